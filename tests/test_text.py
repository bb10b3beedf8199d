from __future__ import annotations

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from patchlens.functions import text as T


def column(spark, values, f, kind="string"):
    d = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[1] for r in d.select("i", f(F.col("v")).alias("r")).orderBy("i").collect()]


def test_instructions(spark):
    cases = {
        "  10:\t55 \tpush   rbp": "push rbp",
        "a\tb": None,
        "MOV  DWORD PTR [rbp-0x4], EAX ; x": "mov <MEM>,eax",
        "jne    1158 <f+0x1f>": "jne <LOC>",
        "js 1158 <f+0x1f>": "js 1158 <f+OFFSET>",
        "jmp short 10 <f>": "jmp <LOC>",
        "call 1030 <strlen@plt>": "call <strlen@plt>",
        "lea rax,[rip+0x2e]        # 2010 <x>": "lea rax,<MEM>",
        "": "",
    }
    assert column(spark, list(cases), T.normalize_asm) == list(cases.values())


def test_comments(spark):
    cases = {
        "a /* b */ c": "a  c",
        '"/* s */" x': '"/* s */" x',
        "'\"' /* y */ \"z\\\"/*\"": "'\"'  \"z\\\"/*\"",
        "a // b": "a // b",
        "/*** x ***/y": "y",
        "": "",
        "/* " + "* " * 50_000 + "*/ok": "ok",
        '"' + "\\a" * 50_000 + '"': '"' + "\\a" * 50_000 + '"',
    }
    assert column(spark, list(cases), T.remove_comments) == list(cases.values())


def windows(items, length, step):
    if len(items) <= length:
        return [items]
    out = [items[i : i + length] for i in range(0, len(items) - length + 1, step)]
    return out if (len(items) - length) % step == 0 else [*out, items[-length:]]


@pytest.mark.parametrize(("length", "step"), [(70, 20), (50, 20), (200, 80), (3, 2)])
def test_windows(spark, length, step):
    lists = [[str(i) for i in range(n)] for n in [0, 1, 2, 3, 4, 5, 49, 50, 51, 69, 70, 71, 89, 90, 91, 199, 200, 201, 280, 299]]
    assert column(spark, lists, lambda c: T.sliding_windows(c, length, step), "array<string>") == [windows(x, length, step) for x in lists]


def test_header_and_prologue(spark):
    sources = [["int f(int a, int b) {", "}"], ["void f(void)", "{"], ["f(...)", "{"], ["g(a,b,c,d,e,f,g) {"], ["h(a, ...) {"], []]
    got = column(spark, sources, T.source_header, "array<string>")
    assert [(r.body_start, r.param_count) for r in got] == [(1, 2), (2, 0), (2, 6), (1, 6), (1, 6), (1, 0)]
    asm = [["push", "mov <MEM>,edi", "mov <MEM>,esi", "nop", "mov <MEM>,eax"], ["mov <MEM>,edi"], ["x", "nop", "movss <MEM>,xmm0"], ["x", "mov <MEM>,0x0", "mov <MEM>,edi"], ["x"] + ["mov <MEM>,edi"] * 30, []]
    got = column(spark, asm, T.asm_prologue, "array<string>")
    assert [(r.body_start, r.param_count) for r in got] == [(3, 2), (1, 0), (3, 1), (3, 1), (20, 6), (1, 0)]


def test_names_and_urls(spark):
    assert column(spark, ["_A", "__a", "a__b", "_a", "a_b"], T.is_reserved) == [True, True, True, False, False]
    assert column(spark, ["http://h/x?p=a;h=b", "http://h/x?a=1&p=2#f", "http://h/"], lambda c: T.url_query(c, "p")) == ["a", "2", None]
    assert [tuple(r) for r in column(spark, ["https://h/own/rep/commit/1"], T.owner_and_repo)] == [("own", "rep")]
    assert column(spark, [" static int f(int a)", "no call", " int *g (x)"], T.function_of_context) == ["f", None, "*g"]
    assert column(spark, ["/b/__tmp/./x/y.c"], lambda c: T.function_key(c, F.lit("f"))) == ["x/y.c__f"]
    got = column(spark, ["a/b.c:12", "a:b.c:7 (discriminator 3)", "a.c:?"], T.line_position)
    assert [tuple(r) for r in got] == [("a/b.c", 12, False), ("a:b.c", 7, True), ("a.c", None, False)]


def test_first_difference_and_choices(spark):
    d = spark.createDataFrame([(["a", "b"], ["a", "c"]), (["a"], ["a", "b"]), ([], ["x"]), (["x /* c */", "y"], ["z", "y"])], "a array<string>, b array<string>")
    got = d.select(T.first_difference(F.col("a"), F.col("b")).alias("k"), T.choice_texts(F.col("a"), F.col("b")).alias("t")).collect()
    assert [r.k for r in got] == [1, 0, 0, 0]
    assert tuple(got[0].t) == ("b", "c") and tuple(got[3].t) == ("x  y", "z y")


def test_locate_suffix(spark):
    d = spark.createDataFrame([(["a", "b", "c", "b"], "b"), (["a", "b", "c"], "b c"), (["a"], "z"), ([], "z")], "l array<string>, t string")
    assert [r[0] for r in d.select(T.locate_suffix(F.col("l"), F.col("t"), 2)).collect()] == [["b"], ["b", "c"], [], []]


def test_labels(spark):
    got = column(spark, [[0.0, 2.0, 2.0], [1.0]], T.arg_max_label, "array<double>")
    assert got[0].label == 1 and got[0].prob == pytest.approx(0.46831053) and tuple(got[1]) == (0, 1.0)


def test_trimmed_record(spark):
    d = spark.createDataFrame([(" a ", " 7.5 "), (None, "0"), ("b", "x")], "name string, score string")
    assert [tuple(r) for r in T.trimmed_record(d, {"score": "double"}).collect()] == [("a", 7.5), (None, None), ("b", None)]


def without(text: str) -> str:
    out, i = [], 0
    while i < len(text):
        if text.startswith("/*", i) and "*/" in text[i + 2 :]:
            i = text.index("*/", i + 2) + 2
        elif text[i] in "\"'":
            q, j = text[i], i + 1
            while j < len(text) and text[j] != q:
                j += 2 if text[j] == "\\" else 1
            if j < len(text):
                out.append(text[i : j + 1])
                i = j + 1
            else:
                out.append(text[i])
                i += 1
        else:
            out.append(text[i])
            i += 1
    return "".join(out)


def test_random_comments(spark):
    r = random.Random(3)
    texts = ["".join(r.choices(["/*", "*/", "*", "/", "a", " "], k=r.randint(0, 12))) for _ in range(300)] + ["".join(r.choices(['"x"', '"/*"', "'", "/* c */", "b", "\n"], k=r.randint(0, 8))) for _ in range(100)]
    texts = [t for t in texts if t.count("'") % 2 == 0]
    assert column(spark, texts, T.remove_comments) == [without(t) for t in texts]


@settings(max_examples=20, deadline=None)
@given(st.lists(st.text("ab c\t\n-+{", max_size=30), min_size=1, max_size=20))
def test_content_hash_ignores_blanks_and_braces(spark, texts):
    assert column(spark, texts, T.content_hash) == column(spark, [t.replace(" ", "").replace("{", "\t") for t in texts], T.content_hash)
