from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from patchlens.operators import candidates, diffs, evaluation, listing, ordered, sampling, scoring, source_features
from patchlens.plans import fixtures, relational


def test_relational(spark):
    rows = {
        "library": [(1, "ssl", "v", "github", True), (2, "xml", "w", "github", True), (3, "old", "w", "x", False)],
        "library_version": [(10, 1, "1.0", True), (11, 1, "1.1", True), (12, 1, "1.2", None), (20, 2, "2.0", True)],
        "library_version_issue": [(10, 100, True), (11, 100, False), (12, 100, True), (20, 101, True)],
        "security_issue": [(100, "CVE-1", True), (101, "CVE-2", True)],
        "vulnerability": [(1000, "CVE-1", True), (1001, "CVE-2", False)],
        "patch_source": [(1000, "https://github.com/a"), (1000, "https://other.org/b"), (1001, "https://github.com/c")],
        "patch": [(5, 1000, "raw5", True), (6, 1000, "raw6", True), (7, 1000, "raw7", False)],
        "patch_hunk": [(5, "h", "a.c", "f", "x", "y"), (6, "h", "b.c", "g", "x", "y")],
    }
    relational.register(spark, {k: spark.createDataFrame(v, relational.VIEWS[k]) for k, v in rows.items()})
    assert relational.library_vulnerabilities(spark, library=1).count() == 2 * 1 * 2  # versions, sources on github, patches
    assert {(r.version_number, r.public_id) for r in relational.affected_versions(spark, [1, 2, 1]).collect()} == {("1.0", "CVE-1"), ("1.1", "CVE-1"), ("2.0", "CVE-2")}
    assert relational.patch_details(spark, ["CVE-1", "CVE-2"]).count() == 4
    assert relational.patch_urls_of_library(spark, 1).count() == 4 and relational.patch_urls_of_library(spark, 2).count() == 0
    assert [(r.library_id, r.version_number) for r in relational.libraries_of_vulnerability(spark, "CVE-1").collect()] == [(1, "1.0")]
    assert relational.vulnerability_count(spark, [1, 2]).first()[0] == 2


def test_hunks(spark):
    p = spark.createDataFrame(fixtures.PATCHES, "patch_id int, raw string")
    got = {(r.patch_id, r.hunk_no): r for r in diffs.hunks(p).collect()}
    assert set(got) == {(1, 1), (1, 2), (3, 0), (3, 1), (5, 0), (6, 0), (7, 1)}
    h = got[1, 1]
    assert (h.change_context, h.start_before, h.size_before, h.start_after, h.size_after) == (" int f(int a)", 1, 3, 1, 4)
    assert h.snippet_before == [" a", "-b", " e"] and h.snippet_after == [" a", "+c", "+d", " e"]
    for r in got.values():
        assert [x for x in r.snippet_before if x[:1] != "-"] == [x for x in r.snippet_after if x[:1] != "+"]
    loose = {(r.patch_id, r.hunk_no): r for r in diffs.hunks(p, strict=False).collect()}
    assert loose[2, 1].size_before == 1 and loose[2, 1].start_after == 5


def test_subsumed_and_overlapped(spark):
    r = random.Random(1)
    lists = [["".join(r.choices("ab", k=r.randint(0, 5))) for _ in range(r.randint(0, 8))] for _ in range(150)]
    d = spark.createDataFrame(list(enumerate(lists)), "i int, l array<string>")
    kept = {x.i: x.l for x in ordered.drop_subsumed(d, "i", "l").collect()}
    joined = {x.i: x.l for x in ordered.drop_overlapped(d, "i", "l", most=2).collect()}
    merged = {x.i: x.l for x in ordered.drop_overlapped(d, "i", "l", most=2, merge=True).collect()}
    for i, l in enumerate(lists):
        s = sorted(l, key=len)
        assert kept[i] == [x for k, x in enumerate(s) if not any(x in y for y in s[k + 1 :])]
        over = [max(k for k in range(min(len(a), len(b)) + 1) if a[len(a) - k :] == b[:k]) for a, b in zip(l, l[1:])]
        assert joined[i] == [x for x, o in zip(l, [*over, 0]) if o <= 2]
        want, open_ = [], ""
        for x, o in zip(l, [*over, 0]):
            open_ += x[: len(x) - o] if o > 2 else x
            if o <= 2:
                want.append(open_)
                open_ = ""
        assert merged[i] == want


def test_merge_adjacent(spark):
    rows = [(1, 1, 10, False, ["a"]), (1, 2, 10, True, ["b"]), (1, 3, 11, False, ["c"]), (1, 4, 10, True, ["d"]), (1, 5, 10, False, ["e"])]
    d = spark.createDataFrame(rows, "f int, n int, line int, again boolean, asm array<string>")
    got = ordered.merge_adjacent(d, ["f"], "n", "line", "asm", joins=F.col("again")).orderBy("n").collect()
    assert [(r.line, r.asm) for r in got] == [(10, ["a", "b"]), (11, ["c"]), (10, ["d"]), (10, ["e"])]


def test_numbering_does_not_depend_on_ranges(spark):
    d = spark.createDataFrame([(i * 7 % 100, i) for i in range(300)], "a int, b int").repartition(5)
    one = {(r.a, r.b): r.seq_id for r in ordered.numbered(d, ["a", "b"]).collect()}
    many = {(r.a, r.b): r.seq_id for r in ordered.numbered(d, ["a", "b"], rows_per_range=20).collect()}
    assert one == many == {k: i for i, k in enumerate(sorted(one))}
    assert {r.batch_id for r in ordered.batches(d, ["a", "b"]).collect()} == set(range(15))


def test_expand_context(spark):
    groups = [["a"], ["b", "c"], ["X", "Y"], ["d"], ["e", "f"], ["g"]]
    d = spark.createDataFrame([(1, i, g, i == 2) for i, g in enumerate(groups)], "k int, o int, items array<string>, answer boolean")
    r = ordered.expand_context(d, ["k"], "o", "items", "answer", 5).first()
    assert (r["items"], r.answer_start, r.answer_end) == (["b", "c", "X", "Y", "d"], 2, 3)
    assert ordered.expand_context(d, ["k"], "o", "items", "answer", 100).first()["items"] == [x for g in groups for x in g]


def test_contained(spark):
    r = random.Random(2)
    hays = [(i, " ".join(r.choices(["a", "bb", "c", "dd"], k=r.randint(0, 12)))) for i in range(60)]
    needles = [(i, t) for i, t in enumerate(["", "a", "bb c", "a bb c", "a  c", "b c d", "dd dd dd", " c ", "c bb a dd"])]
    got = candidates.contained(spark.createDataFrame(needles, "n int, needle string"), spark.createDataFrame(hays, "h int, text string"), "needle", "text")
    assert sorted((x.n, x.h) for x in got.collect()) == sorted((n, h) for n, x in needles for h, t in hays if x in t)


def test_cases(spark):
    case = "id int, binary_name string, is_fixed boolean, functions array<struct<function_name string, vul_source_codes array<string>, patches array<struct<vul_snippet_codes array<string>, fixed_snippet_codes array<string>>>>>"
    p = (["-a", " b"], ["+c", " b"])
    rows = [(1, "x", False, [("f", ["a", "b"], [p])]), (2, "x", True, [("f", ["a", "b"], [p])]), (3, "x", True, [("f", ["c", "b"], [p])]), (4, None, False, [("f", ["a", "b"], [p])]), (5, "x", False, [("f", [], [p])]), (6, "x", False, [])]
    assert [r.id for r in candidates.valid_cases(spark.createDataFrame(rows, case)).collect()] == [1, 3]
    t = spark.createDataFrame([(1, ["f"], True), (2, ["f"], None), (3, [], False), (4, None, False)], "id int, names array<string>, is_fixed boolean")
    assert [(r.has_vul_function, r.has_vul) for r in candidates.ground_truth(t).collect()] == [(True, False), (True, True), (False, False), (False, False)]


def test_pairs_equal_the_product(spark):
    from patchlens.functions import text as T

    names = ["f", "g", "*h", "k", "other", "empty", "*m"]
    s = spark.createDataFrame([(names[i - 1], t.split("\n")) for i, t in fixtures.SOURCES], "src_name string, src_codes array<string>")
    b = spark.createDataFrame(fixtures.BINARY, "bin_name string, asm_codes array<string>")
    got = {(r.src_name, r.bin_name) for r in candidates.candidate_pairs(s, b).collect()}
    x = candidates.prepared_sources(s).filter(F.size("src") > 0).crossJoin(candidates.prepared_binaries(b))
    tests = ~T.is_reserved(F.col("bin_name")) & (F.size("asm") > F.size("src")) & (F.col("header.param_count") == F.col("prologue.param_count"))
    assert got == {(r.src_name, r.bin_name) for r in x.filter(tests | (T.strip_pointer(F.col("src_name")) == F.col("bin_name"))).collect()}
    strict = {(r.src_name, r.bin_name) for r in candidates.candidate_pairs(s, b, keep_name_matches=False).collect()}
    assert strict <= got


def test_whole_decision(spark):
    """Confirmed pairs to located windows, choices and a verdict."""
    asm = [f"op{i}" for i in range(100)]
    rows = [(1, "f", "f", asm, [(["-op80 op81", " same"], ["+op5 op6", " same"])])]
    d = spark.createDataFrame(rows, "case_id int, src_name string, bin_name string, asm_codes array<string>, patches array<struct<vul_snippet_codes array<string>, fixed_snippet_codes array<string>>>")
    w = scoring.locate_inputs(d)
    assert w.count() == 3
    w = w.withColumn("prob", scoring.overlap_score(F.col("question"), F.col("context")))
    found = scoring.located(w.filter("prob > 0"), 0.1).withColumn("pred_text", F.lit("op80"))
    assert [(r.window_no, r.patch_no) for r in found.collect()] == [(1, 0)]
    c = scoring.choice_inputs(found)
    assert c.first().texts.text_0 == "op80 op81 same" and c.first().snippet.startswith("op80 op81")
    c = c.withColumn("vul_score", scoring.overlap_score(F.col("texts.text_0"), F.col("snippet"))).withColumn("fix_score", scoring.overlap_score(F.col("texts.text_1"), F.col("snippet")))
    v = scoring.score_verdict(c, ["case_id"]).first()
    assert v.is_fixed is False
    assert scoring.scored(w, "question", "context", name="s").filter("abs(s - prob) > 1e-12").count() == 0


def test_token_span(spark):
    d = spark.createDataFrame([([(0, 0), (0, 2), (0, 0), (0, 0), (0, 3), (3, 5), (5, 9), (0, 0)], 3, 6), ([(0, 0)], -1, -1)], "o array<struct<s int, e int>>, a int, b int")
    assert [tuple(r[0]) for r in d.select(evaluation.token_span(F.col("o"), F.col("a"), F.col("b"), 350)).collect()] == [(5, 6), (0, 349)]


def test_listing_variants(spark):
    l = spark.createDataFrame(fixtures.LISTING_ROWS, "binary string, line_no int, line string")
    assert {r.function_name: len(r.asm_codes) for r in listing.flat_functions(l).collect()} == {"helper": 7, "parse_len": 6}
    assert listing.any_text_section(l).count() == listing.text_section(l).count() - 2
    s = listing.snippets(listing.split_functions(listing.text_section(l), last_wins=False), home="/root").collect()
    assert {(r.function_name, r.line_position): (len(r.src_lines), len(r.asm_lines)) for r in s}["parse_len", "/root/__tmp/x/parse.c:12"] == (2, 2)


def test_splits_and_partners(spark):
    d = spark.createDataFrame([(i, i % 3, f"t{i // 2}") for i in range(205)], "id int, g int, t string")
    a = {r.id: r.split for r in sampling.split_80_10_10(d, "id").collect()}
    assert sorted(a.values()).count("train") == 164 and list(a.values()).count("valid") == 20 and list(a.values()).count("test") == 21
    assert a == {r.id: r.split for r in sampling.split_80_10_10(d.repartition(7), "id").collect()}
    p = sampling.partners(d, "id", ["g"], "t").collect()
    assert len(p) > 190 and all(r.t != r.partner and r.id % 3 == r.partner_id % 3 for r in p)
    n = sampling.negative_pairs(d.withColumn("asm", F.split("t", "")), "id", ["g"], "asm").collect()
    assert all(r.label == 0 for r in n)


def test_fuzzy_ratio(spark):
    def lcs(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    r = random.Random(5)
    for _ in range(300):
        a, b = ("".join(r.choices("abc", k=r.randint(0, 9))) for _ in range(2))
        assert sampling.common_length(a, b) == lcs(a, b)
    d = spark.createDataFrame([("abc", "abd"), ("", ""), (None, "x")], "a string, b string")
    assert [x[0] for x in d.select(sampling.fuzzy_ratio_udf()("a", "b")).collect()] == [pytest.approx(200 * 2 / 6), 100, 0]


def test_training_text(spark):
    def plain(src, asm, most):
        at, ops, steps = 1, 3, 0
        each = round(len(asm) / len(src)) if src else 0
        show = lambda: f"S {' '.join(src[:at])} | A {' '.join(asm[:ops])}"
        while at <= len(src) and ops <= len(asm) and (not steps or len(show()) <= most):
            brief = src[at] if at < len(src) else src[-1]
            at, ops, steps = at + (2 if len(brief) == 1 or brief == '"STR"' else 1), ops + each, steps + 1
        return show()

    r = random.Random(12)
    word = lambda: r.choice(["}", "{", '"STR"', "", "ab", "line of code", "é", "x" * 40])
    rows = [([word() for _ in range(r.choice([0, 1, 2, 5, 30, 200]))], [word() for _ in range(r.choice([0, 1, 3, 7, 60, 500]))]) for _ in range(150)]
    rows += [(["a b", "}", "c", "d"], [str(i) for i in range(8)]), (["one"], ["x"]), ([""] * 300, [""] * 900), (["line " * 30] * 40, ["op " * 10] * 80)]
    d = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)] + [(-1, None, None)], "i int, s array<string>, a array<string>")
    for most in (1000, 60):
        got = dict(d.select("i", sampling.train_text(F.col("s"), F.col("a"), ("S", "|", "A"), most)).collect())
        assert got.pop(-1) == "S  | A "
        assert got == {i: plain(*x, most) for i, x in enumerate(rows)}


def test_random_partners(spark):
    rows = [(i, i % 3 or None, f"t{i}") for i in range(600)] + [(1000, 9, "alone")]
    got = {x.id: x for x in sampling.random_partners(spark.createDataFrame(rows, "id int, g int, t string"), "id", ["g"], "t").collect()}
    assert set(got) == {x[0] for x in rows} and got[1000].partner_id == 1000
    of = {x[0]: x for x in rows}
    assert all(of[x.partner_id][1] == x.g and of[x.partner_id][2] == x.partner for x in got.values())
    assert len({x.partner_id for x in got.values()}) > 300 and any(x.partner_id == i for i, x in got.items() if i < 1000)


def test_source_features():
    code = '''#include "x.h"
#define NAME "macro"
static const char *msgs[] = { "one" "two", NAME };
int plain = 3;
/* int no(void) { return "c"; } */
int *f(int a, char *b)
{
    if (a > 0x10) { puts("in { f"); }
#ifdef DEBUG
    log("dbg", 7);
#endif
    return 42;
}
namespace n { void g() { h(NAME); } }
'''
    got = source_features.features(code)
    assert [(f["name"], f["node_type"], f["line_start"], f["line_end"]) for f in got] == [("*msgs", "pointer_declarator", 3, 3), ("*f", "pointer_declarator", 6, 13), ("g", "function_declarator", 14, 14)]
    assert got[0]["strings"] == ["onetwo", "macro"]
    assert got[1]["strings"] == ["in { f"] and got[1]["conditional_strings"] == [["dbg"]] and got[1]["numbers"] == ["0x10", "7", "42"]
    assert got[2]["strings"] == ["macro"] and source_features.all_strings(code) == ["onetwo", "in { f", "dbg"]


def test_extracted_functions(spark):
    d = spark.createDataFrame([("a.c", b"int f(void) { return 1; }\nint f(int x) { return 2; }"), ("b.c", b"\xff\xfe{"), ("c.c", None)], "path string, content binary")
    found = source_features.extract(d)
    assert found.count() == 2
    one = source_features.as_record(source_features.pick(found, spark.createDataFrame([("a.c", "*f")], "path string, name string"))).collect()
    assert len(one) == 1 and one[0].line_start == 1


def test_project_is_read_end_to_end(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "test").mkdir()
    (tmp_path / "src" / "a.c").write_text('int f(void) { puts("one"); }\nint x = g("two");\n')
    (tmp_path / "src" / "B.HP").write_text('int k(void) { return 1; }\n')
    (tmp_path / "src" / "c.txt").write_text("int no(void) {}")
    (tmp_path / "src" / "empty.c").write_text("")
    (tmp_path / "test" / "t.c").write_text("int t(void) { }")
    found, by_file = source_features.project(spark, str(tmp_path), spark.createDataFrame([("test",)], "keyword string"))
    assert sorted((r.path.split("/")[-1], r.name) for r in found.collect()) == [("B.HP", "k"), ("a.c", "f"), ("a.c", "x")]
    assert {(r.path.split("/")[-1], r.n_strings, r.n_missing) for r in by_file.collect()} == {("a.c", 2, 0), ("B.HP", 0, 0)}


def test_perturbations_keep_the_rest(spark):
    d = spark.createDataFrame([(i, [f"op{k}" for k in range(n)]) for i, n in enumerate([0, 1, 2, 3, 29, 30, 31, 100] * 5)], "i int, l array<string>")
    rows = d.select("i", "l", sampling.perturbed_asm(F.col("i"), F.col("l")).alias("a"), sampling.perturbed_src(F.col("i"), F.col("l")).alias("s")).collect()
    for r in rows:
        n = len(r.l)
        assert len(r.a) == n and r.a[30:] == r.l[30:] and set(r.a) <= set(r.l) and (n > 2 or r.a == r.l)
        assert max(0, n - 3) <= len(r.s) <= n + 3 and set(r.s) <= set(r.l)
    assert sum(r.a != r.l for r in rows if len(r.l) > 2) >= 20 and len({tuple(r.s) for r in rows if len(r.l) == 100}) == 5


def test_legacy_filter_without_effective_lines(spark):
    d = spark.createDataFrame([(["}"], ["endbr64"] * 9, 0, 0), (["int a = f(b);"] * 3, ["endbr64"] * 9, 1, 1), (["int a = f(b);"] * 3, ["nop"] * 9, 1, 1)], "src_codes array<string>, asm array<string>, src_params int, asm_params int")
    assert [len(r.src_codes) for r in candidates.legacy_filter(d).collect()] == [3]


def test_keywords_against_every_pair(spark):
    r = random.Random(7)
    part = lambda: "".join(r.choices("ab/c", k=r.randint(0, 6)))
    paths = ["/".join(part() for _ in range(r.randint(1, 4))) for _ in range(200)] + ["", None]
    words = [part() for _ in range(12)] + ["abcabc", "a", "ab/c"]
    got = sorted(x.p for x in candidates.without_keywords(spark.createDataFrame([(p,) for p in paths], "p string"), "p", spark.createDataFrame([(w,) for w in words], "k string"), "k").collect() if x.p is not None)
    hit = lambda p: any((f"/{w}/" if len(w) <= 5 else w) in p for w in words)
    assert got == sorted(p for p in paths if p is not None and not hit(p))


def test_contained_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(candidates, "BROADCAST_ROWS", 0)
    test_contained(spark)


def test_partners_of_one_hot_group(spark):
    d = spark.createDataFrame([(i, 0, f"t{i}") for i in range(300)] + [(1000, 1, "alone"), (1001, None, "p"), (1002, None, "q")], "id int, g int, t string")
    got = {r.id: r.partner_id for r in sampling.partners(d, "id", ["g"], "t").collect()}
    assert set(got) == {*range(300), 1001, 1002} and got[1001] == 1002 and sorted(v for k, v in got.items() if k < 300) == list(range(300))
    ranks = ordered.ranked(d, ["g"], ["id"]).collect()
    assert all(r["rank"] == r.id and r.group_size == 300 for r in ranks if r.g == 0)
    lists = ordered.group_lists(d, ["g"], "id", 70).collect()
    assert sorted(len(r["items"]) for r in lists) == [1, 2, 20, 70, 70, 70, 70]


def test_shared_folder_on_a_cluster(spark, monkeypatch):
    from patchlens.sources import shared

    class Remote:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(RuntimeError):
        shared.shared_folder(Remote)
