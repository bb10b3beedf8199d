"""Features of functions and declarations in C and C++ sources, by a lexical scan.

No parser library is needed: comments, literals, preprocessor lines and braces
are recognised in one pass over a file's tokens. Files are rows and stay apart.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchlens.operators.candidates import without_keywords
from patchlens.operators.stats import file_stats, guarded_files
from patchlens.sources.files import SOURCE_SUFFIXES, has_suffix

SCHEMA = (
    "path string, name string, node_type string, line_start int, line_end int, original_lines array<string>, strings array<string>, "
    "conditional_strings array<array<string>>, numbers array<string>, hash_value string"
)
_TOKEN = re.compile(
    r"""(?P<comment>/\*.*?(?:\*/|\Z)|//[^\n]*)|(?P<string>"(?:[^"\\\n]|\\.)*")|(?P<char>'(?:[^'\\\n]|\\.)*')|(?P<directive>(?m:^)[ \t]*\#(?:[^\n\\]|\\.)*)"""
    r"""|(?P<number>\b(?:0[xX][0-9a-fA-F]+|[0-9]+(?:\.[0-9]+)?)[uUlLfF]*\b)|(?P<word>[A-Za-z_]\w*)|(?P<other>[{}()\[\];=,*])""",
    re.S | re.M,
)
_CONTROL = {"if", "for", "while", "switch", "return", "sizeof", "else", "do", "catch"}


class Token(NamedTuple):
    kind: str
    text: str
    line: int


def tokens(source: str) -> Iterator[Token]:
    line, at = 1, 0
    for m in _TOKEN.finditer(source):
        line += source.count("\n", at, m.start())
        at = m.start()
        yield Token(m.lastgroup or "", m[0].strip(), line)


def content_hash(lines: list[str]) -> str:
    return hashlib.md5(re.sub(r"[\n\r\t{} ]", "", "".join(lines)).lower().encode()).hexdigest()


def all_strings(source: str) -> list[str]:
    """Every string literal outside of directives; adjacent ones are one."""
    out: list[str] = []
    glued = False
    for t in tokens(source):
        if t.kind == "string":
            if glued:
                out[-1] += t.text[1:-1]
            else:
                out.append(t.text[1:-1])
            glued = True
        elif t.kind != "comment":
            glued = False
    return out


def _groups(body: list[Token], macros: dict[str, str]) -> tuple[list[str], list[list[str]], list[str]]:
    """Strings that are always compiled, those of each outermost conditional, and distinct numbers."""
    must: list[str] = []
    conditional: list[list[str]] = []
    numbers: list[str] = []
    depth, glued = 0, False
    for t in body:
        text = t.text[1:-1] if t.kind == "string" else macros.get(t.text) if t.kind == "word" else None
        if t.kind == "directive":
            word = re.match(r"#\s*(\w+)", t.text)
            if word and word[1] in ("if", "ifdef", "ifndef"):
                if not depth:
                    conditional.append([])
                depth += 1
            elif word and word[1] == "endif":
                depth = max(0, depth - 1)
        elif text is not None:
            group = conditional[-1] if depth else must
            if glued and group:
                group[-1] += text
            else:
                group.append(text)
        elif t.kind == "number" and t.text not in numbers:
            numbers.append(t.text)
        if t.kind != "comment":
            glued = text is not None
    return must, [g for g in conditional if g], numbers


def features(source: str) -> list[dict]:
    """Functions with a body, and declarations whose value has strings, in order.

    node_type is that of the declarator: pointer_declarator (its name starts
    with `*`), function_declarator, array_declarator or identifier.
    """
    lines = source.split("\n")
    every = list(tokens(source))
    macros = {m[1]: m[2] for t in every if t.kind == "directive" and (m := re.match(r'#\s*define\s+(\w+)\s+"(.*)"\s*$', t.text, re.S))}
    out: list[dict] = []

    def add(name: str, head: list[Token], is_function: bool, first: int, last: int, body: list[Token]) -> None:
        must, conditional, numbers = _groups(body, macros)
        if not is_function and not must and not conditional:
            return
        marks = {h.text for h in head}
        kind = "pointer_declarator" if "*" in marks else "function_declarator" if is_function else "array_declarator" if "[" in marks else "identifier"
        name = "*" * ("*" in marks) + name
        own = lines[first - 1 : last]
        out.append({"name": name, "node_type": kind, "line_start": first, "line_end": last, "original_lines": [x.rstrip() for x in own], "strings": must, "conditional_strings": conditional, "numbers": numbers, "hash_value": content_hash(own)})

    code = [t for t in every if t.kind not in ("comment",)]
    i, start = 0, 0
    while i < len(code):
        t = code[i]
        if t.kind == "directive":
            start = i + 1
        elif t.text in (";", "}"):
            head = code[start:i]
            eq = next((k for k, h in enumerate(head) if h.text == "="), None)
            if t.text == ";" and eq:
                names = [h.text for h in head[:eq] if h.kind == "word"]
                if names:
                    add(names[-1], head[:eq], False, head[0].line, t.line, head[eq + 1 :])
            start = i + 1
        elif t.text == "{":
            head = code[start:i]
            depth, end = 0, i
            while end < len(code):
                depth += {"{": 1, "}": -1}.get(code[end].text, 0)
                if not depth:
                    break
                end += 1
            paren = next((k for k, h in enumerate(head) if h.text == "("), None)
            name = head[paren - 1] if paren else None
            if any(h.text == "=" for h in head):  # an initialiser: its declaration ends at the semicolon
                i = end + 1
                continue
            if name and name.kind == "word" and name.text not in _CONTROL:
                last = code[min(end, len(code) - 1)]
                add(name.text, head[: paren], True, head[0].line, last.line, code[i : end + 1])
                i, start = end + 1, end + 1
                continue
            start = i + 1  # a namespace, class or extern block: go on inside
        i += 1
    return out


def extract(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """A row per function or declaration of every file; rows of files that can't be decoded are empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.strip().split(" ")[0] for c in re.split(r",\s*(?![^<]*>)", SCHEMA)]
        for b in batches:
            rows = []
            for p, c in zip(b["path"], b["content"]):
                if isinstance(c, (bytes, bytearray)):
                    try:
                        c = bytes(c).decode()
                    except UnicodeDecodeError:
                        continue
                rows += [{"path": p, **f} for f in features(c or "")]
            yield pd.DataFrame(rows, columns=names)

    return files.select(F.col(path).alias("path"), F.col(content).alias("content")).mapInPandas(run, SCHEMA)


def pick(found: DataFrame, wanted: DataFrame) -> DataFrame:
    """The first function of a file with the wanted name, with or without a leading `*`. wanted: path, name."""
    from pyspark.sql.window import Window as W

    d = found.withColumn("key", F.regexp_replace("name", r"^\*\s*", ""))
    j = d.join(wanted.select("path", F.regexp_replace("name", r"^\*\s*", "").alias("key")), ["path", "key"])
    return j.withColumn("r__", F.row_number().over(W.partitionBy("path", "key").orderBy("line_start"))).filter("r__ = 1").drop("r__", "key")


def as_record(found: DataFrame, node_types: tuple[str, ...] | None = ("function_declarator", "function_definition", "pointer_declarator")) -> DataFrame:
    """Features of the given node types (None: of all); all strings of a feature in one array, always compiled ones first."""
    kept = found if node_types is None else found.filter(F.col("node_type").isin(*node_types))
    return kept.withColumn("strings", F.concat("strings", F.flatten("conditional_strings"))).drop("conditional_strings", "node_type")


def file_strings(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """path, strings: every string literal of each file; none of one that can't be decoded."""

    @F.pandas_udf("array<string>")
    def every(column: pd.Series) -> pd.Series:
        def one(c):
            try:
                return all_strings(bytes(c).decode() if isinstance(c, (bytes, bytearray)) else c or "")
            except UnicodeDecodeError:
                return []

        return pd.Series([one(c) for c in column], dtype=object)

    return files.select(F.col(path).alias("path"), every(content).alias("strings"))


def project(spark: SparkSession, folder: str, keywords: DataFrame | None = None, keyword: str = "keyword") -> tuple[DataFrame, DataFrame]:
    """(features, statistics by file) of all C and C++ sources below a folder.

    Files are found, those in excluded directories or too large left out, and
    the rest parsed, one file at a time; what is read from one file stays with
    its path. Statistics compare all strings of a file with those its features have.
    """
    d = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).filter(has_suffix(F.col("path"), SOURCE_SUFFIXES) & (F.col("length") > 0))
    if keywords is not None:
        d = without_keywords(d, "path", keywords, keyword)
    d = guarded_files(d, "length").select("path", "content")
    found = extract(d)
    covered = as_record(found, None).groupBy("path").agg(F.flatten(F.collect_list("strings")).alias("covered"))
    every = file_strings(d).join(covered, "path", "left").withColumn("covered", F.coalesce("covered", F.array().cast("array<string>")))
    return found, file_stats(every, ["path"], "strings", "covered")
