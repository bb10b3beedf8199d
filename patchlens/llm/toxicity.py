"""Toxicity: a weighted lexicon, learned from labelled documents, matched by Aho-Corasick in folded text."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from patchlens.llm.bpe import Remembering
from patchlens.llm.common import cut, slices, small_batches

#: Letters of other scripts that look like Latin ones, in pairs.
LOOKALIKES = dict(zip("авеёікмнорсстухцѕјԁԛԝһαβγεηικνορτυχωℓıƅɡ", "abeeikmhopcctyxusjdqwhabyenikvoptuxwlibg"))
#: Digits and signs that stand for letters inside a word; `l` goes with `i`, for which `1` can stand as well.
STAND_INS = dict(zip("0134578@$!|", "oieastbasii"))
_FOLD = str.maketrans(LOOKALIKES)
_WORD_FOLD = str.maketrans(STAND_INS | {"l": "i"})
_INVISIBLE = re.compile("[­​-‏⁠﻿]+")
_TOKEN = re.compile(r"[\w@$!|]+")
_LETTER, _STRETCHED = re.compile(r"[^\W\d_]"), re.compile(r"([^\W\d_])\1{2,}")
#: Share of wrong entries that the lexicon may have by chance.
FALSE_SHARE = 0.05
#: The lexicon has at most so many terms, and as many exceptions: those with the strongest evidence.
TERMS = 20_000
#: Words that are added to a text's length: a match in a very short text alone proves little.
LENGTH = 20
#: Clean documents that must have a phrase for it to be an exception.
EXCEPTION_SUPPORT = 3
#: Words that a worker remembers in folded form.
REMEMBERED = 150_000


def fold(token: str) -> str:
    """A word in the form in which words are compared; '' for what has no letter or digit.

    Compatibility forms, case, lookalikes of other scripts and letters
    stretched to three or more become plain; digits and signs are letters in a
    word that has a letter.
    """
    t = unicodedata.normalize("NFKC", token).lower().translate(_FOLD)
    if not _LETTER.search(t):
        return re.sub(r"[^\w]|_", "", t)
    t = t.rstrip("!|").replace("_", "").translate(_WORD_FOLD)
    return _STRETCHED.sub(r"\1", t)


#: Folded forms of the words a worker has met.
_folded = Remembering({}, fold, REMEMBERED)


def tokens(text: str | None) -> list[str]:
    """The folded words of a whole text."""
    text = text or ""
    if _INVISIBLE.search(text):
        text = _INVISIBLE.sub("", text)
    return [w for w in map(_folded.__getitem__, _TOKEN.findall(text)) if w]


def evidence(clean: int, toxic: int, base: float) -> float:
    """Minus the log of a bound on the chance that so many of a term's documents are toxic (Chernoff's), 0 where they aren't more than usual."""
    n = clean + toxic
    rate = toxic / n if n else 0
    if rate <= base:
        return 0.0
    return toxic * math.log(rate / base) + (clean * math.log((1 - rate) / (1 - base)) if clean else 0)


def weight(clean: int, toxic: int, all_clean: int, all_toxic: int) -> float:
    """Log odds that a document with the term is toxic, against one at large."""
    return math.log((toxic + 0.5) / (all_toxic + 1)) - math.log((clean + 0.5) / (all_clean + 1))


class Lexicon:
    """Terms with the numbers of clean and toxic documents that have them, and phrases in which they don't count."""

    def __init__(self, terms: dict[str, tuple[int, int]], documents: tuple[int, int], least: float, exceptions: tuple[str, ...] = (), given: dict[str, float] | None = None):
        self.terms, self.documents, self.least, self.exceptions, self.given = terms, documents, least, exceptions, given or {}
        self.base = documents[1] / max(1, sum(documents))
        self._automaton = None

    def __getstate__(self):
        return self.__dict__ | {"_automaton": None}

    def of(self, term: str, label: int | None = None) -> float:
        """A term's weight; with `label`, as if one document of that label had not been counted."""
        if term in self.given:
            return self.given[term]
        seen, every = list(self.terms[term]), list(self.documents)
        if label is not None:
            seen[label] -= 1
            every[label] -= 1
            if evidence(*seen, self.base) < self.least:
                return 0.0
        return weight(*seen, *every)

    @property
    def automaton(self):
        """Over the terms and exceptions, each between spaces; made once in each worker."""
        if self._automaton is None:
            self._automaton = ahocorasick.Automaton()
            for e in self.exceptions:
                self._automaton.add_word(f" {e} ", (len(e) + 2, None, 0.0))
            for t in {**self.terms, **self.given}:
                self._automaton.add_word(f" {t} ", (len(t) + 2, t, self.of(t)))
            if len(self._automaton):
                self._automaton.make_automaton()
        return self._automaton

    def matches(self, words: list[str]) -> list[tuple[int, int, str, float]]:
        """(start, end, term, weight) in the words joined by spaces, without those inside an exception."""
        if not words or not len(self.automaton):
            return []
        found, free = [], []
        for end, (size, term, w) in self.automaton.iter(f" {' '.join(words)} "):
            (found if term is not None else free).append((end - size + 1, end, term, w))
        if not free:
            return found
        return [m for m in found if not any(a <= m[0] and m[1] <= b for a, b, _, _ in free)] if len(free) < 8 else _outside(found, free)


def _outside(found: list[tuple], free: list[tuple]) -> list[tuple]:
    """Those of `found` that lie in none of `free`: the one that starts last before a match, among those that reach furthest, decides."""
    free = sorted(free, key=lambda m: m[0])
    starts = np.array([m[0] for m in free])
    reach = np.maximum.accumulate([m[1] for m in free])
    at = np.searchsorted(starts, [m[0] for m in found], "right") - 1
    return [m for m, k in zip(found, at.tolist()) if k < 0 or reach[k] < m[1]]


def density(total: float, n_words: int) -> float:
    """Weight for each hundred words, on a log scale."""
    return math.log1p(max(0.0, 100 * total / (n_words + LENGTH)))


def curve(x: np.ndarray, y: np.ndarray, penalty: float = 0.05) -> tuple[float, float]:
    """Intercept and slope of a logistic curve by Newton's steps, the slope held from growing without bound."""
    at = np.zeros(2)
    if not len(x):
        return 0.0, 0.0
    design = np.stack([np.ones(len(x)), x], 1)
    held = np.array([1e-3, penalty])
    for _ in range(50):
        p = 1 / (1 + np.exp(-design @ at))
        step = np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + np.diag(held), design.T @ (y - p) - held * at)
        at += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(at[0]), float(at[1])


def _each(frame: DataFrame, schema: str, f) -> DataFrame:
    """`f` over lists of (label, words) of slices of the sample; it yields lists of columns."""

    def run(batches):
        for b in batches:
            for part in slices(iter([b]), 1):
                columns = f([(y, tokens(t)) for y, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist())])
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [n for n, _ in named])

    named = [x.split() for x in schema.split(", ")]
    kinds = [{"string": pa.string(), "bigint": pa.int64(), "double": pa.float64()}[k] for _, k in named]
    return frame.mapInArrow(run, schema)


def _counted(pairs: Iterator[tuple[int, str]]) -> list[list]:
    """Columns term, clean, toxic of (label, term) pairs."""
    seen: dict[str, list[int]] = defaultdict(lambda: [0, 0])
    for y, term in pairs:
        seen[term][y] += 1
    return [list(seen), [v[0] for v in seen.values()], [v[1] for v in seen.values()]]


def labelled_sample(docs: DataFrame, labels: DataFrame, per_label: int) -> tuple[DataFrame, tuple[int, int]]:
    """At most `per_label` documents of each label, those with the least md5 of their ids, as (label, text), and how many ids have each label.

    An id with both labels is toxic; of several texts of an id that with the
    least md5 counts. The labels' sample is bounded, so it is broadcast to find
    its texts.
    """
    l = labels.filter("id is not null and toxic is not null").groupBy("id").agg(F.max("toxic").alias("toxic")).withColumn("key", F.md5(F.col("id").cast("string")))
    sizes = {r["toxic"]: r["n"] for r in l.groupBy((F.col("toxic") > 0).cast("int").alias("toxic")).agg(F.count("*").alias("n")).collect()}
    below = F.lit(False)
    for y, n in sizes.items():
        share = (1.5 * per_label + 10) / n
        below |= ((F.col("toxic") > 0).cast("int") == y) & (F.lit(share >= 1) | (F.col("key") < f"{int(min(share, 1) * (16**12 - 1)):012x}"))
    l = l.filter(below).select("id", "key", (F.col("toxic") > 0).cast("long").alias("label"))
    l = l.withColumn("r", F.row_number().over(W.partitionBy("label").orderBy("key", "id"))).filter(F.col("r") <= per_label)
    d = docs.filter("id is not null").join(F.broadcast(l.select("id", "label")), "id")
    d = d.groupBy("id", "label").agg(F.min_by(F.coalesce("text", F.lit("")), F.md5(F.coalesce("text", F.lit("")))).alias("text"))
    return d.select("label", "text"), (sizes.get(0, 0), sizes.get(1, 0))


def learn(sample: DataFrame, given: dict[str, float] | None = None) -> Lexicon:
    """A lexicon from a sample (label 0 or 1, text).

    A term is a word that more toxic documents have than chance explains: with
    terms in the order of their evidence, as many are taken as keep the
    expected share of wrong ones under FALSE_SHARE (Benjamini and Hochberg). A
    phrase of a term and the word before or behind it is an exception if at
    least EXCEPTION_SUPPORT clean documents have it and toxic ones no more
    often than documents at large are toxic. The driver gets at most TERMS of
    either.
    """
    every = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    clean, toxic = every.get(0, 0), every.get(1, 0)
    given = {" ".join(tokens(t)): w for t, w in (given or {}).items()}
    if not toxic or not clean:
        return Lexicon({}, (clean, toxic), 0.0, (), given)
    base = toxic / (clean + toxic)
    words = _each(sample, "term string, clean bigint, toxic bigint", lambda rows: _counted((y, w) for y, ws in rows for w in set(ws)))
    words = cut(words.groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")))
    n, rate = F.col("clean") + F.col("toxic"), F.col("toxic") / (F.col("clean") + F.col("toxic"))
    bound = F.col("toxic") * F.log(rate / base) + F.when(F.col("clean") > 0, F.col("clean") * F.log((1 - rate) / (1 - base))).otherwise(0.0)
    strong = words.filter((n > 0) & (rate > base)).withColumn("bound", bound).filter(F.col("bound") >= -math.log(FALSE_SHARE))
    found = strong.orderBy(F.desc("bound"), "term").limit(TERMS).collect()
    allowed = math.log(words.count() / FALSE_SHARE) if found else 0.0
    taken = max((k for k, r in enumerate(found, 1) if r["bound"] >= allowed - math.log(k)), default=0)
    terms = {r["term"]: (r["clean"], r["toxic"]) for r in found[:taken]}
    lexicon = Lexicon(terms, (clean, toxic), found[taken - 1]["bound"] if taken else 0.0, (), given)

    def phrases(rows):
        for y, ws in rows:
            mine = set()
            for k, w in enumerate(ws):
                if w in terms:
                    mine |= {f"{ws[k - 1]} {w}"} if k else set()
                    mine |= {f"{w} {ws[k + 1]}"} if k + 1 < len(ws) else set()
            yield from ((y, p) for p in mine)

    near = _each(sample, "term string, clean bigint, toxic bigint", lambda rows: _counted(phrases(rows))).groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    near = near.filter((F.col("clean") >= EXCEPTION_SUPPORT) & (F.col("toxic") <= base * n)).orderBy(F.desc("clean"), "term").limit(TERMS)
    return Lexicon(terms, (clean, toxic), lexicon.least, tuple(r["term"] for r in near.collect()), given)


def calibrated(sample: DataFrame, lexicon: Lexicon, labelled: tuple[int, int]) -> tuple[float, float]:
    """The curve from density to probability. Each document of the sample is measured by weights from all others; the share of toxic ones is that of all labels."""

    def measured(rows):
        values = []
        for y, ws in rows:
            counts = Counter(t for _, _, t, _ in lexicon.matches(ws))
            values.append(density(sum(c * lexicon.of(t, y) for t, c in counts.items()), len(ws)))
        return [[y for y, _ in rows], values]

    clean, toxic = labelled
    if not clean or not toxic:
        share = (toxic + 0.5) / (clean + toxic + 1)
        return math.log(share / (1 - share)), 0.0
    found = _each(sample, "label bigint, x double", measured).toArrow()
    y, x = (found.column(c).to_numpy() for c in ("label", "x"))
    order = np.lexsort([y, x])  # sums don't depend on the order of tasks
    a, b = curve(x[order], y[order])
    had = [max(1, int((y == k).sum())) for k in (0, 1)]
    return a + math.log(toxic / clean) - math.log(had[1] / had[0]), b


def score_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    learn_if: Column | None = None,
    per_label: int = 5000,
    lexicon: dict[str, float] | None = None,
    threshold: float = 0.7,
) -> DataFrame:
    """How likely each text is toxic, by the words of its whole text alone.

    `labels`: id_col and label_col (over 0: toxic). From at most `per_label`
    documents of each label for which `learn_if` (a condition on id_col) holds
    a lexicon is learned; `lexicon` adds phrases with weights of the caller's.
    Words are folded (see `fold`), terms and the exceptions are found by one
    automaton, and the weights of the matches outside of exceptions are added
    up and divided by the length; a logistic curve fitted to the sample makes
    that a probability.

    Returns id_col, score (double, 0 to 1), predicted (int: 1 if score >=
    `threshold`). A null or empty text has no matches and gets the score of
    such texts; without labels of both kinds every score is the share of toxic
    labels ((t + 1/2) / (n + 1)), moved by `lexicon` not at all. Null and repeated
    ids stay as rows; an empty table gives an empty result. The documents are
    read once for the sample (no text of others moves) and once to score; a
    text is held whole by one task. The driver and the broadcasts hold the
    sample's labels, at most TERMS terms and exceptions, and a number per
    document of the sample.
    """
    spark = docs.sparkSession
    small_batches(spark)
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    l = labels.filter(F.lit(True) if learn_if is None else learn_if).select(F.col(id_col).alias("id"), F.col(label_col).alias("toxic"))
    sample, labelled = labelled_sample(d, l, per_label)
    sample = cut(sample)
    known = learn(sample, lexicon)
    a, b = calibrated(sample, known, labelled)
    model = spark.sparkContext.broadcast(known)
    kind = d.schema["id"].dataType.simpleString()

    def scored(batches):
        for part in slices(batches, 1):
            out = []
            for t in part.column(1).to_pylist():
                ws = tokens(t)
                out.append(1 / (1 + math.exp(-min(max(a + b * density(sum(m[3] for m in model.value.matches(ws)), len(ws)), -700), 700))))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.float64())], ["id", "score"])

    return d.mapInArrow(scored, f"id {kind}, score double").select(F.col("id").alias(id_col), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
