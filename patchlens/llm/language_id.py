"""Language identification: known words by log frequency, unseen ones by ever shorter character n-grams."""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from patchlens.llm.bpe import blocks, load
from patchlens.llm.common import slices, small_batches
from patchlens.llm.hashing import piece_hashes

LONGEST = 5
#: Characters of a known n-gram (word boundaries included) from which on it explains an unseen word.
EXPLAINS = 3
#: Words of average evidence that a score is based on: with all words of a long text every posterior would be 1.
EVIDENCE = 10
#: Words whose n-grams the driver holds at once.
TOGETHER = 16_384
#: Words a worker remembers.
REMEMBERED = 60_000
_WORD = re.compile(r"[^\W\d_]+")


class Model:
    """Log probabilities by language. words, grams: sorted 64-bit hashes of the known ones, which are the rows of `rows` in this order; its columns are `langs`."""

    def __init__(self, langs: list[str], prior: np.ndarray, words: np.ndarray, grams: np.ndarray, rows: np.ndarray):
        self.langs, self.prior, self.words, self.grams, self.rows = langs, prior, words, grams, rows
        self.places: dict[str, int] = {}  # what a worker adds: words it has met, and their rows of its table
        self.table: np.ndarray | None = None

    def remembered(self, words: list[str]) -> tuple[list[int], np.ndarray]:
        """Places of words in a table of scores (last column: 1 if the word is explained, see `explained`), and the table; unseen words are added to it."""
        n = len(self.words)
        if self.table is None:
            self.table = np.ones((n + REMEMBERED, len(self.langs) + 1), np.float32)
            self.table[:n, :-1] = self.rows[:n]
        new = {w for w in words if w not in self.places}
        if len(self.places) + len(new) > REMEMBERED:
            self.places = {}
            new = set(words)
            if len(new) > len(self.table) - n:
                self.table = np.concatenate([self.table[:n], np.ones((len(new), len(self.langs) + 1), np.float32)])
        if new:
            added = list(new)
            at = _found(self.words, _hashes(added))
            odd = np.flatnonzero(at < 0)
            at[odd] = np.arange(n + len(self.places), n + len(self.places) + len(odd))
            unseen = [added[k] for k in odd]
            self.table[at[odd], :-1] = self.unseen(unseen)
            self.table[at[odd], -1] = self.explained(unseen)
            self.places.update(zip(added, at.tolist()))
        return list(map(self.places.__getitem__, words)), self.table

    def explained(self, words: list[str]) -> np.ndarray:
        """Which unseen words have a known n-gram of EXPLAINS characters (longer ones hold such a one)."""
        out = np.zeros(len(words), bool)
        for at in range(0, len(words), 2048):
            hashes, owners = _gram_hashes(words[at : at + 2048], EXPLAINS)
            out[at + owners[_found(self.grams, hashes) >= 0]] = True
        return out

    def unseen(self, words: list[str]) -> np.ndarray:
        """Scores of words outside the vocabulary: the mean over each one's known n-grams of the greatest length that has any, 0 without any."""
        out = np.zeros((len(words), len(self.langs)))
        for at in range(0, len(words), 2048):
            left = np.arange(at, min(at + 2048, len(words)))
            for n in range(LONGEST, 0, -1):
                hashes, owners = _gram_hashes([words[k] for k in left], n)
                rows = _found(self.grams, hashes)
                known = rows >= 0
                counts = np.bincount(owners[known], minlength=len(left))
                some = counts > 0
                out[left[some]] = _sums(self.rows[len(self.words) + rows[known]], counts)[some] / counts[some, None]
                left = left[~some]
                if not len(left):
                    break
        return out


def _points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts, one after the other, and how many each has."""
    joined = "".join(texts).encode("utf-32-le", "surrogatepass")
    return np.frombuffer(joined, np.uint32), np.fromiter(map(len, texts), np.int64, len(texts))


def _hashes(words: list[str]) -> np.ndarray:
    points, sizes = _points(words)
    ends = np.cumsum(sizes)
    return piece_hashes(points, ends - sizes, ends)


def _gram_hashes(words: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams of the words, each framed by ^ and $, and the word that each is of."""
    points, sizes = _points([f"^{w}$" for w in words])
    counts = np.maximum(0, sizes - n + 1)
    owners = np.repeat(np.arange(len(words)), counts)
    starts = np.arange(len(owners)) + np.repeat((np.cumsum(sizes) - sizes) - (np.cumsum(counts) - counts), counts)
    return piece_hashes(points, starts, starts + n), owners


def _found(known: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Places of hashes among sorted ones, -1 for those that are not there."""
    if not len(known):
        return np.full(len(hashes), -1)
    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    return np.where(known[at] == hashes, at, -1)


def _sums(rows: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive stretches of rows, as long as `counts` says."""
    out = np.zeros((len(counts), rows.shape[1]))
    some = counts > 0
    if some.any():
        out[some] = np.add.reduceat(rows, (np.cumsum(counts) - counts)[some], axis=0, dtype=np.float64)
    return out


def build(counts: dict[str, dict[str, int]], documents: dict[str, int], smoothing: float = 0.5) -> Model:
    """A model from word counts and numbers of documents by language; without any words it knows no language."""
    if not counts:
        return Model([], np.zeros(0), np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros((0, 0), np.float32))
    langs = sorted(counts)
    words: dict[str, int] = {}
    for lang in langs:
        for word in counts[lang]:
            words.setdefault(word, len(words))
    table = np.zeros((len(words), len(langs)))
    for k, lang in enumerate(langs):
        table[[words[w] for w in counts[lang]], k] = list(counts[lang].values())
    log = lambda t: np.log((t + smoothing) / (t.sum(0) + smoothing * len(t))).astype(np.float32)
    known = list(words)
    own = _hashes(known)
    grams, tables = [], []
    for n in range(1, LONGEST + 1):
        found = np.zeros(0, np.uint64)
        for at in range(0, len(known), TOGETHER):
            found = np.union1d(found, _gram_hashes(known[at : at + TOGETHER], n)[0])
        sums = np.zeros((len(found), len(langs)))
        for at in range(0, len(known), TOGETHER):
            hashes, owners = _gram_hashes(known[at : at + TOGETHER], n)
            own_rows, places = table[at + owners], np.searchsorted(found, hashes)
            for k in range(len(langs)):
                sums[:, k] += np.bincount(places, own_rows[:, k], len(found))
        grams.append(found)
        tables.append(log(sums))
    places, every = np.argsort(own), np.concatenate(grams)
    order = np.argsort(every)
    total = sum(documents.values())
    prior = np.log(np.array([documents[lang] / total for lang in langs]))
    return Model(langs, prior, own[places], every[order], np.concatenate([log(table)[places], np.concatenate(tables)[order]]))


def predict(model: Model, texts: list[str | None]) -> list[tuple[str, float, float]]:
    """Language, posterior and share of explained words of each text, read in blocks of bounded size."""
    texts = [t or "" for t in texts]
    sums, lettered, totals = np.zeros((len(texts), len(model.langs) + 1)), np.zeros(len(texts), bool), np.zeros(len(texts))
    for owners, parts in blocks(texts, 1 << 17) if model.langs else ():
        words = [_WORD.findall(p.lower()) for p in parts]
        counts = np.fromiter(map(len, words), np.int64, len(words))
        at, rows = model.remembered([w for ws in words for w in ws])
        np.add.at(sums, owners, _sums(rows[at], counts))
        np.add.at(totals, owners, counts)
        for k, ws in zip(owners, words):
            lettered[k] |= bool(ws) and (ws[0].isalpha() or any(c.isalpha() for w in ws for c in w))
    out = []
    for s, n, known, explained in zip(sums[:, :-1] + model.prior, totals, lettered, sums[:, -1]):
        if known:
            p = np.exp((s - s.max()) * min(1, EVIDENCE / n))
            k = int(np.argmax(s))
            out.append((model.langs[k], float(p[k] / p.sum()), float(explained / n)))
        else:
            out.append(("und", 0.0, 0.0))
    return out


def learn(docs: DataFrame, id_col: str, text_col: str, lang_col: str, learn_if: Column, per_language: int) -> Model:
    """A model from at most `per_language` documents of each language, those with the least md5 of their ids.

    Keys are spread evenly, so from a language's number of documents follows
    below which key about one and a half times as many as wanted lie: only
    these are ranked. Words are counted by Spark; the driver gets numbers of documents and
    the words of the sample with their numbers, no texts: the sample bounds them.
    """
    d = docs.filter(learn_if & F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))).alias("key"), F.col(text_col).alias("text"))
    sizes = {r["lang"]: r["n"] for r in d.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return build({}, {})
    below = F.lit(False)
    for lang, n in sizes.items():
        share = (1.5 * per_language + 10) / n
        below |= (F.col("lang") == lang) & (F.lit(share >= 1) | (F.col("key") < f"{int(min(share, 1) * (16**12 - 1)):012x}"))
    sample = d.filter(below & F.col("text").isNotNull()).withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy("key", "text"))).filter(F.col("r") <= per_language)
    word = sample.select("lang", "r", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("word"))
    found = word.groupBy("lang", "word").agg(F.count("*").alias("n")).toArrow()
    counts: dict[str, dict[str, int]] = defaultdict(dict)
    for b in found.to_batches(max_chunksize=10_000):
        for lang, w, n in zip(*[c.to_pylist() for c in b.columns]):
            counts[lang][w] = n
    return build(counts, {lang: sizes[lang] for lang in counts})


def identify(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    learn_if: Column | None = None,
    per_language: int = 1000,
    keep: tuple[str, ...] = (),
    explained: bool = False,
) -> DataFrame:
    """Language and score of every text.

    The model is fitted to a bounded sample (see `learn`) of the rows for
    which `learn_if` holds; a text is scored by its own words alone. Every
    word of the whole text counts: known words by their log frequency in each
    language, unseen ones by their longest known character n-grams, from five
    characters down to one. The model holds every word of the sample, whose
    size `per_language` bounds, as 64-bit hashes, and goes to workers once.

    Returns id_col, the `keep` columns, lang_pred, and score: the posterior of that
    language among the learned ones, 0 to 1, from the evidence of ten average
    words of the text (of all its words, if fewer). Null text, text without a letter,
    or no labelled rows at all: `und`, 0. Equal scores go to the first
    language by name. Null ids and repeated rows are rows like others; an empty
    table gives an empty result. With `explained` also that column: the share of the text's
    words that are known or have a known n-gram of EXPLAINS characters; the score alone
    can't tell a text in no learned language, since one of them is always the best.
    """
    spark = docs.sparkSession
    small_batches(spark)
    model = spark.sparkContext.broadcast(learn(docs, id_col, text_col, lang_col, F.lit(True) if learn_if is None else learn_if, per_language))
    others = [c for c in keep if c != text_col]
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *[F.col(c).alias(f"keep_{i}") for i, c in enumerate(others)])
    kind = T.StructType([*d.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("explained", T.DoubleType())])

    def guess(batches):
        load.cache_clear()  # a worker that has encoded texts before gives back that memory
        for b in slices(batches, 1):
            langs, scores, shares = zip(*predict(model.value, b.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(shares, pa.float64())], kind.fieldNames())

    d = d.mapInArrow(guess, kind)
    of = {c: f"keep_{i}" for i, c in enumerate(others)} | {text_col: "text"}
    return d.select(F.col("id").alias(id_col), *[F.col(of[c]).alias(c) for c in keep], "lang_pred", "score", *["explained"] * explained)
