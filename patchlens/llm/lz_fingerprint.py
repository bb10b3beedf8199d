"""Document fingerprints from Lempel-Ziv phrases, and the likeness of documents to edits and neighbours."""

from __future__ import annotations

import base64
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchlens.llm.common import partitions, slices, small_batches
from patchlens.llm.hashing import piece_hashes

#: Minimum hashes in a fingerprint.
SIGNATURE = 128

def phrases(text: str, seen: set[str], at: int, end: int) -> tuple[list[int], int]:
    """Ends of the phrases of text[at:end], and where the rest begins that is a known phrase.

    A phrase is the shortest piece not yet in `seen`, which then holds it. All
    beginnings of a known phrase are known, so the search may start at the
    length of the phrase before and go up or down.
    """
    ends: list[int] = []
    size = 4
    while at < end:
        e = min(at + size, end)
        piece = text[at:e]
        if piece in seen:
            e += 1
            while e <= end:
                piece = text[at:e]
                if piece not in seen:
                    break
                e += 1
            else:
                return ends, at
        else:
            while e - 1 > at:
                shorter = text[at : e - 1]
                if shorter in seen:
                    break
                piece = shorter
                e -= 1
        seen.add(piece)
        ends.append(e)
        size = e - at
        at = e
    return ends, at


def phrase_hashes(text: str, ends: list[int]) -> np.ndarray:
    """A 32-bit hash of each phrase; each starts where the one before ends."""
    e = np.array(ends, np.int64)
    points = np.frombuffer(text[: ends[-1]].encode("utf-32-le", "surrogatepass"), np.uint32) if ends else e
    return (piece_hashes(points, np.concatenate([[0], e[:-1]]), e) >> np.uint64(32)).astype(np.uint32) if ends else np.zeros(0, np.uint32)


def signature(hashes: np.ndarray, k: int = SIGNATURE) -> np.ndarray:
    """The `k` least distinct hashes."""
    return np.unique(hashes)[:k]


def likeness(a: np.ndarray, b: np.ndarray, k: int = SIGNATURE) -> float:
    """Estimated Jaccard similarity of two phrase sets; exact if both have at most `k`. Two empty sets: 1."""
    union = np.union1d(a, b)[:k]
    if not len(union):
        return 1.0
    both = np.intersect1d(a, b, assume_unique=True)
    return float(np.searchsorted(both, union[-1], "right")) / len(union)


def fingerprint(text: str, k: int = SIGNATURE) -> np.ndarray:
    return signature(phrase_hashes(text, phrases(text, set(), 0, len(text))[0]), k)


def edited_fingerprints(text: str, head: str, k: int = SIGNATURE) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of a text and of its edit, whose last quarter is `head`; the common part is parsed once."""
    n = len(text)
    kept = n - n // 4
    seen: set[str] = set()
    common, at = phrases(text, seen, 0, kept)
    more, _ = phrases(text, seen, at, n)
    hashes = phrase_hashes(text, common + more)
    before = at
    for e in more:
        seen.discard(text[before:e])
        before = e
    tail = text[at:kept] + head
    new = phrase_hashes(tail, phrases(tail, seen, 0, len(tail))[0])
    return signature(hashes, k), signature(np.concatenate([hashes[: len(common)], new]), k)


def as_text(s: np.ndarray) -> str:
    return base64.b64encode(s.astype("<u4").tobytes()).decode()


def _rows(texts: Iterator[tuple]) -> Iterator[tuple]:
    """Result rows from (bucket, id, is a neighbour from the next bucket, text) in order."""
    before = ready_print = None
    for bucket, key, lent, text in texts:
        if before and before[0] == bucket:
            _, own, words, ready = before
            head = text[: len(words) // 4]
            own_print, edit_print = edited_fingerprints(words, head)
            edited = words[: len(words) - len(words) // 4] + head
            if ready is not None:
                yield *ready, likeness(ready_print, own_print)
            ready_print = own_print
            row = (own, len(words), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), as_text(own_print), as_text(edit_print), likeness(own_print, edit_print))
            if lent:
                yield *row, likeness(own_print, fingerprint(text))
                before = None
            else:
                before = (bucket, key, text, row)
        else:
            before = None if lent else (bucket, key, text, None)


def lz_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows_per_range: int = 10_000) -> DataFrame:
    """Fingerprint of every document and of an edit of it, and their likeness.

    A text is parsed into Lempel-Ziv phrases (each the shortest piece not met
    before in it); the fingerprint is the 128 least 32-bit hashes of the set of
    phrases. Two fingerprints' likeness estimates the Jaccard similarity of
    the sets, 0 to 1; equal texts have equal fingerprints and likeness 1.

    The edited text ends, instead of with its last floor(n/4) code points,
    with the first as many (or all) of the next document, by ascending id; the
    last one's next is the first. Documents are dealt out by ranges of ids, in
    one shuffle; the first document of a range is lent to the range before, so
    each task has its neighbours and holds two documents at a time. There is
    a range for each `rows_per_range` rows, of its own partition; range bounds
    and first ids (two numbers for each) are all the driver sees.

    Ids are whole numbers, or text that reads as one; others order like null.
    Returns id_col, n_chars (long), edited_sha256,
    fingerprint (base64, empty for an empty text), edited_fingerprint
    (strings), near_edited, near_next (double). Null text counts as empty; two
    empty texts are alike by 1. Null ids come first; equal ids go by text. A
    table's only row is its own next; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    lowest = -(1 << 63)
    d = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(id_col).try_cast("long"), F.lit(lowest)).alias("place"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n = max(2 * partitions(spark), math.ceil(docs.count() / rows_per_range))
    marks = d.select(F.percentile_approx("place", [i / n for i in range(1, n)], min(50 * n, 2_000_000))).first()[0] or []
    marks = np.unique(np.array(marks, np.int64))

    @F.pandas_udf("int")
    def bucket_of(place):
        import pandas as pd

        return pd.Series(np.searchsorted(marks, place.to_numpy(np.int64), "right").astype(np.int32))

    least = {r[0]: r[1] for r in d.groupBy(bucket_of("place").alias("bucket")).agg(F.min("place")).collect()}
    used = sorted(least)
    to = {least[b]: used[i - 1] for i, b in enumerate(used)}

    @F.pandas_udf("array<int>")
    def buckets_of(place):
        import pandas as pd

        p = place.to_numpy(np.int64)
        own = np.searchsorted(marks, p, "right").tolist()
        # a lent copy has the bitwise complement of its bucket
        return pd.Series([[b] if x not in to else [b, ~to[x]] for x, b in zip(p.tolist(), own)])

    d = d.withColumn("to", F.explode(buckets_of("place")))
    d = d.select("id", "text", "place", F.when(F.col("to") < 0, F.bitwise_not("to")).otherwise(F.col("to")).alias("bucket"), (F.col("to") < 0).alias("lent"))
    d = d.repartitionById(n, F.col("bucket")).sortWithinPartitions("bucket", "lent", "place", "text").select("bucket", "id", "lent", "text")
    kind = d.schema["id"].dataType.simpleString()

    def likenesses(batches):
        def texts():
            for b in slices(batches, 3):
                types.append(b.schema.field(1).type)
                yield from zip(*[c.to_pylist() for c in b.columns])

        types: list = []
        out: list = []

        def batch():
            fields = [types[0], pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), fields)], ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

        for row in _rows(texts()):
            out.append(row)
            if len(out) == 500:
                yield batch()
                out = []
        if out:
            yield batch()

    out = d.mapInArrow(likenesses, f"id {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return out.withColumnRenamed("id", id_col) if id_col != "id" else out
