"""Cost-balanced packing of documents into sequences."""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchlens.llm import bpe
from patchlens.llm.common import partitions, slices, small_batches

#: Tokens of the shortest piece that a document is cut in to fill a sequence.
LEAST = 16
#: Remainders that are packed with each other; bounds a task's memory.
TOGETHER = 4096


def capacities(total: int, length: int) -> list[int]:
    """Sequences that hold exactly `total` tokens: full ones, and powers of two, which need no padding."""
    rest = total % length
    return [length] * (total // length) + [1 << b for b in range(rest.bit_length())[::-1] if rest >> b & 1]


def balance(sizes: list[int], length: int, linear: float = 1.0, quadratic: float = 1 / 512, least: int = LEAST) -> list[tuple[int, int, int, int, int]]:
    """Pieces (item, start, size, sequence, offset) of items shorter than `length`.

    A piece costs linear * n + quadratic * n * n. Items in descending order go
    to the sequence of lowest cost that has room for them; those that fit
    nowhere wait, and at the end are cut to fill what room is left. Room for
    fewer than `least` tokens stays empty, for shorter pieces are of no use;
    the tokens that are left then fill sequences of a power of two.
    """
    room = np.full(sum(sizes) // length, length, np.int64)
    used, cost, out, waiting = np.zeros(len(room), np.int64), np.zeros(len(room)), [], []

    def put(i: int, start: int, n: int, k: int) -> int:
        out.append((i, start, n, k, int(used[k])))
        room[k] -= n
        used[k] += n
        cost[k] += linear * n + quadratic * n * n
        return start + n

    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        fits = np.flatnonzero(room >= sizes[i])
        if len(fits):
            put(i, 0, sizes[i], int(fits[np.argmin(cost[fits])]))
        else:
            waiting.append(i)
    rest = []
    for i in waiting:
        start = 0
        while start < sizes[i] and len(room) and room.max() >= least:
            k, left = int(np.argmax(room)), sizes[i] - start
            n = min(left, int(room[k]))
            if 0 < left - n < least <= left - least:
                n = left - least
            start = put(i, start, n, k)
        if start < sizes[i]:
            rest.append([i, start])
    sequence = len(room)
    for capacity in capacities(sum(sizes[i] - start for i, start in rest), length):
        at = 0
        while at < capacity:
            i, start = rest[0]
            n = min(sizes[i] - start, capacity - at)
            out.append((i, start, n, sequence, at))
            at += n
            rest[0][1] += n
            if rest[0][1] == sizes[i]:
                rest.pop(0)
        sequence += 1
    return out


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", length: int = 2048, end_id: int = 1) -> DataFrame:
    """Sequences of at most `length` tokens that hold every token of every document once, nearly without padding.

    A document's tokens are its ids by the file at `path` (on every machine)
    and `end_id`. Whole runs of `length` tokens are sequences of their own;
    what is left of each document is dealt out by the hash of its id and
    packed with up to 4095 others that land beside it, as they stream by: a
    task holds only those, whatever its share. Nothing is collected.

    Returns a row per piece: id_col, start, length, ids_crc32 (of the ids as
    little-endian unsigned 32-bit numbers), doc_tokens, sequence_id, offset
    (all long), and ids (binary; 16-bit numbers if all ids fit, else 32-bit).
    Null text is an empty document: the end id alone. Null ids are dealt out
    by their tokens. Rows that repeat are packed each; ties go by place. An
    empty table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    d = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = d.schema["id"].dataType.simpleString()
    rows = docs.count()

    def tokens(batches):
        for b in slices(batches, 1):
            ids, starts, sizes, held = [], [], [], []
            for key, x in zip(b.column(0).to_pylist(), bpe.encode(path, b.column(1).to_pylist())):
                x = np.append(x, np.array(end_id, x.dtype))
                for at in range(0, len(x), length):
                    ids.append(key)
                    starts.append(at)
                    sizes.append(len(x))
                    held.append(x[at : at + length].tobytes())
                    if len(held) >= 1024:
                        yield _batch(b.schema.field(0).type, ids, starts, sizes, held)
                        ids, starts, sizes, held = [], [], [], []
            yield _batch(b.schema.field(0).type, ids, starts, sizes, held)

    def packed(batches):
        item = bpe.id_type(path)
        width = item.itemsize
        part, n, waiting = TaskContext.get().partitionId() << 36, 0, []

        def row(key, start, x, doc_tokens, sequence, offset):
            return key, start, len(x), zlib.crc32(x.astype("<u4").tobytes()), doc_tokens, part + sequence, offset, x.tobytes()

        def flush():
            nonlocal n, waiting
            whole = [w for w in waiting if len(w[3]) == length * width]
            rest = [w for w in waiting if len(w[3]) < length * width]
            out = [row(k, s, np.frombuffer(x, item), t, n + i, 0) for i, (k, s, t, x) in enumerate(whole)]
            n += len(whole)
            sizes = [len(w[3]) // width for w in rest]
            pieces = balance(sizes, length)
            for i, start, size, sequence, offset in pieces:
                k, s, t, x = rest[i]
                out.append(row(k, s + start, np.frombuffer(x, item)[start : start + size], t, n + sequence, offset))
            n += max((p[3] + 1 for p in pieces), default=0)
            waiting = []
            types = [*[kind_of], *[pa.int64()] * 6, pa.binary()]
            for at in range(0, len(out), 2048):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[at : at + 2048]), types)], NAMES)

        kind_of = None
        for b in batches:
            kind_of = b.schema.field(0).type
            for r in zip(*[c.to_pylist() for c in b.columns[:4]]):
                waiting.append(r)
                if len(waiting) == TOGETHER:
                    yield from flush()
        if waiting:
            yield from flush()

    t = d.mapInArrow(tokens, f"id {kind}, start bigint, doc_tokens bigint, ids binary")
    t = t.repartition(max(partitions(spark), math.ceil(rows / 50_000)), F.xxhash64("id", F.crc32("ids")))
    t = t.sortWithinPartitions(F.xxhash64("id"), "id", "start", "ids")
    out = t.mapInArrow(packed, f"id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary")
    return out.withColumnRenamed("id", id_col) if id_col != "id" else out


NAMES = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]


def _batch(kind, ids, starts, sizes, held):
    return pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(held, pa.binary())], ["id", "start", "doc_tokens", "ids"])
