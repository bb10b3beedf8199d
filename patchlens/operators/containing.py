"""Many strings in many texts: Aho-Corasick automata, one pass over a text for each."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patchlens.sources.shared import cut

#: Characters of the strings of one automaton: some 100 bytes of a worker's memory each.
SHARD_CHARS = 1 << 21
#: Automata that pass over the texts; strings for which more are needed go to `beyond`.
SHARDS = 8
#: Characters of texts that a worker looks at together.
TOGETHER = 1 << 20


def automaton(strings: list[str]):
    """Over the strings that aren't empty; None without any."""
    import ahocorasick

    a = ahocorasick.Automaton()
    for s in strings:
        if s:
            a.add_word(s, s)
    if not len(a):
        return None
    a.make_automaton()
    return a


def _parts(batch: pa.RecordBatch, texts: int) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch of about TOGETHER characters."""
    sizes = pc.fill_null(pc.binary_length(batch.column(texts)), 0).to_pylist()
    start = held = 0
    for k, size in enumerate(sizes):
        held += size
        if held >= TOGETHER:
            yield batch.slice(start, k + 1 - start)
            start, held = k + 1, 0
    if start < len(sizes):
        yield batch.slice(start)


def occurring(strings: DataFrame, string: str, texts: DataFrame, text: str, keep: list[str], name: str = "string__", shard_chars: int = SHARD_CHARS, shards: int = SHARDS) -> DataFrame | None:
    """The columns `keep` of `texts` with each distinct string that occurs in the text, as `name`: a row per text row and string.

    The empty string occurs in every text; nulls match nothing. The strings
    are split by hash into as many automata as their characters ask for, each
    of a bounded size and broadcast; every task runs its texts through each,
    without a shuffle, and only what matches leaves it. Returns None where
    more than `shards` automata would be needed: the caller then joins.
    """
    spark = texts.sparkSession
    distinct = cut(strings.select(F.col(string).alias("s")).filter("s is not null").distinct())
    size = distinct.agg(F.sum(F.char_length("s")).alias("n"), F.max(F.char_length("s")).alias("most")).first()
    n = max(1, -(-2 * (size["n"] or 0) // shard_chars))  # on average half full
    if n > shards or (size["most"] or 0) > shard_chars // 2:
        return None
    thin = texts.select(*keep, F.col(text).alias("text__"))
    at = len(keep)
    kinds = T.StructType([*thin.schema.fields[:at], T.StructField(name, T.StringType())])
    found = None
    for k in range(n):
        own = [r["s"] for r in distinct.filter(F.pmod(F.xxhash64("s"), F.lit(n)) == k).collect()]
        shared = spark.sparkContext.broadcast(own)

        def scan(batches, shared=shared):
            words = automaton(shared.value)
            always = [""] if "" in shared.value else []
            for batch in batches:
                for part in _parts(batch, at):
                    rows, hits = [], []
                    for i, t in enumerate(part.column(at).to_pylist()):
                        if t is not None:
                            here = [*always, *({s for _, s in words.iter(t)} if words else ())]
                            rows += [i] * len(here)
                            hits += here
                    taken = part.take(pa.array(rows, pa.int32()))
                    yield pa.RecordBatch.from_arrays([*taken.columns[:at], pa.array(hits, pa.string())], kinds.fieldNames())

        one = thin.mapInArrow(scan, kinds)
        found = one if found is None else found.unionByName(one)
    return found


def longest_first(items: list[str]) -> list[str]:
    """The strings by length, without those that are part of a later one; of equal strings the last stays.

    One automaton over the distinct strings, one pass over each of them.
    """
    last = {s: k for k, s in enumerate(items)}
    order = sorted(last, key=lambda s: (len(s), last[s]))
    words = automaton(order)
    inside = set()
    if words:
        for s in order:
            inside.update(t for _, t in words.iter(s) if t != s)
        if "" in last:
            inside.add("")
    return [s for s in order if s not in inside]


def without_subsumed(lists: DataFrame, items: str) -> DataFrame:
    """`lists` with the array of strings `items` reduced by `longest_first`; a null list stays null, null strings go. The work on a list is linear in its characters and matches."""
    names = lists.columns
    at = names.index(items)

    def reduce(batches):
        for b in batches:
            kept = [None if x is None else longest_first([s for s in x if s is not None]) for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:at], pa.array(kept, pa.list_(pa.string())), *b.columns[at + 1 :]], names)

    fields = [T.StructField(f.name, T.ArrayType(T.StringType()) if f.name == items else f.dataType) for f in lists.schema.fields]
    return lists.mapInArrow(reduce, T.StructType(fields))


def matched(strings: DataFrame, found: DataFrame, string: str, name: str = "string__") -> DataFrame:
    """The rows of `found` (of `occurring`) with the columns of `strings`."""
    same: Column = found[name] == strings[string]
    return found.join(strings, same).drop(found[name])
