"""Operators over ordered rows and lists."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from patchlens.operators import scans
from patchlens.operators.containing import without_subsumed
from patchlens.sources.shared import cut


def adjacent_runs(df: DataFrame, keys: list[str], order: list[str], value: str, joins: Column | None = None, rows_per_range: int = 100_000) -> DataFrame:
    """`df` with run_id: a row continues the run of the row before it (by `order`) if `value` is the same and `joins` holds.

    The value of the row before and the number of runs so far are carried over
    ranges of rows, so a key of any size is spread over many tasks.
    """
    d = scans.in_ranges(df, keys, order, rows_per_range)
    d = scans.folded(d, keys, {"last__": ("last", F.struct(F.col(value).alias("v")))}, before=True)
    same = F.col("last__").isNotNull() & F.col(value).eqNullSafe(F.col("last__.v"))
    if joins is not None:
        same &= joins
    d = scans.folded(d.withColumn("new__", (~same).cast("int")), keys, {"run_id": ("sum", F.col("new__"))})
    return d.select(*df.columns, "run_id")


def merge_adjacent(df: DataFrame, keys: list[str], order: str, value: str, items: str, joins: Column | None = None) -> DataFrame:
    """Runs as one row: the first `order`, the value, and the arrays `items` one after the other."""
    d = adjacent_runs(df, keys, [order], value, joins)
    parts = F.array_sort(F.collect_list(F.struct(order, items)))
    g = d.groupBy(*keys, "run_id").agg(F.min(order).alias(order), F.min_by(value, order).alias(value), parts.alias("p"))
    return g.select(*keys, "run_id", order, value, F.flatten(F.transform("p", lambda x: x[items])).alias(items))


def context_rows(df: DataFrame, keys: list[str], number: str, text: str, reach: int = 2, width: int = 10_000) -> DataFrame:
    """Texts of the rows whose number is at most `reach` below or above.

    A key's rows are dealt out by stretches of `width` numbers; rows within
    reach of a neighbouring stretch are seen there as well, so a key of any
    size is spread over many tasks.
    """
    n, own = F.col(number), F.floor(F.col(number) / width)
    near = F.array_distinct(F.array(own, F.floor((n - reach) / width), F.floor((n + reach) / width)))
    d = df.withColumn("stretch__", F.explode(near)).withColumn("here__", F.col("stretch__").eqNullSafe(own))
    w = W.partitionBy(*keys, "stretch__").orderBy(number)
    d = d.withColumn("before", F.collect_list(text).over(w.rangeBetween(-reach, -1))).withColumn("after", F.collect_list(text).over(w.rangeBetween(1, reach)))
    return d.filter("here__").drop("stretch__", "here__")


def drop_subsumed(lists: DataFrame, id_col: str, items: str) -> DataFrame:
    """Each list's strings by length, without those that are part of a later one; of equal strings the last stays.

    Lists are rows; the comparison stays within a row, by one automaton over its strings.
    """
    return without_subsumed(lists.select(id_col, items), items)


def overlap(a: Column, b: Column) -> Column:
    """Length of the longest end of `a` that `b` starts with, for short strings: every length is tried."""
    n = F.least(F.char_length(a), F.char_length(b))
    fits = F.filter(F.sequence(F.lit(0), n), lambda k: F.right(a, k) == F.left(b, k))
    return F.array_max(fits)


def longest_overlap(a: str, b: str) -> int:
    """`overlap` of strings of any length, in linear time.

    borders[k] is the longest proper start of b[:k] that is also its end: as
    the end of `a` is read, a start of `b` that fails falls back to it.
    """
    a = a[max(0, len(a) - len(b)) :]
    borders, k = [0] * (len(b) + 1), 0
    for i in range(1, len(b)):
        while k and b[i] != b[k]:
            k = borders[k]
        k += b[i] == b[k]
        borders[i + 1] = k
    k = 0
    for c in a:
        while k and (k == len(b) or c != b[k]):
            k = borders[k]
        k += k < len(b) and c == b[k]
    return k


def _overlaps(lists: DataFrame, items: str) -> DataFrame:
    """`lists` with p: structs of each string (s) and its overlap with the next one (o), by linear scans in Python."""
    names, at = lists.columns, lists.columns.index(items)

    def scan(batches):
        for batch in batches:
            found = []
            for x in batch.column(at).to_pylist():
                after = [*x[1:], None] if x is not None else []
                found.append(None if x is None else [{"s": s, "o": 0 if s is None or t is None else longest_overlap(s, t)} for s, t in zip(x, after)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.struct([("s", pa.string()), ("o", pa.int32())])))], [*names, "p"])

    return lists.mapInArrow(scan, ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in lists.schema.fields], "p array<struct<s: string, o: int>>"]))


def drop_overlapped(lists: DataFrame, id_col: str, items: str, most: int = 10, merge: bool = False, short: int = 64) -> DataFrame:
    """Strings without those that overlap the next one by more than `most`; with `merge` the two become one.

    Lists of strings of at most `short` characters stay in the JVM; the time
    of the others is linear in their characters.
    """
    d = lists.select(id_col, items)
    brief = ~F.exists(items, lambda s: F.coalesce(F.char_length(s) > short, F.lit(False)))
    pairs = F.transform(items, lambda s, i: F.struct(s.alias("s"), F.coalesce(overlap(s, F.get(items, i + 1)), F.lit(0)).alias("o")))
    d = d.filter(F.coalesce(brief, F.lit(True))).select(id_col, pairs.alias("p")).unionByName(_overlaps(d.filter(~brief), items).select(id_col, "p"))
    if not merge:
        return d.select(id_col, F.transform(F.filter("p", lambda x: x["o"] <= most), lambda x: x["s"]).alias(items))
    zero = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("open"))

    def step(a: Column, x: Column) -> Column:
        joined = x["o"] > most
        head = F.concat(a["open"], F.when(joined, F.left(x["s"], F.char_length(x["s"]) - x["o"])).otherwise(x["s"]))
        return F.struct(F.when(joined, a["out"]).otherwise(F.concat(a["out"], F.array(head))).alias("out"), F.when(joined, head).otherwise("").alias("open"))

    return d.select(id_col, F.aggregate("p", zero, step, lambda a: a["out"]).alias(items))


def last_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key."""
    w = W.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("r__", F.row_number().over(w)).filter("r__ = 1").drop("r__")


def numbered(df: DataFrame, order: list[str], name: str = "seq_id", rows_per_range: int = 100_000) -> DataFrame:
    """`df` with its place in a total order from 0, without one task that sorts everything.

    Rows are dealt out by ranges of all columns of `order`, as many as the
    number of rows asks for, and written with their place in their range; the
    ranges' sizes (a number for each `rows_per_range` rows) give each range's
    first place. Nulls come first.
    """
    n = max(1, math.ceil(df.count() / rows_per_range))
    d = (df.repartitionByRange(n, *order) if n > 1 else df.repartition(1)).sortWithinPartitions(*order)
    d = cut(d.select("*", F.spark_partition_id().alias("b__"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("at__")))
    starts, at = [], 0
    for b, size in sorted(d.groupBy("b__").count().collect()):
        starts.append((b, at))
        at += size
    first = df.sparkSession.createDataFrame(starts, "b__ int, first__ long")
    return d.join(F.broadcast(first), "b__").select(*df.columns, (F.col("first__") + F.col("at__")).alias(name))


def ranked(df: DataFrame, keys: list[str], order: list[str], rank: str = "rank", size: str = "group_size") -> DataFrame:
    """`df` with each row's place in its key's order, from 0, and the key's number of rows; a hot key is spread over ranges like all others."""
    d = numbered(df, [*keys, *order], "all__")
    own = [F.col(k).alias(f"k{i}__") for i, k in enumerate(keys)]
    groups = d.groupBy(*own).agg(F.min("all__").alias("low__"), F.count("*").alias(size))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"k{i}__"))
    return d.join(groups, same).select(*df.columns, (F.col("all__") - F.col("low__")).alias(rank), size)


def group_lists(df: DataFrame, keys: list[str], item: str, per_row: int = 1000) -> DataFrame:
    """Each key's items in order as lists of at most `per_row`: keys, part (from 0), n (all of the key's items), items. No row grows with its key."""
    d = ranked(df.select(*keys, item), keys, [item], "at__", "n__")
    g = d.groupBy(*keys, F.floor(F.col("at__") / per_row).alias("part"), F.col("n__").alias("n")).agg(F.array_sort(F.collect_list(item)).alias("items"))
    return g.select(*keys, "part", "n", "items")


def batches(df: DataFrame, order: list[str], size: int = 20, name: str = "batch_id") -> DataFrame:
    """`df` with the number of its batch of `size` rows in a total order."""
    return numbered(df, order, "n__").withColumn(name, F.floor(F.col("n__") / size).cast("long")).drop("n__")


def top_over(df: DataFrame, keys: list[str], score: str, threshold: float, n: int, ties: list[str]) -> DataFrame:
    """The `n` best rows of each key whose score is over the threshold."""
    w = W.partitionBy(*keys).orderBy(F.col(score).desc(), *ties)
    return df.filter(F.col(score) > threshold).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def best(df: DataFrame, keys: list[str], score: str, least: float, ties: list[str]) -> DataFrame:
    """Each key's first row of highest score among those of at least `least`; a key without any has no row."""
    w = W.partitionBy(*keys).orderBy(F.col(score).desc(), *ties)
    return df.filter(F.col(score) >= least).withColumn("r__", F.row_number().over(w)).filter("r__ = 1").drop("r__")


def expand_context(df: DataFrame, keys: list[str], order: str, items: str, answer: str, budget: int) -> DataFrame:
    """Groups of items around the answer's group until there are `budget` items: left and right in turn, whole groups.

    Per key one row: items, and the answer's first and last place in them.
    Each group gets the number of the turn at which it would be added (1, 3, 5
    to the left, 2, 4, 6 to the right); a running sum over the turns says
    which come before the budget is reached. When a side is used up the other goes on.
    """
    own = W.partitionBy(*keys)
    at = F.max(F.when(F.col(answer), F.col(order))).over(own)
    d = df.withColumn("side__", F.when(F.col(order) < at, -1).when(F.col(order) > at, 1).otherwise(0)).withColumn("n__", F.size(items))
    away = F.row_number().over(W.partitionBy(*keys, "side__").orderBy(F.when(F.col("side__") < 0, -F.col(order)).otherwise(F.col(order))))
    d = d.withColumn("turn__", F.when(F.col("side__") == 0, 0).when(F.col("side__") < 0, 2 * away - 1).otherwise(2 * away))
    before = F.coalesce(F.sum("n__").over(own.orderBy("turn__").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    kept = d.withColumn("before__", before).filter((F.col("turn__") == 0) | (F.col("before__") < budget))
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(items).alias("i"))))
    left = F.coalesce(F.sum(F.when(F.col("side__") < 0, F.col("n__"))), F.lit(0))
    size = F.sum(F.when(F.col("side__") == 0, F.col("n__")))
    return kept.groupBy(*keys).agg(F.flatten(F.transform(parts, lambda x: x["i"])).alias(items), left.alias("answer_start"), (left + size - 1).alias("answer_end"))
