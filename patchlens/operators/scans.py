"""Running values along an order, segmented by keys, without a task that holds a whole key.

Rows are dealt out by ranges of (keys, order), so a hot key spans as many
ranges as its rows ask for. Inside a range a window does the work; what a key
brings along from earlier ranges is one summary a range, added to the rows of
the range's first key.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from patchlens.sources.shared import cut

#: Summaries (one a range) up to which they are broadcast; more meet their ranges in a shuffle.
BROADCAST_RANGES = 100_000
RANGE, PLACE = "range__", "place__"

Order = list[str | Column]


def in_ranges(df: DataFrame, keys: list[str], order: Order, rows_per_range: int = 100_000) -> DataFrame:
    """`df`, written in ranges of (keys, order), with range__ and place__ (a row's place in its range, from 0). Rows that are equal in all of these are in one range."""
    n = max(1, math.ceil(df.count() / rows_per_range))
    d = (df.repartitionByRange(n, *keys, *order) if n > 1 else df.repartition(1)).sortWithinPartitions(*keys, *order)
    return cut(d.select("*", F.spark_partition_id().alias(RANGE), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias(PLACE)))


def _fold(kind: str, c: Column) -> Column:
    """Of a window's rows. `last` is the last one that isn't null."""
    return {"sum": F.sum, "max": F.max, "min": F.min, "last": lambda x: F.last(x, ignorenulls=True)}[kind](c)


def _both(kind: str, carried: Column, own: Column) -> Column:
    if kind == "sum":
        return F.coalesce(carried + own, own, carried)
    if kind == "last":
        return F.coalesce(own, carried)
    return (F.greatest if kind == "max" else F.least)(carried, own)


def folded(d: DataFrame, keys: list[str], folds: dict[str, tuple[str, Column]], before: bool = False) -> DataFrame:
    """`d` (of `in_ranges`, by the same keys) with a column for each fold: (sum, max, min or last, value) of the key's rows up to this one, or, with `before`, up to the one before; null where there is none."""
    names = list(folds)
    d = d.withColumns({f"{c}__v": v for c, (_, v) in folds.items()})
    whole = {c: _fold(k, F.col(f"{c}__v")) if k != "last" else F.max_by(F.col(f"{c}__v"), F.when(F.col(f"{c}__v").isNotNull(), F.col(PLACE))) for c, (k, _) in folds.items()}
    own_keys = [F.col(k).alias(f"k{i}__") for i, k in enumerate(keys)]
    s = d.groupBy(RANGE, *own_keys).agg(F.min(PLACE).alias("low__"), F.max(PLACE).alias("high__"), *[v.alias(f"{c}__s") for c, v in whole.items()])
    s = cut(s)  # read for its sizes and its edges
    ends = s.groupBy(F.col(RANGE).alias("of__")).agg(F.max("high__").alias("end__"))
    few = ends.count() <= BROADCAST_RANGES
    light = F.broadcast if few else (lambda x: x)
    # of each range only its first key can come from an earlier one, and only its last can go on: two summaries a range
    edges = s.join(light(ends), F.col(RANGE) == F.col("of__")).filter((F.col("low__") == 0) | (F.col("high__") == F.col("end__")))
    earlier = W.partitionBy(*[f"k{i}__" for i in range(len(keys))]).orderBy(RANGE).rowsBetween(W.unboundedPreceding, -1)
    carry = edges.select("*", *[_fold(k, F.col(f"{c}__s")).over(earlier).alias(f"{c}__c") for c, (k, _) in folds.items()])
    carry = carry.filter("low__ = 0").select(F.col(RANGE).alias("of__"), *[f"k{i}__" for i in range(len(keys))], *[f"{c}__c" for c in names])
    same = F.col(RANGE) == F.col("of__")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"k{i}__"))
    frame = W.partitionBy(RANGE, *keys).orderBy(PLACE).rowsBetween(W.unboundedPreceding, -1 if before else W.currentRow)
    local = d.select("*", *[_fold(k, F.col(f"{c}__v")).over(frame).alias(f"{c}__l") for c, (k, _) in folds.items()])
    joined = local.join(light(carry), same, "left")
    return joined.select(*[c for c in d.columns if c not in {f"{n}__v" for n in names}], *[_both(k, F.col(f"{c}__c"), F.col(f"{c}__l")).alias(c) for c, (k, _) in folds.items()])


def running(df: DataFrame, keys: list[str], order: Order, folds: dict[str, tuple[str, Column]], before: bool = False, rows_per_range: int = 100_000) -> DataFrame:
    """`df` with running folds (see `folded`) of each key's rows in `order`. Null keys are a key; rows equal in keys and order come one after the other in any order."""
    d = in_ranges(df, keys, order, rows_per_range)
    return folded(d, keys, folds, before).drop(RANGE, PLACE)


def within_budget(df: DataFrame, size: str, budget: int, order: Order, rows_per_range: int = 100_000) -> DataFrame:
    """The rows of an order up to which the sum of `size` (null counts 0) is within the budget; later rows go, even if they would fit."""
    d = running(df, [], order, {"sum__": ("sum", F.coalesce(F.col(size), F.lit(0)).cast("long"))}, rows_per_range=rows_per_range)
    return d.filter(F.col("sum__") <= budget).drop("sum__")


def following(left: DataFrame, right: DataFrame, on: list[str], left_value: str, right_value: str, ties: str, most: int, keep: list[str], rows_per_range: int = 100_000, hot: int = 50_000, salts: int = 64) -> DataFrame:
    """Each row of `left` with the `most` rows of `right` of the same `on` whose value is greater and least; equal values by `ties`.

    An inequality join whose result is bounded by `most` a row. Returns the
    columns of `left`, then right_value, ties and `keep` of `right`, and `nth`
    (from 1). Nulls in `on` or the values have no match.

    Both sides' distinct cells (on, value) are sorted by ranges once: a running
    count of the right rows up to a cell is the place of the first one that
    follows, so all that is paired is a cell with `most` places. Rows of `left`
    meet their cell last; those of a cell with over `hot` rows are salted, and
    the cell's result is repeated for each salt.
    """
    on_left = [F.col(c).alias(f"on{i}__") for i, c in enumerate(on)]
    names = [f"on{i}__" for i in range(len(on))]
    some = lambda d: d.filter(" and ".join(f"{n} is not null" for n in [*names, "at__"]))
    cells = some(left.select(*on_left, F.col(left_value).alias("at__"))).groupBy(*names, "at__").agg(F.count("*").alias("rows__"))
    r = some(right.select(*on_left, F.col(right_value).alias("at__"), F.col(ties).alias("tie__"), *[F.col(c).alias(f"r{i}__") for i, c in enumerate(keep)]))
    # a right row comes before the cell of its own value: the count up to the cell holds it
    line = r.select(*names, "at__", F.lit(0).alias("cell__"), "tie__", F.lit(1).alias("one__"), *[f"r{i}__" for i in range(len(keep))], F.lit(None).cast("long").alias("rows__"))
    line = line.unionByName(cells.select(*names, "at__", F.lit(1).alias("cell__"), F.lit(0).alias("one__"), "rows__"), allowMissingColumns=True)
    line = cut(running(line, names, ["at__", "cell__", "tie__"], {"count__": ("sum", F.col("one__"))}, rows_per_range=rows_per_range))
    places = line.filter("cell__ = 0").select(*names, F.col("count__").alias("place__"), F.col("at__").alias("value__"), "tie__", *[f"r{i}__" for i in range(len(keep))])
    wanted = line.filter("cell__ = 1").select(*names, "at__", "rows__", F.explode(F.sequence(F.lit(1), F.lit(most))).alias("nth"), F.col("count__"))
    found = wanted.withColumn("place__", F.col("count__") + F.col("nth")).join(places, [*names, "place__"])
    lists = found.groupBy(*names, "at__").agg(F.first("rows__").alias("rows__"), F.collect_list(F.struct("nth", "value__", "tie__", *[f"r{i}__" for i in range(len(keep))])).alias("found__"))
    lists = cut(lists)
    busy = lists.filter(F.col("rows__") > hot).select(*names, "at__")
    l = left.select("*", *on_left, F.col(left_value).alias("at__"))
    many = busy.select(*[F.col(n).alias(f"{n}b") for n in [*names, "at__"]])
    salted = F.when(F.col("at__b").isNotNull(), F.pmod(F.xxhash64(*left.columns), F.lit(salts))).otherwise(0).cast("int")
    is_busy = F.lit(True)
    for n in [*names, "at__"]:
        is_busy &= F.col(n) == F.col(f"{n}b")
    l = l.join(F.broadcast(many), is_busy, "left") if busy.count() <= BROADCAST_RANGES else l.join(many, is_busy, "left")
    l = l.withColumn("salt__", salted)
    spread = lists.withColumn("salt__", F.explode(F.when(F.col("rows__") > hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))).drop("rows__")
    out = l.join(spread, [*names, "at__", "salt__"]).select(*left.columns, F.explode("found__").alias("f__"))
    return out.select(*left.columns, F.col("f__.value__").alias(right_value), F.col("f__.tie__").alias(ties), *[F.col(f"f__.r{i}__").alias(c) for i, c in enumerate(keep)], F.col("f__.nth").alias("nth"))
