"""Connected components of a graph that no one machine holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchlens.llm.common import cut, discard


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of `edges` (u, v: long), root being its component's least node.

    Alternates two steps until nothing changes (a number of times that grows
    with the square of the logarithm of the graph's size at most): every node
    links its greater neighbours to its least neighbour, then its lesser ones.
    Minima are combined before the shuffle, so a node with very many
    neighbours is no hot key of an aggregation; each round ends in the
    checkpoint folder. Loops and repeated edges do no harm; no edges, no rows.
    """
    e = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct())
    mark = None
    for _ in range(rounds):
        seen = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark or not seen[0]:
            break
        mark = seen
        both = e.union(e.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        last = e
        e = cut(small.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").union(low.toDF("u", "v")).distinct())
        discard(last)
    else:
        raise RuntimeError(f"components have not settled in {rounds} rounds")
    out = cut(e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select("v", "v").distinct().toDF("node", "root")))
    discard(e)
    return out
