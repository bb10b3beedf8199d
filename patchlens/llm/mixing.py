"""Mixing sources to target weights, by distributed prefix sums over hash-random keys."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from patchlens.llm.common import cut, n_words
from patchlens.operators.ordered import numbered

SEED = "mix-1"
#: Sources up to which their targets and ends are broadcast (some 100 bytes each).
BROADCAST_SOURCES = 100_000


def source_targets(totals: DataFrame, weights=(3, 1, 2), share: float = 1.5, repeats: int = 2) -> DataFrame:
    """Targets from one row per source: `src`, `source`, `source_size`.

    Sources in code point order, null last, take the weights in turn. A target
    is `least(repeats * size, level * weight)`. The level starts where it would
    be without limits; sources that are full at it fix their targets, what they
    can't take is reshared by weight among the others, which raises the level,
    until no further source gets full. Each step is one aggregate of two sums;
    no task sees all sources, however many hosts they are.
    """
    t = numbered(totals.withColumn("last", F.col("source").isNull()), ["last", "source"], "place")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    t = cut(t.select("src", "source_size", w.alias("w"), (F.lit(float(repeats)) * F.col("source_size")).alias("cap")))
    whole, level, before = share * (t.agg(F.sum(F.col("source_size").cast("double"))).first()[0] or 0.0), 0.0, -1
    while True:
        full = F.lit(before >= 0) & (F.col("cap") <= level * F.col("w"))
        fixed, open_, n, some = t.agg(F.sum(F.when(full, F.col("cap"))), F.sum(F.when(~full, F.col("w"))), F.count_if(full), F.count("*")).first()
        if n == before or n == some:
            break
        before, level = n, (whole - (fixed or 0.0)) / open_
    return t.select("src", "source_size", F.when(F.lit(n == some), F.col("cap")).otherwise(F.least(F.col("cap"), level * F.col("w"))).alias("target"))


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    size_col: str | None = None,
    weights=(3, 1, 2),
    share: float = 1.5,
    repeats: int = 2,
    rows_per_bucket: int = 20_000,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """How many words the mix takes of each document.

    Words are counted once (or given as `size_col`). Every document gets the key md5(seed, id): random, but the same in every
    run. The key's range is cut in buckets; the words of each (source, bucket)
    are summed with map-side combine and a running sum over a source's buckets
    gives each bucket's place in the source's order, and each source's last
    bucket in each epoch. Buckets before it are taken whole, later ones not.
    Only in a last bucket that the budget cuts through is there a running sum
    over documents. So no task holds a source, however hot, and documents meet
    a row per source (broadcast, as counted) but aren't shuffled, except those
    in the few last buckets.
    Once a source is used up its order is run through again, up to `repeats`
    times. The document at the cut is taken in part: the budget is met exactly.

    Returns `id_col`, the `keep` columns, and size (long: words, or `size_col`),
    source, source_size (long), target (double), taken (long, at most
    `repeats` times size). A null id's key comes from the hash of the text, so
    that many of them don't share one; equal ids have equal keys and go by size. Null text has size 0 and takes 0. A null
    source is a source of its own. An empty table gives an empty result.
    """
    d = docs.select(
        F.col(id_col).alias("id"),
        F.col(source_col).alias("source"),
        (F.coalesce(F.col(size_col).cast("long"), F.lit(0)) if size_col else n_words(F.col(text_col))).alias("size"),
        F.md5(F.coalesce(F.col(text_col), F.lit(""))).alias("salt"),
        *[F.col(c).alias(f"keep_{i}") for i, c in enumerate(keep)],
    )
    d = d.withColumn("src", F.coalesce(F.concat(F.lit("="), "source"), F.lit("null")))
    d = d.withColumn("key", F.md5(F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col("id").cast("string"), F.concat(F.lit("null:"), F.col("salt")))))).drop("salt")
    if not keep:
        d = cut(d)
    rows = docs.count()
    buckets = max(16, math.ceil(rows / rows_per_bucket))
    d = d.withColumn("bucket", F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * buckets / 2**32))

    sums = cut(d.groupBy("src", "bucket").agg(F.first("source").alias("source"), F.sum("size").alias("bucket_size")))
    totals = sums.groupBy("src").agg(F.first("source").alias("source"), F.sum("bucket_size").alias("source_size"))
    before = F.sum("bucket_size").over(W.partitionBy("src").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))
    places = sums.select("src", "bucket", "bucket_size", F.coalesce(before, F.lit(0)).alias("bucket_start"))
    targets = source_targets(totals, weights, share, repeats).withColumn("budget", F.floor(F.col("target") + 1e-6))
    places = places.join(targets, "src")
    cuts = [F.col("budget") - e * F.col("source_size") for e in range(repeats)]
    last = []
    for e, c in enumerate(cuts):
        bucket = F.struct("bucket", F.col("bucket_start").alias("start"), (c < F.col("bucket_start") + F.col("bucket_size")).alias("cut"))
        last.append(F.max(F.when(c > F.col("bucket_start"), bucket)).alias(f"last_{e}"))
    ends = cut(targets.join(places.groupBy("src").agg(*last), "src"))
    j = d.join(F.broadcast(ends) if ends.count() <= BROADCAST_SOURCES else ends, "src")

    epochs, through, bucket_start = F.lit(0), F.lit(False), F.lit(None).cast("long")
    for e in range(repeats):
        end = F.col(f"last_{e}")
        here = F.coalesce((F.col("bucket") == end["bucket"]) & end["cut"], F.lit(False))
        epochs += F.coalesce(F.col("bucket") <= end["bucket"], F.lit(False)).cast("int")
        through |= here
        bucket_start = F.coalesce(bucket_start, F.when(here, end["start"]))
    j = j.withColumn("through", through)
    plain = j.filter(~F.col("through")).withColumn("taken", F.col("size") * epochs)
    order = W.partitionBy("src", "bucket").orderBy("key", "id", "size").rowsBetween(W.unboundedPreceding, -1)
    edge = j.filter("through").withColumn("start", bucket_start + F.coalesce(F.sum("size").over(order), F.lit(0)))
    part = F.lit(0).cast("long")
    for c in cuts:
        part += F.greatest(F.lit(0), F.least(F.col("size"), c - F.col("start")))
    out = plain.unionByName(edge.withColumn("taken", part).drop("start"))
    return out.select(
        F.col("id").alias(id_col),
        *[F.col(f"keep_{i}").alias(c) for i, c in enumerate(keep)],
        "size",
        "source",
        "source_size",
        "target",
        F.col("taken").cast("long").alias("taken"),
    )


def take_words(mixed: DataFrame, text_col: str = "text", id_col: str = "doc_id", others: tuple[str, ...] = ()) -> DataFrame:
    """The mix itself: a row for each copy of a document, the last one cut after the words still due.

    `mixed` is mix_sources(..., keep=(text_col, *others)). Documents of which
    nothing is taken give no row. The cut keeps the text up to the end of its
    last word, white space between words included.
    """
    full = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    rest = F.when(F.col("size") > 0, F.col("taken") % F.col("size")).otherwise(0).cast("int")
    word = r"[^\x20\x09-\x0D]++"
    t = mixed.withColumn("full", full).withColumn("rest", rest)
    pieces = F.split(F.col(text_col), r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    part = F.when(F.col("rest") > 0, F.array(F.array_join(F.slice(pieces, F.lit(1), F.col("rest")), ""))).otherwise(F.array().cast("array<string>"))
    copies = F.concat(F.array_repeat(F.col(text_col), F.col("full")), part)
    t = t.select(id_col, *others, "source", F.posexplode(copies).alias("copy", text_col))
    return t
