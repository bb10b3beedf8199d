"""Feature statistics of files and projects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchlens.operators.scans import within_budget


def file_stats(files: DataFrame, keys: list[str], every: str, covered: str) -> DataFrame:
    """Per file: strings in all and distinct, those in nodes, and distinct strings (but `C`) that no node has; percent covered, 100 if there are none."""
    distinct, nodes = F.array_distinct(every), F.array_distinct(covered)
    missing = F.filter(F.array_except(distinct, nodes), lambda s: s != "C")
    percent = F.when(F.size(distinct) == 0, F.lit(100.0)).otherwise(100.0 * (F.size(distinct) - F.size(missing)) / F.size(distinct))
    return files.select(*keys, F.size(every).alias("n_strings"), F.size(distinct).alias("n_unique"), F.size(nodes).alias("n_node_unique"), F.size(missing).alias("n_missing"), percent.alias("percent"))


def project_stats(files: DataFrame, keys: list[str]) -> DataFrame:
    """Sums over a project's files; the share covered is 1 if it has no strings."""
    g = files.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("n_strings", "n_unique", "n_node_unique", "n_missing")], F.count("*").alias("n_files"))
    return g.withColumn("share", F.when(F.col("n_unique") == 0, F.lit(1.0)).otherwise((F.col("n_unique") - F.col("n_missing")) / F.col("n_unique")))


def guarded_files(files: DataFrame, size: str, most: int = 10 << 20, total: int = 2048 << 20) -> DataFrame:
    """Files of at most `most` bytes; an error if together they exceed `total`."""
    kept = files.filter(F.col(size) <= most)
    whole = kept.agg(F.coalesce(F.sum(size), F.lit(0)).alias("t")).select(F.col("t")).scalar()
    return kept.filter(F.when(whole > total, F.raise_error(F.lit("files exceed the memory limit")).cast("boolean")).otherwise(True))


def files_within(files: DataFrame, size: str, id_col: str, most: int = 10 << 20, total: int = 2048 << 20, rows_per_range: int = 100_000) -> DataFrame:
    """Of the files of at most `most` bytes the largest, in falling size (ties by id), as long as their sum stays within `total`: what can be worked on in bounded memory, instead of an error."""
    return within_budget(files.filter(F.col(size) <= most), size, total, [F.col(size).desc(), F.col(id_col)], rows_per_range)


def distinct_bitmaps(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The distinct whole numbers of `value` of each key as bitmaps: keys, bucket, bits.

    A bucket holds 32,768 neighbouring numbers in 4 KB. Tasks build their own
    bitmaps before the shuffle, so a hot key moves one row a task and bucket,
    and no key's values meet in one place. Bitmaps of coarser keys are the
    union of these: see `merged_bitmaps`. Nulls count as no value.
    """
    v = F.col(value).cast("long")
    return df.filter(v.isNotNull()).groupBy(*keys, F.bitmap_bucket_number(v).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(v)).alias("bits"))


def merged_bitmaps(bitmaps: DataFrame, keys: list[str]) -> DataFrame:
    """Bitmaps of fewer keys, without another look at the rows."""
    return bitmaps.groupBy(*keys, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def distinct_counts(bitmaps: DataFrame, keys: list[str], name: str = "n_distinct") -> DataFrame:
    """Exact numbers of distinct values of each key from its bitmaps."""
    return bitmaps.groupBy(*keys).agg(F.sum(F.bitmap_count("bits")).alias(name))
