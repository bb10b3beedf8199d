"""Unified diffs to hunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hunks(patches: DataFrame, id_col: str = "patch_id", raw_col: str = "raw", strict: bool = True) -> DataFrame:
    """A row per hunk: context, start and size before and after, lines before and after with their signs.

    `-` lines are before, `+` lines after, others both. Lines ahead of the
    first header form a hunk of zeros. A hunk without lines counts only as the
    last. If a header doesn't have two ranges with commas and three parts, the
    patch has no hunks; with strict=False a range without a comma has size 1
    and other headers are null. Rows are patches, each cut in its own row: no shuffle.
    """
    lines = F.split(F.coalesce(F.col(raw_col), F.lit("")), "\n")
    d = patches.select(F.col(id_col).alias("id"), lines.alias("l"))
    is_head = lambda x: x.startswith("@@")
    heads = F.filter(F.transform("l", lambda x, i: F.when(is_head(x), i)), lambda i: i.isNotNull())
    starts = F.concat(F.array(F.lit(-1)), heads)
    d = d.withColumn("starts", starts)
    cut = F.transform("starts", lambda s, k: F.struct(k.alias("no"), F.get("l", F.greatest(s, F.lit(0))).alias("head"), (s >= 0).alias("headed"), F.slice("l", s + 2, F.coalesce(F.get("starts", k + 1), F.size("l")) - s - 1).alias("body")))
    d = d.withColumn("cut", cut)
    form = r"^@@ *-([0-9]+),([0-9]+) \+([0-9]+),([0-9]+) *@@((?:(?!@@).)*)$" if strict else r"^@@ *-([0-9]+)(?:,([0-9]+))? \+([0-9]+)(?:,([0-9]+))? *@@(.*)$"
    if strict:
        d = d.filter(~F.exists("cut", lambda c: c["headed"] & ~c["head"].rlike(form)))
    d = d.select("id", F.explode("cut").alias("c"), F.size("cut").alias("n"))
    d = d.filter((F.size("c.body") > 0) | (F.col("c.no") == F.col("n") - 1))

    def number(k: int) -> Column:
        size = F.lit(1) if k in (2, 4) else F.lit(None).cast("int")
        return F.when(F.col("c.headed"), F.coalesce(F.regexp_extract("c.head", form, k).try_cast("int"), size)).otherwise(0)

    before = F.filter("c.body", lambda x: ~x.startswith("+"))
    after = F.filter("c.body", lambda x: ~x.startswith("-"))
    return d.select(
        F.col("id").alias(id_col), F.col("c.no").alias("hunk_no"), F.when(F.col("c.headed"), F.regexp_extract("c.head", form, 5)).otherwise("").alias("change_context"),
        number(1).alias("start_before"), number(2).alias("size_before"), number(3).alias("start_after"), number(4).alias("size_after"),
        before.alias("snippet_before"), after.alias("snippet_after"),
    )
