"""Metrics of predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchlens.operators.scans import running


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def confusion(df: DataFrame, truth: Column, prediction: Column, keys: list[str] = ()) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count_if(truth & prediction).alias("tp"), F.count_if(~truth & prediction).alias("fp"), F.count_if(~truth & ~prediction).alias("tn"), F.count_if(truth & ~prediction).alias("fn")
    )


def metrics(counts: DataFrame) -> DataFrame:
    """Precision, recall and so on from tp, fp, tn, fn; 0 where a denominator is."""
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))
    p, r, n = ratio(tp, tp + fp), ratio(tp, tp + fn), tp + fp + tn + fn
    root = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return counts.select(
        "*", p.alias("precision"), r.alias("recall"), ratio(2 * p * r, p + r).alias("f1"), ratio(tp + tn, n).alias("accuracy"),
        ratio(tn, tn + fp).alias("specificity"), ratio(fp + fn, n).alias("error_rate"), ratio(tp * tn - fp * fn, root).alias("mcc"),
    )


def thresholds(df: DataFrame, truth: Column, score: str, rows_per_range: int = 100_000) -> DataFrame:
    """The confusion counts of every threshold at once: a row per distinct score (threshold), which predicts all rows of at least that score as true.

    Rows of equal scores are added up first; running sums over the falling
    scores, by ranges, then give all of them. A null score is never predicted
    true; a row of unknown truth doesn't count. Returns threshold, tp, fp, tn,
    fn (long), tied_true, tied_false: rows of that very score.
    """
    s = df.select(F.col(score).alias("threshold"), truth.alias("truth__")).filter("truth__ is not null")
    every = s.agg(F.count_if("truth__").alias("p"), F.count_if(~F.col("truth__")).alias("n")).select(F.struct("p", "n").alias("x"))
    g = s.filter("threshold is not null").groupBy("threshold").agg(F.count_if("truth__").alias("tied_true"), F.count_if(~F.col("truth__")).alias("tied_false"))
    r = running(g, [], [F.col("threshold").desc()], {"tp": ("sum", F.col("tied_true")), "fp": ("sum", F.col("tied_false"))}, rows_per_range=rows_per_range)
    r = r.withColumn("all__", every.scalar())
    return r.select("threshold", "tp", "fp", (F.col("all__.n") - F.col("fp")).alias("tn"), (F.col("all__.p") - F.col("tp")).alias("fn"), "tied_true", "tied_false")


def ranking_quality(counts: DataFrame) -> DataFrame:
    """Of `thresholds`, one row: area under the curve of true against false positive rate (a tie counts half; null without both classes), the best F1 and the highest threshold that has it.

    A false row of a score is ranked below all true rows of higher scores and half of those of its own.
    """
    below = F.col("tied_false").cast("double") * (F.col("tp") - F.col("tied_true") / 2)
    f1 = ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    pairs = F.max(F.col("tp") + F.col("fn")).cast("double") * F.max(F.col("fp") + F.col("tn")).cast("double")
    best = F.max(F.struct(f1.alias("f1"), F.col("threshold").alias("at")))
    return counts.agg(F.try_divide(F.sum(below), pairs).alias("auc"), best.alias("b"), F.count("*").alias("n_thresholds")).select("auc", F.col("b.f1").alias("best_f1"), F.col("b.at").alias("best_threshold"), "n_thresholds")


def funnel(df: DataFrame, keys: list[str], stages: dict[str, Column]) -> DataFrame:
    """How many keys reach each stage and all before it, and the share of those of the stage before."""
    reached, hit = [], F.lit(True)
    for name, c in stages.items():
        reached.append(F.max(c.cast("int")).alias(name))
    g = df.groupBy(*keys).agg(*reached)
    out, before = [F.count("*").alias("total")], None
    for name in stages:
        hit &= F.col(name) == 1
        out.append(F.count_if(hit).alias(name))
    t = g.agg(*out)
    for name in stages:
        t = t.withColumn(f"{name}_share", ratio(F.col(name), F.col(before or "total")))
        before = name
    return t


def span_overlap(df: DataFrame) -> DataFrame:
    """Micro precision, recall and F1 of predicted spans (start, end inclusive); an invalid prediction is widened by 350."""
    end = F.when(F.col("pred_end") < F.col("pred_start"), F.col("pred_start") + 350).otherwise(F.col("pred_end"))
    both = F.greatest(F.lit(0), F.least(end, F.col("true_end")) - F.greatest(F.col("pred_start"), F.col("true_start")) + 1)
    g = df.agg(F.sum(both).alias("overlap"), F.sum(end - F.col("pred_start") + 1).alias("predicted"), F.sum(F.col("true_end") - F.col("true_start") + 1).alias("actual"))
    p, r = ratio(F.col("overlap"), F.col("predicted")), ratio(F.col("overlap"), F.col("actual"))
    return g.select("*", p.alias("precision"), r.alias("recall"), ratio(2 * p * r, p + r).alias("f1"))


def accuracy_and_errors(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Per label: rows, accuracy, how many are wrong. `errors` has the wrong rows themselves."""
    wrong = F.col(label) != F.col(prediction)
    return df.groupBy(label).agg(F.count("*").alias("n"), F.avg((~wrong).cast("double")).alias("accuracy"), F.count_if(wrong).alias("n_wrong"))


def errors(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """The rows whose prediction is wrong, a row each: a list per label would grow with the input."""
    return df.filter(F.col(label) != F.col(prediction))


def token_span(offsets: Column, start: Column, end: Column, max_length: int) -> Column:
    """First and last token that hold the characters start and end; 0 and max_length - 1 if there is none.

    offsets: array of (s, e), e exclusive; the context's tokens follow the third (0, 0).
    """
    marks = F.filter(F.transform(offsets, lambda x, i: F.when((x["s"] == 0) & (x["e"] == 0), i)), lambda i: i.isNotNull())
    first = F.coalesce(F.get(marks, 2), F.lit(-1))
    holds = lambda at: F.get(F.filter(F.transform(offsets, lambda x, i: F.when((i > first) & (x["s"] <= at) & (at < x["e"]), i)), lambda i: i.isNotNull()), 0)
    return F.struct(F.coalesce(holds(start), F.lit(0)).alias("start"), F.coalesce(holds(end), F.lit(max_length - 1)).alias("end"))


def rescored(df: DataFrame) -> DataFrame:
    """A saved score table judged again: vulnerable if vul_score > fix_score rounded to 4 digits; counts and rate of right ones."""
    d = df.withColumn("pred", F.col("vul_score") > F.bround("fix_score", 4))
    return d.agg(F.count_if(F.col("pred") == F.col("has_vul")).alias("right"), F.count_if(F.col("pred") != F.col("has_vul")).alias("wrong")).withColumn("rate", ratio(F.col("right"), F.col("right") + F.col("wrong")))
