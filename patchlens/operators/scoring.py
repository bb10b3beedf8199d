"""Scoring of candidates by pluggable models, and what follows from the scores."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchlens.functions import text as T
from patchlens.operators.ordered import best, top_over


class Scorer(Protocol):
    """Scores text pairs in batches; loaded once per Python worker by `scored`."""

    def score(self, left: list[str], right: list[str]) -> list[float]: ...


class TokenOverlap:
    """Share of the left text's distinct tokens that the right one has. Deterministic; stands in for a model."""

    def score(self, left: list[str], right: list[str]) -> list[float]:
        sets = ((set(a.split()), set(b.split())) for a, b in zip(left, right))
        return [len(a & b) / len(a) if a else 0.0 for a, b in sets]


def scored(df: DataFrame, left: str, right: str, scorer: type = TokenOverlap, name: str = "score") -> DataFrame:
    """`df` with the scorer's result for two text columns, batch by batch over Arrow."""

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = scorer()
        for a, b in batches:
            yield pd.Series(model.score(a.fillna("").tolist(), b.fillna("").tolist()), dtype=float)

    return df.withColumn(name, run(left, right))


def overlap_score(left: Column, right: Column) -> Column:
    """TokenOverlap as an expression."""
    a, b = F.array_distinct(F.filter(F.split(left, r"\s+"), lambda x: x != "")), F.split(right, r"\s+")
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(a)), F.lit(0.0))


def shared_token_scores(left: DataFrame, right: DataFrame, left_id: str, right_id: str, left_text: str, right_text: str) -> DataFrame:
    """TokenOverlap's score of every pair of texts that share a token; that of all other pairs is 0.

    Pairs come from an equality join on the token, so no pair with a score is
    left out and none without one is built. Ids are unique on each side.
    """
    tokens = lambda c: F.array_distinct(F.filter(F.split(c, r"\s+"), lambda x: x != ""))
    a = left.select(left_id, tokens(F.col(left_text)).alias("t__")).select(left_id, F.size("t__").alias("n__"), F.explode("t__").alias("w__"))
    b = right.select(right_id, F.explode(tokens(F.col(right_text))).alias("w__"))
    return b.join(a, "w__").groupBy(left_id, right_id).agg((F.count("*") / F.first("n__")).alias("score"))


def confirmed(pairs: DataFrame, threshold: float = 0.99) -> DataFrame:
    return pairs.filter((F.col("pred") == 1) & (F.col("prob") > threshold))


def locate_inputs(pairs: DataFrame, length: int = 70, step: int = 20, head: int = 10) -> DataFrame:
    """A row per confirmed pair, patch and window: the snippet's first lines and the window's instructions.

    pairs: asm_codes, patches (array of vul_snippet_codes, fixed_snippet_codes), ...
    """
    d = pairs.select("*", F.posexplode("patches").alias("patch_no", "patch"))
    d = d.select("*", F.posexplode(T.sliding_windows(F.col("asm_codes"), length, step)).alias("window_no", "window"))
    question = F.slice(T.normalize_src_lines(F.transform("patch.vul_snippet_codes", T.strip_sign)), 1, head)
    return d.withColumn("question", F.array_join(question, " ")).withColumn("context", F.array_join("window", " "))


def located(scores: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Each function's best window; ties go to the first pair, patch and window."""
    return best(scores, ["case_id", "src_name"], "prob", threshold, ["bin_name", "patch_no", "window_no"])


def choice_inputs(found: DataFrame, length: int = 30) -> DataFrame:
    """The located instructions and both patch texts from their first difference on."""
    part = T.locate_suffix(F.col("window"), F.col("pred_text"), length)
    lines = lambda c: F.filter(F.transform(c, lambda x: T.strip(T.strip_sign(x))), lambda x: x != "")
    texts = T.choice_texts(lines(F.col("patch.vul_snippet_codes")), lines(F.col("patch.fixed_snippet_codes")))
    return found.withColumn("snippet", F.array_join(part, " ")).withColumn("texts", texts)


def score_verdict(choices: DataFrame, keys: list[str]) -> DataFrame:
    """Sums of both options' scores, and is_fixed: null if they are equal."""
    g = choices.groupBy(*keys).agg(F.sum("vul_score").alias("vul_score"), F.sum("fix_score").alias("fix_score"))
    return g.withColumn("is_fixed", F.when(F.col("vul_score") != F.col("fix_score"), F.col("vul_score") < F.col("fix_score")))


def has_vulnerability(located_any: Column, is_fixed: Column) -> Column:
    """A located function that isn't known to be fixed: undecided counts as vulnerable."""
    return located_any & ~F.coalesce(is_fixed, F.lit(False))


def confirmed_sums(snippets: DataFrame, keys: list[str]) -> DataFrame:
    """Number and score sum of snippets predicted 1, whether there is any."""
    hit = F.col("pred") == 1
    return snippets.groupBy(*keys).agg(F.count_if(hit).alias("n_confirmed"), F.coalesce(F.sum(F.when(hit, F.col("score"))), F.lit(0.0)).alias("score_sum"), F.bool_or(hit).alias("has_any"))


def legacy_verdict(df: DataFrame) -> DataFrame:
    """is_vul from any vulnerable snippet; is_repaired if the patch's score is no less, so also with no snippets."""
    return df.withColumn("is_vul", F.col("vul_count") > 0).withColumn("is_repaired", F.col("patch_score") >= F.col("vul_score"))


def candidates_rollup(functions: DataFrame, keys: list[str]) -> DataFrame:
    """Per vulnerability function: candidates, names of vulnerable and repaired ones, conclusion."""
    g = functions.groupBy(*keys).agg(
        F.count("*").alias("n_candidates"),
        F.count_if("has_vul").alias("n_vul"),
        F.count_if("is_repaired").alias("n_repaired"),
        F.array_sort(F.collect_list(F.when(F.col("has_vul"), F.col("bin_name")))).alias("vul_names"),
    )
    return g.withColumn("conclusion", F.col("n_vul") > F.col("n_repaired"))


def vulnerability_rollup(functions: DataFrame, keys: list[str]) -> DataFrame:
    return functions.groupBy(*keys).agg(F.count_if("conclusion").alias("n_confirmed"), F.bool_or("conclusion").alias("conclusion"))


def analysis_report(scores: DataFrame, keys: list[str], name: str, prob: str, threshold: float = 0.95, n: int = 1) -> DataFrame:
    """Possible names by falling probability, and the best over the threshold as confirmed."""
    ranked = F.array_sort(F.collect_list(F.struct((-F.col(prob)).alias("p"), F.col(name).alias("name"))))
    g = scores.groupBy(*keys).agg(F.transform(ranked, lambda x: x["name"]).alias("possible"))
    top = top_over(scores, keys, prob, threshold, n, [name]).groupBy(*keys).agg(F.array_sort(F.collect_list(name)).alias("confirmed"))
    return g.join(top, keys, "left").withColumn("confirmed", F.coalesce("confirmed", F.array().cast("array<string>")))
