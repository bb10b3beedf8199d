"""Host-level quality rules: failures by domain, shrunk by an empirical beta prior, joined back to documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchlens.llm.common import SPACE, cut, words

#: Characters of the symbol rule.
SYMBOLS = "[#*$%&|<>]"


def repeated_words(word: Column, n: int = 3) -> Column:
    """How many words lie in a window of `n` words that the text has twice or more.

    `word` is an array. Windows are compared by 64-bit hashes. Texts whose
    windows all differ (seen from the size of the distinct hashes) stop there;
    in the others hashes sort with their places, so that equal ones are
    neighbours, and the places of the repeated ones, in order, add what each
    covers beyond the one before.
    """
    count = F.size(word) - (n - 1)
    grams = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.xxhash64(*[F.get(word, i + k) for k in range(n)]))

    def covered(hashes: Column) -> Column:
        ranked = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(r: Column) -> Column:
            same = lambda x, k: F.coalesce(F.get(r, k)["h"] == x["h"], F.lit(False))
            twice = F.filter(r, lambda x, k: same(x, k - 1) | same(x, k + 1))
            return F.array_sort(F.transform(twice, lambda x: x["i"]))

        at = _let(ranked, places)
        return _let(at, lambda p: F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(n), F.coalesce(F.get(p, k + 1) - x, F.lit(n)))), F.lit(0), lambda a, b: a + b))

    return F.when(count < 2, F.lit(0)).otherwise(_let(grams, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(covered(g)))).cast("long")


def _let(value: Column, body) -> Column:
    """`body(value)` with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def document_stats(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """Per document: the counts that the rules read. Thin rows; no shuffle."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(F.col(id_col).alias("id"), F.col(host_col).alias("host"), text.alias("text"))
    d = d.withColumn("word", words(F.col("text")))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    d = d.select(
        "id",
        "host",
        F.size("word").cast("long").alias("n_words"),
        F.char_length(F.array_join("word", "")).cast("long").alias("word_chars"),
        (F.char_length("text") - F.char_length(F.regexp_replace("text", f"{SYMBOLS}+", ""))).cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("line"),
        repeated_words(F.col("word")).alias("n_repeat_words"),
    )
    return d.select("id", "host", "n_words", "word_chars", "n_symbols", F.col("line.n").alias("n_lines"), F.col("line.dup").alias("n_dup_lines"), "n_repeat_words")


def host_rules(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    min_words: int = 50,
    max_repeat_percent: int = 50,
    max_symbol_percent: int = 25,
    max_dup_line_percent: int = 50,
    leniency: tuple[float, float] = (0.5, 4.0),
) -> DataFrame:
    """Which documents stay, judged by their own base rules and by their host.

    base_failed: fewer than `min_words` words, or more than
    `max_repeat_percent` per cent of them in repeated 3-word windows.
    A document is suspect if it fails the base, has more than
    `max_symbol_percent` symbols per 100 word characters, or more than
    `max_dup_line_percent` per cent of its lines repeat earlier ones.

    Each host's rate of suspect documents is shrunk towards the corpus by a
    beta prior fitted to all hosts by moments: a host with few documents is
    near the corpus rate, one with many speaks for itself. The posterior sets
    how much a host's documents may show before they go: their symbols and
    repeated lines are held against the two limits times the corpus rate over
    the host's (`leniency` bounds this factor; it is 1 without any suspect
    document). So a document with many symbols goes on a host like the others
    and stays on a cleaner one, and on a host that fails often smaller faults
    suffice. Documents without such faults stay wherever they are.

    The text is read once, without a shuffle; what moves is a row of counts
    per (task, host) and the verdicts of hosts. Returns id_col, n_words,
    word_chars, n_symbols, n_dup_lines, n_repeat_words (long), base_failed,
    kept, suspect (boolean), leniency (double). Null text counts as empty (base
    fails); a null host is a host of its own; rows that repeat are judged one
    by one; an empty table gives an empty result.
    """
    stats = cut(document_stats(docs, id_col, text_col, host_col))
    n, rep = F.col("n_words"), F.col("n_repeat_words")
    base = (n < min_words) | (100 * rep > max_repeat_percent * n)
    suspect = base | (100 * F.col("n_symbols") > max_symbol_percent * F.col("word_chars")) | (100 * F.col("n_dup_lines") > max_dup_line_percent * F.col("n_lines"))
    s = stats.withColumn("base_failed", base).withColumn("suspect", suspect).withColumn("hk", F.coalesce(F.concat(F.lit("="), F.col("host").cast("string")), F.lit("null")))
    verdicts = host_verdicts(s.groupBy("hk").agg(F.count("*").cast("double").alias("n"), F.sum(F.col("suspect").cast("double")).alias("bad")), leniency)
    j = s.join(verdicts.select("hk", "leniency"), "hk")
    faulty = (100 * F.col("n_symbols") > max_symbol_percent * F.col("leniency") * F.col("word_chars")) | (100 * F.col("n_dup_lines") > max_dup_line_percent * F.col("leniency") * F.col("n_lines"))
    return j.select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~faulty).alias("kept"), "suspect", "leniency",
    )


def host_verdicts(hosts: DataFrame, leniency: tuple[float, float]) -> DataFrame:
    """Posterior failure rates, and what they make of the limits. `hosts`: hk, n, bad (doubles), a row per host.

    Moments: m is the corpus rate, v the variance of hosts' rates weighted by
    documents less what binomial noise alone would give; the prior's strength
    is m(1-m)/v - 1, held between 1 and 10000.
    """
    total = hosts.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.count("*").alias("hosts"), F.sum(F.col("bad") * F.col("bad") / F.col("n")).alias("sq"))
    m = F.col("bad") / F.col("n")
    spread = F.col("sq") / F.col("n") - m * m - m * (1 - m) * F.col("hosts") / F.col("n")
    strength = F.when(spread > 0, F.least(F.lit(10000.0), F.greatest(F.lit(1.0), m * (1 - m) / spread - 1))).otherwise(10000.0)
    prior = total.select(F.struct(m.alias("m"), strength.alias("k")).alias("p"))
    h = hosts.withColumn("p", prior.scalar())
    rate = (F.col("bad") + F.col("p.m") * F.col("p.k")) / (F.col("n") + F.col("p.k"))
    factor = F.least(F.lit(leniency[1]), F.greatest(F.lit(leniency[0]), F.col("p.m") / rate))
    return h.select("hk", "n", "bad", rate.alias("rate"), F.when(F.col("p.m") > 0, F.round(factor, 9)).otherwise(1.0).alias("leniency"))
