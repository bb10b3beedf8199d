"""Training sets: splits, partners and perturbed copies, by hashes of keys instead of random states.

The same seed gives the same rows whatever the partitioning.
"""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from patchlens.functions import text as T
from patchlens.operators.ordered import numbered, ranked
from patchlens.sources.shared import cut


def key_of(id_col: str, seed: str = "0") -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), F.col(id_col).cast("string")))


def split_80_10_10(df: DataFrame, id_col: str, seed: str = "0") -> DataFrame:
    """`df` with split: train, valid or test, of exactly floor(.8 n), floor(.1 n) and the remaining rows."""
    d = df.withColumn("h__", F.conv(F.substring(key_of(id_col, seed), 1, 15), 16, 10).cast("long"))
    n = df.count()
    d = numbered(d, ["h__", id_col], "k__")
    a = n * 8 // 10
    split = F.when(F.col("k__") < a, "train").when(F.col("k__") < a + n // 10, "valid").otherwise("test")
    return d.withColumn("split", split).drop("h__", "k__")


def partners(df: DataFrame, id_col: str, keys: list[str], differ: str, seed: str = "0") -> DataFrame:
    """Each row with the next row in its group's hash order (the last with the first), if the column `differ` differs.

    Ids are unique and not null. Who follows whom is found with ids and keys
    alone, however large a group; the values are fetched afterwards.
    """
    thin = df.select(*[F.col(c).alias(f"g{i}__") for i, c in enumerate(keys)], F.col(id_col).alias("id__"), key_of(id_col, seed).alias("h__"))
    on = [f"g{i}__" for i in range(len(keys))]
    r = cut(ranked(thin, on, ["h__", "id__"], "at__", "n__").drop("h__"))
    other = r.select(*[F.col(c).alias(f"o{c}") for c in on], F.col("at__").alias("o_at__"), F.col("id__").alias("partner_id"))
    same = (F.col("at__") + 1) % F.col("n__") == F.col("o_at__")
    for c in on:
        same &= F.col(c).eqNullSafe(F.col(f"o{c}"))
    pairs = r.join(other, same).select("id__", "partner_id")
    values = df.select(F.col(id_col).alias("p__"), F.col(differ).alias("partner"))
    j = df.join(pairs, F.col(id_col) == F.col("id__")).join(values, F.col("partner_id") == F.col("p__"))
    return j.filter(F.col("partner") != F.col(differ)).select(*df.columns, "partner_id", "partner")


def random_partners(df: DataFrame, id_col: str, keys: list[str], value: str, seed: str = "0") -> DataFrame:
    """Each row with a row of its group drawn by its id's hash, as likely any as any other, itself among them: partner_id, partner (that row's value).

    Ids are unique and not null. As with `partners`, places are found with ids
    and keys alone.
    """
    on = [f"g{i}__" for i in range(len(keys))]
    thin = df.select(*[F.col(c).alias(f"g{i}__") for i, c in enumerate(keys)], F.col(id_col).alias("id__"))
    r = cut(ranked(thin, on, ["id__"], "at__", "n__"))
    other = r.select(*[F.col(c).alias(f"o{c}") for c in on], F.col("at__").alias("o_at__"), F.col("id__").alias("partner_id"))
    same = drawn(F.concat_ws(":", F.lit(seed), F.col("id__").cast("string")), 0, F.col("n__")) == F.col("o_at__")
    for c in on:
        same &= F.col(c).eqNullSafe(F.col(f"o{c}"))
    pairs = r.join(other, same).select("id__", "partner_id")
    values = df.select(F.col(id_col).alias("p__"), F.col(value).alias("partner"))
    return df.join(pairs, F.col(id_col) == F.col("id__")).join(values, F.col("partner_id") == F.col("p__")).select(*df.columns, "partner_id", "partner")


def ratio_udf(autojunk: bool = True):
    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([difflib.SequenceMatcher(None, x, y, autojunk).ratio() for x, y in zip(a.fillna(""), b.fillna(""))], dtype=float)

    return ratio


def ratio_bound(a: Column, b: Column) -> Column:
    """No less than `ratio_udf` of two texts (null: empty): from their lengths, then from the characters they share, each as often as both have it."""
    a, b = F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))
    n, m = F.char_length(a), F.char_length(b)
    times = lambda text, c: F.char_length(text) - F.char_length(F.replace(text, c, F.lit("")))
    shared = F.aggregate(F.array_distinct(F.split(a, "")), F.lit(0), lambda acc, c: acc + F.least(times(a, c), times(b, c)))
    return F.when(n + m == 0, 1.0).otherwise(2.0 * shared / (n + m))


def length_bound(a: Column, b: Column) -> Column:
    """As `ratio_bound`, from the lengths alone."""
    n, m = F.char_length(F.coalesce(a, F.lit(""))), F.char_length(F.coalesce(b, F.lit("")))
    return F.when(n + m == 0, 1.0).otherwise(2.0 * F.least(n, m) / (n + m))


def common_length(x: str, y: str) -> int:
    """Length of the longest common subsequence; a set bit of `rows` marks a place without a match yet."""
    places: dict[str, int] = {}
    for i, c in enumerate(x):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(x)) - 1
    rows = full
    for c in y:
        m = rows & places.get(c, 0)
        rows = (rows + m | rows - m) & full
    return len(x) - rows.bit_count()


def fuzzy_ratio_udf():
    """100 times the normalised insert/delete similarity: 200 LCS / (length sum); 100 for two empty texts."""

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([200 * common_length(x, y) / (len(x) + len(y)) if x or y else 100.0 for x, y in zip(a.fillna(""), b.fillna(""))], dtype=float)

    return ratio


def dissimilar(df: DataFrame, id_col: str, text: str, block: list[str], k: int, below: float, tries: int = 8, seed: str = "0", exact: bool = True) -> DataFrame:
    """The first `k` partners of each row in its block's hash order, from the next row on and round the end, whose similarity is under `below`.

    A first round compares the next `tries` rows; only rows still short of `k`
    go on, with twice as many in each further round, until they have `k` or
    the block is used up. Pairs whose bound (`length_bound`, else
    `ratio_bound`) is under `below` need no comparison; only the others go to
    Python. The similarity of the partners is compared for the result, unless
    `exact` is false: then it is null where the bound decided.
    """
    thin = df.select(*[F.col(c).alias(f"b{i}__") for i, c in enumerate(block)], F.col(id_col).alias("id__"), key_of(id_col, seed).alias("h__"))
    thin = ranked(thin, [f"b{i}__" for i in range(len(block))], ["h__", "id__"], "at__", "n__").drop("h__")
    texts = df.select(F.col(id_col).alias("i__"), F.col(text).alias("t__"))
    rows = cut(thin.join(texts, F.col("id__") == F.col("i__")).drop("i__"))
    on = [f"b{i}__" for i in range(len(block))]
    others = rows.select(*[F.col(c).alias(f"o{c}") for c in on], F.col("at__").alias("o_at__"), F.col("id__").alias("o_id__"), F.col("t__").alias("o_t__"))
    same = F.col("to__") == F.col("o_at__")
    for c in on:
        same &= F.col(c).eqNullSafe(F.col(f"o{c}"))
    out, done = None, 0
    short = rows.withColumn("has__", F.lit(0))
    while True:
        last = F.least(F.lit(done + tries), F.col("n__") - 1).cast("int")
        tried = short.filter(F.col("n__") - 1 > done).withColumn("try__", F.explode(F.sequence(F.lit(done + 1), last)))
        tried = tried.withColumn("to__", (F.col("at__") + F.col("try__")) % F.col("n__")).join(others, same)
        far = F.when(length_bound(F.col("t__"), F.col("o_t__")) < below, True).otherwise(ratio_bound(F.col("t__"), F.col("o_t__")) < below)
        tried = tried.withColumn("far__", far)
        near = tried.filter("not far__").withColumn("similarity", ratio_udf()(F.col("t__"), F.col("o_t__"))).filter(F.col("similarity") < below)
        tried = tried.filter("far__").withColumn("similarity", F.lit(None).cast("double")).unionByName(near)
        first = W.partitionBy(*on, "at__").orderBy("try__")
        found = cut(tried.withColumn("r__", F.row_number().over(first) + F.col("has__")).filter(F.col("r__") <= k).select(*on, "at__", "r__", "id__", "o_id__", "similarity"))
        out = found if out is None else out.unionByName(found)
        done, tries = done + tries, 2 * tries
        most = found.groupBy(*[F.col(c).alias(f"o{c}") for c in on], F.col("at__").alias("o_at__")).agg(F.max("r__").alias("most__"))
        match = F.col("at__") == F.col("o_at__")
        for c in on:
            match &= F.col(c).eqNullSafe(F.col(f"o{c}"))
        short = short.join(most, match, "left").withColumn("has__", F.coalesce("most__", "has__")).filter((F.col("has__") < k) & (F.col("n__") - 1 > done)).select(*rows.columns, "has__")
        short = cut(short)
        if short.isEmpty():
            break
    out = out.select("id__", "o_id__", "similarity")
    if exact:
        other = texts.toDF("j__", "o_t__")
        bare = out.filter("similarity is null").drop("similarity").join(texts, F.col("id__") == F.col("i__")).join(other, F.col("o_id__") == F.col("j__"))
        bare = bare.select("id__", "o_id__", ratio_udf()(F.col("t__"), F.col("o_t__")).alias("similarity"))
        out = out.filter("similarity is not null").unionByName(bare)
    return out.select(F.col("id__").alias(id_col), F.col("o_id__").alias("partner_id"), "similarity")


def drawn(key: Column, step, n: Column) -> Column:
    """A number from 0 to n - 1 that the key and the step decide."""
    h = F.conv(F.substring(F.md5(F.concat_ws(":", key.cast("string"), F.lit(step).cast("string") if isinstance(step, int) else step.cast("string"))), 1, 8), 16, 10).cast("long")
    return F.pmod(h, n).cast("int")


def _twice(a: Column, at: Column) -> Column:
    return F.concat(F.slice(a, F.lit(1), at + 1), F.slice(a, at + 1, F.size(a) - at))


def _without(a: Column, at: Column) -> Column:
    return F.concat(F.slice(a, F.lit(1), at), F.slice(a, at + 2, F.size(a)))


def _swapped(a: Column, i: Column, j: Column) -> Column:
    return F.transform(a, lambda x, p: F.when(p == i, F.get(a, j)).when(p == j, F.get(a, i)).otherwise(x))


def perturbed_asm(key: Column, lines: Column, head: int = 30) -> Column:
    """All instructions, of the first `head` three repeated in place, three removed, two swapped; lists of less than three stay as they are.

    The key's hashes choose the places. Runs in the JVM.
    """

    def step(a: Column, k: Column) -> Column:
        n = F.size(a)
        return F.when(k < 6, T.let(drawn(key, k, n), lambda at: F.when(k < 3, _twice(a, at)).otherwise(_without(a, at)))).otherwise(
            T.let(drawn(key, 6, n), lambda i: T.let(F.pmod(i + 1 + drawn(key, 7, n - 1), n), lambda j: _swapped(a, i, j)))
        )

    done = F.aggregate(F.sequence(F.lit(0), F.lit(6)), F.slice(lines, 1, head), step)
    return F.when(F.size(lines) < 3, lines).otherwise(F.concat(done, T.tail(lines, head)))


def perturbed_src(key: Column, lines: Column) -> Column:
    """One to three times a line is removed, or one of the lines is put in behind another, as the key's hashes choose. Runs in the JVM."""

    def step(a: Column, k: Column) -> Column:
        at = drawn(key, 10 + k, F.size(a))
        insert = T.let(at, lambda p: F.concat(F.slice(a, F.lit(1), p + 1), F.array(F.get(lines, drawn(key, 30 + k, F.size(lines)))), F.slice(a, p + 2, F.size(a))))
        return F.when(F.size(a) == 0, a).when(drawn(key, 20 + k, F.lit(2)) == 0, T.let(at, lambda p: _without(a, p))).otherwise(insert)

    return F.aggregate(F.sequence(F.lit(1), 1 + drawn(key, 0, F.lit(3))), lines, step)


def negative_pairs(df: DataFrame, id_col: str, keys: list[str], asm: str, seed: str = "0") -> DataFrame:
    """Pairs of label 0: a row's source with its partner's instructions, perturbed."""
    d = partners(df, id_col, keys, asm, seed)
    return d.withColumn(asm, perturbed_asm(F.col(id_col), F.col("partner"))).withColumn("label", F.lit(0)).drop("partner")


def choice_items(df: DataFrame, id_col: str, keys: list[str], src: str, copies: int = 3, seed: str = "0") -> DataFrame:
    """Wrong options of each row: one of a partner, and `copies` of its own source, perturbed; those equal to the right one are left out."""
    other = partners(df, id_col, keys, src, seed).select(id_col, F.lit(0).alias("wrong_type"), F.col(src).alias("src_0"), F.col("partner").alias("src_1"))
    own = df.select(id_col, src, F.explode(F.sequence(F.lit(1), F.lit(copies))).alias("copy"))
    own = own.withColumn("src_1", perturbed_src(F.concat_ws(":", F.col(id_col).cast("string"), F.col("copy").cast("string")), F.col(src)))
    return other.unionByName(own.filter(F.col("src_1") != F.col(src)).select(id_col, F.lit(1).alias("wrong_type"), F.col(src).alias("src_0"), "src_1"))


def source_slice(id_col: str, lines: Column, length: int, seed: str = "0") -> Column:
    """`length` lines from a hashed start between 3 and n - 4, cut at the end; all lines if there are fewer than eight."""
    n = F.size(lines)
    h = F.conv(F.substring(key_of(id_col, seed), 1, 8), 16, 10).cast("long")
    start = 3 + F.pmod(h, F.greatest(n - 6, F.lit(1)))
    return F.when(n < 8, lines).otherwise(F.slice(lines, (start + 1).cast("int"), length))


def row_windows(id_col: str, items: Column, seed: str = "0") -> Column:
    """Windows of seven: the whole of a shorter list, else min(ceil(n / 7), 3) at hashed starts."""
    n = F.size(items)
    count = F.least(F.ceil(n / 7), F.lit(3)).cast("int")

    def at(k: Column) -> Column:
        h = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col(id_col).cast("string"), k.cast("string"))), 1, 8), 16, 10).cast("long")
        return F.slice(items, (F.pmod(h, F.greatest(n - 6, F.lit(1))) + 1).cast("int"), 7)

    return F.when(n < 7, F.array(items)).otherwise(F.transform(F.sequence(F.lit(1), count), at))


def positioning_items(df: DataFrame) -> DataFrame:
    """Training items of (src_codes, asm_codes, answer_asm_codes): five effective lines, at most 50 instructions, 2 to 10 answer lines per source line."""
    c = T.effective_line_count(F.col("src_codes"))
    d = df.withColumn("effective_src_length", c)
    n, a = F.col("effective_src_length"), F.size("answer_asm_codes")
    return d.filter((n >= 5) & (F.size("asm_codes") <= 50) & (a > 2 * n) & (a < 10 * n))


def train_text(src: Column, asm: Column, marks: tuple[str, str, str] = ("[SRC_CODE]", "[SEP]", "[ASM_CODE]"), most: int = 1000) -> Column:
    """Source and instructions as one text: the first line and three instructions, then a line at a time with as many instructions as there are per line (rounded half to even), until either list is used up or the text passes `most` characters.

    A line of one character or a bare literal isn't ended at: the next line
    comes with it. So of a stretch of such lines every second one is a place to
    end, and all others lines are. Running sums of the lines' lengths give the
    length of the text at every place; the first that can't go on is the end.
    """
    reach = most + 5  # with the space behind it a line adds a character at least, so no text goes further

    def place(acc: Column, line: Column) -> Column:
        brief = (acc["line"] > 0) & ((F.char_length(line) == 1) | (line == '"STR"'))
        gap = F.when(brief, acc["gap"] + 1).otherwise(0)
        more, chars = (gap % 2 == 0) & ~acc["over"], acc["chars"] + F.char_length(line) + 1
        ends = F.when(more, F.concat(acc["ends"], F.array(acc["line"] + 1))).otherwise(acc["ends"])
        return F.struct((acc["line"] + 1).alias("line"), gap.alias("gap"), chars.alias("chars"), (acc["over"] | (more & (chars > most) & (acc["line"] > 0))).alias("over"), ends.alias("ends"))

    def sums(lines: Column) -> Column:
        """Characters of the first k lines with a space between them, for every k up to the first that has too many."""
        grow = lambda acc, x: F.when(F.element_at(acc, -1) > most, acc).otherwise(F.concat(acc, F.array(F.element_at(acc, -1) + F.char_length(x) + 1)))
        return F.aggregate(F.slice(lines, 1, reach), F.array(F.lit(-1)), grow)

    def measured(x: Column) -> Column:
        start = F.struct(F.lit(0).alias("line"), F.lit(0).alias("gap"), F.lit(0).alias("chars"), F.lit(False).alias("over"), F.array().cast("array<int>").alias("ends"))
        ends = F.aggregate(F.slice(x["s"], 1, reach), start, place, lambda acc: acc["ends"])
        each = F.coalesce(F.bround(F.try_divide(F.size(x["a"]).cast("double"), F.size(x["s"])), 0), F.lit(0)).cast("int")
        return F.struct(ends.alias("ends"), sums(x["s"]).alias("s"), sums(x["a"]).alias("a"), F.size(x["s"]).alias("n"), F.size(x["a"]).alias("m"), each.alias("each"))

    def stop(x: Column) -> Column:
        """Lines and instructions at the end."""
        ops = lambda k: F.least(3 + k * x["each"], x["m"])
        chars = lambda sums, count: F.coalesce(F.greatest(F.lit(0), F.get(sums, count)), F.lit(0)) + F.when(count >= F.size(sums), most + 1).otherwise(0)
        size = lambda k: chars(x["s"], F.get(x["ends"], k)) + chars(x["a"], ops(k)) + sum(map(len, marks)) + 4
        stuck = F.filter(F.sequence(F.lit(0), F.size(x["ends"]) - 1), lambda k: (3 + k * x["each"] > x["m"]) | ((k > 0) & (size(k) > most)))
        k = F.when(x["n"] == 0, 0).otherwise(F.coalesce(F.array_min(stuck), F.size(x["ends"])))
        return F.struct(F.coalesce(F.get(x["ends"], k), x["n"]).alias("lines"), ops(k).alias("ops"))

    s, a = F.coalesce(src, F.array().cast("array<string>")), F.coalesce(asm, F.array().cast("array<string>"))
    part = lambda lines, count: F.array_join(F.slice(lines, F.lit(1), count), " ")
    text = lambda x, end: F.concat_ws(" ", F.lit(marks[0]), part(x["s"], end["lines"]), F.lit(marks[1]), F.lit(marks[2]), part(x["a"], end["ops"]))
    return T.let(F.struct(s.alias("s"), a.alias("a")), lambda x: T.let(T.let(measured(x), stop), lambda end: text(x, end)))


def positive_items(df: DataFrame) -> DataFrame:
    """Positive items of (src_codes, asm_codes): ten effective lines, and at least two instructions for each."""
    n = T.effective_line_count(F.col("src_codes"))
    return df.withColumn("effective", n).filter((F.col("effective") >= 10) & (F.size("asm_codes") >= 2 * F.col("effective"))).withColumn("label", F.lit(1))


def body_items(mappings: DataFrame) -> DataFrame:
    """Per function the instructions after the first mapping whose source has an opening brace (after the last if none does before it)."""
    parts = F.array_sort(F.collect_list(F.struct("mapping_no", "src_codes", "asm_codes")))
    g = mappings.groupBy("binary", "function_name").agg(parts.alias("m"))
    opens = T.first_index(F.col("m"), lambda x: F.exists(x["src_codes"], lambda s: F.contains(s, F.lit("{"))))
    start = F.least(F.coalesce(opens, F.lit(-1)) + 1, F.size("m") - 1)
    return g.select("binary", "function_name", F.flatten(F.transform(T.tail(F.col("m"), start), lambda x: x["asm_codes"])).alias("asm_codes"))


def long_context_items(df: DataFrame) -> DataFrame:
    """Items with three lines of more than one token and at most 60 instructions."""
    several = F.filter("src_codes", lambda x: F.size(F.split(T.strip(x), r"\s+")) > 1)
    return df.filter((F.size(several) >= 3) & (F.size("asm_codes") <= 60))


def usable_choices(df: DataFrame) -> DataFrame:
    """Choice items with both texts and a wrong option of another function."""
    return df.filter((F.length("text_0") > 0) & (F.length("text_1") > 0) & (F.col("wrong_type") != 1))


def similarity_band(df: DataFrame, column: str = "similarity", low: float = 80, high: float = 98) -> DataFrame:
    return df.filter((F.col(column) > low) & (F.col(column) < high))


def window_items(rows: DataFrame, id_col: str, seed: str = "0") -> DataFrame:
    """Items from windows of a function's rows (line_number, asm_codes, in order): instructions of all, and the window's lines.

    rows: id_col, items (array of struct line_number, asm_codes).
    """
    d = rows.select(id_col, "items", F.posexplode(row_windows(id_col, F.col("items"), seed)).alias("window_no", "w"))
    lines = F.transform("w", lambda x: x["line_number"])
    flat = lambda c: F.flatten(F.transform(c, lambda x: x["asm_codes"]))
    return d.select(id_col, "window_no", flat("w").alias("answer_asm_codes"), flat("items").alias("asm_codes"), F.array_min(lines).alias("first_line"), F.array_max(lines).alias("last_line"))
