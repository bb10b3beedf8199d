"""Candidate pairs of source and binary functions, and containment of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchlens.functions import text as T
from patchlens.operators.containing import matched, occurring
from patchlens.operators.scans import following

#: Rows of a side up to which a theta join broadcasts it.
BROADCAST_ROWS = 10_000


def prepared_sources(sources: DataFrame) -> DataFrame:
    """Each source function normalised once: src_name, src (lines), header (body_start, param_count)."""
    return sources.withColumn("src", T.normalize_src_lines(F.col("src_codes"))).withColumn("header", T.source_header(F.col("src")))


def prepared_binaries(binaries: DataFrame) -> DataFrame:
    """Each binary function normalised once: bin_name, asm (lines), prologue (body_start, param_count)."""
    return binaries.withColumn("asm", T.normalize_asm_lines(F.col("asm_codes"))).withColumn("prologue", T.asm_prologue(F.col("asm")))


def candidate_pairs(sources: DataFrame, binaries: DataFrame, block: list[str] = (), keep_name_matches: bool = True, whole: bool = False, closest: int | None = None) -> DataFrame:
    """Pairs that pass the three tests: not a reserved name, more instructions than lines, equal parameter counts.

    All pairs of a block are meant, but the last test is an equality: pairs
    come from a hash join on the parameter count. Pairs of equal names skip
    the tests; they come from a second join on the name. Normalisation is done
    per function, not per pair. Both bodies start after header and prologue.
    A source without lines has no pair. With `whole` also all instructions, as
    `asm`, which legacy_filter reads. With `closest` only as many tested pairs
    of a source as that, those with the fewest instructions (ties by name):
    they come from a sorted scan over both sides' lengths (`following`), so
    that pairs which the length rules out are never made.
    """
    s, b = prepared_sources(sources).filter(F.size("src") > 0), prepared_binaries(binaries).drop("asm_codes")
    on = list(block)
    same = T.strip_pointer(F.col("src_name")) == F.col("bin_name")
    s, b = s.withColumn("params", F.col("header.param_count")), b.withColumn("params", F.col("prologue.param_count"))
    named_binaries = b.filter(~T.is_reserved(F.col("bin_name")))
    if closest:
        sized = s.withColumn("n__", F.size("src"))
        tested = following(sized, named_binaries.withColumn("m__", F.size("asm")), [*on, "params"], "n__", "m__", "bin_name", closest, ["asm", "prologue"]).drop("n__", "m__", "nth")
    else:
        tested = s.join(named_binaries, [*on, "params"]).filter(F.size("asm") > F.size("src"))
    if keep_name_matches:
        tested = tested.filter(~same)
        named = s.drop("params").withColumn("bin_name", T.strip_pointer(F.col("src_name"))).join(b.drop("params"), [*on, "bin_name"])
        tested = tested.drop("params").unionByName(named)
    return tested.select(
        *on, "src_name", "bin_name", T.tail(F.col("src"), F.col("header.body_start")).alias("src_codes"), T.tail(F.col("asm"), F.col("prologue.body_start")).alias("asm_codes"),
        F.col("header.param_count").alias("src_params"), F.col("prologue.param_count").alias("asm_params"), *["asm"] * whole,
    )


def legacy_filter(pairs: DataFrame) -> DataFrame:
    """Pairs (candidate_pairs with `whole`) whose first instruction is endbr64, of equal parameter counts and 2 to 10 instructions per effective line; without such lines the ratio is 0."""
    ratio = F.coalesce(F.bround(F.try_divide(F.size("asm"), T.effective_line_count(F.col("src_codes"))), 2), F.lit(0.0))
    return pairs.filter((F.get("asm", 0) == "endbr64") & (F.col("src_params") == F.col("asm_params")) & ratio.between(2, 10))


def by_name(features: DataFrame, binaries: DataFrame) -> DataFrame:
    """Source functions and binary functions of one name (a source name's first `*` left out); of repeated names the last counts.

    features: name, ord, ...; binaries: name, ord, ...
    """
    from patchlens.operators.ordered import last_wins

    s = last_wins(features, ["name"], ["ord"]).withColumn("key", T.strip_pointer(F.col("name"))).withColumnRenamed("ord", "src_ord")
    b = last_wins(binaries, ["name"], ["ord"]).withColumnsRenamed({"name": "key", "ord": "bin_ord"})
    return s.join(b, "key")


def contained(needles: DataFrame, hays: DataFrame, needle: str, hay: str, keep: list[str] | None = None) -> DataFrame:
    """Pairs whose needle is part of the hay, with the columns `keep` of the hay (all by default) and those of the needle.

    Texts pass once through each of a few automata (`containing.occurring`);
    needles of more characters than these may hold meet their texts in joins
    (`contained_by_words`). No pair is made that isn't one of the result.
    """
    keep = hays.columns if keep is None else keep
    found = occurring(needles, needle, hays, hay, keep)
    if found is None:
        return contained_by_words(needles, hays, needle, hay).select(*keep, *needles.columns)
    return matched(needles, found, needle).select(*[found[c] for c in keep], *[needles[c] for c in needles.columns])


def contained_by_words(needles: DataFrame, hays: DataFrame, needle: str, hay: str) -> DataFrame:
    """Pairs whose needle is part of the hay: an equality join on a word, verified by the text.

    A word between two spaces of a needle is a whole word of any hay that has
    the needle. Needles with such a word meet only hays that have its longest
    one. If they are too many to broadcast, hashes of the hays stand in for
    them until the words have met, so that a text isn't shuffled once for each
    of its words. Needles without such a word meet hays on their first
    characters: see `part_of`.
    """
    words = F.split(F.col(needle), " ")
    inner = F.slice(words, F.lit(2), F.greatest(F.size(words) - 2, F.lit(0)))
    longest = F.get(F.array_sort(F.transform(inner, lambda w: F.struct((-F.char_length(w)).alias("n"), w.alias("w")))), 0)["w"]
    n = needles.withColumn("word__", F.when(F.char_length(longest) > 0, longest))
    of_hay = F.explode(F.array_distinct(F.split(hay, " "))).alias("word__")
    verified = F.contains(F.col(hay), F.col(needle))
    long = n.filter("word__ is not null")
    if long.count() <= BROADCAST_ROWS:
        found = hays.select("*", of_hay).join(F.broadcast(long), "word__").drop("word__").filter(verified)
    else:
        thin = hays.select(F.xxhash64(hay).alias("h__"), of_hay).distinct()
        found = hays.withColumn("h__", F.xxhash64(hay)).join(thin.join(long, "word__").drop("word__"), "h__").drop("h__").filter(verified)
    columns = [*hays.columns, *needles.columns]
    return found.select(*columns).unionByName(part_of(n.filter("word__ is null").drop("word__"), hays, needle, hay).select(*columns))


def part_of(needles: DataFrame, hays: DataFrame, needle: str, hay: str, gram: int = 4) -> DataFrame:
    """Pairs whose needle is anywhere in the hay: joined on the needle's first `gram` characters, which any such hay has among its own; shorter needles on all they have."""
    n = needles.select("*", F.left(F.col(needle), F.lit(gram)).alias("gram__"))
    text = F.col(hay)
    sizes = sorted(r[0] for r in n.select(F.char_length("gram__")).distinct().collect() if r[0] is not None)
    verified = F.contains(text, F.col(needle))
    at = lambda k: F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(text) - k + 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(k)))
    grams = F.flatten(F.array(*[at(k) if k else F.array(F.lit("")) for k in sizes or [gram]]))
    thin = hays.select(F.xxhash64(hay).alias("h__"), F.explode(F.array_distinct(grams)).alias("gram__")).distinct()
    met = thin.join(n, "gram__").drop("gram__")
    return hays.withColumn("h__", F.xxhash64(hay)).join(met, "h__").drop("h__").filter(verified)


def valid_cases(cases: DataFrame) -> DataFrame:
    """Test cases (functions, is_fixed, binary_name) with the functions and patches that can be found.

    A patch stays if its snippet (the fixed one iff the case is fixed), without
    signs and joined by spaces, is part of the joined source; a function needs
    a source and a patch, a case a binary and a function.
    """

    def joined(lines: Column) -> Column:
        return F.array_join(F.transform(lines, lambda x: T.strip(T.strip_sign(x))), " ")

    def patches(f: Column) -> Column:
        source = joined(f["vul_source_codes"])
        snippet = lambda p: F.when(F.col("is_fixed"), joined(p["fixed_snippet_codes"])).otherwise(joined(p["vul_snippet_codes"]))
        return F.filter(f["patches"], lambda p: F.contains(source, snippet(p)))

    fs = F.transform("functions", lambda f: F.struct(f["function_name"].alias("function_name"), f["vul_source_codes"].alias("vul_source_codes"), patches(f).alias("patches")))
    fs = F.filter(fs, lambda f: (F.size(f["vul_source_codes"]) > 0) & (F.size(f["patches"]) > 0))
    return cases.withColumn("functions", fs).filter((F.size("functions") > 0) & F.col("binary_name").isNotNull())


def listings_of_cases(cases: DataFrame, functions: DataFrame) -> DataFrame:
    """Cases with the functions of their binary; each binary's listing is parsed once, however many cases name it."""
    return cases.join(functions, "binary")


def not_listed(df: DataFrame, column: str, denied: list[str]) -> DataFrame:
    """Rows whose value isn't denied; null is not."""
    return df.filter(~F.coalesce(F.col(column).isin(*denied), F.lit(False)))


def without_keywords(paths: DataFrame, path: str, keywords: DataFrame, keyword: str, short: int = 5) -> DataFrame:
    """Paths that have no keyword: one of at most `short` characters counts only as a whole directory, others anywhere.

    The distinct paths pass through automata of the keywords, a whole directory
    with its slashes; keywords too many for these meet paths by equality joins:
    a whole directory on its name, others on their first characters. Empty
    keywords count as the empty directory (two slashes). A null path has no keyword.
    """
    k = F.col(keyword)
    brief = F.char_length(k) <= short
    found = keywords.filter(k.isNotNull()).select(F.when(brief, F.concat(F.lit("/"), k, F.lit("/"))).otherwise(k).alias("k__"), (brief & ~F.contains(k, F.lit("/"))).alias("dir__")).distinct()
    distinct = paths.select(F.col(path).alias("p__")).filter("p__ is not null").distinct()
    hit = occurring(found, "k__", distinct, "p__", ["p__"])
    if hit is not None:
        return paths.join(hit.select("p__").distinct(), F.col(path) == F.col("p__"), "left_anti")
    parts = F.split("p__", "/")
    inner = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0)))
    dirs = distinct.select("p__", F.explode(F.array_distinct(F.transform(inner, lambda x: F.concat(F.lit("/"), x, F.lit("/"))))).alias("k__"))
    hit = dirs.join(found.filter("dir__"), "k__").select("p__").unionByName(part_of(found.filter("not dir__").select("k__"), distinct, "k__", "p__").select("p__"))
    return paths.join(hit.distinct(), F.col(path) == F.col("p__"), "left_anti")


def latest_change(spans: DataFrame, lines: DataFrame) -> DataFrame:
    """Per span (file, start, end) the latest time of its lines (file, line_no, time); null if its first line has none.

    A dyadic cell is a stretch of 2^k lines that starts at a multiple of its
    length. Each line adds to one cell of each length, where the latest time
    is kept; a span is the union of at most two cells of each length, so it
    meets some 2 log2(length) rows, however many lines it has.
    """
    s = spans.select(F.col("file").alias("f__"), F.col("start").cast("long").alias("a__"), F.col("end").cast("long").alias("b__")).distinct()
    longest = s.agg(F.max(F.col("b__") - F.col("a__") + 1)).first()[0] or 0
    top = max(0, int(longest).bit_length())
    own = lines.filter("file is not null and line_no is not null").select(F.col("file").alias("f__"), F.col("line_no").cast("long").alias("n__"), "time")
    cells = own.select("f__", "time", F.explode(F.transform(F.sequence(F.lit(0), F.lit(top)), lambda k: F.struct(k.alias("level"), F.call_function("shiftright", F.col("n__"), k).alias("cell")))).alias("c__"))
    cells = cells.groupBy("f__", "c__").agg(F.max("time").alias("time__"))
    wanted = s.select("*", F.explode(_cells(F.col("a__"), F.col("b__"), top)).alias("w__")).select("f__", "a__", "b__", F.struct("w__.level", "w__.cell").alias("c__"), F.col("w__.first").alias("first__"))
    met = wanted.join(cells, ["f__", "c__"]).groupBy("f__", "a__", "b__").agg(F.bool_or("first__").alias("has__"), F.max(F.when(~F.col("first__"), F.col("time__"))).alias("time__"))
    same = (F.col("file") == F.col("f__")) & (F.col("start") == F.col("a__")) & (F.col("end") == F.col("b__"))
    return spans.join(met, same, "left").select(*spans.columns, F.when(F.col("has__"), F.col("time__")).alias("time"))


def _cells(start: Column, end: Column, top: int) -> Column:
    """The cells (level, cell, first) whose union is start..end, and its first line once more as `first`."""

    def pair(k: Column) -> Column:
        low = F.call_function("shiftright", start + F.call_function("shiftleft", F.lit(1).cast("long"), k) - 1, k)
        high = F.call_function("shiftright", end + 1, k)
        odd = lambda x: x.bitwiseAND(F.lit(1).cast("long")) == 1
        cell = lambda take, at: F.when(take, F.struct(k.alias("level"), at.alias("cell"), F.lit(False).alias("first")))
        return F.array(cell((low < high) & odd(low), low), cell((low < high) & odd(high), high - 1))

    found = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(top)), pair))
    first = F.struct(F.lit(0).alias("level"), start.alias("cell"), F.lit(True).alias("first"))
    return F.concat(F.filter(found, lambda x: x.isNotNull()), F.array(first))


def ground_truth(cases: DataFrame) -> DataFrame:
    """has_vul_function if the case names functions; has_vul if it isn't fixed besides. names: array; is_fixed."""
    named = F.coalesce(F.size("names") > 0, F.lit(False))
    return cases.withColumn("has_vul_function", named).withColumn("has_vul", named & ~F.coalesce(F.col("is_fixed"), F.lit(False)))


def large_enough(df: DataFrame, codes: str, least: int, strict: bool = False) -> DataFrame:
    """Functions of at least (or, strictly, of more than) `least` instructions or lines."""
    return df.filter(F.size(codes) > least if strict else F.size(codes) >= least)
