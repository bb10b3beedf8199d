"""Disassembly listings, as rows (binary, line_no, line), to functions and source/assembly mappings.

A listing's order is its line numbers; the running sums and last values below
are windows per binary and, once functions are numbered, per function, so the
unit of work is a function wherever its own order suffices.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

# Forms of listing lines.
SECTION = "Disassembly of section "
TEXT_SECTION = "Disassembly of section .text:"
ASM_LINE = r"^\s*[0-9a-f]+:\t([0-9a-f]{2} )+\s*(\S+)?"
LOOSE_ASM_LINE = r"^\s*[0-9a-fA-F]+:"


def text_section(lines: DataFrame) -> DataFrame:
    """The lines from the text section's header up to the next section's."""
    order = W.partitionBy("binary").orderBy("line_no").rowsBetween(W.unboundedPreceding, W.currentRow)
    section = F.last(F.when(F.col("line").startswith(SECTION), F.col("line")), ignorenulls=True).over(order)
    return lines.withColumn("section", section).filter(F.col("section") == TEXT_SECTION).drop("section")


def split_functions(lines: DataFrame, last_wins: bool = True) -> DataFrame:
    """Lines below function headers `<addr> <name>:` with function_no and name (up to its first dot).

    Of functions of the same name the last one stays, as an overwritten
    dictionary entry would; with last_wins=False the one with most lines.
    """
    header = F.contains(F.col("line"), F.lit(" <")) & F.col("line").endswith(">:")
    order = W.partitionBy("binary").orderBy("line_no").rowsBetween(W.unboundedPreceding, W.currentRow)
    token = F.get(F.split(F.trim("line"), r"\s+"), 1)
    name = F.substring_index(F.substring(token, F.lit(2), F.char_length(token) - 3), ".", 1)
    d = lines.withColumn("is_header", header).withColumn("function_no", F.sum(F.col("is_header").cast("int")).over(order))
    d = d.withColumn("function_name", F.last(F.when(F.col("is_header"), name), ignorenulls=True).over(order)).filter("function_no > 0")
    sizes = d.groupBy("binary", "function_name", "function_no").agg(F.count("*").alias("size"))
    rank = W.partitionBy("binary", "function_name").orderBy(*([F.col("function_no").desc()] if last_wins else [F.col("size").desc(), F.col("function_no").desc()]))
    kept = sizes.withColumn("r", F.row_number().over(rank)).filter("r = 1").select("binary", "function_no")
    return d.join(kept, ["binary", "function_no"], "left_semi").filter("not is_header").drop("is_header")


def code_mappings(lines: DataFrame) -> DataFrame:
    """Rows per mapping of split_functions' lines: where its source is, source lines, instructions.

    `name():` or a location line opens a mapping. Before its first instruction
    other lines are source, after it they are skipped. Mappings without either are left out.
    """
    line = F.col("line")
    callee = line.endswith("():")
    place = (F.contains(line, F.lit("__tmp/")) | line.startswith("/usr/")) & F.contains(line, F.lit(":"))
    fn = ["binary", "function_no", "function_name"]
    order = W.partitionBy(*fn).orderBy("line_no").rowsBetween(W.unboundedPreceding, W.currentRow)
    d = lines.withColumn("is_callee", callee).withColumn("is_place", place & ~callee).withColumn("opens", F.col("is_callee") | F.col("is_place"))
    d = d.withColumn("mapping_no", F.sum(F.col("opens").cast("int")).over(order))
    d = d.withColumn("src_function", F.last(F.when(F.col("is_callee"), F.trim(F.regexp_replace("line", r"\(\):$", ""))), ignorenulls=True).over(order))
    d = d.withColumn("is_asm", F.col("line").rlike(ASM_LINE) & ~F.col("opens"))
    own = W.partitionBy(*fn, "mapping_no").orderBy("line_no").rowsBetween(W.unboundedPreceding, W.currentRow)
    parts = F.split("line", "\t")
    asm = F.when(F.col("is_asm") & (F.size(parts) == 3), F.rtrim(F.element_at(parts, 3)))
    d = d.withColumn("asm", asm)
    d = d.withColumn("seen", F.max(F.col("asm").isNotNull().cast("int")).over(own))
    d = d.withColumn("src", F.when(~F.col("opens") & ~F.col("is_asm") & (F.col("seen") == 0), F.regexp_replace("line", r"\s+$", "")))
    path, number = F.substring_index("line", ":", 1), F.regexp_extract("line", r":([0-9]+)", 1).try_cast("int")
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("line_no", c)))), lambda x: x[c])
    g = d.groupBy(*fn, "mapping_no").agg(
        F.max("src_function").alias("src_function"),
        F.max(F.when(F.col("is_place"), path)).alias("src_path"),
        F.max(F.when(F.col("is_place"), number)).alias("src_line"),
        F.coalesce(F.bool_or(F.when(F.col("is_place"), F.contains(F.col("line"), F.lit("(discriminator")))), F.lit(False)).alias("is_discriminator"),
        ordered("src").alias("src_codes"),
        ordered("asm").alias("asm_codes"),
    )
    return g.filter((F.size("src_codes") > 0) | (F.size("asm_codes") > 0))


def functions(mappings: DataFrame, least: int = 10) -> DataFrame:
    """One row per function of at least `least` instructions: all of them in order, and its declared parameters.

    The count of parameters is that of commas, plus one, in the first mapping line with a parenthesis.
    """
    parts = F.array_sort(F.collect_list(F.struct("mapping_no", "src_line", "src_codes", "asm_codes")))
    g = mappings.groupBy("binary", "function_no", "function_name").agg(parts.alias("m"))
    g = g.withColumn("asm_codes", F.flatten(F.transform("m", lambda x: x["asm_codes"]))).filter(F.size("asm_codes") >= least)
    declared = F.get(F.filter(F.flatten(F.transform("m", lambda x: x["src_codes"])), lambda s: F.contains(s, F.lit("("))), 0)
    return g.select("binary", "function_name", "asm_codes", F.get(F.transform("m", lambda x: x["src_line"]), 0).alias("first_line"), F.coalesce(F.regexp_count(declared, F.lit(",")) + 1, F.lit(0)).alias("declared_params"))


def flat_functions(lines: DataFrame) -> DataFrame:
    """Per function of the text section, the last tab field of each line, blank ones included."""
    d = split_functions(text_section(lines)).withColumn("asm", F.element_at(F.split("line", "\t"), -1))
    codes = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "asm"))), lambda x: x["asm"])
    return d.groupBy("binary", "function_name").agg(codes.alias("asm_codes"))


def source_lines(snippets: DataFrame) -> DataFrame:
    """The source-line dictionary of mappings: (binary, function_name, line_number, text).

    A snippet's last line has its line number, earlier ones count back from it,
    but for the first snippet; of texts for one line the latest stays.
    """
    w = W.partitionBy("binary", "function_name").orderBy("mapping_no")
    d = snippets.filter("src_line is not null and size(src_codes) > 0").withColumn("nth", F.row_number().over(w))
    d = d.select("binary", "function_name", "mapping_no", "nth", "src_line", F.size("src_codes").alias("n"), F.posexplode("src_codes").alias("k", "text"))
    d = d.withColumn("line_number", F.col("src_line") - (F.col("n") - 1 - F.col("k"))).filter("nth > 1 or k = n - 1")
    latest = W.partitionBy("binary", "function_name", "line_number").orderBy(F.col("mapping_no").desc(), F.col("k").desc())
    return d.withColumn("r", F.row_number().over(latest)).filter("r = 1").select("binary", "function_name", "line_number", "text")


def line_to_asm(mappings: DataFrame) -> DataFrame:
    """One row per mapping whose source line is known: its line, text and instructions."""
    m = mappings.select("binary", "function_name", "mapping_no", F.col("src_line").alias("line_number"), "is_discriminator", "asm_codes")
    return m.join(source_lines(mappings), ["binary", "function_name", "line_number"])


def any_text_section(lines: DataFrame) -> DataFrame:
    """Lines of the section `.text`, or else of the first one whose name starts with it, without its header and the blank line after."""
    name = F.regexp_extract("line", r"^Disassembly of section (.*):$", 1)
    order = W.partitionBy("binary").orderBy("line_no").rowsBetween(W.unboundedPreceding, W.currentRow)
    d = lines.withColumn("section", F.last(F.when(F.col("line").startswith(SECTION), name), ignorenulls=True).over(order)).filter(F.col("section").startswith(".text"))
    rank = F.struct((F.col("section") != ".text").alias("other"), F.col("line_no").alias("at"), F.col("section").alias("section"))
    d = d.withColumn("first", F.min(rank).over(W.partitionBy("binary"))).filter(F.col("section") == F.col("first.section"))
    d = d.withColumn("k", F.row_number().over(W.partitionBy("binary").orderBy("line_no")))
    return d.filter("k > 2").select("binary", "line_no", "line")


def snippets(lines: DataFrame, home: str = "/home") -> DataFrame:
    """Per function, snippets opened by a line below `home` or /usr/; those without instructions are left out.

    lines: split_functions' rows. Before the first instruction lines are source.
    """
    opens = F.col("line").startswith(home) | F.col("line").startswith("/usr/")
    order = W.partitionBy("binary", "function_no").orderBy("line_no").rowsBetween(W.unboundedPreceding, W.currentRow)
    d = lines.withColumn("opens", opens).withColumn("snippet_no", F.sum(F.col("opens").cast("int")).over(order))
    d = d.withColumn("is_asm", F.col("line").rlike(LOOSE_ASM_LINE))
    own = W.partitionBy("binary", "function_no", "snippet_no").orderBy("line_no").rowsBetween(W.unboundedPreceding, W.currentRow)
    d = d.withColumn("seen", F.max(F.col("is_asm").cast("int")).over(own))
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("line_no", "line")))), lambda x: x["line"])
    g = d.groupBy("binary", "function_no", "function_name", "snippet_no").agg(
        F.max(F.when(F.col("opens"), F.col("line"))).alias("line_position"), ordered((F.col("seen") == 0) & ~F.col("opens")).alias("src_lines"), ordered(F.col("is_asm")).alias("asm_lines")
    )
    return g.filter(F.size("asm_lines") > 0)
