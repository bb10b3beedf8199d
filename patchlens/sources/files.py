"""Sources and sinks. Schemas are given, not inferred: a read is one pass and prunes columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Extensions of C and C++ sources (each also in capitals), and of files that patches touch.
SOURCE_SUFFIXES = (".c", ".h", ".cc", ".hh", ".cp", ".hp", ".cpp", ".hpp", ".cxx", ".hxx", ".c++", ".h++")
PATCH_SUFFIXES = (".c", ".cpp", ".h", ".hpp", ".cc")
LIBRARY_CSV = "public_id string, library_id bigint, library_name string, vendor string, platform string, version_id bigint, version_number string"
DETAIL_JSON = "public_id string, url string, raw string, hunk_code string, affected_file string, affected_function string"


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Whole-file JSON: arrays give a row per element."""
    return spark.read.schema(schema).json(path, multiLine=True)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_json_folder(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All JSON files below a folder; a file that doesn't parse gives no rows."""
    d = spark.read.schema(f"{schema}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").option("mode", "PERMISSIVE").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(path, multiLine=True)
    return d.filter(F.col("_corrupt").isNull()).drop("_corrupt")


def merged_by_file(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, content) of the JSON files below a folder; of files of one name that of the last path."""
    from patchlens.operators.ordered import last_wins

    d = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.json")
    d = d.select(F.col("_metadata.file_name").alias("file_name"), F.col("_metadata.file_path").alias("file_path"), F.col("value").alias("content"))
    return last_wins(d, ["file_name"], ["file_path"]).drop("file_path")


def read_libraries(spark: SparkSession, path: str) -> DataFrame:
    """Library and version records, by library, version (as text) and vulnerability."""
    return spark.read.option("header", True).schema(LIBRARY_CSV).csv(path).orderBy("library_name", "version_number", "public_id")


def read_listing(spark: SparkSession, path: str) -> DataFrame:
    """Rows (binary, line_no, line) of listings, a file each."""
    d = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("binary"), "value")
    return d.select("binary", F.posexplode(F.split("value", "\n")).alias("line_no", "line"))


def find_files(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """Path and size of the files below a folder with a suffix; their contents aren't read."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").load(path)
    return d.select("path", F.col("length").alias("size"))


def find_sources(spark: SparkSession, path: str, suffixes: tuple[str, ...] = SOURCE_SUFFIXES) -> DataFrame:
    """Non-empty C and C++ files below a folder, the largest first."""
    return find_files(spark, path, "").filter(has_suffix(F.col("path"), suffixes) & (F.col("size") > 0)).orderBy(F.col("size").desc(), "path")


def find_binaries(spark: SparkSession, path: str, least: int = 100) -> DataFrame:
    """Files over `least` bytes whose content starts like an executable."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).filter(F.col("length") > least)
    return d.filter(F.hex(F.substring("content", 1, 4)) == "7F454C46").select("path", F.col("length").alias("size"))


def has_suffix(path: Column, suffixes: tuple[str, ...]) -> Column:
    """Whether the extension is one of these, in small letters or in capitals."""
    return F.regexp_extract(path, r"(\.[^./]+)$", 1).isin(*suffixes, *[x.upper() for x in suffixes])


def patch_details(details: DataFrame) -> DataFrame:
    """Details of C-family files with a raw patch and a hunk, as one list per vulnerability, without repeats."""
    kept = details.filter(has_suffix(F.col("affected_file"), PATCH_SUFFIXES) & (F.length("raw") > 0) & (F.length("hunk_code") > 0))
    return kept.dropDuplicates().groupBy("public_id").agg(F.array_sort(F.collect_list(F.struct("url", "raw", "hunk_code", "affected_file", "affected_function"))).alias("details"))


def moved(path: Column, old_root: str, new_root: str, suffix: str) -> Column:
    """A path below another root, with another extension."""
    return F.regexp_replace(F.replace(path, F.lit(old_root), F.lit(new_root)), r"\.[^./]+$", suffix)


def write_scores(cases: DataFrame, path: str) -> None:
    """One text line per case: has_vul_function, has_vul, then diff_num, vul_score, fix_score of each located snippet."""
    score_lines(cases).write.mode("overwrite").text(path)


def score_lines(cases: DataFrame) -> DataFrame:
    triples = F.transform("snippets", lambda s: F.concat_ws(",", s["diff_num"].cast("string"), s["vul_score"].cast("string"), s["fix_score"].cast("string")))
    return cases.select(F.concat_ws(",", F.col("has_vul_function").cast("string"), F.col("has_vul").cast("string"), triples).alias("value"))


def read_scores(lines: DataFrame) -> DataFrame:
    """Typed rows of score lines; lines without exactly five fields are left out."""
    p = F.split("value", ",")
    d = lines.select(p.alias("p")).filter(F.size("p") == 5)
    field = lambda k, t: F.trim(F.get("p", k)).try_cast(t)
    return d.select(field(0, "boolean").alias("has_vul_function"), field(1, "boolean").alias("has_vul"), field(2, "int").alias("diff_num"), field(3, "double").alias("vul_score"), field(4, "double").alias("fix_score"))


def html_span_text(html: Column, css_class: str) -> Column:
    """Texts of all span elements of one class."""
    return F.regexp_extract_all(html, F.lit(f'<span class="{css_class}">([^<]*)</span>'), F.lit(1))


def write_features(df: DataFrame, path: str, file_col: str = "file") -> None:
    """Features by file, without names that hold `.json` or `i64`; a file's rows are in a folder of their own."""
    df.filter(~F.col(file_col).rlike(r"\.json|i64")).write.mode("overwrite").partitionBy(file_col).json(path)


def compile_matrix(files: DataFrame, compilers=("gcc", "clang"), levels=("O0", "O1", "O2", "O3")) -> DataFrame:
    """Each file with every compiler and level: eight rows a file, made in its own row."""
    return files.withColumn("compiler", F.explode(F.array(*map(F.lit, compilers)))).withColumn("level", F.explode(F.array(*map(F.lit, levels))))
