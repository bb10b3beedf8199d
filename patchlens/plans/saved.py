"""Named queries that write the given tables to the shared folder with the library's sinks and read them again with its sources, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchlens.operators import evaluation, ordered
from patchlens.plans import catalog as C
from patchlens.sources import files
from patchlens.sources.shared import fresh_path

query, table = C.query, C.table


def _put(spark: SparkSession, path: str, content: bytes) -> None:
    """One small file, in whatever file system the path is of."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).create(at)
    out.write(bytearray(content))
    out.close()


_VENDOR = "struct<vendor_id: bigint, name: string, balance: double>"
_VENDORS = "SELECT nation_id, vendor_id, name, balance FROM vendors WHERE nation_id IS NOT NULL"


def _vendor_lists(spark, d) -> DataFrame:
    """Vendors by nation, at most a thousand to a list."""
    v = table(spark, d, "vendors").filter("nation_id is not null").select("nation_id", F.struct("vendor_id", "name", "balance").alias("vendor"))
    return ordered.group_lists(v, ["nation_id"], "vendor").select("nation_id", "part", F.col("items").alias("vendors"))


@query(_VENDORS)
def json_arrays_read(spark, d):
    """A file with one array for each list."""
    at = fresh_path(spark, "arrays")
    _vendor_lists(spark, d).select("nation_id", "part", F.to_json("vendors").alias("value")).write.partitionBy("nation_id", "part").text(at)
    return files.read_json(spark, at, "vendor_id bigint, name string, balance double, nation_id int").select("nation_id", "vendor_id", "name", "balance")


@query("SELECT client_id, master_id, source, name, city, balance FROM clients")
def json_rows_saved(spark, d):
    at = fresh_path(spark, "rows")
    files.write_json(table(spark, d, "clients").select("client_id", "master_id", "source", "name", "city", "balance"), at)
    return spark.read.schema("client_id bigint, master_id bigint, source string, name string, city string, balance double").json(at)


@query(_VENDORS)
def json_folder_scan(spark, d):
    """A file with one object for each list, and two broken files among them."""
    at = fresh_path(spark, "folder")
    _vendor_lists(spark, d).withColumn("nation", F.col("nation_id")).write.partitionBy("nation_id", "part").json(at)
    _put(spark, f"{at}/nation_id=0/part=77/broken.json", b'{"vendors": [{"vendor_id": 1, ')
    _put(spark, f"{at}/nation_id=1/part=77/words.json", b"no json at all")
    return files.read_json_folder(spark, at, f"nation int, vendors array<{_VENDOR}>").select(F.col("nation").alias("nation_id"), F.inline("vendors"))


_BY_NATION = "SELECT n_nationkey, n_regionkey, n_name, count(client_id) AS clients FROM nation LEFT JOIN clients ON nation_id = n_nationkey GROUP BY ALL"


def _by_nation(spark, d):
    """(key, region, name, clients), a row a nation."""
    j = table(spark, d, "nation").join(table(spark, d, "clients"), F.col("nation_id") == F.col("n_nationkey"), "left")
    return [tuple(r) for r in j.groupBy("n_nationkey", "n_regionkey", "n_name").agg(F.count("client_id")).collect()]


@query(f"SELECT n_name || '.json' AS file_name, CASE WHEN n_regionkey = 2 THEN -1 ELSE clients END AS clients FROM ({_BY_NATION})")
def json_files_merged(spark, d):
    """A file a nation; those of one region stand in a second folder as well, which comes later."""
    at = fresh_path(spark, "merged")
    for _, region, name, n in _by_nation(spark, d):
        _put(spark, f"{at}/a/{name}.json", b'{"clients": %d}' % n)
        if region == 2:
            _put(spark, f"{at}/b/{name}.json", b'{"clients": -1}')
    return files.merged_by_file(spark, at).select("file_name", F.get_json_object("content", "$.clients").cast("long").alias("clients"))


@query("SELECT coalesce(source, '__HIVE_DEFAULT_PARTITION__') AS source FROM clients GROUP BY 1")
def files_by_suffix(spark, d):
    at = fresh_path(spark, "found")
    table(spark, d, "clients").select("client_id", "source").write.partitionBy("source").json(at)
    _put(spark, f"{at}/source=other/notes.txt", b"no such file is meant")
    found = files.find_files(spark, at, ".json").filter("size > 0")
    return found.select(F.regexp_extract("path", "source=([^/]*)/", 1).alias("source")).distinct()


_KINDS = [".c", ".H", ".txt", ".cpp", ".py"]


@query(f"SELECT n_name || k AS file, clients AS size FROM (SELECT *, {_KINDS}[n_nationkey % 5 + 1] AS k FROM ({_BY_NATION})) WHERE clients > 0 AND k IN ('.c', '.H', '.cpp')")
def source_files_found(spark, d):
    """A file a nation with a byte a client; the suffix tells sources from others."""
    at = fresh_path(spark, "sources")
    for key, region, name, n in _by_nation(spark, d):
        _put(spark, f"{at}/{region}/{name}{_KINDS[key % 5]}", b"x" * n)
    return files.find_sources(spark, at).select(F.replace(F.element_at(F.split("path", "/"), -1), F.lit("%20"), F.lit(" ")).alias("file"), "size")


@query(f"SELECT n_name AS file, clients + 4 AS size FROM ({_BY_NATION}) WHERE n_nationkey % 2 = 0 AND clients + 4 > 30")
def executables_found(spark, d):
    at = fresh_path(spark, "executables")
    for key, region, name, n in _by_nation(spark, d):
        _put(spark, f"{at}/{region}/{name}", (b"\x7fELF" if key % 2 == 0 else b"#!sh") + b"\0" * n)
    return files.find_binaries(spark, at, 30).select(F.replace(F.element_at(F.split("path", "/"), -1), F.lit("%20"), F.lit(" ")).alias("file"), "size")


@query("SELECT item_id, unnest(string_split(text || chr(10), chr(10))) AS line, generate_subscripts(string_split(text || chr(10), chr(10)), 1) - 1 AS line_no FROM benchmark")
def listing_files_read(spark, d):
    at = fresh_path(spark, "listings")
    table(spark, d, "benchmark").select("item_id", F.col("text").alias("value")).write.partitionBy("item_id").text(at)
    return files.read_listing(spark, at).select(F.regexp_extract("binary", "item_id=([0-9]+)/", 1).cast("long").alias("item_id"), "line", F.col("line_no").cast("long").alias("line_no"))


_SALE_SCORES = "SELECT status = 'done' AS has_vul_function, priority > 2 AS has_vul, priority AS diff_num, total AS vul_score, total / 2 AS fix_score FROM sales WHERE status IS NOT NULL AND priority IS NOT NULL AND total IS NOT NULL"


def _sale_scores(spark, d) -> DataFrame:
    """Sales as cases of one located snippet each, as score lines; a case that lacks a value gives a line that isn't read."""
    at = fresh_path(spark, "scores")
    one = F.array(F.struct(F.col("priority").alias("diff_num"), F.col("total").alias("vul_score"), (F.col("total") / 2).alias("fix_score")))
    s = table(spark, d, "sales").select((F.col("status") == "done").alias("has_vul_function"), (F.col("priority") > 2).alias("has_vul"), one.alias("snippets"))
    files.write_scores(s, at)
    return files.read_scores(spark.read.text(at))


@query(_SALE_SCORES)
def score_lines_saved(spark, d):
    return _sale_scores(spark, d)


@query(f"""SELECT r AS "right", n - r AS wrong, r::double / n AS rate FROM (SELECT count(*) FILTER ((vul_score > round_even(fix_score, 4)) = has_vul) AS r, count(*) AS n FROM ({_SALE_SCORES}))""")
def saved_scores_rejudged(spark, d):
    return evaluation.rescored(_sale_scores(spark, d))


@query("SELECT source || '.c' AS file, doc_id, n_chars FROM documents WHERE source IS NOT NULL AND doc_id % 7 <> 0")
def features_saved(spark, d):
    """A seventh of the documents is said to be of files that aren't kept."""
    at = fresh_path(spark, "features")
    f = table(spark, d, "documents").select(F.concat("source", F.when(F.col("doc_id") % 7 == 0, ".json").otherwise(".c")).alias("file"), "doc_id", "n_chars")
    files.write_features(f, at)
    return spark.read.schema("doc_id bigint, n_chars bigint, file string").json(at).select("file", "doc_id", "n_chars")
