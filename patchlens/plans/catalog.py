"""Named queries over the driver's tables, each an operator of the library applied to them, with its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchlens.functions import text as T
from patchlens.operators import candidates, diffs, evaluation, listing, ordered, sampling, scoring, source_features, stats
from patchlens.plans import fixtures
from patchlens.sources import files
from patchlens.streaming import events as stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def over(spark: SparkSession, sf_dir: str, sql: str, *names: str) -> DataFrame:
    """SQL text over the named tables."""
    return spark.sql(sql, **{n: table(spark, sf_dir, n) for n in names})


def joined(column, sep: str = "|"):
    return F.array_join(column, sep)


# ---- relational ----

_BAG = """SELECT l_orderkey, l_linenumber, n_name, p_brand, s_name, c_mktsegment FROM {region} JOIN {nation} ON n_regionkey = r_regionkey
JOIN {customer} ON c_nationkey = n_nationkey JOIN {orders} ON o_custkey = c_custkey AND o_orderstatus = 'F' JOIN {lineitem} ON l_orderkey = o_orderkey
JOIN {part} ON p_partkey = l_partkey AND p_brand LIKE '%2%' JOIN {supplier} ON s_suppkey = l_suppkey WHERE r_regionkey = 1"""
_DISTINCT = "SELECT DISTINCT r_name, n_name, c_mktsegment, o_orderpriority FROM {region} JOIN {nation} ON n_regionkey = r_regionkey JOIN {customer} ON c_nationkey = n_nationkey JOIN {orders} ON o_custkey = c_custkey WHERE n_nationkey IN (3, 5, 3, 8, 5)"
_FANOUT = "SELECT DISTINCT n_name, s_suppkey, c_mktsegment FROM {nation} JOIN {supplier} ON s_nationkey = n_nationkey JOIN {customer} ON c_nationkey = n_nationkey"
_SEMI = "SELECT o.o_orderkey, o.o_custkey FROM {orders} o WHERE o.o_custkey IN (SELECT DISTINCT o.c_custkey FROM {customer} o WHERE o.c_nationkey = 3)"
_ORDINAL = "SELECT s_suppkey, s_name, n_name FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey AND n_regionkey = 2 ORDER BY 1"
_LIKE = "SELECT p_partkey, count(*) AS n_lines FROM {part} JOIN {lineitem} ON l_partkey = p_partkey AND p_type LIKE '%A%' GROUP BY p_partkey"


def _plain(sql: str) -> str:
    return sql.replace("{", "").replace("}", "")


@query(_plain(_BAG))
def join_inner_chain_bag(spark, d):
    return over(spark, d, _BAG, "region", "nation", "customer", "orders", "lineitem", "part", "supplier")


@query(_plain(_DISTINCT))
def join_distinct_chain(spark, d):
    return over(spark, d, _DISTINCT, "region", "nation", "customer", "orders")


@query(_plain(_FANOUT))
def join_fanout_distinct(spark, d):
    """A nation's segments are few: they become distinct before they meet its suppliers, so no pair is made twice."""
    once = _FANOUT.replace("{customer}", "(SELECT DISTINCT c_nationkey, c_mktsegment FROM {customer})")
    return over(spark, d, once, "nation", "supplier", "customer")


@query(_plain(_SEMI))
def semi_in_subquery(spark, d):
    return over(spark, d, _SEMI, "orders", "customer")


@query(_plain(_ORDINAL))
def join_order_by_ordinal(spark, d):
    return over(spark, d, _ORDINAL, "supplier", "nation")


@query(_plain(_LIKE))
def filter_like_in_on(spark, d):
    return over(spark, d, _LIKE, "part", "lineitem")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IS NULL OR c_mktsegment NOT IN ('BUILDING', 'MACHINERY')")
def anti_denylist(spark, d):
    return candidates.not_listed(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", ["BUILDING", "MACHINERY"])


_KEYWORDS = [("en",), ("fr",), ("utm_source",), ("m.",)]


@query(f"SELECT page_id, url FROM pages WHERE NOT EXISTS (SELECT 1 FROM {fixtures.values(_KEYWORDS, 'k')} WHERE CASE WHEN length(k) <= 5 THEN contains(url, '/' || k || '/') ELSE contains(url, k) END)")
def keyword_path_exclude(spark, d):
    return candidates.without_keywords(table(spark, d, "pages").select("page_id", "url"), "url", spark.createDataFrame(_KEYWORDS, "k string"), "k")


@query("SELECT c_custkey AS customer_id, c_name AS customer_name, c_nationkey AS nation_id, c_acctbal AS balance FROM customer WHERE c_acctbal > 0")
def rename_nest_struct(spark, d):
    c = table(spark, d, "customer").filter("c_acctbal > 0")
    n = c.select(F.col("c_custkey").alias("customer_id"), F.struct(F.col("c_name").alias("customer_name"), F.col("c_nationkey").alias("nation_id")).alias("who"), F.struct(F.col("c_acctbal").alias("balance")).alias("account"))
    return n.select("customer_id", "who.customer_name", "who.nation_id", "account.balance")


# ---- grouping, sets ----


@query("""SELECT source, part, n, string_agg(doc_id::varchar, ',' ORDER BY doc_id) AS ids FROM (SELECT source, doc_id, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 1000 AS part, count(*) OVER (PARTITION BY source) AS n FROM documents) GROUP BY source, part, n""")
def group_collect_sorted(spark, d):
    g = ordered.group_lists(table(spark, d, "documents"), ["source"], "doc_id")
    return g.select("source", "part", "n", F.array_join(F.transform("items", lambda x: x.cast("string")), ",").alias("ids"))


@query("SELECT DISTINCT text, lang FROM documents")
def dedup_rows(spark, d):
    return table(spark, d, "documents").select("text", "lang").dropDuplicates()


@query("SELECT text, min(doc_id) AS doc_id, arg_min(source, doc_id) AS source FROM documents GROUP BY text")
def dedup_key_first(spark, d):
    return table(spark, d, "documents").groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.min_by("source", "doc_id").alias("source"))


@query("SELECT event_type, count(*) FILTER (value > 50) AS n_high, count(*) FILTER (NOT value > 50) AS n_low FROM events GROUP BY event_type")
def count_if_split(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count_if(F.col("value") > 50).alias("n_high"), F.count_if(~(F.col("value") > 50)).alias("n_low"))


@query("SELECT count(DISTINCT user_id) AS users FROM events")
def count_distinct(spark, d):
    return table(spark, d, "events").agg(F.count_distinct("user_id").alias("users"))


_DOC_WORDS = r"string_split(regexp_replace(text, '[\n ]+', ' ', 'g'), ' ')"
_FILE_STATS = f"""SELECT doc_id, lang, len(w) AS n_strings, len(list_distinct(w)) AS n_unique, len(list_distinct(c)) AS n_node_unique,
  len(list_filter(list_distinct(w), lambda x: NOT list_contains(c, x) AND x <> 'C')) AS n_missing FROM (SELECT doc_id, lang, w, list_filter(w, lambda x: regexp_matches(x, '[A-Z0-9]')) AS c FROM (SELECT doc_id, lang, {_DOC_WORDS} AS w FROM documents))"""


def _file_stats(spark, d):
    """A text's words are its strings; those with a capital or a digit, wherever they stand, are the strings in nodes."""
    w = F.split(F.regexp_replace("text", "[\\n ]+", " "), " ")
    docs = table(spark, d, "documents").select("doc_id", "lang", w.alias("w"))
    return stats.file_stats(docs.withColumn("c", F.filter("w", lambda x: x.rlike("[A-Z0-9]"))), ["doc_id", "lang"], "w", "c")


@query(f"SELECT *, CASE WHEN n_unique = 0 THEN 100.0::double ELSE 100.0::double * (n_unique - n_missing) / n_unique END AS percent FROM ({_FILE_STATS})")
def stats_rollup_file(spark, d):
    return _file_stats(spark, d)


@query(f"SELECT *, (n_unique - n_missing)::double / n_unique AS share FROM (SELECT lang, sum(n_strings)::bigint AS n_strings, sum(n_unique)::bigint AS n_unique, sum(n_node_unique)::bigint AS n_node_unique, sum(n_missing)::bigint AS n_missing, count(*) AS n_files FROM ({_FILE_STATS}) GROUP BY lang)")
def stats_rollup_project(spark, d):
    return stats.project_stats(_file_stats(spark, d), ["lang"])


_HASH = r"md5(lower(translate(text, chr(10) || chr(13) || chr(9) || '{} ', '')))"


@query(f"SELECT {_HASH} AS content_hash, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def hash_dedup_groups(spark, d):
    g = table(spark, d, "documents").groupBy(T.content_hash(F.col("text")).alias("content_hash")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))
    return g.filter("n > 1")


@query("SELECT doc_id, sha256(text) AS digest FROM documents")
def content_sha256(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))


@query("SELECT quality AS value, count(*) AS n FROM labels GROUP BY quality")
def label_histogram(spark, d):
    return table(spark, d, "labels").groupBy(F.col("quality").alias("value")).agg(F.count("*").alias("n"))


@query("SELECT doc_id AS id, text, 'document' AS kind FROM documents UNION ALL SELECT item_id, text, 'benchmark' FROM benchmark")
def union_all_labeled(spark, d):
    a = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", F.lit("document").alias("kind"))
    return a.unionByName(table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text", F.lit("benchmark").alias("kind")))


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def set_difference(spark, d):
    return table(spark, d, "documents").select("doc_id").subtract(table(spark, d, "labels").select("doc_id"))


@query("SELECT o_orderkey, o_orderpriority, o_orderdate FROM orders WHERE o_totalprice > 100000 ORDER BY o_orderpriority, o_orderdate, o_orderkey")
def sort_three_keys(spark, d):
    return table(spark, d, "orders").filter("o_totalprice > 100000").select("o_orderkey", "o_orderpriority", "o_orderdate").orderBy("o_orderpriority", "o_orderdate", "o_orderkey")


@query("SELECT doc_id, n_chars FROM documents WHERE n_chars <= 10485760 ORDER BY n_chars DESC, doc_id")
def size_guard_sorted(spark, d):
    return stats.guarded_files(table(spark, d, "documents").select("doc_id", "n_chars"), "n_chars", total=1 << 60).orderBy(F.col("n_chars").desc(), "doc_id")


# ---- URLs, HTML, paths ----


@query(r"SELECT page_id, string_split(url, '/')[4] AS owner, string_split(url, '/')[5] AS repo, starts_with(string_split(url, '://')[2], 'www.') AS on_www FROM pages")
def url_parts(spark, d):
    p = table(spark, d, "pages")
    return p.select("page_id", T.owner_and_repo(F.col("url")).alias("o"), F.get(F.split("url", "://"), 1).startswith("www.").alias("on_www")).select("page_id", "o.owner", "o.repo", "on_www")


@query(r"SELECT page_id, nullif(regexp_extract(url, '[?&;]page=([^&;#]*)', 1), '') AS page, nullif(regexp_extract(url, '[?&;]ref=([^&;#]*)', 1), '') AS ref FROM pages")
def url_query_params(spark, d):
    return table(spark, d, "pages").select("page_id", T.url_query(F.col("url"), "page").alias("page"), T.url_query(F.col("url"), "ref").alias("ref"))


@query("""SELECT page_id, array_to_string(regexp_extract_all(replace(replace(html, '<li>', '<span class="x">'), '</li>', '</span>'), '<span class="x">([^<]*)</span>', 1), '|') AS spans FROM pages""")
def html_span_text(spark, d):
    marked = F.replace(F.replace(F.col("html"), F.lit("<li>"), F.lit('<span class="x">')), F.lit("</li>"), F.lit("</span>"))
    return table(spark, d, "pages").select("page_id", joined(files.html_span_text(marked, "x")).alias("spans"))


@query(r"SELECT page_id, regexp_replace(replace(url, 'example.com', 'example.org'), '\.[^./]+$', '.txt') AS moved FROM pages")
def path_derivation(spark, d):
    return table(spark, d, "pages").select("page_id", files.moved(F.col("url"), "example.com", "example.org", ".txt").alias("moved"))


# ---- text ----

_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
#: The library's own fixed values, without the possessive repeats that DuckDB's patterns lack.
_NOT_COMMENT = T.NOT_COMMENT.replace("*+", "*").replace("++", "+").replace("'", "''")


def _uncommented(x: str) -> str:
    return f"array_to_string(regexp_extract_all({x}, '{_NOT_COMMENT}', 1), '')"


def _src_lines(lines: str) -> str:
    kept = f"""list_filter(list_transform({lines}, lambda x: {_STRIP.format("x")}), lambda x: NOT (starts_with(x, '/*') OR starts_with(x, '* ') OR starts_with(x, '//') OR ends_with(x, '*/') OR x IN ('', '*')))"""
    inner = r"""regexp_replace(regexp_replace(regexp_replace(x, '".*?"', '"STR"', 'g'), '\t+', ' ', 'g'), ' +', ' ', 'g')"""
    return f"list_transform({kept}, lambda x: {_uncommented(inner)})"


_SOURCE_VALUES = f"(SELECT row_id * 1000 + id AS id, row_id, id AS form, replace(source, 'y', own) AS source FROM {fixtures.filled_sql(fixtures.SOURCES, 'id, source')})"


def _sources(spark, d):
    s = fixtures.filled(spark, d, fixtures.SOURCES, "id int, source string").withColumn("source", F.replace("source", F.lit("y"), F.col("own")))
    return s.select((F.col("row_id") * 1000 + F.col("id")).alias("id"), "row_id", F.col("id").alias("form"), "source", F.split("source", "\n").alias("lines"))


@query(f"SELECT doc_id, array_to_string({_src_lines('string_split(text, chr(10))')}, chr(10)) AS lines FROM documents")
def text_normalize_lines(spark, d):
    return table(spark, d, "documents").select("doc_id", joined(T.normalize_src_lines(F.split("text", "\n")), "\n").alias("lines"))


@query(f"SELECT id, {_uncommented('source')} AS bare FROM {_SOURCE_VALUES} UNION ALL SELECT -page_id, {_uncommented('html')} FROM pages")
def comment_strip(spark, d):
    a = _sources(spark, d).select(F.col("id").cast("long").alias("id"), T.remove_comments(F.col("source")).alias("bare"))
    return a.unionByName(table(spark, d, "pages").select((-F.col("page_id")).alias("id"), T.remove_comments(F.col("html")).alias("bare")))


@query(f"SELECT id, array_to_string({_src_lines('string_split(source, chr(10))')}, '|') AS lines FROM {_SOURCE_VALUES}")
def source_normalize(spark, d):
    return _sources(spark, d).select("id", joined(T.normalize_src_lines(F.col("lines"))).alias("lines"))


@query(r"""SELECT conv_id, turn, array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split(text, ' '), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: length(x) >= 4))), '|') AS strings FROM conversations""")
def string_set_normalize(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", joined(T.normalize_strings(F.split("text", " "))).alias("strings"))


_BRACE = "coalesce(list_position(list_transform(l, lambda x: contains(x, '{')), true), 1)"


def _effective(l: str) -> str:
    start = f"coalesce(list_position(list_transform({l}, lambda x: contains(x, '{{')), true), 1)"
    return rf"list_filter(({l})[{start}:], lambda x: len(string_split_regex({_STRIP.format('x')}, '\s+')) > 1 OR length({_STRIP.format('x')}) > 10)"


@query(f"SELECT doc_id, len({_effective('l')}) AS n_effective FROM (SELECT doc_id, {_src_lines('string_split(text, chr(10))')} AS l FROM documents)")
def effective_line_count(spark, d):
    return table(spark, d, "documents").select("doc_id", T.effective_line_count(F.split("text", "\n")).alias("n_effective"))


_HEADER = rf"""{_BRACE} AS body_start, least(6, CASE WHEN array_to_string(l[1:{_BRACE}], ' ').string_split('(')[-1].string_split(')')[1] IN ('void', '') THEN 0 WHEN ends_with(array_to_string(l[1:{_BRACE}], ' ').string_split('(')[-1].string_split(')')[1], '...') THEN 6
  ELSE len(string_split(array_to_string(l[1:{_BRACE}], ' ').string_split('(')[-1].string_split(')')[1], ',')) END)::int AS param_count"""


@query(f"SELECT id, {_HEADER} FROM (SELECT id, {_src_lines('string_split(source, chr(10))')} AS l FROM {_SOURCE_VALUES})")
def header_params(spark, d):
    s = _sources(spark, d).withColumn("h", T.source_header(T.normalize_src_lines(F.col("lines"))))
    return s.select("id", "h.body_start", "h.param_count")


def _asm_sql(x: str) -> str:
    code = f"CASE WHEN NOT contains({x}, chr(9)) THEN {x} WHEN len(string_split({x}, chr(9))) = 3 THEN string_split({x}, chr(9))[3] END"
    c = f"string_split(regexp_replace(lower({code}), ';.*', '', 'g'), '#')[1]"
    c = rf"regexp_replace(regexp_replace({c}, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')"
    c = f"regexp_replace(regexp_replace({c}, '{T.SIZE_MARKER}', '', 'g'), '{T.MEMORY}', '<MEM>', 'g')"
    c = rf"regexp_replace({c}, '{T.JUMP}', '\1 <LOC>', 'g')"
    c = rf"replace(regexp_replace({c}, '{T.CALL}', 'call <\1>', 'g'), ' short ', ' ')"
    return rf"replace(replace(regexp_replace({c}, '{T.LABEL_OFFSET}', '<\1+OFFSET>', 'g'), '  ', ' '), ', ', ',')"


@query(f"SELECT id, {_asm_sql('line')} AS asm FROM {fixtures.values(fixtures.ASM, 'id, line')} UNION ALL SELECT conv_id * 100 + turn + 1000, {_asm_sql('text')} FROM conversations")
def asm_normalize(spark, d):
    a = spark.createDataFrame(fixtures.ASM, "id long, line string").select("id", T.normalize_asm(F.col("line")).alias("asm"))
    return a.unionByName(table(spark, d, "conversations").select((F.col("conv_id") * 100 + F.col("turn") + 1000).alias("id"), T.normalize_asm(F.col("text")).alias("asm")))


_BINARY_VALUES = f"(SELECT row_id, bin_name, list_transform(asm_codes, lambda x: replace(x, 'nop', own)) AS asm_codes FROM {fixtures.filled_sql(fixtures.BINARY, 'bin_name, asm_codes')})"


def _binaries(spark, d):
    b = fixtures.filled(spark, d, fixtures.BINARY, "bin_name string, asm_codes array<string>")
    return b.select("row_id", "bin_name", F.transform("asm_codes", lambda x: F.replace(x, F.lit("nop"), F.col("own"))).alias("asm_codes"))


_PROLOGUE = f"""WITH b AS (SELECT row_id, bin_name, list_filter(list_transform(asm_codes, lambda x: {_asm_sql('x')}), lambda x: x <> '') AS a FROM {_BINARY_VALUES}),
s AS (SELECT row_id, bin_name, i, string_split(a[i + 1], ',')[1] IN ('mov <MEM>', 'movsd <MEM>', 'movss <MEM>') AND a[i + 1] <> 'mov <MEM>,0x0' AS st FROM (SELECT row_id, bin_name, a, unnest(range(1, least(20, len(a)))) AS i FROM b)),
f AS (SELECT row_id, bin_name, min(i) FILTER (st) AS first FROM s GROUP BY row_id, bin_name),
e AS (SELECT row_id, s.bin_name, min(i) FILTER (NOT st AND i > first) AS stop, first, max(i) AS last FROM s JOIN f USING (row_id, bin_name) GROUP BY row_id, s.bin_name, first)
SELECT row_id, bin_name, coalesce(CASE WHEN first IS NULL THEN 1 ELSE coalesce(stop, last + 1) END, 1)::int AS body_start, least(6, coalesce(coalesce(stop, last + 1) - first, 0))::int AS param_count FROM b LEFT JOIN e USING (row_id, bin_name)"""


@query(_PROLOGUE)
def asm_prologue(spark, d):
    b = _binaries(spark, d).withColumn("p", T.asm_prologue(T.normalize_asm_lines(F.col("asm_codes"))))
    return b.select("row_id", "bin_name", "p.body_start", "p.param_count")


@query("""SELECT id, array_to_string(list_filter(list_transform(l, lambda x, i: CASE WHEN i > p AND NOT contains(x, '{') THEN x END), lambda x: x IS NOT NULL), '|') AS body
FROM (SELECT id, l, coalesce(list_position(list_transform(l, lambda x: contains(x, '{')), true), 1000) AS p FROM (SELECT id, string_split(source, chr(10)) AS l FROM """ + _SOURCE_VALUES + "))")  # fmt: skip
def source_body(spark, d):
    return _sources(spark, d).select("id", joined(T.source_body(F.col("lines"))).alias("body"))


_PATCH_VALUES = f"(SELECT row_id * 1000 + patch_id AS patch_id, replace(raw, 'e', own) AS raw FROM {fixtures.filled_sql(fixtures.PATCHES, 'patch_id, raw')})"


def _patches(spark, d):
    p = fixtures.filled(spark, d, fixtures.PATCHES, "patch_id int, raw string")
    return p.select((F.col("row_id") * 1000 + F.col("patch_id")).alias("patch_id"), F.replace("raw", F.lit("e"), F.col("own")).alias("raw"))


@query(rf"""SELECT patch_id, {_uncommented(r"array_to_string(list_filter(list_transform(string_split(raw, chr(10)), lambda x: regexp_replace(regexp_replace(x, '^[+-]', ''), '^\s+|\s+$', '', 'g')), lambda x: x <> ''), ' ')")} AS snippet FROM {_PATCH_VALUES}""")
def snippet_text(spark, d):
    return _patches(spark, d).select("patch_id", T.snippet_text(F.split("raw", "\n")).alias("snippet"))


@query("SELECT doc_id, CASE WHEN a = '' THEN 0 ELSE instr(text, a) - 1 END AS start_char, CASE WHEN a = '' THEN 0 ELSE instr(text, a) - 1 END + length(a) - 1 AS end_char FROM (SELECT doc_id, text, string_split(text, ' ')[3] AS a FROM documents) WHERE a IS NOT NULL")
def answer_span(spark, d):
    s = table(spark, d, "documents").select("doc_id", "text", F.get(F.split("text", " "), 2).alias("a")).filter("a is not null")
    return s.withColumn("s", T.answer_span(F.col("text"), F.col("a"))).select("doc_id", F.col("s.start").alias("start_char"), F.col("s.end").alias("end_char"))


@query("""SELECT doc_id, coalesce(list_position(list_transform(range(1, least(len(a), len(b)) + 1), lambda i: a[i] <> b[i]), true) - 1, 0)::int AS first_difference
FROM (SELECT doc_id, string_split(text, ' ') AS a, string_split(lead(text) OVER (ORDER BY doc_id), ' ') AS b FROM documents) WHERE b IS NOT NULL""")
def prefix_diff_index(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.split("text", " ").alias("w"))
    n = ordered.numbered(t.select("doc_id", "w"), ["doc_id"], "k")
    j = n.alias("a").join(n.select((F.col("k") - 1).alias("k"), F.col("w").alias("next")).alias("b"), "k")
    return j.select("doc_id", T.first_difference(F.col("w"), F.col("next")).cast("int").alias("first_difference"))


@query(r"""SELECT patch_id, CASE WHEN contains(h, '(') THEN regexp_extract(string_split(h, '(')[1], '(\S+)\s*$', 1) END AS function_name FROM (SELECT patch_id, array_to_string(string_split_regex(trim(string_split(string_split(raw, chr(10))[1], '@@')[3]), '\s+')[1:3], ' ') AS h FROM """ + _PATCH_VALUES + " WHERE starts_with(raw, '@@'))")
def function_of_context(spark, d):
    p = _patches(spark, d).filter(F.col("raw").startswith("@@"))
    return p.select("patch_id", T.function_of_context(F.get(F.split(F.get(F.split("raw", "\n"), 0), "@@"), 2)).alias("function_name"))


_NAMES = [(1, "a/b.c_main"), (2, "x.h_f_g"), (3, "plain"), (4, "a.c_b.c_d"), (5, "* name (int)"), (6, "_Abc"), (7, "a__b"), (8, "__x"), (9, "_abc"), (10, "*ptr")]
_NAME_VALUES = f"(SELECT row_id * 1000 + id AS id, replace(name, 'b', own) AS name FROM {fixtures.filled_sql(_NAMES, 'id, name')})"


@query(rf"""SELECT id, CASE WHEN n = 1 THEN regexp_extract(name, '^(.*\.[ch])_(.*)$', 1) END AS file, CASE WHEN n = 1 THEN regexp_extract(name, '^(.*\.[ch])_(.*)$', 2) END AS func,
replace(string_split(name, '(')[1], '* ', '') AS node_name, regexp_matches(name, '^_[A-Z]|__') AS reserved, regexp_replace(name, '^\*', '') AS pointed FROM (SELECT *, len(regexp_extract_all(name, '\.[ch]_')) AS n FROM {_NAME_VALUES})""")
def names_parsed(spark, d):
    n = fixtures.filled(spark, d, _NAMES, "id int, name string")
    n = n.select((F.col("row_id") * 1000 + F.col("id")).alias("id"), F.replace("name", F.lit("b"), F.col("own")).alias("name")).withColumn("f", T.file_and_function(F.col("name")))
    return n.select("id", "f.file", F.col("f.function").alias("func"), T.node_name(F.col("name")).alias("node_name"), T.is_reserved(F.col("name")).alias("reserved"), T.strip_pointer(F.col("name")).alias("pointed"))


_ASM_0 = f"array_to_string(list_filter(list_transform({fixtures.literal(fixtures.BINARY[0][1])}, lambda x: {_asm_sql('x')}), lambda x: x <> ''), chr(10))"


@query(f"""SELECT id, json_object('question', 'Does the binary function contain the patch? Answer yes or no.', 'source', array_to_string({_src_lines("string_split(source, chr(10))")}, chr(10)), 'patch', '- a' || chr(10) || '+ b', 'assembly', {_ASM_0})::varchar AS prompt FROM {_SOURCE_VALUES}""")
def prompts(spark, d):
    asm = F.array(*map(F.lit, fixtures.BINARY[0][1]))
    return _sources(spark, d).select("id", T.prompt(F.col("lines"), F.lit("- a\n+ b"), asm).alias("prompt"))


# ---- ordered lists ----


@query("""SELECT doc_id, i AS window_no, array_to_string(w[i * 20 + 1:least(len(w), i * 20 + 70)], ' ') AS words FROM (SELECT doc_id, w, unnest(range(0, CASE WHEN len(w) <= 70 THEN 1 ELSE (len(w) - 70) // 20 + 1 END)) AS i FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents))
UNION ALL SELECT doc_id, (len(w) - 70) // 20 + 1, array_to_string(w[len(w) - 69:], ' ') FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents) WHERE len(w) > 70 AND (len(w) - 70) % 20 <> 0""")
def sliding_windows(spark, d):
    w = table(spark, d, "documents").select("doc_id", F.posexplode(T.sliding_windows(F.split("text", " "))).alias("window_no", "w"))
    return w.select("doc_id", F.col("window_no").cast("long").alias("window_no"), joined("w", " ").alias("words"))


_RUNS = """WITH e AS (SELECT *, CASE WHEN event_type = lag(event_type) OVER w THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM e)"""


@query(f"{_RUNS} SELECT user_id, run::bigint AS run_id, min(event_type) AS event_type, count(*) AS n, min(ts) AS first_ts FROM r GROUP BY user_id, run")
def adjacent_merge(spark, d):
    r = ordered.adjacent_runs(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "event_type")
    return r.groupBy("user_id", "run_id").agg(F.min("event_type").alias("event_type"), F.count("*").alias("n"), F.min("ts").alias("first_ts"))


@query("""SELECT conv_id, turn, coalesce(string_agg(role, '|') OVER (PARTITION BY conv_id ORDER BY turn RANGE BETWEEN 2 PRECEDING AND 1 PRECEDING), '') AS before,
coalesce(string_agg(role, '|') OVER (PARTITION BY conv_id ORDER BY turn RANGE BETWEEN 1 FOLLOWING AND 2 FOLLOWING), '') AS after FROM conversations""")
def context_rows(spark, d):
    c = ordered.context_rows(table(spark, d, "conversations").select("conv_id", "turn", "role"), ["conv_id"], "turn", "role")
    return c.select("conv_id", "turn", joined("before").alias("before"), joined("after").alias("after"))


@query("""WITH t AS (SELECT item_id, list_transform(string_split(text, ' '), lambda x: lower(x)) AS w FROM benchmark), u AS (SELECT item_id, unnest(w) AS s, generate_subscripts(w, 1) AS i FROM t),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY length(s), i) AS k FROM u)
SELECT a.item_id, string_agg(a.s, '|' ORDER BY a.k) AS kept FROM r a WHERE NOT EXISTS (SELECT 1 FROM r b WHERE b.item_id = a.item_id AND b.k > a.k AND contains(b.s, a.s)) GROUP BY a.item_id""")
def substring_subsume(spark, d):
    b = table(spark, d, "benchmark").select("item_id", F.transform(F.split("text", " "), F.lower).alias("w"))
    return ordered.drop_subsumed(b, "item_id", "w").select("item_id", joined("w").alias("kept"))


@query("""WITH t AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, i, text[i * 20 + 1:i * 20 + 30] AS s FROM (SELECT *, unnest(range(0, CASE WHEN n <= 30 THEN 1 ELSE (n - 30) // 20 + 1 END)) AS i FROM t) UNION ALL SELECT doc_id, (n - 30) // 20 + 1, right(text, 30) FROM t WHERE n > 30 AND (n - 30) % 20 <> 0),
p AS (SELECT *, lead(s) OVER (PARTITION BY doc_id ORDER BY i) AS next FROM w),
o AS (SELECT *, coalesce(list_max(list_filter(range(0, least(length(s), length(next)) + 1), lambda k: right(s, k) = left(next, k))), 0) AS o FROM p)
SELECT doc_id, string_agg(s, '|' ORDER BY i) AS kept FROM o WHERE next IS NULL OR o <= 10 GROUP BY doc_id""")
def overlap_merge(spark, d):
    t = table(spark, d, "documents").filter("text is not null").select("doc_id", T.text_windows(F.col("text")).alias("l"))
    return ordered.drop_overlapped(t, "doc_id", "l").select("doc_id", joined("l").alias("kept"))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS seq_id, (row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1) // 20 AS batch_id FROM orders")
def seq_id_and_batching(spark, d):
    o = ordered.numbered(table(spark, d, "orders").withColumn("day", F.unix_micros(F.col("o_orderdate").cast("timestamp"))).select("o_orderkey", "day"), ["day", "o_orderkey"])
    return o.select("o_orderkey", "seq_id", F.floor(F.col("seq_id") / 20).cast("long").alias("batch_id"))


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders WHERE o_totalprice > 200000) WHERE r <= 2")
def topn_threshold(spark, d):
    return ordered.top_over(table(spark, d, "orders"), ["o_custkey"], "o_totalprice", 200000, 2, ["o_orderkey"]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM events WHERE value >= 0.5) WHERE r = 1")
def argmax_first(spark, d):
    return ordered.best(table(spark, d, "events"), ["user_id"], "value", 0.5, ["event_id"]).select("user_id", "event_id", "value")


@query("SELECT source, doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id DESC) AS r FROM documents) WHERE r = 1")
def last_wins(spark, d):
    return ordered.last_wins(table(spark, d, "documents").select("source", "doc_id", "lang"), ["source", "lang"], ["doc_id"])


# ---- listings, diffs ----

_LISTING_SQL = f"""WITH l AS (SELECT * FROM {fixtures.LISTING_SQL}),
s AS (SELECT * FROM (SELECT *, last_value(CASE WHEN starts_with(line, 'Disassembly of section ') THEN line END IGNORE NULLS) OVER (PARTITION BY bin ORDER BY line_no) AS section FROM l) WHERE section = 'Disassembly of section .text:'),
f0 AS (SELECT *, contains(line, ' <') AND ends_with(line, '>:') AS head FROM s),
f1 AS (SELECT *, sum(head::int) OVER (PARTITION BY bin ORDER BY line_no) AS fno FROM f0),
f2 AS (SELECT *, first_value(string_split(regexp_extract(line, '<(.*)>:$', 1), '.')[1]) OVER (PARTITION BY bin, fno ORDER BY line_no) AS name FROM f1 WHERE fno > 0),
f AS (SELECT * FROM f2 WHERE NOT head AND (bin, fno) IN (SELECT (bin, max(fno)) FROM f2 GROUP BY bin, name))"""


@query(f"{_LISTING_SQL} SELECT bin AS binary, name AS function_name, (row_number() OVER (PARTITION BY bin, name ORDER BY line_no) - 1)::int AS place, string_split(line, chr(9))[-1] AS asm FROM f")
def listing_flat(spark, d):
    return listing.flat_functions(fixtures.listing(spark, d)).select("binary", "function_name", F.posexplode("asm_codes").alias("place", "asm"))


_MAPPINGS = rf"""m AS (SELECT *, ends_with(line, '():') AS callee, (contains(line, '__tmp/') OR starts_with(line, '/usr/')) AND contains(line, ':') AND NOT ends_with(line, '():') AS place FROM f),
n AS (SELECT *, sum((callee OR place)::int) OVER (PARTITION BY bin, fno ORDER BY line_no) AS mno, regexp_matches(line, '^\s*[0-9a-f]+:\t([0-9a-f][0-9a-f] )+\s*(\S+)?') AS asm FROM m),
a AS (SELECT *, CASE WHEN asm AND len(string_split(line, chr(9))) = 3 THEN rtrim(string_split(line, chr(9))[3]) END AS code FROM n),
c AS (SELECT *, max((code IS NOT NULL)::int) OVER (PARTITION BY bin, fno, mno ORDER BY line_no) AS seen FROM a)"""
#: The same listing, of functions of one name the one with most lines.
_LONGEST_SQL = _LISTING_SQL.replace("SELECT (bin, max(fno)) FROM f2 GROUP BY bin, name", "SELECT (bin, arg_max(fno, [n, fno])) FROM (SELECT bin, name, fno, count(*) AS n FROM f2 GROUP BY bin, name, fno) GROUP BY bin, name")


@query(rf"""{_LISTING_SQL}, {_MAPPINGS}
SELECT bin AS binary, name AS function_name, mno::bigint AS mapping_no, max(CASE WHEN place THEN string_split(line, ':')[1] END) AS src_path, max(CASE WHEN place THEN regexp_extract(line, ':([0-9]+)', 1)::int END) AS src_line,
  coalesce(bool_or(CASE WHEN place THEN contains(line, '(discriminator') END), false) AS is_discriminator,
  coalesce(string_agg(CASE WHEN NOT callee AND NOT place AND NOT asm AND seen = 0 THEN regexp_replace(line, '\s+$', '') END, '|' ORDER BY line_no), '') AS src_codes, coalesce(string_agg(code, '|' ORDER BY line_no), '') AS asm_codes
FROM c GROUP BY bin, name, mno HAVING count(code) > 0 OR count(CASE WHEN NOT callee AND NOT place AND NOT asm AND seen = 0 THEN 1 END) > 0""")
def listing_segments(spark, d):
    m = listing.code_mappings(listing.split_functions(listing.text_section(fixtures.listing(spark, d))))
    return m.select("binary", "function_name", F.col("mapping_no").cast("long").alias("mapping_no"), "src_path", "src_line", "is_discriminator", joined("src_codes").alias("src_codes"), joined("asm_codes").alias("asm_codes"))


def _longest(spark, d):
    return listing.code_mappings(listing.split_functions(listing.text_section(fixtures.listing(spark, d)), last_wins=False))


_OWN = "CASE WHEN NOT callee AND NOT place AND NOT asm AND seen = 0 THEN regexp_replace(line, '\\s+$', '') END"
_LINED = f"""r AS (SELECT bin, name, mno, max(CASE WHEN place THEN regexp_extract(line, ':([0-9]+)', 1)::int END) AS src_line, list({_OWN} ORDER BY line_no) FILTER ({_OWN} IS NOT NULL) AS src, count(code) AS n_asm FROM c GROUP BY bin, name, mno HAVING count(code) > 0 OR count({_OWN}) > 0)"""


@query(rf"""{_LONGEST_SQL}, {_MAPPINGS}, {_LINED},
p AS (SELECT bin, name, min(line_no) AS first_no FROM c WHERE contains({_OWN}, '(') GROUP BY bin, name)
SELECT bin AS binary, name AS function_name, sum(n_asm)::int AS n_asm, arg_min(src_line, mno) AS first_line, coalesce((SELECT len(string_split(line, ',')) FROM c JOIN p USING (bin, name) WHERE c.bin = r.bin AND c.name = r.name AND line_no = first_no), 0)::int AS declared_params FROM r GROUP BY bin, name HAVING sum(n_asm) >= 10""")
def listing_functions(spark, d):
    return listing.functions(_longest(spark, d)).select("binary", "function_name", F.size("asm_codes").alias("n_asm"), "first_line", "declared_params")


@query(rf"""{_LONGEST_SQL}, {_MAPPINGS}, {_LINED},
t AS (SELECT *, row_number() OVER (PARTITION BY bin, name ORDER BY mno) AS nth FROM r WHERE src_line IS NOT NULL AND len(src) > 0),
u AS (SELECT bin, name, mno, nth, src_line, len(src) AS n, unnest(src) AS text, generate_subscripts(src, 1) AS k FROM t),
w AS (SELECT bin, name, src_line - (n - k) AS line_number, arg_max(text, [mno, k]) AS text FROM u WHERE nth > 1 OR k = n GROUP BY 1, 2, 3)
SELECT r.bin AS binary, r.name AS function_name, line_number::int AS line_number, text, n_asm::int AS n_asm FROM r JOIN w ON w.bin = r.bin AND w.name = r.name AND w.line_number = r.src_line""")
def listing_line_to_asm(spark, d):
    return listing.line_to_asm(_longest(spark, d)).select("binary", "function_name", "line_number", "text", F.size("asm_codes").alias("n_asm"))


@query(rf"""WITH p AS (SELECT patch_id, unnest(string_split(raw, chr(10))) AS line, generate_subscripts(string_split(raw, chr(10)), 1) AS i FROM {_PATCH_VALUES}),
h AS (SELECT *, starts_with(line, '@@') AS head, sum(starts_with(line, '@@')::int) OVER (PARTITION BY patch_id ORDER BY i) AS no FROM p),
bad AS (SELECT patch_id FROM h WHERE head AND NOT (regexp_matches(line, '^@@ *-[0-9]+,[0-9]+ \+[0-9]+,[0-9]+ *@@[^@]*$'))),
g AS (SELECT patch_id, no, max(CASE WHEN head THEN line END) AS l, count(*) FILTER (NOT head) AS n, coalesce(string_agg(line, '|' ORDER BY i) FILTER (NOT head AND NOT starts_with(line, '+')), '') AS snippet_before, coalesce(string_agg(line, '|' ORDER BY i) FILTER (NOT head AND NOT starts_with(line, '-')), '') AS snippet_after FROM h WHERE patch_id NOT IN (SELECT patch_id FROM bad) GROUP BY patch_id, no)
SELECT patch_id, no::int AS hunk_no, coalesce(string_split(l, '@@')[3], '') AS change_context, coalesce(regexp_extract(l, '-([0-9]+),', 1)::int, 0) AS start_before, coalesce(regexp_extract(l, '-[0-9]+,([0-9]+)', 1)::int, 0) AS size_before,
  coalesce(regexp_extract(l, '\+([0-9]+),', 1)::int, 0) AS start_after, coalesce(regexp_extract(l, '\+[0-9]+,([0-9]+)', 1)::int, 0) AS size_after, snippet_before, snippet_after FROM g WHERE n > 0 OR no = (SELECT max(no) FROM g x WHERE x.patch_id = g.patch_id)""")
def diff_hunks(spark, d):
    h = diffs.hunks(_patches(spark, d))
    return h.withColumns({c: joined(c) for c in ("snippet_before", "snippet_after")})


# ---- candidates ----


@query("SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def containment_theta(spark, d):
    b = table(spark, d, "benchmark").select("item_id", F.col("text").alias("needle"))
    return candidates.contained(b, table(spark, d, "documents").select("doc_id", "text"), "needle", "text", ["doc_id"]).select("doc_id", "item_id")


@query("""SELECT doc_id, item_id FROM (SELECT doc_id, len(string_split(text, ' ')) AS n, length(text) % 7 AS p, lang FROM documents) d JOIN (SELECT item_id, len(string_split(text, ' ')) AS n, length(text) % 7 AS p FROM benchmark) b ON d.p = b.p WHERE d.n > b.n""")
def pair_candidates_blocked(spark, d):
    side = lambda t, i: table(spark, d, t).select(i, F.size(F.split("text", " ")).alias(f"n_{i}"), (F.char_length("text") % 7).alias("p"))
    return side("documents", "doc_id").join(side("benchmark", "item_id"), "p").filter("n_doc_id > n_item_id").select("doc_id", "item_id")


_SRC_NAMES = {1: "f", 2: "g", 3: "*h", 4: "k", 5: "other", 6: "empty", 7: "*m"}


_NAMED_VALUES = f"(SELECT row_id, src_name, replace(source, 'y', own) AS source FROM {fixtures.filled_sql([(_SRC_NAMES[i], t) for i, t in fixtures.SOURCES], 'src_name, source')})"
_PAIRS = f"""WITH s AS (SELECT row_id, src_name, l, {_HEADER} FROM (SELECT row_id, src_name, {_src_lines("string_split(source, chr(10))")} AS l FROM {_NAMED_VALUES}) WHERE len(l) > 0),
  b AS (SELECT row_id, bin_name, body_start AS asm_start, param_count AS asm_params, list_filter(list_transform(asm_codes, lambda x: {_asm_sql("x")}), lambda x: x <> '') AS a FROM {_BINARY_VALUES} JOIN ({_PROLOGUE}) USING (row_id, bin_name)),
  p AS (SELECT *, regexp_replace(src_name, '^\\*', '') = bin_name AS same FROM s JOIN b USING (row_id) WHERE (regexp_replace(src_name, '^\\*', '') = bin_name OR NOT regexp_matches(bin_name, '^_[A-Z]|__') AND len(a) > len(l) AND param_count = asm_params))"""


def _pairs(spark, d, **how):
    name = F.element_at(F.create_map(*[F.lit(x) for kv in _SRC_NAMES.items() for x in kv]), F.col("form"))
    return candidates.candidate_pairs(_sources(spark, d).select("row_id", name.alias("src_name"), F.col("lines").alias("src_codes")), _binaries(spark, d), ["row_id"], **how)


@query(f"{_PAIRS} SELECT row_id, src_name, bin_name, param_count AS src_params, asm_params FROM p")
def function_candidates(spark, d):
    return _pairs(spark, d).select("row_id", "src_name", "bin_name", "src_params", "asm_params")


@query(f"""{_PAIRS} SELECT row_id, src_name, bin_name FROM (SELECT *, l[body_start + 1:] AS body FROM p WHERE a[1] = 'endbr64' AND param_count = asm_params)
WHERE round_even(coalesce(len(a)::double / nullif(len({_effective(_src_lines("body"))}), 0), 0), 2) BETWEEN 2 AND 10""")
def legacy_candidates(spark, d):
    return candidates.legacy_filter(_pairs(spark, d, whole=True)).select("row_id", "src_name", "bin_name")


@query(f"SELECT row_id, bin_name, len(asm_codes) AS n FROM {_BINARY_VALUES} WHERE len(asm_codes) >= 8")
def large_functions(spark, d):
    return candidates.large_enough(_binaries(spark, d), "asm_codes", 8).select("row_id", "bin_name", F.size("asm_codes").alias("n"))


_FEATURES = [("*f", 1), ("f", 2), ("g", 3), ("*f", 4), ("zz", 5)]
_BINS = [("f", 1), ("g", 2), ("f", 3)]


def _own_names(rows, names: str) -> str:
    return f"(SELECT name || row_id || own AS name, ord FROM {fixtures.filled_sql(rows, names)})"


@query(f"""SELECT s.name, regexp_replace(s.name, '^\\*', '') AS key, s.ord AS src_ord, b.ord AS bin_ord FROM (SELECT name, max(ord) AS ord FROM {_own_names(_FEATURES, 'name, ord')} GROUP BY name) s JOIN (SELECT name, max(ord) AS ord FROM {_own_names(_BINS, 'name, ord')} GROUP BY name) b ON b.name = regexp_replace(s.name, '^\\*', '')""")
def features_by_name(spark, d):
    own = lambda rows: fixtures.filled(spark, d, rows, "name string, ord int").select(F.concat("name", F.col("row_id").cast("string"), "own").alias("name"), "ord")
    return candidates.by_name(own(_FEATURES), own(_BINS)).select("name", "key", "src_ord", "bin_ord")


@query("""WITH s AS (SELECT o_custkey AS file, min(day) AS a, max(day) AS b FROM (SELECT o_custkey, epoch(o_orderdate)::bigint // 8640000 AS day FROM orders) GROUP BY 1),
l AS (SELECT o_custkey AS file, epoch(o_orderdate)::bigint // 8640000 AS n, o_orderkey AS t FROM orders) SELECT s.file, a AS "start", b AS "end", max(t) AS time FROM s JOIN l ON l.file = s.file AND n BETWEEN a AND b GROUP BY 1, 2, 3""")
def latest_change(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("file"), F.floor(F.unix_seconds(F.col("o_orderdate").cast("timestamp")) / 8640000).alias("line_no"), F.col("o_orderkey").alias("time"))
    spans = o.groupBy("file").agg(F.min("line_no").alias("start"), F.max("line_no").alias("end"))
    return candidates.latest_change(spans, o)


# ---- scoring, decisions, evaluation ----


@query(r"""WITH a AS (SELECT item_id, list_distinct(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) AS w FROM benchmark), b AS (SELECT doc_id, unnest(list_distinct(list_filter(string_split_regex(text, '\s+'), lambda x: x <> ''))) AS t FROM documents)
SELECT item_id, doc_id, count(*)::double / any_value(len(w)) AS score FROM (SELECT item_id, w, unnest(w) AS t FROM a) JOIN b USING (t) GROUP BY item_id, doc_id""")
def token_overlap_scores(spark, d):
    b, t = table(spark, d, "benchmark").select("item_id", F.col("text").alias("q")), table(spark, d, "documents").select("doc_id", "text")
    return scoring.shared_token_scores(b, t, "item_id", "doc_id", "q", "text").select("item_id", "doc_id", "score")


@query("SELECT user_id, CASE WHEN v = f THEN NULL ELSE v < f END AS is_fixed, k > 0 AND NOT coalesce(CASE WHEN v = f THEN NULL ELSE v < f END, false) AS has_vul FROM (SELECT user_id, sum(CASE WHEN event_id % 3 = 0 THEN event_id ELSE 0 END) AS v, sum(CASE WHEN event_id % 3 = 1 THEN event_id ELSE 0 END) AS f, count(*) FILTER (event_id % 3 = 0) AS k FROM events GROUP BY user_id)")
def score_sum_verdict(spark, d):
    kind = F.col("event_id") % 3
    e = table(spark, d, "events").select("user_id", F.when(kind == 0, F.col("event_id")).otherwise(0).alias("vul_score"), F.when(kind == 1, F.col("event_id")).otherwise(0).alias("fix_score"), (kind == 0).alias("located"))
    v = scoring.score_verdict(e, ["user_id"]).join(e.groupBy("user_id").agg(F.bool_or("located").alias("located")), "user_id")
    return v.select("user_id", "is_fixed", scoring.has_vulnerability(F.col("located"), F.col("is_fixed")).alias("has_vul"))


@query("SELECT user_id, count(*) FILTER (event_id % 4 = 1) AS n_confirmed, coalesce(sum(event_id) FILTER (event_id % 4 = 1), 0)::bigint AS id_sum, bool_or(event_id % 4 = 1) AS has_any FROM events GROUP BY user_id")
def confirmed_sums(spark, d):
    e = table(spark, d, "events").select("user_id", (F.col("event_id") % 4).alias("pred"), F.col("event_id").cast("double").alias("score"))
    return scoring.confirmed_sums(e, ["user_id"]).select("user_id", "n_confirmed", F.col("score_sum").cast("long").alias("id_sum"), "has_any")


_ROLL = """SELECT o_custkey, count(*) AS n_candidates, count(*) FILTER (o_orderstatus = 'F') AS n_vul, count(*) FILTER (o_orderstatus = 'O') AS n_repaired, coalesce(string_agg(o_orderkey::varchar, '|' ORDER BY o_orderkey::varchar) FILTER (o_orderstatus = 'F'), '') AS vul_names FROM orders GROUP BY o_custkey"""


def _orders_rollup(spark, d):
    o = table(spark, d, "orders").select("o_custkey", (F.col("o_orderstatus") == "F").alias("has_vul"), (F.col("o_orderstatus") == "O").alias("is_repaired"), F.col("o_orderkey").cast("string").alias("bin_name"))
    return scoring.candidates_rollup(o, ["o_custkey"])


@query(f"SELECT *, n_vul > n_repaired AS conclusion FROM ({_ROLL})")
def candidates_rollup(spark, d):
    return _orders_rollup(spark, d).withColumn("vul_names", joined("vul_names"))


@query(f"SELECT c_nationkey, count(*) FILTER (n_vul > n_repaired) AS n_confirmed, bool_or(n_vul > n_repaired) AS conclusion FROM ({_ROLL}) JOIN customer ON c_custkey = o_custkey GROUP BY c_nationkey")
def vulnerability_rollup(spark, d):
    j = _orders_rollup(spark, d).join(table(spark, d, "customer").select("c_nationkey", F.col("c_custkey").alias("o_custkey")), "o_custkey")
    return scoring.vulnerability_rollup(j, ["c_nationkey"])


@query("SELECT o_custkey, string_agg(o_orderkey::varchar, '|' ORDER BY o_totalprice DESC, o_orderkey) AS possible, coalesce(max(CASE WHEN o_totalprice > 300000 AND r = 1 THEN o_orderkey::varchar END), '') AS confirmed FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) GROUP BY o_custkey")
def analysis_report(spark, d):
    r = scoring.analysis_report(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], "o_orderkey", "o_totalprice", 300000)
    text = lambda c: joined(F.transform(c, lambda x: x.cast("string")))
    return r.select("o_custkey", text("possible").alias("possible"), text("confirmed").alias("confirmed"))


_CONFUSION = "SELECT count(*) FILTER (quality = 1 AND toxic = 0) AS tp, count(*) FILTER (quality = 0 AND toxic = 0) AS fp, count(*) FILTER (quality = 0 AND toxic = 1) AS tn, count(*) FILTER (quality = 1 AND toxic = 1) AS fn FROM labels"


@query(f"""SELECT *, CASE WHEN precision + recall = 0 THEN 0.0::double ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM (SELECT *, coalesce(tp::double / nullif(tp + fp, 0), 0) AS precision, coalesce(tp::double / nullif(tp + fn, 0), 0) AS recall,
coalesce((tp + tn)::double / nullif(tp + tn + fp + fn, 0), 0) AS accuracy, coalesce(tn::double / nullif(tn + fp, 0), 0) AS specificity, coalesce((fp + fn)::double / nullif(tp + tn + fp + fn, 0), 0) AS error_rate,
coalesce((tp::double * tn - fp::double * fn) / nullif(sqrt((tp::double + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0) AS mcc FROM ({_CONFUSION}))""")
def confusion_metrics(spark, d):
    return evaluation.metrics(evaluation.confusion(table(spark, d, "labels"), F.col("quality") == 1, F.col("toxic") == 0))


@query("""SELECT count(*) AS total, count(*) FILTER (a) AS filtered, count(*) FILTER (a AND b) AS confirmed, count(*) FILTER (a AND b AND c) AS located, count(*) FILTER (a)::double / count(*) AS filtered_share,
coalesce(count(*) FILTER (a AND b)::double / nullif(count(*) FILTER (a), 0), 0) AS confirmed_share, coalesce(count(*) FILTER (a AND b AND c)::double / nullif(count(*) FILTER (a AND b), 0), 0) AS located_share
FROM (SELECT user_id, bool_or(event_id % 2 = 0) AS a, bool_or(event_id % 7 = 0) AS b, bool_or(event_id % 11 = 0) AS c FROM events GROUP BY user_id)""")
def stage_funnel(spark, d):
    e = F.col("event_id")
    return evaluation.funnel(table(spark, d, "events"), ["user_id"], {"filtered": e % 2 == 0, "confirmed": e % 7 == 0, "located": e % 11 == 0})


@query("""SELECT *, CASE WHEN precision + recall = 0 THEN 0.0::double ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM (SELECT o::bigint AS overlap, p::bigint AS predicted, a::bigint AS actual, o::double / p AS precision, o::double / a AS recall FROM (
SELECT sum(greatest(0, least(pe, te) - greatest(ps, ts) + 1)) AS o, sum(pe - ps + 1) AS p, sum(te - ts + 1) AS a FROM (SELECT ps, ts, te, CASE WHEN pe < ps THEN ps + 350 ELSE pe END AS pe FROM (SELECT l_partkey % 50 AS ps, l_partkey % 50 + l_suppkey % 30 - 2 AS pe, l_orderkey % 50 AS ts, l_orderkey % 50 + l_linenumber AS te FROM lineitem))))""")
def span_overlap(spark, d):
    a, b = F.col("l_partkey") % 50, F.col("l_orderkey") % 50
    s = table(spark, d, "lineitem").select(a.alias("pred_start"), (a + F.col("l_suppkey") % 30 - 2).alias("pred_end"), b.alias("true_start"), (b + F.col("l_linenumber")).alias("true_end"))
    return evaluation.span_overlap(s)


@query("SELECT quality, count(*) AS n, avg((quality = toxic)::int::double) AS accuracy, count(*) FILTER (quality <> toxic) AS n_wrong FROM labels GROUP BY quality")
def accuracy_and_errors(spark, d):
    return evaluation.accuracy_and_errors(table(spark, d, "labels"), "quality", "toxic")


@query("SELECT quality, doc_id FROM labels WHERE quality <> toxic")
def wrong_items(spark, d):
    return evaluation.errors(table(spark, d, "labels"), "quality", "toxic").select("quality", "doc_id")


_SCORE_LINES = [("true,false,1,0.5,0.25",), ("true,true,0,0.25,0.5",), ("false,false",), ("true,true,1,2.0,1.0,2,3.0,1.0",), ("False,True,3,0.5,0.50001",)]


_SCORES = f"SELECT trim(p[1])::boolean AS has_vul_function, trim(p[2])::boolean AS has_vul, trim(p[3])::int AS diff_num, trim(p[4])::double AS vul_score, trim(p[5])::double AS fix_score FROM (SELECT string_split(replace(line, ',1,', ',' || row_id || ','), ',') AS p FROM {fixtures.filled_sql(_SCORE_LINES, 'line')}) WHERE len(p) = 5"


def _score_lines(spark, d):
    return fixtures.filled(spark, d, _SCORE_LINES, "line string").select(F.replace("line", F.lit(",1,"), F.concat(F.lit(","), F.col("row_id").cast("string"), F.lit(","))).alias("value"))


@query(_SCORES)
def score_csv_scan(spark, d):
    return files.read_scores(_score_lines(spark, d))


@query(f"""SELECT r AS "right", n - r AS wrong, r::double / n AS rate FROM (SELECT count(*) FILTER ((vul_score > round_even(fix_score, 4)) = has_vul) AS r, count(*) AS n FROM ({_SCORES}))""")
def scores_rejudged(spark, d):
    return evaluation.rescored(files.read_scores(_score_lines(spark, d)))


# ---- training sets ----


@query("""SELECT doc_id, CASE WHEN k < n * 8 // 10 THEN 'train' WHEN k < n * 8 // 10 + n // 10 THEN 'valid' ELSE 'test' END AS split FROM (SELECT doc_id, row_number() OVER (ORDER BY md5('0:' || doc_id::varchar)[1:15], doc_id) - 1 AS k, count(*) OVER () AS n FROM documents)""")
def hash_split_80_10_10(spark, d):
    return sampling.split_80_10_10(table(spark, d, "documents").select("doc_id"), "doc_id")


@query("""SELECT doc_id, partner_id FROM (SELECT doc_id, text, coalesce(lead(doc_id) OVER w, first_value(doc_id) OVER w) AS partner_id, CASE WHEN lead(doc_id) OVER w IS NULL THEN first_value(text) OVER w ELSE lead(text) OVER w END AS t FROM documents WINDOW w AS (PARTITION BY source, lang ORDER BY md5('0:' || doc_id::varchar), doc_id)) WHERE t <> text""")
def negative_pairs_hash(spark, d):
    return sampling.partners(table(spark, d, "documents").select("doc_id", "text", "source", "lang"), "doc_id", ["source", "lang"], "text").select("doc_id", "partner_id")


@query()
def similarity_ratio(spark, d):
    b = table(spark, d, "benchmark").select("item_id", "text")
    return sampling.dissimilar(b.withColumn("block", F.lit(0)), "item_id", "text", ["block"], 3, 0.9)


def _draw(key: str, step, n: str) -> str:
    return f"(('0x' || md5(({key})::varchar || ':' || ({step})::varchar)[1:8])::ubigint % ({n}))::int"


def _perturbed_asm(rows: str, key: str) -> str:
    """SQL: `rows` (with `key` and w, a list) with w perturbed, as a chain of subqueries, one for each step."""
    q = f"SELECT *, w[:30] AS a, w[31:] AS rest, len(w) >= 3 AS enough FROM ({rows})"
    for k in range(3):
        q = f"SELECT * REPLACE (list_concat(a[:j + 1], a[j + 1:]) AS a) FROM (SELECT * EXCLUDE (j), {_draw(key, k, 'greatest(len(a), 1)')} AS j FROM (SELECT *, 0 AS j FROM ({q})))" if k == 0 else f"SELECT * REPLACE (list_concat(a[:j + 1], a[j + 1:]) AS a) FROM (SELECT * REPLACE ({_draw(key, k, 'greatest(len(a), 1)')} AS j) FROM ({q}))"
    for k in range(3, 6):
        q = f"SELECT * REPLACE (list_concat(a[:j], a[j + 2:]) AS a) FROM (SELECT * REPLACE ({_draw(key, k, 'greatest(len(a), 1)')} AS j) FROM ({q}))"
    q = f"SELECT *, (i + 1 + {_draw(key, 7, 'greatest(len(a) - 1, 1)')}) % greatest(len(a), 1) AS o FROM (SELECT *, {_draw(key, 6, 'greatest(len(a), 1)')} AS i FROM ({q}))"
    return f"SELECT * REPLACE (CASE WHEN enough THEN list_concat(list_transform(a, lambda x, p: CASE WHEN p = i + 1 THEN a[o + 1] WHEN p = o + 1 THEN a[i + 1] ELSE x END), rest) ELSE w END AS w) FROM ({q})"


def _perturbed_src(rows: str, key: str) -> str:
    q = f"SELECT *, w AS a, 0 AS j, 1 + {_draw(key, 0, '3')} AS times FROM ({rows})"
    for k in (1, 2, 3):
        q = f"""SELECT * REPLACE (CASE WHEN times < {k} OR len(a) = 0 THEN a WHEN {_draw(key, 20 + k, '2')} = 0 THEN list_concat(a[:j], a[j + 2:]) ELSE list_concat(a[:j + 1], [w[{_draw(key, 30 + k, 'greatest(len(w), 1)')} + 1]], a[j + 2:]) END AS a)
FROM (SELECT * REPLACE ({_draw(key, 10 + k, 'greatest(len(a), 1)')} AS j) FROM ({q}))"""
    return f"SELECT * REPLACE (a AS w) FROM ({q})"


_TEXT_WORDS = "SELECT doc_id, string_split(text, ' ') AS w FROM documents"


@query(f"SELECT doc_id, array_to_string(x.w, ' ') AS asm, array_to_string(y.w, ' ') AS src FROM ({_perturbed_asm(_TEXT_WORDS, 'doc_id')}) x JOIN ({_perturbed_src(_TEXT_WORDS, 'doc_id')}) y USING (doc_id)")
def perturb_lines(spark, d):
    w, key = F.split("text", " "), F.col("doc_id")
    return table(spark, d, "documents").select("doc_id", joined(sampling.perturbed_asm(key, w), " ").alias("asm"), joined(sampling.perturbed_src(key, w), " ").alias("src"))


_OWN_CHOICES = "SELECT item_id, n, string_split(text, ' ') AS w, item_id::varchar || ':' || n::varchar AS key FROM benchmark, (SELECT unnest([1, 2, 3]) AS n)"


@query(f"""WITH p AS (SELECT item_id, text, lead(text) OVER w AS next, first_value(text) OVER w AS first FROM benchmark WINDOW w AS (PARTITION BY item_id % 3 ORDER BY md5('0:' || item_id::varchar), item_id))
SELECT item_id, 0 AS wrong_type, text AS src_0, coalesce(next, first) AS src_1 FROM p WHERE coalesce(next, first) <> text
UNION ALL SELECT item_id, 1, array_to_string(o.w, ' '), array_to_string(q.w, ' ') FROM ({_perturbed_src(_OWN_CHOICES, 'key')}) q JOIN ({_OWN_CHOICES}) o USING (item_id, n) WHERE q.w <> o.w""")
def choice_items(spark, d):
    t = table(spark, d, "benchmark").select("item_id", F.split("text", " ").alias("src"), (F.col("item_id") % 3).alias("g"))
    c = sampling.choice_items(t, "item_id", ["g"], "src")
    return c.select("item_id", "wrong_type", joined("src_0", " ").alias("src_0"), joined("src_1", " ").alias("src_1"))


@query()
def source_features_scan(spark, d):
    f = source_features.extract(_sources(spark, d).select(F.col("id").cast("string").alias("path"), F.col("source").alias("content")))
    return f.select("path", "name", "node_type", "line_start", "line_end", joined("strings").alias("strings"), "hash_value")


# ---- extensions over events ----


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n_events, round(sum(value), 4) AS sum_value FROM events GROUP BY 1, 2")
def events_tumbling(spark, d):
    return stream.tumbling(table(spark, d, "events")).withColumn("sum_value", F.round("sum_value", 4))


@query("""SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n_events FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, k""")
def events_sessions(spark, d):
    return stream.sessions(table(spark, d, "events"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage, with the size of their group of equal content."""
    docs = table(spark, sf_dir, "documents").withColumn("content_hash", T.content_hash(F.col("text")))
    sizes = docs.groupBy("content_hash").agg(F.count("*").alias("n_equal"))
    found = candidates.contained(table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("needle")), docs.select("doc_id", "text", "content_hash"), "needle", "text", ["doc_id", "content_hash"])
    g = found.groupBy("doc_id", "content_hash").agg(F.count("*").alias("n_items"), F.min("item_id").alias("first_item"))
    return g.join(sizes, "content_hash").select("doc_id", "n_items", "first_item", "n_equal").orderBy("doc_id")


from patchlens.plans import large, saved, training  # noqa: E402, F401  their queries register themselves
