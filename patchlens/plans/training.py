"""Named queries over training items, cases, scores and metadata, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from patchlens.functions import text as T
from patchlens.operators import candidates, evaluation, listing, ordered, sampling, scoring
from patchlens.plans import fixtures, relational
from patchlens.plans import catalog as C
from patchlens.sources import files

query, table, joined = C.query, C.table, C.joined

# ---- training items: source lines, instructions and answers that a rule makes of a vendor's name ----


def _items() -> list[tuple]:
    out = []
    for i in range(40):
        src = [f"int v{k} = f({k}, x);" if (i + k) % 3 else "}" for k in range(i % 19)] + ["/* note */"] * (i % 2)
        asm = [f"mov eax,{k}" for k in range((i * 7) % 71)]
        out.append((i, src, asm, asm[: (i * 5) % 43]))
    return out


_ITEMS = _items()
#: The item of a vendor's id, its first lines' names replaced by the vendor's.
_ITEM_VALUES = f"(SELECT row_id * 100 + id AS id, list_transform(src_codes, lambda x: replace(x, 'v1', own)) AS src_codes, asm_codes, answer_asm_codes FROM {fixtures.filled_sql(_ITEMS, 'id, src_codes, asm_codes, answer_asm_codes')} WHERE id % 8 = row_id % 8)"


def _training(spark, d):
    f = fixtures.filled(spark, d, _ITEMS, "id int, src_codes array<string>, asm_codes array<string>, answer_asm_codes array<string>").filter("id % 8 = row_id % 8")
    return f.select((F.col("row_id") * 100 + F.col("id")).alias("id"), F.transform("src_codes", lambda x: F.replace(x, F.lit("v1"), F.col("own"))).alias("src_codes"), "asm_codes", "answer_asm_codes")


_EFFECTIVE = f"len({C._effective(C._src_lines('src_codes'))})"


@query(f"SELECT id, n::int AS effective_src_length FROM (SELECT *, {_EFFECTIVE} AS n FROM {_ITEM_VALUES}) WHERE n >= 5 AND len(asm_codes) <= 50 AND len(answer_asm_codes) > 2 * n AND len(answer_asm_codes) < 10 * n")
def positioning_items(spark, d):
    return sampling.positioning_items(_training(spark, d)).select("id", "effective_src_length")


@query(f"SELECT id, n::int AS effective, 1 AS label FROM (SELECT *, {_EFFECTIVE} AS n FROM {_ITEM_VALUES}) WHERE n >= 10 AND len(asm_codes) >= 2 * n")
def positive_items(spark, d):
    return sampling.positive_items(_training(spark, d)).select("id", "effective", "label")


@query(rf"SELECT id FROM {_ITEM_VALUES} WHERE len(list_filter(src_codes, lambda x: len(string_split_regex({C._STRIP.format('x')}, '\s+')) > 1)) >= 3 AND len(asm_codes) <= 60")
def long_context_items(spark, d):
    return sampling.long_context_items(_training(spark, d)).select("id")


@query("SELECT doc_id FROM labels JOIN documents USING (doc_id) WHERE quality <> 1 AND text <> '' AND lang <> ''")
def usable_choices(spark, d):
    j = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id").select("doc_id", F.col("quality").alias("wrong_type"), F.col("text").alias("text_0"), F.col("lang").alias("text_1"))
    return sampling.usable_choices(j).select("doc_id")


@query("SELECT event_id, value FROM events WHERE value > 20 AND value < 60")
def similarity_band(spark, d):
    return sampling.similarity_band(table(spark, d, "events").select("event_id", "value"), "value", 20, 60)


def _start(key: str, n: str) -> str:
    return f"('0x' || md5({key})[1:8])::ubigint % greatest({n} - 6, 1)"


@query(f"SELECT doc_id, array_to_string(CASE WHEN len(w) < 8 THEN w ELSE w[3 + h + 1:3 + h + 12] END, ' ') AS part FROM (SELECT doc_id, w, ({_start(chr(39) + '0:' + chr(39) + ' || doc_id::varchar', 'len(w)')})::int AS h FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents))")
def source_slices(spark, d):
    return table(spark, d, "documents").select("doc_id", joined(sampling.source_slice("doc_id", F.split("text", " "), 12), " ").alias("part"))


_TURNS = "SELECT conv_id, list(turn ORDER BY turn) AS l, list(string_split(text, ' ') ORDER BY turn) AS a FROM conversations GROUP BY conv_id"


@query(f"""WITH r AS ({_TURNS}), k AS (SELECT conv_id, l, a, unnest(CASE WHEN len(l) < 7 THEN [0] ELSE range(1, least(ceil(len(l) / 7)::int, 3) + 1) END) AS k FROM r),
s AS (SELECT *, CASE WHEN k = 0 THEN 0 ELSE ({_start("'0:' || conv_id::varchar || ':' || k::varchar", 'len(l)')})::int END AS s FROM k), w AS (SELECT *, greatest(k - 1, 0)::int AS window_no, CASE WHEN k = 0 THEN len(l) ELSE 7 END AS n FROM s)
SELECT conv_id, window_no, len(flatten(a[s + 1:s + n]))::int AS n_answer, len(flatten(a))::int AS n_all, list_min(l[s + 1:s + n]) AS first_line, list_max(l[s + 1:s + n]) AS last_line, md5(array_to_string(flatten(a[s + 1:s + n]), ' ')) AS answer_md5 FROM w""")
def window_items(spark, d):
    rows = F.array_sort(F.collect_list(F.struct(F.col("turn").alias("line_number"), F.split("text", " ").alias("asm_codes"))))
    c = table(spark, d, "conversations").groupBy("conv_id").agg(rows.alias("items"))
    w = sampling.window_items(c, "conv_id")
    return w.select("conv_id", "window_no", F.size("answer_asm_codes").alias("n_answer"), F.size("asm_codes").alias("n_all"), "first_line", "last_line", F.md5(joined("answer_asm_codes", " ")).alias("answer_md5"))


@query(rf"""{C._LONGEST_SQL}, {C._MAPPINGS}, {C._LINED},
b AS (SELECT bin, name, mno, row_number() OVER (PARTITION BY bin, name ORDER BY mno) AS k, count(*) OVER (PARTITION BY bin, name) AS n, len(list_filter(src, lambda x: contains(x, '{{'))) > 0 AS opens FROM r),
o AS (SELECT bin, name, least(coalesce(min(k) FILTER (opens), 0) + 1, max(n)) AS start FROM b GROUP BY bin, name)
SELECT bin AS binary, name AS function_name, coalesce(string_agg(code, '|' ORDER BY line_no), '') AS asm FROM c JOIN b USING (bin, name, mno) JOIN o USING (bin, name) WHERE k >= start GROUP BY bin, name""")
def body_items(spark, d):
    return sampling.body_items(C._longest(spark, d)).select("binary", "function_name", joined("asm_codes").alias("asm"))


_TRAIN = "concat('[SRC_CODE] ', array_to_string(s[:l], ' '), ' [SEP] [ASM_CODE] ', array_to_string(a[:o], ' '))"


@query(f"""WITH RECURSIVE d AS (SELECT id, src_codes AS s, asm_codes AS a, len(src_codes) AS n, len(asm_codes) AS m, coalesce(round_even(len(asm_codes)::double / nullif(len(src_codes), 0), 0), 0)::int AS each FROM {_ITEM_VALUES}),
g AS (SELECT *, 0 AS t, 1 AS l, 3 AS o FROM d UNION ALL SELECT id, s, a, n, m, each, t + 1, l + CASE WHEN length(s[least(l + 1, n)]) = 1 OR s[least(l + 1, n)] = '"STR"' THEN 2 ELSE 1 END, o + each FROM g WHERE n > 0 AND l <= n AND o <= m AND (t = 0 OR length({_TRAIN}) <= 1000))
SELECT id, arg_max({_TRAIN}, t) AS train_text FROM g GROUP BY id""")
def training_texts(spark, d):
    return _training(spark, d).select("id", sampling.train_text(F.col("src_codes"), F.col("asm_codes")).alias("train_text"))


@query()
def fuzzy_similarity(spark, d):
    b = table(spark, d, "benchmark").select("item_id", "text")
    p = sampling.partners(b.withColumn("g", F.lit(0)), "item_id", ["g"], "text")
    return p.select("item_id", "partner_id", sampling.fuzzy_ratio_udf()("text", "partner").alias("similarity"))


# ---- lists of two texts ----

_TWO = "SELECT item_id, string_split(text, ' ') AS a, string_split(replace(text, 'e', 'E'), ' ') AS b FROM benchmark"


def _two(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.split("text", " ").alias("a"), F.split(F.replace("text", F.lit("e"), F.lit("E")), " ").alias("b"))


@query(f"SELECT item_id, coalesce(list_position(list_transform(range(0, len(a)), lambda i: a[len(a) - i] <> b[len(b) - i]), true) - 1, 0)::int AS equal_at_end FROM ({_TWO})")
def suffix_diff_index(spark, d):
    return _two(spark, d).select("item_id", T.last_difference(F.col("a"), F.col("b")).alias("equal_at_end"))


@query(f"SELECT item_id, {C._uncommented("array_to_string(a[k + 1:k + 10], ' ')")} AS text_0, {C._uncommented("array_to_string(b[k + 1:k + 10], ' ')")} AS text_1 FROM (SELECT *, coalesce(list_position(list_transform(range(1, len(a) + 1), lambda i: a[i] <> b[i]), true) - 1, 0) AS k FROM ({_TWO}))")
def choice_texts(spark, d):
    return _two(spark, d).select("item_id", T.choice_texts(F.col("a"), F.col("b")).alias("t")).select("item_id", "t.text_0", "t.text_1")


@query("SELECT item_id, array_to_string(CASE WHEN last IS NULL THEN [] ELSE w[least(last, len(w) - 1) + 1:least(last, len(w) - 1) + 5] END, ' ') AS part FROM (SELECT item_id, w, list_max(list_filter(range(0, len(w) + 1), lambda i: contains(array_to_string(w[i + 1:], ' '), t))) AS last FROM (SELECT item_id, string_split(text, ' ') AS w, substring(text, 4, 2) AS t FROM benchmark))")
def located_suffix(spark, d):
    b = table(spark, d, "benchmark")
    return b.select("item_id", joined(T.locate_suffix(F.split("text", " "), F.substring("text", 4, 2), 5), " ").alias("part"))


# ---- cases, candidates, decisions ----

_CASES = [
    (1, "x", False, "f", ["int a;", " b();"], [" b();", "+c();"], [" b();"]), (2, "x", True, "f", ["a", "b"], ["-a", " b"], ["+a", " b"]), (3, "x", True, "f", ["c", "b"], ["-a"], ["+z"]),
    (4, None, False, "g", ["a"], ["a"], ["a"]), (5, "y", False, "h", [], ["a"], ["a"]), (6, "y", False, "k", ["a b", "c"], ["-b", " c"], []), (6, "y", False, "m", ["q"], ["r"], ["q"]),
]
_CASE_NAMES = "id, binary_name, is_fixed, function_name, source, vul, fix"
#: A vendor's name stands for `c` in its sources, so patches fit it or not.
_CASE_VALUES = f"(SELECT row_id * 10 + id AS id, binary_name, is_fixed, function_name, list_transform(source, lambda x: replace(x, 'c', own)) AS source, vul, fix FROM {fixtures.filled_sql(_CASES, _CASE_NAMES)})"


def _unsigned(l: str) -> str:
    return rf"array_to_string(list_transform({l}, lambda x: {C._STRIP.format("regexp_replace(x, '^[+-]', '')")}), ' ')"


@query(f"SELECT id, string_agg(function_name, '|' ORDER BY function_name) AS names FROM {_CASE_VALUES} WHERE binary_name IS NOT NULL AND len(source) > 0 AND contains({_unsigned('source')}, CASE WHEN is_fixed THEN {_unsigned('fix')} ELSE {_unsigned('vul')} END) GROUP BY id")
def valid_cases(spark, d):
    c = fixtures.filled(spark, d, _CASES, "id int, binary_name string, is_fixed boolean, function_name string, source array<string>, vul array<string>, fix array<string>")
    c = c.withColumn("id", F.col("row_id") * 10 + F.col("id")).withColumn("source", F.transform("source", lambda x: F.replace(x, F.lit("c"), F.col("own"))))
    patch = F.array(F.struct(F.col("vul").alias("vul_snippet_codes"), F.col("fix").alias("fixed_snippet_codes")))
    fs = F.array_sort(F.collect_list(F.struct("function_name", F.col("source").alias("vul_source_codes"), patch.alias("patches"))))
    cases = c.groupBy("id").agg(F.first("binary_name").alias("binary_name"), F.first("is_fixed").alias("is_fixed"), fs.alias("functions"))
    return candidates.valid_cases(cases).select("id", joined(F.transform("functions", lambda f: f["function_name"])).alias("names"))


@query("SELECT o_orderkey, c_custkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey")
def cases_with_listings(spark, d):
    cases = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("binary"))
    return candidates.listings_of_cases(cases, table(spark, d, "customer").select(F.col("c_custkey").alias("binary"), "c_mktsegment")).select("o_orderkey", F.col("binary").alias("c_custkey"), "c_mktsegment")


@query("SELECT doc_id, toxic = 1 AS has_vul_function, toxic = 1 AND NOT coalesce(quality = 1, false) AS has_vul FROM labels")
def ground_truth(spark, d):
    named = F.when(F.col("toxic") == 1, F.array(F.lit("f"))).otherwise(F.array().cast("array<string>"))
    return candidates.ground_truth(table(spark, d, "labels").select("doc_id", named.alias("names"), (F.col("quality") == 1).alias("is_fixed"))).select("doc_id", "has_vul_function", "has_vul")


@query("SELECT event_id FROM events WHERE event_id % 2 = 1 AND value > 70")
def confirmed_pairs(spark, d):
    return scoring.confirmed(table(spark, d, "events").select("event_id", (F.col("event_id") % 2).alias("pred"), F.col("value").alias("prob")), 70).select("event_id")


@query("SELECT event_id, (list_position(s, list_max(s)) - 1)::int AS label, 1 / list_sum(list_transform(s, lambda x: exp(x - list_max(s)))) AS prob FROM (SELECT event_id, [value / 100, (user_id % 7)::double, (event_id % 5)::double] AS s FROM events)")
def arg_max_labels(spark, d):
    s = F.array(F.col("value") / 100, (F.col("user_id") % 7).cast("double"), (F.col("event_id") % 5).cast("double"))
    return table(spark, d, "events").select("event_id", T.arg_max_label(s).alias("a")).select("event_id", "a.label", "a.prob")


@query("SELECT user_id, v > 0 AS is_vul, p >= s AS is_repaired FROM (SELECT user_id, count(*) FILTER (event_id % 3 = 0) AS v, sum(event_id) FILTER (event_id % 5 = 0) AS p, sum(event_id) FILTER (event_id % 5 = 1) AS s FROM events GROUP BY user_id)")
def legacy_verdicts(spark, d):
    e, k = F.col("event_id"), F.col("event_id") % 5
    g = table(spark, d, "events").groupBy("user_id").agg(F.count_if(e % 3 == 0).alias("vul_count"), F.sum(F.when(k == 0, e)).alias("patch_score"), F.sum(F.when(k == 1, e)).alias("vul_score"))
    return scoring.legacy_verdict(g).select("user_id", "is_vul", "is_repaired")


@query("""WITH c AS (SELECT conv_id, turn, len(string_split(text, ' ')) AS n, turn - 1 AS d FROM conversations), a AS (SELECT conv_id, n AS own FROM c WHERE d = 0),
r AS (SELECT c.*, own, row_number() OVER (PARTITION BY c.conv_id, d < 0 ORDER BY abs(d)) AS away FROM c JOIN a USING (conv_id) WHERE d <> 0),
o AS (SELECT *, own + coalesce(sum(n) OVER (PARTITION BY conv_id ORDER BY 2 * away - (d < 0)::int ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM r)
SELECT a.conv_id, (own + coalesce(sum(n) FILTER (before < 60), 0))::int AS n_items, coalesce(sum(n) FILTER (before < 60 AND d < 0), 0)::int AS answer_start, (coalesce(sum(n) FILTER (before < 60 AND d < 0), 0) + any_value(own) - 1)::int AS answer_end FROM a LEFT JOIN (SELECT conv_id, n, d, before FROM o) USING (conv_id) GROUP BY a.conv_id, own""")
def expanded_context(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", F.split("text", " ").alias("items"), (F.col("turn") == 1).alias("answer"))
    kept = c.join(c.filter("answer").select("conv_id"), "conv_id", "left_semi")
    e = ordered.expand_context(kept, ["conv_id"], "turn", "items", "answer", 60)
    return e.select("conv_id", F.size("items").alias("n_items"), F.col("answer_start").cast("int").alias("answer_start"), F.col("answer_end").cast("int").alias("answer_end"))


_OFFSETS = [(1, [0, 0, 0, 0, 0, 3, 5, 0], [0, 2, 0, 0, 3, 5, 9, 0], 3, 6), (2, [0], [0], -1, -1), (3, [0, 0, 0, 0, 4], [0, 0, 0, 4, 8], 0, 99)]
#: Each vendor looks for places that depend on its id.
_OFFSET_VALUES = "(SELECT vendor_id * 10 + id AS id, s, e, a + vendor_id % 5 AS a, b + vendor_id % 3 AS b FROM vendors, (VALUES " + ", ".join(f"({i}, {s}, {e}, {a}, {b})" for i, s, e, a, b in _OFFSETS) + ") t(id, s, e, a, b) WHERE vendor_id IS NOT NULL)"
_HOLDS = "list_position(list_transform(range(1, len(s) + 1), lambda i: i > m AND s[i] <= {0} AND {0} < e[i]), true) - 1"


@query(f"SELECT id, coalesce({_HOLDS.format('a')}, 0)::int AS first_token, coalesce({_HOLDS.format('b')}, 349)::int AS last_token FROM (SELECT *, coalesce(list_filter(range(1, len(s) + 1), lambda i: s[i] = 0 AND e[i] = 0)[3], 0) AS m FROM {_OFFSET_VALUES})")
def token_spans(spark, d):
    o = fixtures.filled(spark, d, _OFFSETS, "id int, s array<int>, e array<int>, a int, b int")
    o = o.select((F.col("row_id") * 10 + F.col("id")).alias("id"), "s", "e", (F.col("a") + F.col("row_id") % 5).alias("a"), (F.col("b") + F.col("row_id") % 3).alias("b")).withColumn("o", F.zip_with("s", "e", lambda x, y: F.struct(x.alias("s"), y.alias("e"))))
    return o.select("id", evaluation.token_span(F.col("o"), F.col("a"), F.col("b"), 350).alias("t")).select("id", F.col("t.start").alias("first_token"), F.col("t.end").alias("last_token"))


# ---- listings, paths, records ----


@query(f"""WITH l AS (SELECT *, last_value(CASE WHEN starts_with(line, 'Disassembly of section ') THEN regexp_extract(line, '^Disassembly of section (.*):$', 1) END IGNORE NULLS) OVER (PARTITION BY bin ORDER BY line_no) AS section FROM {fixtures.LISTING_SQL})
SELECT bin AS binary, line_no, line FROM (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY line_no) AS k FROM l WHERE section = '.text') WHERE k > 2""")
def listing_text_lines(spark, d):
    return listing.any_text_section(fixtures.listing(spark, d)).select("binary", "line_no", "line")


@query(rf"""{C._LONGEST_SQL}, o AS (SELECT *, sum((starts_with(line, '/root') OR starts_with(line, '/usr/'))::int) OVER (PARTITION BY bin, fno ORDER BY line_no) AS sno, starts_with(line, '/root') OR starts_with(line, '/usr/') AS opens, regexp_matches(line, '^\s*[0-9a-fA-F]+:') AS is_asm FROM f),
e AS (SELECT *, max(is_asm::int) OVER (PARTITION BY bin, fno, sno ORDER BY line_no) AS seen FROM o)
SELECT bin AS binary, name AS function_name, max(CASE WHEN opens THEN line END) AS line_position, coalesce(string_agg(line, '|' ORDER BY line_no) FILTER (seen = 0 AND NOT opens), '') AS src, string_agg(line, '|' ORDER BY line_no) FILTER (is_asm) AS asm FROM e GROUP BY bin, name, sno HAVING count(*) FILTER (is_asm) > 0""")
def listing_snippets(spark, d):
    s = listing.snippets(listing.split_functions(listing.text_section(fixtures.listing(spark, d)), last_wins=False), home="/root")
    return s.select("binary", "function_name", "line_position", joined("src_lines").alias("src"), joined("asm_lines").alias("asm"))


_PLACES = [(1, "/b/__tmp/./x/y.c:12"), (2, "a:b.c:7 (discriminator 3)"), (3, "a.c:?"), (4, "/root/__tmp/z.h: 9 ")]


@query(rf"""SELECT id, p AS path, try_cast(string_split(trim(q), ' ')[1] AS int) AS line_number, contains(trim(q), ' ') AS is_discriminator, regexp_replace(string_split(p, '__tmp/')[-1], '^\./', '') || '__f' AS key FROM (SELECT id, regexp_extract(t, '^(.*):([^:]*)$', 1) AS p, regexp_extract(t, '^(.*):([^:]*)$', 2) AS q FROM (SELECT row_id * 10 + id AS id, replace(replace(t, '12', row_id::varchar), 'y', own) AS t FROM {fixtures.filled_sql(_PLACES, 'id, t')}))""")
def line_positions(spark, d):
    t = F.replace(F.replace("t", F.lit("12"), F.col("row_id").cast("string")), F.lit("y"), F.col("own"))
    p = fixtures.filled(spark, d, _PLACES, "id int, t string").select((F.col("row_id") * 10 + F.col("id")).alias("id"), t.alias("t")).select("id", T.line_position(F.col("t")).alias("p"))
    return p.select("id", "p.path", "p.line_number", "p.is_discriminator", T.function_key(F.col("p.path"), F.lit("f")).alias("key"))


@query(r"SELECT c_custkey, regexp_replace(c_name, '^\s+|\s+$', '', 'g') AS c_name, nullif(round(c_acctbal, 0), 0) AS score FROM customer")
def trimmed_records(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.concat(F.lit(" "), "c_name", F.lit("\t")).alias("c_name"), F.round("c_acctbal", 0).cast("string").alias("score"))
    return T.trimmed_record(c, {"score": "double"})


@query("SELECT p_partkey, compiler, level FROM part, (SELECT unnest(['gcc', 'clang']) AS compiler), (SELECT unnest(['O0', 'O1', 'O2', 'O3']) AS level)")
def compile_jobs(spark, d):
    return files.compile_matrix(table(spark, d, "part").select("p_partkey"))


_DETAILS = [("CVE-1", "u1", "r1", "h1", "a.c", "f"), ("CVE-1", "u1", "r1", "h1", "a.c", "f"), ("CVE-1", "u2", "r2", "h2", "b.CPP", "g"), ("CVE-1", "u3", "", "h3", "c.c", "g"), ("CVE-2", "u4", "r4", "h4", "doc.md", "x"), ("CVE-2", "u5", "r5", None, "d.h", "x"), ("CVE-3", "u6", "r6", "h6", "e.hpp", "y")]


@query(f"SELECT public_id, string_agg(url || ':' || affected_file, ',' ORDER BY url) AS details FROM (SELECT DISTINCT public_id || '-' || (row_id % 50) AS public_id, url || own AS url, affected_file, raw, hunk_code, affected_function FROM {fixtures.filled_sql(_DETAILS, 'public_id, url, raw, hunk_code, affected_file, affected_function')} WHERE regexp_matches(affected_file, '\\.(c|cpp|h|hpp|cc|C|CPP|H|HPP|CC)$') AND raw <> '' AND hunk_code <> '') GROUP BY public_id")
def patch_detail_lists(spark, d):
    rows = fixtures.filled(spark, d, _DETAILS, files.DETAIL_JSON)
    rows = rows.withColumn("public_id", F.concat("public_id", F.lit("-"), (F.col("row_id") % 50).cast("string"))).withColumn("url", F.concat("url", "own")).drop("row_id", "own")
    p = files.patch_details(rows)
    return p.select("public_id", F.array_join(F.transform("details", lambda x: F.concat(x["url"], F.lit(":"), x["affected_file"])), ",").alias("details"))


# ---- vulnerability metadata: the library's own SQL, over views made of the driver's tables ----

_VIEWS = {
    "library": "SELECT n_nationkey AS id, n_name AS name, 'v' || n_regionkey AS vendor, 'p' AS platform, n_nationkey % 5 <> 4 AS is_valid FROM {nation}",
    "library_version": "SELECT c_custkey AS id, c_nationkey AS library_id, c_mktsegment AS version_number, c_custkey % 7 <> 0 AS is_valid FROM {customer}",
    "library_version_issue": "SELECT o_custkey AS library_version_id, o_orderkey AS security_issue_id, o_orderkey % 3 <> 0 AS is_valid FROM {orders}",
    "security_issue": "SELECT o_orderkey AS id, 'CVE-' || CAST(o_orderkey % 400 AS string) AS public_id, o_orderkey % 11 <> 0 AS is_valid FROM {orders}",
    "vulnerability": "SELECT p_partkey AS id, 'CVE-' || CAST(p_partkey % 400 AS string) AS public_id, p_partkey % 4 <> 0 AS is_valid FROM {part}",
    "patch_source": "SELECT p_partkey AS vulnerability_id, CASE WHEN p_partkey % 2 = 0 THEN 'https://github.com/a' ELSE 'https://example.org/b' END AS url FROM {part}",
    "patch": "SELECT p_partkey AS id, p_partkey AS vulnerability_id, p_name AS raw, p_partkey % 9 <> 0 AS is_valid FROM {part}",
    "patch_hunk": "SELECT p_partkey AS patch_id, p_brand AS hunk_code, p_type AS affected_file, CAST(p_size AS string) AS affected_function, 'v' AS vulnerable_code, 'p' AS patched_code FROM {part}",
}
_WITH = "WITH " + ", ".join(f"{k}_ AS ({C._plain(v).replace('AS string', 'AS varchar')})" for k, v in _VIEWS.items())


def _metadata(spark, d):
    relational.register(spark, {k: C.over(spark, d, v, v.split("{")[1][:-1]) for k, v in _VIEWS.items()})


_AFFECTED = "library_ l, library_version_ v, library_version_issue_ i, security_issue_ s WHERE v.library_id = l.id AND v.is_valid AND i.library_version_id = v.id AND s.id = i.security_issue_id AND s.is_valid"
_PATCHED = "vulnerability_ u, patch_source_ o, patch_ p, patch_hunk_ h WHERE u.is_valid AND o.vulnerability_id = u.id AND p.vulnerability_id = u.id AND p.is_valid AND h.patch_id = p.id"
_DETAIL = "url, raw, hunk_code, affected_file, affected_function, vulnerable_code, patched_code"


@query(f"{_WITH}, a AS (SELECT l.name, vendor, platform, l.id AS library_id, version_number, public_id FROM {_AFFECTED} AND l.id = 3), b AS (SELECT public_id, {_DETAIL} FROM {_PATCHED} AND url LIKE '%github%') SELECT a.*, {_DETAIL} FROM a JOIN b USING (public_id)")
def metadata_library_vulnerabilities(spark, d):
    _metadata(spark, d)
    return relational.library_vulnerabilities(spark, library=3)


@query(f"{_WITH} SELECT DISTINCT public_id, l.id AS library_id, l.name AS library_name, vendor, platform, v.id AS version_id, version_number FROM {_AFFECTED} AND l.id IN (2, 5)")
def metadata_affected_versions(spark, d):
    _metadata(spark, d)
    return relational.affected_versions(spark, [2, 5, 2])


@query(f"{_WITH} SELECT DISTINCT s.public_id, {_DETAIL} FROM security_issue_ s JOIN (SELECT public_id, {_DETAIL} FROM {_PATCHED}) USING (public_id) WHERE s.public_id IN ('CVE-1', 'CVE-2', 'CVE-33', 'CVE-150')")
def metadata_patch_details(spark, d):
    _metadata(spark, d)
    return relational.patch_details(spark, ["CVE-1", "CVE-2", "CVE-33", "CVE-150"])


@query(f"{_WITH} SELECT s.public_id, url FROM security_issue_ s JOIN (SELECT public_id, url FROM {_PATCHED}) USING (public_id) WHERE s.public_id IN (SELECT public_id FROM {_AFFECTED} AND l.id = 4)")
def metadata_patch_urls(spark, d):
    _metadata(spark, d)
    return relational.patch_urls_of_library(spark, 4)


@query(f"{_WITH} SELECT l.id AS library_id, l.name, vendor, platform, public_id, version_number FROM security_issue_ s, library_version_issue_ i, library_version_ v, library_ l WHERE s.id = i.security_issue_id AND public_id = 'CVE-7' AND i.is_valid AND i.library_version_id = v.id AND v.is_valid AND v.library_id = l.id AND l.is_valid")
def metadata_libraries(spark, d):
    _metadata(spark, d)
    return relational.libraries_of_vulnerability(spark, "CVE-7")


@query(f"{_WITH} SELECT count(DISTINCT public_id) AS vulnerabilities FROM {_AFFECTED} AND l.id IN (1, 2, 3)")
def metadata_count(spark, d):
    _metadata(spark, d)
    return relational.vulnerability_count(spark, [1, 2, 3])
