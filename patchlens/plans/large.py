"""Named queries of the operators that spread hot keys, over texts and the shop's tables, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from patchlens.operators import candidates, evaluation, ordered, sampling, scans, stats
from patchlens.plans import catalog as C

query, table, joined = C.query, C.table, C.joined

# ---- inequality joins bounded by a number of rows each ----

_WORDS = "len(string_split(text, ' '))"


@query(f"""SELECT doc_id, item_id, n, nth::int AS nth FROM (SELECT i.item_id, d.doc_id, d.n, row_number() OVER (PARTITION BY i.item_id ORDER BY d.n, d.doc_id) AS nth
FROM (SELECT item_id, {_WORDS} AS n, len(string_split(text, ',')) - 1 AS commas FROM benchmark) i JOIN (SELECT doc_id, {_WORDS} AS n, len(string_split(text, ',')) - 1 AS commas FROM documents) d ON d.n > i.n AND d.commas = i.commas) WHERE nth <= 5""")
def pair_candidates_closest(spark, d):
    """Texts in place of functions: words for lines and instructions, commas for parameters."""
    sized = lambda t, i, n: table(spark, d, t).select(i, F.size(F.split("text", " ")).alias(n), (F.size(F.split("text", ",")) - 1).alias("commas"))
    found = scans.following(sized("benchmark", "item_id", "m"), sized("documents", "doc_id", "n"), ["commas"], "m", "n", "doc_id", 5, [])
    return found.select("doc_id", "item_id", "n", "nth")


@query(f"""SELECT doc_id, item_id, nth::int AS nth FROM (SELECT d.doc_id, i.item_id, row_number() OVER (PARTITION BY d.doc_id ORDER BY i.n, i.item_id) AS nth
FROM (SELECT doc_id, {_WORDS} AS n FROM documents) d JOIN (SELECT item_id, {_WORDS} AS n FROM benchmark) i ON i.n > d.n) WHERE nth <= 3""")
def longer_items(spark, d):
    """One key for all rows: the sides are spread by length alone."""
    sized = lambda t, i, n: table(spark, d, t).select(i, F.size(F.split("text", " ")).alias(n))
    return scans.following(sized("documents", "doc_id", "m"), sized("benchmark", "item_id", "n"), [], "m", "n", "item_id", 3, []).select("doc_id", "item_id", "nth")


@query("""SELECT change_id, sale_id, sold_at, nth::int AS nth FROM (SELECT c.change_id, s.sale_id, s.sold_at, row_number() OVER (PARTITION BY c.change_id, c.client_id, c.valid_at ORDER BY s.sold_at, s.sale_id) AS nth
FROM (SELECT DISTINCT change_id, client_id, valid_at FROM client_changes) c JOIN (SELECT DISTINCT sale_id, client_id, sold_at FROM sales) s ON s.client_id = c.client_id AND s.sold_at > c.valid_at) WHERE nth <= 2""")
def sales_after_change(spark, d):
    c = table(spark, d, "client_changes").select("change_id", "client_id", "valid_at").distinct()
    s = table(spark, d, "sales").select("sale_id", "client_id", "sold_at").distinct()
    return scans.following(c, s, ["client_id"], "valid_at", "sold_at", "sale_id", 2, []).select("change_id", "sale_id", "sold_at", "nth")


# ---- containment of many strings ----

_NEEDLES = """SELECT DISTINCT needle FROM (SELECT w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS needle FROM (SELECT w, unnest(range(1, len(w) - 1)) AS i FROM (SELECT string_split(text, ' ') AS w FROM benchmark)))"""


@query(f"SELECT doc_id, count(*) AS n_needles, min(needle) AS first_needle FROM documents d JOIN ({_NEEDLES}) n ON contains(d.text, n.needle) GROUP BY doc_id")
def containment_many(spark, d):
    """Every three words of the benchmark in every document."""
    w = F.split("text", " ")
    three = F.transform(F.sequence(F.lit(0), F.size("w") - 3), lambda i: F.array_join(F.slice("w", i + 1, F.lit(3)), " "))
    needles = table(spark, d, "benchmark").select(w.alias("w")).filter(F.size("w") >= 3).select(F.explode(three).alias("needle")).distinct()
    found = candidates.contained(needles, table(spark, d, "documents").select("doc_id", "text"), "needle", "text", ["doc_id"])
    return found.groupBy("doc_id").agg(F.count("*").alias("n_needles"), F.min("needle").alias("first_needle"))


@query("""SELECT doc_id, (SELECT string_agg(s, '|' ORDER BY length(s), k) FROM (SELECT s, k FROM (SELECT unnest(w) AS s, generate_subscripts(w, 1) AS k) a
  WHERE NOT EXISTS (SELECT 1 FROM (SELECT unnest(w) AS s, generate_subscripts(w, 1) AS k) b WHERE contains(b.s, a.s) AND (length(b.s) > length(a.s) OR b.k > a.k)))) AS kept
FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL) WHERE len(w) > 0""")
def subsumed_lines(spark, d):
    """The lines of every document by length, without those that another one holds."""
    lines = table(spark, d, "documents").select("doc_id", F.filter(F.split("text", "\n"), lambda x: x != "").alias("w")).filter(F.size("w") > 0)
    return ordered.drop_subsumed(lines, "doc_id", "w").select("doc_id", joined("w").alias("kept"))


# ---- lookups over ranges ----


@query("""WITH o AS (SELECT o_orderkey AS k, o_orderpriority AS file, epoch(o_orderdate::timestamp)::bigint // 86400 AS n FROM orders), l AS (SELECT file, n, max(k) AS t FROM o GROUP BY 1, 2)
SELECT o.k AS order_id, CASE WHEN bool_or(l.n = o.n - 20) THEN max(l.t) END AS time FROM o LEFT JOIN l ON l.file = o.file AND l.n BETWEEN o.n - 20 AND o.n + 40 GROUP BY o.k""")
def latest_change_overlapping(spark, d):
    """Spans of 61 days that overlap, one an order, over few and large files."""
    day = F.floor(F.unix_seconds(F.col("o_orderdate").cast("timestamp")) / 86400)
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("time"), F.col("o_orderpriority").alias("file"), day.alias("line_no"))
    spans = o.select("file", F.col("time").alias("order_id"), (F.col("line_no") - 20).alias("start"), (F.col("line_no") + 40).alias("end"))
    return candidates.latest_change(spans, o).select("order_id", "time")


# ---- running values over hot keys ----


@query("""WITH c AS (SELECT DISTINCT client_id, ts, click_id, kind FROM clicks), e AS (SELECT *, CASE WHEN lag(click_id) OVER w IS NOT NULL AND kind IS NOT DISTINCT FROM lag(kind) OVER w THEN 0 ELSE 1 END AS new FROM c WINDOW w AS (PARTITION BY client_id ORDER BY ts NULLS FIRST, click_id)),
r AS (SELECT *, sum(new) OVER (PARTITION BY client_id ORDER BY ts NULLS FIRST, click_id ROWS UNBOUNDED PRECEDING) AS run FROM e)
SELECT client_id, run::bigint AS run_id, min(kind) AS kind, count(*) AS n, min(click_id) AS first_id FROM r GROUP BY client_id, run""")
def click_runs(spark, d):
    c = table(spark, d, "clicks").select("client_id", "ts", "click_id", "kind").distinct()
    r = ordered.adjacent_runs(c, ["client_id"], ["ts", "click_id"], "kind")
    return r.groupBy("client_id", "run_id").agg(F.min("kind").alias("kind"), F.count("*").alias("n"), F.min("click_id").alias("first_id"))


@query("""SELECT sale_id, client_id, sum(total::decimal(18, 2)) OVER w AS spent, max(total) OVER w AS most, last_value(status IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS status_before
FROM (SELECT DISTINCT sale_id, client_id, sold_at, arrived_at, status, total, priority FROM sales) WINDOW w AS (PARTITION BY client_id ORDER BY sold_at NULLS FIRST, sale_id, arrived_at NULLS FIRST, status NULLS FIRST, total NULLS FIRST, priority NULLS FIRST)""".replace("OVER w AS spent", "OVER (w ROWS UNBOUNDED PRECEDING) AS spent").replace("OVER w AS most", "OVER (w ROWS UNBOUNDED PRECEDING) AS most"))
def client_running_totals(spark, d):
    s = table(spark, d, "sales").select("sale_id", "client_id", "sold_at", "arrived_at", "status", "total", "priority").distinct()
    order = ["sold_at", "sale_id", "arrived_at", "status", "total", "priority"]
    r = scans.in_ranges(s, ["client_id"], order)
    r = scans.folded(r, ["client_id"], {"spent": ("sum", F.col("total").cast("decimal(18,2)")), "most": ("max", F.col("total"))})
    r = scans.folded(r, ["client_id"], {"status_before": ("last", F.col("status"))}, before=True)
    return r.select("sale_id", "client_id", "spent", "most", "status_before")


@query("""SELECT doc_id, n_chars FROM (SELECT doc_id, n_chars, sum(n_chars) OVER (ORDER BY n_chars DESC, doc_id ROWS UNBOUNDED PRECEDING) AS s, (SELECT sum(n_chars) // 2 FROM documents) AS budget FROM documents WHERE n_chars <= 100000) WHERE s <= budget""")
def files_within_budget(spark, d):
    """The largest documents of at most 100,000 characters that together have half of all."""
    t = table(spark, d, "documents").select("doc_id", "n_chars")
    return stats.files_within(t, "n_chars", "doc_id", 100_000, (t.agg(F.sum("n_chars")).first()[0] or 0) // 2)


# ---- evaluation at all thresholds ----

_ALL = """g AS (SELECT s, count(*) FILTER (t) AS tt, count(*) FILTER (NOT t) AS tf FROM e WHERE s IS NOT NULL AND t IS NOT NULL GROUP BY s),
r AS (SELECT s AS threshold, sum(tt) OVER w AS tp, sum(tf) OVER w AS fp, (SELECT count(*) FROM e WHERE t) AS p, (SELECT count(*) FROM e WHERE NOT t) AS n, tt, tf FROM g WINDOW w AS (ORDER BY s DESC ROWS UNBOUNDED PRECEDING))"""
_SCORED_EVENTS = "e AS (SELECT round(value) AS s, event_type = 'purchase' AS t FROM events)"


def _scored_events(spark, d):
    return table(spark, d, "events").select(F.round("value").alias("s"), (F.col("event_type") == "purchase").alias("t"))


@query(f"WITH {_SCORED_EVENTS}, {_ALL} SELECT threshold, tp::bigint AS tp, fp::bigint AS fp, (n - fp)::bigint AS tn, (p - tp)::bigint AS fn, tt AS tied_true, tf AS tied_false FROM r")
def confusion_of_thresholds(spark, d):
    return evaluation.thresholds(_scored_events(spark, d), F.col("t"), "s")


_DOC_SCORES = "e AS (SELECT n_chars AS s, quality = 1 AS t FROM documents JOIN labels USING (doc_id))"


@query(f"""WITH {_DOC_SCORES}, {_ALL}, f AS (SELECT *, 2 * tp / (2 * tp + fp + p - tp)::double AS f1 FROM r)
SELECT sum(tf * (tp - tt / 2.0::double))::double / (max(p)::double * max(n)) AS auc, max(f1) AS best_f1, (SELECT max(threshold) FROM f WHERE f1 = (SELECT max(f1) FROM f)) AS best_threshold, count(*) AS n_thresholds FROM f""")
def ranking_quality(spark, d):
    j = table(spark, d, "documents").select("doc_id", "n_chars").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id")
    return evaluation.ranking_quality(evaluation.thresholds(j, F.col("quality") == 1, "n_chars"))


# ---- exact distinct counts ----


@query("SELECT kind, count(DISTINCT client_id)::bigint AS clients FROM clicks WHERE client_id IS NOT NULL GROUP BY kind UNION ALL SELECT 'all kinds', count(DISTINCT client_id)::bigint FROM clicks")
def distinct_clients(spark, d):
    """By kind, and of all kinds from the same bitmaps."""
    b = stats.distinct_bitmaps(table(spark, d, "clicks"), ["kind"], "client_id")
    every = stats.distinct_counts(stats.merged_bitmaps(b, []), [], "clients").select(F.lit("all kinds").alias("kind"), F.coalesce("clients", F.lit(0)).cast("long").alias("clients"))
    return stats.distinct_counts(b, ["kind"], "clients").unionByName(every)


# ---- training texts and partners ----

_GROWN = "concat('[SRC_CODE] ', array_to_string(s[:l], ' '), ' [SEP] [ASM_CODE] ', array_to_string(s[:o], ' '))"
_BRIEF = "CASE WHEN length(s[least(l + 1, n)]) = 1 OR s[least(l + 1, n)] = '\"STR\"' THEN 2 ELSE 1 END"


@query(f"""WITH RECURSIVE d AS (SELECT doc_id, w[:1003] AS s, len(w) AS n FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents WHERE text IS NOT NULL)),
g AS (SELECT doc_id, s, n, 0 AS t, 1 AS l, 3 AS o FROM d UNION ALL SELECT doc_id, s, n, t + 1, l + {_BRIEF}, o + 1 FROM g WHERE l <= n AND o <= n AND (t = 0 OR length({_GROWN}) <= 1000))
SELECT doc_id, arg_max({_GROWN}, t) AS train_text FROM g GROUP BY doc_id""")
def document_train_texts(spark, d):
    """The words of a document as its lines and as its instructions."""
    w = F.split("text", " ")
    return table(spark, d, "documents").filter("text is not null").select("doc_id", sampling.train_text(w, w).alias("train_text"))


_DRAWN = "(('0x' || md5('0:' || doc_id::varchar || ':0')[1:8])::ubigint % n)"


@query(f"""WITH r AS (SELECT doc_id, source, lang, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) - 1 AS k, count(*) OVER (PARTITION BY source, lang) AS n FROM documents)
SELECT r.doc_id, o.doc_id AS partner_id FROM r JOIN r o ON o.source IS NOT DISTINCT FROM r.source AND o.lang IS NOT DISTINCT FROM r.lang AND o.k = {_DRAWN.replace("doc_id", "r.doc_id").replace("% n", "% r.n")}""")
def random_partners(spark, d):
    t = table(spark, d, "documents").select("doc_id", "source", "lang", "n_chars")
    return sampling.random_partners(t, "doc_id", ["source", "lang"], "n_chars").select("doc_id", "partner_id")


@query()
def dissimilar_clients(spark, d):
    """Three clients of the same nation with quite another name; no SQL for the similarity, see the tests."""
    c = table(spark, d, "clients").select("client_id", "name", "nation_id").filter("client_id is not null").dropDuplicates(["client_id"])
    return sampling.dissimilar(c, "client_id", "name", ["nation_id"], 3, 0.6, exact=False).select("client_id", "partner_id")


@query("""WITH t AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, w, i, w[i] AS a, w[i + 1] AS b FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM t)),
o AS (SELECT *, coalesce(list_max(list_filter(range(0, least(length(a), length(b)) + 1), lambda k: left(b, k) = right(a, k))), 0) AS n FROM p)
SELECT doc_id, coalesce(string_agg(a, '|' ORDER BY i) FILTER (n <= 2), '') AS kept FROM o GROUP BY doc_id""")
def overlapped_lines(spark, d):
    """Lines of documents whose end isn't the next one's start by more than two characters."""
    w = F.filter(F.split("text", "\n"), lambda x: x != "")
    t = table(spark, d, "documents").filter("text is not null").select("doc_id", w.alias("w")).filter(F.size("w") > 0)
    return ordered.drop_overlapped(t, "doc_id", "w", 2).select("doc_id", joined("w").alias("kept"))
