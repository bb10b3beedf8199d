"""Operators that spread hot keys, against plain loops, with few rows a range so that keys span many."""

from __future__ import annotations

import difflib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from patchlens.operators import candidates, containing, evaluation, ordered, sampling, scans, stats
from patchlens.plans import relational


@pytest.mark.parametrize("hot", [False, True])
def test_running_folds(spark, hot):
    r = random.Random(1)
    rows = [("a" if hot and r.random() < 0.9 else r.choice([None, "a", "b", "c"]), r.choice([None, *range(300)]), i, r.choice([None, 1, 2, 3])) for i in range(900)]
    d = spark.createDataFrame(rows, "k string, o int, i int, v int").repartition(5)
    for before in (False, True):
        folds = {"s": ("sum", F.col("v")), "m": ("max", F.col("v")), "n": ("min", F.col("v")), "l": ("last", F.col("v")), "p": ("last", F.struct("v"))}
        got = {x.i: (x.s, x.m, x.n, x.l, x.p and (x.p.v,)) for x in scans.running(d, ["k"], ["o", "i"], folds, before, rows_per_range=70).collect()}
        want = {}
        for k in {x[0] for x in rows}:
            seen, last = [], None
            for x in sorted((x for x in rows if x[0] == k), key=lambda x: (x[1] is not None, x[1] or 0, x[2])):
                now = seen + [x[3]] * (x[3] is not None)
                of, prev = (seen, last) if before else (now, (x[3],))
                want[x[2]] = (sum(of) if of else None, max(of, default=None), min(of, default=None), of[-1] if of else None, prev)
                seen, last = now, (x[3],)
        assert got == want


def test_ranges_of_a_hot_key_are_even(spark):
    d = spark.range(3000).select(F.lit("one").alias("k"), F.col("id").alias("o"))
    sizes = [x["count"] for x in scans.in_ranges(d, ["k"], ["o"], 200).groupBy(scans.RANGE).count().collect()]
    assert len(sizes) == 15 and max(sizes) <= 2 * 200


def test_running_of_no_rows(spark):
    d = spark.createDataFrame([], "k string, o int, v int")
    assert scans.running(d, ["k"], ["o"], {"s": ("sum", F.col("v"))}).collect() == []
    assert ordered.adjacent_runs(d, ["k"], ["o"], "v").collect() == []


def test_runs_of_one_key_over_many_ranges(spark):
    r = random.Random(2)
    rows = [(None if r.random() < 0.1 else 1, i, r.choice(["x", "x", "x", "y", None]), r.random() < 0.8) for i in range(700)]
    d = spark.createDataFrame(rows, "k int, o int, v string, ok boolean").repartition(3)
    for joins in (None, F.col("ok")):
        got = {(x.k, x.o): x.run_id for x in ordered.adjacent_runs(d, ["k"], ["o"], "v", joins, rows_per_range=50).collect()}
        want = {}
        for k in (None, 1):
            run, last = 0, ()
            for _, o, v, ok in sorted((x for x in rows if x[0] == k), key=lambda x: x[1]):
                run += not (last == (v,) and (ok or joins is None))
                want[k, o] = run
                last = (v,)
        assert got == want


def test_context_over_stretches(spark):
    r = random.Random(3)
    rows = [(r.choice([1, 1, 1, None]), r.choice([None, *range(-60, 200)]), f"t{i}") for i in range(300)]
    d = spark.createDataFrame(rows, "k int, n int, t string")
    one = sorted((str(x.k), str(x.n), x.t, sorted(x.before), sorted(x.after)) for x in ordered.context_rows(d, ["k"], "n", "t", 3, width=7).collect())
    near = lambda x, a, b: sorted(t for k, n, t in rows if k == x[0] and (n is None and x[1] is None or None not in (n, x[1]) and x[1] + a <= n <= x[1] + b))
    assert one == sorted((str(x[0]), str(x[1]), x[2], near(x, -3, -1), near(x, 1, 3)) for x in rows)


@pytest.mark.parametrize("hot", [5, 10_000])
def test_following_rows(spark, hot):
    r = random.Random(4)
    left = [(i, r.choice(["x", "x", "y", None]), r.choice([None, *range(30)])) for i in range(400)]
    right = [(1000 + i, r.choice(["x", "y", "z", None]), r.choice([None, *range(25)])) for i in range(200)]
    l, q = spark.createDataFrame(left + left[:9], "i int, g string, a int"), spark.createDataFrame(right, "j int, g string, b int").withColumn("w", F.col("j") * 2)
    got = sorted((x.i, x.nth, x.j, x.b, x.w) for x in scans.following(l, q, ["g"], "a", "b", "j", 3, ["w"], rows_per_range=60, hot=hot).collect())
    later = lambda g, a: sorted((b, j) for j, h, b in right if h == g and b is not None and b > a)[:3]
    assert got == sorted((i, n, j, b, 2 * j) for i, g, a in left + left[:9] if g is not None and a is not None for n, (b, j) in enumerate(later(g, a), 1))
    none = scans.following(l.limit(0), q, ["g"], "a", "b", "j", 3, [])
    assert none.columns == ["i", "g", "a", "b", "j", "nth"] and none.collect() == []


def test_closest_pairs_are_the_first_of_all_pairs(spark):
    from patchlens.plans import fixtures

    s = spark.createDataFrame([(f"s{i}", t.split("\n")) for i, t in fixtures.SOURCES], "src_name string, src_codes array<string>")
    b = spark.createDataFrame([(f"{n}{k}", c + ["nop"] * k) for n, c in fixtures.BINARY for k in range(4)], "bin_name string, asm_codes array<string>")
    every = candidates.candidate_pairs(s, b, whole=True).select("src_name", "bin_name", F.size("asm").alias("n")).collect()
    few = {(x.src_name, x.bin_name) for x in candidates.candidate_pairs(s, b, closest=2).collect()}
    want = set()
    for name in {x.src_name for x in every}:
        want |= {(name, x.bin_name) for x in sorted((x for x in every if x.src_name == name), key=lambda x: (x.n, x.bin_name))[:2]}
    assert few == want and want


@pytest.mark.parametrize(("chars", "shards"), [(1 << 21, 8), (40, 100), (40, 1)])
def test_occurring_strings(spark, monkeypatch, chars, shards):
    r = random.Random(5)
    texts = [(i, r.choice([None, "".join(r.choices("ab é", k=r.randint(0, 40)))])) for i in range(150)] + [(900, ""), (901, "a" * 5000)]
    needles = [(i, "".join(r.choices("ab é", k=r.randint(0, 4)))) for i in range(60)] + [(99, None), (98, ""), (97, "aé")]
    t, n = spark.createDataFrame(texts, "i int, text string").repartition(3), spark.createDataFrame(needles, "n int, s string")
    monkeypatch.setattr(containing, "TOGETHER", 100)
    want = sorted((i, k) for i, x in texts if x is not None for k, s in needles if s is not None and s in x)
    found = containing.occurring(n, "s", t, "text", ["i"], shard_chars=chars, shards=shards)
    assert (found is None) == (shards == 1)
    if found is not None:
        assert sorted((x.i, x.n) for x in containing.matched(n, found, "s").select("i", "n").collect()) == want
    assert sorted((x.i, x.n) for x in candidates.contained_by_words(n.filter("s is not null"), t.filter("text is not null"), "s", "text").collect()) == want


def test_contained_needs_no_join_on_words(spark):
    t, n = spark.createDataFrame([(1, "x y z")], "i int, text string"), spark.createDataFrame([(7, "y z")], "n int, s string")
    plan = candidates.contained(n, t, "s", "text", ["i"])._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Generate" not in plan


def test_subsumption_of_odd_lists(spark):
    rows = [(1, None), (2, []), (3, ["", ""]), (4, ["a", None, "", "a"]), (5, ["ab", "b", "ab", "xabx"]), (6, ["é", "éé", "x" * 20_000, "xx"])]
    got = {x.i: x.l for x in ordered.drop_subsumed(spark.createDataFrame(rows, "i int, l array<string>"), "i", "l").collect()}
    assert got == {1: None, 2: [], 3: [""], 4: ["a"], 5: ["xabx"], 6: ["éé", "x" * 20_000]}


def test_latest_change_of_overlapping_spans(spark):
    r = random.Random(6)
    lines = [(r.choice(["f", "f", "g", None]), r.choice([None, *range(-40, 300)]), r.choice([None, *range(1000)])) for _ in range(400)]
    spans = [(r.choice(["f", "g", "h", None]), (a := r.randint(-50, 310)), r.choice([a, a + r.randint(0, 9), a + r.randint(0, 400), a - 3, None])) for _ in range(300)]
    got = sorted((str(x.file), x.start, str(x.end), str(x.time)) for x in candidates.latest_change(spark.createDataFrame(spans, "file string, start int, end int"), spark.createDataFrame(lines, "file string, line_no int, time int")).collect())
    want = []
    for f, a, b in spans:
        own = [t for g, n, t in lines if f is not None and g == f and n is not None and b is not None and a <= n <= b]
        first = any(g == f and n == a for g, n, _ in lines) and f is not None
        times = [t for t in own if t is not None]
        want.append((str(f), a, str(b), str(max(times) if first and times else None)))
    assert got == sorted(want)


def test_rows_within_a_budget(spark):
    d = spark.createDataFrame([(i, s) for i, s in enumerate([5, 3, 9, None, 1, 7, 3, 20])], "id int, size int")
    got = sorted(x.id for x in stats.files_within(d, "size", "id", most=10, total=24, rows_per_range=2).collect())
    assert got == [0, 1, 2, 5]
    assert stats.files_within(d, "size", "id", most=10, total=8).collect() == []


def test_thresholds_and_area(spark):
    r = random.Random(7)
    rows = [(r.choice([None, *range(12)]), r.choice([True, False, False, None])) for _ in range(400)]
    c = evaluation.thresholds(spark.createDataFrame(rows, "s int, t boolean"), F.col("t"), "s", rows_per_range=3)
    known = [x for x in rows if x[1] is not None]
    p, n = sum(t for _, t in known), sum(not t for _, t in known)
    want = {}
    for at in {s for s, _ in known if s is not None}:
        tp, fp = (sum(s is not None and s >= at and t is v for s, t in known) for v in (True, False))
        want[at] = (tp, fp, n - fp, p - tp)
    assert {x.threshold: (x.tp, x.fp, x.tn, x.fn) for x in c.collect()} == want
    q = evaluation.ranking_quality(c).first()
    real = [(s, t) for s, t in known if s is not None]
    wins = sum((a > b) + (a == b) / 2 for a, t in real for b, u in real if t and not u)
    f1 = {at: 2 * tp / (2 * tp + fp + fn) for at, (tp, fp, _, fn) in want.items()}
    assert q.auc == pytest.approx(wins / (p * n)) and q.best_f1 == max(f1.values()) and q.best_threshold == max(a for a in f1 if f1[a] == q.best_f1)


def test_distinct_by_bitmaps(spark):
    r = random.Random(8)
    rows = [(r.choice(["a", "a", "b", None]), r.choice([None, r.randint(-5, 5), r.randint(0, 10**12), r.randint(32760, 32780)])) for _ in range(600)]
    b = stats.distinct_bitmaps(spark.createDataFrame(rows, "k string, v long"), ["k"], "v")
    got = {x.k: x.n_distinct for x in stats.distinct_counts(b, ["k"]).collect()}
    assert got == {k: len({v for g, v in rows if g == k and v is not None}) for k in ("a", "b", None)}
    assert stats.distinct_counts(stats.merged_bitmaps(b, []), []).first()[0] == len({v for _, v in rows if v is not None})


def test_long_overlaps(spark):
    r = random.Random(9)
    words = ["".join(r.choices("ab", k=r.randint(0, 30))) * r.randint(1, 6) for _ in range(400)] + ["a" * 30_000, "a" * 30_000 + "b", "é😀" * 40, "😀é"]
    plain = lambda a, b: max(k for k in range(min(len(a), len(b)) + 1) if a[len(a) - k :] == b[:k])
    for a, b in zip(words[:400], words[1:401]):
        assert ordered.longest_overlap(a, b) == (plain(a, b) if len(b) < 1000 else ordered.longest_overlap(a, b))
    assert ordered.longest_overlap("a" * 200_000, "a" * 100_000 + "b") == 100_000 and ordered.longest_overlap("", "x") == ordered.longest_overlap("x", "") == 0
    lists = [(i, words[i * 7 : i * 7 + 7]) for i in range(57)] + [(98, None), (99, [])]
    d = spark.createDataFrame(lists, "i int, l array<string>")
    for merge in (False, True):
        jvm, python = ({x.i: x.l for x in ordered.drop_overlapped(d, "i", "l", 2, merge, short=n).collect()} for n in (10_000, 0))
        assert jvm == python and jvm[98] is None and jvm[99] == []


def test_bounds_of_similarity(spark):
    r = random.Random(10)
    text = lambda: r.choice([None, "".join(r.choices("abcé😀 ", k=r.randint(0, 30)))])
    rows = [(i, text(), text()) for i in range(300)]
    for x in spark.createDataFrame(rows, "i int, a string, b string").select("a", "b", sampling.ratio_bound(F.col("a"), F.col("b")).alias("q"), sampling.length_bound(F.col("a"), F.col("b")).alias("l")).collect():
        m = difflib.SequenceMatcher(None, x.a or "", x.b or "")
        assert x.q == pytest.approx(m.quick_ratio()) and x.l == pytest.approx(m.real_quick_ratio()) and m.ratio() <= x.q + 1e-12 <= x.l + 2e-12


def test_bounds_spare_comparisons(spark, monkeypatch):
    r = random.Random(11)
    rows = [(i, "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randint(5, 60)))) for i in range(200)]
    d = spark.createDataFrame(rows, "i int, t string").withColumn("g", F.col("i") % 2)
    compared = spark.sparkContext.accumulator(0)

    def counting(autojunk=True):
        @F.pandas_udf("double")
        def ratio(a, b):
            compared.add(len(a))
            return a.combine(b, lambda x, y: difflib.SequenceMatcher(None, x, y, autojunk).ratio())

        return ratio

    both = {x: {(y.i, y.partner_id) for y in sampling.dissimilar(d, "i", "t", ["g"], 3, 0.9, exact=x).collect()} for x in (True, False)}
    assert both[True] == both[False] and len(both[True]) == 600
    monkeypatch.setattr(sampling, "ratio_udf", counting)
    sampling.dissimilar(d, "i", "t", ["g"], 3, 0.9, exact=False).collect()
    assert compared.value < 200 * 8 / 10


def _made_by_joins(df):
    """Rows of a plan's joins as it ran, the most of any of them."""
    found, left = [], [df._jdf.queryExecution().executedPlan()]
    while left:
        p = left.pop()
        kind = p.getClass().getSimpleName()
        left += [p.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [p.plan()] if kind.endswith("QueryStageExec") else [p.children().apply(i) for i in range(p.children().size())]
        if kind.endswith("JoinExec"):
            found.append(p.metrics().apply("numOutputRows").value())
    return max(found)


def _hot_id(spark):
    """One id with 300 issues and 200 patches of two texts, others with few, none or no id."""
    issues = [(i, "CVE-1", i % 7 > 0) for i in range(300)] + [(900, "CVE-2", True), (901, None, True), (902, "CVE-3", True), (903, "CVE-4", False)]
    known = [(i, "CVE-1", True) for i in range(200)] + [(500, "CVE-2", True), (501, None, True), (502, "CVE-9", True), (503, "CVE-3", False), (504, "CVE-4", True), (505, "CVE-2", None)]
    sources = [(i, f"https://{'github.com' if i % 4 else 'a.org'}/{i % 2}") for i, _, _ in known] + [(0, "https://github.com/0"), (500, None)]
    patches = [(1000 + i, i, None if i % 2 else "raw", i % 5 > 0) for i, _, _ in known] + [(3000, 500, "raw", True)]
    hunks = [(i, "h", "a.c", None, "x", "y") for i, _, _, _ in patches] + [(1001, "h", "a.c", None, "x", "y")]
    versions = [(10, 1, "1.0", True), (11, 1, "1.0", True), (12, 1, None, True), (13, 1, "2.0", False), (20, 2, "2.0", True)]
    rows = {
        "library": [(1, "ssl", "v", None, True), (2, "xml", "w", "p", True)],
        "library_version": versions,
        "library_version_issue": [(10 + i % 4, i, True) for i, _, _ in issues] + [(10, 1, None), (20, 902, True)],
        "security_issue": issues, "vulnerability": known, "patch_source": sources, "patch": patches, "patch_hunk": hunks,
    }
    relational.register(spark, {k: spark.createDataFrame(v, relational.VIEWS[k]) for k, v in rows.items()})
    valid = {x[0]: x[1] for x in issues if x[2] and x[1]}  # a null id meets none
    own = {x[0]: x for x in versions if x[1] == 1 and x[3]}
    affected = [(own[v][2], valid[i]) for v, i, _ in rows["library_version_issue"] if v in own and i in valid]
    patched = [(c, url, raw, *h[1:]) for u, c, ok in known if ok for o, url in sources if o == u for p, of, raw, good in patches if of == u and good for h in hunks if h[0] == p]
    return issues, affected, patched


def test_urls_of_an_id_of_many_issues_and_patches(spark):
    issues, affected, patched = _hot_id(spark)
    found = relational.patch_urls_of_library(spark, 1)
    ids = {c for _, c in affected}
    want = Counter((c, p[1]) for _, c, _ in issues if c in ids for p in patched if p[0] == c)
    assert Counter((x.public_id, x.url) for x in found.collect()) == want and sum(want.values()) > 40_000
    assert _made_by_joins(found) <= 310
    shares = [x["count"] for x in found.groupBy(F.spark_partition_id()).count().collect()]
    assert len(shares) == 4 and max(shares) < 0.3 * sum(shares)  # the one id's rows are dealt to all tasks


def test_details_of_an_id_of_many_issues_and_patches(spark):
    issues, _, patched = _hot_id(spark)
    found = relational.patch_details(spark, ["CVE-1", "CVE-2", "CVE-9"])
    ids = {c for _, c, _ in issues} & {"CVE-1", "CVE-2", "CVE-9"}
    got = found.collect()
    assert len(got) == len(set(got)) and {tuple(x) for x in got} == {p for p in patched if p[0] in ids}
    assert _made_by_joins(found) <= 310


def test_patches_of_a_library_of_many_issues_and_patches(spark, monkeypatch):
    _, affected, patched = _hot_id(spark)
    want = Counter(("ssl", "v", None, 1, version, *p) for version, c in affected for p in patched if p[0] == c and p[1] and "github" in p[1])
    for piece in (1024, 7):
        monkeypatch.setattr(relational, "PIECE", piece)
        found = relational.library_vulnerabilities(spark, library=1)
        assert Counter(tuple(x) for x in found.collect()) == want and sum(want.values()) > 10_000
        assert _made_by_joins(found) <= 310


def _dealt(df):
    """Rows that a plan's shuffles wrote as it ran."""
    found, left = 0, [df._jdf.queryExecution().executedPlan()]
    while left:
        p = left.pop()
        kind = p.getClass().getSimpleName()
        left += [p.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [p.plan()] if kind.endswith("QueryStageExec") else [p.children().apply(i) for i in range(p.children().size())]
        if kind == "ShuffleExchangeExec":
            found += p.metrics().apply("shuffleRecordsWritten").value()
    return found


def test_copies_are_dealt_in_few_shares(spark):
    counts = {"hot": 30_000_001, "warm": 262_145, "few": 3, "one": 1, "piece": 1024, "more": 1025, "less": 1023, "none": 0, "null": None}
    made = relational._repeated(spark.createDataFrame(list(counts.items()), "k string, times bigint").coalesce(1), "times")
    assert made.columns == ["k"]
    found = made.groupBy("k", F.spark_partition_id().alias("task")).count()
    rows = found.collect()
    total = Counter()
    for r in rows:
        total[r.k] += r["count"]
    assert total == {k: c for k, c in counts.items() if c}
    hot = [r["count"] for r in rows if r.k == "hot"]
    assert len(hot) == 4 and max(hot) < 0.3 * sum(hot)
    # some 29,300 pieces of 1,024 before; now 64 shares a task, their rest, the other rows, and the groups of the count
    assert _dealt(found) < 1_000


def test_a_share_is_not_held_whole(spark):
    """Generated code holds all rows it makes of one of its input rows, so what makes pieces and what makes copies may not share it."""
    made = relational._repeated(spark.createDataFrame([("hot", 30_000_001)], "k string, times bigint"), "times")
    found = made.groupBy("k").count()
    assert [tuple(x) for x in found.collect()] == [("hot", 30_000_001)]
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    copies, pieces, _ = [x.split("Generate explode")[0].strip(" :+-") for x in plan.splitlines() if "Generate explode" in x]
    assert copies.startswith("*(") and pieces != copies, plan


@pytest.mark.parametrize(("piece", "shares"), [(1, 1), (2, 1), (3, 2), (1024, 64)])
def test_urls_in_shares_of_many_pieces(spark, monkeypatch, piece, shares):
    issues, affected, patched = _hot_id(spark)
    monkeypatch.setattr(relational, "PIECE", piece)
    monkeypatch.setattr(relational, "SHARES", shares)
    ids = {c for _, c in affected}
    want = Counter((c, p[1]) for _, c, _ in issues if c in ids for p in patched if p[0] == c)
    assert Counter((x.public_id, x.url) for x in relational.patch_urls_of_library(spark, 1).collect()) == want
