"""Operators over whole tables and texts, against brute force."""

from __future__ import annotations

import difflib
import hashlib
import random

from patchlens.operators import sampling, scoring
from patchlens.plans import catalog


def test_shared_token_scores_of_all_pairs(spark):
    r = random.Random(3)
    texts = lambda n: [(i, " ".join(r.choices("a b c d e f g h i j k l".split(), k=r.randint(0, 4)))) for i in range(n)]
    items, docs = texts(60), [(i + 380, t) for i, t in texts(60)]
    left, right = spark.createDataFrame(items, "item_id int, q string"), spark.createDataFrame(docs, "doc_id int, text string")
    got = {(x.item_id, x.doc_id): x.score for x in scoring.shared_token_scores(left, right, "item_id", "doc_id", "q", "text").collect()}
    pairs = [(i, j) for i, _ in items for j, _ in docs]
    want = dict(zip(pairs, scoring.TokenOverlap().score([q for _, q in items for _ in docs], [t for _ in items for _, t in docs])))
    assert got == {k: v for k, v in want.items() if v > 0}
    assert {j for _, j in got} - set(range(400)) and {i for i, _ in got} - set(range(40))


def test_overlaps_of_all_windows(spark, tmp_path):
    r = random.Random(4)
    texts = [None, "", "short", "x" * 100, "ab" * 60 + "é😀\n" * 9] + ["".join(r.choices("ab", k=r.randint(0, 25))) * r.randint(1, 9) for _ in range(60)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {x.doc_id: x.kept for x in catalog.overlap_merge(spark, str(tmp_path)).collect()}
    want = {}
    for i, t in enumerate(texts):
        if t is not None:
            l = [t] if len(t) <= 30 else [t[k : k + 30] for k in [*range(0, len(t) - 29, 20), *([len(t) - 30] if (len(t) - 30) % 20 else [])]]
            over = [max(k for k in range(min(len(a), len(b)) + 1) if a[len(a) - k :] == b[:k]) for a, b in zip(l, l[1:])]
            want[i] = "|".join(x for x, o in zip(l, [*over, 0]) if o <= 10)
    assert got == want


def test_subsumed_words_of_whole_text(spark, tmp_path):
    words = [f"w{i:02d}" for i in range(40)] + ["xw03x", "END", "bend"]
    spark.createDataFrame([(1, " ".join(words))], "item_id int, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = catalog.substring_subsume(spark, str(tmp_path)).first().kept.split("|")
    assert kept == [w for w in words[:40] if w != "w03"] + ["bend", "xw03x"]


def test_dissimilar_goes_on_until_the_block_is_used_up(spark):
    r = random.Random(5)
    near = "".join(r.choices("abcdefgh", k=60))
    rows = [(i, near[:-1] + str(i % 10), "near") for i in range(45)] + [(i, f"{'xyz'[i - 45] * 60}", "near") for i in range(45, 48)]
    rows += [(100 + i, chr(97 + i) * 9, "far") for i in range(5)] + [(200, "alone", "one"), (300, "p", None), (301, "q", None)]
    d = spark.createDataFrame(rows, "i int, t string, b string")
    got = {}
    for x in sampling.dissimilar(d, "i", "t", ["b"], 3, 0.9).collect():
        got.setdefault(x.i, set()).add(x.partner_id)
    want = {}
    for b in {x[2] for x in rows}:
        order = sorted((x for x in rows if x[2] == b), key=lambda x: (hashlib.md5(f"0:{x[0]}".encode()).hexdigest(), x[0]))
        for k, x in enumerate(order):
            later = [y for y in order[k + 1 :] + order[:k] if difflib.SequenceMatcher(None, x[1], y[1]).ratio() < 0.9]
            if later:
                want[x[0]] = {y[0] for y in later[:3]}
    assert got == want


def test_file_stats_cover_words_after_the_first_twenty(spark, tmp_path):
    text = " ".join([f"w{chr(97 + i)}" for i in range(25)] + ["Late", "x9", "Late"])
    spark.createDataFrame([(1, text, "en")], "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    x = catalog.stats_rollup_file(spark, str(tmp_path)).first()
    assert (x.n_strings, x.n_unique, x.n_node_unique, x.n_missing) == (28, 27, 2, 25)
