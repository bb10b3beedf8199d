"""The toxicity lexicon: folding, exceptions, a plain version of the whole operator, accuracy on held-out documents."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from patchlens.llm import toxicity
from patchlens.llm.toxicity import Lexicon, fold, score_toxicity, tokens

BAD = ["vexborn", "grulm", "skazzle", "trog10"]


def test_folding():
    same = ["stupid", "STUPID", "5tup1d", "$tup!d", "ѕtuріd", "ｓｔｕｐｉｄ", "stuuuupid", "stu​pid", "𝓼𝓽𝓾𝓹𝓲𝓭", "stupid!!"]
    assert {tuple(tokens(s)) for s in same} == {("stupid",)}
    assert fold("c1own") == fold("clown") == "ciown"
    assert tokens("It costs 1350, or $5 - 3!") == ["it", "costs", "1350", "or", "5", "3"]
    assert tokens("a_b __ @ !!! émile l'été") == ["ab", "émiie", "i", "été"]
    assert tokens(None) == tokens("") == tokens(" .,; ") == []
    assert fold("ooo") == "o" and fold("book") == "book" and fold("111") == "111"


def test_exceptions_and_overlaps():
    x = Lexicon({"trash": (1, 30), "bin": (2, 20)}, (100, 40), 0.0, ("trash can", "the bin"))
    at = lambda text: [m[2] for m in x.matches(tokens(text))]
    assert at("trash bin trash trash can bin the bin") == ["trash", "bin", "trash", "bin"]
    assert at("trashy cabin") == [] and at("") == []
    many = "trash can trash " * 20
    assert at(many) == ["trash"] * 20
    assert x.matches(tokens(many)) == [m for m in x.matches(tokens(many)) if m[3] == toxicity.weight(1, 30, 100, 40)]


def corpus(n=900, seed=4):
    r = random.Random(seed)
    plain = ["".join(r.choices("abdeilmnorst", k=r.randint(2, 7))) for _ in range(300)]
    rows, labels = [], []
    for k in range(n):
        toxic = r.random() < 0.15
        words = r.choices(plain, k=r.choice([4, 30, 30, 200, 1500]))
        if toxic:
            for _ in range(max(1, len(words) // 25)):
                words[r.randrange(len(words))] = r.choice(BAD)
        elif r.random() < 0.2:
            words += ["innocent", "grulm"]  # a phrase that is no offence
        rows.append((k, " ".join(words)))
        if r.random() < 0.6:
            labels.append((k, int(toxic)))
    rows += [(None, "grulm vexborn skazzle"), (n + 1, None), (n + 2, ""), (n + 3, "ѵexborn vexb0rn grulm skazzle"), rows[5], rows[5], (n + 4, "x" * 200_000), (n + 5, "vexborn " * 50_000)]
    labels += [(None, 1), (3, None), (n + 50, 1), labels[0]]
    return rows, labels


def brute(rows, labels, learned, per_label=5000):
    """Scores by plain loops over whole texts."""
    text = {}
    for i, t in rows:
        text.setdefault(i, t or "")
    label = {}
    for i, y in labels:
        if i is not None and y is not None and learned(i):
            label[i] = max(y, label.get(i, 0))
    sample = [(y, tokens(text[i])) for i, y in label.items() if i in text]
    n = Counter(y for y, _ in sample)
    base = n[1] / len(sample)
    seen = {}
    for y, ws in sample:
        for w in set(ws):
            seen.setdefault(w, [0, 0])[y] += 1
    ranked = sorted(((toxicity.evidence(*c, base), w) for w, c in seen.items()), key=lambda x: (-x[0], x[1]))
    ranked = [x for x in ranked if x[0] >= -math.log(toxicity.FALSE_SHARE)]
    taken = max((k for k, (e, _) in enumerate(ranked, 1) if math.exp(-e) <= toxicity.FALSE_SHARE * k / len(seen)), default=0)
    terms = {w: seen[w] for _, w in ranked[:taken]}
    near = {}
    for y, ws in sample:
        for p in {f"{a} {b}" for a, b in zip(ws, ws[1:]) if a in terms or b in terms}:
            near.setdefault(p, [0, 0])[y] += 1
    free = {p for p, (c, t) in near.items() if c >= toxicity.EXCEPTION_SUPPORT and t <= base * (c + t)}

    def hits(ws):
        out = []
        for k, w in enumerate(ws):
            if w in terms and f"{w} {ws[k + 1] if k + 1 < len(ws) else ''}" not in free and f"{ws[k - 1] if k else ''} {w}" not in free:
                out.append(w)
        return out

    least = ranked[taken - 1][0] if taken else 0

    def loo(w, y):
        c, every = list(terms[w]), [n[0], n[1]]
        c[y] -= 1
        every[y] -= 1
        return toxicity.weight(*c, *every) if toxicity.evidence(*c, base) >= least else 0.0

    x = np.array([toxicity.density(sum(loo(w, y) for w in hits(ws)), len(ws)) for y, ws in sample])
    a, b = toxicity.curve(x, np.array([y for y, _ in sample]))
    every = Counter(label.values())
    a += math.log(every[1] / every[0]) - math.log(n[1] / n[0])
    score = lambda ws: 1 / (1 + math.exp(-(a + b * toxicity.density(sum(toxicity.weight(*terms[w], n[0], n[1]) for w in hits(ws)), len(ws)))))
    return [(i, score(tokens(t))) for i, t in rows], terms, free


def test_scores_equal_plain_loops_and_generalise(spark):
    rows, labels = corpus()
    d = spark.createDataFrame([(*x, 1, "x") for x in rows], "doc_id long, text string, toxic int, label string").repartition(5)
    l = spark.createDataFrame([(*x, "y") for x in labels], "doc_id long, toxic int, text string").repartition(3)
    held = F.col("doc_id") % 3 == 1
    got = score_toxicity(d, l, learn_if=~held)
    assert got.columns == ["doc_id", "score", "predicted"]
    got = sorted((r.doc_id is None, r.doc_id, r.score, r.predicted) for r in got.collect())
    want, terms, free = brute(rows, labels, lambda i: i % 3 != 1)
    assert set(map(fold, BAD)) <= set(terms) and f"innocent {fold('grulm')}" in free
    want = sorted((i is None, i, s) for i, s in want)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:2] == w[:2] and g[2] == pytest.approx(w[2], abs=1e-9) and g[3] == (g[2] >= 0.7)
    of = dict((g[1], g[3]) for g in got)
    assert of[903] == 1 and of[None] == 1 and of[905] == 1 and of[901] == of[902] == of[904] == 0
    unseen = [(i, y) for i, y in labels if i is not None and y is not None and i % 3 == 1 and i < 900]
    assert sum(of[i] == y for i, y in unseen) / len(unseen) > 0.97


def test_bounded_sample_is_the_same_for_every_partitioning(spark):
    rows, labels = corpus(400, 8)
    l = spark.createDataFrame(labels, "doc_id long, toxic int")
    d = spark.createDataFrame(rows, "doc_id long, text string")
    a, b = (sorted((str(r.doc_id), r.score) for r in score_toxicity(d.repartition(n), l.repartition(n), per_label=30).collect()) for n in (1, 7))
    assert a == b


@pytest.mark.parametrize("labels", [[], [(1, 0)], [(1, 1), (2, 1)], [(1, None), (None, 1)]])
def test_labels_of_one_kind(spark, labels):
    d = spark.createDataFrame([(1, "grulm grulm"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r.score for r in score_toxicity(d, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    ys = [y for i, y in labels if i is not None and y is not None]
    assert got == {k: pytest.approx((sum(ys) + 0.5) / (len(ys) + 1)) for k in (1, 2)}


def test_lexicon_of_the_caller(spark):
    rows, labels = corpus(900, 3)
    d = spark.createDataFrame([(1, "you odious w0rm of a person"), (2, "worm food"), (3, "odious worm")], "doc_id long, text string")
    every = spark.createDataFrame([(i + 100 if i is not None else None, t) for i, t in rows], "doc_id long, text string").unionByName(d)
    l = spark.createDataFrame([(i + 100 if i is not None else None, y) for i, y in labels], "doc_id long, toxic int")
    got = {r.doc_id: r.predicted for r in score_toxicity(every, l, lexicon={"odious worm": 9.0}).filter("doc_id < 4").collect()}
    assert got == {1: 1, 2: 0, 3: 1}


def test_no_documents(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert score_toxicity(empty, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")).collect() == []
