"""The pipeline's stages against plain versions of their decisions."""

from __future__ import annotations

import hashlib
import random
import re
import struct
from collections import Counter, defaultdict

import public_tokenizers
import pytest

import corpus_pipeline
from patchlens.llm import pii

WORD = r"[^\x20\x09-\x0D]+"


def shingles(text):
    w = re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


@pytest.fixture(scope="module")
def rows():
    r = random.Random(11)
    sounds = {"en": "th he in er an re on".split(), "de": "sch ei en ch ung ö ß".split()}
    out = []
    for i in range(90):
        lang = r.choice(["en", "de"])
        text = " ".join("".join(r.choices(sounds[lang], k=r.randint(1, 3))) for _ in range(r.choice([2, 30, 120])))
        if out and r.random() < 0.3:
            text, lang = r.choice(out)[1:3]
            w = text.split(" ")
            if len(w) > 60 and r.random() < 0.7:
                w[r.randrange(len(w))] = "x"
            text = " ".join(w)
        elif r.random() < 0.2:
            text += " mail a.b@example.org or +49 30 1234567"
        out.append((i, text, lang, r.choice(["a", "b", "b", None]), len(text)))
    out += [(200, None, "en", "a", 0), (201, "123 !!", "en", "a", 6), (202, "", None, None, None), out[5], out[5]]
    return out


def test_stages(spark, rows, tmp_path, monkeypatch):
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        d = stage(spark, d, "")
        d.write.parquet(str(tmp_path / name))
        d = spark.read.parquet(str(tmp_path / name))
        seen.append(d.collect())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert d.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    known, single, clean, mixed, packed = seen

    # language: all but what has no letter; the text's own language
    assert Counter(r.doc_id for r in known) == Counter(x[0] for x in rows if x[1] and re.search("[a-zöß]", x[1]))
    lang = {x[0]: x[2] for x in rows}
    assert sum(r.lang == lang[r.doc_id] for r in known) > 0.95 * len(known)

    # near copies: the least id of each component
    docs = {r.doc_id: r.text for r in known}
    root = {k: k for k in docs}
    sets = {k: shingles(t) for k, t in docs.items()}
    changed = True
    while changed:
        changed = False
        for a in docs:
            for b in docs:
                if root[a] != root[b] and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
                    changed = True
    assert Counter(r.doc_id for r in single) == Counter(k for k in docs if root[k] == k)

    # personal data: the patterns' matches are gone, other texts are as they were
    assert Counter(r.doc_id for r in clean) == Counter(r.doc_id for r in single)
    for r in clean:
        assert "@example" not in r.text and "1234567" not in r.text and r.n_chars == len(r.text)
        if "@" not in docs[r.doc_id]:
            assert r.text == docs[r.doc_id]
        else:
            assert "<EMAIL>" in r.text and "<PHONE>" in r.text

    # mix: words by source
    size = lambda t: len(re.findall(WORD, t))
    by = defaultdict(list)
    for r in clean:
        by[r.source].append(r)
    names = sorted(s for s in by if s is not None) + [None] * (None in by)
    cap = {s: 2 * sum(size(r.text) for r in by[s]) for s in names}
    left, open_, share = 0.75 * sum(cap.values()), dict(zip(names, [3, 1, 2] * 3)), {}
    while open_:
        level = left / sum(open_.values())
        full = [s for s in open_ if level * open_[s] > cap[s]]
        for s in full or list(open_):
            share[s] = cap[s] if full else level * open_[s]
            left -= share[s]
            del open_[s]
    want = Counter()
    for s in names:
        due = int(share[s] + 1e-6)
        order = sorted(by[s], key=lambda r: (hashlib.md5(f"mix-1:{r.doc_id}".encode()).hexdigest(), r.doc_id, size(r.text)))
        while due:
            for r in order:
                n = min(due, size(r.text))
                if n:
                    want[r.doc_id, " ".join(r.text.split(" ")[:n]) if n < size(r.text) else r.text] += 1
                due -= n
    assert Counter((r.doc_id, r.text) for r in mixed) == want

    # packing: every token of every row once
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    total = Counter()
    for r in mixed:
        total.update(tokenizer.encode(r.text, add_special_tokens=False).ids + [1])
    got = Counter()
    for r in packed:
        got.update(struct.unpack(f"<{r.length}H", r.ids))
    assert got == total
    assert sum(r.length for r in packed) == sum(total.values())


def test_run_reads_documents(spark, rows, tmp_path):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    assert [len(corpus_pipeline.STAGES), len({n for n, _ in corpus_pipeline.STAGES})] == [5, 5]
    assert pii.KINDS[-1] == "term"


def test_empty_table(spark, tmp_path):
    d = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        d = stage(spark, d, "")
    assert d.count() == 0


def test_null_and_repeated_ids(spark):
    from pyspark.sql import functions as F

    r = random.Random(17)
    say = lambda n=60: " ".join("".join(r.choices("abcdefgh", k=5)) for _ in range(n))
    a, b, c = say(), say(), say()
    near = a.replace(a.split(" ")[30], "zzz", 1)
    rows = [(None, a), (7, near), (8, b), (8, c), (8, c), (None, None), (None, say()), (9, b), (10, "")]
    d = spark.createDataFrame([(i, t, "en", None, 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = Counter((x.doc_id, x.text) for x in corpus_pipeline.copies(spark, d, "").collect())
    assert kept[7, near] == 1 and (None, a) not in kept  # a null id is never the least while there is another
    assert kept[8, b] == kept[8, c] == 1 and (9, b) not in kept and kept[10, ""] == 1 and kept[None, rows[6][1]] == 1
    for name, stage in corpus_pipeline.STAGES[2:]:
        d = stage(spark, d, "")
        assert d.count() > 0, name
    assert d.filter(F.col("doc_id").isNull()).count() > 0


def test_copies_without_broadcast(spark, rows, monkeypatch):
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    want = Counter(map(tuple, corpus_pipeline.copies(spark, d, "").collect()))
    monkeypatch.setattr(corpus_pipeline, "BROADCAST_IDS", 0)
    assert Counter(map(tuple, corpus_pipeline.copies(spark, d, "").collect())) == want
