"""The alignment of two tokenizers against brute force over byte offsets."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from patchlens.llm import token_alignment
from patchlens.llm.bpe import load
from patchlens.llm.token_alignment import Memory, Pair, Transducer, align_tokens

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [" ", "  ", "\n", "\t", "\r\n", " ", "　", "a", "b", "é", "é", "漢", "ا", "😀", "▁", "<|endoftext|>", "<s>", "</s>", "<unk>", "<0x0A>", "0", "12", "!", "'s", "\0", "\x1c", "\x85", "ﬁ", "Ω", "​", "the", " the", "\n\n"]


def texts(seed: int = 5) -> list[str | None]:
    r = random.Random(seed)
    vocabulary = ["".join(r.choices(ODD[7:13] + list("thendiso"), k=r.randint(1, 6))) for _ in range(80)]
    found = ["".join(r.choices(ODD, k=r.randint(1, 14))) for _ in range(400)]
    found += [" ".join(r.choices(vocabulary, k=r.choice([3, 40, 300]))) for _ in range(60)]
    return found + [None, "", " ", "\n", " \n", "▁", "a▁b", " " * 3000, "q" * 5000, "a" + " " * 300 + "b", found[0], found[0]]


class Plain:
    def __init__(self):
        self.a, self.b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
        self.a.encode_special_tokens = True
        ranks = load(A).ranks
        self.a_bytes = {i: t for t, i in ranks.items()}
        self.b_bytes = lambda i: bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode()

    def read(self, text):
        """(a ids, b ids, groups as text, links), by sets of byte offsets and overlaps."""
        none = [], [], "", []
        if not text:
            return none
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        pieces = [self.a_bytes[i] for i in a], [self.b_bytes(i) for i in b]
        if any(b"".join(p) != (" " + text).encode() for p in pieces):
            return none
        ends = [np.cumsum([len(x) for x in p]).tolist() for p in pieces]
        groups, i, j = [], 0, 0
        for place in sorted(set(ends[0]) & set(ends[1])):
            x, y = ends[0].index(place) + 1, ends[1].index(place) + 1
            groups.append(",".join(map(str, a[i:x])) + "|" + ",".join(map(str, b[j:y])))
            i, j = x, y
        starts = [[0, *e[:-1]] for e in ends]
        links, first = [], 0
        for k, own in enumerate(a):
            while first < len(b) and ends[1][first] <= starts[0][k]:
                first += 1
            m = first
            while m < len(b) and starts[1][m] < ends[0][k]:
                links.append((own, b[m]))
                m += 1
        return a, b, hashlib.sha256(";".join(groups).encode()).hexdigest(), links

    def rows(self, rows):
        read = [self.read(t) for _, t in rows]
        counts = Counter(x for r in read for x in r[3])
        top = Counter()
        for (_, b), n in counts.items():
            top[b] = max(top[b], n)
        for (i, _), (a, b, groups, links) in zip(rows, read):
            best = sum(counts[x] == top[x[1]] for x in links)
            yield i, len(a), len(b), len(a) + len(b) - len(links) if links else 0, len(links), best, sum(counts[x] for x in links), groups


def test_links_are_one_less_than_tokens_per_group():
    plain, memory = Plain(), Memory(Pair(A, B), True)
    found = texts(2)
    segments, counts = memory.read(found)
    ends = np.cumsum(counts)
    for t, end, n in zip(found, ends, counts):
        a, b, groups, links = plain.read(t)
        mine = segments[end - n : end]
        assert [(int(x) >> token_alignment.BITS, int(x) & (1 << token_alignment.BITS) - 1) for x in memory.links_of(mine)] == links
        assert (hashlib.sha256("".join(memory.groups[k] for k in mine)[:-1].encode()).hexdigest() if n else "") == groups


def test_walk_of_any_two_segmentations():
    r = random.Random(3)
    pieces = [bytes(r.choices(b"ab", k=r.randint(1, 4))) for _ in range(40)]
    pieces = list(dict.fromkeys([*pieces, b"a", b"b"]))
    t = Transducer(pieces, pieces)
    split = lambda text: _split(text, pieces, r)
    sides = [[], []]
    for k in range(200):
        text = bytes(r.choices(b"ab", k=r.randint(1, 30)))
        sides[0].append(split(text))
        sides[1].append(split(text if k % 7 else text[:-1] + (b"b" if text[-1:] == b"a" else b"a")))
    a, b = (np.array([i for s in side for i in s]) for side in sides)
    a_ends, b_ends = (np.cumsum([len(s) for s in side]) for side in sides)
    agree, links, owners, groups = t.walk(a, a_ends, b, b_ends)
    assert agree.tolist() == [k % 7 > 0 for k in range(200)]
    for k in np.flatnonzero(agree):
        assert (owners == k).sum() == len(sides[0][k]) + len(sides[1][k]) - (groups[:, 0] == k).sum()


def _split(text, pieces, r):
    out, at = [], 0
    while at < len(text):
        k = r.choice([k for k, p in enumerate(pieces) if text.startswith(p, at)])
        out.append(k)
        at += len(pieces[k])
    return out


@pytest.mark.parametrize("frequent", [1 << 20, 50, 1])
def test_alignment_equals_brute_force(spark, frequent):
    rows = [(None if k % 50 == 7 else k % 400, t) for k, t in enumerate(texts())]
    docs = spark.createDataFrame([(*x, 1, 2, "x") for x in rows], "doc_id long, text string, key long, n long, rare string").repartition(5)
    got = align_tokens(docs, A, B, frequent=frequent)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert Counter(map(tuple, got.collect())) == Counter(Plain().rows(rows))


def test_alignment_of_no_rows(spark):
    assert align_tokens(spark.createDataFrame([], "doc_id long, text string"), A, B).collect() == []
    got = align_tokens(spark.createDataFrame([(1, None), (None, "")], "doc_id long, text string"), A, B).collect()
    assert sorted(map(tuple, got), key=str) == [(1, 0, 0, 0, 0, 0, 0, ""), (None, 0, 0, 0, 0, 0, 0, "")]


def test_forgotten_segments_are_read_again(spark, monkeypatch):
    monkeypatch.setattr(token_alignment, "REMEMBERED", 40)
    plain, memory = Plain(), Memory(Pair(A, B), True)
    found = [t for t in texts(9) if t and len(t) < 400]
    for at in range(0, len(found), 10):
        segments, counts = memory.read(found[at : at + 10])
        ends = np.cumsum(counts)
        for t, end, n in zip(found[at : at + 10], ends, counts):
            mine = segments[end - n : end]
            assert (hashlib.sha256("".join(memory.groups[k] for k in mine)[:-1].encode()).hexdigest() if n else "") == plain.read(t)[2]
