from __future__ import annotations

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from patchlens.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_every_character_has_the_library_s_class():
    split = bpe.load(PATH).tokenizer.pre_tokenizer.pre_tokenize_str
    every = [chr(c) for c in [*range(1, 0x3100), *range(0xA000, 0xA100), *range(0xFB00, 0x10000), *range(0x1D7C0, 0x1D800), *range(0x1F100, 0x1F700)]]
    texts = [f"a{c}a1{c}1!{c}! {c}" for c in every]
    _, counts = bpe.pretokens(texts)
    assert counts.tolist() == [len(split(t)) for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*" \n\t'sdtrevml!?a1Zé<|>中", "'s", "'re", "<|endoftext|>", "  ", "\x85", "😀"]), max_size=40).map("".join), max_size=6))
def test_ids_are_the_library_s(texts):
    want = [e.ids for e in bpe.load(PATH).tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in bpe.encode(PATH, texts)] == want


def test_known_pretokens_are_proven():
    known = bpe.load(PATH).known()
    assert len(known) > 49_000
    assert " the" in known and "'s" in known


def test_long_texts_are_cut_between_pretokens(monkeypatch):
    text = "One two  three\n\nfour's x 12 !! " * 50
    whole = bpe.pretokens([text])[0]
    parts = [p for _, ps in bpe.blocks([text], 100) for p in ps]
    assert len(parts) > 5 and "".join(parts) == text
    assert [t for p in parts for t in bpe.pretokens([p])[0]] == whole


def test_long_blanks():
    texts = [" " * 5000 + "x", "a" + "\n" * 3000, "\t \n" * 400 + "b c", "q" * 20_000]
    want = [e.ids for e in bpe.load(PATH).tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in bpe.encode(PATH, texts)] == want
