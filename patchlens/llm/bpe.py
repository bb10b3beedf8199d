"""Byte-level BPE over whole batches: numpy finds the pre-tokens, a dictionary knows their ids.

The pre-token pattern of byte-level BPE,

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

decides every boundary from a character's class, its neighbours' classes and,
behind an apostrophe, up to two letters. So boundaries of a million characters
are a few vector operations, where a regex engine needs a call per pre-token.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterable, Iterator

import numpy as np

OTHER, LETTER, NUMBER, BLANK = 0, 1, 2, 3
#: Characters handled at once; bounds the memory of the arrays.
BLOCK = 1 << 19
#: Pre-tokens a worker remembers beside the vocabulary.
REMEMBERED = 150_000
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


@functools.cache
def classes() -> np.ndarray:
    """The class of every code point."""
    import regex

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    table = np.zeros(0x110000, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (BLANK, r"\s+")):
        for m in regex.finditer(pattern, every):
            a, b = ord(m[0][0]), ord(m[0][-1])
            table[a : b + 1] = kind
    table[0xD800:0xE000] = OTHER
    return table


def boundaries(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where pre-tokens start. points: code points; first: true where a text starts."""
    n = len(points)
    kind = classes()[points]
    before = np.empty(n, np.uint8)
    before[0] = 255
    before[1:] = kind[:-1]
    before[first] = 255
    blank = kind == BLANK
    more = np.zeros(n, bool)  # a character that is no white space follows in the same text
    more[:-1] = ~blank[1:] & ~first[1:]
    joined = np.zeros(n, bool)  # a plain space precedes in the same text
    joined[1:] = points[:-1] == 32
    joined &= ~first
    out = np.where(blank, (before != BLANK) | more, (before != kind) & ~joined)
    for i in np.flatnonzero((points == 39) & out & more):
        if kind[i + 1] != LETTER:
            continue
        two = chr(points[i + 1]) + (chr(points[i + 2]) if i + 2 < n and not first[i + 2] else "")
        m = next((len(c) for c in CONTRACTIONS if two.startswith(c)), 0)
        if m:
            out[i + 1] = False
            if m == 2:
                out[i + 2] = False
            if i + 1 + m < n:
                out[i + 1 + m] = True
    return out


def blocks(texts: list[str], most: int = BLOCK) -> Iterator[tuple[list[int], list[str]]]:
    """Texts in runs of about `most` characters: (owner of each part, parts).

    A longer text is cut where white space follows something else: there a
    pre-token starts whatever surrounds it.
    """
    owners, parts, held = [], [], 0
    for k, text in enumerate(texts):
        at = 0
        while True:
            end = len(text)
            if end - at > most:
                m = _CUT.search(text, at + most)
                end = m.end() if m else end
            owners.append(k)
            parts.append(text[at:end])
            held += end - at
            if held >= most:
                yield owners, parts
                owners, parts, held = [], [], 0
            at = end
            if at >= len(text):
                break
    if owners:
        yield owners, parts


_CUT = re.compile(r"\S(?=\s)")


def pretokens(parts: list[str]) -> tuple[list[str], np.ndarray]:
    """All pre-tokens of some texts, and how many each text has."""
    joined = "".join(parts)
    if not joined:
        return [], np.zeros(len(parts), np.int64)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(sizes)
    first = np.zeros(len(joined), bool)
    starts_of = (ends - sizes)[sizes > 0]
    first[starts_of] = True
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.flatnonzero(boundaries(points, first))
    edges = [*starts.tolist(), len(joined)]
    found = [joined[a:b] for a, b in zip(edges, edges[1:])]
    return found, np.searchsorted(starts, ends) - np.searchsorted(starts, ends - sizes)


def _bytes_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for.

    Printable bytes of Latin-1 stand for themselves, the others in turn for
    the characters from 256 on.
    """
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBPE:
    """What a tokenizers file says, as far as texts can be encoded without its library.

    `ranks` (bytes of a token to its id) is None unless the file is a plain
    byte-level BPE whose ids rise in the order of its merges: then merging by
    id is merging by rule, and pre-tokens can be merged alone.
    """

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, split, added = spec["model"], spec.get("pre_tokenizer") or {}, spec.get("added_tokens", [])
        self.special = {t["content"]: t["id"] for t in added}
        self.largest = max([*model["vocab"].values(), *self.special.values()])
        self.ranks: dict[bytes, int] | None = None
        if (
            model["type"] == "BPE" and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not spec.get("normalizer")
            and not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added)
            and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        ):
            vocab = model["vocab"]
            made = [vocab["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in model["merges"]]
            if all(a < b for a, b in zip(made, made[1:])):
                table = _bytes_of()
                self.ranks = {bytes(map(table.__getitem__, k)): v for k, v in vocab.items() if k not in self.special}

    @functools.cached_property
    def tokenizer(self):
        """The library's own, without truncation and padding."""
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(self.path)
        t.no_truncation()
        t.no_padding()
        return t

    def known(self) -> dict[str, int]:
        """Vocabulary strings that encode alone as one token, each proven by the library: string to id."""
        found: dict[str, int] = {}
        strings = {}
        for b, i in (self.ranks or {}).items():
            try:
                strings[b.decode()] = i
            except UnicodeDecodeError:
                continue
        names = [s for s, c in zip(strings, pretokens(list(strings))[1]) if c == 1]
        for at in range(0, len(names), 1000):
            part = names[at : at + 1000]
            found |= {s: strings[s] for s, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False)) if e.ids == [strings[s]]}
        return found

    @functools.cached_property
    def merge(self):
        """A function from a pre-token to its ids."""
        if self.ranks is None:
            raise ValueError("this file's pre-tokens aren't merged alone")
        import tiktoken

        encoding = tiktoken.Encoding("pre-tokens", pat_str=r"[\s\S]+", mergeable_ranks=self.ranks, special_tokens={})
        return encoding.encode_ordinary

    @functools.cached_property
    def encoder(self):
        """A function from a text without special strings to its ids."""
        import tiktoken

        return tiktoken.Encoding("texts", pat_str=PATTERN, mergeable_ranks=self.ranks, special_tokens={}).encode_ordinary

    def split_special(self, text: str) -> list[str]:
        """Text and special strings in turn; specials at odd places."""
        return self._special.split(text) if self.special else [text]

    @functools.cached_property
    def _special(self):
        return re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")


class Remembering(dict):
    """A dictionary that finds what it lacks by a function, and forgets that when it holds too much."""

    def __init__(self, base: dict, find, most: int = REMEMBERED):
        super().__init__(base)
        self.base, self.find, self.most = base, find, most

    def __missing__(self, key):
        if len(self) > len(self.base) + self.most:
            self.clear()
            self.update(self.base)
        self[key] = value = self.find(key)
        return value


@functools.lru_cache(4)
def load(path: str) -> ByteBPE:
    return ByteBPE(path)


#: White space of at least this length in a row is kept from the library's own pattern, which recurses over it.
LONG_BLANK = 200
_LONG_BLANK = re.compile(rf"\s{{{LONG_BLANK}}}")
#: The pattern with its likeliest branch first; no two branches start alike but the last two, so the order doesn't matter to the result.
PATTERN = r" ?\p{L}+|'s|'t|'re|'ve|'m|'ll|'d| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def id_type(path: str) -> np.dtype:
    """The smallest of 16 and 32 bits that holds all ids."""
    return np.dtype("<u2") if load(path).largest < 1 << 16 else np.dtype("<u4")


def encode(path: str, texts: Iterable[str]) -> Iterator[np.ndarray]:
    """The ids of each text, in arrays of id_type.

    Parts between special strings go, in blocks, to the library's encoder as
    a whole; where white space runs long, pre-tokens are found here and merged one by one.
    """
    bpe, kind = load(path), id_type(path)
    if bpe.ranks is None:
        for t in texts:
            yield np.array(bpe.tokenizer.encode(t, add_special_tokens=False).ids, kind)
        return
    for t in texts:
        held: list[np.ndarray] = []
        for j, piece in enumerate(bpe.split_special(t)):
            if j % 2:
                held.append(np.array([bpe.special[piece]], kind))
                continue
            for _, parts in blocks([piece]):
                for p in parts:
                    if _LONG_BLANK.search(p):
                        held += [np.array(bpe.merge(w), kind) for w in pretokens([p])[0]]
                    elif p:
                        held.append(np.array(bpe.encoder(p), kind))
        yield held[0] if len(held) == 1 else np.concatenate([np.zeros(0, kind), *held])


def count(path: str, texts: Iterable[str], known: dict) -> np.ndarray:
    """The number of ids of each text. known: pre-tokens to their numbers."""
    bpe = load(path)
    texts = list(texts)
    if bpe.ranks is None:
        return np.array([len(e.ids) for e in bpe.tokenizer.encode_batch_fast(texts, add_special_tokens=False)], np.int64)
    flat, owners, total = [], [], np.zeros(len(texts), np.int64)
    for k, t in enumerate(texts):
        pieces = bpe.split_special(t)
        total[k] = len(pieces) // 2
        flat += pieces[::2]
        owners += [k] * len(pieces[::2])
    owner = np.array(owners, np.int64)
    for places, parts in blocks(flat):
        found, counts = pretokens(parts)
        each = np.fromiter(map(known.__getitem__, found), np.int64, len(found))
        sums = np.concatenate([[0], np.cumsum(each)])
        ends = np.cumsum(counts)
        np.add.at(total, owner[places], sums[ends] - sums[ends - counts])
    return total
