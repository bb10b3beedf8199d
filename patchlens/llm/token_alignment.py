"""Alignment of two tokenizers' tokens by a dangling-suffix transducer, and corpus counts of the linked ids."""

from __future__ import annotations

import functools
import hashlib
import itertools
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchlens.llm import bpe
from patchlens.llm.common import cut, slices, small_batches

#: Segments of text that a worker remembers with their groups and links; with more it keeps those met OFTEN since the last time.
REMEMBERED, OFTEN = 300_000, 2
#: Characters of segments that go to the tokenizers at once.
CHUNK = 1 << 15
#: Steps of the transducer that a worker remembers.
STEPS = 1_000_000
#: Id pairs with at least one in this many of all links are broadcast: no more than so many can exist.
FREQUENT = 1 << 20
#: Distinct id pairs that a task counts before it hands them on.
HELD = 1 << 21
#: Bits of an id in the keys of pairs (a_id << BITS | b_id) and of steps.
BITS = 24
#: A segment starts at a space or newline behind something else than white space: both tokenizers have a boundary there.
_SEGMENT = re.compile(r"[ \n]\s*\S*(?:[^\S \n]\s*\S*)*")
_NOT_PLAIN, _LONG_BLANK = re.compile(r"\s[ \n]|\0"), re.compile(rf"\s{{{bpe.LONG_BLANK}}}")
#: Segments walked at once; fewer are walked one by one.
TOGETHER = 24


class Transducer:
    """Walks the tokens of both sides at once.

    A state is which side leads (0: neither, 1: A, 2: B) and the bytes of its
    last token that the other side hasn't matched yet. The side that lags (A,
    if neither leads) gives the next token; the step depends on the state and
    on that token alone and is remembered by both. Every token read while a
    side leads overlaps that side's last token: one link. An empty residual
    closes the group.
    """

    SLOTS = 1 << 20

    def __init__(self, a_bytes: list[bytes], b_bytes: list[bytes]):
        self.of = (a_bytes, b_bytes)
        self.forget()

    def forget(self) -> None:
        self.ids: dict[tuple[int, bytes], int] = {(0, b""): 0}
        self.states: list[tuple[int, bytes]] = [(0, b"")]
        self.side = np.zeros(1 << 12, np.uint8)  # the leading side of each state
        self.steps: dict[int, int] = {}
        self.slot_keys, self.slot_values = np.full(self.SLOTS, -1, np.int64), np.zeros(self.SLOTS, np.int64)  # the steps met last, by a hash of their keys

    def step(self, key: int) -> int:
        """The state that follows state << BITS | token; -1 if the token's bytes contradict the residual."""
        found = self.steps.get(key)
        if found is None:
            found = self.steps[key] = self._step(*divmod(key, 1 << BITS))
        return found

    def _step(self, state: int, token: int) -> int:
        lead, left = self.states[state]
        own = self.of[lead == 1][token]
        if not lead:
            new = (1, own)
        elif left.startswith(own):
            new = (lead, left[len(own) :])
        elif own.startswith(left):
            new = (3 - lead, own[len(left) :])
        else:
            return -1
        at = self.ids.setdefault(new if new[1] else (0, b""), len(self.states))
        if at == len(self.states):
            self.states.append(new)
            if at == len(self.side):
                self.side = np.concatenate([self.side, np.zeros(at, np.uint8)])
            self.side[at] = new[0]
        return at

    def _next(self, keys: np.ndarray) -> np.ndarray:
        slots = ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)
        out = self.slot_values[slots]
        odd = np.flatnonzero(self.slot_keys[slots] != keys)
        if len(odd):
            unseen, back = np.unique(keys[odd], return_inverse=True)
            found = np.fromiter(map(self.step, unseen.tolist()), np.int64, len(unseen))[back]
            out[odd] = found
            self.slot_keys[slots[odd]], self.slot_values[slots[odd]] = keys[odd], found
            # two keys of one slot: the last one stands there with its own value, as both arrays are written in the same order
        return out

    def walk(self, a: np.ndarray, a_ends: np.ndarray, b: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, ...]:
        """Many segments side by side. a, b: ids of all segments, one after the other; ends: where each segment's end.

        Returns agree (per segment: its bytes are the same on both sides), links (keys) with the
        segment of each, ends of groups (places behind their last A and B token) with the segment of
        each; links and groups in order.
        """
        if len(self.steps) > STEPS:
            self.forget()
        n = len(a_ends)
        i, j = np.concatenate([[0], a_ends[:-1]]), np.concatenate([[0], b_ends[:-1]])
        state, agree, at = np.zeros(n, np.int64), np.ones(n, bool), np.arange(n)
        links, owners, groups = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros((0, 3), np.int64)]
        while len(at) >= TOGETHER:
            s, x, y = state[at], i[at], j[at]
            lead = self.side[s]
            from_b = lead == 1
            over = np.where(from_b, y == b_ends[at], x == a_ends[at])
            if over.any():
                ended = at[over]
                agree[ended] = (state[ended] == 0) & (j[ended] == b_ends[ended])
                go = ~over
                at, s, x, y, lead, from_b = at[go], s[go], x[go], y[go], lead[go], from_b[go]
                if not len(at):
                    break
            token = np.where(from_b, b[np.where(from_b, y, 0)], a[np.where(from_b, 0, x)])
            linked = lead > 0
            if linked.any():
                own_a, own_b = a[np.where(from_b, x - 1, x)[linked]], b[np.where(from_b, y, y - 1)[linked]]
                links.append(own_a << BITS | own_b)
                owners.append(at[linked])
            new = self._next(s << BITS | token)
            x, y = x + ~from_b, y + from_b
            closed = new == 0
            groups.append(np.stack([at[closed], x[closed], y[closed]], 1))
            state[at], i[at], j[at] = new, x, y
            bad = new < 0
            if bad.any():
                agree[at[bad]] = False
                at = at[~bad]
        for k in at.tolist():
            agree[k] = self._alone(k, int(state[k]), int(i[k]), int(j[k]), a, int(a_ends[k]), b, int(b_ends[k]), links, owners, groups)
        link, owner, group = np.concatenate(links), np.concatenate(owners), np.concatenate(groups)
        order, by = np.argsort(owner, kind="stable"), np.argsort(group[:, 0], kind="stable")
        return agree, link[order], owner[order], group[by]

    def _alone(self, k, state, i, j, a, a_end, b, b_end, links, owners, groups) -> bool:
        """The rest of one segment."""
        own_links, own_groups = [], []
        start, a, b = (i, j), a[i - 1 if i else 0 : a_end].tolist(), b[j - 1 if j else 0 : b_end].tolist()
        di, dj = start[0] - (1 if start[0] else 0), start[1] - (1 if start[1] else 0)
        ok = True
        while True:
            lead = self.states[state][0]
            if lead == 1:
                if j == b_end:
                    ok = False
                    break
                token = b[j - dj]
                own_links.append(a[i - 1 - di] << BITS | token)
                j += 1
            else:
                if i == a_end:
                    ok = not state and j == b_end
                    break
                token = a[i - di]
                if lead:
                    own_links.append(token << BITS | b[j - 1 - dj])
                i += 1
            state = self.step(state << BITS | token)
            if state < 0:
                ok = False
                break
            if not state:
                own_groups.append((k, i, j))
        links.append(np.array(own_links, np.int64))
        owners.append(np.full(len(own_links), k))
        groups.append(np.array(own_groups, np.int64).reshape(-1, 3))
        return ok


class Pair:
    """Two tokenizers: `a`, a byte-level file of the tokenizers library, and `b`, a sentencepiece model."""

    def __init__(self, a: str, b: str):
        import sentencepiece

        self.a = bpe.load(a)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b)
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if self.a.ranks is None:
            raise ValueError(f"{a} is no plain byte-level BPE")
        own = [b""] * (self.a.largest + 1)
        for token, i in [*self.a.ranks.items(), *((s.encode(), i) for s, i in self.a.special.items())]:
            own[i] = token
        self.transducer = Transducer(own, [bytes([int(n[3:5], 16)]) if self.b.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)])
        self.blank = self.b.piece_to_id("▁")
        self.apart = self._apart(names)
        named = lambda n, end: np.array([f"{i}{end}" for i in range(n)], object)
        self.names = named(len(own), ","), named(len(own), "|"), named(len(names), ","), named(len(names), ";")
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in side]) for side in self.transducer.of)

    @functools.cached_property
    def a_encoder(self):
        import tiktoken

        return tiktoken.Encoding("segments", pat_str=bpe.PATTERN, mergeable_ranks=self.a.ranks, special_tokens={})

    def _apart(self, names: list[str]) -> bool:
        """Whether B never joins what stands on both sides of a segment's start: no piece has a space behind something else, or a newline; texts aren't rewritten."""
        probe = ["a  b", " a", "a ", "Aéﬁ Ω", "a\n\n b"]
        kept = all(self.b.decode(self.b.encode(p)) == p for p in probe)
        plain = [n for i, n in enumerate(names) if not self.b.is_byte(i) and not self.b.is_control(i) and not self.b.is_unknown(i)]
        return kept and not any(re.search("[^▁]▁|\n", n) for n in plain) and self.b.encode("a")[0] != self.blank

    def segments(self, text: str) -> list[str]:
        """The pieces of space + text that are aligned one by one."""
        if not self.apart:
            return [" " + text]
        text = " " + text
        if _NOT_PLAIN.search(text):
            return _SEGMENT.findall(text)
        return text.replace(" ", "\0 ").replace("\n", "\0\n").split("\0")[1:]

    def alone(self, segment: str) -> bool:
        """Whether a segment can't be encoded as a part of a text of other segments and found again by its bytes."""
        return not self.apart or "▁" in segment or segment[-1].isspace() or bool(_LONG_BLANK.search(segment))

    def encoded(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """A ids of segments of one text, where each one's end, and the same of B.

        B puts a space before a text: the first segment's own, or, before a newline, one that is taken off again.
        """
        text = "".join(segments)
        a = self.a_encoder.encode_to_numpy(text, disallowed_special=()).astype(np.int64)
        b = np.array(self.b.encode(text[1:]) if text[0] == " " else self.b.encode(text)[1:], np.int64)
        edges = np.cumsum([len(s.encode()) for s in segments])
        sums = np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b])
        ends = [np.searchsorted(x, edges, "right") for x in sums]
        if any(x[e - 1].tolist() != edges.tolist() for x, e in zip(sums, ends)):
            return self.encoded_alone(segments)
        return a, ends[0], b, ends[1]

    def encoded_alone(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        flat, counts = bpe.pretokens(segments)
        ids = list(map(self.a.merge, flat))
        sizes = np.cumsum([0, *map(len, ids)])
        a = np.fromiter((i for x in ids for i in x), np.int64, int(sizes[-1]))
        found = self.b.encode([s[1:] if s[0] == " " else s for s in segments], num_threads=1)
        found = [[self.blank] if s == " " else x if s[0] == " " else x[1:] for s, x in zip(segments, found)]
        b_ends = np.cumsum([len(x) for x in found])
        return a, sizes[np.cumsum(counts)], np.fromiter((i for x in found for i in x), np.int64, int(b_ends[-1])), b_ends

    def all_encoded(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """As `encoded`, for segments in any number; those that stand alone come last."""
        alone = next((k for k, s in enumerate(segments) if self.alone(s)), len(segments))
        parts, at = [], 0
        for end in [*self._chunks(segments[:alone]), alone]:
            if end > at:
                parts.append(self.encoded(segments[at:end]))
            at = end
        if alone < len(segments):
            parts.append(self.encoded_alone(segments[alone:]))
        a, a_ends, b, b_ends = zip(*parts)
        moved = lambda ids, ends: np.concatenate([e + x for e, x in zip(ends, np.cumsum([0, *map(len, ids)]).tolist())])
        return np.concatenate(a), moved(a, a_ends), np.concatenate(b), moved(b, b_ends)

    @staticmethod
    def _chunks(segments: list[str]) -> list[int]:
        sizes = np.cumsum([0, *map(len, segments)])
        return np.unique(np.searchsorted(sizes, np.arange(CHUNK, int(sizes[-1]), CHUNK))).tolist()


class _Numbers(dict):
    """Numbers segments as they are met; `new`: those met since it was emptied."""

    def __init__(self, *known):
        super().__init__(*known)
        self.new: list[str] = []

    def __missing__(self, segment: str) -> int:
        self[segment] = n = len(self)
        self.new.append(segment)
        return n


class Memory:
    """Aligned segments, by number. `forgetting` is called before `uses` is set back.

    n_a, n_b, n_groups: by segment; -1 where the two sides' bytes differ.
    links: keys of all segments, one after the other; link_ends: where each
    segment's end. groups: texts of segments' groups, if `named`. uses: how
    often each was met.
    """

    def __init__(self, pair: Pair, named: bool, forgetting: Callable[[], None] = lambda: None):
        self.pair, self.named, self.forgetting = pair, named, forgetting
        self.number = _Numbers()
        self.n_a = self.n_b = self.n_groups = self.link_ends = self.links = self.uses = np.zeros(0, np.int64)
        self.groups: list[str] = []

    def forget(self) -> None:
        self.forgetting()
        stay = np.flatnonzero(self.uses >= OFTEN)
        if len(stay) > REMEMBERED // 2:
            stay = stay[:0]
        self.links, sizes = self.links_of(stay), self.n_links(stay)
        for k in ("n_a", "n_b", "n_groups"):
            setattr(self, k, getattr(self, k)[stay])
        self.link_ends = np.cumsum(sizes)
        names = list(self.number)
        self.number = _Numbers(zip(map(names.__getitem__, stay.tolist()), range(len(stay))))
        self.groups = list(map(self.groups.__getitem__, stay.tolist())) if self.named else []
        self.uses = np.zeros(len(stay), np.int64)

    def numbers(self, segments: list[str]) -> np.ndarray:
        n = len(self.number)
        found = np.fromiter(map(self.number.__getitem__, segments), np.int64, len(segments))
        new, self.number.new = self.number.new, []
        if new:
            last = [self.pair.alone(s) for s in new]
            if any(last):  # these are numbered last
                order = np.argsort(last, kind="stable")
                place = np.empty(len(new), np.int64)
                place[order] = np.arange(len(new))
                found = np.where(found < n, found, n + place[np.maximum(found - n, 0)])
                new = [new[k] for k in order.tolist()]
                for s in new:
                    del self.number[s]
                self.number.update(zip(new, range(n, n + len(new))))
            self._add(new)
        self.uses = np.concatenate([self.uses, np.zeros(len(new), np.int64)]) + np.bincount(found, minlength=len(self.number))
        return found

    def _add(self, new: list[str]) -> None:
        a, a_ends, b, b_ends = self.pair.all_encoded(new)
        agree, links, owners, ends = self.pair.transducer.walk(a, a_ends, b, b_ends)
        good = agree[owners]
        links = links[good]
        n_links = np.bincount(owners[good], minlength=len(new))
        n_a, n_b, n_groups = np.diff(a_ends, prepend=0), np.diff(b_ends, prepend=0), np.bincount(ends[:, 0], minlength=len(new))
        for k, x in (("n_a", n_a), ("n_b", n_b), ("n_groups", n_groups)):
            setattr(self, k, np.concatenate([getattr(self, k), np.where(agree, x, -1)]))
        self.link_ends = np.concatenate([self.link_ends, len(self.links) + np.cumsum(n_links)])
        self.links = np.concatenate([self.links, links])
        if not self.named:
            return
        ends = ends[agree[ends[:, 0]]]
        a_plain, a_last, b_plain, b_last = self.pair.names
        a_group, b_group = np.searchsorted(ends[:, 1], np.arange(len(a)), "right"), np.searchsorted(ends[:, 2], np.arange(len(b)), "right")
        a_text, b_text = a_plain[a], b_plain[b]
        a_text[ends[:, 1] - 1] = a_last[a[ends[:, 1] - 1]]
        b_text[ends[:, 2] - 1] = b_last[b[ends[:, 2] - 1]]
        a_in, b_in = np.repeat(agree, n_a), np.repeat(agree, n_b)
        order = np.argsort(np.concatenate([a_group[a_in], b_group[b_in]]), kind="stable")
        parts = np.concatenate([a_text[a_in], b_text[b_in]])[order].tolist()
        edges = np.concatenate([[0], np.cumsum(np.where(agree, n_a + n_b, 0))]).tolist()
        self.groups += ["".join(parts[x:y]) for x, y in zip(edges, edges[1:])]

    def read(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all segments of the texts that have tokens, and of how many segments each text is (0: none)."""
        if len(self.number) > REMEMBERED:
            self.forget()
        cut_up = [self.pair.segments(t) if t else [] for t in texts]
        counts = np.fromiter(map(len, cut_up), np.int64, len(texts))
        found = self.numbers(list(itertools.chain.from_iterable(cut_up)))
        odd = self.n_a[found] < 0
        if odd.any():
            owner = np.repeat(np.arange(len(texts)), counts)
            bad = np.bincount(owner[odd], minlength=len(texts)) > 0
            self.uses -= np.bincount(found[bad[owner]], minlength=len(self.uses))
            found, counts = found[~bad[owner]], np.where(bad, 0, counts)
        return found, counts

    def links_of(self, segments: np.ndarray) -> np.ndarray:
        """The links of each of the segments in turn."""
        ends, sizes = self.link_ends[segments], self.n_links(segments)
        return self.links[np.repeat(ends - np.cumsum(sizes), sizes) + np.arange(int(sizes.sum()))]

    def n_links(self, segments: np.ndarray) -> np.ndarray:
        return self.link_ends[segments] - np.where(segments > 0, self.link_ends[segments - 1], 0)


@functools.lru_cache(1)
def _pair(a: str, b: str) -> Pair:
    return Pair(a, b)


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of stretches of `values`, as long as `counts` says."""
    sums = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(counts)
    return sums[ends] - sums[ends - counts]


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, in order, and the sums of their counts."""
    key, count = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    return key[first], np.add.reduceat(count, first) if len(first) else count


def link_counts(texts: DataFrame, a: str, b: str) -> DataFrame:
    """How many links of all texts (the only column, `text`) hold each id pair: key (a_id << BITS | b_id), n (long).

    A worker counts how often it meets each segment it remembers, and turns
    that into pairs when it forgets them; a task holds HELD distinct pairs and
    hands them on when it has more. So a frequent pair is a few rows of a task.
    """

    def counted(batches):
        keys, counts = [], []

        def flush():
            nonlocal keys, counts
            met = np.flatnonzero(memory.uses)
            keys.append(memory.links_of(met))
            counts.append(np.repeat(memory.uses[met], memory.n_links(met)))
            key, count = _merged(keys, counts)
            keys, counts = [key], [count]

        memory = Memory(_pair(a, b), False, flush)
        for batch in batches:
            for part in slices(iter([batch]), 0):
                memory.read(part.column(0).to_pylist())
                if keys and len(keys[0]) > HELD:
                    yield from _rows(keys[0], counts[0])
                    keys, counts = [], []
        flush()
        yield from _rows(keys[0], counts[0])

    return texts.mapInArrow(counted, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))


def _rows(key: np.ndarray, count: np.ndarray, most: int = 1 << 17) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(key), most):
        yield pa.RecordBatch.from_arrays([pa.array(key[at : at + most]), pa.array(count[at : at + most])], ["key", "n"])


def align_tokens(docs: DataFrame, a: str, b: str, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """How the tokens of two tokenizers cover each text, and how typical its links are in the whole corpus.

    A encodes space + text, B the text (to which it adds that space), both
    without special tokens; strings of special tokens are plain text. Places
    where tokens of both end cut them into groups. An A and a B token whose
    bytes overlap are linked; a pair's count is the number of links of all
    texts that hold it.

    Returns per row id_col, n_a, n_b, n_groups, n_links, n_best (links whose
    pair has its B id's highest count, ties included), count_sum (the sum of
    counts over links; long all), groups_sha256 (of `a1,a2|b1;a3|b2,b3`: ids
    in order, lowercase hex). A text that is null, empty or that B's tokens
    don't spell byte by byte has zeros and ''. Null and repeated ids stay as
    rows; an empty table gives an empty result.

    Texts are cut into segments at places where both tokenizers always have a
    boundary, as shown from their vocabularies; without such places a text is
    one segment. Each segment is encoded and walked once while remembered.
    Texts are read twice: for the counts, and for the rows. Counts of pairs
    with one in `frequent` or more of all links (at most `frequent` pairs
    exist) are broadcast; the others are met through a shuffle, in which no
    key has more rows than one in `frequent` of all links. A text is held
    whole by one task, with its segments.
    """
    spark = docs.sparkSession
    small_batches(spark)
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    counts = cut(link_counts(d.select("text"), a, b))
    top = F.broadcast(counts.groupBy((F.col("key") % (1 << BITS)).alias("b_id")).agg(F.max("n").alias("top")))  # a row per id of B
    ranked = counts.join(top, F.col("key") % (1 << BITS) == F.col("b_id")).select("key", "n", (F.col("n") == F.col("top")).alias("best"))
    total = counts.agg(F.sum("n").alias("n")).first()["n"] or 0
    least = -(-total // frequent)
    known = _known(spark, ranked.filter(F.col("n") >= least))
    kind = d.schema["id"].dataType.simpleString()
    numbers = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]

    def scored(batches):
        key, n, best = known.value
        memory = Memory(_pair(a, b), True)
        for batch in batches:
            for part in slices(iter([batch]), 2):
                yield _scored(memory, part, key, n, best, numbers)

    d = d.select(F.monotonically_increasing_id().alias("row"), "id", "text")
    schema = f"row bigint, id {kind}, {', '.join(f'{x} bigint' for x in numbers)}, groups_sha256 string, rare array<bigint>"
    rows = cut(d.mapInArrow(scored, schema))
    rare = rows.select("row", F.explode("rare").alias("key")).join(ranked.filter(F.col("n") < least), "key")
    rare = rare.groupBy("row").agg(F.sum("n").alias("rare_sum"), F.sum(F.col("best").cast("long")).alias("rare_best"))
    more = lambda c, x: (F.col(c) + F.coalesce(F.col(x), F.lit(0))).alias(c)
    return rows.drop("rare").join(rare, "row", "left").select(F.col("id").alias(id_col), *numbers[:4], more("n_best", "rare_best"), more("count_sum", "rare_sum"), "groups_sha256")


def _known(spark: SparkSession, frequent: DataFrame):
    """A broadcast of the frequent pairs: sorted keys, their counts, whether each is its B id's best."""
    found = frequent.toArrow()
    key, n, best = (found.column(c).to_numpy() for c in ("key", "n", "best"))
    order = np.argsort(key)
    return spark.sparkContext.broadcast((key[order].astype(np.int64), n[order].astype(np.int64), best[order].astype(bool)))


def _scored(memory: Memory, part: pa.RecordBatch, key: np.ndarray, n: np.ndarray, best: np.ndarray, numbers: list[str]) -> pa.RecordBatch:
    found, counts = memory.read(part.column(2).to_pylist())
    used, back = np.unique(found, return_inverse=True)
    links, sizes = memory.links_of(used), memory.n_links(used)
    at = np.minimum(np.searchsorted(key, links), max(len(key) - 1, 0))
    common = key[at] == links if len(key) else np.zeros(len(links), bool)
    seg_sum, seg_best = _sums(np.where(common, n[at], 0), sizes) if len(key) else np.zeros(len(used), np.int64), _sums(common & best[at], sizes) if len(key) else np.zeros(len(used), np.int64)
    odd = ~common
    seg_rare = _sums(odd, sizes)
    with_rare = np.flatnonzero(seg_rare[back])  # segments, in the order of texts, that have rare links
    starts, each = np.cumsum(seg_rare) - seg_rare, seg_rare[back[with_rare]]
    places = np.repeat(starts[back[with_rare]] - (np.cumsum(each) - each), each) + np.arange(int(each.sum()))
    rare = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(_sums(seg_rare[back], counts))]), pa.int32()), pa.array(links[odd][places]))
    values = [_sums(x, counts) for x in (memory.n_a[found], memory.n_b[found], memory.n_groups[found], memory.n_links(found), seg_best[back], seg_sum[back])]
    digests, at_segment = [], 0
    for c in counts.tolist():
        mine = found[at_segment : at_segment + c].tolist()
        at_segment += c
        digests.append(hashlib.sha256("".join(map(memory.groups.__getitem__, mine))[:-1].encode()).hexdigest() if c else "")
    return pa.RecordBatch.from_arrays([part.column(0), part.column(1), *[pa.array(v, pa.int64()) for v in values], pa.array(digests, pa.string()), rare], ["row", "id", *numbers, "groups_sha256", "rare"])
