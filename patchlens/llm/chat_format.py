"""Chat formatting in budgeted windows of whole turns."""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchlens.llm.common import partitions, slices, small_batches
from patchlens.llm.token_counts import counter, special_strings, whole_tokens

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
#: What control strings look like, whatever the template: `<|...`, `<tag`, `</tag`, `<<SYS`, `[INST]`, `[/INST]` and the like begin so.
FORM = r"<(?=[|｜/<\w])|\[(?=/?[A-Z])"
_ESCAPED = re.compile(r"\\(.)", re.S)
_TURN = re.compile(re.escape(OPEN) + r"([^\n]*)\n(.*?)" + re.escape(CLOSE), re.S)
_MEANS = {"\\": "\\", "-": "", "n": "\n"}


@functools.lru_cache(8)
def control(special: tuple[str, ...] = ()) -> re.Pattern:
    """Matches the first character of whatever begins like a control string, or is one of the tokenizer's special strings."""
    return re.compile("|".join([FORM, *[f"{re.escape(s[0])}(?={re.escape(s[1:])})" for s in sorted(special) if s]]))


def escape(text: str, pattern: re.Pattern | None = None) -> str:
    r"""A backslash is doubled; a control string is broken by `\-` after its first character."""
    return (pattern or control()).sub(lambda m: m[0] + "\\-", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: _MEANS.get(m[1], m[0]), text)


def turn(role: str, text: str, pattern: re.Pattern | None = None) -> tuple[str, int, int]:
    """A formatted turn, and where its text starts and ends in it."""
    head = f"{OPEN}{escape(role, pattern).replace(chr(10), chr(92) + 'n')}\n"
    body = escape(text, pattern)
    return head + body + CLOSE, len(head), len(head) + len(body)


def parse(formatted: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, end) of each turn; start and end are of the escaped text in `formatted`."""
    return [(unescape(m[1]), unescape(m[2]), m.start(2), m.end(2)) for m in _TURN.finditer(formatted)]


def windows(turns: Iterable[tuple[str, str, int, int, int]], budget: int, history: int, system: str, target: str) -> Iterator[tuple]:
    """Windows of one conversation: (formatted, repeated turns, new turns, first new turn, loss starts, loss ends, tokens).

    turns: (role, formatted, text start, text end, tokens) in order. A window
    repeats the system turn (if the conversation starts with one) and, within
    `history` tokens, the last turns before its new ones; then come new turns
    while prefix sums of their tokens stay within `budget`, at least one. The
    loss covers the `target` texts of new turns only.
    """
    head: list[tuple] = []
    held: list[tuple] = []  # repeated turns besides the head, then new ones
    first, old, new, tokens, place = 0, 0, 0, 0, 0

    def made() -> tuple:
        lead = head if first else []
        starts, ends, at = [], [], 0
        for k, (role, text, a, b, _) in enumerate([*lead, *held]):
            if k >= len(lead) + old and role == target:
                starts.append(at + a)
                ends.append(at + b)
            at += len(text)
        return "".join(t[1] for t in [*lead, *held]), len(lead) + old, new, first, starts, ends, tokens

    for t in turns:
        if new and tokens + t[4] > budget:
            yield made()
            first, fixed = place, sum(h[4] for h in head)
            room, again = min(history, budget - fixed - t[4]), []
            for h in reversed(held[1:] if head and held and held[0] is head[0] else held):
                if h[4] > room:
                    break
                room -= h[4]
                again.insert(0, h)
            held, old, new = again, len(again), 0
            tokens = fixed + sum(h[4] for h in again)
        if place == 0 and t[0] == system:
            head = [t]
        held.append(t)
        new, tokens, place = new + 1, tokens + t[4], place + 1
    if new:
        yield made()


def format_windows(
    conversations: DataFrame,
    path: str,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    budget: int = 2048,
    history: int = 512,
    system: str = "system",
    target: str = "assistant",
    rows_per_task: int = 50_000,
) -> DataFrame:
    """Training windows of every conversation, a row each, with their loss mask.

    Turns are escaped (by the form of control strings, and the special strings
    of the file at `path`), formatted and counted (tokens by that file) where
    they are read. One shuffle brings a conversation's turns together
    and in order; windows are cut as turns stream by, so that a task holds one
    window, however long the conversation. A conversation's windows follow
    each other in one partition.

    Returns conv_col, window (its number, int), text, n_repeated (turns that
    the window before had already, or the system turn), n_new (turns seen
    first), first_turn (place of the first new one), loss_starts, loss_ends
    (arrays of code point offsets in text, of each target text), n_tokens. A
    turn over the budget has a window of its own, uncut. Null texts and roles
    are empty; turns of equal number go by role and text; null conversation
    ids are one conversation; rows that repeat are turns that repeat; an empty
    table gives an empty result.
    """
    spark = conversations.sparkSession
    small_batches(spark)
    whole = spark.sparkContext.broadcast(whole_tokens(path))
    c = conversations.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind, order = c.schema["conv"].dataType.simpleString(), c.schema["turn"].dataType.simpleString()

    def turns(batches):
        pattern = control(special_strings(path))
        for b in slices(batches, 3):
            roles = b.column(2).to_pylist()
            done = [turn(r, t, pattern) for r, t in zip(roles, b.column(3).to_pylist())]
            n = counter(path, whole)([d[0] for d in done]) if done else []
            cols = [b.column(0), b.column(1), b.column(2), pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int32()), pa.array([d[2] for d in done], pa.int32()), pa.array(n, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["conv", "turn", "role", "formatted", "a", "b", "tokens"])

    def cut(batches):
        types: list = []
        rest = _Groups(batches, types)
        out: list[tuple] = []
        for conv, own in rest:
            for k, w in enumerate(windows(own, budget, history, system, target)):
                out.append((conv, k, *w))
                if len(out) == 256:
                    yield _batch(out, types[0])
                    out = []
        if out:
            yield _batch(out, types[0])

    t = c.mapInArrow(turns, f"conv {kind}, turn {order}, role string, formatted string, a int, b int, tokens bigint")
    t = t.repartition(max(partitions(spark), math.ceil(conversations.count() / rows_per_task)), "conv").sortWithinPartitions("conv", "turn", "role", "formatted").select("conv", "role", "formatted", "a", "b", "tokens")
    out = t.mapInArrow(cut, f"conv {kind}, window int, text string, n_repeated int, n_new int, first_turn int, loss_starts array<int>, loss_ends array<int>, n_tokens bigint")
    return out.withColumnRenamed("conv", conv_col) if conv_col != "conv" else out


def _batch(rows: list[tuple], kind) -> pa.RecordBatch:
    conv, k, text, old, new, first, a, b, n = zip(*rows)
    arrays = [pa.array(conv, kind), *[pa.array(x, pa.int32()) if x is not text else pa.array(x, pa.string()) for x in (k, text, old, new, first)], pa.array(a, pa.list_(pa.int32())), pa.array(b, pa.list_(pa.int32())), pa.array(n, pa.int64())]
    return pa.RecordBatch.from_arrays(arrays, ["conv", "window", "text", "n_repeated", "n_new", "first_turn", "loss_starts", "loss_ends", "n_tokens"])


class _Groups:
    """(conversation, iterator of its turns) of sorted batches, holding one batch at a time."""

    def __init__(self, batches, types: list):
        self.rows, self.types = self._rows(batches), types
        self.next = next(self.rows, None)

    def _rows(self, batches):
        for b in slices(batches, 2):
            self.types.append(b.schema.field(0).type) if not self.types else None
            yield from zip(*[c.to_pylist() for c in b.columns])

    def __iter__(self):
        while self.next:
            conv = self.next[0]
            yield conv, self._own(conv)

    def _own(self, conv):
        while self.next and self.next[0] == conv:
            row, self.next = self.next, next(self.rows, None)
            yield row[1:]


def digests(formatted: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Per conversation, what its windows say when read back: see op10 in queries.

    Reads format_windows' rows as they come, a conversation's one after the
    other: each window is parsed, its repeated turns are left out, and the
    hashes go on from window to window.
    """
    import hashlib

    kind = formatted.schema[conv_col].dataType.simpleString()

    def read(batches):
        now, out, types = None, [], []

        def row():
            return now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5]

        def batch():
            cols = [pa.array(c, t) for c, t in zip(zip(*out), [types[0], pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()])]
            return pa.RecordBatch.from_arrays(cols, [conv_col, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for b in slices(batches, 2):
            types.append(b.schema.field(0).type)
            for conv, k, text, old, a, z in zip(*[c.to_pylist() for c in b.columns]):
                if k == 0:
                    if now:
                        out.append(row())
                    if len(out) >= 1000:
                        yield batch()
                        out = []
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, body, _, _ in parse(text)[old:]:
                    now[1] += 1
                    now[2].update(f"{role}\n{body}\n".encode("utf-8", "surrogatepass"))
                for s, e in zip(a, z):
                    plain = unescape(text[s:e])
                    now[3] += len(plain)
                    now[4].update(plain.encode("utf-8", "surrogatepass"))
                now[5] += len(text)
        if now:
            out.append(row())
        if out:
            yield batch()

    w = formatted.select(conv_col, "window", "text", "n_repeated", "loss_starts", "loss_ends")
    return w.mapInArrow(read, f"{conv_col} {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
