"""Mixed timestamps to UTC: a recursive-descent scanner, a vote per source on the order of slashed dates, bisection over zone changes."""

from __future__ import annotations

import bisect
import functools
import operator
import zoneinfo
from collections.abc import Iterator
from datetime import date, datetime, timedelta, timezone

from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MONTHS = {name: f"{k:02}" for k, name in enumerate("Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split(), 1)}
SPACE = " \t\n\v\f\r"
#: Sources with a verdict up to which the verdicts are broadcast; more meet their rows in a join.
BROADCAST_SOURCES = 20_000
#: Parts of a source's rows in that join.
SALTS = 64
#: Years whose zone changes are known: those that a stamp can have, with a margin.
YEARS = range(1999, 2102)
SECOND, DAY = 1_000_000, 86_400_000_000
_EPOCH = date(1970, 1, 1).toordinal()
#: What a scanned stamp is. EITHER: a slashed date that is another day with its first two parts swapped.
BAD, EPOCH, PLAIN, EITHER = range(4)
DAY_FIRST, MONTH_FIRST = "day", "month"


#: See `changes`.
Changes = tuple[list[int], list[int], list[int]]


class _Bad(Exception):
    """A stamp that the grammar doesn't have, or an impossible one."""


class Scanner:
    """stamp: date [clock]; date: y-m-d | ymd | d.m.y | d b y | d/m/y; clock: (T | space) h:m[:s] [[space] (AM | PM)] [[space] (Z | (+ | -) h[:]m)].

    Each method reads one rule from where the last one ended.
    """

    def __init__(self, text: str):
        self.text, self.at = text, 0

    def stamp(self) -> tuple[list[int | None], bool, int, int | None]:
        """(days, slashed, microseconds of the day, offset in minutes). days: since 1970; of a slashed date the reading with the day first and that with the month first, None for an impossible one."""
        days, slashed = self.date()
        clock, offset = self.clock() if self.at < len(self.text) else (0, None)
        if self.at < len(self.text) or not any(d is not None for d in days):
            raise _Bad
        return days, slashed, clock, offset

    def date(self) -> tuple[list[int | None], bool]:
        first = self.digits(2)
        mark = self.peek()
        if mark in (".", "/"):
            self.take(mark)
            second = self.digits(2)
            self.take(mark)
            year = self.year(self.digits(2))
            return ([day(year, second, first)], False) if mark == "." else ([day(year, second, first), day(year, first, second)], True)
        if mark == " ":
            self.take(" ")
            month = MONTHS.get(self.text[self.at : self.at + 3])
            if month is None:
                raise _Bad
            self.at += 3
            self.take(" ")
            return [day(self.year(self.digits(2)), month, first)], False
        year = self.year(first)
        dashed = self.maybe("-")
        month = self.digits(2)
        if dashed:
            self.take("-")
        return [day(year, month, self.digits(2))], False

    def year(self, century: str) -> str:
        if century != "20":
            raise _Bad
        return century + self.digits(2)

    def clock(self) -> tuple[int, int | None]:
        if not (self.maybe("T") or self.maybe(" ")):
            raise _Bad
        hour = int(self.digits(2))
        self.take(":")
        minute, second = self.under(60), 0
        if self.maybe(":"):
            second = self.under(60)
        half = self.suffix(("AM", "PM"))
        if half is None:
            if hour > 23:
                raise _Bad
        elif 1 <= hour <= 12:
            hour = hour % 12 + 12 * (half == "PM")
        else:
            raise _Bad
        return ((hour * 60 + minute) * 60 + second) * SECOND, self.offset()

    def offset(self) -> int | None:
        sign = self.suffix(("Z", "+", "-"))
        if sign is None or sign == "Z":
            return None if sign is None else 0
        hours = self.under(15)
        self.maybe(":")
        return (hours * 60 + self.under(60)) * (-1 if sign == "-" else 1)

    def suffix(self, names: tuple[str, ...]) -> str | None:
        """One of the names, perhaps behind a space; nothing is read where there is none."""
        at = self.at + (self.peek() == " ")
        found = next((n for n in names if self.text.startswith(n, at)), None)
        if found:
            self.at = at + len(found)
        return found

    def under(self, most: int) -> int:
        n = int(self.digits(2))
        if n >= most:
            raise _Bad
        return n

    def digits(self, n: int) -> str:
        found = self.text[self.at : self.at + n]
        if len(found) < n or not (found.isascii() and found.isdigit()):
            raise _Bad
        self.at += n
        return found

    def peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def maybe(self, mark: str) -> bool:
        found = self.text.startswith(mark, self.at)
        self.at += found
        return found

    def take(self, mark: str) -> None:
        if not self.maybe(mark):
            raise _Bad


@functools.lru_cache(1 << 16)
def day(year: str, month: str, of_month: str) -> int | None:
    """Days since 1970; None for a date that doesn't exist."""
    try:
        return date(int(year), int(month), int(of_month)).toordinal() - _EPOCH
    except ValueError:
        return None


def scanned(raw: str | None, zone: str | None, zones: dict[str, Changes]) -> tuple[int, int | None, int | None, str | None, str | None]:
    """(what it is, time, time if the month is first, zone, vote): times in microseconds, UTC where the zone is None, else on the zone's wall. `zones`: those that are known."""
    text = (raw or "").strip(SPACE)
    if len(text) in (10, 13) and text.isascii() and text.isdigit():
        return EPOCH, int(text) * (SECOND if len(text) == 10 else 1000), None, None, None
    try:
        days, slashed, clock, offset = Scanner(text).stamp()
    except _Bad:
        return BAD, None, None, None, None
    if offset is None and zone not in zones:
        return BAD, None, None, None, None
    shift = clock - (offset or 0) * 60 * SECOND
    times = [None if d is None else d * DAY + shift for d in days]
    where = zone if offset is None else None
    if not slashed or times[0] == times[1]:
        return PLAIN, times[0], None, where, None
    if None in times:
        return PLAIN, times[0] if times[1] is None else times[1], None, where, DAY_FIRST if times[1] is None else MONTH_FIRST
    return EITHER, *times, where, None


def changes(zone: str) -> Changes:
    """Of a zone, in microseconds: wall times from which the offset behind each change holds, wall times from which that change's skipped or repeated ones begin, and the offsets before, between and behind all changes."""
    info = zoneinfo.ZoneInfo(zone)
    offset = lambda t: info.utcoffset(datetime.fromtimestamp(t, timezone.utc).astimezone(info)) // timedelta(seconds=1)
    start, end = (int(datetime(y, 1, 1, tzinfo=timezone.utc).timestamp()) for y in (YEARS[0], YEARS[-1]))
    holds, begins, offsets = [], [], [offset(start)]
    for t in range(start, end, 86_400):
        if offset(t + 86_400) != offsets[-1]:
            low, high = t, t + 86_400
            while high - low > 1:
                mid = (low + high) // 2
                low, high = (mid, high) if offset(mid) == offsets[-1] else (low, mid)
            new = offset(high)
            holds.append((high + max(offsets[-1], new)) * SECOND)
            begins.append((high + min(offsets[-1], new)) * SECOND)
            offsets.append(new)
    return holds, begins, [o * SECOND for o in offsets]


def to_utc(wall: int, zone: str | None, zones: dict[str, Changes]) -> tuple[int, bool]:
    """UTC of a wall time, and whether the zone's clocks skip or repeat it; such a one takes the offset before the change."""
    if zone is None:
        return wall, False
    holds, begins, offsets = zones[zone]
    k = bisect.bisect_right(holds, wall)
    return wall - offsets[k], k < len(begins) and wall >= begins[k]


def finished(what: int, time: int | None, month_first: int | None, zone: str | None, verdict: str | None, zones: dict[str, Changes]) -> tuple[int | None, str, bool]:
    """(utc, rule, ambiguous) of a scanned stamp, under its source's verdict."""
    if what == BAD:
        return None, "bad", False
    if what == EITHER:
        utc, _ = to_utc(time if verdict == DAY_FIRST else month_first, zone, zones)
        return utc, "votes" if verdict else "default", True
    utc, odd = to_utc(time, zone, zones)
    return utc, "epoch" if what == EPOCH else "plain", odd


def verdicts(parsed: RDD, over: float = 1.0) -> RDD:
    """(source, order) of each source where one order has over `over` times the other's votes. `parsed`: (id, source, *scanned)."""

    def votes(rows: Iterator[tuple]) -> Iterator[tuple]:
        for r in rows:
            if r[6]:
                yield (r[1], r[6]), 1

    def by_source(vote):
        (source, order), n = vote
        return source, (n, 0) if order == DAY_FIRST else (0, n)

    # one row a task and (source, order) is shuffled, then one of each source
    both = parsed.mapPartitions(votes).reduceByKey(operator.add).map(by_source).reduceByKey(lambda x, y: (x[0] + y[0], x[1] + y[1]))
    decided = both.mapValues(lambda n: DAY_FIRST if n[0] > over * n[1] else MONTH_FIRST if n[1] > over * n[0] else None)
    return decided.filter(lambda x: x[1] is not None)


def normalise_timestamps(stamps: DataFrame, id_col: str = "stamp_id", source_col: str = "source", zone_col: str = "zone", raw_col: str = "raw", over: float = 1.0, broadcast: int = BROADCAST_SOURCES) -> DataFrame:
    """Every stamp's time in UTC. Returns id_col, utc_us (long; null where bad), rule (string), ambiguous (boolean).

    rule: `epoch` for ten digits (seconds) or thirteen (milliseconds); `bad`
    for what the grammar (see Scanner) doesn't have, impossible dates and
    times, null, and stamps without offset whose zone is null or unknown;
    `votes` and `default` for slashed dates that are two different days; else
    `plain`. Slashed stamps that are possible in one order only vote for it in
    their source (null is a source like others); an order with over `over`
    times the other's votes wins the source, else the month is first. Wall
    times that a zone skips or repeats take the offset before the change and
    are ambiguous, as are `votes` and `default`.

    The changes of the zones that occur, of all that the driver knows (some
    600), are broadcast. Stamps are scanned twice, for the votes and for the
    rows; both times each row stays in the task that reads it. Votes are added up in tasks before
    they are shuffled. Verdicts are broadcast for up to `broadcast` sources;
    for more, the rows that need one are joined to them by source, in SALTS
    parts of each source. Null and repeated ids stay as rows; an empty table
    gives an empty result.
    """
    spark = stamps.sparkSession
    s = stamps.select(F.col(id_col).alias("id"), *[F.col(c).cast("string").alias(n) for c, n in ((source_col, "source"), (zone_col, "zone"), (raw_col, "raw"))])

    met = s.filter(F.col("zone").isin(*sorted(zoneinfo.available_timezones()))).select("zone").distinct().collect()
    zones = spark.sparkContext.broadcast({r["zone"]: changes(r["zone"]) for r in met})

    def scan(rows):
        known = zones.value
        for i, source, zone, raw in rows:
            yield i, source, *scanned(raw, zone, known)

    parsed = s.rdd.mapPartitions(scan)
    decided = verdicts(parsed, over)
    out = T.StructType([T.StructField(id_col, s.schema["id"].dataType), T.StructField("utc_us", T.LongType()), T.StructField("rule", T.StringType()), T.StructField("ambiguous", T.BooleanType())])
    if decided.count() <= broadcast:
        of = spark.sparkContext.broadcast(decided.collectAsMap())

        def finish(rows):
            verdict, known = of.value, zones.value
            for i, source, what, time, month_first, zone, _ in rows:
                yield i, *finished(what, time, month_first, zone, verdict.get(source), known)

        return spark.createDataFrame(parsed.mapPartitions(finish), out, verifySchema=False)
    fields = [T.StructField("id", s.schema["id"].dataType), T.StructField("source", T.StringType()), T.StructField("what", T.IntegerType()), T.StructField("time", T.LongType()), T.StructField("month_first", T.LongType()), T.StructField("zone", T.StringType()), T.StructField("vote", T.StringType())]
    rows = spark.createDataFrame(parsed, T.StructType(fields), verifySchema=False)
    verdict = spark.createDataFrame(decided, "by_source string, verdict string", verifySchema=False).withColumn("by_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    either = rows.filter(F.col("what") == EITHER).withColumn("salt", F.pmod(F.xxhash64("id", "time", "month_first"), F.lit(SALTS)).cast("int"))
    told = either.join(verdict, F.col("source").eqNullSafe(F.col("by_source")) & (F.col("salt") == F.col("by_salt")), "left").select(*rows.columns, "verdict")
    every = rows.filter(F.col("what") != EITHER).withColumn("verdict", F.lit(None).cast("string")).unionByName(told)

    def finish_joined(rows):
        known = zones.value
        for i, _, what, time, month_first, zone, _, verdict in rows:
            yield i, *finished(what, time, month_first, zone, verdict, known)

    return spark.createDataFrame(every.rdd.mapPartitions(finish_joined), out, verifySchema=False)
