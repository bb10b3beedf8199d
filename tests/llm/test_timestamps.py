"""Timestamps against the grammar as one regular expression and zone rules as the library of zones has them."""

from __future__ import annotations

import random
import re
from collections import Counter
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pytest

from patchlens.llm.timestamps import changes, normalise_timestamps, scanned, to_utc

FORMS = [r"(?P<y>20\d\d)-(?P<m>\d\d)-(?P<d>\d\d)", r"(?P<y>20\d\d)(?P<m>\d\d)(?P<d>\d\d)", r"(?P<d>\d\d)\.(?P<m>\d\d)\.(?P<y>20\d\d)", r"(?P<d>\d\d) (?P<b>Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec) (?P<y>20\d\d)", r"(?P<d>\d\d)/(?P<m>\d\d)/(?P<y>20\d\d)"]
TAIL = r"(?P<t>[T ](?P<h>\d\d):(?P<mi>\d\d)(:(?P<s>\d\d))?( ?(?P<ap>[AP]M))?( ?(?P<o>Z|(?P<sg>[+-])(?P<oh>\d\d):?(?P<om>\d\d)))?)?"
MONTHS = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()


def plain(raw, zone):
    """(slashed, day-first wall or None, month-first wall or None, offset or None) or None for a bad stamp; a number for an epoch."""
    text = (raw or "").strip(" \t\n\v\f\r")
    if re.fullmatch("[0-9]{10}|[0-9]{13}", text):
        return int(text) * (10**6 if len(text) == 10 else 1000)
    for k, form in enumerate(FORMS):
        g = re.fullmatch(form + TAIL, text, re.A)
        if not g:
            continue
        g = g.groupdict()
        h, mi, s = (int(g[x] or 0) for x in ("h", "mi", "s"))
        if g["ap"]:
            if not 1 <= h <= 12:
                return None
            h = h % 12 + 12 * (g["ap"] == "PM")
        month = MONTHS.index(g["b"]) + 1 if g.get("b") else int(g["m"])

        def wall(month, day):
            try:
                return datetime(int(g["y"]), month, day, h, mi, s)
            except ValueError:
                return None

        walls = wall(month, int(g["d"])), wall(int(g["d"]), month) if k == 4 else None
        off = None
        if g["o"]:
            off = timedelta(0) if g["o"] == "Z" else timedelta(hours=int(g["oh"]), minutes=int(g["om"])) * (-1 if g["sg"] == "-" else 1)
            if g["o"] != "Z" and (int(g["oh"]) > 14 or int(g["om"]) > 59):
                return None
        elif zone not in ZONES:
            return None
        return None if walls == (None, None) else (k == 4, *walls, off)
    return None


ZONES = ["Europe/Berlin", "America/New_York", "Asia/Kolkata", "UTC", "Australia/Lord_Howe", "America/St_Johns"]


def utc(wall, off, zone):
    if off is not None:
        return round((wall - off - datetime(1970, 1, 1)).total_seconds() * 10**6), False
    at = [wall.replace(tzinfo=ZoneInfo(zone), fold=f).utcoffset() for f in (0, 1)]
    return round((wall - at[0] - datetime(1970, 1, 1)).total_seconds() * 10**6), at[0] != at[1]


def brute(rows):
    read = [plain(raw, zone) for _, _, zone, raw in rows]
    votes = Counter()
    for (_, source, _, _), p in zip(rows, read):
        if isinstance(p, tuple) and p[0] and None in p[1:3]:
            votes[source, "d" if p[2] is None else "m"] += 1
    for (i, source, zone, _), p in zip(rows, read):
        if p is None:
            yield i, None, "bad", False
        elif isinstance(p, int):
            yield i, p, "epoch", False
        else:
            slashed, day, month, off = p
            if slashed and day and month and day != month:
                d, m = votes[source, "d"], votes[source, "m"]
                yield i, utc(day if d > m else month, off, zone)[0], "votes" if d != m else "default", True
            else:
                t, odd = utc(day or month, off, zone)
                yield i, t, "plain", odd


def stamps(n=6000):
    r = random.Random(11)
    two = lambda a, b: f"{r.randint(a, b):02}"
    rows = []
    for k in range(n):
        y, m, d = f"20{two(0, 99)}" if r.random() < 0.3 else "2024", two(0, 13), two(0, 32)
        if r.random() < 0.3:  # near changes of offset
            y, m, d = "2024", *r.choice([("03", "31"), ("03", "10"), ("11", "03"), ("10", "27"), ("04", "07"), ("10", "06")])
        date = r.choice([f"{y}-{m}-{d}", f"{y}{m}{d}", f"{d}.{m}.{y}", f"{d} {r.choice(MONTHS + ['jan', 'Mai'])} {y}", f"{d}/{m}/{y}", f"{m}/{d}/{y}", f"{d}/{m}/{y}"])
        tail = r.choice(["", f"{r.choice('T T_')}{two(0, 24)}:{two(0, 60)}", f" {two(0, 3)}:{two(0, 59)}:{two(0, 60)}"])
        if tail:
            tail += r.choice(["", "", "", " AM", "PM", " am"]) + r.choice(["", "", "", "Z", " Z", "+05:30", f"-{two(0, 15)}{two(0, 61)}", " +0100", "+1"])
        raw = r.choice([date + tail] * 12 + ["".join(r.choices("0123456789", k=r.choice([9, 10, 13, 8]))), None, "", "n/a", date[:-1], (date + tail)[: r.randint(0, 20)], " \t" + date + tail + "\n", "٢٠٢٤-01-01", " " + date])
        rows.append((None if k % 90 == 5 else k % (n - 50), r.choice(["a", "b", "c", "d", None, f"rare{k % 40}"]), r.choice(ZONES * 3 + [None, "Nowhere", "", "../x", "America"]), raw))
    return rows


@pytest.mark.parametrize("broadcast", [20_000, 0])
def test_stamps_equal_brute_force(spark, broadcast):
    rows = stamps()
    df = spark.createDataFrame([(*x, 1, "x", True) for x in rows], "stamp_id long, source string, zone string, raw string, id int, rule string, verdict boolean").repartition(6)
    got = normalise_timestamps(df, broadcast=broadcast)
    assert got.columns == ["stamp_id", "utc_us", "rule", "ambiguous"]
    want = Counter(brute(rows))
    assert {x[2] for x in want} == {"bad", "epoch", "plain", "votes", "default"}
    assert Counter(map(tuple, got.collect())) == want


def test_no_stamps(spark):
    assert normalise_timestamps(spark.createDataFrame([], "stamp_id long, source string, zone string, raw string")).collect() == []


def test_skipped_and_repeated_wall_times():
    known = {z: changes(z) for z in ZONES}
    for raw, zone, want in [
        ("2024-03-10 02:30", "America/New_York", (1710055800000000, True)),
        ("2024-03-10 03:00", "America/New_York", (1710054000000000, False)),
        ("2024-11-03 01:30", "America/New_York", (1730611800000000, True)),
        ("2024-11-03 02:00", "America/New_York", (1730617200000000, False)),
        ("2024-11-03 00:59:59", "America/New_York", (1730609999000000, False)),
        ("2024-07-01 12:00 PM", "Asia/Kolkata", (1719815400000000, False)),
    ]:
        assert to_utc(scanned(raw, zone, known)[1], zone, known) == want
