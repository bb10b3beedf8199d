"""Personal data: patterns, and terms that give protected entities away by their co-occurrence in the corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchlens.llm.common import cut, discard
from patchlens.llm.host_rules import _let

#: Kinds in their order, as Java patterns that find what these do, leftmost and in linear time:
#:   email  [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
#:   ip     [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
#:   card   [0-9]([\x20-]?[0-9])+
#:   phone  \+[0-9][\x20().0-9-]+[0-9]
#: A run of characters that fails from its start fails from all later places
#: in it, so a match starts at a run's start or where the one before ended;
#: possessive repeats keep Java from recursing.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?=[0-9][\x20-]?[0-9])[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = [*PATTERNS, "term"]
#: What a text must have for a kind to be looked for.
NEEDS = {"email": "@", "ip": ".", "phone": "+"}
BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
TERM = r"\p{L}{4,}+"
#: A code point that is no character; it frames matches while they are located.
FRAME = "﷐"
SPAN = "array<struct<kind: int, start: int, end: int>>"


def _valid(kind: str, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return m.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$")
    if kind == "phone":
        return F.length(digits).between(8, 15)
    figures = F.transform(F.split(F.reverse(digits), "(?!^)(?!$)"), lambda x: x.cast("int"))
    doubled = F.transform(figures, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d))
    luhn = F.aggregate(doubled, F.lit(0), lambda a, b: a + b) % 10 == 0
    return F.when(F.length(digits).between(16, 19), luhn).otherwise(False)


def located(text: Column, pattern: str, kind: int, valid) -> Column:
    """Spans of a pattern's valid matches, in order: places come from the lengths of the pieces between frames."""
    clean = F.when(F.instr(text, FRAME) > 0, F.translate(text, FRAME, "�")).otherwise(text)
    pieces = F.split(F.regexp_replace(clean, f"({pattern})", f"{FRAME}$1{FRAME}"), FRAME)

    def step(a: Column, x: Column) -> Column:
        n = F.char_length(x)
        span = F.struct(F.lit(kind).alias("kind"), a["at"].alias("start"), (a["at"] + n).alias("end"))
        spans = F.when(a["inside"] & valid(x), F.concat(a["spans"], F.array(span))).otherwise(a["spans"])
        return F.struct((a["at"] + n).alias("at"), (~a["inside"]).alias("inside"), spans.alias("spans"))

    zero = F.struct(F.lit(0).alias("at"), F.lit(False).alias("inside"), F.array().cast(SPAN).alias("spans"))
    return _let(pieces, lambda p: F.when(F.size(p) > 1, F.aggregate(p, zero, step, lambda a: a["spans"])).otherwise(F.array().cast(SPAN)))


def base_spans(text: Column) -> Column:
    """Spans of the four kinds, by kind, then start."""
    found = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        may = F.instr(text, NEEDS[kind]) > 0 if kind in NEEDS else F.lit(True)
        if kind != "email":
            may &= text.rlike("[0-9]")
        found.append(F.when(may, located(text, pattern, k, lambda m, kind=kind: _valid(kind, m))).otherwise(F.array().cast(SPAN)))
    return F.concat(*found)


def _words(text: Column) -> Column:
    """The different words of at least four letters, in small letters."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)))


def _entities(text: Column, s: Column) -> Column:
    """What a span stands for: its value, and the class that it is one of (mail domain, first half of the IP address, first figure of the card, country code of the phone)."""

    def both(m: Column) -> Column:
        of = F.when(s["kind"] == 0, F.substring_index(m, "@", -1)).when(s["kind"] == 1, F.regexp_extract(m, r"^([0-9]+\.[0-9]+)", 1)).when(s["kind"] == 2, F.left(m, F.lit(1))).otherwise(F.regexp_extract(m, r"^\+([0-9]{1,3})", 1))
        return F.array(F.concat_ws(":", s["kind"].cast("string"), m), F.concat_ws("@", s["kind"].cast("string"), of))

    return _let(F.lower(F.substring(text, s["start"] + 1, s["end"] - s["start"])), both)


def _near(text: Column, spans: Column, width: int) -> Column:
    """The different pairs (entity, term) of a text: each span's entities with the words within `width` code points of it; a word that the window cuts is none of them."""

    def around(s: Column) -> Column:
        left = F.greatest(F.lit(0), s["start"] - width)
        before = F.substring(text, left + 1, s["start"] - left)
        before = F.when(left > 0, F.regexp_replace(before, r"^\p{L}+", "")).otherwise(before)
        n = F.least(F.lit(width), F.char_length(text) - s["end"])
        after = F.substring(text, s["end"] + 1, n)
        after = F.when(s["end"] + n < F.char_length(text), F.regexp_replace(after, r"\p{L}+$", "")).otherwise(after)
        return _let(F.array_union(_words(before), _words(after)), lambda ts: F.flatten(F.transform(_entities(text, s), lambda e: F.transform(ts, lambda t: F.struct(e.alias("entity"), t.alias("term"))))))

    return F.array_distinct(F.flatten(F.transform(spans, around)))


def findings(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """A row per document without its text: id, key (a hash of the text), spans; of documents with spans also entities, near (pairs of entity and term) and words, each without repeats."""
    text = F.col("text")
    d = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("spans", base_spans(text))
    some = F.size("spans") > 0
    return cut(d.select("id", F.xxhash64("text").alias("key"), "spans", F.when(some, F.array_distinct(F.flatten(F.transform("spans", lambda s: _entities(text, s))))).alias("entities"), F.when(some, _near(text, F.col("spans"), width)).alias("near"), F.when(some, _words(text)).alias("words")))


def _beside(left: DataFrame, right: DataFrame, how: str, most: int) -> DataFrame:
    """A join on `key`; the right side is broadcast if it is counted to have at most `most` rows."""
    return left.join(F.broadcast(right) if right.count() <= most else right, "key", how)


def disclosing_terms(found: DataFrame, docs: DataFrame, text_col: str, generalise: float, remove: float, support: int) -> DataFrame:
    """By key, the terms to sanitise in a text: terms (array of term, instead).

    All numbers count different texts, so that copies change nothing. For a
    term t and an entity e, c(t,e) is how many have t within the width of e,
    c(e) and c(t) how many have e and t, N how many there are. The share of the
    entity's information that the term gives away is
    PMI(t;e) / IC(e) = log(c(t,e) N / (c(t) c(e))) / log(N / c(e)). It is 1 if
    the term is found with that entity only. Entities are values and their
    classes alike (see _entities): most values stand in one text, which proves
    nothing, so what a term tells of them is estimated on the class.

    A term of a share from `generalise` on is replaced by the most informative
    term of that entity under it, from `remove` on by nothing; in every text
    that has the entity, wherever the term stands in it.
    """
    copies = cut(found.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1"))
    n = found.count() - (copies.agg(F.sum(F.col("m") - 1)).first()[0] or 0)
    texts = cut(found.filter(F.size("spans") > 0).groupBy("key").agg(*[F.any_value(c).alias(c) for c in ("entities", "near", "words")]))
    of_entity = texts.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("c_e"))
    pairs = texts.select(F.explode("near").alias("p")).groupBy("p.entity", "p.term").agg(F.count("*").alias("c_te")).filter(F.col("c_te") >= support)
    d = docs.select(F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("key"), _words(F.col(text_col)).alias("words"))
    d = _beside(d, copies, "left", BROADCAST_KEYS).select((F.lit(1.0) / F.coalesce("m", F.lit(1))).alias("weight"), F.explode("words").alias("term"))
    of_term = d.groupBy("term").agg(F.round(F.sum("weight")).alias("c_t"))
    share = F.log(F.col("c_te") * n / (F.col("c_t") * F.col("c_e"))) / F.log(n / F.col("c_e"))
    judged = pairs.join(of_term, "term").join(of_entity, "entity").withColumn("share", F.when(F.col("c_e") < n, share)).filter("share > 0")
    judged = cut(judged.select("entity", "term", "share"))
    broader = judged.filter(F.col("share") < generalise).groupBy("entity").agg(F.max(F.struct("share", "term"))["term"].alias("broader"))
    told = judged.filter(F.col("share") >= generalise).join(broader, "entity", "left")
    told = told.select("entity", "term", "share", F.when(F.col("share") >= remove, "").otherwise(F.coalesce("broader", F.lit("<TERM>"))).alias("instead"))
    met = texts.select("key", F.explode("words").alias("term")).join(told, "term").join(texts.select("key", F.explode("entities").alias("entity")), ["key", "entity"])
    best = met.groupBy("key", "term").agg(F.max(F.struct("share", "entity", "instead"))["instead"].alias("instead"))
    out = cut(best.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("term", "instead"))).alias("terms")))
    discard(copies, texts, judged)
    return out


def _occurrences(text: Column, terms: Column) -> Column:
    """Places of the terms (array of term, instead) in a text: array of start, end, instead."""
    meant = lambda m: F.filter(terms, lambda x: x["term"] == F.lower(m))
    spots = located(text, TERM, len(PATTERNS), lambda m: F.size(meant(m)) > 0)
    found = F.transform(spots, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.get(meant(F.substring(text, s["start"] + 1, s["end"] - s["start"])), 0)["instead"].alias("instead")))
    return F.when(F.size(terms) > 0, found)


def _apart(terms: Column, spans: Column) -> Column:
    """The terms that touch no other span."""
    t = F.coalesce(terms, F.array().cast("array<struct<start: int, end: int, instead: string>>"))
    return F.filter(t, lambda x: ~F.exists(spans, lambda s: (s["start"] < x["end"]) & (x["start"] < s["end"])))


#: Texts with terms up to which these are broadcast (some 100 bytes each), and repeated texts up to which their numbers are (16 bytes each).
BROADCAST_ROWS = 100_000
BROADCAST_KEYS = 1_000_000


def find_personal_data(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 80,
    generalise: float = 0.75,
    remove: float = 0.9,
    support: int = 2,
    sanitised: bool = False,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Spans of personal data in every text, and of terms that disclose it; with `sanitised`, the texts without them.

    Protected entities are e-mail and IP addresses, card and phone numbers, found by
    patterns in the whole text. A word of at least four letters that stands
    within `width` code points of an entity in at least `support` different
    texts (1: in any) is a term; it discloses the entity if it gives away at
    least the share `generalise` of its information (see disclosing_terms).
    An entity is a value or its class (mail domain, half of the IP address,
    first figure of the card, country code).
    Then it is a span wherever it stands in a text that has the entity, near or
    far. Terms that touch a base span stay out. In sanitised texts base spans become
    <EMAIL>, <IP>, <CARD>, <PHONE> (spans that overlap become one, named after
    the first); a term becomes the most informative one of its entity that
    discloses too little (<TERM> if there is none), or nothing at a share of
    `remove` or more.

    Texts are read for the patterns, for words' numbers of texts, and for the
    places of terms, never with a shuffle of texts unless more than
    BROADCAST_KEYS texts repeat or more than BROADCAST_ROWS have terms. Words
    are counted with map-side combine. All else is rows of the texts that hold an entity.

    Returns id_col, n_email, n_ip, n_card, n_phone, n_term (long), spans (array of
    kind number in KINDS, start, end: code points, end exclusive; by kind, then start)
    and, if sanitised, text_col and the `keep` columns. Null text counts as
    empty; in sanitised texts it stays null. Null ids and repeated rows are
    kept, each judged by its text. An empty table gives an empty result.
    """
    found = findings(docs, id_col, text_col, width)
    terms = disclosing_terms(found, docs, text_col, generalise, remove, support)
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *[F.col(c).alias(f"keep_{i}") for i, c in enumerate(keep)]).withColumn("key", F.xxhash64(text))
    if sanitised:
        discard(found)
        d = _beside(d.withColumn("spans", base_spans(text)), terms, "left", BROADCAST_ROWS).withColumn("terms", _occurrences(text, F.col("terms")))
    else:
        spots = _beside(d.select("key", "text"), terms, "inner", BROADCAST_ROWS).select("key", _occurrences(text, F.col("terms")).alias("terms"))
        spots = cut(spots.groupBy("key").agg(F.any_value("terms").alias("terms")))
        discard(terms)
        d = _beside(found.select("id", "key", "spans"), spots, "left", BROADCAST_ROWS)
    d = d.withColumn("terms", _apart(F.col("terms"), F.col("spans")))
    number = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    every = F.concat("spans", F.transform("terms", lambda x: F.struct(F.lit(len(PATTERNS)).alias("kind"), x["start"].alias("start"), x["end"].alias("end"))))
    out = [F.col("id").alias(id_col), *[number(k).alias(f"n_{kind}") for k, kind in enumerate(PATTERNS)], F.size("terms").cast("long").alias("n_term"), every.alias("spans")]
    if sanitised:
        out += [_sanitise(F.col("text"), F.col("spans"), F.col("terms")).alias(text_col), *[F.col(f"keep_{i}").alias(c) for i, c in enumerate(keep)]]
    return d.select(*out)


def _sanitise(text: Column, spans: Column, terms: Column) -> Column:
    tags = F.array(*[F.lit(f"<{k.upper()}>") for k in PATTERNS])
    marks = F.concat(
        F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.get(tags, s["kind"]).alias("tag"))),
        F.transform(terms, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["instead"].alias("tag"))),
    )

    def step(a: Column, m: Column) -> Column:
        apart = m["start"] >= a["at"]
        piece = F.concat(F.substring(text, a["at"] + 1, m["start"] - a["at"]), m["tag"])
        return F.struct(F.greatest(a["at"], m["end"]).alias("at"), F.when(apart, F.concat(a["out"], F.array(piece))).otherwise(a["out"]).alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    rest = lambda a: F.concat(F.array_join(a["out"], ""), F.substring(text, a["at"] + 1, F.char_length(text)))
    return _let(F.array_sort(marks), lambda m: F.when(F.size(m) > 0, F.aggregate(m, zero, step, rest)).otherwise(text))


def spans_text(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
