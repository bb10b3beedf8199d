"""N-gram Jaccard join: rare-first prefixes, length, positional and suffix filters, one verification per pair."""

from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from patchlens.llm.common import cut, discard, partitions, slices, small_batches
from patchlens.llm.components import components
from patchlens.llm.shingles import shingle_sets

#: Buckets of the frequency sketch, as a power of two: what is broadcast has one byte for each, whatever the corpus.
SKETCH_BITS = 23
#: Parts in which the sketch travels.
SKETCH_PARTS = 64
#: Parts of the suffix filter.
SUFFIX_PARTS = 64
#: Postings of one token that a task gets at most, about.
TOKEN_ROWS = 4096
#: Components of one token and size that a task pairs with others at most, about.
TOKEN_COMPONENTS = 16_384
#: Ids up to which the documents to verify are found by a broadcast join, and tokens up to which salts are.
BROADCAST_IDS = 200_000


def frequencies(docs: DataFrame, width: int, bits: int) -> np.ndarray:
    """How frequent shingles are: for each of 2**bits ranges of hashes a class, 8 to the doubling.

    All documents count. Each task sums its own sketch and sends it as 64
    compressed parts; parts are added up as they stream by. The result has
    one byte a range. The join's result does not depend on it: any order of
    tokens is right, rare-first ones leave few candidates. Where the ranges
    are fewer than the corpus's shingles (over some 100 GB), only tokens more
    frequent than their range's others stand out.
    """

    def sketch(batches):
        total = np.zeros(1 << bits, np.uint32)
        for b in slices(batches, 0):
            sets = shingle_sets(b.column(0).to_pylist(), width)
            if sets:
                np.add.at(total, (np.concatenate(sets) >> np.uint64(64 - bits)).astype(np.int64), np.uint32(1))
        parts = [zlib.compress(p.astype("<u4").tobytes(), 1) for p in np.split(total, SKETCH_PARTS)]
        yield pa.RecordBatch.from_arrays([pa.array(range(SKETCH_PARTS), pa.int32()), pa.array(parts, pa.binary())], ["part", "counts"])

    size = (1 << bits) // SKETCH_PARTS

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for part, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                counts = np.frombuffer(zlib.decompress(data), "<u4")
                if part in sums:
                    sums[part] += counts
                else:
                    sums[part] = counts.astype(np.int64)
        ranks = [np.minimum(255, 8 * np.log2(np.maximum(s, 1))).astype(np.uint8).tobytes() for s in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(ranks, pa.binary())], ["part", "ranks"])

    sent = docs.select("text").mapInArrow(sketch, "part int, counts binary").repartition(min(SKETCH_PARTS, partitions(docs.sparkSession)), "part")
    found = dict(tuple(r) for r in sent.mapInArrow(add, "part int, ranks binary").collect())
    none = bytes(size)
    return np.frombuffer(b"".join(found.get(i, none) for i in range(SKETCH_PARTS)), np.uint8)


def prefix_length(n: int, percent: int) -> int:
    """Least tokens of which a set of `n` shares one with every set alike by `percent`."""
    return n - -(-percent * n // 100) + 1


def signatures(docs: DataFrame, width: int, percent: int, ranks, bits: int) -> DataFrame:
    """Per document (id, key, text): n, node (a digest of its set), prefix (its rarest tokens, in order), marks (the part of the suffix filter that each of these is in), sizes (of all parts of its set).

    A token is a shingle's class of frequency, then its hash, so that tokens' order is rare-first.
    """
    kind = docs.schema["id"].dataType.simpleString()

    def sign(batches):
        for b in slices(batches, 2):
            order = ranks.value
            n, nodes, tokens, ends, marks, sizes = [], [], [], [0], [], []
            for s in shingle_sets(b.column(2).to_pylist(), width):
                n.append(len(s))
                nodes.append(_digest(s))
                t = (order[(s >> np.uint64(64 - bits)).astype(np.int64)].astype(np.uint64) << np.uint64(55)) | (s >> np.uint64(9))
                p = prefix_length(len(s), percent) if len(s) else 0
                first = np.argpartition(t, p - 1)[:p] if 0 < p < len(t) else np.arange(p)
                first = first[np.argsort(t[first])]
                part = (s & np.uint64(SUFFIX_PARTS - 1)).astype(np.uint8)
                tokens.append(t[first])
                ends.append(ends[-1] + p)
                marks.append(part[first].tobytes())
                sizes.append(np.bincount(part, minlength=SUFFIX_PARTS).astype("<u4").tobytes())
            prefix = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(tokens).view(np.int64), pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(nodes, pa.int64()), prefix, pa.array(marks, pa.binary()), pa.array(sizes, pa.binary())], ["id", "key", "n", "node", "prefix", "marks", "sizes"])

    return docs.select("id", "key", "text").mapInArrow(sign, f"id {kind}, key bigint, n bigint, node bigint, prefix array<bigint>, marks binary, sizes binary")


def _digest(s: np.ndarray) -> int | None:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True) if len(s) else None


def _overlap(a: Column, b: Column, percent: int) -> Column:
    """Whole shingles that sets of sizes a and b must share, times (100 + percent)."""
    return percent * (a + b)


def _passes(percent: int, na, pa_, nb, pb) -> Column:
    """Length and positional filter: what can still be shared from the tokens' places on is enough."""
    rest = 1 + F.least(na - pa_ - 1, nb - pb - 1)
    return (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & ((100 + percent) * rest >= _overlap(na, nb, percent))


def _behind(sizes: list[bytes], marks: list[bytes], places: list[int]) -> np.ndarray:
    """(row, part): sizes of the parts of each set's tokens behind its place."""
    whole = np.frombuffer(b"".join(sizes), "<u4").reshape(len(sizes), SUFFIX_PARTS).astype(np.int64)
    before = [m[: p + 1] for m, p in zip(marks, places)]
    at = np.repeat(np.arange(len(sizes)), [len(m) for m in before]) * SUFFIX_PARTS + np.frombuffer(b"".join(before), np.uint8)
    return whole - np.bincount(at, minlength=whole.size).reshape(whole.shape)


def _suffix_filter(pairs: DataFrame, nodes: DataFrame, percent: int, first: bool) -> DataFrame:
    """Pairs (a, b, i, j) whose sets could share enough, judged by their suffixes: the tokens behind the places i and j of one they share.

    Both suffixes fall into the same 64 parts by hash; what they share of a
    part is at most the smaller of its two sizes. Before the places lies
    nothing shared if they are those of the `first` shared token, else at most
    the lesser of i and j.
    """
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("marks").alias(f"m_{x}"), F.col("sizes").alias(f"s_{x}"))
    j = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "i", "j", "n_a", "n_b", "m_a", "m_b", "s_a", "s_b")

    def could(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                b = batch.slice(at, 4096)
                i, k, na, nb = (b.column(c).to_numpy().astype(np.int64) for c in (2, 3, 4, 5))
                ma, mb, sa, sb = (b.column(c).to_pylist() for c in (6, 7, 8, 9))
                most = 1 + np.minimum(_behind(sa, ma, i.tolist()), _behind(sb, mb, k.tolist())).sum(1)
                if not first:
                    most = most + np.minimum(i, k)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array((100 + percent) * most >= percent * (na + nb)))

    return j.mapInArrow(could, "a bigint, b bigint")


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) that are alike, each checked once on its two whole sets.

    Only documents in some pair are looked up: by a broadcast of their ids if
    these are few (counted first), else by a shuffle.
    """
    pairs = cut(pairs)
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    ids = cut(nodes.join(wanted, "node", "left_semi").select("rep"))
    texts = docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, docs["id"].eqNullSafe(F.col("rep")), "left_semi").select("text")

    def sets(batches):
        for b in slices(batches, 0):
            found = shingle_sets(b.column(0).to_pylist(), width)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([_digest(s) for s in found], pa.int64()), pa.array([s.tobytes() for s in found], pa.binary())], ["node", "items"])

    whole = cut(texts.mapInArrow(sets, "node bigint, items binary").join(wanted, "node", "left_semi").dropDuplicates(["node"]))
    j = pairs.join(whole.toDF("a", "x"), "a").join(whole.toDF("b", "y"), "b")

    def check(batches):
        for b in batches:
            alike = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                alike.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(alike, pa.bool_()))

    alike = cut(j.select("a", "b", "x", "y").mapInArrow(check, "a bigint, b bigint"))
    discard(pairs, ids, whole)
    return alike


def _pair(x: Column, i: Column, y: Column, j: Column) -> list[Column]:
    """Two nodes and the places of a token in them, the lesser node first."""
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b"), F.when(x < y, i).otherwise(j).alias("i"), F.when(x < y, j).otherwise(i).alias("j")]


def _once(pairs: DataFrame) -> DataFrame:
    """Each pair once, with the places of its first token."""
    return pairs.groupBy("a", "b").agg(F.min(F.struct("i", "j")).alias("p")).select("a", "b", "p.i", "p.j")


class _Join:
    """What both forms of the join share: signatures of documents, one node per different set, tokens that nodes share."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, width: int, percent: int):
        small_batches(docs.sparkSession)
        self.width, self.percent = width, percent
        text = F.coalesce(F.col(text_col), F.lit(""))
        self.docs = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("key"), text.alias("text"))
        bits = SKETCH_BITS
        ranks = docs.sparkSession.sparkContext.broadcast(frequencies(self.docs, width, bits))
        self.signed = cut(signatures(self.docs, width, percent, ranks, bits))
        filled = self.signed.filter("n > 0")
        self.nodes = cut(filled.groupBy("node").agg(F.min("id").alias("rep"), F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("who"), *[F.first(c).alias(c) for c in ("n", "prefix", "marks", "sizes")]))

        posting = self.nodes.select("node", "n", F.posexplode("prefix").alias("pos", "token"))
        # the sketch never counts less than there is: only tokens of such a class can have so many postings
        may = F.shiftrightunsigned("token", 55) >= int(8 * math.log2(TOKEN_ROWS))
        hot = self.hot = cut(posting.filter(may).groupBy("token").agg(F.count("*").alias("rows")).filter(F.col("rows") > TOKEN_ROWS))
        salts = F.coalesce(F.ceil(F.col("rows") / TOKEN_ROWS), F.lit(1)).cast("int")
        posting = posting.join(F.broadcast(hot) if hot.count() <= BROADCAST_IDS else hot, "token", "left").withColumn("salts", salts).drop("rows")
        posting = posting.withColumn("salt", F.pmod(F.xxhash64("node"), F.col("salts")))
        own = W.partitionBy("token", "salt")
        first = F.first(F.struct("node", "n", "pos")).over(own.orderBy("pos", "node"))
        posting = posting.withColumn("hub", first).withColumn("size", F.count("*").over(own))
        self.shared = cut(posting.filter("size > 1 or salts > 1").select("token", "node", "n", "pos", "salts", "hub"))

    def near_hubs(self) -> DataFrame:
        """Pairs of each posting and its token's first one (the one with fewest rarer tokens): as many as postings, not their square.

        Frequent tokens are salted: postings pair with the first of their salt, and these with the token's.
        """
        p = self.shared
        hub = F.col("hub")
        near = p.filter(F.col("node") != hub["node"]).filter(_passes(self.percent, F.col("n"), F.col("pos"), hub["n"], hub["pos"])).select(*_pair(F.col("node"), F.col("pos"), hub["node"], hub["pos"]))
        lead = p.filter((F.col("salts") > 1) & (F.col("node") == hub["node"])).select("token", "node", "n", "pos")
        lead = lead.withColumn("top", F.first(F.struct("node", "n", "pos")).over(W.partitionBy("token").orderBy("pos", "node")))
        top = F.col("top")
        lead = lead.filter(F.col("node") != top["node"]).filter(_passes(self.percent, F.col("n"), F.col("pos"), top["n"], top["pos"])).select(*_pair(F.col("node"), F.col("pos"), top["node"], top["pos"]))
        return _once(near.union(lead))

    def across(self, roots: DataFrame | None) -> DataFrame:
        """All candidate pairs of nodes of different components (of different nodes, if `roots` is None).

        Tokens first pair the components that meet in them, by the ranges of
        their sets' sizes; only the members of pairs that could link are
        joined. Components meet by token and class of size; where one token
        and class has many of them, one side is salted and the other repeated,
        so that no task pairs them all.
        """
        p = self.shared.select("token", "node", "n", "pos")
        if roots is None:
            p = p.withColumn("root", F.col("node"))
        else:
            p = p.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        parts = p.groupBy("token", "root").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.min("pos").alias("pos"))
        several = parts.groupBy("token").agg(F.count("*").alias("k")).filter("k > 1").select("token")
        # sizes that fit differ by one class at most
        step = max(0.01, math.log(100 / self.percent)) * 1.000001
        of = lambda c: F.floor(F.log(F.col(c)) / step)
        parts = self.parts = cut(parts.join(several, "token", "left_semi").withColumn("from", of("low")).withColumn("to", of("high")))
        left = parts.withColumn("size", F.explode(F.sequence("from", "to")))
        many = self.many = cut(left.groupBy("token", "size").agg(F.count("*").alias("k")).filter(F.col("k") > TOKEN_COMPONENTS).select("token", "size", F.ceil(F.col("k") / TOKEN_COMPONENTS).alias("salts")))
        few = many.count() <= BROADCAST_IDS
        salted = lambda d: d.join(F.broadcast(many) if few else many, ["token", "size"], "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
        x = salted(left).withColumn("salt", F.pmod(F.xxhash64("root"), F.col("salts"))).alias("x")
        y = salted(parts.withColumn("size", F.explode(F.sequence(F.col("from") - 1, F.col("to") + 1)))).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))).alias("y")
        same = (F.col("x.token") == F.col("y.token")) & (F.col("x.size") == F.col("y.size")) & (F.col("x.salt") == F.col("y.salt"))
        once = F.col("x.size") == F.greatest(F.col("x.from"), F.col("y.from") - 1)
        fits = (100 * F.col("x.high") >= self.percent * F.col("y.low")) & (100 * F.col("y.high") >= self.percent * F.col("x.low"))
        rest = 1 + F.least(F.col("x.high") - F.col("x.pos") - 1, F.col("y.high") - F.col("y.pos") - 1)
        room = (100 + self.percent) * rest >= _overlap(F.col("x.low"), F.col("y.low"), self.percent)
        meet = x.join(y, same & once & (F.col("x.root") < F.col("y.root")) & fits & room)
        meet = meet.select("x.token", F.col("x.root").alias("r1"), F.col("y.root").alias("r2"))
        one = p.select("token", F.col("root").alias("r1"), F.col("node").alias("m1"), F.col("n").alias("n1"), F.col("pos").alias("p1"))
        two = p.select("token", F.col("root").alias("r2"), F.col("node").alias("m2"), F.col("n").alias("n2"), F.col("pos").alias("p2"))
        j = meet.join(one, ["token", "r1"]).join(two, ["token", "r2"])
        return _once(j.filter(_passes(self.percent, F.col("n1"), F.col("p1"), F.col("n2"), F.col("p2"))).select(*_pair(F.col("m1"), F.col("p1"), F.col("m2"), F.col("p2"))))

    def verified(self, pairs: DataFrame, first: bool) -> DataFrame:
        return _verified(_suffix_filter(pairs, self.nodes, self.percent, first), self.nodes, self.docs, self.width, self.percent)


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """Components of documents whose sets of `width`-word shingles have a Jaccard similarity of `percent` or more.

    Equal sets are one node. Sets order their shingles rarest first and are
    joined on a prefix that alike sets must share a token of. In a first pass
    every set meets only the hub of each of its tokens; what that links is
    joined up. A second pass meets all remaining pairs: those that share a
    token but belong to different components so far. So no link between
    components is lost, while a group of thousands of near copies costs about
    one check per copy, not one per pair. Very frequent tokens are salted.

    Returns per document id_col, n_shingles (long), component_id (the least id
    of its component; links lead from document to document), n_copies (long,
    documents with the same set), is_first (boolean: the row stands for its
    component, as that of the least id, then least hash of its text) and
    text_key (that hash). Texts with fewer words have one shingle,
    the whole sequence; without words, or null: none, and a component of their
    own. Null ids take part, but are never the least while there is another.
    Rows that repeat are copies. An empty table gives an empty result. Sets and
    shingles are compared by 64-bit hashes.
    """
    join = _Join(docs, id_col, text_col, width, percent)
    hubs = cut(join.near_hubs())
    links = join.verified(hubs, False)
    roots = components(links.toDF("u", "v"))
    discard(join.hot)
    more = join.verified(join.across(roots).join(hubs.select("a", "b"), ["a", "b"], "left_anti"), True)
    discard(join.parts, join.many)
    if more.count():
        discard(roots)
        roots = components(links.union(more).toDF("u", "v"))
    at = cut(join.nodes.select("node", "who").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    least = at.groupBy("root").agg(F.min("who").alias("least"))
    copies = join.signed.filter("n > 0").groupBy("node").agg(F.count("*").alias("n_copies"))
    of_node = at.join(least, "root").join(copies, "node").select("node", "least", "n_copies")
    out = join.signed.select("id", "key", "n", "node").join(of_node, "node", "left")
    none = F.col("n") == 0
    first = none | F.col("id").eqNullSafe(F.col("least.id")) & (F.col("key") == F.col("least.key"))
    out = cut(out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(none, F.col("id")).otherwise(F.col("least.id")).alias("component_id"), F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"), first.alias("is_first"), F.col("key").alias("text_key")))
    discard(join.signed, join.nodes, join.shared, hubs, links, more, roots, at)
    return out


def similar_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """(pairs, members): every link between different sets, and which documents have which set.

    pairs: a, b (ids that stand for two different sets that are alike, a < b
    by node); members: id_col, rep (the id that stands for the document's set;
    null if it is empty). Inputs are handled as in similar_components.
    """
    join = _Join(docs, id_col, text_col, width, percent)
    links = join.verified(join.across(None), True)
    rep = join.nodes.select("node", "rep")
    pairs = links.join(rep.toDF("a", "id_a"), "a").join(rep.toDF("b", "id_b"), "b").select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))
    members = join.signed.select("id", "node").join(rep, "node", "left").select(F.col("id").alias(id_col), "rep")
    return pairs, members
