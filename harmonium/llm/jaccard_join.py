"""Exact Jaccard join on word shingles by a partition of the shingle universe (operator 9).

Two sets of sizes ``r <= s`` with Jaccard at least ``t`` differ in at most ``(r + s) * (1 - t) / (1 + t)`` elements.  If
a hash deals the universe into more segments than that, two such sets agree in at least one whole segment, so segments
can be used as equi-join keys.

* **Size bands.** The number of segments must be fixed before two sets are compared, so it belongs to a band of sizes.
  A set is dealt by its own band, and by the next ones as far as it is large enough to match a set there.
* **Points.** Agreeing in a segment covers one difference ("first point" of a segment).  For the first few segments of
  a band the one-deletion neighbourhood is indexed as well; a segment that differs by one element at most is then found
  too, which covers a second difference ("second point").  A set finds all its smaller partners if the points it uses
  reach one more than the largest possible difference.
* **Cost-based allocation.** The cost of a point is the number of sets that share its key.  Keys that nobody shares
  cost nothing and count as used.  Of the others, only as many as are still needed are used, cheapest first.  Segments
  that are empty or consist of a common line are therefore left out wherever anything cheaper will do.
* **Verification.** Candidate pairs are compared on their whole sets of 64-bit shingle hashes.

Equal sets become one node first.  Each key's members are then checked against the smallest of them only; keys whose
members all lie in one component by that time are dropped, so a large group of near copies costs a linear number of
comparisons.  The holders of keys with very many are then compared with a few of them, drawn anew
in rounds; the nearest of each are verified, so that a dense cluster is one component before pairs are formed, which
happens across components alone.
"""

from __future__ import annotations

from bisect import bisect_right
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from harmonium.llm.common import DOCUMENT_COLUMNS, SLICE_BYTES, batches, bounded_batches, broadcast_if_small, discard, materialise, mix, prepared, read, shuffles_removed, slices
from harmonium.llm.components import components

#: Shingle length in words, and the threshold in per cent.
WORDS, PERCENT = 5, 80
#: Ratio of the largest to the smallest size of a band.
BAND_RATIO = 1.6
#: Every so many segments, one has its one-deletion neighbourhood indexed (at least ``LEAST_DELETIONS`` of a band's).
DELETION_EVERY, LEAST_DELETIONS = 32, 4


#: The rule of words as a table of bytes: A-Z in lower case, white space as a space.
_FOLDED = bytes(32 if c == 32 or 9 <= c <= 13 else c + 32 if 65 <= c <= 90 else c for c in range(256))
#: A number for each byte (0 for the space), the base of the polynomial over a word's bytes, and the bytes hashed together.
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) * (np.arange(256) != 32)
_BASE, HASHED_BYTES = 0x9E3779B97F4A7C17, 1 << 16
_INVERSE = pow(_BASE, -1, 1 << 64)


@lru_cache(2)
def _powers(base: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(HASHED_BYTES - 1, base, np.uint64)]))


def _hashed(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of folded ``raw`` and where they begin, from the running sums of one polynomial over all its bytes."""
    b, power, inverse = np.frombuffer(raw, np.uint8), _powers(_BASE), _powers(_INVERSE)
    space = np.ones(len(b) + 2, bool)
    np.equal(b, 32, out=space[1:-1])
    edge = np.flatnonzero(space[1:] != space[:-1])
    start, end = edge[::2], edge[1::2]
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_BYTE[b] * power[: len(b)], out=total[1:])
    return mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64)), start


def hashed_words(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of folded ``raw``, and where they begin; a word too long for the tables is hashed alone."""
    found, starts, at = [], [], 0
    while at < len(raw):
        end = len(raw) if len(raw) - at <= HASHED_BYTES else raw.rfind(b" ", at, at + HASHED_BYTES)
        if end >= 0:
            h, start = _hashed(raw[at:end])
        else:
            end = raw.find(b" ", at)
            end = len(raw) if end < 0 else end
            h, start = np.array([xxhash.xxh3_64_intdigest(raw[at:end])], np.uint64), np.zeros(1, np.int64)
        found.append(h)
        starts.append(start + at)
        at = end + 1
    return (np.concatenate(found), np.concatenate(starts)) if found else (np.empty(0, np.uint64), np.empty(0, np.int64))


def _windows(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the windows of ``width`` words."""
    out = np.full(max(len(h) - width + 1, 0), width, np.uint64)
    for i in range(width):
        out = (out ^ h[i : len(out) + i]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return mix(out)


def _distinct(h: np.ndarray) -> np.ndarray:
    h = np.sort(h)
    new = h[1:] != h[:-1]
    return h if new.all() else h[np.concatenate([[True], new])]


def shingle_sets(texts: list[str | None], k: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the ``k``-word shingles of each text.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case.  Fewer than ``k`` make one shingle of the whole sequence;
    without words (null, empty or white space only) the set is empty.
    """
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    h, start = hashed_words(b" ".join(raw).translate(_FOLDED))
    size = np.fromiter(map(len, raw), np.int64, len(raw)) + 1
    edge = [*np.searchsorted(start, np.cumsum(size) - size).tolist(), len(h)]
    every = _windows(h, k)
    return [_distinct(every[a : b - k + 1] if b - a >= k else _windows(h[a:b], b - a) if b > a else h[:0]) for a, b in zip(edge, edge[1:], strict=False)]


def shingles(text: str | None, k: int = WORDS) -> np.ndarray:
    return shingle_sets([text], k)[0]


def largest_difference(r: int, s: int, percent: int) -> int:
    """The most elements in which two sets of these sizes can differ and still link."""
    return (r + s) * (100 - percent) // (100 + percent)


@lru_cache(8)
def _starts(percent: int) -> list[int]:
    """Smallest size of each band, far beyond any text."""
    starts = [1]
    while starts[-1] < 1 << 40:
        starts.append(max(starts[-1] + 1, int(starts[-1] * BAND_RATIO)))
    return starts


def bands(size: int, percent: int = PERCENT) -> list[int]:
    """The bands a set of this size is dealt by: its own, and the next ones as far as a set there can link to it."""
    starts = _starts(percent)
    own = bisect_right(starts, size) - 1
    return list(range(own, bisect_right(starts, size * 100 // percent)))


def smallest_linked(percent: int) -> int:
    """The smallest size of a set that can link to another than itself: ``n`` shingles inside ``n + 1`` are enough."""
    return -(-percent // (100 - percent)) if percent < 100 else 1 << 40


def band_shape(band: int, percent: int = PERCENT) -> tuple[int, int]:
    """(segments, segments with a deletion neighbourhood) of a band."""
    largest = _starts(percent)[band + 1] - 1
    m = largest_difference(largest, largest, percent) + 1
    return m, min(m, max(LEAST_DELETIONS, -(-m // DELETION_EVERY)))


def segment_keys(h: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """Keys of a set and their codes: ``segment << 3 | empty << 2 | deletion << 1 | probe`` (probe: own band)."""
    keys, codes = [], []
    token = mix(h + np.uint64(0x632BE59BD9B4E019))
    for i, band in enumerate(bands(len(h), percent)):
        probe = int(not i)
        m, with_deletions = band_shape(band, percent)
        segment = (h % np.uint64(m)).astype(np.uint16 if m <= 1 << 16 else np.int64)
        order = np.argsort(segment, kind="stable")  # by digits, if segments are short numbers
        at, held = segment[order].astype(np.int64), token[order]
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(held, dtype=np.uint64)])
        edge = np.concatenate([[0], np.cumsum(np.bincount(segment, minlength=m))])
        sums = total[edge[1:]] - total[edge[:-1]]
        base = mix(np.arange(m, dtype=np.uint64) + np.uint64(band << 32) + np.uint64(1))
        upto = edge[with_deletions]
        keys += [mix(sums + base), mix(sums[at[:upto]] - held[:upto] + base[at[:upto]])]
        codes += [np.arange(m) << 3 | (edge[1:] == edge[:-1]).astype(np.int64) << 2 | probe, at[:upto] << 3 | 2 | probe]
    return np.concatenate(keys).view(np.int64), np.concatenate(codes).astype(np.int32)


def _identities(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes that stand for each set."""
    every, edge = np.concatenate(sets), np.cumsum([0, *map(len, sets)])
    total = lambda x: np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)])[edge]
    return tuple(np.diff(total(mix(every ^ np.uint64(salt)))).view(np.int64) for salt in (0, 0xD6E8FEB86659FD93))


def _sets(k: int):
    """(doc_id, text) to (doc_id, n_shingles, set_a, set_b)."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_a", pa.int64()), ("set_b", pa.int64())])

    def run(parts):
        for part in slices(parts, size=SLICE_BYTES):
            found = shingle_sets(part.column(1).to_pylist(), k)
            yield batches(schema, [part.column(0), [len(h) for h in found], *_identities(found)])

    return run


def _keys(k: int, percent: int):
    """(text, set_a, set_b, node) to the keys of the node; texts of another set that share the doc_id are left out."""
    schema = pa.schema([("node", pa.int64()), ("key", pa.int64()), ("code", pa.int64())])

    def run(parts):
        for part in slices(parts, size=SLICE_BYTES):
            found = shingle_sets(part.column(0).to_pylist(), k)
            a, b = _identities(found)
            own = np.flatnonzero((a == part.column(1).to_numpy()) & (b == part.column(2).to_numpy()))
            named = part.column(3).to_numpy()
            nodes, keys, codes = [], [], []
            for i in own.tolist():
                key, code = segment_keys(found[i], percent)
                nodes.append(np.full(len(key), named[i], np.int64))
                keys.append(key)
                codes.append(code.astype(np.int64) | len(found[i]) << 32)
            if keys:
                yield batches(schema, [np.concatenate(nodes), np.concatenate(keys), np.concatenate(codes)])

    return run


def _odd(h: np.ndarray) -> np.ndarray:
    """For each of ``PARITIES`` classes of shingles, whether the set holds an odd number.

    Every element in which two sets differ turns one parity at most, so the number of different parities is never more
    than that of different elements.
    """
    return np.packbits((np.bincount((h >> np.uint64(20)).astype(np.int64) & (PARITIES - 1), minlength=PARITIES) & 1).astype(bool)).view(np.int64)


def _hashes(k: int):
    """(doc_id, text) to (set_a, set_b, hashes, p)."""
    schema = pa.schema([("set_a", pa.int64()), ("set_b", pa.int64()), ("hashes", pa.list_(pa.int64())), ("p", pa.list_(pa.int64()))])

    def run(parts):
        for part in slices(parts, size=SLICE_BYTES):
            found = shingle_sets(part.column(1).to_pylist(), k)
            edge = np.cumsum([0, *map(len, found)]).astype(np.int32)
            yield batches(schema, [*_identities(found), pa.ListArray.from_arrays(pa.array(edge), pa.array(np.concatenate(found).view(np.int64))), list(map(_odd, found))])

    return run


def _parities(k: int):
    """(doc_id, text) to (set_a, set_b, p)."""
    schema = pa.schema([("set_a", pa.int64()), ("set_b", pa.int64()), ("p", pa.list_(pa.int64()))])

    def run(parts):
        for part in slices(parts, size=SLICE_BYTES):
            found = shingle_sets(part.column(1).to_pylist(), k)
            yield batches(schema, [*_identities(found), list(map(_odd, found))])

    return run


def _size(code: str) -> Column:
    return F.shiftright(code, 32)


def _flag(bit: int) -> Column:
    return F.col("code").bitwiseAND(bit) != 0


#: Bits of a code; above 32 of them stands the size.
PROBE, DELETION, EMPTY = 1, 2, 4
#: In the first comparison of a key's holders with the first of them, two sets are compared if this share of the smaller
#: one's size is the number of keys that say so.  The second comparison does not depend on it.
HUB_SHARE = 1 / 16
#: Such comparisons at most, each with other first holders; another follows if one in ``WORTHWHILE`` nodes was linked.  All
#: they leave to the second is work.
HUB_ROUNDS = 3
#: Keys with more holders are joined under the parity bound as well; its number of classes.
CROWDED, PARITIES = 64, 1024
#: Rounds at most in which holders of a crowded key are compared with so many of them (twice as many in each) drawn anew, each with its nearest few
#: verified; another round follows if one in so many holders was linked.  All they leave to the last comparison is work.
CROWD_ROUNDS, DRAWN, NEAREST, WORTHWHILE = 6, 64, 2, 50
#: Drawn holders that may travel to every task.
DRAWN_BROADCAST = 50_000
#: Keys just before that a row on a crowded key carries; a pair that shares none of them is formed again, which is work only.
EARLIER = 24


class JaccardJoin:
    """Links between texts whose shingle sets have a Jaccard similarity of at least ``percent`` / 100.

    ``fit(docs)`` reads columns ``doc_id`` (long) and ``text``; other columns are ignored, whatever their names.

    * ``membership``: one row per row of ``docs``: doc_id, n_shingles, component_id.
    * ``edges``: verified links between nodes (a node is one distinct set), enough to connect each component.

    Defined results: null, empty and white-space texts have an empty set and link with nothing (component_id is their
    own doc_id); repeated rows and equal sets are one component; a row whose doc_id is null is returned with its
    n_shingles and a null component_id, and links nothing; an empty table gives an empty result; texts are used whole.
    """

    def __init__(self, k: int = WORDS, percent: int = PERCENT):
        if not 0 < percent <= 100:
            raise ValueError("percent must lie in (0, 100]")
        self.k, self.percent = k, percent

    def fit(self, docs: DataFrame) -> JaccardJoin:
        with bounded_batches(docs.sparkSession), shuffles_removed(docs.sparkSession):
            return self._fit(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))

    def _fit(self, texts: DataFrame) -> JaccardJoin:
        self._sets = materialise(texts.mapInArrow(_sets(self.k), "doc_id long, n_shingles long, set_a long, set_b long"), "sets")
        nodes = self._sets.where("n_shingles > 0 and doc_id is not null").groupBy("set_a", "set_b").agg(F.min("doc_id").alias("first"), F.max("n_shingles").alias("size"))
        # a node is called by its first doc_id; by a hash, if different sets have that doc_id
        alone = F.count("*").over(W.partitionBy("first")) == 1
        self._nodes = materialise(nodes.withColumn("node", F.when(alone, F.col("first")).otherwise(F.xxhash64("set_a", "set_b"))), "nodes")
        shared = materialise(self._shared(texts), "keys")
        near, merged, least = None, None, self._nodes.count() // WORTHWHILE
        for turn in range(HUB_ROUNDS):
            found = self._verified(self._hub_pairs(shared, merged, turn), texts)
            near = found if near is None else near.unionByName(found)
            merged = components(near)
            if found.count() <= least:
                break
        found, parity = self._crowd_links(shared, merged, texts)
        if found:
            near = reduce(DataFrame.unionByName, found, near)
            merged = components(near)
        cross = self._verified(self._cross_pairs(shared, merged, parity, texts), texts)
        self.edges = materialise(near.unionByName(cross), "links")
        self._components = components(self.edges)
        self.membership = self._members()
        return self

    def _shared(self, texts: DataFrame) -> DataFrame:
        """Keys that at least two nodes hold in a way that can match, with the number of holders and the first one."""
        # below this size only equal sets link, and those are one node
        dealt = self._nodes.where(F.col("size") >= smallest_linked(self.percent)).select(F.col("first").alias("doc_id"), "set_a", "set_b", "node")
        dealt = texts.join(broadcast_if_small(dealt), "doc_id").select("text", "set_a", "set_b", "node")
        keys = dealt.mapInArrow(_keys(self.k, self.percent), "node long, key long, code long")
        repeated = self._sets.groupBy("doc_id", "set_a", "set_b").count().where("count > 1").select(F.col("doc_id").alias("first"), "set_a", "set_b")
        repeated = self._nodes.join(repeated, ["first", "set_a", "set_b"]).select("node")
        if repeated.limit(1).count():  # rows that repeat a first document bring its keys again
            twice = broadcast_if_small(repeated)
            keys = keys.join(twice, "node", "left_anti").unionByName(keys.join(twice, "node", "left_semi").distinct())
        by_key = W.partitionBy("key")
        deletion = _flag(DELETION)
        return (
            keys.withColumn("n_all", F.count("*").over(by_key)).where("n_all > 1")
            .withColumn("n_whole", F.sum(F.when(deletion, 0).otherwise(1)).over(by_key))
            .withColumn("probed", F.max(F.col("code").bitwiseAND(PROBE)).over(by_key))
            .where("n_whole > 0 and probed = 1").drop("probed")
        )

    def _hub_pairs(self, shared: DataFrame, merged: DataFrame | None, turn: int) -> DataFrame:
        """Each holder of a whole-segment key with one of them, another one in each turn, unless they are connected."""
        held = shared.where(~_flag(DELETION) & ~_flag(EMPTY)).select("node", "key", _size("code").alias("size"), F.col("node").alias("group"))
        if merged is not None:
            held = held.drop("group").join(merged.withColumnRenamed("component", "group"), "node", "left").withColumn("group", F.coalesce("group", "node"))
        hubs = held.groupBy("key").agg(F.min(F.struct(F.xxhash64(F.lit(turn), "node").alias("order"), "node", "size", "group")).alias("hub"))
        size, hub = F.col("size"), F.col("hub.size")
        fits = (F.least(size, hub) * 100 >= F.greatest(size, hub) * self.percent) & (F.col("group") != F.col("hub.group"))
        pairs = held.join(hubs, "key").where(fits).groupBy(F.col("node").alias("a"), F.col("hub.node").alias("b"), F.least(size, hub).alias("size")).count()
        return pairs.where(F.col("count") >= F.col("size") * HUB_SHARE).select("a", "b")

    def _parity_columns(self, nodes: DataFrame, texts: DataFrame) -> DataFrame:
        """(node, p0, p1, ...)."""
        return self._spread(self._of_nodes(nodes, texts, _parities(self.k), "p"))

    def _spread(self, parity: DataFrame, *also: str) -> DataFrame:
        """A column for each word of ``p``: no null checks in the inner loop."""
        return parity.select("node", *also, *[F.coalesce(F.col("p")[i], F.lit(0)).alias(f"p{i}") for i in range(PARITIES // 64)])

    def _within_bound(self, differ: Column) -> Column:
        return differ <= F.expr(f"((size_a + size_b) * {100 - self.percent}) div {100 + self.percent}")

    def _crowd_links(self, shared: DataFrame, merged: DataFrame, texts: DataFrame) -> tuple[list[DataFrame], DataFrame | None]:
        """Verified links that put the holders of crowded keys together before all pairs of different components are compared,
        and the holders' parities.

        In a round a node stands under one of its crowded keys, the first in an order drawn anew, so that near copies often
        stand under the same.  Under each key every node meets the same few holders, and the nearest of them by parities
        are verified.  The work and the rows of a round grow with the number of nodes, however many link with one another.
        """
        held = materialise(shared.where(~_flag(DELETION) & ~_flag(EMPTY) & (F.col("n_all") > CROWDED)).select("node", "key", _size("code").alias("size")), "crowd")
        if not held.limit(1).count():
            return [], None
        parity = self._parity_columns(held.select("node").distinct(), texts)
        group = held.select("node").distinct().join(merged.withColumnRenamed("component", "group"), "node", "left").withColumn("group", F.coalesce("group", "node"))
        group = materialise(group, "crowd-groups")
        least, links = group.count() // WORTHWHILE, []
        for turn in range(CROWD_ROUNDS):
            under = held.groupBy("node").agg(F.min_by("key", F.struct(F.xxhash64(F.lit(turn), "key"), "key")).alias("key"), F.max("size").alias("size"))
            under = materialise(under.join(group, "node").join(parity, "node"), "crowd-under")
            order = W.partitionBy("key").orderBy(F.xxhash64(F.lit(turn), "node"), "node")
            drawn = materialise(under.withColumn("place", F.row_number().over(order)).where(F.col("place") <= (DRAWN << turn)).drop("place"), "crowd-drawn")
            ends = [df.select("key", *[F.col(c).alias(f"{c}_{end}") for c in under.columns if c != "key"]) for df, end in ((under, "a"), (drawn, "b"))]
            differ = sum(F.bit_count(F.col(f"p{i}_a").bitwiseXOR(F.col(f"p{i}_b"))) for i in range(PARITIES // 64))
            size = F.col("size_a"), F.col("size_b")
            fits = (F.col("group_a") != F.col("group_b")) & (F.least(*size) * 100 >= F.greatest(*size) * self.percent) & self._within_bound(differ)
            met = ends[0].join(broadcast_if_small(ends[1], DRAWN_BROADCAST), "key").where(fits).select(F.col("node_a").alias("a"), F.col("node_b").alias("b"), differ.alias("differ"))
            met = met.withColumn("place", F.row_number().over(W.partitionBy("a").orderBy("differ", "b"))).where(F.col("place") <= NEAREST)
            found = self._verified(met.select("a", "b"), texts)
            discard(under, drawn)
            n = found.count()
            if n:
                links.append(found)
            if n <= least:
                break
            of = lambda end: group.select(F.col("node").alias(end), F.col("group").alias(f"group_{end}"))
            bound = components(found.join(of("a"), "a").join(of("b"), "b").select(F.col("group_a").alias("a"), F.col("group_b").alias("b")))
            before, group = group, materialise(group.join(bound.withColumnRenamed("node", "group"), "group", "left").select("node", F.coalesce("component", "group").alias("group")), "crowd-groups")
            discard(before, bound)
        discard(held, group)
        return links, parity

    def _cross_pairs(self, shared: DataFrame, merged: DataFrame, parity: DataFrame | None, texts: DataFrame) -> DataFrame:
        """Candidate pairs of different components, by the cheapest sufficient points of the larger set."""
        percent = self.percent
        held = shared.join(merged.withColumnRenamed("component", "group"), "node", "left").withColumn("group", F.coalesce("group", "node"))
        apart = held.groupBy("key").agg(F.min("group").alias("low"), F.max("group").alias("high")).where("low <> high").select("key")
        held = materialise(held.join(apart, "key", "left_semi"), "apart")
        discard(shared)
        deletion, probe = _flag(DELETION), _flag(PROBE)
        segment = F.shiftright(F.col("code").bitwiseAND((1 << 32) - 1), 3)
        starts = _starts(percent)

        def shape(sizes):
            """Needed points, all points and deletion segments of a node, from its size."""
            import pandas as pd

            found = {int(n): (largest_difference(int(n), int(n), percent) + 1, *band_shape(bisect_right(starts, int(n)) - 1, percent)) for n in sizes.unique()}
            return pd.DataFrame([found[int(n)] for n in sizes], columns=["need", "segments", "deletions"], dtype="int64")

        shaped = F.pandas_udf(shape, T.StructType([T.StructField(x, T.LongType()) for x in ("need", "segments", "deletions")]))
        points = (
            held.where(probe).groupBy("node", segment.alias("segment"), _size("code").alias("size"))
            .agg(F.coalesce(F.max(F.when(~deletion, F.col("n_whole") - 1)), F.lit(0)).alias("whole"),
                 F.sum(F.when(deletion, F.col("n_whole")).otherwise(F.col("n_all") - F.col("n_whole"))).alias("near"))
            .withColumn("shape", shaped("size"))
            .select("node", "segment", "shape", F.explode(F.array(
                F.struct(F.col("whole").alias("cost"), F.lit(0).alias("second")),
                F.struct(F.when(F.col("segment") < F.col("shape.deletions"), F.col("whole") + F.col("near")).otherwise(0).alias("cost"), F.lit(1).alias("second")),
            )).alias("point")).where("point.cost > 0")
        )
        by_node = W.partitionBy("node")
        chosen = (
            points.withColumn("paid", F.count("*").over(by_node))
            .withColumn("place", F.row_number().over(by_node.orderBy("point.cost", "point.second", "segment")))
            # all points that cost nothing are used as they are
            .where(F.col("place") <= F.col("shape.need") - (F.col("shape.segments") + F.col("shape.deletions") - F.col("paid")))
            .groupBy("node", "segment").agg(F.max("point.second").alias("second"))
        )
        asks = (
            held.where(probe).withColumn("segment", segment).join(chosen, ["node", "segment"])
            .where(~deletion | (F.col("second") == 1))
            .select("key", F.col("node").alias("a"), _size("code").alias("size_a"), F.col("group").alias("group_a"), deletion.alias("deletion_a"), "second", "n_all")
        )
        asks = materialise(asks, "asks")
        gives = held.select("key", F.col("node").alias("b"), _size("code").alias("size_b"), F.col("group").alias("group_b"), deletion.alias("deletion_b"), probe.alias("probe_b"))
        smaller = (F.col("size_b") < F.col("size_a")) | ((F.col("size_b") == F.col("size_a")) & (F.col("b") < F.col("a")))
        fits = smaller & (F.col("size_b") * 100 >= F.col("size_a") * percent) & (
            ~F.col("deletion_a") & (~F.col("deletion_b") | (F.col("second") == 1)) | F.col("deletion_a") & ~F.col("deletion_b"))
        few, many = asks.where(F.col("n_all") <= CROWDED).drop("n_all"), asks.where(F.col("n_all") > CROWDED).drop("n_all")
        # components meet before their members do, and only on keys that someone asks for
        few_gives = gives.join(few.select("key").distinct(), "key", "left_semi")
        other = few.select("key", "group_a").distinct().join(few_gives.select("key", "group_b").distinct(), "key").where("group_a <> group_b")
        pairs = few.join(other, ["key", "group_a"]).join(few_gives, ["key", "group_b"]).where(fits).select("a", "b")
        if not many.limit(1).count():
            return pairs.distinct()
        many_gives = materialise(gives.join(many.select("key").distinct(), "key", "left_semi"), "crowded")
        return pairs.union(self._crowded_pairs(many, many_gives, fits, parity, texts)).distinct()

    def _crowded_pairs(self, asks: DataFrame, gives: DataFrame, fits: Column, parity: DataFrame | None, texts: DataFrame) -> DataFrame:
        """Pairs on crowded keys that the parity bound leaves, each under the first of the keys it shares, or few more.

        Every row carries the whole-segment keys that its node holds just before in the order of keys.  A pair that has met
        under one of them is not formed again; by induction along that order, its first key always forms it.
        """
        nodes = asks.select(F.col("a").alias("node")).union(gives.select(F.col("b").alias("node"))).distinct()
        if parity is None:
            parity = self._parity_columns(nodes, texts)
        else:
            parity = parity.unionByName(self._parity_columns(nodes.join(parity.select("node"), "node", "left_anti"), texts))
        words_ = range(PARITIES // 64)
        of = lambda end: parity.select(F.col("node").alias(end), *[F.col(f"p{i}").alias(f"{end}{i}") for i in words_])

        def earlier(rows: DataFrame, end: str, *also: str) -> DataFrame:
            before = W.partitionBy(end, *also).orderBy("key").rowsBetween(-EARLIER, -1)
            return rows.withColumn(f"earlier_{end}", F.collect_list(F.when(~F.col(f"deletion_{end}"), F.col("key"))).over(before))

        differ = sum(F.bit_count(F.col(f"a{i}").bitwiseXOR(F.col(f"b{i}"))) for i in words_)
        left, right = earlier(asks, "a").join(of("a"), "a"), earlier(gives, "b", "probe_b").join(of("b"), "b")
        met = F.arrays_overlap("earlier_a", "earlier_b")
        return left.join(right, "key").where((F.col("group_a") != F.col("group_b")) & fits & self._within_bound(differ) & ~met).select("a", "b")

    def _of_nodes(self, nodes: DataFrame, texts: DataFrame, step, *columns: str) -> DataFrame:
        """(node, columns): what ``step`` makes of the nodes' texts."""
        kept = materialise(self._nodes.join(nodes, "node", "left_semi"), "wanted")
        ids = broadcast_if_small(kept.select(F.col("first").alias("doc_id")).distinct())
        found = texts.join(ids, "doc_id", "left_semi").mapInArrow(step, ", ".join(["set_a long, set_b long", *(f"{c} array<long>" for c in columns)]))
        made = materialise(found.dropDuplicates(["set_a", "set_b"]).join(kept, ["set_a", "set_b"]).select("node", "size", *columns), columns[0])
        discard(kept)
        return made

    def _verified(self, pairs: DataFrame, texts: DataFrame) -> DataFrame:
        """The pairs that link, by the whole sets of those that the parity bound leaves."""
        pairs = materialise(pairs, "pairs")
        nodes = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
        made = self._of_nodes(nodes, texts, _hashes(self.k), "hashes", "p")
        parity = self._spread(made, "size")
        words_ = range(PARITIES // 64)
        of = lambda end: parity.select(F.col("node").alias(end), F.col("size").alias(f"size_{end}"), *[F.col(f"p{i}").alias(f"{end}{i}") for i in words_])
        differ = sum(F.bit_count(F.col(f"a{i}").bitwiseXOR(F.col(f"b{i}"))) for i in words_)
        near = materialise(pairs.join(of("a"), "a").join(of("b"), "b").where(self._within_bound(differ)).select("a", "b"), "within")
        both, ends = F.size(F.array_intersect("x", "y")), near.select(F.col("a").alias("node")).union(near.select(F.col("b").alias("node"))).distinct()
        whole = made.select("node", "hashes").join(broadcast_if_small(ends), "node", "left_semi")
        found = materialise(
            near.join(whole.select(F.col("node").alias("a"), F.col("hashes").alias("x")), "a").join(whole.select(F.col("node").alias("b"), F.col("hashes").alias("y")), "b")
            .where(both * 100 >= (F.size("x") + F.size("y") - both) * self.percent).select("a", "b"),
            "verified",
        )
        discard(pairs, made, near)
        return found

    def _members(self) -> DataFrame:
        named = self._nodes.join(self._components, "node", "left").withColumn("component", F.coalesce("component", "node"))
        first = named.groupBy("component").agg(F.min("first").alias("component_id"))
        named = named.join(first, "component").select("set_a", "set_b", "component_id")
        rows = self._sets.select("doc_id", "n_shingles", "set_a", "set_b")
        linked = rows.where("n_shingles > 0 and doc_id is not null").join(named, ["set_a", "set_b"]).select("doc_id", "n_shingles", "component_id")
        return linked.unionByName(rows.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).alias("component_id")))


def op9_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return JaccardJoin().fit(read(spark, folder, "documents")).membership


def stage_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates: the one with the smallest doc_id.

    Documents without words are in no group and stay; so do rows without a doc_id.  Rows that repeat a doc_id are
    reduced to one if they are equal in their text too.
    """
    prepared(spark)
    docs = docs.select(*DOCUMENT_COLUMNS)
    members = JaccardJoin().fit(docs).membership
    gone = members.where("doc_id <> component_id").select("doc_id").distinct()
    kept = docs.join(broadcast_if_small(gone), "doc_id", "left_anti")
    repeated = members.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    repeated = broadcast_if_small(repeated)
    return kept.join(repeated, "doc_id", "left_anti").unionByName(kept.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]))
