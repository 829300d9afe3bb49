"""Exact Jaccard join of documents' word shingles in the metric space of Jaccard distance.

Two stages. Candidate regions: a pair above the threshold shares several of the
first shingles of both documents in one fixed order, so documents connected by
such shingles hold all pairs. In a region, pivots take the documents near them:
whoever is within the threshold of a pivot is linked to it, and by the triangle
inequality can be linked to no one beyond twice the threshold distance. Only
documents in that window are compared again, and the region without the pivots'
documents is joined the same way. Regions too large for a task are first cut by
what their documents share, counted within the region.

Pivots alone can't cut the whole table: unrelated documents share no shingle, lie
at distance 1 of every pivot and would all fall in every window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.common import fresh, mix64, released, utf8_column, words_of, written
from tideline.llm.components import components

WORDS = 5
THRESHOLD = Fraction(4, 5)
# Shingles met in at least this share of a task's documents may be hot; the most frequent HOT_SHINGLES come
# last in the order. That is only about speed: any order finds all pairs.
HOT_SHARE = 1 / 256
HOT_SHINGLES = 100_000
# A region of more shingles than this is cut across tasks, by shared shingles and then by pivots, before it is joined in one.
REGION_SHINGLES = 4_000_000
PIVOTS = 16
SALTS = 32
# Shingles in at least this part of a region's sets have a bit in each set.
FREQUENT_PART = 64
# A cut by shingles that leaves more than this of what is in large regions is the last one.
LEAST_CUT = 0.9
WORD_CACHE = 300_000
_BASE = np.uint64(0x9E3779B97F4A7C15)


class Shingler:
    """Distinct shingles of a text as sorted 64-bit hashes."""

    def __init__(self, words: int):
        self.words = words
        self.known = _WordHashes()
        with np.errstate(over="ignore"):
            self.powers = np.cumprod(np.full(words, _BASE, np.uint64))

    def __call__(self, text: bytes) -> np.ndarray:
        tokens = words_of(text)
        if len(self.known) > WORD_CACHE:
            self.known.clear()
        hashes = np.fromiter(map(self.known.__getitem__, tokens), np.uint64, len(tokens))
        if not len(hashes):
            return hashes
        with np.errstate(over="ignore"):
            if len(hashes) < self.words:
                return mix64((hashes * self.powers[: len(hashes)]).sum(keepdims=True) + np.uint64(len(hashes)))
            n = len(hashes) - self.words + 1
            joint = np.zeros(n, np.uint64)
            for i in range(self.words):
                joint += hashes[i : i + n] * self.powers[i]
        return _distinct(mix64(joint))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


def _distinct(values: np.ndarray) -> np.ndarray:
    """Sorts ``values`` in place; faster here than hashing them."""
    values.sort()
    new = np.empty(len(values), bool)
    new[0] = True
    np.not_equal(values[1:], values[:-1], out=new[1:])
    return values[new]


def set_id(shingles: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def needed(n: int, threshold: Fraction = THRESHOLD) -> int:
    """The fewest common shingles that a partner of a set of ``n`` has."""
    return -(-n * threshold.numerator // threshold.denominator)


def depth(n: int) -> int:
    """How many of the common shingles the prefixes of both are to hold."""
    return max(1, n // 5)


def _describe(docs: DataFrame, words: int) -> DataFrame:
    """kind 0: doc_id (null_id), set, n of a document; kind 1: a shingle and its documents, if many in this task."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, n_docs, counts = Shingler(words), 0, np.zeros((0, 2), np.uint64)
        for batch in batches:
            ids, sets, sizes, pending = batch.column(0).to_pylist(), [], [], []
            for text in utf8_column(batch.column(1)):
                shingles = shingler(text)
                sets.append(set_id(shingles) if len(shingles) else None)
                sizes.append(len(shingles))
                pending.append(shingles)
                if sum(map(len, pending[-64:])) > 2_000_000 or len(pending) >= 2000:
                    counts = _add_counts(counts, pending, n_docs + len(sizes))
                    pending = []
            counts = _add_counts(counts, pending, n_docs + len(sizes))
            n_docs += len(ids)
            yield _typed(0, ids, sets, sizes)
        hot = counts[counts[:, 1] >= max(3, n_docs * HOT_SHARE)]
        yield _typed(1, hot[:, 0].view(np.int64), [None] * len(hot), hot[:, 1].astype(np.int64))

    return docs.mapInArrow(released(describe), "kind int, id long, set long, n long")


def _typed(kind: int, ids, sets, sizes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([kind] * len(sizes), pa.int32()), pa.array(ids, pa.int64()), pa.array(sets, pa.int64()), pa.array(sizes, pa.int64())], names=["kind", "id", "set", "n"]
    )


def _add_counts(counts: np.ndarray, sets: list[np.ndarray], n_docs: int) -> np.ndarray:
    """Adds sets to the counts of frequent shingles. Those that can't be frequent so far are forgotten, so few are held."""
    if not sets:
        return counts
    values, found = np.unique(np.concatenate(sets), return_counts=True)
    keep = found >= max(2, len(sets) * HOT_SHARE / 2)
    values = np.concatenate([counts[:, 0], values[keep]])
    found = np.concatenate([counts[:, 1], found[keep].astype(np.uint64)])
    order = np.argsort(values, kind="stable")
    values, found = values[order], found[order]
    starts = np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.zeros(0, np.int64)
    merged = np.stack([values[starts], np.add.reduceat(found, starts)], axis=1) if len(starts) else np.zeros((0, 2), np.uint64)
    return merged[merged[:, 1] >= n_docs * HOT_SHARE / 4]


def _prefixes(docs: DataFrame, words: int, threshold: Fraction, hot: np.ndarray, counts: np.ndarray) -> DataFrame:
    """shingle, set, least, hot: the first shingles of every set, once per task and set.

    ``hot`` are shingles that come last, in their order; their rows tell their ``counts``, others null. Any
    pair above the threshold has at least ``least`` of these rows in common.
    """
    sent = docs.sparkSession.sparkContext.broadcast((hot, counts.astype(np.int64)))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, seen = Shingler(words), set()
        by_value = np.argsort(sent.value[0])
        values, frequent = sent.value[0][by_value], np.append(sent.value[1], 0)
        for batch in batches:
            keys, sets, least, ranks = [], [], [], []

            def block() -> pa.RecordBatch:
                sizes = [len(k) for k in keys]
                places = np.concatenate(ranks) if ranks else np.zeros(0, np.int32)
                return pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate(keys).view(np.int64) if keys else [], pa.int64()),
                        pa.array(np.repeat(np.array(sets, np.int64), sizes), pa.int64()),
                        pa.array(np.repeat(np.array(least, np.int32), sizes), pa.int32()),
                        pa.array(frequent[places], pa.int64(), mask=places < 0),
                    ],
                    names=["shingle", "set", "least", "hot"],
                )

            for text in utf8_column(batch.column(1)):
                shingles = shingler(text)
                n = len(shingles)
                if not n or (own := set_id(shingles)) in seen:
                    continue
                seen.add(own)
                if len(seen) > 1_000_000:
                    seen.clear()
                rank = np.full(n, -1, np.int32)
                if len(values):
                    at = np.minimum(np.searchsorted(values, shingles), len(values) - 1)
                    is_hot = values[at] == shingles
                    rank[is_hot] = by_value[at[is_hot]]
                order = np.argsort(rank, kind="stable")[: n - needed(n, threshold) + depth(n)]
                keys.append(shingles[order])
                ranks.append(rank[order])
                sets.append(own)
                least.append(depth(needed(n, threshold)))
                if len(keys) >= 400:
                    yield block()
                    keys, sets, least, ranks = [], [], [], []
            if keys:
                yield block()

    return docs.mapInArrow(released(cut), "shingle long, set long, least int, hot long")


def _candidate_edges(prefixes: DataFrame) -> DataFrame:
    """Edges (a, b) between sets that connect all pairs above the threshold.

    A set keeps only shingles that others have too; with fewer than it must share
    it has no partner. Of the rest, the ``least - 1`` most frequent can go as well: a
    pair shares ``least``, and the rarest of those stays with both. Hot shingles
    bring their counts and are spread by their sets, so one pass over the texts and one
    exchange count the others. The smallest set of a shingle comes from partial
    aggregates that are joined back.
    """
    salt = F.when(F.col("hot").isNull(), F.lit(0).cast("long")).otherwise(F.col("set"))
    counted = (
        prefixes.withColumn("salt", salt)
        .withColumn("met", F.count(F.lit(1)).over(Window.partitionBy("shingle", "salt")))
        .select("shingle", "set", "least", F.coalesce("hot", "met").alias("df"))
        .where("df > 1")
    )
    by_set = Window.partitionBy("set")
    ranked = (
        counted
        .withColumn("place", F.dense_rank().over(by_set.orderBy("df", "shingle")))
        .withColumn("shared", F.max("place").over(by_set))
        .where((F.col("shared") >= F.col("least")) & (F.col("place") <= F.col("shared") - F.col("least") + 1))
    )
    kept = written(ranked.select("shingle", "set"))
    firsts = kept.groupBy("shingle").agg(F.min("set").alias("a"), F.max("set").alias("z")).where("a <> z").select("shingle", "a")
    return kept.join(firsts, "shingle").select("a", F.col("set").alias("b")).where("a <> b").distinct()


def _linked(common: np.ndarray, n: np.ndarray, size: int, threshold: Fraction) -> np.ndarray:
    return common * threshold.denominator >= (n + size - common) * threshold.numerator


class Region:
    """Sets of one region, held by one task, by what they share: a bit for each shingle that many have, lists of sets for the others."""

    def __init__(self, sets: np.ndarray, shingles: list[np.ndarray], settled: np.ndarray, threshold: Fraction):
        self.threshold = threshold
        # The same set may come from several cuts of its region.
        order = np.lexsort((settled, sets))
        keep = order[np.append(True, sets[order][1:] != sets[order][:-1])]
        self.sets, self.settled = sets[keep], settled[keep]
        kept = [shingles[i] for i in keep]
        self.sizes = np.array([len(s) for s in kept], np.int64)
        m, starts = len(kept), np.append(0, np.cumsum(self.sizes))
        _, dense, met = np.unique(np.concatenate(kept), return_inverse=True, return_counts=True)
        self.partners = np.add.reduceat(met[dense] > 1, starts[:-1]) >= [needed(int(n), threshold) for n in self.sizes]
        owner = np.repeat(np.arange(m, dtype=np.int32), self.sizes)
        frequent = met >= max(2, m / FREQUENT_PART)
        at = np.flatnonzero(frequent[dense])
        column = (np.cumsum(frequent) - 1)[dense[at]]
        self.bits = np.zeros((m, int(frequent.sum()) // 64 + 1), np.uint64)
        np.bitwise_or.at(self.bits.reshape(-1), owner[at].astype(np.int64) * self.bits.shape[1] + column // 64, np.uint64(1) << (column % 64).astype(np.uint64))
        self.n_frequent = np.bincount(owner[at], minlength=m)
        # The other shingles, those of one set left out: of each set, and the sets of each.
        at = np.flatnonzero((~frequent & (met > 1))[dense])
        self.rare = (np.cumsum(~frequent & (met > 1)) - 1)[dense[at]]
        self.rare_starts = np.searchsorted(owner[at], np.arange(m + 1))
        by_shingle = np.argsort(self.rare, kind="stable")
        self.having = owner[at][by_shingle]
        self.having_starts = np.append(0, np.cumsum(np.bincount(self.rare, minlength=0)))

    def near(self, pivot: int, live: np.ndarray, all_live: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Live sets, all within twice the radius of the pivot among them, and how many shingles they share with it."""
        own = self.rare[self.rare_starts[pivot] : self.rare_starts[pivot + 1]]
        lists = [self.having[self.having_starts[k] : self.having_starts[k + 1]] for k in own.tolist()]
        met = np.concatenate(lists) if lists else np.zeros(0, np.int32)
        # Within twice the radius lies only who shares so many; with fewer frequent ones it shares another as well.
        least = self.sizes[pivot] * max(0.0, float(2 * self.threshold - 1)) - 1e-6
        if self.n_frequent[pivot] < least:
            among, common = np.unique(met[live[met]], return_counts=True)
        else:
            among, common = all_live, np.bincount(met, minlength=len(live))[all_live]
        if self.n_frequent[pivot]:
            common = common + np.bitwise_count(self.bits[among] & self.bits[pivot]).sum(axis=1, dtype=np.int64)
        return among, common

    def links(self) -> Iterator[tuple[int, int]]:
        """Pairs of sets that connect whatever is linked in the region.

        A pivot's own are settled: linked to it, so connected. Others may be linked to one
        of them only within twice the radius of the pivot. If no one is there, the settled
        ones are done; else those stay that lie within the radius of the nearest other. They
        stay open where that other is settled itself, but in another component. Sets that
        share too little with the whole region are linked to none and left out.
        """
        radius = float(1 - self.threshold) + 1e-9
        label, groups = np.arange(len(self.sets)), {}
        open_, live = self.partners & ~self.settled, self.partners.copy()
        all_live, n_live = np.flatnonzero(live), int(live.sum())
        for pivot in np.flatnonzero(open_).tolist():
            if not open_[pivot]:
                continue
            if n_live < 2:
                return
            if n_live < 0.8 * len(all_live):
                all_live = np.flatnonzero(live)
            among, common = self.near(pivot, live, all_live)
            among, common = among[live[among]], common[live[among]]
            n, size = self.sizes[among], int(self.sizes[pivot])
            linked, distance, is_open = _linked(common, n, size, self.threshold), 1 - common / (n + size - common), open_[among]
            for other in among[linked].tolist():
                a, b = int(label[pivot]), int(label[other])
                if a != b:
                    yield int(self.sets[pivot]), int(self.sets[other])
                    a, b = (a, b) if len(groups.get(a, "1")) >= len(groups.get(b, "1")) else (b, a)
                    label[groups.get(b, [b])] = a
                    groups.setdefault(a, [a]).extend(groups.pop(b, [b]))
            own = linked & is_open & (among != pivot)
            to_open = _nearest(distance[is_open & ~linked], radius)
            to_foreign = _nearest(distance[~is_open & ~linked & (label[among] != label[pivot])], radius)
            reopened = own & (distance >= to_foreign - radius)
            joined = own & ~reopened & (distance >= to_open - radius)
            # Settled ones linked to the pivot are covered by its window as well.
            covered = ~is_open & linked & ~(distance >= min(to_open, to_foreign) - radius)
            open_[among[own & ~reopened]] = False
            gone = among[(own & ~reopened & ~joined) | covered]
            open_[pivot] = live[pivot] = False
            live[gone] = False
            n_live -= len(gone) + 1


def _nearest(distances: np.ndarray, radius: float) -> float:
    """The smallest distance, if it is within twice the radius."""
    nearest = float(distances.min()) if len(distances) else np.inf
    return nearest if nearest <= 2 * radius else np.inf


MEMBER = "region long, set long, n long, settled boolean, shingles binary"


def _join_regions(members: DataFrame, threshold: Fraction) -> DataFrame:
    """Links (a, b) inside each region; a region is joined by one task and bounded in size."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, bool, np.ndarray]] = []
        region, found = None, []

        def close() -> None:
            if len(held) > 1:
                r = Region(np.array([h[0] for h in held], np.int64), [h[2] for h in held], np.array([h[1] for h in held], bool), threshold)
                found.extend(r.links())
            held.clear()

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in (0, 1, 3, 4)]
            for own, one, settled, packed in zip(*columns):
                if own != region:
                    close()
                    region = own
                held.append((one, settled, np.frombuffer(packed, "<u8")))
            if len(found) >= 10_000:
                yield _edges(found)
                found = []
        close()
        if found:
            yield _edges(found)

    return members.repartition("region").sortWithinPartitions("region").mapInArrow(released(join), "a long, b long")


def _edges(found: list[tuple[int, int]]) -> pa.RecordBatch:
    pairs = np.array(found, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["a", "b"])


def _cut_by_shingles(members: DataFrame, threshold: Fraction) -> DataFrame:
    """Of each region the smaller ones that hold all its pairs above the threshold; none is settled yet.

    Prefixes of unlike documents meet by chance, the more the larger the table. Within a region
    all shingles are counted: a set whose partner is there shares as many as it must have in
    common with it. Of those each set may leave out any less than half of that many: what both
    leave out is then not all that they have in common. Those go that are in far more or far fewer sets
    than its others, like a line that is in many unlike texts.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.slice(at, 500)
                sizes = np.array(part.column(2).to_pylist(), np.int64)
                least = np.array([needed(int(n), threshold) for n in sizes], np.int64)
                shingles = np.frombuffer(b"".join(part.column(3).to_pylist()), np.int64)
                repeated = [np.repeat(np.array(x, np.int64), sizes) for x in (part.column(0).to_pylist(), part.column(1).to_pylist(), least)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*repeated, shingles)], names=["region", "set", "least", "shingle"])

    rows = members.select("region", "set", "n", "shingles").mapInArrow(released(spread), "region long, set long, least long, shingle long")
    # Partial aggregates are joined back, so that a shingle of very many sets needs no task of its own.
    met = rows.groupBy("region", "shingle").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    by_set = Window.partitionBy("region", "set")
    kept = written(
        rows.join(met, ["region", "shingle"])
        .withColumn("place", F.dense_rank().over(by_set.orderBy("df", "shingle")))
        .withColumn("shared", F.max("place").over(by_set))
        .where("shared >= least")
        .withColumn("usual", F.max(F.when(F.col("place") == F.ceil(F.col("shared") / 2), F.col("df"))).over(by_set))
        .withColumn("unusual", F.dense_rank().over(by_set.orderBy(F.abs(F.log(F.col("df") / F.col("usual"))).desc(), "shingle")))
        .where("unusual > (least - 1) DIV 2")
        .select("region", "shingle", "set")
    )
    firsts = kept.groupBy("region", "shingle").agg(F.min("set").alias("a"), F.max("set").alias("z")).where("a <> z").select("region", "shingle", "a")
    edges = kept.join(firsts, ["region", "shingle"]).select("a", F.col("set").alias("b")).where("a <> b").distinct()
    smaller = components(edges).select(F.col("node").alias("set"), F.col("component").alias("smaller"))
    return members.join(smaller, "set").select(F.col("smaller").alias("region"), "set", "n", "settled", "shingles")


def _cut_by_pivots(members: DataFrame, threshold: Fraction, round_: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """One round over regions too large for a task: links to their pivots, and smaller regions that hold all other pairs.

    Every pivot's region is a window: its own documents and those not its own within
    twice the radius; what belongs to no pivot stays together. Where that is most of
    the region, its documents lie far from one another, and it is cut in blocks joined two by two.
    """
    radius = float(1 - threshold) + 1e-9
    draw = F.xxhash64("set", F.lit(round_))
    pivots = (
        members.where(~F.col("settled"))
        .groupBy("region", F.pmod(draw, F.lit(PIVOTS)).alias("k"))
        .agg(F.min_by(F.struct("set", "shingles"), draw).alias("pivot"))
        .groupBy("region")
        .agg(F.collect_list("pivot").alias("pivots"))
        .select("region", "pivots", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    )
    salted = members.withColumn("salt", F.pmod(F.xxhash64("set", F.lit("salt")), F.lit(SALTS)).cast("int"))
    sent = salted.join(pivots, ["region", "salt"]).select("region", "set", "n", "settled", "shingles", "pivots")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for packed, n, own_pivots in zip(batch.column(4).to_pylist(), batch.column(2).to_pylist(), batch.column(5).to_pylist()):
                own, near = np.frombuffer(packed, "<u8"), []
                for p in own_pivots:
                    other = np.frombuffer(p["shingles"], "<u8")
                    common = np.array([len(np.intersect1d(own, other, assume_unique=True))])
                    near.append({"pivot": p["set"], "linked": bool(_linked(common, np.array([n]), len(other), threshold)[0]), "distance": float(1 - common[0] / (n + len(other) - common[0]))})
                out.append(near)
            near = pa.array(out, pa.list_(pa.struct([("pivot", pa.int64()), ("linked", pa.bool_()), ("distance", pa.float64())])))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), near], names=["region", "set", "n", "settled", "shingles", "near"])

    near_schema = MEMBER + ", near array<struct<pivot: long, linked: boolean, distance: double>>"
    measured = written(sent.mapInArrow(released(measure), near_schema))
    flat = measured.select("region", "set", "settled", F.explode("near").alias("p")).select("region", "set", "settled", "p.*")
    links = flat.where("linked AND set <> pivot").select(F.col("pivot").alias("a"), F.col("set").alias("b"))
    # Where someone settled earlier is near, the pivot's own stay open to be compared with them.
    nearest = (
        flat.where(~F.col("linked") & (F.col("distance") <= 2 * radius))
        .groupBy("region", "pivot")
        .agg(F.min("distance").alias("nearest"), F.bool_or("settled").alias("reopen"))
    )
    windows = (
        measured.select("region", "set", "n", "settled", "shingles", F.explode("near").alias("p"))
        .where(F.col("p.distance") <= 2 * radius)
        .withColumn("pivot", F.col("p.pivot"))
        .withColumn("salt", F.pmod(F.xxhash64("set", F.lit("salt")), F.lit(SALTS)).cast("int"))
        .join(nearest.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["region", "pivot", "salt"])
        .where((F.col("p.linked") & (F.col("p.distance") >= F.col("nearest") - radius)) | (~F.col("p.linked")))
        .select(F.xxhash64("region", "pivot", F.lit(round_)).alias("region"), "set", "n", (F.col("settled") | (F.col("p.linked") & ~F.col("reopen"))).alias("settled"), "shingles")
    )
    left = measured.where(~F.exists("near", lambda p: p["linked"]))
    before = measured.groupBy("region").agg(F.sum("n").alias("before"))
    shares = (
        left.groupBy("region")
        .agg(F.sum("n").alias("after"))
        .join(before, "region")
        .select("region", F.when((F.col("after") > limit) & (F.col("after") > 0.8 * F.col("before")), F.ceil(2 * F.col("after") / limit)).otherwise(1).cast("int").alias("blocks"))
    )
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    placed = (
        left.drop("near")
        .withColumn("salt", F.pmod(F.xxhash64("set", F.lit("salt")), F.lit(SALTS)).cast("int"))
        .join(shares.select("region", "blocks", salts), ["region", "salt"])
        .withColumn("block", F.pmod(F.xxhash64("set", F.lit(round_)), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(F.xxhash64("region", F.least("block", "other"), F.greatest("block", "other"), F.lit(round_)).alias("region"), "set", "n", "settled", "shingles")
    )
    return links, windows.unionByName(placed)


def shingle_components(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = WORDS,
    threshold: Fraction = THRESHOLD,
    region_shingles: int = REGION_SHINGLES,
) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (the smallest doc_id that links reach, or its own).

    Equal sets are joined once, whatever the number of their documents. Each other
    set's shingles travel twice: the first of them to find its region, all of them
    only if it has one.

    Defined for odd input: a null or empty text has no shingles and is linked with
    nothing; a text of fewer words than a shingle is one shingle of its own;
    repeated rows are documents of equal sets; rows with a null id belong to the
    component of their set. An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    described = written(_describe(rows, words))
    documents = described.where("kind = 0").select(F.col("id").alias("doc_id"), "set", F.col("n").alias("n_shingles"))
    hot = (
        described.where("kind = 1").groupBy("id").agg(F.sum("n").alias("n")).orderBy(F.col("n").desc(), "id").limit(HOT_SHINGLES).collect()
    )
    hot = sorted(((r["n"], r["id"]) for r in hot))
    prefixes = _prefixes(rows, words, threshold, np.array([i for _, i in hot], np.int64).view(np.uint64), np.array([n for n, _ in hot], np.int64))
    regions = written(components(_candidate_edges(prefixes)).withColumnsRenamed({"node": "set", "component": "region"}))

    sets = documents.where("set IS NOT NULL").groupBy("set").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies"), F.first("n_shingles").alias("n"))
    sets = written(sets)
    chosen = sets.join(regions, "set").select(F.col("first_id").alias("doc_id"), F.col("set").alias("chosen_set"), "region")
    # A set whose documents all have null ids can't be met by id; it is met by its text.
    texts = rows.join(chosen, "doc_id").select("region", "chosen_set", "text")
    orphans = sets.where("first_id IS NULL").join(regions, "set").select("set", "region")
    nameless = None if orphans.isEmpty() else rows.where("doc_id IS NULL").select(F.lit(None).cast("long").alias("region"), F.lit(None).cast("long").alias("chosen_set"), "text")

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            for at in range(0, max(1, len(batch)), 500):
                part = batch.slice(at, 500)
                sets = [shingler(t) for t in utf8_column(part.column(2))]
                own = [set_id(s) for s in sets]
                # Repeated ids may have other texts; only the row of the set itself counts.
                keep = [i for i, (s, wanted) in enumerate(zip(own, part.column(1).to_pylist())) if wanted is None or s == wanted]
                regions = part.column(0).to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([regions[i] for i in keep], pa.int64()),
                        pa.array([own[i] for i in keep], pa.int64()),
                        pa.array([len(sets[i]) for i in keep], pa.int64()),
                        pa.array([False] * len(keep), pa.bool_()),
                        pa.array([sets[i].tobytes() for i in keep], pa.binary()),
                    ],
                    names=["region", "set", "n", "settled", "shingles"],
                )

    members = texts.mapInArrow(released(shingle), MEMBER)
    if nameless is not None:
        found = nameless.mapInArrow(released(shingle), MEMBER).drop("region").join(orphans, "set").select("region", "set", "n", "settled", "shingles")
        members = members.unionByName(found)
    members = members.where("n > 0")
    links = _all_links(members, sets.join(regions, "set").groupBy("region").agg(F.sum("n").alias("size"), F.count(F.lit(1)).alias("sets")), threshold, region_shingles)

    roots = components(links).withColumnsRenamed({"node": "set", "component": "root"})
    joined = sets.join(roots, "set", "left").withColumn("root", F.coalesce("root", "set"))
    smallest = joined.groupBy("root").agg(F.min("first_id").alias("component_id"), F.sum("copies").alias("size")).where("size > 1")
    named = written(joined.join(smallest, "root").select("set", "copies", "component_id"))
    return _attach(documents, named)


def _all_links(members: DataFrame, sizes: DataFrame, threshold: Fraction, limit: int) -> DataFrame:
    """Cuts regions above ``limit`` shingles round by round, by their shingles as long as that helps, then by pivots; the rest is joined region by region."""
    sizes = written(sizes)
    if sizes.where(F.col("size") > limit).isEmpty():
        return _join_regions(members, threshold)
    members = written(members)
    large = sizes.where((F.col("size") > limit) & (F.col("sets") > 1))
    links = _join_regions(members.join(large.select("region"), "region", "left_anti"), threshold)
    work, round_ = members.join(large.select("region"), "region", "left_semi"), 0
    before = large.agg(F.sum("size")).first()[0]
    if not before:
        return links
    while True:
        cut = written(_cut_by_shingles(work, threshold))
        sizes = written(cut.groupBy("region").agg(F.sum("n").alias("size"), F.count(F.lit(1)).alias("sets")))
        large = sizes.where((F.col("size") > limit) & (F.col("sets") > 2))
        links = links.unionByName(_join_regions(cut.join(large.select("region"), "region", "left_anti"), threshold))
        work, after = cut.join(large.select("region"), "region", "left_semi"), large.agg(F.sum("size")).first()[0]
        if not after:
            return links
        if after > LEAST_CUT * before:
            break
        before = after
    while True:
        found, cut = _cut_by_pivots(work, threshold, round_, limit)
        cut = written(cut)
        links = links.unionByName(written(found))
        sizes = written(cut.groupBy("region").agg(F.sum("n").alias("size"), F.count(F.lit(1)).alias("sets"), F.bool_or(~F.col("settled")).alias("open")))
        live = sizes.where(F.col("open") & (F.col("sets") > 1))
        # Two sets can't be cut further, however large they are.
        large = live.where((F.col("size") > limit) & (F.col("sets") > 2)).select("region")
        small = live.where((F.col("size") <= limit) | (F.col("sets") <= 2)).select("region")
        links = links.unionByName(_join_regions(cut.join(small, "region", "left_semi"), threshold))
        if large.isEmpty():
            return links
        work, round_ = cut.join(large, "region", "left_semi"), round_ + 1


def _attach(documents: DataFrame, named: DataFrame) -> DataFrame:
    """Names each document's component. Sets of very many documents, at most 1000, are sent; the rest is joined."""
    hot_size = documents.count() / 1000
    hot = named.where(F.col("copies") > hot_size).select("set", F.col("component_id").alias("hot_id"), F.lit(True).alias("is_hot"))
    rest = named.where(F.col("copies") <= hot_size).select(F.col("set").alias("rest_set"), F.col("component_id"), F.lit(True).alias("is_rest"))
    marked = documents.join(F.broadcast(hot), "set", "left")
    # What is decided, or has no set, gets a key of its own and so spreads over the join.
    key = F.when(F.col("is_hot") | F.col("set").isNull(), F.xxhash64("doc_id", F.lit(7))).otherwise(F.col("set"))
    undecided = F.col("is_hot").isNull() & F.col("set").isNotNull()
    joined = marked.withColumn("key", key).withColumn("undecided", undecided).join(rest, (F.col("key") == F.col("rest_set")) & F.col("undecided"), "left")
    component = F.when(F.col("is_hot"), F.col("hot_id")).when(F.col("is_rest"), F.col("component_id")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id"))


def one_per_component(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **parameters) -> DataFrame:
    """The documents without near duplicates: of each component one row stays, with all its columns.

    It is the row with the smallest id; null ids come after all others. Rows are told
    apart by a key written with them, so null and repeated ids decide nothing but that order.
    """
    row, dropped_row = fresh("row_key", docs.columns), fresh("dropped_row", docs.columns)
    keyed = written(docs.withColumn(row, F.monotonically_increasing_id()))
    found = written(shingle_components(keyed, row, text_col, **parameters).select(F.col("doc_id").alias("row"), F.col("component_id").alias("component")))
    others = found.where("row <> component")
    members = others.unionByName(others.select(F.col("component").alias("row"), "component").distinct())
    named = keyed.select(F.col(row).alias("key"), F.col(id_col).cast("long").alias("id"))
    order = F.struct(F.col("id").isNull(), "id", "row")
    kept = members.join(named, F.col("row") == F.col("key")).groupBy("component").agg(F.min_by("row", order).alias("kept"))
    dropped = members.join(kept.select("kept"), F.col("row") == F.col("kept"), "left_anti").select(F.col("row").alias(dropped_row))
    return keyed.join(dropped, F.col(row) == F.col(dropped_row), "left_anti").drop(row)
