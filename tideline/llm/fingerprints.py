"""Document fingerprints by locally consistent parsing.

A text is cut into phrases by looking only at a few neighbours of each symbol:
deterministic coin tossing lowers the symbols to six labels of which no two
neighbours are equal, and phrases start at their local maxima. Phrases get names
from their contents and are the symbols of the next level. Equal substrings are
cut alike, whatever stands before them, except near their ends.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import mix64, released, utf8_column

# Phrases of this level, some 14 characters long on average, are what fingerprints are made of.
LEVEL = 3
# So many of the smallest phrase names form a fingerprint.
KEPT = 48
CHARS_AT_ONCE = 400_000
IDS_PER_BUCKET = 500
MAX_BUCKETS = 100_000
CUTS_TOGETHER = 256

_BASE = np.uint64(0x9E3779B97F4A7C15)
_DE_BRUIJN = np.uint64(0x03F79D71B4CB0A89)
_BIT_INDEX = np.zeros(64, np.uint8)
for _i in range(64):
    _BIT_INDEX[(((1 << _i) * int(_DE_BRUIJN)) & (2**64 - 1)) >> 58] = _i


def _toss_table() -> np.ndarray:
    """For labels below 128, by own * 128 + left neighbour's: twice the lowest differing bit plus its value."""
    own, left = np.divmod(np.arange(128 * 128, dtype=np.int64), 128)
    differing = own ^ left
    lowest = np.zeros_like(own)
    for bit in range(6, -1, -1):
        lowest[(differing >> bit) & 1 == 1] = bit
    return (2 * lowest + ((own >> lowest) & 1)).astype(np.uint8)


_TOSS = _toss_table()


def coin_labels(symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Labels 0 to 5, unequal between neighbours, for symbols unequal between neighbours.

    ``first`` marks the first symbol of each text; it is compared with its own complement.
    """
    left = np.empty_like(symbols)
    left[1:] = symbols[:-1]
    left[first] = ~symbols[first]
    differing = symbols ^ left
    with np.errstate(over="ignore"):
        bit = _BIT_INDEX[((differing & (~differing + np.uint64(1))) * _DE_BRUIJN) >> np.uint64(58)]
    labels = (2 * bit + ((symbols >> bit.astype(np.uint64)) & np.uint64(1)).astype(np.uint8)).astype(np.int32)
    for _ in range(3):
        left_labels = np.empty_like(labels)
        left_labels[1:] = labels[:-1]
        left_labels[first] = labels[first] ^ 1
        labels = _TOSS[labels * 128 + left_labels].astype(np.int32)
    return labels


def next_level(symbols: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Phrases of each text's symbols: their names and texts. ``text`` numbers each symbol's text, ascending."""
    if not len(symbols):
        return symbols, text
    new = np.empty(len(symbols), bool)
    new[0] = True
    np.not_equal(symbols[1:], symbols[:-1], out=new[1:])
    new[1:] |= text[1:] != text[:-1]
    starts = np.flatnonzero(new)
    if len(starts) < len(symbols):
        # A run of one symbol is one symbol, named by what it repeats and how often.
        runs = np.diff(np.append(starts, len(symbols))).astype(np.uint64)
        symbols, text = symbols[starts], text[starts]
        with np.errstate(over="ignore"):
            symbols = np.where(runs > 1, mix64(symbols + runs * _BASE), symbols)
    first = np.empty(len(symbols), bool)
    first[0] = True
    np.not_equal(text[1:], text[:-1], out=first[1:])
    # Two run names could be equal by chance; a differing bit is then made up, alike for equal substrings.
    same = np.zeros(len(symbols), bool)
    same[1:] = (symbols[1:] == symbols[:-1]) & ~first[1:]
    labels = coin_labels(symbols, first | same)
    cut = first.copy()
    cut[1:-1] |= (labels[1:-1] > labels[:-2]) & (labels[1:-1] > labels[2:]) & ~first[2:]
    starts = np.flatnonzero(cut)
    sizes = np.diff(np.append(starts, len(symbols)))
    place = np.arange(len(symbols)) - np.repeat(starts, sizes)
    powers = np.cumprod(np.full(int(sizes.max()), _BASE, np.uint64))
    with np.errstate(over="ignore"):
        names = mix64(np.add.reduceat(mix64(symbols) * powers[place], starts) + sizes.astype(np.uint64))
    return names, text[starts]


def fingerprints(texts: list[str], level: int = LEVEL, kept: int = KEPT) -> list[np.ndarray]:
    """Per text the smallest ``kept`` names of its phrases, as sorted 32-bit numbers; the empty text has none."""
    sizes = np.array([len(t) for t in texts], np.int64)
    symbols = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    text = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    for _ in range(level):
        symbols, text = next_level(symbols, text)
    names = (mix64(symbols + np.uint64(level)) >> np.uint64(32)).astype(np.uint64)
    joint = np.unique((text.astype(np.uint64) << np.uint64(32)) | names)
    cuts = np.searchsorted(joint >> np.uint64(32), np.arange(len(texts) + 1, dtype=np.uint64))
    low = (joint & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    return [low[a : min(b, a + kept)] for a, b in zip(cuts[:-1], cuts[1:])]


def likeness(a: np.ndarray, b: np.ndarray, kept: int = KEPT) -> float:
    """Estimated share of common phrases: of the smallest names of both, those that both have. Two empty ones are alike."""
    if not len(a) and not len(b):
        return 1.0
    union = np.union1d(a, b)[:kept]
    return float(np.isin(union, np.intersect1d(a, b, assume_unique=True), assume_unique=True).mean())


def in_order(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows by bucket of ids, each bucket closed by a copy (``guest``) of the row that follows its last one.

    Order is descending id (null ids last, repeated ids by text); after the last row comes the first. Buckets are
    ranges of ids and meet in one task each, one after the other, so each text is exchanged
    once. They begin at ids drawn by their hash, so they hold about as many different ids
    each, wherever these lie. A bucket is streamed; its size doesn't matter to memory. Only one id per
    bucket goes through the driver, about MAX_BUCKETS at most.
    """
    smallest = -(1 << 63)
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(smallest)).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ids = docs.select(F.col(id_col).cast("long").alias("id"))
    every = max(IDS_PER_BUCKET, ids.count() // MAX_BUCKETS)
    drawn = ids.where(F.col("id").isNotNull() & (F.pmod(F.xxhash64("id"), F.lit(every)) == 0)).distinct()
    cuts = sorted(r["id"] for r in drawn.collect())
    blocks = [cuts[i : i + CUTS_TOGETHER] for i in range(0, len(cuts), CUTS_TOGETHER)]
    # One text each, read once when the query is planned: first the block is found by its first cut, then the place in it.
    firsts, places = F.from_json(F.lit(json.dumps([b[0] for b in blocks])), "array<bigint>"), F.from_json(F.lit(json.dumps(blocks)), "array<array<bigint>>")
    block = F.size(F.filter(firsts, lambda c: c <= F.col("key"))) - 1
    within = F.size(F.filter(F.get(places, F.col("block")), lambda c: c <= F.col("key")))
    bucket = F.when(F.col("doc_id").isNull(), F.lit(-1)).when(F.col("block") < 0, F.lit(0)).otherwise(F.col("block") * CUTS_TOGETHER + within)
    keyed = keyed.withColumn("block", block).withColumn("bucket", bucket.cast("long"))
    tops = sorted(((r["bucket"], r["key"]) for r in keyed.groupBy("bucket").agg(F.max("key").alias("key")).collect()), reverse=True)
    guests = [(tops[(i + 1) % len(tops)][1], b) for i, (b, _) in enumerate(tops)]
    visits = F.broadcast(docs.sparkSession.createDataFrame(guests, "guest_key long, visited long"))
    both = F.array_compact(F.array(F.struct(F.col("bucket"), F.lit(False).alias("guest")), F.when(F.col("visited").isNotNull(), F.struct(F.col("visited").alias("bucket"), F.lit(True).alias("guest")))))
    rows = keyed.join(visits, F.col("key") == F.col("guest_key"), "left").select("doc_id", "key", "text", F.explode(both).alias("place"))
    return (
        rows.select("place.bucket", "place.guest", "key", "doc_id", "text")
        .repartition("bucket")
        .sortWithinPartitions(F.col("bucket").desc(), "guest", F.col("key").desc(), "text")
        .select("bucket", "guest", "doc_id", "text")
    )


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document its fingerprint, that of its edited text, and their likeness and the next document's.

    The edited text has its last third replaced by the beginning of the next
    document. Defined for odd input: a null text is the empty text, which has an
    empty fingerprint (alike only to another empty one); repeated ids stand in the
    order of their texts; a single document is its own next one; an empty table gives no rows.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple[int | None, str]] = []
        bucket, closed, size = None, False, 0
        for batch in batches:
            for at, guest, doc_id, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), utf8_column(batch.column(3))):
                if at != bucket:
                    bucket, closed, waiting, size = at, False, [], 0
                if closed:
                    continue
                waiting.append((doc_id, raw.decode("utf-8", "replace")))
                size += len(waiting[-1][1])
                if guest or size >= CHARS_AT_ONCE and len(waiting) > 1:
                    yield _compared(waiting)
                    waiting, closed = waiting[-1:], guest
                    size = len(waiting[0][1])

    return in_order(docs, id_col, text_col).mapInArrow(released(compare), SCHEMA)


def _compared(rows: list[tuple[int | None, str]]) -> pa.RecordBatch:
    """All rows but the last, each with the row after it."""
    texts = [text for _, text in rows]
    edited = []
    for text, following in zip(texts, texts[1:]):
        third = len(text) // 3
        edited.append(text[: len(text) - third] + following[:third])
    prints = fingerprints(texts + edited)
    own, changed = prints[: len(texts)], prints[len(texts) :]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([i for i, _ in rows[:-1]], pa.int64()),
            pa.array([len(t) for t in texts[:-1]], pa.int64()),
            pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited], pa.string()),
            pa.array([p.astype(">u4").tobytes().hex() for p in own[:-1]], pa.string()),
            pa.array([p.astype(">u4").tobytes().hex() for p in changed], pa.string()),
            pa.array([likeness(a, b) for a, b in zip(own, changed)], pa.float64()),
            pa.array([likeness(a, b) for a, b in zip(own, own[1:])], pa.float64()),
        ],
        names=[c.split()[0] for c in SCHEMA.split(", ")],
    )
