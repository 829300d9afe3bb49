"""Two tokenizers' tokens of one text, cut into groups where both end, and how often pairs of ids end together.

Both token sequences of a text spell the same bytes. A byte offset at which a token
of each ends is a cut. Cuts are found by divide and conquer: near the middle of an
interval a token end of the one sequence is looked up by bisection among the ends of
the other; a common end splits the interval in two, which are treated alike, and an
interval without one is a group. All intervals of a depth, of all texts of a batch,
are treated at once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.bpe import WORDS, Vocabulary
from tideline.llm.common import released, sliced, utf8_column, written

# Bytes of text that are aligned together; a longer text is aligned alone.
BATCH_BYTES = 4_000_000
# A pair holding this share of all links is frequent; there are at most 1 / FREQUENT_SHARE of them.
FREQUENT_SHARE = 2.0**-18
# Fixed value: the character that stands for a space in pieces.
SPACE = "▁"

SCHEMA = "doc_id long, n_a long, n_b long, n_groups long, groups string, pairs array<long>, times array<long>"


class Tokenizers:
    """What tasks need of both tokenizers: small, and sent to each of them once."""

    def __init__(self, vocabulary: Vocabulary, pieces: bytes):
        self.vocabulary, self.pieces = vocabulary, pieces
        self.key = vocabulary.key + hashlib.sha256(pieces).hexdigest()

    @classmethod
    def load(cls, byte_bpe: str, pieces: str) -> Tokenizers:
        return cls(Vocabulary.load(byte_bpe), Path(pieces).read_bytes())


class Both:
    """The tokenizers of a worker, with the bytes and the printed form of each token."""

    def __init__(self, sent: Tokenizers):
        vocabulary = sent.vocabulary
        plain = {i: t for i, t in vocabulary.tokens.items() if i not in vocabulary.special.values()}
        formed = [token for _, _, token in vocabulary.merges]
        # The library merges by rank: single bytes first, then tokens in the order of the merges that form them.
        ids = [*(i for i, t in plain.items() if len(t) == 1), *dict.fromkeys(formed)]
        self.encoder = tiktoken.Encoding("a", pat_str=WORDS, mergeable_ranks={plain[i]: rank for rank, i in enumerate(ids)}, special_tokens={})
        self.id_of_rank = np.array(ids, np.int64)
        self.a_bytes = [vocabulary.tokens.get(i, b"") for i in range(max(vocabulary.tokens) + 1)]
        self.processor = sentencepiece.SentencePieceProcessor()
        self.processor.LoadFromSerializedProto(sent.pieces)
        names = [self.processor.id_to_piece(i) for i in range(self.processor.get_piece_size())]
        self.b_bytes = [bytes([int(s[3:5], 16)]) if self.processor.is_byte(i) else s.replace(SPACE, " ").encode() for i, s in enumerate(names)]
        self.a_size, self.b_size = (np.array([len(t) for t in table], np.int64) for table in (self.a_bytes, self.b_bytes))
        # Twice each token: followed by another of its kind, and as the last one of its kind in a group.
        self.printed = [f"{i}{end}" for table, last in ((self.a_bytes, "|"), (self.b_bytes, ";")) for i in range(len(table)) for end in (",", last)]

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """The ids of both, or None where not both spell the text."""
        whole = (" " + text).encode()
        a = self.id_of_rank[np.asarray(self.encoder.encode_ordinary(" " + text), np.int64)]
        b = self.processor.encode(text, num_threads=1)
        if b"".join(map(self.b_bytes.__getitem__, b)) != whole or b"".join(map(self.a_bytes.__getitem__, a.tolist())) != whole:
            return None
        return a, np.asarray(b, np.int64)


def _near_middle(a_ends: np.ndarray, b_ends: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For intervals of a-tokens [lo, hi): the a-token nearest the middle whose end, before the interval's own, is also
    an end of a b-token, and that b-token; -1 where there is none.

    Rings around the middle, each twice as wide as the one before, are looked up by bisection until one has a common end.
    """
    found_a, found_b = np.full(len(lo), -1), np.full(len(lo), -1)
    mid, open_, near = (lo + hi - 1) // 2, np.flatnonzero(hi - lo > 1), 0
    while len(open_):
        far = 2 * near + 1
        m, first, last = mid[open_], lo[open_], hi[open_] - 2
        # Left of the middle (mid - far, mid - near], right of it [mid + near, mid + far), the middle itself once.
        spans = [(np.maximum(m - far + 1, first), np.minimum(m - near, last))]
        if near:
            spans.append((np.maximum(m + near, first), np.minimum(m + far - 1, last)))
        best = np.full(len(open_), np.iinfo(np.int64).max)
        at_a, at_b = np.full(len(open_), -1), np.full(len(open_), -1)
        for start, stop in spans:
            sizes = np.maximum(stop - start + 1, 0)
            of = np.repeat(np.arange(len(open_)), sizes)
            asked = np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + start[of]
            place = np.searchsorted(b_ends, a_ends[asked])
            common = np.flatnonzero(b_ends[np.minimum(place, len(b_ends) - 1)] == a_ends[asked])
            away = np.abs(asked[common] - m[of[common]])
            # The nearest one of each interval comes last, so that it stays.
            order = np.argsort(-away, kind="stable")
            common, away = common[order], away[order]
            nearest = np.full(len(open_), np.iinfo(np.int64).max)
            nearest[of[common]] = away
            asked_at, place_at = np.full(len(open_), -1), np.full(len(open_), -1)
            asked_at[of[common]], place_at[of[common]] = asked[common], place[common]
            closer = nearest < best
            best[closer], at_a[closer], at_b[closer] = nearest[closer], asked_at[closer], place_at[closer]
        hit = at_a >= 0
        found_a[open_[hit]], found_b[open_[hit]] = at_a[hit], at_b[hit]
        spent = (m - far < first) & (m + far > last)
        open_, near = open_[~hit & ~spent], far
    return found_a, found_b


def shared_cuts(a_ends: np.ndarray, b_ends: np.ndarray, a_from: np.ndarray, a_to: np.ndarray, b_from: np.ndarray, b_to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Groups of both token sequences, as ascending numbers one past the last token of each.

    ``a_ends`` and ``b_ends`` ascend strictly; the intervals given have common last ends.
    """
    done_a, done_b = [], []
    while len(a_from):
        # An interval with a single token of either kind can't be cut further.
        whole = (a_to - a_from <= 1) | (b_to - b_from <= 1)
        done_a.append(a_to[whole])
        done_b.append(b_to[whole])
        a_from, a_to, b_from, b_to = (x[~whole] for x in (a_from, a_to, b_from, b_to))
        cut_a, cut_b = _near_middle(a_ends, b_ends, a_from, a_to)
        leaf = cut_a < 0
        done_a.append(a_to[leaf])
        done_b.append(b_to[leaf])
        a_from, a_to, b_from, b_to, cut_a, cut_b = (x[~leaf] for x in (a_from, a_to, b_from, b_to, cut_a + 1, cut_b + 1))
        a_from, a_to = np.concatenate([a_from, cut_a]), np.concatenate([cut_a, a_to])
        b_from, b_to = np.concatenate([b_from, cut_b]), np.concatenate([cut_b, b_to])
    nothing = np.zeros(0, np.int64)
    return np.sort(np.concatenate(done_a or [nothing])), np.sort(np.concatenate(done_b or [nothing]))


def _printed(both: Both, a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray) -> np.ndarray:
    """Numbers into ``both.printed`` of all tokens: group after group, first the a-tokens, then the b-tokens."""
    last_a, last_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    last_a[group_a - 1], last_b[group_b - 1] = 1, 1
    items = np.empty(len(a) + len(b), np.int64)
    before_a, before_b = np.concatenate([[0], group_a]), np.concatenate([[0], group_b])
    items[np.arange(len(a)) + np.repeat(before_b[:-1], np.diff(before_a))] = 2 * a + last_a
    items[np.arange(len(b)) + np.repeat(before_a[1:], np.diff(before_b))] = 2 * len(both.a_bytes) + 2 * b + last_b
    return items


def _aligned(both: Both, ids: pa.Array, texts: list[str]) -> pa.RecordBatch:
    found = [both.encode(t) if t else None for t in texts]
    there = [f for f in found if f is not None]
    n_a = np.array([0 if f is None else len(f[0]) for f in found], np.int64)
    n_b = np.array([0 if f is None else len(f[1]) for f in found], np.int64)
    to_a, to_b = np.cumsum(n_a), np.cumsum(n_b)
    a, b = (np.concatenate([np.zeros(0, np.int64), *(f[k] for f in there)]) for k in (0, 1))
    # Texts follow one another, so ends ascend over the whole batch.
    a_ends, b_ends = np.cumsum(both.a_size[a]), np.cumsum(both.b_size[b])
    some = n_a > 0
    group_a, group_b = shared_cuts(a_ends, b_ends, (to_a - n_a)[some], to_a[some], (to_b - n_b)[some], to_b[some])
    items = _printed(both, a, b, group_a, group_b).tolist()
    groups, at = [], 0
    for size in (n_a + n_b).tolist():
        groups.append("".join(map(both.printed.__getitem__, items[at : at + size]))[:-1])
        at += size
    # Each group ends with one a-token and one b-token that end together: a link.
    per_text = np.diff(np.searchsorted(group_a, np.concatenate([[0], to_a]), side="right"))
    linked = a[group_a - 1] << 32 | b[group_b - 1]
    of = np.repeat(np.arange(len(texts)), per_text)
    order = np.lexsort((linked, of))
    linked, of = linked[order], of[order]
    first = np.flatnonzero(np.concatenate([[True], (np.diff(linked) != 0) | (np.diff(of) != 0)])[: len(linked)])
    times = np.diff(np.concatenate([first, [len(linked)]]))
    offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(of[first], minlength=len(texts)))]).astype(np.int32))
    columns = [ids, *(pa.array(x.astype(np.int64)) for x in (n_a, n_b, per_text)), pa.array(groups, pa.string())]
    columns += [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int64))) for x in (linked[first], times)]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_a", "n_b", "n_groups", "groups", "pairs", "times"])


_WORKERS: dict[str, Both] = {}


def _both(sent: Tokenizers) -> Both:
    if sent.key not in _WORKERS:
        _WORKERS.clear()
        _WORKERS[sent.key] = Both(sent)
    return _WORKERS[sent.key]


def align(docs: DataFrame, tokenizers: Tokenizers, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, groups, and its pairs of ids that end together with how often they do.

    ``groups`` prints the groups as ``a1,a2|b1;a3|b2,b3``; an element of ``pairs`` is a's id times 2^32 plus b's.
    Runs where the rows are read. Defined for odd input: a null or empty text, and one that not
    both tokenizers spell in full, has no tokens and no groups; null ids stay, repeated rows are aligned each.
    """
    sent = docs.sparkSession.sparkContext.broadcast(tokenizers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = _both(sent.value)
        for batch in sliced(batches):
            texts = [t.decode("utf-8", "replace") for t in utf8_column(batch.column(1))]
            start = size = 0
            for i, text in enumerate(texts):
                if size and size + len(text) > BATCH_BYTES:
                    yield _aligned(both, batch.column(0).slice(start, i - start), texts[start:i])
                    start, size = i, 0
                size += len(text)
            yield _aligned(both, batch.column(0).slice(start), texts[start:])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(released(run), SCHEMA)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair, count, best: how many links of all documents hold a pair, and whether no pair of its b-id is held by more."""
    links = aligned.select(F.explode(F.arrays_zip("pairs", "times")).alias("link"))
    counts = links.groupBy(F.col("link.pairs").alias("pair")).agg(F.sum("link.times").alias("count"))
    counts = counts.withColumn("b", F.expr("pair & 4294967295L"))
    # A b-id has as many pairs as the other vocabulary has ids at most.
    highest = counts.groupBy("b").agg(F.max("count").alias("most"))
    return counts.join(highest, "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def link_report(docs: DataFrame, tokenizers: Tokenizers, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Texts are encoded once; what is written of them are counts, the digest and their
    different pairs. Links with frequent pairs, of proven number, are looked up where they are read
    and summed per document there; the rest meets its counts in a join on the pair.
    """
    digest = F.when(F.col("n_groups") > 0, F.sha2(F.col("groups").cast("binary"), 256)).otherwise("")
    aligned = written(
        align(docs, tokenizers, id_col, text_col).select(
            F.monotonically_increasing_id().alias("row"), "doc_id", "n_a", "n_b", "n_groups", digest.alias("groups_sha256"), "pairs", "times"
        )
    )
    counts = written(pair_counts(aligned))
    total = aligned.agg(F.coalesce(F.sum("n_groups"), F.lit(0)).alias("links")).first()["links"]
    frequent = F.col("count") >= total * FREQUENT_SHARE
    # At most 1 / FREQUENT_SHARE pairs are that frequent.
    hot = F.broadcast(counts.where(frequent))
    links = aligned.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("link")).select("row", F.col("link.pairs").alias("pair"), F.col("link.times").alias("times"))
    sums = [F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum")]
    known = links.join(hot, "pair").groupBy("row").agg(*sums)
    rare = links.join(F.broadcast(counts.where(frequent).select("pair")), "pair", "left_anti").join(counts.where(~frequent), "pair").groupBy("row").agg(*sums)
    own = ["doc_id", "n_a", "n_b", "n_groups", "groups_sha256"]
    parts = aligned.select("row", *own).unionByName(known, allowMissingColumns=True).unionByName(rare, allowMissingColumns=True)
    merged = parts.groupBy("row").agg(*(F.max(c).alias(c) for c in own), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_best", "count_sum")))
    return merged.select("doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "n_best", "count_sum", "groups_sha256")
