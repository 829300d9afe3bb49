"""Language-model scores by a subword lattice.

A word is read as a space and its bytes. Every way to cut it into pieces of an
existing vocabulary counts, weighted by the product of the pieces' probabilities;
the forward recursion in log space sums them all. A word that training rows have
is one more piece, spanning the word, with its share of their tokens. Pieces never
span words, so a document's marginal probability is the product over its words
and the end mark.

The vocabulary's own scores weight the pieces at first; expected counts over the
lattices of all different training words then refit them.
"""

from __future__ import annotations

import math
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import released, training_rows, utf8_column, words_of, written

# Words above this many bytes (links, junk) are summed one by one, others side by side.
LONG_WORD = 48
LANES = 20_000
ROUNDS = 2
# A word with at least this share of all tokens is frequent; there can't be more than its inverse of them.
FREQUENT_SHARE = 1 / (1 << 18)
COUNTER_WORDS = 300_000
BLOCK_DOCS = 4096
BLOCK_WORDS = 300_000
# Expected counts are summed in whole units of this size, so that their order can't change the sum.
UNIT = 1 << 20
PIECE_PRIOR = 0.1
BASE = np.uint64(0x9E3779B97F4A7C15)
END = b""


@dataclass
class Pieces:
    """Pieces as bytes with natural log probabilities; the last one is the end mark."""

    surfaces: list[bytes]
    log_p: np.ndarray
    end_log_p: float

    @classmethod
    def load(cls, path: str) -> Pieces:
        """From a sentencepiece vocabulary. Where scores are ranks, the piece of rank r weighs 1 / (r + 10);
        single bytes get what is left for what the vocabulary lacks."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        weights: dict[bytes, float] = {}
        for i in range(model.get_piece_size()):
            if model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                continue
            score = model.get_score(i)
            if model.is_byte(i):
                surface, weight = bytes([int(model.id_to_piece(i)[3:5], 16)]), 1e-7
            else:
                surface = model.id_to_piece(i).replace("▁", " ").encode()
                weight = 1.0 / (10.0 - score)
            if b" " not in surface[1:]:
                weights[surface] = weights.get(surface, 0.0) + weight
        surfaces = sorted(weights)
        total = sum(weights.values())
        p = np.array([weights[s] for s in surfaces]) / total
        return cls(surfaces, np.log(p * 0.999), math.log(0.001))

    def spelling_shift(self) -> float:
        """What turns a lattice's sum into the probability of a word, given that a word is spelled: its first
        piece is one that starts words, and after its last piece comes a new start or the end."""
        starts = sum(math.exp(p) for s, p in zip(self.surfaces, self.log_p) if s[:1] == b" ")
        end = math.exp(self.end_log_p)
        return math.log1p(-end) + math.log(starts + end) - math.log(starts)

    def fitted(self, counts: dict[int, int], ends: int) -> Pieces:
        expected = np.full(len(self.surfaces), PIECE_PRIOR)
        for piece, units in counts.items():
            expected[piece] += units / UNIT
        total = expected.sum() + ends + PIECE_PRIOR
        return Pieces(self.surfaces, np.log(expected / total), math.log((ends + PIECE_PRIOR) / total))


def _powers(n: int) -> np.ndarray:
    powers = np.ones(n + 1, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            powers[i + 1] = powers[i] * BASE
    return powers


class Lattice:
    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.by_surface = {s: i for i, s in enumerate(pieces.surfaces)}
        self.sizes = sorted({len(s) for s in pieces.surfaces})
        self.powers = _powers(max(LONG_WORD + 1, self.sizes[-1]))
        self.tables = {}
        for size in self.sizes:
            own = [i for i, s in enumerate(pieces.surfaces) if len(s) == size]
            hashes = self.prefix_hashes(np.frombuffer(b"".join(pieces.surfaces[i] for i in own), np.uint8).reshape(len(own), size))[:, size]
            order = np.argsort(hashes)
            self.tables[size] = (hashes[order], np.array(own)[order])

    def prefix_hashes(self, block: np.ndarray) -> np.ndarray:
        out = np.zeros((block.shape[0], block.shape[1] + 1), np.uint64)
        with np.errstate(over="ignore"):
            for i in range(block.shape[1]):
                out[:, i + 1] = out[:, i] * BASE + block[:, i].astype(np.uint64) + np.uint64(1)
        return out

    def _block(self, words: list[bytes]) -> np.ndarray:
        """Words of one size, a space before each."""
        size = len(words[0])
        block = np.full((len(words), size + 1), 32, np.uint8)
        block[:, 1:] = np.frombuffer(b"".join(words), np.uint8).reshape(len(words), size)
        return block

    def arcs(self, block: np.ndarray):
        """By end: (rows, start, end, piece) of every piece in every word."""
        prefix, length = self.prefix_hashes(block), block.shape[1]
        for end in range(1, length + 1):
            for size in self.sizes:
                if size > end:
                    break
                with np.errstate(over="ignore"):
                    asked = prefix[:, end] - prefix[:, end - size] * self.powers[size]
                hashes, ids = self.tables[size]
                at = np.minimum(np.searchsorted(hashes, asked), len(hashes) - 1)
                rows = np.flatnonzero(hashes[at] == asked)
                if len(rows):
                    yield rows, end - size, end, ids[at[rows]]

    def forward(self, words: list[bytes], keep: list | None = None) -> np.ndarray:
        block = self._block(words)
        alpha = np.full((block.shape[1] + 1, len(words)), -np.inf)
        alpha[0] = 0.0
        for rows, start, end, ids in self.arcs(block):
            alpha[end, rows] = np.logaddexp(alpha[end, rows], alpha[start, rows] + self.pieces.log_p[ids])
            if keep is not None:
                keep.append((rows, start, end, ids))
        return alpha

    def forward_long(self, word: bytes) -> list[float]:
        text, log_p = b" " + word, self.pieces.log_p
        alpha = [0.0] + [-math.inf] * len(text)
        for end in range(1, len(text) + 1):
            terms = [
                alpha[end - size] + log_p[i] for size in self.sizes if size <= end and (i := self.by_surface.get(text[end - size : end])) is not None
            ]
            most = max(terms)
            alpha[end] = most + math.log(sum(math.exp(t - most) for t in terms))
        return alpha

    def log_marginals(self, words: list[bytes]) -> np.ndarray:
        out = np.zeros(len(words))
        for indices in _by_size(words):
            if len(words[indices[0]]) > LONG_WORD:
                for i in indices:
                    out[i] = self.forward_long(words[i])[-1]
            else:
                out[indices] = self.forward([words[i] for i in indices])[-1]
        return out

    def expected(self, words: list[bytes], counts: np.ndarray) -> np.ndarray:
        """Per piece its expected count over all segmentations of all words, in whole units."""
        units = np.zeros(len(self.pieces.surfaces), np.int64)
        for indices in _by_size(words):
            if len(words[indices[0]]) > LONG_WORD:
                for i in indices:
                    self._expected_long(words[i], int(counts[i]), units)
                continue
            arcs: list = []
            alpha = self.forward([words[i] for i in indices], arcs)
            all_ids, all_units = [np.zeros(0, np.int64)], [np.zeros(0)]
            beta = np.full_like(alpha, -np.inf)
            beta[-1] = 0.0
            for rows, start, end, ids in reversed(sorted(arcs, key=lambda a: a[2])):
                log_p = self.pieces.log_p[ids]
                share = np.exp(alpha[start, rows] + log_p + beta[end, rows] - alpha[-1, rows])
                all_ids.append(ids)
                all_units.append(np.rint(share * counts[indices[rows]] * UNIT))
                beta[start, rows] = np.logaddexp(beta[start, rows], beta[end, rows] + log_p)
            # Whole numbers below 2^53 add up exactly in any order.
            units += np.bincount(np.concatenate(all_ids), np.concatenate(all_units), len(units)).astype(np.int64)
        return units

    def _expected_long(self, word: bytes, count: int, units: np.ndarray) -> None:
        text, log_p, alpha = b" " + word, self.pieces.log_p, self.forward_long(word)
        beta = [-math.inf] * len(text) + [0.0]
        for end in range(len(text), 0, -1):
            for size in self.sizes:
                if size <= end and (i := self.by_surface.get(text[end - size : end])) is not None:
                    through = beta[end] + log_p[i]
                    units[i] += round(math.exp(alpha[end - size] + through - alpha[-1]) * count * UNIT)
                    held = beta[end - size]
                    beta[end - size] = max(held, through) + math.log1p(math.exp(-abs(held - through))) if held > -math.inf else through


def _by_size(words: list[bytes]) -> Iterator[np.ndarray]:
    sizes = np.array([len(w) for w in words])
    order = np.argsort(sizes, kind="stable")
    cuts = np.flatnonzero(np.diff(sizes[order])) + 1
    for group in np.split(order, cuts):
        for at in range(0, len(group), LANES):
            if len(group):
                yield group[at : at + LANES]


def _gathered(batches: Iterator[pa.RecordBatch], rows: int = 8 * LANES) -> Iterator[pa.RecordBatch]:
    """Larger batches, so that many words of one size stand side by side."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) >= rows:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def count_words(docs: DataFrame) -> DataFrame:
    """Every word of all documents with its count in training rows (0: in others only); the empty word counts ends.

    ``docs`` has text and trains. Words are counted where they are read and only partial counts are exchanged.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text, trains in zip(utf8_column(batch.column(0)), batch.column(1).to_pylist()):
                words = words_of(text)
                if trains:
                    seen.update(words)
                    seen[END] += 1
                else:
                    for word in words:
                        seen.setdefault(word, 0)
                if len(seen) >= COUNTER_WORDS:
                    yield from _count_batches(seen)
                    seen.clear()
        yield from _count_batches(seen)

    partial = docs.select("text", "trains").mapInArrow(released(count), "word binary, c long")
    return partial.groupBy("word").agg(F.sum("c").alias("c"))


def _count_batches(seen: Counter) -> Iterator[pa.RecordBatch]:
    words = list(seen)
    for at in range(0, len(words), 50_000):
        part = words[at : at + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()), pa.array([seen[w] for w in part], pa.int64())], names=["word", "c"])


def fit(words: DataFrame, pieces: Pieces, ends: int, rounds: int = ROUNDS) -> Pieces:
    """Refits the pieces' probabilities: expected counts over all training words, added up per piece.

    Each different word counts once, as pieces are to spell words not seen before.
    What comes back is one number per piece of the vocabulary.
    """
    for _ in range(rounds):
        sent = words.sparkSession.sparkContext.broadcast(pieces)

        def expect(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            lattice, units = Lattice(sent.value), None
            for batch in _gathered(batches):
                words = batch.column(0).to_pylist()
                found = lattice.expected(words, np.ones(len(words), np.int64))
                units = found if units is None else units + found
            if units is not None:
                ids = np.flatnonzero(units)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(units[ids], pa.int64())], names=["piece", "units"])

        trained = words.where((F.col("c") > 0) & (F.octet_length("word") > 0)).select("word")
        counts = trained.mapInArrow(released(expect), "piece long, units long").groupBy("piece").agg(F.sum("units").alias("units"))
        pieces = pieces.fitted({r["piece"]: r["units"] for r in counts.collect()}, ends)
    return pieces


def score_words(words: DataFrame, pieces: Pieces, train_tokens: int, distinct: int) -> DataFrame:
    """word, c and log10 of the word's marginal probability; the end mark is the empty word.

    Tokens not seen before get the share that first occurrences have in training.
    """
    seen_share = train_tokens / (train_tokens + distinct) if train_tokens else 0.0
    sent = words.sparkSession.sparkContext.broadcast(pieces)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = sent.value
        lattice, shift = Lattice(pieces), pieces.spelling_shift() + math.log(1 - seen_share)
        for batch in _gathered(batches):
            words, counts = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            spelled = np.exp(lattice.log_marginals(words) + shift) if words else np.zeros(0)
            tiny = spelled < 1e-290
            known = seen_share * counts / max(1, train_tokens)
            lp = np.log10(np.where(tiny & (known == 0), 1.0, spelled + known))
            for i in np.flatnonzero(tiny & (known == 0)):
                lp[i] = (lattice.log_marginals([words[i]])[0] + shift) / math.log(10)
            for i, word in enumerate(words):
                if word == END:
                    lp[i] = end_score(pieces, seen_share, int(counts[i]), train_tokens)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lp)], names=["word", "c", "lp"])

    return words.select("word", "c").mapInArrow(released(score), "word binary, c long, lp double")


def end_score(pieces: Pieces, seen_share: float, ends: int, train_tokens: int) -> float:
    return math.log10(seen_share * ends / max(1, train_tokens) + (1 - seen_share) * math.exp(pieces.end_log_p))


# What a block's header keeps of each document beside its id.
HEADER = np.dtype([("doc_id", "<i8"), ("null_id", "?"), ("held_out", "?"), ("n_tokens", "<i8"), ("n_known", "<i8"), ("base", "<f8"), ("score", "<f8")])


def score_documents(docs: DataFrame, pieces: Pieces, id_col: str = "doc_id", text_col: str = "text", parts: int = 10, held_out: int = 0, rounds: int = ROUNDS) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10).

    Frequent words, of proven number, are looked up where documents are read. The
    rest leaves as postings: a block of documents gives one row per word with the
    places of its documents in the block. Postings meet the words' scores in a join
    on the word, return to their block and are added up. ``docs`` must be a stored
    table (its splits are read alike each time).

    Defined for odd input: a null or empty text is the end mark alone, a null id
    is the id text '' and stays null, repeated rows are scored and counted each,
    and an empty table gives no rows.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), training_rows(id_col, parts, held_out).alias("trains")
    )
    words = written(count_words(rows))
    total = words.agg(
        F.coalesce(F.sum("c"), F.lit(0)).alias("n"),
        F.coalesce(F.sum(F.when(F.col("c") > 0, 1)), F.lit(0)).alias("v"),
        F.coalesce(F.max(F.when(F.octet_length("word") == 0, F.col("c"))), F.lit(0)).alias("ends"),
    ).first()
    train_tokens, distinct, ends = total["n"], total["v"], total["ends"]
    fitted = fit(words, pieces, ends, rounds)
    base = F.log10((F.col("c") + 0.1) / F.lit(train_tokens + 0.1 * (distinct + 1)))
    scored = written(score_words(words, fitted, train_tokens, distinct).withColumn("base", base))
    # At most 1 / FREQUENT_SHARE words have that share of the training tokens.
    frequent = scored.where((F.col("c") > 0) & (F.col("c") >= max(1.0, train_tokens * FREQUENT_SHARE)) & (F.octet_length("word") > 0))
    known = {bytes(r["word"]): (r["base"], r["lp"]) for r in frequent.collect()}
    end_base = math.log10((ends + 0.1) / (train_tokens + 0.1 * (distinct + 1)))
    seen_share = train_tokens / (train_tokens + distinct) if train_tokens else 0.0
    sent = docs.sparkSession.sparkContext.broadcast((known, end_base, end_score(fitted, seen_share, ends, train_tokens), ends > 0))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, end_base, end_lp, end_known = sent.value
        place = {w: i for i, w in enumerate(known)}
        values = np.array([*known.values(), (0.0, 0.0)]).reshape(-1, 2)
        header: list[tuple] = []
        rest: defaultdict[bytes, list[int]] = defaultdict(list)
        # Numbers of this task's blocks; no other task of the one job that writes them has them.
        blocks = count(TaskContext.get().partitionId() << 32)
        for batch in batches:
            for doc_id, text, trains in zip(batch.column(0).to_pylist(), utf8_column(batch.column(1)), batch.column(2).to_pylist()):
                words = words_of(text)
                at = np.fromiter((place.get(w, -1) for w in words), np.int64, len(words))
                unknown = np.flatnonzero(at < 0)
                for i in unknown.tolist():
                    rest[words[i]].append(len(header))
                base, score = values[at].sum(axis=0) if len(words) else (0.0, 0.0)
                header.append((doc_id or 0, doc_id is None, not trains, len(words) + 1, len(words) - len(unknown) + end_known, base + end_base, score + end_lp))
                if len(header) >= BLOCK_DOCS or len(rest) >= BLOCK_WORDS:
                    yield from _block_batches(next(blocks), header, rest)
                    header, rest = [], defaultdict(list)
        if header:
            yield from _block_batches(next(blocks), header, rest)

    # Written once, so that headers and postings come from the same run.
    posted = written(rows.mapInArrow(released(post), "block long, word binary, places binary"))
    is_header = F.octet_length("word") == 0
    heads = posted.where(is_header).select("block", F.lit(0).alias("part"), "places", F.lit(0).cast("long").alias("c"), F.lit(0.0).alias("base"), F.lit(0.0).alias("lp"))
    tails = posted.where(~is_header).join(scored, "word").select("block", F.lit(1).alias("part"), "places", "c", "base", "lp")

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, own = None, None
        for batch in batches:
            blocks = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if blocks[a] != block:
                    if own is not None:
                        yield _scores(own, train_tokens)
                    block, own = blocks[a], None
                part = batch.slice(a, b - a)
                if part.column(1)[0].as_py() == 0:
                    # The header sorts first; every block has one.
                    own = np.frombuffer(part.column(2)[0].as_py(), HEADER).copy()
                    part = part.slice(1)
                    if not len(part):
                        continue
                packed = part.column(2).to_pylist()
                places = np.frombuffer(b"".join(packed), "<i4")
                sizes = np.array([len(p) // 4 for p in packed])
                n = len(own)
                for name, column in (("base", 4), ("score", 5)):
                    own[name] += np.bincount(places, np.repeat(part.column(column).to_numpy(), sizes), n)
                own["n_known"] += np.bincount(places, np.repeat((part.column(3).to_numpy() > 0).astype(float), sizes), n).astype(np.int64)
        if own is not None:
            yield _scores(own, train_tokens)

    together = heads.unionByName(tails).repartition("block").sortWithinPartitions("block", "part")
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return together.mapInArrow(released(add_up), schema)


def _block_batches(block: int, header: list[tuple], rest: dict[bytes, list[int]]) -> Iterator[pa.RecordBatch]:
    packed = np.array(header, HEADER).tobytes()
    words, places = [END, *rest], [packed, *(array("i", p).tobytes() for p in rest.values())]
    for at in range(0, len(words), 20_000):
        n = len(words[at : at + 20_000])
        yield pa.RecordBatch.from_arrays(
            [pa.array([block] * n, pa.int64()), pa.array(words[at : at + n], pa.binary()), pa.array(places[at : at + n], pa.binary())], names=["block", "word", "places"]
        )


def _scores(own: np.ndarray, train_tokens: int) -> pa.RecordBatch:
    n = len(own)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(own["doc_id"].copy(), pa.int64(), mask=own["null_id"].copy()),
            pa.array(own["held_out"].copy()),
            pa.array(own["n_tokens"].copy()),
            pa.array(own["n_known"].copy()),
            pa.array(np.full(n, train_tokens), pa.int64()),
            pa.array(own["base"].copy()),
            pa.array(own["score"].copy()),
        ],
        names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    )
