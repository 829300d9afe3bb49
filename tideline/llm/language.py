"""Language identification by a bidirectional gated recurrent network over bytes.

Every byte is read by two recurrences, one from each side; at every position
their states give a distribution over languages, and a document's probabilities
are pooled over all its positions. The network is trained here, in numpy, by
backpropagation through time over windows of labelled texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.llm.common import fresh, released, sliced, training_rows, utf8_column

UNKNOWN = "und"
HIDDEN = 8
# A recurrence starts anew at every window, so that all windows of many texts advance side by side.
WINDOW = 256
LANES = 2048
# The labelled sample that training sees: at most so many texts of a language, and so many excerpts of each.
TEXTS_PER_LANGUAGE = 400
EXCERPTS_PER_TEXT = 4
EXCERPT_BYTES = 96
STEPS = 260
BATCH = 128
LEARNING_RATE = 0.02
HAS_LETTER = re.compile(r"[^\W\d_]")


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-x))


@dataclass
class Direction:
    """One recurrence: per byte the inputs of update, reset and candidate; their recurrent weights."""

    table: np.ndarray  # 256, 3 * hidden (the biases are in it)
    gates: np.ndarray  # 2 * hidden, hidden
    candidate: np.ndarray  # hidden, hidden

    def step(self, byte: np.ndarray, h: np.ndarray):
        """States are (hidden, lanes)."""
        n = self.candidate.shape[0]
        x = self.table_t.take(byte, axis=1)
        zr = self.gates @ h
        zr += x[: 2 * n]
        np.negative(zr, out=zr)
        np.exp(zr, out=zr)
        zr += 1.0
        np.reciprocal(zr, out=zr)
        c = self.candidate @ (zr[n:] * h)
        c += x[2 * n :]
        np.tanh(c, out=c)
        return zr, c

    def prepare(self) -> None:
        self.table_t = np.ascontiguousarray(self.table.T)


@dataclass
class Network:
    languages: list[str]
    forward: Direction
    backward: Direction
    out: np.ndarray  # languages, 2 * hidden
    bias: np.ndarray  # languages, 1

    @classmethod
    def fresh(cls, languages: list[str], hidden: int = HIDDEN, seed: int = 7) -> Network:
        rng = np.random.default_rng(seed)

        def weights(*shape: int) -> np.ndarray:
            return rng.normal(0, 0.3, shape).astype(np.float32)

        sides = [Direction(weights(256, 3 * hidden), weights(2 * hidden, hidden), weights(hidden, hidden)) for _ in range(2)]
        return cls(languages, *sides, weights(len(languages), 2 * hidden), np.zeros((len(languages), 1), np.float32))

    def parameters(self) -> list[np.ndarray]:
        return [*(w for d in (self.forward, self.backward) for w in (d.table, d.gates, d.candidate)), self.out, self.bias]

    def gradients(self, windows: np.ndarray, labels: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross entropy over all positions of full windows (lanes, time), and its gradients through time."""
        lanes, times = windows.shape
        hidden = self.forward.candidate.shape[0]
        kept = []
        for side, order in ((self.forward, range(times)), (self.backward, range(times - 1, -1, -1))):
            side.prepare()
            h = np.zeros((hidden, lanes), np.float32)
            states = {}
            for t in order:
                zr, c = side.step(windows[:, t], h)
                before, h = h, (1 - zr[:hidden]) * h + zr[:hidden] * c
                states[t] = (before, zr, c, h)
            kept.append(states)
        wanted = np.zeros((len(self.languages), lanes), np.float32)
        wanted[labels, np.arange(lanes)] = 1
        grads = [np.zeros_like(p) for p in self.parameters()]
        loss, flow = 0.0, {}
        for t in range(times):
            h = np.concatenate([kept[0][t][3], kept[1][t][3]])
            logits = self.out @ h + self.bias
            logits -= logits.max(axis=0)
            p = np.exp(logits)
            p /= p.sum(axis=0)
            loss -= float(np.log(np.maximum((p * wanted).sum(axis=0), 1e-12)).mean())
            error = (p - wanted) / (lanes * times)
            grads[6] += error @ h.T
            grads[7] += error.sum(axis=1, keepdims=True)
            flow[t] = self.out.T @ error
        for k, (side, order) in enumerate(((self.forward, range(times - 1, -1, -1)), (self.backward, range(times)))):
            carried = np.zeros((hidden, lanes), np.float32)
            table, gates, candidate = grads[3 * k : 3 * k + 3]
            for t in order:
                before, zr, c, _ = kept[k][t]
                z, r = zr[:hidden], zr[hidden:]
                dh = carried + flow[t][k * hidden : (k + 1) * hidden]
                dc = dh * z * (1 - c * c)
                dz = dh * (c - before) * z * (1 - z)
                drh = side.candidate.T @ dc
                dr = drh * before * r * (1 - r)
                dzr = np.concatenate([dz, dr])
                gates += dzr @ before.T
                candidate += dc @ (r * before).T
                np.add.at(table, windows[:, t], np.concatenate([dzr, dc]).T)
                carried = dh * (1 - z) + drh * r + side.gates.T @ dzr
        return loss / times, grads

    def position_probabilities(self, windows: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Windows (time, lanes), bytes at the front: per lane the sum over its positions of
        log probabilities (languages, lanes), and per position the likeliest language (time, lanes)."""
        times, lanes = windows.shape
        hidden = self.forward.candidate.shape[0]
        self.forward.prepare()
        self.backward.prepare()
        scores = np.empty((times, len(self.languages), lanes), np.float32)
        h = np.zeros((hidden, lanes), np.float32)
        for t in range(times):
            zr, c = self.forward.step(windows[t], h)
            c -= h
            c *= zr[:hidden]
            h += c
            np.matmul(self.out[:, :hidden], h, out=scores[t])
        h = np.zeros((hidden, lanes), np.float32)
        total = np.zeros((len(self.languages), lanes), np.float32)
        label = np.empty((times, lanes), np.uint8)
        for t in range(times - 1, -1, -1):
            zr, c = self.backward.step(windows[t], h)
            c -= h
            c *= zr[:hidden]
            c *= valid[t]  # the state stays zero until the window's last byte
            h += c
            s = scores[t]
            s += self.out[:, hidden:] @ h
            s += self.bias
            label[t] = s.argmax(axis=0)
            s -= s.max(axis=0)
            s -= np.log(np.exp(s).sum(axis=0))
            s *= valid[t]
            total += s
        return total, label


def train(texts: list[bytes], labels: list[str], steps: int = STEPS, hidden: int = HIDDEN, seed: int = 7) -> Network:
    """By Adam over random windows, every language equally often; ``texts`` of at least one byte."""
    languages = sorted(set(labels))
    network, rng = Network.fresh(languages, hidden, seed), np.random.default_rng(seed)
    by_language = [[np.frombuffer(t, np.uint8) for t, x in zip(texts, labels) if x == language] for language in languages]
    first = [np.zeros_like(p) for p in network.parameters()]
    second = [np.zeros_like(p) for p in network.parameters()]
    for step in range(1, steps + 1):
        times = min(EXCERPT_BYTES, 16 + step // 3)
        chosen = rng.integers(0, len(languages), BATCH)
        windows = np.full((BATCH, times), 32, np.uint8)
        for lane, language in enumerate(chosen):
            text = by_language[language][rng.integers(0, len(by_language[language]))]
            start = rng.integers(0, max(1, len(text) - times + 1))
            piece = text[start : start + times]
            windows[lane, : len(piece)] = piece
        _, grads = network.gradients(windows, chosen)
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        rate = LEARNING_RATE * min(1.0, 2 * (1 - step / (steps + 1)))
        for p, g, m, v in zip(network.parameters(), grads, first, second):
            g *= min(1.0, 1.0 / (norm + 1e-12))
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return network


def classify(network: Network, texts: list[bytes], window: int = WINDOW, lanes: int = LANES) -> np.ndarray:
    """Per text the probabilities of the languages (languages, texts), pooled over every byte.

    Positions agree with their neighbours, so the mean of log probabilities is
    what is pooled: the product of all positions, brought back to one position's strength.
    """
    sums = np.zeros((len(network.languages), len(texts)), np.float64)
    sizes = np.array([len(t) for t in texts], np.int64)
    pieces = [(k, at) for k, t in enumerate(texts) for at in range(0, len(t), window)]
    # Windows of like length go together, so that short ones don't wait for long ones.
    pieces.sort(key=lambda p: min(window, sizes[p[0]] - p[1]))
    for first in range(0, len(pieces), lanes):
        group = pieces[first : first + lanes]
        lengths = np.array([min(window, sizes[k] - at) for k, at in group])
        block = np.zeros((len(group), int(lengths.max())), np.uint8)
        for lane, (k, at) in enumerate(group):
            block[lane, : lengths[lane]] = np.frombuffer(texts[k], np.uint8, lengths[lane], at)
        valid = (np.arange(block.shape[1])[:, None] < lengths[None, :]).astype(np.float32)
        total, _ = network.position_probabilities(np.ascontiguousarray(block.T), valid)
        np.add.at(sums.T, [k for k, _ in group], total.T.astype(np.float64))
    mean = sums / np.maximum(sizes, 1)
    p = np.exp(mean - mean.max(axis=0))
    return p / p.sum(axis=0)


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", parts: int = 4, held_out: int = 2) -> Network | None:
    """Trains on a bounded sample of labelled rows: per language at most TEXTS_PER_LANGUAGE texts, those
    first by hashed id, of each up to EXCERPTS_PER_TEXT excerpts spread over the whole text. None without any."""
    labelled = docs.where(training_rows(id_col, parts, held_out) & F.col(lang_col).isNotNull() & (F.length(text_col) > 0)).select(
        F.col(lang_col).cast("string").alias("lang"), F.xxhash64(F.col(id_col).cast("long"), F.lit(1)).alias("draw"), F.col(text_col).alias("text")
    )
    sizes = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    length = F.length("text")
    starts = [F.floor(length * i / EXCERPTS_PER_TEXT).cast("int") + 1 for i in range(EXCERPTS_PER_TEXT)]
    excerpts = F.array(*[F.substring(F.col("text"), start, F.lit(EXCERPT_BYTES)) for start in starts])
    if not sizes:
        return None
    # Of large languages a few times as many rows as are wanted are drawn by the hash first, so that no task orders or sends many;
    # all languages in one pass.
    shares = [(language, int(min(1.0, 4 * TEXTS_PER_LANGUAGE / size) * (1 << 30))) for language, size in sizes.items()]
    drawn = labelled.join(F.broadcast(docs.sparkSession.createDataFrame(shares, "lang string, share long")), "lang")
    small = drawn.where(F.pmod("draw", F.lit(1 << 30)) < F.col("share")).select("lang", "draw", excerpts.alias("excerpts"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "excerpts"))
    rows = small.withColumn("place", place).where(F.col("place") <= TEXTS_PER_LANGUAGE).select("lang", "place", "excerpts").collect()
    texts, labels = [], []
    for r in sorted(rows, key=lambda r: (r["lang"], r["place"])):
        for excerpt in r["excerpts"]:
            if excerpt:
                texts.append(excerpt.encode("utf-8", "replace"))
                labels.append(r["lang"])
    return train(texts, labels) if texts else None


def identify(docs: DataFrame, network: Network | None, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, answer: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Per document: doc_id, lang_pred, score (the probability of lang_pred; 0 for ``und``).

    With ``keep``, those columns of the documents come first instead of doc_id; ``answer`` names the other two.

    Reads whole texts in place, without an exchange. A null or empty text, or one
    without a letter, is ``und``; so is every text if nothing could be learned.
    Equal texts get equal answers; repeated rows are answered each.
    """
    sent = docs.sparkSession.sparkContext.broadcast(network)
    kept = docs.select(*keep) if keep else docs.select(F.col(id_col).cast("long").alias("doc_id"))
    schema = T.StructType([*kept.schema.fields, T.StructField(answer[0], T.StringType()), T.StructField(answer[1], T.DoubleType())])
    # The text comes last under a name that no other column has; columns are taken by place.
    text = docs[text_col].cast("string").alias(fresh("text", docs.columns))
    # A text that is kept anyway is sent once.
    kept_at = keep.index(text_col) if keep and text_col in keep and docs.schema[text_col].dataType == T.StringType() else None
    read = docs.select(*(keep or [docs[id_col].cast("long").alias("doc_id")]), *([] if kept_at is not None else [text]))
    text_at, n_kept = (len(kept.columns) if kept_at is None else kept_at), len(kept.columns)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in sliced(batches):
            raw = utf8_column(batch.column(text_at))
            at = 0
            while at < len(raw) or at == 0:
                end, size = at, 0
                while end < len(raw) and size < LANES * WINDOW * 2:
                    size += len(raw[end])
                    end += 1
                texts = raw[at:end]
                names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
                asked = [k for k, t in enumerate(texts) if model is not None and HAS_LETTER.search(t.decode("utf-8", "replace"))]
                if asked:
                    p = classify(model, [texts[k] for k in asked])
                    best = p.argmax(axis=0)
                    for column, k in enumerate(asked):
                        names[k], scores[k] = model.languages[best[column]], float(p[best[column], column])
                columns = [batch.column(i).slice(at, end - at) for i in range(n_kept)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=schema.names)
                at = max(end, 1)

    return read.mapInArrow(released(predict), schema)
