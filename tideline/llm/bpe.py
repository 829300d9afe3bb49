"""Byte-level BPE by dynamic programming over prefixes, without replaying merges.

Every prefix of a word has one encoding, and of it only the last token is stored.
The automaton finds all tokens that end at a place; the one that is compatible
with the last token of the prefix before it is the prefix's own last token.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import released, sliced, utf8_column

# Fixed value: the pattern by which byte-level BPE cuts text into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

# Pieces of text, their words and pairs of tokens that a worker remembers; some 200 MB.
CACHE_PIECES = 450_000
CACHE_WORDS = 150_000
CACHE_PAIRS = 600_000
NEVER = 1 << 62


def byte_alphabet() -> dict[str, int]:
    """The visible characters that stand for bytes: printable ones for themselves, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Vocabulary:
    """Tokens as bytes by id, the merge that forms each, and special tokens; small and sent to every task."""

    def __init__(self, tokens: dict[int, bytes], merges: list[tuple[int, int, int]], special: dict[str, int]):
        self.tokens, self.merges, self.special = tokens, merges, special
        self.key = hashlib.sha256(repr((len(tokens), merges[:50], len(merges), sorted(special.items()))).encode()).hexdigest()

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as file:
            stored = json.load(file)
        to_byte, ids = byte_alphabet(), stored["model"]["vocab"]
        special = {t["content"]: t["id"] for t in stored["added_tokens"]}
        tokens = {i: bytes(to_byte[c] for c in s) for s, i in ids.items() if i not in special.values()}
        merges = []
        for merge in stored["model"]["merges"]:
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            merges.append((ids[left], ids[right], ids[left + right]))
        return cls(tokens | {i: s.encode() for s, i in special.items()}, merges, special)


class Encoder:
    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.rank_of_pair = {(a, b): r for r, (a, b, _) in enumerate(vocabulary.merges)}
        self.formed = {token: (rank, a, b) for rank, (a, b, token) in enumerate(vocabulary.merges)}
        self.lengths = {i: len(t) for i, t in vocabulary.tokens.items()}
        self.automaton = ahocorasick.Automaton()
        for i, token in vocabulary.tokens.items():
            if i not in vocabulary.special.values():
                self.automaton.add_word(token.decode("latin-1"), (i, len(token)))
        self.automaton.make_automaton()
        self.pattern = regex.compile(WORDS)
        self.fits = _Known(lambda pair: self.compatible(pair >> 32, pair & 0xFFFFFFFF), CACHE_PAIRS)
        self.packed = _Known(self.encode_word_text, CACHE_WORDS)
        self.after_space = _Known(lambda chunk: b"".join(map(self.packed.__getitem__, self.pattern.findall(" " + chunk))), CACHE_PIECES)
        self.space_run = regex.compile(r"\s \s|  ")
        size = max(vocabulary.tokens) + 1
        self.by_id = [vocabulary.tokens.get(i, b"") for i in range(size)]
        self.special = (
            regex.compile("(" + "|".join(regex.escape(s) for s in sorted(vocabulary.special, key=len, reverse=True)) + ")") if vocabulary.special else None
        )

    def compatible(self, left: int, right: int) -> bool:
        """Whether two tokens, side by side, are what merging their joint bytes leaves.

        Goes back in time: of the two tokens at the boundary the one formed later is
        split. Where both stood side by side their own merge must not have come up
        before either was used in its further merge; of equal merges the left one comes first.
        """
        left_used = right_used = NEVER
        while True:
            joint = self.rank_of_pair.get((left, right))
            if joint is not None and joint < left_used and joint <= right_used:
                return False
            made_left, made_right = self.formed.get(left), self.formed.get(right)
            if made_left is None and made_right is None:
                return True
            if made_right is None or (made_left is not None and made_left[0] > made_right[0]):
                left, left_used = made_left[2], made_left[0]
            else:
                right, right_used = made_right[1], made_right[0]

    def encode_word(self, word: bytes) -> list[int]:
        """Forward over prefixes, then back along the stored last tokens.

        The automaton reports the tokens ending at a place from the longest down.
        """
        last, sizes, fits = [-1] * (len(word) + 1), self.lengths, self.fits
        for end, (token, size) in self.automaton.iter(word.decode("latin-1")):
            if last[end + 1] < 0:
                start = end + 1 - size
                if start == 0 or ((before := last[start]) >= 0 and fits[before << 32 | token]):
                    last[end + 1] = token
        ids, at = [], len(word)
        while at:
            ids.append(last[at])
            at -= sizes[last[at]]
        return ids[::-1]

    def encode_word_text(self, word: str) -> bytes:
        return np.asarray(self.encode_word(word.encode("utf-8", "surrogatepass")), "<u4").tobytes()

    def encode_plain(self, text: str) -> bytes:
        """Without special tokens. A single space only ever joins the word after it, so
        pieces between single spaces are encoded apart; runs of white space need the whole pattern."""
        if self.space_run.search(text):
            return b"".join(map(self.packed.__getitem__, self.pattern.findall(text)))
        first, *rest = text.split(" ")
        return b"".join([*map(self.packed.__getitem__, self.pattern.findall(first)), *map(self.after_space.__getitem__, rest)])

    def encode(self, text: str) -> bytes:
        """Ids of the whole text, packed as little-endian unsigned 32-bit numbers."""
        if self.special is None or not any(s in text for s in self.vocabulary.special):
            return self.encode_plain(text)
        parts = []
        for piece in self.special.split(text):
            special = self.vocabulary.special.get(piece)
            parts.append(self.encode_plain(piece) if special is None else special.to_bytes(4, "little"))
        return b"".join(parts)

    def decode(self, packed: bytes) -> str:
        return b"".join(map(self.by_id.__getitem__, np.frombuffer(packed, "<u4").tolist())).decode("utf-8", "replace")


class _Known(dict):
    """Answers found so far; emptied when full, so memory is bounded. Long pieces are answered anew."""

    def __init__(self, answer, most: int):
        super().__init__()
        self.answer, self.most = answer, most

    def __missing__(self, asked):
        found = self.answer(asked)
        if not isinstance(asked, str) or len(asked) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[asked] = found
        return found


_ENCODERS: dict[str, Encoder] = {}


def encoder_for(vocabulary: Vocabulary) -> Encoder:
    """One per worker process and vocabulary."""
    if vocabulary.key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[vocabulary.key] = Encoder(vocabulary)
    return _ENCODERS[vocabulary.key]


def encode_documents(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, ids (packed, little-endian unsigned 32-bit), text (decoded from the ids).

    Runs where the rows are read, without an exchange. A null text is the empty
    text and has no ids; a null id stays null; repeated rows are encoded each.
    """
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(sent.value)
        for batch in sliced(batches):
            ids = [encoder.encode(t.decode("utf-8", "replace")) for t in utf8_column(batch.column(1))]
            decoded = [encoder.decode(i) for i in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.array(decoded, pa.string())], names=["doc_id", "ids", "text"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(released(encode), "doc_id long, ids binary, text string")


def token_digests(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of what ``encode_documents`` gives.

    Digests are taken where texts are encoded, one text after the other, so a task
    never holds the ids or decoded texts of more than one document.
    """
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(sent.value)
        for batch in sliced(batches):
            sizes, of_ids, of_texts = [], [], []
            for text in utf8_column(batch.column(1)):
                ids = encoder.encode(text.decode("utf-8", "replace"))
                sizes.append(len(ids) // 4)
                of_ids.append(hashlib.sha256(ids).hexdigest())
                of_texts.append(hashlib.sha256(encoder.decode(ids).encode()).hexdigest())
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(released(digest), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
