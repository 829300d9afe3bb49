"""License scans: exact phrases, and short notices with a bounded number of edits.

A notice with at most k edits, cut into k + 1 pieces, leaves one piece unedited.
Pieces are searched exactly, all at once; around each hit the regex library
verifies the whole notice under the bound and reports where it stands.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import released, sliced, utf8_column

# Letters and digits of ASCII, A-Z lower-cased, and all other characters are parts of words; the rest is space.
WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)

# The phrases of the contract with their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# Notices searched with edits, in words.
NOTICES = {
    "released under the mit license": "mit",
    "licensed under the mit license": "mit",
    "licensed under the apache license version 2 0": "apache-2",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "licensed under the gnu general public license version 3": "gpl-3",
    "licensed under the gnu general public license version 2": "gpl-2",
    "subject to the terms of the mozilla public license": "mpl",
    "redistribution and use in source and binary forms": "bsd",
    "this work is licensed under a creative commons attribution": "cc-by",
}
CHARS_PER_EDIT = 10


@dataclass
class Notice:
    text: bytes
    label: str
    edits: int
    pieces: list[tuple[int, bytes]] = field(default_factory=list)

    @classmethod
    def of(cls, text: str, label: str, chars_per_edit: int) -> Notice:
        raw = f" {text} ".encode()
        edits = len(raw) // chars_per_edit
        cuts = [len(raw) * i // (edits + 1) for i in range(edits + 2)]
        return cls(raw, label, edits, [(a, raw[a:b]) for a, b in zip(cuts, cuts[1:])])


def spaces_of(text: bytes) -> np.ndarray:
    """Where the spaces are; how many stand before a place is then found by bisection."""
    return np.flatnonzero(np.frombuffer(text, np.uint8) == 0x20)


class Scanner:
    def __init__(self, phrases: dict[str, str], notices: dict[str, str], chars_per_edit: int):
        self.phrases = [(f" {text} ".encode(), label) for text, label in phrases.items()]
        self.notices = [Notice.of(text, label, chars_per_edit) for text, label in notices.items()]
        self.patterns = [regex.compile(b"(?be)(?:" + regex.escape(n.text) + b"){e<=%d}" % n.edits) for n in self.notices]
        owners: dict[bytes, list[tuple[int, int]]] = {}
        for at, notice in enumerate(self.notices):
            for offset, piece in notice.pieces:
                owners.setdefault(piece, []).append((at, offset))
        self.seeds = ahocorasick.Automaton()
        for piece, places in owners.items():
            self.seeds.add_word(piece.decode("latin-1"), (len(piece), places))
        self.seeds.make_automaton()

    def exact(self, text: bytes) -> list[tuple[str, int]]:
        """Label and first word of every place of every phrase; ``text`` has one space around each word."""
        found = []
        for phrase, label in self.phrases:
            at = text.find(phrase)
            while at >= 0:
                found.append((label, at))
                at = text.find(phrase, at + 1)
        spaces = spaces_of(text) if found else None
        return [(label, int(np.searchsorted(spaces, at))) for label, at in found]

    def fuzzy(self, text: bytes) -> list[tuple[str, int, int, int, float]]:
        """Label, first and last word, edits and similarity of every verified notice."""
        windows: set[tuple[int, int]] = set()
        for end, (size, places) in self.seeds.iter(text.decode("latin-1")):
            for notice, offset in places:
                windows.add((notice, end + 1 - size - offset - self.notices[notice].edits))
        if not windows:
            return []
        found, spaces = {}, spaces_of(text)
        for notice, start in sorted(windows):
            n = self.notices[notice]
            # A window of its own for each hit: the best match of a wider one would hide others left of it.
            for at, matched, edits in self._verified(notice, text, max(0, start), min(len(text), start + len(n.text) + 2 * n.edits)):
                inner = matched.strip(b" ")
                if not inner:
                    continue
                first = int(np.searchsorted(spaces, at + matched.find(inner))) - 1
                last = first + inner.count(b" ")
                held = found.get((n.label, first))
                if held is None or edits < held[3]:
                    found[n.label, first] = (n.label, first, last, edits, 1 - edits / len(n.text))
        # Wordings that differ in a word or two match in each other's places, and a window that ends inside
        # a notice has a part of it; there the closest one stands.
        closest: list[tuple[str, int, int, int, float]] = []
        starts: list[int] = []
        for one in sorted(found.values(), key=lambda f: (-f[4], f[1], f[0])):
            # Those that stand are disjoint and in order, so only the neighbours can overlap.
            at = bisect_left(starts, one[1])
            if (at == 0 or closest[at - 1][2] < one[1]) and (at == len(starts) or starts[at] > one[2]):
                starts.insert(at, one[1])
                closest.insert(at, one)
        return closest

    def _verified(self, notice: int, text: bytes, start: int, stop: int) -> Iterator[tuple[int, bytes, int]]:
        """Place, bytes and edits of the best match in a window, and of those left and right of it."""
        n = self.notices[notice]
        if stop - start < len(n.text) - n.edits:
            return
        match = self.patterns[notice].search(text, start, stop)
        if match is None or not match.group():
            return
        yield match.start(), match.group(), sum(match.fuzzy_counts)
        # Neighbours share the space between them.
        yield from self._verified(notice, text, start, min(match.start() + 1, stop - 1))
        yield from self._verified(notice, text, max(match.end() - 1, start + 1), stop)


SCHEMA = (
    "doc_id long, n_words long, places array<struct<label: string, word: long>>, "
    "notices array<struct<label: string, first_word: long, last_word: long, edits: long, similarity: double>>"
)
_PLACES = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())]))
_NOTICES = pa.list_(
    pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("edits", pa.int64()), ("similarity", pa.float64())])
)


def scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    phrases: dict[str, str] = PHRASES,
    notices: dict[str, str] = NOTICES,
    chars_per_edit: int = CHARS_PER_EDIT,
) -> DataFrame:
    """Per document: doc_id, n_words, places (exact phrases) and notices (with edits, by word numbers from 0).

    Whole texts are read in place, without an exchange. A null or empty text has
    no words; repeated rows are scanned each; a notice found at one word by
    several wordings of a label is reported once, with the fewest edits; where
    notices overlap, the most similar one is reported.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(phrases, notices, chars_per_edit)
        for batch in sliced(batches):
            counts, places, found = [], [], []
            for raw in utf8_column(batch.column(1)):
                words = raw.translate(WORD_BYTES).split(b" ")
                words = list(filter(None, words))
                text = b" " + b" ".join(words) + b" "
                counts.append(len(words))
                places.append([{"label": x, "word": w} for x, w in scanner.exact(text)])
                found.append([dict(zip(("label", "first_word", "last_word", "edits", "similarity"), f)) for f in scanner.fuzzy(text)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(places, _PLACES), pa.array(found, _NOTICES)],
                names=["doc_id", "n_words", "places", "notices"],
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(released(find), SCHEMA)


def license_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **lists) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (the best similarity; 1 for a phrase)."""
    found = scan(docs, id_col, text_col, **lists)
    base, method = F.col("places.label"), F.col("notices.label")
    similar = F.coalesce(F.array_max("notices.similarity"), F.lit(0.0))
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places.word").alias("first_word"),
        F.array_max("places.word").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, method)), ",").alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(similar).alias("score"),
    )
