"""Cuts of two tokenizations against the plain intersection of their ends, and whole reports against brute force."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tideline.llm import alignment
from tideline.llm.bpe import byte_alphabet
from tideline.llm.queries import tokenizer_path

SMALL = "/root/testdata/sf0.001"
ZEROS = (0, 0, 0, 0, 0, 0, "")


@pytest.fixture(scope="module")
def tokenizers():
    return alignment.Tokenizers.load(tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sets(st.integers(1, 40)), st.sets(st.integers(1, 40))), max_size=4))
def test_cuts_are_the_common_ends(texts):
    """Several texts side by side, each with both sequences ending at 41."""
    a_ends, b_ends, bounds, want_a, want_b = [], [], [], [], []
    for i, (a, b) in enumerate(texts):
        bounds.append((len(a_ends), len(a_ends) + len(a) + 1, len(b_ends), len(b_ends) + len(b) + 1))
        a, b = sorted(a | {41}), sorted(b | {41})
        want_a += [len(a_ends) + a.index(e) + 1 for e in sorted(set(a) & set(b))]
        want_b += [len(b_ends) + b.index(e) + 1 for e in sorted(set(a) & set(b))]
        a_ends += [41 * i + e for e in a]
        b_ends += [41 * i + e for e in b]
    intervals = np.array(bounds, np.int64).reshape(-1, 4).T
    got = alignment.shared_cuts(np.array(a_ends, np.int64), np.array(b_ends, np.int64), *intervals)
    assert (got[0].tolist(), got[1].tolist()) == (want_a, want_b)


def test_long_stretch_without_cuts():
    """One common end far from the middle, among 200 000 tokens of either kind."""
    a = np.concatenate([[2], np.arange(5, 400_001, 2), [400_002]])
    b = np.concatenate([[2], np.arange(4, 400_001, 2), [400_002]])
    got = alignment.shared_cuts(a, b, np.array([0]), np.array([len(a)]), np.array([0]), np.array([len(b)]))
    assert got[0].tolist() == [1, len(a)] and got[1].tolist() == [1, len(b)]


def brute_force(texts):
    """Rows of the report without their ids, by the tokenizers' own libraries and sets of ends."""
    a_lib = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    a_lib.encode_special_tokens = True
    b_lib = sentencepiece.SentencePieceProcessor(model_file=str(public_tokenizers.path("piece_bpe_32k.model")))
    alphabet = byte_alphabet()
    found, counts = [], Counter()
    for text in texts:
        whole = (" " + (text or "")).encode()
        a = a_lib.encode(" " + (text or ""), add_special_tokens=False).ids
        b = b_lib.encode(text or "")
        a_bytes = [bytes(alphabet[c] for c in a_lib.id_to_token(i)) for i in a]
        b_bytes = [bytes([int(p[3:5], 16)]) if b_lib.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, map(b_lib.id_to_piece, b))]
        if not text or b"".join(a_bytes) != whole or b"".join(b_bytes) != whole:
            found.append(None)
            continue
        a_ends, b_ends = np.cumsum([len(t) for t in a_bytes]).tolist(), np.cumsum([len(t) for t in b_bytes]).tolist()
        a_at, b_at = {e: i for i, e in enumerate(a_ends)}, {e: i for i, e in enumerate(b_ends)}
        groups, links, last = [], [], (0, 0)
        for end in sorted(a_at.keys() & b_at.keys()):
            to = (a_at[end] + 1, b_at[end] + 1)
            groups.append(",".join(map(str, a[last[0] : to[0]])) + "|" + ",".join(map(str, b[last[1] : to[1]])))
            links.append((a[to[0] - 1], b[to[1] - 1]))
            last = to
        counts.update(links)
        found.append((len(a), len(b), links, ";".join(groups)))
    highest = Counter()
    for (_, b), n in counts.items():
        highest[b] = max(highest[b], n)
    rows = []
    for f in found:
        if f is None:
            rows.append(ZEROS)
            continue
        n_a, n_b, links, groups = f
        best = sum(counts[pair] == highest[pair[1]] for pair in links)
        rows.append((n_a, n_b, len(links), len(links), best, sum(counts[pair] for pair in links), hashlib.sha256(groups.encode()).hexdigest()))
    return rows


def reported(frame):
    return sorted((r.doc_id is None, r.doc_id or 0, tuple(r)[1:]) for r in frame.collect())


def expected(rows):
    return sorted((i is None, i or 0, r) for i, r in rows)


@pytest.mark.parametrize("share", [alignment.FREQUENT_SHARE, 0.01, 2.0])
def test_report_against_brute_force(spark, tokenizers, monkeypatch, share):
    """Whatever the number of frequent pairs: all, some, none."""
    monkeypatch.setattr(alignment, "FREQUENT_SHARE", share)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    rows = docs.collect()
    assert reported(alignment.link_report(docs, tokenizers)) == expected(zip([r.doc_id for r in rows], brute_force([r.text for r in rows])))


def test_odd_texts(spark, tokenizers, odd_documents, no_documents):
    """Null, empty, long and repeated texts, clashing names, strings of special tokens, texts that the pieces do not spell."""
    odd = [
        "  two  spaces ", "▁ stands for a space", "<s> </s> <unk> <0x41> <|endoftext|>", "漢字かな交じり文🙂é", "é", "​﻿", "a\tb\r\n\n", "\x00\x01", " ", "ﬁ ½", "x" * 3000,
    ]
    more = spark.createDataFrame([(100 + i, t, None, None, None) for i, t in enumerate(odd)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = odd_documents.unionByName(more, allowMissingColumns=True).withColumn("pairs", F.lit("clash")).withColumn("row", F.lit("clash"))
    rows = docs.select("doc_id", "text").collect()
    want = brute_force([r.text for r in rows])
    assert ZEROS in want and reported(alignment.link_report(docs, tokenizers)) == expected(zip([r.doc_id for r in rows], want))
    assert alignment.link_report(no_documents, tokenizers).collect() == []


def test_groups_are_given_in_full(spark, tokenizers):
    row = alignment.align(spark.createDataFrame([(1, "pale ale")], "doc_id long, text string"), tokenizers).first()
    assert row.groups.count(";") + 1 == row.n_groups == sum(row.times)
    assert sum(len(g.split("|")[0].split(",")) for g in row.groups.split(";")) == row.n_a


def test_long_texts_are_aligned_alone(spark, tokenizers, monkeypatch):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    together = sorted(alignment.align(docs, tokenizers).collect(), key=lambda r: r.doc_id)
    both = alignment.Both(tokenizers)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for row in together[:20]:
        alone = alignment._aligned(both, alignment.pa.array([row.doc_id]), [texts[row.doc_id] or ""]).to_pylist()[0]
        assert alone == row.asDict()
