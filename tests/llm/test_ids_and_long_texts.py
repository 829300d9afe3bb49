"""Ids wherever they lie, and scans of long texts in time proportional to their length."""

import random
import time

import pytest

from tideline.llm import fingerprints, licenses


@pytest.mark.parametrize("kind", ["wide", "outlier", "strided", "clustered"])
def test_fingerprints_follow_any_ids(spark, monkeypatch, kind):
    """Each document meets the one with the next smaller id, in many buckets of about equal sizes."""
    monkeypatch.setattr(fingerprints, "IDS_PER_BUCKET", 20)
    rng = random.Random(kind)
    ids = {
        "wide": [rng.randrange(-(2**63), 2**63) for _ in range(600)] + [-(2**63), 2**63 - 1, 0],
        "outlier": [*range(600), 4 * 10**12],
        "strided": [i * 2**20 for i in range(-300, 300)],
        "clustered": [c * 10**15 + i for c in range(3) for i in range(200)],
    }[kind]
    docs = spark.createDataFrame([(i, f"text of {i} " * 9) for i in rng.sample(ids, len(ids))], "doc_id long, text string")
    sizes = [r["count"] for r in fingerprints.in_order(docs, "doc_id", "text").where("NOT guest").groupBy("bucket").count().collect()]
    assert sum(sizes) == len(ids) and max(sizes) <= 20 * 12 and len(sizes) > 10
    got = {r.doc_id: r.edited_sha256 for r in fingerprints.compare_with_next(docs).collect()}
    order = sorted(ids, reverse=True)
    texts = {i: f"text of {i} " * 9 for i in ids}
    import hashlib

    for i, following in zip(order, [*order[1:], order[0]]):
        third = len(texts[i]) // 3
        edited = texts[i][: len(texts[i]) - third] + texts[following][:third]
        assert got[i] == hashlib.sha256(edited.encode()).hexdigest()


def test_all_rows_with_one_or_no_id(spark):
    for doc_id in (7, None):
        docs = spark.createDataFrame([(doc_id, f"text {i}") for i in range(50)], "doc_id long, text string")
        assert fingerprints.compare_with_next(docs).count() == 50


def words(text):
    return b" " + b" ".join(w for w in text.encode().translate(licenses.WORD_BYTES).split(b" ") if w) + b" "


def test_phrases_of_long_texts_take_time_in_proportion():
    scanner = licenses.Scanner(licenses.PHRASES, licenses.NOTICES, licenses.CHARS_PER_EDIT)
    text = words("under the mit license and more " * 200_000)
    started = time.perf_counter()
    found = scanner.exact(text)
    assert [w for _, w in found[:3]] == [0, 6, 12] and len(found) == 200_000
    # Counting spaces from the start for each place took over ten minutes.
    assert time.perf_counter() - started < 30


def test_many_notices_are_kept_apart():
    scanner = licenses.Scanner(licenses.PHRASES, licenses.NOTICES, licenses.CHARS_PER_EDIT)
    found = scanner.fuzzy(words("released under teh mit license, " * 500))
    assert [f[1] for f in found] == [5 * i for i in range(500)] and {f[0] for f in found} == {"mit"}


def edit_distance(a, b):
    """Of the pattern ``a`` to the best part of ``b``: the start of the match is free, and so is its end."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        before, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return min(row)


@pytest.mark.parametrize("seed", range(6))
def test_fuzzy_finds_what_a_scan_of_edit_distances_finds(seed):
    """A label is found exactly where some notice of it lies within its edits, by the plain table of distances."""
    rng = random.Random(seed)
    scanner = licenses.Scanner(licenses.PHRASES, licenses.NOTICES, licenses.CHARS_PER_EDIT)
    for _ in range(12):
        text, label = rng.choice(list(licenses.NOTICES.items()))
        letters = list(text)
        for _ in range(rng.randrange(0, 8)):
            at = rng.randrange(len(letters))
            letters[at : at + rng.randrange(2)] = rng.choice(["", "x", "q", " "])
        whole = words("some words before " + "".join(letters) + " and some words after")
        near = {n.label for n in scanner.notices if edit_distance(n.text, whole) <= n.edits}
        got = {f[0] for f in scanner.fuzzy(whole)}
        # Of labels whose notices lie in one place the closest is reported.
        assert got <= near and bool(got) == bool(near), (whole, got, near)
        assert label in got or label not in near or len(near) > 1
