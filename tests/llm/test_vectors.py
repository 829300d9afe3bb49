"""Search and hard negatives against all products, exact multiplication, heaps in any order, pruning."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tideline.llm import negatives, topk, vectors

SMALL = "/root/testdata/sf0.001"
NAN, INF = float("nan"), float("inf")
SCHEMA = "vec_id long, embedding array<float>, label int, row string, shelf string"


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 70), st.integers(0, 70), st.integers(0, 70), st.integers(1, 9), st.integers(0, 2**32 - 1))
def test_strassen_is_exact(n, m, p, leaf, seed):
    rng = np.random.default_rng(seed)
    a, b = rng.integers(-(2**40), 2**40, (n, m)), rng.integers(-(2**20), 2**20, (m, p))
    # Both wrap around alike beyond 64 bits, and neither has to here.
    assert np.array_equal(negatives.strassen(a, b, leaf), a @ b)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(-5, 5)), max_size=60), st.integers(1, 5), st.integers(1, 7))
def test_heaps_do_not_depend_on_portions(offers, k, portion):
    heaps = vectors.Heaps(4, k)
    rows = np.random.default_rng(len(offers)).permutation(len(offers))
    for at in range(0, len(offers), portion):
        part = offers[at : at + portion]
        heaps.offer(np.array([q for q, _ in part]), np.array([s for _, s in part]), rows[at : at + len(part)])
    want = [(q, s, r) for q in range(4) for s, r in sorted(((s, r) for (o, s), r in zip(offers, rows) if o == q), key=lambda x: (-x[0], x[1]))[:k]]
    assert list(zip(*(x.tolist() for x in heaps.entries()))) == want


def whole(vector, scale):
    return None if vector is None or any(x is None or not math.isfinite(x) for x in vector) else [math.floor(scale * x) for x in vector]


def product(a, b):
    return sum(x * y for x, y in zip(a, b))


def order(entry):
    """Highest score, then smallest id, null ids last."""
    score, vec_id = entry
    return (-score, vec_id is None, vec_id or 0)


def best_of(rows, every, k, scale):
    kept = [(i, w) for i, v, *_ in rows if (w := whole(v, scale)) is not None]
    out = []
    for at, (query, q) in enumerate(kept):
        if query is not None and query % every == 0:
            scores = sorted(((product(q, c), i) for other, (i, c) in enumerate(kept) if other != at), key=order)[:k]
            out += [(query, rank, i, s) for rank, (s, i) in enumerate(scores, 1)]
    return out


def mined(rows, every, positives, wanted, scale):
    kept = [(i, w, label) for i, v, label, *_ in rows if label is not None and (w := whole(v, scale)) is not None]
    out = []
    for at, (anchor, a, label) in enumerate(kept):
        if anchor is None or anchor % every:
            continue
        scored = [(product(a, c), i, other) for n, (i, c, other) in enumerate(kept) if n != at]
        for s, i in sorted(((s, i) for s, i, other in scored if other == label), key=order)[:positives]:
            near = sorted(((t, j) for t, j, other in scored if other != label and 50 * s <= 100 * t <= 95 * s), key=order)[:wanted]
            out += [(anchor, i, rank, j, s, t) for rank, (t, j) in enumerate(near, 1)]
    return out


def same(frame, want):
    key = lambda row: [(v is None, v or 0) for v in row]
    assert sorted((tuple(r) for r in frame.collect()), key=key) == sorted(want, key=key)


@pytest.fixture(scope="module")
def odd_rows():
    """Few values, so many ties; repeated rows and ids, null ids, broken, short, empty and extreme vectors."""
    rng = np.random.default_rng(5)
    rows = [(i, rng.integers(-2, 3, 6).astype(float).tolist(), int(rng.integers(0, 3))) for i in range(-20, 60)]
    rows += [rows[20], rows[20], rows[25]] + [(20, [1.0] * 6, 1)] * 3
    rows += [(None, [1.0, 2.0, 0.0, 1.0, 1.0, 0.5], 1), (None, [2.0] * 6, 0), (70, None, 1), (80, [1.0, None], 1), (90, [NAN, 1.0], 1), (100, [INF], 2)]
    rows += [(110, [], 1), (120, [1.5], 1), (130, [1.0] * 9, 2), (140, [1.0] * 6, None), (150, [-0.001] * 6, 0)]
    return [(*r, "clash", "clash") for r in rows]


@pytest.mark.parametrize("shelf_rows", [vectors.SHELF_ROWS, 16])
@pytest.mark.parametrize("group_bytes", [vectors.GROUP_BYTES, 100])
def test_odd_vectors(spark, odd_rows, monkeypatch, shelf_rows, group_bytes):
    """The same whether the table is one cell or many."""
    monkeypatch.setattr(vectors, "SHELF_ROWS", shelf_rows)
    monkeypatch.setattr(vectors, "GROUP_BYTES", group_bytes)
    monkeypatch.setattr(topk, "BLOCK_ROWS", 8)
    frame = spark.createDataFrame(odd_rows, SCHEMA)
    same(topk.top_k(frame, k=4, scale=1024, every=10), best_of(odd_rows, 10, 4, 1024))
    same(negatives.hard_negatives(frame, F.col("label"), scale=256, every=10, positives=3, negatives=2), mined(odd_rows, 10, 3, 2, 256))


def test_no_vectors(spark):
    for rows in ([], [(1, None, 1, "", "")], [(100, [1.0], 1, "", "")]):
        frame = spark.createDataFrame(rows, SCHEMA)
        assert topk.top_k(frame).collect() == [] and negatives.hard_negatives(frame, F.col("label")).collect() == []


def test_huge_components_count_as_the_largest(spark):
    rows = [(0, [1e30, -1e30], 1, "", ""), (1, [1.0, 0.0], 1, "", "")]
    assert [tuple(r) for r in topk.top_k(spark.createDataFrame(rows, SCHEMA)).collect()] == [(0, 1, 1, 2**22 * 1024)]


def test_provided_vectors(spark):
    frame = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    rows = [tuple(r) for r in frame.select("vec_id", "embedding", "label").collect()]
    same(topk.top_k(frame), best_of(rows, 100, 10, 1024))
    moved = [(i, v, (label + 1) % 10 if i % 7 == 0 else label) for i, v, label in rows]
    same(negatives.hard_negatives(frame.withColumn("moved", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))), F.col("moved")), mined(moved, 50, 5, 3, 256))


def test_blocks_that_cannot_hold_better_rows_are_not_scored(spark):
    """Sixteen clusters in many blocks: a query is scored in few of them, with the same result."""
    rng = np.random.default_rng(3)
    centres = np.eye(16) * 4
    values = (centres[np.repeat(np.arange(16), 256)] + rng.normal(0, 0.05, (4096, 16))).astype(np.float32)
    frame = spark.createDataFrame([(i, v.tolist(), 0, "", "") for i, v in enumerate(values)], SCHEMA)
    blocks = vectors.stored(vectors.whole_numbers(frame, 1024, "vec_id", "embedding"), 1, 64, [F.transform("ints", lambda x: x > 1024)])
    held = vectors.Blocks.of(blocks.toArrow(), 0)
    numbers = np.floor(1024 * values.astype(float)).astype(np.int64)
    asked = np.arange(0, 4096, 64)
    heaps, scored = topk.search(held, numbers[asked], held.rows.max() + 1 + asked, np.full(len(asked), vectors.NO_SCORE), 5)
    assert len(held.sizes) == 64 and scored <= len(asked) * 8
    want = np.sort(numbers[asked] @ numbers.T, axis=1)[:, ::-1][:, :5]
    assert np.array_equal(heaps.scores, want)


def test_products_beyond_floating_point_are_exact():
    a, b = np.array([[2**40 + 1, 1]]), np.array([[2**20 + 1], [1]])
    assert topk.exact_product(a, b)[0, 0] == (2**40 + 1) * (2**20 + 1) + 1
