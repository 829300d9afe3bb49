"""Hard negatives: rows of another label that score almost as high as a positive, by exact products of matrices.

Anchors and candidates meet in tiles of whole numbers, multiplied by Strassen's recursion. The best rows of
the own label, and for each of them the best of the other labels within a window of scores below it, are kept in
heaps; those of different tiles and tasks are merged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.common import written
from tideline.llm.vectors import Blocks, Grid, Heaps, in_cells, matrix, shelf_count, stored, whole_numbers

BLOCK_ROWS = 512
ANCHORS_AT_ONCE = 512
# Matrices with a side of at most this are multiplied directly.
LEAF = 16

# The window of scores, in hundredths of the positive's.
FROM_PERCENT, TO_PERCENT = 50, 95


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """The product of matrices of 64-bit whole numbers: seven products of halves instead of eight; odd sides get a line of zeros."""
    (n, m), p = a.shape, b.shape[1]
    if min(n, m, p) <= leaf:
        return a @ b
    h, w, v = (n + 1) // 2, (m + 1) // 2, (p + 1) // 2
    if n % 2 or m % 2:
        a = np.pad(a, ((0, 2 * h - n), (0, 2 * w - m)))
    if m % 2 or p % 2:
        b = np.pad(b, ((0, 2 * w - m), (0, 2 * v - p)))
    a11, a12, a21, a22 = a[:h, :w], a[:h, w:], a[h:, :w], a[h:, w:]
    b11, b12, b21, b22 = b[:w, :v], b[:w, v:], b[w:, :v], b[w:, v:]
    diagonal = strassen(a11 + a22, b11 + b22, leaf)
    lower = strassen(a21 + a22, b11, leaf)
    right = strassen(a11, b12 - b22, leaf)
    left = strassen(a22, b21 - b11, leaf)
    upper = strassen(a11 + a12, b22, leaf)
    out = np.empty((2 * h, 2 * v), np.int64)
    out[:h, :v] = diagonal + left - upper + strassen(a12 - a22, b21 + b22, leaf)
    out[:h, v:] = right + upper
    out[h:, :v] = lower + left
    out[h:, v:] = diagonal - lower + right + strassen(a21 - a11, b11 + b12, leaf)
    return out[:n, :p]


def best_positives(blocks: Blocks, anchors: np.ndarray, own: np.ndarray, labels: np.ndarray, k: int) -> Heaps:
    """For each anchor the best other rows of its label."""
    heaps = Heaps(len(anchors), k)
    for start, size, tile in zip(blocks.starts, blocks.sizes, blocks.components):
        rows, of = blocks.rows[start : start + size], blocks.labels[start : start + size]
        scores = strassen(anchors, tile)
        a, r = np.nonzero((labels[:, None] == of[None, :]) & (own[:, None] != rows[None, :]) & (scores >= heaps.least[:, None]))
        heaps.offer(a, scores[a, r], rows[r])
    return heaps


def best_in_windows(blocks: Blocks, anchors: np.ndarray, labels: np.ndarray, anchor: np.ndarray, positive_score: np.ndarray, k: int) -> Heaps:
    """For each positive, given by the number of its anchor and its score, the best rows of other labels in its window."""
    heaps = Heaps(len(anchor), k)
    low, high = -(-FROM_PERCENT * positive_score // 100), TO_PERCENT * positive_score // 100
    for start, size, tile in zip(blocks.starts, blocks.sizes, blocks.components):
        rows, of = blocks.rows[start : start + size], blocks.labels[start : start + size]
        scores = strassen(anchors, tile)[anchor]
        least = np.maximum(low, heaps.least)
        p, r = np.nonzero((labels[anchor][:, None] != of[None, :]) & (scores >= least[:, None]) & (scores <= high[:, None]))
        heaps.offer(p, scores[p, r], rows[r])
    return heaps


def hard_negatives(
    vectors: DataFrame,
    label,
    scale: int = 256,
    every: int = 50,
    positives: int = 5,
    negatives: int = 3,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the rows whose id is divisible by ``every``.

    ``label`` is a column. A positive without a row in its window gives none. Defined for odd
    input: rows without a label, and vectors that are null or have a null or not finite component, take no
    part; shorter vectors end with zeros; a row with a null id is no anchor and comes last among ties; of repeated
    rows each is an anchor and a positive of the others; scaled components beyond 2^22 count as 2^22.
    """
    numbers = whole_numbers(vectors, scale, id_col, vec_col, label)
    asks = F.col("vec_id") % every == 0
    grid = Grid.of(numbers, asks)
    blocks = stored(numbers, grid.shelves, BLOCK_ROWS, [])
    grid = Grid(shelf_count(blocks), grid.groups)
    anchors = numbers.where(asks).select("row", "vec_id", "label", "ints", grid.group().alias("group"))

    def own_label(shelf: pa.Table, asked: pa.Table) -> pa.Table:
        parts = []
        if len(shelf) and len(asked):
            held = Blocks.of(shelf, matrix(asked.column("ints")).shape[1])
            for at in range(0, len(asked), ANCHORS_AT_ONCE):
                some = asked.slice(at, ANCHORS_AT_ONCE)
                own = some.column("row").to_numpy()
                heaps = best_positives(held, matrix(some.column("ints"), held.upper.shape[2]), own, some.column("label").to_numpy(), positives)
                a, score, row = heaps.entries()
                parts.append(pa.table([pa.array(own[a]), pa.array(row), held.ids_of(row), pa.array(score)], ["anchor", "row", "positive_id", "positive_score"]))
        return pa.concat_tables(parts) if parts else pa.table([pa.array([], pa.int64())] * 4, ["anchor", "row", "positive_id", "positive_score"])

    found = in_cells(blocks, anchors, grid, own_label, "anchor long, row long, positive_id long, positive_score long")
    by_score = Window.partitionBy("anchor").orderBy(F.col("positive_score").desc(), "row")
    first = found.withColumn("place", F.row_number().over(by_score)).where(F.col("place") <= positives)
    # An anchor carries its positives, a number fixed by the request.
    listed = F.array_sort(F.collect_list(F.struct("place", "positive_id", "positive_score")))
    carried = written(first.groupBy(F.col("anchor").alias("row")).agg(listed.alias("positives")))

    def other_labels(shelf: pa.Table, asked: pa.Table) -> pa.Table:
        parts = []
        if len(shelf) and len(asked):
            held = Blocks.of(shelf, matrix(asked.column("ints")).shape[1])
            for at in range(0, len(asked), ANCHORS_AT_ONCE):
                some = asked.slice(at, ANCHORS_AT_ONCE)
                lists = some.column("positives").combine_chunks()
                each = lists.flatten()
                score = each.field("positive_score").to_numpy()
                anchor = np.repeat(np.arange(len(some)), lists.value_lengths().to_numpy())
                heaps = best_in_windows(held, matrix(some.column("ints"), held.upper.shape[2]), some.column("label").to_numpy(), anchor, score, negatives)
                p, negative_score, row = heaps.entries()
                taken = pa.array(p)
                columns = [pa.array(some.column("row").to_numpy()[anchor[p]]), some.column("vec_id").combine_chunks().take(pa.array(anchor[p]))]
                columns += [each.field(c).take(taken) for c in ("place", "positive_id", "positive_score")]
                columns += [pa.array(row), held.ids_of(row), pa.array(negative_score)]
                parts.append(pa.table(columns, MINED))
        return pa.concat_tables(parts) if parts else pa.table([pa.array([], pa.int32() if c == "place" else pa.int64()) for c in MINED], MINED)

    schema = ", ".join(f"{c} {'int' if c == 'place' else 'long'}" for c in MINED)
    mined = in_cells(blocks, anchors.join(carried, "row"), grid, other_labels, schema)
    by_rank = Window.partitionBy("anchor", "place").orderBy(F.col("negative_score").desc(), "row")
    ranked = mined.withColumn("rank", F.row_number().over(by_rank)).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


MINED = ["anchor", "anchor_id", "place", "positive_id", "positive_score", "row", "negative_id", "negative_score"]
