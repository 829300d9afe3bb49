"""Exact search for the highest inner products, block after block, until no block can hold a better row.

Components are terms, positive and negative ones apart; of each block the largest value of every term
is known. Their sum, weighted by a query, bounds the scores of the block's rows. A query takes the
blocks of a shelf by falling bound and stops at the first that lies below its k-th score so far. To
start with a high k-th score everywhere, it is first searched in the shelf with its highest bound.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.common import written
from tideline.llm.vectors import NO_SCORE, Blocks, Grid, Heaps, in_cells, matrix, shelf_count, stored, whole_numbers

BLOCK_ROWS = 128
# Blocks that a query takes before its k-th score is looked at again, and queries treated at a time.
STRIDE = 4
QUERIES_AT_ONCE = 1_024
# Strongest terms by which rows are put in order.
STRONGEST = 3

FOUND = "query long, query_id long, row long, vec_id long, score long"


def exact_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The product of matrices of whole numbers: in floating point where every sum fits in its 53 bits."""
    largest = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * a.shape[1]
    if largest < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)
    return a @ b


def block_bounds(queries: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """For each query and block the sum of its terms' maxima."""
    return exact_product(np.maximum(queries, 0), upper[:, 0].T) + exact_product(np.maximum(-queries, 0), upper[:, 1].T)


def search(blocks: Blocks, queries: np.ndarray, own: np.ndarray, least: np.ndarray, k: int) -> tuple[Heaps, int]:
    """The best rows of the blocks for each query, its ``own`` row apart, and how many blocks were scored for a query, summed.

    Rows that score below ``least`` may be left out.
    """
    heaps, scored = Heaps(len(queries), k, least), 0
    bounds = block_bounds(queries, blocks.upper)
    order = np.argsort(-bounds, axis=1, kind="stable")
    starts = blocks.starts
    for at in range(0, order.shape[1], STRIDE):
        taken = order[:, at : at + STRIDE]
        asked = np.take_along_axis(bounds, taken, axis=1) >= heaps.least[:, None]
        if not asked.any():
            break
        of, column = np.nonzero(asked)
        block = taken[of, column]
        scored += len(of)
        by_block = np.argsort(block, kind="stable")
        of, block = of[by_block], block[by_block]
        cuts = np.flatnonzero(np.diff(block)) + 1
        offers = []
        for some, b in zip(np.split(of, cuts), block[np.concatenate([[0], cuts])]):
            scores = exact_product(queries[some], blocks.components[b])
            rows = blocks.rows[starts[b] : starts[b] + blocks.sizes[b]]
            q, r = np.nonzero((scores >= heaps.least[some][:, None]) & (rows[None, :] != own[some][:, None]))
            offers.append((some[q], scores[q, r], rows[r]))
        heaps.offer(*(np.concatenate(x) for x in zip(*offers)))
    return heaps, scored


def _queries(table: pa.Table, dim: int) -> np.ndarray:
    return matrix(table.column("ints"), dim)


def top_k(vectors: DataFrame, k: int = 10, scale: int = 1024, every: int = 100, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` rows with the highest inner product with each row whose id is divisible by ``every``.

    Components become floor(``scale`` * component). Exact: ties go to the smaller id. Defined for odd input:
    vectors that are null or have a null or not finite component take no part; shorter vectors end with zeros; a
    row with a null id asks nothing and is found last among ties; of repeated rows each asks and finds the others;
    scaled components beyond 2^22 count as 2^22. Other columns are not read.
    """
    numbers = whole_numbers(vectors, scale, id_col, vec_col)
    asks = F.col("vec_id") % every == 0
    grid = Grid.of(numbers, asks)
    # Rows with the same strongest terms lie together, so that a block's maxima are theirs.
    strongest = F.slice(F.array_sort(F.transform("ints", lambda x, i: F.struct((-F.abs(x)).alias("size"), i.alias("term"), (x > 0).alias("positive")))), 1, STRONGEST)
    blocks = stored(numbers, grid.shelves, BLOCK_ROWS, [F.transform(strongest, lambda t: F.struct(t["term"], t["positive"]))])
    grid = Grid(shelf_count(blocks), grid.groups)
    queries = numbers.where(asks).select("row", "vec_id", "ints", grid.group().alias("group"))

    def bound(shelf: pa.Table, asked: pa.Table) -> pa.Table:
        if not len(shelf) or not len(asked):
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int32()), pa.array([], pa.int64())], ["row", "shelf", "bound"])
        values = _queries(asked, max(shelf.column("dim").to_pylist()))
        best = block_bounds(values, Blocks.of(shelf, values.shape[1]).upper).max(axis=1)
        return pa.table([asked.column("row"), pa.array([shelf.column("shelf")[0].as_py()] * len(asked), pa.int32()), pa.array(best)], ["row", "shelf", "bound"])

    def best(shelf: pa.Table, asked: pa.Table) -> pa.Table:
        parts = []
        if len(shelf) and len(asked):
            held = Blocks.of(shelf, matrix(asked.column("ints")).shape[1])
            for at in range(0, len(asked), QUERIES_AT_ONCE):
                some = asked.slice(at, QUERIES_AT_ONCE)
                values = _queries(some, held.upper.shape[2])
                own = some.column("row").to_numpy()
                heaps, _ = search(held, values, own, some.column("least").to_numpy(), k)
                q, score, row = heaps.entries()
                ids = some.column("vec_id").combine_chunks().take(pa.array(q))
                parts.append(pa.table([pa.array(own[q]), ids, pa.array(row), held.ids_of(row), pa.array(score)], ["query", "query_id", "row", "vec_id", "score"]))
        return pa.concat_tables(parts) if parts else pa.table([pa.array([], pa.int64())] * 5, ["query", "query_id", "row", "vec_id", "score"])

    found_bounds = in_cells(blocks.drop("data"), queries, grid, bound, "row long, shelf int, bound long")
    home = written(found_bounds.groupBy("row").agg(F.max_by("shelf", F.struct("bound", "shelf")).alias("home")))
    at_home = queries.join(home, "row").withColumnRenamed("home", "shelf").withColumn("least", F.lit(NO_SCORE))
    first = written(in_cells(blocks, at_home, grid, best, FOUND))
    kth = first.groupBy(F.col("query").alias("row")).agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).otherwise(NO_SCORE).alias("least"))
    elsewhere = queries.join(home, "row").join(kth, "row", "left").withColumn("least", F.coalesce("least", F.lit(NO_SCORE)))
    shelves = F.array_except(F.sequence(F.lit(0), F.lit(grid.shelves - 1)), F.array("home"))
    elsewhere = elsewhere.withColumn("shelf", F.explode(shelves)).drop("home")
    rest = in_cells(blocks, elsewhere, grid, best, FOUND)
    by_rank = Window.partitionBy("query").orderBy(F.col("score").desc(), "row")
    ranked = first.unionByName(rest).withColumn("rank", F.row_number().over(by_rank)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
