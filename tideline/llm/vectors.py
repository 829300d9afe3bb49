"""Vectors as whole numbers, stored in blocks, and best lists that can be merged.

Some rows of a table, the queries, are scored against all its rows. Rows are stored in blocks of a
fixed number, blocks in shelves, queries in groups; a task gets one shelf and one group, both of
bounded size, and tells the best rows of the shelf for each query. What tasks find is merged.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import released, written

# What a task holds of the rows, and of the queries, in bytes of their whole numbers.
SHELF_BYTES = 32_000_000
GROUP_BYTES = 16_000_000
# A shelf is not made smaller than this to have work for more tasks.
SHELF_ROWS = 4_096
# Scaled components beyond this count as this, so that scores, and a hundred times them, fit in 64 bits up to 4096 components.
LARGEST = 2**22
NO_SCORE = np.iinfo(np.int64).min


def whole_numbers(rows: DataFrame, scale: int, id_col: str, vec_col: str, label: Column | None = None) -> DataFrame:
    """row, vec_id, label, ints (floor of ``scale`` times each component) of the rows whose vector is whole, written once.

    ``row`` is unique and ascends with the id, null ids last, so it breaks ties as the ids do, and
    tells repeated rows apart. Left out are null vectors and those with a null or not finite
    component, and with ``label`` those without one.
    """
    x = F.col(vec_col).cast("array<double>")
    sound = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    if label is not None:
        sound = sound & label.isNotNull()
    bound = F.lit(float(LARGEST))
    ints = F.transform(x, lambda c: F.floor(F.least(F.greatest(F.lit(float(scale)) * c, -bound), bound)).cast("int"))
    kept = rows.where(F.coalesce(sound, F.lit(False))).select(
        F.col(id_col).cast("long").alias("vec_id"), (F.lit(None) if label is None else label).cast("long").alias("label"), ints.alias("ints")
    )
    # The running number splits rows of one id over partitions.
    spread = kept.withColumn("_n", F.monotonically_increasing_id()).orderBy(F.col("vec_id").asc_nulls_last(), "_n").drop("_n")
    return written(spread.select(F.monotonically_increasing_id().alias("row"), "*"))


def matrix(lists: pa.ChunkedArray | pa.Array, dim: int | None = None) -> np.ndarray:
    """Lists of numbers as rows of a matrix; shorter ones end with zeros."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    values = lists.flatten().to_numpy(zero_copy_only=False)
    dim = max(int(sizes.max(initial=0)), dim or 0)
    out = np.zeros((len(lists), dim), np.int64)
    out[np.repeat(np.arange(len(lists)), sizes), np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


@dataclass
class Blocks:
    """The blocks of one shelf: the rows of each, ids and labels beside them, and a matrix with a line per component."""

    sizes: np.ndarray
    rows: np.ndarray
    ids: pa.Array
    labels: np.ndarray
    components: list[np.ndarray]
    upper: np.ndarray

    @classmethod
    def of(cls, table: pa.Table, dim: int) -> Blocks:
        """From rows that ``stored`` made; matrices are padded with zeros to ``dim`` lines at least."""
        dim = max([dim, *table.column("dim").to_pylist()])
        found = []
        for own, data in zip(table.column("dim").to_pylist(), table.column("data").to_pylist() if "data" in table.column_names else []):
            lines = np.frombuffer(data, "<i4").reshape(own, -1) if own else np.zeros((0, 0), "<i4")
            found.append(lines)
        sizes = table.column("rows").combine_chunks().value_lengths().to_numpy().astype(np.int64)
        components = []
        for lines, size in zip(found, sizes):
            padded = np.zeros((dim, size), np.int64)
            padded[: len(lines)] = lines
            components.append(padded)
        upper = np.zeros((len(table), 2, dim), np.int64)
        for i, (own, packed) in enumerate(zip(table.column("dim").to_pylist(), table.column("upper").to_pylist())):
            upper[i, :, :own] = np.frombuffer(packed, "<i4").reshape(2, own) if own else 0
        flat = {c: table.column(c).combine_chunks().flatten() for c in ("rows", "ids", "labels")}
        labels = flat["labels"].fill_null(0).to_numpy(zero_copy_only=False)
        return cls(sizes, flat["rows"].to_numpy(zero_copy_only=False), flat["ids"], labels, components, upper)

    @property
    def starts(self) -> np.ndarray:
        return np.cumsum(self.sizes) - self.sizes

    def ids_of(self, rows: np.ndarray) -> pa.Array:
        order = np.argsort(self.rows, kind="stable")
        return self.ids.take(pa.array(order[np.searchsorted(self.rows, rows, sorter=order)]))


STORED = "shelf int, block int, dim int, rows array<long>, ids array<long>, labels array<long>, data binary, upper binary"


def stored(numbers: DataFrame, shelves: int, block_rows: int, order: list[Column]) -> DataFrame:
    """The rows in shelves by ranges of ``order``, in blocks of at most ``block_rows``, with the largest value and the
    largest opposite value of each component in a block; written once."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shelf, block = TaskContext.get().partitionId(), 0
        held = None
        for batch in batches:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            while len(held) >= block_rows:
                yield one(shelf, block, held.slice(0, block_rows))
                held, block = held.slice(block_rows), block + 1
        if held is not None and len(held):
            yield one(shelf, block, held)

    def one(shelf: int, block: int, part: pa.Table) -> pa.RecordBatch:
        values = matrix(part.column("ints"))
        top = np.stack([values.max(axis=0, initial=-LARGEST), (-values).max(axis=0, initial=-LARGEST)]).astype("<i4")
        lists = [pa.array([part.column(c).to_pylist()], pa.list_(pa.int64())) for c in ("row", "vec_id", "label")]
        numbers = [pa.array([n], pa.int32()) for n in (shelf, block, values.shape[1])]
        packed = [pa.array([np.ascontiguousarray(m).tobytes()], pa.binary()) for m in (values.T.astype("<i4"), top)]
        return pa.RecordBatch.from_arrays([*numbers, *lists, *packed], names=["shelf", "block", "dim", "rows", "ids", "labels", "data", "upper"])

    # As columns, so that sorting compares what was computed once.
    names = [f"_order{i}" for i in range(len(order))]
    keyed = numbers.withColumns(dict(zip(names, order))) if order else numbers
    placed = keyed.repartitionByRange(shelves, *names, "row").sortWithinPartitions(*names, "row").drop(*names)
    return written(placed.mapInArrow(released(pack), STORED))


@dataclass(frozen=True)
class Grid:
    """How many shelves and groups of queries there are."""

    shelves: int
    groups: int

    @classmethod
    def of(cls, numbers: DataFrame, queries: Column) -> Grid:
        n = numbers.agg(
            F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.size("ints")), F.lit(0)).alias("ints"), F.coalesce(F.sum(F.when(queries, F.size("ints"))), F.lit(0)).alias("asked")
        ).first()
        cores = numbers.sparkSession.sparkContext.defaultParallelism
        shelves = max(1, -(-4 * n["ints"] // SHELF_BYTES), min(2 * cores, n["rows"] // SHELF_ROWS))
        return cls(shelves, max(1, -(-4 * n["asked"] // GROUP_BYTES)))

    def group(self) -> Column:
        return F.pmod(F.xxhash64("row"), F.lit(self.groups)).cast("int")


def shelf_count(blocks: DataFrame) -> int:
    """Shelves are numbered from 0."""
    return (blocks.agg(F.max("shelf").alias("last")).first()["last"] or 0) + 1


def in_cells(blocks: DataFrame, queries: DataFrame, grid: Grid, function: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """``function`` of each shelf with the queries of each group.

    ``queries`` have a group, and a shelf if each is for one shelf only. A cell holds a shelf and a group, both bounded.
    """
    if "shelf" not in queries.columns:
        queries = queries.withColumn("shelf", F.explode(F.sequence(F.lit(0), F.lit(grid.shelves - 1))))
        spread = blocks.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(grid.groups - 1))))
    else:
        # Shelves go where queries ask for them.
        wanted = queries.select(F.col("shelf").alias("wanted"), (F.col("group") + 0).alias("group")).distinct()
        spread = blocks.join(wanted, F.col("shelf") == F.col("wanted")).drop("wanted")
    return spread.groupBy("shelf", "group").cogroup(queries.groupBy("shelf", "group")).applyInArrow(function, schema)


class Heaps:
    """For each of some numbered queries the ``k`` best rows: highest score first, ties to the smaller row.

    Offers may come in any order and portions, and from other heaps: the result is the same.
    """

    def __init__(self, queries: int, k: int, least: np.ndarray | None = None):
        self.k = k
        self.scores = np.full((queries, k), NO_SCORE, np.int64)
        self.rows = np.full((queries, k), np.iinfo(np.int64).max, np.int64)
        self.sizes = np.zeros(queries, np.int64)
        # A row below this can't be among the best; one that equals it can.
        self.least = np.full(queries, NO_SCORE, np.int64) if least is None else least.copy()

    def offer(self, query: np.ndarray, score: np.ndarray, row: np.ndarray) -> None:
        keep = score >= self.least[query]
        query, score, row = query[keep], score[keep], row[keep]
        if not len(query):
            return
        touched = np.unique(query)
        old_q, old_at = np.nonzero(np.arange(self.k)[None, :] < self.sizes[touched][:, None])
        query = np.concatenate([touched[old_q], query])
        score = np.concatenate([self.scores[touched[old_q], old_at], score])
        row = np.concatenate([self.rows[touched[old_q], old_at], row])
        order = np.lexsort((row, -score, query))
        query, score, row = query[order], score[order], row[order]
        first = np.searchsorted(query, query)
        rank = np.arange(len(query)) - first
        best = rank < self.k
        self.scores[query[best], rank[best]] = score[best]
        self.rows[query[best], rank[best]] = row[best]
        self.sizes[touched] = np.minimum(np.bincount(query, minlength=len(self.sizes))[touched], self.k)
        full = touched[self.sizes[touched] == self.k]
        self.least[full] = np.maximum(self.least[full], self.scores[full, self.k - 1])

    def entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """query, score, row of all that is held, best first."""
        query, at = np.nonzero(np.arange(self.k)[None, :] < self.sizes[:, None])
        return query, self.scores[query, at], self.rows[query, at]
