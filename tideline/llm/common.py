"""What the operators share: reading, cutting lineage, white space, packed numbers."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.session import scratch_path, staged

# The white space of the contracts, U+0020 and U+0009 to U+000D.
WHITE_CHARS = " \t\n\x0b\x0c\r"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

# bytes.translate table that lower-cases A-Z and nothing else.
LOWER_AZ = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, *by: str) -> DataFrame:
    """Cuts the lineage: the rows, stored once in the folder that the cluster names in spark.checkpoint.dir, and read from there.

    Whoever reads them later neither computes them again nor depends on the
    executor that did; with ``by``, in folders by the values of these columns, so that
    readers of one value read no other. The folder is the cluster's to clean.
    """
    if not by:
        return staged(df, "tideline")
    path = scratch_path(df.sparkSession, "tideline")
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def row_keyed(docs: DataFrame, row: str) -> DataFrame:
    """The rows with a key ``row`` of their own, the same in every read; keys can be compared and ordered.

    Rows of stored files, read as they stand, have their place there: file and number in it.
    Others are written with a number first.
    """
    if docs._jdf.queryExecution().analyzed().nodeName() == "LogicalRelation":
        try:
            place = docs.metadataColumn("_metadata")
            return docs.select("*", F.struct(place["file_path"], place["row_index"]).alias(row))
        except AnalysisException:
            pass  # The files' format has no numbers of rows.
    return written(docs.withColumn(row, F.monotonically_increasing_id()))


def sliced(batches, rows: int = 512):
    """Batches of fewer rows, so that only so many texts are held as Python objects at a time."""
    for batch in batches:
        for at in range(0, max(1, len(batch)), rows):
            yield batch.slice(at, rows)


def fresh(name: str, columns: list[str]) -> str:
    """A column name that none of ``columns`` has, whatever their case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def released(function):
    """For mapInArrow: gives memory back when a task ends.

    A worker serves one task after another, of several operators, and what the
    allocators keep of each would add up.
    """

    def run(batches):
        try:
            yield from function(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return run


def words_of(data: bytes) -> list[bytes]:
    """The words of UTF-8 text: ``bytes.split`` cuts at exactly the contract's white space."""
    return data.translate(LOWER_AZ).split()


def encoded(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def utf8_column(column: pa.Array) -> list[bytes]:
    """The values of a string column as UTF-8, null as empty, without decoding them."""
    return [v or b"" for v in column.cast(pa.binary() if column.type != pa.large_string() else pa.large_binary()).to_pylist()]


def mix64(x: np.ndarray) -> np.ndarray:
    """A fixed mixing of 64-bit numbers: each bit of the input changes half of the output's."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(33)
        x *= np.uint64(0xFF51AFD7ED558CCD)
        x ^= x >> np.uint64(33)
        x *= np.uint64(0xC4CEB9FE1A85EC53)
        x ^= x >> np.uint64(33)
    return x


def training_rows(id_column: str, parts: int, held_out: int):
    """True for rows to learn from: crc32 of the id's text modulo ``parts`` is not ``held_out``. A null id is the text ''."""
    text = F.coalesce(F.col(id_column).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % F.lit(parts) != F.lit(held_out)
