import pytest
from pyspark.sql import functions as F

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in every column, empty and long texts, ties and repeated rows, and columns with clashing names."""
    long_text = " ".join(f"word{i % 997} more{i % 13}" for i in range(30_000))
    rows = [
        (1, "The quick brown fox jumps over the lazy dog near the river", "en", "a", 1),
        (1, "The quick brown fox jumps over the lazy dog near the river", "en", "a", 1),
        (2, "the quick brown fox jumps over the lazy dog near  the river", "en", "b", 2),
        (3, None, "en", "a", None),
        (4, "", None, None, 0),
        (5, " \t\n", "fr", None, 3),
        (6, long_text, "en", "a", None),
        (7, long_text + " tail", "fr", "a", None),
        (None, "sans identité, licensed under the MIT License", "fr", "b", 5),
        (None, None, None, None, None),
        (8, "12345 !!! <|endoftext|> 67", "fr", "c", 9),
        (9, "x" * 5000, "fr", "c", 9),
        (10, "Released under teh MIT Licence.", "en", "c", 9),
    ]
    frame = spark.createDataFrame(rows, DOCUMENT)
    for name in ("set", "score", "key", "bucket", "copies", "language", "mixed_copies", "kept_doc_id", "dropped_id", "mix_doc_id"):
        frame = frame.withColumn(name, F.lit("clash"))
    return frame


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], DOCUMENT)
