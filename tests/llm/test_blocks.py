"""Blocks of documents with equal headers stay apart."""

import pytest

from tideline.llm import lm
from tideline.llm.queries import tokenizer_path


def test_equal_partitions_are_scored_each(spark):
    pieces = lm.Pieces.load(tokenizer_path("piece_bpe_32k.model"))
    frame = spark.range(0, 2, 1, 2).selectExpr("cast(1 AS long) AS doc_id", "'some words of one text some' AS text")
    found = [r.asDict() for r in lm.score_documents(frame, pieces).collect()]
    side_by_side = [r.asDict() for r in lm.score_documents(frame.coalesce(1), pieces).collect()]
    assert len(found) == len(side_by_side) == 2
    for r in (*found, *side_by_side):
        assert (r["n_tokens"], r["n_known"]) == (7, 7)
        assert (r["score"], r["base_score"]) == pytest.approx((found[0]["score"], found[0]["base_score"]))
