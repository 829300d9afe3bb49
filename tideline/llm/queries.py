"""The operators applied to whole tables, each result reduced to its contract's columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import alignment, bpe, dedup, fingerprints, jaccard, language, licenses, lm, mixing, negatives, pages, topk, urls
from tideline.llm.common import read_table, training_rows

# The rules and listed names of the url filter.
URL_RULES = [
    urls.Rule("allow", "org", "/"),
    urls.Rule("block", "example.org", "/es/"),
    urls.Rule("block", "example.org", "/en/1"),
    urls.Rule("allow", "com", "/fr/"),
    urls.Rule("block", "com", "/de/"),
]
LISTED_NAMES = ["ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm"]


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file lies; read by the driver, which sends its contents."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = lm.Pieces.load(tokenizer_path("piece_bpe_32k.model"))
    return lm.score_documents(read_table(spark, sf_dir, "documents"), pieces, parts=10, held_out=0)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = bpe.Vocabulary.load(tokenizer_path("byte_bpe_50k.json"))
    return bpe.token_digests(read_table(spark, sf_dir, "documents"), vocabulary)


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.shingle_components(read_table(spark, sf_dir, "documents"))


def op4_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(read_table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_report(read_table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_next(read_table(spark, sf_dir, "documents"))


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urls.judge(read_table(spark, sf_dir, "pages"), URL_RULES, LISTED_NAMES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op9_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.exact_groups(read_table(spark, sf_dir, "documents"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents")
    held_out = ~training_rows("doc_id", 4, 2)
    network = language.learn(documents, parts=4, held_out=2)
    return language.identify(documents, network).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizers = alignment.Tokenizers.load(tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))
    return alignment.link_report(read_table(spark, sf_dir, "documents"), tokenizers)


def op12_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read_table(spark, sf_dir, "embeddings"), k=10, scale=1024, every=100)


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(read_table(spark, sf_dir, "embeddings"), moved, scale=256, every=50, positives=5, negatives=3)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        *(op1_lattice_lm, op2_bpe, op3_jaccard, op4_pages, op5_licenses, op6_mixing, op7_fingerprints, op8_urls, op9_dedup, op10_language),
        *(op11_alignment, op12_topk, op13_negatives),
    )
}
