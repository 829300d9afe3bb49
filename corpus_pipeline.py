"""From raw documents to encoded training text, stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tideline.llm import bpe, dedup, jaccard, language, mixing
from tideline.llm.common import fresh, read_table, written
from tideline.llm.queries import tokenizer_path


# A text goes if no language explains it so many times better than a guess; short clean texts may score low.
LEAST_GAIN = 1.2


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter, and those that fit no learned language better than another, go."""
    network = language.learn(docs)
    least = LEAST_GAIN / len(network.languages) if network is not None and len(network.languages) > 1 else 0.0
    name, score = fresh("language", docs.columns), fresh("score", docs.columns)
    found = language.identify(docs, network, keep=docs.columns, answer=(name, score))
    return found.where((found[name] != language.UNKNOWN) & (found[score] >= least)).drop(name, score)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the longest stays."""
    return dedup.without_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by a Jaccard similarity of 0.8 the one with the smallest id stays."""
    return jaccard.one_per_component(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixed_documents(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the text decoded from them."""
    return bpe.token_digests(docs, bpe.Vocabulary.load(tokenizer_path("byte_bpe_50k.json")))


STAGES = [
    ("language", known_language),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixed),
    ("bpe", encoded),
]

# Language identification is a trained network; SQL can't express it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs)
    return docs
