"""A corpus pipeline of five stages, each one operator of ``weftgraph.llm``.

Every stage takes all documents that the one before kept; ``run`` writes each
stage's result to the shared folder and reads it again. All stages but the last
return the columns of documents, whatever else these are called; the last one
returns doc_id, lang, source, ids and decoded.

Null and empty texts fail the quality rules, so they go in the first stage. Rows
with null or shared ids are rows like others: each is judged by its own text,
near copies and repeated rows leave one row, and the mixture takes each row as
often as systematic sampling says. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftgraph.llm import bpe, jaccard_join, language, mixing, quality
from weftgraph.llm.common import documents, stored
from weftgraph.llm.queries import labels, vocabulary_path

#: Near copies share so many per cent of their shingles, of so many words; op4 has a rule of its own.
NEAR_PERCENT, NEAR_WORDS = 80, 5


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    return quality.keep_good(docs, labels(spark, sf_dir))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language, or with less than half of their letters in one, go."""
    return language.keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that of the smallest id."""
    return jaccard_join.keep_one(docs, NEAR_PERCENT, NEAR_WORDS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that the sources come near their targets."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text, and the text decoded from them."""
    return bpe.encode(docs, vocabulary_path(), "doc_id", "lang", "source", decoded=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("mix_sources", mix_sources),
    ("encode", encode),
]

#: The classifier, the language model and the tokenizer can't be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
