"""The corpus pipeline: language, exact copies, near copies, source mix, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from scorelake.llm import exact_dedup, language_id, mixing, near_dup, packing
from scorelake.llm.common import documents, written
from scorelake.llm.queries import tokenizer_path


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a language that the classifier, fitted on the labelled ones, can tell. Null texts and texts without
    a letter go; without labels there is no language to tell, and all go."""
    model = language_id.fitted(docs)
    return language_id.identified(docs, model).where(~language_id.rejected()).select(docs.columns)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, A-Z lower-cased, the row with the largest doc_id stays."""
    return exact_dedup.exact_dedup(docs).where("kept").select(docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by near copies, directly or not, the one with the smallest doc_id stays. Texts without words
    stay, and so do rows without an id."""
    found = near_dup.near_components(docs).where("component_id <> id").select(F.col("id").alias("doc_id")).distinct()
    return docs.join(written(found, "near"), "doc_id", "left_anti").select(docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target shares of 150 % of all words: a document is left out, or stays once or twice."""
    return mixing.repeated(mixing.mixed(docs)).select(docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and the sequences of 2048 tokens that they lie in. Workers have other stages' memory
    to carry here, so they remember less than in a packing of its own, and nothing after a task."""
    return packing.packed(docs, tokenizer_path(), remembered=32_000_000, keep=False)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_stage),
    ("exact_dedup", exact_stage),
    ("ngram_jaccard", near_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]
#: The first stage's classifier is trained; SQL can't express it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
