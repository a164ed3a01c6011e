"""A corpus pipeline: language ID, exact dedup, near dedup, decontamination, subword encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphlake.llm import decontaminate, exact_dedup, language_id, near_dedup, unigram
from graphlake.llm.common import Scratch, table
from graphlake.llm.queries import PIECES


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known well enough; those without a letter and those unlike any language go."""
    return language_id.keep_known(spark, docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.keep_first(spark, docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of similar texts."""
    return near_dedup.keep_one(spark, docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.keep_clean(spark, docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their subword ids, and whether these decode to the text."""
    return unigram.with_ids(docs, PIECES)


STAGES = [("language ID", language), ("exact dedup", exact), ("near dedup", near), ("decontamination", clean), ("encoding", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each reads what the one before it wrote."""
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES):
        docs = scratch.keep(stage(spark, docs, sf_dir), str(i))
    return docs


#: Signatures and subword ids are no SQL; tests hold the run against a brute-force version.
ORACLE_SQL = None
