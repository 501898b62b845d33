"""A corpus pipeline: stages over documents, each written as Parquet and read again by the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlake.llm import decontaminate, langid, mixing, neardup, pii
from lumenlake.llm.common import Scratch, cut


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that the labels name.

    Those without letters go (null and empty texts among them), and those whose cost a symbol is beyond what held-back rows of their best language
    have. Very long texts are judged whole; repeated rows and ties alike. An empty table gives an empty one.
    """
    return langid.keep_identified(docs, langid.learn(docs, F.lit(True)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each class of near duplicates; null ids and texts without words are classes of their own, unless rows are equal."""
    return neardup.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null and empty texts hold none, very long ones are searched whole, and null or empty items are in none."""
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind; null texts stay null, and n_chars follows what changed."""
    return pii.redact_pii(docs)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, with taken, the words it takes of each; null and empty texts have no words, and so no part."""
    quality = mixing.quality_weights(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return mixing.mix(docs, docs.columns, quality=quality).where("taken > 0")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", language),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("PII", personal_data),
    ("mixing sources to target weights", mixing_sources),
]

#: Cross-parsing, Bayesian pruning and personal data have no SQL form; tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with Scratch(spark, "pipeline") as scratch:
        for name, stage in STAGES[:-2]:
            docs = scratch(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        name, stage = STAGES[-2]
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))  # the result reads this one
    return STAGES[-1][1](spark, docs, sf_dir)
