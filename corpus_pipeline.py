"""Cleaning of documents for training, in five stages.

Each stage takes the documents its predecessor kept and calls one operator of
inferframe.llm; all but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inferframe.llm import near_dup
from inferframe.llm.decontaminate import decontaminate
from inferframe.llm.langid import identify_languages
from inferframe.llm.line_dedup import line_dedup
from inferframe.llm.queries import bpe_columns
from inferframe.llm.shared import new_folder

#: Columns of documents; any others pass under names of their own.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def guarded(stage: Stage) -> Stage:
    """A stage that no name of an extra column can disturb; one that the stage itself makes is replaced."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        aside = {c: f"extra{i}" for i, c in enumerate(docs.columns) if c not in COLUMNS}
        out = stage(spark, docs.withColumnsRenamed(aside), sf_dir)
        back = {a: c for c, a in aside.items() if a in out.columns and c not in out.columns}
        return out.drop(*(a for a in aside.values() if a not in back)).withColumnsRenamed(back)

    return run


@guarded
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no known language go.

    The verdict depends on text, declared language and host: a row goes by these and its id, so
    others with the same id, or with none, aren't touched.
    """
    row = F.struct(F.col("doc_id").alias("a"), F.xxhash64("text").alias("b"), F.col("lang").alias("c"), F.col("source").alias("d"))
    judged = identify_languages(docs.withColumn("row", row), id_col="row", declared=F.col("lang"), host=F.col("source"))
    gone = judged.where("rejected").select(F.col("id").alias("gone")).distinct()
    return docs.join(gone, row.eqNullSafe(F.col("gone")), "left_anti")


@guarded
def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share go, but for one; the documents stay."""
    return line_dedup(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


@guarded
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: five-word shingles, Jaccard similarity of 0.8 or more."""
    return near_dup.near_dedup(docs, shingle=5, similarity=0.8).select(*docs.columns)


@guarded
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that benchmark passages make up a twentieth of go."""
    marked = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return marked.where(~F.col("contaminated")).select(*docs.columns)


@guarded
def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and the decoded bytes."""
    return bpe_columns(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("byte_level_bpe", tokenize),
]

#: SQL has no XXH64, and no merges of a vocabulary: a test holds the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = new_folder(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
