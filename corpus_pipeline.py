"""From documents to token files: language, near-duplicates, benchmark passages, mixture, ids.

Every stage takes ``(spark, docs, sf_dir)`` and works on all that the stage before kept.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeglass.llm import decontaminate, language_id, minhash_dedup, mixing, token_files
from lakeglass.llm.settings import NEAR_PERCENT, TARGETS, TOKENIZER
from lakeglass.llm.shared import learns, rows_of, written
from lakeglass.runtime import scratch_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Bytes of rows that Spark gives to Python at once. Whole texts reach its own bound of 64 MB or 10,000 rows, and each task holds a batch
#: several times, as do workers that wait for the next stage.
BATCH_BYTES = 2 << 20


def in_small_batches(stage: Stage) -> Stage:
    """``stage`` in a session that bounds batches by ``BATCH_BYTES``; all rows still arrive."""

    @functools.wraps(stage)
    def bounded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
        return stage(spark, docs, sf_dir)

    return bounded


@in_small_batches
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in some language. Those without letters, and those unlike all languages learned, go; if none could be learned, all stay."""
    lessons = docs.where(learns(F.col("doc_id")))
    model = language_id.fit(lessons)
    if not model.languages:
        return docs
    return language_id.in_some_language(docs, model, language_id.least_scores(lessons, model))


@in_small_batches
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest id."""
    return minhash_dedup.dedup(docs, percent=NEAR_PERCENT)


@in_small_batches
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@in_small_batches
def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each document as its rate asks for. With the targets' default total every document stays."""
    labelled = rows_of(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").select("text", F.col("lang").alias("domain"))
    return mixing.repeated(docs, labelled, TARGETS)


@in_small_batches
def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as they stand in the token files."""
    path = scratch_path(spark, "tokens")
    token_files.write_tokens(docs, path, TOKENIZER)
    return token_files.read_tokens(spark, path, with_ids=False)


STAGES = [
    ("language_id", identify_language),
    ("minhash_near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_domains),
    ("token_files", write_tokens),
]

#: Learned languages and fitted rates have no SQL form; tests compare the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs, _ = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
