"""From raw documents to packed training sequences, in five stages.

Each stage takes all documents that its predecessor kept and returns the
columns of `documents`; the last one returns pieces of packed sequences.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm import langid, line_runs, packing, quality_zstd, word_sets
from pagewright.llm.common import table
from pagewright.session import ensure_checkpoint_dir


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go. It is fitted on the labelled training fold of `docs`."""
    return quality_zstd.keep_good(docs, quality_zstd.fit(docs, table(spark, sf_dir, "labels")))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in none of the known languages go."""
    return langid.keep_known(docs, langid.fit(docs))


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated runs of lines leave the texts; n_chars follows. Every document stays."""
    shorter = line_runs.delete_repeated_runs(docs)
    if "n_chars" in docs.columns:
        shorter = shorter.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return shorter.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the least id.

    Near means 0.8 or more of the five-word shingles in common; the two bits of op5 are that query's contract."""
    return word_sets.keep_one(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts as pieces of sequences of one length."""
    return packing.pack(docs)


STAGES = [("quality", quality), ("language", language), ("line dedup", repeated_lines), ("near-dedup", near_duplicates), ("packing", packed)]

# Model fits, compression, tokenization and near-duplicate components have no SQL form; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over `documents`. What a stage keeps is written to the shared
    checkpoint folder and read again, so a later stage never repeats an earlier one."""
    folder = f"{ensure_checkpoint_dir(spark)}/corpus-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return STAGES[-1][1](spark, docs, sf_dir)
