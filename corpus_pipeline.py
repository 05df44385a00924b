"""A training-data pipeline over the documents table, from raw texts to packed sequences.

Every stage decides about rows, not ids: null ids, repeated ids with different texts and
repeated rows are documents of their own. A stage reads a written table, so that what it
reads twice is the same both times. An empty table goes through as one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sectionmill.llm import dartminhash, langid, line_spread, mixing, packing
from sectionmill.llm.scratch import materialise

#: A prediction less sure than this is a rejection; with four languages a guess has 0.25.
LEAST_SCORE = 0.4
BUDGET = 0.8
#: Characters of words that packing's workers remember; they share executors with what other stages leave in memory.
REMEMBERED = 5_000_000


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without letters (null and empty ones too) and those that the model can't tell at all."""
    told = langid.identify(docs)
    return told.where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_SCORE)).select(docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take out cross-site boilerplate; a document of nothing else goes. Equal rows stay equal; one
    of which nothing is taken stays as it is, a null or empty text too."""
    cleaned = line_spread.remove_boilerplate(docs)
    left = cleaned.where((F.col("n_removed") == 0) | (F.trim(F.col("text"), F.lit(" \t\r\n")) != ""))
    return left.withColumn("n_chars", F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(docs.columns)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each near-duplicate class, of equal rows too; rows with null texts all stay."""
    return dartminhash.deduplicated(docs).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mix to the target weights within one epoch: each row at most once. Rows without tokens go;
    null languages and sources are leaves of their own."""
    return mixing.mixed(docs, budget=BUDGET, max_epochs=1).select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences, each row for itself."""
    return packing.pack(docs, remembered=REMEMBERED)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("minhash_near_dedup", dedup_documents),
    ("mix_sources", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: Learned language models, sketches and tokenizers can't be put in SQL; tests/llm/test_pipeline.py holds the stages to plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
