"""Corpus pipeline: from raw documents to packed training sequences.

Each stage applies one operator of ``pentarank.llm`` to all that its predecessor kept. Stages
read and write Parquet, so a lost executor costs at most the stage that runs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pentarank.llm import decontaminate, packing, quality, secrets, simhash
from pentarank.llm.common import fresh_folder, table
from pentarank.llm.queries import training_rows

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
TOKENIZER = "word_bpe_49k.json"


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It learns as the operator's query does."""
    labelled = training_rows(docs, table(spark, sf_dir, "labels"))
    return quality.classify(docs, labelled, threshold=0.7).filter("predicted = 1").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, the one with the smallest id."""
    return simhash.keep_one(docs, shingle=3, distance=3).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def secret_masking(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; every document stays, with the length of its new text."""
    clean = secrets.redact(docs, secrets.train(secrets.corpus_samples(docs)))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in the sequences."""
    return packing.pack_documents(docs, public_tokenizers.path(TOKENIZER), room=4096, end_id=2)


STAGES = [
    ("quality classifier", quality_filter),
    ("simhash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_masking),
    ("packing", pack),
]

# A trained classifier and a tokenizer have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        folder = fresh_folder(spark, f"pipeline-{k}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
