"""Token counts through a digest cache.

The cache is a Parquet table of ``(tokenizer, digest, n_tokens)``, partitioned by the digest
of the tokenizer file. A text's digest is joined to it; only distinct texts without a stored
count are encoded, once each, and appended.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from pentarank.llm.common import cut
from pentarank.llm.vocabulary import counter, file_digest

CACHE_SCHEMA = "digest binary, n_tokens long, tokenizer string"


def read_cache(spark, cache_path: str, version: str) -> DataFrame:
    """Stored counts of one tokenizer version; empty where there is no cache yet."""
    try:
        stored = spark.read.schema(CACHE_SCHEMA).parquet(cache_path)
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        stored = spark.createDataFrame([], CACHE_SCHEMA)
    # Two runs may append the same text; both count alike.
    return stored.filter(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(
    docs: DataFrame,
    tokenizer_path: str,
    cache_path: str,
    limit: int = 4096,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``(id, n_bytes, n_tokens, over_limit)`` of every row; appends to the cache at ``cache_path``.

    A text is normalised by reading NULL as empty and nothing else, as the count must be that
    of the text as it stands. ``tokenizer_path`` must name the file on every machine. Repeated
    rows are all returned and encoded once; other columns are ignored. The largest shuffle
    moves the texts that are missing, once each. Runs a job while it builds the result; a run
    that is lost before its append has finished leaves the cache as it was.
    """
    spark = docs.sparkSession
    version = file_digest(tokenizer_path)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).select(
        "id", "text", F.octet_length("text").cast("long").alias("n_bytes"), F.unhex(F.sha2("text", 256)).alias("digest")
    )
    # One row stands for each distinct text that has no count; its text moves, copies' do not.
    first = F.min(F.struct("n_bytes", "id")).alias("first")
    missing = (
        rows.groupBy("digest").agg(first)
        .join(read_cache(spark, cache_path, version), "digest", "left_anti")
        .select(F.col("digest").alias("d"), F.col("first.id").alias("i"))
    )
    texts = rows.select("digest", "id", "text").join(
        missing.hint("shuffle_hash"), (F.col("digest") == F.col("d")) & F.col("id").eqNullSafe(F.col("i")), "left_semi"
    )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, seen = counter(tokenizer_path).counts, set()
        for batch in batches:
            # Rows that repeat both id and text meet in this partition.
            fresh = []
            for k, digest in enumerate(batch.column(0).to_pylist()):
                if digest not in seen:
                    seen.add(digest)
                    fresh.append(k)
            once = batch.take(pa.array(fresh, pa.int64()))
            counts = count(x.as_py() for x in once.column(1))
            yield pa.RecordBatch.from_arrays([once.column(0), pa.array(counts, pa.int64())], ["digest", "n_tokens"])

    counted = texts.select("digest", "text").mapInArrow(encode, "digest binary, n_tokens long")
    counted.withColumn("tokenizer", F.lit(version)).write.mode("append").partitionBy("tokenizer").parquet(cache_path)

    # Written out, so that the last join reads plain exchanges, which can be split at a hot digest.
    stored = cut(read_cache(spark, cache_path, version))
    return rows.select("id", "n_bytes", "digest").join(stored, "digest").select(
        F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
