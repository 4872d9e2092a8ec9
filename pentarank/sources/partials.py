"""Partial sums of metrics, stored by run and batch so that replaying a batch changes nothing.

    path/sums/run_id=../batch_id=..    (metric, total, weight) of one batch
    path/resets/                       (run_id, up_to): batches up to this one no longer count
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from pentarank.operators.metrics import Metric, merge_partials

SUMS = "metric string, total double, weight double, run_id string, batch_id long"
RESETS = "run_id string, up_to long"


def upsert_partials(parts: DataFrame, path: str) -> None:
    """Store ``(run_id, batch_id, metric, total, weight)``; batches that are there already are replaced as a whole.

    Only the folders of the batches in ``parts`` are touched.
    """
    stored = parts.select(*[F.col(f.name).cast(f.dataType) for f in _fields(parts.sparkSession, SUMS)])
    # A batch is one small folder: its rows go to one file.
    dealt = stored.repartition("run_id", "batch_id")
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id", "batch_id").parquet(f"{path}/sums")


def reset(spark: SparkSession, path: str, run_id: str, up_to: int | None = None) -> None:
    """Forget batches of a run, up to a number or all that are stored; nothing is deleted or rewritten."""
    if up_to is None:
        up_to = read_all(spark, path).filter(F.col("run_id") == run_id).agg(F.max("batch_id")).first()[0]
    if up_to is not None:
        spark.range(1).select(F.lit(run_id).alias("run_id"), F.lit(up_to).cast("long").alias("up_to")).write.mode("append").parquet(f"{path}/resets")


def _fields(spark: SparkSession, ddl: str):
    return spark.createDataFrame([], ddl).schema


def _stored(spark: SparkSession, folder: str, ddl: str) -> DataFrame:
    try:
        return spark.read.schema(ddl).parquet(folder)
    except AnalysisException as problem:
        if "PATH_NOT_FOUND" not in str(problem):
            raise
        return spark.createDataFrame([], ddl)


def read_all(spark: SparkSession, path: str) -> DataFrame:
    """Sums of all batches, forgotten ones too."""
    return _stored(spark, f"{path}/sums", SUMS)


def read_partials(spark: SparkSession, path: str) -> DataFrame:
    """Sums of the batches that count: those after the last reset of their run."""
    gone = _stored(spark, f"{path}/resets", RESETS).groupBy("run_id").agg(F.max("up_to").alias("up_to"))
    kept = read_all(spark, path).join(gone, "run_id", "left")
    return kept.filter(F.col("up_to").isNull() | (F.col("batch_id") > F.col("up_to"))).drop("up_to")


def stored_metrics(spark: SparkSession, path: str, metrics: Sequence[Metric]) -> DataFrame:
    """``(run_id, metric, value)`` over the batches that count."""
    return merge_partials(read_partials(spark, path), metrics, ["run_id"])
