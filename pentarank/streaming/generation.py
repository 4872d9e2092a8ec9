"""Resumable generation: snapshots per micro-batch and a ledger of failures."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from pentarank.functions import prompts
from pentarank.operators.generation import Generator, generate_sft
from pentarank.schemas import MAP_BATCH, SHUFFLE_SEED, base_schema

_OK, _FAILED = "ok", "failed"


def run_generation(
    spark: SparkSession,
    source: str,
    target: str,
    checkpoint: str,
    make_generator: Callable[[], Generator],
    schema: T.StructType | None = None,
    template: str = prompts.GENERATION_TEMPLATE,
    seed: int = SHUFFLE_SEED,
    batch_size: int = MAP_BATCH,
    files_per_snapshot: int = 10,
    num_partitions: int | None = None,
    retry: DataFrame | None = None,
    pattern: str = "*.parquet",
    on_snapshot: Callable[[int], None] | None = None,
) -> StreamingQuery:
    """Generate answers for record files that have arrived since the last run, then stop.

    Each micro-batch is one snapshot. It is written in one pass into the folder of its
    batch number, so a replayed batch replaces its own output and nothing is written
    twice; what earlier batches stored survives any later failure. With ``retry`` only
    records on that list are sent to the generator. ``pattern`` names the files that count;
    ``on_snapshot`` is told the number of each batch that has been stored.
    """
    records = (
        spark.readStream.schema(schema or base_schema())
        .option("maxFilesPerTrigger", files_per_snapshot)
        .option("pathGlobFilter", pattern)
        .parquet(source)
    )

    def snapshot(batch: DataFrame, batch_id: int) -> None:
        wanted = batch if retry is None else batch.join(retry.select("id"), "id", "left_semi")
        outcomes = generate_sft(
            wanted, make_generator, template, seed, batch_size, num_partitions
        )
        status = F.when(F.col("error").isNull(), _OK).otherwise(_FAILED)
        (
            outcomes.withColumn("status", status)
            .write.mode("overwrite")
            .partitionBy("status")
            .parquet(f"{target}/batch_id={batch_id}")
        )
        if on_snapshot is not None:
            on_snapshot(batch_id)

    return (
        records.writeStream.foreachBatch(snapshot)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _outcomes(spark: SparkSession, target: str, status: str) -> DataFrame:
    stored = spark.read.parquet(target).filter(F.col("status") == status)
    return stored.drop("status", "batch_id")


def all_outcomes(spark: SparkSession, target: str) -> DataFrame:
    """Successes and failures of all snapshots, with ``error`` telling them apart."""
    return spark.read.parquet(target).drop("status", "batch_id")


def generated_records(spark: SparkSession, target: str) -> DataFrame:
    """Successes of all snapshots; only their folders are read."""
    return _outcomes(spark, target, _OK).drop("error")


def failed_ids(spark: SparkSession, target: str) -> DataFrame:
    """Failures of all snapshots: ``(id, error)``."""
    return _outcomes(spark, target, _FAILED).select("id", "error")
