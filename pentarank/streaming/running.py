"""Metrics that follow arriving batches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from pentarank.functions import vectors
from pentarank.operators.metrics import Metric, evaluate, perplexity


def running_metrics(
    stream: DataFrame, metrics: Sequence[Metric], by: Sequence[str] = ()
) -> DataFrame:
    """Metrics of everything seen so far, for ``update`` or ``complete`` output.

    State is two sums per metric and group.
    """
    return evaluate(stream, metrics, by)


def accumulate_perplexity(
    tokens: DataFrame,
    target: str,
    checkpoint: str,
    by: Sequence[str] = (),
    seq_col: str = "seq_id",
) -> StreamingQuery:
    """Store each sequence's log-probability sum and count per micro-batch.

    A sequence may arrive in any number of batches; its sums meet when they are read. A
    replayed batch overwrites its own sums.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        scored = batch.select(*by, seq_col, vectors.target_log_prob("logits", "target").alias("_log_prob"))
        sums = scored.groupBy(*by, seq_col).agg(
            F.coalesce(F.sum("_log_prob"), F.lit(0.0)).alias("total"), F.count("_log_prob").alias("n_tokens")
        )
        sums.write.mode("overwrite").parquet(f"{target}/batch_id={batch_id}")

    return (
        tokens.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def accumulated_perplexity(
    spark: SparkSession,
    target: str,
    by: Sequence[str] = (),
    seq_col: str = "seq_id",
    skip_empty: bool = False,
) -> DataFrame:
    """Perplexity over all stored batches: sums merge by sequence before the mean over sequences.

    A fully padded sequence makes it NaN unless ``skip_empty``.
    """
    merged = spark.read.parquet(target).groupBy(*by, seq_col).agg(
        F.sum("total").alias("total"), F.sum("n_tokens").alias("n_tokens")
    )
    if skip_empty:
        merged = merged.filter("n_tokens > 0")
    mean = F.coalesce(F.try_divide("total", "n_tokens"), F.lit(float("nan")))
    return evaluate(merged.withColumn("mean_log_prob", mean), [perplexity()], by)
