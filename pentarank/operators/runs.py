"""Metric logs and comparing runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def metric_log(
    wide: DataFrame, metrics: Sequence[str], keys: Sequence[str] = ("run_id", "split", "epoch")
) -> DataFrame:
    """Wide metric columns to ``(keys, metric, value)`` rows."""
    numbers = wide.select(*keys, *[F.col(m).cast("double").alias(m) for m in metrics])
    return numbers.unpivot(list(keys), list(metrics), "metric", "value")


def epoch_loss(
    steps: DataFrame, loss: str = "loss", keys: Sequence[str] = ("run_id", "epoch")
) -> DataFrame:
    """Mean of the losses logged in each epoch, with the number of steps."""
    return steps.groupBy(*keys).agg(
        F.avg(loss).alias("epoch_loss"), F.count(loss).alias("steps")
    )


def compare_runs(
    log: DataFrame, before: str, after: str, keys: Sequence[str] = ("split", "metric")
) -> DataFrame:
    """Metric values of two runs next to each other and their difference.

    A metric logged several times in a run counts with its mean.
    """
    value = F.col("value")
    both = log.filter(F.col("run_id").isin(before, after))
    sides = both.groupBy(*keys).agg(
        F.avg(F.when(F.col("run_id") == before, value)).alias("before"),
        F.avg(F.when(F.col("run_id") == after, value)).alias("after"),
    )
    return sides.withColumn("change", F.col("after") - F.col("before"))
