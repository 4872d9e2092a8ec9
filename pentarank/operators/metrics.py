"""Evaluation metrics as mergeable ratios.

Each metric is ``finish(sum(term) / sum(weight))`` over rows. One aggregation serves any
number of metrics, its state is two numbers per metric and group whatever the input, and
partial sums per batch merge to the same value in any split.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from pentarank.functions import vectors
from pentarank.functions.arrays import as_column, total
from pentarank.schemas import IGNORE_INDEX, NO_IMAGE, SIMILARITY_WEIGHTS


@dataclass(frozen=True)
class Metric:
    name: str
    term: Column
    weight: Column
    finish: Callable[[Column], Column] = lambda ratio: ratio

    def value(self, totals: Column, weights: Column) -> Column:
        return self.finish(F.try_divide(totals, weights))


def evaluate(df: DataFrame, metrics: Sequence[Metric], by: Sequence[str] = ()) -> DataFrame:
    """All metrics in one pass: one row, or one row per group."""
    columns = [m.value(F.sum(m.term), F.sum(m.weight)).alias(m.name) for m in metrics]
    return df.groupBy(*by).agg(*columns)


def partials(df: DataFrame, metrics: Sequence[Metric], by: Sequence[str] = ()) -> DataFrame:
    """Accumulated ``(metric, total, weight)`` rows per group."""
    sums = [
        F.struct(
            F.lit(m.name).alias("metric"),
            F.coalesce(F.sum(m.term), F.lit(0.0)).alias("total"),
            F.coalesce(F.sum(m.weight), F.lit(0.0)).alias("weight"),
        )
        for m in metrics
    ]
    wide = df.groupBy(*by).agg(F.array(*sums).alias("_sums"))
    return wide.select(*by, F.inline("_sums"))


def merge_partials(
    parts: DataFrame, metrics: Sequence[Metric], by: Sequence[str] = ()
) -> DataFrame:
    """Metric values ``(metric, value)`` from accumulated partial sums."""
    merged = parts.groupBy(*by, "metric").agg(
        F.sum("total").alias("total"), F.sum("weight").alias("weight")
    )
    return merged.select(*by, "metric", finished_value(metrics).alias("value"))


def finished_value(metrics: Sequence[Metric]) -> Column:
    """Value of a ``(metric, total, weight)`` row."""
    choices = [
        F.when(F.col("metric") == m.name, m.value(F.col("total"), F.col("weight")))
        for m in metrics
    ]
    return F.coalesce(*choices)


def top_image_accuracy(
    scores: Column | str = "scores",
    label: Column | int = 1,
    name: str = "top_image_accuracy",
) -> Metric:
    """Share of rows whose best candidate is ``label`` (0-based).

    The default of 1 is the second candidate. Data stored best first wants ``label=0``.
    """
    top = vectors.argmax(scores)
    label = label if isinstance(label, Column) else F.lit(label)
    hit = (top == label).cast("double")
    return Metric(name, hit, hit.isNotNull().cast("double"))


def spearman(
    scores: Column | str = "scores",
    gold: Column | str | Sequence[int] | None = None,
    method: str = "permutation",
    name: str = "spearman",
) -> Metric:
    """Mean rank correlation; rows with fewer than two candidates have none."""
    rho = vectors.spearman(scores, gold, method)
    return Metric(name, rho, rho.isNotNull().cast("double"))


def pairwise_loss(
    scores: Column | str = "scores",
    weights: Sequence[float] | None = SIMILARITY_WEIGHTS,
    name: str = "pairwise_loss",
) -> Metric:
    """Mean ranking loss over the neighbouring pairs of all rows that have a loss.

    A pair with a NULL score has none: it counts neither above nor below.
    """
    losses = F.array_compact(vectors.pairwise_losses(scores, weights))
    return Metric(name, total(losses), F.size(losses).cast("double"))


def perplexity(
    mean_log_prob: Column | str = "mean_log_prob", name: str = "perplexity"
) -> Metric:
    """``exp(-mean)`` over sequences of their mean log-probability, not token-weighted."""
    mean = as_column(mean_log_prob)
    return Metric(name, mean, mean.isNotNull().cast("double"), lambda m: F.exp(-m))


def mean(value: Column | str, name: str = "mean") -> Metric:
    value = as_column(value).cast("double")
    return Metric(name, value, value.isNotNull().cast("double"))


def generation_accuracy(
    predicted: Column | str = "pred_image",
    label: Column | str = "label_image",
    name: str = "generation_accuracy",
) -> Metric:
    """Share of matching image numbers, leaving out rows where both sides are -1.

    0.0 when no row is left.
    """
    predicted, label = as_column(predicted), as_column(label)
    valid = valid_case(predicted, label).cast("double")
    hit = (predicted == label) & ~F.isnan(predicted.cast("double"))
    return Metric(
        name, hit.cast("double") * valid, valid, lambda r: F.coalesce(r, F.lit(0.0))
    )


def valid_case(predicted: Column | str, label: Column | str) -> Column:
    return ~((as_column(predicted) == NO_IMAGE) & (as_column(label) == NO_IMAGE))


def shift_targets(
    tokens: DataFrame,
    seq_col: str = "seq_id",
    pos_col: str = "pos",
    target_col: str = "target",
) -> DataFrame:
    """Give each position the target of the next one; the last position goes.

    Positions of a sequence count from 0; a gap raises, as no target would be right there.
    The join is on ``(sequence, position)``, so one very long sequence still spreads over all
    tasks, and the moved side is narrow. Sequences stored in one row each need no exchange
    at all: ``vectors.mean_log_prob(shift=True)``.
    """
    following = tokens.select(
        F.col(seq_col),
        (F.col(pos_col) - 1).alias(pos_col),
        F.col(target_col).alias(target_col),
        F.lit(True).alias("_next"),
    )
    moved = tokens.drop(target_col).withColumn("_here", F.lit(True)).join(following, [seq_col, pos_col], "full")
    # What follows no row is the first of its sequence, or stands after a gap.
    gap = F.raise_error(F.lit("positions of a sequence are not dense")).cast("boolean")
    first = F.when(F.col(pos_col) >= 0, gap).otherwise(F.lit(False))
    paired = F.when(F.col("_here").isNull(), first).otherwise(F.col("_next").isNotNull())
    return moved.filter(paired).drop("_next", "_here")


def sequence_log_probs(
    tokens: DataFrame,
    seq_col: str = "seq_id",
    logits_col: str = "logits",
    target_col: str = "target",
    by: Sequence[str] = (),
    skip_empty: bool = False,
) -> DataFrame:
    """Mean log-probability of each sequence over its unpadded positions.

    A fully padded sequence yields NaN, which makes the whole perplexity NaN, unless
    ``skip_empty``.
    """
    scored = tokens.select(
        *by,
        seq_col,
        vectors.target_log_prob(logits_col, target_col, IGNORE_INDEX).alias("_log_prob"),
    )
    means = scored.groupBy(*by, seq_col).agg(F.avg("_log_prob").alias("mean_log_prob"))
    if skip_empty:
        return means.filter(F.col("mean_log_prob").isNotNull())
    return means.fillna(float("nan"), subset=["mean_log_prob"])
