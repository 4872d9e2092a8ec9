"""Global order, fixed-size batches and collation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from pentarank.operators.candidates import shuffle_key
from pentarank.schemas import SHUFFLE_SEED
from pentarank.session import materialise

_ROW_BITS = 33  # monotonically_increasing_id keeps the partition above this many bits


def row_index(keys: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """Number rows 0..n-1 in ``order`` without sorting in one task.

    Rows are range-partitioned and sorted, stored once (range bounds are sampled, so a
    second evaluation could cut elsewhere), and each partition is shifted by the rows
    before it. The table of shifts has one row per partition, which bounds both the
    window over it and its broadcast. Pass narrow rows: keys only.
    """
    ranged = keys.repartitionByRange(*order).sortWithinPartitions(*order)
    spot = F.monotonically_increasing_id()
    placed = materialise(
        ranged.withColumns(
            {
                "_part": F.shiftright(spot, _ROW_BITS),
                "_row": spot.bitwiseAND(F.lit((1 << _ROW_BITS) - 1)),
            }
        )
    )
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        placed.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    )
    numbered = placed.join(F.broadcast(shifts), "_part")
    return numbered.withColumn("row_index", F.col("_before") + F.col("_row")).drop(
        "_part", "_row", "_before"
    )


def assign_batches(
    df: DataFrame,
    id_col: str,
    batch_size: int,
    shuffle: bool = True,
    seed: int = SHUFFLE_SEED,
) -> DataFrame:
    """``(id, row_index, batch_id, slot)`` for each row, ids being unique.

    Training order is a seeded shuffle, test order is by id. All batches but the last
    hold exactly ``batch_size`` rows. Join the result on the id to batch wide rows. Runs a
    job at once: the sorted keys are stored before they are numbered.
    """
    if shuffle:
        keys = df.select(id_col, shuffle_key(seed, F.col(id_col)).alias("_key"))
        numbered = row_index(keys, ["_key", id_col]).drop("_key")
    else:
        numbered = row_index(df.select(id_col), [id_col])
    return numbered.withColumns(
        {
            "batch_id": F.expr(f"row_index div {int(batch_size)}"),
            "slot": (F.col("row_index") % batch_size).cast("int"),
        }
    )


def limit_batches(batches: DataFrame, count: int | None) -> DataFrame:
    """The first ``count`` batches; ``None`` keeps all."""
    return batches if count is None else batches.filter(F.col("batch_id") < count)


def collate_batches(
    rows: DataFrame,
    stack: Sequence[str],
    flatten: Sequence[str] = (),
    batch_col: str = "batch_id",
    slot_col: str = "slot",
) -> DataFrame:
    """One row per batch: columns of ``stack`` as arrays in slot order, columns of
    ``flatten`` (arrays themselves) joined end to end.

    Batches come from ``assign_batches``, so a collated row holds at most one batch; with
    pictures that may still be hundreds of megabytes, so choose the batch size by it. Wide
    rows move once, by batch: join them to the narrow batch numbers where they are.
    """
    fields = F.struct(slot_col, *stack, *flatten)
    batches = rows.groupBy(batch_col).agg(F.sort_array(F.collect_list(fields)).alias("_rows"))
    return batches.select(
        batch_col,
        F.size("_rows").alias("batch_rows"),
        *[F.col("_rows")[c].alias(c) for c in stack],
        *[F.flatten(F.col("_rows")[c]).alias(c) for c in flatten],
    )


def token_length_profile(
    df: DataFrame,
    tokens: Column,
    by: Sequence[str] = (),
    percentiles: Sequence[float] = (0.5, 0.95),
) -> DataFrame:
    """Longest and typical token counts, untruncated.

    Percentiles are exact; their state is one counter per distinct length.
    """
    lengths = df.select(*by, F.size(tokens).alias("_n"))
    marks = [
        F.percentile("_n", F.lit(p)).alias(f"p{round(p * 100)}_tokens") for p in percentiles
    ]
    return lengths.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"), F.max("_n").alias("max_tokens"), *marks
    )
