"""Reshaping and shuffling the five candidates of a record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pentarank.functions.arrays import let
from pentarank.schemas import (
    CANDIDATE_NUMBERS,
    IMAGE_COLUMNS,
    PROMPT_COLUMNS,
    SHUFFLE_SEED,
)


def candidates_long(records: DataFrame, id_col: str = "id") -> DataFrame:
    """One row ``(id, idx, prompt, image)`` per candidate, ``idx`` being 1-based."""
    rows = [
        F.struct(F.lit(i).alias("idx"), F.col(p).alias("prompt"), F.col(m).alias("image"))
        for i, p, m in zip(CANDIDATE_NUMBERS, PROMPT_COLUMNS, IMAGE_COLUMNS)
    ]
    return records.select(id_col, F.inline(F.array(*rows)))


def shuffle_key(seed: int, *parts: Column) -> Column:
    return F.md5(F.concat_ws("-", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def shuffled_order(id_col: str = "id", seed: int = SHUFFLE_SEED) -> Column:
    """Original candidate numbers in a random order that depends on seed and id only."""
    keyed = F.array(
        *[
            F.struct(shuffle_key(seed, F.col(id_col), F.lit(i)).alias("key"), F.lit(i).alias("idx"))
            for i in CANDIDATE_NUMBERS
        ]
    )
    return F.transform(F.sort_array(keyed), lambda c: c["idx"])


def correct_position(order: Column | str) -> Column:
    """1-based place of original candidate 1, the right one."""
    return F.array_position(order, F.lit(1)).cast("int")


def shuffle_candidates(
    records: DataFrame, id_col: str = "id", seed: int = SHUFFLE_SEED
) -> DataFrame:
    """Reorder the candidates of each record and note where the right one went.

    Adds ``candidate_order`` and ``correct_image``. Only candidate numbers are sorted;
    descriptions and images are picked by number within the row, without a shuffle.
    """
    ordered = records.withColumn("candidate_order", shuffled_order(id_col, seed))
    picked: dict[str, Column] = {"correct_image": correct_position("candidate_order")}
    for columns in (PROMPT_COLUMNS, IMAGE_COLUMNS):
        pool = F.array(*[F.col(c) for c in columns])
        for place, name in enumerate(columns):
            picked[name] = F.get(pool, F.col("candidate_order")[place] - 1)
    return ordered.withColumns(picked)


def candidates_shuffled(
    records: DataFrame, id_col: str = "id", seed: int = SHUFFLE_SEED
) -> DataFrame:
    """Long form of the shuffled candidates: ``(id, pos, idx, prompt, image)``."""
    prompts = F.array(*[F.col(c) for c in PROMPT_COLUMNS])
    images = F.array(*[F.col(c) for c in IMAGE_COLUMNS])
    placed = records.select(
        id_col,
        prompts.alias("prompts"),
        images.alias("images"),
        F.posexplode(shuffled_order(id_col, seed)).alias("place", "idx"),
    )
    return placed.select(
        id_col,
        (F.col("place") + 1).alias("pos"),
        "idx",
        F.get("prompts", F.col("idx") - 1).alias("prompt"),
        F.get("images", F.col("idx") - 1).alias("image"),
    )


def candidates_wide(long: DataFrame, id_col: str = "id", pos_col: str = "pos") -> DataFrame:
    """Long candidates back to numbered columns in ``pos`` order.

    A pivot by hand: each place keeps one whole candidate, so partial aggregation holds at
    most five per record. Two candidates at one place raise; an empty place is NULL.
    """
    candidate = F.struct("prompt", "image", "idx")
    slots = _places(pos_col, candidate, len(CANDIDATE_NUMBERS), first=1)
    placed = long.groupBy(id_col).agg(*[s.alias(f"_{i}") for i, s in enumerate(slots, 1)])
    correct = F.coalesce(*[F.when(F.col(f"_{i}.idx") == 1, F.lit(i)) for i in CANDIDATE_NUMBERS])
    return placed.select(
        id_col,
        correct.cast("int").alias("correct_image"),
        *[F.col(f"_{i}.prompt").alias(p) for i, p in zip(CANDIDATE_NUMBERS, PROMPT_COLUMNS)],
        *[F.col(f"_{i}.image").alias(m) for i, m in zip(CANDIDATE_NUMBERS, IMAGE_COLUMNS)],
    )


def _places(pos_col: str, value: Column, count: int, first: int) -> list[Column]:
    """One aggregate per place: its only value. A place outside the range, or taken twice, raises."""
    pos = F.col(pos_col)
    known = F.count_if(~F.coalesce(pos.between(first, first + count - 1), F.lit(False))) == 0
    outside = F.raise_error(F.lit("candidate position out of range"))
    twice = F.raise_error(F.lit("two candidates at one position"))
    slots = []
    for i in range(first, first + count):
        here = pos == i
        only = F.when(F.count_if(here) > 1, twice).otherwise(F.max(F.when(here, value)))
        slots.append(F.when(known, only).otherwise(outside))
    return slots


def stack_candidates(
    long: DataFrame,
    group_col: str,
    pos_col: str,
    value_col: str,
    count: int,
    alias: str = "values",
) -> DataFrame:
    """Long ``(group, pos, value)`` rows to one array per group, ``pos`` from 0.

    ``count`` bounds the array; a position outside it, or taken twice, raises. A missing
    place is NULL, so values keep their positions; places after the last are cut off.
    """
    slots = F.array(*_places(pos_col, F.col(value_col), count, first=0))
    stacked = long.groupBy(group_col).agg(slots.alias("_slots"), F.max(pos_col).alias("_last"))
    return stacked.select(group_col, F.slice("_slots", F.lit(1), F.col("_last") + 1).alias(alias))
