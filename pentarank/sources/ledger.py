"""The list of ids whose generation failed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def read_id_array(spark: SparkSession, path: str) -> DataFrame:
    """Ids of files that are one JSON array of integers each, the form older runs left behind.

    Files are read comma by comma, so a huge array is split among tasks like any text and no value
    holds more than one id. Anything but an integer between the commas, an object for
    example, raises instead of counting as an empty list.
    """
    parts = spark.read.option("lineSep", ",").text(path).select(F.regexp_replace("value", r"^\s*\[|\]\s*$", "").alias("part"))
    whole = F.trim(F.regexp_replace("part", r"[\s]+", " "))
    number = F.when(whole.rlike("^-?[0-9]+$"), whole.cast("int")).otherwise(
        F.raise_error(F.concat(F.lit("not an integer in the list of failed ids: "), whole)).cast("int")
    )
    return parts.filter(whole != "").select(number.alias("id"))


def write_failed(failed: DataFrame, path: str, id_col: str = "id") -> None:
    """JSON lines ``{"id": ..}``, which many tasks can write and read at once."""
    failed.select(F.col(id_col).cast("int").alias("id")).write.json(path)


def read_failed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id int").json(path)


EVENTS = "id long, attempt long, error string"


def append_events(outcomes: DataFrame, path: str, attempt: Column | int, id_col: str = "id", error_col: str = "error") -> None:
    """Log what became of each id in an attempt; ``error`` is NULL for a success. Nothing is ever rewritten."""
    attempt = attempt if isinstance(attempt, Column) else F.lit(attempt)
    events = outcomes.select(F.col(id_col).cast("long").alias("id"), attempt.cast("long").alias("attempt"), F.col(error_col).cast("string").alias("error"))
    events.write.mode("append").json(path)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EVENTS).json(path)


def fold_events(events: DataFrame) -> DataFrame:
    """``(id, attempt, error, attempts)``: the latest attempt per id, and how many there were.

    If one attempt is logged with both outcomes, as when a lost task ran again, the success counts. Each task
    sends one row per id, however often it was tried.
    """
    place = F.struct("attempt", F.col("error").isNull().alias("ok"), F.coalesce("error", F.lit("")).alias("said"))
    latest = events.groupBy("id").agg(F.max(place).alias("last"), F.count_distinct("attempt").alias("attempts"))
    return latest.select("id", "last.attempt", F.when(~F.col("last.ok"), F.col("last.said")).alias("error"), "attempts")


def remaining(events: DataFrame, older: DataFrame | None = None) -> DataFrame:
    """``(id, error)`` of ids whose latest attempt failed, and of ``older`` failures never tried since."""
    if older is not None:
        events = events.unionByName(older.select(F.col("id").cast("long"), F.lit(-1).cast("long").alias("attempt"), F.lit("failed before").alias("error")))
    return fold_events(events).filter("error is not null").select("id", "error")
