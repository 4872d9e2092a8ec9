"""Helpers that several operators share."""

from __future__ import annotations

import string
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pentarank.session import materialise as cut  # noqa: F401
from pentarank.session import shared_folder

# What separates words in every operator of this subpackage.
SPACE_CLASS = r"\x20\x09-\x0D"
WORD_PATTERN = rf"[^{SPACE_CLASS}]+"
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def words(text: Column) -> Column:
    """Words of a text; NULL and blank texts give an empty array."""
    parts = F.split(F.coalesce(text, F.lit("")), rf"[{SPACE_CLASS}]+", -1)
    return F.filter(parts, lambda w: w != "")


def fresh_folder(spark: SparkSession, name: str) -> str:
    """An unused path in the folder that the driver and all executors share."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal rows by ``keys`` to the session's number of shuffle partitions.

    For work that is heavy per row: adaptive execution does not merge these partitions.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
