"""Picture files as columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pentarank.functions.pictures import picture_size


def read_images(spark: SparkSession, path: str, drop_invalid: bool = False) -> DataFrame:
    """Decoded pictures: ``(path, image)`` with the struct of Spark's image source."""
    pictures = spark.read.format("image").option("dropInvalid", drop_invalid).load(path)
    return pictures.select(F.col("image.origin").alias("path"), "image")


def read_image_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Undecoded files: ``(path, length, content)``, for any format."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return files.select("path", "length", "content")


def scan_pictures(spark: SparkSession, path: str, pattern: str = "*", least_side: int = 1) -> DataFrame:
    """``(path, length, kind, width, height, usable, content)`` of files, told from their headers.

    ``usable`` files are pictures of a known kind with sides of at least ``least_side``: filter by it
    before anything decodes them. Nothing is decoded here.
    """
    files = read_image_files(spark, path, pattern).withColumn("_size", picture_size("content"))
    usable = F.coalesce(F.least("_size.width", "_size.height") >= least_side, F.lit(False))
    return files.select("path", "length", "_size.kind", "_size.width", "_size.height", usable.alias("usable"), "content")
