"""Typed train/test datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from pentarank.schemas import sft_schema


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Exactly the columns of ``schema`` in its types; a value that does not fit raises."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])


def assemble_sft_dataset(
    train: DataFrame, test: DataFrame, image_type: T.DataType = T.BinaryType()
) -> DataFrame:
    """Both splits with the fixed record types and a ``split`` column."""
    named = [part.withColumn("split", F.lit(name)) for name, part in (("train", train), ("test", test))]
    return conform_splits(named[0].unionByName(named[1]), image_type)


def conform_splits(records: DataFrame, image_type: T.DataType = T.BinaryType()) -> DataFrame:
    """Records that name their ``split`` already, with the fixed types, in one pass."""
    schema = T.StructType([*sft_schema(image_type).fields, T.StructField("split", T.StringType())])
    return conform(records, schema)


def select_split(dataset: DataFrame, split: str) -> DataFrame:
    """One split; on a partitioned table only its folders are read."""
    return dataset.filter(F.col("split") == split)


def training_view(dataset: DataFrame, columns: list[str]) -> DataFrame:
    """Only the columns training reads; the scan below is pruned to them."""
    return dataset.select(*columns)
