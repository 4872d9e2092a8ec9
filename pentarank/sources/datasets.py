"""Split datasets, generated records and the metric log as partitioned tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from pentarank.schemas import METRIC_LOG, sft_schema, with_split


class SchemaMismatch(ValueError):
    pass


def check_schema(df: DataFrame, expected: T.StructType) -> DataFrame:
    """Require the columns of ``expected`` in their types, whatever their order."""
    found = {f.name: f.dataType for f in df.schema}
    wrong = [
        f"{f.name}: expected {f.dataType.simpleString()}, found "
        + (found[f.name].simpleString() if f.name in found else "nothing")
        for f in expected
        if found.get(f.name) != f.dataType
    ]
    if wrong:
        raise SchemaMismatch("; ".join(wrong))
    return df


def write_splits(
    dataset: DataFrame, path: str, mode: str = "errorifexists", file_rows: int = 0
) -> None:
    """One folder per split. ``file_rows`` caps rows per file, for records with images."""
    writer = dataset.write.mode(mode).partitionBy("split")
    if file_rows:
        writer = writer.option("maxRecordsPerFile", file_rows)
    writer.parquet(path)


def load_splits(
    spark: SparkSession, path: str, schema: T.StructType | None = None
) -> DataFrame:
    """All splits of a stored dataset, checked against the record schema.

    The stored types are looked at, not assumed, so a file of another type is reported
    before any row is read. Filtering on ``split`` reads that folder only.
    """
    expected = with_split(sft_schema() if schema is None else schema)
    stored = check_schema(spark.read.parquet(path), expected)
    return stored.select(*expected.names)


def save_bucketed(dataset: DataFrame, table: str, path: str, key: str = "id", buckets: int = 64, mode: str = "errorifexists") -> None:
    """A catalog table under ``path``: one folder per split, rows of a key always in the same bucket, sorted by it.

    Tables with the same number of buckets join on the key without an exchange, and split by split. ``buckets`` bounds
    the files of a task, so rows are dealt out by bucket first: as many files a split as buckets.
    """
    dealt = dataset.repartition(buckets, key)
    dealt.write.mode(mode).partitionBy("split").bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(table)


def append_bucketed(dataset: DataFrame, table: str, key: str = "id") -> None:
    """More rows for a bucketed table; columns that are new join its schema, those missing are NULL."""
    spark = dataset.sparkSession
    stored = spark.table(table)
    known = {f.name: f.dataType for f in stored.schema}
    fresh = [f for f in dataset.schema if f.name not in known]
    wrong = [f.name for f in dataset.schema if known.get(f.name, f.dataType) != f.dataType]
    if wrong:
        raise SchemaMismatch("; ".join(f"{n}: expected {known[n].simpleString()}, found {dataset.schema[n].dataType.simpleString()}" for n in wrong))
    if fresh:
        spark.sql(f"ALTER TABLE {table} ADD COLUMNS ({', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in fresh)})")
    wanted = spark.table(table).schema
    columns = [F.col(f.name) if f.name in dataset.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in wanted]
    buckets = int(next(r.data_type for r in spark.sql(f"DESCRIBE FORMATTED {table}").collect() if r.col_name == "Num Buckets"))
    rows = dataset.select(*columns).repartition(buckets, key)
    rows.write.mode("append").format("parquet").partitionBy("split").bucketBy(buckets, key).sortBy(key).saveAsTable(table)


def save_records(records: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A complete set of generated records."""
    records.write.mode(mode).parquet(path)


def append_metrics(log: DataFrame, path: str) -> None:
    columns = [log[f.name].cast(f.dataType).alias(f.name) for f in METRIC_LOG]
    log.select(*columns).write.mode("append").partitionBy("run_id").parquet(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(METRIC_LOG).parquet(path).select(*METRIC_LOG.names)
