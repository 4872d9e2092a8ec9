"""Success, failure and retry."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

_STATUS, _OK, _FAILED = "_status", "ok", "failed"


def retry_failed_only(records: DataFrame, failed: DataFrame, id_col: str = "id") -> DataFrame:
    """Records whose id is on the failed list.

    Catalyst broadcasts the list when it is small enough and shuffles both sides otherwise.
    """
    return records.join(failed.select(id_col), id_col, "left_semi")


def remaining_failed(previous: DataFrame, succeeded: DataFrame, id_col: str = "id") -> DataFrame:
    """Failed ids that are still open: earlier failures not among the new successes."""
    return previous.select(id_col).join(succeeded.select(id_col), id_col, "left_anti")


def route_outcomes(
    outcomes: DataFrame, folder: str, error_col: str = "error"
) -> tuple[DataFrame, DataFrame]:
    """Split outcomes into ``(successes, failures)``, stored as Parquet under ``folder``.

    They are written in one pass, partitioned by status, so an expensive generation behind
    ``outcomes`` runs once and each side reads only its own files and columns. ``folder`` is
    an unused path that all executors share. Outcomes that come from a table need no copy:
    filter them instead.
    """
    status = F.when(F.col(error_col).isNull(), _OK).otherwise(_FAILED)
    outcomes.withColumn(_STATUS, status).write.partitionBy(_STATUS).parquet(folder)
    schema = T.StructType([*outcomes.schema.fields, T.StructField(_STATUS, T.StringType())])
    stored = outcomes.sparkSession.read.schema(schema).parquet(folder)
    ok, failed = (stored.filter(F.col(_STATUS) == s).drop(_STATUS) for s in (_OK, _FAILED))
    return ok.drop(error_col), failed
