"""The per-row analysis as CSV."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pentarank.operators.analysis import ANALYSIS_COLUMNS
from pentarank.operators.batching import row_index

_FORMAT = {"header": "true", "escape": '"', "quote": '"'}


def _image_text(name: str) -> Column:
    value = F.col(name)
    whole = (value == F.floor(value)) & (F.abs(value) < 1e15)
    return F.when(whole, value.cast("bigint").cast("string")).otherwise(value.cast("string"))


def write_analysis(
    analysis: DataFrame, path: str, id_cols: tuple[str, ...] = ("id",), mode: str = "errorifexists"
) -> None:
    """Quoted CSV that keeps line breaks; whole image numbers are written as integers."""
    images = {c: _image_text(c) for c in ("pred_image", "label_image")}
    report = analysis.withColumns(images).select(*id_cols, *ANALYSIS_COLUMNS)
    report.write.mode(mode).options(**_FORMAT, quoteAll="true", nullValue="").csv(path)


def read_analysis(
    spark: SparkSession, path: str, id_ddl: str = "id bigint"
) -> DataFrame:
    numbers = ("pred_image", "label_image")
    columns = [f"{c} {'double' if c in numbers else 'string'}" for c in ANALYSIS_COLUMNS]
    schema = ", ".join([id_ddl, *columns])
    return spark.read.options(**_FORMAT, multiLine="true").schema(schema).csv(path)


# What stands for NULL where empty texts must stay empty; a text of just these letters would read as NULL.
NULL_MARK = "\\N"
CORRUPT = "_corrupt"
_EXACT = {"nullValue": NULL_MARK, "emptyValue": "", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def write_indexed_analysis(analysis: DataFrame, path: str, id_col: str = "id", mode: str = "errorifexists") -> None:
    """The analysis with a running row index in its first column, 0 to n - 1 in the order of the ids.

    Part files follow each other: each holds a range of the index, in order, so that they can be put end to
    end. Indices are counted on the ids alone; the wide rows move once. Ids are unique and not NULL. Texts come
    back as they were, with quotes, line breaks, spaces at their ends, and empty ones apart from NULL.
    """
    images = {c: _image_text(c) for c in ("pred_image", "label_image")}
    index = row_index(analysis.select(id_col), [id_col])
    report = analysis.withColumns(images).join(index, id_col).select("row_index", id_col, *ANALYSIS_COLUMNS)
    ordered = report.repartitionByRange("row_index").sortWithinPartitions("row_index")
    ordered.write.mode(mode).options(**_FORMAT, **_EXACT, quoteAll="true").csv(path)


def read_indexed_analysis(spark: SparkSession, path: str, id_ddl: str = "id bigint") -> DataFrame:
    """The report with its index; a record that does not fit has its text in ``_corrupt`` and is not lost."""
    numbers = ("pred_image", "label_image")
    columns = [f"{c} {'double' if c in numbers else 'string'}" for c in ANALYSIS_COLUMNS]
    schema = ", ".join(["row_index bigint", id_ddl, *columns, f"{CORRUPT} string"])
    kept = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    return spark.read.options(**_FORMAT, **_EXACT, **kept, multiLine="true").schema(schema).csv(path)
