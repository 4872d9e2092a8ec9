"""Scoring tagged model answers row by row."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pentarank.functions import text
from pentarank.schemas import IGNORE_TOKEN

ANALYSIS_COLUMNS = (
    "full_prediction",
    "full_label",
    "pred_reasoning",
    "label_reasoning",
    "pred_output",
    "label_output",
    "pred_json",
    "label_json",
    "pred_image",
    "label_image",
)


def image_pairs(
    generations: DataFrame,
    prediction: str = "prediction",
    label: str = "label",
    output_tag: str = text.OUTPUT_TAG,
) -> DataFrame:
    """Adds ``pred_image`` and ``label_image`` (double, -1 when unreadable)."""
    names = generations.columns
    outputs = generations.withColumns(
        {"_pred_output": text.extract_tag(prediction, output_tag), "_label_output": text.extract_tag(label, output_tag)}
    )
    return _with_images(outputs, "_").select(*names, "pred_image", "label_image")


def _with_images(outputs: DataFrame, prefix: str) -> DataFrame:
    """Adds the image of both sides; each answer is read once, in columns of its own."""
    for side in ("pred", "label"):
        outputs = outputs.withColumns(text.image_readings(f"{prefix}{side}_output", f"_{side}_"))
    return outputs.withColumns(
        {
            f"{side}_image": text.image_of(f"{prefix}{side}_output", F.col(f"_{side}_listed"), F.col(f"_{side}_number"))
            for side in ("pred", "label")
        }
    )


def analysis_table(
    generations: DataFrame,
    id_cols: tuple[str, ...] = ("id",),
    prediction: str = "prediction",
    label: str = "label",
    reasoning_tag: str = text.REASONING_TAG,
    output_tag: str = text.OUTPUT_TAG,
    ignore_token: str = IGNORE_TOKEN,
) -> DataFrame:
    """Everything read out of prediction and label, one row per generation.

    Tags are looked up in the raw text, the ignore token is removed from the full text
    only. A label whose JSON cannot be read has no JSON. It loses its output text too, and so
    does one in which looking for the image fails: a bare number, true, false or null, a
    list with the element ``Image`` or a string with that word. A prediction keeps its text
    and shows ``{}`` when it is unreadable.
    """
    sides = generations.select(
        *id_cols,
        text.strip_ignore_token(prediction, ignore_token).alias("full_prediction"),
        text.strip_ignore_token(label, ignore_token).alias("full_label"),
        text.extract_tag(prediction, reasoning_tag).alias("pred_reasoning"),
        text.extract_tag(label, reasoning_tag).alias("label_reasoning"),
        text.extract_tag(prediction, output_tag).alias("pred_output"),
        text.extract_tag(label, output_tag).alias("label_output"),
    )
    read = sides.withColumns({"_pred_is": text.is_json("pred_output"), "_label_is": text.is_json("label_output")})
    kept = F.col("_label_is") & text.holds_fields("label_output")
    made = _with_images(read, "").withColumns(
        {
            "pred_json": F.when(F.col("_pred_is"), F.col("pred_output")).otherwise("{}"),
            "label_json": F.when(F.col("_label_is"), F.col("label_output")),
            "_kept": kept,
        }
    )
    blanked = F.when(F.col("_kept"), F.col("label_output")).otherwise("")
    return made.withColumn("label_output", blanked).select(*id_cols, *ANALYSIS_COLUMNS)
