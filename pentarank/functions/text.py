"""Reading tagged model answers: tags, structured JSON, ignore token."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from pentarank.functions.arrays import as_column
from pentarank.schemas import IGNORE_TOKEN, NO_IMAGE

# The characters a Unicode-aware strip removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 "
    "           "
    "    　"
)
REASONING_TAG = "reasoning"
OUTPUT_TAG = "output"
REASONING_CLOSER = "</reasoning>"
OUTPUT_OPENER = "<output>"

# The JSON reader must be as strict as a standard parser, except for bare NaN/Infinity.
_STRICT_JSON = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "true"}


def strip(value: Column | str) -> Column:
    return F.btrim(as_column(value), F.lit(WHITESPACE))


def strip_ignore_token(value: Column | str, token: str = IGNORE_TOKEN) -> Column:
    return strip(F.replace(as_column(value), F.lit(token), F.lit("")))


def extract_tag(value: Column | str, tag: str) -> Column:
    """Text from the first opener to the next closer, next opener or end; "" without opener."""
    after = F.split_part(as_column(value), F.lit(f"<{tag}>"), F.lit(2))
    return strip(F.substring_index(after, f"</{tag}>", 1))


def split_reply(reply: Column | str) -> Column:
    """``struct<reasoning, output>`` of a reply, NULL unless it closes reasoning exactly once."""
    parts = F.split(as_column(reply), REASONING_CLOSER, -1)
    return F.when(
        F.size(parts) == 2,
        F.struct(
            F.concat(parts.getItem(0), F.lit(REASONING_CLOSER)).alias("reasoning"),
            F.concat(F.lit(OUTPUT_OPENER), parts.getItem(1)).alias("output"),
        ),
    )


def _in_list(text: Column, element: str) -> Column:
    return F.from_json(
        F.concat(F.lit("["), text, F.lit("]")), f"array<{element}>", _STRICT_JSON
    )


def _in_object(text: Column, element: str) -> Column:
    return F.from_json(
        F.concat(F.lit('{"v":'), text, F.lit("}")), f"struct<v:{element}>", _STRICT_JSON
    )["v"]


def image_readings(output: Column | str, prefix: str, key: str = "Image") -> dict[str, Column]:
    """The readings ``image_of`` takes apart, as columns to add, so that each is made once."""
    output = as_column(output)
    return {
        f"{prefix}listed": _in_list(output, f"struct<`{key}`:string>"),
        f"{prefix}number": _in_object(output, f"struct<`{key}`:double>"),
    }


def holds_fields(output: Column | str, key: str = "Image") -> Column:
    """Whether ``key`` can be looked for in a JSON value without failing.

    True for an object, for a list without the element ``key`` and for a string without that word.
    """
    text = strip(output)
    elements = F.coalesce(_in_list(text, "array<string>")[0], F.array().cast("array<string>"))
    string = F.coalesce(_in_object(text, "string"), F.lit(""))
    return (
        F.when(text.startswith("{"), F.lit(True))
        .when(text.startswith("["), ~F.array_contains(elements, key))
        .when(text.startswith('"'), ~F.contains(string, F.lit(key)))
        .otherwise(F.lit(False))
    )
def is_json(text: Column | str) -> Column:
    """Whether the text is exactly one JSON value.

    Spark stops reading after the first complete value, so trailing text is caught by
    reading the value as the only element of a list and as the only field of an
    object: nothing but the end of the text can follow it in both.
    """
    text = as_column(text)
    as_list = _in_list(text, "string")
    in_object = _in_object(text, "string").isNotNull() | (strip(text) == "null")
    return F.coalesce((F.size(as_list) == 1) & in_object, F.lit(False))


def image_choice(output: Column | str, key: str = "Image") -> Column:
    """The image number of a JSON answer as double; -1 when there is no usable one.

    A JSON number is kept as it is, true and false are 1 and 0, a string must hold a
    whole number; the last of repeated keys wins.
    """
    readings = image_readings(output, "", key)
    return image_of(output, readings["listed"], readings["number"], key)


def image_of(output: Column | str, listed: Column, number: Column, key: str = "Image") -> Column:
    """``image_choice`` from readings that are made already."""
    output = as_column(output)
    text = F.get(listed, F.lit(0))[key]
    value = number[key]
    whole = F.replace(strip(text), F.lit("_"), F.lit(""))
    from_string = F.when(
        strip(text).rlike(r"^[+-]?[0-9]+(_[0-9]+)*$"), whole.try_cast("double")
    )
    # Bare NaN and Infinity come back quoted when read as a string.
    finite = ~F.isnan(value) & (F.abs(value) != float("inf"))
    is_number = F.when(finite, text.try_cast("double") == value).otherwise(
        text.startswith('"')
    )
    # Rare enough to be worth a third reading only for these two words.
    truth = F.when(
        text.isin("true", "false"), _in_object(output, f"struct<`{key}`:boolean>")[key]
    ).cast("double")
    single = (F.size(listed) == 1) & number.isNotNull()
    return (
        F.when(~F.coalesce(single, F.lit(False)), float(NO_IMAGE))
        .when(value.isNotNull() & is_number, value)
        .otherwise(F.coalesce(from_string, truth, F.lit(float(NO_IMAGE))))
    )
