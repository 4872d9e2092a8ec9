from __future__ import annotations

import json
import math
import random

import pytest

from pentarank.functions import text
from pentarank.operators import analysis, metrics

CASES = [
    ('<reasoning>r</reasoning>\n\n<output>\n{"Image": "3"}\n</output></s>', 3),
    ('<output>{"Image": 3}</output>', 3),
    ('<output>{"Image": "three"}</output>', -1),
    ('<output>{"Answer": 3}</output>', -1),
    ("no tags at all", -1),
    ('<output>{"Image": 2}', 2),
    ('<output>{"Image": 2}</s></s>', -1),
    ('<output>\n\n<output>\n{"Image": "3"}\n</output>', -1),
    ('<output>{"Image": 3} ok</output>', -1),
    ('<output>["Image"]</output>', -1),
    ('<output>{"Image": 3.0}</output>', 3.0),
    ('<output>{"Image": " 4 "}</output>', 4),
    ('<output>{"Image": "3.0"}</output>', -1),
    ('<output>{"Image": 1, "Image": 2}</output>', 2),
    ("<output>{'Image': 3}</output>", -1),
    ('<output>{"R": "a" "Image": "3"}</output>', -1),
    ('<output>{"R":"a\nb","Image":3}</output>', -1),
    ('<output>{"c":NaN,"Image":3}</output>', 3),
    ('<output>{"Image": 3},{"Image": 4}</output>', -1),
    ('<output>{"Image": null}</output>', -1),
    ('<output>{"Image": 1e400}</output>', math.inf),
]
MORE_JSON = [
    '{"Image": 3}] [',
    '{"Image": 3}} {',
    '{"Image": 3}, "v": {"Image": 4}',
    '{"Image": "NaN"}',
    '{"Image": NaN}',
    '{"Image": "Infinity"}',
    '{"Image": -Infinity}',
    '{"Image": "+5"}',
    '{"Image": "-2"}',
    '{"Image": "1_0"}',
    '{"Image": "1__0"}',
    '{"Image": "_1"}',
    '{"Image": ""}',
    '{"Image": "  7\\n"}',
    '{"Image": 2, "Image": "1"}',
    '{"Image": "1", "Image": 2}',
    '{"Image": 2.5}',
    '{"Image": 12345678901}',
    '{"Image": "12345678901"}',
    '{"x": {"Image": 4}}',
    '{"Image": "2", "x": [1, {"y": "]}"}]}',
    '{"Image": 007}',
    '{"Image": 3,}',
    "3",
    "null",
    "",
    '"Image"',
    '{"a\\qb": 1}',
    '{"Image": "\\u0033"}',
    "{}",
    "[]",
    "[1, 2]",
    "nul",
    "tru",
    '{"image": 3}',
    '{"Image": true}',
    '{"Image": false}',
    '{"Image": "true"}',
]


def reference_choice(output):
    """The rule in plain Python."""
    try:
        parsed = json.loads(output)
    except ValueError:
        return -1
    if not isinstance(parsed, dict) or "Image" not in parsed:
        return -1
    image = parsed["Image"]
    if isinstance(image, str):
        try:
            return int(image)
        except ValueError:
            return -1
    return image if isinstance(image, (int, float)) else -1


def parses(output):
    try:
        json.loads(output)
        return True
    except ValueError:
        return False


def same(left, right):
    return left == right or (math.isnan(left) and math.isnan(right))


def column(spark, values, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[1] for r in df.select("i", expression).orderBy("i").collect()]


def test_tagged_answers(spark):
    got = column(spark, [c for c, _ in CASES], text.image_choice(text.extract_tag("t", "output")))
    assert got == [float(v) for _, v in CASES]


def test_image_choice_agrees_with_a_strict_parser(spark):
    got = column(spark, MORE_JSON, text.image_choice("t"))
    wrong = [(o, g, reference_choice(o)) for o, g in zip(MORE_JSON, got) if not same(g, reference_choice(o))]
    assert wrong == []


def test_is_json_agrees_with_a_strict_parser(spark):
    got = column(spark, MORE_JSON, text.is_json("t"))
    assert [(o, g) for o, g in zip(MORE_JSON, got) if g != parses(o)] == []


def test_fuzzed_json(spark):
    rng = random.Random(11)
    pieces = ['{"Image": ', "3", '"3"', "}", "{", "]", "[", ",", " ", '"', "null", '"Image"', ":", "1.5", "x", "true"]
    values = ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 7))) for _ in range(2000)]
    values += ['{"Image": %s}%s' % (rng.choice(pieces), rng.choice(pieces + [""])) for _ in range(500)]
    got = column(spark, values, text.image_choice("t"))
    valid = column(spark, values, text.is_json("t"))
    assert [(o, g) for o, g in zip(values, got) if not same(g, reference_choice(o))] == []
    assert [(o, v) for o, v in zip(values, valid) if v != parses(o)] == []


def test_strip_matches_unicode_strip(spark):
    values = ["　\n a b \x85 ", " \x1c", "", "x", "​x", "﻿ y"]
    assert column(spark, values, text.strip("t")) == [v.strip() for v in values]


def test_extract_tag_against_plain_python(spark):
    rng = random.Random(5)
    pieces = ["<output>", "</output>", "a", " \n", "<reasoning>", "</reasoning>", "</s>"]
    values = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 8))) for _ in range(400)]

    def plain(value):
        parts = value.split("<output>")
        return parts[1].split("</output>")[0].strip() if len(parts) > 1 else ""

    assert column(spark, values, text.extract_tag("t", "output")) == [plain(v) for v in values]
    stripped = column(spark, values, text.strip_ignore_token("t"))
    assert stripped == [v.replace("</s>", "").strip() for v in values]


def test_long_whitespace_runs_stay_cheap(spark):
    value = "a" + " " * 300_000 + "b"
    assert column(spark, [value], text.strip("t")) == [value]


def test_split_reply(spark):
    good, none, two = "<reasoning>x</reasoning>\ny", "<reasoning>x", "a</reasoning>b</reasoning>c"
    got = column(spark, [good, none, two, None], text.split_reply("t"))
    assert got == [("<reasoning>x</reasoning>", "<output>\ny"), None, None, None]


def test_scoring_leaves_out_doubly_unreadable_rows(spark):
    rows = [(3.0, 3.0), (-1.0, 3.0), (3.0, -1.0), (-1.0, -1.0)]
    df = spark.createDataFrame(rows, "pred_image double, label_image double")
    score = metrics.generation_accuracy()
    assert metrics.evaluate(df, [score]).first()[0] == pytest.approx(1 / 3)
    assert metrics.evaluate(df.filter("pred_image = -1 and label_image = -1"), [score]).first()[0] == 0.0
    nans = spark.createDataFrame([(math.nan, math.nan)], df.schema)
    assert metrics.evaluate(nans, [score]).first()[0] == 0.0


def test_analysis_table(spark):
    rows = [
        (1, '<reasoning> why </reasoning><output>{"Image": 2}</output></s>', '<output>{"Image": "2"}</output>'),
        (2, "<output>broken</output>", "<output>broken</output>"),
    ]
    table = analysis.analysis_table(spark.createDataFrame(rows, "id long, prediction string, label string"))
    first, second = sorted(table.collect())
    assert first.full_prediction.endswith("</output>") and first.pred_reasoning == "why"
    assert (first.pred_image, first.label_image) == (2.0, 2.0)
    assert (first.pred_json, first.label_json) == ('{"Image": 2}', '{"Image": "2"}')
    assert (second.pred_output, second.pred_json) == ("broken", "{}")
    assert (second.label_output, second.label_json) == ("", None)
    assert (second.pred_image, second.label_image) == (-1.0, -1.0)


@pytest.mark.parametrize(
    "label, output",
    [
        ("3", ""), ("null", ""), ("true", ""), ('["Image"]', ""), ('["image", 1]', '["image", 1]'), ('"An Image"', ""),
        ('"none"', '"none"'), ('{"Image": "x"}', '{"Image": "x"}'), ("{}", "{}"), ("{", ""), ("[]", "[]"), ("", ""),
    ],
)
def test_label_output_is_blanked_where_looking_for_the_image_fails(spark, label, output):
    df = spark.createDataFrame([(1, "p", f"<output>{label}</output>")], "id int, prediction string, label string")
    assert analysis.analysis_table(df).first().label_output == output
