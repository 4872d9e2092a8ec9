from __future__ import annotations

from pyspark.sql import functions as F

from pentarank.functions import prompts
from pentarank.schemas import PROMPT_COLUMNS

FIELDS = ["sentence", *PROMPT_COLUMNS, "compound", "sentence_type", "correct_image"]
SCHEMA = ", ".join(f"{f} {'int' if f == 'correct_image' else 'string'}" for f in FIELDS)
SHORT = "{{SENTENCE}}|{{IMAGE_1_DESCRIPTION}}|{{IMAGE_5_DESCRIPTION}}|{{COMPOUND_PHRASE}}|{{COMPOUND_TYPE}}|{{CORRECT_IMAGE}}|{{CORRECT_IMAGE}}"


def render(spark, *values, template=SHORT):
    df = spark.createDataFrame([tuple(values)], SCHEMA)
    return df.select(prompts.render_generation_prompt(template)).first()[0]


def test_placeholders_are_filled_everywhere(spark):
    assert render(spark, "s", "a", "b", "c", "d", "e", "cp", "literal", 4) == "s|a|e|cp|literal|4|4"
    full = render(spark, "s", *"abcde", "cp", "literal", 4, template=prompts.GENERATION_TEMPLATE)
    assert "{{" not in full


def test_text_put_in_early_may_hold_a_later_placeholder(spark):
    got = render(spark, "see {{IMAGE_1_DESCRIPTION}}", "a {{SENTENCE}}", *"bcde", "cp", "t", 1)
    assert got.startswith("see a {{SENTENCE}}|a {{SENTENCE}}|")


def test_gaps_read_none_but_a_sentence_is_required(spark):
    assert render(spark, "s", None, "b", "c", "d", "e", None, None, 2) == "s|None|e|None|None|2|2"
    assert render(spark, None, *"abcde", "cp", "t", 2) is None


def test_training_pair(spark):
    rows = [
        ("s", "<reasoning>r</reasoning>", '<output>\n\n<output>\n{"Image": 1}'),
        ("s", "r", "<output>\n{}"),
        ("s", "r", None),
    ]
    df = spark.createDataFrame(rows, "sentence string, reasoning string, output string")
    got = df.select(prompts.user_content(), prompts.assistant_content()).collect()
    assert got[0][0].count("[IMG]") == 5 and "IMAGE_" not in got[0][0] and "\ns\n" in got[0][0]
    assert got[0][1] == '<reasoning>r</reasoning>\n\n<output>\n{"Image": 1}'
    assert got[1][1] == "r\n\n<output>\n{}"
    assert got[2][1] is None


def test_chat_messages_and_rendering(spark):
    df = spark.createDataFrame([("ask", "answer")], "u string, a string")
    trained = df.select(prompts.chat_messages("u", "a").alias("m"))
    assert [tuple(m) for m in trained.first().m] == [("user", "ask"), ("assistant", "answer")]
    assert trained.select(prompts.render_chat("m")).first()[0] == "[INST]ask[/INST]answer</s>"
    opened = df.select(prompts.chat_messages("u", "a", for_generation=True).alias("m"))
    rendered = opened.select(prompts.render_chat("m", for_generation=True)).first()[0]
    assert rendered == "[INST]ask[/INST]<reasoning>"


def test_fill_with_columns(spark):
    df = spark.createDataFrame([("x",)], "v string")
    assert df.select(prompts.fill(F.lit("a-b-a"), [("a", F.col("v"))])).first()[0] == "x-b-x"
