"""Prompt templates, filling them in, and chat messages.

Templates are arguments everywhere; the defaults below only fix the placeholder names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from pentarank.functions.arrays import as_column
from pentarank.schemas import CANDIDATE_NUMBERS, IGNORE_TOKEN, PROMPT_COLUMNS

# Placeholders, markers and prefixes.
SENTENCE = "{{SENTENCE}}"
DESCRIPTIONS = tuple("{{IMAGE_%d_DESCRIPTION}}" % i for i in CANDIDATE_NUMBERS)
COMPOUND_PHRASE = "{{COMPOUND_PHRASE}}"
COMPOUND_TYPE = "{{COMPOUND_TYPE}}"
CORRECT_IMAGE = "{{CORRECT_IMAGE}}"
IMAGE_SLOTS = tuple("<image_%d>{{IMAGE_%d_DESCRIPTION}}</image_%d>" % (i, i, i) for i in CANDIDATE_NUMBERS)
IMAGE_MARKER = "[IMG]"
INSTRUCTION_START = "[INST]"
INSTRUCTION_END = "[/INST]"
OUTPUT_PREFIX = "<output>\n\n"
OPEN_REASONING = "<reasoning>"
MISSING = "None"

GENERATION_TEMPLATE = """Write one worked example that teaches a model to pick a picture for a sentence.

<sentence>
{{SENTENCE}}
</sentence>

<descriptions>
1: {{IMAGE_1_DESCRIPTION}}
2: {{IMAGE_2_DESCRIPTION}}
3: {{IMAGE_3_DESCRIPTION}}
4: {{IMAGE_4_DESCRIPTION}}
5: {{IMAGE_5_DESCRIPTION}}
</descriptions>

The expression is "{{COMPOUND_PHRASE}}", used in its {{COMPOUND_TYPE}} sense.
Picture {{CORRECT_IMAGE}} is the right choice.

Think aloud between <reasoning> and </reasoning>, then give one JSON object between
<output> and </output>, for example:
{"Compound": "{{COMPOUND_PHRASE}}", "Image": "{{CORRECT_IMAGE}}", "Confidence": "High"}
"""

TRAINING_TEMPLATE = """Read the sentence and choose the picture that shows what it means.

<sentence>
{{SENTENCE}}
</sentence>

<images>
<image_1>{{IMAGE_1_DESCRIPTION}}</image_1>
<image_2>{{IMAGE_2_DESCRIPTION}}</image_2>
<image_3>{{IMAGE_3_DESCRIPTION}}</image_3>
<image_4>{{IMAGE_4_DESCRIPTION}}</image_4>
<image_5>{{IMAGE_5_DESCRIPTION}}</image_5>
</images>

Explain your choice between <reasoning> and </reasoning>, then answer between <output>
and </output> with a JSON object whose "Image" is the number of the picture.
"""

_MESSAGES = "array<struct<role:string,content:string>>"


def fill(template: Column, values: Sequence[tuple[str, Column]]) -> Column:
    """Replace placeholders one after the other.

    Order matters: text put in early may itself hold a later placeholder.
    """
    for placeholder, value in values:
        template = F.replace(template, F.lit(placeholder), value)
    return template


def render_generation_prompt(
    template: str = GENERATION_TEMPLATE,
    sentence: Column | str = "sentence",
    descriptions: Sequence[Column | str] = PROMPT_COLUMNS,
    phrase: Column | str = "compound",
    phrase_type: Column | str = "sentence_type",
    correct_image: Column | str = "correct_image",
) -> Column:
    """The prompt of one record; NULL without a sentence, other gaps read ``None``."""

    def text(value: Column | str) -> Column:
        return F.coalesce(as_column(value).cast("string"), F.lit(MISSING))

    values = [(SENTENCE, as_column(sentence))]
    values += [(slot, text(d)) for slot, d in zip(DESCRIPTIONS, descriptions, strict=True)]
    values += [
        (COMPOUND_PHRASE, text(phrase)),
        (COMPOUND_TYPE, text(phrase_type)),
        (CORRECT_IMAGE, text(correct_image)),
    ]
    return fill(F.lit(template), values)


def user_content(template: str = TRAINING_TEMPLATE, sentence: Column | str = "sentence") -> Column:
    """Training prompt with each image slot turned into an image marker."""
    values = [(SENTENCE, as_column(sentence))]
    values += [(slot, F.lit(IMAGE_MARKER)) for slot in IMAGE_SLOTS]
    return fill(F.lit(template), values)


def assistant_content(
    reasoning: Column | str = "reasoning", output: Column | str = "output"
) -> Column:
    """Reasoning and answer joined by a blank line, minus one doubled output opener."""
    output = as_column(output)
    answer = F.when(
        output.startswith(OUTPUT_PREFIX), F.substr(output, F.lit(len(OUTPUT_PREFIX) + 1))
    ).otherwise(output)
    return F.concat(as_column(reasoning), F.lit("\n\n"), answer)


def chat_messages(
    user: Column | str, assistant: Column | str, for_generation: bool = False
) -> Column:
    """``[{user}, {assistant}]``; a generation prompt only opens the reasoning."""
    reply = F.lit(OPEN_REASONING) if for_generation else as_column(assistant)

    def message(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    return F.array(message("user", as_column(user)), message("assistant", reply)).cast(_MESSAGES)


def render_chat(
    messages: Column | str, for_generation: bool = False, end_token: str = IGNORE_TOKEN
) -> Column:
    """One string per conversation; generation leaves the last message open."""

    def turn(message: Column) -> Column:
        content = message["content"]
        asked = F.concat(F.lit(INSTRUCTION_START), content, F.lit(INSTRUCTION_END))
        return F.when(message["role"] == "user", asked).otherwise(content)

    text = F.array_join(F.transform(as_column(messages), turn), "")
    return text if for_generation else F.concat(text, F.lit(end_token))
