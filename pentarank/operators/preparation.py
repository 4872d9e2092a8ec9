"""Records to model-ready token rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from pentarank.functions import prompts, tokens
from pentarank.operators.images import resize_images
from pentarank.schemas import IGNORE_TOKEN, PAIR_MAX_LENGTH, SIMILARITY_MAX_LENGTH

PIXEL_COLUMNS = ("pixel_values", "image_error")


def _with_pixels(records: DataFrame, keep: Sequence[str], side: int | None) -> tuple[DataFrame, tuple[str, ...]]:
    """The records, with their pictures resized where a side is given, and the columns that stay."""
    if side is None:
        return records, tuple(keep)
    return resize_images(records, side=side, antialias=True), (*keep, *PIXEL_COLUMNS)


def pair_rows(
    records: DataFrame,
    tokenizer: tokens.Tokenizer = tokens.HashTokenizer(),
    template: str = prompts.TRAINING_TEMPLATE,
    for_generation: bool = False,
    max_length: int | None = PAIR_MAX_LENGTH,
    keep: Sequence[str] = ("id",),
    padding: bool = True,
    pixels: int | None = None,
) -> DataFrame:
    """Prompt, answer and image markers as padded tokens.

    Training rows carry ``labels`` over the answer only. Generation rows end where the
    reasoning opens and carry the tokens of the whole answer as ``partial_labels``.
    ``max_length`` of None keeps whole texts without padding; ``pixels``, the side of a
    square such as 224, adds the record's pictures as ``pixel_values``.
    """
    both = pair_row_modes(records, tokenizer, template, max_length, keep, padding, pixels, modes=(for_generation,))
    unused = "labels" if for_generation else "partial_labels"
    return both.drop("generation", unused)


def pair_row_modes(
    records: DataFrame,
    tokenizer: tokens.Tokenizer = tokens.HashTokenizer(),
    template: str = prompts.TRAINING_TEMPLATE,
    max_length: int | None = PAIR_MAX_LENGTH,
    keep: Sequence[str] = ("id",),
    padding: bool = True,
    pixels: int | None = None,
    modes: Sequence[bool] = (False, True),
) -> DataFrame:
    """Training rows and generation rows, told apart by ``generation``, in one pass over the records."""
    records, kept = _with_pixels(records, keep, pixels)
    make = _joined_ids if tokenizer.splits_at_specials else _rendered_ids
    texts = make(records, tokenizer, template, max_length, kept, modes)

    def fixed(ids: str) -> Column:
        return tokens.fixed_length(ids, tokenizer.pad_id, max_length, side="left", padding=padding)

    rows = texts.withColumns({"_fixed": fixed("_ids"), "_partial": fixed("_answer_ids")})
    ids, mask = F.col("_fixed.input_ids"), F.col("_fixed.attention_mask")
    marker = tokenizer.special_id(prompts.INSTRUCTION_END)
    return rows.select(
        *kept,
        "generation",
        ids.alias("input_ids"),
        mask.alias("attention_mask"),
        F.when(~F.col("generation"), tokens.mask_labels(ids, mask, marker)).alias("labels"),
        F.when(F.col("generation"), F.col("_partial.input_ids")).alias("partial_labels"),
    )


def _rendered_ids(records, tokenizer, template, max_length, kept, modes) -> DataFrame:
    """``(kept, generation, _ids, _answer_ids)``: every chat encoded as one text."""

    def chat(mode: bool) -> Column:
        messages = prompts.chat_messages(prompts.user_content(template), F.col("_answer"), mode)
        return F.struct(F.lit(mode).alias("generation"), prompts.render_chat(messages, mode).alias("_chat"))

    answered = records.withColumn("_answer", prompts.assistant_content())
    texts = answered.select(*kept, "_answer", F.inline(F.array(*[chat(m) for m in modes])))
    # A training row has no answer of its own to encode: its NULL stays NULL.
    return texts.select(
        *kept, "generation", tokenizer.encode("_chat", max_length).alias("_ids"),
        tokenizer.encode(F.when(F.col("generation"), F.col("_answer")), max_length).alias("_answer_ids"),
    )


def _joined_ids(records, tokenizer, template, max_length, kept, modes) -> DataFrame:
    """The same from the ids of prompt and answer, each encoded once: no token reaches across a special one."""
    asked = F.concat(F.lit(prompts.INSTRUCTION_START), prompts.user_content(template), F.lit(prompts.INSTRUCTION_END))
    coded = records.select(
        *kept, tokenizer.encode(asked, max_length).alias("_prompt"), tokenizer.encode(prompts.assistant_content(), max_length).alias("_answer")
    )
    none = F.array().cast("array<int>")
    prompt, answer = (F.coalesce(c, none) for c in ("_prompt", "_answer"))
    opened = tokenizer.encode(F.lit(prompts.OPEN_REASONING))
    closed = F.array(F.lit(tokenizer.special_id(IGNORE_TOKEN)))

    def mode(generation: bool) -> Column:
        ids = F.concat(prompt, opened) if generation else F.concat(prompt, answer, closed)
        own = F.col("_answer") if generation else F.lit(None).cast("array<int>")
        return F.struct(F.lit(generation).alias("generation"), ids.alias("_ids"), own.alias("_answer_ids"))

    return coded.select(*kept, F.inline(F.array(*[mode(m) for m in modes])))


def similarity_rows(
    records: DataFrame,
    tokenizer: tokens.Tokenizer = tokens.HashTokenizer(),
    max_length: int | None = SIMILARITY_MAX_LENGTH,
    keep: Sequence[str] = ("id",),
    padding: bool = True,
    pixels: int | None = None,
) -> DataFrame:
    """The sentence as tokens, padded on the right, with the pictures where ``pixels`` gives their side."""
    records, kept = _with_pixels(records, keep, pixels)
    ids = tokenizer.encode("sentence", max_length)
    fixed = tokens.fixed_length(ids, tokenizer.pad_id, max_length, side="right", padding=padding)
    return records.select(*kept, fixed.alias("_fixed")).select(*kept, "_fixed.*")
