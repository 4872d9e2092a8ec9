"""Tokenising, padding, masking and decoding as array expressions.

The default tokenizer is a regular expression with a hashed vocabulary, so it runs
inside the JVM; real tokenizers plug in through ``encode_with`` / ``decode_with``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from pentarank.functions.arrays import as_column, let
from pentarank.schemas import IGNORE_INDEX, IGNORE_TOKEN, PAIR_MAX_LENGTH

# Special tokens, ids 0..4 in this order.
SPECIAL_TOKENS = ("<s>", "</s>", "[INST]", "[/INST]", "[IMG]")
LONGEST_PIECE = 32


@dataclass(frozen=True)
class HashTokenizer:
    """Words of at most 32 letters, single symbols, and the special tokens.

    Ids of ordinary tokens are their CRC-32 modulo the vocabulary size. Both the number
    of ids and the length of a token are bounded, hence so is any vocabulary table.
    """

    vocab_size: int = 32768
    #: No token reaches across a special one, so texts may be encoded part by part.
    splits_at_specials = True

    @property
    def pattern(self) -> str:
        word = r"[\p{L}\p{N}_]{1,%d}" % LONGEST_PIECE
        return word + r"|<s>|</s>|\[INST\]|\[/INST\]|\[IMG\]|[^\p{L}\p{N}_\t-\r ]"

    def special_id(self, token: str) -> int:
        return SPECIAL_TOKENS.index(token)

    @property
    def pad_id(self) -> int:
        return self.special_id(IGNORE_TOKEN)

    def pieces(self, text: Column | str) -> Column:
        return F.regexp_extract_all(as_column(text), F.lit(self.pattern), F.lit(0))

    def token_id(self, token: Column) -> Column:
        specials = F.array(*[F.lit(t) for t in SPECIAL_TOKENS])
        hashed = F.crc32(token) % (self.vocab_size - len(SPECIAL_TOKENS)) + len(SPECIAL_TOKENS)
        special = F.array_position(specials, token) - 1
        return F.when(token.isin(*SPECIAL_TOKENS), special).otherwise(hashed).cast("int")

    def encode(self, text: Column | str, max_length: int | None = None) -> Column:
        """Token ids; tokens beyond ``max_length`` are cut before they are looked up."""
        pieces = self.pieces(text)
        kept = pieces if max_length is None else truncate(pieces, max_length)
        return F.transform(kept, self.token_id)

    def vocabulary(self, texts: DataFrame, column: str) -> DataFrame:
        """``(token_id, token)`` seen in a corpus, the smallest token for a shared id."""
        # Ids are looked up once per distinct token, not once per occurrence.
        distinct = texts.select(F.explode(self.pieces(column)).alias("token")).distinct()
        ordinary = distinct.filter(~F.col("token").isin(*SPECIAL_TOKENS))
        seen = ordinary.groupBy(self.token_id(F.col("token")).alias("token_id")).agg(
            F.min("token").alias("token")
        )
        special = texts.sparkSession.createDataFrame(
            list(enumerate(SPECIAL_TOKENS)), "token_id int, token string"
        )
        return seen.unionByName(special)


def truncate(ids: Column, max_length: int) -> Column:
    return F.slice(ids, 1, max_length)


def pad_left(ids: Column, max_length: int, pad_id: int) -> Column:
    gap = F.greatest(F.lit(max_length) - F.size(ids), F.lit(0))
    return F.concat(F.array_repeat(F.lit(pad_id), gap), ids)


def pad_right(ids: Column, max_length: int, pad_id: int) -> Column:
    gap = F.greatest(F.lit(max_length) - F.size(ids), F.lit(0))
    return F.concat(ids, F.array_repeat(F.lit(pad_id), gap))


def fixed_length(
    ids: Column | str, pad_id: int, max_length: int | None = PAIR_MAX_LENGTH, side: str = "left", padding: bool = True
) -> Column:
    """``struct<input_ids, attention_mask>`` cut on the right and padded on ``side``.

    ``max_length`` of None neither cuts nor pads; without ``padding`` rows are only cut.
    """
    if side not in ("left", "right"):
        raise ValueError("side must be 'left' or 'right'")
    pad = pad_left if side == "left" else pad_right

    def filled(kept: Column, value: int) -> Column:
        return pad(kept, max_length, value) if padding and max_length is not None else kept

    def build(kept: Column) -> Column:
        ones = F.array_repeat(F.lit(1), F.size(kept))
        return F.struct(filled(kept, pad_id).alias("input_ids"), filled(ones, 0).alias("attention_mask"))

    ids = as_column(ids)
    return let(ids if max_length is None else truncate(ids, max_length), build)


def mask_labels(
    input_ids: Column | str,
    attention_mask: Column | str,
    marker_id: int,
    ignore_index: int = IGNORE_INDEX,
) -> Column:
    """Labels with padding, and everything up to the first marker, set to ``ignore_index``.

    The marker is looked up among unpadded tokens; without one only padding is masked.
    Padding at the ends, the usual case, is cut off and put back as whole slices; only a
    mask with gaps is gone through token by token.
    """
    ids, seen = as_column(input_ids), as_column(attention_mask)

    def ignored(count: Column) -> Column:
        return F.array_repeat(F.lit(ignore_index), count)

    def answer_only(tokens: Column) -> Column:
        prompt = F.array_position(tokens, F.lit(marker_id)).cast("int")
        return F.concat(ignored(prompt), F.slice(tokens, prompt + 1, F.size(tokens) - prompt))

    first = F.array_position(seen, F.lit(1)).cast("int")
    count = F.size(F.array_remove(seen, 0))
    before = F.greatest(first - 1, F.lit(0))
    kept = F.slice(ids, before + 1, count)
    whole = F.size(F.array_remove(F.slice(seen, before + 1, count), 0)) == count
    blanked = F.zip_with(
        ids, seen, lambda t, s: F.when(s == 0, F.lit(ignore_index)).otherwise(t)
    )
    by_slices = F.concat(
        ignored(before), let(kept, answer_only), ignored(F.size(ids) - before - count)
    )
    return F.when(whole, by_slices).otherwise(let(blanked, answer_only))


def decode(
    df: DataFrame,
    ids: str,
    vocabulary: DataFrame,
    vocab_size: int,
    alias: str = "decoded",
    ignore_index: int = IGNORE_INDEX,
    ignore_token: str = IGNORE_TOKEN,
    unknown: str = "",
) -> DataFrame:
    """Add token ids as text, ignored positions shown as the ignore token.

    The vocabulary is one array indexed by id, from a scalar subquery: it holds at most
    ``vocab_size`` tokens, whatever the size of the corpus, and is no column of the
    result. An id outside that range makes the query fail instead of growing the array.
    """
    in_range = F.col("token_id").between(0, vocab_size - 1)
    outside = F.raise_error(F.lit("token id outside the vocabulary")).cast("int")
    seen = vocabulary.select(
        F.when(in_range, F.col("token_id")).otherwise(outside).alias("token_id"), "token"
    )
    empty = vocabulary.sparkSession.range(vocab_size).select(
        F.col("id").cast("int").alias("token_id"), F.lit(None).cast("string").alias("token")
    )
    slots = seen.unionByName(empty).groupBy("token_id").agg(F.min("token").alias("token"))
    entries = F.sort_array(F.collect_list(F.struct("token_id", "token")))
    words = slots.agg(entries.alias("entries")).select(F.col("entries.token"))

    def word(token: Column) -> Column:
        known = F.coalesce(F.get("_vocabulary", token), F.lit(unknown))
        return F.when(token == ignore_index, F.lit(ignore_token)).otherwise(known)

    # A subquery cannot stand inside a lambda, so it has a column for as long as this takes.
    looked_up = df.withColumn("_vocabulary", words.scalar())
    return looked_up.withColumn(alias, F.array_join(F.transform(as_column(ids), word), " ")).drop("_vocabulary")


def greedy_ids(logits: Column | str) -> Column:
    """Most likely class of each position, from an array of logit arrays."""
    return F.transform(
        as_column(logits), lambda v: (F.array_position(v, F.array_max(v)) - 1).cast("int")
    )


def encode_with(make_encoder: Callable[[], Callable[[list[str]], list[list[int]]]]):
    """Arrow-batched column function around a real tokenizer, built once per task; NULL stays NULL."""

    @F.pandas_udf("array<int>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = make_encoder()
        for texts in batches:
            known = texts.notna()
            ids = iter(encoder(texts[known].tolist()))
            yield pd.Series([next(ids) if k else None for k in known], index=texts.index, dtype=object)

    return encode


def decode_with(
    make_decoder: Callable[[], Callable[[Sequence[Sequence[int]]], list[str]]],
    ignore_index: int = IGNORE_INDEX,
    ignore_id: int = 1,
):
    """Arrow-batched decoding with a real tokenizer; ignored positions become ``ignore_id``."""

    @F.pandas_udf("string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        decoder = make_decoder()
        for rows in batches:
            known = rows.notna()
            ids = [[ignore_id if t == ignore_index else int(t) for t in row] for row in rows[known]]
            texts = iter(decoder(ids))
            yield pd.Series([next(texts) if k else None for k in known], index=rows.index, dtype=object)

    return decode


@dataclass(frozen=True)
class PluggedTokenizer:
    """A real tokenizer in the place of ``HashTokenizer``: what the preparation steps ask of one.

    ``make_encoder`` and ``make_decoder`` are called once per task. ``special_ids`` names the
    ids of the special tokens in use.
    """

    make_encoder: Callable[[], Callable[[list[str]], list[list[int]]]]
    pad_id: int
    special_ids: Mapping[str, int]
    splits_at_specials = False
    make_decoder: Callable[[], Callable[[Sequence[Sequence[int]]], list[str]]] | None = None

    def special_id(self, token: str) -> int:
        return self.special_ids[token]

    def encode(self, text: Column | str, max_length: int | None = None) -> Column:
        ids = encode_with(self.make_encoder)(as_column(text))
        return ids if max_length is None else truncate(ids, max_length)

    def decode(self, ids: Column | str, ignore_index: int = IGNORE_INDEX) -> Column:
        return decode_with(self.make_decoder, ignore_index, self.pad_id)(as_column(ids))


Tokenizer = HashTokenizer | PluggedTokenizer
