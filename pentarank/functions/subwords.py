"""Lossless tokenizers: what is encoded comes back letter by letter, whatever the script.

The ids of ``HexTokenizer`` are the digits of the UTF-8 bytes and the special tokens, worked on by whole batches.
``byte_pair_tokenizer`` reads the ranks of a byte-level vocabulary from a file and merges pairs of
neighbouring parts, the lowest rank first; bytes that belong to no longer token stay tokens of their own.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F

from pentarank.functions.arrays import as_column
from pentarank.functions.tokens import SPECIAL_TOKENS, PluggedTokenizer, truncate
from pentarank.schemas import IGNORE_INDEX, IGNORE_TOKEN

BYTES = 256
DIGITS = "0123456789ABCDEF"
SPECIAL_HEX = tuple(t.encode().hex().upper() for t in SPECIAL_TOKENS)
SPECIAL_BYTES = {t.encode(): len(DIGITS) + k for k, t in enumerate(SPECIAL_TOKENS)}
#: Digits an id stands for, with none for what is no id.
WIDTHS = np.array([*[1] * len(DIGITS), *map(len, SPECIAL_HEX), 0])
#: The row of logits of each id, highest at the id.
LOGITS = np.eye(len(DIGITS) + len(SPECIAL_TOKENS))
#: Positions whose logits exist at once, and ids that are written out as digits at once.
SLICE = 4096
EXPANDED = 1 << 20
#: Bytes or ids of short texts that are worked on together.
PART = 1 << 20
CACHED_WORDS = 1 << 16

# Every character belongs to exactly one piece: letters, digits, symbols or white space.
_PIECES = re.compile(r" ?[^\W\d_]+| ?\d+| ?(?:[^\w\s]|_)+|\s+")
_SPECIALS = re.compile(b"|".join(re.escape(t) for t in sorted(SPECIAL_BYTES, key=len, reverse=True)))


def _list_values(ids: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All ids of a batch in a row, ``size`` standing for NULL; which are given; where each list starts, and the end."""
    flat = ids.flatten()
    given = np.asarray(flat.is_valid()) if flat.null_count else np.ones(len(flat), bool)
    lengths = pc.fill_null(pc.list_value_length(ids), 0)
    return np.asarray(pc.fill_null(flat, size)), given, _bounds(np.asarray(lengths))


def _bounds(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])


def _lists(values: pa.Array, bounds: np.ndarray, like: pa.Array) -> pa.Array:
    """Lists of ids, NULL where ``like`` is. Spark makes them ``array<int>``; between functions an id takes one byte."""
    mask = like.is_null() if like.null_count else None
    return pa.LargeListArray.from_arrays(pa.array(bounds), values, mask=mask)


def _by_parts(work: Callable[[pa.Array], pa.Array], rows: pa.Array, lengths: pa.Array) -> pa.Array:
    """``work`` on runs of rows of about ``PART`` bytes or ids, so that what it needs besides its result stays small."""
    parts = _bounds(np.asarray(pc.fill_null(lengths, 0)))[:-1] // PART
    cuts = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(rows)]
    return pa.concat_arrays([work(rows.slice(a, b - a)) for a, b in zip(cuts, cuts[1:])])


def _hex_ids(texts: pa.Array) -> pa.Array:
    """The ids of a batch of UTF-8 texts: two digits a byte, one id a special token."""
    whole = pc.fill_null(texts, b"").cast(pa.large_binary())
    starts = _bounds(np.asarray(pc.binary_length(whole)))
    _, places, held = whole.buffers()
    # The batch may be a part of its buffers.
    begin = np.frombuffer(places, np.int64)[whole.offset] if starts[-1] else 0
    data = memoryview(held or b"")[begin : begin + starts[-1]]
    octets = np.frombuffer(data, np.uint8)
    ids = np.empty(2 * len(octets), np.int8)
    ids[0::2], ids[1::2] = octets >> 4, octets & 15
    # Row by row, as no token reaches from one text into the next.
    found = (m for row in zip(starts[:-1].tolist(), starts[1:].tolist()) for m in _SPECIALS.finditer(data, *row))
    first, last, own = np.fromiter((x for m in found for x in (*m.span(), SPECIAL_BYTES[m.group()])), np.int64).reshape(-1, 3).T
    bounds = 2 * starts
    if len(first):
        ids[2 * first] = own
        # A token keeps its first place; the others go.
        steps = np.zeros(len(ids) + 1, np.int8)
        steps[2 * first + 1], steps[2 * last] = 1, -1
        ids = ids[np.cumsum(steps[:-1], dtype=np.int8) == 0]
        bounds = bounds - _bounds(2 * (last - first) - 1)[np.searchsorted(first, starts)]
    return _lists(pa.array(ids), bounds, texts)


def _spoken_ids(ids: pa.Array) -> pa.Array:
    """The class with the highest logit at each position, logits having their peak at its id; NULL outside the vocabulary."""
    size = len(LOGITS)
    values, given, bounds = _list_values(ids, size)
    known = given & (values >= 0) & (values < size)
    best = np.empty(len(values), np.int8)
    for at in range(0, len(values), SLICE):
        logits = np.take(LOGITS, values[at : at + SLICE], axis=0, mode="clip")
        best[at : at + SLICE] = logits.argmax(axis=1)
    return _lists(pa.array(best, mask=None if known.all() else ~known), bounds, ids)


def _hex_octets(ids: pa.Array, ignore_index: int) -> pa.Array:
    """The bytes of a batch of ids; an odd number of digits counts as led by a 0."""
    none = len(LOGITS)
    values, given, bounds = _list_values(ids, none)
    ignored = given & (values == ignore_index)
    codes = np.where(given & (values >= 0) & (values < none), values, none).astype(np.uint8)
    codes[ignored] = len(DIGITS) + SPECIAL_TOKENS.index(IGNORE_TOKEN)
    others = np.flatnonzero(codes >= len(DIGITS))
    if len(others):
        bounds = bounds + _bounds(WIDTHS[codes[others]] - 1)[np.searchsorted(others, bounds)]
        codes = np.concatenate([_digits(codes[at : at + EXPANDED]) for at in range(0, len(codes), EXPANDED)])
    odd = np.diff(bounds) % 2
    if odd.any():
        codes = np.insert(codes, bounds[:-1][odd == 1], 0)
        bounds = bounds + _bounds(odd)
    octets = codes[0::2] << 4 | codes[1::2]
    buffers = [None, pa.py_buffer(bounds // 2), pa.py_buffer(octets)]
    told = pa.Array.from_buffers(pa.large_binary(), len(ids), buffers)
    return pc.if_else(ids.is_valid(), told, pa.scalar(None, told.type)) if ids.null_count else told


def _digits(codes: np.ndarray) -> np.ndarray:
    """Digits as they are, special tokens as those of their bytes, nothing for what is no id."""
    out = np.repeat(codes, WIDTHS[codes])
    for k, token in enumerate(SPECIAL_HEX, len(DIGITS)):
        own = np.flatnonzero(out == k)
        out[own] = np.tile(np.array([DIGITS.index(d) for d in token], np.uint8), len(own) // len(token))
    return out


@dataclass(frozen=True)
class HexTokenizer:
    """The hexadecimal digits of the UTF-8 bytes as ids 0 to 15, two a byte, and special tokens after them.

    Its functions work on whole Arrow batches; one that takes the result of another gets it within the same
    Python task. The small vocabulary keeps a row of logits short.
    """

    splits_at_specials = True

    @property
    def vocab_size(self) -> int:
        return len(DIGITS) + len(SPECIAL_TOKENS)

    def special_id(self, token: str) -> int:
        return len(DIGITS) + SPECIAL_TOKENS.index(token)

    @property
    def pad_id(self) -> int:
        return self.special_id(IGNORE_TOKEN)

    def encode(self, text: Column | str, max_length: int | None = None) -> Column:
        """Ids of a text; special tokens in it become their own ids. NULL stays NULL."""

        @F.arrow_udf("array<int>")
        def encode(texts: pa.Array) -> pa.Array:
            return _by_parts(_hex_ids, texts, pc.binary_length(texts))

        whole = encode(F.encode(as_column(text), "UTF-8"))
        return whole if max_length is None else truncate(whole, max_length)

    def decode(self, ids: Column | str, ignore_index: int = IGNORE_INDEX) -> Column:
        """Text of ids; ignored positions become the ignore token, broken UTF-8 the replacement character.

        An id outside the vocabulary adds nothing.
        """

        @F.arrow_udf("binary")
        def decode(rows: pa.Array) -> pa.Array:
            return _by_parts(partial(_hex_octets, ignore_index=ignore_index), rows, pc.list_value_length(rows))

        return F.make_valid_utf8(decode(as_column(ids)).cast("string"))

    def spoken(self, ids: Column | str) -> Column:
        """Ids of a model that is sure of itself: logits with their peak at each id, decoded greedily.

        Logits are made a slice of positions at a time; no more than those of one slice exist at once.
        """

        @F.arrow_udf("array<int>")
        def spoken(rows: pa.Array) -> pa.Array:
            return _by_parts(_spoken_ids, rows, pc.list_value_length(rows))

        return spoken(as_column(ids))


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of tokens from lines of ``base64 rank``; every single byte must have one."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    if missing := [b for b in range(BYTES) if bytes([b]) not in ranks]:
        raise ValueError(f"{path} has no rank for {len(missing)} bytes")
    return ranks


def merge_parts(word: bytes, ranks: Mapping[bytes, int]) -> list[int]:
    """Ids of one piece: neighbours of the lowest rank merge first, the left ones of equal rank.

    Pairs wait in a heap and are skipped when one of their parts has changed meanwhile, so a
    piece of n bytes takes n log n steps.
    """
    if word in ranks:
        return [ranks[word]]
    end = list(range(1, len(word) + 1))
    before = list(range(-1, len(word) - 1))
    alive = [True] * len(word)
    pairs: list[tuple[int, int, int]] = []

    def offer(at: int) -> None:
        if at >= 0 and end[at] < len(word):
            stop = end[end[at]]
            rank = ranks.get(word[at:stop])
            if rank is not None:
                heapq.heappush(pairs, (rank, at, stop))

    for at in range(len(word) - 1):
        offer(at)
    while pairs:
        _, at, stop = heapq.heappop(pairs)
        if not alive[at] or end[at] >= len(word) or end[end[at]] != stop:
            continue
        gone = end[at]
        alive[gone], end[at] = False, stop
        if stop < len(word):
            before[stop] = at
        offer(at)
        offer(before[at])
    return [ranks[word[at : end[at]]] for at in range(len(word)) if alive[at]]


class BytePairEncoder:
    """Texts to ids, with the ids of words kept for as long as a task lasts."""

    def __init__(self, ranks: Mapping[bytes, int], specials: Mapping[str, int]):
        self.ranks, self.specials = ranks, specials
        names = sorted(specials, key=len, reverse=True)
        self.marks = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else re.compile("(?!)")
        self.words: dict[str, list[int]] = {}

    def _ids(self, piece: str) -> list[int]:
        ids = self.words.get(piece)
        if ids is None:
            ids = merge_parts(piece.encode(), self.ranks)
            if len(self.words) >= CACHED_WORDS:
                self.words.clear()
            self.words[piece] = ids
        return ids

    def _encode(self, text: str) -> list[int]:
        out: list[int] = []
        for part in self.marks.split(text):
            if part in self.specials:
                out.append(self.specials[part])
            else:
                for piece in _PIECES.findall(part):
                    out += self._ids(piece)
        return out

    def __call__(self, texts: Sequence[str]) -> list[list[int]]:
        return [self._encode(text) for text in texts]


class BytePairDecoder:
    """Ids to texts; unknown ids add nothing, broken UTF-8 becomes the replacement character."""

    def __init__(self, ranks: Mapping[bytes, int], specials: Mapping[str, int]):
        self.tokens = {rank: token for token, rank in ranks.items()} | {i: t.encode() for t, i in specials.items()}

    def __call__(self, rows: Sequence[Sequence[int]]) -> list[str]:
        return [b"".join(self.tokens.get(t, b"") for t in row).decode("utf-8", "replace") for row in rows]


def byte_pair_tokenizer(path: str, specials: Sequence[str] = SPECIAL_TOKENS) -> PluggedTokenizer:
    """A byte-level subword tokenizer from a file of ranks, for every step that takes a tokenizer.

    The file is read once, on the driver; its ranks travel to the tasks with the function. Special
    tokens get the ids after the last rank.
    """
    ranks = read_ranks(path)
    first = max(ranks.values()) + 1
    ids = {token: first + k for k, token in enumerate(specials)}
    return PluggedTokenizer(
        make_encoder=partial(BytePairEncoder, ranks, ids), pad_id=ids[IGNORE_TOKEN], special_ids=ids,
        make_decoder=partial(BytePairDecoder, ranks, ids),
    )
