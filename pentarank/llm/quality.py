"""Quality classifier: supervised subword embeddings.

A text is three families of hashed features: words, word bigrams, and the character n-grams
of words with their borders. Each family's learned vectors are averaged over the document,
the three averages are averaged again, and a softmax layer reads the result. Vectors and
layer are trained together by stochastic gradient descent in numpy.

The layer is linear, so for scoring each bucket's vector is multiplied with it once; a
document's score then needs one number per feature. Hashes are differences of polynomial
prefix sums over the text's bytes, taken for all positions of a text at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pentarank.llm.common import SPACES

# Odd multipliers of the polynomial and the mixers, as usual for 64-bit hashing.
BASE = np.uint64(0x100000001B3)
MIX = np.uint64(0x9E3779B97F4A7C15)
UNBASE = np.uint64(pow(0x100000001B3, -1, 1 << 64))
CHUNK = 1 << 17
FAMILIES = 3
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[np.frombuffer(SPACES.encode(), np.uint8)] = True


@dataclass(frozen=True)
class Settings:
    """``max_train`` bounds the labelled documents used for training, whatever their number."""

    bits: int = 16
    dim: int = 12
    ngrams: tuple[int, ...] = (2, 3, 4)
    max_train: int = 6000
    epochs: int = 6
    rate: float = 0.4
    seed: int = 42

    @property
    def id_type(self) -> type:
        """The narrowest type of a bucket's number: bags are what training sends to the driver."""
        return np.uint16 if self.bits <= 16 else np.uint32


def _powers(base: np.uint64, size: int) -> np.ndarray:
    powers = np.full(size, base, dtype=np.uint64)
    powers[0] = 1
    return np.cumprod(powers, dtype=np.uint64)


_POWERS, _UNPOWERS = _powers(BASE, CHUNK + 8), _powers(UNBASE, CHUNK + 8)


def _spans(data: bytes) -> Iterator[bytes]:
    """The text in parts of at most ``CHUNK`` bytes, cut after white space where there is any."""
    start = 0
    while len(data) - start > CHUNK:
        window = np.frombuffer(data, np.uint8, CHUNK, start)
        spaces = np.flatnonzero(_IS_SPACE[window])
        size = int(spaces[-1]) + 1 if len(spaces) else CHUNK
        yield data[start : start + size]
        start += size
    yield data[start:]


def _buckets(hashes: np.ndarray, salt: int, bits: int) -> np.ndarray:
    mixed = (hashes + np.uint64(salt)) * MIX
    mixed ^= mixed >> np.uint64(29)
    return ((mixed * MIX) >> np.uint64(64 - bits)).astype(np.int64)


def features(text: str, settings: Settings) -> Iterator[tuple[int, np.ndarray]]:
    """``(family, buckets)`` of the text, repeats included, a part at a time.

    A bigram's hash is the difference of its words' hashes: a word that follows itself falls
    in one bucket, whichever word it is, so that repetition can be learned. Characters are the bytes of UTF-8. What
    lies across two parts of a long text is carried over, so the parts leave no trace.
    """
    parts, longest = list(_spans(text.encode())), max(settings.ngrams, default=1)
    tail, last = b" ", np.zeros(0, np.uint64)
    begun, begun_size = 0, 0
    for k, part in enumerate(parts):
        raw = np.frombuffer(tail + part + (b" " if k == len(parts) - 1 else b""), np.uint8)
        space = _IS_SPACE[raw]
        symbol = np.where(space, 32, raw).astype(np.uint64) + np.uint64(1)
        total = np.concatenate(([np.uint64(0)], np.cumsum(symbol * _POWERS[: len(raw)], dtype=np.uint64)))
        # Words of the new bytes alone; a first one without space before it goes on with the one begun.
        old = len(tail)
        edges = np.flatnonzero(np.diff(space[old:].astype(np.int8), prepend=1, append=1))
        starts, ends = edges[::2] + old, edges[1::2] + old
        word = (total[ends] - total[starts]) * _UNPOWERS[starts]
        if begun_size:
            whole = np.array([begun], np.uint64)
            if len(starts) and starts[0] == old:
                word[:1] = whole + word[:1] * np.uint64(pow(int(BASE), begun_size, 1 << 64))
            else:
                word, starts, ends = np.concatenate((whole, word)), np.concatenate(([old], starts)), np.concatenate(([old], ends))
        open_end = len(word) > 0 and not space[-1]
        begun_size = (begun_size if ends[-1] - starts[-1] == len(raw) - old else 0) + int(ends[-1] - starts[-1]) if open_end else 0
        if open_end:
            begun, word = int(word[-1]), word[:-1]
        if len(word):
            yield 0, _buckets(word, 1, settings.bits)
        near = np.concatenate((last, word))
        if len(near) > 1:
            yield 1, _buckets(near[1:] - near[:-1], 2, settings.bits)
        last = near[-1:]
        gaps = np.concatenate(([0], np.cumsum(space)))
        for n in settings.ngrams:
            at = np.arange(max(0, old - n + 1), len(raw) - n + 1)
            # White space may be the first or the last character, never inside.
            at = at[(gaps[at + n - 1] - gaps[at + 1] == 0) & ~(space[at] & space[at + n - 1])] if n > 2 else at[~(space[at] & space[at + n - 1])]
            yield 2, _buckets((total[at + n] - total[at]) * _UNPOWERS[at], 10 + n, settings.bits)
        tail = raw[max(0, len(raw) - longest + 1) :].tobytes()


def _bag(text: str, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and their weights; weights of a text with words sum to one."""
    size = 1 << settings.bits
    counts = [np.zeros(size, np.float32) for _ in range(FAMILIES)]
    for family, buckets in features(text, settings):
        counts[family] += np.bincount(buckets, minlength=size).astype(np.float32)
    weights = np.zeros(size, np.float32)
    for family in counts:
        if total := family.sum():
            weights += family / (total * FAMILIES)
    ids = np.flatnonzero(weights)
    return ids.astype(settings.id_type), weights[ids]


@dataclass
class Model:
    """``table``: what a bucket adds to the log-odds of label 1; ``bias``: that of an empty text."""

    table: np.ndarray
    bias: float
    settings: Settings

    def score(self, text: str | None) -> float:
        sums, counts = [0.0] * FAMILIES, [0] * FAMILIES
        for family, buckets in features(text or "", self.settings):
            sums[family] += float(self.table[buckets].sum(dtype=np.float64))
            counts[family] += len(buckets)
        odds = self.bias + sum(s / (c * FAMILIES) for s, c in zip(sums, counts) if c)
        return float(1.0 / (1.0 + np.exp(-np.clip(odds, -40.0, 40.0))))


def fit(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, settings: Settings) -> Model:
    """Train on weighted bags of buckets; no rows, or one class alone, give a constant score.

    Loss is the softmax cross-entropy; the step falls linearly to zero. Vectors' steps are
    scaled by ``dim`` times the buckets' share, as an average moves each vector little.
    """
    size, rng = 1 << settings.bits, np.random.default_rng(settings.seed)
    vectors = rng.uniform(-1 / settings.dim, 1 / settings.dim, (size, settings.dim)).astype(np.float32)
    layer = np.zeros((settings.dim, 2), np.float32)
    shift = np.zeros(2, np.float32)
    share = (labels.sum() + 1.0) / (len(labels) + 2.0)
    shift[1] = np.log(share / (1 - share))
    steps, done = max(1, len(bags) * settings.epochs), 0
    for _ in range(settings.epochs):
        for k in rng.permutation(len(bags)):
            ids, weights = bags[k]
            rate = settings.rate * (1 - done / steps)
            done += 1
            hidden = weights @ vectors[ids]
            logits = hidden @ layer + shift
            chance = np.exp(logits - logits.max())
            chance /= chance.sum()
            chance[labels[k]] -= 1.0
            back = layer @ chance
            layer -= rate * np.outer(hidden, chance)
            shift -= 0.02 * rate * chance
            vectors[ids] -= (rate * 200.0 * weights)[:, None] * back
    pull = layer[:, 1] - layer[:, 0]
    return Model((vectors @ pull).astype(np.float32), float(shift[1] - shift[0]), settings)


def train(labelled: DataFrame, settings: Settings = Settings()) -> Model:
    """Fit on ``(text, label)`` rows with label 0 or 1; other labels and NULL texts are left out.

    At most about ``max_train`` texts, drawn by a hash of the text, become bags in the executors;
    only these bags reach the driver. A drawn text counts once however many copies it has, so
    their number grows neither with the table nor with its copies.
    """
    rows = labelled.filter("label in (0, 1) and text is not null").select("text", "label")
    count = rows.count()
    share = F.pmod(F.xxhash64(F.lit(settings.seed), "text"), F.lit(1 << 20)) / float(1 << 20)
    drawn = rows.filter(share < settings.max_train / max(count, 1)).groupBy("text").agg(F.min("label").alias("label"))

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 64):
                part = batch.slice(lo, 64)
                made = [_bag(t.as_py(), settings) for t in part.column(0)]
                ids, weights = ([m[k].tobytes() for m in made] for k in (0, 1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.binary()), pa.array(weights, pa.binary()), part.column(1), part.column(2)],
                    ["ids", "weights", "label", "place"],
                )

    rows = drawn.select("text", F.col("label").cast("int"), F.xxhash64("text").alias("place"))
    got = rows.mapInArrow(bags, "ids binary, weights binary, label int, place long").toArrow()
    # Views of what has arrived, in an order that does not depend on Spark's partitions.
    order = np.argsort(got["place"].to_numpy(), kind="stable")
    ids, weights = ([x.as_buffer() for x in got[c]] for c in ("ids", "weights"))
    made = [(np.frombuffer(ids[k], settings.id_type), np.frombuffer(weights[k], np.float32)) for k in order]
    return fit(made, got["label"].to_numpy().astype(np.int64)[order], settings)


def score_texts(model: Model, text: Column) -> Column:
    """Score between 0 and 1 of each text; NULL scores as the empty text."""

    @F.pandas_udf("double")
    def scored(texts):
        import pandas as pd

        return pd.Series([model.score(t) for t in texts], dtype="float64")

    return scored(text)


def classify(
    docs: DataFrame,
    labelled: DataFrame,
    threshold: float = 0.7,
    settings: Settings = Settings(),
    text_col: str = "text",
) -> DataFrame:
    """Add ``score`` and ``predicted`` to ``docs``; trains first, which runs jobs at once.

    NULL and empty texts get the score of the labels' share. Repeated rows score alike.
    Columns named ``score`` or ``predicted`` are replaced. The model is a few hundred
    kilobytes, fixed by ``settings``, and goes out with the tasks.
    """
    model = train(labelled, settings)
    scored = docs.withColumn("score", score_texts(model, F.col(text_col)))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
