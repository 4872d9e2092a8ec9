"""Resizing image columns."""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from pentarank.schemas import IMAGE_COLUMNS, RESIZED_SIDE

_RESIZED = "pixels array<float>, error string"
STACK_BYTES = 64 << 20


@lru_cache(maxsize=256)
def resize_weights(length: int, side: int, antialias: bool = True) -> np.ndarray:
    """``(side, length)``: the share of each pixel of a line in each pixel of the resized line.

    A triangle around the centre of the new pixel, as wide as two old pixels, or two new ones where
    ``antialias`` and the line shrinks, so that every old pixel counts. Rows add up to 1.
    """
    scale = length / side
    reach = max(scale, 1.0) if antialias else 1.0
    centre = (np.arange(side) + 0.5) * scale
    if not antialias:
        # A line that shrinks is sampled between its two nearest pixels.
        centre = np.clip(centre, 0.5, length - 0.5)
    away = np.abs(np.arange(length) + 0.5 - centre[:, None]) / reach
    weights = np.maximum(0.0, 1.0 - away)
    return weights / weights.sum(1, keepdims=True)


def _resized(stack: np.ndarray, side: int, antialias: bool) -> np.ndarray:
    """Pictures ``(n, height, width, 3)`` of one size as ``(n, 3 * side * side)``: two matrix products for all."""
    rows, columns = (resize_weights(length, side, antialias) for length in stack.shape[1:3])
    lines = np.tensordot(rows, stack, (1, 1))
    small = np.tensordot(columns, lines, (1, 2))
    return small.transpose(2, 3, 1, 0).reshape(len(stack), -1).astype(np.float32)


def _to_rgb(height: int, width: int, channels: int, data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, dtype=np.uint8)
    picture = raw.reshape(height, width, channels).astype(np.float64)
    if channels == 1:
        return np.repeat(picture, 3, axis=2)
    return picture[:, :, 2::-1]


def resize_images(
    df: DataFrame,
    columns: Sequence[str] = IMAGE_COLUMNS,
    side: int = RESIZED_SIDE,
    alias: str = "pixel_values",
    antialias: bool = False,
) -> DataFrame:
    """Stack the images of a record as flat channel-first RGB arrays of equal size.

    Columns hold the struct of Spark's ``image`` source. An unreadable picture leaves a
    NULL in the stack and its reason in ``image_error``. With ``antialias`` a picture that shrinks is
    averaged over all its pixels; without, new pixels are sampled between the nearest old ones.

    Pictures of one size in an Arrow batch are resized together, in stacks of bounded size.
    """

    @F.pandas_udf(_RESIZED)
    def resize(images: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = [(None, None)] * len(images)
        waiting: dict[tuple[int, int], list[tuple[int, np.ndarray]]] = {}

        def flush(size: tuple[int, int]) -> None:
            held = waiting.pop(size)
            for (k, _), pixels in zip(held, _resized(np.stack([rgb for _, rgb in held]), side, antialias)):
                out[k] = (pixels, None)

        for k, image in enumerate(images.itertuples(index=False)):
            try:
                # A NULL picture among others turns their numbers into floats.
                height, width, channels = int(image.height), int(image.width), int(image.nChannels)
                if height <= 0 or channels not in (1, 3, 4):
                    raise ValueError("undecodable image")
                rgb = _to_rgb(height, width, channels, image.data)
            except (TypeError, ValueError) as exc:
                out[k] = (None, str(exc))
                continue
            held = waiting.setdefault(rgb.shape[:2], [])
            held.append((k, rgb))
            if len(held) * rgb.nbytes >= STACK_BYTES:
                flush(rgb.shape[:2])
        for size in list(waiting):
            flush(size)
        return pd.DataFrame(out, columns=["pixels", "error"])

    made = {f"_resized_{i}": resize(F.col(c)) for i, c in enumerate(columns)}
    resized = df.withColumns(made)
    problems = F.concat_ws("; ", *[F.col(f"{m}.error") for m in made])
    return resized.withColumns(
        {
            alias: F.array(*[F.col(f"{m}.pixels") for m in made]),
            "image_error": F.nullif(problems, F.lit("")),
        }
    ).drop(*made)
