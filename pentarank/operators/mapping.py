"""Batched Python functions over columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from pentarank.schemas import MAP_BATCH

ListColumns = dict[str, list]


def batched_map(
    df: DataFrame,
    fn: Callable[[ListColumns], Mapping[str, Sequence]],
    output: T.StructType | str,
    input_columns: Sequence[str],
    batch_size: int = MAP_BATCH,
    remove_columns: Sequence[str] = (),
    num_partitions: int | None = None,
) -> DataFrame:
    """Add the columns ``fn`` computes from batches of rows, then drop ``remove_columns``.

    ``fn`` gets a dict of lists and returns one of the same length; it must not depend
    on where batches are cut. Only ``input_columns`` travel to Python, all others stay
    in the JVM. ``num_partitions`` spreads slow functions over more tasks.
    """
    schema = T.StructType.fromDDL(output) if isinstance(output, str) else output
    names = list(input_columns)

    def apply(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            done = []
            for start in range(0, len(frame), batch_size):
                chunk = frame.iloc[start : start + batch_size]
                made = fn({c: chunk[c].tolist() for c in names})
                done.append(pd.DataFrame({f.name: list(made[f.name]) for f in schema}))
                if len(done[-1]) != len(chunk):
                    raise ValueError("a batched function must keep the number of rows")
            if done:
                yield pd.concat(done, ignore_index=True)
            else:
                yield pd.DataFrame({f.name: [] for f in schema})

    call = F.pandas_udf(apply, schema).asNondeterministic()
    spread = df if num_partitions is None else df.repartition(num_partitions)
    mapped = spread.withColumn("_made", call(F.struct(*names)))
    made = {f.name: F.col("_made")[f.name] for f in schema}
    return mapped.withColumns(made).drop("_made", *[c for c in remove_columns if c not in made])


def hashing_embedder(dimension: int = 512) -> Callable[[list[str]], np.ndarray]:
    """Stand-in embedding: counts of hashed words, scaled to unit length."""
    from zlib import crc32

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dimension), dtype=np.float32)
        for row, text in enumerate(texts):
            for word in (text or "").lower().split():
                out[row, crc32(word.encode()) % dimension] += 1.0
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norms == 0, 1, norms)

    return embed


def embed_column(
    df: DataFrame,
    column: str,
    embed_fn: Callable[[list[str]], np.ndarray],
    alias: str = "embedding",
    batch_size: int = MAP_BATCH,
) -> DataFrame:
    """Add vectors computed by a user function in batches."""

    def run(batch: ListColumns) -> dict[str, list]:
        return {alias: [v.tolist() for v in np.asarray(embed_fn(batch[column]))]}

    output = T.StructType([T.StructField(alias, T.ArrayType(T.FloatType()))])
    return batched_map(df, run, output, [column], batch_size)
