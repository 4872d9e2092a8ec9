"""Log-probabilities of sequences whose tokens arrive in pieces, held in keyed state.

State belongs to a sequence's block of positions: the positions seen with their log-probabilities.
A position that arrives again replaces itself, so replayed files and repeated rows count once.
A block leaves as one row of sums once all of it is there, or when event time has moved past its
last piece by the allowed lateness; its state goes at that time. What arrives later still is
dropped by the watermark and counted in the query's progress.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from pentarank.functions import vectors

BLOCK = 4096
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_PARTITIONS = "spark.sql.shuffle.partitions"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Sums(StatefulProcessor):
    """Sums of one block, told once: when it is whole, or when its time is up."""

    def __init__(self, names: Sequence[str], block: int, lateness_ms: int):
        self.names, self.block, self.lateness_ms = list(names), block, lateness_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("seen", "positions array<int>, log_probs array<double>, until long, told boolean")

    def _row(self, key: tuple, log_probs: list) -> pd.DataFrame:
        known = [x for x in log_probs if x is not None]
        values = [*key, math.fsum(known), len(known)]
        return pd.DataFrame([values], columns=[*self.names, "total", "n_tokens"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        positions, log_probs, until, told = self.state.get() if self.state.exists() else ([], [], 0, False)
        seen, expected = dict(zip(positions, log_probs)), None
        for frame in rows:
            values = [None if pd.isna(x) else float(x) for x in frame["log_prob"]]
            seen.update(zip(map(int, frame["pos"]), values))
            until = max(until, int(frame["at_ms"].max()) + self.lateness_ms)
            if frame["length"].notna().any():
                expected = min(self.block, int(frame["length"].max()) - int(key[-1]) * self.block)
        if not told and expected is not None and len(seen) >= expected:
            told = True
            yield self._row(key, list(seen.values()))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(until)
        self.state.update((list(seen), list(seen.values()), until, told))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            _, log_probs, _, told = self.state.get()
            self.state.clear()
            if not told:
                yield self._row(key, list(log_probs))

    def close(self) -> None:
        pass


def sequence_sums(
    tokens: DataFrame,
    by: Sequence[str] = (),
    seq_col: str = "seq_id",
    pos_col: str = "pos",
    time_col: str = "ts",
    length_col: str | None = None,
    lateness: str = "1 hour",
    block: int = BLOCK,
) -> DataFrame:
    """``(by, seq, block, total, n_tokens)`` of a stream of tokens ``(seq, pos, logits, target, time)``.

    Scores are computed before the exchange; only they travel to the state. Blocks of positions
    spread a very long sequence over all tasks and bound the state behind one key. With
    ``length_col``, the tokens of the whole sequence, a block is told as soon as it is complete. A NULL
    sequence only moves the time on, as a mark at the end of a source does.
    """
    lateness_ms = int(pd.Timedelta(lateness).total_seconds() * 1000)
    length = F.lit(None).cast("long") if length_col is None else F.col(length_col).cast("long")
    scored = tokens.withWatermark(time_col, lateness).select(
        *by, F.col(seq_col), F.expr(f"cast({pos_col} div {block} as long)").alias("block"), F.col(pos_col).cast("int").alias("pos"),
        vectors.target_log_prob("logits", "target").alias("log_prob"), length.alias("length"),
        F.unix_millis(time_col).alias("at_ms"), F.col(time_col),
    )
    keys = [*by, seq_col, "block"]
    types = ", ".join(f"`{k}` {scored.schema[k].dataType.simpleString()}" for k in keys)
    sums = scored.groupBy(*keys).transformWithStateInPandas(
        _Sums(keys, block, lateness_ms), f"{types}, total double, n_tokens long", "Append", "EventTime"
    )
    return sums.filter(F.col(seq_col).isNotNull())


def store_sequence_sums(sums: DataFrame, target: str, checkpoint: str, state_partitions: int | None = None) -> StreamingQuery:
    """Append finished sums to ``target`` for all that has arrived, then stop.

    State and progress live in ``checkpoint``: a run that fails, or ends, is taken up by the
    next one, and the file sink lists each batch once. Keyed state needs the RocksDB state store, which
    is set for this query alone, and so is ``state_partitions``: over how many tasks the state is dealt, for the life of
    the checkpoint; the session's shuffle partitions by default. Read the result with ``running.accumulated_perplexity``.
    """
    spark = sums.sparkSession
    wanted = {_PROVIDER: _ROCKS}
    if state_partitions is not None:
        wanted[_PARTITIONS] = str(state_partitions)
    before = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        # The query takes the settings it finds when it starts.
        return (
            sums.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start(target)
        )
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def token_stream(spark: SparkSession, source: str, schema: str, files_per_batch: int | None = None) -> DataFrame:
    """Parquet files of a folder as they arrive, oldest first, at most so many a batch."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet")
    return (reader if files_per_batch is None else reader.option("maxFilesPerTrigger", files_per_batch)).parquet(source)
