"""Sequences that arrive in pieces, held in keyed state."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from pentarank.operators import metrics
from pentarank.streaming import running, sequences

DDL = "run string, seq_id long, pos int, logits array<double>, target int, ts timestamp, length long"
START = 1_700_000_000


def write(spark, folder, rows, second):
    """``rows``: (seq, pos, target, length); one file, all at one time."""
    made = [("a", s, p, [0.5 * p, 1.0, float(s or 0)], t, n) for s, p, t, n in rows]
    df = spark.createDataFrame(made, "run string, seq_id long, pos int, logits array<double>, target int, length long")
    df = df.withColumn("ts", F.timestamp_seconds(F.lit(START + second)))
    df.select("run", "seq_id", "pos", "logits", "target", "ts", "length").coalesce(1).write.mode("append").parquet(folder)


def run(spark, tmp_path, **options):
    stream = sequences.token_stream(spark, str(tmp_path / "in"), DDL, 1)
    sums = sequences.sequence_sums(stream, ["run"], length_col="length", **options)
    query = sequences.store_sequence_sums(sums, str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination()
    return query


def sums_of(spark, tmp_path):
    out = spark.read.parquet(str(tmp_path / "out")).groupBy("seq_id").agg(F.sum("total").alias("total"), F.sum("n_tokens").alias("n"))
    return {r.seq_id: (round(r.total, 9), r.n) for r in out.collect()}


def expected(spark, rows):
    made = [(s, p, [0.5 * p, 1.0, float(s)], t) for s, p, t, _ in {r[:2]: r for r in rows}.values()]
    df = spark.createDataFrame(made, "seq_id long, pos int, logits array<double>, target int")
    from pentarank.functions import vectors

    out = df.withColumn("lp", vectors.target_log_prob("logits", "target")).groupBy("seq_id").agg(F.coalesce(F.sum("lp"), F.lit(0.0)).alias("t"), F.count("lp").alias("n"))
    return {r.seq_id: (round(r.t, 9), r.n) for r in out.collect()}


@pytest.mark.parametrize("block", [4096, 2])
def test_pieces_replays_and_late_rows(spark, tmp_path, block):
    rows = [(s, p, -100 if (s + p) % 4 == 0 else p % 3, None) for s in range(5) for p in range(7)]
    folder = str(tmp_path / "in")
    for piece in (0, 1, 2, 1):
        write(spark, folder, [r for r in rows if r[1] % 3 == piece], piece)
    # The first run ends with everything open: nothing is told yet, all is in the state.
    run(spark, tmp_path, block=block)
    assert spark.read.schema("seq_id long").parquet(str(tmp_path / "out")).count() == 0
    write(spark, folder, [(None, 0, 0, None)], 86_400)
    run(spark, tmp_path, block=block)
    want = expected(spark, rows)
    assert sums_of(spark, tmp_path) == want
    # A replay after that time is late: it is dropped and counted, and changes nothing.
    write(spark, folder, [r for r in rows if r[1] % 3 == 1], 1)
    query = run(spark, tmp_path, block=block)
    assert sum(s.numRowsDroppedByWatermark for p in query.recentProgress for s in p.stateOperators) > 0
    assert sums_of(spark, tmp_path) == want
    batch = metrics.evaluate(
        spark.createDataFrame([(t / n,) for t, n in want.values()], "mean_log_prob double"), [metrics.perplexity()]
    ).first()[0]
    streamed = running.accumulated_perplexity(spark, str(tmp_path / "out"), ["run"]).first()
    assert math.isclose(streamed.perplexity, batch, rel_tol=1e-9)


def test_complete_blocks_are_told_at_once(spark, tmp_path):
    rows = [(s, p, 1, 5) for s in range(3) for p in range(5)]
    folder = str(tmp_path / "in")
    write(spark, folder, [r for r in rows if r[1] < 3], 0)
    write(spark, folder, [r for r in rows if r[1] >= 3 and r[0] < 2], 1)
    run(spark, tmp_path, block=4)
    told = spark.read.parquet(str(tmp_path / "out"))
    assert {(r.seq_id, r.block) for r in told.collect()} == {(0, 0), (0, 1), (1, 0), (1, 1)}
    # The rest is told when its time is up, incomplete as it is; what was told is not told again.
    write(spark, folder, [r for r in rows if r[0] == 1], 2)
    write(spark, folder, [(None, 0, 0, None)], 86_400)
    run(spark, tmp_path, block=4)
    assert sums_of(spark, tmp_path) == expected(spark, [r for r in rows if r[0] < 2 or r[1] < 3])
