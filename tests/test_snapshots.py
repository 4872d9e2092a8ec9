"""Snapshots that are published whole or not at all, and the log of failed ids."""

from __future__ import annotations

import json
import os
import threading

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from pentarank.operators import generation
from pentarank.sources import ledger, snapshots


def ids(df):
    return sorted(r.id for r in df.select("id").collect())


def test_readers_see_published_snapshots_only(spark, tmp_path):
    path = str(tmp_path / "s")
    with pytest.raises(FileNotFoundError):
        snapshots.read_snapshot(spark, path)
    assert snapshots.write_snapshot(spark.range(10), path) == 1
    first = snapshots.read_snapshot(spark, path)
    assert snapshots.write_snapshot(spark.range(10, 15), path) == 2
    broken = spark.range(0, 100, 1, 4).select(F.when(F.col("id") == 60, F.raise_error(F.lit("halfway")).cast("long")).otherwise(F.col("id")).alias("id"))
    for mode in ("append", "replace"):
        with pytest.raises(PySparkException, match="halfway"):
            snapshots.write_snapshot(broken, path, mode=mode)
    assert ids(snapshots.read_snapshot(spark, path)) == list(range(15))
    assert snapshots.write_snapshot(spark.range(3), path, mode="replace") == 3
    assert ids(snapshots.read_snapshot(spark, path)) == [0, 1, 2]
    # A snapshot that was opened earlier stays whole.
    assert ids(first) == list(range(10)) and ids(snapshots.read_snapshot(spark, path, 2)) == list(range(15))
    assert len(snapshots.vacuum(spark, path, keep=1)) == 2
    assert snapshots.versions(spark, path) == [3] and ids(snapshots.read_snapshot(spark, path)) == [0, 1, 2]
    with pytest.raises(ValueError):
        snapshots.write_snapshot(spark.range(1), path, mode="overwrite")


def test_writers_at_the_same_time_lose_nothing(spark, tmp_path):
    path, made = str(tmp_path / "s"), []
    writers = [threading.Thread(target=lambda k=k: made.append(snapshots.write_snapshot(spark.range(k, k + 1), path))) for k in range(6)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert sorted(made) == [1, 2, 3, 4, 5, 6] and ids(snapshots.read_snapshot(spark, path)) == list(range(6))
    with pytest.raises(snapshots.SnapshotConflict):
        snapshots.write_snapshot(spark.range(1), path, expected=5)
    assert not [n for n in os.listdir(tmp_path / "s" / "log") if n.startswith(".") and not n.endswith(".crc")]


def test_columns_may_come_and_go(spark, tmp_path):
    path = str(tmp_path / "s")
    snapshots.write_snapshot(spark.range(2).withColumn("a", F.lit("x")), path)
    snapshots.write_snapshot(spark.range(2, 3).withColumn("b", F.lit(1.5)), path, expected=1)
    rows = snapshots.read_snapshot(spark, path).orderBy("id").collect()
    assert [tuple(r) for r in rows] == [(0, "x", None), (1, "x", None), (2, None, 1.5)]
    with pytest.raises(ValueError, match="a was string"):
        snapshots.write_snapshot(spark.range(1).withColumn("a", F.lit(1)), path)
    assert snapshots.versions(spark, path) == [1, 2]
    snapshots.write_snapshot(spark.range(0), path, mode="replace")
    assert snapshots.read_snapshot(spark, path).count() == 0


@pytest.mark.parametrize("array", [[], [3], [3, 13, -23], list(range(5000))])
@pytest.mark.parametrize("indent", [None, 2])
def test_id_arrays_are_read_in_pieces(spark, tmp_path, array, indent):
    (tmp_path / "failed.json").write_text(json.dumps(array, indent=indent) + "\n")
    found = ledger.read_id_array(spark, str(tmp_path / "failed.json"))
    assert ids(found) == sorted(array)


@pytest.mark.parametrize("text", ['{"id": 3}', "[1, x]", '["1"]', "[1.5]", "[1 2]", "[null]"])
def test_other_files_are_no_id_lists(spark, tmp_path, text):
    (tmp_path / "failed.json").write_text(text)
    with pytest.raises(PySparkException):
        ledger.read_id_array(spark, str(tmp_path / "failed.json")).collect()


def test_huge_array_is_split_among_tasks(spark, tmp_path):
    (tmp_path / "failed.json").write_text(json.dumps(list(range(200_000))))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        found = ledger.read_id_array(spark, str(tmp_path / "failed.json"))
        assert found.rdd.getNumPartitions() > 8
        assert tuple(found.agg(F.count("*"), F.sum("id"), F.count_distinct("id")).first()) == (200_000, 199_999 * 100_000, 200_000)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_events_fold_to_what_is_left(spark, tmp_path):
    log = str(tmp_path / "log")

    def outcomes(*rows):
        return spark.createDataFrame(rows, "id int, error string")

    ledger.append_events(outcomes((1, "a"), (2, None), (3, "b"), (4, "c")), log, 1)
    ledger.append_events(outcomes((1, None), (3, "d"), (4, "e"), (4, None)), log, 2)
    events = ledger.read_events(spark, log)
    folded = {r.id: (r.attempt, r.error, r.attempts) for r in ledger.fold_events(events).collect()}
    assert folded == {1: (2, None, 2), 2: (1, None, 1), 3: (2, "d", 2), 4: (2, None, 2)}
    older = spark.createDataFrame([(2,), (3,), (9,)], "id int")
    assert {(r.id, r.error) for r in ledger.remaining(events, older).collect()} == {(3, "d"), (9, "failed before")}
    # Logging an attempt twice changes nothing.
    ledger.append_events(outcomes((3, "d"), (1, None)), log, 2)
    assert {(r.id, r.error) for r in ledger.remaining(ledger.read_events(spark, log)).collect()} == {(3, "d")}


def test_answered_prompts_are_asked_once(spark, tmp_path):
    """A client that notes every call: failing prompts are asked again, answered ones never."""
    calls, busy = tmp_path / "calls", tmp_path / "busy"
    calls.mkdir(), busy.mkdir()

    def make():
        import time
        import uuid

        running = []

        def ask(prompt):
            running.append(prompt)
            (busy / f"{len(running)}").touch()
            (calls / f"{prompt}-{uuid.uuid4().hex}").touch()
            time.sleep(0.005)
            running.remove(prompt)
            tries = len([n for n in os.listdir(calls) if n.startswith(f"{prompt}-")])
            if prompt == "p3" or (prompt == "p5" and tries < 2):
                raise RuntimeError("no luck")
            if prompt == "p7" and tries < 3:
                raise generation.RetryLater(0.01)
            if prompt == "p8":
                raise KeyError("hopeless")
            return None if prompt == "p9" else prompt.upper()

        return ask

    df = spark.createDataFrame([(k, None if k == 4 else f"p{k}") for k in range(40)], "id int, prompt string").coalesce(2)
    asked = generation.ask_prompts(df, make, concurrency=3, backoff=0.0, retry_on=(RuntimeError, generation.RetryLater))
    rows = {r.id: (r.reply, r.error, r.attempts) for r in asked.collect()}
    seen = [n.split("-")[0] for n in os.listdir(calls)]
    want = {3: (None, "RuntimeError: no luck", 3), 4: (None, "no prompt", 0), 5: ("P5", None, 2), 7: ("P7", None, 3), 8: (None, "KeyError: 'hopeless'", 1), 9: (None, "no reply", 3)}
    for k in range(40):
        assert rows[k] == want.get(k, (f"P{k}", None, 1))
        assert seen.count(f"p{k}") == rows[k][2]
    # No more than three at a time in any task.
    assert max(map(int, os.listdir(busy))) <= 3
