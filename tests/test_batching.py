from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from pentarank.operators import batching
from pentarank.plans import inputs


def expected_order(ids, seed=42):
    return sorted(ids, key=lambda i: (hashlib.md5(f"{seed}-{i}".encode()).hexdigest(), i))


@pytest.mark.parametrize("partitions", [1, 7])
def test_shuffled_batches(spark, partitions):
    df = spark.range(1003).repartition(partitions)
    rows = batching.assign_batches(df, "id", 128).collect()
    order = [r.id for r in sorted(rows, key=lambda r: r.row_index)]
    assert order == expected_order(range(1003))
    assert [r.row_index for r in sorted(rows, key=lambda r: r.row_index)] == list(range(1003))
    assert all((r.batch_id, r.slot) == divmod(r.row_index, 128) for r in rows)


def test_batches_in_order_for_clustered_ids(spark):
    ids = [*range(500), *range(10**12, 10**12 + 300), -5]
    df = spark.createDataFrame([(i,) for i in reversed(ids)], "id long").repartition(9)
    rows = batching.assign_batches(df, "id", 100, shuffle=False).collect()
    assert [r.id for r in sorted(rows, key=lambda r: r.row_index)] == sorted(ids)
    sizes = {}
    for r in rows:
        sizes[r.batch_id] = sizes.get(r.batch_id, 0) + 1
    assert sorted(sizes.values()) == [1] + [100] * 8


def test_empty_input(spark):
    assert batching.assign_batches(spark.range(0), "id", 10).count() == 0


def test_limit(spark):
    batches = batching.assign_batches(spark.range(50), "id", 8)
    assert batching.limit_batches(batches, 2).count() == 16
    assert batching.limit_batches(batches, None).count() == 50


def test_collate(spark):
    df = spark.range(10).select(
        "id",
        F.array(F.col("id"), F.col("id") + 1).alias("input_ids"),
        F.array(F.array("id"), F.array(-F.col("id"))).alias("pixels"),
    )
    order = batching.assign_batches(df, "id", 4)
    rows = df.join(order, "id").repartition(5)
    collated = batching.collate_batches(rows, ["id", "input_ids"], ["pixels"]).orderBy("batch_id").collect()
    flat = [i for r in collated for i in r.id]
    assert flat == expected_order(range(10))
    assert [r.batch_rows for r in collated] == [4, 4, 2]
    first = collated[0]
    assert first.input_ids == [[i, i + 1] for i in first.id]
    assert first.pixels == [p for i in first.id for p in ([i], [-i])]


def test_no_stage_sorts_everything_in_one_task(spark):
    numbered = batching.assign_batches(spark.range(1000), "id", 10)
    plan = numbered._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Sort [id" not in plan


def test_inputs_are_spread_only_when_the_session_says_so(spark, sf_dir):
    as_scanned = inputs.documents(spark, sf_dir).rdd.getNumPartitions()
    assert as_scanned == inputs.table(spark, sf_dir, "documents").rdd.getNumPartitions()
    spark.conf.set("pentarank.inputPartitions", "5")
    try:
        assert inputs.documents(spark, sf_dir).rdd.getNumPartitions() == 5
    finally:
        spark.conf.unset("pentarank.inputPartitions")
