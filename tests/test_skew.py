"""A third of all rows under one key: results stay whole, work stays spread."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from pentarank.operators import metrics, routing

ROWS = 9000


@pytest.fixture(scope="module")
def token_rows(spark):
    """Sequence 0 holds 3,000 positions, the others ten each."""
    hot = F.col("id") < ROWS // 3
    rest = F.col("id") - ROWS // 3
    return spark.range(ROWS).select(
        F.when(hot, 0).otherwise(rest.cast("long") / 10 + 1).cast("long").alias("seq_id"),
        F.when(hot, F.col("id")).otherwise(rest % 10).cast("int").alias("pos"),
        F.array((F.col("id") % 3).cast("double"), F.lit(1.0)).alias("logits"),
        (F.col("id") % 2).cast("int").alias("target"),
    ).cache()


def brute_force(rows):
    sequences = {}
    for r in rows:
        sequences.setdefault(r.seq_id, {})[r.pos] = r
    means = []
    for seq in sequences.values():
        scores = []
        for pos in range(len(seq) - 1):
            mass = sum(math.exp(x) for x in seq[pos].logits)
            scores.append(math.log(math.exp(seq[pos].logits[seq[pos + 1].target]) / mass))
        means.append(sum(scores) / len(scores))
    return math.exp(-sum(means) / len(means))


def test_hot_sequence(token_rows):
    shifted = metrics.shift_targets(token_rows)
    got = metrics.evaluate(metrics.sequence_log_probs(shifted), [metrics.perplexity()]).first()[0]
    assert got == pytest.approx(brute_force(token_rows.collect()))


def test_hot_sequence_spreads_over_tasks(spark, token_rows):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        shifted = metrics.shift_targets(token_rows)
        hot = shifted.filter("seq_id = 0").groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    sizes = [r[1] for r in hot]
    assert len(sizes) == 8 and max(sizes) < 2 * sum(sizes) / 8


def test_hot_group_is_summed_before_the_shuffle(token_rows):
    plan = metrics.evaluate(token_rows, [metrics.mean("target", "m")], ["seq_id"])
    text = plan._jdf.queryExecution().executedPlan().toString()
    below = text.partition("Exchange hashpartitioning(seq_id")[2]
    assert "partial_sum" in below


def test_hot_id_in_retry(spark):
    records = spark.range(ROWS).select(
        F.when(F.col("id") < ROWS // 3, 7).otherwise(F.col("id")).alias("id"), F.col("id").alias("n")
    )
    failed = spark.createDataFrame([(7,), (7,), (8999,), (5,)], "id long")
    assert routing.retry_failed_only(records, failed).count() == ROWS // 3 + 1


@pytest.mark.parametrize(
    "master, folder, warehouse, default, wanted",
    [
        ("yarn", None, "file:/home/me/spark-warehouse", "file:///", None),
        ("spark://host:7077", None, "/home/me/spark-warehouse", "file:///", None),
        ("yarn", None, "/warehouse", "hdfs://name", "/warehouse/_checkpoints"),
        ("yarn", None, "hdfs://name/warehouse", "file:///", "hdfs://name/warehouse/_checkpoints"),
        ("yarn", "file:///mnt/shared/", "file:/x", "file:///", "file:///mnt/shared"),
        ("local[8]", None, "file:/home/me/spark-warehouse", "file:///", "file:/home/me/spark-warehouse/_checkpoints"),
    ],
)
def test_folder_is_shared_on_a_cluster(master, folder, warehouse, default, wanted):
    from types import SimpleNamespace as Stub

    from pentarank.session import shared_folder

    conf = {"spark.checkpoint.dir": folder, "spark.sql.warehouse.dir": warehouse}
    hadoop = Stub(get=lambda key, other: default)
    context = Stub(master=master, getConf=lambda: Stub(get=lambda key: None), _jsc=Stub(hadoopConfiguration=lambda: hadoop))
    session = Stub(conf=Stub(get=lambda key, other=None: conf[key] or other), sparkContext=context)
    if wanted is None:
        with pytest.raises(ValueError, match="all executors share"):
            shared_folder(session)
    else:
        assert shared_folder(session) == wanted
