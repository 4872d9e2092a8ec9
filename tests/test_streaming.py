from __future__ import annotations

import shutil

import pytest
from pyspark.sql import functions as F

from pentarank.functions import vectors
from pentarank.operators import generation, metrics
from pentarank.schemas import base_schema
from pentarank.streaming import generation as stored, running

TEMPLATE = "{{SENTENCE}}|{{CORRECT_IMAGE}}"


def records(spark, ids):
    rows = [
        (i, "en", "c", "literal", f"s{i}", "st")
        + tuple(v for n in range(1, 6) for v in (f"p{n}", b"m"))
        for i in ids
    ]
    return spark.createDataFrame(rows, base_schema())


def make_generator(bad=(3, 13, 23)):
    refused = {f"s{i}" for i in bad}

    def make():
        def generate(batch):
            if any(p.split("|")[0] in refused for p in batch):
                raise RuntimeError("refused")
            return [f"<reasoning>{p}</reasoning>\n{{}}" for p in batch]

        return generate

    return make


def run(spark, tmp_path, generator, target="out", checkpoint="check", **options):
    query = stored.run_generation(
        spark, str(tmp_path / "in"), str(tmp_path / target), str(tmp_path / checkpoint),
        generator, template=TEMPLATE, files_per_snapshot=2, **options,
    )
    query.awaitTermination()


def test_generation_resumes_retries_and_equals_batch(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    records(spark, range(30)).repartition(3).write.parquet(source)
    run(spark, tmp_path, make_generator())
    assert sorted(r.id for r in stored.failed_ids(spark, out).collect()) == [3, 13, 23]
    assert len(list((tmp_path / "out").glob("batch_id=*"))) == 2

    records(spark, range(30, 40)).write.mode("append").parquet(source)
    run(spark, tmp_path, make_generator(bad=(33,)))
    done = stored.generated_records(spark, out)
    assert sorted(r.id for r in done.select("id").collect()) == [i for i in range(40) if i not in (3, 13, 23, 33)]
    batch = generation.generate_sft(records(spark, range(40)), make_generator((3, 13, 23, 33)), TEMPLATE)
    expected = batch.filter("error is null").drop("error")
    assert sorted(done.select(expected.columns).collect()) == sorted(expected.collect())

    retry = stored.failed_ids(spark, out)
    run(spark, tmp_path, make_generator(bad=(3,)), "again", "check-again", retry=retry)
    again = str(tmp_path / "again")
    assert sorted(r.id for r in stored.generated_records(spark, again).collect()) == [13, 23, 33]
    assert [r.id for r in stored.failed_ids(spark, again).collect()] == [3]


def test_replayed_batch_replaces_its_output(spark, tmp_path):
    out = str(tmp_path / "out")
    records(spark, range(10)).coalesce(1).write.parquet(str(tmp_path / "in"))
    run(spark, tmp_path, make_generator())
    # Losing the commit makes the next run process the same batch again.
    shutil.rmtree(tmp_path / "check" / "commits")
    run(spark, tmp_path, make_generator(bad=(3, 5)))
    assert sorted(r.id for r in stored.generated_records(spark, out).collect()) == [0, 1, 2, 4, 6, 7, 8, 9]
    assert sorted(r.id for r in stored.failed_ids(spark, out).collect()) == [3, 5]


def test_running_metrics_equal_batch(spark, sf_dir, tmp_path):
    embeddings = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    scores = embeddings.select(
        (F.col("label") % 2).cast("string").alias("run_id"), F.slice("embedding", 1, 5).cast("array<double>").alias("scores")
    )
    path = str(tmp_path / "scores")
    scores.repartition(6).write.parquet(path)
    wanted = [metrics.top_image_accuracy(label=0), metrics.spearman(), metrics.pairwise_loss()]
    stream = spark.readStream.schema(scores.schema).option("maxFilesPerTrigger", 2).parquet(path)
    query = (
        running.running_metrics(stream, wanted, ["run_id"])
        .writeStream.outputMode("complete").format("memory").queryName("running")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    assert len([p for p in query.recentProgress if p.numInputRows]) == 3
    got = {r.run_id: tuple(r)[1:] for r in spark.table("running").collect()}
    expected = {r.run_id: tuple(r)[1:] for r in metrics.evaluate(scores, wanted, ["run_id"]).collect()}
    assert got.keys() == expected.keys()
    for key in got:
        assert got[key] == pytest.approx(expected[key])


def test_accumulated_perplexity_equals_batch(spark, sf_dir, tmp_path):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(
        F.expr("vec_id div 8").alias("seq_id"),
        F.col("embedding").cast("array<double>").alias("logits"),
        F.col("label").alias("target"),
        F.expr("if(vec_id div 8 % 2 = 0, 'a', 'b')").alias("run_id"),
    )
    path = str(tmp_path / "tokens")
    rows.repartition(6).write.parquet(path)  # sequences are cut across the micro-batches
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(path)
    target = str(tmp_path / "sums")
    running.accumulate_perplexity(stream, target, str(tmp_path / "check"), ["run_id"]).awaitTermination()
    assert len(list((tmp_path / "sums").glob("batch_id=*"))) == 3
    assert spark.read.parquet(target).groupBy("seq_id").count().filter("count > 1").count() > 0
    got = dict(running.accumulated_perplexity(spark, target, ["run_id"]).collect())
    means = metrics.sequence_log_probs(rows, by=["run_id"])
    expected = dict(metrics.evaluate(means, [metrics.perplexity()], ["run_id"]).collect())
    assert got == pytest.approx(expected)


def test_partials_do_not_depend_on_the_split(spark, sf_dir):
    scores = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(
        "vec_id", F.slice("embedding", 1, 5).cast("array<double>").alias("scores")
    )
    wanted = [
        metrics.top_image_accuracy(label=0),
        metrics.spearman(),
        metrics.pairwise_loss(),
        metrics.mean(vectors.argmax("scores"), "mean_top"),
    ]
    whole = metrics.evaluate(scores, wanted).first().asDict()
    for size in (1, 7, 1000):
        split = scores.withColumn("part", F.floor(F.col("vec_id") / size)).repartition(size % 5 + 1)
        merged = metrics.merge_partials(metrics.partials(split, wanted, ["part"]), wanted)
        assert dict(merged.collect()) == pytest.approx(whole)
