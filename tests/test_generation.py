from __future__ import annotations

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from pentarank.operators import generation, mapping, routing
from pentarank.schemas import base_schema, sft_schema


def records(spark, count, sentence=lambda i: f"s{i}"):
    rows = [
        (i, "en", "c", "literal", sentence(i), "st")
        + tuple(v for n in range(1, 6) for v in (f"p{n}", b"m"))
        for i in range(count)
    ]
    return spark.createDataFrame(rows, base_schema())


def make_generator():
    def reply(prompt):
        if "s3|" in prompt:
            raise RuntimeError("no luck")
        if "s4|" in prompt:
            return None
        if "s5|" in prompt:
            return "no closing tag"
        return f"<reasoning>{prompt}</reasoning>\n<output>"

    return lambda batch: [reply(p) for p in batch]


TEMPLATE = "{{SENTENCE}}|{{CORRECT_IMAGE}}"


def test_failures_stay_with_their_row(spark):
    df = records(spark, 40, lambda i: None if i == 6 else f"s{i}")
    outcomes = generation.generate_sft(df, make_generator, TEMPLATE, batch_size=7)
    assert outcomes.columns == sft_schema().names + ["error"]
    errors = {r.id: r.error for r in outcomes.collect() if r.error is not None}
    assert errors == {
        3: "RuntimeError: no luck",
        4: "no reply",
        5: "malformed reply",
        6: "no prompt",
    }


def test_result_does_not_depend_on_batches_or_partitions(spark):
    df = records(spark, 40)
    base = sorted(generation.generate_sft(df, make_generator, TEMPLATE).collect())
    for size, parts in ((1, 3), (13, 8)):
        again = generation.generate_sft(
            df, make_generator, TEMPLATE, batch_size=size, num_partitions=parts
        )
        assert sorted(again.collect(), key=lambda r: r.id) == sorted(base, key=lambda r: r.id)


def test_wrong_number_of_replies_is_an_error(spark):
    df = records(spark, 3).withColumn("prompt", F.col("sentence"))
    got = generation.generate_replies(df, lambda: lambda batch: ["x"] * (len(batch) + 1))
    assert {r.error for r in got.collect()} == {"wrong number of replies"}


def test_images_do_not_travel_to_python(spark):
    plan = generation.generate_sft(records(spark, 3), make_generator)._jdf.queryExecution()
    line = next(x for x in plan.executedPlan().toString().splitlines() if "ArrowEvalPython" in x)
    argument = line.partition("ask(")[2].partition(")#")[0]
    assert "sentence" in argument
    assert not re.search(r"image_\d#", argument)


def test_routing_runs_the_generator_once(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()

    def counting():
        def generate(batch):
            for prompt in batch:
                with open(calls / prompt.split("|")[0], "a") as f:
                    f.write("x")
            return ["a</reasoning>b"] * len(batch)

        return generate

    outcomes = generation.generate_sft(records(spark, 20), counting, TEMPLATE)
    ok, failed = routing.route_outcomes(outcomes, str(tmp_path / "out"))
    assert (ok.count(), failed.count(), ok.filter("id < 5").count()) == (20, 0, 5)
    assert {f.read_text() for f in calls.iterdir()} == {"x"}


def test_ok_and_failed_cover_the_input(spark, tmp_path):
    outcomes = generation.generate_sft(records(spark, 20), make_generator, TEMPLATE)
    ok, failed = routing.route_outcomes(outcomes, str(tmp_path / "out"))
    assert sorted(r.id for r in ok.select("id").collect() + failed.select("id").collect()) == list(range(20))
    assert sorted(r.id for r in failed.collect()) == [3, 4, 5]


def test_retry_lists(spark):
    def ids(*values):
        return spark.createDataFrame([(v,) for v in values], "id int")

    again = routing.retry_failed_only(records(spark, 20), ids(3, 13, 13, 99))
    assert sorted(r.id for r in again.collect()) == [3, 13]
    left = routing.remaining_failed(ids(3, 13, 23), ids(13))
    assert sorted(r.id for r in left.collect()) == [3, 23]


def test_batched_map(spark):
    df = spark.range(95).select(F.col("id"), F.concat(F.lit("t"), "id").alias("t"), F.lit(b"img").alias("image"))
    sizes = []

    def fn(batch):
        assert list(batch) == ["id", "t"] and len(batch["id"]) <= 10
        return {"n": [len(t) for t in batch["t"]], "t": [t.upper() for t in batch["t"]]}

    out = mapping.batched_map(df, fn, "n int, t string", ["id", "t"], 10, remove_columns=["image"])
    assert sorted(out.columns) == ["id", "n", "t"]
    assert {(r.id, r.n, r.t) for r in out.collect()} == {
        (i, len(f"t{i}"), f"T{i}") for i in range(95)
    }
    assert sizes == []
    bad = mapping.batched_map(df, lambda b: {"n": [1]}, "n int", ["t"], 10)
    with pytest.raises(Exception, match="keep the number of rows"):
        bad.collect()
    assert mapping.batched_map(df.limit(0), fn, "n int, t string", ["id", "t"]).count() == 0


def test_embedding(spark):
    df = spark.createDataFrame([("a b a",), ("",), ("b a a",)], "t string")
    vectors = [r.v for r in mapping.embed_column(df, "t", mapping.hashing_embedder(32), "v", 2).collect()]
    assert len(vectors[0]) == 32 and vectors[0] == vectors[2]
    assert np.linalg.norm(vectors[0]) == pytest.approx(1.0) and not any(vectors[1])
