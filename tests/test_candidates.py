from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from pentarank.operators import assembly, candidates
from pentarank.schemas import IMAGE_COLUMNS, PROMPT_COLUMNS, base_schema


@pytest.fixture(scope="module")
def records(spark):
    rows = [
        (i, "en", f"c{i}", "literal", f"s{i}", "st")
        + tuple(v for n in range(1, 6) for v in (f"p{i}-{n}", f"m{i}-{n}".encode()))
        for i in range(40)
    ]
    return spark.createDataFrame(rows, base_schema()).cache()


def test_long_form(records):
    long = candidates.candidates_long(records).filter("id = 3").orderBy("idx").collect()
    assert [(r.idx, r.prompt, bytes(r.image)) for r in long] == [
        (n, f"p3-{n}", f"m3-{n}".encode()) for n in range(1, 6)
    ]


def test_correct_position(spark):
    df = spark.createDataFrame([([4, 1, 5, 2, 3],)], "o array<int>")
    assert df.select(candidates.correct_position("o")).first()[0] == 2


def test_order_is_seeded_by_id(records):
    def key(i, n, seed):
        return hashlib.md5(f"{seed}-{i}-{n}".encode()).hexdigest()

    orders = {}
    for seed in (42, 7):
        got = dict(records.select("id", candidates.shuffled_order(seed=seed)).collect())
        assert all(
            order == sorted(range(1, 6), key=lambda n: key(i, n, seed)) for i, order in got.items()
        )
        orders[seed] = got
    assert orders[42] != orders[7]
    assert len({tuple(o) for o in orders[42].values()}) > 20


def test_shuffle_keeps_prompt_and_image_together(records):
    for row in candidates.shuffle_candidates(records).collect():
        got = [(row[p], bytes(row[m])) for p, m in zip(PROMPT_COLUMNS, IMAGE_COLUMNS)]
        expected = [(f"p{row.id}-{n}", f"m{row.id}-{n}".encode()) for n in row.candidate_order]
        assert got == expected
        assert got[row.correct_image - 1][0] == f"p{row.id}-1"


def test_long_shuffle_and_pivot_agree_with_wide_shuffle(records):
    columns = ["id", "correct_image", *PROMPT_COLUMNS]
    wide = candidates.shuffle_candidates(records).select(columns)
    pivoted = candidates.candidates_wide(candidates.candidates_shuffled(records)).select(columns)
    assert sorted(wide.collect()) == sorted(pivoted.collect())


def test_shuffling_needs_no_exchange(records):
    plan = candidates.shuffle_candidates(records)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_stacking_is_bounded_under_a_hot_group(spark):
    rows = [(1, 1, 7), (2, 1, 8), (2, 0, 9), (3, 0, 1), (3, 2, 3)]
    long = spark.createDataFrame(rows, "g int, p int, v int")
    stacked = candidates.stack_candidates(long, "g", "p", "v", 3)
    assert dict(stacked.collect()) == {1: [None, 7], 2: [9, 8], 3: [1, None, 3]}
    with pytest.raises(Exception, match="out of range"):
        candidates.stack_candidates(long, "g", "p", "v", 2).collect()
    hot = spark.range(3000).select(F.lit(1).alias("g"), (F.col("id") % 3).alias("p"), (F.col("id") % 3).alias("v"))
    with pytest.raises(Exception, match="two candidates at one position"):
        candidates.stack_candidates(hot, "g", "p", "v", 3).collect()


def test_pivot_keeps_whole_candidates(spark):
    schema = "id int, pos int, idx int, prompt string, image string"
    gap = spark.createDataFrame([(1, 1, 2, "a2", "x"), (1, 3, 1, "b", "y")], schema)
    row = candidates.candidates_wide(gap).first()
    assert (row.correct_image, row.image_1_prompt, row.image_1, row.image_2_prompt, row.image_3) == (3, "a2", "x", None, "y")
    twice = spark.createDataFrame([(1, 1, 2, "a2", "x"), (1, 1, 3, "zz", "a")], schema)
    with pytest.raises(Exception, match="two candidates at one position"):
        candidates.candidates_wide(twice).collect()


def test_assembly_types_and_splits(spark, records):
    finished = candidates.shuffle_candidates(records).withColumns(
        {"id": F.col("id").cast("bigint"), "reasoning": F.lit("r"), "output": F.lit("o")}
    )
    dataset = assembly.assemble_sft_dataset(finished.filter("id < 30"), finished.filter("id >= 30"))
    assert len(dataset.columns) == 20
    kinds = dict(dataset.dtypes)
    assert (kinds["id"], kinds["correct_image"], kinds["image_5"]) == ("int", "int", "binary")
    assert assembly.select_split(dataset, "test").count() == 10
    too_big = finished.withColumn("id", F.lit(2**40))
    with pytest.raises(Exception, match="CAST_OVERFLOW"):
        assembly.assemble_sft_dataset(too_big, finished).collect()
    assert assembly.training_view(dataset, ["sentence", "output"]).columns == ["sentence", "output"]
