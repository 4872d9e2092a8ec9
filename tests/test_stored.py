"""Sketches, partial sums, indexed reports and bucketed tables that outlive a run."""

from __future__ import annotations

import random
import uuid

import pytest
from pyspark.sql import functions as F

from pentarank.operators import lengths, metrics
from pentarank.operators.analysis import ANALYSIS_COLUMNS
from pentarank.sources import datasets, partials, reports


def test_merged_sketches_stay_near_the_ranks(spark, tmp_path):
    path, n = str(tmp_path / "s"), 60_000
    # Lengths with a long tail, in order, so that every run has another part of them.
    rows = spark.range(n).select("id", F.expr("cast(pow(id % 6000, 1.3) / 400 + id div 20000 as int)").alias("n"))
    rows = rows.withColumn("tokens", F.array_repeat(F.lit(1), F.col("n"))).withColumn("kind", F.col("id") % 2)
    for run in range(6):
        part = rows.filter(F.expr(f"id div 10000 = {run}"))
        lengths.store_sketches(lengths.length_sketches(part, F.col("tokens"), ["kind"]), path, f"r{run}")
    lengths.store_sketches(lengths.length_sketches(rows.filter("id div 10000 = 3"), F.col("tokens"), ["kind"]), path, "r3")
    marks = (0.01, 0.25, 0.5, 0.95, 0.99)
    merged = lengths.merged_profile(lengths.read_sketches(spark, path), (), marks).first()
    exact = sorted(r.n for r in rows.select("n").collect())
    assert merged.n_rows == n and merged.max_tokens == exact[-1]
    for p in marks:
        value = merged[f"p{round(p * 100)}_tokens"]
        below, upto = (sum(x < value for x in exact) / n, sum(x <= value for x in exact) / n)
        assert below <= p + 0.01 and upto >= p - 0.01
    by_kind = lengths.merged_profile(lengths.read_sketches(spark, path), ["kind"])
    assert {(r.kind, r.n_rows) for r in by_kind.collect()} == {(0, n // 2), (1, n // 2)}
    # The sketch of a group is small, and what has no length counts as no row.
    assert lengths.read_sketches(spark, path).agg(F.max(F.octet_length("sketch"))).first()[0] < 100_000
    none = spark.createDataFrame([(None,), ([],)], "tokens array<int>")
    assert tuple(lengths.merged_profile(lengths.length_sketches(none, F.col("tokens"))).first())[:2] == (1, 0)


def test_replayed_batches_change_nothing(spark, tmp_path):
    path = str(tmp_path / "p")
    wanted = [metrics.mean("x", "mean_x")]
    assert partials.stored_metrics(spark, path, wanted).count() == 0
    rows = spark.createDataFrame([(b, float(b * 10 + k)) for b in range(5) for k in range(4)], "batch_id long, x double")
    parts = metrics.partials(rows, wanted, ["batch_id"]).withColumn("run_id", F.lit("a"))

    def value(run="a"):
        found = {r.run_id: r.value for r in partials.stored_metrics(spark, path, wanted).collect()}
        return found.get(run)

    partials.upsert_partials(parts.filter("batch_id < 3"), path)
    assert value() == 11.5
    for again in (0, 1, 2):
        partials.upsert_partials(parts.filter(F.col("batch_id") == again), path)
        assert value() == 11.5
    partials.upsert_partials(parts, path)
    assert value() == 21.5
    # A batch that comes with other sums replaces its own.
    partials.upsert_partials(parts.filter("batch_id = 4").withColumn("total", F.lit(0.0)), path)
    assert value() == (21.5 * 20 - 166) / 20
    partials.upsert_partials(parts.filter("batch_id = 4"), path)
    partials.upsert_partials(parts.withColumn("run_id", F.lit("b")), path)
    partials.reset(spark, path, "a", 2)
    assert value() == 36.5 and value("b") == 21.5
    partials.reset(spark, path, "a")
    assert value() is None and value("b") == 21.5
    partials.upsert_partials(parts.filter("batch_id = 4").withColumn("batch_id", F.lit(7)), path)
    assert value() == 41.5 and partials.read_all(spark, path).filter("run_id = 'a'").count() == 6


ODD = ["", "plain", 'with "quotes", commas', "lines\nand\r\nmore", "\\", "\\\"", '"', ",", " spaces ", "漢字 😀", "a\\nb", "null", None]


def test_indexed_reports_round_trip(spark, tmp_path):
    path, pick = str(tmp_path / "csv"), random.Random(1)
    rows = []
    for k in range(300):
        texts = [pick.choice(ODD) for _ in ANALYSIS_COLUMNS[:-2]]
        rows.append((1000 - k, *texts, pick.choice([-1.0, 3.0, 2.5, None]), pick.choice([-1.0, 1e20, float("nan")])))
    ddl = ", ".join(["id long", *[f"{c} {'double' if c.endswith('_image') else 'string'}" for c in ANALYSIS_COLUMNS]])
    df = spark.createDataFrame(rows, ddl)
    reports.write_indexed_analysis(df.repartition(5), path)
    got = sorted(tuple(r) for r in [tuple(str(v) for v in r) for r in reports.read_indexed_analysis(spark, path).collect()])
    want = sorted((str(i), *map(str, r), "None") for i, r in enumerate(sorted(rows, key=lambda r: r[0])))
    assert got == want
    # Part files hold consecutive ranges of the index, in order.
    seen = []
    for part in sorted((tmp_path / "csv").glob("part-*.csv")):
        index = [int(r.row_index) for r in reports.read_indexed_analysis(spark, str(part)).collect()]
        seen += index
    assert seen == list(range(300))
    (tmp_path / "csv" / "part-broken.csv").write_text('"row_index","id"\n"x","y"\n')
    broken = reports.read_indexed_analysis(spark, path).filter("_corrupt is not null").collect()
    assert len(broken) == 1 and '"x"' in broken[0]._corrupt


def test_bucketed_tables_join_without_exchange(spark, tmp_path):
    name, path = f"t_{uuid.uuid4().hex}", str(tmp_path / "t")
    rows = spark.range(200).selectExpr("id", "concat('s', id) as sentence", "if(id % 4 = 0, 'test', 'train') as split")
    datasets.save_bucketed(rows.filter("id < 150"), name, path, buckets=4)
    other = f"{name}_o"
    datasets.save_bucketed(rows.selectExpr("id", "id * 2 as twice", "split"), other, str(tmp_path / "o"), buckets=4)
    datasets.append_bucketed(rows.filter("id >= 150").withColumn("late", F.lit(1.5)), name)
    datasets.append_bucketed(spark.range(200, 201).withColumn("split", F.lit("train")), name)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = spark.table(name).filter("split = 'train'").join(spark.table(other).filter("split = 'train'").drop("split"), "id")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "SortMergeJoin" in plan and plan.count("PartitionFilters: [isnotnull(split") == 2
        got = {r.id: (r.sentence, r.late, r.twice) for r in joined.collect()}
        assert got == {k: (f"s{k}", 1.5 if k >= 150 else None, 2 * k) for k in range(200) if k % 4}
        assert spark.table(name).filter("id = 200").first().sentence is None and spark.table(name).count() == 201
        with pytest.raises(datasets.SchemaMismatch, match="sentence: expected string, found bigint"):
            datasets.append_bucketed(spark.range(1).selectExpr("id", "id as sentence", "'x' as split"), name)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.sql(f"DROP TABLE {name}")
        spark.sql(f"DROP TABLE {other}")
