from __future__ import annotations

import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F, types as T

from pentarank.operators import analysis, assembly, candidates, images, runs
from pentarank.schemas import IMAGE_COLUMNS, base_schema, sft_schema
from pentarank.sources import datasets, images as image_files, ledger, reports


@pytest.fixture(scope="module")
def dataset(spark):
    rows = [
        (i, "en", "c", "literal", "s", "st")
        + tuple(v for n in range(1, 6) for v in (f"p{n}", b"m"))
        for i in range(20)
    ]
    finished = candidates.shuffle_candidates(spark.createDataFrame(rows, base_schema())).withColumns(
        {"reasoning": F.lit("r"), "output": F.lit("o")}
    )
    return assembly.assemble_sft_dataset(finished.filter("id < 15"), finished.filter("id >= 15"))


def test_splits_round_trip_with_pruning(spark, dataset, tmp_path):
    path = str(tmp_path / "sft")
    datasets.write_splits(dataset, path, file_rows=4)
    back = datasets.load_splits(spark, path)
    assert back.columns == sft_schema().names + ["split"]
    assert sorted(back.select("id", "split", "correct_image").collect()) == sorted(
        dataset.select("id", "split", "correct_image").collect()
    )
    test = assembly.select_split(back, "test").select("id")
    plan = test._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan and "ReadSchema: struct<id:int>" in plan
    assert test.count() == 5


def test_stored_types_are_checked(spark, dataset, tmp_path):
    path = str(tmp_path / "wrong")
    datasets.write_splits(dataset.withColumn("id", F.col("id").cast("long")).drop("output"), path)
    with pytest.raises(datasets.SchemaMismatch, match="id: expected int, found bigint; output: .* nothing"):
        datasets.load_splits(spark, path)


def test_records_round_trip(spark, dataset, tmp_path):
    path = str(tmp_path / "records")
    datasets.save_records(dataset.drop("split"), path)
    assert spark.read.parquet(path).schema == sft_schema()
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        datasets.save_records(dataset, path)


def test_failed_id_files(spark, tmp_path):
    old = tmp_path / "failed.json"
    old.write_text(json.dumps([3, 13, 23]))
    failed = ledger.read_id_array(spark, str(old))
    assert failed.schema == T.StructType([T.StructField("id", T.IntegerType())])
    assert sorted(r.id for r in failed.collect()) == [3, 13, 23]
    path = str(tmp_path / "failed")
    ledger.write_failed(failed.repartition(3), path)
    assert sorted(r.id for r in ledger.read_failed(spark, path).collect()) == [3, 13, 23]
    bad = tmp_path / "bad.json"
    bad.write_text('{"ids": [1]}')
    with pytest.raises(Exception):
        ledger.read_id_array(spark, str(bad)).collect()


def test_analysis_report_round_trip(spark, tmp_path):
    rows = [
        (1, '<reasoning>a,\n"b"</reasoning><output>{"Image": 3.0}</output></s>', '<output>{"Image": "3"}</output>'),
        (2, "back\\slash", ""),
        (3, '<output>{"Image": 2.5}</output>', '<output>{"Image": 1e400}</output>'),
    ]
    table = analysis.analysis_table(spark.createDataFrame(rows, "id long, prediction string, label string"))
    path = str(tmp_path / "report")
    reports.write_analysis(table.coalesce(1), path)
    back = reports.read_analysis(spark, path)
    blank = {c: F.coalesce(F.col(c), F.lit("")) for c, kind in table.dtypes if kind == "string"}
    assert sorted(back.withColumns(blank).collect()) == sorted(table.withColumns(blank).collect())
    text = "".join(f.read_text() for f in (tmp_path / "report").glob("*.csv"))
    assert text.startswith('"id","full_prediction"') and '"3","3"' in text and '"2.5"' in text


def test_metric_log(spark, tmp_path):
    path = str(tmp_path / "log")
    wide = spark.createDataFrame(
        [("a", "test", 0, 0.5, 1), ("b", "test", 0, 0.75, 2)],
        "run_id string, split string, epoch int, accuracy double, steps int",
    )
    datasets.append_metrics(runs.metric_log(wide, ["accuracy", "steps"]), path)
    datasets.append_metrics(runs.metric_log(wide.filter("run_id = 'b'"), ["accuracy"]), path)
    log = datasets.read_metrics(spark, path)
    assert log.count() == 5
    compared = {r.metric: (r.before, r.after, r.change) for r in runs.compare_runs(log, "a", "b").collect()}
    assert compared == {"accuracy": (0.5, 0.75, 0.25), "steps": (1.0, 2.0, 1.0)}
    steps = spark.createDataFrame([("a", 0, 1.0), ("a", 0, 3.0), ("a", 1, 5.0)], "run_id string, epoch int, loss double")
    assert {tuple(r) for r in runs.epoch_loss(steps).collect()} == {("a", 0, 2.0, 2), ("a", 1, 5.0, 1)}


def png(pixels):
    """A PNG file of an ``(height, width, 3)`` array."""
    height, width, _ = pixels.shape

    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    raw = b"".join(b"\x00" + row.tobytes() for row in pixels.astype(np.uint8))
    header = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def bilinear(pixels, side):
    """Resized value of every pixel, one at a time."""
    height, width, channels = pixels.shape
    out = np.zeros((side, side, channels))

    def spot(i, length):
        at = min(max((i + 0.5) * length / side - 0.5, 0), length - 1)
        low = int(at)
        return low, min(low + 1, length - 1), at - low

    for y in range(side):
        y0, y1, fy = spot(y, height)
        for x in range(side):
            x0, x1, fx = spot(x, width)
            top = pixels[y0, x0] * (1 - fx) + pixels[y0, x1] * fx
            low = pixels[y1, x0] * (1 - fx) + pixels[y1, x1] * fx
            out[y, x] = top * (1 - fy) + low * fy
    return out


def test_images_are_read_and_resized(spark, tmp_path):
    rng = np.random.default_rng(1)
    wide, square = rng.integers(0, 256, (5, 9, 3)), rng.integers(0, 256, (8, 8, 3))
    (tmp_path / "a.png").write_bytes(png(wide))
    (tmp_path / "b.png").write_bytes(png(square))
    (tmp_path / "c.webp").write_bytes(b"RIFF....WEBP")
    raw = image_files.read_image_files(spark, str(tmp_path), "*.png")
    assert sorted(r.length for r in raw.collect()) == sorted([len(png(wide)), len(png(square))])
    assert image_files.read_images(spark, str(tmp_path), drop_invalid=True).count() == 2

    pictures = {r.path[-5]: r.image for r in image_files.read_images(spark, str(tmp_path)).collect()}
    kind = image_files.read_images(spark, str(tmp_path)).schema["image"].dataType
    schema = T.StructType([T.StructField(c, kind) for c in IMAGE_COLUMNS])
    invalid = next(v for k, v in pictures.items() if k not in "ab")
    rows = [[pictures["a"], pictures["b"]] * 2 + [pictures["a"]], [pictures["a"]] * 4 + [invalid]]
    resized = images.resize_images(spark.createDataFrame(rows, schema), side=6).collect()
    assert [len(p) for p in resized[0].pixel_values] == [3 * 6 * 6] * 5 and resized[0].image_error is None
    for place, pixels in ((0, wide), (1, square)):
        got = np.array(resized[0].pixel_values[place]).reshape(3, 6, 6).transpose(1, 2, 0)
        assert np.allclose(got, bilinear(pixels.astype(float), 6), atol=1e-3)
    assert resized[1].pixel_values[4] is None and "undecodable" in resized[1].image_error
