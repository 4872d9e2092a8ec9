"""Resizing with a filter, and picture files told from their headers, against plain programs."""

from __future__ import annotations

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from pentarank.functions import pictures
from pentarank.operators import images
from pentarank.sources import images as image_files

IMAGE = "image struct<origin: string, height: int, width: int, nChannels: int, mode: int, data: binary>"


def shares(length, side, i):
    """What each old pixel gives to new pixel ``i``, by the definition of the filter."""
    scale = length / side
    reach = max(scale, 1.0)
    given = [max(0.0, 1 - abs(k + 0.5 - (i + 0.5) * scale) / reach) for k in range(length)]
    return [g / sum(given) for g in given]


def filtered(picture, side):
    height, width, channels = picture.shape
    out = np.zeros((channels, side, side))
    for i in range(side):
        for j in range(side):
            for y, a in enumerate(shares(height, side, i)):
                for x, b in enumerate(shares(width, side, j)):
                    out[:, i, j] += a * b * picture[y, x]
    return out


def test_every_pixel_counts_when_a_picture_shrinks(spark, monkeypatch):
    rng = np.random.default_rng(4)
    made = [rng.integers(0, 256, (h, w, c)).astype(np.uint8) for h, w, c in [(9, 14, 3), (9, 14, 3), (20, 5, 1), (3, 3, 4), (1, 1, 3), (40, 40, 3)]]
    rows = [(k, (str(k), p.shape[0], p.shape[1], p.shape[2], 0, bytearray(p.tobytes()))) for k, p in enumerate(made)]
    rows += [(90, None), (91, ("x", 4, 4, 3, 0, bytearray(b"short"))), (92, ("x", -1, -1, -1, -1, bytearray()))]
    df = spark.createDataFrame(rows, f"id int, {IMAGE}").coalesce(1)
    for room in (images.STACK_BYTES, 1):
        monkeypatch.setattr(images, "STACK_BYTES", room)
        got = {r.id: r for r in images.resize_images(df, ["image"], 4, antialias=True).collect()}
        for k, p in enumerate(made):
            rgb = np.repeat(p, 3, 2) if p.shape[2] == 1 else p[:, :, 2::-1]
            assert np.allclose(np.array(got[k].pixel_values[0]).reshape(3, 4, 4), filtered(rgb.astype(float), 4), atol=1e-3)
        assert all(got[k].pixel_values == [None] and got[k].image_error for k in (90, 91, 92))
    # A dark line of single white pixels keeps its mean away from the edges; sampling between neighbours loses it.
    line = np.zeros((1, 64))
    line[0, ::8] = 255
    assert np.allclose((line @ images.resize_weights(64, 8).T)[0, 1:-1], 255 / 8)
    assert np.ptp(line @ images.resize_weights(64, 8, False).T) == 0 and (line @ images.resize_weights(64, 8, False).T).max() in (0.0, 127.5, 255.0)


@pytest.mark.parametrize("length, side", [(1, 5), (7, 7), (100, 3), (3, 100), (1024, 224)])
@pytest.mark.parametrize("antialias", [True, False])
def test_weights_add_up(length, side, antialias):
    weights = images.resize_weights(length, side, antialias)
    assert weights.shape == (side, length) and np.allclose(weights.sum(1), 1) and (weights >= 0).all()
    if antialias and length >= side:
        assert (weights.sum(0) > 0).all()


def jpeg(width, height, before=b"", code=0xC0):
    return b"\xff\xd8" + before + bytes([0xFF, code]) + struct.pack(">HBHHB", 17, 8, height, width, 3) + b"rest"


def segment(code, size):
    return bytes([0xFF, code]) + struct.pack(">H", size + 2) + b"\xff\xc0" * (size // 2)


FILES = {
    "png": (b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + struct.pack(">II", 70_000, 3), ("png", 70_000, 3)),
    "png, no pixels": (b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + struct.pack(">II", 0, 3), None),
    "png, cut": (b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR\0\0", None),
    "png, no header first": (b"\x89PNG\r\n\x1a\n\0\0\0\rIDAT" + struct.pack(">II", 7, 3), None),
    "jpeg": (jpeg(640, 480), ("jpeg", 640, 480)),
    "jpeg, progressive": (jpeg(5, 6, segment(0xE0, 14) + segment(0xE1, 60_000) + segment(0xDB, 64) + segment(0xC4, 30), 0xC2), ("jpeg", 5, 6)),
    "jpeg, filled marks": (jpeg(5, 6, segment(0xFE, 2) + b"\xff\xff\xff"), ("jpeg", 5, 6)),
    "jpeg, many segments": (jpeg(9, 8, segment(0xE2, 4) * 200), ("jpeg", 9, 8)),
    "jpeg, scan before frame": (jpeg(9, 8, segment(0xDA, 4)), None),
    "jpeg, cut": (jpeg(9, 8)[:9], None),
    "jpeg, broken": (b"\xff\xd8\x00\x00\x00\x00\x00\x00\x00\x00\x00\x00", None),
    "webp, extended": (b"RIFF\0\0\0\0WEBPVP8X\x0a\0\0\0\x10\0\0\0" + struct.pack("<I", 99_999)[:3] + struct.pack("<I", 9)[:3], ("webp", 100_000, 10)),
    "webp, lossless": (b"RIFF\0\0\0\0WEBPVP8L\0\0\0\0/" + struct.pack("<I", 799 | 599 << 14 | 1 << 28) + b"\0" * 9, ("webp", 800, 600)),
    "webp, lossy": (b"RIFF\0\0\0\0WEBPVP8 \0\0\0\0\x10\0\0\x9d\x01\x2a" + struct.pack("<HH", 320 | 1 << 14, 200) + b"..", ("webp", 320, 200)),
    "webp, stub": (b"RIFF....WEBP", None),
    "text": (b"no picture at all", None),
    "empty": (b"", None),
}


def test_headers_tell_kind_and_size(spark, tmp_path):
    rows = [(name, bytearray(data)) for name, (data, _) in FILES.items()] + [("null", None)]
    df = spark.createDataFrame(rows, "name string, content binary")
    got = {r.name: r.s for r in df.select("name", pictures.picture_size("content").alias("s")).collect()}
    assert {k: v and tuple(v) for k, v in got.items()} == {**{k: want for k, (_, want) in FILES.items()}, "null": None}
    for name, (data, _) in FILES.items():
        (tmp_path / f"{name}.img").write_bytes(data)
    found = image_files.scan_pictures(spark, str(tmp_path), "*.img", least_side=10)
    usable = {r.path.split("/")[-1].replace("%20", " ") for r in found.filter("usable").collect()}
    assert usable == {f"{k}.img" for k, (_, want) in FILES.items() if want and min(want[1:]) >= 10}
    plan = found.filter("usable").select("path")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and found.select(F.count_if("usable")).first()[0] == len(usable)
