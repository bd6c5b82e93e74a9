"""Photos: Spark's image source, thinning out, and measures against plain loops."""

from __future__ import annotations

import random
import struct
import zlib

import pytest

from shelfwise.operators import photos


def png(width, height, pixel):
    rows = b"".join(b"\0" + b"".join(bytes(pixel(x, y)) for x in range(width)) for y in range(height))
    part = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(rows)) + part(b"IEND", b"")


def measures(width, height, gray):
    inner = [(x, y) for y in range(1, height - 1) for x in range(1, width - 1)]
    edge = lambda x, y: x < width * 0.12 or x >= width * 0.88 or y < height * 0.12 or y >= height * 0.88
    mean = lambda v: sum(v) / len(v)
    spread = lambda v: max(0, mean([a * a for a in v]) - mean(v) ** 2)
    light = [gray(*p) for p in inner]
    lap = [gray(x - 1, y) + gray(x + 1, y) + gray(x, y - 1) + gray(x, y + 1) - 4 * gray(x, y) for x, y in inner]
    rim, mid = [gray(*p) for p in inner if edge(*p)], [gray(*p) for p in inner if not edge(*p)]
    return 1 / (1 + spread(lap) / 0.0025), mean(light), spread(rim) < 0.055 and abs(mean(rim) - mean(mid)) < 0.45 and spread(light) > 0.002


def test_measures_of_decoded_images(spark, tmp_path):
    rng = random.Random(3)
    noise = [[(rng.randint(0, 255), rng.randint(0, 255), rng.randint(0, 255)) for _ in range(24)] for _ in range(20)]
    made = {"noise": lambda x, y: noise[y][x], "flat": lambda x, y: (200, 200, 200), "slope": lambda x, y: (x * 10, y * 5, 40)}
    for name, pixel in made.items():
        (tmp_path / f"{name}.png").write_bytes(png(24, 20, pixel))
    images = spark.read.format("image").load(str(tmp_path)).select("image.*")
    got = {r.origin.rsplit("/", 1)[1][:-4]: r for r in photos.measured(photos.checked(images, long=1, short=1)).collect()}
    for name, pixel in made.items():
        gray = lambda x, y: sum(w * v for w, v in zip((0.299, 0.587, 0.114), pixel(x, y))) / 255  # noqa: E731, B023
        blur, light, background = measures(24, 20, gray)
        assert got[name].blur == pytest.approx(blur, rel=1e-6) and got[name].brightness == pytest.approx(light, rel=1e-6) and got[name].background_ok == background


def test_sizes(spark):
    rows = [("a", 720, 480), ("b", 719, 480), ("c", 480, 720), ("d", 720, 479), ("e", 1281, 900), ("h", 1282, 900), ("f", 1280, 900), ("g", 4000, 3000)]
    got = {r.origin: (r.fault, r.step) for r in photos.checked(spark.createDataFrame(rows, "origin string, width int, height int")).collect()}
    low = "RESOLUTION_TOO_LOW"
    assert got == {"a": (None, 2), "b": (low, 2), "c": (None, 2), "d": (low, 2), "e": (None, 2), "f": (None, 2), "g": (None, 8), "h": (None, 4)}


def test_no_pixel_is_shuffled(spark, tmp_path):
    (tmp_path / "big.png").write_bytes(png(1500, 1000, lambda x, y: (x % 256, y % 256, 7)))
    (tmp_path / "small.png").write_bytes(png(30, 30, lambda x, y: (x, y, 7)))
    images = spark.read.format("image").load(str(tmp_path)).select("image.*")
    out = photos.measured(photos.checked(images))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "ArrowEvalPython" in plan
    got = out.collect()
    gray = lambda x, y: sum(w * v for w, v in zip((0.299, 0.587, 0.114), (4 * x % 256, 4 * y % 256, 7))) / 255
    blur, light, background = measures(375, 250, gray)
    assert len(got) == 1 and got[0].blur == pytest.approx(blur, rel=1e-6) and got[0].brightness == pytest.approx(light, rel=1e-6) and got[0].background_ok == background
