"""Quality of photos: light, sharpness and background of decoded images, by a stencil over each image in Arrow batches.

Images have the columns of Spark's own image source (spark.read.format("image")): origin, height, width, nChannels, mode and
data, bytes of blue, green and red row by row.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.registry import query
from ..sources import bindings as b

#: Least sides of a photo, and the side to which it is thinned out.
LONG, SHORT, MOST = 720, 480, 640
#: Weights of colours, the border's share, and what sharpness and background are measured by.
RED, GREEN, BLUE, FULL = 299, 587, 114, 255_000
BORDER, SHARP, BORDER_SPREAD, LIGHT_GAP, LEAST_SPREAD = 0.12, 0.0025, 0.055, 0.45, 0.002


def checked(images: DataFrame, long: int = LONG, short: int = SHORT, most: int = MOST) -> DataFrame:
    """The images with `fault`, RESOLUTION_TOO_LOW for small ones, and `step`, the power of two by which they are thinned out."""
    larger, smaller = F.greatest("width", "height"), F.least("width", "height")
    times = F.when(larger > most, F.floor(F.log2(larger / (most + 1)) + 1e-12) + 1).otherwise(0)
    step = F.pow(F.lit(2), times).cast("int")
    return images.withColumn("fault", F.when((larger < long) | (smaller < short), "RESOLUTION_TOO_LOW")).withColumn("step", step)


def pixels(images: DataFrame) -> DataFrame:
    """(origin, width, height, x, y, g): pixels of the images without fault, thinned out; g is light in FULL parts."""
    usable = images.where("fault is null").select("origin", "data", "nChannels", F.col("width").alias("w0"), "step", F.floor(F.col("width") / F.col("step")).cast("int").alias("width"), F.floor(F.col("height") / F.col("step")).cast("int").alias("height"))
    rows = usable.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("height") - 1)))
    # a row's bytes only are carried to its pixels
    row = rows.withColumn("line", F.substr("data", F.col("y") * F.col("step") * F.col("w0") * F.col("nChannels") + 1, F.col("w0") * F.col("nChannels"))).drop("data")
    each = row.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("width") - 1)))
    byte = lambda k: F.conv(F.hex(F.substr("line", F.col("x") * F.col("step") * F.col("nChannels") + k + 1, F.lit(1))), 16, 10).cast("long")
    g = F.when(F.col("nChannels") == 1, byte(0) * (RED + GREEN + BLUE)).otherwise(byte(2) * RED + byte(1) * GREEN + byte(0) * BLUE)
    return each.select("origin", "width", "height", "x", "y", g.alias("g"))


SUMS = ("n", "all", "all2", "lap", "lap2", "rim_n", "rim", "rim2")


@F.arrow_udf(T.StructType([T.StructField(k, T.DecimalType(38, 0)) for k in SUMS]))
def stencil(data: pa.Array, width: pa.Array, height: pa.Array, channels: pa.Array, step: pa.Array) -> pa.Array:
    """Sums over an image's inner pixels: light, light squared, the difference to the four neighbours and its square, and light in the border. Whole numbers in FULL parts."""
    out = []
    for body, w0, h0, k, by in zip(data, width.to_pylist(), height.to_pylist(), channels.to_pylist(), step.to_pylist()):
        cells = np.frombuffer(body.as_buffer(), np.uint8)[: w0 * h0 * k].reshape(h0, w0, k)[: h0 // by * by : by, : w0 // by * by : by].astype(np.int64)
        g = cells[..., 0] * (RED + GREEN + BLUE) if k == 1 else cells[..., 2] * RED + cells[..., 1] * GREEN + cells[..., 0] * BLUE
        h, w = g.shape
        c = g[1:-1, 1:-1]
        lap = g[1:-1, :-2] + g[1:-1, 2:] + g[:-2, 1:-1] + g[2:, 1:-1] - 4 * c
        x, y = np.arange(1, max(w - 1, 1)), np.arange(1, max(h - 1, 1))[:, None]
        rim = (x < w * BORDER) | (x >= w * (1 - BORDER)) | (y < h * BORDER) | (y >= h * (1 - BORDER))
        # squares are added up row by row in 64 bits and then without a bound
        total = lambda v: sum(v.sum(axis=1).tolist())
        own = c * rim
        values = (c.size, total(c), total(c * c), total(lap), total(lap * lap), int(rim.sum()), total(own), total(own * own))
        out.append(dict(zip(SUMS, map(Decimal, values))))
    return pa.array(out, pa.struct([(k, pa.decimal128(38, 0)) for k in SUMS]))


def measured(images: DataFrame) -> DataFrame:
    """(origin, blur, brightness, background_ok) of checked images without fault; the outermost pixels only serve their neighbours. Each image is read where it lies: no pixel is shuffled."""
    usable = images.where("fault is null and width > 2 * step and height > 2 * step")
    sums = usable.select("origin", stencil("data", "width", "height", "nChannels", "step").alias("s")).select("origin", *[F.col(f"s.{k}").cast("double").alias(k) for k in SUMS]).where("n > 0")
    sums = sums.withColumns({"all_n": F.col("n"), "lap_n": F.col("n"), "mid_n": F.col("n") - F.col("rim_n"), "mid": F.col("all") - F.col("rim")})
    mean = lambda k: F.try_divide(F.col(k), F.col(f"{k}_n")) / float(FULL)
    spread = lambda k: F.greatest(F.lit(0.0), F.try_divide(F.col(f"{k}2"), F.col(f"{k}_n")) / float(FULL) ** 2 - mean(k) * mean(k))
    middle = F.when(F.col("mid_n") == 0, mean("all")).otherwise(mean("mid"))
    border = F.when(F.col("rim_n") == 0, F.lit(1.0)).otherwise(spread("rim"))
    background = (border < BORDER_SPREAD) & (F.abs(F.coalesce(mean("rim"), F.lit(0.0)) - middle) < LIGHT_GAP) & (spread("all") > LEAST_SPREAD)
    return sums.select("origin", (1 / (1 + spread("lap") / SHARP)).alias("blur"), mean("all").alias("brightness"), background.alias("background_ok"))


# -- queries: a made-up image for each supplier

_W, _H = "(18 + s_suppkey % 5)", "(16 + s_suppkey % 3)"
_R, _G, _B = "((x * s_suppkey + y * 7) % 256)", "((x * 5 + y * s_suppkey) % 256)", "((x * y + s_suppkey) % 256)"


def images(spark, sf_dir) -> DataFrame:
    s = b.table(spark, sf_dir, "supplier").select("s_suppkey", F.expr(_W).cast("int").alias("width"), F.expr(_H).cast("int").alias("height"))
    cells = F.sequence(F.lit(0), F.col("width") * F.col("height") - 1)

    def cell(i: Column) -> Column:
        x, y, k = i % F.col("width"), F.floor(i / F.col("width")), F.col("s_suppkey")
        hexed = lambda v: F.lpad(F.hex((v % 256).cast("long")), 2, "0")
        return F.concat(hexed(x * y + k), hexed(x * 5 + y * k), hexed(x * k + y * 7))

    return s.select(F.col("s_suppkey").cast("string").alias("origin"), "height", "width", F.lit(3).alias("nChannels"), F.unhex(F.array_join(F.transform(cells, cell), "")).alias("data"))


@query(f"SELECT s_suppkey::VARCHAR AS origin, CASE WHEN {_W} < 20 THEN 'RESOLUTION_TOO_LOW' END AS fault, CASE WHEN {_W} > 21 THEN 4 ELSE 2 END AS step, CASE WHEN {_W} < 20 THEN 0 ELSE ({_W} // CASE WHEN {_W} > 21 THEN 4 ELSE 2 END) * ({_H} // CASE WHEN {_W} > 21 THEN 4 ELSE 2 END) END AS n FROM supplier")
def src_image(spark, sf_dir):
    """Images of under 20 columns are too small here, larger ones are thinned out to 10 or less."""
    held = checked(images(spark, sf_dir), long=20, short=16, most=10)
    n = pixels(held).groupBy("origin").agg(F.count("*").alias("n"))
    return held.join(n, "origin", "left").select("origin", "fault", "step", F.coalesce("n", F.lit(0)).alias("n"))


def _gray(x: str, y: str) -> str:
    put = lambda e: e.replace("x", f"({x})").replace("y * 7", f"({y}) * 7").replace("+ y *", f"+ ({y}) *").replace("* y +", f"* ({y}) +")
    return f"({put(_R)} * 299 + {put(_G)} * 587 + {put(_B)} * 114)"


@query(
    f"""WITH p AS (SELECT s_suppkey, {_W} AS w, {_H} AS h, x, y FROM supplier, (SELECT unnest(range(1, 22)) AS x), (SELECT unnest(range(1, 18)) AS y) WHERE x < {_W} - 1 AND y < {_H} - 1),
q AS (SELECT *, {_gray("x", "y")}::HUGEINT AS c, ({_gray("x - 1", "y")} + {_gray("x + 1", "y")} + {_gray("x", "y - 1")} + {_gray("x", "y + 1")} - 4 * {_gray("x", "y")})::HUGEINT AS lap,
  x < w * 0.12::DOUBLE OR x >= w * 0.88::DOUBLE OR y < h * 0.12::DOUBLE OR y >= h * 0.88::DOUBLE AS edge FROM p),
t AS (SELECT s_suppkey, count(*) AS n, sum(c)::DOUBLE / count(*) / 255000.0::DOUBLE AS mean, sum(c * c)::DOUBLE / count(*) / 65025000000.0::DOUBLE AS square, sum(lap)::DOUBLE / count(*) / 255000.0::DOUBLE AS lmean,
  sum(lap * lap)::DOUBLE / count(*) / 65025000000.0::DOUBLE AS lsquare, sum(c) FILTER (edge)::DOUBLE / count(*) FILTER (edge) / 255000.0::DOUBLE AS rim, sum(c * c) FILTER (edge)::DOUBLE / count(*) FILTER (edge) / 65025000000.0::DOUBLE AS rsquare,
  sum(c) FILTER (NOT edge)::DOUBLE / count(*) FILTER (NOT edge) / 255000.0::DOUBLE AS mid FROM q GROUP BY s_suppkey)
SELECT s_suppkey::VARCHAR AS origin, round(1.0::DOUBLE / (1.0::DOUBLE + greatest(0.0::DOUBLE, lsquare - lmean * lmean) / 0.0025::DOUBLE), 9) AS blur, round(mean, 9) AS brightness,
  greatest(0.0::DOUBLE, rsquare - rim * rim) < 0.055::DOUBLE AND abs(rim - mid) < 0.45::DOUBLE AND greatest(0.0::DOUBLE, square - mean * mean) > 0.002::DOUBLE AS background_ok FROM t"""
)
def agg_image_stats(spark, sf_dir):
    """Measures to nine decimals."""
    m = measured(checked(images(spark, sf_dir), long=1, short=1))
    return m.select("origin", F.round("blur", 9).alias("blur"), F.round("brightness", 9).alias("brightness"), "background_ok")
