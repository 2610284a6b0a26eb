"""Operators on neighbourhoods: demosaic and sharpening.

Pixels of a row become one array.  Rows are dealt out in bands with the halo that
the stencil reaches, so a frame is never one task, and a window over the rows of
a band gives each row its neighbours.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.exprs import clamp
from .pointwise import parity

BAND = 64


def to_rows(pixels: DataFrame, value: Column) -> DataFrame:
    """frame_id, y, row: the values of a row in the order of x."""
    cells = pixels.groupBy("frame_id", "y").agg(F.array_sort(F.collect_list(F.struct("x", value.alias("v")))).alias("_c"))
    return cells.select("frame_id", "y", F.transform("_c", lambda c: c["v"]).alias("row"))


def with_neighbours(rows: DataFrame, reach: int, band: int = BAND) -> DataFrame:
    """rows with r{k} for the rows k away, -reach..reach; the first and last row of a frame repeat."""
    near = F.array_distinct(F.array(*[F.floor((F.col("y") + k) / band).cast("int") for k in (-reach, 0, reach)]))
    halo = rows.withColumn("_band", F.explode(near))
    w = Window.partitionBy("frame_id", "_band").orderBy("y")
    out = {0: F.col("row")}
    for sign, step in ((-1, F.lag), (1, F.lead)):
        for k in range(1, reach + 1):
            out[sign * k] = F.coalesce(*[step("row", n).over(w) for n in range(k, 0, -1)], F.col("row"))
    done = halo.select("frame_id", "y", "_band", *[c.alias(f"r{k}".replace("-", "m")) for k, c in sorted(out.items())])
    return done.filter(F.floor(F.col("y") / band) == F.col("_band")).drop("_band")


def _at(dy: int, dx: int, width: int) -> Column:
    x = F.col("x") + dx if dx else F.col("x")
    return F.get(f"r{dy}".replace("-", "m"), clamp(x, 0, width - 1).cast("int") if dx else x)


def _conv(kernel: dict[tuple[int, int], int], width: int) -> Column:
    total = reduce(lambda a, b: a + b, [_at(dy, dx, width) * w for (dy, dx), w in kernel.items()])
    return F.greatest(F.shiftright(total, 4), F.lit(0))


def demosaic(pixels: DataFrame, width: int, height: int) -> DataFrame:
    """frame_id, y, x, r, g, b: directional 5 by 5 interpolation, bilinear in a border of two pixels."""
    p = with_neighbours(to_rows(pixels, F.col("v")), 2).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
    at = lambda dy, dx: _at(dy, dx, width)
    h = F.abs(at(0, -1) - at(0, 1)) + F.abs(at(0, -2) - at(0, 2))
    v = F.abs(at(-1, 0) - at(1, 0)) + F.abs(at(-2, 0) - at(2, 0))
    p = p.withColumn("_way", F.when(F.abs(h - v) <= fixed.DIRECTION_THRESHOLD, "n").when(h < v, "h").otherwise("v"))
    border = (F.col("y") < 2) | (F.col("y") >= height - 2) | (F.col("x") < 2) | (F.col("x") >= width - 2)
    way = lambda w: F.col("_way") == w
    conv = lambda k: _conv(k, width)
    green = F.when(way("h"), conv(fixed.ALONG_ROW)).when(way("v"), conv(fixed.ALONG_COLUMN)).otherwise(conv(fixed.G_AT_RB))
    row = F.when(way("h"), conv(fixed.ALONG_ROW)).otherwise(conv(fixed.HORIZ))
    column = F.when(way("v"), conv(fixed.ALONG_COLUMN)).otherwise(conv(fixed.VERT))
    own, cross = at(0, 0), conv(fixed.DIAG)
    plain = bilinear(width)
    by = {0: (own, green, cross), 1: (row, own, column), 2: (column, own, row), 3: (cross, green, own)}
    out = {c: F.when(border, plain[c]) for c in "rgb"}
    for k, c in enumerate("rgb"):
        inner = F.when(parity() == 0, by[0][k]).when(parity() == 1, by[1][k]).when(parity() == 2, by[2][k]).otherwise(by[3][k])
        out[c] = out[c].otherwise(inner)
    return p.select("frame_id", "y", "x", *[v.cast("int").alias(c) for c, v in out.items()])


def bilinear(width: int) -> dict[str, Column]:
    """r, g, b from the nearest neighbours."""
    at = lambda dy, dx: _at(dy, dx, width)
    mean = lambda *cells: F.shiftright(reduce(lambda a, b: a + b, cells), {2: 1, 4: 2}[len(cells)])
    own, row, column = at(0, 0), mean(at(0, -1), at(0, 1)), mean(at(-1, 0), at(1, 0))
    four, cross = mean(at(-1, 0), at(1, 0), at(0, -1), at(0, 1)), mean(at(-1, -1), at(-1, 1), at(1, -1), at(1, 1))
    by = {"r": (own, row, column, cross), "g": (four, own, own, four), "b": (cross, column, row, own)}
    return {c: F.when(parity() == 0, k[0]).when(parity() == 1, k[1]).when(parity() == 2, k[2]).otherwise(k[3]) for c, k in by.items()}


def demosaic_bilinear(pixels: DataFrame, width: int) -> DataFrame:
    p = with_neighbours(to_rows(pixels, F.col("v")), 1).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
    return p.select("frame_id", "y", "x", *[v.cast("int").alias(c) for c, v in bilinear(width).items()])


def gauss(radius: float) -> list[float]:
    """Normalised taps; the radius is the deviation."""
    s = min(8.0, max(0.3, radius))
    n = min(16, max(1, math.ceil(2.5 * s)))
    taps = [math.exp(-(k * k) / (2 * s * s)) for k in range(-n, n + 1)]
    return [t / sum(taps) for t in taps]


def blur(rows: DataFrame, width: int, radius: float = fixed.RADIUS) -> DataFrame:
    """rows (frame_id, y, row) -> frame_id, y, x, v: a Gaussian along rows, then along columns, each pass rounded half to even."""
    across = blur_rows(rows, width, radius)
    return blur_columns(across, width, radius)


def blur_rows(rows: DataFrame, width: int, radius: float = fixed.RADIUS) -> DataFrame:
    taps = gauss(radius)
    n = len(taps) // 2
    tap = lambda x: reduce(lambda a, b: a + b, [F.get("row", clamp(x + (k - n), 0, width - 1).cast("int")) * t for k, t in enumerate(taps)])
    return rows.select("frame_id", "y", F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda x: F.rint(tap(x)).cast("int")).alias("row"))


def blur_columns(rows: DataFrame, width: int, radius: float = fixed.RADIUS) -> DataFrame:
    taps = gauss(radius)
    n = len(taps) // 2
    p = with_neighbours(rows, n).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
    total = reduce(lambda a, b: a + b, [F.get(f"r{k - n}".replace("-", "m"), F.col("x")) * t for k, t in enumerate(taps)])
    return p.select("frame_id", "y", "x", F.rint(total).cast("int").alias("v"))


def unsharp(rgb: DataFrame, luma: Column, width: int, amount: float = fixed.AMOUNT, radius: float = fixed.RADIUS, threshold: int = fixed.THRESHOLD) -> DataFrame:
    """rgb (8 bit) with the part of luma above its blur added to all channels, as far as none leaves 0..255."""
    if amount <= 0:
        return rgb
    soft = blur(to_rows(rgb, luma), width, radius).withColumnRenamed("v", "_soft")
    d = luma - F.col("_soft")
    past = F.when(d > threshold, d - threshold).when(d < -threshold, d + threshold).otherwise(0)
    delta = F.rint(past * F.lit(float(amount))).cast("int")
    top, low = F.greatest("r", "g", "b"), F.least("r", "g", "b")
    step = F.when(delta > 0, F.least(delta, 255 - top)).otherwise(F.greatest(delta, -low))
    out = rgb.join(soft, ["frame_id", "y", "x"]).withColumn("_step", step)
    return out.select("frame_id", "y", "x", *[(F.col(c) + F.col("_step")).cast("int").alias(c) for c in "rgb"])
