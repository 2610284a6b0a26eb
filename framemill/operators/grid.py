"""Lens shading: blending the calibrated grids, fading them where they would clip, sampling them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.exprs import clamp


def warmth(g_r: Column, g_b: Column) -> Column:
    """0 in daylight (R/B gain ratio 1.1 or more), 1 in tungsten light (0.6 or less), linear between."""
    r = F.try_divide(g_r, g_b)
    return F.when(g_b <= 0, 0.0).when(r >= 1.1, 0.0).when(r <= 0.6, 1.0).otherwise((1.1 - r) / 0.5)


def blend(slots: DataFrame, warm: float, strength: float = 1.0) -> DataFrame:
    """slots (frame_id, illum, ch, gy, gx, shading) -> frame_id, ch, gy, gx, shading with equal mean gains of the channels."""
    b = slots.groupBy("frame_id", "ch", "gy", "gx").agg(F.sum(F.col("shading") * F.when(F.col("illum") == "A", 1 - warm).otherwise(warm)).alias("v"))
    b = b.withColumn("v", F.greatest(1.0 + (F.col("v") - 1.0) * strength, F.lit(1e-3)))
    means = b.groupBy("frame_id", "ch").agg(F.avg(1.0 / F.col("v")).alias("mean"))
    means = means.withColumn("target", F.avg("mean").over(Window.partitionBy("frame_id")))
    scale = F.when(F.abs(F.col("mean") - 1) < 1e-4, 1.0).otherwise((F.col("target") - 1) / (F.col("mean") - 1))
    out = b.join(means.withColumn("scale", scale), ["frame_id", "ch"])  # four rows a frame
    return out.select("frame_id", "ch", "gy", "gx", (1.0 / F.greatest(1.0 + (1.0 / F.col("v") - 1.0) * F.col("scale"), F.lit(1e-3))).alias("shading"))


def _cell(at: Column, size: int, cells: int) -> Column:
    return at * ((cells - 1) / (size - 1))


def cell_max(pixels: DataFrame, width: int, height: int) -> DataFrame:
    """frame_id, gy, gx, cell_max for every cell of the grid: the largest of the pixels sampled every 8 rows and columns."""
    near = lambda at, size, cells: clamp((_cell(at, size, cells) + 0.5).cast("int"), 0, cells - 1).cast("int")
    some = pixels.filter((F.col("y") % 8 == 0) & (F.col("x") % 8 == 0))
    found = some.groupBy("frame_id", near(F.col("y"), height, fixed.GRID_H).alias("gy"), near(F.col("x"), width, fixed.GRID_W).alias("gx")).agg(F.max("v").alias("cell_max"))
    frames = pixels.select("frame_id").distinct()
    cells = frames.withColumn("gy", F.explode(F.sequence(F.lit(0), F.lit(fixed.GRID_H - 1)))).withColumn("gx", F.explode(F.sequence(F.lit(0), F.lit(fixed.GRID_W - 1))))
    return cells.join(found, ["frame_id", "gy", "gx"], "left").withColumn("cell_max", F.coalesce("cell_max", F.lit(0)))


def safe_fade(maxima: DataFrame, blended: DataFrame, gains: tuple[float, float, float] = fixed.GAINS) -> DataFrame:
    """frame_id, gy, gx, fade: how much of the correction a cell gives up so that no channel clips."""
    g = blended.join(maxima, ["frame_id", "gy", "gx"])
    mx = (F.col("cell_max") - fixed.BLACK).cast("double")
    wb = F.when(F.col("ch") == 0, gains[0]).when(F.col("ch") == 3, gains[2]).otherwise(gains[1])
    full, room = 1.0 / F.col("shading"), F.try_divide(F.lit(fixed.SAFE_SHARE * fixed.WHITE), mx * wb)
    part = F.when(mx <= 0, 1.0).when(room >= full, 1.0).when(room <= 1, 0.0).otherwise((room - 1.0) / (full - 1.0))
    return g.groupBy("frame_id", "gy", "gx").agg((1.0 - F.min(part)).alias("fade"))


def smooth(fade: DataFrame) -> DataFrame:
    """[1 2 1] / 4 along rows, then along columns; the edges repeat."""
    def once(df: DataFrame, along: str, across: str) -> DataFrame:
        w = Window.partitionBy("frame_id", across).orderBy(along)
        t = F.col("fade")
        return df.withColumn("fade", (F.coalesce(F.lag(t).over(w), t) + t * 2.0 + F.coalesce(F.lead(t).over(w), t)) * 0.25)

    return once(once(fade, "gx", "gy"), "gy", "gx")


def as_arrays(blended: DataFrame, fade: DataFrame) -> DataFrame:
    """One row a frame: the shading of 4 * 63 cells and the fade of 63 cells, in order."""
    s = blended.groupBy("frame_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ch", "gy", "gx", "shading"))), lambda c: c["shading"]).alias("_s"))
    f = fade.groupBy("frame_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("gy", "gx", "fade"))), lambda c: c["fade"]).alias("_f"))
    return s.join(f, "frame_id")


def gain(width: int, height: int, odd_ends: bool = True) -> Column:
    """The shading gain of a pixel from the arrays _s and _f of its frame.

    With odd_ends the last row or column of an odd frame, which has no partner, keeps gain 1.
    """
    def place(at: Column, size: int, cells: int) -> tuple[Column, Column]:
        g = _cell(at, size, cells)
        i = clamp(g.cast("int"), 0, cells - 2).cast("int")
        return i, clamp(g - i, 0.0, 1.0)

    y, x = F.col("y"), F.col("x")
    (y0, fy), (x0, fx) = place(y, height, fixed.GRID_H), place(x, width, fixed.GRID_W)
    at = lambda dy, dx: F.get("_s", ((y % 2) * 2 + x % 2) * 63 + (y0 + dy) * 9 + x0 + dx)
    left, right = (at(0, d) * (1.0 - fy) + at(1, d) * fy for d in (0, 1))
    shade = left * (1.0 - fx) + right * fx
    (ty, gy), (tx, gx) = place(y - y % 2, height, fixed.GRID_H), place(x - x % 2, width, fixed.GRID_W)
    fade_at = lambda dy: F.get("_f", (ty + dy) * 9 + tx) * (1.0 - gx) + F.get("_f", (ty + dy) * 9 + tx + 1) * gx
    t = clamp(fade_at(0) * (1.0 - gy) + fade_at(1) * gy, 0.0, 1.0)
    out = 1.0 + (1.0 / shade - 1.0) * (1.0 - t)
    for at, size in ((y, height), (x, width)):
        if odd_ends and size % 2:
            out = F.when(at == size - 1, 1.0).otherwise(out)
    return out
