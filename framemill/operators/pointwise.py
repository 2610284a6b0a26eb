"""Operators on one pixel: white balance, colour, tone, luma."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.exprs import clamp, half_away


def parity() -> Column:
    """0 R, 1 Gr, 2 Gb, 3 B."""
    return (F.col("y") % 2) * 2 + F.col("x") % 2


def wb_ratio(num: Column, den: Column, g_num: Column, g_den: Column) -> Column:
    """(num * g_den) / (den * g_num), 1 where that is not a positive number."""
    r = F.try_divide(num.cast("double") * g_den, den.cast("double") * g_num)
    return F.when((r > 0) & ~F.isnan(r), r).otherwise(F.lit(1.0))


def black_wb(pixels: DataFrame, q: tuple[int, int, int] = fixed.Q16, gain: Column | None = None) -> DataFrame:
    """v minus black, times the shading gain, times the Q16 gain of its colour, plus the pedestal."""
    of = F.when(parity() == 0, q[0]).when(parity() == 3, q[2]).otherwise(q[1]).cast("bigint")
    v = (F.col("v") - fixed.BLACK).cast("bigint")
    if gain is not None:
        v = F.when(gain != 1, half_away(v * gain)).otherwise(v)
    out = F.shiftright(v * of + 32768, 16) + fixed.PEDESTAL
    return pixels.withColumn("v", clamp(out, 0, 65535).cast("int"))


def normalize(rgb: DataFrame) -> DataFrame:
    """r, g, b from pedestalled integers to 0..1."""
    return rgb.withColumns({c: clamp(F.greatest(F.col(c) - fixed.PEDESTAL, F.lit(0)) * (1.0 / fixed.WHITE), 0.0, 1.0) for c in "rgb"})


def color_matrix(rgb: DataFrame) -> DataFrame:
    r, g, b = (F.col(c) for c in "rgb")
    return rgb.withColumns({c: r * m[0] + g * m[1] + b * m[2] for c, m in zip("rgb", fixed.CAM_TO_SRGB, strict=True)})


def luma() -> Column:
    return sum((F.col(c) * w for c, w in zip("rgb", fixed.LUMA709, strict=True)), F.lit(0.0))


def exposure(rgb: DataFrame, e: float = fixed.EXPOSURE) -> DataFrame:
    """A curve of luma that is linear between 1024 points over [0, 2)."""
    if e == 1:
        return rgb
    pos = luma() * 512.0
    at = clamp(F.floor(pos), 0, 1022)
    rest = F.when(F.floor(pos) > 1022, 1.0).otherwise(pos - at)
    point = lambda i: e / (1.0 + (e - 1.0) * (i * (2.0 / 1024)))
    ratio = F.when(luma() > 1e-6, point(at) + (point(at + 1) - point(at)) * rest).otherwise(F.lit(e))
    return rgb.withColumn("_ratio", ratio).withColumns({c: F.col(c) * F.col("_ratio") for c in "rgb"}).drop("_ratio")


def black_lift(rgb: DataFrame, lift: float = fixed.LIFT) -> DataFrame:
    return rgb.withColumns({c: F.col(c) - lift for c in "rgb"})


def saturation(rgb: DataFrame, s: float = fixed.SATURATION) -> DataFrame:
    if s == 1:
        return rgb
    return rgb.withColumn("_y", luma()).withColumns({c: F.col("_y") + (F.col(c) - F.col("_y")) * s for c in "rgb"}).drop("_y")


def tone_gamma(rgb: DataFrame, k: float = fixed.TONE) -> DataFrame:
    """8-bit values: 14-bit index, S-curve blend, gamma 2.2."""
    def curve(c: Column) -> Column:
        lin = clamp(c * 16383.0, 0.0, 16383.0).cast("int") / 16383.0
        toned = lin * (1.0 - k) + lin * lin * (3.0 - 2.0 * lin) * k
        return clamp(F.pow(clamp(toned, 0.0, 1.0), F.lit(1.0 / 2.2)) * 255.0 + 0.5, 0.0, 255.0).cast("int")

    return rgb.withColumns({c: curve(F.col(c)) for c in "rgb"})


def look(rgb: DataFrame) -> DataFrame:
    """Demosaiced integers to 8-bit sRGB with the deployed look."""
    return tone_gamma(saturation(black_lift(exposure(color_matrix(normalize(rgb))))))


def luma709_fixed() -> Column:
    return F.shiftright(F.col("r") * 217 + F.col("g") * 732 + F.col("b") * 74 + 512, 10)


def ycc_luma() -> Column:
    return F.shiftright(F.col("r") * 19595 + F.col("g") * 38470 + F.col("b") * 7471 + 32768, 16) - 128
