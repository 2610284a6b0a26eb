"""Noise reduction: Hadamard planes, Haar bands, BayesShrink.

Three Haar levels of the block grid are exact inside a tile of 16 by 16 pixels,
so planes are dealt out by tile once and every level groups inside its tile: the
grouping keys begin with the keys of that one exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import clamp, div
from ..functions.fixed import PLANES

TILE = ("frame_id", "ty", "tx")


def by_tile(pixels: DataFrame) -> DataFrame:
    return pixels.withColumn("ty", div(F.col("y"), 16)).withColumn("tx", div(F.col("x"), 16)).repartition(*TILE)


def _corners(y: str, x: str, v: str) -> list[Column]:
    """The values of a 2 by 2 block: top left, top right, bottom left, bottom right."""
    return [F.sum(F.when((F.col(y) % 2 == a) & (F.col(x) % 2 == b), F.col(v).cast("double"))) for a in (0, 1) for b in (0, 1)]


def hadamard(pixels: DataFrame) -> DataFrame:
    """pixels (with tile keys) -> tile keys, chan, j, i, c."""
    r, g1, g2, b = _corners("y", "x", "v")
    blocks = pixels.groupBy(*TILE, div(F.col("y"), 2).alias("j"), div(F.col("x"), 2).alias("i")).agg(r.alias("r"), g1.alias("g"), g2.alias("h"), b.alias("b"))
    r, g, h, b = (F.col(k) for k in "rghb")
    planes = {"Y": r + g + h + b, "CH": r - g + h - b, "CV": r + g - h - b, "CD": r - g - h + b}
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("chan"), (v * 0.5).alias("c")) for k, v in planes.items()]))
    return blocks.select(*TILE, "j", "i", rows.alias("_r")).select(*TILE, "_r.chan", "j", "i", "_r.c")


def hadamard_inverse(planes: DataFrame) -> DataFrame:
    """tile keys, chan, j, i, c -> frame_id, y, x, v."""
    pick = {k: F.sum(F.when(F.col("chan") == k, F.col("c"))) for k in PLANES}
    b = planes.groupBy(*TILE, "j", "i").agg(*[v.alias(k) for k, v in pick.items()])
    y, h, v, d = (F.col(k) for k in PLANES)
    out = [(0, 0, y + h + v + d), (0, 1, y - h + v - d), (1, 0, y + h - v - d), (1, 1, y - h - v + d)]
    whole = lambda c: F.floor(clamp(c * 0.5, 0.0, 65535.0) + 0.5).cast("int")
    cells = F.explode(F.array(*[F.struct((F.col("j") * 2 + a).alias("y"), (F.col("i") * 2 + e).alias("x"), whole(c).alias("v")) for a, e, c in out]))
    return b.select("frame_id", cells.alias("_p")).select("frame_id", "_p.*")


def haar(planes: DataFrame) -> DataFrame:
    """One level: tile keys, chan, j, i, c -> tile keys, chan, band (LL, HL, LH, HH), j, i, c."""
    a, b, c, d = _corners("j", "i", "c")
    q = planes.groupBy(*TILE, "chan", div(F.col("j"), 2).alias("j"), div(F.col("i"), 2).alias("i")).agg(a.alias("a"), b.alias("b"), c.alias("c"), d.alias("d"))
    a, b, c, d = (F.col(k) for k in "abcd")
    bands = {"LL": a + b + c + d, "HL": a - b + c - d, "LH": a + b - c - d, "HH": a - b - c + d}
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("band"), (v * 0.5).alias("c")) for k, v in bands.items()]))
    return q.select(*TILE, "chan", "j", "i", rows.alias("_r")).select(*TILE, "chan", "_r.band", "j", "i", "_r.c")


def haar_inverse(bands: DataFrame) -> DataFrame:
    """tile keys, chan, band, j, i, c -> tile keys, chan, j, i, c of the finer level."""
    names = ("LL", "HL", "LH", "HH")
    q = bands.groupBy(*TILE, "chan", "j", "i").agg(*[F.sum(F.when(F.col("band") == k, F.col("c"))).alias(k) for k in names])
    ll, hl, lh, hh = (F.col(k) for k in names)
    out = [(0, 0, ll + hl + lh + hh), (0, 1, ll - hl + lh - hh), (1, 0, ll + hl - lh - hh), (1, 1, ll - hl - lh + hh)]
    cells = F.explode(F.array(*[F.struct((F.col("j") * 2 + a).alias("j"), (F.col("i") * 2 + e).alias("i"), (c * 0.5).alias("c")) for a, e, c in out]))
    return q.select(*TILE, "chan", cells.alias("_p")).select(*TILE, "chan", "_p.j", "_p.i", "_p.c")


def levels(rows: int, columns: int) -> int:
    """Haar levels of a block grid: the third and the second need a grid that divides and is large enough."""
    if min(rows, columns) < 4:
        return 0
    for n in (3, 2):
        if rows % 2**n == 0 and columns % 2**n == 0 and min(rows, columns) // 2**n >= 8:
            return n
    return 1


def decompose(planes: DataFrame, depth: int) -> DataFrame:
    """tile keys, chan, lvl, band, j, i, c: details of every level and LL of the last."""
    out, now = None, planes
    for lvl in range(1, depth + 1):
        bands = haar(now).withColumn("lvl", F.lit(lvl))
        part = bands if lvl == depth else bands.filter("band <> 'LL'")
        out = part if out is None else out.unionByName(part)
        now = bands.filter("band = 'LL'").select(*TILE, "chan", "j", "i", "c")
    return out


def recompose(bands: DataFrame, depth: int) -> DataFrame:
    now = None
    for lvl in range(depth, 0, -1):
        part = bands.filter((F.col("lvl") == lvl) & (F.lit(lvl == depth) | (F.col("band") != "LL"))).select(*TILE, "chan", "band", "j", "i", "c")
        if now is not None:
            part = part.unionByName(now.withColumn("band", F.lit("LL")).select(*part.columns))
        now = haar_inverse(part)
    return now


def noise(bands: DataFrame) -> DataFrame:
    """frame_id, chan, sigma: upper median of |HH| of the first level over 0.6745; 0 below 100 coefficients."""
    first = bands.filter("lvl = 1 AND band = 'HH'").groupBy("frame_id", "chan")
    median = F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY abs(c) DESC)")
    return first.agg(F.when(F.count(F.lit(1)) >= 100, median / 0.6745).otherwise(0.0).alias("sigma"))


def band_stddev(bands: DataFrame) -> DataFrame:
    """frame_id, chan, lvl, band, sd: population deviations from sums and sums of squares."""
    mean, square = F.avg("c"), F.avg(F.col("c") * F.col("c"))
    return bands.filter("band <> 'LL'").groupBy("frame_id", "chan", "lvl", "band").agg(F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))).alias("sd"))


def thresholds(bands: DataFrame, strength: float = 1.0) -> DataFrame:
    """frame_id, chan, lvl, band, t: null where the band is left, infinite where it is zeroed."""
    s = band_stddev(bands).join(noise(bands), ["frame_id", "chan"])
    k = F.lit(strength)
    for name, f in PLANES.items():
        k = F.when(F.col("chan") == name, strength * f).otherwise(k)
    rest = F.col("sd") * F.col("sd") - F.col("sigma") * F.col("sigma")
    t = F.when((F.col("sigma") <= 0) | (k <= 0), F.lit(None)).when(rest <= 0, F.lit(float("inf"))).otherwise(F.col("sigma") * F.col("sigma") / F.sqrt(rest) * k)
    return s.withColumn("t", t.cast("double"))


def shrink(bands: DataFrame, strength: float = 1.0) -> DataFrame:
    """Soft thresholds on the detail bands.  The thresholds are 36 rows a frame."""
    t = thresholds(bands, strength).select("frame_id", "chan", "lvl", "band", "t")
    c, d = bands.join(t, ["frame_id", "chan", "lvl", "band"], "left"), F.col("c")
    soft = F.when(F.col("t").isNull(), d).otherwise(F.signum(d) * F.greatest(F.abs(d) - F.col("t"), F.lit(0.0)))
    return c.withColumn("c", soft).drop("t")


def denoise(pixels: DataFrame, width: int, height: int, strength: float = 1.0) -> DataFrame:
    """frame_id, y, x, v after noise reduction; what lies beyond the last multiple of four is left."""
    w, h = width - width % 4, height - height % 4
    depth = levels(h // 2, w // 2)
    if strength <= 0 or min(w, h) < 16 or not depth:
        return pixels.select("frame_id", "y", "x", "v")
    inner = pixels.filter((F.col("y") < h) & (F.col("x") < w))
    bands = decompose(hadamard(by_tile(inner)), depth)
    done = hadamard_inverse(recompose(shrink(bands, strength), depth))
    if (w, h) == (width, height):
        return done
    return done.unionByName(pixels.filter((F.col("y") >= h) | (F.col("x") >= w)).select("frame_id", "y", "x", "v"))
