"""From a Bayer plane to a finished picture: the chain of operators and its parameters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import grid, pointwise, stencil, wavelet


@dataclass(frozen=True)
class Look:
    """The look without deployment (noise reduction and shading off, no sharpening)."""

    noise: float = 0.0
    lift: float = 0.025
    saturation: float = 1.2
    tone: float = 0.6
    exposure: float = 1.0
    shading: float = 0.0
    sharpen: float = 0.0
    radius: float = 3.0
    threshold: int = 3
    quality: int = 96


#: The deployed look.
DEPLOYED = Look(noise=1.0, lift=0.02, saturation=1.4, tone=0.4, exposure=1.5, shading=1.0, sharpen=0.8)


def shaded(bayer: DataFrame, slots: DataFrame, width: int, height: int, warm: float, strength: float) -> DataFrame:
    """bayer with _s and _f, the arrays of the shading gain of its frame; slots as raw.lsc_slots gives them."""
    blended = grid.blend(slots, warm, strength)
    fade = grid.smooth(grid.safe_fade(grid.cell_max(bayer, width, height), blended))
    return bayer.join(F.broadcast(grid.as_arrays(blended, fade)), "frame_id", "left")  # 315 numbers a frame


def develop(bayer: DataFrame, width: int, height: int, look: Look = Look(), slots: DataFrame | None = None, warm: float = 0.0) -> DataFrame:
    """bayer (frame_id, y, x, v) -> frame_id, y, x, r, g, b of 8 bits.

    Frames without a good shading table get none.  Each step is a DataFrame of the one
    before; sizes that cannot be demosaiced are an error.
    """
    if width < 2 or height < 2:
        raise ValueError("a frame has two rows and two columns or more")
    if slots is not None and look.shading > 0:
        gain = F.when(F.col("_s").isNull() | F.col("_f").isNull(), 1.0).otherwise(grid.gain(width, height))
        plane = pointwise.black_wb(shaded(bayer, slots, width, height, warm, look.shading), gain=gain).select("frame_id", "y", "x", "v")
    else:
        plane = pointwise.black_wb(bayer)
    rgb = stencil.demosaic(wavelet.denoise(plane, width, height, look.noise), width, height)
    lit = pointwise.exposure(pointwise.color_matrix(pointwise.normalize(rgb)), look.exposure)
    out = pointwise.tone_gamma(pointwise.saturation(pointwise.black_lift(lit, look.lift), look.saturation), look.tone)
    out = out.select("frame_id", "y", "x", *[F.col(c).cast("int").alias(c) for c in "rgb"])
    return stencil.unsharp(out, pointwise.luma709_fixed(), width, look.sharpen, look.radius, look.threshold)


def apply_shading(bayer: DataFrame, slots: DataFrame, width: int, height: int, warm: float, strength: float) -> DataFrame:
    """bayer times its whole shading gain, without fading: nearest integer, 0..65535."""
    blended = grid.blend(slots, warm, strength)
    none = blended.select("frame_id", "gy", "gx").distinct().withColumn("fade", F.lit(0.0))
    p = bayer.join(F.broadcast(grid.as_arrays(blended, none)), "frame_id")  # 315 numbers a frame
    whole = F.floor(F.col("v") * grid.gain(width, height, odd_ends=False) + 0.5)
    return p.select("frame_id", "y", "x", F.least(F.greatest(whole, F.lit(0)), F.lit(65535)).cast("int").alias("v"))
