"""RAW frames: headers, packed pixels, sidecars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import byte_at, u32_at
from ..functions.fixed import HEADER, LSC_CELLS, LSC_OFFSET, LSC_STRIDE, RAW_HEADER, RAW_MAGIC, WB_MAGIC


def read_raw_files(spark: SparkSession, frames: str, sidecars: str | None = None) -> DataFrame:
    """(frame_id, path, header, packed, width, height, sidecar, rc) of RAW files; a sidecar is matched by its stem.

    rc is 1 for files that are too short for a header or for their own pixels, else 0.
    """
    stem = F.regexp_extract("path", "([^/]*?)(\\.[^./]*)?$", 1)
    f = spark.read.format("binaryFile").load(frames).select(stem.alias("frame_id"), "path", F.col("content").alias("_c"))
    size = F.octet_length("_c")
    f = f.withColumn("header", F.when(size >= RAW_HEADER, F.substring("_c", 1, RAW_HEADER)))
    f = f.withColumn("width", u32_at(F.col("header"), HEADER["width"])).withColumn("height", u32_at(F.col("header"), HEADER["height"]))
    stride = F.ceil(F.col("width") / 6) * 8
    ok = F.coalesce((F.col("width") > 0) & (F.col("height") > 0) & (size >= F.col("height") * stride + RAW_HEADER), F.lit(False))
    f = f.withColumn("packed", F.when(ok, F.substring(F.col("_c"), F.lit(RAW_HEADER + 1), size))).withColumn("rc", F.when(ok, 0).otherwise(1)).drop("_c")
    if sidecars is None:
        return f.withColumn("sidecar", F.lit(None).cast("binary"))
    s = spark.read.format("binaryFile").load(sidecars).select(stem.alias("frame_id"), F.substring("content", 1, 256).alias("_s"))
    return f.join(s, "frame_id", "left").withColumn("sidecar", F.when(F.octet_length("_s") >= 20, F.col("_s"))).drop("_s")


def header_fields(header: Column) -> list[Column]:
    """The fields of a header; null where the magic is wrong or the header is short."""
    ok = (F.octet_length(header) >= RAW_HEADER) & (F.substring(header, 1, 4) == F.lit(RAW_MAGIC))
    return [F.when(ok, u32_at(header, at)).alias(name) for name, at in HEADER.items()]


def wb_gains(header: Column, sidecar: Column) -> Column:
    """struct r, g, b (Q16): a valid sidecar, else a valid header, else 1:1:1."""
    def pick(data: Column, ok: Column, at: tuple[int, int, int]) -> Column:
        r, g, b = (u32_at(data, a) for a in at)
        return F.when(ok & (r > 0) & (g > 0) & (b > 0), F.struct(r.alias("r"), g.alias("g"), b.alias("b")))

    one = F.lit(65536).cast("bigint")
    side = pick(sidecar, (F.octet_length(sidecar) >= 20) & (u32_at(sidecar, 0) == WB_MAGIC), (8, 12, 16))
    head = pick(header, (F.octet_length(header) >= RAW_HEADER) & (F.substring(header, 1, 4) == F.lit(RAW_MAGIC)), (HEADER["r"], HEADER["g"], HEADER["b"]))
    return F.coalesce(side, head, F.struct(one.alias("r"), one.alias("g"), one.alias("b")))


def exif_fields(header: Column) -> Column:
    """exposure_us, iso (at most 25600), f-number 2/1 and focal length 49/10."""
    ok = (F.octet_length(header) >= RAW_HEADER) & (F.substring(header, 1, 4) == F.lit(RAW_MAGIC))
    zero = F.lit(0).cast("bigint")
    exposure = F.when(ok, u32_at(header, HEADER["exposure_us"])).otherwise(zero)
    iso = F.when(ok, F.least(u32_at(header, HEADER["iso"]), F.lit(25600))).otherwise(zero)
    return F.struct(exposure.alias("exposure_us"), iso.alias("iso"), *[F.lit(v).alias(n) for n, v in (("fnum_n", 2), ("fnum_d", 1), ("focal_n", 49), ("focal_d", 10))])


def lsc_table(header: Column) -> Column:
    """The bytes of the eight slots; null where the header is short."""
    size = 8 * LSC_STRIDE
    return F.when(F.octet_length(header) >= LSC_OFFSET + size, F.substring(header, LSC_OFFSET + 1, size))


def lsc_cells(tables: DataFrame, *keys: str) -> DataFrame:
    """tables (keys, table) -> keys, illum, ch, gy, gx, shading; no rows where a slot is bad, which is decided before there are cells."""
    ok = F.octet_length("table") >= 8 * LSC_STRIDE
    for at in range(1, 8 * LSC_STRIDE, LSC_STRIDE):
        ok &= (F.substring("table", at + 31, 1) == F.lit(bytes([128]))) & ~F.contains(F.substring("table", at, LSC_CELLS), F.lit(bytes(1)))
    cells = tables.withColumn("slot", F.explode(F.when(ok, F.sequence(F.lit(0), F.lit(7))))).withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(LSC_CELLS - 1))))
    raw = byte_at(F.col("table"), F.col("slot") * LSC_STRIDE + F.col("cell"))
    illum = F.when(F.col("slot") < 4, "A").otherwise("B")
    return cells.select(*keys, illum.alias("illum"), (F.col("slot") % 4).alias("ch"), F.floor(F.col("cell") / 9).cast("int").alias("gy"), (F.col("cell") % 9).alias("gx"), (raw / 128.0).alias("shading"))


def lsc_slots(frames: DataFrame) -> DataFrame:
    """frames (frame_id, header) -> frame_id, illum, ch, gy, gx, shading; no rows where a slot is bad."""
    return lsc_cells(frames.select("frame_id", lsc_table(F.col("header")).alias("table")), "frame_id")


def unpack10(rows: DataFrame, width: int | Column) -> DataFrame:
    """rows (row_id, packed) -> row_id, i, p: six 10-bit pixels in each little-endian 64-bit word; one width, or a column with that of each row."""
    n = (F.lit(width) if isinstance(width, int) else width).cast("int")
    words = rows.withColumn("_n", n).filter("_n > 0").withColumn("_w", F.explode(F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / 6).cast("int"))))
    h = F.hex(F.substring("packed", F.col("_w") * 8 + 1, F.lit(8)))
    # The low 60 bits of a word hold its pixels.
    low = F.substring(F.concat(*[F.substring(h, k, 2) for k in range(15, 0, -2)]), 2, 15)
    words = words.select("row_id", "_n", (F.col("_w") * 6).alias("_at"), F.conv(F.nullif(low, F.lit("")), 16, 10).cast("bigint").alias("_v"))
    cells = words.withColumn("_j", F.explode(F.sequence(F.lit(0), F.least(F.lit(5), F.col("_n") - 1 - F.col("_at")))))
    p = F.call_function("shiftright", F.col("_v"), F.col("_j") * 10).bitwiseAND(F.lit(1023))
    return cells.select("row_id", (F.col("_at") + F.col("_j")).alias("i"), p.cast("int").alias("p"))
