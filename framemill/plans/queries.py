"""The registered queries of the image operators, each over a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.exprs import format_datetime, le_bytes, u32_at
from ..operators import files, grid, jpeg, pointwise, stencil, tiff, wavelet
from ..sources import bridges, raw
from ..streaming import delivery
from . import develop

Query = Callable[[SparkSession, str], DataFrame]
W = bridges.WIDTH


def _height(spark: SparkSession, sf_dir: str) -> int:
    """Rows of the bridge's plane: half the vectors, down to a multiple of 16."""
    n = spark.read.parquet(f"{sf_dir}/embeddings.parquet").count() // 2
    return n - n % 16


def plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bridges.bayer_from_embeddings(spark, sf_dir)


def balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The structured plane after black level and white balance."""
    return pointwise.black_wb(bridges.bayer_structured(spark, sf_dir))


def black_wb_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pointwise.black_wb(plain(spark, sf_dir)).groupBy(pointwise.parity().cast("int").alias("ch"))
    return p.agg(F.count(F.lit(1)).alias("n"), F.sum("v").cast("long").alias("total"), F.min("v").alias("low"), F.max("v").alias("high"))


def black_wb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pointwise.black_wb(plain(spark, sf_dir)).select("y", "x", "v")


def bayer_structured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bridges.bayer_structured(spark, sf_dir).select("y", "x", "v")


def _unpacked(packed: DataFrame) -> DataFrame:
    """The pixels of all words of every row."""
    return raw.unpack10(packed, F.octet_length("packed") / 8 * 6)


def unpack10_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _unpacked(bridges.packed_rows(spark, sf_dir, "documents", "doc_id", "text"))


def unpack10_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _unpacked(bridges.packed_rows(spark, sf_dir, "pages", "page_id", "html"))


def read_u32(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = bridges.packed_rows(spark, sf_dir, "documents", "doc_id", "text")
    return p.select("row_id", *[u32_at(F.col("packed"), at).alias(f"u{at}") for at in (0, 5, 44)])


def headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A RAW header and a sidecar for each customer; every fifth has no magic, every third no red gain, every second no sidecar."""
    k = F.col("c_custkey")
    values = {"width": k % 5248 + 6, "height": k % 3936 + 1, "exposure_us": k * 37 % 500000, "iso": k * 211 % 40000, "g": F.lit(65536), "r": F.when(k % 3 == 0, 0).otherwise(65536 + k * 97), "b": 65536 + k * 131}
    parts, at = [F.when(k % 5 == 0, F.lit(b"XXX\0")).otherwise(F.lit(fixed.RAW_MAGIC))], 4
    for name, offset in sorted(fixed.HEADER.items(), key=lambda f: f[1]):
        parts += [F.lit(bytes(offset - at)), le_bytes(values[name], 4)]
        at = offset + 4
    lsc = [F.lit(bytes(fixed.LSC_OFFSET - at))]
    for slot in range(8):
        ch, a = slot % 4, 3 - slot // 4
        cells = [128 - (a + ch) * (c // 9 - 3) ** 2 - 2 * (c % 9 - 4) ** 2 for c in range(63)]
        lsc.append(F.lit(bytes(cells[:31])))
        lsc.append(F.when((k % 7 == 0) & F.lit(slot == 5), F.lit(bytes([127]))).otherwise(F.lit(bytes([128]))))
        lsc.append(F.when((k % 11 == 0) & F.lit(slot == 2), F.lit(bytes(32))).otherwise(F.lit(bytes(cells[32:]))))
        lsc.append(F.lit(bytes(1)))
    rest = fixed.RAW_HEADER - fixed.LSC_OFFSET - 8 * fixed.LSC_STRIDE
    header = F.concat(*parts, *lsc, F.lit(bytes(rest)))
    side = F.concat(le_bytes(F.when(k % 4 == 0, 1).otherwise(fixed.WB_MAGIC), 4), F.lit(bytes(4)), le_bytes(k + 70000, 4), le_bytes(F.lit(65536), 4), le_bytes(k + 90000, 4))
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(k.alias("frame_id"), header.alias("header"), F.when(k % 2 == 0, side).alias("sidecar"))


def header_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return headers(spark, sf_dir).select("frame_id", *raw.header_fields(F.col("header"))).filter("width IS NOT NULL")


def wb_gains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return headers(spark, sf_dir).select("frame_id", raw.wb_gains(F.col("header"), F.col("sidecar")).alias("_g")).select("frame_id", "_g.*")


def wb_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also the neutral of the shot: g/r and g/b."""
    g = wb_gains(spark, sf_dir)
    one = F.lit(65536)
    ratio = lambda c: F.round(pointwise.wb_ratio(F.col(c), one, F.col("g"), one), 9)
    return g.select("frame_id", ratio("r").alias("gain_r"), ratio("b").alias("gain_b"), F.col("g").alias("neutral_num"), F.col("r").alias("neutral_r_den"), F.col("b").alias("neutral_b_den"))


def exif_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return headers(spark, sf_dir).select("frame_id", raw.exif_fields(F.col("header")).alias("_e")).select("frame_id", "_e.*")


def lsc_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal tables are counted first, so a table is parsed once for all of its frames."""
    tables = headers(spark, sf_dir).groupBy(raw.lsc_table(F.col("header")).alias("table")).agg(F.count(F.lit(1)).alias("frames"))
    s = raw.lsc_cells(tables, "frames")
    return s.groupBy("illum", "ch", "gy", "gx").agg(F.sum("frames").alias("frames"), F.max("shading").alias("shading"))


def lsc_warmth(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = wb_gains(spark, sf_dir)
    return g.select("frame_id", F.round(grid.warmth(F.col("r").cast("double"), F.col("b").cast("double")), 9).alias("warmth"))


def _calibration(spark: SparkSession) -> DataFrame:
    """The literal calibration of the fixtures, as parsed from a header: one frame."""
    rows = [(0, i, ch, gy, gx, (128 - (a + ch) * (gy - 3) ** 2 - 2 * (gx - 4) ** 2) / 128) for i, a in (("A", 3), ("B", 2)) for ch in range(4) for gy in range(7) for gx in range(9)]
    return spark.createDataFrame(rows, "frame_id int, illum string, ch int, gy int, gx int, shading double")


def _blended(spark: SparkSession) -> DataFrame:
    return grid.blend(_calibration(spark), 0.5)


def lsc_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _blended(spark).select("ch", "gy", "gx", F.round("shading", 9).alias("shading"))


def lsc_cell_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.cell_max(plain(spark, sf_dir), W, _height(spark, sf_dir)).select("gy", "gx", "cell_max")


def _fade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.safe_fade(grid.cell_max(plain(spark, sf_dir), W, _height(spark, sf_dir)), _blended(spark))


def lsc_safe_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fade(spark, sf_dir).select("gy", "gx", F.round("fade", 9).alias("fade"))


def fade_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.smooth(_fade(spark, sf_dir)).select("gy", "gx", F.round("fade", 9).alias("fade"))


def black_wb_lsc(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrays = grid.as_arrays(_blended(spark), grid.smooth(_fade(spark, sf_dir)))
    p = plain(spark, sf_dir).join(F.broadcast(arrays), "frame_id")  # 315 numbers a frame
    return pointwise.black_wb(p, gain=grid.gain(W, _height(spark, sf_dir))).select("y", "x", "v")


def hadamard_fwd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.hadamard(wavelet.by_tile(balanced(spark, sf_dir))).select("chan", "j", "i", "c")


def hadamard_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.hadamard_inverse(wavelet.hadamard(wavelet.by_tile(balanced(spark, sf_dir)))).select("y", "x", "v")


def _bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.decompose(wavelet.hadamard(wavelet.by_tile(balanced(spark, sf_dir))), 3)


def haar_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bands(spark, sf_dir).select("chan", "lvl", "band", "j", "i", F.round("c", 6).alias("c"))


def mad_sigma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.noise(_bands(spark, sf_dir)).select("chan", F.round("sigma", 6).alias("sigma"))


def band_stddev(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.band_stddev(_bands(spark, sf_dir)).select("chan", "lvl", "band", F.round("sd", 6).alias("sd"))


def bayes_shrink(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = wavelet.thresholds(_bands(spark, sf_dir))
    return t.select("chan", "lvl", "band", F.when(F.col("t") == float("inf"), -1.0).otherwise(F.round("t", 6)).alias("t"))


def bayer_nr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.denoise(balanced(spark, sf_dir), W, _height(spark, sf_dir)).select("y", "x", "v")


def demosaic_border(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stencil.demosaic_bilinear(balanced(spark, sf_dir), W).select("y", "x", "r", "g", "b")


def demosaic_mhc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stencil.demosaic(balanced(spark, sf_dir), W, _height(spark, sf_dir)).select("y", "x", "r", "g", "b")


def _linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pointwise.normalize(stencil.demosaic_bilinear(balanced(spark, sf_dir), W))


def _rounded(rgb: DataFrame) -> DataFrame:
    return rgb.select("y", "x", *[F.round(c, 6).alias(c) for c in "rgb"])


def color_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(pointwise.color_matrix(_linear(spark, sf_dir)))


def exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(pointwise.exposure(pointwise.color_matrix(_linear(spark, sf_dir))))


def saturation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(pointwise.saturation(pointwise.black_lift(pointwise.color_matrix(_linear(spark, sf_dir)))))


def _rgb8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Integers 0..255 of the bilinear planes, for the operators on finished images."""
    rgb = stencil.demosaic_bilinear(balanced(spark, sf_dir), W)
    return rgb.select("frame_id", "y", "x", *[(F.col(c) % 256).cast("int").alias(c) for c in "rgb"])


def tone_gamma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The curve on all 14-bit values that the customers' balances reach."""
    c = F.col("c_custkey") % 16384 / 16383.0
    t = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", c.alias("r"), (c * 0.5).alias("g"), (1.0 - c).alias("b"))
    return pointwise.tone_gamma(t)


def luma709_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rgb8(spark, sf_dir).select("y", "x", pointwise.luma709_fixed().cast("int").alias("luma"))


def blur_h(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stencil.blur_rows(stencil.to_rows(_rgb8(spark, sf_dir), pointwise.luma709_fixed()), W)
    return rows.select("y", F.posexplode("row").alias("x", "v"))


def blur_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stencil.blur_columns(stencil.to_rows(_rgb8(spark, sf_dir), pointwise.luma709_fixed()), W).select("y", "x", "v")


def unsharp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stencil.unsharp(_rgb8(spark, sf_dir), pointwise.luma709_fixed(), W).select("y", "x", "r", "g", "b")


def rgb_to_ycc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rgb8(spark, sf_dir).select("y", "x", pointwise.ycc_luma().cast("int").alias("luma"))


def chroma_420(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jpeg.chroma_420(_rgb8(spark, sf_dir)).select("cy", "cx", "cb", "cr")


def quality_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(q, i, v) for q in (1, 25, 50, 75, 96, 100) for i, v in enumerate(jpeg.quality_table(fixed.LUMA_TABLE, q))]
    return spark.createDataFrame(rows, "quality int, place int, step int")


def huff_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(jpeg.huffman(*fixed.DC_LUMA), "symbol int, code int, len int")


def fdct8x8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jpeg.fdct(jpeg.luma_blocks(_rgb8(spark, sf_dir))).select("block_y", "block_x", "u", "w", "c")


def _quantised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jpeg.quantise(jpeg.fdct(jpeg.luma_blocks(_rgb8(spark, sf_dir))), jpeg.quality_table(fixed.LUMA_TABLE, 75))


def quantize_zigzag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quantised(spark, sf_dir).select("block_y", "block_x", "k", "q")


def _scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quantised blocks of the whole scan, luma and chroma."""
    blocks = jpeg.mcu_blocks(_rgb8(spark, sf_dir), W, _height(spark, sf_dir))
    return jpeg.quantise(jpeg.fdct(blocks, jpeg.MCU), jpeg.quality_table(fixed.LUMA_TABLE, 75), jpeg.quality_table(fixed.CHROMA_TABLE, 75), jpeg.MCU)


def dc_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jpeg.dc_delta(_scanned(spark, sf_dir)).select("my", "mx", "block", "diff", "size")


def ac_rle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jpeg.ac_runs(_quantised(spark, sf_dir)).select("block_y", "block_x", "k", "run", "size", "zrls")


def bit_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entropy-coded bytes of the scan; checked against the serial form in the tests."""
    return jpeg.scan(jpeg.scan_codes(_scanned(spark, sf_dir))).select(F.col("at").cast("long").alias("at"), "byte")


def frame_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delivery.frame(bridges.messages(spark, sf_dir)).select("seq", "body_len", F.lower(F.hex("wire")).alias("wire"))


def message_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = delivery.chunks(delivery.frame(bridges.messages(spark, sf_dir)), 16)
    return c.select("seq", "chunk", F.lower(F.hex("data")).alias("data"))


def sink_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = bridges.messages(spark, sf_dir)
    peer, path = F.when(F.col("peer") % 3 == 0, F.col("peer")), F.when(F.col("seq") % 4 != 0, F.concat(F.lit("out.d/f"), F.col("seq").cast("string"), F.when(F.col("seq") % 2 == 0, ".dng").otherwise("")))
    return m.select("seq", delivery.sink_route(peer, path).alias("sink"), delivery.jpeg_path(path).alias("jpeg"))


def peer_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delivery.newest_peer(bridges.messages(spark, sf_dir))


def _shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A frame for each nation, with what the containers need; some lack exposure, sensitivity or a maker."""
    k = F.col("n_nationkey")
    return spark.read.parquet(f"{sf_dir}/nation.parquet").select(
        k.cast("int").alias("frame_id"), (k * 100 + 128).cast("bigint").alias("width"), (k * 10 + 64).cast("bigint").alias("height"), F.lit("2024:01:02 03:04:05").alias("datetime"),
        (65536 + k * 999).cast("bigint").alias("r"), F.lit(65536).cast("bigint").alias("g"), (65536 + k * 777).cast("bigint").alias("b"),
        F.when(k % 4 == 0, 0).otherwise(k * 1000).cast("bigint").alias("exposure_us"), F.when(k % 3 == 0, 0).otherwise(k * 100).cast("bigint").alias("iso"),
        *[F.lit(v).alias(n) for n, v in (("fnum_n", 2), ("fnum_d", 1), ("focal_n", 49), ("focal_d", 10))],
        F.when(k % 5 != 0, F.col("n_name")).alias("make"), F.lit("D5503").alias("model"), F.lit(1).alias("orientation"),
    )


def ifd_dng(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bytes before the strip of a DNG file."""
    return tiff.dng_prefix(_shots(spark, sf_dir)).select("frame_id", "entries", "exif_at", F.octet_length("prefix").alias("size"), F.hex("prefix").alias("prefix"))


def ifd_exif(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The EXIF segment of a JPEG file."""
    return tiff.app1(_shots(spark, sf_dir)).select("frame_id", F.hex("segment").alias("segment"))


def dng_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.dng_strip(plain(spark, sf_dir)).select("part", F.lower(F.hex("data")).alias("data"))


def developed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole chain with the deployed look."""
    height = _height(spark, sf_dir)
    return develop.develop(bridges.bayer_structured(spark, sf_dir), W, height, develop.DEPLOYED, _calibration(spark), 0.5).select("y", "x", "r", "g", "b")


def jpeg_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of a JPEG of the bilinear plane."""
    return files.jpeg_file(_rgb8(spark, sf_dir), W, _height(spark, sf_dir), 75).select("part", F.lower(F.hex("data")).alias("data"))


def has_peer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven endpoints; purchases end a connection, and some user ids are no app's."""
    m = spark.read.parquet(f"{sf_dir}/events.parquet")
    uid = F.col("user_id") * 37 % 14000 + 8000
    m = m.select((F.col("event_id") % 7).alias("endpoint"), "ts", F.col("event_id").alias("seq"), (F.col("user_id") % 5).alias("peer"), (F.col("event_type") != "purchase").alias("open"), uid.alias("uid"))
    return delivery.has_peer(delivery.admitted(m))


def shot_datetime(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text that the containers hold, of every event's time."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", format_datetime(F.col("ts")).alias("datetime"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        black_wb_stats, black_wb, bayer_structured, unpack10_documents, unpack10_pages, read_u32, header_fields, wb_gains, wb_ratio, exif_fields, lsc_parse, lsc_warmth,
        lsc_blend, lsc_cell_max, lsc_safe_fraction, fade_smooth, black_wb_lsc, hadamard_fwd, hadamard_roundtrip, haar_levels, mad_sigma, band_stddev, bayes_shrink,
        bayer_nr, demosaic_border, demosaic_mhc, color_matrix, exposure, saturation, tone_gamma, luma709_fixed, blur_h, blur_v, unsharp, rgb_to_ycc, chroma_420,
        quality_table, huff_table, fdct8x8, quantize_zigzag, dc_delta, ac_rle, bit_pack, frame_messages, message_chunks, sink_route, peer_latest, ifd_dng, ifd_exif, dng_strip, developed, jpeg_file, has_peer, shot_datetime,
    )
}
