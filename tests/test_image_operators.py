import math

import pytest
from pyspark.sql import functions as F

from framemill.functions import fixed
from framemill.operators import jpeg, pointwise, stencil, wavelet
from framemill.sources import raw
from framemill.streaming import delivery


def plane(spark, height, width, value):
    p = spark.range(height * width).select(F.lit(0).alias("frame_id"), F.floor(F.col("id") / width).cast("int").alias("y"), (F.col("id") % width).cast("int").alias("x"))
    return p.withColumn("v", value(F.col("y"), F.col("x")).cast("int"))


def test_kernels_have_unit_gain():
    for k in (fixed.G_AT_RB, fixed.HORIZ, fixed.VERT, fixed.DIAG, fixed.ALONG_ROW, fixed.ALONG_COLUMN):
        assert sum(k.values()) == 16


def test_flat_field_stays_flat(spark):
    flat = plane(spark, 32, 32, lambda y, x: F.lit(500))
    assert stencil.demosaic(flat, 32, 32).select("r", "g", "b").distinct().collect() == [(500, 500, 500)]
    rgb = flat.select("frame_id", "y", "x", *[F.lit(c).alias(n) for n, c in (("r", 90), ("g", 120), ("b", 60))])
    assert stencil.unsharp(rgb, pointwise.luma709_fixed(), 32).select("r", "g", "b").distinct().collect() == [(90, 120, 60)]
    assert wavelet.denoise(flat, 32, 32).select("v").distinct().collect() == [(500,)]


def test_bands_do_not_show(spark):
    """Halo rows make the result independent of the height of the bands."""
    p = plane(spark, 40, 16, lambda y, x: (y * 37 + x * x * 11) % 1024)
    rows = stencil.to_rows(p, F.col("v"))
    want = {r["y"]: r for r in stencil.with_neighbours(rows, 2, band=64).collect()}
    got = {r["y"]: r for r in stencil.with_neighbours(rows, 2, band=5).collect()}
    assert got == want and len(want) == 40


def test_tiny_frames_are_left_by_noise_reduction(spark):
    p = plane(spark, 16, 16, lambda y, x: (y * 91 + x * 57) % 1024)
    assert sorted(wavelet.denoise(p, 16, 16).collect()) == sorted(p.collect())


def test_odd_frames_keep_their_last_rows(spark):
    p = plane(spark, 35, 34, lambda y, x: (y * 91 + x * 57) % 1024)
    out = wavelet.denoise(p, 34, 35)
    assert out.count() == 35 * 34
    left = p.filter("y >= 32 OR x >= 32")
    assert left.join(out, ["frame_id", "y", "x", "v"], "left_anti").count() == 0


def test_two_frames_as_each_alone(spark):
    a = plane(spark, 32, 32, lambda y, x: (y * 91 + x * 57) % 1024)
    b = plane(spark, 32, 32, lambda y, x: (y * y + x * 13) % 1024).withColumn("frame_id", F.lit(1))
    both = wavelet.denoise(a.unionByName(b), 32, 32)
    assert sorted(both.collect()) == sorted(wavelet.denoise(a, 32, 32).unionByName(wavelet.denoise(b, 32, 32)).collect())


def test_gauss_taps():
    taps = stencil.gauss(3.0)
    assert len(taps) == 17 and math.isclose(sum(taps), 1)
    assert [round(t, 6) for t in taps[:9]] == [0.003816, 0.008779, 0.018077, 0.033306, 0.054913, 0.081015, 0.106955, 0.126353, 0.133571]


def test_quality_table():
    assert jpeg.quality_table(fixed.LUMA_TABLE, 96)[:8] == [1, 1, 1, 1, 2, 3, 4, 5]


def test_zigzag():
    assert fixed.ZIGZAG[:10] == (0, 1, 8, 16, 9, 2, 3, 10, 17, 24)


@pytest.mark.parametrize(("i", "want"), [(0, 0), (1, 2), (163, 25), (1638, 77), (8191, 186), (16383, 255)])
def test_tone_curve(spark, i, want):
    # The middle of the index, so that truncation lands on it.
    c = F.lit((i + 0.5) / 16383.0 if i < 16383 else 1.0)
    assert pointwise.tone_gamma(spark.range(1).select(c.alias("r"), c.alias("g"), c.alias("b"))).first()[0] == want


def test_bits_like_a_serial_writer(spark):
    import random

    rnd = random.Random(5)
    codes = [(0, n // 7, n % 7, rnd.getrandbits(size), size) for n, size in enumerate(rnd.randint(1, 20) for _ in range(200))]
    df = spark.createDataFrame(codes, "frame_id int, block_y int, block_x int, code long, len int").repartition(4)
    bits = "".join(format(c, f"0{n}b") for _, _, _, c, n in codes)
    bits += "1" * (-len(bits) % 8)
    want = [int(bits[k : k + 8], 2) for k in range(0, len(bits), 8)]
    assert [r["byte"] for r in jpeg.bit_pack(df).orderBy("at").collect()] == want


def test_unpack_is_the_inverse_of_packing(spark):
    pixels = [(k * 191 + 7) % 1024 for k in range(18)]
    packed = b"".join(sum(p << (10 * j) for j, p in enumerate(pixels[w : w + 6])).to_bytes(8, "little") for w in range(0, 18, 6))
    got = raw.unpack10(spark.createDataFrame([(1, bytearray(packed))], "row_id int, packed binary"), 18).orderBy("i").collect()
    assert [r["p"] for r in got] == pixels


def test_raw_files(spark, tmp_path):
    def header(width, height):
        h = bytearray(fixed.RAW_HEADER)
        h[:4] = fixed.RAW_MAGIC
        h[0x0C:0x10], h[0x10:0x14] = width.to_bytes(4, "little"), height.to_bytes(4, "little")
        return bytes(h)

    (tmp_path / "raw").mkdir()
    (tmp_path / "wb").mkdir()
    (tmp_path / "raw/a.raw").write_bytes(header(12, 2) + bytes(32) + b"slack")
    (tmp_path / "raw/b.raw").write_bytes(header(12, 2) + bytes(31))
    (tmp_path / "raw/c.raw").write_bytes(b"short")
    (tmp_path / "wb/a.wb").write_bytes(bytes(20))
    (tmp_path / "wb/b.wb").write_bytes(bytes(19))
    got = {r["frame_id"]: r for r in raw.read_raw_files(spark, f"file://{tmp_path}/raw", f"file://{tmp_path}/wb").collect()}
    assert {k: r["rc"] for k, r in got.items()} == {"a": 0, "b": 1, "c": 1}
    assert len(got["a"]["packed"]) == 37 and got["a"]["sidecar"] is not None and got["b"]["sidecar"] is None


@pytest.mark.parametrize(("path", "want"), [("b.dng", "b.jpg"), ("a.x/b", "a.x/b.jpg"), ("b", "b.jpg"), (".hid", ".jpg"), ("b.tar.gz", "b.tar.jpg")])
def test_sibling_path(spark, path, want):
    assert spark.range(1).select(delivery.jpeg_path(F.lit(path))).first()[0] == want


def test_chunks_join_to_the_message(spark):
    m = spark.createDataFrame([(1, 7, bytearray(b"")), (2, 7, bytearray(range(200)))], "seq long, magic long, body binary")
    f = delivery.frame(m)
    wire = {r["seq"]: bytes(r["wire"]) for r in f.collect()}
    assert wire[1] == (7).to_bytes(4, "little") + bytes(4)
    got: dict[int, bytes] = {}
    for r in delivery.chunks(f, 64).orderBy("seq", "chunk").collect():
        assert len(r["data"]) <= 64
        got[r["seq"]] = got.get(r["seq"], b"") + bytes(r["data"])
    assert got == wire
