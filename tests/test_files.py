"""Whole files, the chain of the look, odd frames, and delivery's peers."""

import random

from pyspark.sql import functions as F
from test_jpeg_scan import serial

from framemill.operators import files, grid
from framemill.plans import develop, queries
from framemill.streaming import delivery

SCHEMA = "frame_id int, y int, x int, v int"


def plane(spark, width, height):
    rnd = random.Random(2)
    return spark.createDataFrame([(0, y, x, 64 + rnd.randrange(700)) for y in range(height) for x in range(width)], SCHEMA)


def test_jpeg_file(spark):
    rnd, width, height = random.Random(8), 21, 18
    picture = {(y, x): tuple(rnd.randrange(256) for _ in range(3)) for y in range(height) for x in range(width)}
    rgb = spark.createDataFrame([(0, y, x, *p) for (y, x), p in picture.items()], "frame_id int, y int, x int, r int, g int, b int")
    got = b"".join(bytes(r["data"]) for r in files.jpeg_file(rgb, width, height, 75).orderBy("part").collect())
    _, _, scan = serial(lambda y, x: picture[y, x], width, height, 75)
    assert got == files.jpeg_start() + files.jpeg_tables(width, height, 75) + bytes(scan) + b"\xff\xd9"
    # The segments follow one another up to the scan, and the frame has its size.
    at, found = 2, []
    while got[at + 1] != 0xDA:
        found.append(got[at + 1])
        if got[at + 1] == 0xC0:
            assert got[at + 5 : at + 9] == height.to_bytes(2, "big") + width.to_bytes(2, "big")
        at += 2 + int.from_bytes(got[at + 2 : at + 4], "big")
    assert found == [0xE0, 0xDB, 0xDB, 0xC0, 0xC4]


def test_dng_file_and_writing(spark, sf_dir, tmp_path):
    shot = queries._shots(spark, sf_dir).filter("frame_id = 0").withColumns({"width": F.lit(5).cast("bigint"), "height": F.lit(3).cast("bigint")})
    p = plane(spark, 5, 3)
    parts = files.dng_file(p, shot)
    prefix = bytes(parts.filter("part = -1").first()["data"])
    want = prefix + b"".join(r["v"].to_bytes(2, "little") for r in p.orderBy("y", "x").collect())
    good, bad = str(tmp_path / "a.dng"), str(tmp_path / "none" / "b.dng")
    out = files.write_files(parts.withColumn("path", F.lit(good)).unionByName(parts.withColumn("path", F.lit(bad))))
    assert {(r["path"], r["rc"], r["bytes"]) for r in out.collect()} == {(good, 0, len(want)), (bad, 2, 0)}
    assert (tmp_path / "a.dng").read_bytes() == want
    rc = spark.createDataFrame([(0, 0), (1, 2), (2, 3)], "frame_id int, rc int")
    assert [r["frame_id"] for r in files.jpegs_to_write(rc, rc.select("frame_id")).collect()] == [0]


def test_odd_frame(spark):
    """The row and the column without a partner keep gain 1, and the whole chain has a value for each pixel."""
    width, height = 19, 17
    bayer, slots = plane(spark, width, height), queries._calibration(spark)
    p = develop.shaded(bayer, slots, width, height, 0.5, 1.0).select("y", "x", grid.gain(width, height).alias("g")).collect()
    ends = [r["g"] for r in p if r["y"] == height - 1 or r["x"] == width - 1]
    assert set(ends) == {1.0} and any(r["g"] != 1 for r in p)
    for look in (develop.Look(), develop.DEPLOYED):
        rgb = develop.develop(bayer, width, height, look, slots, 0.5).collect()
        assert sorted((r["y"], r["x"]) for r in rgb) == [(y, x) for y in range(height) for x in range(width)]
        assert all(0 <= r[c] <= 255 for r in rgb for c in "rgb")
    alone = develop.apply_shading(bayer, slots, width, height, 0.5, 1.0).collect()
    assert len(alone) == width * height and any(r["v"] > 800 for r in alone)


def test_start_is_idempotent(spark, tmp_path):
    stream = spark.readStream.format("rate").load()
    one = delivery.start(stream, "frames", lambda df, n: None, str(tmp_path))
    try:
        assert delivery.start(stream, "frames", lambda df, n: None, str(tmp_path)).id == one.id
    finally:
        one.stop()
