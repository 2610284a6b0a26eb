"""TIFF directories: DNG prefixes and EXIF segments as relations of entries, laid out by prefix sums.

An entry is (ord, tag, type, count, data).  Data of four bytes or less stays in
the entry; longer data goes behind the directory, each piece at an even place,
whose offset is the sum of the padded lengths before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import le_bytes

BYTE, ASCII, SHORT, LONG, RATIONAL, UNDEFINED, SRATIONAL = 1, 2, 3, 4, 5, 7, 10
#: First byte behind a directory with room for 64 entries.
PAYLOAD = 8 + 2 + 64 * 12 + 4
#: Colour calibration as numerators over 128 and the identity, row by row.
COLOR_MATRIX_1 = (90, -9, -12, -80, 183, 19, -31, 49, 70)
COLOR_MATRIX_2 = (127, -43, 43, -100, 238, -1, -15, 38, 80)
FORWARD_MATRIX_1 = (102, 6, 15, 43, 97, -12, 11, -49, 144)
FORWARD_MATRIX_2 = (111, 19, -6, 46, 86, -4, -3, -85, 194)
IDENTITY = (1, 0, 0, 0, 1, 0, 0, 0, 1)


def _int(value: int | Column, size: int) -> Column:
    return F.lit((value % (1 << 8 * size)).to_bytes(size, "little")) if isinstance(value, int) else le_bytes(value, size)


def _entry(tag: int, kind: int, count: int | Column, *parts: tuple[int | Column, int] | Column) -> Column:
    data = F.concat(*[_int(*p) if isinstance(p, tuple) else p for p in parts])
    count = F.lit(count) if isinstance(count, int) else count
    return F.struct(F.lit(tag).alias("tag"), F.lit(kind).alias("type"), count.cast("int").alias("count"), data.alias("data"))


def short(tag: int, *values: int | Column) -> Column:
    return _entry(tag, SHORT, len(values), *[(v, 2) for v in values])


def long(tag: int, value: int | Column) -> Column:
    return _entry(tag, LONG, 1, (value, 4))


def raw_bytes(tag: int, data: bytes, kind: int = BYTE) -> Column:
    return _entry(tag, kind, len(data), F.lit(data))


def ascii_text(tag: int, text: str | Column) -> Column:
    data = F.concat(F.encode(F.lit(text) if isinstance(text, str) else text, "UTF-8"), F.lit(b"\0"))
    return _entry(tag, ASCII, F.octet_length(data), data)


def rationals(tag: int, *values: int | Column, kind: int = RATIONAL) -> Column:
    return _entry(tag, kind, len(values) // 2, *[(v, 4) for v in values])


def matrix(tag: int, values: tuple[int, ...], over: int) -> Column:
    return rationals(tag, *[x for v in values for x in (v, over)], kind=SRATIONAL)


def _laid_out(entries: DataFrame, start: Column, align: bool) -> DataFrame:
    """entries (frame_id, ord, tag, type, count, data, ...) with ``value``: the data itself or the place it gets from start on."""
    size = F.octet_length("data")
    room = F.when(size > 4, size + (size % 2 if align else 0)).otherwise(0)
    before = Window.partitionBy("frame_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    at = start + F.coalesce(F.sum(room).over(before), F.lit(0))
    inline = F.substring(F.concat(F.col("data"), F.lit(bytes(4))), 1, 4)
    return entries.withColumn("offset", F.when(size > 4, at)).withColumn("value", F.when(size > 4, le_bytes(at, 4)).otherwise(inline)).withColumn("_room", room)


def _joined(part: Column) -> Column:
    """The parts of a directory in order, as bytes; a directory has a few dozen entries."""
    ordered = F.array_sort(F.collect_list(F.struct("ord", part.alias("p"))))
    return F.unhex(F.array_join(F.transform(ordered, lambda e: F.hex(e["p"])), ""))


def _directory(laid: DataFrame, align: bool) -> DataFrame:
    """frame_id, n, head (count, entries, next), body (data behind the directory)."""
    twelve = F.concat(le_bytes(F.col("tag"), 2), le_bytes(F.col("type"), 2), le_bytes(F.col("count"), 4), F.col("value"))
    long_data = F.octet_length("data") > 4
    padded = F.when(long_data, F.concat(F.col("data"), F.when((F.octet_length("data") % 2 == 1) & F.lit(align), F.lit(b"\0")).otherwise(F.lit(b"")))).otherwise(F.lit(b""))
    d = laid.groupBy("frame_id").agg(F.count(F.lit(1)).alias("n"), _joined(twelve).alias("_e"), _joined(padded).alias("body"), F.sum("_room").alias("room"))
    return d.select("frame_id", "n", F.concat(le_bytes(F.col("n"), 2), F.col("_e"), F.lit(bytes(4))).alias("head"), "body", "room")


def _rows(frames: DataFrame, entries: list[Column], present: list[Column | None]) -> DataFrame:
    numbered = [F.when(F.lit(True) if p is None else p, F.struct(F.lit(k).alias("ord"), e.alias("e"))) for k, (e, p) in enumerate(zip(entries, present, strict=True))]
    x = frames.select("frame_id", F.explode(F.array(*numbered)).alias("x")).filter("x IS NOT NULL")
    return x.select("frame_id", "x.ord", "x.e.*")


def exif_entries(version_first: bool) -> tuple[list[Column], list[Column | None]]:
    """The sub-directory's entries in the order of the DNG (version first) or ascending by tag."""
    c = F.col
    version = (raw_bytes(36864, b"0230", UNDEFINED), None)
    taken = (ascii_text(36867, c("datetime")), F.coalesce(c("datetime"), F.lit("")) != "")
    time = (rationals(33434, c("exposure_us"), 1000000), c("exposure_us") > 0)
    stop = (rationals(33437, c("fnum_n"), c("fnum_d")), (c("fnum_n") > 0) & (c("fnum_d") > 0))
    iso = (short(34855, c("iso")), c("iso") > 0)
    focal = (rationals(37386, c("focal_n"), c("focal_d")), (c("focal_n") > 0) & (c("focal_d") > 0))
    both = [version, taken, time, stop, iso, focal] if version_first else [time, stop, iso, version, taken, focal]
    return [e for e, _ in both], [p for _, p in both]


def dng_tags() -> list[Column]:
    """The 42 entries before the EXIF pointer, in their order of emission; columns width, height, datetime, r, g, b (Q16 gains)."""
    c = F.col
    return [
        long(254, 0), long(256, c("width")), long(257, c("height")), short(258, 16), short(259, 1), short(262, 32803), ascii_text(271, "Sony"), ascii_text(272, "D5503"),
        long(273, c("_strip")), short(274, 1), short(277, 1), long(278, c("height")), long(279, c("width") * c("height") * 2), short(284, 1), ascii_text(305, "framemill raw 0.1"),
        ascii_text(306, c("datetime")), rationals(282, 72, 1), rationals(283, 72, 1), short(296, 2), short(33421, 2, 2), raw_bytes(33422, bytes((0, 1, 1, 2))),
        raw_bytes(50706, bytes((1, 4, 0, 0))), raw_bytes(50707, bytes((1, 0, 0, 0))), ascii_text(50708, "Sony D5503 (IMX2000A)"), raw_bytes(50710, bytes((0, 1, 2))), short(50711, 1),
        short(50713, 2, 2), short(50714, 64, 64, 64, 64), long(50717, 1023), rationals(50718, 1, 1, 1, 1), rationals(50719, 0, 1, 0, 1), rationals(50720, c("width"), 1, c("height"), 1),
        short(50778, 21), short(50779, 17), matrix(50721, COLOR_MATRIX_1, 128), matrix(50722, COLOR_MATRIX_2, 128), matrix(50964, FORWARD_MATRIX_1, 128), matrix(50965, FORWARD_MATRIX_2, 128),
        matrix(50723, IDENTITY, 1), matrix(50724, IDENTITY, 1), rationals(50728, c("g"), c("r"), 1, 1, c("g"), c("b")), rationals(50730, 0, 100, kind=SRATIONAL),
    ]


def dng_prefix(frames: DataFrame) -> DataFrame:
    """frames (frame_id, width, height, datetime, r, g, b and the EXIF columns) -> frame_id, entries, exif_at, prefix.

    The strip follows the prefix, so its offset is the prefix's size: known once
    the lengths of all data are, before any byte is written.
    """
    zero = frames.withColumn("_strip", F.lit(0).cast("bigint"))
    tags = dng_tags()
    size = F.octet_length("data")
    behind = _rows(zero, tags, [None] * len(tags)).groupBy("frame_id").agg(F.sum(F.when(size > 4, size + size % 2).otherwise(0)).alias("_room"))
    exif, present = exif_entries(version_first=True)
    sub = _rows(frames, exif, present).join(behind.withColumn("exif_at", F.col("_room") + PAYLOAD).drop("_room"), "frame_id")
    count = F.count(F.lit(1)).over(Window.partitionBy("frame_id"))
    sub = _laid_out(sub.withColumn("_n", count), F.col("exif_at") + 6 + F.col("_n") * 12, align=False)
    at = sub.groupBy("frame_id").agg(F.first("exif_at").alias("exif_at"))
    sub = _directory(sub, align=False).join(at, "frame_id").select("frame_id", "exif_at", F.concat("head", "body").alias("_sub"))
    sub = sub.withColumn("_strip", F.col("exif_at") + F.octet_length("_sub"))
    whole = frames.join(sub, "frame_id")
    tags = [*dng_tags(), long(34665, F.col("exif_at"))]
    main = _directory(_laid_out(_rows(whole, tags, [None] * len(tags)), F.lit(PAYLOAD), align=True), align=True)
    out = main.join(sub, "frame_id")
    start = F.concat(F.lit(b"II*\0"), le_bytes(F.lit(8), 4), F.col("head"))
    gap = F.unhex(F.repeat(F.lit("00"), (F.lit(PAYLOAD) - F.octet_length(start)).cast("int")))
    return out.select("frame_id", F.col("n").cast("int").alias("entries"), F.col("exif_at").cast("int").alias("exif_at"), F.concat(start, gap, "body", "_sub").alias("prefix"))


def app1(frames: DataFrame) -> DataFrame:
    """frames (frame_id, make, model, orientation, datetime and the EXIF columns) -> frame_id, segment: the APP1 segment of a JPEG.

    Long data of both directories lies behind them, in the order of the entries.
    Frames without any field have no row, nor do segments that exceed 64 KB.
    """
    c = F.col
    there = lambda k: F.coalesce(c(k), F.lit("")) != ""
    first = [ascii_text(271, c("make")), ascii_text(272, c("model")), short(274, c("orientation")), ascii_text(306, c("datetime"))]
    if_first = [there("make"), there("model"), c("orientation") > 0, there("datetime")]
    exif, if_exif = exif_entries(version_first=False)
    counted = lambda flags: sum((F.when(f, 1).otherwise(0) for f in flags if f is not None), F.lit(sum(f is None for f in flags)))
    f = frames.withColumn("_n0", counted(if_first) + 1).withColumn("_n1", counted(if_exif)).filter("_n0 > 1 OR _n1 > 1")
    f = f.withColumn("_sub_at", F.lit(8 + 6) + c("_n0") * 12).withColumn("_data_at", c("_sub_at") + 6 + c("_n1") * 12)
    rows = _rows(f, [*first, long(34665, c("_sub_at")), *exif], [*if_first, None, *if_exif]).join(f.select("frame_id", "_data_at"), "frame_id")
    laid = _laid_out(rows, c("_data_at"), align=True)
    d0 = _directory(laid.filter(c("ord") <= 4), align=True).select("frame_id", c("head").alias("_h0"), c("body").alias("_b0"))
    d1 = _directory(laid.filter(c("ord") > 4), align=True).select("frame_id", c("head").alias("_h1"), c("body").alias("_b1"))
    body = F.concat(F.lit(b"Exif\0\0II*\0"), le_bytes(F.lit(8), 4), "_h0", "_h1", "_b0", "_b1")
    size = F.hex(F.octet_length("_body") + 2)
    out = d0.join(d1, "frame_id").withColumn("_body", body).filter(F.octet_length("_body") + 2 <= 0xFFFF)
    return out.select("frame_id", F.concat(F.lit(b"\xff\xe1"), F.unhex(F.lpad(size, 4, "0")), "_body").alias("segment"))
