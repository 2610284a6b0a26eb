"""Whole files of frames as ordered pieces (frame_id, part, data), and writing them.

A file is never one value: a DNG is its directories and a piece a row of pixels, a
JPEG its header, stretches of the scan and an end.  A writer appends the pieces of
a file one after another, so its memory does not grow with the frame.
"""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from . import jpeg, tiff

#: Bytes of the scan in a piece.
PIECE = 1 << 16
#: What writing a file returns: done, not opened, not written whole.
WRITTEN, NOT_OPENED, SHORT = 0, 2, 3
DONE = "path string, rc int, bytes long"


def _bytes(values: Column) -> Column:
    """An array of values 0..255 as binary."""
    return F.unhex(F.array_join(F.transform(values, lambda b: F.lpad(F.hex(b.cast("bigint")), 2, "0")), ""))


def dng_strip(pixels: DataFrame) -> DataFrame:
    """pixels (frame_id, y, x, v) -> frame_id, part, data: each row as little-endian 16-bit integers."""
    rows = pixels.groupBy("frame_id", "y").agg(F.array_sort(F.collect_list(F.struct("x", "v"))).alias("_c"))
    both = F.flatten(F.transform("_c", lambda c: F.array(c["v"] % 256, F.floor(c["v"] / 256).cast("int"))))
    return rows.select("frame_id", F.col("y").cast("int").alias("part"), _bytes(both).alias("data"))


def dng_file(pixels: DataFrame, shots: DataFrame) -> DataFrame:
    """The directories as part -1, then the strip; shots have what tiff.dng_prefix needs."""
    head = tiff.dng_prefix(shots).select("frame_id", F.lit(-1).alias("part"), F.col("prefix").alias("data"))
    return head.unionByName(dng_strip(pixels))


def _segment(marker: int, body: bytes) -> bytes:
    return bytes((0xFF, marker)) + (len(body) + 2).to_bytes(2, "big") + body


def jpeg_start() -> bytes:
    """Start of image and a JFIF 1.1 segment of 72 dots an inch."""
    return b"\xff\xd8" + _segment(0xE0, b"JFIF\0\1\1\1" + 2 * (72).to_bytes(2, "big") + bytes(2))


def jpeg_tables(width: int, height: int, quality: int) -> bytes:
    """Quantisation tables, a baseline frame with halved chroma, Huffman tables, start of the scan."""
    bases, codes = (fixed.LUMA_TABLE, fixed.CHROMA_TABLE), ((fixed.DC_LUMA, fixed.AC_LUMA), (fixed.DC_CHROMA, fixed.AC_CHROMA))
    steps = [jpeg.quality_table(b, quality) for b in bases]
    out = b"".join(_segment(0xDB, bytes((k, *(s[i] for i in fixed.ZIGZAG)))) for k, s in enumerate(steps))
    size = height.to_bytes(2, "big") + width.to_bytes(2, "big")
    out += _segment(0xC0, b"\x08" + size + bytes((3, 1, 0x22, 0, 2, 0x11, 1, 3, 0x11, 1)))
    out += _segment(0xC4, b"".join(bytes((ac << 4 | k, *counts, *symbols)) for k, pair in enumerate(codes) for ac, (counts, symbols) in enumerate(pair)))
    return out + _segment(0xDA, bytes((3, 1, 0, 2, 0x11, 3, 0x11, 0, 63, 0)))


def jpeg_file(rgb: DataFrame, width: int, height: int, quality: int, shots: DataFrame | None = None) -> DataFrame:
    """rgb (frame_id, y, x, r, g, b; 8 bit) as JPEG; shots have what tiff.app1 needs, frames without it get no EXIF segment.

    Part -1 is everything before the scan; the end of image is the last part.
    """
    if not (0 < width <= 65535 and 0 < height <= 65535):
        raise ValueError("a JPEG has 1 to 65535 rows and columns")
    tables = [jpeg.quality_table(t, quality) for t in (fixed.LUMA_TABLE, fixed.CHROMA_TABLE)]
    coded = jpeg.quantise(jpeg.fdct(jpeg.mcu_blocks(rgb, width, height), jpeg.MCU), *tables, jpeg.MCU)
    bytes_at = jpeg.scan(jpeg.scan_codes(coded)).withColumn("part", F.floor(F.col("at") / PIECE).cast("int"))
    pieces = bytes_at.groupBy("frame_id", "part").agg(_bytes(F.transform(F.array_sort(F.collect_list(F.struct("at", "byte"))), lambda c: c["byte"])).alias("data"))
    frames = rgb.select("frame_id").distinct()
    exif = F.lit(b"")
    if shots is not None:
        frames, exif = frames.join(tiff.app1(shots), "frame_id", "left"), F.coalesce("segment", F.lit(b""))
    head = frames.select("frame_id", F.lit(-1).alias("part"), F.concat(F.lit(jpeg_start()), exif, F.lit(jpeg_tables(width, height, quality))).alias("data"))
    end = frames.select("frame_id", F.lit((1 << 31) - 1).alias("part"), F.lit(b"\xff\xd9").alias("data"))
    return head.unionByName(pieces).unionByName(end)


def write_files(pieces: DataFrame) -> DataFrame:
    """pieces (path, part, data) -> path, rc, bytes; the folders must be ones that all executors share.

    A task has whole files, with their pieces in order.  A file is truncated first,
    so a repeated task writes the same bytes.  rc 2: not opened, 3: not written whole.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(path: str, rc: int, size: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([rc], pa.int32()), pa.array([size], pa.int64())], names=["path", "rc", "bytes"])

        now, out, rc, size = None, None, WRITTEN, 0
        for batch in batches:
            for path, data in zip(batch.column("path"), batch.column("data"), strict=True):
                if (name := path.as_py()) != now:
                    if now is not None:
                        yield done(now, _closed(out, rc), size)
                    now, out, rc, size = name, None, WRITTEN, 0
                    try:
                        out = Path(name).open("wb")
                    except OSError:
                        rc = NOT_OPENED
                if rc == WRITTEN:
                    try:
                        size += out.write(data.as_py())
                    except OSError:
                        rc = SHORT
        if now is not None:
            yield done(now, _closed(out, rc), size)

    return pieces.select("path", "part", "data").repartition("path").sortWithinPartitions("path", "part").mapInArrow(work, DONE)


def _closed(out, rc: int) -> int:
    if out is None:
        return rc
    try:
        out.close()
    except OSError:
        return SHORT
    return rc


def jpegs_to_write(dngs: DataFrame, jpegs: DataFrame) -> DataFrame:
    """jpegs (frame_id, ...) of the frames whose DNG was written (frame_id, rc); what becomes of a JPEG changes no return code."""
    return jpegs.join(dngs.filter(F.col("rc") == WRITTEN).select("frame_id").distinct(), "frame_id", "left_semi")
