import struct

from framemill.operators import tiff

COLUMNS = "frame_id int, width long, height long, datetime string, r long, g long, b long, exposure_us long, iso long, fnum_n int, fnum_d int, focal_n int, focal_d int, make string, model string, orientation int"
FULL = (0, 5248, 3936, "2024:01:02 03:04:05", 108134, 65536, 136315, 20000, 400, 2, 1, 49, 10, "Sony", "D5503", 1)
BARE = (1, 128, 128, "2024:01:02 03:04:05", 65536, 65536, 65536, 0, 0, 0, 0, 0, 0, "", None, 0)


def directory(data, at):
    """tag -> (type, count, bytes) of the directory at a place, read by a plain parser."""
    sizes = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 10: 8}
    (n,) = struct.unpack_from("<H", data, at)
    out = {}
    for k in range(n):
        tag, kind, count, value = struct.unpack_from("<HHII", data, at + 2 + 12 * k)
        size = sizes[kind] * count
        out[tag] = (kind, count, data[at + 10 + 12 * k :][:size] if size <= 4 else data[value : value + size])
    return out


def test_dng_prefix(spark):
    rows = {r["frame_id"]: r for r in tiff.dng_prefix(spark.createDataFrame([FULL, BARE], COLUMNS)).collect()}
    full = bytes(rows[0]["prefix"])
    assert (rows[0]["entries"], rows[0]["exif_at"], len(full)) == (43, 1390, 1512)
    assert len(full) + 2 * 5248 * 3936 == 41313768
    d = directory(full, 8)
    assert d[273][2] == struct.pack("<I", 1512) and d[34665][2] == struct.pack("<I", 1390)
    assert d[271] == (2, 5, b"Sony\0") and d[306][2] == b"2024:01:02 03:04:05\0"
    assert struct.unpack("<6I", d[50728][2]) == (65536, 108134, 1, 1, 65536, 136315)
    assert struct.unpack("<18i", d[50721][2])[:4] == (90, 128, -9, 128)
    e = directory(full, 1390)
    assert list(e) == [36864, 36867, 33434, 33437, 34855, 37386]
    assert e[36864][2] == b"0230" and struct.unpack("<2I", e[33434][2]) == (20000, 1000000) and struct.unpack("<H", e[34855][2]) == (400,)
    bare = bytes(rows[1]["prefix"])
    assert list(directory(bare, rows[1]["exif_at"])) == [36864, 36867]


def test_app1(spark):
    nothing = (2, *FULL[1:3], "", *FULL[4:7], 0, 0, 0, 0, 0, 0, "", "", 0)
    rows = {r["frame_id"]: bytes(r["segment"]) for r in tiff.app1(spark.createDataFrame([FULL, BARE, nothing], COLUMNS)).collect()}
    assert set(rows) == {0, 1}
    seg = rows[0]
    assert seg[:2] == b"\xff\xe1" and struct.unpack(">H", seg[2:4])[0] == len(seg) - 2 and seg[4:10] == b"Exif\0\0"
    body = seg[10:]
    d = directory(body, 8)
    assert list(d) == sorted(d) == [271, 272, 274, 306, 34665]
    e = directory(body, struct.unpack("<I", d[34665][2])[0])
    assert list(e) == sorted(e) and e[36867][2] == b"2024:01:02 03:04:05\0" and struct.unpack("<2I", e[37386][2]) == (49, 10)
