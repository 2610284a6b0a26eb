"""Queries over whole tables, against brute force that shares nothing with their SQL."""

import pytest
from pyspark.sql import functions as F

from framemill.plans.queries import QUERIES
from framemill.sources import raw


def texts(duck, table, key, text):
    """(key, bytes) of whole texts, filled with zeros to words of 8 bytes."""
    rows = [(k, t.encode()) for k, t in duck.sql(f"SELECT {key}, {text} FROM {table}").fetchall()]
    return [(k, b + bytes(-len(b) % 8)) for k, b in rows]


def pixels(b):
    words = [int.from_bytes(b[k : k + 8], "little") for k in range(0, len(b), 8)]
    return [w >> 10 * j & 1023 for w in words for j in range(6)]


def test_lsc_parse_counts_every_frame(spark, sf_dir, duck):
    keys = [k for (k,) in duck.sql("SELECT c_custkey FROM customer").fetchall()]
    good = sum(k % 7 != 0 and k % 11 != 0 for k in keys)
    assert len(keys) > 60 and good > 60
    want = {
        (i, ch, gy, gx, good, (128 - (a + ch) * (gy - 3) ** 2 - 2 * (gx - 4) ** 2) / 128)
        for i, a in (("A", 3), ("B", 2)) for ch in range(4) for gy in range(7) for gx in range(9)
    }
    rows = QUERIES["lsc_parse"](spark, sf_dir).select("illum", "ch", "gy", "gx", "frames", "shading").collect()
    assert len(rows) == len(want) == 504 and {tuple(r) for r in rows} == want


@pytest.mark.parametrize(("name", "table", "key", "text"), [("unpack10_documents", "documents", "doc_id", "text"), ("unpack10_pages", "pages", "page_id", "html")])
def test_unpack_reads_whole_texts(name, table, key, text, spark, sf_dir, duck):
    """Every pixel counts in the sums, and its place too."""
    want = {}
    for k, b in texts(duck, table, key, text):
        p = pixels(b)
        if p:
            want[k] = (len(p), sum(p), sum(v * (i + 1) for i, v in enumerate(p)), len(p) - 1)
    assert max(n for n, *_ in want.values()) > 36
    p = F.col("p").cast("long")
    found = QUERIES[name](spark, sf_dir).groupBy("row_id").agg(F.count("p"), F.sum(p), F.sum(p * (F.col("i") + 1)), F.max("i"))
    assert {r[0]: tuple(r[1:]) for r in found.collect()} == want


def test_unpack_rows_of_different_widths(spark):
    rows = [(1, bytearray(b"")), (2, bytearray(b"abc".ljust(8, b"\0"))), (3, bytearray(range(200, 256)))]
    df = spark.createDataFrame(rows, "row_id long, packed binary")
    got = {(r["row_id"], r["i"]): r["p"] for r in raw.unpack10(df, F.octet_length("packed") / 8 * 6).collect()}
    assert got == {(k, i): v for k, b in rows for i, v in enumerate(pixels(bytes(b)))}


def test_read_u32_keeps_short_rows(spark, sf_dir, duck):
    want = [(k, *[int.from_bytes(b[at : at + 4], "little") if len(b) >= at + 4 else None for at in (0, 5, 44)]) for k, b in texts(duck, "documents", "doc_id", "text")]
    got = [tuple(r) for r in QUERIES["read_u32"](spark, sf_dir).select("row_id", "u0", "u5", "u44").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert any(None in w for w in want)
