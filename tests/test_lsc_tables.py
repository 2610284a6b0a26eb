"""Shading tables: what a header yields, and how many cells are made for it."""

from framemill.functions import fixed
from framemill.plans import queries
from framemill.sources import raw

GOOD = [128 - (3 - s // 4 + s % 4) * (c // 9 - 3) ** 2 - 2 * (c % 9 - 4) ** 2 for s in range(8) for c in range(63)]


def header(changes=(), size=fixed.RAW_HEADER, padding=0):
    cells = GOOD[:]
    for k, v in changes:
        cells[k] = v
    slots = b"".join(bytes(cells[s * 63 : s * 63 + 63]) + bytes([padding]) for s in range(8))
    return (bytes(fixed.LSC_OFFSET) + slots + bytes(fixed.RAW_HEADER))[:size]


def parsed(frame_id, h):
    """The reference's parser, slot by slot."""
    if h is None or len(h) < 0x5C8 + 512:
        return []
    slots = [h[0x5C8 + s * 64 :][:63] for s in range(8)]
    if any(p[3 * 9 + 4] != 128 or 0 in p for p in slots):
        return []
    return [(frame_id, "AB"[s // 4], s % 4, c // 9, c % 9, v / 128) for s, p in enumerate(slots) for c, v in enumerate(p)]


def test_each_header_is_judged_by_itself(spark):
    """Also those that share a frame's name, or have none."""
    centre, last = 5 * 63 + 31, 7 * 63 + 62
    rows = [
        (1, header()), (2, header([(centre, 127)])), (3, header([(last, 0)])), (4, header([(0, 255), (last, 1)])), (5, header([(0, 0)])), (6, header(padding=7)),
        (7, header(size=0x7C8)), (8, header(size=0x7C7)), (9, b""), (10, None), (11, header([(1, 99)])), (11, header([(31, 0)])), (None, header([(2, 98)])), (12, header([(centre, 255)])),
    ]
    df = spark.createDataFrame([(k, None if h is None else bytearray(h)) for k, h in rows], "frame_id long, header binary")
    got = [tuple(r) for r in raw.lsc_slots(df).select("frame_id", "illum", "ch", "gy", "gx", "shading").collect()]
    want = [r for k, h in rows for r in parsed(k, h)]
    assert sorted(got, key=repr) == sorted(want, key=repr) and len(want) == 6 * 504


def test_tables_are_parsed_where_they_are_read(spark):
    df = spark.createDataFrame([(1, bytearray(header()))], "frame_id long, header binary")
    plan = raw.lsc_slots(df)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" in plan and "Exchange" not in plan and "Join" not in plan


def generated(plan):
    """Rows that the Generate nodes of a plan have made."""
    own = plan.metrics().apply("numOutputRows").value() if plan.nodeName() == "Generate" else 0
    return own + sum(generated(plan.children().apply(k)) for k in range(plan.children().size()))


def test_lsc_parse_makes_cells_of_tables_not_of_frames(spark, sf_dir):
    """All good frames of the bridge have one table: 8 slots and 504 cells, however many frames there are."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = queries.lsc_parse(spark, sf_dir)
        assert len(df.collect()) == 504
        assert generated(df._jdf.queryExecution().executedPlan()) == 8 + 504
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_tables_that_differ_are_all_counted(spark, monkeypatch):
    rows = [(k, bytearray(header([(0, k % 50 + 1), (31, 128 if k % 4 else 127)]))) for k in range(200)]
    df = spark.createDataFrame(rows, "frame_id long, header binary")
    monkeypatch.setattr(queries, "headers", lambda *_: df)
    got = {(r["illum"], r["ch"], r["gy"], r["gx"]): (r["frames"], r["shading"]) for r in queries.lsc_parse(spark, "").collect()}
    assert len(got) == 504 and {n for n, _ in got.values()} == {150}
    assert got["A", 0, 0, 0] == (150, 50 / 128) and got["B", 3, 6, 8] == (150, GOOD[-1] / 128)
