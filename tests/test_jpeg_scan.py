"""The entropy-coded bytes of a scan against a serial encoder that goes MCU by MCU."""

import random

import pytest
from pyspark.sql import functions as F

from framemill.functions import fixed
from framemill.operators import jpeg
from framemill.plans import queries

M = jpeg.fdct_matrix()


def codes_of(table):
    return {s: format(c, f"0{n}b") for s, c, n in jpeg.huffman(*table)}


LUMA, CHROMA = (codes_of(fixed.DC_LUMA), codes_of(fixed.AC_LUMA)), (codes_of(fixed.DC_CHROMA), codes_of(fixed.AC_CHROMA))


def mantissa(v):
    n = abs(v).bit_length()
    return format(v if v > 0 else v + (1 << n) - 1, f"0{n}b") if n else ""


def quantised(samples, table):
    rows = [[(sum(M[k][n] * s[n] for n in range(8)) + 1024) >> 11 for k in range(8)] for s in samples]
    both = [[(sum(M[k][n] * rows[n][w] for n in range(8)) + 16384) >> 15 for w in range(8)] for k in range(8)]
    out = []
    for i in fixed.ZIGZAG:
        v, d = both[i // 8][i % 8], 8 * table[i]
        out.append((abs(v) + d // 2) // d * (1 if v >= 0 else -1))
    return out


def serial(at, width, height, quality):
    """(diffs by block of the scan, bits, bytes) of the picture at(y, x) -> (r, g, b)."""
    tables = [jpeg.quality_table(t, quality) for t in (fixed.LUMA_TABLE, fixed.CHROMA_TABLE)]
    edge = lambda y, x: at(min(y, height - 1), min(x, width - 1))
    luma = lambda p: ((19595 * p[0] + 38470 * p[1] + 7471 * p[2] + 32768) >> 16) - 128
    level = lambda v: min(255, max(0, (v + 32768 + (128 << 16)) >> 16)) - 128
    bits, before, diffs, zrls = [], [0, 0, 0], {}, 0
    for my in range(-(-height // 16)):
        for mx in range(-(-width // 16)):
            blocks = [[[luma(edge(my * 16 + a + u, mx * 16 + b + w)) for w in range(8)] for u in range(8)] for a in (0, 8) for b in (0, 8)]
            mean = [[[(sum(edge(my * 16 + 2 * u + a, mx * 16 + 2 * w + b)[c] for a in (0, 1) for b in (0, 1)) + 2) >> 2 for c in range(3)] for w in range(8)] for u in range(8)]
            blocks.append([[level(-11059 * r - 21709 * g + 32768 * b) for r, g, b in row] for row in mean])
            blocks.append([[level(32768 * r - 27439 * g - 5329 * b) for r, g, b in row] for row in mean])
            for n, samples in enumerate(blocks):
                dc, ac = LUMA if n < 4 else CHROMA
                zz, comp = quantised(samples, tables[n > 3]), max(0, n - 3)
                diff, before[comp] = zz[0] - before[comp], zz[0]
                diffs[my, mx, n] = diff
                bits.append(dc[abs(diff).bit_length()] + mantissa(diff))
                run = 0
                for v in zz[1:]:
                    if v == 0:
                        run += 1
                        continue
                    while run > 15:
                        bits.append(ac[0xF0])
                        run, zrls = run - 16, zrls + 1
                    bits.append(ac[run * 16 + abs(v).bit_length()] + mantissa(v))
                    run = 0
                if run:
                    bits.append(ac[0])
    line = "".join(bits)
    line += "1" * (-len(line) % 8)
    out = []
    for k in range(0, len(line), 8):
        out += [255, 0] if line[k : k + 8] == "1" * 8 else [int(line[k : k + 8], 2)]
    return diffs, zrls, out


def test_scan_like_a_serial_encoder(spark):
    """A picture whose last MCUs are not whole: noise, flat parts and fine checks."""
    rnd, width, height, quality = random.Random(3), 42, 37, 75
    kind = lambda y, x: (y // 16 + x // 16) % 3
    pick = [lambda y, x: [rnd.randrange(256) for _ in range(3)], lambda y, x: [200, 90, 10], lambda y, x: [128 + 9 * (-1) ** (x + y)] * 3]
    picture = {(y, x): pick[kind(y, x)](y, x) for y in range(height) for x in range(width)}
    rgb = spark.createDataFrame([(0, y, x, *p) for (y, x), p in picture.items()], "frame_id int, y int, x int, r int, g int, b int").repartition(4)
    diffs, zrls, want = serial(lambda y, x: picture[y, x], width, height, quality)
    assert zrls and 255 in want
    tables = [jpeg.quality_table(t, quality) for t in (fixed.LUMA_TABLE, fixed.CHROMA_TABLE)]
    q = jpeg.quantise(jpeg.fdct(jpeg.mcu_blocks(rgb, width, height), jpeg.MCU), *tables, jpeg.MCU).cache()
    assert {(r["my"], r["mx"], r["block"]): r["diff"] for r in jpeg.dc_delta(q).collect()} == diffs
    got = jpeg.scan(jpeg.scan_codes(q)).orderBy("at").collect()
    assert [r["at"] for r in got] == list(range(len(want))) and [r["byte"] for r in got] == want


@pytest.mark.parametrize("piece", [3, 4096])
def test_stuffing(spark, piece):
    data = [255, 255, 1, 0, 255, 7, 8, 255]
    df = spark.createDataFrame([(0, k, b) for k, b in enumerate(data)], "frame_id int, at long, byte int").repartition(3)
    want = [255, 0, 255, 0, 1, 0, 255, 0, 7, 8, 255, 0]
    assert [(r["at"], r["byte"]) for r in jpeg.stuff(df, piece).orderBy("at").collect()] == list(enumerate(want))


def test_queries_write_the_whole_scan(spark, sf_dir):
    rgb = queries._rgb8(spark, sf_dir).collect()
    picture = {(r["y"], r["x"]): (r["r"], r["g"], r["b"]) for r in rgb}
    diffs, _, want = serial(lambda y, x: picture[y, x], 128, max(y for y, _ in picture) + 1, 75)
    assert {(r["my"], r["mx"], r["block"]): r["diff"] for r in queries.dc_delta(spark, sf_dir).collect()} == diffs
    assert [r["byte"] for r in queries.bit_pack(spark, sf_dir).orderBy(F.col("at")).collect()] == want
