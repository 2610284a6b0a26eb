"""JPEG blocks: colour, subsampling, transform, quantisation, runs and bit packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.exprs import clamp, div
from .pointwise import ycc_luma


def quality_table(base: tuple[int, ...], quality: int) -> list[int]:
    q = min(100, max(1, quality))
    scale = 5000 // q if q < 50 else 200 - 2 * q
    return [min(255, max(1, (b * scale + 50) // 100)) for b in base]


def huffman(counts: tuple[int, ...], symbols: tuple[int, ...]) -> list[tuple[int, int, int]]:
    """(symbol, code, length) of canonical codes."""
    out, code, at = [], 0, 0
    for length, n in enumerate(counts, 1):
        for s in symbols[at : at + n]:
            out.append((s, code, length))
            code += 1
        at += n
        code <<= 1
    return out


#: The keys of a block in its plane, and in the scan: MCU row, MCU column, and 0..5 for four luma blocks, Cb and Cr.
BLOCK = ("frame_id", "block_y", "block_x")
MCU = ("frame_id", "my", "mx", "block")


def luma_blocks(rgb: DataFrame) -> DataFrame:
    """frame_id, block_y, block_x, u, w, c: shifted luma samples of 8 by 8 blocks."""
    return rgb.select("frame_id", div(F.col("y"), 8).alias("block_y"), div(F.col("x"), 8).alias("block_x"), (F.col("y") % 8).alias("u"), (F.col("x") % 8).alias("w"), ycc_luma().cast("int").alias("c"))


def chroma_420(rgb: DataFrame) -> DataFrame:
    """frame_id, cy, cx, cb, cr from the rounded means of 2 by 2 pixels."""
    mean = [F.shiftright(F.sum(c).cast("int") + 2, 2).alias(c) for c in "rgb"]
    m = rgb.groupBy("frame_id", div(F.col("y"), 2).alias("cy"), div(F.col("x"), 2).alias("cx")).agg(*mean)
    r, g, b = (F.col(c) for c in "rgb")
    cb = F.shiftright(r * -11059 + g * -21709 + b * 32768 + 8421376, 16)
    cr = F.shiftright(r * 32768 + g * -27439 + b * -5329 + 8421376, 16)
    return m.select("frame_id", "cy", "cx", *[(clamp(c, 0, 255) - 128).cast("int").alias(n) for n, c in (("cb", cb), ("cr", cr))])


def mcu_blocks(rgb: DataFrame, width: int, height: int) -> DataFrame:
    """frame_id, my, mx, block, u, w, c: the samples of MCUs of 16 by 16 pixels; the last row and column fill those that are not whole."""
    def filled(at: str, size: int) -> Column:
        last = F.when(F.col(at) == size - 1, -(-size // 16) * 16 - 1).otherwise(F.col(at))
        return F.explode(F.sequence(F.col(at), last))

    full = rgb.withColumn("y", filled("y", height)).withColumn("x", filled("x", width))
    block = div(F.col("y") % 16, 8) * 2 + div(F.col("x") % 16, 8)
    luma = full.select("frame_id", div(F.col("y"), 16).alias("my"), div(F.col("x"), 16).alias("mx"), block.alias("block"), (F.col("y") % 8).alias("u"), (F.col("x") % 8).alias("w"), ycc_luma().cast("int").alias("c"))
    two = F.explode(F.array(F.struct(F.lit(4).alias("block"), F.col("cb").alias("c")), F.struct(F.lit(5).alias("block"), F.col("cr").alias("c"))))
    chroma = chroma_420(full).withColumn("_s", two).select("frame_id", div(F.col("cy"), 8).alias("my"), div(F.col("cx"), 8).alias("mx"), "_s.block", (F.col("cy") % 8).alias("u"), (F.col("cx") % 8).alias("w"), "_s.c")
    return luma.unionByName(chroma)


def fdct_matrix() -> list[list[int]]:
    """The integer transform as 13-bit fixed-point weights: row k gives coefficient k of eight samples.

    The accurate integer method shares products between outputs; written out, each
    output is one weighted sum that is rounded once.
    """
    a, b, c = fixed.DCT_EVEN
    out = [[0] * 8 for _ in range(8)]
    z1, z2, z3, z4 = fixed.DCT_PAIRS
    own = dict(zip((4, 5, 6, 7), fixed.DCT_OWN, strict=True))
    pairs = {7: (4, z1, z3), 5: (5, z2, z4), 3: (6, z2, z3), 1: (7, z1, z4)}
    member = {z1: (4, 7), z2: (5, 6), z3: (4, 6), z4: (5, 7)}
    for n in range(8):
        sign = 1 if n < 4 else -1
        near = min(n, 7 - n)
        out[0][n] = 8192
        out[4][n] = 8192 * (1 if near in (0, 3) else -1)
        outer, inner = {0: (1, 0), 1: (0, 1), 2: (0, -1), 3: (-1, 0)}[near]
        out[2][n] = outer * (a + b) + inner * a
        out[6][n] = outer * a + inner * (a - c)
        diff = 7 - near  # which of the four differences the sample enters
        for k, (mine, p, q) in pairs.items():
            weight = fixed.DCT_SHARED + (own[mine] if diff == mine else 0)
            weight += sum(-z for z in (p, q) if diff in member[z])
            out[k][n] = sign * weight
    return out


def fdct(blocks: DataFrame, keys: tuple[str, ...] = BLOCK) -> DataFrame:
    """keys of a block, u, w, c: the integer transform of each block, scaled by 8.

    Separable: one aggregate over the samples of a block, whose 64 results leave
    it together, so a block is shuffled once.
    """
    weights = F.array(*[F.lit(w).cast("bigint") for row in fdct_matrix() for w in row])
    block = blocks.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("u", "w", "c"))), lambda s: s["c"].cast("bigint")).alias("s"))
    block = block.withColumn("m", weights)
    high, low = (lambda p: F.floor(p / 8).cast("int")), (lambda p: p % 8)
    eight, zero = F.sequence(F.lit(0), F.lit(7)), F.lit(0).cast("bigint")

    def pass_over(name: str, place: Callable[[Column, Column], Column], row: Callable[[Column], Column], shift: int) -> Column:
        one = lambda p: F.aggregate(eight, zero, lambda total, n: total + F.get(name, place(p, n)) * F.get("m", row(p) * 8 + n))
        # Its second use keeps the array a column of its own, not an expression inside the lambda.
        return F.transform(F.sequence(F.lit(0), F.size(name) - 1), lambda p: F.shiftright(one(p) + (1 << (shift - 1)), shift))

    block = block.withColumn("t", pass_over("s", lambda p, n: high(p) * 8 + n, low, 11))
    both = pass_over("t", lambda p, n: n * 8 + low(p), high, 15)
    out = block.select(*keys, F.posexplode(both).alias("p", "c"))
    return out.select(*keys, div(F.col("p"), 8).alias("u"), (F.col("p") % 8).alias("w"), F.col("c").cast("int").alias("c"))


def quantise(coefficients: DataFrame, table: list[int], chroma: list[int] | None = None, keys: tuple[str, ...] = BLOCK) -> DataFrame:
    """keys of a block, k, q: quantised in zigzag order, halves away from zero; blocks 4 and 5 of an MCU by the table of chroma."""
    spot = {place: k for k, place in enumerate(fixed.ZIGZAG)}
    place = F.col("u") * 8 + F.col("w")
    k = F.get(F.array(*[F.lit(spot[i]) for i in range(64)]), place)
    step = lambda t: F.get(F.array(*[F.lit(8 * s) for s in t]), place)
    d = step(table) if chroma is None else F.when(F.col("block") < 4, step(table)).otherwise(step(chroma))
    size = F.floor((F.abs("c") + F.floor(d / 2)) / d)
    return coefficients.select(*keys, k.alias("k"), (F.signum("c") * size).cast("int").alias("q"))


def dc_delta(quantised: DataFrame) -> DataFrame:
    """keys of a block in the scan, diff, size: differences of the first coefficients of a component in scan order, and their bit sizes.

    Differences inside a row of MCUs, and the last value of the row before:
    neither window holds a frame.
    """
    dc = quantised.filter("k = 0").select(*MCU, F.greatest(F.col("block") - 3, F.lit(0)).alias("_comp"), "q")
    last = dc.groupBy("frame_id", "_comp", "my").agg(F.max_by("q", F.struct("mx", "block")).alias("_end")).withColumn("my", F.col("my") + 1)
    inside = F.lag("q").over(Window.partitionBy("frame_id", "_comp", "my").orderBy("mx", "block"))
    d = dc.withColumn("_before", inside).join(last, ["frame_id", "_comp", "my"], "left")
    diff = F.col("q") - F.coalesce(F.col("_before"), F.col("_end"), F.lit(0))
    return d.select(*MCU, diff.cast("int").alias("diff"), bit_size(diff).alias("size"))


def bit_size(v: Column) -> Column:
    return F.when(v == 0, 0).otherwise(F.length(F.bin(F.abs(v).cast("bigint")))).cast("int")


def ac_runs(quantised: DataFrame, keys: tuple[str, ...] = BLOCK) -> DataFrame:
    """keys of a block, k, run, size, zrls, q: every coefficient that is not zero after the first; the end of a block has k 64."""
    w = Window.partitionBy(*keys).orderBy("k")
    ac = quantised.filter("k > 0 AND q <> 0")
    run = F.col("k") - F.coalesce(F.lag("k").over(w), F.lit(0)) - 1
    found = ac.withColumn("_run", run).select(*keys, "k", (F.col("_run") % 16).cast("int").alias("run"), bit_size(F.col("q")).alias("size"), div(F.col("_run"), 16).alias("zrls"), "q")
    ends = quantised.groupBy(*keys).agg(F.max(F.when((F.col("k") > 0) & (F.col("q") != 0), F.col("k"))).alias("_last")).filter("_last IS NULL OR _last < 63")
    zero = F.lit(0)
    return found.unionByName(ends.select(*keys, F.lit(64).alias("k"), *[zero.alias(c) for c in ("run", "size", "zrls", "q")]))


def scan_codes(quantised: DataFrame) -> DataFrame:
    """keys of a block in the scan, k, part, code, len: every code of the scan with its mantissa as one string of bits.

    A long run of zeros has parts of 16 zeros before its coefficient.  A symbol
    without a code is an error.
    """
    spark: SparkSession = quantised.sparkSession
    tables = ((0, 0, fixed.DC_LUMA), (0, 1, fixed.DC_CHROMA), (1, 0, fixed.AC_LUMA), (1, 1, fixed.AC_CHROMA))
    h = spark.createDataFrame([(ac, chroma, *row) for ac, chroma, t in tables for row in huffman(*t)], "_ac int, _chroma int, _symbol int, _c long, _n int")
    dc = dc_delta(quantised).select(*MCU, F.lit(0).alias("k"), F.lit(0).alias("part"), F.lit(0).alias("_ac"), F.col("size").alias("_symbol"), "size", F.col("diff").alias("v"))
    runs = ac_runs(quantised, MCU).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("zrls"))))
    zeros = F.col("part") < F.col("zrls")
    or_zero = lambda c: F.when(zeros, 0).otherwise(F.col(c))
    ac = runs.select(*MCU, "k", "part", F.lit(1).alias("_ac"), F.when(zeros, 0xF0).otherwise(F.col("run") * 16 + F.col("size")).alias("_symbol"), or_zero("size").alias("size"), or_zero("q").alias("v"))
    c = dc.unionByName(ac).withColumn("_chroma", (F.col("block") > 3).cast("int"))
    c = c.join(F.broadcast(h), ["_ac", "_chroma", "_symbol"], "left")  # 348 rows
    known = F.when(F.col("_n").isNull(), F.raise_error("a symbol without a Huffman code").cast("int")).otherwise(F.col("_n"))
    bits = F.when(F.col("v") < 0, F.col("v") + F.call_function("shiftleft", F.lit(1), F.col("size")) - 1).otherwise(F.col("v"))
    return c.select(*MCU, "k", "part", (F.call_function("shiftleft", F.col("_c"), F.col("size")) + bits).alias("code"), (known + F.col("size")).alias("len"))


def scan(codes: DataFrame) -> DataFrame:
    """frame_id, at, byte: the entropy-coded bytes of a scan, with a zero after each 255."""
    return stuff(bit_pack(codes.select("frame_id", F.col("my").alias("block_y"), F.struct("mx", "block", "k", "part").alias("block_x"), "code", "len")))


def stuff(data: DataFrame, piece: int = 4096) -> DataFrame:
    """frame_id, at, byte: a zero put in after each 255.

    A byte moves by the number of those before it: per piece first, then inside
    the piece.
    """
    full = (F.col("byte") == 255).cast("int")
    d = data.withColumn("_piece", F.floor(F.col("at") / piece))
    sums = d.groupBy("frame_id", "_piece").agg(F.sum(full).alias("_n"))
    before = Window.partitionBy("frame_id").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("frame_id", "_piece", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("frame_id", "_piece").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("_in", F.coalesce(F.sum(full).over(inside), F.lit(0))).join(base, ["frame_id", "_piece"])
    at = F.col("at") + F.col("_base") + F.col("_in")
    one = F.struct(at.alias("at"), F.col("byte"))
    put = F.when(F.col("byte") == 255, F.array(one, F.struct((at + 1).alias("at"), F.lit(0).alias("byte")))).otherwise(F.array(one))
    return d.select("frame_id", F.explode(put).alias("_b")).select("frame_id", "_b.*")


def bit_pack(codes: DataFrame) -> DataFrame:
    """frame_id, at, byte: the bits of all codes in block order, before stuffing; the last byte is filled with ones.

    The place of a code is the sum of the lengths before it: per row of blocks
    first, then inside the row.  A code touches few bytes and each byte is the
    union of what touches it.
    """
    sums = codes.groupBy("frame_id", "block_y").agg(F.sum("len").alias("_n"))
    before = Window.partitionBy("frame_id").orderBy("block_y").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("frame_id", "block_y", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("frame_id", "block_y").orderBy("block_x").rowsBetween(Window.unboundedPreceding, -1)
    c = codes.withColumn("_in", F.coalesce(F.sum("len").over(inside), F.lit(0))).join(base, ["frame_id", "block_y"])
    c = c.withColumn("off", F.col("_base") + F.col("_in")).select("frame_id", "off", "code", "len")
    end = sums.groupBy("frame_id").agg(F.sum("_n").alias("off")).withColumn("len", F.pmod(-F.col("off"), F.lit(8))).filter("len > 0")
    ones = end.select("frame_id", "off", (F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("len").cast("int")) - 1).alias("code"), F.col("len").cast("int").alias("len"))
    c = c.unionByName(ones).withColumn("at", F.explode(F.sequence(F.floor(F.col("off") / 8), F.floor((F.col("off") + F.col("len") - 1) / 8))))
    shift = (F.col("at") * 8 + 8 - F.col("off") - F.col("len")).cast("int")
    part = F.when(shift >= 0, F.call_function("shiftleft", F.col("code"), F.greatest(shift, F.lit(0)))).otherwise(F.call_function("shiftright", F.col("code"), F.greatest(-shift, F.lit(0))))
    return c.groupBy("frame_id", "at").agg(F.bit_or(part.bitwiseAND(F.lit(255))).cast("int").alias("byte"))
