"""Mixing sources to target weights (DataFrame functions only).

The mix is a schedule of slots.  Slot i owns the i-th point of the golden-ratio
sequence, taken in 32-bit integers, and the point falls into the cumulative
weight of one source; any run of slots therefore holds every source near its
weight.  The n-th slot of a source takes the n-th block of that source's stream:
its documents in hashed order, laid end to end and cut every ``block`` words.
A stream that is used up starts again.

Positions (of a word in its stream, of a slot among its source's slots) are
prefix sums in two levels: counts per (source, bucket) first, then windows
inside one bucket.  No task ever holds a source, however hot it is.  The only
one-task step is over the table of sources, one row each.  Sources, counts and the
schedule are written as small tables on the way: one plan of them all costs the driver
more memory than its parts, in threads of exchanges and in generated code.

Defined cases: a null text has size 0 and is never taken; the null source is a
source, the last one; sources of size 0 have target 0; repeated rows are
separate documents; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import SPACE, materialise, packed, settle, unpacked

#: Words in a block, words in a bucket of a source's stream about (there are LEAST_BUCKETS at least), slots that are ranked together.
BLOCK = 256
BUCKET = 1 << 22
LEAST_BUCKETS = 512
CHUNK = 4096
#: Weights by rank of the source, share of all words, most uses of a source; 2**32 / golden ratio.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
GOLDEN = 2654435769
SPAN = 1 << 32


def word_count(text: Column) -> Column:
    """Runs of [^\\x20\\x09-\\x0D] in text; 0 for null."""
    t = F.coalesce(text, F.lit(""))
    return F.size(F.array_remove(F.split(t, SPACE), "")).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size) -> also src (rank), weight, target.

    Water filling: with sources by most * size / weight, the first j stand at
    their limits and the rest share what is left by weight; j is the first for
    which nobody else is above.  One row a source, so one sorted window serves.
    """
    everything = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("src") % len(weights) + 1).cast("int"))
    s = sizes.withColumn("src", F.row_number().over(everything) - 1).withColumn("weight", w)
    s = s.withColumn("_limit", F.col("source_size") * float(most))
    by = Window.orderBy((F.col("_limit") / F.col("weight")).asc(), F.col("src"))
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    after = by.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy()
    s = s.withColumn("_total", F.sum("source_size").over(whole) * float(share))
    s = s.withColumn("_level", (F.col("_total") - F.coalesce(F.sum("_limit").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    # The level that holds is that of the first source whose limit is not below its share.
    s = s.withColumn("_lambda", F.min(F.when(F.col("_level") * F.col("weight") <= F.col("_limit"), F.struct(F.col("_limit") / F.col("weight"), "src", "_level"))).over(whole)["_level"])
    target = F.least(F.col("_limit"), F.coalesce(F.col("_lambda") * F.col("weight"), F.col("_limit")))
    return s.withColumn("target", target.cast("double")).drop("_limit", "_total", "_level", "_lambda")


def streams(docs: DataFrame, sources: DataFrame, seed: str = "mix") -> DataFrame:
    """docs (doc_id, size, source, _text, ...) with src, source_size, target and ``start``: the place of the first word in the source's stream.

    Buckets are ranges of the hash that orders the stream, so their number changes no place.
    """
    buckets = max(LEAST_BUCKETS, -(-(sources.agg(F.sum("source_size")).first()[0] or 0) // BUCKET))
    key = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    d = docs.join(sources.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    d = d.withColumn("_key", key).withColumn("_bucket", (F.conv(F.substring("_key", 1, 8), 16, 10).cast("long") * buckets / SPAN).cast("int"))
    sums = d.groupBy("src", "_bucket").agg(F.sum("size").alias("_n"))
    earlier = Window.partitionBy("src").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums, _ = materialise(sums.select("src", "_bucket", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base")), "mix-buckets")
    inside = Window.partitionBy("src", "_bucket").orderBy("_key", "doc_id", "size", "_text").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("_inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return d.join(sums, ["src", "_bucket"]).withColumn("start", F.col("_base") + F.col("_inside")).drop("_base", "_inside", "_bucket", "_key", "_text")


def schedule(sources: DataFrame, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """(slot, src, block, epoch, take): take is how many words of the block the slot takes.

    The low-discrepancy part has as many slots as blocks are needed in all; what
    a source then lacks to its target (a few blocks) follows at the end, and what
    it has beyond its target takes nothing.
    """
    spark = sources.sparkSession
    s = sources.filter("target >= 1").withColumn("_goal", F.floor("target"))
    s = s.withColumn("_blocks", F.ceil(F.col("source_size") / block)).withColumn("_rounds", F.floor(F.col("_goal") / F.col("source_size")))
    s = s.withColumn("_need", F.col("_rounds") * F.col("_blocks") + F.ceil((F.col("_goal") - F.col("_rounds") * F.col("source_size")) / block))
    by = Window.orderBy("src")
    whole = Window.partitionBy()
    s = s.withColumn("_high", F.sum("_need").over(by.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_all", F.sum("_need").over(whole))
    # 32-bit points: source src owns [_from, _to).
    s = s.withColumn("_to", F.floor(F.col("_high") / F.col("_all") * SPAN)).withColumn("_from", F.floor((F.col("_high") - F.col("_need")) / F.col("_all") * SPAN))
    s, _ = materialise(s.withColumn("_cells", F.count(F.lit(1)).over(whole) * 16), "mix-goals")
    cell = lambda x: F.floor(x * F.col("_cells") / SPAN)
    cells = s.withColumn("_cell", F.explode(F.sequence(cell(F.col("_from")), F.greatest(cell(F.col("_from")), cell(F.col("_to") - 1)))))
    total = s.agg(F.max("_all"), F.max("_cells")).first()
    slots, n_cells = int(total[0] or 0), int(total[1] or 16)
    point = (F.col("id") % (SPAN >> 1)) * GOLDEN % SPAN  # within 64 bits
    dealt = spark.range(slots).select(F.col("id").alias("slot"), point.alias("_point"), F.floor(point * n_cells / SPAN).alias("_cell"))
    plan = cells.select("src", "_cell", "_from", "_to")
    dealt = dealt.join(plan, "_cell").filter((F.col("_point") >= F.col("_from")) & (F.col("_point") < F.col("_to"))).select("slot", "src", F.floor(F.col("slot") / chunk).alias("_chunk"))
    counts = dealt.groupBy("src", "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("src").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts, _ = materialise(counts.withColumn("_base", F.coalesce(F.sum("_n").over(earlier), F.lit(0))), "mix-counts")
    base = counts.drop("_n")
    rank = F.row_number().over(Window.partitionBy("src", "_chunk").orderBy("slot")) - 1
    dealt = dealt.withColumn("_rank", rank).join(base, ["src", "_chunk"]).select("slot", "src", (F.col("_rank") + F.col("_base")).alias("_k"))
    have = counts.groupBy("src").agg(F.sum("_n").alias("_have"))
    rest = s.join(have, "src", "left").withColumn("_have", F.coalesce("_have", F.lit(0))).filter("_have < _need")
    rest = rest.select(F.lit(None).cast("long").alias("slot"), "src", F.explode(F.sequence("_have", F.col("_need") - 1)).alias("_k"))
    k = dealt.unionByName(rest).join(s.select("src", "source_size", "_goal", "_blocks"), "src")
    k = k.withColumn("epoch", F.floor(F.col("_k") / F.col("_blocks"))).withColumn("block", F.col("_k") % F.col("_blocks"))
    length = F.least(F.lit(block), F.col("source_size") - F.col("block") * block)
    filled = F.col("epoch") * F.col("source_size") + F.col("block") * block
    k = k.withColumn("take", F.least(length, F.col("_goal") - filled)).filter("take > 0")
    return k.select("slot", "src", "block", "epoch", "take")


def pieces(placed: DataFrame, slots: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row for each part of a document that a slot takes: the placed row, slot, epoch, ``first`` (its word in the document) and ``words``.

    A document of which nothing is taken keeps one row or more with null there.
    """
    last = F.floor((F.col("start") + F.col("size") - 1) / block)
    touched = F.when(F.col("size") > 0, F.sequence(F.floor(F.col("start") / block), last))
    p = placed.withColumn("block", F.explode_outer(touched)).join(slots, ["src", "block"], "left")
    lo = F.greatest("start", F.col("block") * block)
    hi = F.least(F.col("start") + F.col("size"), F.col("block") * block + F.col("take"))
    taken = F.col("take").isNotNull() & (hi > lo)
    return p.withColumn("first", F.when(taken, lo - F.col("start"))).withColumn("words", F.when(taken, hi - lo)).drop("take")


def place(docs: DataFrame, keep: tuple[str, ...] = (), block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """The placed documents (doc_id, size, source, keep, src, source_size, target, start) and the schedule."""
    d, _ = materialise(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("_text"), *keep), "mix-sizes")
    sources, _ = materialise(source_targets(d.groupBy("source").agg(F.sum("size").alias("source_size"))).repartition(1), "mix-sources")
    slots, _ = materialise(schedule(sources, block), "mix-slots")
    placed = streams(d, sources.drop("weight"))
    settle(d.sparkSession)
    return placed, slots


def mix(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """docs (doc_id, text, source) -> doc_id, source, size, source_size, target, taken for every row."""
    placed, slots = place(docs, block=block)
    by = ("src", "start", "doc_id", "source", "size", "source_size", "target")
    took = pieces(placed, slots, block).groupBy(*by).agg(F.sum("words").alias("taken"), F.count(F.lit(1)).alias("_rows"))
    # Documents with words differ in their places; equal rows without words have been counted.
    copies = F.when(F.col("size") > 0, F.lit(1)).otherwise(F.col("_rows"))
    took = took.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), copies)))
    return took.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The mix itself: a row for each use of a document, with the columns of docs and the words that the use takes as its text.

    A use that takes all words has the text as it was; another has its words
    joined by a space.  n_chars, if there is one, is that of the new text.  Rows are
    numbered in a table of their own, so equal rows are as far apart as others.
    """
    own = ("doc_id", "text", "source")
    named, _ = materialise(packed(docs, *own).withColumn("_id", F.monotonically_increasing_id()), "mix-rows")
    placed, slots = place(named, ("_id",), block)
    uses = pieces(placed, slots, block).filter("words > 0").groupBy("_id", "size", "epoch").agg(F.min("first").alias("first"), F.sum("words").alias("words"))
    taken = named.join(uses, "_id")
    words = F.slice(F.array_remove(F.split("text", SPACE), ""), (F.col("first") + 1).cast("int"), F.col("words").cast("int"))
    out = taken.withColumn("text", F.when(F.col("words") == F.col("size"), F.col("text")).otherwise(F.array_join(words, " ")))
    new = {}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return unpacked(out, docs.columns, *own, **new)
