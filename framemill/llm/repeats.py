"""Where windows of units may occur more than once: anchors, occurrences and their classes.

Every window of ``length`` units owns an anchor, the gram of the smallest hash in
it (see kernel.Occurrences), and equal windows own equal anchors at equal places.
Consecutive windows with one anchor form an occurrence; its content is all their
units.

1.  Anchors are counted over the whole corpus.  What owns an anchor that is
    alone cannot repeat; a Bloom filter of the others thins the second pass.
2.  Occurrences of one anchor with equal contents, by a 128-bit digest, are one
    class.  All windows of a class with two members or more repeat.
3.  Classes of one member whose anchor has other classes are compared on their
    contents; how is up to the operator (substring_dedup, suffix_dedup).
4.  Occurrences take over the windows that repeat in their class.

Anchors that own more than 1 in ``SHARE`` occurrences are hot.  There are fewer
than ``SHARE`` of them, so their names fit anywhere; their occurrences carry a
salt, are counted per salt first, and get what their class learns per salt too.

A document is known by two 64-bit hashes of its id and text, so equal rows share
their spans and a null id is an id like others.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel
from .filters import bloom, may_hold
from .shared import forget, materialise, settle

#: A key with more than 1 in SHARE rows, and more than FLOOR, is hot; parts of a hot key.
SHARE = 1024
FLOOR = 64
PARTS = 64
CLASS = ("anchor", "c1", "c2")


@dataclass(frozen=True)
class Kind:
    """What is compared: ``words`` or bytes, windows of length units, anchors of gram units."""

    words: bool
    length: int
    gram: int

    def units(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(values of the units, their offsets by text, bytes, begin of each unit in the bytes); words are joined by one space."""
        if not self.words:
            return kernel.byte_values(raw), off, raw, np.arange(len(raw) + 1)
        starts, ends, word_off = kernel.words(raw, off)
        data, at = kernel.joined(raw, starts, ends, between=1)
        return kernel.word_values(raw, starts, ends), word_off, data, at

    def span(self, at: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(begin, end) in the bytes of the units from first to before end."""
        return at[first], at[end] - (1 if self.words else 0)


def keyed(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with _h and _g, which name the row by its id and text."""
    return docs.withColumn("_h", F.xxhash64("doc_id", text, F.lit(1))).withColumn("_g", F.xxhash64(text, F.lit(2), "doc_id"))


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def anchors(docs: DataFrame, kind: Kind) -> DataFrame:
    """(anchor, n): every anchor and its occurrences."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for _, _, raw, off in kernel.chunks(batch.column(0)):
                units, unit_off, _, _ = kind.units(raw, off)
                found.append(kernel.Occurrences(units, unit_off, kind.length, kind.gram).anchor)
            if found:
                values, counts = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([_long(values), pa.array(counts)], names=["anchor", "n"])

    return docs.select("text").mapInArrow(work, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))


def hot_keys(counted: DataFrame, *keys: str) -> list[tuple]:
    """The keys of counted (keys, n) that are hot: fewer than SHARE."""
    total = counted.agg(F.sum("n")).first()[0] or 0
    return [tuple(r) for r in counted.filter(F.col("n") > max(FLOOR, total // SHARE)).select(*keys).collect()]


def occurrences(docs: DataFrame, kind: Kind, sieve: tuple[int, np.ndarray], hot: np.ndarray) -> DataFrame:
    """Occurrences whose anchors pass the sieve: _h, _g, first, count, place, CLASS (c1 and c2 are the digest), salt (0 unless the anchor is hot)."""
    shared = docs.sparkSession.sparkContext.broadcast((sieve, np.sort(hot)))
    names = ("_h", "_g", "first", "count", "place", *CLASS, "salt")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sieve, hot = shared.value
        for batch in batches:
            h, g = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_h", "_g"))
            for lo, _, raw, off in kernel.chunks(batch.column("text")):
                units, unit_off, data, at = kind.units(raw, off)
                o = kernel.Occurrences(units, unit_off, kind.length, kind.gram)
                keep = may_hold(sieve, o.anchor)
                row, first, count, place, anchor = o.text[keep] + lo, o.first[keep], o.count[keep], o.place[keep], o.anchor[keep].view(np.int64)
                begin, end = kind.span(at, o.head[keep], o.head[keep] + count + kind.length - 1)
                held = memoryview(np.ascontiguousarray(data))
                shape = np.stack([place, count], 1).astype("<i8").tobytes()  # equal contents with anchors at other places are other classes
                digests = [blake2b(held[a:b], digest_size=16, salt=shape[k : k + 16]).digest() for k, a, b in zip(range(0, len(shape), 16), begin.tolist(), end.tolist(), strict=True)]
                pair = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                salt = np.where(np.isin(anchor, hot), 1 + (kernel.finish((h[row] + first).astype(np.int64).view(kernel.U)) % kernel.U(PARTS)).astype(np.int64), 0)
                cols = [h[row], g[row], first, count.astype(np.int32), place.astype(np.int32), anchor, pair[:, 0], pair[:, 1], salt.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=list(names))

    return docs.select("_h", "_g", "text").mapInArrow(work, "_h long, _g long, first long, count int, place int, anchor long, c1 long, c2 long, salt int")


def classes(found: DataFrame) -> tuple[DataFrame, DataFrame, str]:
    """((CLASS, n, rep, hot), (CLASS, salt) of the hot ones, scratch path): every class with a member that speaks for it."""
    each, path = materialise(found.groupBy(*CLASS, "salt").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("_h", "_g", "first", "count", "place")).alias("rep")), "repeat-classes")
    salted = each.filter("salt > 0")
    hot = salted.groupBy(*CLASS).agg(F.sum("n").alias("n"), F.min("rep").alias("rep"))  # at most PARTS rows a class
    cold = each.filter("salt = 0").drop("salt")
    return cold.withColumn("hot", F.lit(False)).unionByName(hot.withColumn("hot", F.lit(True))), salted.select(*CLASS, "salt"), path


def contents(docs: DataFrame, kind: Kind, wanted: DataFrame) -> DataFrame:
    """wanted (CLASS, n, rep, hot) with ``place`` and ``content``: the bytes of the class."""
    spark = docs.sparkSession
    fields = ("first", "count", "place", *CLASS, "n", "hot")
    per_doc = wanted.groupBy(F.col("rep._h").alias("_h"), F.col("rep._g").alias("_g")).agg(F.collect_list(F.struct(F.col("rep.first").alias("first"), F.col("rep.count").alias("count"), F.col("rep.place").alias("place"), *CLASS, "n", "hot")).alias("_runs"))
    per_doc, path = materialise(per_doc, "repeat-wanted")
    sieve = spark.sparkContext.broadcast(bloom(per_doc, "_h", per_doc.count()))

    def needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(may_hold(sieve.value, batch.column("_h").to_numpy().view(kernel.U))))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = batch.column("_runs")
            ends = runs.offsets.to_numpy()
            flat = {f: runs.values.field(f) for f in fields}
            for lo, hi, raw, off in kernel.chunks(batch.column("text")):
                _, unit_off, data, at = kind.units(raw, off)
                mine, n = int(ends[lo]), int(ends[hi] - ends[lo])
                first = flat["first"].slice(mine, n).to_numpy() + np.repeat(unit_off[:-1], np.diff(ends[lo : hi + 1]))
                begin, end = kind.span(at, first, first + flat["count"].slice(mine, n).to_numpy() + kind.length - 1)
                piece, take = kernel.joined(data, begin, end)
                made = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(take.astype(np.int32)), pa.py_buffer(piece)])
                yield pa.RecordBatch.from_arrays([*(flat[f].slice(mine, n) for f in fields[2:]), made], names=[*fields[2:], "content"])

    texts = docs.select("_h", "_g", "text").mapInArrow(needed, "_h long, _g long, text string")
    one = texts.join(per_doc, ["_h", "_g"]).dropDuplicates(["_h", "_g"])
    out, _ = materialise(one.select("text", "_runs").mapInArrow(work, "place int, anchor long, c1 long, c2 long, n long, hot boolean, content binary"), "repeat-contents")
    forget(spark, path)
    return out


def spans_of(again: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, pa.ListArray]:
    """(rows that have a repeated window, their spans): first and last window of each run, one after the other."""
    row = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(again)) - np.repeat(np.cumsum(counts) - counts, counts)
    on = np.flatnonzero(again)
    if not len(on):
        return on, pa.array([], pa.list_(pa.int32()))
    cut = np.ones(len(on), bool)
    cut[1:] = (on[1:] != on[:-1] + 1) | (row[on[1:]] != row[on[:-1]])
    heads = np.flatnonzero(cut)
    tails = np.append(heads[1:], len(on)) - 1
    flat = np.stack([place[on[heads]], place[on[tails]]], 1).reshape(-1).astype(np.int32)
    rows, n = np.unique(row[on[heads]], return_counts=True)
    ends = np.concatenate([[0], np.cumsum(2 * n)]).astype(np.int32)
    return rows, pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


#: Compares classes: contents (place, CLASS, n, hot, content) -> CLASS, spans; several rows of a class add up.
Compare = Callable[[DataFrame, Kind], DataFrame]


def repeated(docs: DataFrame, kind: Kind, compare: Compare) -> DataFrame:
    """(_h, _g, runs): for each keyed document with a repeated window the set of (first, count, spans).

    spans is null if all windows of the run repeat; otherwise pairs of first and
    last window, counted from the run's first.
    """
    spark = docs.sparkSession
    common, p1 = materialise(anchors(docs, kind).filter("n > 1"), "repeat-anchors")
    sieve = bloom(common, "anchor", common.count())
    hot = np.array([k for (k,) in hot_keys(common, "anchor")], np.int64)
    forget(spark, p1)
    found, _ = materialise(occurrences(docs, kind, sieve, hot), "repeat-found")
    each, salted, p2 = classes(found)
    # Whether an anchor has other classes: a hot one is taken to have, so that its classes need not meet.
    several = each.filter("NOT hot").groupBy("anchor").agg(F.count(F.lit(1)).alias("_k")).filter("_k > 1").select("anchor")
    wanted = each.filter("NOT hot").join(several, "anchor", "left_semi").unionByName(each.filter("hot"))
    settle(spark)
    content = contents(docs, kind, wanted)
    settle(spark)
    learnt = compare(content, kind).join(each.filter("hot").select(*CLASS, F.lit(True).alias("hot")), list(CLASS), "left") if len(hot) else compare(content, kind).withColumn("hot", F.lit(False))
    whole = each.filter("n > 1").select(*CLASS, F.lit(None).cast("array<int>").alias("spans"), "hot")
    marks, p3 = materialise(whole.unionByName(learnt.select(*CLASS, "spans", F.coalesce("hot", F.lit(False)).alias("hot"))), "repeat-marks")
    settle(spark)
    parted = marks.filter("NOT hot").select(*CLASS, F.lit(0).alias("salt"), "spans").unionByName(marks.filter("hot").join(salted, list(CLASS)).select(*CLASS, "salt", "spans"))
    runs = found.join(parted, [*CLASS, "salt"]).groupBy("_h", "_g").agg(F.collect_set(F.struct("first", "count", "spans")).alias("runs"))
    out, _ = materialise(runs, "repeat-runs")
    forget(spark, p2, p3)
    settle(spark)
    return out


def covered(runs: pa.ListArray, base: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end) of the maximal stretches that repeated windows cover; base: first unit of each text."""
    ends = runs.offsets.to_numpy().astype(np.int64)
    inner = runs.values.slice(int(ends[0]), int(ends[-1] - ends[0]))
    text = np.repeat(np.arange(len(runs)), np.diff(ends))
    first = inner.field("first").to_numpy(zero_copy_only=False) + base[text]
    count = inner.field("count").to_numpy(zero_copy_only=False).astype(np.int64)
    spans = inner.field("spans")
    whole = spans.is_null().to_numpy(zero_copy_only=False)
    span_ends = spans.offsets.to_numpy().astype(np.int64)
    pairs = spans.values.to_numpy(zero_copy_only=False)[span_ends[0] : span_ends[-1]].reshape(-1, 2).astype(np.int64)
    owner = np.repeat(np.arange(len(first)), np.diff(span_ends) // 2)
    owners = np.concatenate([np.flatnonzero(whole), owner])
    lo = np.concatenate([first[whole], first[owner] + pairs[:, 0]])
    hi = np.concatenate([first[whole] + count[whole] - 1, first[owner] + pairs[:, 1]]) + length
    order = np.argsort(lo, kind="stable")
    owners, lo, hi = owners[order], lo[order], np.maximum.accumulate(hi[order]) if len(hi) else hi
    new = np.ones(len(lo), bool)
    new[1:] = (lo[1:] > hi[:-1]) | (text[owners[1:]] != text[owners[:-1]])
    heads = np.flatnonzero(new)
    return text[owners[heads]], lo[heads], hi[np.append(heads[1:], len(lo)) - 1] if len(lo) else hi


def _left(raw: np.ndarray, units: np.ndarray, gone: np.ndarray, starts: np.ndarray | None, ends: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(bytes that stay, their offsets by text): units that are not gone, words with a space after each but a text's last."""
    stay = np.flatnonzero(~gone)
    kept = np.searchsorted(stay, units)
    if starts is None:
        return raw[stay], kept
    data, at = kernel.joined(raw, starts[stay], ends[stay], between=1)
    has = kept[1:] > kept[:-1]
    on = np.ones(len(data), bool)
    on[at[kept[1:][has]] - 1] = False
    return data[on], np.concatenate([[0], np.cumsum(at[kept[1:]] - at[kept[:-1]] - has)])


def remove(docs: DataFrame, kind: Kind, compare: Compare, characters: bool = False) -> DataFrame:
    """docs without text, with n_units, n_removed, n_spans and ``kept`` (binary): the units left, words joined by a space.

    With characters, bytes of a UTF-8 character that a stretch cuts go with it, so that kept stays text; the counts are unchanged.
    """
    new = ("n_units", "n_removed", "n_spans", "kept")
    own = docs.drop(*new)
    keep = [c for c in own.columns if c != "text"]
    schema = own.select(*[F.col(f"`{c}`") for c in keep]).schema
    # The other columns travel in one, so that their names cannot meet those used here.
    named = keyed(own.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_own")))
    runs = repeated(named.select("_h", "_g", "text"), kind, compare)
    for c in new[:3]:
        schema = schema.add(c, "long")
    schema = schema.add("kept", "binary")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, raw, off in kernel.chunks(batch.column("text")):
                starts, ends, units = kernel.words(raw, off) if kind.words else (None, None, off)
                part = batch.slice(lo, hi - lo)
                text, a, b = covered(part.column("runs"), units[:-1], kind.length)
                step = np.zeros(int(units[-1]) + 1, np.int32)
                np.add.at(step, a, 1)
                np.add.at(step, b, -1)
                gone = np.cumsum(step)[:-1] > 0
                if characters and len(raw):
                    of = np.cumsum((raw & 0xC0) != 0x80)
                    gone = (np.bincount(of, weights=gone) > 0)[of]
                left, at = _left(raw, units, gone, starts, ends)
                removed = np.bincount(text, weights=b - a, minlength=hi - lo).astype(np.int64)
                spans = np.bincount(text, minlength=hi - lo)
                kept = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(at.astype(np.int32).tobytes()), pa.py_buffer(left.tobytes())])
                yield pa.RecordBatch.from_arrays([*part.column("_own").flatten(), pa.array(np.diff(units)), pa.array(removed), pa.array(spans), kept], names=[*keep, *new])

    return named.join(runs, ["_h", "_g"], "left").select("_own", "text", "runs").mapInArrow(work, schema)
