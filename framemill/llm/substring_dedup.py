"""Substring deduplication by seed and extend.

Seeds are winnowed anchors: in every window of ``length`` words the gram of the
smallest hash.  Occurrences join on them.  All matches of a seed are extended
together, word by word to the left and to the right: after k words the
occurrences that still agree are one group.  A window that reaches a words to the
left of its seed repeats if another occurrence is in its group after a words to
the left and in its group after the rest to the right; matches that agree for
``length`` words in all are kept, overlapping ones merge into maximal repeats, and
their words are removed.  Words are compared by their bytes.

Seeds that are hot are made longer instead of meeting in one task: the windows of
an occurrence are halved by how far they reach to the left, and the words that all
windows of a half have in common are its longer seed.  Halves whose seeds are
still hot are halved again, down to single windows, which need no extension.

Defined cases: a null text has no words; texts with fewer words than a window
stay whole; equal rows repeat each other; an empty table stays empty.  Other
columns pass through; those named like a result column are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel
from .repeats import CLASS, Kind, hot_keys, remove, spans_of
from .shared import materialise

#: Words of a window and of an anchor.
LENGTH = 35
GRAM = 8
#: Occurrences that are extended at once, unless one seed has more.
STEP = 20000

_SEED = ("k1", "k2", "lo", "hi")


def word_table(content: pa.Array, place: np.ndarray, kind: Kind) -> np.ndarray:
    """A row for each content, a column for each word, -1 where there is none; every seed begins in column length - gram."""
    left, width = kind.length - kind.gram, 2 * kind.length - kind.gram
    table = np.full((len(content), width), -1, np.int64)
    _, _, raw, off = next(kernel.chunks(content, 1 << 62))
    starts, ends, at = kernel.words(raw, off)
    codes, _ = kernel.word_codes(raw, starts, ends)
    row = np.repeat(np.arange(len(content)), np.diff(at))
    table[row, np.arange(len(codes)) - at[row] + (left - place)[row]] = codes
    return table


def refined(group: np.ndarray, by: np.ndarray) -> np.ndarray:
    """The groups of rows that agree in both."""
    return pd.factorize(group * (int(by.max(initial=0)) + 2) + (by + 1))[0]


def extend(table: np.ndarray, group: np.ndarray, n: np.ndarray, lo: int, hi: int, kind: Kind) -> np.ndarray:
    """again[row, a - lo]: whether the window that reaches a words to the left of the seed occurs elsewhere, for lo <= a < hi.

    group: rows whose seeds share a name; it is refined by the words of the seed.
    """
    left = kind.length - kind.gram
    again = np.zeros((len(table), hi - lo), bool)
    for c in range(left - lo, left + kind.length - hi + 1):
        group = refined(group, table[:, c])
    live = np.flatnonzero(np.bincount(group, weights=n)[group] > n)  # the others match nothing
    if not len(live):
        return again
    table, group, n = table[live], group[live], n[live]
    to_left = [group]
    for a in range(lo, hi - 1):
        to_left.append(refined(to_left[-1], table[:, left - a - 1]))
    to_right = group
    for a in range(hi - 1, lo - 1, -1):
        first, last = left - a, left - a + kind.length - 1
        if a < hi - 1:
            to_right = refined(to_right, table[:, last])
        rows = np.flatnonzero((table[:, first] >= 0) & (table[:, last] >= 0))
        if len(rows):
            both = refined(to_left[a - lo][rows], to_right[rows])
            again[live[rows], a - lo] = np.bincount(both, weights=n[rows])[both] > 1
    return again


def _whole_seeds(batches: Iterator[pa.RecordBatch], step: int = STEP) -> Iterator[pa.RecordBatch]:
    """Batches sorted by seed, regrouped so that no seed is cut."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < step:
            continue
        whole = pa.concat_batches(held)
        seeds = np.stack([whole.column(c).to_numpy() for c in _SEED], 1)
        cut = int(np.flatnonzero(np.append(True, (seeds[1:] != seeds[:-1]).any(1)))[-1])
        if cut:
            yield whole.slice(0, cut)
        held = [whole.slice(cut)]
        rows = whole.num_rows - cut
    if held:
        yield pa.concat_batches(held)


def _extended(rows: DataFrame, kind: Kind) -> DataFrame:
    """CLASS, spans from rows (_SEED, place, CLASS, n, content), all rows of a seed in one task."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in _whole_seeds(batches):
            ranges = np.stack([whole.column(c).to_numpy() for c in ("lo", "hi")], 1)
            for lo, hi in np.unique(ranges, axis=0).tolist():
                block = whole.take(pa.array(np.flatnonzero((ranges[:, 0] == lo) & (ranges[:, 1] == hi))))
                n, place = block.column("n").to_numpy(), block.column("place").to_numpy().astype(np.int64)
                group = refined(pd.factorize(block.column("k1").to_numpy())[0], pd.factorize(block.column("k2").to_numpy())[0])
                again = extend(word_table(block.column("content"), place, kind), group, n, lo, hi, kind)
                again[n > 1] = False  # all windows of these are known to repeat
                reach = again[:, ::-1]  # in the order of the windows
                found, spans = spans_of(reach.reshape(-1), np.full(len(n), hi - lo))
                lead = np.repeat((place - hi + 1)[found], np.diff(spans.offsets.to_numpy()))
                spans = pa.ListArray.from_arrays(spans.offsets, pa.array(spans.values.to_numpy() + lead, pa.int32()))
                pick = pa.array(found)
                yield pa.RecordBatch.from_arrays([*(block.column(c).take(pick) for c in CLASS), spans], names=[*CLASS, "spans"])

    near = rows.select(*_SEED, "place", *CLASS, "n", "content").repartition("k1", "k2").sortWithinPartitions(*_SEED)
    return near.mapInArrow(work, "anchor long, c1 long, c2 long, spans array<int>")


def _halved(rows: DataFrame, kind: Kind) -> DataFrame:
    """The two halves of the windows of each row, under the words that each half has in common."""
    names = [*_SEED, "place", *CLASS, "n", "content"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            place, content = batch.column("place").to_numpy(), batch.column("content").to_pylist()
            lows, highs = batch.column("lo").to_numpy(), batch.column("hi").to_numpy()
            for half in (0, 1):
                out: list[tuple[int, bytes, int, int]] = []
                for i, (p, text, lo, hi) in enumerate(zip(place.tolist(), content, lows.tolist(), highs.tolist(), strict=True)):
                    mid = (lo + hi) // 2
                    a, b = (lo, mid) if half == 0 else (mid, hi)
                    words = text.split(b" ")
                    # Unless the occurrence has no window of this half; one that has holds the common words too.
                    if max(a, p + kind.length - len(words)) < min(b, p + 1):
                        core = b" ".join(words[p - a : p - b + 1 + kind.length])
                        out.append((i, blake2b(core, digest_size=16).digest(), a, b))
                if not out:
                    continue
                pick, digests, a, b = zip(*out, strict=True)
                pair = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                rest = batch.take(pa.array(pick))
                cols = [pa.array(pair[:, 0]), pa.array(pair[:, 1]), pa.array(a, pa.int32()), pa.array(b, pa.int32())]
                yield pa.RecordBatch.from_arrays([*cols, *(rest.column(c) for c in names[4:])], names=names)

    return rows.select(*names).mapInArrow(work, "k1 long, k2 long, lo int, hi int, place int, anchor long, c1 long, c2 long, n long, content binary")


def compare(content: DataFrame, kind: Kind) -> DataFrame:
    """The windows of classes that repeat in another class of their anchor."""
    spark = content.sparkSession
    seeds = content.select(F.col("anchor").alias("k1"), F.lit(0).cast("long").alias("k2"), F.lit(0).alias("lo"), F.lit(kind.length - kind.gram + 1).alias("hi"), "place", *CLASS, "n", "content", "hot")
    out = _extended(seeds.filter("NOT hot"), kind)
    rest = seeds.filter("hot").drop("hot")
    while not rest.isEmpty():
        halves, _ = materialise(_halved(rest, kind), "seed-halves")
        counted = halves.groupBy(*_SEED).agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("_all"))
        still = spark.createDataFrame(hot_keys(counted, *_SEED), "k1 long, k2 long, lo int, hi int")
        hot = halves.join(F.broadcast(still), list(_SEED), "left_semi")  # fewer than SHARE rows
        out = out.unionByName(_extended(halves.join(F.broadcast(still), list(_SEED), "left_anti"), kind))
        # A single window under its own words: what is hot has company.
        alone = hot.filter("hi = lo + 1 AND n = 1").select(*CLASS, F.array(F.col("place") - F.col("lo"), F.col("place") - F.col("lo")).alias("spans"))
        out = out.unionByName(alone)
        rest = hot.filter("hi > lo + 1")
    return out


def dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """docs without text, with n_words, n_removed, n_spans and kept (the words left, joined by one space, UTF-8)."""
    return remove(docs.drop("n_words"), Kind(words=True, length=length, gram=gram), compare).withColumnRenamed("n_units", "n_words")
