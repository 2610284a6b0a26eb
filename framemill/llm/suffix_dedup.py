"""Substring deduplication over byte strings by a distributed sort of suffixes.

The suffixes that are sorted begin at anchors (see repeats): every window of
``length`` bytes owns one, so a window is the bytes to the left of its anchor's
suffix and leading bytes of that suffix.  It repeats if another suffix agrees
with its own for the one and to the left for the other.

1.  Splitters that Spark samples range-partition the suffixes by their leading
    bytes, so a bucket is a stretch of the sorted order, however many suffixes
    begin alike.  A bucket is sorted by multikey quicksort over tokens of eight
    bytes; common prefixes of neighbours cut it into groups for every length, and
    the bytes to the left, sorted in the same way backwards, cut it again.
2.  A group at either end of a bucket may go on in the next.  Its suffixes are
    sorted once more, now by the bytes to the left backwards: what begins alike
    but differs there falls into place.
3.  A window that is at the end of a bucket in both orders is compared across the
    boundaries by a 128-bit digest; each bucket sends one for each different window.

Defined cases: a null text is empty; texts shorter than a window stay whole;
equal rows repeat each other; an empty table stays empty.  Other columns pass
through; those named like a result column are replaced.
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
from .kernel import U
from .repeats import CLASS, Kind, remove, spans_of
from .shared import materialise, spread

#: Bytes of a window and of an anchor.
LENGTH = 200
GRAM = 16
#: Bytes of content in a bucket, about.
BUCKET = 16 << 20
_SMALL = 24


def multikey_quicksort(keys: list[np.ndarray]) -> np.ndarray:
    """The order of rows of tokens: three-way partition by a token, then by the next where equal."""
    order = np.arange(len(keys[0]))
    todo = [(0, len(order), 0)]
    while todo:
        lo, hi, depth = todo.pop()
        if hi - lo < 2 or depth == len(keys):
            continue
        part = order[lo:hi]
        if hi - lo <= _SMALL:
            order[lo:hi] = part[np.lexsort([k[part] for k in reversed(keys[depth:])])]
            continue
        token = keys[depth][part]
        sample = np.sort(token[:: max(1, len(token) // 9)])
        pivot = sample[len(sample) // 2]
        less, more = token < pivot, token > pivot
        same = ~(less | more)
        a = lo + int(less.sum())
        b = a + int(same.sum())
        order[lo:a], order[a:b], order[b:hi] = part[less], part[same], part[more]
        todo += [(lo, a, depth), (a, b, depth + 1), (b, hi, depth)]
    return order


def strings(raw: np.ndarray, start: np.ndarray, size: np.ndarray, step: int, width: int) -> np.ndarray:
    """A row of width bytes for each string raw[start], raw[start + step], ..., of size bytes; zeros fill it."""
    out = np.zeros((len(start), width), np.uint8)
    for lo in range(0, len(start), 8192):
        s, n = start[lo : lo + 8192, None], size[lo : lo + 8192, None]
        k = np.arange(width)[None, :]
        out[lo : lo + 8192] = np.where(k < n, raw[s + step * np.minimum(k, np.maximum(n - 1, 0))], 0)
    return out


def tokens(rows: np.ndarray) -> list[np.ndarray]:
    """Columns of eight bytes as integers that sort like the bytes."""
    wide = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
    wide[:, : rows.shape[1]] = rows
    return list(np.ascontiguousarray(wide.view(">u8").T).astype(U))


def common(rows: np.ndarray) -> np.ndarray:
    """How many leading bytes each row shares with the one before; 0 for the first."""
    out = np.zeros(len(rows), np.int64)
    for lo in range(1, len(rows), 8192):
        differ = rows[lo : lo + 8192] != rows[lo - 1 : min(len(rows), lo + 8192) - 1]
        out[lo : lo + 8192] = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
    return out


def reach(shared: np.ndarray, width: int) -> np.ndarray:
    """The most leading bytes that each sorted row shares with the first or the last."""
    if not len(shared):
        return shared
    down = np.minimum.accumulate(np.append(width, shared[1:]))
    up = np.minimum.accumulate(np.append(shared[1:], width)[::-1])[::-1]
    return np.maximum(down, up)


class Bucket:
    """Suffixes that came to one task, in the order of their leading bytes and in that of the bytes to their left."""

    def __init__(self, batch: pa.RecordBatch, kind: Kind):
        self.kind, self.rest = kind, kind.length - kind.gram
        _, _, self.raw, off = next(kernel.chunks(batch.column("content"), 1 << 62))
        place = batch.column("place").to_numpy().astype(np.int64)
        right = strings(self.raw, off[:-1] + place, np.diff(off) - place, 1, kind.length)
        order = multikey_quicksort(tokens(right))
        self.batch = batch.take(pa.array(order))
        self.begin, self.size, self.place = off[:-1][order], np.diff(off)[order], place[order]
        self.n = batch.column("n").to_numpy()[order]
        self.right = common(right[order])
        self.right_reach = reach(self.right, kind.length)
        self.left_rows = strings(self.raw, self.begin + self.place - 1, self.place, -1, self.rest)
        self.by_left = multikey_quicksort(tokens(self.left_rows))
        self.left = common(self.left_rows[self.by_left])
        self.left_reach = np.zeros(len(order), np.int64)
        self.left_reach[self.by_left] = reach(self.left, self.rest)

    def has(self, a: int) -> np.ndarray:
        """Rows with a window that reaches a bytes to the left of the anchor."""
        return (self.place >= a) & (self.size - self.place >= self.kind.length - a)

    def windows(self, a: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows with a window that reaches a bytes to the left, the group of equal windows of each)."""
        rows = np.flatnonzero(self.has(a))
        left = np.empty(len(self.n), np.int64)
        left[self.by_left] = np.cumsum(self.left < a)
        both = np.cumsum(self.right < self.kind.length - a)[rows] * (len(self.n) + 1) + left[rows]
        return rows, pd.factorize(both)[0]

    def repeats(self) -> tuple[np.ndarray, pa.ListArray]:
        """(rows with windows that repeat in this bucket, their spans)."""
        counts = self.size - self.kind.length + 1
        start = np.cumsum(counts) - counts
        again = np.zeros(int(counts.sum()), bool)
        for a in range(self.rest + 1):
            rows, group = self.windows(a)
            if len(rows):
                on = rows[(np.bincount(group, weights=self.n[rows])[group] > 1) & (self.n[rows] == 1)]
                again[start[on] + self.place[on] - a] = True
        return spans_of(again, counts)

    def at_the_ends(self) -> list[tuple[bytes, int, int | None, int]]:
        """(digest, members, the row if it is alone, window) of the windows that may go on in other buckets in both orders."""
        out = []
        known = self.batch.column("reach").to_numpy()
        for a in range(self.rest + 1):
            rows, group = self.windows(a)
            on = (self.left_reach[rows] >= a) & (np.maximum(known, 0)[rows] >= self.kind.length - a)
            if not on.any():
                continue
            members = np.bincount(group, weights=self.n[rows]).astype(np.int64)
            for g, k in zip(*np.unique(group[on], return_index=True), strict=True):
                row = int(rows[on][k])
                at = int(self.begin[row] + self.place[row] - a)
                digest = blake2b(memoryview(self.raw[at : at + self.kind.length]), digest_size=16).digest()
                out.append((digest, int(members[g]), row if members[g] == 1 else None, int(self.place[row] - a)))
        return out


_ROW = "place int, anchor long, c1 long, c2 long, n long, content binary"
_FOUND = "anchor long, c1 long, c2 long, spans array<int>"


def _whole(batches: Iterator[pa.RecordBatch]) -> pa.RecordBatch | None:
    held = [b for b in batches if b.num_rows]
    return pa.concat_batches(held) if held else None


def _buckets(rows: DataFrame) -> int:
    size = rows.agg(F.sum(F.octet_length("content"))).first()[0] or 0
    return max(spread(rows.sparkSession), -(-size // BUCKET))


def _nulls(n: int, *kinds: pa.DataType) -> list[pa.Array]:
    return [pa.nulls(n, k) for k in kinds]


def compare(content: DataFrame, kind: Kind) -> DataFrame:
    """The windows of classes that repeat in another class of their anchor."""
    names = ("place", *CLASS, "n", "content")
    ints = pa.list_(pa.int32())

    def by_suffix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = _whole(batches)
        if whole is None:
            return
        bucket = Bucket(whole, kind)
        rows, spans = bucket.repeats()
        found = bucket.batch.take(pa.array(rows))
        cols = [found.column(c) for c in CLASS]
        yield pa.RecordBatch.from_arrays([*_nulls(len(rows), pa.int32()), *cols, *_nulls(len(rows), pa.int64(), pa.binary(), pa.binary(), pa.int32()), spans], names=[*names, "left", "reach", "spans"])
        ends = np.flatnonzero(bucket.right_reach >= kind.gram)
        if len(ends):
            open_rows = bucket.batch.take(pa.array(ends))
            size, take = bucket.place[ends], np.concatenate([[0], np.cumsum(bucket.place[ends])])
            flat = bucket.left_rows[ends][np.arange(bucket.rest)[None, :] < size[:, None]]
            left = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(take.astype(np.int32)), pa.py_buffer(flat)])
            cols = [open_rows.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*cols, left, pa.array(bucket.right_reach[ends].astype(np.int32)), *_nulls(len(ends), ints)], names=[*names, "left", "reach", "spans"])

    dealt = content.select(*names).withColumn("_r", F.substring(F.col("content"), F.col("place") + 1, F.lit(kind.length)))
    dealt = dealt.repartitionByRange(_buckets(content), "_r", "content").drop("_r")
    first, _ = materialise(dealt.mapInArrow(by_suffix, _ROW + ", left binary, reach int, spans array<int>"), "suffix-buckets")
    ends = first.filter("spans IS NULL").drop("spans")

    def by_left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = _whole(batches)
        if whole is None:
            return
        bucket = Bucket(whole, kind)
        rows, spans = bucket.repeats()
        found = bucket.batch.take(pa.array(rows))
        cols = [found.column(c) for c in CLASS]
        yield pa.RecordBatch.from_arrays([*cols, spans, *_nulls(len(rows), pa.binary(), pa.int64(), pa.int32())], names=[*CLASS, "spans", "digest", "members", "window"])
        sent = bucket.at_the_ends()
        if sent:
            digest, members, row, window = zip(*sent, strict=True)
            lone = bucket.batch.take(pa.array(row, pa.int64()))
            cols = [lone.column(c) for c in CLASS]
            yield pa.RecordBatch.from_arrays([*cols, *_nulls(len(sent), ints), pa.array(digest, pa.binary()), pa.array(members, pa.int64()), pa.array(window, pa.int32())], names=[*CLASS, "spans", "digest", "members", "window"])

    dealt = ends.repartitionByRange(_buckets(ends), "left", "content")
    second, _ = materialise(dealt.mapInArrow(by_left, _FOUND + ", digest binary, members long, window int"), "suffix-ends")
    # One row for each bucket and different window at an end.
    sent = second.filter("digest IS NOT NULL")
    again = sent.groupBy("digest").agg(F.sum("members").alias("_all"), F.collect_list(F.when(F.col("members") == 1, F.struct(*CLASS, "window"))).alias("_lone")).filter("_all > 1")
    across = again.select(F.explode("_lone").alias("_l")).select("_l.*").withColumn("spans", F.array("window", "window")).drop("window")
    out = first.filter("spans IS NOT NULL").select(*CLASS, "spans").unionByName(second.filter("spans IS NOT NULL").select(*CLASS, "spans"))
    return out.unionByName(across)


def dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, characters: bool = False) -> DataFrame:
    """docs without text, with n_bytes, n_removed, n_spans and kept (the bytes left; with characters, whole characters)."""
    return remove(docs.drop("n_bytes"), Kind(words=False, length=length, gram=gram), compare, characters).withColumnRenamed("n_units", "n_bytes")
