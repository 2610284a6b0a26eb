"""Bloom filters of 64-bit hashes, built by the executors and bounded in size.

They spare shuffles and never decide: what passes is compared exactly later.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import U, finish

#: Bits of a filter: so many for each value, within these powers of two (the largest is 32 MB).
PER_VALUE = 12
LEAST, MOST = 16, 28
SLICES = 16


def _places(values: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two bit places of each value, both in the slice that its high bits name."""
    part = bits - 4
    base = (values >> U(60)) << U(part)
    more = finish(values ^ U(0x5851F42D4C957F2D))
    mask = U((1 << part) - 1)
    return base | (values & mask), base | (more & mask)


def bloom(values: DataFrame, column: str, count: int) -> tuple[int, np.ndarray]:
    """(bits, filter) of a long column that has about count different values."""
    bits = min(MOST, max(LEAST, (max(1, count) * PER_VALUE - 1).bit_length()))
    size = 1 << (bits - 4 - 3)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, np.ndarray] = {}
        for batch in batches:
            v = batch.column(0).to_numpy(zero_copy_only=False).view(U)
            slices = (v >> U(60)).astype(np.int64)
            for s in np.unique(slices):
                field = made.setdefault(int(s), np.zeros(size * 8, bool))
                for p in _places(v[slices == s], bits):
                    field[(p & U(size * 8 - 1)).astype(np.int64)] = True
        rows = sorted(made)
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array([np.packbits(made[s]).tobytes() for s in rows], pa.binary())], names=["slice", "bits"])

    part = F.call_function("shiftrightunsigned", F.col(column), F.lit(60))
    got = values.select(column).repartition(SLICES, part).mapInArrow(build, "slice int, bits binary").collect()
    field = np.zeros(size * SLICES, np.uint8)
    for r in got:
        field[r["slice"] * size : (r["slice"] + 1) * size] |= np.frombuffer(r["bits"], np.uint8)
    return bits, field


def may_hold(made: tuple[int, np.ndarray], values: np.ndarray) -> np.ndarray:
    bits, field = made
    keep = np.ones(len(values), bool)
    for p in _places(values, bits):
        p = p.astype(np.int64)
        keep &= (field[p >> 3] >> (7 - (p & 7)).astype(np.uint8)) & 1 == 1
    return keep
