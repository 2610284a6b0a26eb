"""Array kernels over the raw bytes of many texts at once: words, rolling hashes, anchors of windows.

Units (words or bytes) have 64-bit values; that of a long word is a digest of its
bytes.  A polynomial over prefix sums gives the hash of any run of units in two
look-ups, without a loop over positions.  These hashes choose anchors and bring
candidates together; what is equal is decided on contents elsewhere.
Every window of ``length`` units owns one anchor: of the grams inside it the one
with the smallest hash, the rightmost on a tie.  That depends on the window's
content alone, so equal windows have equal anchors at equal places.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once, unless one text is longer.
CHUNK = 1 << 20

U = np.uint64
_BASE = U(0x9E3779B97F4A7C15)
_BYTE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def finish(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit of x over the result."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


class Powers:
    """Powers of the base and of its inverse modulo 2**64, grown as needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << n.bit_length()
            inverse = U(pow(int(_BASE), -1, 1 << 64))
            up, down = np.full(size, _BASE), np.full(size, inverse)
            up[0] = down[0] = 1
            self.up, self.down = np.cumprod(up, dtype=U), np.cumprod(down, dtype=U)
        return self.up, self.down


_POWERS = Powers()


class Rolling:
    """Hashes of runs of units."""

    def __init__(self, units: np.ndarray):
        n = len(units)
        up, self.down = _POWERS.get(n + 1)
        self.sums = np.zeros(n + 1, U)
        np.cumsum(units * up[:n], out=self.sums[1:])

    def run(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return finish((self.sums[end] - self.sums[start]) * self.down[start])

    def every(self, length: int) -> np.ndarray:
        """The hash of each run of length units, by its start."""
        n = len(self.sums) - length
        if n <= 0:
            return np.zeros(0, U)
        return finish((self.sums[length:] - self.sums[:n]) * self.down[:n])


def chunks(column: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of stretches of a string or binary column; nulls are empty."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(off, off[at] + size, side="right")) - 1)
        yield at, end, raw[off[at] : off[end]], off[at : end + 1] - off[at]
        at = end


def words(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, word offsets of the texts): words are runs of bytes outside SEPARATOR and end with their text."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    inside = ~SEPARATOR[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[off] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:-1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, off)


def joined(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, between: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(the bytes of all words, offsets); between: bytes after each word, which are spaces."""
    size = ends - starts + between
    at = np.concatenate([[0], np.cumsum(size)])
    where = np.repeat(starts - at[:-1], size) + np.arange(at[-1])
    if between:
        where[at[1:] - 1] = len(raw)
        raw = np.append(raw, np.uint8(32))
    return raw[where], at


#: Values of words that were met, so that a digest is taken once; longer words are not remembered.
_VALUES: dict[bytes, int] = {}
_REMEMBERED, _LONGEST = 100_000, 64


def _value(word: bytes) -> int:
    got = _VALUES.get(word)
    if got is None:
        got = int.from_bytes(blake2b(word, digest_size=8).digest(), "little")
        if len(word) <= _LONGEST:
            if len(_VALUES) >= _REMEMBERED:
                _VALUES.clear()
            _VALUES[word] = got
    return got


def word_codes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """(number of each word among the different ones, the different words): equal numbers are equal bytes."""
    flat, at = joined(raw, starts, ends)
    column = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(flat)])
    coded = column.dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary.to_pylist()


_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], U)


def word_values(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit values of words: of up to eight bytes, the bytes themselves, spread; of more, a digest."""
    size = ends - starts
    eight = np.ndarray(len(raw) + 1, "<u8", buffer=np.concatenate([raw, np.zeros(8, np.uint8)]), strides=(1,))
    short = np.minimum(size, 8)
    out = finish((eight[starts] & _MASKS[short]) ^ finish(short.astype(U) + U(1)))
    far = np.flatnonzero(size > 8)
    if len(far):
        codes, words = word_codes(raw, starts[far], ends[far])
        out[far] = np.array([_value(w) for w in words], U)[codes]
    return out


def byte_values(raw: np.ndarray) -> np.ndarray:
    return _BYTE[raw]


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Smallest of x[i : i + width], for each i that has so many."""
    done, step = x, 1
    while step * 2 <= width:
        done = np.minimum(done[:-step], done[step:])
        step *= 2
    if step < width:
        rest = width - step
        done = np.minimum(done[:-rest], done[rest:])
    return done


class Occurrences:
    """Runs of windows that own the same anchor.

    text: index of the text; first: start of the first window, from the text's
    start; count: windows of the run; anchor: hash of the anchor's gram; place: its
    start, in units from the run's first.
    """

    def __init__(self, units: np.ndarray, off: np.ndarray, length: int, gram: int):
        n, empty = len(units), np.zeros(0, np.int64)
        self.text = self.first = self.count = self.place = self.head = empty
        self.anchor = np.zeros(0, U)
        if n < length:
            return
        grams = Rolling(units).every(gram)
        bits = U(len(grams).bit_length())
        mask = (U(1) << bits) - U(1)
        keys = (grams & ~mask) | (mask - np.arange(len(grams), dtype=U))
        place = (mask - (sliding_min(keys, length - gram + 1) & mask)).astype(np.int64)  # by window start
        sizes = np.diff(off)
        text = np.repeat(np.arange(len(sizes)), sizes)[: len(place)]
        whole = np.arange(len(place)) + length <= off[1:][text]
        turn = np.ones(len(place), bool)
        turn[1:] = (place[1:] != place[:-1]) | (whole[1:] != whole[:-1]) | (text[1:] != text[:-1])
        heads = np.flatnonzero(turn)
        tails = np.append(heads[1:], len(place)) - 1
        keep = whole[heads]
        heads, tails = heads[keep], tails[keep]
        at = place[heads]
        self.text, self.head, self.place = text[heads], heads, at - heads
        self.first = heads - off[self.text]
        self.count = tails - heads + 1
        self.anchor = finish(grams[at] ^ U(0xA0761D6478BD642F))  # the smallest hashes, spread out again
