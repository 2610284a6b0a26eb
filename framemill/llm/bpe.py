"""Byte-pair encoding with a segment tree over the ranks of adjacent pairs.

A piece of text is a row of symbols.  Leaf i of the tree holds the rank of the
merge of symbol i with its right neighbour, or infinity; every inner node the
smallest of its two children, the left one on a tie.  So the root names the
leftmost merge of the lowest rank.  Applying it changes three leaves, each
carried to the root in logarithmic time, until the root is infinite.

Pieces come from the library's own normalizer and pre-tokenizer, so they are cut
as it cuts them.  Equal stretches of text are encoded once per worker and
remembered in a table of bounded size.  Texts are decoded from their ids.

Defined cases: a null or empty text has no tokens and decodes to the empty text;
texts of any length are encoded whole, a single huge piece in n log n steps;
repeated rows and null ids are kept as rows.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from . import kernel

#: Stretches that are remembered, emptied when full, and the characters of the longest of them; bytes of text that are encoded at once.
CACHE = 400_000
LONGEST = 200
STEP = 1 << 20
#: Symbols of the longest pieces that are merged together with others.
MOST_TOGETHER = 32
_SPACE = re.compile(r"\s")
_NONE = 1 << 62


class Merges:
    """Merge rules by pair of symbol ids: the rank times 2**32, and by rank what a merge gives; the same as sorted arrays."""

    def __init__(self, pairs: list[tuple[int, int, int]]):
        self.ranks: dict[int, int] = {}
        self.made = [made for _, _, made in pairs]
        for rank, (a, b, _) in enumerate(pairs):
            self.ranks.setdefault(a << 32 | b, rank << 32)
        self.pairs = np.array(sorted(self.ranks), np.int64)
        self.by_pair = np.array([self.ranks[k] for k in self.pairs.tolist()], np.int64)
        self.gives = np.array(self.made, np.int64)

    def look(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The ranks of pairs, _NONE where there is no rule or a symbol is missing (-1)."""
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where((self.pairs[at] == key) & (a >= 0) & (b >= 0), self.by_pair[at], _NONE)


def merge(symbols: list[int], rules: Merges) -> list[int]:
    """symbols after all merges, the leftmost of the lowest rank first.

    tree[size + i] is rank << 32 | i for the pair that begins at place i, so the
    smaller of two nodes is the lower rank and then the place further left.
    """
    n = len(symbols)
    if n < 2:
        return symbols
    rank, made, s = rules.ranks.get, rules.made, list(symbols)
    leaves = [rank(a << 32 | b, _NONE) + i for i, (a, b) in enumerate(zip(s, s[1:], strict=False))]
    if n == 2:
        return s if leaves[0] >= _NONE else [made[leaves[0] >> 32]]
    size = 1 << (n - 2).bit_length()
    tree = [_NONE] * size + leaves + [_NONE] * (size - n + 1)
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while (low := tree[1]) < _NONE:
        i = low & 0xFFFFFFFF
        gone = after[i]
        new = s[i] = made[low >> 32]
        s[gone] = -1
        right = after[i] = after[gone]
        left = before[i]
        changed = []
        if right < n:
            before[right] = i
            changed.append((gone, _NONE))
            changed.append((i, rank(new << 32 | s[right], _NONE) + i))
        else:
            changed.append((i, _NONE))
        if left >= 0:
            changed.append((left, rank(s[left] << 32 | new, _NONE) + left))
        for place, key in changed:
            j = size + place
            tree[j] = key
            while j > 1:
                other = tree[j ^ 1]
                if other < key:
                    key = other
                j >>= 1
                if tree[j] == key:
                    break
                tree[j] = key
    return [x for x in s if x >= 0]


def merge_rows(rows: np.ndarray, rules: Merges) -> np.ndarray:
    """The same for many pieces at once: a row of symbols each, filled with -1; what is merged away becomes -1.

    Every row has a segment tree of its own, in a row of one array, and all rows
    that still have a merge make theirs together.
    """
    m, size = rows.shape  # size is a power of two
    s, length = rows.copy(), (rows >= 0).sum(1)
    tree = np.full((m, 2 * size), _NONE, np.int64)
    tree[:, size : 2 * size - 1] = rules.look(s[:, :-1], s[:, 1:]) + np.arange(size - 1)
    for i in range(size - 1, 0, -1):
        np.minimum(tree[:, 2 * i], tree[:, 2 * i + 1], out=tree[:, i])
    after, before = (np.tile(np.arange(size) + d, (m, 1)) for d in (1, -1))
    live = np.flatnonzero(tree[:, 1] < _NONE)
    while len(live):
        low = tree[live, 1]
        i = low & 0xFFFFFFFF
        gone = after[live, i]
        new = rules.gives[low >> 32]
        s[live, i], s[live, gone] = new, -1
        right, left = after[live, gone], before[live, i]
        after[live, i] = right
        some = right < length[live]
        before[live[some], right[some]] = i[some]
        tree[live, size + gone] = _NONE
        tree[live, size + i] = rules.look(new, np.where(some, s[live, np.minimum(right, size - 1)], -1)) + i
        # Without a left neighbour its own place is carried up twice.
        has = left >= 0
        tree[live[has], size + left[has]] = rules.look(s[live[has], left[has]], new[has]) + left[has]
        for place in (gone, i, np.where(has, left, i)):
            j = (size + place) >> 1
            while j[0]:
                tree[live, j] = np.minimum(tree[live, 2 * j], tree[live, 2 * j + 1])
                j >>= 1
        live = live[tree[live, 1] < _NONE]
    return s


class Codec:
    """Encoder and decoder for a tokenizer file of the word-end kind.

    The library's own normalizer and pre-tokenizer cut a text into pieces; the
    merges are made here.  Both work within stretches between spaces: no piece
    holds one, and neither composition nor lower-casing looks across one.
    """

    def __init__(self, spec: bytes, cache: int = CACHE):
        from tokenizers import Tokenizer

        facts, self.library = json.loads(spec), Tokenizer.from_str(spec.decode())
        model = facts["model"]
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in facts["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        names: list[str | None] = [None] * size
        for token, i in (vocab | self.special).items():
            names[i] = token
        self.tokens = pa.array(names, pa.string())
        pairs = [p if isinstance(p, list) else p.split(" ") for p in model["merges"]]
        self.rules = Merges([(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs])
        end = model["end_of_word_suffix"] or ""
        self.inner, self.last = vocab, {t.removesuffix(end): i for t, i in vocab.items() if t.endswith(end)} if end else vocab
        # The characters that stand for bytes have low code points.
        self.inner_of, self.last_of = (np.array([by.get(chr(k), -1) for k in range(512)], np.int64) for by in (self.inner, self.last))
        # Two special tokens that begin at one place: the longer one counts.
        self.specials = re.compile("|".join(sorted(map(re.escape, self.special), key=len, reverse=True))) if self.special else None
        self.cache, self.known = cache, {"": b""}  # empty where spaces meet

    def piece(self, shown: str) -> list[int]:
        """ids of one piece, given in the printable characters that stand for its bytes."""
        return merge([*(self.inner[c] for c in shown[:-1]), self.last[shown[-1]]], self.rules)

    def stretch(self, text: str) -> bytes:
        """ids of a text as little-endian 32-bit integers, without the table of known stretches."""
        ids: list[int] = []
        at = 0
        for m in [*(self.specials.finditer(text) if self.specials else ()), None]:
            plain = self.library.normalizer.normalize_str(text[at : m.start() if m else len(text)])
            for shown, _ in self.library.pre_tokenizer.pre_tokenize_str(plain):
                ids += self.piece(shown)
            if m:
                ids.append(self.special[m[0]])
                at = m.end()
        return np.asarray(ids, "<u4").tobytes()

    def pieces(self, shown: list[str]) -> list[bytes]:
        """ids of different pieces as little-endian 32-bit integers, merged together by size."""
        length = np.array(list(map(len, shown)), np.int64)
        flat = np.frombuffer("".join(shown).encode("utf-32-le"), "<u4")
        end = np.cumsum(length)
        symbols = self.inner_of[flat]
        symbols[end - 1] = self.last_of[flat[end - 1]]
        out: list[bytes] = [b""] * len(shown)
        size = 2
        while size <= MOST_TOGETHER:
            mine = np.flatnonzero((length <= size) & (length > (size // 2 if size > 2 else 0)))
            for at in range(0, len(mine), 16384):
                some = mine[at : at + 16384]
                place = np.arange(size)[None, :]
                rows = np.where(place < length[some, None], symbols[np.minimum((end - length)[some, None] + place, len(symbols) - 1)], -1)
                merged = merge_rows(rows, self.rules)
                ids = merged[merged >= 0].astype("<u4").tobytes()
                ends = (np.cumsum((merged >= 0).sum(1)) * 4).tolist()
                for k, a, b in zip(some.tolist(), [0, *ends[:-1]], ends, strict=True):
                    out[k] = ids[a:b]
            size *= 2
        for k in np.flatnonzero(length > MOST_TOGETHER).tolist():
            out[k] = array("I", self.piece(shown[k])).tobytes()
        return out

    def learn(self, new: list[str]) -> dict[str, bytes]:
        """ids of stretches.  Those without white space and special tokens are cut in one call, laid between spaces."""
        plain = [p for p in new if not (_SPACE.search(p) or (self.specials and self.specials.search(p)))]
        out = {}
        if plain:
            text = self.library.normalizer.normalize_str(" ".join(plain))
            ends = list(itertools.accumulate(len(p) + 1 for p in text.split(" ")))
            if len(ends) == len(plain):
                cut = self.library.pre_tokenizer.pre_tokenize_str(text)
                shown = list(dict.fromkeys(p for p, _ in cut))
                ids = dict(zip(shown, self.pieces(shown), strict=True)) if shown else {}
                at, n = 0, len(cut)
                for p, end in zip(plain, ends, strict=True):
                    begin = at
                    while at < n and cut[at][1][0] < end:
                        at += 1
                    out[p] = b"".join([ids[c[0]] for c in cut[begin:at]])
        return out | {p: self.stretch(p) for p in new if p not in out}

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """ids of each text as little-endian 32-bit integers."""
        split = [(t or "").replace("\n", " ").split(" ") for t in texts]  # both are white space, which no piece holds
        if len(self.known) > self.cache:
            self.known = {"": b""}
        learnt = self.learn([p for p in set().union(*split) if p not in self.known])
        self.known.update((p, i) for p, i in learnt.items() if len(p) <= LONGEST)
        far = {p: i for p, i in learnt.items() if len(p) > LONGEST}
        get = self.known.get
        return [b"".join([far[p] if (i := get(p)) is None else i for p in parts]) for parts in split]

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """The tokens of each list of ids, joined by spaces."""
        flat = self.tokens.take(ids.values.slice(ids.offsets[0].as_py(), ids.offsets[-1].as_py() - ids.offsets[0].as_py()))
        return pc.binary_join(pa.ListArray.from_arrays(pc.subtract(ids.offsets, ids.offsets[0]), flat), " ")


@lru_cache(maxsize=2)
def codec(spec: bytes) -> Codec:
    return Codec(spec)


def encode_decode(docs: DataFrame, path: str, text: str = "text", digests: bool = False) -> DataFrame:
    """docs with ``n_tokens`` and either ``ids`` (array<int>) and ``decoded``, or the SHA-256 digests of both.

    Columns of docs that bear these names are replaced; text itself is kept unless digests are asked for.
    """
    new = ["n_tokens", "ids_sha256", "decoded_sha256"] if digests else ["n_tokens", "ids", "decoded"]
    keep = [c for c in docs.columns if c not in new and not (digests and c == text)]
    kinds = ["long", "string", "string"] if digests else ["long", ArrayType(IntegerType()), "string"]
    schema = docs.select(*keep).schema
    for name, kind in zip(new, kinds, strict=True):
        schema = schema.add(name, kind)

    spec = docs.sparkSession.sparkContext.broadcast(Path(path).read_bytes())  # a few MB; the workers need not have the file

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(spec.value)
        for batch in batches:
            for lo, hi, _, _ in kernel.chunks(batch.column(0), STEP):
                part = batch.slice(lo, hi - lo)
                coded = coder.encode(part.column(0).to_pylist())
                ends = np.cumsum([0] + [len(c) // 4 for c in coded])
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(coded), "<i4"), pa.int32()))
                decoded = coder.decode(ids)
                made = [pa.array(np.diff(ends), pa.int64()), ids, decoded]
                if digests:
                    made[1:] = [pa.array([hashlib.sha256(c).hexdigest() for c in coded], pa.string()), pa.array([hashlib.sha256(t.as_buffer()).hexdigest() for t in decoded.cast(pa.binary())], pa.string())]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], *made], names=[*keep, *new])

    return docs.select(F.col(f"`{text}`").alias("_text"), *[F.col(f"`{c}`") for c in keep]).mapInArrow(work, schema)
