"""Exact Jaccard join of documents on word shingles, as linked groups.

1.  Texts become sets of hashed shingles; equal sets become one node.  Shingles
    are counted in a sketch of fixed size, which orders them: rare ones first,
    frequent ones by their class.  Any order gives right results; a good one
    makes the lists below short.
2.  Two sets over the threshold share at least ``CLASSES + 1`` shingles of the
    prefixes that are extended by so many.  Rare shingles of a prefix are
    signatures by themselves.  Frequent ones fall into ``CLASSES`` classes by
    hash, and pairs of one class are signatures: among the shared shingles there
    is a rare one, or two frequent ones of one class.  Small sets use every
    shingle.
3.  Nodes that share a signature are a list; lists with the same members count
    once.  In a list the parity bitmaps of the sets bound their difference from
    below, and of the pairs that may link a spanning forest goes on, never all
    pairs.  Long lists are cut into parts of ``BLOCK`` members that have two
    members in common, so that a list of copies hangs together without its parts
    meeting.
4.  Forest links are verified on the words themselves.  A list all of whose links
    hold and whose members lie in one component is settled.  In the others, the
    members outside the list's largest component meet every part, and pairs across
    components that may link are verified too.
5.  Components over the verified links.

Shingles are named by hashes of digests of words; a link is one of equal words.

Defined cases: texts without words (or null) have an empty set and are linked
with nothing; fewer words than a shingle are one shingle; repeated rows share
their component; a null id is ignored for the smallest id of a component unless
it has no other; other columns pass through.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel
from .components import components
from .filters import bloom, may_hold
from .kernel import U, finish
from .repeats import hot_keys
from .shared import SALTS, forget, least_by, materialise, settle

WORDS = 4
PERCENT = 85
#: Cells of the sketch (a power of two) and of a slice of it; shingles seen this often or less are rare.
CELL_BITS = 24
SLICE_BITS = 18
RARE = 16
#: Classes of frequent shingles; sets up to SMALL use every shingle alone, from LEAST on the prefixes hold.
CLASSES = 8
SMALL = 12
LEAST = 10
#: Members of a list that meet in one task.
BLOCK = 512
_SPACES = re.compile("[\x20\x09-\x0d]+")
_LOWER = {c: c + 32 for c in range(65, 91)}
#: Signatures a worker holds before it hands them on.
HELD = 1 << 19
#: Keys a worker remembers, so that copies need not send what is known.
REMEMBERED = 1_000_000


def shingle_sets(column: pa.Array, words: int = WORDS) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of every text."""
    for lo, hi, raw, off in kernel.chunks(column):
        raw = kernel.LOWER[raw]
        starts, ends, at = kernel.words(raw, off)
        rolling = kernel.Rolling(kernel.word_values(raw, starts, ends))
        every = rolling.every(words)
        for i in range(hi - lo):
            a, b = int(at[i]), int(at[i + 1])
            if b - a >= words:
                yield lo + i, np.unique(every[a : b - words + 1])
            elif b > a:
                yield lo + i, finish(rolling.run(np.array([a]), np.array([b])) + U(b - a))
            else:
                yield lo + i, every[:0]


def key_of(found: np.ndarray) -> int:
    """A 64-bit name of a set."""
    return int.from_bytes(blake2b(found, digest_size=8).digest(), "little", signed=True)


def _nodes_and_sketch(docs: DataFrame, words: int) -> DataFrame:
    """Rows (doc_id, n, key) of the documents, and rows (slice, counts) of the sketch of each task."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = None
        kind = schema_of("doc_id")
        for batch in batches:
            n, keys = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for i, found in shingle_sets(batch.column("text"), words):
                n[i] = len(found)
                if len(found):
                    keys[i] = key_of(found)
                    sketch = np.zeros(1 << CELL_BITS, np.uint32) if sketch is None else sketch
                    np.add.at(sketch, (found >> U(64 - CELL_BITS)).astype(np.int64), 1)
            none = pa.nulls(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), pa.array(keys, mask=n == 0), none.cast(pa.int32()), none.cast(pa.binary())], names=["doc_id", "n", "key", "slice", "counts"])
        if sketch is not None:
            for s, part in enumerate(sketch.reshape(-1, 1 << SLICE_BITS)):
                if part.any():
                    yield pa.RecordBatch.from_arrays([pa.nulls(1, kind), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([s], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())], names=["doc_id", "n", "key", "slice", "counts"])

    from pyspark.sql.pandas.types import to_arrow_type

    arrow = to_arrow_type(docs.schema["doc_id"].dataType)

    def schema_of(_: str) -> pa.DataType:
        return arrow

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id {kind}, n long, key long, slice int, counts binary")


def _classes(rows: DataFrame, total: int) -> np.ndarray:
    """A byte for each cell: 0 for rare shingles, then one more with each doubling.  Fixed size, so fit for the driver."""
    rare = max(RARE, 4 * total >> CELL_BITS)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for s, counts in zip(batch.column("slice").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                part = np.frombuffer(zlib.decompress(counts), np.uint32).astype(np.uint64)
                sums[s] = sums[s] + part if s in sums else part
        for s, part in sums.items():
            level = np.where(part <= rare, 0, 1 + np.log2(np.maximum(part, 1) / rare)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([zlib.compress(level.tobytes(), 1)], pa.binary())], names=["slice", "levels"])

    slices = 1 << (CELL_BITS - SLICE_BITS)
    got = rows.filter("slice IS NOT NULL").select("slice", "counts").repartition(slices, "slice").mapInArrow(work, "slice int, levels binary").collect()
    out = np.zeros((slices, 1 << SLICE_BITS), np.uint8)
    for r in got:
        out[r["slice"]] = np.frombuffer(zlib.decompress(r["levels"]), np.uint8)
    return out.reshape(-1)


def signatures(found: np.ndarray, levels: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The signatures of a set."""
    n = len(found)
    out = [finish(found ^ U(0xD6E8FEB86659FD93))] if n <= SMALL else []
    if n >= LEAST:
        level = levels[(found >> U(64 - CELL_BITS)).astype(np.int64)]
        length = min(n, n - -(-percent * n // 100) + 1 + CLASSES)
        order = (level.astype(U) << U(58)) | (found >> U(6))
        pick = np.argpartition(order, length - 1)[:length] if length < n else np.arange(n)
        rare = level[pick] == 0
        if n > SMALL:
            out.append(finish(found[pick[rare]] ^ U(0xD6E8FEB86659FD93)))
        often = np.sort(found[pick[~rare]])
        if len(often) > 1:
            group = often & U(CLASSES - 1)
            for c in range(CLASSES):
                one = often[group == U(c)]
                a, b = np.triu_indices(len(one), 1)
                out.append(finish(one[a] * U(0x9E3779B97F4A7C15) + finish(one[b])))
    return np.concatenate(out) if out else found[:0]


def bitmap(found: np.ndarray) -> np.ndarray:
    """Parity of the shingles in each of 2 to 4 bits a shingle, as 64-bit words."""
    bits = max(64, 1 << (2 * len(found) - 1).bit_length())
    field = np.bincount((found >> U(20)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(field.astype(np.uint8), bitorder="little").view(U)


def _signed(docs: DataFrame, levels: np.ndarray, speakers: tuple[int, np.ndarray], words: int, percent: int) -> DataFrame:
    """Rows (sig, key), and for every node a row (key, n, bits).

    Of equal sets the document with the smallest id speaks, and only its text is
    read; what else passes the filter of speakers is a harmless repetition.
    """
    shared, spoken = (docs.sparkSession.sparkContext.broadcast(x) for x in (levels, speakers))

    def rows(keys: list[int], sizes: list[int], bits: list[bytes], sigs: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if not keys:
            return
        flat, counts = np.concatenate(sigs), [len(s) for s in sigs]
        none, m = pa.nulls(len(flat)), len(keys)
        yield pa.RecordBatch.from_arrays([pa.array(flat.view(np.int64)), pa.array(np.repeat(np.array(keys, np.int64), counts)), none.cast(pa.int64()), none.cast(pa.binary())], names=["sig", "key", "n", "bits"])
        yield pa.RecordBatch.from_arrays([pa.nulls(m, pa.int64()), pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), pa.array(bits, pa.binary())], names=["sig", "key", "n", "bits"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[int] = set()
        for batch in batches:
            made, held = ([], [], [], []), 0
            some = batch.filter(pa.array(may_hold(spoken.value, batch.column("_id").to_numpy().view(U))))
            for _, found in shingle_sets(some.column("text"), words):
                if not len(found) or (key := key_of(found)) in known:
                    continue
                if len(known) >= REMEMBERED:
                    known.clear()
                known.add(key)
                sigs = signatures(found, shared.value, percent)
                for column, value in zip(made, (key, len(found), bitmap(found).tobytes(), sigs), strict=True):
                    column.append(value)
                held += len(sigs)
                if held > HELD:
                    yield from rows(*made)
                    made, held = ([], [], [], []), 0
            yield from rows(*made)

    return docs.select("text", F.xxhash64("doc_id").alias("_id")).mapInArrow(work, "sig long, key long, n long, bits binary")


def _sieved(rows: DataFrame, sieve: tuple[int, np.ndarray], hot: np.ndarray) -> DataFrame:
    """rows (sig, key) whose signature passes the sieve, with a salt, which is 0 unless the signature is hot."""
    shared = rows.sparkSession.sparkContext.broadcast((sieve, hot))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sieve, hot = shared.value
        for batch in batches:
            sig, key = (batch.column(c).to_numpy() for c in ("sig", "key"))
            keep = may_hold(sieve, sig.view(U))
            sig, key = sig[keep], key[keep]
            salt = np.where(np.isin(sig, hot), 1 + (finish(key.view(U).copy()) % U(SALTS)).astype(np.int64), 0).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(sig), pa.array(key), pa.array(salt)], names=["sig", "key", "salt"])

    return rows.select("sig", "key").mapInArrow(work, "sig long, key long, salt int")


def lists(signed: DataFrame, path: str) -> DataFrame:
    """(sig, part, parts, own, key, n, bits): the members of lists of two nodes or more.

    A list longer than BLOCK is cut into parts; a member is its own part's, and the two
    with the smallest and the largest key are guests of all others.  The table of
    signatures at path goes as soon as it has been read.
    """
    spark = signed.sparkSession
    nodes, p3 = materialise(signed.filter("sig IS NULL").groupBy("key").agg(F.first("n").alias("n"), F.first("bits").alias("bits")), "jaccard-nodes")
    sigs = signed.filter("sig IS NOT NULL").select("sig", "key")
    twice, p1 = materialise(sigs.groupBy("sig").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "jaccard-twice")
    settle(spark)
    hot = np.array([k for (k,) in hot_keys(twice, "sig")], np.int64)
    some, p2 = materialise(_sieved(sigs, bloom(twice, "sig", twice.count()), hot), "jaccard-some")
    forget(spark, p1, path)
    settle(spark)
    half = lambda s: F.call_function("shiftrightunsigned", F.xxhash64("key", F.lit(s)), F.lit(33))
    facts = {"c": F.count(F.lit(1)), "lo": F.min("key"), "hi": F.max("key"), "a": F.sum(half(1)), "b": F.sum(half(2))}
    per_salt = some.groupBy("sig", "salt").agg(*[v.alias(k) for k, v in facts.items()])
    # A hot signature has at most SALTS rows here.
    joined = per_salt.filter("salt > 0").groupBy("sig").agg(F.sum("c").alias("c"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("a").alias("a"), F.sum("b").alias("b"))
    each = per_salt.filter("salt = 0").drop("salt").withColumn("_hot", F.lit(False)).unionByName(joined.withColumn("_hot", F.lit(True))).filter("lo < hi")
    one = each.groupBy("c", "lo", "hi", "a", "b").agg(F.min("sig").alias("sig"), F.min_by("_hot", "sig").alias("_hot"))
    one = one.select("sig", "lo", "hi", F.ceil(F.col("c") / BLOCK).cast("int").alias("parts"), F.explode(F.when(F.col("_hot"), F.sequence(F.lit(1), F.lit(SALTS))).otherwise(F.array(F.lit(0)))).alias("salt"))
    members = some.join(one.hint("merge"), ["sig", "salt"]).select("sig", "key", "parts", F.col("key").isin(F.col("lo"), F.col("hi")).alias("_guest")).distinct()
    home = F.pmod(F.xxhash64("key", F.lit("part")), F.col("parts")).cast("int")
    members = members.withColumn("_home", home).withColumn("part", F.explode(F.when(F.col("_guest"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array("_home"))))
    members = members.select("sig", "part", "parts", (F.col("part") == F.col("_home")).alias("own"), "key")
    out, _ = materialise(members.join(nodes.hint("merge"), "key").select("sig", "part", "parts", "own", "key", "n", "bits"), "jaccard-lists")
    forget(spark, p2, p3)
    settle(spark)
    return out


def _fold(bits: np.ndarray, words: int) -> np.ndarray:
    """Rows of bitmaps folded to fewer words: parities of halves add up."""
    while bits.shape[1] > words:
        h = bits.shape[1] // 2
        bits = bits[:, :h] ^ bits[:, h:]
    return bits


def may_link(n: np.ndarray, bits: list[bytes], percent: int, label: np.ndarray | None = None, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(x, y, difference at least) of members that can reach the threshold; with labels, only across them and not of two guests."""
    order = np.argsort(n, kind="stable")
    width = np.array([len(b) // 8 for b in bits])
    xs, ys, ds = [], [], []
    for w in np.unique(width):
        mine = order[width[order] == w]
        block = np.frombuffer(b"".join([bits[i] for i in mine]), U).reshape(len(mine), int(w))
        for v in (w, 2 * w, 4 * w):  # sets of such different sizes do not link beyond the next width
            other = order[width[order] == v]
            if not len(other):
                continue
            rows = block if v == w else _fold(np.frombuffer(b"".join([bits[i] for i in other]), U).reshape(len(other), int(v)), int(w))
            for at in range(0, len(mine), max(1, (1 << 19) // max(1, rows.size))):
                top = min(len(mine), at + max(1, (1 << 19) // max(1, rows.size)))
                d = np.bitwise_count(block[at:top, None, :] ^ rows[None, :, :]).sum(-1, dtype=np.int64)
                a, b = n[mine[at:top]][:, None], n[other][None, :]
                ok = (d * (100 + percent) <= (a + b) * (100 - percent)) & (100 * np.minimum(a, b) >= percent * np.maximum(a, b))
                if v == w:
                    ok &= np.arange(at, top)[:, None] < np.arange(len(other))[None, :]
                if label is not None and own is not None:
                    ok &= (label[mine[at:top]][:, None] != label[other][None, :]) & (own[mine[at:top]][:, None] | own[other][None, :])
                p, q = np.nonzero(ok)
                xs.append(mine[at:top][p])
                ys.append(other[q])
                ds.append(d[p, q])
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (xs, ys, ds))


def forest(x: np.ndarray, y: np.ndarray, worth: np.ndarray, size: int) -> list[int]:
    """Links of a spanning forest, those of the smallest worth first."""
    parent, out = list(range(size)), []

    def root(a: int) -> int:
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    for i in np.argsort(worth, kind="stable").tolist():
        a, b = root(int(x[i])), root(int(y[i]))
        if a != b:
            parent[a] = b
            out.append(i)
    return out


def _by_list(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of one part of a list after another, from sorted batches."""
    held: pa.RecordBatch | None = None
    for batch in batches:
        whole = batch if held is None else pa.concat_batches([held, batch])
        if not whole.num_rows:
            continue
        sig, part = (whole.column(c).to_numpy() for c in ("sig", "part"))
        cut = np.flatnonzero((sig[1:] != sig[:-1]) | (part[1:] != part[:-1])) + 1
        for a, b in zip([0, *cut[:-1].tolist()], cut.tolist(), strict=False):
            yield whole.slice(a, b - a)
        held = whole.slice(int(cut[-1]) if len(cut) else 0)
    if held is not None and held.num_rows:
        yield held


def _links(members: DataFrame, percent: int, labelled: bool) -> DataFrame:
    """(sig, x, y): a forest of each part of a list, or if labelled all pairs across labels that may link."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for group in _by_list(batches):
            keys, n, bits = group.column("key").to_numpy(), group.column("n").to_numpy(), group.column("bits").to_pylist()
            if labelled:
                x, y, _ = may_link(n, bits, percent, group.column("label").to_numpy(), group.column("own").to_numpy(zero_copy_only=False))
                take = range(len(x))
            else:
                x, y, d = may_link(n, bits, percent)
                take = forest(x, y, d / (n[x] + n[y]) if len(x) else d, len(n))
            sig = group.column("sig")[0].as_py()
            out += [(sig, *sorted((int(keys[x[t]]), int(keys[y[t]])))) for t in take]
            if len(out) > 20000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=names)

    names = ["sig", "x", "y"]
    return members.repartition("sig", "part").sortWithinPartitions("sig", "part").mapInArrow(work, "sig long, x long, y long")


def _open(members: DataFrame, found: DataFrame, failed: DataFrame, labels: DataFrame) -> DataFrame:
    """Members, with labels, of lists where a link failed or that have parts, as far as they can still link.

    Members outside the largest label of their list are guests of every part.
    """
    named = members.join(labels.hint("merge"), members["key"] == labels["node"], "left").withColumn("label", F.coalesce("label", "key")).drop("node")
    lists_of = found.join(failed.hint("merge"), ["x", "y"]).select("sig").unionByName(members.filter("parts > 1").select("sig")).distinct()
    named = named.filter("own").join(lists_of.hint("merge"), "sig", "left_semi")
    size = named.groupBy("sig", "label", "parts").agg(F.count(F.lit(1)).alias("_n"))
    most = size.groupBy("sig").agg(F.max_by("label", F.struct("_n", "label")).alias("_most"), F.count(F.lit(1)).alias("_labels"), F.first("parts").alias("_parts")).filter("_labels > 1")
    most = most.select("sig", "_most", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("part"))
    named = named.join(most.hint("merge"), ["sig", "part"]).withColumn("_home", F.col("part"))
    outside = F.col("label") != F.col("_most")
    named = named.withColumn("part", F.explode(F.when(outside, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array("_home"))))
    return named.select("sig", "part", (F.col("part") == F.col("_home")).alias("own"), "label", "key", "n", "bits")


@lru_cache(maxsize=4)
def words_of(text: str) -> list[str]:
    """The words of a text, A-Z lower-cased; the last few are remembered, as neighbouring pairs share a text."""
    return [x for x in _SPACES.split(text.translate(_LOWER)) if x]


def reaches(one: str, other: str, words: int, percent: int) -> bool:
    """Whether two texts with words reach the threshold, by the words themselves.

    Words are numbered for the pair and a shingle is the number that its words spell,
    renumbered wherever that would outgrow 64 bits, so that equal means equal words.
    """
    a, b = words_of(one), words_of(other)
    if min(len(a), len(b)) < words:
        return a == b
    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for part in (a, b) for w in part), np.int64, len(a) + len(b))
    names, limit = ids, len(number)
    for k in range(1, words):
        if limit * len(number) >= 1 << 62:
            kinds, names = np.unique(names, return_inverse=True)
            limit = len(kinds)
        names, limit = names[:-1] * len(number) + ids[k:], limit * len(number)
    x, y = np.unique(names[: len(a) - words + 1]), np.unique(names[len(a) :])
    both = len(x) + len(y) - len(np.union1d(x, y))
    return 100 * both >= percent * (len(x) + len(y) - both)


def verify(docs: DataFrame, pairs: DataFrame, speakers: DataFrame, words: int, percent: int) -> DataFrame:
    """pairs (x, y) with ``ok``: whether the sets of the two nodes reach the threshold.

    speakers (key, speaker): the hash of the id of a document of each node.
    """
    spark = docs.sparkSession
    ends, path = materialise(pairs.select(F.col("x").alias("key")).unionByName(pairs.select(F.col("y").alias("key"))).distinct(), "jaccard-ends")
    n = ends.count()
    sieve = spark.sparkContext.broadcast((bloom(ends, "key", n), bloom(speakers.join(ends.hint("merge"), "key", "left_semi"), "speaker", n)))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[int] = set()
        for batch in batches:
            keys, rows = [], []
            wanted, speaking = sieve.value
            some = batch.filter(pa.array(may_hold(speaking, batch.column("_id").to_numpy().view(U)))).column("text")
            for i, found in shingle_sets(some, words):
                if len(found) and (key := key_of(found)) not in known and may_hold(wanted, np.array([key]).view(U))[0]:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known.add(key)
                    keys.append(key)
                    rows.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), some.take(pa.array(rows, pa.int64()))], names=["key", "text"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column("a"), batch.column("b"), strict=True)  # a text at a time: batches hold long ones
            ok = [reaches(one.as_py(), other.as_py(), words, percent) for one, other in pairs]
            yield pa.RecordBatch.from_arrays([batch.column("x"), batch.column("y"), pa.array(ok)], names=["x", "y", "ok"])

    texts = docs.select("text", F.xxhash64("doc_id").alias("_id")).mapInArrow(fetch, "key long, text string")
    sets, sets_path = materialise(texts.join(ends.hint("merge"), "key", "left_semi").groupBy("key").agg(F.first("text").alias("text")), "jaccard-sets")
    with_x = pairs.join(sets.select(F.col("key").alias("x"), F.col("text").alias("a")).hint("merge"), "x")
    both = with_x.join(sets.select(F.col("key").alias("y"), F.col("text").alias("b")).hint("merge"), "y")
    out, _ = materialise(both.select("x", "y", "a", "b").mapInArrow(compare, "x long, y long, ok boolean"), "jaccard-verified")
    forget(spark, path, sets_path)
    return out


def groups(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_shingles, component_id for every row; needs percent of 80 or more."""
    if percent < 80:
        raise ValueError("the prefixes of small sets hold from 80 percent on")
    spark = docs.sparkSession
    rows, _ = materialise(_nodes_and_sketch(docs, words), "jaccard-rows")
    plain = rows.filter("slice IS NULL").select("doc_id", "n", "key")
    total = plain.agg(F.sum("n")).first()[0] or 0
    speakers = plain.filter("n > 0").groupBy("key").agg(F.min("doc_id").alias("low")).select("key", F.xxhash64("low").alias("speaker"))
    speakers, p5 = materialise(speakers, "jaccard-speakers")
    signed, p1 = materialise(_signed(docs, _classes(rows, total), bloom(speakers, "speaker", speakers.count()), words, percent), "jaccard-signed")
    settle(spark)
    members = lists(signed, p1)
    found, p2 = materialise(_links(members, percent, labelled=False), "jaccard-links")
    settle(spark)
    first = verify(docs, found.select("x", "y").distinct(), speakers, words, percent)
    linked, failed = first.filter("ok").select("x", "y"), first.filter("NOT ok").select("x", "y")
    if not (failed.isEmpty() and members.filter("parts > 1").isEmpty()):
        labels, p3 = materialise(components(linked), "jaccard-labels")
        more = _links(_open(members, found, failed, labels), percent, labelled=True).select("x", "y").distinct().join(first.hint("merge"), ["x", "y"], "left_anti")
        more, p4 = materialise(more, "jaccard-more")
        if not more.isEmpty():
            linked, _ = materialise(linked.unionByName(verify(docs, more, speakers, words, percent).filter("ok").select("x", "y")), "jaccard-linked")
        forget(spark, p3, p4)
    labels, _ = materialise(components(linked), "jaccard-components")
    forget(spark, p2, p5)
    settle(spark)
    # Copies of a text share a node and groups share a label: both are reduced and reached per salt.
    each = plain.filter("n > 0").withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))).groupBy("key", "_salt").agg(F.min("doc_id").alias("_low"))
    nodes = each.groupBy("key").agg(F.min("_low").alias("_low"))
    nodes = nodes.join(labels.hint("merge"), nodes["key"] == labels["node"], "left").select("key", F.coalesce("label", "key").alias("label"), "_low")
    named = least_by(nodes, "label", "_low", "component_id", salt="key").select("key", "component_id")
    parted = each.select("key", "_salt").join(named.hint("merge"), "key")
    rows = plain.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))).join(parted.hint("merge"), ["key", "_salt"], "left")
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
