"""Token-ID files: Parquet with one list of ids per document.

A file holds documents in ascending id order; the files follow one another in
name order.  ``ids`` is dictionary encoded (a vocabulary's ids fit one
dictionary page) and the counters beside it are delta encoded; row groups and
pages have fixed sizes and the writer adds page indexes, so readers of a few
documents or of the counters alone touch little.  The place of a document among
all ids is the sum of the files before it, read from the counters, plus its
place in its file.

The library encodes everything, but it need not see a common word again and
again.  Where a tokenizer's pieces end at a space anyway (``cuttable``), texts are
cut before spaces and the ids of short pieces are remembered; pieces that are new
go to the library joined, and its ids are dealt out again at those that begin with
a space; a word that ends in a mark is remembered without it.  A cut needs a character before the space that is white space in no
version of Unicode; where there is none, the text stays in one piece.  Other
tokenizers get whole texts.

Defined cases: a null or empty text is its end id alone; rows without id come
first; equal ids keep together, ordered by their texts; an empty table gives
files without rows.
"""

from __future__ import annotations

import itertools
import json
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import kernel
from .shared import materialise, scratch_path, spread

if TYPE_CHECKING:
    from tokenizers import Tokenizer

#: Bytes of a row group and of a page, rows of a page at most; bytes of text that are encoded at once, unless one text is longer.
ROW_GROUP = 16 << 20
PAGE = 64 << 10
PAGE_ROWS = 2000
STEP = 1 << 20
#: Pieces of a generation, of which a worker remembers two, and the longest of them.
REMEMBERED = 200_000
LONGEST = 64
# No cut after these characters, which are or once were white space, or are controls.
NO_CUT = frozenset(map(chr, [*range(0x21), *range(0x7F, 0xA1), 0x1680, 0x180E, *range(0x2000, 0x2010), *range(0x2028, 0x2030), *range(0x205F, 0x2070), 0x3000, 0xFEFF]))
# A mark that ends a word after one of these letters is a piece by itself, whatever the version of Unicode.
MARKS = ".,;:!?"
LETTERS = frozenset(c for c in map(chr, range(0x250)) if c.isalpha())


@lru_cache(maxsize=2)
def library(spec: bytes) -> Tokenizer:
    """The tokenizers library with a tokenizer file's content, without truncation and padding."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the cores are Spark's
    from tokenizers import Tokenizer

    made = Tokenizer.from_str(spec.decode())
    made.no_padding()
    made.no_truncation()
    return made


def cuttable(spec: bytes) -> bool:
    """Whether the tokenizer's ids on the two sides of a space after a visible character never depend on each other."""
    made = json.loads(spec)
    before, model = made.get("pre_tokenizer") or {}, made["model"]
    plain = before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space")
    added = made.get("added_tokens") or []
    alone = not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or any(c.isspace() for c in t["content"]) for t in added)
    return bool(plain and alone and not made.get("normalizer") and model.get("type") == "BPE" and not model.get("dropout"))


class Coder:
    """Ids of texts, as the library gives them for whole texts."""

    def __init__(self, spec: bytes) -> None:
        self.made, self.cut, self.known, self.older = library(spec), cuttable(spec), {}, {}
        vocabulary = self.made.get_vocab(with_added_tokens=True)
        self.begins = np.zeros(1 + max(vocabulary.values(), default=0), bool)
        self.begins[[i for t, i in vocabulary.items() if t[:1] == "\u0120"]] = True  # the byte of a space
        added = "".join(t.content for t in self.made.get_added_tokens_decoder().values())
        self.marks = {m: ids.tobytes() for m, ids in zip(MARKS, self.library([*MARKS]), strict=True) if m not in added} if self.cut else {}

    def library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(e.ids, "<u4") for e in self.made.encode_batch_fast(texts, add_special_tokens=False)]

    def sections(self, text: str) -> Iterator[str]:
        """The text, in parts of some STEP characters where it can be cut."""
        start, at = 0, STEP
        while (at := text.find(" ", at)) >= 0:
            if text[at - 1] in NO_CUT:
                at += 1
                continue
            yield text[start:at]
            start, at = at, at + STEP
        yield text[start:]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers."""
        if not self.cut:
            return [ids.tobytes() for ids in self.library(texts)]
        return [b"".join(self.pieces([part])[0] for part in self.sections(t)) for t in texts] if any(len(t) > STEP for t in texts) else self.pieces(texts)

    def pieces(self, texts: list[str]) -> list[bytes]:
        parts = pc.split_pattern(pa.array(texts, pa.string()), " ")
        at, coded = parts.offsets.to_numpy(), parts.values.dictionary_encode()
        words, place = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy().copy()
        ids, again, fresh, marked, apart = [self.known.get(w) for w in words], {}, {}, [], []
        for i in [i for i, v in enumerate(ids) if v is None]:
            word = words[i]
            if (ids_of := self.older.get(word)) is not None:
                ids[i] = again[word] = ids_of
            elif word[-1:] in self.marks and word[-2:-1] in LETTERS and len(word) <= LONGEST:
                stem = word[:-1]
                if (ids_of := self.known.get(stem) or self.older.get(stem)) is None:
                    fresh.setdefault(stem, -1)
                    marked.append((i, stem))
                else:
                    again[stem], ids[i] = ids_of, ids_of + self.marks[word[-1]]
            elif word and len(word) <= LONGEST and word[-1] not in NO_CUT:
                fresh[word] = i
            else:
                apart.append(i)
        if fresh:
            (flat,) = self.library([" " + " ".join(fresh)])
            cuts = np.flatnonzero(self.begins[flat])
            if len(cuts) != len(fresh) or cuts[0]:
                raise ValueError("the tokenizer does not begin a piece at each space")
            raw, ends = flat.tobytes(), [*(4 * cuts).tolist(), 4 * len(flat)]
            for k, (word, i) in enumerate(fresh.items()):
                fresh[word] = raw[ends[k] : ends[k + 1]]
                if i >= 0:
                    ids[i] = fresh[word]
            for i, stem in marked:
                ids[i] = fresh[stem] + self.marks[words[i][-1]]
        # Alone: the first part of a text, which has no space before it, and parts that are not remembered, with those that they cannot be cut from.
        alone = np.zeros(len(words), bool)
        alone[apart] = True
        alone = alone[place]
        alone[at[:-1]] = True
        bound, single, last, done = at[1:].tolist(), [], 0, 0
        names = place.tolist() if len(apart) else None
        for i in np.flatnonzero(alone).tolist():
            if i < done:
                continue
            while bound[last] <= i:
                last += 1
            first, done = i == (bound[last - 1] if last else 0), i + 1
            text = [words[names[i] if names else place[i]]]
            while done < bound[last] and (not text[-1] or text[-1][-1] in NO_CUT):
                text.append(words[names[done] if names else place[done]])
                done += 1
            place[i], place[i + 1 : done] = len(ids) + len(single), -1
            single.append(("" if first else " ") + " ".join(text))
        ids += [x.tobytes() for x in self.library(single)] if single else []
        ids.append(b"")
        place[place < 0] = len(ids) - 1
        _, ends, raw = pa.array(ids, pa.binary()).take(pa.array(place)).buffers()
        ends, raw = np.frombuffer(ends, np.int32)[at], raw.to_pybytes() if raw else b""
        if len(self.known) + len(fresh) + len(again) > REMEMBERED:
            self.older, self.known = self.known, {}
        self.known.update(fresh | again)
        return [raw[a:b] for a, b in itertools.pairwise(ends.tolist())]


@lru_cache(maxsize=2)
def coder_of(spec: bytes) -> Coder:
    """The worker's coder, which keeps what it remembers from task to task."""
    return Coder(spec)


def write(docs: DataFrame, tokenizer: str, path: str, end_id: int | None = 2, files: int | None = None) -> None:
    """Encode docs (doc_id, text) and write them to path.  Columns: part, doc_id, first (its place in the file), n_tokens, ids."""
    files = files or spread(docs.sparkSession)
    tie = F.xxhash64("text")
    ordered = docs.select("doc_id", "text").repartitionByRange(files, F.col("doc_id"), tie).sortWithinPartitions(F.col("doc_id"), tie)
    tail = b"" if end_id is None else int(end_id).to_bytes(4, "little")
    spec = docs.sparkSession.sparkContext.broadcast(Path(tokenizer).read_bytes())  # a few MB; the workers need not have the file

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, at = coder_of(spec.value), TaskContext.get().partitionId(), 0
        for batch in batches:
            for lo, hi, _, _ in kernel.chunks(batch.column("text"), STEP):
                rows = batch.slice(lo, hi - lo)
                texts = [t or "" for t in rows.column("text").to_pylist()]
                coded = [ids + tail for ids in coder.encode(texts)]
                counts = np.array([len(c) // 4 for c in coded], "i8")
                ends = np.concatenate([[0], np.cumsum(counts)])
                flat = np.frombuffer(b"".join(coded), "<i4")
                made = [
                    pa.array(np.full(len(coded), part, "i4")), rows.column("doc_id"), pa.array(at + ends[:-1]), pa.array(counts),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32())),
                ]
                at += int(ends[-1])
                yield pa.RecordBatch.from_arrays(made, names=["part", "doc_id", "first", "n_tokens", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    coded = ordered.mapInArrow(work, f"part int, doc_id {kind}, first long, n_tokens long, ids array<int>")
    options = {"compression": "zstd", "parquet.writer.version": "v2", "parquet.block.size": ROW_GROUP, "parquet.page.size": PAGE, "parquet.page.row.count.limit": PAGE_ROWS, "parquet.enable.dictionary": "true", "parquet.enable.dictionary#first": "false", "parquet.enable.dictionary#doc_id": "false", "parquet.enable.dictionary#n_tokens": "false"}
    coded.write.options(**options).parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The files' rows with ``start``: the number of ids of all documents before."""
    rows = spark.read.parquet(path)
    by = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    base = rows.groupBy("part").agg(F.sum("n_tokens").alias("_n")).select("part", F.coalesce(F.sum("_n").over(by), F.lit(0)).alias("_base"))
    base, _ = materialise(base, "token-bases")  # its known size lets Spark broadcast it while it is small
    return rows.join(base, "part").withColumn("start", F.col("_base") + F.col("first")).drop("_base")


def checksums(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the CRC-32 of the ids as little-endian 32-bit integers."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            flat, ends = ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False), ids.offsets.to_numpy()
            sums = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            counts = pa.array(np.diff(ends).astype("i8"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), counts, pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.select("doc_id", "start", "ids").mapInArrow(work, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str, path: str | None = None, end_id: int | None = 2) -> DataFrame:
    spark = docs.sparkSession
    path = path or scratch_path(spark, "token-files")
    write(docs, tokenizer, path, end_id)
    return read(spark, path)
