"""Language identification as a mixture of languages.

Every language has a distribution over hashed four-byte grams, counted on a
bounded sample of labelled documents.  A document is a bag of its grams, drawn
from an unknown mixture: expectation-maximisation estimates the proportions, and
the set of languages is the one of the highest likelihood after a penalty of
``PENALTY * ln(grams)`` for each language beyond the first.  The prediction is
the language of the largest proportion, the score that proportion.

Defined cases: a null text, or one without a letter, gives ``und`` and 0.0, as
does everything if no document has a label; ties go to the language first in
code-point order; texts are used whole; repeated rows are predicted one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows of a language that are learnt from, about; grams are hashed into so many cells.
ROWS_PER_LANGUAGE = 1500
CELL_BITS = 16
SMOOTHING = 0.3
PENALTY = 8.0
ROUNDS = 12

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = np.zeros(256, np.uint8)
_LETTER[97:123] = 1
_LETTER[128:] = 1
_ANY = regex.compile(r"\p{L}")


def cells(text: str) -> np.ndarray:
    """The cells of the grams of text that have two letter bytes or more."""
    raw = _LOWER[np.frombuffer(b" " + text.encode() + b"  ", np.uint8)]
    code = raw[:-3].astype(np.uint32)
    for k in (1, 2, 3):
        code |= raw[k : len(raw) - 3 + k].astype(np.uint32) << np.uint32(8 * k)
    mark = _LETTER[raw]
    keep = mark[:-3] + mark[1:-2] + mark[2:-1] + mark[3:] >= 2
    return ((code[keep] * np.uint32(2654435769)) >> np.uint32(32 - CELL_BITS)).astype(np.int64)


def held_out(doc_id: Column) -> Column:
    """The fold that nothing is learnt from: crc32 of the id as text, remainder 2 of 4."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, rows: int = ROWS_PER_LANGUAGE) -> tuple[list[str], np.ndarray]:
    """(languages, table): table[cell] holds p(cell | language), scaled to 1 for the likeliest.

    Of a language about ``rows`` documents are drawn, by the hash of their ids;
    all rows of it if it has fewer.  A language's counts come together in one
    task, which the bound makes small, and a vector for each goes to the driver.
    """
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    size = 1 << CELL_BITS
    # A count for each language, of which the model has a vector anyway; joined, the texts would be shuffled.
    found = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    if not found:
        return [], np.zeros((size, 0), np.float32)
    share = F.create_map(*[F.lit(x) for lang, n in found.items() for x in (lang, rows / n)])
    spot = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("learn")), F.lit(1 << 30)) / float(1 << 30)
    drawn = labelled.filter(spot < F.element_at(share, F.col("lang")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                got = np.bincount(cells(text), minlength=size)
                sums[lang] = sums[lang] + got if lang in sums else got
        names = sorted(sums)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([sums[n].astype("<i8").tobytes() for n in names], pa.binary())], names=["lang", "counts"])

    got = drawn.select("lang", "text").repartition("lang").mapInArrow(count, "lang string, counts binary").collect()
    names = sorted(r["lang"] for r in got)
    if not names:
        return [], np.zeros((size, 0), np.float32)
    counts = np.stack([np.frombuffer(next(r["counts"] for r in got if r["lang"] == n), "<i8") for n in names], axis=1).astype(np.float64)
    p = (counts + SMOOTHING) / (counts.sum(axis=0) + SMOOTHING * size)
    return names, (p / p.max(axis=1, keepdims=True)).astype(np.float32)


def mixture(p: np.ndarray, weight: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """EM over rows p (different grams by languages) that occur weight times: the proportions and the log likelihood."""
    m, total = p.shape[1], np.float32(weight.sum())
    share = np.full(m, 1.0 / m, np.float32)
    if m > 1:
        for _ in range(rounds):
            share = share * ((weight / (p @ share)) @ p) / total
    return share, float((np.log(p @ share) * weight).sum(dtype=np.float64))


def identify(text: str | None, names: list[str], table: np.ndarray) -> tuple[str, float]:
    """The language of the largest proportion and that proportion, in the set of the highest penalised likelihood.

    The set grows from the likeliest single language by the language that gains
    most, for as long as the gain exceeds the penalty.
    """
    if not names or text is None or not _ANY.search(text):
        return "und", 0.0
    found, counts = np.unique(cells(text), return_counts=True)
    if not len(found):
        return names[0], 1.0 / len(names)
    p, weight = table[found], counts.astype(np.float32)
    cost = PENALTY * np.log(max(2.0, float(counts.sum())))
    alone = (np.log(p) * weight[:, None]).sum(axis=0, dtype=np.float64)
    chosen = [int(np.argmax(alone))]
    share, worth = np.ones(1, np.float32), float(alone[chosen[0]])
    most = mixture(p, weight)[1] if len(names) > 1 else worth
    while most > worth + cost:  # else no larger set can gain its penalty
        tried = [(*mixture(p[:, [*chosen, i]], weight), i) for i in range(len(names)) if i not in chosen]
        if not tried:
            break
        some, gained, i = max(tried, key=lambda t: (t[1], -t[2]))
        if gained <= worth + cost:
            break
        chosen.append(i)
        share, worth = some, gained
    best = max(range(len(chosen)), key=lambda k: (share[k], -chosen[k]))
    return names[chosen[best]], float(min(1.0, max(0.0, share[best])))


def predict(docs: DataFrame, names: list[str], table: np.ndarray) -> DataFrame:
    """docs without text, with lang_pred and score.  The model has one vector of 2**CELL_BITS cells for each language."""
    keep = [c for c in docs.columns if c not in ("text", "lang_pred", "score")]
    schema = docs.select(*[F.col(f"`{c}`") for c in keep]).schema.add("lang_pred", "string").add("score", "double")
    model = docs.sparkSession.sparkContext.broadcast((names, table))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, cell_table = model.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                got = [identify(t, known, cell_table) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=[*keep, "lang_pred", "score"])

    return docs.select(*keep, "text").mapInArrow(work, schema)
