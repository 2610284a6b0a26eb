"""Quality rules as a short-circuit cascade (DataFrame functions only).

``measures`` derives the base counts of every text with array expressions inside
one row, so nothing is shuffled.  ``cascade`` draws a bounded sample of the texts,
times every rule on it and looks which rows it rejects, then orders the rules: the
next one is that with the most rejections per second among the rows that passed
those before.  The rules are folded into one ``CASE WHEN``: Spark evaluates a
later rule only for rows that passed all the earlier ones.  The verdict is a
conjunction, so the order changes the work and never the result; only
``rejected_by`` depends on it where several rules reject a row.

Defined cases: a null or empty text has no words and every count is 0, so it
fails the base rules; a null ``doc_id`` is kept as it is; repeated rows are
judged one by one; other columns pass through untouched, and a column of the
input that bears the name of a result column is replaced.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import SPACE, forget, materialise, packed

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Rows that the order of the rules is learnt from, and how often a rule is applied to each of them when it is timed.
SAMPLE_ROWS = 1000
TIMES = 4

#: Columns that ``measures`` adds.
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """reject: true where the row fails."""

    name: str
    reject: Callable[[], Column]


def _c(name: str) -> Column:
    return F.col(name)


RULES: tuple[Rule, ...] = (
    Rule("symbols", lambda: _c("n_symbols") * 4 > _c("n_words")),
    Rule("duplicate_lines", lambda: _c("n_dup_lines") * 3 > _c("_n_lines")),
    Rule("word_length", lambda: ~(_c("word_chars") / F.greatest(_c("n_words"), F.lit(1))).between(2, 15)),
    Rule("shouting", lambda: F.size(F.split("text", "!+[\\x20\\x09-\\x0D]")) * 4 > _c("n_words")),
    Rule("no_lower_case", lambda: F.length(F.regexp_replace("text", "\\P{Lu}+", "")) * 2 > _c("word_chars")),
)


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs (text, and columns whose names begin with _row) with BASE and ``_n_lines`` (lines that have a word).

    Windows of three words are compared by a 64-bit hash cut to the bits that a
    position leaves free, then by the hashes of the three words themselves.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    d = docs.withColumn("_words", F.array_remove(F.split(t, SPACE), ""))
    d = d.withColumn("_lines", F.filter(F.split(t, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")))
    d = d.select(
        *[c for c in d.columns if c not in ("_words", "_lines")],
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        (F.size(F.split(t, "[#*$%&|<>]")) - 1).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("_n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.transform("_words", lambda w: F.xxhash64(w)).alias("_hashes"),
    )
    # A sorted long holds (hash of the window, its start): the start takes the low _bits.
    d = d.withColumn("_bits", F.length(F.bin(F.col("n_words"))))
    window = lambda i: F.xxhash64(F.get("_hashes", i), F.get("_hashes", i + 1), F.get("_hashes", i + 2))
    d = d.withColumn(
        "_sorted",
        F.when(
            F.col("n_words") >= 4,
            F.sort_array(F.transform(F.sequence(F.lit(0), F.col("n_words").cast("int") - 3), lambda i: F.call_function("shiftleft", window(i), F.col("_bits")).bitwiseOR(i.cast("long")))),
        ).otherwise(F.array().cast("array<bigint>")),
    )
    top = lambda x: F.call_function("shiftright", x, F.col("_bits"))
    low = lambda x: x.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_bits")) - 1).cast("int")

    def same(x: Column, y: Column) -> Column:
        words = [F.get("_hashes", low(x) + k) == F.get("_hashes", low(y) + k) for k in range(3)]
        return F.coalesce((top(x) == top(y)) & words[0] & words[1] & words[2], F.lit(False))

    d = d.withColumn("_starts", F.filter("_sorted", lambda x, i: same(x, F.get("_sorted", i + 1)) | same(x, F.get("_sorted", i - 1))))
    d = d.withColumn("_starts", F.sort_array(F.transform("_starts", low)))
    covered = F.aggregate(
        F.transform("_starts", lambda x, i: F.least(F.lit(3), F.coalesce(F.get("_starts", i + 1) - x, F.lit(3)))), F.lit(0).cast("long"), lambda a, x: a + x
    )
    return d.withColumn("n_repeat_words", covered).drop("_hashes", "_bits", "_sorted", "_starts")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)


def order_rules(docs: DataFrame, rules: Sequence[Rule] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Rules in the order of the cascade, learnt from at most sample_rows rows of docs (text); ties keep the given order."""
    if len(rules) < 2:
        return list(rules)
    n = docs.count()
    some = docs.select("text").sample(min(1.0, 4.0 * sample_rows / max(1, n)), seed=7).limit(sample_rows)
    sample, path = materialise(measures(some), "rules-sample")  # a filter on top would be pushed into the measures
    sample = sample.filter(~base_failed())
    again = sample.withColumn("_k", F.explode(F.sequence(F.lit(1), F.lit(TIMES))))

    def seconds(what: Column) -> float:
        began = time.perf_counter()
        again.agg(F.sum(what)).first()
        return time.perf_counter() - began

    one = lambda r: F.coalesce(r.reject(), F.lit(False)).cast("int") + F.col("_k") * 0
    seconds(F.col("_k"))  # the first reading of the sample counts for none
    idle = seconds(F.col("_k") + F.octet_length("text"))
    cost = [max(seconds(one(r)) - idle, 1e-3) for r in rules]
    # A flag for each rule and row of the sample.
    left = [list(r) for r in sample.select(*[F.coalesce(r.reject(), F.lit(False)) for r in rules]).collect()]
    forget(sample.sparkSession, path)
    rest, out = list(range(len(rules))), []
    while rest:
        best = max(rest, key=lambda i: (sum(row[i] for row in left) / cost[i], -i))
        out.append(rules[best])
        rest.remove(best)
        left = [row for row in left if not row[best]]
    return out


def cascade(docs: DataFrame, rules: Sequence[Rule] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """docs with BASE, ``base_failed``, ``kept`` and ``rejected_by`` (the first rule that fired, or null)."""
    new = (*BASE, "base_failed", "kept", "rejected_by")
    columns = [c for c in docs.columns if c not in new]
    measured = measures(packed(docs.drop(*new), "text"))
    verdict = F.when(base_failed(), F.lit("base"))
    for r in order_rules(docs, rules, sample_rows):
        verdict = verdict.when(r.reject(), F.lit(r.name))
    # A filter on the verdict must not be pushed below the measures, which would be derived again inside
    # their own lambdas; Spark leaves a filter above a projection that is not deterministic.
    verdict = F.when(F.monotonically_increasing_id() >= 0, verdict)
    out = measured.withColumn("base_failed", base_failed()).withColumn("rejected_by", verdict)
    out = out.withColumn("kept", F.col("rejected_by").isNull())
    return out.select(*[(F.col("text") if c == "text" else F.col("_row").getField(c)).alias(c) for c in columns], *new)
