"""A corpus from end to end: quality rules, near copies, repeated passages, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and works on everything that its
predecessor kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framemill.llm import bpe, jaccard, mixing, quality_rules, repeats, suffix_dedup
from framemill.llm.queries import tokenizer
from framemill.llm.shared import materialise, packed, ship, unpacked

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Near copies share shingles of so many words, to a Jaccard similarity of so many percent or more; op5 has its own values.
NEAR_WORDS = 5
NEAR_PERCENT = 80


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return unpacked(quality_rules.cascade(packed(docs, "text")).filter("kept"), docs.columns, "text")


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are linked by near equality the one with the smallest id; of equal rows one."""
    ship(spark)
    named = repeats.keyed(packed(docs, "doc_id", "text"))
    found = jaccard.groups(named.select(F.struct("doc_id", "_h", "_g").alias("doc_id"), "text"), words=NEAR_WORDS, percent=NEAR_PERCENT)
    stay = found.filter("doc_id = component_id").select("doc_id._h", "doc_id._g").distinct()
    return unpacked(named.join(stay, ["_h", "_g"]).dropDuplicates(["_h", "_g"]), docs.columns, "doc_id", "text")


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the byte strings that occur elsewhere; what has no word left goes."""
    ship(spark)
    cut = suffix_dedup.dedup(packed(docs, "doc_id", "text"), characters=True).withColumn("_text", F.col("kept").cast("string"))
    new = {"text": F.col("_text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("_text").cast(docs.schema["n_chars"].dataType)
    return unpacked(cut.filter(F.col("_text").rlike("[^\\x20\\x09-\\x0D]")), docs.columns, "doc_id", **new)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes, a row for each use of a document."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row."""
    ship(spark)
    out = bpe.encode_decode(docs.select("doc_id", "lang", "source", "text"), tokenizer("word_bpe_49k.json"))
    return out.select("doc_id", "lang", "source", "n_tokens", "ids")


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", keep_good),
    ("jaccard_join", keep_one_of_each_group),
    ("suffix_dedup", drop_repeated_passages),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: Sorting suffixes and merging pairs are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each but the last written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs, _ = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
