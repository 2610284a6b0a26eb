"""Deterministic frames, packed rows and messages made from the driver's tables, which hold no images."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import clamp, div

WIDTH = 128


def bayer_from_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pixels (frame_id, y, x, v): two vectors of 64 are a row of 128 pixels, the height a multiple of 16."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    height = e.agg((F.floor(F.count(F.lit(1)) / 32) * 16).alias("_h"))
    p = e.select("vec_id", F.posexplode("embedding").alias("pos", "e"))
    p = p.select(
        F.lit(0).alias("frame_id"),
        div(F.col("vec_id"), 2).alias("y"),
        ((F.col("vec_id") % 2) * 64 + F.col("pos")).cast("int").alias("x"),
        clamp(F.floor((F.col("e").cast("double") + 1) * 511.5), 0, 1023).cast("int").alias("v"),
    )
    return p.join(F.broadcast(height), F.col("y") < F.col("_h")).drop("_h")  # one row


def bayer_structured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same plane attenuated, with edges, stripes, chroma and texture."""
    y, x, v = F.col("y"), F.col("x"), F.col("v")
    shaped = (
        F.floor((v - 512) / 16.0) + 200
        + F.when((x >= 40) & (x < 90), 300).otherwise(0)
        + 150 * (div(y, 24) % 2) + 60 * (x % 2) * (div(y, 40) % 2) + (x * y) % 97
    )
    return bayer_from_embeddings(spark, sf_dir).withColumn("v", clamp(shaped, 0, 1023).cast("int"))


def packed_rows(spark: SparkSession, sf_dir: str, table: str, key: str, text: str) -> DataFrame:
    """(row_id, packed): the bytes of whole texts, filled with zeros to whole words of 8 bytes."""
    t = spark.read.parquet(f"{sf_dir}/{table}.parquet").select(F.col(key).alias("row_id"), F.encode(text, "UTF-8").alias("_b"))
    fill = F.substring(F.lit(bytes(8)), F.lit(1), F.pmod(-F.octet_length("_b"), F.lit(8)))
    return t.select("row_id", F.concat("_b", fill).alias("packed"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, peer, ts, magic, body) from the events."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    magic = F.when(F.col("event_type") == "view", 0x3147504A).otherwise(0x31474E44).cast("bigint")
    return e.select(F.col("event_id").alias("seq"), F.col("user_id").alias("peer"), "ts", magic.alias("magic"), F.encode("props", "UTF-8").alias("body"))
