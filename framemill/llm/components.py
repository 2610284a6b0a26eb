"""Connected components of a table of links, by alternating large and small stars.

Each round is two aggregates over the links and two joins of links with what their
nodes learnt.  Nodes with more than 1 in SHARE of the links are hubs, of which there
are fewer than SHARE: what they learnt is broadcast, and their links stay where they
are, so that a node with any number of links is no burden.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .repeats import FLOOR, SHARE
from .shared import forget, materialise, settle


def _both(links: DataFrame) -> DataFrame:
    return links.select("x", "y").unionByName(links.select(F.col("y").alias("x"), F.col("x").alias("y")))


def _lowest(links: DataFrame, count: int) -> DataFrame:
    """links (x, y) with ``m``, the smallest y of each x; count: about how many links there are."""
    low = links.groupBy("x").agg(F.min("y").alias("m"), F.count(F.lit(1)).alias("_n"))
    hub = F.col("_n") > max(FLOOR, count // SHARE)
    hubs = F.broadcast(low.filter(hub).drop("_n"))  # fewer than SHARE rows
    return links.join(hubs.select("x"), "x", "left_anti").join(low.drop("_n").hint("merge"), "x").unionByName(links.join(hubs, "x"))


def _large(links: DataFrame, count: int) -> DataFrame:
    """Every neighbour above a node is tied to the smallest of the node and its neighbours."""
    both = _lowest(_both(links), 2 * count)
    return both.filter("y > x").select(F.col("y").alias("x"), F.least("m", "x").alias("y"))


def _small(links: DataFrame, count: int) -> DataFrame:
    """Every neighbour below a node, and the node, are tied to the smallest of them."""
    down = _lowest(links.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")), count)
    return down.select(F.explode(F.array(F.struct(F.col("y").alias("x"), F.col("m").alias("y")), F.struct("x", F.col("m").alias("y")))).alias("_l")).select("_l.*")


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of links (x, y): label is the smallest node that can be reached."""
    spark = links.sparkSession
    now, path = materialise(links.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).filter("x <> y").distinct(), "links")
    seen, count = None, now.count()
    # The rounds grow as the square of the logarithm of the longest chain; each but the last changes something.
    while True:
        stars = _small(_large(now, count), count).filter("x <> y").distinct()
        after, after_path = materialise(stars, "links")
        # The links that are left are stars once nothing changes; sums of hashes tell.
        mark = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("x", "y").cast("decimal(20,0)"))).first()
        forget(spark, path)
        settle(spark)
        now, path = after, after_path
        if tuple(mark) == seen:
            return now.select(F.col("x").alias("node"), F.col("y").alias("label")).unionByName(now.select(F.col("y").alias("node"), F.col("y").alias("label")).distinct())
        seen, count = tuple(mark), mark[0]
