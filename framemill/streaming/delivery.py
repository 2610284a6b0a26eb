"""Delivery: framed messages, chunks, sink choice, and the newest peer as streaming state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions.exprs import le_bytes

CHUNK = 64 * 1024
#: Peers by the user id they run as.
LOWEST_UID, HIGHEST_UID = 10000, 19999


def frame(messages: DataFrame) -> DataFrame:
    """messages (seq, magic, body) with ``wire``: magic and length as little-endian 32-bit integers, then the body."""
    size = F.octet_length("body")
    return messages.withColumn("body_len", size.cast("bigint")).withColumn("wire", F.concat(le_bytes(F.col("magic"), 4), le_bytes(size, 4), F.col("body")))


def chunks(framed: DataFrame, size: int = CHUNK) -> DataFrame:
    """seq, chunk, data: the wire bytes in pieces of at most size."""
    last = F.floor((F.greatest(F.octet_length("wire"), F.lit(1)) - 1) / size).cast("int")
    c = framed.withColumn("chunk", F.explode(F.sequence(F.lit(0), last)))
    return c.select("seq", "chunk", F.substring(F.col("wire"), F.col("chunk") * size + 1, F.lit(size)).alias("data"))


def sink_route(peer: Column, path: Column) -> Column:
    """A connected peer gets the stream; else a path gets a file; else nothing is written."""
    return F.when(peer.isNotNull(), "stream").when(F.coalesce(path, F.lit("")) != "", "file").otherwise("noop")


def jpeg_path(path: Column) -> Column:
    """The sibling of a path: its extension, if its last part has one, becomes .jpg."""
    return F.concat(F.regexp_replace(path, "\\.[^./]*$", ""), F.lit(".jpg"))


def admitted(connections: DataFrame) -> DataFrame:
    """Connections whose column uid is that of an app; others are closed at once and replace nobody."""
    return connections.filter(F.col("uid").between(LOWEST_UID, HIGHEST_UID))


def has_peer(events: DataFrame) -> DataFrame:
    """events (endpoint, ts, seq, peer, open) -> endpoint, peer, has_peer.

    A connection replaces the one before; an end counts only if it is that of the newest
    connection, as an older one has been closed already.
    """
    at = F.struct("ts", "seq")
    newest = events.groupBy("endpoint").agg(F.max_by("peer", F.when(F.col("open"), at)).alias("_peer"), F.max(F.when(F.col("open"), at)).alias("_since"))
    ends = events.filter(~F.col("open")).groupBy("endpoint", "peer").agg(F.max(at).alias("_end")).withColumnRenamed("peer", "_peer")
    on = F.col("_peer").isNotNull() & (F.col("_end").isNull() | (F.col("_end") < F.col("_since")))
    return newest.join(ends, ["endpoint", "_peer"], "left").select("endpoint", F.when(on, F.col("_peer")).alias("peer"), on.alias("has_peer"))


def start(stream: DataFrame, name: str, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """The running query of that name, started if there is none: a second start changes nothing."""
    for query in stream.sparkSession.streams.active:
        if query.name == name:
            return query
    return stream.writeStream.queryName(name).option("checkpointLocation", checkpoint).foreachBatch(sink).start()


def newest_peer(events: DataFrame) -> DataFrame:
    """One row: the peer that connected last; ties go to the larger sequence number."""
    return events.agg(F.max_by("peer", F.struct("ts", "seq")).alias("peer"), F.max("ts").alias("since"), F.count(F.lit(1)).alias("connections"))


class NewestPeer(StatefulProcessor):
    """Keeps the newest peer of each endpoint and emits it when it changes."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("peer", "ts timestamp, seq long, peer long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator:  # noqa: N802, N803
        from pyspark.sql import Row

        old = self.state.get() if self.state.exists() else None
        best = tuple(old) if old is not None else None
        for r in rows:
            now = (r["ts"], r["seq"], r["peer"])
            if best is None or now[:2] > best[:2]:
                best = now
        if best is not None and (old is None or tuple(old) != best):
            self.state.update(best)
            yield Row(endpoint=key[0], ts=best[0], seq=best[1], peer=best[2])

    def close(self) -> None:
        pass


def newest_peers(connections: DataFrame) -> DataFrame:
    """A stream of connections (endpoint, ts, seq, peer) -> the newest peer of each endpoint, whenever it changes."""
    return connections.groupBy("endpoint").transformWithState(NewestPeer(), "endpoint string, ts timestamp, seq long, peer long", "Update", "None")


def watch_frames(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of RAW files as they arrive in a folder: path, modificationTime, content."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).load(folder)
