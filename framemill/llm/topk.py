"""Exact top-k by inner product with ball trees.

Candidates are dealt into cells by the nearest of at most ``CELLS`` centres, which
come from a ball tree over a bounded sample; a cell with too many candidates for
one task has several shards.  A cell is a ball, and a task builds a ball tree over
its shard.  For a query q and a ball with centre c and radius r no member scores
above q.c + |q| r.

The kth score is shared between shards in two rounds.  First every query searches
one shard of its most promising cell; its kth score there is a lower bound that
holds everywhere.  Then it goes only to the shards of cells whose bound is not
below that, and every shard searches from that bound on.

Inside a shard the nodes wait in a queue, ordered by the highest bound that any of
their queries has.  The first node leaves out the queries whose bound has fallen
below their kth score so far; a leaf scores its rows for the rest, an inner node
hands them to its children.

Defined cases: a vector that is null, empty or holds null or a non-finite
component takes no part, nor does a row without id; vectors meet only vectors of
their own length; repeated rows are separate candidates, a query leaves out one
row of its own id and vector; fewer candidates than k give fewer rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .shared import forget, materialise

#: Rows of a shard at most about, queries of a task, rows of a leaf, queries that descend together.
SHARD = 65536
BLOCK = 16384
LEAF = 64
TOGETHER = 2048
#: Cells of the vectors of one length at most, and rows of the sample that their centres come from.
CELLS = 256
SAMPLE = 20000


class BallTree:
    """Leaves hold rows order[lo:hi]; every node a centre and a radius."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.points = points
        self.order = np.arange(len(points))
        self.centre: list[np.ndarray] = []
        self.radius: list[float] = []
        self.span: list[tuple[int, int]] = []
        self.children: list[tuple[int, int] | None] = []
        todo = [(self._node(0, len(points)), 0, len(points))]
        while todo:
            node, lo, hi = todo.pop()
            rows = points[self.order[lo:hi]]
            if hi - lo <= leaf or self.radius[node] == 0:
                continue
            far = rows[np.argmax(((rows - self.centre[node]) ** 2).sum(1))]
            other = rows[np.argmax(((rows - far) ** 2).sum(1))]
            side = np.argsort(rows @ (other - far), kind="stable")
            self.order[lo:hi] = self.order[lo:hi][side]
            mid = (lo + hi) // 2
            a, b = self._node(lo, mid), self._node(mid, hi)
            self.children[node] = (a, b)
            todo += [(a, lo, mid), (b, mid, hi)]

    def _node(self, lo: int, hi: int) -> int:
        rows = self.points[self.order[lo:hi]]
        centre = rows.mean(0) if hi > lo else np.zeros(self.points.shape[1])
        self.centre.append(centre)
        self.radius.append(float(np.sqrt(((rows - centre) ** 2).sum(1).max())) if hi > lo else 0.0)
        self.span.append((lo, hi))
        self.children.append(None)
        return len(self.span) - 1

    def bound(self, node: int, queries: np.ndarray, norms: np.ndarray) -> np.ndarray:
        """No member of the node scores above this."""
        return ball_bound(queries, norms, self.centre[node][None, :], np.array([self.radius[node]]))[:, 0]


def ball_bound(queries: np.ndarray, norms: np.ndarray, centres: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """bound[q, c]: no point of ball c scores above it with query q, rounding included."""
    room = 1e-9 * norms[:, None] * (np.sqrt((centres**2).sum(1)) + radii + 1) + 1e-6
    return queries @ centres.T + norms[:, None] * radii + room


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows: in floating point while that is exact, then in 64-bit or Python integers."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2.0**53:
        return a @ b.T
    exact = object if most >= 2.0**62 else np.int64
    return a.astype(exact) @ b.astype(exact).T


def _search(tree: BallTree, queries: np.ndarray, floor: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of everything that is not below its query's kth score; own: the row that a query leaves out, or -1."""
    floor, norms = floor.copy(), np.sqrt((queries**2).sum(1))
    best = np.full((len(queries), k), -np.inf)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for begin in range(0, len(queries), TOGETHER):
        every = np.arange(begin, min(len(queries), begin + TOGETHER))
        bound = tree.bound(0, queries[every], norms[every])
        queue = [(-float(bound.max()), 0, every, bound)]
        while queue:
            _, node, who, bound = heapq.heappop(queue)
            open_ = bound >= floor[who]
            who, bound = who[open_], bound[open_]
            if not len(who):
                continue
            children = tree.children[node]
            if children is not None:
                for child in children:
                    # What bounds a node bounds its children too.
                    lower = np.minimum(bound, tree.bound(child, queries[who], norms[who]))
                    heapq.heappush(queue, (-float(lower.max()), child, who, lower))
                continue
            lo, hi = tree.span[node]
            for at in range(lo, hi, 4096):  # a leaf of equal points may be large
                rows = tree.order[at : min(hi, at + 4096)]
                scores = _product(queries[who], tree.points[rows])
                near = scores.astype(np.float64)
                near[own[who][:, None] == rows[None, :]] = -np.inf
                q, r = np.nonzero((near >= floor[who][:, None]) & (near > -np.inf))
                found.append((who[q], rows[r], scores[q, r]))
                top = np.partition(np.concatenate([best[who], near], axis=1), -k, axis=1)[:, -k:]
                best[who] = top
                floor[who] = np.maximum(floor[who], top.min(axis=1))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    query, row, score = (np.concatenate(x) for x in zip(*found, strict=True))
    good = score.astype(np.float64) >= floor[query]
    return query[good], row[good], score[good]


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(np.float64)


def _shard(cand: pd.DataFrame, asks: pd.DataFrame, k: int) -> pd.DataFrame:
    """What one shard has for one block of queries."""
    if not len(cand) or not len(asks):
        return pd.DataFrame({c: pd.Series([], dtype="int32" if c == "copy" else "int64") for c in ("query_id", "copy", "vec_id", "score")})
    cand, asks = cand.sort_values("vec_id"), asks.sort_values(["vec_id", "copy"])
    ids = cand["vec_id"].to_numpy()
    same = {key: r for r, key in enumerate(zip(ids.tolist(), cand["copy"].tolist(), strict=True))}
    own = np.array([same.get(key, -1) for key in zip(asks["vec_id"].tolist(), asks["copy"].tolist(), strict=True)])
    q, rows, scores = _search(BallTree(_matrix(cand["v"])), _matrix(asks["v"]), asks["floor"].to_numpy(np.float64), own, k)
    return pd.DataFrame({"query_id": asks["vec_id"].to_numpy()[q], "copy": asks["copy"].to_numpy()[q], "vec_id": ids[rows], "score": scores.astype(np.int64)})


def centres(v: DataFrame, cells: int = CELLS) -> dict[int, np.ndarray]:
    """For each length of vectors the centres of its cells: leaves of a ball tree over a sample of SAMPLE rows."""
    n = max(1, v.count())
    some = v.select("v").sample(min(1.0, 2.0 * SAMPLE / n), seed=5).limit(SAMPLE).toPandas()["v"] if n > SAMPLE else v.select("v").toPandas()["v"]
    out = {}
    for dim in sorted({len(x) for x in some}):
        points = _matrix(some[[len(x) == dim for x in some]])
        tree = BallTree(points, leaf=max(1, -(-2 * len(points) // cells)))
        out[dim] = np.stack([c for c, child in zip(tree.centre, tree.children, strict=True) if child is None])
    return out


def _cell(v: DataFrame, made: dict[int, np.ndarray]) -> DataFrame:
    """v with ``cell`` and the distance to its centre; lengths that the sample missed have one cell around zero."""
    shared = v.sparkSession.sparkContext.broadcast(made)  # at most SAMPLE vectors

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            cell, far = np.zeros(len(pdf), np.int32), np.zeros(len(pdf))
            dims = pdf["dim"].to_numpy()
            for dim in np.unique(dims):
                mine = np.flatnonzero(dims == dim)
                at = shared.value.get(int(dim), np.zeros((1, int(dim))))
                for lo in range(0, len(mine), 4096):
                    rows = mine[lo : lo + 4096]
                    points = _matrix(pdf["v"].iloc[rows])
                    cell[rows] = np.argmin((at**2).sum(1) - 2 * points @ at.T, axis=1)
                    far[rows] = np.sqrt(((points - at[cell[rows]]) ** 2).sum(1))
            yield pdf.assign(cell=cell, far=far)

    return v.mapInPandas(work, StructType(list(v.schema.fields)).add("cell", "integer").add("far", "double"))


def quantised(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """(vec_id, v): vectors whose components are all finite, as floor(scale * x); copy tells repeated ids apart."""
    good = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    v = vectors.filter(good).filter(finite).select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"))
    return v.withColumn("copy", F.row_number().over(Window.partitionBy("vec_id").orderBy(F.xxhash64("v"))))


def search(vectors: DataFrame, query: Column, k: int = 20, scale: int = 64) -> DataFrame:
    """query_id, copy, rank, vec_id, score: the k best candidates of every row for which query holds."""
    v, p1 = materialise(quantised(vectors, scale).withColumn("dim", F.size("v")), "topk-vectors")
    made = centres(v)
    spark = v.sparkSession
    cand, _ = materialise(_cell(v, made), "topk-cells")
    forget(spark, p1)
    # A row for each cell: CELLS for each length that the sample has, and one for each other.
    balls = {(r["dim"], r["cell"]): (r["far"], -(-r["n"] // SHARD), r["n"]) for r in cand.groupBy("dim", "cell").agg(F.max("far").alias("far"), F.count(F.lit(1)).alias("n")).collect()}
    facts = spark.sparkContext.broadcast((made, balls))
    spot = lambda of, seed: F.pmod(F.xxhash64("vec_id", "copy", F.lit(seed)), of).cast("int")
    shards = spark.createDataFrame([(d, c, s) for (d, c), (_, s, _) in balls.items()], "dim int, cell int, shards int")
    dealt = cand.join(F.broadcast(shards), ["dim", "cell"]).select("dim", "cell", spot(F.col("shards"), "shard").alias("shard"), "vec_id", "copy", "v")

    def visits(asks: DataFrame, first: bool) -> DataFrame:
        """A row for each query and shard that it visits."""

        def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            made, balls = facts.value
            for pdf in parts:
                for dim in pdf["dim"].unique():
                    cells = [(c, *ball) for (d, c), ball in sorted(balls.items()) if d == dim]
                    at = made.get(int(dim), np.zeros((1, int(dim))))[[c[0] for c in cells]]
                    radius, count = np.array([c[1] for c in cells]), np.array([c[2] for c in cells])
                    mine = pdf[pdf["dim"] == dim]
                    for lo in range(0, len(mine), 1024):
                        rows = mine.iloc[lo : lo + 1024]
                        points = _matrix(rows["v"])
                        bound = ball_bound(points, np.sqrt((points**2).sum(1)), at, radius)
                        if first:
                            # Cells that can fill k places come first.
                            full = np.array([c[3] // c[2] > k for c in cells])
                            q, c = np.arange(len(rows)), np.argmax(bound + np.where(full, 0, -1e18), axis=1)
                            shard = rows["vec_id"].to_numpy() % count[c]
                        else:
                            q, c = np.nonzero(bound >= rows["floor"].to_numpy()[:, None])
                            times = count[c]
                            q, c = np.repeat(q, times), np.repeat(c, times)
                            shard = np.arange(len(q)) - np.repeat(np.cumsum(times) - times, times)
                        yield rows.iloc[q].assign(cell=np.array([x[0] for x in cells], np.int32)[c], shard=shard.astype(np.int32))

        return asks.mapInPandas(work, StructType(list(asks.schema.fields)).add("cell", "integer").add("shard", "integer"))

    def against(asks: DataFrame, first: bool, name: str) -> DataFrame:
        seen, _ = materialise(visits(asks, first), name)
        blocks = seen.groupBy("dim", "cell", "shard").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
        at = ["dim", "cell", "shard", "block"]
        ours = seen.join(blocks, at[:3]).withColumn("block", spot(F.col("blocks"), "block")).drop("blocks")
        # Only shards that are asked send their candidates, once for each block of queries.
        theirs = dealt.join(blocks.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks"), at[:3])
        found = theirs.groupBy(*at).cogroup(ours.groupBy(*at)).applyInPandas(lambda c, q: _shard(c, q, k), "query_id long, copy int, vec_id long, score long")
        best = Window.partitionBy("query_id", "copy").orderBy(F.col("score").desc(), F.col("vec_id"))
        return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)

    asks = cand.filter(query).select("dim", "vec_id", "copy", "v")
    lowest = against(asks.withColumn("floor", F.lit(float("-inf"))), True, "topk-first").filter(F.col("rank") == k)
    floors, _ = materialise(lowest.select(F.col("query_id").alias("vec_id"), "copy", F.col("score").cast("double").alias("floor")), "topk-floors")
    asks = asks.join(floors, ["vec_id", "copy"], "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
    return against(asks.select("dim", "vec_id", "copy", "v", "floor"), False, "topk-visits")
