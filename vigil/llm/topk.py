"""Exact top-k inner products: KD-trees per shard, searched best first.

Rows are dealt into shards of bounded size; each shard is one KD-tree (median splits of the dimension with
the widest spread) whose nodes have tight bounding boxes. A box's bound is the largest inner product that
a point in it could have with the query. Nodes are visited by falling bound until the bound is below the
k-th score found. Queries come in blocks of bounded size; a first search in one shard gives each query a
k-th score, which is handed to the search of all others.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vigil.settings import cut

#: Rows of a shard, queries of a block, and points of a leaf, about.
SHARD, BLOCK, LEAF = 8192, 512, 64


class Tree:
    """points and ids in the order of the leaves; node k has the children 2k + 1 and 2k + 2."""

    def __init__(self, points: np.ndarray, ids: np.ndarray, leaf: int = LEAF):
        self.depth = max(0, int(np.ceil(np.log2(max(1, len(points)) / leaf))))
        order, self.spans = np.arange(len(points)), [(0, len(points))]
        for _ in range(self.depth):
            level = self.spans[-(len(self.spans) + 1) // 2 :]
            for lo, hi in level:
                mid = (lo + hi) // 2
                if hi - lo > 1:
                    part = points[order[lo:hi]]
                    axis = int(np.argmax(part.max(0) - part.min(0)))
                    order[lo:hi] = order[lo:hi][np.argpartition(part[:, axis], mid - lo)]
                self.spans += [(lo, mid), (mid, hi)]
        self.points, self.ids = points[order], ids[order]
        empty = np.full(points.shape[1], 0.0)
        self.low = np.array([self.points[a:b].min(0) if b > a else empty for a, b in self.spans])
        self.high = np.array([self.points[a:b].max(0) if b > a else empty for a, b in self.spans])

    def search(self, queries: np.ndarray, names: np.ndarray, floors: np.ndarray, k: int) -> list[tuple[int, int, int]]:
        """(query, id, score) of up to k best points per query with a score of `floors` at least; ties to the smaller id."""
        bounds = np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T
        out, inner = [], (1 << self.depth) - 1
        for q, name, floor, bound in zip(queries, names.tolist(), floors.tolist(), bounds.tolist(), strict=True):
            best: list[tuple] = []  # a heap of (score, -id): the worst first
            todo = [(-bound[0], 0)]
            while todo:
                above, node = heapq.heappop(todo)
                if -above < floor:
                    break
                if node < inner:
                    for child in (2 * node + 1, 2 * node + 2):
                        if bound[child] >= floor:
                            heapq.heappush(todo, (-bound[child], child))
                    continue
                a, b = self.spans[node]
                scores = self.points[a:b] @ q
                for at in np.flatnonzero(scores >= floor).tolist():
                    item = (scores[at], -int(self.ids[a + at]))
                    if item[1] == -name:
                        continue
                    if len(best) < k:
                        heapq.heappush(best, item)
                    elif item > best[0]:
                        heapq.heapreplace(best, item)
                    if len(best) == k:
                        floor = max(floor, best[0][0])
            out += [(name, -i, int(s)) for s, i in best]
        return out


def _matrix(blob: bytes, dim: int) -> np.ndarray:
    """Integers as doubles, which are exact while every product sum stays below 2 ** 53; else as Python integers."""
    found = np.frombuffer(blob, np.int64).reshape(-1, dim)
    return found.astype(float) if float(np.abs(found.astype(float)).max(initial=0)) ** 2 * dim < 2**53 else found.astype(object)


def _pack(group: pd.DataFrame) -> pd.DataFrame:
    """The rows of one shard or block as one row of bytes."""
    group = group.sort_values("vec_id")
    points = np.array(group["v"].to_list(), np.int64)
    return pd.DataFrame({"part": [group["part"].iloc[0]], "dim": [points.shape[1]], "ids": [group["vec_id"].to_numpy(np.int64).tobytes()], "points": [points.tobytes()]})


def _search(frames: Iterator[pd.DataFrame], k: int) -> Iterator[pd.DataFrame]:
    tree, of = None, None
    for frame in frames:
        for row in frame.itertuples():
            if of != (row.dim, row.shard):
                tree, of = Tree(_matrix(row.points, row.dim), np.frombuffer(row.ids, np.int64)), (row.dim, row.shard)
            queries, names = _matrix(row.q_points, row.dim), np.frombuffer(row.q_ids, np.int64)
            floors = np.full(len(names), -np.inf) if row.floors is None else np.frombuffer(row.floors, float)
            found = tree.search(queries, names, floors, k)
            if found:
                yield pd.DataFrame(found, columns=["query_id", "vec_id", "score"])


def _floors(group: pd.DataFrame) -> pd.DataFrame:
    """Of one block: its ids, and for each the k-th score known so far (or minus infinity)."""
    first = group[group["q_ids"].notna()].iloc[0]
    names = np.frombuffer(first["q_ids"], np.int64)
    known = dict(zip(group["query_id"].to_list(), group["floor"].to_list(), strict=True))
    floors = np.array([known.get(n, -np.inf) for n in names.tolist()], float)
    return pd.DataFrame({"dim": [first["dim"]], "block": [first["block"]], "floors": [floors.tobytes()]})


def top_inner_products(vectors: DataFrame, queries: str = "vec_id % 50 = 0", k: int = 5, scale: float = 256.0, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each query row its k best other rows by inner product of floor(scale * x).

    Equal scores go to the smaller vec_id; a query with fewer candidates has fewer rows. Vectors that are
    null or empty or hold null or non-finite components take no part, nor do rows without vec_id; vectors
    of different lengths never meet. Scores are exact while they fit a long. vec_id is unique. Other columns
    are not read; an empty table gives no rows.
    """
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("e")).where("vec_id is not null")
    finite = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (F.size("e") > 0)
    rows = rows.where(F.coalesce(finite, F.lit(False))).select("vec_id", F.size("e").alias("dim"), F.transform("e", lambda x: F.floor(x * scale).cast("long")).alias("v"))
    rows = cut(rows, "integers")

    def packed(some: DataFrame, size: int, name: str) -> DataFrame:
        parts = some.groupBy("dim").agg(F.ceil(F.count("*") / size).cast("int").alias("parts"))
        dealt = some.join(parts, "dim").withColumn("part", F.expr("cast(pmod(xxhash64(vec_id), parts) as int)"))
        made = dealt.groupBy("dim", "part").applyInPandas(_pack, "part int, dim int, ids binary, points binary")
        return cut(made.withColumnRenamed("part", name), name)

    shards, blocks = packed(rows, SHARD, "shard"), packed(rows.where(queries), BLOCK, "block").withColumnsRenamed({"ids": "q_ids", "points": "q_points"})
    kind = "query_id long, vec_id long, score long"
    counted = shards.groupBy("dim").agg(F.max("shard").alias("last"))
    meet = blocks.join(counted, "dim")
    home = meet.withColumn("shard", F.expr("cast(pmod(block, last + 1) as int)")).join(shards, ["dim", "shard"]).withColumn("floors", F.lit(None).cast("binary"))
    first = cut(home.mapInPandas(lambda frames: _search(frames, k), kind), "first")
    kth = first.groupBy("query_id").agg(F.min("score").alias("floor"), F.count("*").alias("n")).where(f"n >= {k}").drop("n")
    blocked = rows.where(queries).select(F.col("vec_id").alias("query_id"), "dim")
    parts = blocked.groupBy("dim").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    of = blocked.join(parts, "dim").withColumn("block", F.expr("cast(pmod(xxhash64(query_id), parts) as int)")).join(kth, "query_id").select("dim", "block", "query_id", F.col("floor").cast("double").alias("floor"), F.lit(None).cast("binary").alias("q_ids"))
    heads = blocks.select("dim", "block", F.lit(None).cast("long").alias("query_id"), F.lit(None).cast("double").alias("floor"), "q_ids")
    floors = of.unionByName(heads).groupBy("dim", "block").applyInPandas(_floors, "dim int, block int, floors binary")
    spread = meet.join(floors, ["dim", "block"]).withColumn("shard", F.explode(F.expr("sequence(0, last)")))
    found = spread.repartition("dim", "shard", "block").join(shards, ["dim", "shard"]).mapInPandas(lambda frames: _search(frames, k), kind)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(f"rank <= {k}").select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e::DOUBLE[], c.e::DOUBLE[]) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
