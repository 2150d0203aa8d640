"""Approximate nearest neighbours by multiprobe p-stable hashing.

A table hashes a vector x with HASHES functions floor((a . x + b) / w), a drawn from the normal
distribution, which is 2-stable: over all a, a . (x - y) is normal with the distance |x - y| as deviation. So for a
query and a distance the chance that a row at this distance lies in a given bucket is a product of
HASHES normal probabilities. Buckets around the query's own are visited in the order of that chance until
the visited ones of a table hold a row at the query's k-th distance with the wanted chance; the k-th distance in a
bounded sample bounds the query's own from above. What the tables' buckets hold is compared exactly.

Rows of a table are ordered by bucket and cut into shards of SHARD rows, so near buckets share a shard and a
bucket of any size is spread. A query goes to the shards that hold buckets it visits, k rows come back.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vigil.llm.order import positions
from vigil.settings import cut

#: Hash tables, functions of each, and the width of a slot in k-th distances (ninth decile of the sample).
TABLES, HASHES, WIDTH = 2, 8, 2.25
#: Wanted chance that a row at the k-th distance is visited in some table.
SUCCESS = 0.95
#: Rows that distances are estimated from; rows of a shard and queries of a block, about.
SAMPLE, SHARD, BLOCK = 8192, 4096, 1024
#: Slots whose chance is below are never visited.
LEAST = 1e-3
#: Buckets that are weighed for a query at most; a query that is too far from its neighbours for that is compared with all rows.
MOST = 1 << 18
SEED = 20240613
_ZERO = 1 << 31


def functions(dim: int, table: int) -> tuple[np.ndarray, np.ndarray]:
    """Directions and offsets (in slots) of a table's hash functions; the same in every task."""
    rng = np.random.default_rng([SEED, dim, table])
    return rng.normal(size=(dim, HASHES)), rng.uniform(size=HASHES)


def _slots(points: np.ndarray, table: int, width: float) -> np.ndarray:
    """Place of each point on each function's axis, in slots."""
    a, b = functions(points.shape[1], table)
    return np.clip(points @ a / width + b, -_ZERO, _ZERO - 1)


def _keys(slots: np.ndarray) -> list[bytes]:
    """Buckets as bytes whose order is that of their slots."""
    raw = (np.asarray(slots, np.int64) + _ZERO).astype(">u4").tobytes()
    return [raw[k : k + 4 * HASHES] for k in range(0, len(raw), 4 * HASHES)]


_erf = np.vectorize(math.erf, otypes=[float])


def _chance(place: np.ndarray, slot: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """That a normal deviate around `place` with deviation `scale` (in slots) falls into [slot, slot + 1)."""
    below, above = (slot - place) / scale, (slot + 1 - place) / scale
    return 0.5 * (_erf(above / math.sqrt(2)) - _erf(below / math.sqrt(2)))


def probes(place: np.ndarray, scale: float, success: float) -> tuple[np.ndarray, float] | None:
    """Buckets to visit, the likeliest first, and the logarithm of the last one's chance; None where there would be more than MOST to weigh."""
    slots, logs = np.zeros((1, 0)), np.zeros(1)
    if scale > 10:
        return None
    for p in place:
        reach = int(math.ceil(4 * scale)) + 1
        near = np.floor(p) + np.arange(-reach, reach + 1)
        chance = _chance(p, near, scale)
        held = (chance >= LEAST) | (near == np.floor(p))
        if len(slots) * held.sum() > MOST:
            return None
        slots = np.concatenate([np.repeat(slots, held.sum(), axis=0), np.tile(near[held], len(slots))[:, None]], axis=1)
        logs = (logs[:, None] + np.log(np.maximum(chance[held], 1e-300))).ravel()
    order = np.argsort(-logs, kind="stable")
    n = min(len(order), int(np.searchsorted(np.cumsum(np.exp(logs[order])), success)) + 1)
    return slots[order[:n]], float(logs[order[n - 1]])


def _matrix(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float64).reshape(len(column), -1)


def distances(points: np.ndarray, query: np.ndarray) -> np.ndarray:
    gap = points - query
    return np.sqrt((gap * gap).sum(axis=1))


def _index(batches: Iterator[pa.RecordBatch], widths: dict[int, float]) -> Iterator[pa.RecordBatch]:
    """A row for each vector and table, with its bucket."""
    for batch in batches:
        frame = batch.to_pandas()
        for dim, rows in frame.groupby("dim"):
            points = _matrix(rows["v"])
            for table in range(TABLES):
                keys = _keys(np.floor(_slots(points, table, widths[dim])))
                yield pa.RecordBatch.from_pandas(pd.DataFrame({"table": np.int32(table), "dim": np.int32(dim), "bucket": keys, "vec_id": rows["vec_id"], "v": rows["v"]}), preserve_index=False)


def _probe(batches: Iterator[pa.RecordBatch], widths: dict[int, float], sample: dict[int, tuple], k: int, success: float) -> Iterator[pa.RecordBatch]:
    """Of each query the buckets it visits in each table; none where the sample holds fewer than k others or they are too far."""
    each = 1 - (1 - success) ** (1 / TABLES)
    for batch in batches:
        for row in batch.to_pandas().itertuples():
            ids, points = sample[row.dim]
            query = np.frombuffer(row.v, np.float64)
            far = np.sort(distances(points[ids != row.vec_id], query))[:k]
            if len(far) < k:
                continue
            scale = max(far[-1], 1e-9 * widths[row.dim]) / widths[row.dim]
            visits = [probes(_slots(query[None, :], table, widths[row.dim])[0], scale, each) for table in range(TABLES)]
            for table, (found, last) in enumerate([] if None in visits else visits):
                out = pd.DataFrame({"query_id": row.vec_id, "table": np.int32(table), "dim": np.int32(row.dim), "bucket": _keys(found), "scale": scale, "last": last - 1e-9, "q": [row.v] * len(found)})
                yield pa.RecordBatch.from_pandas(out, preserve_index=False)


def _nearest(queries: pd.DataFrame, rows: pd.DataFrame, widths: dict[int, float], k: int) -> pd.DataFrame:
    """k nearest of a shard's rows in visited buckets for each query of a block."""
    out = []
    if len(queries) and len(rows):
        table, points, ids = int(rows["table"].iloc[0]), _matrix(rows["v"]), rows["vec_id"].to_numpy(np.int64)
        width = widths[points.shape[1]]
        buckets, of = np.unique(rows["bucket"].to_numpy(object), return_inverse=True)
        slots = np.frombuffer(b"".join(buckets), ">u4").reshape(len(buckets), HASHES).astype(np.int64) - _ZERO
        squares = (points * points).sum(1)
        for name, blob, scale, last in zip(queries["query_id"].tolist(), queries["q"], queries["scale"].tolist(), queries["last"].tolist(), strict=True):
            query = np.frombuffer(blob, np.float64)
            open_ = ids != name
            if last == last:  # NaN: all buckets
                place = _slots(query[None, :], table, width)[0]
                logs = np.zeros(len(buckets))
                for j in range(HASHES):
                    values, at = np.unique(slots[:, j], return_inverse=True)
                    logs += np.log(np.maximum(_chance(place[j], values, scale), 1e-300))[at]
                open_ &= (logs >= last)[of]
            at = np.flatnonzero(open_)
            if len(at) > k:
                # products are inexact: what is as near as the k-th up to their error is compared exactly
                rough = squares[at] + query @ query - 2 * (points[at] @ query)
                slack = 1e-9 * (query @ query + squares[at].max())
                at = at[rough <= np.partition(rough, k - 1)[k - 1] + slack]
            exact = distances(points[at], query)
            best = np.lexsort((ids[at], exact))[:k]
            out += zip([name] * len(best), ids[at][best].tolist(), exact[best].tolist(), strict=True)
    return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})


def _searched(hits: DataFrame, index: DataFrame, widths: dict[int, float], k: int) -> DataFrame:
    """query_id, vec_id, score of k rows for each hit (query and shard); a shard meets its queries in blocks."""
    key = ["table", "dim", "shard"]
    hits = cut(hits, "hits")
    blocks = cut(hits.groupBy(*key).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "blocks")
    dealt = hits.join(blocks, key).withColumn("block", F.expr("cast(pmod(xxhash64(query_id), blocks) as int)"))
    copies = index.join(blocks, key).withColumn("block", F.explode(F.expr("sequence(0, blocks - 1)")))
    dealt, copies = dealt.toDF(*dealt.columns), copies.toDF(*copies.columns)  # columns of their own on either side
    both = dealt.groupBy(*key, "block").cogroup(copies.groupBy(*key, "block"))
    return both.applyInPandas(lambda q, x: _nearest(q, x, widths, k), "query_id long, vec_id long, score double")


def nearest_neighbours(vectors: DataFrame, queries: str = "vec_id % 100 = 0", k: int = 10, success: float = SUCCESS, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest rows found for each query row, by Euclidean distance.

    Equal distances go to the smaller vec_id. Recall at the k-th distance is `success` at least on average;
    a query for which fewer than k rows are found though there are more, or whose neighbours are too far for the
    width of the slots (ninth decile of the sample), is compared with all rows. A row is
    no candidate of queries with its own id; rows and queries that share an id count with their least
    distance. Vectors that are null, empty or zero or hold null or non-finite components take no part, nor do
    rows without vec_id; vectors of different lengths never meet. Other columns are not read. An
    empty table gives no rows.
    """
    e = F.col("e")
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    read = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("e"))
    valid = read.where("vec_id is not null").where(F.coalesce(fine, F.lit(False))).withColumn("dim", F.size("e"))
    rows = cut(valid.mapInArrow(_packed, "vec_id long, dim int, v binary"), "vectors")
    # a bounded sample, the same rows on every run, of which distances are learned
    taken = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toPandas()
    sizes = {r["dim"]: r["n"] for r in rows.groupBy("dim").agg(F.countDistinct("vec_id").alias("n")).collect()}
    sample, widths = {}, {}
    for dim in sizes:
        some = taken[taken["dim"] == dim]
        points = _matrix(some["v"]) if len(some) else np.empty((0, dim))
        sample[dim] = some["vec_id"].to_numpy(np.int64), points
        kth = [np.sort(distances(points, p))[min(k, len(points) - 1)] for p in points[:256]]
        # the ninth decile, so that large groups of near copies do not set the width
        usual = float(np.quantile(kth, 0.9)) if kth else 0.0
        widths[dim] = WIDTH * (usual if usual > 0 else 1.0)
    spark = rows.sparkSession
    known = spark.sparkContext.broadcast(sample)
    made = rows.mapInArrow(lambda b: _index(b, widths), "table int, dim int, bucket binary, vec_id long, v binary")
    placed = positions(cut(made, "buckets"), ["table", "dim"], ["bucket", "vec_id"])
    index = cut(placed.select("table", "dim", "bucket", "vec_id", "v", F.expr(f"cast(pos div {SHARD} as int)").alias("shard")), "index")
    found_at = index.groupBy("table", "dim", "bucket").agg(F.min("shard").alias("first"), F.max("shard").alias("last_shard"))
    asked = rows.where(queries)
    visits = asked.mapInArrow(lambda b: _probe(b, widths, known.value, k, success), "query_id long, table int, dim int, bucket binary, scale double, last double, q binary")
    visits = visits.join(found_at, ["table", "dim", "bucket"]).withColumn("shard", F.explode(F.expr("sequence(first, last_shard)")))
    hits = visits.select("query_id", "table", "dim", "shard", "scale", "last", "q").distinct()
    least = lambda d: d.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    found = cut(least(_searched(hits, index, widths, k)), "found")
    counts = found.groupBy("query_id").agg(F.count("*").alias("n"))
    there = F.lit(0)
    for dim, n in sizes.items():
        there = F.when(F.col("dim") == dim, F.lit(min(k, n - 1))).otherwise(there)
    named = asked.select(F.col("vec_id").alias("query_id"), "dim", F.col("v").alias("q"))
    short = cut(named.join(counts, "query_id", "left").where(F.coalesce("n", F.lit(0)) < there), "short")
    if not short.isEmpty():
        shards = index.where("table = 0").groupBy("table", "dim").agg(F.max("shard").alias("most"))
        every = short.join(shards, "dim").withColumn("shard", F.explode(F.expr("sequence(0, most)")))
        rest = _searched(every.select("query_id", "table", "dim", "shard", F.lit(1.0).alias("scale"), F.lit(float("nan")).alias("last"), "q").distinct(), index, widths, k)
        found = least(found.unionByName(rest))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(f"rank <= {k}").select("query_id", "rank", "vec_id", "score")


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Components as bytes of doubles."""
    for batch in batches:
        e = batch.column("e")
        flat, starts = e.values.to_numpy(zero_copy_only=False).astype(float), e.offsets.to_numpy()
        blobs = [flat[a:b].tobytes() for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("dim"), pa.array(blobs, pa.binary())], ["vec_id", "dim", "v"])
