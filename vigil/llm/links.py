"""Connected components of a link table, as joins and minima over tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.settings import cut


def _towards_least(pairs: DataFrame) -> DataFrame:
    """Each pair (u, v) becomes (v, m), m being the least of u and all that u is paired with.

    The join is never a broadcast: stored pairs are far larger in memory than on disk, by which Spark would choose it.
    """
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(least.hint("merge"), "u")


def components(edges: DataFrame) -> DataFrame:
    """Columns node, root: for every end of an edge (a, b) the smallest node it is connected to.

    Alternates the large and the small star until nothing changes: each round halves the depth at
    least, so the rounds grow with the logarithm of the longest chain. Every round is a pair of
    aggregations and joins; no component is gathered anywhere. Nulls and loops are ignored.
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _towards_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = _towards_least(large)
        now = cut(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "edges")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1000003), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == seen:
            break
        seen = state
    return now.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root").unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
