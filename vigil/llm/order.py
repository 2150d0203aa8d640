"""Positions of rows in a global order, without sorting in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vigil.settings import cut


def positions(rows: DataFrame, groups: list[str], order: list[str]) -> DataFrame:
    """`rows` with `pos`, the place of each row in its group by ascending `order` (from 0, nulls first), and `n`, the rows of the group.

    Rows are dealt by ranges of (groups, order) and written sorted; the rows of a group in each range are
    counted, and running sums of those few counts give every range its offset. A group of any size is
    spread over many ranges as long as `order` tells its rows apart. `rows` is read twice, so it should be
    a stored table. Ties in `order` get different places in no particular order.
    """
    keys = [*groups, *order]
    marked = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = cut(marked.withColumn("_piece", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), "placed")
    counts = placed.groupBy(*groups, "_piece").agg(F.count("*").alias("_rows"), F.min("_at").alias("_first"))
    whole = W.partitionBy(*groups)
    before = F.coalesce(F.sum("_rows").over(whole.orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(*(F.col(g).alias(f"_of_{g}") for g in groups), F.col("_piece").alias("_in"), (before - F.col("_first")).alias("_shift"), F.sum("_rows").over(whole).alias("n"))
    match = F.col("_piece") == F.col("_in")
    for g in groups:
        match = match & F.col(g).eqNullSafe(F.col(f"_of_{g}"))
    return placed.join(offsets, match).select(*rows.columns, (F.col("_at") + F.col("_shift")).alias("pos"), "n")
