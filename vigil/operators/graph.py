"""Call graph: transitive callees and direct callers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigil import constants as K
from vigil.settings import cut


def services_table(spark: SparkSession, services=K.SERVICES) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(s).alias("service"), F.lit(i).alias("service_order"), F.lit(d).alias("depth")) for i, (s, d) in enumerate(services)])
    return spark.range(1).select(F.explode(rows).alias("s")).select("s.*")


def calls_table(spark: SparkSession, calls=K.CALLS) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(a).alias("caller"), F.lit(b).alias("callee"), F.lit(s).alias("share"), F.lit(n).alias("per_request")) for a, b, s, n in calls])
    return spark.range(1).select(F.explode(rows).alias("s")).select("s.*")


def calls_of_traces(spans: DataFrame, trace: list[str], order: list[str], share: float) -> DataFrame:
    """caller, callee, calls from recorded spans (trace, order, service).

    A span is called by the one before it in its trace, if that is another service's. An edge counts if it
    makes at least `share` of all calls of its caller. Traces are short, so no task holds more than a few
    of them at a time; edges are counted before the shuffle.
    """
    line = Window.partitionBy(*trace).orderBy(*order)
    hops = spans.select(F.lag("service").over(line).alias("caller"), F.col("service").alias("callee"))
    edges = hops.filter("caller <> callee").groupBy("caller", "callee").agg(F.count(F.lit(1)).alias("calls"))
    total = F.sum("calls").over(Window.partitionBy("caller"))  # one row per pair of services
    return edges.withColumn("all", total).filter(F.col("calls") >= share * F.col("all")).drop("all")


def call_closure(calls: DataFrame) -> DataFrame:
    """caller, callee for every service reachable from the caller, cycles included.

    Known paths are joined with themselves, which doubles their length, until no new pair appears;
    pairs stay distinct, so parallel paths do not multiply.
    """
    reach = cut(calls.select("caller", "callee").distinct(), "reach")
    known, size = 0, reach.count()
    while size > known:
        onward = reach.select(F.col("caller").alias("callee"), F.col("callee").alias("target"))
        longer = reach.join(onward, "callee").select("caller", F.col("target").alias("callee"))
        reach = cut(reach.unionByName(longer).distinct(), "reach")
        known, size = size, reach.count()
    return reach


def callers_of(calls: DataFrame, service: str) -> DataFrame:
    return calls.filter(F.col("callee") == service).select("caller").distinct()
