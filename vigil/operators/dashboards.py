"""Dashboard aggregates over request and prediction logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil import constants as K


def counter_increase(log: DataFrame, label: str, window_s: int = 3600, slide_s: int = 300) -> DataFrame:
    """Events per label in the `window_s` up to each slide point, and per second.

    Counted per slide first; the overlapping windows then add up a few counts instead of copying every
    event window/slide times.
    """
    n = window_s // slide_s
    point = (F.floor(F.unix_seconds("ts") / slide_s) * slide_s + slide_s).cast("long")
    per_slide = log.groupBy(label, point.alias("p")).agg(F.count(F.lit(1)).alias("n"))
    spread = per_slide.withColumn("end", F.explode(F.sequence(F.col("p"), F.col("p") + (n - 1) * slide_s, F.lit(slide_s).cast("long"))))
    return (
        spread.groupBy(label, "end")
        .agg(F.sum("n").alias("increase"))
        .select(label, F.timestamp_seconds("end").alias("ts"), "increase", (F.col("increase") / float(window_s)).alias("per_second"))
    )


def _buckets(bounds: list[float]) -> Column:
    return F.array(*[F.lit(float(b)) for b in bounds], F.lit(float("inf")))


def cumulative_histogram(log: DataFrame, keys: list[str], value: str, bounds: list[float]) -> DataFrame:
    """Cumulative bucket counts per key: keys, le, count.

    Values are counted per bucket once and the running sum is over a dozen buckets.
    """
    slot = F.size(F.filter(F.array(*[F.lit(float(b)) for b in bounds]), lambda b: b < F.col(value)))
    counts = log.select(*keys, slot.alias("slot")).groupBy(*keys, "slot").agg(F.count(F.lit(1)).alias("n"))
    per_key = counts.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("slot", "n"))).alias("m"))
    rows = per_key.select(*keys, "m", F.posexplode(_buckets(bounds)).alias("i", "le"))
    upto = F.aggregate(
        F.sequence(F.lit(0), F.col("i")), F.lit(0).cast("long"), lambda a, s: a + F.coalesce(F.element_at(F.col("m"), s), F.lit(0).cast("long"))
    )
    return rows.select(*keys, "le", upto.alias("count"))


def histogram_quantile(histogram: DataFrame, keys: list[str], q: float) -> DataFrame:
    """Quantile interpolated inside its bucket; beyond the last bound, that bound."""
    buckets = histogram.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("le", "count"))).alias("b"))
    total = F.element_at("b", -1)["count"]
    rank = F.lit(q) * total
    i = F.size(F.filter("b", lambda x: x["count"] < rank))  # 0-based bucket holding the rank
    at = lambda k: F.get("b", k)
    low_le = F.when(i == 0, 0.0).otherwise(at(i - 1)["le"])
    low_n = F.when(i == 0, F.lit(0)).otherwise(at(i - 1)["count"])
    inside = low_le + (at(i)["le"] - low_le) * (rank - low_n) / (at(i)["count"] - low_n)
    value = F.when(F.isnan(at(i)["le"]) | (at(i)["le"] == float("inf")), at(i - 1)["le"]).otherwise(inside)
    return buckets.select(*keys, F.when(total > 0, value).alias("value"))


def gauges(predictions: DataFrame, drift: DataFrame, burn_alerts: DataFrame, latest: DataFrame) -> DataFrame:
    """Share of unknown predictions, largest PSI, number of burn alerts active at the latest time."""
    top = drift.agg(F.max("psi")).scalar()
    now = latest.scalar()
    active = burn_alerts.withColumn("now", now).agg(F.count(F.when((F.col("start") <= F.col("now")) & (F.col("end") >= F.col("now")), 1))).scalar()
    return predictions.agg(F.avg((F.col("predicted") == K.UNKNOWN).cast("double")).alias("unknown_share")).select(
        "unknown_share", top.alias("max_psi"), active.alias("active_burn_alerts")
    )
