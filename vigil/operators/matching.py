"""Alerts against labelled incidents, on grid cells instead of theta joins.

An interval covers whole grid cells and at most two in part. "Inside", "still open when it begins" and
"owner" become equi-joins on the cell. For whole cells one side is reduced to one row per cell before
the two meet, so a busy hour full of alerts and incidents yields no pairs; only in the two cells at an
interval's ends are times compared, which is what makes alerts off the grid come out right.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil import constants as K

INSIDE, OPEN = 1, 2  # cell kinds: fired inside the incident / open when the incident began


def cells(first: Column, last: Column, step: int) -> Column:
    """Grid seconds in [first, last] (epoch microseconds), empty when there are none."""
    lo = (F.ceil(first / (step * 1_000_000)) * step).cast("long")
    hi = (F.floor(last / (step * 1_000_000)) * step).cast("long")
    return F.when(lo <= hi, F.sequence(lo, hi, F.lit(step).cast("long"))).otherwise(F.array().cast("array<long>"))


def _us(name: str) -> Column:
    return F.unix_micros(name)


def _points(df: DataFrame, columns: list, kind: int, at: Column, step: int) -> DataFrame:
    """The cell (its first microsecond) a moment lies in."""
    width = F.lit(step * 1_000_000)
    return df.select(*columns, F.lit(kind).alias("kind"), at.alias("lo"), at.alias("hi"), (at - F.pmod(at, width)).alias("cell")).filter("lo IS NOT NULL")


def _covered(df: DataFrame, columns: list, kind: int, lo: Column, hi: Column, step: int, ends: bool) -> DataFrame:
    """Cells wholly inside [lo, hi], or with `ends` those it covers only in part."""
    width = F.lit(step * 1_000_000)
    rows = df.select(*columns, F.lit(kind).alias("kind"), lo.alias("lo"), hi.alias("hi")).filter("lo <= hi")
    a, b = F.col("lo"), F.col("hi")
    if ends:
        head, tail = a - F.pmod(a, width), b - F.pmod(b, width)
        partial = [F.when((c < a) | (c + width - 1 > b), c) for c in (head, tail)]
        return rows.withColumn("cell", F.explode(F.array_distinct(F.array(*partial)))).filter("cell IS NOT NULL")
    first, last = a + F.pmod(-a, width), b + 1 - F.pmod(b + 1, width) - width
    return rows.withColumn("cell", F.explode(F.when(first <= last, F.sequence(first, last, width))))


def alert_cells(alerts: DataFrame, keys: list, step: int, ends: bool = False) -> DataFrame:
    """Probe cells of an alert: where it fired, and every later cell until it ended."""
    inside = _points(alerts, keys, INSIDE, _us("fired_at"), step)
    return inside.unionByName(_covered(alerts, keys, OPEN, _us("fired_at") + 1, _us("ended_at"), step, ends))


def fault_cells(faults: DataFrame, columns: list, before: int, grace: int, step: int, ends: bool = False) -> DataFrame:
    """Cells of an incident with its lead and grace, and the one in which it began."""
    lo, hi = _us("start") - before * 1_000_000, _us("end") + grace * 1_000_000
    return _covered(faults, columns, INSIDE, lo, hi, step, ends).unionByName(_points(faults, columns, OPEN, _us("start"), step))


def _at_ends(alerts: DataFrame, faults: DataFrame, keys: list, columns: list, before: int, grace: int, step: int) -> DataFrame:
    """Matches in cells that an interval covers in part: keys and columns."""
    right = fault_cells(faults, columns, before, grace, step, True).withColumnsRenamed({"lo": "f_lo", "hi": "f_hi"})
    return alert_cells(alerts, keys, step, True).join(right, ["kind", "cell"]).filter("lo <= f_hi AND f_lo <= hi").drop("kind", "cell", "lo", "hi", "f_lo", "f_hi")


def owners(
    alerts: DataFrame, faults: DataFrame, keys: list[str], before: int = 60, grace: int = K.GRACE_SECONDS, step: int = 60
) -> DataFrame:
    """First incident in list order that explains each alert: keys, owner (absent alerts have none)."""
    listed = F.struct("fault_order", "fault_id", "category").alias("f")
    per_cell = fault_cells(faults, [listed], before, grace, step).groupBy("kind", "cell").agg(F.min("f").alias("f"))
    whole = alert_cells(alerts, keys, step).join(per_cell, ["kind", "cell"]).select(*keys, "f")
    return (
        whole.unionByName(_at_ends(alerts, faults, keys, [listed], before, grace, step))
        .groupBy(*keys)
        .agg(F.min("f").alias("f"))
        .select(*keys, F.col("f.fault_id").alias("owner"), F.col("f.category").alias("owner_category"))
    )


def true_alerts(alerts: DataFrame, faults: DataFrame, keys: list[str], grace: int = K.GRACE_SECONDS, step: int = 60) -> DataFrame:
    hits = owners(alerts, faults, keys, 0, grace, step).select(*keys)
    return alerts.join(hits, keys, "left_semi")


def false_alerts(alerts: DataFrame, faults: DataFrame, keys: list[str], grace: int = K.GRACE_SECONDS, step: int = 60) -> DataFrame:
    hits = owners(alerts, faults, keys, 0, grace, step).select(*keys)
    return alerts.join(hits, keys, "left_anti")


def first_alerts(
    alerts: DataFrame, faults: DataFrame, by: list[str] | None = None, grace: int = K.GRACE_SECONDS, step: int = 60
) -> DataFrame:
    """Earliest alert of every detected incident (per setting `by`): fault columns, fired_at."""
    by = by or []
    keys, columns = [*by, "fired_at"], ["fault_id", "category", "start"]
    per_cell = alert_cells(alerts, keys, step).groupBy(*by, "kind", "cell").agg(F.min("fired_at").alias("fired_at"))
    whole = fault_cells(faults, columns, 0, grace, step).join(per_cell, ["kind", "cell"]).select(*keys, *columns)
    return (
        whole.unionByName(_at_ends(alerts, faults, keys, columns, 0, grace, step))
        .groupBy(*by, "fault_id", "category", "start")
        .agg(F.min("fired_at").alias("fired_at"))
    )


def time_to_detect() -> Column:
    return F.greatest(F.lit(0.0), (F.unix_micros("fired_at") - F.unix_micros("start")) / 60e6)


def scorecard(
    alerts: DataFrame, faults: DataFrame, days: float, step: int = 60, grace: int = K.GRACE_SECONDS, by: list[str] | None = None
) -> DataFrame:
    """Recall parts, median time to detect, false alerts per day and precision, per setting with alerts.

    Without `by` there is always exactly one row, also when there are no alerts.
    """
    by = by or []
    keys = [*by, "fired_at"]
    found = first_alerts(alerts, faults, by, grace, step).groupBy(*by).agg(
        F.count(F.lit(1)).alias("detected"), F.percentile(time_to_detect(), 0.5).alias("median_ttd_min")
    )
    hits = owners(alerts, faults, keys, 0, grace, step).select(*keys, F.lit(1).alias("hit"))
    counts = alerts.join(hits, keys, "left").groupBy(*by).agg(
        F.count(F.lit(1)).alias("alerts"), F.count("hit").alias("true_alerts")
    )
    if by:
        both = counts.join(found, by, "left")
    else:
        row = found.agg(F.first(F.struct("detected", "median_ttd_min"))).scalar()
        both = counts.withColumn("found", row).select("*", "found.*")
    incidents = faults.agg(F.count(F.lit(1))).scalar()
    false = F.col("alerts") - F.col("true_alerts")
    return both.withColumn("incidents", incidents).select(
        *by,
        (F.coalesce("detected", F.lit(0)) / F.greatest(F.col("incidents"), F.lit(1))).alias("recall"),
        "median_ttd_min",
        (false / F.lit(float(days))).alias("false_alerts_per_day"),
        F.when(F.col("alerts") > 0, F.col("true_alerts") / F.col("alerts")).otherwise(0.0).alias("precision"),
        "alerts",
        "true_alerts",
        false.alias("false_alerts"),
        F.coalesce("detected", F.lit(0)).cast("long").alias("detected"),
        "incidents",
    )


def scorecard_by_category(alerts: DataFrame, faults: DataFrame, step: int = 60, grace: int = K.GRACE_SECONDS) -> DataFrame:
    found = first_alerts(alerts, faults, None, grace, step).groupBy("category").agg(
        F.count(F.lit(1)).alias("detected"), F.percentile(time_to_detect(), 0.5).alias("median_ttd_min")
    )
    return faults.groupBy("category").agg(F.count(F.lit(1)).alias("incidents")).join(found, "category", "left").select(
        "category",
        "incidents",
        F.coalesce("detected", F.lit(0)).cast("long").alias("detected"),
        (F.coalesce("detected", F.lit(0)) / F.col("incidents")).alias("recall"),
        "median_ttd_min",
    )


def label_alerts(alerts: DataFrame, faults: DataFrame, grace: int = K.GRACE_SECONDS, step: int = 60) -> DataFrame:
    """Alert label: category of the incident it was first for, else of its owner; `unknown` if false."""
    keys = ["fired_at"]
    listed = faults.select("fault_id", "fault_order")
    firsts = (
        first_alerts(alerts, faults, None, grace, step)
        .join(listed, "fault_id")
        .groupBy("fired_at")
        .agg(F.min(F.struct("fault_order", "category")).alias("f"))
        .select("fired_at", F.col("f.category").alias("first_category"))
    )
    # an alert that explains an incident without the one-minute lead also does so with it
    owned = owners(alerts, faults, keys, 60, grace, step)
    hits = owners(alerts, faults, keys, 0, grace, step).select(*keys, F.lit(True).alias("is_true"))
    return (
        alerts.join(hits, keys, "left")
        .join(firsts, keys, "left")
        .join(owned, keys, "left")
        .withColumn("is_true", F.coalesce("is_true", F.lit(False)))
        .withColumn(
            "label",
            F.when(F.col("is_true"), F.coalesce("first_category", "owner_category", F.lit(K.UNKNOWN))).otherwise(K.UNKNOWN),
        )
        .drop("first_category", "owner_category")
    )


def normal_minutes(timeline: DataFrame, faults: DataFrame, margin: int = 1800, warm: int = K.WARM_UP_ROWS, step: int = 60) -> DataFrame:
    """Minutes outside every incident and its margin, warm-up rows excluded."""
    span = cells(_us("start") - margin * 1_000_000, _us("end") + margin * 1_000_000, step)
    busy = faults.select(F.explode(span).alias("cell")).distinct()
    return (
        timeline.filter(F.col("rn") >= warm)
        .withColumn("cell", F.unix_seconds("ts"))
        .join(busy, "cell", "left_anti")
        .drop("cell")
    )
