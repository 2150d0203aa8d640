"""Minute rollup, pivots and resampling (raw telemetry -> one row per service and minute)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil import constants as K


def floor_time(ts: Column, seconds: int) -> Column:
    """Start of the grid cell that holds `ts`."""
    return F.timestamp_seconds(F.floor(F.unix_seconds(ts) / seconds) * seconds)


def ceil_time(ts: Column, seconds: int) -> Column:
    """Smallest grid point at or after `ts` (microseconds count)."""
    return F.timestamp_seconds(F.ceil(F.unix_micros(ts) / (seconds * 1_000_000)) * seconds)


def shift(ts: Column, seconds: int | Column) -> Column:
    """`ts` moved by a signed number of seconds, microseconds kept."""
    moved = F.lit(seconds) if isinstance(seconds, int) else seconds
    return F.timestamp_micros(F.unix_micros(ts) + moved.cast("long") * 1_000_000)


def to_minutes(raw: DataFrame, grain: int = 60, signals: dict[str, str] = K.SIGNALS) -> DataFrame:
    """One row per observed service and minute.

    The only step that sees raw volume. All three aggregates combine before the shuffle, so a service
    with a third of the raw rows still sends one partial row per task and minute.
    """
    clean = raw.select(
        floor_time(F.col("ts"), grain).alias("ts"),
        "service",
        *[F.nanvl(F.col(s).cast("double"), F.lit(None).cast("double")).alias(s) if how != "sum" else s
          for s, how in signals.items()],
    )
    how_to = {"avg": F.avg, "max": F.max, "sum": F.sum}
    return clean.groupBy("ts", "service").agg(*[how_to[how](s).alias(s) for s, how in signals.items()])


def unpivot_wide(wide: DataFrame) -> DataFrame:
    """Wide stored minutes (`signal|service` columns) -> long rows ts, service, signal, value."""
    names = [c for c in wide.columns if "|" in c]
    quoted = wide.select("ts", *[F.col(f"`{c}`").cast("double").alias(c) for c in names])
    long = quoted.unpivot(["ts"], [F.col(f"`{c}`") for c in names], "name", "value")
    parts = F.split("name", r"\|")
    return long.select("ts", parts[1].alias("service"), parts[0].alias("signal"), "value")


def widen(minutes: DataFrame, signals: list[str], services: list[str] = K.SERVICE_NAMES) -> DataFrame:
    """Stored layout: one column per `signal|service`, built with conditional aggregates (no value scan)."""
    cells = [
        F.max(F.when(F.col("service") == svc, F.col(sig))).alias(f"{sig}|{svc}")
        for sig in signals
        for svc in services
    ]
    return minutes.groupBy("ts").agg(*cells)


def pivot_signal(minutes: DataFrame, signal: str, services: list[str] = K.SERVICE_NAMES) -> DataFrame:
    """One column per service for a signal; the explicit value list spares a distinct scan."""
    return minutes.groupBy("ts").pivot("service", services).agg(F.first(signal))


def resample(minutes: DataFrame, seconds: int, columns: list[str], how: str, keys: tuple[str, ...] = ("service",)) -> DataFrame:
    agg = {"max": F.max, "avg": F.avg}[how]
    return minutes.groupBy(floor_time(F.col("ts"), seconds).alias("ts"), *keys).agg(*[agg(c).alias(c) for c in columns])


def last_hours(minutes: DataFrame, hours: int) -> DataFrame:
    """Rows of the last `hours` hours; the latest time arrives as a scalar subquery."""
    latest = minutes.agg(F.max(F.unix_seconds("ts"))).scalar()
    return minutes.filter(F.unix_seconds("ts") >= latest - hours * 3600)


def service_overview(minutes: DataFrame, hours: int, step: int, signals: list[str]) -> DataFrame:
    """Recent signals per service at a coarser step, long form, services without data dropped."""
    recent = resample(last_hours(minutes, hours), step, signals, "avg")
    long = recent.unpivot(["ts", "service"], signals, "signal", "value")
    return long.filter(F.col("value").isNotNull())


def number_rows(times: DataFrame, bucket: int = 86_400) -> DataFrame:
    """0-based position `rn` of each distinct `ts`.

    Counts per day give the offset and a window numbers the rows inside one day, so no task orders
    more than a day of the grid however long the history is.
    """
    from pyspark.sql import Window

    days = times.select("ts").distinct().withColumn("day", F.floor(F.unix_seconds("ts") / bucket))
    sizes = days.groupBy("day").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)  # one row per calendar day
    offsets = sizes.select("day", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = F.row_number().over(Window.partitionBy("day").orderBy("ts")) - 1
    return days.join(offsets, "day").select("ts", (F.col("offset") + inside).cast("long").alias("rn"))
