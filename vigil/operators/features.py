"""Leakage-free incident features: everything known at the minute of the probe and nothing later.

A probe is (probe_id, at, culprit). Features depend on `at` alone except for the culprit, so the
windows are gathered once per distinct minute. A minute belongs to the windows of at most 71 later
minutes, so probes list their minutes and meet the rollup in an equi-join on `ts`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil import constants as K
from vigil.operators.graph import call_closure
from vigil.operators.rollup import floor_time
from vigil.settings import cut

NOW, BASE_FROM, BASE_TO, RECENT, EARLIER = 4, 10, 70, 9, 60  # window bounds in steps before the probe


def floor_probes(probes: DataFrame, step: int = 60) -> DataFrame:
    return probes.withColumn("at", floor_time(F.col("at"), step))


def fault_windows(faults: DataFrame, offsets: list[int] = K.WINDOW_OFFSETS, step: int = 60) -> DataFrame:
    """Labelled windows at fixed positions after the onset of every incident."""
    at = F.timestamp_micros(F.unix_micros("start") + F.col("offset").cast("long") * step * 1_000_000)
    return faults.withColumn("offset", F.explode(F.array(*[F.lit(o) for o in offsets]))).select(
        F.concat_ws("+", "fault_id", "offset").alias("probe_id"), "fault_id", at.alias("at"), "category", "start"
    )


def _cells(probes: DataFrame, step: int) -> DataFrame:
    at = F.unix_seconds("at")
    lags = F.sequence(F.lit(0), F.lit(BASE_TO))
    return (
        probes.select("at")
        .distinct()
        .withColumn("lag", F.explode(lags))
        .withColumn("ts", F.timestamp_seconds(at - F.col("lag") * step))
    )


def _now(column: str | Column) -> Column:
    return F.when(F.col("lag") <= NOW, column if isinstance(column, Column) else F.col(column))


def _base(column: str) -> Column:
    return F.when(F.col("lag") >= BASE_FROM, F.col(column))


def window_features(minutes: DataFrame, probes: DataFrame, step: int = 60, eps: dict[str, float] = K.DELTA_EPS) -> DataFrame:
    """Per probe minute and service: window mean, baseline median and their difference for each signal.

    A group holds at most 71 rows, so the exact medians are cheap.
    """
    signals = [*eps, "span_ms", "db_connections_in_use"]
    joined = _cells(probes, step).join(minutes.select("ts", "service", *signals), "ts")
    aggs = []
    for s in signals:
        aggs += [F.avg(_now(s)).alias(f"{s}_now"), F.percentile(_base(s), 0.5).alias(f"{s}_base")]
    mem = F.col("memory_utilization")
    stats = joined.groupBy("at", "service").agg(
        *aggs,
        F.max(_now("db_connections_in_use")).alias("conn_peak"),
        F.avg(F.when(F.col("lag") <= RECENT, mem)).alias("mem_recent"),
        F.avg(F.when(F.col("lag") >= EARLIER, mem)).alias("mem_earlier"),
    )
    deltas = {}
    for s, e in eps.items():
        diff = F.col(f"{s}_now") - F.col(f"{s}_base")
        deltas[f"{s}_delta"] = diff if s == "error_rate" else diff / (F.abs(f"{s}_base") + F.lit(e))
    deltas["span_delta"] = F.col("span_ms_now") - F.col("span_ms_base")
    deltas["conn_delta"] = F.col("db_connections_in_use_now") - F.col("db_connections_in_use_base")
    deltas["mem_slope"] = F.col("mem_recent") - F.col("mem_earlier")
    return stats.withColumns(deltas)


def _in_order(services: DataFrame, stats: DataFrame) -> DataFrame:
    return stats.join(services, "service")


def error_topology(stats: DataFrame, services: DataFrame) -> DataFrame:
    """Services with errors up: how many, deepest, shallowest, and the deepest one (first on ties)."""
    up = F.coalesce(F.col("error_rate_delta") > K.ERROR_UP, F.lit(False))
    place = F.struct("depth", (-F.col("service_order")).alias("o"), "service")
    return _in_order(services, stats).groupBy("at").agg(
        F.count(F.when(up, 1)).cast("double").alias("services_with_errors"),
        F.coalesce(F.max(F.when(up, F.col("depth"))), F.lit(-1)).cast("double").alias("deepest_error_depth"),
        F.coalesce(F.min(F.when(up, F.col("depth"))), F.lit(-1)).cast("double").alias("shallowest_error_depth"),
        F.max(F.when(up, place)).getField("service").alias("error_origin"),
    )


def slowest_span(stats: DataFrame, services: DataFrame) -> DataFrame:
    """Service whose own time grew most."""
    grown = F.when(F.col("span_delta").isNotNull(), F.struct("span_delta", (-F.col("service_order")).alias("o"), "service", "depth"))
    top = _in_order(services, stats).groupBy("at").agg(F.max(grown).alias("s"))
    return top.select("at", F.col("s.service").alias("top_span"), F.col("s.depth").cast("double").alias("top_span_depth"), F.col("s.span_delta").alias("span_delta"))


def memory_slope(stats: DataFrame) -> DataFrame:
    return stats.groupBy("at").agg(F.max("mem_slope").alias("memory_slope_60m"))


def error_log_ratio(minutes: DataFrame, probes: DataFrame, step: int = 60) -> DataFrame:
    """log1p(mean of the window) - log1p(median of the baseline) of error logs over all services."""
    totals = minutes.groupBy("ts").agg(F.sum("log_error").cast("double").alias("logs"))
    return (
        _cells(probes, step)
        .join(totals, "ts")
        .groupBy("at")
        .agg((F.log1p(F.avg(_now("logs"))) - F.log1p(F.percentile(_base("logs"), 0.5))).alias("error_log_ratio"))
    )


def asof_deploy(deploys: DataFrame, keys: DataFrame, cap: float = K.DEPLOY_CAP) -> DataFrame:
    """Minutes since the last deploy of a service at or before `at`, capped; (service, at) in, one row each out.

    Deploys and probes are reduced to one row per service and minute, so the window over a service
    is bounded by the calendar.
    """
    done = deploys.select("service", floor_time(F.col("ts"), 60).alias("t")).distinct().withColumn("deployed", F.col("t"))
    asked = keys.select("service", F.col("at").alias("t")).distinct()
    both = done.unionByName(asked, allowMissingColumns=True)
    line = Window.partitionBy("service").orderBy(F.unix_seconds("t")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    since = (F.unix_seconds("t") - F.unix_seconds("last")) / 60.0
    return (
        both.withColumn("last", F.last("deployed", ignorenulls=True).over(line))
        .filter(F.col("deployed").isNull())
        .select("service", F.col("t").alias("at"), F.coalesce(F.least(F.lit(cap), since), F.lit(cap)).alias("minutes_since"))
    )


def feature_rows(
    minutes: DataFrame, probes: DataFrame, deploys: DataFrame, services: DataFrame, calls: DataFrame, step: int = 60,
    names: list[str] = K.SERVICE_NAMES,
) -> DataFrame:
    """The full feature row per probe: probe_id, at, culprit and 48 doubles in fixed order."""
    probes = floor_probes(probes, step).select("probe_id", "at", "culprit")
    stats = cut(window_features(minutes, probes, step), "window-stats")  # read four times below
    cells = [
        F.max(F.when(F.col("service") == s, F.col(f"{g}_delta"))).alias(f"{K.short_name(s)}_{g}_delta")
        for s in names
        for g in K.DELTA_EPS
    ]
    db = F.col("service") == K.DATABASE
    wide = stats.groupBy("at").agg(
        *cells,
        (F.max(F.when(db, F.col("conn_peak"))) / float(K.DB_POOL_MAX)).alias("db_saturation_ratio"),
        F.max(F.when(db, F.col("conn_delta"))).alias("db_connections_delta"),
        F.max("mem_slope").alias("memory_slope_60m"),
    )
    per_minute = (
        probes.select("at").distinct()
        .join(wide, "at", "left")
        .join(error_topology(stats, services), "at", "left")
        .join(slowest_span(stats, services).drop("span_delta"), "at", "left")
        .join(error_log_ratio(minutes, probes, step), "at", "left")
    )
    depth = services.select(F.col("service").alias("culprit"), F.col("depth").cast("double").alias("culprit_depth"))
    row = (
        probes.join(per_minute, "at")
        .join(depth, "culprit", "left")
        .withColumn("origin", F.coalesce("error_origin", "culprit", "top_span", F.lit(names[0])))
    )
    # origin and everything below it; each service counts as its own dependency
    reach = call_closure(calls).unionByName(services.select(F.col("service").alias("caller"), F.col("service").alias("callee")))
    asked = probes.select("at").distinct().withColumn("service", F.explode(F.array(*[F.lit(s) for s in names])))
    since = asof_deploy(deploys, asked)
    any_deploy = since.groupBy("at").agg(F.min("minutes_since").alias("min_since_any_deploy"))
    around = (
        row.select("at", "origin")
        .distinct()
        .join(reach, F.col("origin") == F.col("caller"))
        .join(since.withColumnRenamed("service", "callee"), ["at", "callee"])
        .groupBy("at", "origin")
        .agg(
            F.min("minutes_since").alias("min_since_deploy_origin_or_deps"),
            F.min(F.when(F.col("callee") == F.col("origin"), F.col("minutes_since"))).alias("since_origin"),
        )
    )
    full = row.join(around, ["at", "origin"], "left").join(any_deploy, "at", "left").withColumns(
        {
            "min_since_deploy_error_origin": F.when(F.col("error_origin").isNotNull(), F.col("since_origin")).otherwise(K.DEPLOY_CAP),
            "edge_traffic_delta": F.col(f"{K.short_name(names[0])}_request_rate_delta"),
            "culprit_depth": F.coalesce("culprit_depth", F.lit(-1.0)),
            "services_with_errors": F.coalesce("services_with_errors", F.lit(0.0)),
            "deepest_error_depth": F.coalesce("deepest_error_depth", F.lit(-1.0)),
            "shallowest_error_depth": F.coalesce("shallowest_error_depth", F.lit(-1.0)),
        }
    )
    return full.select("probe_id", "at", "culprit", *[zero_if_not_finite(F.col(f)).alias(f) for f in K.feature_names()])


def zero_if_not_finite(x: Column) -> Column:
    return F.coalesce(F.when(F.abs(x) < float("inf"), x), F.lit(0.0))


def baseline_deltas(minutes: DataFrame, signals: list[str], eps: dict[str, float] = K.DELTA_EPS, step: int = 60) -> DataFrame:
    """The same deltas for every service minute, with time frames instead of a join (dense probing)."""
    line = Window.partitionBy("service").orderBy(F.unix_seconds("ts"))
    now, base = line.rangeBetween(-NOW * step, 0), line.rangeBetween(-BASE_TO * step, -BASE_FROM * step)
    out = []
    for s in signals:
        middle = F.percentile(s, 0.5).over(base)
        diff = F.avg(s).over(now) - middle
        out.append((diff if s == "error_rate" else diff / (F.abs(middle) + F.lit(eps[s]))).alias(f"{s}_delta"))
    return minutes.select("ts", "service", *out)


def dense_memory_slope(minutes: DataFrame, step: int = 60) -> DataFrame:
    line = Window.partitionBy("service").orderBy(F.unix_seconds("ts"))
    recent = F.avg("memory_utilization").over(line.rangeBetween(-RECENT * step, 0))
    earlier = F.avg("memory_utilization").over(line.rangeBetween(-BASE_TO * step, -EARLIER * step))
    return minutes.select("ts", (recent - earlier).alias("slope")).groupBy("ts").agg(F.max("slope").alias("memory_slope_60m"))


def neutral_fill(given: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Hand-built feature rows completed with "nothing notable"; an unknown feature name is an error."""
    names = names or K.feature_names()
    extra = sorted(set(given.columns) - set(names) - {"probe_id"})
    if extra:
        raise ValueError(f"Unknown features: {', '.join(extra[:5])}")
    return given.select(
        "probe_id",
        *[
            (F.coalesce(F.col(n).cast("double"), F.lit(K.NEUTRAL.get(n, 0.0))) if n in given.columns else F.lit(K.NEUTRAL.get(n, 0.0))).alias(n)
            for n in names
        ],
    )


def time_split(df: DataFrame, start: Column, origin: Column, split_day: int, before: str, after: str) -> DataFrame:
    """Day index since `origin` and the side of the split it falls on."""
    day = F.floor((F.unix_micros(start) - F.unix_micros(origin)) / 86_400_000_000).cast("long")
    return df.withColumn("day", day).withColumn("split", F.when(F.col("day") < split_day, before).otherwise(after))
