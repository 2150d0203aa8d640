"""Scores to alerts, detector sweeps and the choice of an operating point."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigil import constants as K
from vigil.functions.stats import exact_quantiles
from vigil.settings import cut

SETTING = ["threshold", "consecutive"]


def settings_array(thresholds: list[float], consecutive: list[int]) -> Column:
    """The parameter grid as a literal array in sweep order (consecutive outer, threshold inner)."""
    pairs = [(n, t) for n in consecutive for t in thresholds]
    return F.array(
        *[
            F.struct(
                F.lit(float(t)).alias("threshold"), F.lit(int(n)).alias("consecutive"), F.lit(i).alias("setting_no")
            )
            for i, (n, t) in enumerate(pairs)
        ]
    )


def settings_table(spark: SparkSession, thresholds: list[float], consecutive: list[int]) -> DataFrame:
    return spark.range(1).select(F.explode(settings_array(thresholds, consecutive)).alias("s")).select("s.*")


def runs_to_alerts(
    scores: DataFrame,
    thresholds: list[float],
    consecutive: list[int],
    timeline: DataFrame | None = None,
    cooldown: int = K.COOLDOWN_ROWS,
    by: list[str] | None = None,
) -> DataFrame:
    """Alerts of every setting in one pass over ts, rn, score, signal, service.

    Fires on the Nth consecutive row above the threshold and stays open until `cooldown` rows at or
    below it. Rows at or below the lowest threshold are dropped before anything is shuffled; the
    windows see the remaining rows of one setting (and series `by`), at most one per minute.
    """
    keys = [*(by or []), *SETTING]
    timeline = scores if timeline is None else timeline
    lines = by or []
    hot = (
        scores.filter(F.col("score") > float(min(thresholds)))
        .withColumn("g", F.explode(settings_array(thresholds, consecutive)))
        .select("*", "g.threshold", "g.consecutive")
        .filter(F.col("score") > F.col("threshold"))
    )
    ordered = Window.partitionBy(*keys).orderBy("rn")
    so_far = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    gap = F.col("rn") - F.lag("rn").over(ordered)
    marked = hot.withColumn("gap", gap).withColumns(
        {
            "cluster": F.sum(F.when(F.col("gap") <= cooldown, 0).otherwise(1)).over(so_far),
            "run": F.sum(F.when(F.col("gap") <= 1, 0).otherwise(1)).over(so_far),
            "run_rn": F.max(F.when(F.coalesce("gap", F.lit(2)) > 1, F.col("rn"))).over(so_far),
        }
    )
    runs = marked.groupBy(*keys, "cluster", "run").agg(
        F.min("ts").alias("started_at"),
        F.max(F.when(F.col("rn") - F.col("run_rn") + 1 == F.col("consecutive"), F.col("ts"))).alias("fired_at"),
        F.max("rn").alias("last_rn"),
        F.max(F.struct("score", (-F.col("rn")).alias("r"), "service", "signal")).alias("top"),
    )
    opened = F.min("fired_at").over(
        Window.partitionBy(*keys, "cluster").orderBy("run").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    alerts = (
        runs.withColumn("opened", opened)
        .filter(F.col("opened").isNotNull())
        .groupBy(*keys, "cluster")
        .agg(
            F.min("opened").alias("fired_at"),
            F.min("started_at").alias("started_at"),
            (F.max("last_rn") + cooldown).alias("rn"),
            F.max("top").alias("top"),
        )
    )
    ends = timeline.select(*lines, "rn", F.col("ts").alias("end_ts"))
    if lines:
        tail = timeline.groupBy(*lines).agg(F.max("ts").alias("last_ts"))
        closed = alerts.join(ends, [*lines, "rn"], "left").join(tail, lines)
    else:
        closed = alerts.join(ends, "rn", "left").withColumn("last_ts", timeline.agg(F.max("ts")).scalar())
    return closed.select(
        *keys,
        "fired_at",
        "started_at",
        F.coalesce("end_ts", "last_ts").alias("ended_at"),
        F.col("top.service").alias("service"),
        F.col("top.signal").alias("signal"),
        F.col("top.score").alias("peak"),
    )


def detection_curve(
    alerts: DataFrame, faults: DataFrame, thresholds: list[float], consecutive: list[int], days: float, step: int = 60,
    grace: int = K.GRACE_SECONDS,
) -> DataFrame:
    """Scorecard of every setting, in sweep order, settings without alerts included."""
    from vigil.operators.matching import scorecard

    grid = settings_table(faults.sparkSession, thresholds, consecutive)
    card = scorecard(alerts, faults, days, step, grace, by=SETTING)
    incidents = faults.agg(F.count(F.lit(1))).scalar()
    n = F.col("incidents")
    return (
        grid.join(card, SETTING, "left")
        .withColumn("incidents", incidents)
        .select(
            *SETTING,
            "setting_no",
            (F.coalesce("detected", F.lit(0)) / F.greatest(n, F.lit(1))).alias("recall"),
            "median_ttd_min",
            F.coalesce("false_alerts_per_day", F.lit(0.0)).alias("false_alerts_per_day"),
            F.coalesce("precision", F.lit(0.0)).alias("precision"),
            *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("alerts", "true_alerts", "false_alerts", "detected")],
            n.cast("long").alias("incidents"),
        )
    )


def score_limits(scores: DataFrame, probs: list[float]) -> dict[float, float]:
    """Exact quantiles of a score as thresholds, each with its least probability; equal ones count once.

    One number per probability reaches the driver, and no task gathers the scores (exact_quantiles).
    """
    found = exact_quantiles(scores, [], "score", sorted(probs)).select("q").collect()
    limits: dict[float, float] = {}
    for p, t in zip(sorted(probs), found[0]["q"] if found else [], strict=False):
        limits.setdefault(t, p)
    return limits


def quantile_curve(
    scores: DataFrame, faults: DataFrame, probs: list[float], consecutive: list[int], days: float, step: int = 60, timeline: DataFrame | None = None,
    min_recall: float = 0.93,
) -> DataFrame:
    """detection_curve at quantiles of the scores, with `quantile` and whether a setting is the operating point.

    For detectors whose scores have no scale of their own. Without any score there is no threshold, which is an error.
    """
    limits = score_limits(scores, probs)
    if not limits:
        raise ValueError("no scores to take quantiles of")
    alerts = cut(runs_to_alerts(scores, list(limits), consecutive, timeline), "quantile-alerts")
    curve = cut(detection_curve(alerts, faults, list(limits), consecutive, days, step), "curve")
    named = F.create_map(*[F.lit(x) for t, p in limits.items() for x in (t, p)])
    best = operating_point(curve, min_recall).select("setting_no").scalar()
    return curve.select(F.element_at(named, F.col("threshold")).alias("quantile"), "*", (F.col("setting_no") == best).alias("chosen"))


def operating_point(curve: DataFrame, min_recall: float = 0.93) -> DataFrame:
    """Fewest false alerts among settings with enough recall (else the best recall), then the fastest."""
    best = curve.agg(F.max("recall")).scalar()
    return (
        curve.filter(F.col("recall") >= F.least(F.lit(min_recall), best))
        .orderBy("false_alerts_per_day", F.col("median_ttd_min").asc_nulls_last(), "setting_no")
        .limit(1)
    )
