"""Registered queries: scans, rollups, detection and matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil import constants as K
from vigil.functions.stats import exact_quantiles
from vigil.operators import alerts as A
from vigil.operators import baseline as B
from vigil.operators import matching as M
from vigil.operators import rollup as R
from vigil.plans.common import (
    CONSECUTIVE, DAYS, STEP, SWEEP_N, SWEEP_T, THRESHOLD, Fixture, fixture, r6, rounded, sql,
)

SIGNALS = list(K.SIGNALS)
DOUBLES = [s for s, how in K.SIGNALS.items() if how != "sum"]
ALERT_COLS = "fired_at, started_at, ended_at, service, signal, round(peak, 6) AS peak"
CARD = ["recall", "median_ttd_min", "false_alerts_per_day", "precision"]
COUNTS = "alerts, true_alerts, false_alerts, detected, incidents"
WIDE = list(K.SIGNALS)


def _wide_sql() -> str:
    cells = ", ".join(
        f"max(CASE WHEN service = '{svc}' THEN {sig}::DOUBLE END) AS \"{sig}|{svc}\"" for sig in WIDE for svc in K.SERVICE_NAMES
    )
    return f"SELECT ts, {cells} FROM minutes GROUP BY ts"


def scan_unpivot(spark, d):
    fx = fixture(spark, d)
    return rounded(R.unpivot_wide(R.widen(fx.rollup, WIDE)).filter(F.col("value").isNotNull()))


def minute_rollup(spark, d):
    return rounded(fixture(spark, d).rollup)


def pivot_signal(spark, d):
    fx = fixture(spark, d)
    return rounded(R.pivot_signal(fx.rollup, "error_rate"))


def z_matrix(spark, d):
    fx = fixture(spark, d)
    return rounded(B.z_matrix(fx.z, fx.timeline))


def ewma_z(spark, d):
    return rounded(B.long_z(fixture(spark, d).z))


def minute_score(spark, d):
    return rounded(fixture(spark, d).scores)


def alert_runs(spark, d):
    return rounded(fixture(spark, d).sweep_alerts)


def ewma_alerts(spark, d):
    return rounded(fixture(spark, d).alerts)


def resample_max(spark, d):
    return rounded(R.resample(fixture(spark, d).raw, 1800, ["error_rate", "latency_p99"], "max"))


def resample_mean(spark, d):
    return rounded(R.resample(fixture(spark, d).rollup, 21600, ["request_rate", "cpu_utilization"], "avg"))


def service_overview(spark, d):
    return rounded(R.service_overview(fixture(spark, d).minutes, 24, 10800, ["request_rate", "latency_p95", "db_connections_in_use"]))


def match_first_alert(spark, d):
    fx = fixture(spark, d)
    return rounded(M.first_alerts(fx.alerts, fx.faults, step=STEP).select("fault_id", "fired_at", M.time_to_detect().alias("ttd_min")))


def true_alerts(spark, d):
    fx = fixture(spark, d)
    return rounded(M.true_alerts(fx.alerts, fx.faults, ["fired_at"], step=STEP))


def false_alerts(spark, d):
    fx = fixture(spark, d)
    return rounded(M.false_alerts(fx.alerts, fx.faults, ["fired_at"], step=STEP))


def alert_owner(spark, d):
    fx = fixture(spark, d)
    return fx.alerts.select("fired_at").join(M.owners(fx.alerts, fx.faults, ["fired_at"], step=STEP), "fired_at", "left")


def label_alerts(spark, d):
    fx = fixture(spark, d)
    return M.label_alerts(fx.alerts, fx.faults, step=STEP).select("fired_at", "service", "is_true", "owner", "label")


def normal_minutes(spark, d):
    fx = fixture(spark, d)
    return M.normal_minutes(fx.timeline, fx.faults, step=STEP).select("ts")


def detection_report(spark, d):
    fx = fixture(spark, d)
    return rounded(M.scorecard(fx.alerts, fx.faults, DAYS, STEP))


def detection_by_category(spark, d):
    fx = fixture(spark, d)
    return rounded(M.scorecard_by_category(fx.alerts, fx.faults, STEP))


def _curve(fx):
    return A.detection_curve(fx.sweep_alerts, fx.faults, SWEEP_T, SWEEP_N, DAYS, STEP)


def detector_sweep(spark, d):
    return rounded(_curve(fixture(spark, d)))


def operating_point(spark, d):
    return rounded(A.operating_point(_curve(fixture(spark, d)), 0.5).select(*A.SETTING, *CARD))


def score_quantiles(spark, d):
    fx, probs = fixture(spark, d), K.FOREST_QUANTILES
    q = exact_quantiles(fx.scores, [], "score", probs).select(F.posexplode("q").alias("i", "value"))
    return rounded(q.select(F.element_at(F.array(*[F.lit(p) for p in probs]), F.col("i") + 1).alias("quantile"), "value"))


_KEYED = f"threshold = {THRESHOLD} AND consecutive = {CONSECUTIVE}"
QUERIES = {
    "scan_unpivot": (
        scan_unpivot,
        sql(
            "SELECT ts, split_part(name, '|', 2) AS service, split_part(name, '|', 1) AS signal, round(value, 6) AS value FROM (UNPIVOT wide ON COLUMNS(* EXCLUDE ts) INTO NAME name VALUE value)",
            "wide",
            blocks={"wide": (["minutes"], _wide_sql())},
        ),
    ),
    "minute_rollup": (minute_rollup, sql(f"SELECT ts, service, {r6(*DOUBLES)}, log_info, log_warn, log_error FROM minutes", "minutes")),
    "pivot_signal": (
        pivot_signal,
        sql("SELECT ts, " + ", ".join(f"round(max(CASE WHEN service = '{s}' THEN error_rate END), 6) AS \"{s}\"" for s in K.SERVICE_NAMES) + " FROM minutes GROUP BY ts", "minutes"),
    ),
    "z_matrix": (z_matrix, sql("SELECT ts, service, signal, round(z, 6) + 0.0 AS z FROM zfull", "zfull")),
    "ewma_z": (ewma_z, sql("SELECT ts, service, signal, round(z, 6) + 0.0 AS z FROM z", "z")),
    "minute_score": (minute_score, sql("SELECT ts, rn, round(score, 6) + 0.0 AS score, signal, service FROM scores", "scores")),
    "alert_runs": (alert_runs, sql(f"SELECT threshold::DOUBLE AS threshold, consecutive, {ALERT_COLS} FROM sweep_alerts", "sweep_alerts")),
    "ewma_alerts": (ewma_alerts, sql(f"SELECT {ALERT_COLS} FROM alerts", "alerts")),
    "resample_max": (
        resample_max,
        sql(f"SELECT time_bucket(INTERVAL '30 minutes', ts) AS ts, service, {r6('max(error_rate) AS error_rate', 'max(latency_p99) AS latency_p99')} FROM raw GROUP BY 1, 2", "raw"),
    ),
    "resample_mean": (
        resample_mean,
        sql(f"SELECT time_bucket(INTERVAL '6 hours', ts) AS ts, service, {r6('avg(request_rate) AS request_rate', 'avg(cpu_utilization) AS cpu_utilization')} FROM minutes GROUP BY 1, 2", "minutes"),
    ),
    "service_overview": (
        service_overview,
        sql(
            """SELECT ts, service, signal, round(value, 6) AS value FROM (UNPIVOT (SELECT time_bucket(INTERVAL '3 hours', ts) AS ts, service, avg(request_rate) AS request_rate,
            avg(latency_p95) AS latency_p95, avg(db_connections_in_use) AS db_connections_in_use FROM minutes
            WHERE ts >= (SELECT max(ts) FROM minutes) - INTERVAL '24 hours' GROUP BY 1, 2) ON request_rate, latency_p95, db_connections_in_use INTO NAME signal VALUE value)""",
            "minutes",
        ),
    ),
    "match_first_alert": (match_first_alert, sql(f"SELECT fault_id, fired_at, round(ttd, 6) AS ttd_min FROM firsts WHERE {_KEYED}", "firsts")),
    "true_alerts": (true_alerts, sql(f"SELECT {ALERT_COLS} FROM alerts WHERE fired_at IN (SELECT fired_at FROM pairs WHERE {_KEYED})", "alerts", "pairs")),
    "false_alerts": (false_alerts, sql(f"SELECT {ALERT_COLS} FROM alerts WHERE fired_at NOT IN (SELECT fired_at FROM pairs WHERE {_KEYED})", "alerts", "pairs")),
    "alert_owner": (alert_owner, sql("SELECT fired_at, owner, owner_category FROM alerts LEFT JOIN own USING (fired_at)", "alerts", "own")),
    "label_alerts": (
        label_alerts,
        sql(
            f"""SELECT a.fired_at, a.service, p.fired_at IS NOT NULL AS is_true, o.owner,
            CASE WHEN p.fired_at IS NOT NULL THEN coalesce(f.category, o.owner_category, 'unknown') ELSE 'unknown' END AS label
            FROM alerts a LEFT JOIN (SELECT DISTINCT fired_at FROM pairs WHERE {_KEYED}) p USING (fired_at)
            LEFT JOIN (SELECT fired_at, arg_min(category, fault_order) AS category FROM firsts WHERE {_KEYED} GROUP BY 1) f USING (fired_at)
            LEFT JOIN own o USING (fired_at)""",
            "alerts", "pairs", "firsts", "own",
        ),
    ),
    "normal_minutes": (
        normal_minutes,
        sql(
            """SELECT ts FROM timeline t WHERE rn >= 120 AND NOT EXISTS (SELECT 1 FROM faults f
            WHERE t.ts >= f.start_ts - INTERVAL '30 minutes' AND t.ts <= f.end_ts + INTERVAL '30 minutes')""",
            "timeline", "faults",
        ),
    ),
    "detection_report": (detection_report, sql(f"SELECT {r6(*CARD)}, {COUNTS} FROM card WHERE {_KEYED}", "card")),
    "detection_by_category": (
        detection_by_category,
        sql(
            f"""SELECT category, count(*) AS incidents, count(fired_at) AS detected, {r6('count(fired_at) / count(*)::DOUBLE AS recall', 'median(ttd) AS median_ttd_min')}
            FROM faults LEFT JOIN (SELECT fault_id, fired_at, ttd FROM firsts WHERE {_KEYED}) USING (fault_id) GROUP BY category""",
            "faults", "firsts",
        ),
    ),
    "detector_sweep": (detector_sweep, sql(f"SELECT threshold::DOUBLE AS threshold, consecutive, setting_no, {r6(*CARD)}, {COUNTS} FROM card", "card")),
    "operating_point": (
        operating_point,
        sql(
            f"""SELECT threshold::DOUBLE AS threshold, consecutive, {r6(*CARD)} FROM card
            WHERE recall >= least(0.5, (SELECT max(recall) FROM card)) ORDER BY false_alerts_per_day, median_ttd_min NULLS LAST, setting_no LIMIT 1""",
            "card",
        ),
    ),
    "score_quantiles": (
        score_quantiles,
        sql(
            "SELECT unnest([0.95, 0.97, 0.98, 0.99, 0.995, 0.998, 0.999]::DOUBLE[]) AS quantile, round(unnest(quantile_cont(score, [0.95, 0.97, 0.98, 0.99, 0.995, 0.998, 0.999])), 6) AS value FROM scores",
            "scores",
        ),
    ),
}
