"""Registered queries: features, rules, call graph and incidents."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from vigil import constants as K
from vigil.operators import features as FE
from vigil.operators import graph as G
from vigil.operators import incidents as I
from vigil.operators import matching as M
from vigil.plans.common import STEP, Fixture, fixture, r6, rounded, sql
from vigil.settings import cut
from vigil.sources import fixtures as X

SPLIT_DAY = 22
#: Share of its caller's calls from which a traced edge counts.
CALL_SHARE = 0.25
CONTEXT_SIGNALS = ["error_rate", "latency_p99", "request_rate", "memory_utilization", "db_connections_in_use"]
BEFORE, AFTER = 12 * 3600, 9 * 3600


def _stat(s: str) -> str:
    return f"avg({s}) FILTER (lag <= 4) AS {s}_now, median({s}) FILTER (lag >= 10) AS {s}_base"


def _delta(s: str) -> str:
    diff = f"({s}_now - {s}_base)"
    return f"{diff} AS {s}_delta" if s == "error_rate" else f"{diff} / (abs({s}_base) + {K.DELTA_EPS[s]}::DOUBLE) AS {s}_delta"


_GLOBAL = {
    "db_saturation_ratio": f"(SELECT conn_peak / 100.0 FROM win w WHERE w.at = o.at AND w.service = '{K.DATABASE}')",
    "db_connections_delta": f"(SELECT conn_delta FROM win w WHERE w.at = o.at AND w.service = '{K.DATABASE}')",
    "services_with_errors": "coalesce(t.n, 0)::DOUBLE",
    "deepest_error_depth": "coalesce(t.deepest, -1)::DOUBLE",
    "shallowest_error_depth": "coalesce(t.shallowest, -1)::DOUBLE",
    "top_span_depth": "(SELECT depth::DOUBLE FROM svc WHERE service = o.top_span)",
    "error_log_ratio": "(SELECT ratio FROM logratio l WHERE l.at = o.at)",
    "min_since_deploy_error_origin": "CASE WHEN t.error_origin IS NULL THEN 240.0 ELSE (SELECT since FROM since s WHERE s.at = o.at AND s.service = o.origin) END",
    "min_since_deploy_origin_or_deps": "(SELECT min(since) FROM since s WHERE s.at = o.at AND (s.service = o.origin OR s.service IN (SELECT callee FROM reach r WHERE r.caller = o.origin)))",
    "min_since_any_deploy": "(SELECT min(since) FROM since s WHERE s.at = o.at)",
    "edge_traffic_delta": "(SELECT request_rate_delta FROM win w WHERE w.at = o.at AND w.service = 'web-frontend')",
    "memory_slope_60m": "(SELECT max(mem_slope) FROM win w WHERE w.at = o.at)",
    "culprit_depth": "coalesce((SELECT depth::DOUBLE FROM svc WHERE service = o.culprit), -1.0)",
}
_PER_SERVICE = {
    f"{K.short_name(s)}_{g}_delta": f"(SELECT {g}_delta FROM win w WHERE w.at = o.at AND w.service = '{s}')"
    for s in K.SERVICE_NAMES
    for g in K.DELTA_EPS
}


def _signed(x: str, digits: int, plus: str = "") -> str:
    return f"CASE WHEN {x} < 0 THEN '-' ELSE '{plus}' END || printf('%.{digits}f', abs(round({x}, 9))::DOUBLE)"


_EVIDENCE = [
    ("DB connection saturation", f"{_signed('db_saturation_ratio * 100', 0)} || '% of pool'", "db_saturation_ratio >= 0.85"),
    ("Edge traffic vs baseline", f"{_signed('edge_traffic_delta * 100', 0, '+')} || '%'", "abs(edge_traffic_delta) >= 0.4"),
    ("Services with errors up", _signed("services_with_errors", 0), "services_with_errors >= 1"),
    ("Minutes since deploy on error origin", f"{_signed('min_since_deploy_error_origin', 0)} || ' min'", "min_since_deploy_error_origin <= 15"),
    ("Memory change, last hour", f"{_signed('memory_slope_60m * 100', 0, '+')} || '%'", "memory_slope_60m >= 0.08"),
    ("ERROR log volume vs baseline", f"{_signed('error_log_ratio', 2, '+')} || ' (log ratio)'", "error_log_ratio >= 1"),
    ("Orders p99 vs baseline", f"{_signed('orders_latency_p99_delta * 100', 0, '+')} || '%'", "orders_latency_p99_delta >= 0.5"),
    ("Frontend p99 vs baseline", f"{_signed('web_latency_p99_delta * 100', 0, '+')} || '%'", "web_latency_p99_delta >= 0.5"),
]
_NOTED = "concat_ws(' ', " + ", ".join(f"CASE WHEN {c} THEN '{n} ' || {v} || '.' END" for n, v, c in _EVIDENCE) + ")"
CONTEXT_SQL = f"""concat_ws(' ', 'Service ' || coalesce(culprit, '') || '.', CASE WHEN rules_prediction <> 'unknown' THEN 'Predicted category ' || replace(rules_prediction, '_', ' ') || '.'
    ELSE 'Unclassified alert.' END, {_NOTED})"""

BLOCKS = {
    "probes": (
        ["alerts", "faults"],
        """SELECT 'A' || epoch(fired_at)::BIGINT AS probe_id, fired_at AS at, service AS culprit FROM alerts
            UNION ALL SELECT fault_id || '+' || o, date_trunc('hour', start_ts + to_hours(o)), NULL FROM faults, unnest([1, 2, 3, 4, 6]) u(o)""",
    ),
    "win": (
        ["probes", "minutes"],
        "SELECT *, " + ", ".join(_delta(s) for s in K.DELTA_EPS)
        + """, span_ms_now - span_ms_base AS span_delta, db_connections_in_use_now - db_connections_in_use_base AS conn_delta, recent - earlier AS mem_slope
            FROM (SELECT at, service, """ + ", ".join(_stat(s) for s in [*K.DELTA_EPS, "span_ms", "db_connections_in_use"])
        + """, max(db_connections_in_use) FILTER (lag <= 4) AS conn_peak, avg(memory_utilization) FILTER (lag <= 9) AS recent, avg(memory_utilization) FILTER (lag >= 60) AS earlier
            FROM (SELECT p.at, m.*, date_diff('hour', m.ts, p.at) AS lag FROM (SELECT DISTINCT at FROM probes) p JOIN minutes m ON m.ts BETWEEN p.at - INTERVAL '70 hours' AND p.at)
            GROUP BY at, service)""",
    ),
    "logratio": (
        ["probes", "minutes"],
        """SELECT p.at, ln(1 + avg(n) FILTER (m.ts >= p.at - INTERVAL '4 hours')) - ln(1 + median(n) FILTER (m.ts <= p.at - INTERVAL '10 hours')) AS ratio
            FROM (SELECT DISTINCT at FROM probes) p JOIN (SELECT ts, sum(log_error)::DOUBLE AS n FROM minutes GROUP BY ts) m
            ON m.ts BETWEEN p.at - INTERVAL '70 hours' AND p.at GROUP BY p.at""",
    ),
    "topo": (
        ["win", "svc"],
        """SELECT at, count(*) AS n, max(depth) AS deepest, min(depth) AS shallowest, arg_max(service, depth * 100 - service_order) AS error_origin
            FROM win JOIN svc USING (service) WHERE error_rate_delta > 0.01 GROUP BY at""",
    ),
    "span": (
        ["win", "svc"],
        """SELECT at, service AS top_span, span_delta, depth FROM (SELECT *, row_number() OVER (PARTITION BY at ORDER BY span_delta DESC, service_order) AS r
            FROM win JOIN svc USING (service) WHERE span_delta IS NOT NULL) WHERE r = 1""",
    ),
    "hops": (
        ["ev"],
        """SELECT caller, callee, count(*) AS n FROM (SELECT t.s[i] AS caller, t.s[i + 1] AS callee
            FROM (SELECT list(service ORDER BY ts, event_id) AS s FROM ev GROUP BY date_trunc('hour', ts), k) t, unnest(range(1, len(t.s))) u(i)) WHERE caller <> callee GROUP BY 1, 2""",
    ),
    "traced": (["hops"], f"SELECT * FROM hops h WHERE n >= {CALL_SHARE} * (SELECT sum(n) FROM hops o WHERE o.caller = h.caller)"),
    "traced_reach": (["traced"], "SELECT caller, callee FROM traced UNION SELECT r.caller, c.callee FROM traced_reach r JOIN traced c ON c.caller = r.callee"),
    "reach": (["calls"], "SELECT caller, callee FROM calls UNION SELECT r.caller, c.callee FROM reach r JOIN calls c ON c.caller = r.callee"),
    "since": (
        ["probes", "svc", "deploys"],
        """SELECT p.at, s.service, coalesce(least(240.0, (SELECT min(epoch(p.at - date_trunc('minute', d.ts)) / 60.0) FROM deploys d
              WHERE d.service = s.service AND date_trunc('minute', d.ts) <= p.at)), 240.0) AS since
            FROM (SELECT DISTINCT at FROM probes) p CROSS JOIN svc s""",
    ),
    "origins": (
        ["probes", "topo", "span"],
        """SELECT p.*, s.top_span, coalesce(t.error_origin, p.culprit, s.top_span, 'web-frontend') AS origin FROM probes p LEFT JOIN topo t USING (at) LEFT JOIN span s USING (at)""",
    ),
    "feats": (
        ["origins", "topo", "win", "logratio", "since", "reach", "svc"],
        "SELECT o.probe_id, o.at, o.culprit, " + ", ".join(
            f"coalesce({(_PER_SERVICE | _GLOBAL)[f]}, 0.0) AS {f}" for f in K.feature_names()
        ) + " FROM origins o LEFT JOIN topo t ON t.at = o.at",
    ),
    "ruled": (
        ["feats"],
        """SELECT *, CASE WHEN db_saturation_ratio >= 0.85 AND edge_traffic_delta < 0.5 THEN 'database_saturation' WHEN edge_traffic_delta >= 0.5 THEN 'traffic_spike'
            WHEN services_with_errors >= 1 AND min_since_deploy_error_origin <= 15 THEN 'deployment_regression' WHEN services_with_errors >= 2 THEN 'dependency_failure'
            WHEN memory_slope_60m >= 0.12 THEN 'memory_leak' WHEN services_with_errors >= 1 AND min_since_any_deploy <= 15 THEN 'deployment_regression' ELSE 'unknown' END AS rules_prediction FROM feats""",
    ),
    "numbered": (["alerts"], "SELECT *, printf('INC-%03d', row_number() OVER (ORDER BY fired_at)) AS incident_id, row_number() OVER (ORDER BY fired_at) - 1 AS rn FROM alerts"),
    "inc": (
        ["numbered", "ruled", "own", "faults", "scored"],
        """SELECT n.*, r.* EXCLUDE (probe_id, at, culprit), o.owner, f.category AS truth, f.detail,
            CASE WHEN m.novelty > 1.5 OR m.confidence < 0.4 THEN 'unknown' ELSE m.top END AS predicted, m.confidence,
            CASE WHEN m.novelty > 1.5 THEN 'far from every training example' WHEN m.confidence < 0.4 THEN 'low confidence' END AS unknown_reason
            FROM numbered n JOIN ruled r ON r.probe_id = 'A' || epoch(n.fired_at)::BIGINT LEFT JOIN own o ON o.fired_at = n.fired_at LEFT JOIN faults f ON f.fault_id = o.owner
            LEFT JOIN scored m ON m.id = n.rn""",
    ),
}


def _blocks() -> dict:
    from vigil.plans.classify import BLOCKS as MODEL_BLOCKS

    return BLOCKS | {"probs": MODEL_BLOCKS["probs"], "scored": MODEL_BLOCKS["scored"]}


def quoted(text: str) -> str:
    return re.sub(r'(?<![\w."])at(?![\w"])', '"at"', text)  # `at` is a keyword in DuckDB


def _sql(body: str, *needs: str) -> str:
    return quoted(sql(body, *needs, blocks=_blocks()))


def _probes(fx: Fixture):
    alerts = fx.alerts.select(
        F.concat(F.lit("A"), F.unix_seconds("fired_at").cast("string")).alias("probe_id"), F.col("fired_at").alias("at"), F.col("service").alias("culprit")
    )
    onset = FE.fault_windows(fx.faults, step=STEP).select("probe_id", "at", F.lit(None).cast("string").alias("culprit"))
    return FE.floor_probes(alerts.unionByName(onset), STEP)


def _stats(fx: Fixture):
    return FE.window_features(fx.minutes, _probes(fx), STEP)


def _features(fx: Fixture):
    probes = cut(_probes(fx), "probes")
    rows = FE.feature_rows(fx.minutes, probes, fx.deploys, G.services_table(fx.spark), G.calls_table(fx.spark), STEP)
    return rows


def _services(fx: Fixture):
    return G.services_table(fx.spark)


def _traced_calls(fx: Fixture):
    """Events of one hour with one k are the spans of a trace; edges of a quarter of a caller's calls or more."""
    ev = X.events(fx.spark, fx.dir).select("service", "ts", "event_id", X._k().alias("k"), F.date_trunc("hour", "ts").alias("hour"))
    return cut(G.calls_of_traces(ev, ["hour", "k"], ["ts", "event_id"], CALL_SHARE), "calls")


def call_closure(spark, d):
    """Everything each service depends on in the recorded traces, with direct calls and the errors seen there."""
    fx = fixture(spark, d)
    errors = fx.raw.groupBy("service").agg(F.sum("log_error").alias("callee_errors"))
    calls = _traced_calls(fx)
    return (
        G.call_closure(calls)
        .join(calls, ["caller", "callee"], "left")
        .join(errors.withColumnRenamed("service", "callee"), "callee")
        .select("caller", "callee", F.coalesce("calls", F.lit(0)).alias("calls"), "callee_errors")
    )


def fault_windows(spark, d):
    return FE.fault_windows(fixture(spark, d).faults, step=STEP)


def window_features(spark, d):
    cols = [f"{s}_delta" for s in K.DELTA_EPS] + ["span_delta", "conn_delta", "mem_slope", "conn_peak"]
    return rounded(_stats(fixture(spark, d)).select("at", "service", *cols), 9)


def asof_deploy(spark, d):
    fx = fixture(spark, d)
    keys = _probes(fx).select("at").distinct().withColumn("service", F.explode(F.array(*[F.lit(s) for s in K.SERVICE_NAMES])))
    return rounded(FE.asof_deploy(fx.deploys, keys))


def error_topology(spark, d):
    fx = fixture(spark, d)
    return FE.error_topology(_stats(fx), _services(fx))


def slowest_span(spark, d):
    fx = fixture(spark, d)
    return rounded(FE.slowest_span(_stats(fx), _services(fx)))


def feature_rows(spark, d):
    return rounded(_features(fixture(spark, d)), 9)


def baseline_deltas(spark, d):
    return rounded(FE.baseline_deltas(fixture(spark, d).rollup, ["latency_p95", "error_rate", "request_rate"], step=STEP))


def memory_slope(spark, d):
    return rounded(FE.dense_memory_slope(fixture(spark, d).rollup, STEP))


def rules_classify(spark, d):
    fx = fixture(spark, d)
    return I.rules_classify(_features(fx)).select("probe_id", "rules_prediction")


def neutral_fill(spark, d):
    """Rows that name only some features: traffic and culprit depth of each alert's probe."""
    fx = fixture(spark, d)
    given = _stats(fx).filter(F.col("service") == "web-frontend").select(
        F.unix_seconds("at").cast("string").alias("probe_id"),
        F.col("request_rate_delta").alias("edge_traffic_delta"),
        F.col("error_rate_delta").alias("web_error_rate_delta"),
        F.lit(None).cast("double").alias("db_saturation_ratio"),
    )
    return rounded(FE.neutral_fill(given))


def time_split(spark, d):
    fx = fixture(spark, d)
    w = FE.fault_windows(fx.faults, step=STEP)
    first = fx.timeline.agg(F.min("ts")).scalar()
    split = FE.time_split(w.withColumn("t0", first), F.col("start"), F.col("t0"), SPLIT_DAY, "train", "validation")
    return split.select("probe_id", "category", "day", "split")


def training_union(spark, d):
    """Onset windows and the windows of false alerts, the latter labelled unknown."""
    fx = fixture(spark, d)
    onset = FE.floor_probes(FE.fault_windows(fx.faults, step=STEP), STEP).select("probe_id", "at", F.col("category").alias("label"))
    noise = M.false_alerts(fx.alerts, fx.faults, ["fired_at"], step=STEP).select(
        F.concat(F.lit("A"), F.unix_seconds("fired_at").cast("string")).alias("probe_id"), F.col("fired_at").alias("at"), F.lit(K.UNKNOWN).alias("label")
    )
    return onset.unionByName(noise)


def class_counts(spark, d):
    return training_union(spark, d).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def evidence(spark, d):
    fx = fixture(spark, d)
    rows = _features(fx).select("probe_id", F.posexplode(I.evidence()).alias("position", "e"))
    return rows.select("probe_id", "position", "e.signal", "e.value", "e.notable")


def incident_text(spark, d):
    fx = fixture(spark, d)
    ruled = I.rules_classify(_features(fx))
    return ruled.select("probe_id", I.incident_text(F.col("culprit"), F.col("rules_prediction"), I.evidence()).alias("context"))


def _numbered(fx: Fixture):
    return I.number_incidents(fx.alerts).select("incident_id", "fired_at", "service")


def incident_context(spark, d):
    fx = fixture(spark, d)
    return rounded(I.incident_context(_numbered(fx), fx.minutes, fx.logs, fx.deploys, CONTEXT_SIGNALS, BEFORE, AFTER, STEP), 5)


def _incidents(fx: Fixture):
    from vigil.plans.classify import scored

    numbered = cut(I.number_incidents(fx.alerts), "numbered")
    keyed = numbered.select("incident_id", "rn", F.concat(F.lit("A"), F.unix_seconds("fired_at").cast("string")).alias("probe_id"))
    feats = _features(fx).join(keyed.select("incident_id", "probe_id"), "probe_id")
    preds = keyed.join(scored(fx).withColumnRenamed("id", "rn"), "rn").select("incident_id", "predicted", "confidence", "explanation")
    own = M.owners(fx.alerts, fx.faults, ["fired_at"], step=STEP)
    return I.build_incidents(fx.alerts, feats, preds, own, fx.faults)


def incidents(spark, d):
    rows = _incidents(fixture(spark, d))
    noted = F.transform(F.filter("evidence", lambda e: e["notable"]), lambda e: F.concat(e["signal"], F.lit(" "), e["value"], F.lit(".")))
    return rounded(rows.select(
        "incident_id", "fired_at", "started_at", "ended_at", "service", "signal", "peak_z", "predicted", "confidence", "rules_prediction",
        F.array_join(noted, " ").alias("notable"), F.col("ground_truth.fault_id").alias("fault_id"), F.col("ground_truth.category").alias("category"),
        F.col("ground_truth.detail").alias("detail"), F.col("explanation.unknown_reason").alias("unknown_reason"), "status",
    ))


def incident_summary(spark, d):
    return rounded(I.incident_summary(_incidents(fixture(spark, d))))


def correct_predictions(spark, d):
    return I.correct_predictions(I.incident_summary(_incidents(fixture(spark, d))))


_F = K.feature_names()
_NEUTRAL_SQL = ", ".join(
    f"round(coalesce({ {'edge_traffic_delta': 'request_rate_delta', 'web_error_rate_delta': 'error_rate_delta'}.get(f, 'NULL') }, {K.NEUTRAL.get(f, 0.0)}::DOUBLE), 6) + 0.0 AS {f}" for f in _F
)
_SUMMARY = """incident_id, fired_at, ended_at, service, signal, round(peak, 1) AS peak_z, predicted, round(confidence, 3) AS confidence, rules_prediction"""


def queries() -> dict:
    return {
        "call_closure": (
            call_closure,
            _sql(
                """SELECT r.caller, r.callee, coalesce((SELECT c.n FROM traced c WHERE c.caller = r.caller AND c.callee = r.callee), 0) AS calls, e.n AS callee_errors
                FROM traced_reach r JOIN (SELECT service, sum(log_error)::BIGINT AS n FROM raw GROUP BY 1) e ON e.service = r.callee""",
                "traced_reach", "raw",
            ),
        ),
        "fault_windows": (
            fault_windows,
            _sql("SELECT fault_id || '+' || o AS probe_id, fault_id, start_ts + to_hours(o) AS at, category, start_ts AS start FROM faults, unnest([1, 2, 3, 4, 6]) u(o)", "faults"),
        ),
        "window_features": (
            window_features,
            _sql("SELECT at, service, " + r6(*[f"{s}_delta" for s in K.DELTA_EPS], "span_delta", "conn_delta", "mem_slope", "conn_peak", digits=9) + " FROM win", "win"),
        ),
        "asof_deploy": (asof_deploy, _sql("SELECT service, at, round(since, 6) AS minutes_since FROM since", "since")),
        "error_topology": (
            error_topology,
            _sql(
                """SELECT a.at, coalesce(n, 0)::DOUBLE AS services_with_errors, coalesce(deepest, -1)::DOUBLE AS deepest_error_depth, coalesce(shallowest, -1)::DOUBLE AS shallowest_error_depth, error_origin
                FROM (SELECT DISTINCT at FROM win) a LEFT JOIN topo t ON t.at = a.at""",
                "win", "topo",
            ),
        ),
        "slowest_span": (
            slowest_span,
            _sql("SELECT a.at, top_span, depth::DOUBLE AS top_span_depth, round(span_delta, 6) AS span_delta FROM (SELECT DISTINCT at FROM win) a LEFT JOIN span s ON s.at = a.at", "win", "span"),
        ),
        "feature_rows": (feature_rows, _sql(f"SELECT probe_id, at, culprit, {r6(*_F, digits=9)} FROM feats", "feats")),
        "baseline_deltas": (
            baseline_deltas,
            _sql(
                "SELECT ts, service, " + ", ".join(
                    f"round((avg({s}) OVER n - median({s}) OVER b) {'' if s == 'error_rate' else f'/ (abs(median({s}) OVER b) + {K.DELTA_EPS[s]}::DOUBLE)'}, 6) + 0.0 AS {s}_delta"
                    for s in ["latency_p95", "error_rate", "request_rate"]
                ) + """ FROM minutes WINDOW n AS (PARTITION BY service ORDER BY ts RANGE BETWEEN INTERVAL '4 hours' PRECEDING AND CURRENT ROW),
                b AS (PARTITION BY service ORDER BY ts RANGE BETWEEN INTERVAL '70 hours' PRECEDING AND INTERVAL '10 hours' PRECEDING)""",
                "minutes",
            ),
        ),
        "memory_slope": (
            memory_slope,
            _sql(
                """SELECT ts, round(max(s), 6) + 0.0 AS memory_slope_60m FROM (SELECT ts, avg(memory_utilization) OVER a - avg(memory_utilization) OVER b AS s FROM minutes
                WINDOW a AS (PARTITION BY service ORDER BY ts RANGE BETWEEN INTERVAL '9 hours' PRECEDING AND CURRENT ROW),
                b AS (PARTITION BY service ORDER BY ts RANGE BETWEEN INTERVAL '70 hours' PRECEDING AND INTERVAL '60 hours' PRECEDING)) GROUP BY ts""",
                "minutes",
            ),
        ),
        "rules_classify": (rules_classify, _sql("SELECT probe_id, rules_prediction FROM ruled", "ruled")),
        "neutral_fill": (neutral_fill, _sql(f"SELECT epoch(at)::BIGINT::VARCHAR AS probe_id, {_NEUTRAL_SQL} FROM win WHERE service = 'web-frontend'", "win")),
        "time_split": (
            time_split,
            _sql(
                f"""SELECT fault_id || '+' || o AS probe_id, category, day, CASE WHEN day < {SPLIT_DAY} THEN 'train' ELSE 'validation' END AS split
                FROM (SELECT *, floor(epoch(start_ts - (SELECT min(ts) FROM timeline)) / 86400)::BIGINT AS day FROM faults), unnest([1, 2, 3, 4, 6]) u(o)""",
                "faults", "timeline",
            ),
        ),
        "training_union": (
            training_union,
            _sql(
                """SELECT p.probe_id, p.at, coalesce(f.category, 'unknown') AS label FROM probes p LEFT JOIN faults f ON p.probe_id LIKE f.fault_id || '+%'
                WHERE p.probe_id LIKE 'F%' OR p.at NOT IN (SELECT fired_at FROM pairs WHERE threshold = 3.0 AND consecutive = 2)""",
                "probes", "faults", "pairs",
            ),
        ),
        "class_counts": (
            class_counts,
            _sql(
                """SELECT label, count(*) AS n FROM (SELECT coalesce(f.category, 'unknown') AS label FROM probes p LEFT JOIN faults f ON p.probe_id LIKE f.fault_id || '+%'
                WHERE p.probe_id LIKE 'F%' OR p.at NOT IN (SELECT fired_at FROM pairs WHERE threshold = 3.0 AND consecutive = 2)) GROUP BY label""",
                "probes", "faults", "pairs",
            ),
        ),
        "evidence": (
            evidence,
            _sql(
                " UNION ALL ".join(f"SELECT probe_id, {i} AS position, '{n}' AS signal, {v} AS value, {c} AS notable FROM feats" for i, (n, v, c) in enumerate(_EVIDENCE)),
                "feats",
            ),
        ),
        "incident_text": (
            incident_text,
            _sql(
                f"SELECT probe_id, {CONTEXT_SQL} AS context FROM ruled",
                "ruled",
            ),
        ),
        "incident_context": (
            incident_context,
            _sql(
                f"""SELECT incident_id, 'series' AS part, ts, service, name, round(value, 5) + 0.0 AS value, NULL::VARCHAR AS text FROM
                (UNPIVOT (SELECT n.incident_id, m.ts, m.service, {', '.join(CONTEXT_SIGNALS)} FROM numbered n JOIN minutes m ON m.ts BETWEEN n.fired_at - INTERVAL '12 hours' AND n.fired_at + INTERVAL '9 hours')
                ON {', '.join(CONTEXT_SIGNALS)} INTO NAME name VALUE value)
                UNION ALL SELECT incident_id, 'log', ts, service, level, NULL, message FROM (SELECT n.incident_id, l.*, row_number() OVER (PARTITION BY n.incident_id ORDER BY l.ts DESC, l.log_id DESC) AS r
                  FROM numbered n JOIN logs l ON l.ts BETWEEN n.fired_at - INTERVAL '30 minutes' AND n.fired_at + INTERVAL '30 minutes') WHERE r <= 12
                UNION ALL SELECT n.incident_id, 'deploy', p.ts, p.service, p.kind, NULL, p.version FROM numbered n JOIN deploys p ON p.ts BETWEEN n.fired_at - INTERVAL '2 hours' AND n.fired_at""",
                "numbered", "minutes", "logs", "deploys",
            ),
        ),
        "incidents": (
            incidents,
            _sql(
                f"""SELECT incident_id, fired_at, started_at, ended_at, service, signal, round(peak, 1) AS peak_z, predicted, round(confidence, 3) AS confidence, rules_prediction,
                {_NOTED} AS notable, owner AS fault_id, truth AS category, detail, unknown_reason, 'resolved' AS status FROM inc""",
                "inc",
            ),
        ),
        "incident_summary": (
            incident_summary,
            _sql(f"SELECT {_SUMMARY}, 'resolved' AS status, coalesce(truth, 'false alert') AS actual, unknown_reason FROM inc", "inc"),
        ),
        "correct_predictions": (
            correct_predictions,
            _sql("SELECT count(*) FILTER (predicted = truth OR (truth = 'memory_leak' AND predicted = 'unknown')) AS correct, count(*) AS total FROM inc", "inc"),
        ),
    }


QUERIES = queries()
