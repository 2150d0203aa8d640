"""Registered queries: drift, promotion, release gate and dashboards."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil import constants as K
from vigil.operators import dashboards as D
from vigil.operators import drift as R
from vigil.operators import gate as G
from vigil.operators import slo as S
from vigil.plans import classify as PC
from vigil.plans import features as PF
from vigil.plans import slo as PS
from vigil.plans.common import STEP, fixture, r6, rounded, sql
from vigil.settings import cut
from vigil.sources import fixtures as X

QUIET_ROWS = 12
COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_K = "CAST(json_extract_string(props, '$.k') AS INTEGER)"


def _psi_sql(source: str, keys: str, bins: int) -> str:
    """PSI over a relation (keys, v, ref boolean)."""
    probs = "[" + ", ".join(repr(i / bins) for i in range(bins + 1)) + "]::DOUBLE[]"
    return f"""SELECT {keys}, CASE WHEN len(any_value(edges)) < 3 THEN 0.0 ELSE sum((greatest(a, 1e-6) - greatest(e, 1e-6)) * ln(greatest(a, 1e-6) / greatest(e, 1e-6))) END AS psi
      FROM (SELECT {keys}, any_value(edges) AS edges, b, count(*) FILTER (ref) / any_value(ne)::DOUBLE AS e, count(*) FILTER (NOT ref) / any_value(na)::DOUBLE AS a
        FROM (SELECT s.*, q.edges, q.ne, q.na, len(list_filter(q.edges[2:len(q.edges) - 1], lambda x: x <= s.v)) AS b FROM {source} s
          JOIN (SELECT {keys}, list_sort(list_distinct(quantile_cont(v, {probs}) FILTER (ref))) AS edges, count(*) FILTER (ref) AS ne, count(*) FILTER (NOT ref) AS na FROM {source} GROUP BY {keys}) q USING ({keys}))
        GROUP BY {keys}, b) GROUP BY {keys}"""


def _quiet_sql(where: str) -> str:
    return f"""SELECT service, arg_min(w0, (d, ts)) AS window_start, arg_min(ts, (d, ts)) AS window_end, min(d) AS deviation FROM (
      SELECT service, ts, round(stddev_samp(error_rate) OVER w, 9) AS d, first_value(ts) OVER w AS w0, row_number() OVER (PARTITION BY service ORDER BY ts) - 1 AS i
      FROM minutes WHERE {where} WINDOW w AS (PARTITION BY service ORDER BY ts ROWS BETWEEN {QUIET_ROWS - 1} PRECEDING AND CURRENT ROW)) WHERE i >= {QUIET_ROWS} GROUP BY service"""


BLOCKS = PF._blocks() | PS.BLOCKS | PC.BLOCKS | {
    "items": (
        [],
        f"""SELECT l_returnflag, name, v::DOUBLE AS v, l_shipdate < (SELECT min(l_shipdate) + (max(l_shipdate) - min(l_shipdate)) / 2 FROM lineitem) AS ref
            FROM (UNPIVOT (SELECT l_returnflag, l_shipdate, {', '.join(COLUMNS)} FROM lineitem) ON {', '.join(COLUMNS)} INTO NAME name VALUE v)""",
    ),
    # the middle of the recording parts what was from what is
    "middle": (["minutes"], "SELECT make_timestamp((epoch_us(min(ts)) + epoch_us(max(ts))) // 2) AS m FROM minutes"),
    "sig": (
        ["minutes", "middle"],
        f"""SELECT service, signal, v, ts < (SELECT m FROM middle) AS ref FROM (UNPIVOT (SELECT ts, service, {', '.join(K.DRIFT_SIGNALS)} FROM minutes) ON {', '.join(K.DRIFT_SIGNALS)} INTO NAME signal VALUE v)""",
    ),
    "fea": (
        ["feats", "middle"],
        f"""SELECT feature, v, "at" < (SELECT m FROM middle) AS ref FROM (UNPIVOT (SELECT "at", {', '.join(f'round({f}, 9)::DOUBLE AS {f}' for f in K.feature_names())} FROM feats) ON COLUMNS(* EXCLUDE "at") INTO NAME feature VALUE v)""",
    ),
    "sig_psi": (["sig"], _psi_sql("sig", "signal, service", 10)),
    "quiet": (["minutes"], _quiet_sql("true")),
    "quiet_early": (["minutes", "middle"], _quiet_sql("ts < (SELECT m FROM middle)")),
    "quiet_late": (["minutes", "middle"], _quiet_sql("ts >= (SELECT m FROM middle)")),
    "canary": (
        ["quiet_early", "quiet_late", "minutes"],
        f"""SELECT s.service, {', '.join(f"avg(m.{c}) FILTER (m.ts BETWEEN s.{p}_start AND s.{p}_end) AS {p}_{n}" for p in ('b', 'c') for c, n in (('error_rate', 'err'), ('latency_p95', 'p95')))}
            FROM (SELECT e.service, e.window_start AS b_start, e.window_end AS b_end, l.window_start AS c_start, l.window_end AS c_end FROM quiet_early e LEFT JOIN quiet_late l USING (service)) s
            LEFT JOIN minutes m ON m.service = s.service GROUP BY s.service""",
    ),
    "candidates": (
        ["ev", "quiet", "minutes", "macro", "flags"],
        f"""SELECT d.event_id AS candidate_id, d.k = 0 AS urgent,
            NOT EXISTS (SELECT 1 FROM ev e WHERE e.user_id = d.user_id AND e.event_type = 'error' AND e.ts::DATE = d.ts::DATE) AS tests_passed,
            (SELECT avg(error_rate) FROM minutes m WHERE m.service = d.service AND m.ts BETWEEN q.window_start AND q.window_end) AS baseline_error_rate,
            (SELECT avg(latency_p95) FROM minutes m WHERE m.service = d.service AND m.ts BETWEEN q.window_start AND q.window_end) AS baseline_p95,
            (SELECT avg(error_rate) FROM minutes m WHERE m.service = d.service AND m.ts > d.ts AND m.ts <= d.ts + to_seconds({QUIET_ROWS * STEP})) AS candidate_error_rate,
            (SELECT avg(latency_p95) FROM minutes m WHERE m.service = d.service AND m.ts > d.ts AND m.ts <= d.ts + to_seconds({QUIET_ROWS * STEP})) AS candidate_p95,
            CASE WHEN d.k <> 0 THEN (SELECT macro_f1 FROM macro WHERE model = 'candidate') END AS model_macro_f1,
            (SELECT min(f.budget_remaining) FROM flags f WHERE f.service = d.service AND f.ts + to_seconds({STEP}) =
              (SELECT max(g.ts) + to_seconds({STEP}) FROM flags g WHERE g.service = d.service AND g.ts + to_seconds({STEP}) <= d.ts)) AS budget
            FROM ev d LEFT JOIN quiet q ON q.service = d.service WHERE d.event_type = 'signup' AND d.k < 10""",
    ),
    "checks": (
        ["candidates", "macro", "status"],
        f"""SELECT candidate_id, check_no, "check", coalesce(passed, false) AS passed, measured, threshold, detail FROM (
            SELECT candidate_id, 1 AS check_no, 'Tests' AS "check", tests_passed AS passed, tests_passed::INT::DOUBLE AS measured, 1.0::DOUBLE AS threshold, 'reported by the CI test job' AS detail FROM candidates
            UNION ALL SELECT candidate_id, 2, 'Canary: error rate', (candidate_error_rate - baseline_error_rate) * 100 <= 0.2, (candidate_error_rate - baseline_error_rate) * 100, 0.2, 'replay of recorded traffic' FROM candidates
            UNION ALL SELECT candidate_id, 3, 'Canary: p95 latency', candidate_p95 / baseline_p95 - 1 <= 0.1, candidate_p95 / baseline_p95 - 1, 0.1, 'replay of recorded traffic' FROM candidates
            UNION ALL SELECT candidate_id, 4, 'Model: macro F1', coalesce(model_macro_f1, f) >= f - 0.02::DOUBLE, coalesce(model_macro_f1, f) - f, -0.02,
              CASE WHEN model_macro_f1 IS NULL THEN 'model unchanged' ELSE 'candidate model evaluated' END FROM candidates, (SELECT macro_f1 AS f FROM macro WHERE model = 'production')
            UNION ALL SELECT candidate_id, 5, 'Error budget', NOT coalesce(budget, w) < 0.25 OR urgent, coalesce(budget, w), 0.25,
              CASE WHEN urgent AND coalesce(budget, w) < 0.25 THEN 'urgent release: exempt from the freeze' ELSE 'error budget policy' END
              FROM candidates, (SELECT min(1.0 - share / {1 - PS.TARGET!r}::DOUBLE) AS w FROM status))""",
    ),
    "hist": (
        ["ev"],
        "SELECT event_type AS route, le, count(*) FILTER (value / 1000.0::DOUBLE <= le) AS n FROM ev, unnest([" + ", ".join(map(repr, K.LATENCY_BUCKETS_S)) + ", 'inf'::DOUBLE]) u(le) GROUP BY 1, 2",
    ),
}


def _sql(body: str, *needs: str) -> str:
    import re

    return re.sub(r'(?<![\w."])at(?![\w"])', '"at"', sql(body, *needs, blocks=BLOCKS))


def psi(spark, d):
    """Early against late shipments, per numeric column and return flag."""
    items = fixture(spark, d).table("lineitem")
    span = items.agg(((F.max(F.unix_micros("l_shipdate")) + F.min(F.unix_micros("l_shipdate"))) / 2).alias("m")).scalar()
    long = items.withColumn("ref", F.unix_micros("l_shipdate") < span).unpivot(["l_returnflag", "ref"], COLUMNS, "name", "v")
    ref, cur = long.filter("ref").drop("ref"), long.filter("NOT ref").drop("ref")
    return rounded(R.psi(ref, cur, ["l_returnflag", "name"], "v"))


def _middle(fx):
    """The middle of the recording: what came before is the reference."""
    ends = F.unix_micros(F.min("ts")) + F.unix_micros(F.max("ts"))
    return fx.minutes.agg(F.timestamp_micros(F.floor(ends / 2))).scalar()


def _signal_drift(fx):
    cut_at = _middle(fx)
    return R.signal_drift(fx.minutes.filter(F.col("ts") < cut_at), fx.minutes.filter(F.col("ts") >= cut_at))


def signal_drift(spark, d):
    return _signal_drift(fixture(spark, d))


def _feature_drift(fx):
    rows = cut(rounded(PF._features(fx), 9), "features")
    cut_at = _middle(fx)
    return R.feature_drift(rows.filter(F.col("at") < cut_at), rows.filter(F.col("at") >= cut_at), K.feature_names())


def feature_drift(spark, d):
    return _feature_drift(fixture(spark, d))


def drift_summary(spark, d):
    return rounded(R.drift_summary(_signal_drift(fixture(spark, d))))


def promotion_decision(spark, d):
    fx = fixture(spark, d)
    return rounded(R.promotion_decision(R.drift_summary(_signal_drift(fx)), PC.compare_models(spark, d)))


def quiet_window(spark, d):
    return rounded(G.quiet_window(fixture(spark, d).rollup, rows=QUIET_ROWS), 9)


def _canary(fx):
    early, late = (G.quiet_window(fx.minutes.filter(side), rows=QUIET_ROWS) for side in (F.col("ts") < _middle(fx), F.col("ts") >= _middle(fx)))
    named = lambda df, side: df.select("service", F.col("window_start").alias(f"{side}_start"), F.col("window_end").alias(f"{side}_end"))
    spans = named(early, "baseline").join(named(late, "candidate"), "service", "left")
    return G.canary_compare(fx.minutes, spans, ["service"], STEP)


def canary_compare(spark, d):
    """The quietest hours of the second half of the recording against those of the first."""
    return rounded(_canary(fixture(spark, d)))


def _candidates(fx):
    """Every deploy as a candidate, from what was recorded.

    Canary: the hours after the deploy against the service's quiet window. Tests: no error of the same user
    on that day. Model: rollbacks leave it as it is, other deploys bring the candidate. Budget: the least of
    the service's objectives at the time of the deploy. Rollbacks are urgent.
    """
    ev = X.events(fx.spark, fx.dir).withColumn("day", F.to_date("ts"))
    found = ev.filter((F.col("event_type") == "signup") & (X._k() < 10))
    found = cut(found.select(F.col("event_id").alias("candidate_id"), "user_id", "day", "service", "ts", (X._k() == 0).alias("urgent")), "releases")
    failed = ev.filter(F.col("event_type") == "error").select("user_id", "day").distinct().withColumn("failed", F.lit(True))
    quiet = G.quiet_window(fx.minutes, rows=QUIET_ROWS).select("service", F.col("window_start").alias("baseline_start"), F.col("window_end").alias("baseline_end"))
    begin = F.timestamp_seconds((F.floor(F.unix_seconds("ts") / STEP) + 1) * STEP)
    end = F.timestamp_seconds((F.floor(F.unix_seconds("ts") / STEP) + QUIET_ROWS) * STEP)
    spans = found.join(quiet, "service", "left").withColumns({"candidate_start": begin, "candidate_end": end})
    canary = G.canary_compare(fx.minutes, spans, ["candidate_id"], STEP)
    budget = S.release_freeze(found, PS._policy(fx), F.col("urgent"), STEP, PS.FREEZE).groupBy("candidate_id").agg(F.min("budget_remaining").alias("budget_override"))
    f1 = cut(PC.C.macro_f1(PC._both(fx)).select("model", "macro_f1"), "macro")
    rows = found.join(failed, ["user_id", "day"], "left").join(canary, "candidate_id", "left").join(budget, "candidate_id", "left")
    rows = rows.withColumn("f1", f1.filter("model = 'candidate'").select("macro_f1").scalar()).select(
        "candidate_id", F.col("failed").isNull().alias("tests_passed"), "baseline_error_rate", "baseline_p95", "candidate_error_rate", "candidate_p95",
        F.when(~F.col("urgent"), F.col("f1")).alias("model_macro_f1"), "urgent", "budget_override",
    )
    return rows, f1.filter("model = 'production'").select("macro_f1")


def _checks(fx):
    rows, f1 = _candidates(fx)
    return G.gate_checks(rows, f1, S.worst_budget(PS._status(fx)))


def gate_checks(spark, d):
    return rounded(_checks(fixture(spark, d)))


def gate_verdict(spark, d):
    v = G.gate_verdict(_checks(fixture(spark, d)))
    return v.withColumn("failed_checks", F.array_join(F.col("failed_checks").cast("array<string>"), ","))


def _requests(fx):
    return X.events(fx.spark, fx.dir).select("ts", F.col("event_type").alias("route"), (F.col("value") / 1000.0).alias("seconds"))


def counter_increase(spark, d):
    return rounded(D.counter_increase(_requests(fixture(spark, d)), "route", 3600, 900))


def cumulative_histogram(spark, d):
    rows = PC.scored(fixture(spark, d)).select("top_label", "confidence")
    return D.cumulative_histogram(rows, ["top_label"], "confidence", K.CONFIDENCE_BUCKETS)


def latency_quantile(spark, d):
    hist = D.cumulative_histogram(_requests(fixture(spark, d)), ["route"], "seconds", K.LATENCY_BUCKETS_S)
    return rounded(D.histogram_quantile(hist, ["route"], 0.95))


def gauges(spark, d):
    fx = fixture(spark, d)
    sli = S.sli_minutes(fx.minutes, PS.LATENCY_MS, STEP)
    burns = S.burn_alerts(sli, "bad_availability", PS.TARGET, PS.RULES, STEP)
    return rounded(D.gauges(PC.scored(fx), _signal_drift(fx), burns, fx.minutes.agg(F.max("ts"))))


_LEVEL = "CASE WHEN psi > 0.25 THEN 'significant' WHEN psi >= 0.1 THEN 'moderate' ELSE 'stable' END AS level"
QUERIES = {
    "psi": (psi, _sql("SELECT l_returnflag, name, round(psi, 6) + 0.0 AS psi FROM (" + _psi_sql("items", "l_returnflag, name", 10) + ")", "items")),
    "signal_drift": (signal_drift, _sql(f"SELECT signal, service, round(psi, 4) + 0.0 AS psi, {_LEVEL} FROM sig_psi", "sig_psi")),
    "feature_drift": (feature_drift, _sql(f"SELECT feature, round(psi, 4) + 0.0 AS psi, {_LEVEL} FROM (" + _psi_sql("fea", "feature", 5) + ")", "fea")),
    "drift_summary": (
        drift_summary,
        _sql(f"SELECT max(psi) AS max_psi, round(median(psi), 6) AS median_psi, count(*) FILTER (level = 'significant') AS significant FROM (SELECT round(psi, 4) AS psi, {_LEVEL} FROM sig_psi)", "sig_psi"),
    ),
    "promotion_decision": (
        promotion_decision,
        _sql(
            """SELECT max_psi, max_psi > 0.25 AS drift_detected, max_psi > 0.25 AS retrained, round(c.macro_f1, 6) AS candidate_macro_f1, round(p.macro_f1, 6) AS production_macro_f1,
            c.macro_f1 > p.macro_f1 AS better_macro_f1, c.fa <= p.fa AS false_alarm_not_worse, max_psi > 0.25 AND c.macro_f1 > p.macro_f1 AND c.fa <= p.fa AS promoted
            FROM (SELECT max(round(psi, 4)) AS max_psi FROM sig_psi),
            (SELECT macro_f1, (SELECT avg((y_pred <> 'unknown')::INT) FROM long_preds WHERE model = 'candidate' AND y_true = 'unknown') AS fa FROM macro WHERE model = 'candidate') c,
            (SELECT macro_f1, (SELECT avg((y_pred <> 'unknown')::INT) FROM long_preds WHERE model = 'production' AND y_true = 'unknown') AS fa FROM macro WHERE model = 'production') p""",
            "sig_psi", "macro", "long_preds",
        ),
    ),
    "quiet_window": (quiet_window, _sql("SELECT service, window_start, window_end, deviation FROM quiet", "quiet")),
    "canary_compare": (
        canary_compare,
        _sql(
            "SELECT service, " + r6("b_err AS baseline_error_rate", "b_p95 AS baseline_p95", "c_err AS candidate_error_rate", "c_p95 AS candidate_p95", "(c_err - b_err) * 100 AS error_delta_pp", "c_p95 / b_p95 - 1 AS p95_delta") + " FROM canary",
            "canary",
        ),
    ),
    "gate_checks": (gate_checks, _sql('SELECT candidate_id, check_no, "check", passed, round(measured, 6) + 0.0 AS measured, threshold, detail FROM checks', "checks")),
    "gate_verdict": (
        gate_verdict,
        _sql("SELECT candidate_id, bool_and(passed) AS passed, coalesce(string_agg(check_no::VARCHAR, ',' ORDER BY check_no) FILTER (NOT passed), '') AS failed_checks FROM checks GROUP BY 1", "checks"),
    ),
    "counter_increase": (
        counter_increase,
        """SELECT event_type AS route, time_bucket(INTERVAL '15 minutes', ts) + to_minutes(15 * (o + 1)) AS ts, count(*) AS increase, round(count(*) / 3600.0::DOUBLE, 6) AS per_second
        FROM events, range(0, 4) r(o) GROUP BY 1, 2""",
    ),
    "cumulative_histogram": (
        cumulative_histogram,
        _sql(
            "SELECT top AS top_label, le, count(*) FILTER (confidence <= le) AS count FROM scored, unnest([" + ", ".join(map(repr, K.CONFIDENCE_BUCKETS)) + ", 'inf'::DOUBLE]) u(le) GROUP BY 1, 2",
            "scored",
        ),
    ),
    "latency_quantile": (
        latency_quantile,
        _sql(
            """SELECT route, round(CASE WHEN le = 'inf'::DOUBLE THEN lo ELSE lo + (le - lo) * (0.95::DOUBLE * total - ln) / (n - ln) END, 6) AS value FROM (
            SELECT *, coalesce(lag(le) OVER w, 0.0) AS lo, coalesce(lag(n) OVER w, 0) AS ln, max(n) OVER (PARTITION BY route) AS total FROM hist WINDOW w AS (PARTITION BY route ORDER BY le))
            WHERE n >= 0.95::DOUBLE * total QUALIFY row_number() OVER (PARTITION BY route ORDER BY le) = 1""",
            "hist",
        ),
    ),
    "gauges": (
        gauges,
        _sql(
            """SELECT round(avg((production = 'unknown')::INT), 6) AS unknown_share, (SELECT max(round(psi, 4)) FROM sig_psi) AS max_psi,
            (SELECT count(DISTINCT (service, rule_no)) FROM periods WHERE slo = 'availability' AND end_ts = (SELECT max(ts) FROM sli)) AS active_burn_alerts FROM preds""",
            "preds", "sig_psi", "periods", "sli",
        ),
    ),
}
