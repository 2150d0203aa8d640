"""Registered queries: streaming jobs, files and the summary."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil import constants as K
from vigil.operators import baseline as B
from vigil.operators import drift as R
from vigil.operators import incidents as I
from vigil.operators import matching as M
from vigil.operators import slo as S
from vigil.plans import detection as PD
from vigil.plans import drift as PR
from vigil.plans import features as PF
from vigil.plans import slo as PS
from vigil.plans.common import CONSECUTIVE, DAYS, STEP, THRESHOLD, Fixture, fixture, r6, rounded, sql
from vigil.settings import cut, scratch_path
from vigil.sources import fixtures as X
from vigil.sources import tables as TB
from vigil.streaming import jobs as J

DOUBLES = PD.DOUBLES
MESSAGE = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("service", T.StringType()), T.StructField("value", T.DoubleType())])
BLOCKS = PR.BLOCKS | {
    "samples": (
        ["ev"],
        f"""SELECT ts, service, 20.0::DOUBLE AS request_rate, value AS latency_p50, value AS latency_p95, value AS latency_p99, (event_type = 'error')::INT::DOUBLE AS error_rate,
            k / 100.0::DOUBLE AS cpu_utilization, k / 100.0::DOUBLE AS memory_utilization, CASE WHEN service = '{K.DATABASE}' THEN k::DOUBLE END AS db_connections_in_use,
            (event_type IN ('click', 'view', 'purchase'))::INT AS log_info, (event_type = 'signup')::INT AS log_warn, (event_type = 'error')::INT AS log_error, value AS span_ms FROM ev""",
    ),
    # which turn of the replay an event comes in: eight days a turn, some events one turn late
    "turns": (["ev"], "SELECT *, least(3, (ts::DATE - (SELECT min(ts)::DATE FROM events)) // 8) + (k % 25 = 3)::INT AS turn FROM ev"),
    "marks": (
        ["turns"],
        "SELECT p.turn, (SELECT max(q.ts) FROM turns q WHERE q.turn < p.turn) - INTERVAL '2 minutes' AS mark FROM (SELECT DISTINCT turn FROM turns) p",
    ),
}
# every day of the second half with all rows up to it, and the reference
BLOCKS["days_sig"] = (
    ["minutes", "middle"],
    f"""SELECT d.day, s.service, s.signal, s.v, s.ts < (SELECT m FROM middle) AS ref FROM (SELECT DISTINCT ts::DATE AS day FROM minutes WHERE ts >= (SELECT m FROM middle)) d
        JOIN (UNPIVOT (SELECT ts, service, {', '.join(K.DRIFT_SIGNALS)} FROM minutes) ON {', '.join(K.DRIFT_SIGNALS)} INTO NAME signal VALUE v) s
        ON s.ts < (SELECT m FROM middle) OR s.ts::DATE <= d.day""",
)
BLOCKS["late_samples"] = (
    ["turns", "marks"],
    BLOCKS["samples"][1].replace("SELECT ts, service,", "SELECT date_trunc('hour', ts) AS ts, coalesce(date_trunc('hour', ts) + INTERVAL '1 hour' <= mark, false) AS late, service,")
    .replace("FROM ev", "FROM turns JOIN marks USING (turn)"),
)


def _sql(body: str, *needs: str) -> str:
    return sql(body, *needs, blocks=BLOCKS)


def _event_stream(spark, d):
    batch = spark.read.parquet(f"{d}/events.parquet")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    stream = J.read_table(spark, d, batch.schema, "events.parquet")
    pick = F.element_at(F.array(*[F.lit(s) for s in K.SERVICE_NAMES]), (F.col("user_id") % 5 + 1).cast("int"))
    return stream.withColumns({"ts": F.col("ts").cast("timestamp"), "service": pick})


def _samples(ev, *more):
    """Every event as one raw telemetry sample, with the columns `more`."""
    kind, k = F.col("event_type"), X._k()
    flag = lambda c: c.cast("int").cast("long")
    return ev.select(
        "ts", "service", F.lit(20.0).alias("request_rate"), F.col("value").alias("latency_p50"), F.col("value").alias("latency_p95"),
        F.col("value").alias("latency_p99"), (kind == "error").cast("int").cast("double").alias("error_rate"), (k / 100.0).alias("cpu_utilization"),
        (k / 100.0).alias("memory_utilization"), F.when(F.col("service") == K.DATABASE, k.cast("double")).alias("db_connections_in_use"),
        flag(kind.isin("click", "view", "purchase")).alias("log_info"), flag(kind == "signup").alias("log_warn"), flag(kind == "error").alias("log_error"),
        F.col("value").alias("span_ms"), *more,
    )


TURNS, LATE_TURNS = 4, 5


def _turn(ev):
    """Turn of the replay: eight days each, all that follows in the last."""
    first = ev.agg(F.min(F.to_date("ts"))).scalar()
    return F.least(F.lit(TURNS - 1), F.floor(F.datediff(F.to_date("ts"), first) / 8)).cast("int")


def _replay(spark, rows, turns, name, run):
    """Rows (their turn in column `turn`) appended turn by turn to a table that `run(stream)` goes on reading.

    Every turn is a start of the stream on the state of the last one, and one batch.
    """
    path, held = scratch_path(spark, name), cut(rows, f"{name}-held")
    for turn in range(turns):
        held.filter(F.col("turn") == turn).drop("turn").write.mode("append").parquet(path)
        found = run(J.read_table(spark, path, held.drop("turn").schema, files_per_batch=1 << 20))
    return found


def stream_ingest(spark, d):
    """Events as JSON messages, some cut off in transit, to a metrics table and dead letters."""
    ev = _event_stream(spark, d)
    whole = F.to_json(F.struct("event_id", "service", "value"))
    cut_off = (F.col("event_type") == "error") & (X._k() < 5)
    messages = ev.select(F.when(cut_off, F.substring(whole, 1, 20)).otherwise(whole).alias("value"))
    good, dead = scratch_path(spark, "metrics"), scratch_path(spark, "dead")
    J.ingest(messages, MESSAGE, good, dead, scratch_path(spark, "ingest-state"))
    rows = spark.read.schema(MESSAGE).parquet(good + "/*").groupBy("service").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("total"))
    lost = spark.read.parquet(dead + "/*").agg(F.count(F.lit(1)).alias("n")).select(F.lit("dead letter").alias("service"), "n", F.lit(None).cast("double").alias("total"))
    return rounded(rows.unionByName(lost))


def stream_minute_rollup(spark, d):
    return rounded(J.drain(J.rollup_stream(_samples(_event_stream(spark, d)), "1 hour", "2 minutes"), "rollup"))


def stream_retries(spark, d):
    """Events as messages to a consumer that refuses each of them k % 7 times: taken in, or dead after five deliveries."""
    ev = X.events(spark, d)
    message = T.StructType([*MESSAGE.fields, T.StructField("k", T.IntegerType())])
    rows = ev.withColumn("k", X._k().cast("int")).select(F.to_json(F.struct("event_id", "service", "value", "k")).alias("value"), _turn(ev).alias("turn"))
    good, dead, state = (scratch_path(spark, n) for n in ("taken", "refused", "retry-state"))
    refuse = lambda _: F.when(F.col("tries") <= F.col("r.k") % 7, "busy")
    _replay(spark, rows, TURNS, "messages", lambda stream: J.ingest(stream, message, good, dead, state, refuse=refuse))
    total = F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("total")
    n = F.count(F.lit(1)).alias("n")
    taken = spark.read.schema(message).parquet(good + "/*").groupBy("service").agg(n, total, F.lit(None).cast("int").alias("tries"))
    lost = spark.read.parquet(dead + "/*").withColumn("value", F.get_json_object("message", "$.value"))
    return rounded(taken.unionByName(lost.groupBy("tries").agg(n, total).withColumn("service", F.lit("dead letter"))))


def stream_late_rows(spark, d):
    """The hourly rollup of a replay in which some events come a turn late, with the late ones counted per window."""
    ev = X.events(spark, d)
    rows = _samples(ev.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("turn", _turn(ev) + (X._k() % 25 == 3).cast("int")), "turn")
    path = scratch_path(spark, "late-rollup")
    table = _replay(spark, rows, LATE_TURNS, "late", lambda stream: J.drain(J.rollup_stream_with_late(stream, "1 hour", "2 minutes"), "late", path))
    kept, late = table.filter("late = 0").drop("late"), table.filter("late > 0").groupBy("ts", "service").agg(F.sum("late").alias("n_late"))
    return rounded(kept.join(late, ["ts", "service"], "full").withColumn("n_late", F.coalesce("n_late", F.lit(0).cast("long"))))


def stream_burn_rules(spark, d):
    """Burn rules of both objectives over minutes that come turn by turn; periods still open at the end included."""
    fx = fixture(spark, d)
    sli = S.sli_minutes(fx.minutes, PS.LATENCY_MS, STEP)
    path = scratch_path(spark, "burn-rules")
    run = lambda stream: J.drain(J.burn_rules_stream(stream, PS.OBJECTIVES, PS.RULES, STEP), "burn-rules", path)
    events = _replay(spark, sli.withColumn("turn", _turn(sli)), TURNS, "sli", run)
    return rounded(J.latest_burn_alerts(events, PS.RULES).drop("closed"))


def stream_daily_drift(spark, d):
    """PSI of every signal and service after each day of the second half, from counts that each start adds to."""
    fx, keys = fixture(spark, d), ["signal", "service"]
    middle = PR._middle(fx)
    late = fx.minutes.filter(F.col("ts") >= middle)
    before = fx.minutes.filter(F.col("ts") < middle).unpivot(["service"], K.DRIFT_SIGNALS, "signal", "value")
    edges = cut(R.bin_edges(before, keys, "value"), "edges")
    path = scratch_path(spark, "daily-drift")
    long = lambda stream: stream.unpivot(["ts", "service"], K.DRIFT_SIGNALS, "signal", "value")
    counts = _replay(spark, late.withColumn("turn", _turn(late)), TURNS, "days", lambda stream: J.drift_counts(long(stream), edges, keys, "value", path))
    return R.drift_by_day(edges, R.bin_counts(before, edges, keys, "value"), counts, keys)


def _minute_stream(fx: Fixture):
    path = scratch_path(fx.spark, "closed-minutes")
    fx.rollup.repartition(4, "service").sortWithinPartitions("ts").write.parquet(path)
    return J.read_table(fx.spark, path, fx.rollup.schema)


def _z(fx: Fixture):
    numbered = _minute_stream(fx).join(fx.timeline, "ts")  # small tables may miss whole hours
    return J.drain(J.ewma_stream(numbered, F.col("rn")), "z")


def stream_ewma(spark, d):
    return rounded(B.long_z(_z(fixture(spark, d))))


def stream_ewma_alerts(spark, d):
    fx = fixture(spark, d)
    scores = B.minute_score(_z(fx), fx.timeline, B.first_key(fx.minutes, fx.timeline))
    path = scratch_path(spark, "scores")
    scores.write.parquet(path)
    found = J.drain(J.alert_stream(J.read_table(spark, path, scores.schema), THRESHOLD, CONSECUTIVE), "alerts")
    return rounded(J.latest_alerts(found).drop("series", "closed"))


def stream_burn(spark, d):
    fx = fixture(spark, d)
    sli = S.sli_minutes(_minute_stream(fx), PS.LATENCY_MS, STEP)
    return rounded(J.drain(J.burn_stream(sli, "bad_availability", PS.TARGET, PS.WINDOWS), "burn"))


def csv_roundtrip(spark, d):
    path = scratch_path(spark, "logs")
    TB.write_csv(fixture(spark, d).logs, path)
    return TB.read_csv(spark, path, TB.LOG_SCHEMA)


def minutes_sink(spark, d):
    path = scratch_path(spark, "minutes-by-day")
    TB.write_minutes(fixture(spark, d).rollup, path)
    return spark.read.parquet(path).select("ts", "service", *[F.col(s) if how == "sum" else F.round(F.col(s).cast("double"), 3).alias(s) for s, how in K.SIGNALS.items()])


def minutes_wide(spark, d):
    path = scratch_path(spark, "minutes-wide")
    TB.write_minutes_wide(fixture(spark, d).rollup, path, list(K.SIGNALS))
    return rounded(TB.read_minutes_wide(spark, path).filter(F.col("value").isNotNull()), 3)


def report_json(spark, d):
    report = PS._status(fixture(spark, d))
    path = scratch_path(spark, "report")
    TB.write_report(report, path)
    return rounded(TB.read_report(spark, path, report.schema).select("service", "slo", "sli", "budget_remaining", "window_days"))


def ground_truth(spark, d):
    return TB.ground_truth(fixture(spark, d).faults)


def incident_windows(spark, d):
    fx = fixture(spark, d)
    keyed = I.number_incidents(fx.alerts).select("incident_id", F.concat(F.lit("A"), F.unix_seconds("fired_at").cast("string")).alias("probe_id"))
    feats = PF._features(fx).join(keyed, "probe_id")
    table = cut(TB.incident_windows(PF._incidents(fx), feats, K.feature_names()), "incident-windows")
    shown = ["services_with_errors", "min_since_any_deploy", "culprit_depth"]
    return rounded(table.select(
        "incident_id", "fired_at", "predicted", "confidence", "label",
        *[F.get_json_object("features", f"$.{f}").cast("double").alias(f) for f in shown],
    ))


def summary(spark, d):
    """One row per headline number."""
    fx = fixture(spark, d)
    card = M.scorecard(fx.alerts, fx.faults, DAYS, STEP).unpivot([], ["recall", "median_ttd_min", "false_alerts_per_day", "precision"], "metric", "value")
    worst = S.worst_budget(PS._status(fx)).select(F.lit("worst_budget_remaining").alias("metric"), F.col("budget_remaining").alias("value"))
    psi = PR._signal_drift(fx).agg(F.max("psi").alias("value")).select(F.lit("max_psi").alias("metric"), "value")
    passed = PR.G.gate_verdict(PR._checks(fx)).agg(F.avg(F.col("passed").cast("double")).alias("value")).select(F.lit("gate_pass_share").alias("metric"), "value")
    return rounded(card.unionByName(worst).unionByName(psi).unionByName(passed))


QUERIES = {
    "stream_ingest": (
        stream_ingest,
        _sql(
            """SELECT service, count(*) AS n, round(sum(value::DECIMAL(18,2))::DOUBLE, 6) AS total FROM ev WHERE NOT (event_type = 'error' AND k < 5) GROUP BY service
            UNION ALL SELECT 'dead letter', count(*), NULL FROM ev WHERE event_type = 'error' AND k < 5""",
            "ev",
        ),
    ),
    "stream_retries": (
        stream_retries,
        _sql(
            """SELECT service, count(*) AS n, round(sum(value::DECIMAL(18,2))::DOUBLE, 6) AS total, NULL::INTEGER AS tries FROM ev WHERE k % 7 < 5 GROUP BY service
            UNION ALL SELECT 'dead letter', count(*), round(sum(value::DECIMAL(18,2))::DOUBLE, 6), 5 FROM ev WHERE k % 7 >= 5""",
            "ev",
        ),
    ),
    "stream_late_rows": (
        stream_late_rows,
        _sql(
            "SELECT ts, service, count(*) FILTER (WHERE late) AS n_late, "
            + ", ".join(f"round({'max' if K.SIGNALS[s] == 'max' else 'avg'}({s}) FILTER (WHERE NOT late), 6) + 0.0 AS {s}" for s in DOUBLES)
            + ", " + ", ".join(f"(sum({s}) FILTER (WHERE NOT late))::BIGINT AS {s}" for s in ("log_info", "log_warn", "log_error"))
            + " FROM late_samples GROUP BY 1, 2 HAVING ts + INTERVAL '1 hour' <= (SELECT max(ts) FROM events) - INTERVAL '2 minutes'",
            "late_samples",
        ),
    ),
    "stream_daily_drift": (
        stream_daily_drift,
        _sql("SELECT day, signal, service, round(psi, 4) + 0.0 AS psi, " + PR._LEVEL + " FROM (" + PR._psi_sql("days_sig", "day, signal, service", 10) + ")", "days_sig"),
    ),
    "stream_burn_rules": (stream_burn_rules, _sql(PS.PERIODS, "periods", "rule_burn")),
    "stream_minute_rollup": (
        stream_minute_rollup,
        _sql(
            "SELECT date_trunc('hour', ts) AS ts, service, "
            + r6(*[f"{'max' if K.SIGNALS[s] == 'max' else 'avg'}({s}) AS {s}" for s in DOUBLES])
            + """, sum(log_info)::BIGINT AS log_info, sum(log_warn)::BIGINT AS log_warn, sum(log_error)::BIGINT AS log_error FROM samples GROUP BY 1, 2
            HAVING date_trunc('hour', ts) + INTERVAL '1 hour' <= (SELECT max(ts) FROM events) - INTERVAL '2 minutes'""",
            "samples",
        ),
    ),
    "stream_ewma": (stream_ewma, _sql("SELECT ts, service, signal, round(z, 6) + 0.0 AS z FROM z", "z")),
    "stream_ewma_alerts": (
        stream_ewma_alerts,
        _sql(
            f"""SELECT f.ts AS fired_at, b.ts AS started_at, e.ts AS ended_at, p.service, p.signal, round(m.apeak, 6) AS peak
            FROM machine m JOIN scores f ON f.rn = m.fired JOIN scores b ON b.rn = m.astart JOIN scores e ON e.rn = m.rn JOIN scores p ON p.rn = m.apeak_rn
            WHERE (m.closed OR (m.open AND m.rn = (SELECT max(rn) FROM scores))) AND m.threshold = {THRESHOLD} AND m.consecutive = {CONSECUTIVE}""",
            "machine", "scores",
        ),
    ),
    "stream_burn": (stream_burn, _sql("SELECT service, ts, " + r6(*[f"burn_{w}" for w in PS.WINDOWS]) + " FROM burn", "burn")),
    "csv_roundtrip": (csv_roundtrip, _sql("SELECT log_id, ts, service, level, message FROM logs", "logs")),
    "minutes_sink": (
        minutes_sink,
        _sql(
            "SELECT ts, service, " + ", ".join(s if how == "sum" else f"round({s}::FLOAT::DOUBLE, 3) AS {s}" for s, how in K.SIGNALS.items()) + " FROM minutes",
            "minutes",
        ),
    ),
    "minutes_wide": (
        minutes_wide,
        _sql(
            "SELECT ts, service, signal, round(v::FLOAT::DOUBLE, 3) + 0.0 AS value FROM (UNPIVOT (SELECT ts, service, " + ", ".join(f"{s}::DOUBLE AS {s}" for s in K.SIGNALS)
            + " FROM minutes) ON " + ", ".join(K.SIGNALS) + " INTO NAME signal VALUE v)",
            "minutes",
        ),
    ),
    "report_json": (
        report_json,
        _sql(
            f"""SELECT service, 'availability' AS slo, {r6('1.0 - share AS sli', f'1.0 - share / {1 - PS.TARGET!r}::DOUBLE AS budget_remaining')},
            round(epoch(t1 - t0) / 86400.0 + {STEP} / 86400.0, 2) AS window_days FROM status""",
            "status",
        ),
    ),
    "ground_truth": (ground_truth, _sql('SELECT fault_id, category, service, start_ts AS "start", end_ts AS "end", detail FROM faults', "faults")),
    "incident_windows": (
        incident_windows,
        PF._sql(
            "SELECT incident_id, fired_at, predicted, round(confidence, 3) AS confidence, truth AS label, services_with_errors, round(min_since_any_deploy, 6) AS min_since_any_deploy, culprit_depth FROM inc",
            "inc",
        ),
    ),
    "summary": (
        summary,
        _sql(
            f"""SELECT metric, round(value, 6) + 0.0 AS value FROM (UNPIVOT (SELECT recall, median_ttd_min, false_alerts_per_day, precision FROM card WHERE threshold = {THRESHOLD} AND consecutive = {CONSECUTIVE})
              ON recall, median_ttd_min, false_alerts_per_day, precision INTO NAME metric VALUE value)
            UNION ALL SELECT 'worst_budget_remaining', round(min(1.0 - share / {1 - PS.TARGET!r}::DOUBLE), 6) FROM status
            UNION ALL SELECT 'max_psi', max(round(psi, 4)) FROM sig_psi
            UNION ALL SELECT 'gate_pass_share', round(avg(p::INT), 6) FROM (SELECT bool_and(passed) AS p FROM checks GROUP BY candidate_id)""",
            "card", "status", "sig_psi", "checks",
        ),
    ),
}
