"""What the registered queries share: the fixture tables, rounding, and SQL building blocks.

SQL blocks are written independently of the Spark form (theta joins and recursive state machines
where the operators use cells, folds and windows), so that agreement means something.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil import constants as K
from vigil.operators import alerts as A
from vigil.operators import baseline as B
from vigil.operators import rollup as R
from vigil.settings import cut
from vigil.sources import fixtures as X

THRESHOLD, CONSECUTIVE = 3.0, 2
SWEEP_T, SWEEP_N = [float(t) for t in K.EWMA_THRESHOLDS], [1, 2, 3]
DAYS = 30.0
STEP = X.GRAIN


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded for comparison; -0.0 becomes 0.0."""
    return df.select(
        *[
            (F.round(F.col(f"`{f.name}`"), digits) + F.lit(0.0)).alias(f.name)
            if f.dataType.typeName() in ("double", "float")
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


class Fixture:
    """Lazy tables of one test folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return X.load(self.spark, self.dir, name)

    @cached_property
    def raw(self) -> DataFrame:
        return X.telemetry(self.spark, self.dir)

    @cached_property
    def rollup(self) -> DataFrame:
        return rounded(R.to_minutes(self.raw, X.GRAIN), 10)

    # Raw events are scanned once. What follows reads the stored rollup, as the pipeline does.
    @cached_property
    def minutes(self) -> DataFrame:
        return cut(self.rollup, "minutes")

    @cached_property
    def timeline(self) -> DataFrame:
        return cut(R.number_rows(self.minutes), "timeline")

    @cached_property
    def z(self) -> DataFrame:
        return B.ewma_z(self.minutes, self.timeline)

    @cached_property
    def scores(self) -> DataFrame:
        first = B.first_key(self.minutes, self.timeline)
        return cut(B.minute_score(self.z, self.timeline, first), "scores")

    @cached_property
    def alerts(self) -> DataFrame:
        found = A.runs_to_alerts(self.scores, [THRESHOLD], [CONSECUTIVE], self.timeline)
        return cut(found.drop(*A.SETTING), "alerts")

    @cached_property
    def sweep_alerts(self) -> DataFrame:
        return cut(A.runs_to_alerts(self.scores, SWEEP_T, SWEEP_N, self.timeline), "sweep")

    @cached_property
    def faults(self) -> DataFrame:
        return X.faults(self.spark, self.dir)

    @cached_property
    def deploys(self) -> DataFrame:
        return X.deploys(self.spark, self.dir)

    @cached_property
    def logs(self) -> DataFrame:
        return X.logs(self.spark, self.dir)


STORED: dict = {}


def fixture(spark: SparkSession, sf_dir: str) -> Fixture:
    """The fixture of a folder, kept for the application: stored rollups are written once."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in STORED:
        STORED[key] = Fixture(spark, sf_dir)
    return STORED[key]


def forget() -> None:
    """Start over, so that the next query pays for everything it needs."""
    STORED.clear()


def _values(rows: list[tuple]) -> str:
    def lit(v):
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v)

    return "(VALUES " + ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows) + ")"


def _signal_agg() -> str:
    sql = {"avg": "round(avg({0}), 10)", "max": "round(max({0}), 10)", "sum": "CAST(sum({0}) AS BIGINT)"}
    return ", ".join(f"{sql[how].format(s)} AS {s}" for s, how in K.SIGNALS.items())


_SERVICE_CASE = "CASE user_id % 5 " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(K.SERVICE_NAMES)) + " END"
_CATEGORY_CASE = "CASE (user_id // 5) % 5 " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(X.CATEGORIES)) + " END"
_K = "CAST(json_extract_string(props, '$.k') AS INTEGER)"
_DETECT = ", ".join(K.STD_FLOOR)

BLOCKS: dict[str, tuple[list[str], str]] = {
    "svc": ([], f"SELECT * FROM {_values([(s, i, d) for i, (s, d) in enumerate(K.SERVICES)])} t(service, service_order, depth)"),
    "calls": ([], f"SELECT * FROM {_values(K.CALLS)} t(caller, callee, share, per_request)"),
    "floors": ([], f"SELECT * FROM {_values([(s, i, a, r) for i, (s, (a, r)) in enumerate(K.STD_FLOOR.items())])} t(signal, signal_order, abs_floor, rel_floor)"),
    "settings": (
        [],
        f"SELECT * FROM {_values([(t, n, i) for i, (n, t) in enumerate((n, t) for n in SWEEP_N for t in SWEEP_T)])} t(threshold, consecutive, setting_no)",
    ),
    "ev": ([], f"SELECT *, {_SERVICE_CASE} AS service, {_K} AS k FROM events"),
    "raw": (
        ["ev"],
        f"""SELECT time_bucket(INTERVAL '15 minutes', ts) AS ts, service, count(*) * 20.0::DOUBLE AS request_rate,
            m AS latency_p50, m + 0.8::DOUBLE * (max(value) - m) AS latency_p95, max(value) AS latency_p99,
            sum((event_type = 'error')::INT)::DOUBLE / count(*) AS error_rate,
            sum(k)::DOUBLE / count(*) / 100.0::DOUBLE AS cpu_utilization, max(k) / 100.0::DOUBLE AS memory_utilization,
            max(CASE WHEN service = '{K.DATABASE}' THEN k::DOUBLE END) AS db_connections_in_use,
            sum((event_type IN ('click', 'view', 'purchase'))::INT)::BIGINT AS log_info,
            sum((event_type = 'signup')::INT)::BIGINT AS log_warn, sum((event_type = 'error')::INT)::BIGINT AS log_error,
            min(value) AS span_ms
            FROM (SELECT *, sum(value::DECIMAL(18,2)) OVER (PARTITION BY service, time_bucket(INTERVAL '15 minutes', ts))::DOUBLE
                  / count(*) OVER (PARTITION BY service, time_bucket(INTERVAL '15 minutes', ts)) AS m FROM ev)
            GROUP BY time_bucket(INTERVAL '15 minutes', ts), service, m""",
    ),
    "minutes": (["raw"], f"SELECT date_trunc('hour', ts) AS ts, service, {_signal_agg()} FROM raw GROUP BY 1, 2"),
    "timeline": (["minutes"], "SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS rn FROM (SELECT DISTINCT ts FROM minutes)"),
    "deploys": (
        ["ev"],
        "SELECT ts, service, 'v' || k AS version, CASE WHEN k = 0 THEN 'rollback' ELSE 'deploy' END AS kind FROM ev WHERE event_type = 'signup' AND k < 10",
    ),
    "faults": (
        ["ev"],
        f"""SELECT 'F' || event_id AS fault_id, event_id AS fault_order, {_CATEGORY_CASE} AS category, service,
            date_trunc('minute', ts) AS start_ts, date_trunc('minute', ts) + to_hours(event_id % 6 + 1) AS end_ts,
            'purchase ' || event_id AS detail FROM ev WHERE event_type = 'purchase' AND k = 99""",
    ),
    "logs": (
        ["ev"],
        """SELECT event_id AS log_id, ts, service, CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARN' ELSE 'INFO' END AS level,
            event_type || ' ' || user_id AS message FROM ev""",
    ),
    "obs": (["minutes"], f"SELECT * FROM (UNPIVOT (SELECT ts, service, {_DETECT} FROM minutes) ON {_DETECT} INTO NAME signal VALUE x)"),
    "dense": (
        ["timeline", "svc", "floors", "obs"],
        """SELECT t.rn, t.ts, s.service, s.service_order, f.*, o.x FROM timeline t CROSS JOIN svc s CROSS JOIN floors f
            LEFT JOIN obs o ON o.ts = t.ts AND o.service = s.service AND o.signal = f.signal""",
    ),
    "zrec": (
        ["dense"],
        """SELECT rn, service, signal, coalesce(x, 0.0) AS mean, 0.0::DOUBLE AS var, NULL::DOUBLE AS z FROM dense WHERE rn = 0
            UNION ALL
            SELECT rn, service, signal, mean + 0.03 * (u - mean), 0.97 * (var + 0.03 * (u - mean) * (u - mean)),
              CASE WHEN x IS NOT NULL AND rn >= 30 THEN greatest((x - mean) / std, 0.0) END
            FROM (SELECT *, CASE WHEN x IS NULL THEN mean WHEN rn < 30 THEN x ELSE least(greatest(x, mean - 4.0 * std), mean + 4.0 * std) END AS u
              FROM (SELECT d.rn, d.service, d.signal, d.x, p.mean, p.var, greatest(sqrt(p.var), d.abs_floor, d.rel_floor * abs(p.mean)) AS std
                FROM zrec p JOIN dense d ON d.rn = p.rn + 1 AND d.service = p.service AND d.signal = p.signal))""",
    ),
    "z": (
        ["zrec", "dense"],
        "SELECT d.ts, d.rn, d.service, d.signal, d.signal_order * 10 + d.service_order AS col_order, r.z FROM zrec r JOIN dense d USING (rn, service, signal) WHERE r.z IS NOT NULL",
    ),
    "zfull": (
        ["z", "timeline"],
        """SELECT t.ts, t.rn, c.service, c.signal, c.col_order, coalesce(z.z, 0.0) AS z FROM timeline t
            CROSS JOIN (SELECT DISTINCT service, signal, col_order FROM z) c LEFT JOIN z ON z.rn = t.rn AND z.col_order = c.col_order""",
    ),
    "scores": (
        ["zfull"],
        """SELECT ts, rn, z AS score, signal, service FROM (SELECT *, row_number() OVER (PARTITION BY rn ORDER BY z DESC, col_order) AS pick FROM zfull)
            WHERE pick = 1""",
    ),
    "machine": (
        ["settings", "scores"],
        """SELECT threshold, consecutive, -1::BIGINT AS rn, 0 AS run, 0 AS quiet, false AS open, 0::BIGINT AS rstart, 0.0::DOUBLE AS rpeak, 0::BIGINT AS rpeak_rn,
              0::BIGINT AS fired, 0::BIGINT AS astart, 0.0::DOUBLE AS apeak, 0::BIGINT AS apeak_rn, false AS closed FROM settings
            UNION ALL
            SELECT threshold, consecutive, nrn, nrun, CASE WHEN up OR NOT open THEN 0 ELSE quiet + 1 END,
              opening OR (open AND NOT closing), nrstart, nrpeak, nrpeak_rn,
              CASE WHEN opening THEN nrn ELSE fired END, CASE WHEN opening THEN nrstart ELSE astart END,
              CASE WHEN opening THEN nrpeak WHEN open AND up AND sc > apeak THEN sc ELSE apeak END,
              CASE WHEN opening THEN nrpeak_rn WHEN open AND up AND sc > apeak THEN nrn ELSE apeak_rn END, closing
            FROM (SELECT *, up AND NOT open AND nrun >= consecutive AS opening, NOT up AND open AND quiet + 1 >= 5 AS closing
              FROM (SELECT p.*, s.rn AS nrn, s.score AS sc, s.score > p.threshold AS up,
                  CASE WHEN s.score > p.threshold THEN p.run + 1 ELSE 0 END AS nrun,
                  CASE WHEN p.run = 0 THEN s.rn ELSE p.rstart END AS nrstart,
                  CASE WHEN p.run = 0 OR s.score > p.rpeak THEN s.score ELSE p.rpeak END AS nrpeak,
                  CASE WHEN p.run = 0 OR s.score > p.rpeak THEN s.rn ELSE p.rpeak_rn END AS nrpeak_rn
                FROM machine p JOIN scores s ON s.rn = p.rn + 1))""",
    ),
    "sweep_alerts": (
        ["machine", "scores"],
        """SELECT m.threshold, m.consecutive, f.ts AS fired_at, b.ts AS started_at, e.ts AS ended_at, p.service, p.signal, m.apeak AS peak
            FROM machine m JOIN scores f ON f.rn = m.fired JOIN scores b ON b.rn = m.astart JOIN scores e ON e.rn = m.rn JOIN scores p ON p.rn = m.apeak_rn
            WHERE m.closed OR (m.open AND m.rn = (SELECT max(rn) FROM scores))""",
    ),
    "alerts": (["sweep_alerts"], f"SELECT * EXCLUDE (threshold, consecutive) FROM sweep_alerts WHERE threshold = {THRESHOLD} AND consecutive = {CONSECUTIVE}"),
    "pairs": (
        ["sweep_alerts", "faults"],
        """SELECT a.threshold, a.consecutive, a.fired_at, f.fault_id, f.fault_order, f.category, f.start_ts FROM sweep_alerts a JOIN faults f
            ON (a.fired_at >= f.start_ts AND a.fired_at <= f.end_ts + INTERVAL '15 minutes') OR (a.fired_at < f.start_ts AND f.start_ts <= a.ended_at)""",
    ),
    "firsts": (
        ["pairs"],
        """SELECT threshold, consecutive, fault_id, fault_order, category, start_ts, min(fired_at) AS fired_at,
            greatest(0.0, epoch(min(fired_at) - start_ts) / 60.0) AS ttd FROM pairs GROUP BY threshold, consecutive, fault_id, fault_order, category, start_ts""",
    ),
    "own": (
        ["alerts", "faults"],
        """SELECT a.fired_at, arg_min(f.fault_id, f.fault_order) AS owner, arg_min(f.category, f.fault_order) AS owner_category FROM alerts a JOIN faults f
            ON (a.fired_at >= f.start_ts - INTERVAL '1 minute' AND a.fired_at <= f.end_ts + INTERVAL '15 minutes')
              OR (a.fired_at < f.start_ts AND f.start_ts <= a.ended_at) GROUP BY a.fired_at""",
    ),
    "card": (
        ["settings", "sweep_alerts", "faults", "pairs", "firsts"],
        f"""SELECT s.threshold, s.consecutive, s.setting_no, coalesce(d.detected, 0) / greatest(i.n, 1)::DOUBLE AS recall, d.median_ttd_min,
            (coalesce(a.n, 0) - coalesce(h.n, 0)) / {DAYS}::DOUBLE AS false_alerts_per_day,
            CASE WHEN a.n > 0 THEN coalesce(h.n, 0) / a.n::DOUBLE ELSE 0.0 END AS precision,
            coalesce(a.n, 0) AS alerts, coalesce(h.n, 0) AS true_alerts, coalesce(a.n, 0) - coalesce(h.n, 0) AS false_alerts,
            coalesce(d.detected, 0) AS detected, i.n AS incidents
            FROM settings s CROSS JOIN (SELECT count(*) AS n FROM faults) i
            LEFT JOIN (SELECT threshold, consecutive, count(*) AS n FROM sweep_alerts GROUP BY 1, 2) a USING (threshold, consecutive)
            LEFT JOIN (SELECT threshold, consecutive, count(DISTINCT fired_at) AS n FROM pairs GROUP BY 1, 2) h USING (threshold, consecutive)
            LEFT JOIN (SELECT threshold, consecutive, count(*) AS detected, median(ttd) AS median_ttd_min FROM firsts GROUP BY 1, 2) d USING (threshold, consecutive)""",
    ),
}


def sql(body: str, *needs: str, blocks: dict | None = None) -> str:
    """`body` preceded by the blocks it needs, in dependency order."""
    known = BLOCKS | (blocks or {})
    chosen: list[str] = []

    def add(name: str) -> None:
        if name not in chosen:
            for dep in known[name][0]:
                add(dep)
            if name not in chosen:
                chosen.append(name)

    for name in needs:
        add(name)
    if not chosen:
        return body
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({known[n][1]})" for n in chosen) + "\n" + body


def r6(*columns: str, digits: int = 6) -> str:
    """SQL select items rounded under their own name."""
    return ", ".join(f"round({c.split(' AS ')[0]}, {digits}) + 0.0 AS {c.split(' AS ')[-1]}" for c in columns)
