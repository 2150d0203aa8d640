"""Registered queries: service level objectives."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil import constants as K
from vigil.functions import stats
from vigil.operators import slo as S
from vigil.plans.common import STEP, Fixture, fixture, r6, rounded, sql

TARGET = 0.8  # a fifth of the test events are errors
LATENCY_TARGET, LATENCY_MS = 0.9, 150.0
OBJECTIVES = [("availability", "bad_availability", TARGET), ("latency", "bad_latency", LATENCY_TARGET)]
RULES = [("page", 21600, 3600, 1.4), ("page", 86400, 10800, 1.1), ("ticket", 259200, 21600, 0.9)]
#: Policy rules: both windows above FAST, the day's burn above SLOW for two hours, less than FREEZE of the budget left.
FAST, SLOW, SLOW_HOLD, FREEZE, BUDGET_ROWS = 1.4, 1.1, 7200, K.BUDGET_FREEZE, 240
WINDOWS = [3600, 10800, 21600, 86400, 259200]


def _horner(cs, x):
    out = repr(cs[0])
    for c in cs[1:]:
        out = f"({out} * {x} + {c!r}::DOUBLE)"
    return out


def _phi(x: str) -> str:
    a = f"abs({x})"
    lower = f"(CASE WHEN {a} > 37 THEN 0.0 WHEN {a} < 7.07106781186547 THEN exp(-{a} * {a} / 2.0) * {_horner(stats.PHI_NUM, a)} / {_horner(stats.PHI_DEN, a)} ELSE exp(-{a} * {a} / 2.0) / ({a} + 1.0 / ({a} + 2.0 / ({a} + 3.0 / ({a} + 4.0 / ({a} + 0.65))))) / 2.506628274631 END)"
    return f"(CASE WHEN {x} > 0 THEN 1.0 - {lower} ELSE {lower} END)"


BLOCKS = {
    "shares": (
        ["minutes"],
        f"""SELECT *, {_phi('q')} AS good FROM (SELECT ts, service, request_rate, error_rate,
            (ln({LATENCY_MS}::DOUBLE) - ln(lo)) / (ln(hi / lo) / {stats.Z_95!r}::DOUBLE) AS q
            FROM (SELECT *, greatest(latency_p95, lo * 1.0001::DOUBLE) AS hi FROM (SELECT *, greatest(latency_p50, 1e-3) AS lo FROM minutes)))""",
    ),
    "sli": (
        ["shares"],
        f"""SELECT ts, service, request_rate * {float(STEP)}::DOUBLE AS total, request_rate * {float(STEP)}::DOUBLE * greatest(0.0, least(1.0, error_rate)) AS bad_availability,
            request_rate * {float(STEP)}::DOUBLE * (1.0 - good) AS bad_latency FROM shares""",
    ),
    "objectives": (
        ["sli"],
        " UNION ALL ".join(f"SELECT ts, service, '{n}' AS slo, {t!r}::DOUBLE AS target, {c} AS bad, total FROM sli" for n, c, t in OBJECTIVES),
    ),
    "rules": ([], "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{s}', {lo}, {sh}, {th}::DOUBLE)" for i, (s, lo, sh, th) in enumerate(RULES)) + ") t(rule_no, severity, long_s, short_s, threshold)"),
    "burn_all": (
        ["objectives"],
        "SELECT service, slo, ts, " + ", ".join(
            f"(sum(bad) OVER w{w} / nullif(sum(total) OVER w{w}, 0)) / (1.0 - target) AS burn_{w}" for w in WINDOWS
        ) + " FROM objectives WINDOW " + ", ".join(f"w{w} AS (PARTITION BY service, slo ORDER BY ts RANGE BETWEEN INTERVAL '{w - 1} seconds' PRECEDING AND CURRENT ROW)" for w in WINDOWS),
    ),
    "burn": (["burn_all"], "SELECT * EXCLUDE (slo) FROM burn_all WHERE slo = 'availability'"),
    "rule_burn": (
        ["burn_all", "rules"],
        f"""SELECT service, slo, ts, rule_no, severity, long_s, short_s, threshold, long_burn,
            coalesce(long_burn > threshold AND short_burn > threshold, false) AND ts >= (min(ts) OVER (PARTITION BY service, slo)) + to_seconds(long_s - {STEP}) AS is_on
            FROM (SELECT b.*, r.*, CASE r.long_s {' '.join(f'WHEN {w} THEN burn_{w}' for w in WINDOWS)} END AS long_burn,
              CASE r.short_s {' '.join(f'WHEN {w} THEN burn_{w}' for w in WINDOWS)} END AS short_burn FROM burn_all b CROSS JOIN rules r)""",
    ),
    # a period is named by the first quiet row after it, found by a correlated lookup
    "periods": (
        ["rule_burn"],
        """SELECT a.service, a.slo, a.rule_no, a.severity, a.long_s, a.short_s, a.threshold, a.ts,
            coalesce((SELECT min(q.ts) FROM rule_burn q WHERE q.service = a.service AND q.slo = a.slo AND q.rule_no = a.rule_no AND q.ts > a.ts AND NOT q.is_on),
              (SELECT max(q.ts) FROM rule_burn q WHERE q.service = a.service AND q.slo = a.slo AND q.rule_no = a.rule_no)) AS end_ts FROM rule_burn a WHERE a.is_on""",
    ),
    "flags": (
        ["burn_all", "objectives"],
        f"""SELECT *, round(burn_21600, 9) > {FAST} AND round(burn_3600, 9) > {FAST} AS fast, round(burn_86400, 9) > {SLOW} AS slow, budget_remaining < {FREEZE} AS low,
            row_number() OVER (PARTITION BY service, slo ORDER BY ts) AS rn FROM burn_all JOIN
            (SELECT service, slo, ts, round(1.0 - coalesce(sum(bad) OVER w / nullif(sum(total) OVER w, 0), 0) / (1.0 - target), 9) AS budget_remaining FROM objectives
              WINDOW w AS (PARTITION BY service, slo ORDER BY ts ROWS BETWEEN {BUDGET_ROWS} PRECEDING AND CURRENT ROW)) USING (service, slo, ts)""",
    ),
    # the rules as a machine that walks through the rows and remembers since when each condition holds
    "rule_machine": (
        ["flags"],
        """SELECT service, slo, rn, ts, CASE WHEN fast THEN ts END AS fast_at, CASE WHEN slow THEN ts END AS slow_at, CASE WHEN low THEN ts END AS freeze_at FROM flags WHERE rn = 1
            UNION ALL
            SELECT f.service, f.slo, f.rn, f.ts, CASE WHEN f.fast THEN coalesce(m.fast_at, f.ts) END, CASE WHEN f.slow THEN coalesce(m.slow_at, f.ts) END, CASE WHEN f.low THEN coalesce(m.freeze_at, f.ts) END
            FROM rule_machine m JOIN flags f ON f.service = m.service AND f.slo = m.slo AND f.rn = m.rn + 1""",
    ),
    "status": (
        ["sli"],
        f"""SELECT service, sum(bad_availability) / sum(total) AS share, min(ts) AS t0, max(ts) AS t1 FROM sli
            WHERE ts >= (SELECT max(ts) FROM sli) - INTERVAL '30 days' + to_seconds({STEP}) GROUP BY service""",
    ),
}


def _sql(body: str, *needs: str) -> str:
    return sql(body, *needs, blocks=BLOCKS)


def _sli(fx: Fixture):
    return S.sli_minutes(fx.rollup, LATENCY_MS, STEP)


def latency_good_share(spark, d):
    m = fixture(spark, d).rollup
    return rounded(m.select("ts", "service", stats.latency_good_share(F.col("latency_p50"), F.col("latency_p95"), LATENCY_MS).alias("good")))


def budget_rules(spark, d):
    """Rules against the traffic at hand: bad requests each rule tolerates over its long window."""
    fx = fixture(spark, d)
    traffic = _sli(fx).groupBy("service").agg(F.avg("total").alias("mean_total"))
    rules = S.budget_rules(spark, slos={"availability": 0.999, "latency": 0.99})
    listed = rules.agg(F.collect_list(F.struct(*rules.columns))).scalar()
    rows = traffic.withColumn("r", F.explode(listed)).select("service", "mean_total", "r.*")
    per_step = F.col("mean_total") * F.col("long_s") / float(STEP)
    return rounded(rows.withColumn("tolerated", per_step * F.col("allowed_error_rate") * F.col("threshold")).drop("mean_total"))


def sli_minutes(spark, d):
    return rounded(_sli(fixture(spark, d)))


def _both(run):
    """`run(column, target)` of both objectives, with the objective's name."""
    parts = [run(column, target).withColumn("slo", F.lit(name)) for name, column, target in OBJECTIVES]
    return rounded(parts[0].unionByName(parts[1]))


def rolling_burn(spark, d):
    sli = S.sli_minutes(fixture(spark, d).minutes, LATENCY_MS, STEP)
    return _both(lambda column, target: S.rolling_burn(sli, column, target, WINDOWS))


def burn_alerts(spark, d):
    sli = S.sli_minutes(fixture(spark, d).minutes, LATENCY_MS, STEP)
    return _both(lambda column, target: S.burn_alerts(sli, column, target, RULES, STEP))


def _status(fx):
    return S.slo_status(S.sli_minutes(fx.minutes, LATENCY_MS, STEP), "bad_availability", TARGET, "availability", step=STEP)


def slo_status(spark, d):
    """Both objectives."""
    sli = S.sli_minutes(fixture(spark, d).minutes, LATENCY_MS, STEP)
    parts = [S.slo_status(sli, column, target, name, step=STEP) for name, column, target in OBJECTIVES]
    return rounded(parts[0].unionByName(parts[1]))


def burn_now(spark, d):
    """Both objectives."""
    sli = S.sli_minutes(fixture(spark, d).minutes, LATENCY_MS, STEP)
    parts = [S.burn_now(sli, column, target, WINDOWS).withColumn("slo", F.lit(name)) for name, column, target in OBJECTIVES]
    return rounded(parts[0].unionByName(parts[1]))


def cumulative_budget(spark, d):
    return rounded(S.cumulative_budget(S.sli_minutes(fixture(spark, d).minutes, LATENCY_MS, STEP), "bad_availability", TARGET, 21600))


def rolling_budget(spark, d):
    return rounded(S.rolling_budget(_sli(fixture(spark, d)), "bad_latency", LATENCY_TARGET, 240))


def sustained_alert(spark, d):
    burn = S.rolling_burn(_sli(fixture(spark, d)), "bad_availability", TARGET, [21600])
    return S.sustained(burn, F.col("burn_21600") > 1.2, 7200)


def _policy(fx):
    """Burn rates and budget of both objectives, minute by minute, with the fast-burn flag."""
    sli, parts = S.sli_minutes(fx.minutes, LATENCY_MS, STEP), []
    for name, column, target in OBJECTIVES:
        left = S.rolling_budget(sli, column, target, BUDGET_ROWS).drop("sli")
        parts.append(S.rolling_burn(sli, column, target, [3600, 21600, 86400]).join(left, ["service", "ts"]).withColumn("slo", F.lit(name)))
    both = rounded(parts[0].unionByName(parts[1]), 9)
    return both.withColumn("fast_burn", F.coalesce((F.col("burn_21600") > FAST) & (F.col("burn_3600") > FAST), F.lit(False)))


def policy_alerts(spark, d):
    """Fast burn at once, slow burn once it has held, and the freeze of releases, for both objectives."""
    rules = [("fast", "page", F.col("fast_burn"), 0), ("slow", "page", F.col("burn_86400") > SLOW, SLOW_HOLD), ("freeze", "ticket", F.col("budget_remaining") < FREEZE, 0)]
    return S.rule_periods(_policy(fixture(spark, d)), rules, ["service", "slo"])


def release_freeze(spark, d):
    """Every deploy against the budget at its time; rollbacks are urgent."""
    fx = fixture(spark, d)
    return rounded(S.release_freeze(fx.deploys, _policy(fx), F.col("kind") == "rollback", STEP, FREEZE))


def worst_budget(spark, d):
    return rounded(S.worst_budget(_status(fixture(spark, d))))


#: Periods of every rule and objective.
PERIODS = """SELECT p.service, p.slo, p.severity, p.long_s, p.short_s, p.threshold, min(p.ts) AS "start", p.end_ts AS "end",
    round((SELECT max(r.long_burn) FROM rule_burn r WHERE r.service = p.service AND r.slo = p.slo AND r.rule_no = p.rule_no AND r.ts >= min(p.ts) AND r.ts <= p.end_ts), 6) AS peak_long
    FROM periods p GROUP BY p.service, p.slo, p.rule_no, p.severity, p.long_s, p.short_s, p.threshold, p.end_ts"""
_ALLOW = f"{1 - TARGET!r}::DOUBLE"
QUERIES = {
    "latency_good_share": (latency_good_share, _sql("SELECT ts, service, round(good, 6) + 0.0 AS good FROM shares", "shares")),
    "budget_rules": (
        budget_rules,
        _sql(
            """SELECT service, slo, target, severity, long_s, short_s, threshold, round(1.0 - target, 6) AS allowed_error_rate, round((1.0 - target) * 43200, 6) AS budget_minutes,
            round(threshold * long_s / 2592000.0, 6) AS budget_share, round(m * long_s / 3600.0 * (1.0 - target) * threshold, 6) AS tolerated
            FROM (SELECT service, avg(total) AS m FROM sli GROUP BY service)
            CROSS JOIN (VALUES ('availability', 0.999::DOUBLE), ('latency', 0.99::DOUBLE)) s(slo, target)
            CROSS JOIN (VALUES ('page', 3600, 300, 14.4::DOUBLE), ('page', 21600, 1800, 6.0::DOUBLE), ('ticket', 259200, 21600, 1.0::DOUBLE)) r(severity, long_s, short_s, threshold)""",
            "sli",
        ),
    ),
    "sli_minutes": (sli_minutes, _sql(f"SELECT ts, service, {r6('total', 'bad_availability', 'bad_latency')} FROM sli", "sli")),
    "rolling_burn": (rolling_burn, _sql("SELECT service, slo, ts, " + r6(*[f"burn_{w}" for w in WINDOWS]) + " FROM burn_all", "burn_all")),
    "burn_alerts": (burn_alerts, _sql(PERIODS, "periods", "rule_burn")),
    "slo_status": (
        slo_status,
        _sql(
            f"""SELECT service, slo, target, {r6('1.0 - share AS sli')}, round(epoch(t1 - t0) / 86400.0 + {STEP} / 86400.0, 2) AS window_days,
            {r6('share / (1.0 - target) AS budget_consumed', '1.0 - share / (1.0 - target) AS budget_remaining', '(1.0 - target) * 43200.0 AS budget_minutes_total', '(1.0 - target) * 43200.0 * (1.0 - share / (1.0 - target)) AS budget_minutes_left')}
            FROM (SELECT service, slo, target, sum(bad) / sum(total) AS share, min(ts) AS t0, max(ts) AS t1 FROM objectives
              WHERE ts >= (SELECT max(ts) FROM sli) - INTERVAL '30 days' + to_seconds({STEP}) GROUP BY service, slo, target)""",
            "objectives",
        ),
    ),
    "burn_now": (
        burn_now,
        _sql(
            "SELECT service, slo, " + ", ".join(
                f"round(coalesce(sum(bad) FILTER (WHERE ts > m - to_seconds({w})) / nullif(sum(total) FILTER (WHERE ts > m - to_seconds({w})), 0), 0) / (1.0 - target), 6) AS burn_{w}" for w in WINDOWS
            ) + " FROM objectives, (SELECT max(ts) AS m FROM sli) WHERE ts > m - INTERVAL '3 days' GROUP BY service, slo, target",
            "objectives",
        ),
    ),
    "cumulative_budget": (
        cumulative_budget,
        _sql(
            f"""SELECT service, time_bucket(INTERVAL '6 hours', ts) AS ts, round(max(1.0 - (b / t) / {_ALLOW}), 6) AS budget_remaining
            FROM (SELECT service, ts, sum(bad_availability) OVER w AS b, sum(total) OVER w AS t FROM sli WINDOW w AS (PARTITION BY service ORDER BY ts))
            GROUP BY 1, 2 HAVING time_bucket(INTERVAL '6 hours', ts) >= (SELECT min(ts) FROM sli) + INTERVAL '2 days'""",
            "sli",
        ),
    ),
    "rolling_budget": (
        rolling_budget,
        _sql(
            f"""SELECT service, ts, {r6('1.0 - s AS sli', f'1.0 - s / {1 - LATENCY_TARGET!r}::DOUBLE AS budget_remaining')} FROM (SELECT service, ts, sum(bad_latency) OVER w / sum(total) OVER w AS s FROM sli
            WINDOW w AS (PARTITION BY service ORDER BY ts ROWS BETWEEN 240 PRECEDING AND CURRENT ROW))""",
            "sli",
        ),
    ),
    "sustained_alert": (
        sustained_alert,
        _sql(
            """SELECT service, min(ts) AS started_at, min(ts) + INTERVAL '2 hours' AS fired_at, max(ts) AS last_true
            FROM (SELECT *, rn - row_number() OVER (PARTITION BY service ORDER BY ts) AS island FROM
              (SELECT *, row_number() OVER (PARTITION BY service ORDER BY ts) AS rn FROM burn) WHERE burn_21600 > 1.2)
            GROUP BY service, island HAVING max(ts) - min(ts) >= INTERVAL '2 hours'""",
            "burn",
        ),
    ),
    "policy_alerts": (
        policy_alerts,
        _sql(
            " UNION ALL ".join(
                f"""SELECT service, slo, '{rule}' AS rule, '{sev}' AS severity, {rule}_at AS started_at, {rule}_at + to_seconds({hold}) AS fired_at, max(ts) AS last_true,
                max(ts) = (SELECT max(f.ts) FROM flags f WHERE f.service = m.service AND f.slo = m.slo) AS active
                FROM rule_machine m WHERE {rule}_at IS NOT NULL GROUP BY service, slo, {rule}_at HAVING max(ts) - {rule}_at >= to_seconds({hold})"""
                for rule, sev, hold in (("fast", "page", 0), ("slow", "page", SLOW_HOLD), ("freeze", "ticket", 0))
            ),
            "rule_machine",
        ),
    ),
    "release_freeze": (
        release_freeze,
        _sql(
            f"""SELECT d.*, d.kind = 'rollback' AS urgent, n.slo, round(f.budget_remaining, 6) + 0.0 AS budget_remaining, coalesce(f.fast, false) AS fast_burn,
            coalesce(f.low, false) AS frozen, NOT coalesce(f.low, false) OR d.kind = 'rollback' AS allowed
            FROM deploys d LEFT JOIN (SELECT DISTINCT service, slo FROM flags) n ON n.service = d.service
            ASOF LEFT JOIN flags f ON f.service = d.service AND f.slo = n.slo AND d.ts >= f.ts + to_seconds({STEP})""",
            "deploys", "flags",
        ),
    ),
    "worst_budget": (
        worst_budget,
        _sql(f"SELECT service, round(1.0 - share / {_ALLOW}, 6) AS budget_remaining FROM status ORDER BY 2, 1 LIMIT 1", "status"),
    ),
}
