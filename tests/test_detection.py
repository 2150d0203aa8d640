"""Baseline, alert runs and matching against hand fixtures and plain loops."""

import math
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from vigil import constants as K
from vigil.operators import alerts as A
from vigil.operators import baseline as B
from vigil.operators import matching as M
from vigil.operators import rollup as R

T0 = datetime(2026, 1, 1)
HOSTILE = ["error_rate|api-gateway"] * 3 + ["latency_p95|orders-service"] + ["error_rate|api-gateway"] * 3


def scores(spark, values, names=None):
    names = names or ["error_rate|api-gateway"] * len(values)
    rows = [(T0 + timedelta(minutes=i), i, float(v), *n.split("|")) for i, (v, n) in enumerate(zip(values, names))]
    return spark.createDataFrame(rows, "ts timestamp, rn long, score double, signal string, service string")


def test_peak_after_firing(spark):
    got = A.runs_to_alerts(scores(spark, [0, 11, 12, 18, 0, 0, 0], HOSTILE), [10], [2], cooldown=2).collect()
    assert len(got) == 1
    assert got[0].fired_at == T0 + timedelta(minutes=2)
    assert (got[0].signal, got[0].service, got[0].peak) == ("latency_p95", "orders-service", 18.0)


def test_peak_before_firing(spark):
    names = list(HOSTILE)
    names[1] = "cpu_utilization|payments-service"
    got = A.runs_to_alerts(scores(spark, [0, 17, 12, 11, 0, 0, 0], names), [10], [2], cooldown=2).collect()
    assert got[0].fired_at == T0 + timedelta(minutes=2)
    assert (got[0].signal, got[0].service, got[0].peak) == ("cpu_utilization", "payments-service", 17.0)


def by_hand(values, threshold, need, cooldown):
    """Alerts as (fired, start, end, peak) rows: `need` hot rows in a line, up to `cooldown` cold ones in a line."""
    hot = "".join("X" if v > threshold else "." for v in values)
    found, free = [], 0
    while (start := hot.find("X" * need, free)) >= 0:
        gap = hot.find("." * cooldown, start)
        end = len(hot) - 1 if gap < 0 else gap + cooldown - 1
        found.append((start + need - 1, start, end, max(values[start : end + 1])))
        free = end + 1
    return found


def test_random_series_and_sweep_match_a_plain_loop(spark):
    rng = np.random.default_rng(3)
    rows, series = [], {}
    for s in range(60):
        values = [float(v) for v in rng.choice([0, 1, 2, 3, 4, 5], size=int(rng.integers(5, 60)), p=[0.35, 0.2, 0.15, 0.1, 0.1, 0.1])]
        series[s] = values
        rows += [(s, T0 + timedelta(minutes=i), i, v, "error_rate", "api-gateway") for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "series int, ts timestamp, rn long, score double, signal string, service string")
    got = A.runs_to_alerts(df, [1, 2, 3], [1, 2, 3], cooldown=3, by=["series"]).collect()
    minute = lambda t: int((t - T0).total_seconds() // 60)
    mine = sorted((r.series, r.threshold, r.consecutive, minute(r.fired_at), minute(r.started_at), minute(r.ended_at), r.peak) for r in got)
    want = sorted((s, float(t), n, *hit) for s, v in series.items() for t in (1, 2, 3) for n in (1, 2, 3) for hit in by_hand(v, t, n, 3))
    assert mine == want and want


def minutes(spark, values):
    """values: {service: {signal: list}}; other detection signals stay null."""
    rows = []
    for service, signals in values.items():
        n = len(next(iter(signals.values())))
        for i in range(n):
            rows.append({"ts": T0 + timedelta(minutes=i), "service": service, **{s: None for s in K.STD_FLOOR}, **{s: v[i] for s, v in signals.items()}})
    schema = "ts timestamp, service string, " + ", ".join(f"{s} double" for s in K.STD_FLOOR)
    return spark.createDataFrame(pd.DataFrame(rows).astype({s: float for s in K.STD_FLOOR}), schema).replace(float("nan"), None)


def ewma_by_hand(x, floor, alpha=0.03):
    mean, var, out = (0.0 if x[0] is None else x[0]), 0.0, [None]
    for t in range(1, len(x)):
        std = max(math.sqrt(var), floor[0], floor[1] * abs(mean))
        v = x[t]
        out.append(max((v - mean) / std, 0.0) if t >= 30 and v is not None else None)
        new = mean if v is None else v if t < 30 else min(max(v, mean - 4 * std), mean + 4 * std)
        delta = new - mean
        mean, var = mean + alpha * delta, (1 - alpha) * (var + alpha * delta * delta)
    return out


def test_ewma_matches_the_recurrence_with_gaps(spark):
    rng = np.random.default_rng(1)
    x = [float(v) for v in rng.normal(100, 5, 120)]
    y = [float(v) for v in rng.normal(50, 9, 120)]
    y[0], y[40], y[41], y[77] = None, None, None, None
    df = minutes(spark, {"web-frontend": {"latency_p95": x}, "api-gateway": {"latency_p95": y}})
    got = {(r.service, int(r.rn)): r.latency_p95 for r in B.ewma_z(df).collect()}
    for service, series in (("web-frontend", x), ("api-gateway", y)):
        for i, want in enumerate(ewma_by_hand(series, K.STD_FLOOR["latency_p95"])):
            have = got.get((service, i))
            assert (have is None) == (want is None)
            assert want is None or abs(have - want) < 1e-9


def test_ewma_does_not_see_the_future(spark):
    rng = np.random.default_rng(2)
    x = [float(v) for v in rng.normal(100, 3, 300)]
    later = x[:200] + [v + 500 for v in x[200:]]
    run = lambda v: {r.rn: r.latency_p95 for r in B.ewma_z(minutes(spark, {"web-frontend": {"latency_p95": v}})).collect()}
    a, b = run(x), run(later)
    assert all(a[i] == b[i] for i in range(200)) and a[250] != b[250]


def test_matching_against_all_pairs(spark):
    rng = np.random.default_rng(5)
    alerts = []
    t = 0
    for i in range(40):
        t += int(rng.integers(5, 90))
        alerts.append((T0 + timedelta(minutes=t), T0 + timedelta(minutes=t + int(rng.integers(1, 60)))))
    faults = []
    for i in range(25):
        start = T0 + timedelta(seconds=int(rng.integers(0, 60 * 2000)))
        faults.append((f"F{i}", i, f"c{i % 3}", start, start + timedelta(seconds=int(rng.integers(60, 7200)))))
    a = spark.createDataFrame(alerts, "fired_at timestamp, ended_at timestamp")
    f = spark.createDataFrame(faults, "fault_id string, fault_order long, category string, start timestamp, end timestamp")

    def hit(al, fa, before=0):
        lead, grace = timedelta(seconds=before), timedelta(minutes=15)
        return fa[3] - lead <= al[0] <= fa[4] + grace or al[0] < fa[3] <= al[1]

    true = {al[0] for al in alerts if any(hit(al, fa) for fa in faults)}
    assert {r.fired_at for r in M.true_alerts(a, f, ["fired_at"]).collect()} == true
    assert {r.fired_at for r in M.false_alerts(a, f, ["fired_at"]).collect()} == {al[0] for al in alerts} - true
    first = {fa[0]: min(al[0] for al in alerts if hit(al, fa)) for fa in faults if any(hit(al, fa) for al in alerts)}
    assert {r.fault_id: r.fired_at for r in M.first_alerts(a, f).collect()} == first
    owner = {al[0]: next(fa[0] for fa in faults if hit(al, fa, 60)) for al in alerts if any(hit(al, fa, 60) for fa in faults)}
    assert {r.fired_at: r.owner for r in M.owners(a, f, ["fired_at"]).collect()} == owner


def test_alerts_off_the_grid_match_by_their_time(spark):
    rng = np.random.default_rng(11)
    moment = lambda: T0 + timedelta(microseconds=int(rng.integers(0, 7_200_000_000)))
    alerts = [(t, t + timedelta(seconds=float(rng.uniform(0, 400)))) for t in (moment() for _ in range(60))]
    faults = [(f"F{i}", i, "c", t, t + timedelta(seconds=float(rng.uniform(0, 300)))) for i, t in enumerate(moment() for _ in range(15))]
    faults.append(("F15", 15, "c", T0 + timedelta(hours=3), T0 + timedelta(hours=3, minutes=2)))
    alerts.append((T0 + timedelta(hours=3, seconds=30), T0 + timedelta(hours=3, seconds=31)))
    a = spark.createDataFrame(alerts, "fired_at timestamp, ended_at timestamp")
    f = spark.createDataFrame(faults, "fault_id string, fault_order long, category string, start timestamp, end timestamp")
    fits = lambda al, fa: fa[3] <= al[0] <= fa[4] + timedelta(seconds=20) or al[0] < fa[3] <= al[1]
    owner = {al[0]: next(fa[0] for fa in faults if fits(al, fa)) for al in alerts if any(fits(al, fa) for fa in faults)}
    assert {r.fired_at: r.owner for r in M.owners(a, f, ["fired_at"], 0, 20).collect()} == owner
    first = {fa[0]: min(al[0] for al in alerts if fits(al, fa)) for fa in faults if any(fits(al, fa) for al in alerts)}
    assert {r.fault_id: r.fired_at for r in M.first_alerts(a, f, None, 20).collect()} == first and "F15" in first


def test_scorecard_without_alerts(spark):
    a = spark.createDataFrame([], "fired_at timestamp, ended_at timestamp")
    f = spark.createDataFrame([("F1", 1, "c", T0, T0 + timedelta(hours=1))], "fault_id string, fault_order long, category string, start timestamp, end timestamp")
    row = M.scorecard(a, f, 7.0).collect()[0]
    assert (row.recall, row.median_ttd_min, row.precision, row.alerts, row.incidents) == (0.0, None, 0.0, 0, 1)


def test_row_numbers_cross_days(spark):
    times = spark.range(3000).select(F.timestamp_seconds(F.col("id") * 613).alias("ts"))
    got = [r.rn for r in R.number_rows(times).orderBy("ts").collect()]
    assert got == list(range(3000))


def test_quantile_curve_matches_a_plain_loop(spark):
    """Thresholds are the exact quantiles of the scores; equal quantiles are one setting."""
    rng = np.random.default_rng(11)
    values = [round(float(v), 2) for v in rng.gamma(1.0, 2.0, 240)] + [9.0] * 60
    df = scores(spark, values)
    faults = spark.createDataFrame(
        [("F1", 1, "memory_leak", "api-gateway", T0 + timedelta(minutes=40), T0 + timedelta(minutes=60)), ("F2", 2, "memory_leak", "api-gateway", T0 + timedelta(minutes=235), T0 + timedelta(minutes=299))],
        "fault_id string, fault_order int, category string, service string, start timestamp, end timestamp",
    )
    probs, runs = [0.5, 0.7, 0.85, 0.9, 0.999], [1, 2, 3]
    limits = {}
    for p in probs:
        limits.setdefault(float(np.quantile(values, p)), p)
    assert len(limits) < len(probs)
    curve = A.quantile_curve(df, faults, probs, runs, 1.0).collect()
    assert len(curve) == len(limits) * len(runs)
    for r in curve:
        assert abs(np.quantile(values, r.quantile) - r.threshold) < 1e-12 and r.quantile in limits.values()
        assert r.alerts == len(by_hand(values, r.threshold, r.consecutive, K.COOLDOWN_ROWS))
    chosen = [r for r in curve if r.chosen]
    enough = [r for r in curve if r.recall >= min(0.93, max(x.recall for x in curve))]
    assert len(chosen) == 1 and chosen[0].false_alerts_per_day == min(r.false_alerts_per_day for r in enough) and chosen[0] in enough
    with pytest.raises(ValueError):
        A.quantile_curve(df.limit(0), faults, probs, runs, 1.0)
