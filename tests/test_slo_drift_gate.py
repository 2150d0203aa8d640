"""Budget arithmetic, burn alerts, quantiles, drift levels and gate verdicts."""

import math
from collections import Counter
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigil.functions import stats
from vigil.operators import drift as D
from vigil.operators import gate as G
from vigil.operators import slo as S

T0 = datetime(2026, 1, 1)


def test_budget_numbers(spark):
    rows = {(r.slo, r.long_s): r for r in S.budget_rules(spark).collect()}
    assert rows["availability", 3600].budget_minutes == pytest.approx(43.2)
    assert [round(rows["availability", w].budget_share, 4) for w in (3600, 21600, 259200)] == [0.02, 0.05, 0.10]
    one = spark.range(1).select(S.burn_rate(F.lit(1.44), F.lit(100.0), 0.999).alias("b"))
    assert one.collect()[0].b == pytest.approx(14.4)


def blip(spark, bad):
    rows = [(T0 + timedelta(minutes=i), "web-frontend", 1000.0, float(bad if 100 <= i <= 102 else 0)) for i in range(180)]
    return spark.createDataFrame(rows, "ts timestamp, service string, total double, bad_availability double")


def test_burn_blip(spark):
    got = S.burn_alerts(blip(spark, 500), "bad_availability", 0.999).collect()
    assert [r.long_s for r in got if r.long_s == 3600] == [3600] and not [r for r in got if r.long_s == 259200]
    assert not [r for r in S.burn_alerts(blip(spark, 50), "bad_availability", 0.999).collect() if r.severity == "page"]


def test_burn_series_matches_direct_sums(spark):
    rng = np.random.default_rng(0)
    keep = sorted(rng.choice(500, 400, replace=False).tolist())
    total, bad = rng.uniform(0, 100, 500), rng.uniform(0, 5, 500)
    rows = [(T0 + timedelta(minutes=i), "s", float(total[i]), float(bad[i])) for i in keep]
    df = spark.createDataFrame(rows, "ts timestamp, service string, total double, bad double")
    for r in S.rolling_burn(df, "bad", 0.99, [300, 3600]).collect():
        i = int((r.ts - T0).total_seconds() // 60)
        for w in (5, 60):
            inside = [j for j in keep if i - w < j <= i]
            assert r[f"burn_{w * 60}"] == pytest.approx(bad[inside].sum() / total[inside].sum() / 0.01, rel=1e-9)


def test_log_normal_share(spark):
    got = spark.range(1).select(stats.latency_good_share(F.lit(100.0), F.lit(300.0), 300.0).alias("g")).collect()[0].g
    assert got == pytest.approx(0.95, abs=1e-6)
    tails = spark.createDataFrame([(-8.0,), (-1.0,), (0.0,), (1.959963984540054,), (40.0,)], "x double").select(stats.normal_cdf(F.col("x")).alias("p"))
    assert [r.p for r in tails.collect()] == pytest.approx([6.220960574271785e-16, 0.15865525393145707, 0.5, 0.975, 1.0], rel=1e-9)


@pytest.mark.parametrize("accuracy", [50, 10_000])
def test_exact_quantiles_with_a_hot_key_and_duplicates(spark, accuracy):
    rng = np.random.default_rng(7)
    groups = {"hot": rng.normal(0, 1, 4000), "flat": np.full(50, 3.0), "few": np.array([1.0, 2.0, 4.0]), "ties": rng.integers(0, 5, 999).astype(float)}
    groups["third"] = np.concatenate([np.full(700, 2.5), rng.uniform(0, 9, 1300)])
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [("few", float("nan")), ("few", None)]
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 0.99, 1.0]
    got = stats.exact_quantiles(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", probs, accuracy).collect()
    assert len(got) == len(groups)
    for r in got:
        assert r.q == pytest.approx(np.quantile(groups[r.k], probs), abs=1e-12) and r.n == len(groups[r.k])


def psi_by_counts(base, other):
    """Sum of (b - a) * ln(b / a) over the ten decile bins of `base`, shares of at least one in a million."""
    cuts = [float(np.quantile(base, i / 10)) for i in range(1, 10)]

    def shares(values):
        counts = Counter(sum(c <= v for c in cuts) for v in values)
        return [max(counts[b] / len(values), 1e-6) for b in range(10)]

    return sum((b - a) * math.log(b / a) for a, b in zip(shares(base), shares(other)))


def test_psi_levels(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(0, 1, 20_000)
    expected = spark.createDataFrame([(float(v),) for v in base], "v double")
    levels = []
    for shift in (0.0, 0.35, 1.0):
        other = rng.normal(shift, 1, 20_000)
        got = D.psi(expected, spark.createDataFrame([(float(v),) for v in other], "v double"), [], "v")
        value = got.collect()[0].psi
        assert value == pytest.approx(psi_by_counts(base, other), rel=1e-9)
        levels.append(D.with_level(got).collect()[0].level)
        assert shift or value < 0.02
    assert levels == ["stable", "moderate", "significant"]


def test_constant_signal_has_no_drift(spark):
    flat = spark.createDataFrame([(1.0,)] * 20, "v double")
    assert D.psi(flat, spark.createDataFrame([(2.0,)] * 20, "v double"), [], "v").collect()[0].psi == 0.0


def test_gate_examples(spark):
    rows = [
        ("clean", True, 0.001, 0.001, 100.0, 101.0, None, False, None),
        ("latency", True, 0.001, 0.001, 100.0, 118.0, None, False, None),
        ("errors", True, 0.001, 0.007, 100.0, 100.0, None, False, None),
        ("weak model", True, 0.001, 0.001, 100.0, 100.0, 0.88, False, None),
        ("freeze", True, 0.001, 0.001, 100.0, 100.0, None, False, 0.18),
        ("urgent", True, 0.001, 0.001, 100.0, 100.0, None, True, 0.18),
    ]
    cand = spark.createDataFrame(
        rows,
        "candidate_id string, tests_passed boolean, baseline_error_rate double, candidate_error_rate double, baseline_p95 double, candidate_p95 double,"
        " model_macro_f1 double, urgent boolean, budget_override double",
    )
    f1 = spark.createDataFrame([(0.97,)], "macro_f1 double")
    worst = spark.createDataFrame([("web-frontend", 0.6)], "service string, budget_remaining double")
    verdict = {r.candidate_id: r.passed for r in G.gate_verdict(G.gate_checks(cand, f1, worst)).collect()}
    assert verdict == {"clean": True, "latency": False, "errors": False, "weak model": False, "freeze": False, "urgent": True}


def test_gate_fails_what_cannot_be_measured(spark):
    cand = spark.createDataFrame(
        [(1, True, 0.001, None, 100.0, None, None, False, None), (2, None, 0.001, 0.001, 0.0, 100.0, None, False, None)],
        "candidate_id int, tests_passed boolean, baseline_error_rate double, candidate_error_rate double, baseline_p95 double, candidate_p95 double,"
        " model_macro_f1 double, urgent boolean, budget_override double",
    )
    checks = G.gate_checks(cand, spark.createDataFrame([(0.97,)], "macro_f1 double"), spark.createDataFrame([("a", 0.6)], "service string, budget_remaining double"))
    got = {r.candidate_id: (r.passed, r.failed_checks) for r in G.gate_verdict(checks).collect()}
    assert got == {1: (False, [2, 3]), 2: (False, [1, 3])} and all(r.passed is not None for r in checks.collect())


def test_canary_compare_of_recorded_spans(spark):
    """Two spans each with ends inside; gaps, spans without minutes, reversed and null spans keep their row."""
    from datetime import datetime, timedelta

    t0 = datetime(2026, 1, 1)
    at = lambda m: None if m is None else t0 + timedelta(minutes=m)
    rows = [("a", at(i), i / 100, 100.0 + i) for i in range(20) if i != 3] + [("b", at(i), 0.5, 9.0) for i in range(20)]
    minutes = spark.createDataFrame(rows, "service string, ts timestamp, error_rate double, latency_p95 double")
    given = [(1, "a", 0, 4, 10, 12), (2, "a", 0, 4, 2, 8), (3, "a", 5, 4, 10, 12), (4, "a", 3, 3, None, 12), (5, "c", 0, 4, 10, 12), (6, "b", 18, 30, 0, 0)]
    spans = spark.createDataFrame([(n, s, *map(at, ends)) for n, s, *ends in given],
                                  "candidate_id int, service string, baseline_start timestamp, baseline_end timestamp, candidate_start timestamp, candidate_end timestamp")
    got = {r.candidate_id: r for r in G.canary_compare(minutes, spans, ["candidate_id"]).collect()}
    assert len(got) == len(given)

    def mean(service, begin, end, column):
        inside = [r[column] for r in rows if begin is not None and end is not None and r[0] == service and at(begin) <= r[1] <= at(end)]
        return pytest.approx(sum(inside) / len(inside)) if inside else None

    for n, service, b0, b1, c0, c1 in given:
        r = got[n]
        assert (r.baseline_error_rate, r.baseline_p95) == (mean(service, b0, b1, 2), mean(service, b0, b1, 3))
        assert (r.candidate_error_rate, r.candidate_p95) == (mean(service, c0, c1, 2), mean(service, c0, c1, 3))


def test_rule_periods_hold_and_stay_active(spark):
    """A break restarts the hold; a rule without one fires at once; the last period is active."""
    from datetime import datetime, timedelta

    t0 = datetime(2026, 1, 1)
    on = [1, 1, 0, 1, 1, 1, None, 1, 1, 1, 1]
    rows = spark.createDataFrame([("a", t0 + timedelta(minutes=i), v) for i, v in enumerate(on)], "service string, ts timestamp, v int")
    got = S.rule_periods(rows, [("held", "page", F.col("v") == 1, 120), ("now", "ticket", F.col("v") == 1, 0)]).collect()
    minutes = lambda r: tuple(int((x - t0).total_seconds() // 60) for x in (r.started_at, r.fired_at, r.last_true)) + (r.active,)
    assert sorted(minutes(r) for r in got if r.rule == "held") == [(3, 5, 5, False), (7, 9, 10, True)]
    assert sorted(minutes(r) for r in got if r.rule == "now") == [(0, 0, 1, False), (3, 3, 5, False), (7, 7, 10, True)]


def test_release_freeze_looks_at_closed_steps_only(spark):
    from datetime import datetime, timedelta

    t0 = datetime(2026, 1, 1)
    at = lambda m: t0 + timedelta(minutes=m)
    budget = spark.createDataFrame([("a", "x", at(0), 0.5, False), ("a", "x", at(5), 0.1, True)], "service string, slo string, ts timestamp, budget_remaining double, fast_burn boolean")
    releases = spark.createDataFrame([(at(0), "a", "deploy"), (at(5), "a", "deploy"), (at(6), "a", "deploy"), (at(9), "a", "rollback"), (at(9), "b", "deploy")], "ts timestamp, service string, kind string")
    got = {(r.service, r.ts, r.kind): (r.budget_remaining, r.fast_burn, r.frozen, r.allowed) for r in S.release_freeze(releases, budget, F.col("kind") == "rollback").collect()}
    assert got == {
        ("a", at(0), "deploy"): (None, False, False, True), ("a", at(5), "deploy"): (0.5, False, False, True),
        ("a", at(6), "deploy"): (0.1, True, True, False), ("a", at(9), "rollback"): (0.1, True, True, True), ("b", at(9), "deploy"): (None, False, False, True),
    }
