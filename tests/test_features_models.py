"""Features, rules, nearest neighbours, models and the isolation forest."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from vigil import constants as K
from vigil.operators import classify as C
from vigil.operators import features as FE
from vigil.operators import forest as FO
from vigil.operators import graph as G
from vigil.operators import incidents as I
from vigil.operators import nearest as N

T0 = datetime(2026, 1, 1)


def minutes(spark, rewrite_after=None, n=200):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(n):
        for s in K.SERVICE_NAMES:
            v = rng.uniform(1, 2, len(K.SIGNALS))
            if rewrite_after is not None and i > rewrite_after:
                v = v * 3 + 7
            rows.append((T0 + timedelta(minutes=i), s, *[float(x) if how != "sum" else int(x * 10) for x, how in zip(v, K.SIGNALS.values())]))
    schema = "ts timestamp, service string, " + ", ".join(f"{s} {'long' if how == 'sum' else 'double'}" for s, how in K.SIGNALS.items())
    return spark.createDataFrame(rows, schema)


def feature_row(spark, table):
    probes = spark.createDataFrame([("p", T0 + timedelta(minutes=150, seconds=20), "orders-service")], "probe_id string, at timestamp, culprit string")
    deploys = spark.createDataFrame(
        [(T0 + timedelta(minutes=100), "postgres-db", "v1", "deploy"), (T0 + timedelta(minutes=170), "postgres-db", "v2", "deploy")],
        "ts timestamp, service string, version string, kind string",
    )
    return FE.feature_rows(table, probes, deploys, G.services_table(spark), G.calls_table(spark)).collect()[0].asDict()


def test_features_do_not_see_the_future(spark):
    before, after = feature_row(spark, minutes(spark)), feature_row(spark, minutes(spark, rewrite_after=150))
    assert before == after and len(before) == 51
    assert before["min_since_any_deploy"] == 50.0 and before["min_since_deploy_origin_or_deps"] in (50.0, 240.0)


def test_rules_follow_the_runbooks(spark):
    base = dict(db_saturation_ratio=0.3, edge_traffic_delta=0.0, services_with_errors=0.0, min_since_deploy_error_origin=240.0, min_since_any_deploy=240.0, memory_slope_60m=0.0)
    cases = [
        ({}, "unknown"), ({"db_saturation_ratio": 0.95}, "database_saturation"), ({"edge_traffic_delta": 1.2}, "traffic_spike"),
        ({"services_with_errors": 1.0, "min_since_deploy_error_origin": 5.0}, "deployment_regression"), ({"services_with_errors": 3.0}, "dependency_failure"),
        ({"memory_slope_60m": 0.2}, "memory_leak"), ({"services_with_errors": 1.0, "min_since_any_deploy": 3.0}, "deployment_regression"),
    ]
    df = spark.createDataFrame([{"n": i, **base, **change} for i, (change, _) in enumerate(cases)])
    got = {r.n: r.rules_prediction for r in I.rules_classify(df).collect()}
    assert [got[i] for i in range(len(cases))] == [want for _, want in cases]


def test_unknown_feature_is_an_error(spark):
    with pytest.raises(ValueError, match="Unknown features: bogus"):
        FE.neutral_fill(spark.createDataFrame([("a", 1.0)], "probe_id string, bogus double"))
    row = FE.neutral_fill(spark.createDataFrame([("a", 0.7)], "probe_id string, edge_traffic_delta double")).collect()[0]
    assert (row.edge_traffic_delta, row.db_saturation_ratio, row.culprit_depth, row.min_since_any_deploy, row.error_log_ratio) == (0.7, 0.35, -1.0, 240.0, 0.0)


@pytest.mark.parametrize("metric", ["dot", "l2"])
@pytest.mark.parametrize("sizes", [(60, 25), (25, 60), (60, 60)])
def test_nearest_blocks_match_brute_force(spark, metric, sizes):
    rng = np.random.default_rng(9)
    q, x = rng.normal(size=(sizes[0], 6)), rng.normal(size=(sizes[1], 6))
    x[3] = x[7]  # equal scores
    frame = lambda m: spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(m)], "id long, vec array<double>")
    got = {}
    for r in N.nearest(frame(q), frame(x), 4, metric, exclude_self=True, block=30).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.item_id))
    for i in range(sizes[0]):
        value = x @ q[i] if metric == "dot" else -np.linalg.norm(x - q[i], axis=1)
        order = sorted((j for j in range(sizes[1]) if j != i), key=lambda j: (-round(value[j], 9), j))[:4]
        assert [j for _, j in sorted(got[i])] == order


def test_best_items_of_pieces_equal_a_sort_of_all(monkeypatch):
    """Ties, copies and missing scores; after the first piece no piece is sorted as a whole."""
    rng = np.random.default_rng(4)
    scores = np.round(rng.normal(size=(50, 900)), 1)
    scores[7], scores[8, 5:], scores[9, ::2] = 0.3, -np.inf, -np.inf
    best = N.Best(50, 5)
    for i in range(0, 900, 100):
        best.add(scores[:, i : i + 100], np.arange(i, i + 100))
    got = best.hits(np.arange(50)).groupby("query_id")
    for q in range(50):
        order = [j for j in sorted(range(900), key=lambda j: (-scores[q, j], j)) if np.isfinite(scores[q, j])][:5]
        assert got.get_group(q)["item_id"].to_list() == order
    monkeypatch.setattr(np, "argsort", None)
    best.add(np.full((50, 100), -9.0), np.arange(900, 1000))
    assert len(best.hits(np.arange(50))) == 250


def test_models_are_deterministic_and_open_set(spark):
    rng = np.random.default_rng(0)
    rows = [(i, K.KNOWN[i % 4], [float(v) for v in rng.normal(i % 4 * 3, 1, 5)]) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, label string, features array<double>")
    for kind, params in (("random_forest", {"numTrees": 10, "maxDepth": 5}), ("gradient_boosting", {"maxIter": 3, "maxDepth": 3})):
        model = C.fit_classifier(df, kind, params, K.KNOWN)
        scored = C.open_set_predict(C.score(model, df).withColumn("novelty", F.lit(0.0)), K.KNOWN, 0.0, 1.0)
        first = [(r.id, r.predicted, r.probability) for r in scored.orderBy("id").collect()]
        again = C.open_set_predict(C.score(C.fit_classifier(df, kind, params, K.KNOWN), df).withColumn("novelty", F.lit(0.0)), K.KNOWN, 0.0, 1.0)
        assert first == [(r.id, r.predicted, r.probability) for r in again.orderBy("id").collect()]
        assert np.mean([p == rows[i][1] for i, p, _ in first]) > 0.9
        assert all(abs(sum(p) - 1) < 1e-9 for _, _, p in first)
    far = scored.withColumn("novelty", F.lit(2.0)).drop("confidence", "top_label", "predicted")
    assert {r.predicted for r in C.open_set_predict(far, K.KNOWN, 0.0, 1.0).collect()} == {"unknown"}


def test_large_forests_grow_in_groups_that_vote_together(spark, monkeypatch):
    monkeypatch.setattr(C, "LARGE", 100)
    monkeypatch.setattr(C, "GROUP", 4)
    rng = np.random.default_rng(1)
    rows = [(i, K.KNOWN[i % 4], [float(v) for v in rng.normal(i % 4 * 2, 2, 3)]) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, label string, features array<double>")
    model = C.fit_classifier(df, "random_forest", {"numTrees": 10, "maxDepth": 6}, K.KNOWN)
    assert [m.getNumTrees for m in model.stages] == [4, 4, 2]
    trees = [t for m in model.stages for t in m.trees]
    votes = lambda x: np.mean([t.predictProbability(Vectors.dense(x)).toArray() for t in trees], axis=0)
    got = {r.id: r.probability for r in C.score(model, df).collect()}
    assert all(got[i] == pytest.approx(votes(x), abs=1e-9) for i, _, x in rows)
    each = np.mean([t.featureImportances.toArray() for t in trees], axis=0)
    assert [r.importance for r in C.impurity_importance(model, ["a", "b", "c"], spark).collect()] == pytest.approx(list(each), abs=1e-9)


def test_scoring_of_shuffled_features_is_dealt_by_its_rows(spark, monkeypatch):
    rows = [(k, K.KNOWN[k % 2], [float(k % 2), float((k * 13) % 17)]) for k in range(60)]
    df = spark.createDataFrame(rows, "id long, label string, features array<double>")
    model = C.fit_classifier(df, "random_forest", {"numTrees": 3, "maxDepth": 3}, K.KNOWN)
    parts, plain = [], C.score
    monkeypatch.setattr(C, "score", lambda m, frame: parts.append(frame.rdd.getNumPartitions()) or plain(m, frame))
    monkeypatch.setattr(C, "SCORED", 40)
    C.permutation_importance(model, df, K.KNOWN, 2, 3).collect()
    assert parts[-1] == 60 * 3 * 2 // 40


def test_isolation_forest_finds_the_outlier(spark):
    rng = np.random.default_rng(0)
    rows = [(T0 + timedelta(minutes=i), [float(v) for v in rng.normal(0, 1, 4)]) for i in range(400)] + [(T0 + timedelta(minutes=400), [9.0, 9.0, -9.0, 9.0])]
    df = spark.createDataFrame(rows, "ts timestamp, x array<double>")
    forest = FO.fit_forest(df, trees=50, sample=64)
    scored = [(r.score, r.ts) for r in FO.score_forest(df, forest).collect()]
    assert max(scored)[1] == T0 + timedelta(minutes=400) and all(0 < s < 1 for s, _ in scored)
    assert sorted(scored) == sorted((r.score, r.ts) for r in FO.score_forest(df, FO.fit_forest(df, trees=50, sample=64)).collect())


def test_call_graph_with_a_cycle_and_a_diamond(spark):
    calls = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("d", "c"), ("c", "e")], "caller string, callee string")
    ring = {(x, y) for x in "abcd" for y in "abce"}
    assert sorted(tuple(r) for r in G.call_closure(calls).collect()) == sorted(ring)


def test_calls_of_traces_follow_the_spans(spark):
    spans = [("t1", 1, "a"), ("t1", 2, "b"), ("t1", 3, "b"), ("t1", 4, "c"), ("t2", 2, "b"), ("t2", 1, "a"), ("t3", 1, "a"), ("t3", 2, "c"), ("t4", 1, "a"), (None, 1, "c"), ("t5", 1, "a"), ("t5", 2, "b")]
    df = spark.createDataFrame(spans, "trace string, at int, service string")
    got = lambda share: sorted(tuple(r) for r in G.calls_of_traces(df, ["trace"], ["at"], share).collect())
    assert got(0.0) == [("a", "b", 3), ("a", "c", 1), ("b", "c", 1)]
    assert got(0.3) == [("a", "b", 3), ("b", "c", 1)]
    assert G.calls_of_traces(df.limit(0), ["trace"], ["at"], 0.1).collect() == []


def test_alerts_of_one_minute_have_their_own_numbers(spark):
    rows = [(T0, "b", "x"), (T0, "a", "x"), (T0 + timedelta(days=2), "a", "y"), (T0, "a", "w")]
    got = I.number_incidents(spark.createDataFrame(rows, "fired_at timestamp, service string, signal string")).collect()
    assert {(r.service, r.signal): r.incident_id for r in got} == {("a", "w"): "INC-001", ("a", "x"): "INC-002", ("b", "x"): "INC-003", ("a", "y"): "INC-004"}


@pytest.mark.parametrize("around", [0, 45, 600])
def test_log_tail_of_a_probe_off_the_minute(spark, around):
    fired = T0 + timedelta(minutes=30, seconds=20)
    lines = [(i, T0 + timedelta(seconds=7 * i), "s", "ERROR", f"m{i}") for i in range(600)] + [(600 + i, fired + timedelta(seconds=around + 1 + i), "s", "INFO", "late") for i in range(20)]
    logs = spark.createDataFrame(lines, "log_id long, ts timestamp, service string, level string, message string")
    got = I.incident_logs(spark.createDataFrame([("INC-001", fired)], "incident_id string, fired_at timestamp"), logs, around, 4).collect()
    inside = sorted((r for r in lines if abs((r[1] - fired).total_seconds()) <= around), key=lambda r: (r[1], r[0]))
    assert sorted(r.message for r in got) == sorted(r[4] for r in inside[-4:])


def test_cut_offs_in_any_order(spark):
    df = spark.createDataFrame([(K.KNOWN[i % 3], K.KNOWN[i % 2], i / 40, 0.0) for i in range(40)], "y_true string, top_label string, confidence double, novelty double")
    up, down = (C.tune_cutoff(df, 1.0, c).orderBy("cutoff").collect() for c in ([0.2, 0.5, 0.8], [0.8, 0.2, 0.5]))
    assert up == down and len(up) == 3


def test_permutation_importance_is_one_rule_at_every_size(spark):
    rows = [(k, K.KNOWN[k % 2], [float(k % 2) + 0.3 * ((k * 7) % 5), float((k * 13) % 17)]) for k in range(90)]
    df = spark.createDataFrame(rows, "id long, label string, features array<double>")
    model = C.fit_classifier(df, "random_forest", {"numTrees": 5, "maxDepth": 4}, K.KNOWN)
    got = [{r.dim: r.importance for r in C.permutation_importance(model, df, K.KNOWN, 2, 3, n).collect()} for n in (100_000, 8)]
    assert got[0] == pytest.approx(got[1], abs=1e-12) and got[0][0] > 0.1


def test_registered_models_have_the_reference_sizes(spark, monkeypatch):
    from vigil.plans import classify, models

    assert [(p.get("numTrees"), p.get("maxIter")) for _, p in classify.MODELS] == [(300, None), (300, None), (None, 200), (None, 300)]
    seen = {}
    monkeypatch.setattr(models.FO, "fit_forest", lambda rows, **sizes: seen.update(sizes) or 1 / 0)
    with pytest.raises(ZeroDivisionError):
        models.isolation_forest(spark, "/root/testdata/sf0.001")
    assert seen == {"trees": 200, "sample": 4096}
