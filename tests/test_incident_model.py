"""The saved incident model against brute force, and the retrain decision against SQL over the stored predictions."""

import duckdb
import numpy as np
import pytest

from vigil import constants as K
from vigil.operators import incident_model as IM
from vigil.settings import scratch_path

NAMES = ["a", "b", "c", "flat"]
SMALL = {"numTrees": 15, "maxDepth": 6, "minInstancesPerNode": 1}
CENTRES = {"database_saturation": (0, 0, 0), "deployment_regression": (6, 0, 0), "traffic_spike": (0, 6, 0), "dependency_failure": (0, 0, 6)}


def rows(spark, seed, count, shift=0.0, labels=(*CENTRES, K.HELD_OUT), prefix="p"):
    rng = np.random.default_rng(seed)
    out = []
    for k in range(count):
        label = labels[k % len(labels)]
        at = np.array(CENTRES.get(label, (30, 30, 30)), float) + rng.normal(size=3) + shift
        out.append((f"{prefix}{seed}-{k}", label, *map(float, at), 1.0))
    return spark.createDataFrame(out, "probe_id string, label string, a double, b double, c double, flat double"), out


@pytest.fixture(scope="module")
def model(spark):
    given, plain = rows(spark, 1, 200)
    path = scratch_path(spark, "test-model")
    return path, IM.fit(given, path, NAMES, SMALL, 0.4), [r for r in plain if r[1] in CENTRES]


def scaled(train, points):
    x = np.array([r[2:] for r in train])
    low, mid, high = np.quantile(x, [0.1, 0.5, 0.9], axis=0)
    width = np.where(high == low, 1.0, high - low)
    return np.clip((np.array(points) - mid) / width, -50, 50)


def test_limit_distances_and_reasons_equal_brute_force(spark, model):
    path, held, train = model
    own = scaled(train, [r[2:] for r in train])
    gaps = np.sqrt(((own[:, None] - own[None]) ** 2).sum(-1))
    np.fill_diagonal(gaps, np.inf)
    assert held.novelty_limit == pytest.approx(np.quantile(np.sort(gaps, 1)[:, :5].mean(1), 0.99), abs=1e-8)
    assert (held.rows, held.cutoff, held.classes) == (160, 0.4, K.KNOWN) and IM.settings(spark, path) == held
    given, plain = rows(spark, 2, 60)
    found = {r.probe_id: r for r in IM.predict(given, path).collect()}
    asked = scaled(train, [r[2:] for r in plain])
    near = np.sort(np.sqrt(((asked[:, None] - own[None]) ** 2).sum(-1)), 1)[:, :5].mean(1)
    for r, d in zip(plain, near, strict=True):
        f = found[r[0]]
        assert f.novelty == pytest.approx(d, abs=1e-8) and sum(f.probability) == pytest.approx(1)
        assert f.predicted == (K.UNKNOWN if d > held.novelty_limit or f.confidence < 0.4 else f.top_label)
    assert all(found[r[0]].predicted == K.UNKNOWN for r in plain if r[1] == K.HELD_OUT)  # never learned, far away
    known = [r for r in plain if r[1] in CENTRES]
    assert np.mean([found[r[0]].top_label == r[1] for r in known]) > 0.95


def test_a_saved_model_predicts_the_same_again(spark, model):
    path, _, _ = model
    given, _ = rows(spark, 3, 25)
    once, again = (sorted((r.probe_id, r.predicted, r.confidence) for r in IM.predict(d, path).collect()) for d in (given, given.repartition(5)))
    assert once == again
    other = scratch_path(spark, "test-again")
    IM.fit(rows(spark, 1, 200)[0].repartition(7), other, NAMES, SMALL, 0.4)
    assert once == sorted((r.probe_id, r.predicted, r.confidence) for r in IM.predict(given, other).collect())


def test_cutoff_is_best_on_rows_and_noise(spark, model):
    path, _, _ = model
    given, _ = rows(spark, 4, 40, labels=tuple(CENTRES))
    noise, _ = rows(spark, 5, 20, shift=2.5, labels=(K.UNKNOWN,), prefix="n")
    assert 0.3 <= IM.tuned_cutoff(given, noise.drop("label"), path) <= 0.95
    with pytest.raises(ValueError):
        IM.fit(given.limit(0), scratch_path(spark, "none"), NAMES, SMALL, 0.4)


DECISION = """
WITH m AS (SELECT unnest(['production', 'candidate']) AS model), c AS (SELECT unnest(['database_saturation', 'deployment_regression', 'traffic_spike', 'dependency_failure']) AS label),
counted AS (SELECT model, label, count(*) FILTER (y_true = label) AS t, count(*) FILTER (predicted = label) AS p, count(*) FILTER (y_true = label AND predicted = label) AS h FROM preds, c WHERE NOT noise GROUP BY ALL),
f AS (SELECT model, avg(CASE WHEN t + p > 0 THEN 2.0 * h / (t + p) ELSE 0 END) AS f1 FROM counted WHERE t > 0 GROUP BY model),
a AS (SELECT model, avg((predicted <> 'unknown')::INT) AS fa FROM preds WHERE noise GROUP BY model),
j AS (SELECT max(f1) FILTER (model = 'production') AS pf, max(f1) FILTER (model = 'candidate') AS cf, max(coalesce(fa, 0)) FILTER (model = 'production') AS pa, max(coalesce(fa, 0)) FILTER (model = 'candidate') AS ca
  FROM m LEFT JOIN f USING (model) LEFT JOIN a USING (model))
SELECT round(cf, 9), round(pf, 9), cf > pf, ca <= pa, cf > pf AND ca <= pa FROM j
"""


@pytest.mark.parametrize("shift", [0.0, 8.0])
def test_decision_equals_sql_over_the_stored_predictions(spark, model, tmp_path, shift):
    path, _, _ = model
    train = rows(spark, 1, 200)[0]
    recent, later = rows(spark, 6, 80, shift, tuple(CENTRES))[0], rows(spark, 7, 60, shift, tuple(CENTRES))[0]
    noise = rows(spark, 8, 12, -9.0, (K.UNKNOWN,), "n")[0].drop("label")
    drift = spark.createDataFrame([(3.5,)], "max_psi double")
    found, decision = IM.gated_retrain(path, scratch_path(spark, "test-candidate"), train, recent, later, noise, drift, SMALL, NAMES)
    found.write.parquet(str(tmp_path / "preds"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW preds AS SELECT * FROM '{tmp_path}/preds/*.parquet'")
    got = decision.first()
    expected = con.execute(DECISION).fetchone()
    assert (round(got.candidate_macro_f1, 9), round(got.production_macro_f1, 9), got.better_macro_f1, got.false_alarm_not_worse, got.promoted) == expected
    assert got.drift_detected and got.retrained and found.count() == 2 * 72
    if shift:  # everything moved: only the candidate knows the new place
        assert got.promoted and got.candidate_macro_f1 > 0.9 > got.production_macro_f1


def test_without_drift_nothing_is_fitted(spark, model):
    path, _, _ = model
    given = rows(spark, 9, 20, labels=tuple(CENTRES))[0]
    for top in (0.25, None):
        drift = spark.createDataFrame([(top,)], "max_psi double")
        found, decision = IM.gated_retrain(path, "/nowhere", given, given, given, given.limit(0).drop("label"), drift, SMALL, NAMES)
        got = decision.first()
        assert {r.model for r in found.collect()} == {"production"} and got.candidate_macro_f1 is None
        assert not (got.drift_detected or got.retrained or got.better_macro_f1 or got.promoted)


def test_a_forest_in_groups_is_saved_and_loaded(spark, monkeypatch):
    monkeypatch.setattr(IM.C, "LARGE", 100)
    monkeypatch.setattr(IM.C, "GROUP", 4)
    given, _ = rows(spark, 3, 100)
    path = scratch_path(spark, "test-groups")
    IM.fit(given, path, NAMES, SMALL, 0.4)
    assert [s.getNumTrees for s in IM.PipelineModel.load(f"{path}/pipeline").stages[2:]] == [4, 4, 4, 3]
    got = IM.predict(given, path).collect()
    assert len(got) == 100 and all(abs(sum(r.probability) - 1) < 1e-9 for r in got)
    assert np.mean([r.top_label == r.label for r in got if r.label in CENTRES]) > 0.9
