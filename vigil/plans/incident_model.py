"""Registered queries: the classifier on the feature table, its reports, incidents with its predictions, and the retrain cycle.

The first half of the recorded days trains, the second half is the changed platform. Only windows of known
categories are learned; false alerts are the noise that a model should call unknown.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil import constants as K
from vigil.operators import classify as C
from vigil.operators import drift as R
from vigil.operators import features as FE
from vigil.operators import incident_model as IM
from vigil.operators import incidents as I
from vigil.operators import matching as M
from vigil.plans import features as PF
from vigil.plans.common import STEP, Fixture, fixture, rounded, sql
from vigil.settings import cut, scratch_path

#: The original's forest; spark.ml grows no deeper than 30.
FOREST = {"numTrees": 300, "maxDepth": 30, "minInstancesPerNode": 1}
#: Days of the original's training data, of which VALIDATION_FROM_DAY is the first to validate on.
TRAIN_DAYS = 30


def _alert_id():
    return F.concat(F.lit("A"), F.unix_seconds("fired_at").cast("string")).alias("probe_id")


class Cycle:
    """Feature rows with labels and days, and the production model fitted on the earlier ones."""

    def __init__(self, fx: Fixture):
        self.fx = fx
        span = fx.minutes.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).first()  # two times
        self.first, self.half = span["a"], (span["b"] - span["a"]).days // 2
        self.features = cut(PF._features(fx), "feature-rows")
        self.windows = cut(_windows(fx, self.first, self.half).join(self.features.drop("at", "culprit"), "probe_id"), "labelled")
        noise = M.false_alerts(fx.alerts, fx.faults, ["fired_at"], step=STEP).select(_alert_id(), F.col("fired_at").alias("start"))
        self.noise = cut(_placed(noise, self.first, self.half).join(self.features.drop("at", "culprit"), "probe_id"), "noise")
        self.path = scratch_path(fx.spark, "production")
        known = self.windows.where(F.col("label").isin(K.KNOWN))
        self.train, self.later = known.where("split = 'train'"), known.where("split = 'upgrade'")
        validate = round(self.half * K.VALIDATION_FROM_DAY / TRAIN_DAYS)
        early = scratch_path(fx.spark, "early")
        names = K.feature_names()
        IM.fit(self.train.where(F.col("day") < validate), early, names, FOREST, 0.0)
        held, quiet = (d.where(F.col("day") >= validate) for d in (self.train, self.noise.where("split = 'train'")))
        IM.fit(self.train, self.path, names, FOREST, IM.tuned_cutoff(held, quiet, early))


def _placed(rows: DataFrame, first, half: int) -> DataFrame:
    """`day` since the first minute, and the half it falls into."""
    return FE.time_split(rows, F.col("start"), F.lit(first), half, "train", "upgrade")


def _windows(fx: Fixture, first, half: int) -> DataFrame:
    onset = FE.fault_windows(fx.faults, step=STEP).select("probe_id", F.col("category").alias("label"), "start")
    return _placed(onset, first, half)


def cycle(spark, d) -> Cycle:
    fx = fixture(spark, d)
    if not hasattr(fx, "cycle"):
        fx.cycle = Cycle(fx)
    return fx.cycle


def retrain_split(spark, d):
    """Windows of each category in training, retraining and hold-out days."""
    fx = fixture(spark, d)
    span = fx.minutes.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).first()
    half = (span["b"] - span["a"]).days // 2
    part = F.when(F.col("split") == "train", "train").when(F.col("day") < half + K.RETRAIN_DAYS, "recent").otherwise("holdout")
    return _windows(fx, span["a"], half).where(F.col("label").isin(K.KNOWN)).groupBy("label", part.alias("part")).agg(F.count("*").alias("windows"))


def _scored_alerts(c: Cycle) -> DataFrame:
    """Every alert scored in one batch by the saved model."""
    if not hasattr(c, "alerts"):
        rows = c.features.where("probe_id like 'A%'")
        c.alerts = cut(IM.predict(rows, c.path), "alert-predictions")
    return c.alerts


def alert_predictions(spark, d):
    """Batch scoring of the alerts' feature rows by the saved pipeline, with the rules' opinion next to it."""
    c = cycle(spark, d)
    rules = I.rules_classify(c.features).select("probe_id", "rules_prediction")
    found = _scored_alerts(c).join(rules, "probe_id")
    return rounded(found.select("probe_id", "predicted", "confidence", "novelty", "rules_prediction", "explanation.unknown_reason"))


def _judged(c: Cycle) -> DataFrame:
    """rows, model, y_true, y_pred: later windows and all alerts, by the model and by the rules."""
    windows = IM.predict(c.later, c.path).select("probe_id", F.col("label").alias("y_true"), "predicted", F.lit("windows").alias("rows"))
    labels = M.label_alerts(c.fx.alerts, c.fx.faults, step=STEP).select(_alert_id(), F.col("label").alias("y_true"))
    alerts = _scored_alerts(c).join(labels, "probe_id").select("probe_id", "y_true", "predicted", F.lit("alerts").alias("rows"))
    rules = I.rules_classify(c.features).select("probe_id", "rules_prediction")
    both = windows.unionByName(alerts).join(rules, "probe_id")
    sides = F.array(F.struct(F.lit("model").alias("model"), F.col("predicted").alias("y_pred")), F.struct(F.lit("rules").alias("model"), F.col("rules_prediction").alias("y_pred")))
    return both.withColumn("s", F.explode(sides)).select("rows", "s.model", "y_true", "s.y_pred")


def model_and_rules(spark, d):
    """Macro F1 and accuracy of the saved model and of the rules, on later windows and on alerts."""
    return rounded(C.macro_f1(_judged(cycle(spark, d))))


def model_and_rules_report(spark, d):
    return rounded(C.class_report(_judged(cycle(spark, d))))


def model_incidents(spark, d):
    """Incident records that carry the saved model's predictions of their own alerts."""
    c = cycle(spark, d)
    fx = c.fx
    keyed = cut(I.number_incidents(fx.alerts).select("incident_id", "fired_at", _alert_id()), "numbered")
    feats = c.features.join(keyed.select("incident_id", "probe_id"), "probe_id")
    preds = _scored_alerts(c).join(keyed, "probe_id").select("incident_id", "predicted", "confidence", "explanation")
    own = M.owners(fx.alerts, fx.faults, ["fired_at"], step=STEP)
    rows = I.build_incidents(fx.alerts, feats, preds, own, fx.faults)
    return rounded(rows.select("incident_id", "fired_at", "service", "predicted", "confidence", "rules_prediction", F.col("ground_truth.category").alias("category"), F.col("explanation.unknown_reason").alias("unknown_reason"), "status"))


def _retrained(c: Cycle) -> tuple[DataFrame, DataFrame]:
    if not hasattr(c, "retrained"):
        upgrade_from = F.lit(c.first) + F.make_dt_interval(F.lit(c.half))
        drift = R.drift_summary(R.signal_drift(c.fx.minutes.where(F.col("ts") < upgrade_from), c.fx.minutes.where(F.col("ts") >= upgrade_from)))
        recent = F.col("day") < c.half + K.RETRAIN_DAYS
        c.retrained = IM.gated_retrain(c.path, scratch_path(c.fx.spark, "candidate"), c.train, c.later.where(recent), c.later.where(~recent), c.noise.where("split = 'upgrade'").where(~recent), cut(drift, "drift"), FOREST)
    return c.retrained


def retrain_cycle(spark, d):
    """The decision row of the gated retrain, computed from the stored predictions of both models."""
    return rounded(_retrained(cycle(spark, d))[1])


def retrain_predictions(spark, d):
    return rounded(_retrained(cycle(spark, d))[0])


_SPLIT_SQL = """
SELECT category AS label, CASE WHEN day < half THEN 'train' WHEN day < half + 6 THEN 'recent' ELSE 'holdout' END AS part, count(*) AS windows
FROM (SELECT f.category, date_diff('microsecond', t.a, f.start_ts) // 86400000000 AS day, date_diff('microsecond', t.a, t.b) // 86400000000 // 2 AS half
  FROM faults f, unnest([1, 2, 3, 4, 6]) u(o), (SELECT min(ts) AS a, max(ts) AS b FROM minutes) t WHERE f.category <> 'memory_leak')
GROUP BY 1, 2
"""
QUERIES = {
    "retrain_split": (retrain_split, sql(_SPLIT_SQL, "faults", "minutes")),
    "alert_predictions": (alert_predictions, None),
    "model_and_rules": (model_and_rules, None),
    "model_and_rules_report": (model_and_rules_report, None),
    "model_incidents": (model_incidents, None),
    "retrain_cycle": (retrain_cycle, None),
    "retrain_predictions": (retrain_predictions, None),
}
