"""The incident classifier as a stored artefact: fitted on feature rows, saved, loaded for batch scoring, retrained behind a gate.

A model is a folder: `pipeline` (a PipelineModel of scaling, assembly and a classifier), `train` (the
scaled training rows, for distances) and `settings` (one row: confidence cut-off and distance limit).
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil import constants as K
from vigil.functions.stats import exact_quantiles
from vigil.operators import classify as C
from vigil.operators.drift import promotion_decision
from vigil.settings import cut

CLIP = 50.0
NEIGHBOURS, NOVELTY_QUANTILE = 5, 0.99
#: Rows of a partition that an estimator reads; small tables are fitted in few tasks.
ROWS = 50_000


class Settings(NamedTuple):
    cutoff: float
    novelty_limit: float
    classes: list[str]
    rows: int


def _scaler(train: DataFrame, names: list[str]) -> SQLTransformer:
    """Adds `scaled`: every feature centred by its median, divided by its 10-90 % range and clipped.

    The parameters are two numbers a feature; they are written into the statement, so they are saved with it.
    """
    long = train.select(*names).unpivot([], names, "feature", "value")
    found = {r["feature"]: r["q"] for r in exact_quantiles(long, ["feature"], "value", [0.1, 0.5, 0.9]).select("feature", "q").collect()}

    def one(name: str) -> str:
        low, mid, high = found[name]
        width = high - low if high != low else 1.0
        return f"greatest({-CLIP}D, least({CLIP}D, (`{name}` - ({mid!r}D)) / ({width!r}D)))"

    return SQLTransformer(statement=f"SELECT *, array({', '.join(map(one, names))}) AS scaled FROM __THIS__")


def fit(rows: DataFrame, path: str, names: list[str], params: dict, cutoff: float, classes: list[str] = K.KNOWN, seed: int = 0) -> Settings:
    """Fits rows (probe_id, label, features) of the given classes and saves the model in `path`.

    Rows of other classes are left out. The distance limit is the NOVELTY_QUANTILE of each training row's
    mean distance to its NEIGHBOURS nearest others.
    """
    spark = rows.sparkSession
    train = cut(rows.where(F.col("label").isin(classes)).select("probe_id", "label", *names), "train")
    n = train.count()
    if not n:
        raise ValueError("no rows of the known classes to fit")
    order = F.xxhash64(*names, "label"), F.col("probe_id")
    prepared = Pipeline(stages=[_scaler(train, names), VectorAssembler(inputCols=names, outputCol="x")]).fit(train)
    # sampling inside the estimator follows row order, so the order is fixed by content
    ordered = cut(prepared.transform(C._indexed(train, classes)).repartitionByRange(-(-n // ROWS), *order).sortWithinPartitions(*order), "ordered")
    model = PipelineModel([*prepared.stages, *C.grow(ordered, n, params, seed)])
    model.write().overwrite().save(f"{path}/pipeline")
    scaled = model.stages[0].transform(train).select(F.col("probe_id").alias("id"), F.col("scaled").alias("vec"))
    scaled.write.mode("overwrite").parquet(f"{path}/train")
    vectors = spark.read.parquet(f"{path}/train")
    limit = C.calibrate_novelty(C.novelty(vectors, vectors, NEIGHBOURS, leave_self_out=True), NOVELTY_QUANTILE).first()
    settings = Settings(cutoff, limit["novelty_threshold"] if limit and limit["novelty_threshold"] is not None else float("inf"), list(classes), n)
    spark.createDataFrame([settings], "cutoff double, novelty_limit double, classes array<string>, rows long").write.mode("overwrite").parquet(f"{path}/settings")
    return settings


def settings(spark: SparkSession, path: str) -> Settings:
    return Settings(*spark.read.parquet(f"{path}/settings").first())


def predict(rows: DataFrame, path: str, cutoff: float | None = None) -> DataFrame:
    """Batch scoring by the model saved in `path`: the rows with probability, novelty, confidence, top_label, predicted, explanation.

    `probe_id` is unique. Distances come from the exact search in blocks, so neither the rows nor the
    training rows have to fit into one task.
    """
    spark = rows.sparkSession
    held = settings(spark, path)
    out = PipelineModel.load(f"{path}/pipeline").transform(rows)
    scored = cut(out.select(*rows.columns, "scaled", C.voted(out).alias("probability")), "probabilities")
    near = C.novelty(scored.select(F.col("probe_id").alias("id"), F.col("scaled").alias("vec")), spark.read.parquet(f"{path}/train"), NEIGHBOURS)
    both = scored.drop("scaled").join(near.withColumnRenamed("id", "probe_id"), "probe_id")
    at = held.cutoff if cutoff is None else cutoff
    return C.explain(C.open_set_predict(both, held.classes, at, held.novelty_limit), held.classes, at, held.novelty_limit)


def tuned_cutoff(rows: DataFrame, noise: DataFrame, path: str) -> float:
    """The confidence cut-off with the best macro F1 on validation rows and noise, which is to be unknown."""
    given = rows.select("probe_id", "label", *_features(rows)).unionByName(noise.withColumn("label", F.lit(K.UNKNOWN)).select("probe_id", "label", *_features(rows)))
    found = predict(given, path, 0.0).withColumnRenamed("label", "y_true")
    best = C.best_cutoff(C.tune_cutoff(found, settings(rows.sparkSession, path).novelty_limit)).first()
    return best["cutoff"] if best and best["cutoff"] is not None else 0.0


def _features(rows: DataFrame) -> list[str]:
    return [c for c in rows.columns if c not in ("probe_id", "label", "at", "culprit", "day", "split")]


def gated_retrain(
    production: str, candidate: str, train: DataFrame, recent: DataFrame, holdout: DataFrame, noise: DataFrame, drift: DataFrame, params: dict,
    names: list[str] | None = None, threshold: float = K.PSI_SIGNIFICANT,
) -> tuple[DataFrame, DataFrame]:
    """(predictions, decision). Where drift exceeds `threshold`, a candidate is fitted on train and recent rows.

    It keeps production's cut-off and learns a distance limit of its own. Both models predict the same
    hold-out and noise rows; the stored table (model, probe_id, y_true, noise, predicted, confidence, novelty) is all that the
    decision is computed from. Promotion needs drift, a strictly better macro F1 on the hold-out and no more false
    alarms on noise. Without drift nothing is fitted, and only production is in the table. `drift` has one row with max_psi.
    """
    spark = train.sparkSession
    names = names or K.feature_names()
    top = drift.select("max_psi").first()
    models = {"production": production}
    if top and top["max_psi"] is not None and top["max_psi"] > threshold:
        given = train.select("probe_id", "label", *names).unionByName(recent.select("probe_id", "label", *names))
        fit(given, candidate, names, params, settings(spark, production).cutoff)
        models["candidate"] = candidate
    asked = cut(
        holdout.select("probe_id", F.col("label").alias("y_true"), *names, F.lit(False).alias("noise"))
        .unionByName(noise.select("probe_id", F.lit(K.UNKNOWN).alias("y_true"), *names, F.lit(True).alias("noise"))), "asked")
    tables = [
        predict(asked, path).select(F.lit(name).alias("model"), "probe_id", "y_true", "noise", "predicted", "confidence", "novelty")
        for name, path in models.items()
    ]
    found = cut(tables[0] if len(tables) == 1 else tables[0].unionByName(tables[1]), "predictions")
    return found, decide(found, drift, len(models) == 2)


def decide(predictions: DataFrame, drift: DataFrame, retrained: bool) -> DataFrame:
    """The decision row from stored predictions; without a candidate nothing is better and nothing is promoted."""
    score = C.macro_f1(predictions.where("not noise").select("model", "y_true", F.col("predicted").alias("y_pred")))
    alarms = predictions.where("noise").groupBy("model").agg(F.avg((F.col("predicted") != K.UNKNOWN).cast("double")).alias("false_alarm_rate"))
    both = predictions.select("model").distinct().join(score, "model", "left").join(alarms, "model", "left")
    made = promotion_decision(drift, both).withColumn("retrained", F.lit(retrained))
    calm = F.lit(retrained) & F.col("false_alarm_not_worse")
    return made.withColumns({c: F.coalesce(F.col(c), F.lit(False)) for c in ("drift_detected", "better_macro_f1", "promoted")}).withColumn("false_alarm_not_worse", calm)
