"""Open-set incident classification: fitting, prediction, calibration and reports."""

from __future__ import annotations

from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark.ml import Model, PipelineModel
from pyspark.ml.classification import GBTClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil import constants as K
from vigil.functions.stats import exact_quantiles
from vigil.operators.nearest import nearest
from vigil.settings import cut

#: Rows of a partition that an estimator reads.
ROWS = 50_000
#: Products of rows and trees above which a forest is grown in groups of GROUP trees side by side.
LARGE, GROUP = 1_000_000, 25
#: Changed rows that a task of the permutation importance scores; every task is sent the whole forest.
SCORED = 75_000
#: Name of the votes of a group of trees, followed by its number.
VOTES = "tree_votes_"


# ------------------------------------------------------------------ reports


def _by_class(pairs: DataFrame) -> DataFrame:
    """label, truth, predicted, hits; one pass, combined before the shuffle."""
    hit = (F.col("y_true") == F.col("y_pred")).cast("long")
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    sides = F.array(
        F.struct(F.col("y_true").alias("label"), one.alias("t"), zero.alias("p"), hit.alias("h")),
        F.struct(F.col("y_pred").alias("label"), zero.alias("t"), one.alias("p"), zero.alias("h")),
    )
    keys = [c for c in pairs.columns if c not in ("y_true", "y_pred")]
    return (
        pairs.select(*keys, F.explode(sides).alias("s"))
        .groupBy(*keys, F.col("s.label").alias("label"))
        .agg(F.sum("s.t").alias("truth"), F.sum("s.p").alias("predicted"), F.sum("s.h").alias("hits"))
    )


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def class_report(pairs: DataFrame) -> DataFrame:
    """Precision, recall, F1, support of every scored class; columns beyond y_true/y_pred group reports."""
    precision, recall = _ratio(F.col("hits"), F.col("predicted")), _ratio(F.col("hits"), F.col("truth"))
    keys = [c for c in pairs.columns if c not in ("y_true", "y_pred")]
    return (
        _by_class(pairs)
        .filter((F.col("truth") > 0) & F.col("label").isin([c for c in K.LABELS if c != K.HELD_OUT]))
        .select(
            *keys,
            "label",
            precision.alias("precision"),
            recall.alias("recall"),
            _ratio(2.0 * F.col("hits"), F.col("predicted") + F.col("truth")).alias("f1"),
            F.col("truth").alias("support"),
        )
    )


def macro_f1(pairs: DataFrame) -> DataFrame:
    """Macro F1 over the known classes present, and accuracy on them."""
    keys = [c for c in pairs.columns if c not in ("y_true", "y_pred")]
    known = class_report(pairs).filter(F.col("label").isin(K.KNOWN))
    return known.groupBy(*keys).agg(
        F.avg("f1").alias("macro_f1"), (F.sum(F.col("recall") * F.col("support")) / F.sum("support")).alias("accuracy_known")
    )


def confusion_matrix(pairs: DataFrame, labels: list[str] = K.LABELS) -> DataFrame:
    """One row per label present in truth or prediction, one column per predicted label."""
    rows = F.array(F.struct(F.col("y_true").alias("actual"), F.col("y_pred").alias("p")),
                   F.struct(F.col("y_pred").alias("actual"), F.lit(None).cast("string").alias("p")))
    return (
        pairs.select(F.explode(rows).alias("r"))
        .groupBy(F.col("r.actual").alias("actual"))
        .agg(*[F.count(F.when(F.col("r.p") == c, 1)).alias(c) for c in labels])
    )


def held_out_routing(pairs: DataFrame) -> DataFrame:
    """Where windows of the class never trained on end up."""
    held = pairs.filter(F.col("y_true") == K.HELD_OUT).groupBy("y_pred").agg(F.count(F.lit(1)).alias("n"))
    unknown = F.sum(F.when(F.col("y_pred") == K.UNKNOWN, F.col("n")).otherwise(0))
    return held.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("count"),
        F.coalesce(unknown, F.lit(0)).alias("routed_unknown"),
        (unknown / F.sum("n")).alias("share_unknown"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("y_pred", "n")))).alias("predicted_as"),
    )


def model_health(predictions: DataFrame, period: str) -> DataFrame:
    return predictions.groupBy(period).agg(
        F.avg("confidence").alias("mean_confidence"), F.avg((F.col("predicted") == K.UNKNOWN).cast("double")).alias("unknown_share")
    )


def false_alarm_rate(predictions: DataFrame) -> DataFrame:
    """Share of noise windows not routed to unknown; null when there are none."""
    return predictions.agg(F.avg((F.col("predicted") != K.UNKNOWN).cast("double")).alias("false_alarm_rate"))


# ------------------------------------------------------------------ open-set prediction


def open_set_predict(df: DataFrame, classes: list[str], cutoff: float, novelty_limit: float) -> DataFrame:
    """top_label, confidence and predicted from `probability` (array) and `novelty`."""
    top = F.array_max("probability")
    label = F.element_at(F.array(*[F.lit(c) for c in classes]), F.array_position("probability", top).cast("int"))
    rows = df.withColumns({"confidence": top, "top_label": label})
    unsure = (F.col("confidence") < cutoff) | (F.col("novelty") > novelty_limit)
    return rows.withColumn("predicted", F.when(unsure, K.UNKNOWN).otherwise(F.col("top_label")))


def explain(df: DataFrame, classes: list[str], cutoff: float, novelty_limit: float) -> DataFrame:
    """Adds `explanation`: probabilities (most likely first), distances, limits, reason for unknown."""
    pairs = F.arrays_zip(F.array(*[F.lit(c) for c in classes]).alias("c"), F.col("probability").alias("p"))
    named = F.transform(pairs, lambda x: F.struct(x["p"].alias("p"), x["c"].alias("c")))
    order = F.reverse(F.array_sort(named))
    ranked = F.map_from_arrays(F.transform(order, lambda x: x["c"]), F.transform(order, lambda x: x["p"]))
    # ---- fixed values: the reasons for an unknown
    reason = F.when(F.col("novelty") > novelty_limit, "far from every training example").when(
        F.col("confidence") < cutoff, "low confidence"
    )
    return df.withColumn(
        "explanation",
        F.struct(
            ranked.alias("probabilities"), F.col("confidence"), F.col("novelty"), F.lit(novelty_limit).alias("novelty_threshold"),
            F.lit(cutoff).alias("confidence_threshold"), reason.alias("unknown_reason"),
        ),
    )


def tune_cutoff(df: DataFrame, novelty_limit: float, cuts: list[float] | None = None) -> DataFrame:
    """Macro F1 (unknown included, absent classes count 0) of every confidence cut-off.

    Rows are first counted by truth, label, novelty and the number of cut-offs they pass, a table of
    a few hundred rows; the grid is applied to that, so the data is not copied 66 times.
    """
    cuts = sorted(set(cuts or [round(0.30 + 0.01 * i, 2) for i in range(66)]))
    grid = F.array(*[F.lit(c) for c in cuts])
    passed = F.size(F.filter(grid, lambda c: c <= F.col("confidence")))
    counts = (
        df.select("y_true", "top_label", (F.col("novelty") > novelty_limit).alias("far"), passed.alias("passed"))
        .groupBy("y_true", "top_label", "far", "passed")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    per_cut = counts.select("*", F.posexplode(grid).alias("i", "cutoff")).withColumn(
        "y_pred", F.when(F.col("far") | (F.col("i") >= F.col("passed")), K.UNKNOWN).otherwise(F.col("top_label"))
    )
    labels = [*K.KNOWN, K.UNKNOWN]

    def f1(c: str) -> Column:
        hits = F.sum(F.when((F.col("y_true") == c) & (F.col("y_pred") == c), F.col("n")).otherwise(0))
        both = F.sum(F.when(F.col("y_true") == c, F.col("n")).otherwise(0)) + F.sum(F.when(F.col("y_pred") == c, F.col("n")).otherwise(0))
        return _ratio(2.0 * hits, both)

    total = f1(labels[0])
    for c in labels[1:]:
        total = total + f1(c)
    return per_cut.groupBy("cutoff").agg((total / float(len(labels))).alias("macro_f1"))


def best_cutoff(curve: DataFrame) -> DataFrame:
    """Highest score, smallest cut-off on ties."""
    best = curve.agg(F.max(F.struct(F.round("macro_f1", 9).alias("macro_f1"), (-F.col("cutoff")).alias("c"))).alias("b"))
    return best.select((-F.col("b.c")).alias("cutoff"), F.col("b.macro_f1").alias("macro_f1"))


# ------------------------------------------------------------------ scaling and novelty


def robust_scale(train: DataFrame, df: DataFrame, column: str, clip: float = 50.0) -> DataFrame:
    """Centre by the median and scale by the 10-90 % range of `train`, clipped.

    The parameters are two numbers per dimension; they reach the rows as one scalar array.
    """
    long = train.select(F.posexplode(column).alias("dim", "v"))
    q = exact_quantiles(long, ["dim"], "v", [0.1, 0.5, 0.9])
    width = F.col("q")[2] - F.col("q")[0]
    params = q.agg(
        F.sort_array(F.collect_list(F.struct("dim", F.col("q")[1].alias("mid"), F.when(width == 0, 1.0).otherwise(width).alias("width")))).alias("p")
    ).scalar()
    scaled = F.zip_with(
        F.col(column), F.col("_params"), lambda x, p: F.greatest(F.lit(-clip), F.least(F.lit(clip), (x.cast("double") - p["mid"]) / p["width"]))
    )
    return df.withColumn("_params", params).withColumn(column, scaled).drop("_params")


def novelty(queries: DataFrame, train: DataFrame, k: int = 5, leave_self_out: bool = False) -> DataFrame:
    """Mean distance to the k nearest training rows: (id, vec) twice in, (id, novelty) out."""
    near = nearest(queries, train, k, metric="l2", exclude_self=leave_self_out)
    return near.groupBy("query_id").agg(F.avg("score").alias("novelty")).withColumnRenamed("query_id", "id")


def calibrate_novelty(scores: DataFrame, quantile: float = 0.99) -> DataFrame:
    return exact_quantiles(scores, [], "novelty", [quantile]).select(F.col("q")[0].alias("novelty_threshold"), F.col("n").alias("rows"))


# ------------------------------------------------------------------ models


def _indexed(train: DataFrame, classes: list[str]) -> DataFrame:
    """Class index and balanced weight n / (classes * count)."""
    counts = train.groupBy("label").agg(F.count(F.lit(1)).alias("n_class"))
    totals = counts.agg(F.struct(F.sum("n_class").alias("n"), F.count(F.lit(1)).alias("k"))).scalar()
    weights = counts.withColumn("t", totals).select("label", (F.col("t.n") / (F.col("t.k") * F.col("n_class"))).alias("weight"))
    index = F.create_map(*[v for i, c in enumerate(classes) for v in (F.lit(c), F.lit(float(i)))])
    return train.join(weights, "label").withColumn("y", F.element_at(index, F.col("label")))


def grow(rows: DataFrame, n: int, params: dict, seed: int) -> list[Model]:
    """A class-balanced forest on n rows (x, y, weight): one model, or several that hold its trees in groups.

    A forest costs by its nodes, which one job after the other splits, so the trees of a large one are dealt
    to forests that grow at the same time; `voted` adds their votes, as one forest adds those of its trees.
    Rows keep the number of the node they have reached, or every job would walk all trees from the root.
    """
    trees = params["numTrees"]

    def forest(i: int, count: int, **columns: str) -> Model:
        settings = {**params, "numTrees": count, "seed": seed + i, "cacheNodeIds": True, **columns}
        return RandomForestClassifier(featuresCol="x", labelCol="y", weightCol="weight", **settings).fit(rows)

    if n * trees <= LARGE or trees <= GROUP:
        return [forest(0, trees)]
    sizes = [min(GROUP, trees - start) for start in range(0, trees, GROUP)]
    with ThreadPool(len(sizes)) as pool:
        return pool.starmap(lambda i, count: forest(i, count, rawPredictionCol=f"{VOTES}{i}", probabilityCol="", predictionCol=""), enumerate(sizes))


def voted(scored: DataFrame) -> Column:
    """Probability (array in class order) of rows that a forest, its groups or one-vs-rest models have scored;
    the margins of the last are squashed and normalised."""
    votes = [vector_to_array(c) for c in scored.columns if c.startswith(VOTES)]
    if not votes and "probability" in scored.columns:
        return vector_to_array("probability")
    if votes:
        raw = reduce(lambda a, b: F.zip_with(a, b, lambda x, y: x + y), votes)
    else:
        raw = F.transform(vector_to_array("rawPrediction"), lambda m: 1.0 / (1.0 + F.exp(-2.0 * m)))
    return F.transform(raw, lambda v: v / F.aggregate(raw, F.lit(0.0), lambda a, b: a + b))


def fit_classifier(train: DataFrame, kind: str, params: dict, classes: list[str], seed: int = 0) -> Model:
    """Fit on rows (features array, label). `random_forest` is class-balanced; boosting is one-vs-rest."""
    rows = _indexed(train, classes).withColumn("x", array_to_vector(F.col("features").cast("array<double>")))
    # sampling inside the estimators follows row order, so the order is fixed by content; many rounds over a
    # small table cost by tasks, so it is stored once in as many partitions as its rows ask for
    n = train.count()
    rows = rows.withColumn("h", F.xxhash64("features", "label"))
    rows = cut(rows.repartitionByRange(max(1, -(-n // ROWS)), "h").sortWithinPartitions("h").drop("h"), "training")
    if kind == "random_forest":
        grown = grow(rows, n, params, seed)
        return grown[0] if len(grown) == 1 else PipelineModel(grown)
    if kind == "gradient_boosting":
        single = GBTClassifier(featuresCol="x", labelCol="y", seed=seed, **params)
        return OneVsRest(classifier=single, featuresCol="x", labelCol="y", parallelism=len(classes)).fit(rows)
    raise ValueError(kind)


def score(model: Model, df: DataFrame) -> DataFrame:
    """Adds `probability` (array in class order)."""
    rows = df.withColumn("x", array_to_vector(F.col("features").cast("array<double>")))
    out = model.transform(rows)
    keep = [c for c in df.columns if c != "probability"]
    return out.select(*keep, voted(out).alias("probability"))


def select_model(train: DataFrame, validation: DataFrame, candidates: list[tuple[str, dict]], classes: list[str]) -> DataFrame:
    """Fit every candidate, tune its cut-off on the validation rows and rank them (best first).

    The candidates are a handful of settings; each fit and each evaluation is a distributed job, and the
    candidates run side by side, as a round over a small table leaves most cores idle.
    """

    def judged(i: int, kind: str, params: dict) -> DataFrame:
        model = fit_classifier(train, kind, params, classes)
        scored = open_set_predict(score(model, validation), classes, 0.0, float("inf"))
        best = best_cutoff(tune_cutoff(scored.withColumnRenamed("label", "y_true"), float("inf")))
        return cut(best.select(F.lit(i).alias("candidate"), F.lit(kind).alias("kind"), F.lit(str(params)).alias("params"), "cutoff", "macro_f1"), "candidate")

    with ThreadPool(len(candidates)) as pool:
        found = pool.starmap(judged, [(i, kind, params) for i, (kind, params) in enumerate(candidates)])
    return reduce(DataFrame.unionByName, found)


def best_config(configs: DataFrame, *order: Column) -> DataFrame:
    """Row with the greatest composite key."""
    return configs.agg(F.max_by(F.struct(*configs.columns), F.struct(*order)).alias("c")).select("c.*")


def impurity_importance(model: Model, names: list[str], spark) -> DataFrame:
    forests = model.stages if isinstance(model, PipelineModel) else [model]
    summed = sum(f.featureImportances.toArray() * f.getNumTrees for f in forests)  # one number per feature
    values = [float(v) for v in summed / sum(f.getNumTrees for f in forests)]
    rows = F.array(*[F.struct(F.lit(n).alias("feature"), F.lit(v).alias("importance")) for n, v in zip(names, values)])
    return spark.range(1).select(F.explode(rows).alias("r")).select("r.*")


def permutation_importance(model: Model, df: DataFrame, classes: list[str], dims: int, repeats: int = 5, rows_per_range: int = 100_000) -> DataFrame:
    """Mean loss of accuracy when one feature is shuffled, all features and repeats in one job.

    Both sides of a shuffle are ordered by a hash of the id, over the whole table. Positions are counted inside
    ranges of the hash, so no task orders the whole table, and the ranges' number does not change the result.
    """
    size = df.count()
    ranges = max(1, size // rows_per_range)
    tasks = max(1, size * repeats * dims // SCORED)
    base = df.select("id", "label", "features").withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))

    def placed(seed: int) -> DataFrame:
        at = F.floor((F.col("h").cast("double") / 2.0**64 + 0.5) * ranges)
        rows = base.withColumn("h", F.xxhash64("id", "r", F.lit(seed))).withColumn("range", F.least(at, F.lit(ranges - 1)))
        earlier = Window.partitionBy("r").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
        sizes = rows.groupBy("r", "range").agg(F.count(F.lit(1)).alias("n"))
        before = sizes.select("r", "range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
        place = F.row_number().over(Window.partitionBy("r", "range").orderBy("h", "id"))
        return rows.join(before, ["r", "range"]).withColumn("pos", F.col("before") + place)

    give = placed(2).select("r", "pos", F.col("features").alias("other"))
    # dealt by number: the rows are few bytes, and every one is scored once per feature
    pairs = placed(1).select("r", "pos", "id", "label", "features").join(give, ["r", "pos"]).repartition(tasks, "r", "pos")
    mixed = pairs.withColumn("dim", F.explode(F.sequence(F.lit(0), F.lit(dims - 1))))
    swapped = F.transform(F.col("features"), lambda v, i: F.when(i == F.col("dim"), F.element_at("other", F.col("dim") + 1)).otherwise(v))

    def hit(frame: DataFrame) -> DataFrame:
        # stored, so that what follows does not walk the trees again for every use of the probability
        found = cut(score(model, frame).drop("id", "features"), "probabilities")
        scored = open_set_predict(found.withColumn("novelty", F.lit(0.0)), classes, 0.0, float("inf"))
        return scored.withColumn("hit", (F.col("top_label") == F.col("label")).cast("double"))

    full = hit(df.select("id", "label", "features")).agg(F.avg("hit")).scalar()
    return (
        hit(mixed.withColumn("features", swapped).select("dim", "label", "features"))
        .groupBy("dim")
        .agg(F.avg("hit").alias("shuffled"))
        .withColumn("full", full)
        .select("dim", (F.col("full") - F.col("shuffled")).alias("importance"))
    )
