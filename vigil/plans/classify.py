"""Registered queries: classification reports, open-set prediction, scaling, novelty and models.

Embeddings stand in for feature windows. Their first components act as raw model scores of the four
known classes, so predictions, confidences and truths grow with the table.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil import constants as K
from vigil.operators import classify as C
from vigil.plans.common import Fixture, fixture, r6, rounded, sql
from vigil.settings import cut

CUT, LIMIT = 0.4, 1.5
CAND_CUT, CAND_LIMIT = 0.3, 2.0
_LABELS_SQL = "[" + ", ".join(f"'{c}'" for c in K.LABELS) + "]"
_KNOWN_SQL = "[" + ", ".join(f"'{c}'" for c in K.KNOWN) + "]"
_EXP = [f"exp(8.0 * embedding[{i}]::DOUBLE)" for i in (1, 2, 3, 4)]

BLOCKS = {
    "probs": (
        [],
        f"""SELECT vec_id AS id, label, {_LABELS_SQL}[label % 6 + 1] AS y_true, 10.0 * abs(embedding[5]::DOUBLE) AS novelty,
            list_transform([{', '.join(_EXP)}], lambda e: e / ({' + '.join(_EXP)})) AS p FROM embeddings""",
    ),
    "scored": (
        ["probs"],
        f"""SELECT *, list_max(p) AS confidence, {_KNOWN_SQL}[list_position(p, list_max(p))] AS top FROM probs""",
    ),
    "preds": (
        ["scored"],
        f"""SELECT id, y_true, CASE WHEN confidence < {CUT} OR novelty > {LIMIT} THEN 'unknown' ELSE top END AS production,
            CASE WHEN confidence < {CAND_CUT} OR novelty > {CAND_LIMIT} THEN 'unknown' ELSE top END AS candidate, confidence, label FROM scored""",
    ),
    "long_preds": (
        ["preds"],
        "SELECT 'production' AS model, y_true, production AS y_pred FROM preds UNION ALL SELECT 'candidate', y_true, candidate FROM preds",
    ),
    "counts": (
        ["long_preds"],
        """SELECT model, c AS label, count(*) FILTER (y_true = c) AS t, count(*) FILTER (y_pred = c) AS p, count(*) FILTER (y_true = c AND y_pred = c) AS h
            FROM long_preds, unnest(%s) u(c) GROUP BY model, c""" % _LABELS_SQL,
    ),
    "report": (
        ["counts"],
        """SELECT model, label, CASE WHEN p > 0 THEN h / p::DOUBLE ELSE 0.0 END AS precision, h / t::DOUBLE AS recall, 2.0 * h / (p + t) AS f1, t AS support
            FROM counts WHERE t > 0 AND label <> 'memory_leak'""",
    ),
    "macro": (
        ["report"],
        "SELECT model, avg(f1) AS macro_f1, sum(recall * support) / sum(support) AS accuracy_known FROM report WHERE label <> 'unknown' GROUP BY model",
    ),
    "dims": ([], "SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings"),
    "scaled": (
        ["dims"],
        """SELECT vec_id, label, dim, greatest(-50.0, least(50.0, (v - mid) / (CASE WHEN hi = lo THEN 1.0 ELSE hi - lo END))) AS v FROM dims JOIN
            (SELECT dim, quantile_cont(v, 0.1) AS lo, quantile_cont(v, 0.5) AS mid, quantile_cont(v, 0.9) AS hi FROM dims WHERE label <> 9 GROUP BY dim) USING (dim)""",
    ),
    "vecs": (["scaled"], "SELECT vec_id, label, list(v ORDER BY dim) AS vec FROM scaled GROUP BY 1, 2"),
    "novel": (
        ["vecs"],
        """SELECT id, avg(d) AS novelty, any_value(label) AS label FROM (SELECT q.vec_id AS id, q.label, list_distance(q.vec, t.vec) AS d,
              row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_distance(q.vec, t.vec), 9), t.vec_id) AS r
            FROM vecs q JOIN vecs t ON t.label <> 9 AND t.vec_id <> q.vec_id) WHERE r <= 5 GROUP BY id""",
    ),
    "cuts": (
        ["scored"],
        """SELECT cutoff, sum(CASE WHEN t + p > 0 THEN 2.0 * h / (t + p) ELSE 0.0 END) / 5.0 AS macro_f1 FROM (
            SELECT cutoff, c, count(*) FILTER (y_true = c) AS t, count(*) FILTER (y_pred = c) AS p, count(*) FILTER (y_true = c AND y_pred = c) AS h
            FROM (SELECT g / 100.0::DOUBLE AS cutoff, y_true, CASE WHEN confidence < g / 100.0::DOUBLE OR novelty > %s THEN 'unknown' ELSE top END AS y_pred FROM scored, range(30, 96) r(g)),
              unnest(%s) u(c) WHERE c <> 'memory_leak' GROUP BY cutoff, c) GROUP BY cutoff""" % (LIMIT, _LABELS_SQL),
    ),
}


def _sql(body: str, *needs: str) -> str:
    return sql(body, *needs, blocks=BLOCKS)


def _probs(fx: Fixture):
    e = lambda i: F.exp(8.0 * F.element_at("embedding", i).cast("double"))
    total = e(1) + e(2) + e(3) + e(4)
    names = F.array(*[F.lit(c) for c in K.LABELS])
    return fx.table("embeddings").select(
        F.col("vec_id").alias("id"),
        "label",
        F.element_at(names, (F.col("label") % 6 + 1).cast("int")).alias("y_true"),
        (10.0 * F.abs(F.element_at("embedding", 5).cast("double"))).alias("novelty"),
        F.array(*[e(i) / total for i in (1, 2, 3, 4)]).alias("probability"),
    )


def scored(fx: Fixture, cut: float = CUT, limit: float = LIMIT):
    return C.explain(C.open_set_predict(_probs(fx), K.KNOWN, cut, limit), K.KNOWN, cut, limit)


def _both(fx: Fixture):
    """Production and candidate predictions of the same rows, one pass over them."""
    rows = C.open_set_predict(_probs(fx), K.KNOWN, CUT, LIMIT)
    cand = F.when((F.col("confidence") < CAND_CUT) | (F.col("novelty") > CAND_LIMIT), K.UNKNOWN).otherwise(F.col("top_label"))
    sides = F.array(
        F.struct(F.lit("production").alias("model"), F.col("predicted").alias("y_pred")),
        F.struct(F.lit("candidate").alias("model"), cand.alias("y_pred")),
    )
    return rows.withColumn("s", F.explode(sides)).select("s.model", "y_true", "s.y_pred")


def _vectors(fx: Fixture):
    e = fx.table("embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").cast("array<double>").alias("vec"))
    return C.robust_scale(e.filter("label <> 9"), e, "vec")


def _novelty(fx: Fixture):
    v = _vectors(fx)
    return C.novelty(v, v.filter("label <> 9"), 5, leave_self_out=True)


def class_report(spark, d):
    return rounded(C.class_report(_both(fixture(spark, d))))


def macro_f1(spark, d):
    return rounded(C.macro_f1(_both(fixture(spark, d))))


def confusion_matrix(spark, d):
    return C.confusion_matrix(_both(fixture(spark, d)).filter("model = 'production'").drop("model"))


def held_out_routing(spark, d):
    r = C.held_out_routing(_both(fixture(spark, d)).filter("model = 'production'"))
    text = F.transform(F.map_entries("predicted_as"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return rounded(r.withColumn("predicted_as", F.array_join(text, " ")))


def compare_models(spark, d):
    """Candidate against production on identical rows: F1, unknown share and false alarms on noise."""
    both = _both(fixture(spark, d))
    shares = both.groupBy("model").agg(
        F.avg((F.col("y_pred") == K.UNKNOWN).cast("double")).alias("unknown_share"),
        F.avg(F.when(F.col("y_true") == K.UNKNOWN, (F.col("y_pred") != K.UNKNOWN).cast("double"))).alias("false_alarm_rate"),
    )
    return rounded(C.macro_f1(both).join(shares, "model"))


def quality_report(spark, d):
    """Two-class report over labelled documents: quality as truth, not toxic as prediction."""
    lab = fixture(spark, d).table("labels")
    name = lambda c: F.when(c, K.KNOWN[0]).otherwise(K.UNKNOWN)
    return rounded(C.class_report(lab.select(name(F.col("quality") == 1).alias("y_true"), name(F.col("toxic") == 0).alias("y_pred"))))


def open_set_predict(spark, d):
    return rounded(scored(fixture(spark, d)).select("id", "confidence", "top_label", "predicted"))


def explain(spark, d):
    rows = scored(fixture(spark, d))
    ranked = F.array_join(F.transform(F.map_entries("explanation.probabilities"), lambda e: F.concat_ws("=", e["key"], F.format_string("%.4f", e["value"]))), " ")
    return rounded(rows.select("id", ranked.alias("probabilities"), "explanation.confidence", "explanation.novelty", "explanation.unknown_reason"))


def tune_cutoff(spark, d):
    return rounded(C.tune_cutoff(scored(fixture(spark, d)), LIMIT))


def best_cutoff(spark, d):
    return rounded(C.best_cutoff(C.tune_cutoff(scored(fixture(spark, d)), LIMIT)))


def best_config(spark, d):
    """Best of four open-set settings by F1, then fewer false alarms, then the stricter cut-off."""
    both = _both(fixture(spark, d))
    table = C.macro_f1(both).join(both.groupBy("model").agg(F.avg((F.col("y_pred") == K.UNKNOWN).cast("double")).alias("unknown_share")), "model")
    return rounded(C.best_config(table, F.round("macro_f1", 9), F.round("unknown_share", 9), F.col("model")))


def robust_scale(spark, d):
    v = _vectors(fixture(spark, d))
    return rounded(v.select("id", F.posexplode("vec").alias("dim", "value")))


def knn_novelty(spark, d):
    return rounded(_novelty(fixture(spark, d)))


def novelty_calibrate(spark, d):
    fx = fixture(spark, d)
    known = fx.table("embeddings").filter("label <> 9").select(F.col("vec_id").alias("id"))
    return rounded(C.calibrate_novelty(_novelty(fx).join(known, "id", "left_semi")))


def model_health(spark, d):
    rows = scored(fixture(spark, d)).withColumn("period", F.when(F.col("label") < 5, "before").otherwise("after"))
    return rounded(C.model_health(rows, "period"))


def false_alarm_rate(spark, d):
    return rounded(C.false_alarm_rate(scored(fixture(spark, d)).filter(F.col("y_true") == K.UNKNOWN)))


MODELS = [
    ("random_forest", {"numTrees": 300, "maxDepth": 30, "minInstancesPerNode": 1}),  # spark.ml grows no deeper than 30
    ("random_forest", {"numTrees": 300, "maxDepth": 8, "minInstancesPerNode": 2}),
    ("gradient_boosting", {"maxIter": 200, "maxDepth": 3, "stepSize": 0.1}),
    ("gradient_boosting", {"maxIter": 300, "maxDepth": 5, "stepSize": 0.05}),  # the original's 31 leaves fit into depth 5
]


def _labelled(fx: Fixture):
    e = fx.table("embeddings").filter("label <> 9")
    names = F.array(*[F.lit(c) for c in K.KNOWN])
    return e.select(F.col("vec_id").alias("id"), F.element_at(names, (F.col("label") % 4 + 1).cast("int")).alias("label"),
                    F.col("embedding").cast("array<double>").alias("features"))


def _halves(fx: Fixture):
    """Earlier rows train, later rows validate (ids are in time order)."""
    rows = _labelled(fx)
    mid = rows.agg(F.max("id") * 0.7).scalar()
    marked = rows.withColumn("mid", mid)
    return marked.filter("id < mid").drop("mid"), marked.filter("id >= mid").drop("mid")


def classifier_fit_predict(spark, d):
    fx = fixture(spark, d)
    train, later = _halves(fx)
    model = C.fit_classifier(train, *MODELS[0], K.KNOWN)
    out = cut(C.score(model, later).drop("features"), "probabilities")  # later steps use the probability many times
    return rounded(C.open_set_predict(out.withColumn("novelty", F.lit(0.0)), K.KNOWN, 0.3, 1.0).select("id", "label", "confidence", "top_label", "predicted"))


def model_selection(spark, d):
    train, later = _halves(fixture(spark, d))
    ranked = C.select_model(train, later.withColumn("novelty", F.lit(0.0)), MODELS, K.KNOWN)
    return rounded(C.best_config(ranked, F.col("macro_f1"), -F.col("candidate")))


def importance(spark, d):
    fx = fixture(spark, d)
    train, later = _halves(fx)
    model = C.fit_classifier(train, *MODELS[0], K.KNOWN)
    impurity = C.impurity_importance(model, [str(i) for i in range(64)], spark)
    shuffled = C.permutation_importance(model, later, K.KNOWN, 64, repeats=5).withColumnRenamed("importance", "permutation")
    return rounded(impurity.join(shuffled, impurity["feature"] == shuffled["dim"].cast("string")).select("feature", "importance", "permutation"))


QUERIES = {
    "class_report": (class_report, _sql(f"SELECT model, label, {r6('precision', 'recall', 'f1')}, support FROM report", "report")),
    "macro_f1": (macro_f1, _sql(f"SELECT model, {r6('macro_f1', 'accuracy_known')} FROM macro", "macro")),
    "confusion_matrix": (
        confusion_matrix,
        _sql(
            "SELECT c AS actual, " + ", ".join(f"count(*) FILTER (y_true = c AND y_pred = '{k}') AS {k}" for k in K.LABELS)
            + f" FROM (SELECT * FROM long_preds WHERE model = 'production'), unnest({_LABELS_SQL}) u(c) GROUP BY c HAVING count(*) FILTER (y_true = c OR y_pred = c) > 0",
            "long_preds",
        ),
    ),
    "held_out_routing": (
        held_out_routing,
        _sql(
            """SELECT sum(n)::BIGINT AS count, coalesce(sum(n) FILTER (y_pred = 'unknown'), 0)::BIGINT AS routed_unknown, round(sum(n) FILTER (y_pred = 'unknown') / sum(n)::DOUBLE, 6) AS share_unknown,
            string_agg(y_pred || '=' || n, ' ' ORDER BY y_pred) AS predicted_as
            FROM (SELECT y_pred, count(*) AS n FROM long_preds WHERE model = 'production' AND y_true = 'memory_leak' GROUP BY y_pred)""",
            "long_preds",
        ),
    ),
    "compare_models": (
        compare_models,
        _sql(
            f"""SELECT model, {r6('macro_f1', 'accuracy_known')}, round(u, 6) AS unknown_share, round(f, 6) AS false_alarm_rate FROM macro JOIN
            (SELECT model, avg((y_pred = 'unknown')::INT) AS u, avg((y_pred <> 'unknown')::INT) FILTER (y_true = 'unknown') AS f FROM long_preds GROUP BY model) USING (model)""",
            "macro", "long_preds",
        ),
    ),
    "quality_report": (
        quality_report,
        """SELECT label, round(CASE WHEN p > 0 THEN h / p::DOUBLE ELSE 0 END, 6) AS precision, round(h / t::DOUBLE, 6) AS recall, round(2.0 * h / (p + t), 6) AS f1, t AS support FROM (
        SELECT 'database_saturation' AS label, count(*) FILTER (quality = 1) AS t, count(*) FILTER (toxic = 0) AS p, count(*) FILTER (quality = 1 AND toxic = 0) AS h FROM labels
        UNION ALL SELECT 'unknown', count(*) FILTER (quality <> 1), count(*) FILTER (toxic <> 0), count(*) FILTER (quality <> 1 AND toxic <> 0) FROM labels) WHERE t > 0""",
    ),
    "open_set_predict": (open_set_predict, _sql("SELECT p.id, round(p.confidence, 6) AS confidence, s.top AS top_label, production AS predicted FROM preds p JOIN scored s USING (id)", "preds", "scored")),
    "explain": (
        explain,
        _sql(
            f"""SELECT id, (SELECT string_agg(c || '=' || printf('%.4f', x), ' ' ORDER BY x DESC) FROM (SELECT unnest({_KNOWN_SQL}) AS c, unnest(p) AS x)) AS probabilities,
            {r6('confidence', 'novelty')}, CASE WHEN novelty > {LIMIT} THEN 'far from every training example' WHEN confidence < {CUT} THEN 'low confidence' END AS unknown_reason FROM scored""",
            "scored",
        ),
    ),
    "tune_cutoff": (tune_cutoff, _sql(f"SELECT cutoff, {r6('macro_f1')} FROM cuts", "cuts")),
    "best_cutoff": (best_cutoff, _sql(f"SELECT cutoff, {r6('macro_f1')} FROM cuts ORDER BY round(macro_f1, 9) DESC, cutoff LIMIT 1", "cuts")),
    "best_config": (
        best_config,
        _sql(
            f"""SELECT model, {r6('macro_f1', 'accuracy_known')}, round(u, 6) AS unknown_share FROM macro JOIN (SELECT model, avg((y_pred = 'unknown')::INT) AS u FROM long_preds GROUP BY model) USING (model)
            ORDER BY round(macro.macro_f1, 9) DESC, round(u, 9) DESC, model DESC LIMIT 1""",
            "macro", "long_preds",
        ),
    ),
    "robust_scale": (robust_scale, _sql("SELECT vec_id AS id, dim::INT AS dim, round(v, 6) + 0.0 AS value FROM scaled", "scaled")),
    "knn_novelty": (knn_novelty, _sql("SELECT id, round(novelty, 6) AS novelty FROM novel", "novel")),
    "novelty_calibrate": (
        novelty_calibrate,
        _sql("SELECT round(quantile_cont(novelty, 0.99), 6) AS novelty_threshold, count(*) AS rows FROM novel WHERE label <> 9", "novel"),
    ),
    "model_health": (
        model_health,
        _sql(
            "SELECT CASE WHEN label < 5 THEN 'before' ELSE 'after' END AS period, round(avg(confidence), 6) AS mean_confidence, round(avg((production = 'unknown')::INT), 6) AS unknown_share FROM preds GROUP BY 1",
            "preds",
        ),
    ),
    "false_alarm_rate": (false_alarm_rate, _sql("SELECT round(avg((production <> 'unknown')::INT), 6) AS false_alarm_rate FROM preds WHERE y_true = 'unknown'", "preds")),
    "classifier_fit_predict": (classifier_fit_predict, None),
    "model_selection": (model_selection, None),
    "importance": (importance, None),
}
