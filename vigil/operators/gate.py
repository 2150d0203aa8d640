"""Release gate: canary comparison on a quiet window, model and budget checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil import constants as K


def quiet_window(minutes: DataFrame, column: str = "error_rate", rows: int = 120) -> DataFrame:
    """Per service, the `rows` rows with the least deviation: service, window_start, window_end, deviation.

    Rows before the first full window are skipped, the earliest window wins ties.
    """
    line = Window.partitionBy("service").orderBy("ts")
    span = line.rowsBetween(-(rows - 1), 0)
    rolled = minutes.select(
        "service", "ts",
        F.round(F.stddev_samp(column).over(span), 9).alias("deviation"),
        F.first("ts").over(span).alias("window_start"),
        (F.row_number().over(line) - 1).alias("i"),
    )
    full = rolled.filter((F.col("i") >= rows) & F.col("deviation").isNotNull())
    best = full.groupBy("service").agg(F.min(F.struct("deviation", "ts", "window_start")).alias("b"))
    return best.select("service", F.col("b.window_start").alias("window_start"), F.col("b.ts").alias("window_end"), F.col("b.deviation").alias("deviation"))


def canary_compare(minutes: DataFrame, spans: DataFrame, keys: list[str], step: int = 60) -> DataFrame:
    """Mean error rate and p95 of two recorded spans per row of `spans`, and what lies between them.

    spans: keys, service, baseline_start, baseline_end, candidate_start, candidate_end; ends are steps of
    the minutes and belong to the span. A span is laid out step by step and meets the minutes by equality,
    so long recordings are not compared with every span of their service. A span that is null or has no
    recorded minute keeps null means.
    """

    def laid_out(side: str) -> DataFrame:
        steps = F.sequence(F.col(f"{side}_start"), F.col(f"{side}_end"), F.expr(f"make_dt_interval(0, 0, 0, {step})"))
        valid = F.when(F.col(f"{side}_start") <= F.col(f"{side}_end"), steps)
        return spans.select(*dict.fromkeys([*keys, "service"]), F.lit(side).alias("side"), F.explode(valid).alias("ts"))

    found = laid_out("baseline").unionByName(laid_out("candidate")).join(minutes.select("service", "ts", "error_rate", "latency_p95"), ["service", "ts"])

    def mean(column: str, side: str) -> Column:
        return F.avg(F.when(F.col("side") == side, F.col(column)))

    means = found.groupBy(*keys).agg(
        mean("error_rate", "baseline").alias("baseline_error_rate"), mean("latency_p95", "baseline").alias("baseline_p95"),
        mean("error_rate", "candidate").alias("candidate_error_rate"), mean("latency_p95", "candidate").alias("candidate_p95"),
    )
    return spans.select(*keys).join(means, keys, "left").select(
        "*",
        ((F.col("candidate_error_rate") - F.col("baseline_error_rate")) * 100.0).alias("error_delta_pp"),
        (F.try_divide("candidate_p95", "baseline_p95") - 1.0).alias("p95_delta"),
    )


def gate_checks(candidates: DataFrame, production_f1: DataFrame, worst: DataFrame) -> DataFrame:
    """Five check rows per candidate.

    candidates: candidate_id, tests_passed, baseline_error_rate, candidate_error_rate, baseline_p95,
    candidate_p95, model_macro_f1 (null: unchanged), urgent, budget_override (null: measured).
    production_f1 and worst (service, budget_remaining) have one row and arrive as scalars, so the
    gate is a projection over the candidates. A check that cannot be measured fails.
    """
    rows = candidates.withColumns({"prod_f1": production_f1.scalar(), "worst": worst.select(F.struct("service", "budget_remaining")).scalar()})
    error_pp = (F.col("candidate_error_rate") - F.col("baseline_error_rate")) * 100.0
    p95 = F.try_divide("candidate_p95", "baseline_p95") - 1.0
    f1 = F.coalesce("model_macro_f1", "prod_f1")
    left = F.coalesce("budget_override", "worst.budget_remaining")
    frozen = left < K.BUDGET_FREEZE

    def check(no: int, name: str, passed: Column, value: Column, limit: float, detail: Column) -> Column:
        return F.struct(
            F.lit(no).alias("check_no"), F.lit(name).alias("check"), F.coalesce(passed, F.lit(False)).alias("passed"), value.cast("double").alias("measured"),
            F.lit(limit).alias("threshold"), detail.alias("detail"),
        )

    # ---- fixed values: names and details of the five checks
    checks = F.array(
        check(1, "Tests", F.col("tests_passed"), F.col("tests_passed").cast("int"), 1.0, F.lit("reported by the CI test job")),
        check(2, "Canary: error rate", error_pp <= K.ERROR_DELTA_PP, error_pp, K.ERROR_DELTA_PP, F.lit("replay of recorded traffic")),
        check(3, "Canary: p95 latency", p95 <= K.P95_DELTA, p95, K.P95_DELTA, F.lit("replay of recorded traffic")),
        check(4, "Model: macro F1", f1 >= F.col("prod_f1") - K.MODEL_TOLERANCE, f1 - F.col("prod_f1"), -K.MODEL_TOLERANCE,
              F.when(F.col("model_macro_f1").isNull(), "model unchanged").otherwise("candidate model evaluated")),
        check(5, "Error budget", ~frozen | F.col("urgent"), left, K.BUDGET_FREEZE,
              F.when(F.col("urgent") & frozen, "urgent release: exempt from the freeze").otherwise("error budget policy")),
    )
    return rows.select("candidate_id", F.explode(checks).alias("c")).select("candidate_id", "c.*")


def gate_verdict(checks: DataFrame) -> DataFrame:
    """A check without a measurement counts as failed."""
    passed = F.coalesce("passed", F.lit(False))
    failed = F.sort_array(F.collect_list(F.when(~passed, F.col("check_no"))))
    return checks.groupBy("candidate_id").agg(F.bool_and(passed).alias("passed"), failed.alias("failed_checks"))
