"""Population stability, and the decision to retrain and promote."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil import constants as K
from vigil.functions.stats import count_of, drift_level, exact_quantiles

FLOOR = 1e-6


def bin_edges(expected: DataFrame, keys: list[str], value: str, bins: int = 10) -> DataFrame:
    """keys, n_edges, inner: the distinct quantiles of each key, and those of them that part its bins."""
    probs = [i / bins for i in range(bins + 1)]
    edges = exact_quantiles(expected, keys, value, probs).select(*keys, F.array_distinct("q").alias("q"))
    return edges.select(*keys, F.size("q").alias("n_edges"), F.slice("q", 2, F.greatest(F.size("q") - 2, F.lit(0))).alias("inner"))


def bin_of(value: Column, bins: int = 10) -> Column:
    """Bin of a value beside its key's `inner` edges."""
    return count_of([F.get("inner", F.lit(i)) <= value for i in range(bins - 1)])


def psi_of_counts(counts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, psi from keys, n_edges, and the rows of each bin on both sides (e, a)."""
    per_key = counts.groupBy(*keys, "n_edges").agg(
        F.collect_list(F.struct("e", "a")).alias("b"), F.sum("e").alias("ne"), F.sum("a").alias("na")
    )  # at most `bins` entries

    def share(c: Column, n: Column) -> Column:
        return F.greatest(F.try_divide(c, n), F.lit(FLOOR))

    def term(b: Column) -> Column:
        e, a = share(b["e"], F.col("ne")), share(b["a"], F.col("na"))
        return (a - e) * F.log(a / e)

    total = F.aggregate("b", F.lit(0.0), lambda acc, b: acc + term(b))
    missing = (F.col("ne") == 0) | (F.col("na") == 0)  # a key that one side lacks has no PSI
    return per_key.select(*keys, F.when(missing, None).when(F.col("n_edges") < 3, 0.0).otherwise(total).alias("psi"))


def psi(expected: DataFrame, actual: DataFrame, keys: list[str], value: str, bins: int = 10) -> DataFrame:
    """PSI per key, all keys in one job: keys, psi.

    Edges are the distinct quantiles of `expected`; bins are right-open with infinite ends. Both sides
    are reduced to counts per key and bin before they are shuffled, and edges are found without
    gathering a key (see exact_quantiles), so a key with a third of the rows is no special case.
    """
    edges = bin_edges(expected, keys, value, bins)
    sides = expected.select(*keys, F.col(value).cast("double").alias("v"), F.lit(1).alias("e")).unionByName(
        actual.select(*keys, F.col(value).cast("double").alias("v"), F.lit(0).alias("e"))
    ).filter(F.abs(F.col("v")) < float("inf"))
    if keys:
        binned = sides.join(edges, keys)
    else:
        binned = sides.withColumn("m", edges.select(F.struct("n_edges", "inner")).scalar()).select("v", "e", "m.*")
    counts = (
        binned.select(*keys, "n_edges", bin_of(F.col("v"), bins).alias("bin"), "e")
        .groupBy(*keys, "n_edges", "bin")
        .agg(F.sum("e").cast("double").alias("e"), F.sum(1 - F.col("e")).cast("double").alias("a"))
    )
    return psi_of_counts(counts, keys)


def bin_counts(rows: DataFrame, edges: DataFrame, keys: list[str], value: str, bins: int = 10, by: list[str] | None = None) -> DataFrame:
    """keys, by, bin, n: rows in each bin of the given edges; keys without edges are left out."""
    by = by or []
    finite = rows.select(*keys, *by, F.col(value).cast("double").alias("v")).filter(F.abs(F.col("v")) < float("inf"))
    return finite.join(edges, keys).groupBy(*keys, *by, bin_of(F.col("v"), bins).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def drift_by_day(edges: DataFrame, reference: DataFrame, counts: DataFrame, keys: list[str]) -> DataFrame:
    """PSI of every key after each day: keys, day, psi, level; all that came up to a day against the reference.

    edges as of bin_edges; reference (keys, bin, n) and counts (keys, day, bin, n) as of bin_counts, where
    counts may name a bin of a day several times. Only counts are read: bins times days per key.
    """
    days = counts.agg(F.sort_array(F.collect_set("day")).alias("d")).scalar()  # one entry a day
    bins = F.explode(F.expr("sequence(0, size(inner))"))
    grid = edges.select(*keys, "n_edges", bins.alias("bin")).withColumn("day", F.explode(days))
    daily = counts.groupBy(*keys, "day", "bin").agg(F.sum("n").alias("n"))
    so_far = Window.partitionBy(*keys, "bin").orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = grid.join(daily, [*keys, "day", "bin"], "left").withColumn("a", F.coalesce(F.sum("n").over(so_far), F.lit(0)).cast("double")).drop("n")
    rows = rows.join(reference.select(*keys, "bin", F.col("n").alias("e")), [*keys, "bin"], "left")
    rows = rows.withColumn("e", F.coalesce("e", F.lit(0)).cast("double"))
    return with_level(psi_of_counts(rows, [*keys, "day"]))


def with_level(values: DataFrame, digits: int = 4) -> DataFrame:
    """psi rounded as reported, with its level (`no data` without a psi)."""
    return values.withColumn("level", F.when(F.col("psi").isNull(), "no data").otherwise(drift_level(F.col("psi")))).withColumn("psi", F.round("psi", digits))


def signal_drift(reference: DataFrame, current: DataFrame, signals: list[str] = K.DRIFT_SIGNALS) -> DataFrame:
    """PSI of every signal and service, one job."""

    def long(df: DataFrame) -> DataFrame:
        return df.unpivot(["service"], signals, "signal", "value")

    return with_level(psi(long(reference), long(current), ["signal", "service"], "value"))


def feature_drift(reference: DataFrame, current: DataFrame, features: list[str], bins: int = 5) -> DataFrame:
    def long(df: DataFrame) -> DataFrame:
        return df.select(*features).unpivot([], features, "feature", "value")

    return with_level(psi(long(reference), long(current), ["feature"], "value", bins))


def drift_summary(values: DataFrame) -> DataFrame:
    """Largest and median PSI and the number of significant entries (one row per signal or feature)."""
    return values.agg(
        F.max("psi").alias("max_psi"),
        F.percentile("psi", 0.5).alias("median_psi"),
        F.count(F.when(F.col("level") == "significant", 1)).alias("significant"),
    )


def promotion_decision(drift: DataFrame, comparison: DataFrame) -> DataFrame:
    """Promote iff drift was detected, macro F1 is strictly better and false alarms are not worse.

    `drift` has one row with max_psi; `comparison` one row per model with macro_f1 and false_alarm_rate.
    """
    rows = comparison.groupBy().pivot("model", ["production", "candidate"]).agg(
        F.first("macro_f1").alias("f1"), F.first("false_alarm_rate").alias("fa")
    )
    detected = F.col("max_psi") > K.PSI_SIGNIFICANT
    better = F.col("candidate_f1") > F.col("production_f1")
    calm = F.coalesce("candidate_fa", F.lit(0.0)) <= F.coalesce("production_fa", F.lit(0.0))
    return rows.withColumn("max_psi", drift.select("max_psi").scalar()).select(
        "max_psi",
        detected.alias("drift_detected"),
        detected.alias("retrained"),
        F.col("candidate_f1").alias("candidate_macro_f1"),
        F.col("production_f1").alias("production_macro_f1"),
        better.alias("better_macro_f1"),
        calm.alias("false_alarm_not_worse"),
        (detected & better & calm).alias("promoted"),
    )
