"""Statistical column expressions and exact quantiles at any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil import constants as K

# ---- fixed values: rational approximation of the normal distribution (Hart 1968, double precision)
PHI_NUM = [
    3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871,
    221.213596169931, 220.206867912376,
]
PHI_DEN = [
    8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674,
    637.333633378831, 793.826512519948, 440.413735824752,
]
Z_95 = 1.6448536269514722


def _horner(coefficients: list[float], x: Column) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + F.lit(c)
    return out


def normal_cdf(x: Column) -> Column:
    """Standard normal distribution function as a column expression (there is no built-in erf)."""
    a = F.abs(x)
    core = _horner(PHI_NUM, a) / _horner(PHI_DEN, a)
    tail = F.lit(1.0) / (a + 1.0 / (a + 2.0 / (a + 3.0 / (a + 4.0 / (a + 0.65))))) / F.lit(2.506628274631)
    lower = F.exp(-a * a / 2.0) * F.when(a < 7.07106781186547, core).otherwise(tail)
    lower = F.when(a > 37, F.lit(0.0)).otherwise(lower)
    return F.when(x > 0, 1.0 - lower).otherwise(lower)


def latency_good_share(p50: Column, p95: Column, threshold: float = K.LATENCY_THRESHOLD_MS) -> Column:
    """Share of requests under `threshold` ms if latency is log-normal with these percentiles."""
    low = F.greatest(p50, F.lit(1e-3))
    high = F.greatest(p95, low * 1.0001)
    sigma = F.log(high / low) / Z_95
    return normal_cdf((F.log(F.lit(threshold)) - F.log(low)) / sigma)


def drift_level(psi: Column) -> Column:
    return (
        F.when(psi > K.PSI_SIGNIFICANT, "significant").when(psi >= K.PSI_MODERATE, "moderate").otherwise("stable")
    )


def finite(x: Column) -> Column:
    """NaN and infinities become null."""
    return F.when(F.abs(x) < float("inf"), x)


def count_of(conditions: list[Column]) -> Column:
    """How many of a fixed list of conditions hold (compiled, unlike a filter over an array)."""
    out = F.lit(0)
    for c in conditions:
        out = out + F.when(c, 1).otherwise(0)
    return out


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: list[float], accuracy: int = 10_000) -> DataFrame:
    """Linear-interpolated quantiles per key, exact, without sending a key's values to one task.

    `percentile` keeps every distinct value of a group in one buffer, which a key holding a third of
    all rows does not survive. Here a mergeable sketch first brackets each wanted rank (its rank error
    is at most n/accuracy, by construction). One more pass counts the rows: those between brackets
    fall into a few groups per key, those inside one (about 4/accuracy of the key) are counted by
    value. Only the latter are ordered, each bracket on its own. In a small group the wanted rank may
    be the neighbour of its bracket; that is the least or greatest value of the group next to it.
    Result: keys, n, q (array in the order of `probs`).
    """
    probs_up = sorted(probs)
    margin = 2.0 / accuracy
    data = df.select(*keys, F.col(value).cast("double").alias("v")).filter(F.abs(F.col("v")) < float("inf"))
    low = [F.lit(max(0.0, p - margin)) for p in probs_up]
    high = [F.lit(min(1.0, p + margin)) for p in probs_up]
    sketch = data.groupBy(*keys).agg(
        F.percentile_approx("v", F.array(*low, *high), F.lit(accuracy)).alias("b"), F.count(F.lit(1)).alias("n")
    )
    size = len(probs_up)
    brackets = sketch.select(*keys, "n", F.slice("b", 1, size).alias("froms"), F.slice("b", size + 1, size).alias("tos"))
    if keys:
        joined = data.join(brackets, keys)
    else:
        joined = data.withColumn("m", brackets.select(F.struct("n", "froms", "tos")).scalar()).select("v", "m.*")
    entered = count_of([F.col("froms")[i] <= F.col("v") for i in range(size)])  # brackets begun at or below v
    left = count_of([F.col("tos")[i] < F.col("v") for i in range(size)])  # brackets ended below v
    groups = (
        joined.select(*keys, "n", "v", entered.alias("entered"), left.alias("left"))
        .withColumn("inside", F.when(F.col("entered") > F.col("left"), F.col("v")))
        .groupBy(*keys, "n", "entered", "left", "inside")
        .agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("v_min"), F.max("v").alias("v_max"))
    )
    # rank = rows in earlier groups (a few totals per key) + rows before it in its own group
    totals = groups.groupBy(*keys, "entered", "left").agg(F.sum("c").alias("total"))
    by_key = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    earlier = by_key.orderBy("entered", "left").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("offset", F.coalesce(F.sum("total").over(earlier), F.lit(0))).drop("total")
    within = Window.partitionBy(*keys, "entered", "left").orderBy("v_min").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = groups.withColumn("upto", F.sum("c").over(within)).join(offsets, [*keys, "entered", "left"])
    first = F.col("offset") + F.col("upto") - F.col("c")
    last = F.col("offset") + F.col("upto") - 1
    wanted = F.array(
        *[
            F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p"), side(F.lit(float(p)) * (F.col("n") - 1)).alias("r"))
            for i, p in enumerate(probs)
            for side in (F.floor, F.ceil)
        ]
    )
    hits = (
        ranked.select(*keys, "n", "v_min", "v_max", first.alias("first"), last.alias("last"), wanted.alias("w"))
        .withColumn("w", F.explode(F.filter("w", lambda w: (w["r"] >= F.col("first")) & (w["r"] <= F.col("last")))))
        .select(*keys, "n", "w.*", F.when(F.col("w.r") == F.col("first"), F.col("v_min")).otherwise(F.col("v_max")).alias("v"))
    )
    rank = F.first("p") * (F.col("n") - 1)
    each = hits.groupBy(*keys, "n", "i").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), (rank - F.floor(rank)).alias("part"))
    q = F.struct("i", (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("part")).alias("q"))
    return each.groupBy(*keys, "n").agg(F.transform(F.sort_array(F.collect_list(q)), lambda s: s["q"]).alias("q"))
