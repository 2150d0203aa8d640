"""Causal robust EWMA z-scores and the per-minute anomaly score."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil import constants as K
from vigil.operators.rollup import number_rows


def ewma_step(mean: float, var: float, x: float, rn: int, floor: tuple, alpha: float, warm: int, clip: float):
    """One observation against the baseline so far: (z or None, new mean, new variance)."""
    std = max(math.sqrt(var), floor[0], floor[1] * abs(mean))
    z = (x - mean) / std if rn >= warm else None
    if rn >= warm:
        x = min(max(x, mean - clip * std), mean + clip * std)
    delta = x - mean
    return z, mean + alpha * delta, (1 - alpha) * (var + alpha * delta * delta)


def ewma_z(
    minutes: DataFrame,
    timeline: DataFrame | None = None,
    floors: dict[str, tuple] = K.STD_FLOOR,
    alpha: float = K.EWMA_ALPHA,
    warm: int = K.EWMA_WARM_ROWS,
    clip: float = K.EWMA_CLIP,
    upward: bool = True,
) -> DataFrame:
    """z of every signal, one row per service and minute (signal columns hold the z-scores).

    Clipping makes the baseline a true recurrence, so each service is folded in time order. Rows are
    hashed by service and sorted by Spark (spilling if need be) and stream through the fold in Arrow
    batches: a task holds one batch and two numbers per signal, never a whole series. A service has at
    most one row per minute here whatever its raw volume. Missing minutes only decay the variance.
    """
    signals = list(floors)
    timeline = number_rows(minutes) if timeline is None else timeline
    rows = minutes.select("service", "ts", *signals).join(timeline, "ts")
    schema = T.StructType(
        [T.StructField("service", T.StringType()), T.StructField("ts", T.TimestampType()), T.StructField("rn", T.LongType())]
        + [T.StructField(s, T.DoubleType()) for s in signals]
    )

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        service, state = None, {}
        for pdf in batches:
            names, rns = pdf["service"].tolist(), pdf["rn"].tolist()
            out = {}
            for signal in signals:
                zs = [None] * len(names)
                current, known = service, dict(state) if service is not None else {}
                mean, var, last = known.get(signal, (0.0, 0.0, 0))
                for i, x in enumerate(pdf[signal].tolist()):
                    if names[i] != current:
                        current, mean, var, last = names[i], 0.0, 0.0, 0
                    rn = rns[i]
                    if x is None or x != x:
                        continue  # decayed when the next value arrives
                    if rn == 0:
                        mean, var, last = x, 0.0, 0
                        continue
                    if rn - last > 1:
                        var *= (1 - alpha) ** (rn - last - 1)
                    z, mean, var = ewma_step(mean, var, x, rn, floors[signal], alpha, warm, clip)
                    last = rn
                    zs[i] = z if z is None or not upward or z > 0 else 0.0
                out[signal] = zs
                state[signal] = (mean, var, last)
            service = names[-1] if names else service
            yield pd.DataFrame({"service": pdf["service"], "ts": pdf["ts"], "rn": pdf["rn"], **out})

    ordered = rows.select("service", "ts", "rn", *signals).repartition("service").sortWithinPartitions("service", "rn")
    return ordered.mapInPandas(fold, schema)


def long_z(z: DataFrame, floors: dict[str, tuple] = K.STD_FLOOR) -> DataFrame:
    """ts, service, signal, z with nulls dropped."""
    return z.unpivot(["ts", "service"], list(floors), "signal", "z").filter(F.col("z").isNotNull())


def z_matrix(z: DataFrame, timeline: DataFrame, floors: dict[str, tuple] = K.STD_FLOOR) -> DataFrame:
    """Dense ts x (signal, service): keys with any z, gaps filled with 0."""
    long = long_z(z, floors)
    rows = timeline.agg(F.max("rn")).scalar()
    # every key lists its row numbers, which then meet the times in an equi-join
    grid = (
        long.select("service", "signal")
        .distinct()
        .withColumn("rn", F.explode(F.sequence(F.lit(0).cast("long"), rows)))
        .join(timeline.select("rn", "ts"), "rn")
    )
    return grid.join(long, ["ts", "service", "signal"], "left").select(
        "ts", "service", "signal", F.coalesce("z", F.lit(0.0)).alias("z")
    )


def _rank(services: list[str]) -> Column:
    """Column order of a service: negated so that the larger struct is the earlier column."""
    listed = F.create_map(*[F.lit(v) for i, s in enumerate(services) for v in (s, -i)])
    return F.coalesce(F.element_at(listed, F.col("service")), F.lit(-len(services)))


def first_key(
    minutes: DataFrame,
    timeline: DataFrame,
    floors: dict[str, tuple] = K.STD_FLOOR,
    services: list[str] = K.SERVICE_NAMES,
    warm: int = K.EWMA_WARM_ROWS,
) -> DataFrame:
    """One row, one struct: the first (signal, service) column that ever has a z, read off the minutes."""
    cells = [
        F.when(
            F.col(s).isNotNull(),
            F.struct(F.lit(-i).alias("s"), _rank(services).alias("r"), F.lit(s).alias("signal"), F.col("service").alias("service")),
        )
        for i, s in enumerate(floors)
    ]
    warmed = minutes.join(timeline.filter(F.col("rn") >= warm), "ts", "left_semi")
    return warmed.select(F.array_max(F.array(*cells)).alias("f")).agg(F.max("f").alias("f"))


def minute_score(
    z: DataFrame,
    timeline: DataFrame,
    first: DataFrame,
    floors: dict[str, tuple] = K.STD_FLOOR,
    services: list[str] = K.SERVICE_NAMES,
) -> DataFrame:
    """Largest z of every minute and its key; the first column (signal, then service order) wins ties.

    Each row first picks its best signal, so the shuffle carries one value per service and minute and
    combines before it. Minutes without any positive z score 0 and name `first`.
    """
    cells = [
        F.when(
            F.col(s).isNotNull(),
            F.struct(
                F.col(s).alias("z"), F.lit(-i).alias("s"), _rank(services).alias("r"), F.lit(s).alias("signal"),
                F.col("service").alias("service"),
            ),
        )
        for i, s in enumerate(floors)
    ]
    top = z.groupBy("ts").agg(F.max(F.array_max(F.array(*cells))).alias("best"))
    score = F.coalesce(F.col("best.z"), F.lit(0.0))
    return (
        timeline.join(top, "ts", "left")
        .withColumn("first", first.scalar())
        .select(
            "ts",
            "rn",
            score.alias("score"),
            F.when(score > 0, F.col("best.signal")).otherwise(F.col("first.signal")).alias("signal"),
            F.when(score > 0, F.col("best.service")).otherwise(F.col("first.service")).alias("service"),
        )
    )
