"""Isolation forest over minute vectors: trees grown on small samples, rows scored where they are."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil import constants as K

EULER = 0.5772156649015329


def minute_vectors(z: DataFrame, timeline: DataFrame, floors: dict[str, tuple] = K.STD_FLOOR, services: list[str] = K.SERVICE_NAMES) -> DataFrame:
    """ts, x: log1p of every z of the minute in column order, 0 where there is none."""
    cells = [F.max(F.when(F.col("service") == s, F.col(sig))) for sig in floors for s in services]
    wide = z.groupBy("ts").agg(F.array(*[F.log1p(F.coalesce(c, F.lit(0.0))) for c in cells]).alias("x"))
    empty = F.array(*[F.lit(0.0) for _ in cells])
    return timeline.select("ts").join(wide, "ts", "left").select("ts", F.coalesce("x", empty).alias("x"))


def average_path(n: np.ndarray | float) -> np.ndarray:
    """Mean depth of an unsuccessful search in a binary tree of n rows."""
    n = np.asarray(n, dtype=float)
    big = 2.0 * (np.log(np.maximum(n - 1.0, 1.0)) + EULER) - 2.0 * (n - 1.0) / np.maximum(n, 1.0)
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, big))


def _grow(x: np.ndarray, rng: np.random.Generator, limit: int) -> dict:
    """Random splits down to single rows or the depth limit; nodes as flat lists."""
    feature, cutoff, left, right, path = [], [], [], [], []
    todo = [(np.arange(len(x)), 0, -1, False)]
    while todo:
        rows, depth, parent, is_right = todo.pop()
        node = len(feature)
        if parent >= 0:
            (right if is_right else left)[parent] = node
        sub = x[rows]
        low, high = (sub.min(0), sub.max(0)) if len(rows) else (np.zeros(x.shape[1]),) * 2
        varied = np.flatnonzero(high > low)
        left.append(-1)
        right.append(-1)
        path.append(depth + float(average_path(len(rows))))
        if depth >= limit or len(rows) <= 1 or not len(varied):
            feature.append(-1)
            cutoff.append(0.0)
            continue
        f = int(rng.choice(varied))
        c = float(rng.uniform(low[f], high[f]))
        feature.append(f)
        cutoff.append(c)
        goes_left = sub[:, f] <= c
        todo += [(rows[~goes_left], depth + 1, node, True), (rows[goes_left], depth + 1, node, False)]
    return {"feature": feature, "cutoff": cutoff, "left": left, "right": right, "path": path}


def fit_forest(rows: DataFrame, trees: int = 200, sample: int = 4096, seed: int = 0) -> DataFrame:
    """rows(ts, x) -> one row per tree.

    A row joins the sample of a tree by a hash of its time, so only about sample * trees rows travel,
    whatever the size of the table, and a repeated task draws the same sample.
    """
    n = rows.count()
    size = min(sample, n)
    share = 1.0 if n <= sample else min(1.0, (sample + 6.0 * sample**0.5) / n)
    unit = lambda t: F.pmod(F.xxhash64("ts", t, F.lit(seed)), F.lit(1 << 52)) / float(1 << 52)
    numbers = F.sequence(F.lit(0), F.lit(trees - 1))
    drawn = rows.select("ts", "x", F.explode(F.filter(numbers, lambda t: unit(t) < share)).alias("tree")).withColumn("u", unit(F.col("tree")))
    limit = int(np.ceil(np.log2(max(size, 2))))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        part = pdf.sort_values(["u", "ts"]).head(size)
        grown = _grow(np.stack(part["x"].to_list()), np.random.default_rng([seed, tree]), limit)
        return pd.DataFrame([{"tree": tree, "rows": len(part), **grown}])

    schema = "tree int, rows int, feature array<int>, cutoff array<double>, left array<int>, right array<int>, path array<double>"
    return drawn.groupBy("tree").applyInPandas(build, schema)


def score_forest(rows: DataFrame, forest: DataFrame) -> DataFrame:
    """ts, score: 2^(-mean path / expected path), larger is more anomalous.

    The forest is bounded by its parameters (trees * 2 * sample nodes), so it is broadcast.
    """
    grown = [
        (r["rows"], np.array(r["feature"]), np.array(r["cutoff"]), np.array(r["left"]), np.array(r["right"]), np.array(r["path"]))
        for r in forest.collect()
    ]
    shared = rows.sparkSession.sparkContext.broadcast(grown)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.stack(pdf["x"].to_list())
            total, norm = np.zeros(len(x)), 0.0
            for n, feature, cutoff, left, right, path in shared.value:
                node = np.zeros(len(x), dtype=int)
                while True:
                    f = feature[node]
                    inner = np.flatnonzero(f >= 0)
                    if not len(inner):
                        break
                    at = node[inner]
                    lower = x[inner, f[inner]] <= cutoff[at]
                    node[inner] = np.where(lower, left[at], right[at])
                total += path[node]
                norm += float(average_path(n))
            yield pd.DataFrame({"ts": pdf["ts"], "score": 2.0 ** (-total / max(norm, 1e-12))})

    return rows.mapInPandas(score, "ts timestamp, score double")
