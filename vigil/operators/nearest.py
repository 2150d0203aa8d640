"""Exact top-k search between two vector tables, in blocks.

Every query must see every item, as in any exact search, but pairs never become rows: a task
multiplies a block of queries with a block of items, piece by piece, and keeps k per query. The blocks
have a fixed size, so neither side has to fit anywhere as a whole, and the plan is the same at any size.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 32_768  # rows of a block on average: a row travels once per block of the other side
PIECE = 1024  # rows of either side in one product


def in_blocks(df: DataFrame, own: int, other: int, mine: str, theirs: str) -> DataFrame:
    """Each row in its block `mine`, by its id, once for every block `theirs` of the other side."""
    others = F.sequence(F.lit(0).cast("long"), F.lit(max(other, 1) - 1).cast("long"))
    return df.withColumn(mine, F.pmod(F.xxhash64("id"), F.lit(max(own, 1)))).withColumn(theirs, F.explode(others))


def _scores(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    """Larger is better: dot product, or negated Euclidean distance."""
    dots = q @ x.T
    if metric == "dot":
        return dots
    squares = (q * q).sum(1)[:, None] + (x * x).sum(1)[None, :] - 2.0 * dots
    return -np.sqrt(np.maximum(squares, 0.0))


class Best:
    """The k best items of every query among those seen so far; equal scores (9 digits) go to the smaller item id.

    Only scores that reach a query's k-th best so far are sorted, which after the first items are few.
    """

    def __init__(self, queries: int, k: int):
        self.k, self.scores = k, np.full((queries, k), -np.inf)
        self.items = np.full((queries, k), None, dtype=object)

    def add(self, scores: np.ndarray, items: np.ndarray, positive: bool = False) -> None:
        """scores: queries x items, larger is better; items in the order of their ids. -inf is never kept, and with
        `positive` only what is above 0."""
        if not scores.size:
            return
        k, floor = self.k, self.scores[:, -1]
        low = np.maximum(floor - 1e-9, 0.0) if positive else floor - 1e-9
        held = scores >= low[:, None]
        many = np.flatnonzero(held.sum(axis=1) > 8 * k)
        if len(many):
            part = scores[many]
            limit = np.partition(part, part.shape[1] - k, axis=1)[:, part.shape[1] - k] - 1e-9
            held[many] &= part >= limit[:, None]
            tied = many[held[many].sum(axis=1) > 8 * k]
            if len(tied):
                first = np.argsort(-np.round(scores[tied], 9), axis=1, kind="stable")[:, :k]
                keep = np.zeros((len(tied), scores.shape[1]), dtype=bool)
                np.put_along_axis(keep, first, True, axis=1)
                held[tied] &= keep
        q, x = np.nonzero(held)
        s = np.round(scores[q, x], 9)
        fit = np.isfinite(s) & (s >= floor[q]) & ((s > 0) | (not positive))
        q, x, s = q[fit], x[fit], s[fit]
        if not len(q):
            return
        hit = np.unique(q)
        old_q, old_s, old_i = np.repeat(hit, k), self.scores[hit].ravel(), self.items[hit].ravel()
        known = np.isfinite(old_s)
        found = np.asarray(items, dtype=object)[x]
        rows = pd.DataFrame({"q": np.append(old_q[known], q), "s": np.append(old_s[known], s), "i": np.append(old_i[known], found)})
        rows = rows.sort_values(["q", "s", "i"], ascending=[True, False, True])
        rank = rows.groupby("q").cumcount().to_numpy()
        rows, rank = rows[rank < k], rank[rank < k]
        self.scores[hit] = -np.inf
        self.scores[rows["q"], rank], self.items[rows["q"], rank] = rows["s"], rows["i"]

    def hits(self, ids: np.ndarray) -> pd.DataFrame:
        """query_id, item_id, score of the queries, whose ids are given."""
        q, r = np.nonzero(np.isfinite(self.scores))
        return pd.DataFrame({"query_id": np.asarray(ids)[q], "item_id": pd.Series(self.items[q, r]).infer_objects(), "score": self.scores[q, r]})


def _same(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Where ids are equal; texts are compared by number."""
    if left.dtype == object or right.dtype == object:
        codes = pd.factorize(np.append(left.astype(object), right.astype(object)))[0]
        left, right = codes[: len(left)], codes[len(left) :]
    return left[:, None] == right[None, :]


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(float)


def nearest(
    queries: DataFrame, items: DataFrame, k: int, metric: str = "dot", exclude_self: bool = False, block: int = BLOCK
) -> DataFrame:
    """(id, vec) twice in; query_id, item_id, score, rank out. `l2` scores are distances, least first."""
    schema = f"query_id {dict(queries.dtypes)['id']}, item_id {dict(items.dtypes)['id']}, score double"
    q, x = queries.select("id", "vec"), items.select("id", "vec")
    n_q, n_x = -(-q.count() // block), -(-x.count() // block)

    def cell(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.sort_values("id")
        pieces = [(p["id"].to_numpy(), _matrix(p["vec"])) for p in (right.iloc[j : j + PIECE] for j in range(0, len(right), PIECE))]
        out = [pd.DataFrame({n: pd.Series([], dtype=object) for n in ("query_id", "item_id", "score")})]
        for i in range(0, len(left) if pieces else 0, PIECE):
            part = left.iloc[i : i + PIECE]
            ids, rows, best = part["id"].to_numpy(), _matrix(part["vec"]), Best(len(part), k)
            for items, vectors in pieces:
                scores = _scores(rows, vectors, metric)
                if exclude_self:
                    scores[_same(ids, items)] = -np.inf
                best.add(scores, items)
            hits = best.hits(ids)
            out.append(hits if metric == "dot" else hits.assign(score=-hits["score"]))
        return pd.concat(out[1:] or out)

    grid_q, grid_x = in_blocks(q, n_q, n_x, "qb", "xb"), in_blocks(x, n_x, n_q, "xb", "qb")
    found = grid_q.groupBy("qb", "xb").cogroup(grid_x.groupBy("qb", "xb")).applyInPandas(cell, schema)
    best = F.col("score").desc() if metric == "dot" else F.col("score").asc()
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(best, "item_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)
