"""Near-duplicate vectors: an exact cosine join in blocks that are stored once.

Vectors are sorted by label and length and stored in blocks of fixed size, one row each. Two blocks whose labels
overlap meet where they are read, in a task that multiplies them piece by piece, so no vector is copied for the blocks of
the other side and the disk grows with the input. What is close in single precision is checked exactly on the vectors as
given. Equal vectors are one vector with a count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.links import components
from vigil.settings import cut

#: Vectors of a block, and vectors of its left side that are multiplied at once.
BLOCK, PIECE = 2048, 512
#: Parts of the blocks, of which each meets all others in tasks of its own; vectors in a sorted partition.
PARTS, ROWS = 32, 16_384


def _units(vectors: np.ndarray) -> np.ndarray:
    x = vectors / np.abs(vectors).max(1, keepdims=True)  # no overflow in the squares
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _blocks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted rows (key, vec_id, embedding, copies) in blocks: first and last key, how many rows each key has, ids, copies and numbers."""
    for frame in frames:
        for start in range(0, len(frame), BLOCK):
            rows = frame.iloc[start : start + BLOCK]
            keys = rows["key"].to_numpy()
            first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            yield pd.DataFrame([{
                "low": keys[0], "high": keys[-1], "keys": keys[first].tolist(), "sizes": np.diff(np.append(first, len(rows))).tolist(),
                "ids": rows["vec_id"].to_numpy(np.int64).tobytes(), "copies": rows["copies"].to_numpy(np.int64).tobytes(),
                "numbers": np.concatenate([np.asarray(v, float) for v in rows["embedding"]]).tobytes(),
            }])


def _find(parent: np.ndarray, k: int) -> int:
    while parent[k] != k:
        parent[k] = parent[parent[k]]
        k = parent[k]
    return k


def _sides(row, side: str) -> dict:
    """For every key of a block: ids, copies and vectors."""
    ids, copies = (np.frombuffer(getattr(row, f"{side}_{c}"), dtype=np.int64) for c in ("ids", "copies"))
    numbers = np.frombuffer(getattr(row, f"{side}_numbers"), dtype=float)
    out, at, seen = {}, 0, 0
    for key, n in zip(getattr(row, f"{side}_keys"), getattr(row, f"{side}_sizes")):
        wide = n * int(key.rsplit("\x01", 1)[1])
        out[key] = ids[at : at + n], copies[at : at + n], numbers[seen : seen + wide].reshape(n, -1)
        at, seen = at + n, seen + wide
    return out


def _close(a: np.ndarray, b: np.ndarray, cosine: float, own: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs with the cosine; within one block (`own`) each pair once."""
    unit_a, unit_b = _units(a), _units(b)
    norm_a, norm_b = np.sqrt((a * a).sum(1)), np.sqrt((b * b).sum(1))
    low, other = np.float32(cosine - 1e-6 - 2e-7 * a.shape[1]), unit_b.astype(np.float32).T  # below any error of single precision
    found = []
    for start in range(0, len(a), PIECE):
        x, y = np.nonzero(unit_a[start : start + PIECE].astype(np.float32) @ other >= low)
        x += start
        if own:
            x, y = x[x < y], y[x < y]
        for s in range(0, len(x), 65536):
            i, j = x[s : s + 65536], y[s : s + 65536]
            with np.errstate(all="ignore"):
                whole = (a[i] * b[j]).sum(1) / (norm_a[i] * norm_b[j])
            good = np.where(np.isfinite(whole), whole >= cosine, (unit_a[i] * unit_b[j]).sum(1) >= cosine)
            found.append((i[good], j[good]))
    return tuple(np.concatenate(side) if found else np.empty(0, np.int64) for side in (zip(*found) if found else ((), ())))


def _linked(left: tuple, right: tuple, cosine: float, own: bool) -> pd.DataFrame | None:
    """Links between vectors of one key in two blocks (or within one): per vector the copies linked, and a spanning forest."""
    (ids_a, copies_a, a), (ids_b, copies_b, b) = left, right
    x, y = _close(a, b, cosine, own)
    if not len(x):
        return None
    ids = np.concatenate([ids_a, ids_b])
    links = np.concatenate([np.bincount(x, copies_b[y], len(ids_a)), np.bincount(y, copies_a[x], len(ids_b))]).astype(int)
    names, at = np.unique(ids, return_inverse=True)
    parent, forest = np.arange(len(names)), []
    for p, q in zip(at[x].tolist(), at[len(ids_a) + y].tolist(), strict=True):
        p, q = _find(parent, p), _find(parent, q)
        if p != q:
            parent[p] = q
            forest.append((names[p], names[q]))
    some = links > 0
    edges = pd.DataFrame(forest, columns=["vec_id", "other"], dtype="int64")
    edges["links"] = 0
    return pd.concat([pd.DataFrame({"vec_id": ids[some], "links": links[some], "other": -1}), edges])[["vec_id", "links", "other"]]


def _joined(frames: Iterator[pd.DataFrame], cosine: float) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for row in frame.itertuples(index=False):
            own, left, right = row.a_no == row.b_no, _sides(row, "a"), _sides(row, "b")
            for key in left.keys() & right.keys():
                found = _linked(left[key], right[key], cosine, own)
                if found is not None:
                    yield found


def near_duplicates(vectors: DataFrame, cosine: float = 0.93, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, n_links (other vectors linked directly), component_id (least vec_id reachable), kept (vec_id = component_id); one row per vector.

    Two vectors link when their labels are equal and not null, their lengths are equal and their cosine in
    double precision is at least `cosine` (above 0). Vectors that are null, empty, zero or hold null or
    non-finite components link with nothing. vec_id is unique and not negative; a null one links with
    nothing. An empty table gives no rows; other columns are not read.
    """
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("embedding"), F.col(label).cast("string").alias("label"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0.0)
    good = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite, F.lit(False)))
    whole = cut(good.groupBy("label", "embedding").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies")), "vectors")
    key = F.concat("label", F.lit("\x01"), F.size("embedding").cast("string"))
    keyed = whole.select(key.alias("key"), "vec_id", "embedding", "copies")
    parts = max(1, -(-whole.count() // ROWS))  # read from the footers; a label of any size is spread over them
    ordered = keyed.repartitionByRange(parts, "key", "vec_id").sortWithinPartitions("key", "vec_id")
    schema = "low string, high string, keys array<string>, sizes array<long>, ids binary, copies binary, numbers binary"
    stored = cut(ordered.mapInPandas(_blocks, schema).withColumn("no", F.monotonically_increasing_id()), "blocks")
    a, b = (stored.select(*[F.col(c).alias(f"{side}_{c}") for c in stored.columns]) for side in "ab")
    overlap = (F.col("a_no") <= F.col("b_no")) & (F.col("a_low") <= F.col("b_high")) & (F.col("b_low") <= F.col("a_high"))
    pairs = a.coalesce(PARTS).join(b.hint("shuffle_replicate_nl"), overlap)
    found = cut(pairs.mapInPandas(lambda frames: _joined(frames, cosine), "vec_id long, links long, other long"), "links")
    counts = found.where("other < 0").groupBy("vec_id").agg(F.sum("links").alias("links"))
    roots = components(found.where("other >= 0").select(F.col("vec_id").alias("a"), F.col("other").alias("b")))
    # stored tables are far larger in memory than on disk, by which Spark would pick those to broadcast
    classes = whole.join(counts.hint("merge"), "vec_id", "left").join(roots.hint("merge"), F.col("vec_id") == F.col("node"), "left")
    classes = classes.select("label", "embedding", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "vec_id").alias("component_id"))
    out = good.join(classes.hint("merge"), ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    rest = rows.where(F.col("vec_id").isNull() | F.col("label").isNull() | ~F.coalesce(finite, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
