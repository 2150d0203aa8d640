"""Exact Jaccard join of word shingle sets: pivots, regions, triangle windows.

1. Coarse regions. Every document is placed at its rarest shingles, one-shingle pivots: under one order
   of all shingles (rare before common), d_s(x, y) = |(x ^ y) before s| obeys the triangle inequality,
   so a partner of x has at most |x| - ceil(t |x|) elements that x lacks before any shared s. x is
   therefore replicated to that many pivots and one more, and two linked documents share a pivot.
2. Regions. In each pivot's cell the first document becomes the pivot of a region; its Jaccard distance
   to all others of the cell is computed. With radius 2 * eps (eps = 1 - t): documents within eps are
   linked to the pivot and need no more links among themselves; those in (eps, 3 eps] are compared with
   each other and with linked ones whose distance to the pivot differs by eps at most (the window).
3. Recursion. Documents beyond 2 eps go on to the next round with a new pivot in their cell; the ring
   (2 eps, 3 eps] belongs to both sides. What is left after the last round is joined in blocks.

Copies meet as one set (its fingerprint), however many there are. The order comes from a fixed-size count
sketch over all shingles, so shingles that many documents share come last and hardly ever make a cell.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vigil.llm.links import components
from vigil.llm.tokens import release
from vigil.llm.words import mix, shingle_sets, texts_of
from vigil.settings import cut, scratch_path

#: Counters of the sketch: 2 ** BITS, whatever the input; every worker holds one copy.
BITS = 22
_SLICES = 64
#: Bits of the sieve for documents whose sets are wanted.
_SIEVE = 1 << 23
#: A cell whose shingle the sketch counts up to so often is streamed through one task; others are split.
HOT = 20_000
#: A document goes to so large a share of its shingles more than it must; each link then shows in as many more cells.
SPARE = 0.1
#: Low bits of a shingle's hash that its cell does without: cells that fall together cost comparisons, never links.
DROPPED = 24
#: Shingles in one block of a region.
BLOCK = 1 << 18


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BITS)).astype(np.int64)


def _fingerprint(s: np.ndarray) -> int:
    """64 bits that name a shingle set."""
    return int(mix(s + np.uint64(len(s))).sum(dtype=np.uint64).astype(np.int64))


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.cumsum([0] + [len(p) for p in parts])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(parts), pa.int64()))


def _small(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The same rows in batches that keep what is made from them small."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def shingle_counts(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Document frequencies of all shingles of all texts, summed into 2 ** BITS counters."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        total, pending, size = np.zeros(1 << BITS, np.uint32), [], 0
        for batch in _small(batches):
            for s in shingle_sets(texts_of(batch.column(0))):
                pending.append(s)
                size += len(s)
                if size > 1 << 19:
                    np.add(total, np.bincount(_bucket(np.concatenate(pending)), minlength=1 << BITS), out=total, casting="unsafe")
                    pending, size = [], 0
        if pending:
            np.add(total, np.bincount(_bucket(np.concatenate(pending)), minlength=1 << BITS), out=total, casting="unsafe")
        if total.any():
            parts = [zlib.compress(p.tobytes(), 1) for p in np.split(total, _SLICES)]
            yield pa.RecordBatch.from_pydict({"slice": pa.array(range(_SLICES), pa.int32()), "part": pa.array(parts, pa.binary())})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = np.frombuffer(zlib.decompress(part), np.uint32).astype(np.int64)
                sums[k] = sums[k] + found if k in sums else found
        if sums:
            parts = [zlib.compress(np.minimum(v, 2**32 - 1).astype(np.uint32).tobytes(), 1) for v in sums.values()]
            yield pa.RecordBatch.from_pydict({"slice": pa.array(list(sums), pa.int32()), "part": pa.array(parts, pa.binary())})

    kind = "slice int, part binary"
    merged = docs.select(text).mapInArrow(count, kind).repartition(_SLICES, "slice").mapInArrow(merge, kind)
    out = np.zeros((_SLICES, (1 << BITS) // _SLICES), np.uint32)
    for row in merged.collect():  # _SLICES rows of fixed size
        out[row["slice"]] += np.frombuffer(zlib.decompress(row["part"]), np.uint32)
    return out.ravel()


def _signatures(docs: DataFrame, doc_id: str, text: str, counts: np.ndarray, share: float) -> DataFrame:
    """Per document its set size, fingerprint, and cells (the frequent ones apart)."""
    held = docs.sparkSession.sparkContext.broadcast(counts)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        sketch = held.value
        for batch in _small(batches):
            ids = batch.column(0)
            n, fp, cold, hot = [], [], [], []
            for known, s in zip(ids.is_valid().to_pylist(), shingle_sets(texts_of(batch.column(1))), strict=True):
                n.append(len(s))
                fp.append(_fingerprint(s))
                if not known or not len(s):
                    cold.append(np.empty(0, np.int64))
                    hot.append(np.empty(0, np.int64))
                    continue
                often = sketch[_bucket(s)]
                first = len(s) - int(np.ceil(share * len(s) - 1e-9)) + 1 + int(SPARE * len(s))
                pick = np.lexsort((s, often))[:first]
                common = often[pick] > HOT
                cells = (s[pick] >> np.uint64(DROPPED)).astype(np.int64)
                cold.append(np.sort(cells[~common]))
                hot.append(np.sort(cells[common]))
            yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array(n, pa.int64()), pa.array(fp, pa.int64()), _lists(cold), _lists(hot)], ["doc_id", "n", "fp", "cold", "hot"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(sign, "doc_id long, n long, fp long, cold array<long>, hot array<long>")


def _shared_cells(rows: DataFrame) -> DataFrame:
    """(cell, fp) -> (cell, pivot, fp) for cells that two different sets fall into; the pivot is the least."""
    w = W.partitionBy("cell")
    placed = rows.withColumns({"pivot": F.min("fp").over(w), "top": F.max("fp").over(w)})
    return placed.where("pivot < top").select("cell", "pivot", "fp").distinct()


def _shared_hot_cells(rows: DataFrame) -> DataFrame:
    """The same for cells of any size: minima combine before the shuffle, and the join may be split."""
    ends = rows.groupBy("cell").agg(F.min("fp").alias("pivot"), F.max("fp").alias("top")).where("pivot < top")
    return rows.join(ends, "cell").select("cell", "pivot", "fp").distinct()


def _with_enough(cells: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """Cells without the sets that meet other sets too seldom to be linked.

    Of two linked sets, let a be the one whose cells end first in the order. Its shingles placed there are
    either cells of the other too or none of its elements, so the two share 1 + SPARE * |a| cells at least,
    and |a| is at least percent / 100 of the other's size.
    """
    seen = cells.groupBy("fp").agg(F.count("*").alias("met")).join(sizes, "fp")
    good = seen.where(f"met >= 1 + floor({SPARE} * floor({percent} * n / 100))").select("fp")
    return cut(_shared_hot_cells(cells.join(good, "fp").select("cell", "fp")), "cells")


def _sets(docs: DataFrame, doc_id: str, text: str, signed: DataFrame, wanted: DataFrame) -> DataFrame:
    """(fp, n, items): the shingle sets of the wanted fingerprints, made anew from one text of each.

    A bitmap of fixed size sieves the documents before their texts are shuffled.
    """
    at = signed.where("n > 0 and doc_id is not null").join(wanted, "fp").groupBy("fp").agg(F.min("doc_id").alias("doc_id"))
    at = cut(at.withColumn("bit", F.expr(f"pmod(xxhash64(doc_id), {_SIEVE})")), "wanted")
    maps = at.groupBy(F.expr("bitmap_bucket_number(bit + 1)").alias("k")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(bit + 1))").alias("bits"))
    bits = bytearray(_SIEVE // 8)
    for row in maps.collect():  # _SIEVE bits at most, whatever the input
        begin = (row["k"] - 1) * len(row["bits"])
        bits[begin : begin + len(row["bits"])] = row["bits"]
    held = docs.sparkSession.sparkContext.broadcast(bytes(bits))

    def sieve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        flags = np.unpackbits(np.frombuffer(held.value, np.uint8), bitorder="little").astype(bool)
        for batch in batches:
            keep = flags[batch.column(2).to_numpy(zero_copy_only=False)]
            if keep.any():
                yield batch.filter(pa.array(keep))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in _small(batches):
            fp, parts = batch.column(0).to_pylist(), list(shingle_sets(texts_of(batch.column(1))))
            good = [k for k, s in enumerate(parts) if _fingerprint(s) == fp[k]]
            if good:
                found = [parts[k].astype(np.int64) for k in good]
                yield pa.RecordBatch.from_arrays([pa.array([fp[k] for k in good]), pa.array([len(p) for p in found]), _lists(found)], ["fp", "n", "items"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null")
    rows = rows.withColumn("bit", F.expr(f"pmod(xxhash64(doc_id), {_SIEVE})")).mapInArrow(sieve, "doc_id long, text string, bit long")
    made = rows.join(at.select("doc_id", "fp"), "doc_id").select("fp", "text").mapInArrow(build, "fp long, n long, items array<long>")
    return _bucketed(made, "fp")


def _bucketed(df: DataFrame, key: str) -> DataFrame:
    """`df` as a table in the shared folder, dealt by `key` once and for all joins to come."""
    spark = df.sparkSession
    path = scratch_path(spark, "sets")
    name = path.rsplit("/", 1)[1].replace("-", "_")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(parts, key).write.bucketBy(parts, key).sortBy(key).option("path", path).saveAsTable(name)
    return spark.table(name)


def _find(parent: list[int], k: int) -> int:
    while parent[k] != k:
        parent[k] = parent[parent[k]]
        k = parent[k]
    return k


def _block_links(block: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links between the build and the probe rows of one block, as a spanning forest.

    Shared elements are counted through the sorted elements of the probe side; a pair counts only if the
    distances of both to the region's pivot differ by eps at most.
    """
    eps = 1 - percent / 100 + 1e-9
    build, probe = block[block["build"]], block[~block["build"]]
    if build.empty or probe.empty:
        return pd.DataFrame({"a": [], "b": []}, dtype="int64")
    owner = np.repeat(np.arange(len(probe)), probe["n"].to_numpy())
    items = np.concatenate(probe["items"].to_list())
    order = np.argsort(items, kind="stable")
    items, owner = items[order], owner[order]
    ids, size, far = probe["fp"].to_numpy(), probe["n"].to_numpy(), probe["d"].to_numpy()
    names = {f: k for k, f in enumerate(dict.fromkeys([*build["fp"], *ids]))}
    parent, out = list(range(len(names))), []
    for fp, n, d, own in zip(build["fp"], build["n"], build["d"], build["items"], strict=True):
        lo, hi = np.searchsorted(items, own, "left"), np.searchsorted(items, own, "right")
        long = hi - lo
        at = np.repeat(lo - np.cumsum(long) + long, long) + np.arange(long.sum())
        both = np.bincount(owner[at], minlength=len(ids))
        linked = (100 * both >= percent * (n + size - both)) & (np.abs(far - d) <= eps) & (ids != fp)
        for other in ids[linked].tolist():
            x, y = _find(parent, names[fp]), _find(parent, names[other])
            if x != y:
                parent[x] = y
                out.append((fp, other))
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def _region_links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links within regions. members: region, fp, n, d (distance to the pivot), build (must meet all others).

    A region is dealt into blocks of about BLOCK shingles a side; each block of rows to build from meets
    each block of the region, so no task holds more than two blocks however large the region is.
    """
    blocks = members.groupBy("region").agg(
        F.ceil(F.sum(F.when(F.col("build"), F.col("n")).otherwise(0)) / BLOCK).cast("int").alias("kb"),
        F.ceil(F.sum("n") / BLOCK).cast("int").alias("kp"),
    )
    dealt = members.join(blocks, "region")
    builds = dealt.where("build").select("region", "fp", "d", "build", F.expr("cast(pmod(xxhash64(fp), kb) as int)").alias("i"), F.explode(F.expr("sequence(0, kp - 1)")).alias("j"))
    probes = dealt.select("region", "fp", "d", F.lit(False).alias("build"), F.explode(F.expr("sequence(0, kb - 1)")).alias("i"), F.expr("cast(pmod(xxhash64(fp), kp) as int)").alias("j"))
    rows = builds.unionByName(probes).join(sets, "fp")
    return rows.groupBy("region", "i", "j").applyInPandas(lambda block: _block_links(block, percent), "a long, b long")


def _empty(df: DataFrame) -> bool:
    return not df.take(1)


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 75, rounds: int = 2) -> DataFrame:
    """Columns doc_id, n_shingles, component_id, one row per row of `docs`.

    Two documents link when 100 * |a & b| >= percent * |a | b|; component_id is the smallest doc_id
    reachable by links. A null, empty or blank text has an empty set, 0 shingles and links with nothing. A
    row without doc_id links with nothing and has no component_id. Rows that repeat a doc_id count as
    documents of their own that share a name. Other columns are never read.
    """
    eps = 1 - percent / 100
    signed = cut(_signatures(docs, doc_id, text, shingle_counts(docs, text), percent / 100), "signed")
    cold = _shared_cells(signed.select("fp", F.explode("cold").alias("cell")))
    hot = _shared_hot_cells(signed.select("fp", F.explode("hot").alias("cell")))
    cells = cut(cold.unionByName(hot), "cells")
    sizes = signed.where("n > 0 and doc_id is not null").groupBy("fp").agg(F.max("n").alias("n"))
    cells = _with_enough(cells, sizes, percent)
    edges = []
    if not _empty(cells):
        sets = _sets(docs, doc_id, text, signed, cells.select("fp").distinct())
        for _ in range(rounds):
            pairs = cells.where("fp <> pivot").select("pivot", "fp").distinct()
            near = pairs.join(sets, "fp").join(sets.select(F.col("fp").alias("pivot"), F.col("n").alias("m"), F.col("items").alias("centre")), "pivot")
            both = F.size(F.array_intersect("items", "centre"))
            near = cut(near.select("pivot", "fp", "n", both.alias("both"), (F.col("n") + F.col("m") - both).alias("all")), "distances")
            near = near.select("pivot", "fp", "n", F.expr(f"100 * both >= {percent} * all").alias("linked"), (1 - F.col("both") / F.col("all")).alias("d"))
            edges.append(near.where("linked").select(F.col("pivot").alias("a"), F.col("fp").alias("b")))
            ring = near.where(f"not linked and d <= {3 * eps + 1e-9}").groupBy("pivot").agg(F.min("d").alias("least"), F.count("*").alias("rows"))
            members = near.where(f"d <= {3 * eps + 1e-9}").join(ring, "pivot").where(f"d >= least - {eps + 1e-9}")
            members = members.select(F.col("pivot").alias("region"), "fp", "n", "d", (~F.col("linked")).alias("build"))
            edges.append(cut(_region_links(members, sets, percent), "links"))
            far = near.where(f"d > {2 * eps - 1e-9}").select("pivot", "fp")
            cells = cut(_shared_hot_cells(cells.join(far, ["pivot", "fp"]).select("cell", "fp")), "cells")
            if _empty(cells):
                break
        else:  # what no pivot has settled: all of a region meets, block by block
            rest = cells.select(F.col("pivot").alias("region"), "fp").distinct().join(sets.select("fp", "n"), "fp")
            rest = rest.withColumns({"d": F.lit(0.0), "build": F.lit(True)})
            edges.append(cut(_region_links(rest, sets, percent), "links"))
    named = signed.where("n > 0 and doc_id is not null")
    if edges:
        found = edges[0]
        for more in edges[1:]:
            found = found.unionByName(more)
        roots = components(found)
        sets_root = named.join(roots, named["fp"] == roots["node"], "left").select("doc_id", "fp", F.coalesce("root", "fp").alias("root"))
    else:
        sets_root = named.select("doc_id", "fp", F.col("fp").alias("root"))
    least = sets_root.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    of = sets_root.select("fp", "root").distinct().join(least, "root").select("fp", "component_id")
    alone = F.when(F.col("doc_id").isNull(), None).when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return signed.select("doc_id", "n", "fp").join(of, "fp", "left").select("doc_id", F.col("n").alias("n_shingles"), alone.alias("component_id"))
