"""Merkle manifest of a dataset by butterfly exchange.

Leaves are grouped into trees and cut into aligned blocks of FANOUT ** LEVELS leaves. One pass hashes the
subtree of every block and keeps each leaf's siblings inside it. Then blocks swap roots: in round r a
block takes the digests of the FANOUT - 1 aligned neighbour groups of FANOUT ** r blocks, each from another
member of that group, hashes their common ancestor itself and notes the digests it received. All members
of a group hash the same ancestor, so after log(blocks) rounds every block holds the root and its own upper
proof; nothing has to be sent down again. A round is a join of the small block table with itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.llm.order import positions
from vigil.settings import cut

FANOUT = 3
#: Levels of the subtree that one task hashes as a whole: 3 ** 7 = 2,187 leaves.
LEVELS = 7
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(columns: list[Column]) -> Column:
    """SHA-256, as bytes, of the columns one after the other: `-` for null, else UTF-8 byte count, `:` and value."""
    texts = [c.cast("string") for c in columns]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def parent(children: list[bytes]) -> bytes:
    """The digest of a node: its children's digests as hexadecimal text, hashed."""
    return hashlib.sha256(b"".join(children).hex().encode()).digest()


def subtree(leaves: list[bytes], levels: int | None, fanout: int = FANOUT) -> tuple[bytes, list[bytes]]:
    """Root of `leaves` after `levels` levels (None: until one node is left), and for each leaf its siblings from below."""
    paths, nodes, span = [bytearray() for _ in leaves], leaves, 1
    while len(nodes) > 1 if levels is None else levels > 0:
        above = []
        for begin in range(0, len(nodes), fanout):
            run = nodes[begin : begin + fanout]
            for k in range(len(run)):
                others = b"".join(run[:k] + run[k + 1 :])
                for leaf in range((begin + k) * span, min(len(leaves), (begin + k + 1) * span)):
                    paths[leaf] += others
            above.append(parent(run))
        nodes, span = above, span * fanout
        levels = None if levels is None else levels - 1
    return nodes[0], [bytes(p) for p in paths]


def fold(leaf: bytes, path: bytes, pos: int, n: int, fanout: int = FANOUT) -> tuple[bytes, bytes]:
    """The root that `leaf` at place `pos` of `n` leaves has with the siblings at the head of `path`; and the rest of `path`."""
    used = 0
    while n > 1:
        at = pos % fanout
        size = min(fanout, n - (pos - at)) - 1
        others = [path[used + 32 * k : used + 32 * (k + 1)] for k in range(size)]
        leaf = parent(others[:at] + [leaf] + others[at:])
        used += 32 * size
        pos, n = pos // fanout, -(-n // fanout)
    return leaf, path[used:]


def _hash_blocks(batches: Iterator[pa.RecordBatch], tree: str, levels: int, fanout: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block and place; each with its siblings in the block (`path`) and the block's root (`top`)."""

    def hashed(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(rows).combine_chunks()
        whole = table.column("n")[0].as_py() <= fanout**levels
        top, paths = subtree(table.column("digest").to_pylist(), None if whole else levels, fanout)
        table = table.append_column("path", pa.array(paths, pa.binary())).append_column("top", pa.array([top] * len(paths), pa.binary()))
        return table.to_batches()[0]

    held, of = [], None
    for batch in batches:
        keys = list(zip(batch.column(tree).to_pylist(), batch.column("block").to_pylist(), strict=True))
        begin = 0
        for k, key in enumerate(keys):
            if key != of:
                if k > begin:
                    held.append(batch.slice(begin, k - begin))
                if held:
                    yield hashed(held)
                held, of, begin = [], key, k
        if len(keys) > begin:
            held.append(batch.slice(begin))
    if held:
        yield hashed(held)


def _swap(blocks: DataFrame, tree: str, span: int, fanout: int) -> DataFrame:
    """One round: blocks of trees with more than `span` blocks learn the digests of their neighbour groups of `span` blocks."""
    group, low = F.expr(f"block div {span}"), F.col("block") % span
    at = group % fanout
    out = blocks.withColumn("_at", at.cast("int"))
    offered = blocks.select(F.col(tree).alias("_tree"), F.col("block").alias("_block"), F.col("digest").alias("_digest"))
    digests = [F.when(F.lit(True), F.struct(F.col("_at").alias("at"), F.col("digest")))]
    for step in range(1, fanout):
        first = (group - at + (at + step) % fanout) * span
        there = first + low % F.least(F.lit(span), F.col("blocks") - first)
        other = offered.select(F.col("_tree").alias(f"_tree{step}"), F.col("_block").alias(f"_block{step}"), F.col("_digest").alias(f"_digest{step}"))
        asks = out.withColumn("_ask", F.when((first < F.col("blocks")) & (F.col("blocks") > span), there).cast("long"))
        out = asks.join(other, F.col(tree).eqNullSafe(F.col(f"_tree{step}")) & (F.col("_ask") == F.col(f"_block{step}")), "left").drop("_ask")
        seen = F.struct(((F.col("_at") + step) % fanout).cast("int").alias("at"), F.col(f"_digest{step}").alias("digest"))
        digests.append(F.when(F.col(f"_digest{step}").isNotNull(), seen))
    run = F.array_sort(F.filter(F.array(*digests), lambda x: x.isNotNull()))
    joined = out.withColumn("_run", run)
    hexes = F.array_join(F.transform("_run", lambda x: F.lower(F.hex(x["digest"]))), "")
    others = F.aggregate("_run", F.lit(b""), lambda a, x: F.when(x["at"] == F.col("_at"), a).otherwise(F.concat(a, x["digest"])))
    busy = F.col("blocks") > span
    return joined.select(
        tree, "block", "blocks",
        F.when(busy, F.unhex(F.sha2(hexes, 256))).otherwise(F.col("digest")).alias("digest"),
        F.when(busy, F.concat("path", others)).otherwise(F.col("path")).alias("path"),
    )


def build(leaves: DataFrame, tree: str, order: list[str], levels: int = LEVELS, fanout: int = FANOUT) -> DataFrame:
    """`leaves` (with a binary column `digest`) and for each its place `pos` of `n` in its tree, its siblings `path` and the `root`.

    Trees are the values of the column `tree`, null being one of them. `path` holds 32 bytes a sibling, level
    by level from below and left to right. A tree of one leaf has that leaf for root and an empty path.
    """
    size = fanout**levels
    placed = positions(leaves, [tree], order).withColumn("block", F.expr(f"pos div {size}"))
    grouped = placed.repartition(tree, "block").sortWithinPartitions(tree, "block", "pos")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in placed.schema.fields)
    local = cut(grouped.mapInArrow(lambda b: _hash_blocks(b, tree, levels, fanout), f"{kinds}, path binary, top binary"), "subtrees")
    blocks = local.where(f"pos % {size} = 0").select(tree, "block", F.expr(f"(n + {size} - 1) div {size}").alias("blocks"), F.col("top").alias("digest"), F.lit(b"").alias("path"))
    most, span = blocks.agg(F.max("blocks")).first()[0] or 0, 1
    while span < most:
        blocks = cut(_swap(blocks, tree, span, fanout), "swapped")
        span *= fanout
    above = blocks.select(F.col(tree).alias("_tree"), F.col("block").alias("_block"), F.col("digest").alias("root"), F.col("path").alias("_path"))
    joined = local.join(above, F.col(tree).eqNullSafe(F.col("_tree")) & (F.col("block") == F.col("_block")))
    return joined.select(*leaves.columns, "pos", "n", F.concat("path", "_path").alias("path"), "root")


def _folded(batches: Iterator[pa.RecordBatch], fanout: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        roots = []
        for leaf, path, pos, n, at, trees in zip(*(batch.column(c).to_pylist() for c in ("changed", "path", "pos", "n", "at", "trees")), strict=True):
            below, rest = fold(leaf, path, pos, n, fanout)
            roots.append(fold(below, rest, at, trees, fanout)[0])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(roots, pa.binary())], [*batch.schema.names, "folded"])


def manifest(docs: DataFrame, changed: dict[str, Column] | None = None, levels: int = LEVELS, fanout: int = FANOUT) -> DataFrame:
    """One row per row of `docs`: doc_id, source, pos (place in its source), leaf, subroot, root, path, folded, verified.

    A leaf is the `digest` of FIELDS. Each source is a tree of its rows by ascending doc_id, and the sources'
    roots, null first and then bytewise, are the leaves of the last tree. `path` holds all siblings of the leaf up to the
    root (32 bytes each). `folded` is the root that comes out when the row, with the columns of `changed`
    replaced by those expressions, is folded with that path; `verified` tells whether it is the root.

    Nulls in any column are hashed as `-`; a null source is a source of its own and null ids come first. Rows
    that share an id are ordered by their leaf; repeated rows are leaves of their own, which of them has which
    place makes no difference to the result. Texts of any length are hashed as a whole. Columns other than FIELDS are not
    read, whatever their names. An empty table gives no rows. Digests are bytes.
    """
    new = {**{c: F.col(c) for c in FIELDS}, **(changed or {})}
    # the row's own number tells repeated rows apart, so that ranges can split them
    leaves = docs.select("doc_id", "source", digest([F.col(c) for c in FIELDS]).alias("digest"), digest([new[c] for c in FIELDS]).alias("changed"), F.monotonically_increasing_id().alias("row"))
    lower = cut(build(cut(leaves, "leaves"), "source", ["doc_id", "digest", "row"], levels, fanout), "trees")
    roots = lower.where("pos = 0").select(F.lit(0).alias("all"), F.col("source").alias("of"), F.col("root").alias("digest"))
    upper = build(cut(roots, "roots"), "all", ["of"], levels, fanout).select("of", F.col("pos").alias("at"), F.col("n").alias("trees"), F.col("path").alias("_path"), F.col("root").alias("top"))
    both = lower.join(cut(upper, "upper"), F.col("source").eqNullSafe(F.col("of")))
    rows = both.select("doc_id", "source", "pos", "n", "at", "trees", F.col("digest").alias("leaf"), "changed", F.col("root").alias("subroot"), F.col("top").alias("root"), F.concat("path", "_path").alias("path"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    checked = rows.mapInArrow(lambda b: _folded(b, fanout), f"{kinds}, folded binary")
    return checked.select("doc_id", "source", "pos", "leaf", "subroot", "root", "path", "folded", (F.col("folded") == F.col("root")).alias("verified"))


#: CRC-32 of an id's digits, by its definition, for the rows that are tampered with.
_CRC = """xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, length({0}) + 1), lambda i: ascii(substr({0}, i, 1))::BIGINT)),
  lambda c, b: list_reduce(list_concat([xor(c, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"""
_FIELD = "coalesce(strlen({0}::VARCHAR) || ':' || {0}::VARCHAR, '-')"
_HEAD = " || ".join(_FIELD.format(c) for c in FIELDS[:-1])
ORACLE = f"""
WITH RECURSIVE leaf AS (
  SELECT doc_id, source, sha256({_HEAD} || {_FIELD.format('text')}) AS leaf,
    CASE WHEN {_CRC.format('(doc_id::VARCHAR)')} % 2 = 0 THEN sha256({_HEAD} || {_FIELD.format("replace(text, chr(10), '')")}) ELSE sha256({_HEAD} || {_FIELD.format('text')}) END AS changed,
    row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n
  FROM documents
), low AS (
  SELECT source, 0 AS lvl, pos, n, leaf AS d FROM leaf
  UNION ALL
  SELECT source, lvl + 1, pos // 3, (any_value(n) + 2) // 3, sha256(string_agg(d, '' ORDER BY pos)) FROM low WHERE n > 1 GROUP BY source, lvl, pos // 3
), roots AS (
  SELECT source, d AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM low WHERE n = 1
), up AS (
  SELECT 0 AS lvl, pos, n, subroot AS d FROM roots
  UNION ALL
  SELECT lvl + 1, pos // 3, (any_value(n) + 2) // 3, sha256(string_agg(d, '' ORDER BY pos)) FROM up WHERE n > 1 GROUP BY lvl, pos // 3
), walk AS (
  SELECT doc_id, source, 0 AS lvl, pos, n, changed AS d, '' AS path FROM leaf
  UNION ALL
  SELECT w.doc_id, w.source, w.lvl + 1, w.pos // 3, (w.n + 2) // 3,
    sha256(string_agg(CASE WHEN s.pos = w.pos THEN w.d ELSE s.d END, '' ORDER BY s.pos)), w.path || coalesce(string_agg(s.d, '' ORDER BY s.pos) FILTER (WHERE s.pos <> w.pos), '')
  FROM walk w JOIN low s ON s.source IS NOT DISTINCT FROM w.source AND s.lvl = w.lvl AND s.pos // 3 = w.pos // 3
  WHERE w.n > 1 GROUP BY w.doc_id, w.source, w.lvl, w.pos, w.n, w.d, w.path
), climb AS (
  SELECT w.doc_id, w.source, 0 AS lvl, r.pos, r.n, w.d, w.path FROM walk w JOIN roots r ON r.source IS NOT DISTINCT FROM w.source WHERE w.n = 1
  UNION ALL
  SELECT c.doc_id, c.source, c.lvl + 1, c.pos // 3, (c.n + 2) // 3,
    sha256(string_agg(CASE WHEN s.pos = c.pos THEN c.d ELSE s.d END, '' ORDER BY s.pos)), c.path || coalesce(string_agg(s.d, '' ORDER BY s.pos) FILTER (WHERE s.pos <> c.pos), '')
  FROM climb c JOIN up s ON s.lvl = c.lvl AND s.pos // 3 = c.pos // 3
  WHERE c.n > 1 GROUP BY c.doc_id, c.source, c.lvl, c.pos, c.n, c.d, c.path
)
SELECT l.doc_id, l.leaf, r.subroot, (SELECT d FROM up WHERE n = 1) AS root, sha256(c.path) AS proof_sha256, c.d AS folded_root, c.d = (SELECT d FROM up WHERE n = 1) AS verified
FROM leaf l JOIN roots r ON r.source IS NOT DISTINCT FROM l.source JOIN climb c ON c.doc_id = l.doc_id AND c.source IS NOT DISTINCT FROM l.source AND c.n = 1
"""
