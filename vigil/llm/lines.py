"""Removal of repeated passages by overlapping windows of three lines.

Every run of three consecutive lines is hashed; a run that occurs again, anywhere, is removed where it
occurs later (documents in the order of doc_id, then text, then position), and overlapping runs remove the
union of their lines. Only DataFrame expressions are used; the hash is 64 bits wide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.settings import cut

LINES = 3


def _windows(lines: Column, size: int) -> Column:
    """Hashes of the runs of `size` lines, null where all lines are blank; no runs in shorter texts."""
    starts = F.when(F.size(lines) >= size, F.sequence(F.lit(0), F.size(lines) - size))

    def run(i: Column) -> Column:
        part = [F.get(lines, i + j) for j in range(size)]
        written = F.lit(False)
        for line in part:
            written = written | (F.trim(line) != "")
        return F.when(written, F.xxhash64(F.concat_ws("\n", *part)))

    return F.transform(starts, run)


def _outside(lines: Column, starts: Column, size: int) -> Column:
    """The lines that no run of `size` lines from one of the ascending `starts` covers: the stretches between them, each copied once."""
    begins = F.concat(F.array(F.lit(0)), F.transform(starts, lambda p: p + size))
    ends = F.concat(starts, F.array(F.size(lines)))
    gaps = F.filter(F.arrays_zip(begins.alias("a"), ends.alias("b")), lambda g: g["b"] > g["a"])
    return F.flatten(F.transform(gaps, lambda g: F.slice(lines, g["a"] + 1, g["b"] - g["a"])))


def drop_repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = LINES) -> DataFrame:
    """`docs` with repeated lines removed from `text`, and n_lines and n_removed (columns of these names are replaced).

    Lines end at newlines. Texts of fewer than `size` lines, null and empty ones stay as they are (a null
    text has 0 lines). Rows with the same doc_id and text are one document: both keep or lose the same lines.
    A null doc_id comes first in the order. Runs of blank lines never count as repeated.
    """
    base = docs.drop("n_lines", "n_removed")
    key, lines = F.coalesce(F.xxhash64(text), F.lit(0)), F.split(text, "\n", -1)
    # texts are split in a projection of their own: inside a lambda they would be split anew for every line
    listed = base.select(F.col(doc_id).alias("doc"), key.alias("key"), lines.alias("lines"))
    held = listed.select("doc", "key", F.posexplode(_windows(F.col("lines"), size)).alias("pos", "run")).where("run is not null")
    held = cut(held, "runs")
    spot = F.struct("doc", "key", "pos")
    again = held.groupBy("run").agg(F.min(spot).alias("first"), F.max(spot).alias("last")).where("first <> last").select("run", "first")
    later = held.join(again, "run").where(spot != F.col("first"))
    covered = later.groupBy("doc", "key").agg(F.sort_array(F.collect_set("pos")).alias("_starts"))
    rows = base.withColumn("_key", key)
    out = rows.join(covered.withColumnRenamed("key", "_key2"), rows[doc_id].eqNullSafe(F.col("doc")) & (F.col("_key") == F.col("_key2")), "left")
    split = out.withColumn("_lines", lines).withColumn("_left", F.when(F.col("_starts").isNotNull(), _outside(F.col("_lines"), F.col("_starts"), size)))
    n, left = F.coalesce(F.when(F.col(text).isNotNull(), F.size("_lines")), F.lit(0)), F.col("_left")
    counted = split.withColumns({"n_lines": n.cast("long"), "n_removed": F.when(left.isNotNull(), n - F.size(left)).otherwise(0).cast("long")})
    return counted.withColumn(text, F.when(left.isNotNull(), F.array_join(left, "\n")).otherwise(F.col(text))).select(*base.columns, "n_lines", "n_removed")


ORACLE = """
WITH lines AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL
), runs AS (
  SELECT doc_id, l, unnest(range(1, greatest(len(l) - 1, 1))) AS p FROM lines
), held AS (
  SELECT doc_id, p, l[p] || chr(10) || l[p + 1] || chr(10) || l[p + 2] AS run FROM runs
  WHERE trim(l[p]) <> '' OR trim(l[p + 1]) <> '' OR trim(l[p + 2]) <> ''
), placed AS (
  SELECT doc_id, p, row_number() OVER (PARTITION BY run ORDER BY doc_id, p) AS k FROM held
), gone AS (
  SELECT DISTINCT doc_id, unnest([p, p + 1, p + 2]) AS p FROM placed WHERE k > 1
), listed AS (
  SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id
), numbered AS (
  SELECT doc_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS p FROM lines
), kept AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY p) AS text FROM numbered ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT d.doc_id, CAST(coalesce(len(string_split(d.text, chr(10))), 0) AS BIGINT) AS n_lines,
       CAST(coalesce(g.n, 0) AS BIGINT) AS n_removed,
       md5(CASE WHEN g.n IS NULL THEN d.text ELSE coalesce(k.text, '') END) AS text_md5
FROM documents d LEFT JOIN listed g ON d.doc_id = g.doc_id LEFT JOIN kept k ON d.doc_id = k.doc_id
"""
