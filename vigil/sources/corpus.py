"""Documents with front matter, section chunks and evaluation questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.functions import text as X

QUESTION_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("question", T.StringType()),
        T.StructField("expected_docs", T.ArrayType(T.StringType())),
        T.StructField("answerable", T.BooleanType()),
    ]
)


def read_markdown(spark: SparkSession, root: str) -> DataFrame:
    """One row per .md file below `root`: doc_id (file stem) and raw text."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").text(root, wholetext=True)
    stem = F.regexp_extract(F.input_file_name(), r"([^/]+)\.md$", 1)
    return files.select(stem.alias("doc_id"), F.col("value").alias("raw"))


def parse_front_matter(raw: DataFrame) -> DataFrame:
    """Metadata between the first two `---` marks, and the body after them."""
    parts = F.split("raw", "---", 3)

    def key(name: str):
        return X.strip(F.regexp_extract(parts[1], rf"(?m)^{name}:[ \t]*(.*)$", 1))

    listed = F.regexp_replace(key("services"), r"^\[|\]$", "")
    services = F.filter(F.transform(F.split(listed, ","), X.strip), lambda s: s != "")
    return raw.select(
        "doc_id", key("title").alias("title"), key("doc_type").alias("doc_type"), key("category").alias("category"),
        services.alias("services"), key("last_reviewed").alias("last_reviewed"), X.strip(parts[2]).alias("body"),
    )


def chunk_documents(docs: DataFrame, overlap: bool = True) -> DataFrame:
    """One chunk per `## ` section, prefixed with the last sentence of the section before it.

    Sections, tails and overlaps are array expressions inside the document row: no shuffle.
    """
    blocks = F.split("body", r"(?m)^## ", -1)
    sections = F.transform(
        F.slice(blocks, 2, F.greatest(F.size(blocks) - 1, F.lit(0))),
        lambda b: F.struct(
            X.strip(F.substring_index(b, "\n", 1)).alias("section"),
            X.strip(F.regexp_replace(b, r"^[^\n]*\n?", "")).alias("content"),
        ),
    )
    keep = [c for c in docs.columns if c != "body"]
    exploded = docs.select(*keep, sections.alias("s")).select(
        *keep,
        F.posexplode(
            F.zip_with("s", F.concat(F.array(F.lit(None).cast("struct<section:string,content:string>")), F.col("s")),
                       lambda now, before: F.struct(now.alias("now"), before["content"].alias("before")))
        ).alias("section_no", "b"),
    ).filter(F.col("b.now").isNotNull())
    tail = F.substring(F.coalesce(F.get(F.reverse(X.split_sentences(F.coalesce("b.before", F.lit("")))), F.lit(0)), F.lit("")), 1, X.TAIL_CHARS)
    content = F.col("b.now.content")
    text = F.when(F.lit(overlap) & (F.col("tail") != ""), F.concat(F.lit("(Context: "), F.col("tail"), F.lit(")\n"), content)).otherwise(content)
    return exploded.withColumn("tail", tail).select(
        F.concat_ws("#", F.col("doc_id").cast("string"), X.slugify(F.col("b.now.section"))).alias("chunk_id"),
        *keep, "section_no", F.col("b.now.section").alias("section"), text.alias("text"),
    )


def embed_text():
    return F.concat(F.col("title"), F.lit(". "), F.col("section"), F.lit(". "), F.col("text"))


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation questions as JSON lines."""
    return spark.read.schema(QUESTION_SCHEMA).json(path)


def write_manifest(chunks: DataFrame, path: str) -> None:
    chunks.write.json(path)


def chunk_by_id(chunks: DataFrame, chunk_id: str) -> DataFrame:
    return chunks.filter(F.col("chunk_id") == chunk_id)
