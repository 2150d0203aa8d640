"""Training-data pipeline: language, toxicity, repeated lines, near duplicates, packing.

Every stage is a function (spark, docs, sf_dir) -> DataFrame. All but the last return the columns of
`documents`; what a stage rejects or removes is gone for those after it. `run` writes each stage's result
as Parquet in the shared folder and reads it again, so a lost executor costs one stage's tasks at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm import toxicity
from vigil.llm.jaccard import jaccard_components
from vigil.llm.language import UNKNOWN, language_samples, predict_languages, training_split
from vigil.llm.lines import drop_repeated_lines
from vigil.llm.packing import pack_documents
from vigil.llm.queries import read
from vigil.settings import cut

#: SQL cannot express suffix automata, Viterbi decoding or the tokenizer; tests compare with brute force.
ORACLE_SQL = None


#: Texts in a batch that goes to Python; a worker and the executor each hold a few such batches.
BATCH = 500


#: Name of the column that numbers the rows inside a stage.
ROW = "_pipeline_row"


def _short_batches(spark: SparkSession) -> None:
    """Texts are long and all stages share their workers, so batches of the default 10,000 rows would fill them."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language cannot be told: null texts and texts without a letter."""
    _short_batches(spark)
    judged = predict_languages(docs, language_samples(docs.where(training_split())))
    return judged.where(F.col("lang_pred") != UNKNOWN).select(*docs.columns)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that score as toxic; learns from the labels of the documents still there."""
    _short_batches(spark)
    trigrams = toxicity.letter_trigrams(docs)
    lexicon = toxicity.learn(toxicity.training_rows(docs, read(spark, sf_dir, "labels"), training_split()), trigrams)
    return toxicity.score_texts(docs, lexicon, trigrams).where(F.col("score") < toxicity.THRESHOLD).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes later occurrences of repeated three-line passages; n_chars follows the text."""
    left = drop_repeated_lines(docs)
    return left.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of linked rows: that with the smallest doc_id, a null one coming last.

    Rows are told apart by a number of their own, so repeated rows and rows without id are documents like any
    other, and another text under a removed row's id stays. Rows without words stay. Empty tables give none.
    """
    _short_batches(spark)
    marked = cut(docs.withColumn(ROW, F.monotonically_increasing_id()), "marked")
    groups = cut(jaccard_components(marked, ROW).select(F.col("doc_id").alias(ROW), "component_id"), "groups")
    shared = groups.groupBy("component_id").count().where("count > 1").drop("count")
    members = cut(groups.join(shared, "component_id").join(marked.select(ROW, "doc_id"), ROW), "members")
    first = members.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", ROW))[ROW].alias("_kept"))
    others = members.join(first, "component_id").where(F.col(ROW) != F.col("_kept")).select(ROW)
    return marked.join(others, ROW, "left_anti").select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in training sequences; see `pack_documents`."""
    _short_batches(spark)
    from public_tokenizers import path

    pieces = pack_documents(docs, path("byte_bpe_50k.json"))
    length = (F.octet_length("ids") / 4).cast("long")
    return pieces.select("doc_id", "start", length.alias("length"), F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("language", language), ("toxicity", clean), ("lines", lines), ("near_duplicates", near_duplicates), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    return docs
