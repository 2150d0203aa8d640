"""Registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm.lines import ORACLE as LINES_SQL
from vigil.llm.merkle import ORACLE as MERKLE_SQL
from vigil.llm.topk import ORACLE as TOPK_SQL


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigil.llm.jaccard import jaccard_components

    return jaccard_components(read(spark, sf_dir, "documents"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigil.llm import urls

    rules = {"org/": urls.ALLOW, "example.org/es/": urls.BLOCK, "example.org/en/1": urls.BLOCK, "com/fr/": urls.ALLOW, "com/de/": urls.BLOCK}
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judge(pages, rules, urls.fit(urls.labelled_urls(spark))).drop("url")


def op3_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigil.llm.neardup import near_duplicates

    return near_duplicates(read(spark, sf_dir, "embeddings"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    from vigil.llm.pieces import encode

    coded = encode(read(spark, sf_dir, "documents").select("doc_id", "text"), path("piece_bpe_32k.model"))
    n = (F.octet_length("ids") / 4).cast("long")
    return coded.select("doc_id", n.alias("n_pieces"), F.crc32("ids").alias("ids_crc32"), "round_trip", "parity")


def op5_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigil.llm.topk import top_inner_products

    return top_inner_products(read(spark, sf_dir, "embeddings"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    from vigil.llm.packing import pack_documents

    pieces = pack_documents(read(spark, sf_dir, "documents"), path("byte_bpe_50k.json"))
    length = (F.octet_length("ids") / 4).cast("long")
    return pieces.select("doc_id", "start", length.alias("length"), F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigil.llm import toxicity
    from vigil.llm.language import training_split

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    trigrams = toxicity.letter_trigrams(docs)
    lexicon = toxicity.learn(toxicity.training_rows(docs, read(spark, sf_dir, "labels"), training_split()), trigrams)
    scored = toxicity.score_texts(docs, lexicon, trigrams)
    return scored.select("doc_id", F.expr(f"not ({training_split()})").alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigil.llm.lines import drop_repeated_lines

    return drop_repeated_lines(read(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", F.md5("text").alias("text_md5"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigil.llm.language import language_samples, predict_languages, training_split

    docs = read(spark, sf_dir, "documents")
    samples = language_samples(docs.where(training_split()))
    held_out = F.expr(f"not ({training_split()})").alias("held_out")
    return predict_languages(docs.select("doc_id", held_out, "text"), samples).drop("text")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    from vigil.llm.transducer import count_tokens

    return count_tokens(read(spark, sf_dir, "documents"), path("word_bpe_49k.json"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    from vigil.llm.alignment import align, score_links
    from vigil.settings import cut

    aligned = align(read(spark, sf_dir, "documents"), path("byte_bpe_50k.json"), path("piece_bpe_32k.model"))
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)).alias("groups_sha256")
    stored = cut(aligned.select("row", "doc_id", "n_a", "n_b", "n_groups", digest, "pairs", "times"), "aligned")
    return score_links(stored).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigil.llm.merkle import manifest

    chosen = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    found = manifest(read(spark, sf_dir, "documents"), {"text": F.when(chosen, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))})
    shown = lambda c: F.lower(F.hex(c))
    proof = F.sha2(shown("path"), 256).alias("proof_sha256")
    return found.select("doc_id", shown("leaf").alias("leaf"), shown("subroot").alias("subroot"), shown("root").alias("root"), proof, shown("folded").alias("folded_root"), "verified")


def op13_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigil.llm.multiprobe import nearest_neighbours

    return nearest_neighbours(read(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_jaccard_join": op1_jaccard_join,
    "op2_url_filter": op2_url_filter,
    "op3_near_vectors": op3_near_vectors,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_top_products": op5_top_products,
    "op6_packing": op6_packing,
    "op7_toxicity": op7_toxicity,
    "op8_line_dedup": op8_line_dedup,
    "op9_language_id": op9_language_id,
    "op10_token_counts": op10_token_counts,
    "op11_token_alignment": op11_token_alignment,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_nearest_neighbours": op13_nearest_neighbours,
}
ORACLES: dict[str, str] = {"op5_top_products": TOPK_SQL, "op8_line_dedup": LINES_SQL, "op12_merkle_manifest": MERKLE_SQL}
