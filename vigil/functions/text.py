"""Text column expressions: slugs, sentences, content words and n-grams (all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vigil import constants as K

# ---- fixed values: patterns of sentences, list bullets, words and tokens
SENTENCE_BREAK = r"(?<=[.!?])\s+|\n(?=\s*(?:-|\d+\.)\s)"
BULLET = r"^\s*(?:-|\d+\.)\s*"
CONTEXT_PREFIX = r"(?s)^\(Context: .*?\)\n"
WORD = r"[a-z0-9][a-z0-9_-]+"
TOKEN = r"[\p{L}\p{N}_][\p{L}\p{N}_-]*[\p{L}\p{N}_]"
TAIL_CHARS = 240


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def slugify(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def split_sentences(text: Column) -> Column:
    parts = F.transform(F.split(text, SENTENCE_BREAK, -1), strip)
    return F.filter(parts, lambda s: s != "")


def chunk_sentences(text: Column) -> Column:
    """Sentences of a chunk without its context prefix and bullets; emptied ones keep their position."""
    body = F.regexp_replace(text, CONTEXT_PREFIX, "")
    return F.transform(split_sentences(body), lambda s: F.regexp_replace(s, BULLET, ""))


def content_words(text: Column, stop_words: list[str] = K.STOP_WORDS) -> Column:
    """Distinct words that carry meaning; plural endings of longer words are cut."""
    words = F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))
    kept = F.filter(words, lambda w: ~w.isin(stop_words))
    return F.array_distinct(F.transform(kept, lambda w: F.when(F.length(w) > 4, F.regexp_replace(w, "s+$", "")).otherwise(w)))


def tokens(text: Column, stop_words: list[str] = K.STOP_WORDS) -> Column:
    found = F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))
    return F.filter(found, lambda w: ~w.isin(stop_words))


def ngrams(words: Column) -> Column:
    """Single tokens and neighbouring pairs."""
    n = F.size(words)
    pairs = F.zip_with(
        F.slice(words, 1, F.greatest(n - 1, F.lit(0))), F.slice(words, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b)
    )
    return F.concat(words, pairs)


def end_sentence(text: Column) -> Column:
    return F.when(text.endswith(".") | text.endswith("`"), text).otherwise(F.concat(text, F.lit(".")))


def verify_citations(sentences: Column, retrieved: Column) -> Column:
    """Error message if a sentence is uncited or cites something not retrieved, else null.

    sentences: array<struct<text, citations array<string>>>; the first problem is reported.
    """
    def problem(s: Column) -> Column:
        bad = F.array_except(s["citations"], retrieved)
        uncited = F.coalesce(F.size(s["citations"]), F.lit(0)) <= 0
        return F.when(uncited, F.concat(F.lit("uncited sentence: "), F.substring(s["text"], 1, 60))).when(
            F.size(bad) > 0, F.concat(F.lit("citation not in retrieved set: "), F.get(bad, F.lit(0)))
        )

    problems = F.filter(F.transform(sentences, problem), lambda p: p.isNotNull())
    return F.when(F.coalesce(F.size(sentences), F.lit(0)) <= 0, "no sentences").otherwise(F.get(problems, F.lit(0)))
