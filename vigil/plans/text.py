"""Registered queries: corpus, retrieval, answering and refusal tuning.

A document's lines are its sections. Benchmark passages are questions whose answer is in the
documents that contain them; user turns of conversations are questions nothing answers.
"""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from vigil import constants as K
from vigil.functions import text as X
from vigil.operators import incidents as I
from vigil.operators import nearest as N
from vigil.operators import retrieval as R
from vigil.plans import features as PF
from vigil.plans.common import STORED, Fixture, fixture, r6, rounded, sql
from vigil.settings import cut
from vigil.sources import corpus as C

STOP = "(" + ", ".join(f"'{w}'" for w in K.STOP_WORDS) + ")"
MIN_SCORE, MIN_OVERLAP, MIN_COVERAGE = 0.25, 2, 0.6
SEP = "chr(31)"


def _sentences_sql(x: str) -> str:
    marked = f"regexp_replace(regexp_replace({x}, '([.!?])\\s+', '\\1' || {SEP}, 'g'), '\\n(\\s*(?:-|\\d+\\.)\\s)', {SEP} || '\\1', 'g')"
    return f"list_filter(list_transform(string_split({marked}, {SEP}), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: s <> '')"


def _words_sql(x: str) -> str:
    raw = f"list_filter(regexp_extract_all(lower({x}), '[a-z0-9][a-z0-9_-]+'), lambda w: w NOT IN {STOP})"
    return f"list_distinct(list_transform({raw}, lambda w: CASE WHEN length(w) > 4 THEN rtrim(w, 's') ELSE w END))"


def _tokens_sql(x: str) -> str:
    return f"list_filter(regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}_][\\p{{L}}\\p{{N}}_-]*[\\p{{L}}\\p{{N}}_]'), lambda w: w NOT IN {STOP})"


def _terms_sql(source: str, keys: str, text: str) -> str:
    return f"""SELECT {keys}, term, count(*) AS tf FROM (SELECT {keys}, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term
        FROM (SELECT {keys}, {_tokens_sql(text)} AS w FROM {source})) GROUP BY {keys}, term"""


def _norm_sql(counts: str, keys: str) -> str:
    return f"""SELECT {keys}, term, w / sqrt(sum(w * w) OVER (PARTITION BY {keys})) AS w FROM (SELECT {keys}, term, (1 + ln(tf)) * idf AS w FROM {counts} JOIN idf USING (term))"""


BLOCKS = {
    "lines": ([], "SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS i, unnest(string_split(text, chr(10))) AS line FROM documents"),
    "secs": (["lines"], "SELECT doc_id, i, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS content FROM lines"),
    "tails": (["secs"], f"SELECT *, coalesce(lag(left(coalesce({_sentences_sql('content')}[-1], ''), 240)) OVER (PARTITION BY doc_id ORDER BY i), '') AS prev FROM secs"),
    "chunks": (
        ["tails"],
        """SELECT doc_id || '#part-' || i AS chunk_id, doc_id::VARCHAR AS doc_id, i - 1 AS section_no, 'Document ' || doc_id AS title, 'Part ' || i AS section, content,
            CASE WHEN prev <> '' THEN '(Context: ' || prev || ')' || chr(10) || content ELSE content END AS text FROM tails""",
    ),
    "questions": (
        [],
        """SELECT 'b' || item_id AS id, text AS question, EXISTS (SELECT 1 FROM documents d WHERE contains(d.text, b.text)) AS answerable FROM benchmark b
            UNION ALL SELECT 'c' || conv_id || '-' || turn, text, false FROM conversations WHERE role = 'user'""",
    ),
    "expected": ([], "SELECT 'b' || item_id AS id, d.doc_id::VARCHAR AS doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)"),
    "counts": (["chunks"], _terms_sql("chunks", "chunk_id", "title || '. ' || section || '. ' || text")),
    "idf": (["counts", "chunks"], "SELECT term, ln((1 + (SELECT count(*) FROM chunks))::DOUBLE / (1 + count(*))) + 1 AS idf FROM counts GROUP BY term"),
    "vectors": (["counts", "idf"], _norm_sql("counts", "chunk_id")),
    "qcounts": (["questions"], _terms_sql("questions", "id", "question")),
    "qvec": (["qcounts", "idf"], _norm_sql("qcounts", "id")),
    "sims": (["qvec", "vectors"], "SELECT q.id, v.chunk_id, round(sum(q.w * v.w), 9) AS score FROM qvec q JOIN vectors v USING (term) GROUP BY 1, 2"),
    "hits": (["sims"], "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, chunk_id) AS rank FROM sims) WHERE rank <= 5"),
    "top4": (["hits", "chunks"], "SELECT h.id, h.score, h.rank, c.* FROM hits h JOIN chunks c USING (chunk_id) WHERE rank <= 4"),
    "facts": (
        ["questions", "top4"],
        f"""SELECT q.id, q.question, q.answerable, words, coalesce(t.top_score, 0.0) AS top_score,
            CASE WHEN len(words) = 0 THEN 0.0 ELSE len(list_intersect(words, coalesce(t.seen, []))) / len(words)::DOUBLE END AS coverage
            FROM (SELECT *, {_words_sql('question')} AS words FROM questions) q LEFT JOIN
            (SELECT id, max(score) AS top_score, flatten(list({_words_sql("title || ' ' || section || ' ' || text")})) AS seen FROM top4 GROUP BY id) t USING (id)""",
    ),
    "sents": (
        ["top4", "facts"],
        f"""SELECT id, rank, position, doc_id, chunk_id, score, sentence, len(list_intersect(words, list_distinct(list_concat({_words_sql('sentence')}, heading)))) AS overlap
            FROM (SELECT t.*, f.words, {_words_sql('t.section')} AS heading, unnest(list_transform(s, lambda x: regexp_replace(x, '^\\s*(?:-|\\d+\\.)\\s*', ''))) AS sentence, generate_subscripts(s, 1) - 1 AS position
              FROM (SELECT *, {_sentences_sql('content')} AS s FROM top4) t JOIN facts f USING (id))""",
    ),
    "scounts": (["sents"], _terms_sql("(SELECT * FROM sents WHERE overlap >= 1)", "id, rank, position", "sentence")),
    "svec": (["scounts", "idf"], _norm_sql("scounts", "id, rank, position")),
    "cands": (
        ["sents", "svec", "qvec"],
        """SELECT s.*, round(coalesce(m.sim, 0.0) + 0.05::DOUBLE * overlap + 0.25::DOUBLE * score, 9) AS value FROM sents s LEFT JOIN
            (SELECT v.id, v.rank, v.position, sum(v.w * q.w) AS sim FROM svec v JOIN qvec q ON q.id = v.id AND q.term = v.term GROUP BY 1, 2, 3) m USING (id, rank, position) WHERE overlap >= 1""",
    ),
    "picked": (
        ["cands"],
        f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY value DESC, rank, position) AS r FROM
            (SELECT *, max(value) OVER (PARTITION BY id) AS best FROM cands WHERE overlap >= {MIN_OVERLAP}) WHERE value >= 0.75::DOUBLE * best) WHERE r <= 3""",
    ),
    "answers": (
        ["facts", "picked"],
        f"""SELECT f.*, p.answer, p.docs, CASE WHEN top_score < {MIN_SCORE} THEN 'retrieval score below threshold'
              WHEN coverage < {MIN_COVERAGE} THEN 'only ' || printf('%.0f', coverage * 100) || '%' || ' of the question''s key terms appear in the retrieved text'
              WHEN p.id IS NULL THEN 'no retrieved sentence supports an answer' ELSE '' END AS note
            FROM facts f LEFT JOIN (SELECT id, string_agg(CASE WHEN sentence LIKE '%.' OR sentence LIKE '%`' THEN sentence ELSE sentence || '.' END, ' ' ORDER BY rank, position) AS answer,
              list_distinct(list(doc_id)) AS docs FROM picked GROUP BY id) p USING (id)""",
    ),
    "supported": (
        ["cands"],
        """SELECT DISTINCT id, o FROM cands, (VALUES (1), (2)) v(o) WHERE overlap >= o""",
    ),
    "grid": (
        ["facts", "supported"],
        """SELECT min_score, min_overlap, min_coverage, avg(refused::INT) FILTER (NOT answerable) AS correct, avg(refused::INT) FILTER (answerable) AS wrong
            FROM (SELECT t.ms AS min_score, v.o AS min_overlap, c AS min_coverage, d.answerable, d.top_score < t.ms OR d.coverage < c OR s.id IS NULL AS refused
              FROM (SELECT f.*, (row_number() OVER (ORDER BY id) - 1) % 2 = 0 AS dev FROM facts f) d CROSS JOIN (VALUES (1), (2)) v(o) CROSS JOIN (VALUES (0.4::DOUBLE), (0.5::DOUBLE), (0.6::DOUBLE), (0.7::DOUBLE)) w(c)
              CROSS JOIN (SELECT 0.0::DOUBLE AS ms UNION SELECT round((top_score - 1e-4) * 10000, 0) / 10000.0::DOUBLE FROM (SELECT *, (row_number() OVER (ORDER BY id) - 1) % 2 = 0 AS dev FROM facts) WHERE dev) t
              LEFT JOIN supported s ON s.id = d.id AND s.o = v.o WHERE d.dev) GROUP BY 1, 2, 3""",
    ),
}


# thresholds chosen on one half of the questions, and the answers they give
BLOCKS["chosen"] = (
    ["grid"],
    "SELECT min_score, min_overlap, min_coverage FROM grid ORDER BY round(correct + (1 - wrong), 9) DESC, min_score, min_coverage, min_overlap LIMIT 1",
)
BLOCKS["chosen_picked"] = (["cands", "chosen"], BLOCKS["picked"][1].replace(f"overlap >= {MIN_OVERLAP}", "overlap >= (SELECT min_overlap FROM chosen)"))
BLOCKS["chosen_answers"] = (
    ["facts", "chosen_picked", "chosen"],
    BLOCKS["answers"][1].replace("FROM picked", "FROM chosen_picked").replace(f"< {MIN_SCORE}", "< (SELECT min_score FROM chosen)").replace(f"< {MIN_COVERAGE}", "< (SELECT min_coverage FROM chosen)"),
)
# the same search and answers for questions about incidents: only the search sees the context
_CHAIN = ["qcounts", "qvec", "sims", "hits", "top4", "facts", "sents", "scounts", "svec", "cands", "picked", "answers"]


def _asked_blocks() -> dict:
    def named(text: str) -> str:
        return re.sub(r"\b(" + "|".join([*_CHAIN, "questions"]) + r")\b", lambda m: "asked" if m[1] == "questions" else f"asked_{m[1]}", text)

    found = {f"asked_{n}": ([named(x) for x in BLOCKS[n][0]], named(BLOCKS[n][1])) for n in _CHAIN}
    found["asked"] = (
        ["ruled", "questions"],
        f"""SELECT q.id || '@' || r.probe_id AS id, q.question, q.answerable, r.context FROM
            (SELECT probe_id, {PF.CONTEXT_SQL} AS context, row_number() OVER (ORDER BY probe_id) - 1 AS i FROM ruled WHERE probe_id LIKE 'A%') r
            JOIN (SELECT *, row_number() OVER (ORDER BY id) - 1 AS j, count(*) OVER () AS n FROM questions) q ON q.j = r.i % q.n""",
    )
    found["search_counts"] = (["asked"], _terms_sql("asked", "id", "concat_ws(' ', question, context)"))
    found["search_vec"] = (["search_counts", "idf"], _norm_sql("search_counts", "id"))
    found["asked_sims"] = (["search_vec", "vectors"], BLOCKS["sims"][1].replace("qvec", "search_vec"))
    return {n: (needs, PF.quoted(text)) for n, (needs, text) in PF._blocks().items()} | BLOCKS | found


def _sql(body: str, *needs: str) -> str:
    return sql(body, *needs, blocks=BLOCKS)


def _docs(fx: Fixture):
    """A table of one row group, which one task would read, is dealt by id, so that it feeds them all; others are read as they lie."""
    docs = fx.table("documents")
    return docs if docs.rdd.getNumPartitions() >= fx.spark.sparkContext.defaultParallelism else docs.repartition("doc_id")


def _documents(fx: Fixture):
    """Documents in corpus form: every line becomes a section."""
    parts = F.transform(F.split("text", "\n", -1), lambda s, i: F.concat(F.lit("## Part "), (i + 1).cast("string"), F.lit("\n"), s))
    return _docs(fx).select(
        F.col("doc_id").cast("string").alias("doc_id"), F.concat(F.lit("Document "), "doc_id").alias("title"), F.array_join(parts, "\n").alias("body")
    )


def _chunks(fx: Fixture):
    return C.chunk_documents(_documents(fx))


def contained(docs, passages):
    """(id, doc_id) for every text that contains a passage; docs(doc_id, text), passages(id, passage).

    The first and last word of a passage may be parts of words in the text, those between are whole: up
    to five of them locate it. Without any (one or two words) its first three characters do. Empty and
    null passages are in no text. A text gives only runs of the lengths that some passage needs.
    """
    def words(c):
        return F.filter(F.split(c, r"\s+"), lambda x: x != "")

    def runs(length):
        starts = F.sequence(F.lit(1), F.size("w") - length + 1)
        return F.when(F.size("w") >= length, F.transform(starts, lambda i: F.array_join(F.slice("w", i, length), " ")))

    def grams(length):
        starts = F.sequence(F.lit(1), F.char_length("text") - length + 1)
        return F.when(F.char_length("text") >= length, F.transform(starts, lambda i: F.substring("text", i, F.lit(length))))

    def marked(k):
        pieces = F.coalesce(F.array_distinct(runs(k) if k > 0 else grams(-k)), F.array().cast("array<string>"))
        return F.transform(pieces, lambda a: F.struct(F.lit(k).alias("kind"), a.alias("anchor")))

    inner = F.least(F.size("w") - 2, F.lit(5))
    kind = F.when(inner > 0, inner).otherwise(-F.least(F.char_length("passage"), F.lit(3)))
    anchor = F.when(inner > 0, F.array_join(F.slice("w", F.lit(2), F.greatest(inner, F.lit(0))), " ")).otherwise(F.substring("passage", 1, 3))
    wanted = passages.filter("passage <> ''").withColumn("w", words(F.col("passage"))).select("id", "passage", kind.alias("kind"), anchor.alias("anchor"))
    kinds = sorted(r["kind"] for r in wanted.select("kind").distinct().collect())  # 1..5 words, -1..-3 characters
    texts = docs.select("doc_id", "text", words(F.col("text")).alias("w"))
    spots = F.concat(*[marked(k) for k in kinds or [5]])
    near = texts.select("doc_id", F.explode(spots).alias("s")).select("doc_id", "s.kind", "s.anchor").join(wanted, ["kind", "anchor"])
    found = near.select("id", "passage", "doc_id").distinct().join(docs.select("doc_id", "text"), "doc_id")
    return found.filter(F.contains("text", "passage")).select("id", "doc_id")


def _passages(fx: Fixture):
    """(id, doc_id) of documents that contain a benchmark passage."""
    bench = fx.table("benchmark").select(F.concat(F.lit("b"), "item_id").alias("id"), F.col("text").alias("passage"))
    return contained(_docs(fx).select(F.col("doc_id").cast("string").alias("doc_id"), "text"), bench)


class Text:
    """Stored index, questions and hits of one test folder."""

    def __init__(self, spark, d, k: int = 5):
        self.fx = fixture(spark, d)
        self.chunks = cut(_chunks(self.fx), "chunks")
        self.index = R.build_index(self.chunks.withColumnRenamed("chunk_id", "id"), C.embed_text())
        self.expected = cut(_passages(self.fx), "expected")
        bench = self.fx.table("benchmark").select(F.concat(F.lit("b"), "item_id").alias("id"), F.col("text").alias("question"))
        known = self.expected.select("id").distinct().withColumn("answerable", F.lit(True))
        turns = self.fx.table("conversations").filter("role = 'user'").select(F.concat(F.lit("c"), "conv_id", F.lit("-"), "turn").alias("id"), F.col("text").alias("question"))
        self.questions = bench.unionByName(turns).join(known, "id", "left").withColumn("answerable", F.coalesce("answerable", F.lit(False)))
        self.qvec = cut(R.query_vectors(self.index, self.questions), "qvec")
        self.hits = cut(R.topk(self.index, self.qvec, k), "hits")

    def facts(self):
        return R.question_facts(self.chunks, self.questions, self.hits.filter("rank <= 4"))

    def candidates(self):
        return cut(R.candidate_sentences(self.index, self.chunks, self.questions, self.hits.filter("rank <= 4"), self.qvec), "candidates")

    def answers(self):
        return R.answer(self.facts(), R.select_sentences(self.candidates(), MIN_OVERLAP), MIN_SCORE, MIN_COVERAGE)


def text(spark, d) -> Text:
    """The index of a folder is built once per application and serves every query after that."""
    key = (spark.sparkContext.applicationId, d, "text")
    if key not in STORED:
        STORED[key] = Text(spark, d)
    return STORED[key]


def load_documents(spark, d):
    """Documents written out with front matter and parsed back."""
    docs = _docs(fixture(spark, d))
    front = F.concat(
        F.lit("---\ntitle: Document "), "doc_id", F.lit("\ndoc_type: "), "lang", F.lit("\ncategory: "), "source",
        F.lit("\nservices: [svc-"), F.col("doc_id") % 5, F.lit(", all]\nlast_reviewed: 2026-01-01\n---\n"), "text",
    )
    parsed = C.parse_front_matter(docs.select(F.col("doc_id").cast("string").alias("doc_id"), front.alias("raw")))
    return parsed.select("doc_id", "title", "doc_type", "category", F.array_join("services", ",").alias("services"), "last_reviewed", F.md5("body").alias("body"))


def chunk_documents(spark, d):
    return _chunks(fixture(spark, d)).select("chunk_id", "doc_id", "section_no", "section", "text")


def chunk_overlap(spark, d):
    prefix = F.regexp_extract("text", r"(?s)^\(Context: (.*?)\)\n", 1)
    return _chunks(fixture(spark, d)).filter(F.col("text").startswith("(Context: ")).select("chunk_id", F.length(prefix).alias("chars"), F.md5(prefix).alias("context"))


def slugify(spark, d):
    return _docs(fixture(spark, d)).select("doc_id", X.slugify(F.col("text")).alias("slug"))


def sentence_split(spark, d):
    docs = _docs(fixture(spark, d))
    return docs.select("doc_id", F.posexplode(X.split_sentences(F.col("text"))).alias("position", "sentence"))


def content_words(spark, d):
    docs = _docs(fixture(spark, d))
    return docs.select("doc_id", F.array_join(F.array_sort(X.content_words(F.col("text"))), " ").alias("words"))


def tfidf(spark, d):
    t = cut(_chunks(fixture(spark, d)), "chunks")  # their number is read from the footers
    index = R.build_index(t.withColumnRenamed("chunk_id", "id"), C.embed_text())
    return rounded(R.tfidf(index).withColumnRenamed("id", "chunk_id"))


def topk_retrieval(spark, d):
    return rounded(text(spark, d).hits.select(F.col("query_id").alias("id"), F.col("item_id").alias("chunk_id"), "score", "rank"))


def topk_embeddings(spark, d):
    e = fixture(spark, d).table("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return rounded(N.nearest(e, e, 5, "dot", exclude_self=True))


def retrieval_metrics(spark, d):
    t = text(spark, d)
    docs = t.hits.join(t.chunks.select(F.col("chunk_id").alias("item_id"), "doc_id"), "item_id")
    return rounded(R.retrieval_metrics(docs, t.questions, t.expected), 7)


def coverage_gate(spark, d):
    f = text(spark, d).facts()
    low = F.when(F.col("top_score") < MIN_SCORE, "score").when(F.col("coverage") < MIN_COVERAGE, "coverage").otherwise("pass")
    return rounded(f.select("id", "top_score", "coverage", low.alias("gate")))


def extractive_answers(spark, d):
    return text(spark, d).answers().select("id", "refused", "answer", F.array_join(F.array_sort("cited_docs"), ",").alias("cited_docs"), "note")


def answer_metrics(spark, d):
    t = text(spark, d)
    return rounded(R.answer_metrics(t.answers(), t.questions, t.expected))


def verify_citations(spark, d):
    """Answers of one question checked against the chunks retrieved for another: the top chunk of a
    question is cited by an answer that only saw its chunks 2 to 5."""
    t = text(spark, d)
    per = t.hits.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "item_id"))).alias("h"))
    ids = F.transform("h", lambda x: x["item_id"])
    sentence = F.array(F.struct(F.lit("claim").alias("text"), F.filter(F.slice(ids, 1, 2), lambda x: F.col("query_id") != "").alias("citations")))
    return per.select(F.col("query_id").alias("id"), X.verify_citations(sentence, F.slice(ids, 2, 4)).alias("problem"))


def _tuning(spark, d):
    t = text(spark, d)
    dev = R.alternate_halves(t.questions).filter("half = 'dev'")
    return R.tune_refusal(cut(t.facts(), "facts").join(dev.select("id"), "id", "left_semi"), t.candidates(), dev)


def tune_refusal(spark, d):
    return rounded(_tuning(spark, d))


def choose_refusal(spark, d):
    return rounded(R.choose_refusal(_tuning(spark, d)))


def refusal_report(spark, d):
    """Thresholds tuned on one half of the questions, reported on the other and on all."""
    t = text(spark, d)
    halves = cut(R.alternate_halves(t.questions).select("id", "answerable", "half"), "halves")
    dev, facts, candidates = halves.filter("half = 'dev'"), cut(t.facts(), "facts"), t.candidates()
    tuning = R.tune_refusal(facts.join(dev.select("id"), "id", "left_semi"), candidates, dev)
    return rounded(R.held_out_refusal(facts, candidates, halves, t.expected, cut(R.choose_refusal(tuning), "chosen")))


def _asked(t: Text):
    """Every alert with one of the questions, dealt in turn, and the sentences that describe it."""
    ruled = I.rules_classify(PF._features(t.fx)).filter("probe_id LIKE 'A%'")
    told = cut(ruled.select("probe_id", I.incident_text(F.col("culprit"), F.col("rules_prediction"), I.evidence()).alias("context")), "told")
    questions = cut(t.questions.select("id", "question"), "questions")
    size = questions.agg(F.count(F.lit(1))).scalar()
    placed = R.number_by(told, "probe_id").withColumn("position", F.pmod("position", size))
    pairs = placed.join(R.number_by(questions, "id"), "position")
    return cut(pairs.select(F.concat("id", F.lit("@"), "probe_id").alias("id"), "question", "context"), "asked")


def incident_answers(spark, d):
    """Questions about alerts: the alert's description steers what is retrieved."""
    t = text(spark, d)
    found = R.answer_incidents(t.index, t.chunks, _asked(t), 4, MIN_SCORE, MIN_OVERLAP, MIN_COVERAGE)
    return found.select("id", "refused", "answer", F.array_join("retrieved", ",").alias("retrieved"), F.array_join(F.array_sort("cited_docs"), ",").alias("cited_docs"), "note")


_REPORT = """round(avg((note <> '')::INT) FILTER (NOT answerable), 6) AS correct_refusal_rate, round(avg((note <> '')::INT) FILTER (answerable), 6) AS false_refusal_rate,
    round(avg((len(list_intersect(docs, e)) = len(docs))::INT) FILTER (answerable AND note = ''), 6) AS citation_accuracy,
    round(avg((len(list_intersect(docs, e)) > 0)::INT) FILTER (answerable AND note = ''), 6) AS cites_expected_doc, count(*) FILTER (answerable AND note = '') AS answered"""
_METRICS = f"{r6('correct AS correct_refusal_rate', 'wrong AS false_refusal_rate', 'correct + (1 - wrong) AS balanced')}"
QUERIES = {
    "load_documents": (
        load_documents,
        """SELECT doc_id::VARCHAR AS doc_id, 'Document ' || doc_id AS title, lang AS doc_type, source AS category, 'svc-' || doc_id % 5 || ',all' AS services,
        '2026-01-01' AS last_reviewed, md5(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS body FROM documents""",
    ),
    "chunk_documents": (chunk_documents, _sql("SELECT chunk_id, doc_id, section_no, section, text FROM chunks", "chunks")),
    "chunk_overlap": (chunk_overlap, _sql("SELECT doc_id || '#part-' || i AS chunk_id, length(prev) AS chars, md5(prev) AS context FROM tails WHERE prev <> ''", "tails")),
    "slugify": (slugify, "SELECT doc_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM documents"),
    "sentence_split": (
        sentence_split,
        f"SELECT doc_id, generate_subscripts(s, 1) - 1 AS position, unnest(s) AS sentence FROM (SELECT doc_id, {_sentences_sql('text')} AS s FROM documents)",
    ),
    "content_words": (content_words, f"SELECT doc_id, array_to_string(list_sort({_words_sql('text')}), ' ') AS words FROM documents"),
    "tfidf": (tfidf, _sql("SELECT chunk_id, term, round(w, 6) AS w FROM vectors", "vectors")),
    "topk_retrieval": (topk_retrieval, _sql("SELECT id, chunk_id, round(score, 6) AS score, rank FROM hits", "hits")),
    "topk_embeddings": (
        topk_embeddings,
        """SELECT query_id, item_id, round(s, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, item_id) AS rank FROM (
        SELECT q.vec_id AS query_id, i.vec_id AS item_id, round(list_dot_product(q.embedding::DOUBLE[], i.embedding::DOUBLE[]), 9) AS s FROM embeddings q JOIN embeddings i ON q.vec_id <> i.vec_id)) WHERE rank <= 5""",
    ),
    "retrieval_metrics": (
        retrieval_metrics,
        _sql(
            """SELECT """ + ", ".join(f"round(avg((coalesce(h, 99) <= {k})::INT) FILTER (answerable), 7) AS hit_at_{k}" for k in (1, 3, 5)) + """,
            round(median(round(top, 6)) FILTER (answerable), 7) AS top_score_answerable_median, round(median(round(top, 6)) FILTER (NOT answerable), 7) AS top_score_unanswerable_median
            FROM (SELECT q.answerable, coalesce(max(h.score), 0.0) AS top, min(h.rank) FILTER (e.id IS NOT NULL) AS h FROM questions q LEFT JOIN hits h ON h.id = q.id LEFT JOIN chunks c ON c.chunk_id = h.chunk_id
              LEFT JOIN expected e ON e.id = q.id AND e.doc_id = c.doc_id GROUP BY q.id, q.answerable)""",
            "questions", "hits", "chunks", "expected",
        ),
    ),
    "coverage_gate": (
        coverage_gate,
        _sql(f"SELECT id, {r6('top_score', 'coverage')}, CASE WHEN top_score < {MIN_SCORE} THEN 'score' WHEN coverage < {MIN_COVERAGE} THEN 'coverage' ELSE 'pass' END AS gate FROM facts", "facts"),
    ),
    "extractive_answers": (
        extractive_answers,
        _sql(
            f"""SELECT id, note <> '' AS refused, CASE WHEN note <> '' THEN '{K.REFUSAL.replace("'", "''")}' ELSE answer END AS answer,
            CASE WHEN note = '' THEN array_to_string(list_sort(docs), ',') END AS cited_docs, note FROM answers""",
            "answers",
        ),
    ),
    "answer_metrics": (
        answer_metrics,
        _sql(
            """SELECT round(avg((note <> '')::INT) FILTER (NOT answerable), 6) AS correct_refusal_rate, round(avg((note <> '')::INT) FILTER (answerable), 6) AS false_refusal_rate,
            round(avg((len(list_intersect(docs, e)) = len(docs))::INT) FILTER (answerable AND note = ''), 6) AS citation_accuracy,
            round(avg((len(list_intersect(docs, e)) > 0)::INT) FILTER (answerable AND note = ''), 6) AS cites_expected_doc, count(*) FILTER (answerable AND note = '') AS answered
            FROM answers LEFT JOIN (SELECT id, list(doc_id) AS e FROM expected GROUP BY id) USING (id)""",
            "answers", "expected",
        ),
    ),
    "verify_citations": (
        verify_citations,
        _sql("SELECT id, 'citation not in retrieved set: ' || chunk_id AS problem FROM hits WHERE rank = 1", "hits"),
    ),
    "tune_refusal": (
        tune_refusal,
        _sql(f"SELECT min_score, min_overlap, min_coverage, {_METRICS} FROM grid", "grid"),
    ),
    "choose_refusal": (
        choose_refusal,
        _sql(f"SELECT min_score, min_overlap, min_coverage, {_METRICS} FROM grid ORDER BY round(correct + (1 - wrong), 9) DESC, min_score, min_coverage, min_overlap LIMIT 1", "grid"),
    ),
    "refusal_report": (
        refusal_report,
        _sql(
            f"""WITH rows AS (SELECT a.*, e.e, (row_number() OVER (ORDER BY a.id) - 1) % 2 = 0 AS dev FROM chosen_answers a LEFT JOIN (SELECT id, list(doc_id) AS e FROM expected GROUP BY id) e USING (id))
            SELECT scope, {_REPORT}, (SELECT min_score FROM chosen) AS min_score, (SELECT min_overlap FROM chosen) AS min_overlap, (SELECT min_coverage FROM chosen) AS min_coverage
            FROM (SELECT *, 'all' AS scope FROM rows UNION ALL SELECT *, 'test' FROM rows WHERE NOT dev) GROUP BY scope""".replace("WITH rows AS (", "SELECT * FROM (WITH rows AS (", 1) + ")",
            "chosen_answers", "expected",
        ),
    ),
    "incident_answers": (
        incident_answers,
        sql(
            f"""SELECT id, note <> '' AS refused, CASE WHEN note <> '' THEN '{K.REFUSAL.replace("'", "''")}' ELSE answer END AS answer,
            coalesce((SELECT string_agg(chunk_id, ',' ORDER BY rank) FROM asked_hits h WHERE h.id = a.id AND rank <= 4), '') AS retrieved,
            CASE WHEN note = '' THEN array_to_string(list_sort(docs), ',') END AS cited_docs, note FROM asked_answers a""",
            "asked_answers", "asked_hits", blocks=_asked_blocks(),
        ),
    ),
}
