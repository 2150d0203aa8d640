"""Corpus, sentences, retrieval paths and citation checks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigil.functions import text as X
from vigil.operators import lsa as L
from vigil.operators import retrieval as R
from vigil.sources import corpus as C

RAW = """---
title: Runbook - Memory leak
doc_type: runbook
category: memory_leak
services: [orders-service, auth-service]
last_reviewed: 2026-06-30
---

# Memory leak

## Symptoms

Memory climbs slowly. It never falls!

## First checks

1. Plot memory for a day.
2. Count restarts.
- Take a heap snapshot
"""


def chunks(spark, tmp_path):
    folder = tmp_path / "corpus" / "runbooks"
    folder.mkdir(parents=True)
    (folder / "rb-memory-leak.md").write_text(RAW)
    return C.chunk_documents(C.parse_front_matter(C.read_markdown(spark, str(tmp_path / "corpus"))))


def test_markdown_corpus(spark, tmp_path):
    rows = chunks(spark, tmp_path).orderBy("section_no").collect()
    assert [r.chunk_id for r in rows] == ["rb-memory-leak#symptoms", "rb-memory-leak#first-checks"]
    assert rows[0].services == ["orders-service", "auth-service"] and rows[0].title == "Runbook - Memory leak"
    assert rows[0].text == "Memory climbs slowly. It never falls!"
    assert rows[1].text.startswith("(Context: It never falls!)\n1. Plot memory")


def test_sentences_keep_the_position_of_emptied_bullets(spark, tmp_path):
    row = chunks(spark, tmp_path).filter("section_no = 1").select(X.chunk_sentences(F.col("text")).alias("s")).collect()[0]
    assert row.s == ["", "Plot memory for a day.", "", "Count restarts.", "Take a heap snapshot"]


def test_content_words(spark):
    got = spark.range(1).select(X.content_words(F.lit("What class of Services needs rolling-restarts, if any is_bad x?")).alias("w")).collect()[0].w
    assert sorted(got) == sorted(["cla", "need", "rolling-restart", "any", "is_bad"])


def test_citations(spark):
    rows = [("foreign", [("a", ["doc#x"])]), ("none", [("b", [])]), ("good", [("c", ["doc#y"])]), ("empty", [])]
    df = spark.createDataFrame(rows, "n string, s array<struct<text:string,citations:array<string>>>")
    got = {r.n: r.p for r in df.select("n", X.verify_citations(F.col("s"), F.array(F.lit("doc#y"))).alias("p")).collect()}
    assert got == {"foreign": "citation not in retrieved set: doc#x", "none": "uncited sentence: b", "good": None, "empty": "no sentences"}


def corpus(spark, n=120):
    rng = np.random.default_rng(6)
    words = [f"word{i}" for i in range(60)]
    texts = [(f"t{i:03d}", " ".join(rng.choice(words, 12))) for i in range(n)]
    return spark.createDataFrame(texts, "id string, text string"), texts, words, rng


def test_blocked_retrieval_equals_one_block(spark):
    df, texts, words, rng = corpus(spark)
    index = R.build_index(df, F.col("text"))
    questions = spark.createDataFrame([(f"q{i}", " ".join(rng.choice(words, 4))) for i in range(30)], "id string, question string")
    vectors = R.query_vectors(index, questions)
    rows = lambda h: sorted((r.query_id, r["rank"], r.item_id, r.score) for r in h.collect())
    one = rows(R.topk(index, vectors, 5))
    assert rows(R.topk(index, vectors, 5, questions=7, texts=11)) == one and len(one) == 150


def test_a_search_copies_no_text_for_blocks_of_questions(spark):
    """Blocks meet where they are read: no row is sent once per block of the other side, and the sieve loses no term."""
    df, texts, words, rng = corpus(spark, 300)
    index = R.build_index(df.unionByName(df.selectExpr("concat('u', id) AS id", "text")), F.col("text"))
    asked = [(f"q{i:02d}", " ".join(rng.choice(words, 3))) for i in range(20)]
    vectors = R.query_vectors(index, spark.createDataFrame(asked, "id string, question string"))
    hits = R.topk(index, vectors, 4, questions=3, texts=16)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Generate" not in plan and "CoGroup" not in plan
    weights = {}
    for r in R.tfidf(index).collect():
        weights.setdefault(r.id, {})[r.term] = r.w
    want = set()
    for q in {r.id for r in vectors.select("id").collect()}:
        mine = {r.term: r.w for r in vectors.filter(F.col("id") == q).collect()} if q < "q03" else None
        if mine is not None:
            scored = [(-round(sum(w * t.get(term, 0.0) for term, w in mine.items()), 9), i) for i, t in weights.items()]
            want |= {(q, i, rank + 1, -s) for rank, (s, i) in enumerate(sorted(x for x in scored if x[0] < 0)[:4])}
    got = {(r.query_id, r.item_id, r["rank"], r.score) for r in hits.filter("query_id < 'q03'").collect()}
    assert {g[:3] for g in got} == {w[:3] for w in want} and len(got) == 12


@pytest.mark.parametrize("dense", [0.0, 0.01, 2.0])
def test_shared_terms_of_every_frequency_add_up(monkeypatch, dense):
    monkeypatch.setattr(R, "DENSE", dense)
    rng = np.random.default_rng(3)

    def side(n):
        matrix = rng.random((n, 40)) * (rng.random((n, 40)) < np.linspace(0.01, 0.9, 40))
        terms = np.flatnonzero(matrix.any(axis=0))
        entries = [(t, i) for t in terms for i in np.flatnonzero(matrix[:, t])]
        starts = np.searchsorted([t for t, _ in entries], np.append(terms, 99))
        return matrix, (np.arange(n), terms * 7 - 5, starts, np.array([i for _, i in entries]), np.array([matrix[i, t] for t, i in entries]))

    (a, q), (b, x) = side(70), side(90)
    assert np.allclose(R._lexical(q, x), a @ b.T)


def test_terms_of_repeated_ids_count_once(spark):
    """Terms of every frequency, so that each way of adding them up is taken."""
    rng = np.random.default_rng(8)
    texts = [(f"t{i:02d}", " ".join(f"w{j}" for j in range(30) if rng.random() < j / 30)) for i in range(60)]
    df = spark.createDataFrame(texts * 2, "id string, text string")
    index = R.build_index(df, F.col("text"))
    asked = R.query_vectors(index, spark.createDataFrame([(f"q{i:02d}", t) for i, (_, t) in enumerate(texts)], "id string, question string"))
    once = {}
    for r in R.tfidf(index).collect():
        once.setdefault(r.id, {})[r.term] = r.w
    mine = {}
    for r in asked.collect():
        mine.setdefault(r.id, {})[r.term] = r.w
    hits = R.topk(index, asked, 60).collect()
    assert len(hits) > 3000
    for r in hits:
        assert r.score == pytest.approx(sum(w * once[r.item_id].get(t, 0.0) for t, w in mine[r.query_id].items()), abs=1e-8)


def test_unit_weights_leave_the_index_without_a_shuffle(spark):
    df, _, _, _ = corpus(spark, 40)
    index = R.build_index(df, F.col("text"))
    unit = R.tfidf(index)
    assert "Exchange" not in unit._jdf.queryExecution().executedPlan().toString()
    lengths = unit.groupBy("id").agg(F.sum(F.col("w") * F.col("w")).alias("n")).collect()
    assert len(lengths) == 40 and all(r.n == pytest.approx(1.0) for r in lengths)


def test_index_holds_the_terms_of_a_block_once_and_counts_texts_of_all_blocks(spark):
    df, texts, _, _ = corpus(spark, 90)
    rows = df.unionByName(spark.createDataFrame([("t000", "word1 word2"), (None, "word3"), (None, "word3 alone"), ("none", ""), ("null", None)], "id string, text string"))
    index = R.build_index(rows.repartition(3), F.col("text"), postings=200)
    held = index.blocks.select("terms").collect()
    assert len(held) > 6 and all(len(set(r.terms)) == len(r.terms) for r in held)
    given = [*texts, ("t000", "word1 word2"), (None, "word3"), (None, "word3 alone")]
    grams = [(i, [*t.split(), *(" ".join(p) for p in zip(t.split(), t.split()[1:]))]) for i, t in given]
    df_of = {}
    for _, g in grams:
        for term in set(g):
            df_of[term] = df_of.get(term, 0) + 1
    want, squares = [], {}
    for i, g in grams:
        for term in set(g):
            w = (1 + np.log(g.count(term))) * (np.log((1 + 95) / (1 + df_of[term])) + 1)
            squares[i] = squares.get(i, 0.0) + w * w
            want.append((i, term, w))
    got = sorted((str(r.id), r.term, round(r.w, 9)) for r in R.tfidf(index).collect())
    assert got == sorted((str(i), term, round(w / np.sqrt(squares[i]), 9)) for i, term, w in want)
    idf = {r.term: r.idf for r in index.idf.collect()}
    assert idf.keys() == df_of.keys() and all(idf[t] == pytest.approx(np.log(96 / (1 + n)) + 1) for t, n in df_of.items())


def test_only_found_texts_travel(spark):
    chunks = spark.range(3000).selectExpr("concat('c', id) AS chunk_id", "concat('text ', id) AS text")
    hits = spark.createDataFrame([("q1", "c7"), ("q2", "c7"), ("q2", "c2999"), ("q3", "gone")], "query_id string, item_id string")
    got = {tuple(r) for r in R.found_texts(chunks, hits).collect()}
    assert {("c7", "text 7"), ("c2999", "text 2999")} <= got and len(got) < 10


def test_term_counts_equal_a_counter(spark):
    texts = {"a": "red fox red fox red", "b": "", "c": "solo", "d": None, "e": "x1 x1 x1"}
    df = spark.createDataFrame(list(texts.items()), "id string, text string")
    got = {(r.id, r.term): r.tf for r in R.term_counts(df, ["id"], F.col("text")).collect()}
    want = {}
    for key, text in texts.items():
        words = (text or "").split()
        for term in words + [f"{a} {b}" for a, b in zip(words, words[1:])]:
            want[key, term] = want.get((key, term), 0) + 1
    assert got == want


def test_latent_search_keeps_negative_scores_and_rows_without_vectors(spark):
    df = spark.createDataFrame([("t1", "red fox"), ("t2", "blue bird"), ("t3", "green tree")], "id string, text string")
    index = R.build_index(df, F.col("text"))
    asked = R.query_vectors(index, spark.createDataFrame([("q1", "red fox"), ("q2", "blue")], "id string, question string"))
    vec = lambda rows: spark.createDataFrame(rows, "id string, vec array<double>")
    latent = (vec([("t1", [1.0, 0.0]), ("t2", [-1.0, 0.0])]), vec([("q1", [1.0, 0.0])]))
    got = {(r.query_id, r.item_id): r.score for r in R.topk(index, asked, 3, latent, 0.5, questions=1, texts=2).collect()}
    assert got == {("q1", "t1"): 1.0, ("q1", "t2"): -0.5, ("q1", "t3"): 0.0, ("q2", "t1"): 0.0, ("q2", "t2"): pytest.approx(0.288675135), ("q2", "t3"): 0.0}


def test_latent_space_matches_a_dense_svd(spark):
    df, texts, _, _ = corpus(spark, 60)
    vectors = R.tfidf(R.build_index(df, F.col("text")))
    rows = vectors.collect()
    terms = {t: i for i, t in enumerate(sorted({r.term for r in rows}))}
    dense = np.zeros((60, len(terms)))
    for r in rows:
        dense[int(r.id[1:]), terms[r.term]] = r.w
    space = L.latent_space(vectors, dims=4, iterations=8)
    assert np.allclose(space.values, np.linalg.svd(dense)[1][:4], rtol=1e-3)


def test_latent_space_of_an_index_shuffles_no_row_per_term(spark, monkeypatch):
    df, _, _, _ = corpus(spark, 60)
    df = df.unionByName(df.limit(1).withColumn("id", F.lit(None).cast("string")))
    monkeypatch.setattr(L, "TERMS", 100)
    index = R.build_index(df, F.col("text"), postings=150)
    rows = [r for r in R.tfidf(index).collect() if r.id is not None]
    terms = {t: i for i, t in enumerate(sorted({r.term for r in rows}))}
    ids = {t: i for i, t in enumerate(sorted({r.id for r in rows}))}
    dense = np.zeros((len(ids), len(terms)))
    for r in rows:
        dense[ids[r.id], terms[r.term]] = r.w
    words = sorted(terms)[::7]
    asked = spark.createDataFrame([(f"q{i % 3}", t, 1.0 + i) for i, t in enumerate(words)], "id string, term string, w double")
    space = L.latent_space(index, dims=4, iterations=8, asked=asked)
    assert space.postings.parts > 1 and space.postings.blocks > 1
    assert np.allclose(space.values, np.linalg.svd(dense)[1][:4], rtol=1e-3)
    texts = {r[0]: np.array(r[1:]) for r in space.texts.collect()}
    assert set(texts) == set(ids)
    u = np.stack([texts[i] for i in ids])
    assert np.allclose(u.T @ u, np.eye(4))
    got = {r.id: r.vec for r in L.question_vectors(space, asked).collect()}
    for q in ("q0", "q1", "q2"):
        want = sum((1.0 + i) * dense[:, terms[t]] @ u for i, t in enumerate(words) if f"q{i % 3}" == q) / space.values
        assert np.allclose(got[q], want / np.linalg.norm(want))
    product = L._multiply(space.postings, space.block, len(space.rotation))
    assert "Exchange" not in product._jdf.queryExecution().toString()


def test_products_wait_for_rows_that_come_early():
    import pyarrow as pa

    base = {"n": None, "xs": None, "alone": None, "starts": None, "tids": None, "at": None, "ws": None}
    rows = [{**base, "turn": 0, "block": b, "n": 2, "xs": [1.0 + b, 2.0]} for b in (0, 1)]
    held = {"alone": [0.5, 0.0], "starts": [0, 2, 3], "at": [0, 1, 1], "ws": [1.0, 2.0, 3.0]}
    rows += [{**base, **held, "turn": t, "block": b, "tids": [7, 9 + b]} for t in (1, 2) for b in (0, 1)]
    kinds = [("turn", pa.int32()), ("block", pa.int64()), ("n", pa.int64()), *((c, pa.list_(pa.float64())) for c in ("xs", "alone", "ws"))]
    schema = pa.schema([*kinds, ("starts", pa.list_(pa.int64())), ("tids", pa.list_(pa.int64())), ("at", pa.list_(pa.int32()))])

    def run(order):
        out = list(L._sums(iter([pa.RecordBatch.from_pylist([rows[i]], schema) for i in order]), 2, 2))
        return {o[0]: [x.tolist() for x in o[1:]] for o in out}

    found = run(range(6))
    assert found == run([5, 4, 3, 2, 1, 0])
    assert found[None] == [[7, 9, 10], [[3.0], [8.0], [10.0]]]
    assert found[0] == [[[3.0 + 16.0 + 0.5], [24.0]]]


def test_halves_alternate(spark):
    df = spark.createDataFrame([(f"q{i:02d}",) for i in range(31)], "id string")
    got = {r.id: r.half for r in R.alternate_halves(df).collect()}
    assert [got[f"q{i:02d}"] for i in range(31)] == ["dev" if i % 2 == 0 else "test" for i in range(31)]


def test_questions_round_trip(spark, tmp_path):
    path = str(tmp_path / "questions")
    spark.createDataFrame([("q1", "How?", ["d"], True)], C.QUESTION_SCHEMA).write.json(path)
    assert C.read_questions(spark, path).collect()[0].expected_docs == ["d"]


def test_passages_of_any_length_are_found(spark):
    from vigil.plans.text import contained

    texts = ["the quick brown fox jumps over it.", "un prequick brown foxes", "a b c d e f g h, i", "", None, "x"]
    wanted = ["quick brown fox", "fox jumps", "brown fox jumps over it", "quick", "a b c d e f g h", "x", "h,", "e  f", "", None, "re", "quick brown fox jumps over it"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = contained(docs, spark.createDataFrame(list(enumerate(wanted)), "id long, passage string")).collect()
    assert sorted(tuple(r) for r in got) == sorted((i, d) for i, p in enumerate(wanted) if p for d, t in enumerate(texts) if t and p in t)


def test_nested_numbers_without_a_value_are_null_in_json(spark):
    import json

    from vigil.sources.tables import json_value

    nan = float("nan")
    df = spark.createDataFrame([(nan, {"x": nan, "y": [1.0, nan]}, {"k": float("inf")}, None)], "a double, s struct<x: double, y: array<double>>, m map<string, double>, z struct<x: double>")
    assert json.loads(df.select(json_value(df).alias("v")).collect()[0].v) == {"a": None, "s": {"x": None, "y": [1.0, None]}, "m": {"k": None}, "z": None}


def test_context_steers_the_search_only(spark):
    """The context picks the chunk; coverage and citations go by the question; without context nothing changes."""
    texts = [("c1", "d1", "Pools", "Check", "Restart the worker when connections run out."), ("c2", "d2", "Memory", "Check", "Restart the worker when memory climbs."),
             ("c3", "d3", "Other", "Notes", "Nothing of use.")]
    chunks = spark.createDataFrame([(*t, t[4]) for t in texts], "chunk_id string, doc_id string, title string, section string, text string, content string")
    index = R.build_index(chunks.withColumnRenamed("chunk_id", "id"), C.embed_text())
    asked = [("q1", "When restart the worker?", None), ("q2", "When restart the worker?", "connections pools"), ("q3", "When restart the worker?", "memory climbs"), ("q4", "unseen words", "memory")]
    questions = spark.createDataFrame(asked, "id string, question string, context string")
    got = {r.id: r for r in R.answer_incidents(index, chunks, questions, 1, 0.0, 1, 0.5).collect()}
    assert got["q2"].retrieved == ["c1"] and got["q2"].cited_docs == ["d1"] and got["q3"].retrieved == ["c2"] and got["q3"].cited_docs == ["d2"]
    assert got["q4"].refused and got["q4"].note.startswith("only 0%") and got["q4"].retrieved == ["c2"]
    plain = R.answer_incidents(index, chunks, questions.withColumn("context", F.lit(None).cast("string")), 1, 0.0, 1, 0.5).collect()
    same = {r.id: (r.retrieved, r.answer) for r in plain}
    assert same["q1"] == same["q2"] == same["q3"] == (got["q1"].retrieved, got["q1"].answer)


def test_held_out_report_uses_the_chosen_thresholds(spark):
    facts = spark.createDataFrame(
        [(f"q{i}", "question", ["w"], score, 1.0, [f"c{i}"]) for i, score in enumerate([0.9, 0.9, 0.2, 0.2, 0.9, 0.2])],
        "id string, question string, words array<string>, top_score double, coverage double, retrieved array<string>",
    )
    candidates = spark.createDataFrame([(f"q{i}", f"c{i}", f"d{i}", 1, 0, f"Sentence {i}", 1 + (i != 4), 1.0) for i in range(6)],
                                       "query_id string, item_id string, doc_id string, rank int, position int, sentence string, overlap int, value double")
    questions = spark.createDataFrame([(f"q{i}", i not in (2, 3), "dev" if i % 2 else "test") for i in range(6)], "id string, answerable boolean, half string")
    expected = spark.createDataFrame([(f"q{i}", f"d{i}") for i in (0, 1, 5)], "id string, doc_id string")
    report = lambda *t: {r.scope: r for r in R.held_out_refusal(facts, candidates, questions, expected, spark.createDataFrame([t], "min_score double, min_overlap int, min_coverage double")).collect()}
    strict = report(0.5, 2, 0.5)
    assert (strict["test"].correct_refusal_rate, strict["test"].false_refusal_rate, strict["test"].answered, strict["test"].citation_accuracy) == (1.0, 0.5, 1, 1.0)
    assert (strict["all"].correct_refusal_rate, strict["all"].false_refusal_rate, strict["all"].answered) == (1.0, 0.5, 2)
    loose = report(0.0, 1, 0.0)
    assert (loose["test"].correct_refusal_rate, loose["test"].false_refusal_rate, loose["test"].answered, loose["test"].citation_accuracy, loose["test"].min_overlap) == (0.0, 0.0, 2, 0.5, 1)


def test_index_sends_numbers_and_no_terms(spark):
    """Terms are counted by hash: neither a term nor a block is shuffled, however many blocks hold it, and hashes agree with those of questions."""
    df, texts, _, _ = corpus(spark, 80)
    index = R.build_index(df.repartition(4), F.col("text"), postings=100, entries=50)
    plan = index.stored._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "SortMergeJoin" in plan
    assert not {"terms", "tids"} & set(index.stored.columns)
    terms = {t for _, text in texts for w in [text.split()] for t in [*w, *(" ".join(p) for p in zip(w, w[1:]))]}
    hashed = {r.term: r.h for r in index.idf.select("term", R.term_hash(F.col("term")).alias("h")).collect()}
    assert set(hashed) == terms and index.idf.count() == len(terms)
    held = {}
    for r in R.weighted_blocks(index).select("tids", "dfs").collect():
        held.update(zip(r.tids, r.dfs))
    df_of = {t: sum(1 for _, text in texts if t in text.split() or f" {t} " in f" {text} ") for t in terms}
    assert {t: held[h] for t, h in hashed.items()} == df_of
    few = R.vocabulary(index, R.sieve(spark.createDataFrame([("word1",), ("word2 word3",)], "term string"), R.term_hash(F.col("term"))))
    assert {r.term for r in few.collect()} >= {"word1"} and few.count() < 10


def test_search_lists_pairs_in_lots(monkeypatch):
    """Rare terms of a block of pairs may have any number of products; they are listed a lot at a time."""
    rng = np.random.default_rng(5)
    entries = [(np.arange(30), np.arange(300), np.arange(301) * 3, rng.random((300, 30)).argsort(axis=1)[:, :3].ravel(), rng.random(900)) for _ in range(2)]
    whole = R._lexical(*entries)
    sizes, real = [], R._ranges
    monkeypatch.setattr(R, "PAIRS", 100)
    monkeypatch.setattr(R, "DENSE", 2.0)
    monkeypatch.setattr(R, "_ranges", lambda s: sizes.append(s.sum()) or real(s))
    assert np.allclose(R._lexical(*entries), whole) and max(sizes) < 200
