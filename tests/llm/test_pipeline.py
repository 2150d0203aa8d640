"""The pipeline's stages on the smallest tables: each equals its operator's decision, worked out by hand."""

import corpus_pipeline
from vigil.llm.queries import read

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_decisions_take_effect(spark):
    docs = read(spark, SF, "documents")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        seen[name] = (docs, out.cache())
        docs = out
        assert name == "packing" or out.columns == columns
    before, after = seen["language"]
    gone = {r.doc_id for r in before.join(after, "doc_id", "left_anti").collect()}
    assert all(not any(c.isalpha() for c in (r.text or "")) for r in before.where(before.doc_id.isin([*gone, -1])).collect())
    before, after = seen["near_duplicates"]
    kept = [frozenset((r.text or "").lower().split()) for r in after.collect() if (r.text or "").split()]
    assert len({tuple(sorted(k)) for k in kept}) > 0.95 * len(kept)
    pieces = seen["packing"][1].collect()
    assert {p.doc_id for p in pieces} == {r.doc_id for r in seen["near_duplicates"][1].collect()}


def test_duplicates_are_decided_row_by_row(spark):
    kind = "doc_id long, text string, lang string, source string, n_chars long, component_id int"
    a, b = " ".join(f"w{k}" for k in range(40)), " ".join(f"v{k}" for k in range(40))
    given = [(1, a), (1, a), (None, a), (2, a + " x"), (2, b), (3, None), (3, None), (4, " ")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, 0) for i, t in given], kind)
    stage = dict(corpus_pipeline.STAGES)["near_duplicates"]
    out = stage(spark, docs, SF)
    assert out.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=repr) == sorted([(1, a), (2, b), (3, None), (3, None), (4, " ")], key=repr)
    assert stage(spark, docs.limit(0), SF).collect() == []
