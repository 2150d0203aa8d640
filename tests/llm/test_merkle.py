"""The Merkle manifest against a plain construction of the trees, with small blocks so that blocks swap roots."""

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from vigil.llm.merkle import FIELDS, fold, manifest, parent, subtree

KINDS = "doc_id long, source string, lang string, n_chars long, text string, root int, path string, _digest int"


def leaf_of(row):
    values = (row[k] for k in FIELDS)
    return hashlib.sha256("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values).encode()).digest()


def tree(nodes):
    """Root, and for each node its siblings from below, by walking the levels one after the other."""
    paths, at = [b""] * len(nodes), list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[k : k + 3] for k in range(0, len(nodes), 3)]
        paths = [p + b"".join(d for k, d in enumerate(runs[i // 3]) if k != i % 3) for p, i in zip(paths, at, strict=True)]
        nodes, at = [parent(r) for r in runs], [i // 3 for i in at]
    return nodes[0], paths


def expected(rows):
    sources = defaultdict(list)
    for r in rows:
        sources[r["source"]].append((r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r)))
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    lower = {s: tree([x[2] for x in sorted(sources[s])]) for s in names}
    root, upper = tree([lower[s][0] for s in names])
    out = []
    for s, above in zip(names, upper, strict=True):
        out += [(x[1] if x[0] else None, x[2], lower[s][0], root, p + above) for x, p in zip(sorted(sources[s]), lower[s][1], strict=True)]
    return sorted(out, key=repr)


def dataset(seed, count):
    rng = random.Random(seed)
    sources = ["hot"] * 6 + [None, "", "a", "Z", "é"] + [f"s{k}" for k in range(20)]
    rows = [{"doc_id": k, "source": rng.choice(sources), "lang": rng.choice([None, "en"]), "n_chars": rng.choice([None, k]), "text": rng.choice([None, "", "x\ny\n", "日本\n" * 50, "plain"])} for k in range(count)]
    rows += [dict(rows[3]), dict(rows[3]), {**rows[4], "text": "another"}, {**rows[4], "doc_id": None}, {**rows[5], "doc_id": None}, {"doc_id": -7, "source": "a", "lang": "e:n", "n_chars": 1, "text": "y" * 300_000 + "\n"}]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("levels,count", [(1, 400), (2, 90), (7, 60)])
def test_manifest_equals_plain_trees(spark, levels, count):
    rows = dataset(levels, count)
    docs = spark.createDataFrame([(*(r[f] for f in FIELDS), 1, "p", 2) for r in rows], KINDS)
    assert FIELDS == ("doc_id", "source", "lang", "n_chars", "text")
    found = manifest(docs, {"text": F.replace("text", F.lit("\n"), F.lit(""))}, levels=levels).collect()
    assert sorted(((r.doc_id, *(bytes(x) for x in (r.leaf, r.subroot, r.root, r.path))) for r in found), key=repr) == expected(rows)
    tampered = {leaf_of(r): leaf_of({**r, "text": r["text"] and r["text"].replace("\n", "")}) for r in rows}
    for r in found:
        assert r.verified == (tampered[bytes(r.leaf)] == bytes(r.leaf)) == (r.folded == r.root)


def test_empty_single_and_one_source(spark):
    docs = spark.createDataFrame([], KINDS)
    assert manifest(docs).collect() == []
    one = manifest(spark.createDataFrame([(None, None, None, None, None, 1, "p", 2)], KINDS)).first()
    assert one.leaf == one.subroot == one.root == one.folded == hashlib.sha256(b"-----").digest() and one.path == b"" and one.verified
    rows = [{"doc_id": k, "source": "s", "lang": "l", "n_chars": 1, "text": str(k)} for k in range(10)]
    found = manifest(spark.createDataFrame([(*(r[f] for f in FIELDS), 1, "p", 2) for r in rows], KINDS), levels=1).collect()
    assert {bytes(r.root) for r in found} == {bytes(found[0].subroot)} == {tree([leaf_of(r) for r in rows])[0]}


def test_fold_inverts_subtree():
    for n in range(1, 40):
        leaves = [hashlib.sha256(bytes([k])).digest() for k in range(n)]
        root, paths = subtree(leaves, None)
        assert (root, paths) == tree(leaves)
        assert all(fold(d, p + b"rest", k, n) == (root, b"rest") for k, (d, p) in enumerate(zip(leaves, paths, strict=True)))
