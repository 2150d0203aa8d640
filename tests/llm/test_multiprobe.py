"""Approximate neighbours against brute force: recall, exact scores, ties, odd rows."""

import numpy as np

from vigil.llm.multiprobe import HASHES, _chance, distances, nearest_neighbours, probes
from vigil.llm.queries import read

KINDS = "vec_id long, embedding array<float>, score string, bucket int, rank int"


def brute(rows, step, k):
    """{query: [(distance, id)] of all other ids with vectors of its length} by plain loops over queries."""
    rows = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    out = {}
    for q, x in rows:
        if q % step == 0:
            near = out.setdefault(q, {})
            for i, y in rows:
                if i != q and len(x) == len(y):
                    near[i] = min(near.get(i, np.inf), float(distances(y[None, :], x)[0]))
    return {q: sorted((d, i) for i, d in near.items())[:k] for q, near in out.items()}


def search(spark, rows, **kw):
    found = {}
    for r in nearest_neighbours(spark.createDataFrame([(*r, "s", 1, 2) for r in rows], KINDS), **kw).collect():
        found.setdefault(r.query_id, {})[r.rank] = (r.score, r.vec_id)
    return {q: [x[k] for k in sorted(x)] for q, x in found.items()}


def test_recall_and_scores_on_the_given_vectors(spark):
    rows = [(r.vec_id, r.embedding) for r in read(spark, "/root/testdata/sf0.1", "embeddings").collect()]
    found, exact = search(spark, rows), brute(rows, 100, 10)
    assert found.keys() == exact.keys() and all(len(f) == 10 and f == sorted(f) for f in found.values())
    points = dict(rows)
    assert all(d == distances(np.array([points[i]], float), np.array(points[q], float))[0] for q, f in found.items() for d, i in f)
    assert np.mean([len(set(found[q]) & set(exact[q])) / 10 for q in exact]) >= 0.9


def test_ties_copies_and_odd_rows(spark):
    rng = np.random.default_rng(2)
    plain = [(k, rng.normal(size=6).astype(np.float32).tolist()) for k in range(1, 200)]
    copies = [(1000 + k, [1.0, 2.0, 0.0, 0.0, 0.5, 0.25]) for k in range(300)]
    near = [(2000 + k, [1.0, 2.0, 0.0, 0.0, 0.5, 0.25 + 1e-6 * k]) for k in range(50)]
    odd = [(None, [1.0] * 6), (5000, None), (5001, []), (5002, [0.0] * 6), (5003, [float("nan")] * 6), (5004, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (5005, [float("inf")] * 6), (100, [3.0] * 6), (7, plain[3][1]), (6000, [1.0, 2.0]), (6001, [2.0, 1.0]), (6100, [1.0])]
    rows = plain + copies + near + odd
    found, exact = search(spark, rows), brute(rows, 100, 10)
    assert {q for q in exact if exact[q]} == found.keys()
    assert [i for _, i in found[1100]] == list(range(1000, 1010)) and {d for d, _ in found[1100]} == {0.0}
    assert found[6000] == exact[6000] and all(len(found[q]) == len(exact[q]) for q in found)
    assert np.mean([len(set(found[q]) & set(exact[q])) / len(exact[q]) for q in found]) >= 0.9


def test_few_rows_and_none(spark):
    assert search(spark, []) == {}
    rows = [(k, [float(k + 1), 1.0]) for k in range(0, 600, 100)]
    assert search(spark, rows) == brute(rows, 100, 10)


def test_probes_come_by_chance_and_reach_the_wanted_share():
    rng = np.random.default_rng(4)
    for scale in (0.05, 0.2, 0.45):
        place = rng.uniform(-3, 3, HASHES)
        found, last = probes(place, scale, 0.7)
        chance = np.prod([_chance(place[j], found[:, j], scale) for j in range(HASHES)], axis=0)
        assert (np.diff(chance) <= 1e-12).all() and abs(np.log(chance[-1]) - last) < 1e-9 and chance[0] == chance.max()
        assert 0.7 <= chance.sum() and chance[:-1].sum() < 0.7
        hits = np.floor(place + scale * rng.normal(size=(4000, HASHES)))
        assert abs(np.mean([tuple(h) in {tuple(f) for f in found} for h in hits[:400]]) - chance.sum()) < 0.1
