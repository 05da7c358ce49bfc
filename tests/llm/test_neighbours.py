"""Recall against brute force, copies, hot groups and odd vectors."""

import numpy as np
import pytest

from treeline.llm import neighbours as N


def clusters(seed, n=1500, dim=32):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 15, dim))
    v = centres[rng.integers(len(centres), size=n)] + 0.25 * rng.normal(size=(n, dim))
    v[::50] = v[1::50][: len(v[::50])]
    return (v * rng.uniform(0.5, 2, size=(n, 1))).astype(np.float32)


def brute(v, k, least):
    u = v.astype(float) / np.linalg.norm(v, axis=1, keepdims=True)
    s = np.round(u @ u.T, 7)
    np.fill_diagonal(s, -2)
    out = set()
    for i in range(len(v)):
        for j in np.lexsort((np.arange(len(v)), -s[i]))[:k]:
            if s[i, j] >= least:
                out.add((min(i, int(j)), max(i, int(j))))
    return out


@pytest.mark.parametrize("cap", [4096, 60, 4])
def test_recall(spark, cap, monkeypatch):
    """Also where buckets of every level are split, and with the full ones joined by a shuffle."""
    monkeypatch.setattr(N, "MOST_BROADCAST", 10 if cap == 60 else 1_000_000)
    v = clusters(1)
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, vectors array<float>")
    got = {tuple(r) for r in N.similar_pairs(rows, "vec_id", "vectors", cap=cap).collect()}
    want = brute(v, 5, 0.85)
    assert len(got & want) >= 0.97 * len(want) and len(got - want) <= 0.01 * len(want)


def test_copies_and_odd_rows(spark):
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=16), rng.normal(size=16)
    rows = [(i, a.tolist(), 1) for i in range(40)] + [(50, (2 * b).tolist(), 1), (51, (b + 0.01).tolist(), 1), (60, None, 1), (61, [0.0] * 16, 1), (62, [], 1), (63, [float("nan")] * 16, 1), (64, [None] * 16, 1)]
    d = spark.createDataFrame(rows, "vec_id long, vectors array<float>, id int")
    got = {}
    for r in N.neighbours(d, "vec_id", "vectors").orderBy("vec_id", "rank").collect():
        got.setdefault(r.vec_id, []).append(r.neighbour)
    assert got[0] == [1, 2, 3, 4, 5] and got[3] == [0, 1, 2, 4, 5] and got[39] == [0, 1, 2, 3, 4]
    assert got[50] == [51] and got[51] == [50] and set(got) == {*range(40), 50, 51}
    assert N.similar_pairs(d.limit(0), "vec_id", "vectors").count() == 0
    assert N.similar_pairs(d.where("vec_id >= 60"), "vec_id", "vectors").count() == 0


def test_alike_vectors_in_blocks(spark):
    """What no rotation splits is compared whole, in pairs of blocks."""
    v = clusters(4, 300, 16)[:1] + 0.02 * np.random.default_rng(5).normal(size=(300, 16))
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, vectors array<float>")
    got = {tuple(r) for r in N.similar_pairs(rows, "vec_id", "vectors", cap=40).collect()}
    want = brute(v, 5, 0.85)
    assert len(got & want) >= 0.9 * len(want)
    assert N.neighbours(rows, "vec_id", "vectors", cap=40).groupBy("vec_id").count().where("count = 5").count() == 300


def test_lengths(spark):
    """Vectors of several lengths are an error, whatever batches they come in."""
    rows = spark.createDataFrame([(1, [1.0] * 64), (2, [1.0] * 32), (3, [2.0] * 64)], "vec_id long, vectors array<float>")
    with pytest.raises(ValueError, match="several lengths, from 32 to 64"):
        N.neighbours(rows.repartition(3), "vec_id", "vectors")


def test_hadamard():
    x = np.random.default_rng(3).normal(size=(5, 16)).astype(np.float32)
    assert np.allclose(N.hadamard(N.hadamard(x)), x, atol=1e-5) and np.allclose(np.linalg.norm(N.hadamard(x), axis=1), np.linalg.norm(x, axis=1), rtol=1e-5)
