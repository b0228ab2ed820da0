from __future__ import annotations

import random

import numpy as np
import pytest

from lexweave.operators import latent as L


def made(n=40, m=25, seed=2):
    rnd = random.Random(seed)
    a = np.zeros((n, m))
    for _ in range(300):
        a[rnd.randrange(n), rnd.randrange(m)] = round(rnd.uniform(0.1, 3), 3)
    a[:8, :5] += 2
    return a


def entries(spark, a):
    return spark.createDataFrame([(int(j), int(i), float(a[i, j])) for i, j in zip(*np.nonzero(a))], "term_id int, pmid int, weight double").repartition(3)


def test_factors_as_a_full_decomposition(spark):
    a = made()
    us, s, v = L.factors(entries(spark, a), 5, rounds=12)
    u0, s0, vt0 = np.linalg.svd(a, full_matrices=False)
    assert s == pytest.approx(s0[:5], rel=1e-4)
    assert np.abs(np.sum(v[:, :2] * vt0[:2].T, axis=0)) == pytest.approx([1, 1], abs=1e-3)
    got = np.zeros((len(a), 5))
    for r in us.collect():
        got[r.doc_id] = r.vec
    assert got == pytest.approx(a @ v, abs=1e-9)
    assert (v[np.abs(v).argmax(axis=0), range(5)] > 0).all()


def test_factors_of_small_and_empty_matrices(spark):
    us, s, v = L.factors(entries(spark, np.array([[1.0, 0.0], [0.0, 2.0]])), 5)
    assert s == pytest.approx([2, 1]) and v.shape == (2, 2) and us.count() == 2
    us, s, _ = L.factors(spark.createDataFrame([], "term_id int, pmid int, weight double"), 3)
    assert us.count() == 0 and not s.any()


def test_too_many_terms_are_refused(spark, monkeypatch):
    monkeypatch.setattr(L, "MOST_BYTES", 100)
    with pytest.raises(ValueError):
        L.factors(entries(spark, made()), 5)


@pytest.mark.parametrize("tile", [2, 7, 256])
def test_tiles_as_a_product(spark, tile):
    a, b = made(9, 13, 1), made(13, 6, 3)
    as_df = lambda m: spark.createDataFrame([(int(i), int(j), float(m[i, j])) for i, j in zip(*np.nonzero(m))], "i int, j int, v double")
    got = np.zeros((9, 6))
    for r in L.dense_product(as_df(a), as_df(b), tile).collect():
        got[r.i, r.j] = r.v
    assert got == pytest.approx(a @ b)


def test_blocks_and_grams(spark):
    x = np.random.default_rng(1).standard_normal((12, 4))
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)] + [(99, None)], "id long, vec array<double>").repartition(3)
    assert L.dense_gram(df, 4) == pytest.approx(x.T @ x)
    block = np.arange(8.0).reshape(4, 2)
    got = {r.id: r.vec for r in L.times_block(df, block).collect()}
    assert got[99] is None and all(got[i] == pytest.approx((x @ block)[i]) for i in range(12))
    top = L.top_documents(df.filter("vec is not null").withColumnRenamed("id", "doc_id"), 1).collect()
    assert {r.concept: r.doc_id for r in top} == dict(enumerate(np.abs(x).argmax(axis=0).tolist()))


@pytest.mark.parametrize("cosine", [True, False])
def test_similar_vectors_either_way(spark, cosine):
    rnd = random.Random(3)
    data = [(i, [float(rnd.randrange(-2, 3)) for _ in range(3)]) for i in range(400)] + [(400, [0.0, 0.0, 0.0]), (401, None)]
    df = spark.createDataFrame(data, "id long, vec array<double>").repartition(5)
    run = lambda limit: sorted(tuple(r) for r in L.similar_vectors(df, df.filter("id % 20 = 0"), 7, cosine, limit=limit).collect())
    want = {}
    for s, a in data[:401:20]:
        rows = []
        for r, b in data[:401]:
            n = (np.linalg.norm(a) * np.linalg.norm(b)) if cosine else 1.0
            if n:
                rows.append((-round(float(np.dot(a, b)) / n, 6) + 0.0, r))
        want |= {(s, r): k + 1 for k, (_, r) in enumerate(sorted(rows)[:7])}
    assert run(20_000) == run(0) and {(s, r): k for s, r, _, k in run(20_000)} == want
