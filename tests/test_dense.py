"""Dense joins and searches against brute force, with bounds that skip chunks."""

import numpy as np
import pytest

from factgraph.operators import dense as N


def clustered(seed, n=240, dims=8, spread=0.05):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dims))
    m = centres[rng.integers(0, 12, n)] + spread * rng.normal(size=(n, dims))
    m[::17] *= 5.0
    m[1], m[2], m[3] = m[0], 2 * m[0], 0
    return m


def brute(m, blocks, threshold):
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    u = np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)
    s = u @ u.T
    return {(a, b): s[a, b] for a in range(len(m)) for b in range(a + 1, len(m)) if blocks[a] == blocks[b] and s[a, b] >= threshold}


@pytest.mark.parametrize("threshold, size", [(0.9, 8), (0.999, 16), (0.2, 1024)])
def test_pairs_are_those_of_brute_force(spark, threshold, size):
    m = clustered(5)
    blocks = [(None, "x", "y")[k % 3] for k in range(len(m))]
    rows = [(k, x.tolist(), b, "clash") for k, (x, b) in enumerate(zip(m, blocks))] + [(None, m[0].tolist(), "x", ""), (900, None, "x", ""), (901, [1.0, None] * 4, "x", ""), (902, [float("nan")] * 8, "x", "")]
    df = spark.createDataFrame(rows, "id long, v array<double>, kind string, chunk string")
    got = {(r.a, r.b): r.similarity for r in N.dense_pairs(df, threshold, "kind", size=size).collect()}
    want = brute(m, blocks, threshold)
    assert got.keys() == want.keys() and len(want) > 50 and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_bounds_skip_pairs_of_chunks(spark):
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(clustered(6, 600))], "id long, v array<double>")
    packed = N.chunks(df, size=16)
    n, pairs = packed.count(), N.chunk_pairs(packed, 0.95).count()
    assert n >= 12 and pairs < n * (n + 1) / 4
    assert sum(len(r.ids) for r in packed.collect()) == 600


def test_copies_of_one_vector_are_cut_into_chunks(spark):
    df = spark.createDataFrame([(k, [1.0, 2.0]) for k in range(300)], "id long, v array<double>")
    assert max(len(r.ids) for r in N.chunks(df, size=8).collect()) <= 16
    assert N.dense_pairs(df, 0.9, size=8).count() == 300 * 299 // 2
    assert N.dense_pairs(df.filter("false"), 0.5).count() == 0


def test_top_k_is_that_of_brute_force(spark):
    m = clustered(8)
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    u = np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(m)], "id long, v array<double>")
    asked = df.filter("id % 9 = 0").withColumnRenamed("id", "request_id")
    for rows in (4096, 5):
        got = N.dense_top(asked, df, 4, 0.5, rows).collect()
        for q in range(0, len(m), 9):
            s = u @ u[q]
            want = sorted((i for i in range(len(m)) if s[i] >= 0.5), key=lambda i: (-round(s[i], 12), i))[:4]
            assert [round(float(s[r.id]), 9) for r in sorted(got, key=lambda r: r["rank"]) if r.request_id == q] == [round(float(s[i]), 9) for i in want]
    assert N.dense_top(asked.filter("false"), df, 4).count() == 0
