"""Whitening against exact fractions and a plain eigenvalue solver; edges."""

from fractions import Fraction

import numpy as np
import pyarrow.parquet as pq
import pytest

from ethospark.llm import queries, whiten

KIND = "vec_id long, embedding array<double>, n int, component string, id int, v int"


def slow(vectors):
    """n, exact deviations, covariance by fractions, eigenvalues in falling order."""
    x = [[int(np.floor(64 * c)) + 1_000_000 for c in v] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    deviation = [sum((n * a - s) ** 2 for a, s in zip(row, sums)) for row in x]
    c = [[n * a - s for a, s in zip(row, sums)] for row in x]
    d = len(sums)
    cov = np.array([[float(Fraction(sum(r[i] * r[j] for r in c), n**3)) for j in range(d)] for i in range(d)])
    return n, deviation, np.array(c, float) / n, cov


def compare(rows, vectors, most=32):
    n, deviation, centred, cov = slow(vectors)
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1], axes[:, ::-1]
    k = min(most, len(values))
    made = np.full((n, k), np.nan)
    for r in rows:
        assert r.n == n and r.deviation == deviation[r.vec_id]
        assert r.explained == pytest.approx(values[r.component - 1] / values.sum(), rel=1e-9, abs=1e-15)
        assert r.identity_error < 1e-9
        made[r.vec_id, r.component - 1] = np.nan if r.whitened is None else r.whitened
    assert len(rows) == n * k
    for j in range(k):
        own = centred @ axes[:, j] / np.sqrt(max(values[j], 1e-300))
        if not np.isnan(made[0, j]):
            assert min(np.abs(own - made[:, j]).max(), np.abs(own + made[:, j]).max()) < 1e-6


@pytest.mark.parametrize("d", [1, 5, 40])
def test_equals_fractions(spark, d):
    r = np.random.default_rng(d)
    v = r.normal(size=(60, d)) * np.linspace(1, 4, d) + 7
    frame = spark.createDataFrame([(i, x.tolist(), 1, "a", 2, 3) for i, x in enumerate(v)], KIND).repartition(5)
    compare(whiten.whiten(frame).collect(), v.tolist())


def test_query(spark):
    t = pq.read_table("/root/testdata/sf0.001/embeddings.parquet").to_pydict()
    place = {v: i for i, v in enumerate(t["vec_id"])}
    rows = queries.op11_covariance_whitening(spark, "/root/testdata/sf0.001").collect()
    moved = [type("R", (), r.asDict() | {"vec_id": place[r.vec_id]}) for r in rows]
    compare(moved, t["embedding"])


def test_large_numbers(spark):
    """Beyond longs: sums stay exact, deviations become null, far entries count as the limit."""
    v = [[2.0**50, 1.0], [-(2.0**50), 2.0], [2.0**51, 5.0], [1e308, -1e308]]
    frame = spark.createDataFrame([(i, x, 1, "a", 2, 3) for i, x in enumerate(v)], KIND)
    rows = whiten.whiten(frame).collect()
    assert len(rows) == 8 and {r.deviation for r in rows} == {None} and all(r.n == 4 for r in rows)
    x = [[-(2**62) if c < -1e300 else 2**62 if c > 1e300 else int(64 * c) for c in row] for row in v]
    assert whiten.exact_sums(np.array(x, np.int64)) == [sum(c) for c in zip(*x)]
    c = whiten.centred(np.array(x, np.int64), 4, [sum(c) for c in zip(*x)])
    assert c.tolist() == [[4 * a - sum(b[j] for b in x) for j, a in enumerate(row)] for row in x]
    assert whiten.squared(np.array([[3037000499, 0], [3037000500, 0]])) == [3037000499**2, None]


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (2, None), (3, []), (4, [1.0, nan]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [1.0]), (None, [3.0, 1.0]), (8, [0.0, -inf]), (1, [1.0, 2.0])]
    frame = spark.createDataFrame([(*r, 1, "a", 2, 3) for r in rows], KIND)
    made = whiten.whiten(frame).collect()
    assert sorted(((r.vec_id or 0), r.component) for r in made) == [(0, 1), (0, 2), (1, 1), (1, 1), (1, 2), (1, 2)]
    assert all(r.n == 3 and (r.whitened is None) == (r.component == 2) and r.identity_error < 1e-12 for r in made)
    assert whiten.whiten(frame.filter("false")).collect() == []
    assert whiten.whiten(frame.filter("vec_id in (2, 3, 4)")).collect() == []
    same = whiten.whiten(frame.filter("vec_id = 1")).collect()
    assert len(same) == 4 and all(r.whitened is None and r.identity_error is None and r.explained == 0 and r.deviation == 0 for r in same)
    floats = frame.selectExpr("vec_id", "cast(embedding as array<float>) as embedding")
    assert whiten.whiten(floats).count() == 6


def test_moments_in_parts():
    y = np.random.default_rng(1).normal(size=(50, 3)) + 1000
    parts = [next(whiten.moments([y[a:b]])).to_pydict() for a, b in ((0, 1), (1, 20), (20, 50))]
    total = None
    for p in parts:
        own = (p["n"][0], p["a"][0], p["b"][0])
        total = own if total is None else whiten.add_moments(total, own)
    assert total[0] == 50 and np.allclose(np.frombuffer(total[1]), y.mean(0))
    assert np.allclose(np.frombuffer(total[2]).reshape(3, 3) / 50, np.cov(y.T, bias=True))
