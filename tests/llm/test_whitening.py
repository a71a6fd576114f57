import numpy as np
import pytest
from pyspark.sql import functions as F

from veriform.llm import whitening as wh

SCHEMA = "vec_id long, embedding array<float>, x string, id string, n int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", "id", 1) for i, v in rows], SCHEMA)


def brute(rows):
    """Rows that stay, their whole numbers, and the eigenvectors by the library of numpy."""
    kept = [(i, np.floor(np.array(v, np.float32).astype(float) * 64).astype(np.int64) + 1_000_000) for i, v in rows
            if v and all(c is not None and np.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in kept}))
    v = np.cov(fit.T, bias=True)
    e, q = np.linalg.eigh(v)
    return kept, fit, e[::-1], q[:, ::-1], np.trace(v)


def test_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    mix = rng.normal(size=(20, 20))
    rows = [(int(i), [float(c) for c in rng.normal(size=20) @ mix + 5]) for i in range(400)]
    rows += rows[:30] + [(None, rows[0][1]), (7, rows[1][1])]
    odd = [(900, None), (901, [None] * 20), (902, [float("nan")] + [1.0] * 19), (903, [float("inf")] + [1.0] * 19), (904, []), (905, [1.0, 2.0])]
    got = wh.whiten(frame(spark, rows + odd)).collect()
    kept, fit, e, q, trace = brute(rows)
    n, s = len(fit), fit.sum(0)
    assert len(got) == 16 * len(rows) and {r["n"] for r in got} == {n}
    assert {r["identity_error"] for r in got} < {r["identity_error"] for r in got} | {1} and got[0]["identity_error"] < 1e-9
    want = {}
    for i, x in kept:
        y = (x - s / n) @ q[:, :16] / np.sqrt(e[:16])
        want.setdefault(i, []).append((int(((n * x - s) ** 2).sum()), y))
    sign = {}
    for r in got:
        fits = [y[r["component"] - 1] for d, y in want[r["id"]] if d == r["deviation"]]
        assert fits
        best = min((abs(abs(f) - abs(r["whitened"])), f) for f in fits)
        assert best[0] < 1e-7
        if abs(best[1]) > 1e-3:
            assert sign.setdefault(r["component"], np.sign(best[1] * r["whitened"])) == np.sign(best[1] * r["whitened"])
        assert r["explained"] == pytest.approx(e[r["component"] - 1] / trace, rel=1e-9)


def test_fewer_components_than_asked_for(spark):
    rows = [(i, [float(i), float(2 * i), 3.0]) for i in range(10)]
    got = wh.whiten(frame(spark, rows)).collect()
    assert {r["component"] for r in got} == {1} and len(got) == 10
    assert got[0]["explained"] == pytest.approx(1)
    assert got[0]["identity_error"] < 1e-9


def test_no_spread_and_no_rows(spark):
    assert wh.whiten(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect() == []
    assert wh.whiten(frame(spark, [])).columns == ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert wh.whiten(frame(spark, [(1, None)])).collect() == []


def test_eigen_of_equal_and_small_values():
    rng = np.random.default_rng(1)
    q = np.linalg.qr(rng.normal(size=(9, 9)))[0]
    values = np.array([4, 4, 4, 1, 1, 1e-3, 1e-6, 0, 0])
    e, c = wh.eigen(q @ np.diag(values) @ q.T)
    assert np.allclose(e, values[:7], rtol=1e-6)
    assert np.allclose(c @ c.T, np.eye(7), atol=1e-8)
    assert wh.eigen(np.zeros((3, 3)))[0].tolist() == []


def test_products_of_large_numbers_are_exact():
    y = np.array([[2**30, -3], [5, 2**29 + 1]] * 50, np.int64)
    assert (wh._exact_products(y) == y.T @ y).all()


def test_query_on_the_given_table(spark):
    from veriform.llm import queries

    sf = "/root/testdata/sf0.001"
    got = queries.op11_embedding_whitening(spark, sf)
    assert got.columns[:7] == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    rows = spark.read.parquet(f"{sf}/embeddings.parquet")
    assert got.count() == 16 * rows.count()
    assert got.agg(F.max("identity_error")).first()[0] < 1e-9
    k = got.where("component = 3").agg(F.stddev_pop("whitened")).first()[0]
    assert k == pytest.approx(1, abs=0.05)
