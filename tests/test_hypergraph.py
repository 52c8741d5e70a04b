import numpy as np
import pytest

from hyperloom.operators import dense as D
from hyperloom.operators import hypergraph as H
from hyperloom.plans import queries
from hyperloom.types import Coo

from .test_algebra import array, check_pairs, dense, far_apart


def brute(x, k):
    d = np.sqrt(np.maximum(((x[:, None] - x[None]) ** 2).sum(-1), 0))
    h = np.zeros((len(x), len(x)))
    for c in range(len(x)):
        order = sorted(range(len(x)), key=lambda v: (v != c, d[c, v], v))[:k]
        h[order, c] = np.exp(-((d[c, order] / d[c].mean()) ** 2))
    return d, h


@pytest.mark.parametrize("cells", [10_000, 12])
def test_neighbours_and_incidence(spark, cells):
    x = np.random.default_rng(0).normal(size=(30, 4))
    d, h = brute(x, 5)
    near = H.knn(dense(spark, x), 5, cells=cells)
    np.testing.assert_allclose(array(H.incidence(near), 30, 30), h, atol=1e-9)
    got = np.zeros_like(d)
    for c, v, e in H.pairwise_distance(dense(spark, x), cells=cells).collect():
        got[c, v] = e
    np.testing.assert_allclose(got, d, atol=1e-7)


@pytest.mark.parametrize("block", [2048, 7])
def test_distances_go_by_rows_that_exist(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(D, "PAIR_ROWS", block, raising=False)
    rows, x = far_apart(spark, tmp_path)
    df = queries.queries()["pairwise_distance"](spark, str(tmp_path))
    check_pairs(df, rows, brute(x, 1)[0])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Generate" not in plan  # pairs of blocks are read, not copied and shuffled


def test_each_hyperedge_has_k_members_with_its_center(spark):
    x = np.vstack((np.zeros((4, 3)), np.ones((3, 3))))
    members = {}
    for r, c, v in H.incidence(H.knn(dense(spark, x), 3), probabilistic=False).df.collect():
        members.setdefault(c, set()).add(r)
        assert v == 1.0
    assert all(len(m) == 3 and c in m for c, m in members.items()) and len(members) == 7
    assert H.knn(dense(spark, x), 20).count() == 49


def test_propagation(spark):
    x = np.random.default_rng(1).normal(size=(12, 3))
    _, h = brute(x, 4)
    hg = H.incidence(H.knn(dense(spark, x), 4))
    dv, de = h.sum(1), h.sum(0)
    s = np.diag(dv**-0.5) @ h @ np.diag(1 / de) @ h.T @ np.diag(dv**-0.5)
    got = array(H.propagation(hg), 12, 12)
    np.testing.assert_allclose(got, s, atol=1e-9)
    np.testing.assert_allclose(got, got.T, atol=1e-12)
    np.testing.assert_allclose(got @ dv**0.5, dv**0.5, atol=1e-9)


def test_isolated_vertices_and_weights(spark):
    h = Coo(spark.createDataFrame([(0, 0, 1.0), (1, 0, 1.0), (2, 1, 0.0)], "row long, col long, val double"), 3, 2)
    assert {r for r, c, v in H.propagation(h).df.collect() if v} == {0, 1}
    w = spark.createDataFrame([(0, 2.0), (1, 1.0)], "idx long, val double")
    np.testing.assert_allclose(array(H.propagation(h, w), 3, 3)[:2, :2], np.ones((2, 2)))


def test_concat(spark):
    a = Coo(spark.createDataFrame([(0, 0, 1.0)], "row long, col long, val double"), 2, 3)
    both = H.hyperedge_concat(a, None, a)
    assert both.shape() == (2, 6) and {tuple(r) for r in both.df.collect()} == {(0, 0, 1.0), (0, 3, 1.0)}
    with pytest.raises(ValueError):
        H.hyperedge_concat(None)
    x = np.array([[1.0, 0.0], [-2.0, 0.0]])
    got = array(H.feature_concat(dense(spark, x), dense(spark, x), normal_col=True), 2, 4)
    np.testing.assert_allclose(got, [[0.5, 0, 0.5, 0], [-1, 0, -1, 0]])
    scales = H.multiscale(dense(spark, x), [1, 2]).groupBy("scale").count().collect()
    assert {tuple(r) for r in scales} == {(1, 2), (2, 4)}


def test_scales_side_by_side_and_apart(spark):
    x = np.random.default_rng(3).normal(size=(9, 2))
    both = H.joined_scales(dense(spark, x), [2, 4])
    parts = [brute(x, k)[1] for k in (2, 4)]
    np.testing.assert_allclose(array(both, 9, 18), np.hstack(parts), atol=1e-9)
    apart = H.split_scales(H.multiscale(dense(spark, x), [2, 4]), [2, 4], 9)
    for h, s in zip(parts, H.propagations(apart)):
        dv, de = h.sum(1), h.sum(0)
        np.testing.assert_allclose(array(s, 9, 9), np.diag(dv**-0.5) @ h @ np.diag(1 / de) @ h.T @ np.diag(dv**-0.5), atol=1e-9)
