"""Losses, metrics, gradients against finite differences, optimisers and training."""

import math

import numpy as np
import pytest

from hyperloom.operators import loss as L
from hyperloom.plans import model, optim
from pyspark.sql import functions as F

from .test_algebra import array, coo, dense


def labels(spark, y):
    return spark.createDataFrame([(i, int(v)) for i, v in enumerate(y)], "row long, label int")


def test_accuracy_tie_goes_to_the_first_class(spark):
    p = [(i, 1 - i) for i in np.cumsum([0.0] + [0.1] * 9)]
    p[5] = (0.5, 0.5)
    assert L.accuracy(dense(spark, p), labels(spark, [1] * 10)).first()[0] == 0.5


def test_stable_losses(spark):
    p = [[-900.0, -901.0], [800.0, 0.0]]
    got = {r.row: r.loss for r in L.row_losses(dense(spark, p), labels(spark, [0, 1])).collect()}
    assert got[0] == pytest.approx(math.log(1 + math.exp(-1))) and got[1] == pytest.approx(800.0)
    assert L.cross_entropy(dense(spark, p), labels(spark, [0, 1]), F.col("row") == 0).first()[0] == pytest.approx(got[0])


def test_metrics_of_absent_classes(spark):
    found = spark.createDataFrame([(0, 0), (0, 1), (2, 0)], "label int, pred int")
    got = {r["class"]: (r.precision, r.recall) for r in L.per_class(found).collect()}
    assert got == {0: (0.5, 0.5), 1: (0.0, 0.0), 2: (0.0, 0.0)}
    m = L.macro(found).first()
    assert m.f1 == pytest.approx(1 / 6)
    low = L.zero_based(labels(spark, [1, 2, 3])).orderBy("row").collect()
    assert [r.label for r in low] == [0, 1, 2]


def problem(spark, factored):
    rng = np.random.default_rng(5)
    n, m, dims = 6, 9, [3, 4, 2]
    left, right = rng.random((n, m)) * (rng.random((n, m)) < 0.6), rng.random((m, n)) * (rng.random((m, n)) < 0.6)
    x, y, mask = rng.normal(size=(n, 3)), rng.integers(0, 2, n), np.arange(n) < 4
    params = model.init(dims, seed=3)
    if factored:
        params["w"] = rng.random(m) + 0.5
        prop = model.Factored(coo(spark, left), coo(spark, right))
        s = lambda p: left @ np.diag(p["w"]) @ right
    else:
        prop = model.Fixed(coo(spark, left @ right))
        s = lambda p: left @ right

    def loss(p):
        h = np.maximum(s(p) @ (x @ p["W0"] + p["b0"]), 0)
        z = s(p) @ (h @ p["W1"] + p["b1"])
        lse = np.log(np.exp(z - z.max(1, keepdims=True)).sum(1)) + z.max(1)
        return (lse - z[np.arange(n), y])[mask].mean()

    return prop, dims, x, y, params, loss


@pytest.mark.parametrize("factored", [False, True])
def test_gradients(spark, factored):
    prop, dims, x, y, params, loss = problem(spark, factored)
    net = model.Network(prop, dims)
    out = net.forward(dense(spark, x), params)
    grads = net.backward(L.ce_gradient(out, labels(spark, y), F.col("row") < 4), params)
    assert set(grads) == set(params)
    for k, g in grads.items():
        for i in np.ndindex(*g.shape):
            up, down = {**params, k: params[k].copy()}, {**params, k: params[k].copy()}
            up[k][i] += 1e-6
            down[k][i] -= 1e-6
            assert g[i] == pytest.approx((loss(up) - loss(down)) / 2e-6, abs=1e-7)


def test_training_lowers_the_loss(spark):
    prop, dims, x, y, params, loss = problem(spark, False)
    net = model.Network(prop, dims)
    after, log = model.train(net, dense(spark, x), labels(spark, y), F.col("row") < 4, params, optim.Sgd(0.05), 2)
    assert log[0].train_loss == pytest.approx(loss(params)) and loss(after) < log[1].train_loss < log[0].train_loss


def test_layers_without_last_propagation(spark):
    prop, dims, x, _, params, _ = problem(spark, False)
    net = model.Network(prop, [3, 2], propagate_last=False)
    p = model.init([3, 2])
    np.testing.assert_allclose(array(net.forward(dense(spark, x), p), 6, 2), x @ p["W0"] + p["b0"], atol=1e-12)


def test_optimisers_and_schedules():
    p, g = {"a": np.array([1.0])}, {"a": np.array([0.5])}
    assert optim.Sgd(0.1).step(p, g)["a"][0] == pytest.approx(0.95)
    assert optim.Adam(0.1, weight_decay=0).step(p, g)["a"][0] == pytest.approx(0.9)
    assert [optim.step_lr(1, e, 2, 0.5) for e in range(4)] == [1, 1, 0.5, 0.5]
    assert [optim.early_step_lr(1, e, 2, 0.5) for e in range(4)] == [1, 0.5, 0.5, 0.25]
    assert optim.warm_lr(0.1, 100) == 0.1 and optim.warm_lr(0.1, 101) == pytest.approx(0.08)


def test_dropout_is_seeded(spark):
    from hyperloom.functions import vectors as V

    df = dense(spark, np.ones((200, 20))).df
    a = array(_dropped(df, V, 0), 200, 20)
    b, c = array(_dropped(df, V, 0), 200, 20), array(_dropped(df, V, 1), 200, 20)
    assert (a == b).all() and (a != c).any() and set(np.unique(a)) == {0.0, 2.0} and abs(a.mean() - 1) < 0.1


def _dropped(df, V, epoch):
    from hyperloom.types import Dense

    return Dense(df.select("row", V.dropout("vec", "row", 0.5, 1, epoch).alias("vec")))
