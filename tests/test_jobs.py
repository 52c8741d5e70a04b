"""Preprocessing, configured runs and benchmarks from end to end."""

import numpy as np
import pytest

from hyperloom.plans import benchmarks, model, preprocess, run
from hyperloom.sources import config, mat

from .test_algebra import array, dense
from .test_sources import YAML


def test_from_features_to_training(spark, tmp_path):
    pytest.importorskip("yaml")
    rng = np.random.default_rng(2)
    y = np.arange(16) % 2
    a, b = rng.normal(size=(16, 3)) + 3 * y[:, None], rng.normal(size=(16, 2))
    x, h = preprocess.assemble(dense(spark, a), dense(spark, b), (True, True), (True, False), k=4)
    m = preprocess.matrices(x, h)
    np.testing.assert_allclose(array(x, 16, 5), np.hstack((a, b)))
    preprocess.write(m, str(tmp_path), "mtx")
    preprocess.write(m, str(tmp_path), "csv")
    preprocess.write(m, str(tmp_path / "p"))
    for name in ("G.mtx", "G_coo.csv", "p/G"):
        np.testing.assert_allclose(array(preprocess.read_sparse(spark, str(tmp_path / name)), 16, 16), array(m.g, 16, 16), atol=1e-12)
    (tmp_path / "y.csv").write_text("".join(f"{v}\n" for v in y))
    at = {"../g": "G.mtx", "../l": "DVH.mtx", "../r": "invDE_HT_DVH.mtx", "../y": "y.csv", "/x": "features.csv"}
    text = YAML.replace("classes: 4", "classes: 2").replace("test_idx: 3", "test_idx: 12").replace("hidden_dims: [8]", "hidden_dims: [4]")
    for old, new in at.items():
        text = text.replace(f": {old}", f": {tmp_path}/{new}")
    params, log = run.run(spark, config.parse(text), str(tmp_path / "log"))
    assert len(log) == 2 and log[1].train_loss < log[0].train_loss and params["W0"].shape == (5, 4)
    assert spark.read.parquet(str(tmp_path / "log" / "main_training")).count() == 2
    with pytest.raises(ValueError):
        preprocess.assemble(x, None, (True, False), (False, False))


def test_example_preset(spark, tmp_path):
    rng = np.random.default_rng(3)
    y = np.arange(12) % 2
    x = dense(spark, rng.normal(size=(12, 3)) + 3 * y[:, None])
    m = preprocess.matrices(*preprocess.assemble(x, None, (True, False), (True, False), k=3))
    labels = spark.createDataFrame(list(enumerate(y.tolist())), "row long, label int")
    params, log = run.example(spark, x, labels, model.Factored(m.left, m.right), [4], 2, 9, epochs=2, log=str(tmp_path / "log"))
    assert len(log) == 2 and params["w"].shape == (12,) and spark.read.parquet(str(tmp_path / "log")).columns == ["run_id", "cpus", "epoch", "ms", "loss"]
    assert (model.init([3, 2], constant_bias=1.0)["b0"] == 1).all()


def test_benchmarks(spark, tmp_path):
    took = benchmarks.products(spark, 1e-5, 2, str(tmp_path / "log"), width=4)
    assert {k: len(v) for k, v in took.items()} == {"dense": 2, "sparse": 2} and spark.read.parquet(str(tmp_path / "log")).count() == 4


def test_archive():
    content = {"X": [[np.ones((2, 3)), np.zeros((2, 1))]], "Y": np.array([[1], [2]]), "indices": np.array([[1, 0]])}
    x, y, train = mat.archive(content, "GVCNN")
    assert x.shape == (2, 1) and y.tolist() == [0, 1] and train.tolist() == [True, False]
    with pytest.raises(ValueError):
        mat.archive(content, "other")
