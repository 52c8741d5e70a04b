import numpy as np
import pytest

from hyperloom.sources import config, csv, generate, matrix_market
from pyspark.sql import functions as F

from .test_algebra import array, coo, dense


def write(path, text):
    path.write_text(text)
    return str(path)


def test_coordinate_files(spark, tmp_path):
    p = write(tmp_path / "a.mtx", "%%MatrixMarket matrix coordinate real general\n% c\n3 4 3\n1 1 2.0\n1\t1\t5.0\n3 4 -1e-3\n")
    m = matrix_market.read_coo(spark, p)
    assert m.shape() == (3, 4) and {tuple(r) for r in m.df.collect()} == {(0, 0, 5.0), (2, 3, -0.001)}
    s = write(tmp_path / "s.mtx", "%%MatrixMarket matrix coordinate pattern symmetric\n2 2 2\n1 1\n2 1\n")
    assert {tuple(r) for r in matrix_market.read_coo(spark, s).df.collect()} == {(0, 0, 1.0), (1, 0, 1.0), (0, 1, 1.0)}
    for bad in ("x\n", "%%MatrixMarket matrix array complex general\n1 1\n1\n", "%%MatrixMarket matrix array real general\n"):
        with pytest.raises(ValueError):
            matrix_market.read_coo(spark, write(tmp_path / "b.mtx", bad))


def test_array_files_in_both_orders(spark, tmp_path):
    p = write(tmp_path / "d.mtx", "%%MatrixMarket matrix array real general\n%\n2 3\n" + "".join(f"{i}\n" for i in range(6)))
    np.testing.assert_array_equal(array(matrix_market.read_dense(spark, p), 2, 3), [[0, 2, 4], [1, 3, 5]])
    np.testing.assert_array_equal(array(matrix_market.read_dense(spark, p, row_major=True), 2, 3), [[0, 1, 2], [3, 4, 5]])


def test_round_trips(spark, tmp_path):
    a = np.array([[1.5, 0, -2.0], [0, 0, 1e-9]])
    matrix_market.write_coo(coo(spark, a), str(tmp_path / "c"))
    np.testing.assert_array_equal(array(matrix_market.read_coo(spark, str(tmp_path / "c")), 2, 3), a)
    matrix_market.write_dense(dense(spark, a), str(tmp_path / "d"))
    np.testing.assert_allclose(array(matrix_market.read_dense(spark, str(tmp_path / "d")), 2, 3), a, rtol=1e-8)
    csv.write_coo(coo(spark, a), str(tmp_path / "e"))
    np.testing.assert_array_equal(array(csv.read_coo(spark, str(tmp_path / "e")), 2, 3), a)
    csv.write_dense(dense(spark, a), str(tmp_path / "f"))
    np.testing.assert_array_equal(array(csv.read_dense(spark, str(tmp_path / "f")), 2, 3), a)


def test_bad_lines_are_left_out(spark, tmp_path):
    p = write(tmp_path / "l.csv", "3\nx\n\n4\n5,6\n")
    assert [r.label for r in csv.read_labels(spark, p).orderBy("row").collect()] == [3, 4]
    p = write(tmp_path / "m.csv", "1,2\n3,y\n5,6\n")
    assert [r.vec for r in csv.read_dense(spark, p).df.orderBy("row").collect()] == [[1.0, 2.0], [5.0, 6.0]]


def test_generators(spark):
    m = generate.random_sparse(spark, 50, 60, 500, seed=1)
    assert sorted(map(tuple, m.df.collect())) == sorted(map(tuple, generate.random_sparse(spark, 50, 60, 500, seed=1).df.collect()))
    assert 400 < m.nnz() <= 500
    x = array(generate.random_dense(spark, 300, 20), 300, 20)
    assert (x >= 0).all() and abs((x == 0).mean() - 0.5) < 0.05 and abs(x.mean() - 0.399) < 0.05
    g = generate.rmat(spark, 6, seed=2)
    assert g.df.agg(F.sum("val")).first()[0] == 16 * 64 and g.shape() == (64, 64)
    assert set(generate.workload(spark, 0.01)) == {"L", "R", "G", "X"}


def test_logs(spark, tmp_path):
    for e in range(2):
        csv.append_log(spark, str(tmp_path / "log"), run_id="r", epoch=e, ms=1.5)
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2


YAML = """
model: {classes: 4, distributed: true, learnable_w: false, hidden_dims: [8], dropout_rate: 0, with_bias: true, activation: relu}
trainer: {learning_rate: 0.1, epochs: 2, output_stepsize: 1, loss_fn: cross_entropy}
lr_scheduler: {step_size: 10, gamma: 0.9}
task_type: classification
data: {dataset: d, g_path: ../g, dvh_path: ../l, invde_ht_dvh_path: ../r, labels_path: ../y, features_path: /x, test_idx: 3}
"""


def test_config():
    pytest.importorskip("yaml")
    c = config.parse(YAML, root="/data")
    assert c.data.g_path == "/data/g" and c.data.features_path == "/x" and c.model.hidden_dims == [8]
    with pytest.raises(ValueError):
        config.parse(YAML.replace("activation: relu", "activation: tanh"))
    with pytest.raises(ValueError):
        config.parse(YAML.replace(", test_idx: 3", ""))
    assert config.preprocessing("a: &r /x\nb: !join [*r, y]\nc: !concat [u, _, v]")["b"] == "/x/y"
    assert config.dataset_name(True, True, True, True) == "m_g_ms_gs" and config.dataset_name(True, False, False, True) == "m_gs"


def test_csv_rows_keep_their_order_over_files(spark, tmp_path):
    """Part files of unequal size, the later ones larger, in a table that Spark reads largest first."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 3)) * np.repeat([1, 1, 1e-12, 1e12], 100)[:, None]
    held = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions", "spark.sql.files.openCostInBytes")}
    try:
        for k, v in zip(held, ("false", "7", "1")):
            spark.conf.set(k, v)
        csv.write_dense(dense(spark, x), str(tmp_path / "x"))
        assert len(list((tmp_path / "x").glob("part-*"))) > 3
        np.testing.assert_array_equal(array(csv.read_dense(spark, str(tmp_path / "x")), 400, 3), x)
        folder = tmp_path / "y"
        folder.mkdir()
        for i, n in ((2, 50), (10, 500), (1, 5)):
            write(folder / f"part-{i}.csv", "".join(f"{1000 * i + k}\n" for k in range(n)))
        want = [1000 * i + k for i, n in ((1, 5), (2, 50), (10, 500)) for k in range(n)]
        assert [r.label for r in csv.read_labels(spark, str(folder)).orderBy("row").collect()] == want
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


def test_labels_of_the_last_column(spark, tmp_path):
    p = write(tmp_path / "t.csv", "0.5,1.5,3\n2,3,1\n")
    assert [r.label for r in csv.read_labels(spark, p, last=True).orderBy("row").collect()] == [3, 1]


def test_shown_and_hardware(spark, tmp_path):
    assert csv.show(coo(spark, [[0, 2.0], [1.0, 0]])) == "(0, 1, 2.0)\n(1, 0, 1.0)" and csv.show(dense(spark, [[1.0], [2.0]]), 1) == "(0, [1.0])"
    csv.append_log(spark, str(tmp_path / "hw"), run_id="r", **csv.hardware(spark))
    assert spark.read.parquet(str(tmp_path / "hw")).columns == ["run_id", "distributed", "ntasks", "tasks_per_node", "cpus_per_task", "mem_per_cpu"]


def test_folders(spark, tmp_path):
    cfg = {"data_root": str(tmp_path / "none"), "result_root": str(tmp_path / "out"), "ckpt_folder": str(tmp_path / "out" / "ckpt"), "result_sub_folder": ""}
    with pytest.raises(ValueError):
        config.check_folders(spark, cfg)
    config.check_folders(spark, cfg | {"data_root": str(tmp_path)})
    assert (tmp_path / "out" / "ckpt").is_dir()


def test_released_results_are_deleted(spark):
    from hyperloom.sources import storage

    outer = storage.stored(spark.range(3), "outer")
    with storage.released(spark):
        inner = storage.stored(spark.range(3), "inner")
        path = inner.inputFiles()[0].removeprefix("file:").rpartition("/")[0]
        assert inner.count() == 3
    import os

    assert outer.count() == 3 and not os.path.exists(path.replace("//", ""))
