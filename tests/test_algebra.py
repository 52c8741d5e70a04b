"""Products, maps and reductions against dense arrays."""

import duckdb
import numpy as np
import pytest

from hyperloom.functions import vectors as V
from hyperloom.operators import dense as D
from hyperloom.operators import sparse as S
from hyperloom.plans import queries
from hyperloom.types import Coo, Dense
from pyspark.sql import functions as F


def coo(spark, m) -> Coo:
    m = np.asarray(m, float)
    rows = [(int(i), int(j), float(m[i, j])) for i, j in zip(*np.nonzero(m))]
    return Coo(spark.createDataFrame(rows, "row long, col long, val double"), *m.shape)


def dense(spark, m) -> Dense:
    m = np.asarray(m, float)
    return Dense(spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(m)], D.ROWS), *m.shape)


def array(m, n, d):
    out = np.zeros((n, d))
    if isinstance(m, Dense):
        for r, v in m.df.collect():
            out[r] += v
    else:
        for r, c, v in m.df.select("row", "col", "val").collect():
            out[r, c] += v
    return out


@pytest.mark.parametrize("n,k,m", [(5, 7, 3), (1, 4, 6), (6, 1, 1)])
def test_products(spark, n, k, m):
    rng = np.random.default_rng(n)
    a, b = rng.normal(size=(n, k)) * (rng.random((n, k)) < 0.5), rng.normal(size=(k, m))
    if n > 2:
        a[1] = 0
    sa, sb, da, db = coo(spark, a), coo(spark, b), dense(spark, a), dense(spark, b)
    want = a @ b
    for got in (S.spgemm(sa, sb), S.spmm(sa, db), S.dense_spmm(da, sb), D.matmul(da, db), D.matmul(da, db, most=0), D.matmul_bt(da, D.transpose(db))):
        np.testing.assert_allclose(array(got, n, m), want, atol=1e-12)
    np.testing.assert_allclose(array(D.at_matmul(dense(spark, a), dense(spark, want)), k, m), a.T @ want, atol=1e-12)
    np.testing.assert_allclose(D.at_matmul_local(dense(spark, a), dense(spark, want)), a.T @ want, atol=1e-12)


def test_extents_must_agree(spark):
    with pytest.raises(ValueError):
        S.spgemm(coo(spark, np.ones((2, 3))), coo(spark, np.ones((2, 3))))
    with pytest.raises(ValueError):
        D.times_local(dense(spark, np.ones((2, 3))), np.ones((2, 3)))


def test_row_runs_over_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.range(1000).select((F.col("id") % 3).alias("row"), F.array(F.lit(1.0), F.col("id").cast("double")).alias("vec"))
        got = {r: v for r, v in D.sum_rows(df).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {r: [float(len(range(r, 1000, 3))), float(sum(range(r, 1000, 3)))] for r in range(3)}


def test_diagonal_scaling_of_the_golden_matrix(spark):
    # A small golden matrix, its weights and its product
    cells = [(0, 0, 4.0), (0, 2, 2.0), (2, 1, 5.0), (3, 0, 3.4), (3, 3, 1.7), (3, 4, 2.0)]
    m = Coo(spark.createDataFrame(cells, "row long, col long, val double"), 4, 9)
    w = spark.createDataFrame(list(enumerate([4.0, 1.0, 3.0, 2.0, 5.0, 1.0, 4.0, 1.0, 0.0])), "idx long, val double")
    got = {(r, c): round(v, 9) for r, c, v in S.scale_cols(m, w).df.collect()}
    assert got == {(0, 0): 16.0, (0, 2): 6.0, (2, 1): 5.0, (3, 0): 13.6, (3, 3): 3.4, (3, 4): 10.0}


def test_duplicates_and_structure(spark):
    m = Coo(spark.createDataFrame([(0, 1, 2.0), (0, 1, 3.0), (1, 1, 0.0), (2, 2, 4.0)], "row long, col long, val double"))
    assert {tuple(r) for r in S.dedupe(m).df.collect()} == {(0, 1, 3.0), (1, 1, 0.0), (2, 2, 4.0)}
    assert {tuple(r) for r in S.dedupe(m, F.sum).df.collect()} == {(0, 1, 5.0), (1, 1, 0.0), (2, 2, 4.0)}
    assert {tuple(r) for r in S.diagonal(m).collect()} == {(1, 0.0), (2, 4.0)}
    assert m.shape() == (3, 3) and S.nonzero(m).nnz() == 3
    blocks = spark.range(10).select(S.block_of("id", 10, 3).alias("b")).collect()
    assert [r.b for r in blocks] == [0, 0, 0, 1, 1, 1, 2, 2, 2, 2]


def test_elementwise(spark):
    a = np.array([[-1.0, 0.0, 2.0], [3.0, -4.0, 0.5]])
    d = dense(spark, a)
    np.testing.assert_allclose(array(D.map_rows(d, V.relu), 2, 3), np.maximum(a, 0))
    np.testing.assert_allclose(array(D.map_rows(d, V.relu_grad), 2, 3), a > 0)
    np.testing.assert_allclose(array(D.add(d, d), 2, 3), 2 * a)
    np.testing.assert_allclose(array(D.hadamard(d, d), 2, 3), a * a)
    np.testing.assert_allclose(array(D.add_bias(d, [1, 2, 3]), 2, 3), a + [1, 2, 3])
    np.testing.assert_allclose(array(D.transpose(d), 3, 2), a.T)
    w = spark.createDataFrame([(0, 1.0), (1, -1.0)], "idx long, val double")
    np.testing.assert_allclose(array(D.add_to_rows(d, w), 2, 3), a + [[1], [-1]])
    assert {r.idx: r.val for r in D.row_sum(d).collect()} == {0: 1.0, 1: -0.5}
    assert {r.idx: r.val for r in D.col_sum(d).collect()} == {0: 2.0, 1: -4.0, 2: 2.5}


def test_empty_matrices(spark):
    e = Coo(spark.createDataFrame([], "row long, col long, val double"), 3, 3)
    assert S.spgemm(e, e).nnz() == 0 and S.spmm(e, dense(spark, np.ones((3, 2)))).df.count() == 0
    assert D.sum_rows(spark.createDataFrame([], D.ROWS)).count() == 0


def test_min_plus_semiring(spark):
    m = coo(spark, [[0, 1, 5], [0, 0, 2], [0, 0, 0]])
    got = {(r, c): v for r, c, v in S.spgemm(m, m, lambda x, y: x + y, F.min).df.collect()}
    assert got == {(0, 2): 3.0}


@pytest.mark.parametrize("most", [1, 6, 40])
def test_large_products_go_by_blocks(spark, most):
    rng = np.random.default_rng(most)
    a, b = rng.normal(size=(9, 7)), rng.normal(size=(7, 4))
    np.testing.assert_allclose(array(D.matmul(dense(spark, a), dense(spark, b), most), 9, 4), a @ b)
    np.testing.assert_allclose(array(D.matmul_bt(dense(spark, a), dense(spark, b.T.copy()), most), 9, 4), a @ b)
    np.testing.assert_array_equal(array(D.transpose(dense(spark, a)), 7, 9), a.T)
    with pytest.raises(ValueError):
        D.matmul(dense(spark, a), dense(spark, a), most)
    c = dense(spark, a[:7])
    np.testing.assert_allclose(array(D.matmul(c, c, most), 7, 7), a[:7] @ a[:7])


def test_shapes_must_agree(spark):
    a, b = dense(spark, [[1.0, 2.0], [3.0, 4.0]]), dense(spark, [[1.0, 2.0]])
    for f in (D.add, D.hadamard):
        with pytest.raises(ValueError):
            f(a, b)
        with pytest.raises(Exception, match="lengths"):
            f(Dense(a.df), Dense(dense(spark, [[1.0], [2.0]]).df)).df.collect()
    with pytest.raises(ValueError):
        D.add_bias(a, [1.0])
    np.testing.assert_array_equal(array(D.add(Dense(a.df), Dense(b.df)), 2, 2), [[2, 4], [3, 4]])
    w = spark.createDataFrame([(1, 10.0)], "idx long, val double")
    np.testing.assert_array_equal(array(D.add_to_rows(a, w), 2, 2), [[1, 2], [13, 14]])


def test_block_offsets():
    assert [S.block_offset(b, 10, 3) for b in range(3)] == [0, 3, 6]


def far_apart(spark, folder):
    """Embeddings of rows that are few and far apart, in a folder; and their numbers and vectors."""
    x = np.random.default_rng(4).normal(size=(45, 64)).astype("f4").astype("f8")
    rows = np.concatenate((np.arange(40) * 10**11, 70_000 + np.arange(5)))
    spark.createDataFrame([(int(i), [float(v) for v in u], 0) for i, u in zip(rows, x)], "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    return rows, x


def check_pairs(df, rows, want):
    got = {(a, b): v for a, b, v in df.collect()}
    assert len(got) == df.count() == len(rows) ** 2
    np.testing.assert_allclose([[got[a, b] for b in rows.tolist()] for a in rows.tolist()], want, atol=6e-7)


@pytest.mark.parametrize("block", [2048, 7])
def test_product_with_a_transpose_goes_by_rows_that_exist(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(D, "PAIR_ROWS", block, raising=False)
    rows, x = far_apart(spark, tmp_path)
    df = queries.queries()["dense_mult_bt"](spark, str(tmp_path))
    check_pairs(df, rows, x @ x.T)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Generate" not in plan  # pairs of blocks are read, not copied and shuffled


def test_product_with_a_transpose_adds_up_equal_rows(spark):
    a, b = np.arange(12.0).reshape(6, 2), np.arange(6.0).reshape(3, 2)
    twice = Dense(dense(spark, b).df.unionByName(dense(spark, b).df))
    for most in (1, 1000):
        np.testing.assert_allclose(array(D.matmul_bt(dense(spark, a), twice, most), 6, 3), 2 * a @ b.T)
    assert D.bt_cells(dense(spark, a), twice).df.count() == 36 and D.bt_cells(Dense(spark.createDataFrame([], D.ROWS)), twice).df.count() == 0


def test_rounding_of_pairs(spark):
    values = [0.5e-6, -0.5e-6, 1.5e-6, 2.5e-6, -2.5e-6, -1e-9, 0.1234565, 0.1234564999, 123456.7890125, 5e8 + 2**-21, -7e11 - 0.3, 3e15, float("inf"), float("-inf")]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r.v for r in df.select(queries._rounded("v")).collect()]
    assert str(got) == str(duckdb.sql(f"SELECT round(v::DOUBLE, 6) + 0.0 FROM (SELECT unnest({[str(v) for v in values]}) AS v)").fetchall()).replace("(", "").replace(",)", "")
