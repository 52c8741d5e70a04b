"""The engine's registered queries, each with its SQL where SQL can express it.

Inputs: table embeddings as features and labels; table lineitem as a hypergraph of parts (vertices) in orders (hyperedges)
with the largest quantity as value. Weights are integer formulas of their indices. Results are rounded to 6 places.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import dense as D
from ..operators import hypergraph as H
from ..operators import loss as L
from ..operators import sparse as S
from ..sources import csv, generate, matrix_market
from ..sources.storage import scratch, stored
from ..sources.tables import table
from ..types import Coo, Dense
from . import model, optim

K, HIDDEN, CLASSES, WIDTH = 10, 8, 10, 64

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}

#: Common tables of the SQL, each with what it needs.
_WITH = {
    "x": ("", "SELECT vec_id AS row, label, list_transform(embedding, lambda v: v::DOUBLE) AS vec FROM embeddings"),
    "c": ("x", "SELECT row, unnest(generate_series(0, 63)) AS col, unnest(vec) AS val FROM x"),
    "d": ("x", "SELECT a.row AS center, b.row AS v, CASE WHEN a.row = b.row THEN 0.0 ELSE sqrt(greatest(0.0, list_dot_product(a.vec, a.vec) + list_dot_product(b.vec, b.vec) - 2 * list_dot_product(a.vec, b.vec))) END AS d FROM x a, x b"),
    "k": ("d", "SELECT *, row_number() OVER (PARTITION BY center ORDER BY (v <> center)::INT, d, v) AS rank, avg(d) OVER (PARTITION BY center) AS mean FROM d"),
    "h": ("k", "SELECT v AS row, center AS col, exp(-pow(CASE WHEN mean > 0 THEN d / mean ELSE 0 END, 2)) AS val FROM k WHERE rank <= 10"),
    "dv": ("h", "SELECT row AS idx, sum(val) AS val FROM h GROUP BY row"),
    "de": ("h", "SELECT col AS idx, sum(val) AS val FROM h GROUP BY col"),
    "l": ("h dv", "SELECT h.row, h.col, h.val * pow(dv.val, -0.5) AS val FROM h JOIN dv ON h.row = dv.idx"),
    "r": ("h dv de", "SELECT h.col AS row, h.row AS col, h.val / de.val * pow(dv.val, -0.5) AS val FROM h JOIN dv ON h.row = dv.idx JOIN de ON h.col = de.idx"),
    "s": ("l r", "SELECT l.row, r.col, sum(l.val * r.val) AS val FROM l JOIN r ON l.col = r.row GROUP BY 1, 2"),
    "a": ("", "SELECT l_partkey AS row, l_orderkey AS col, max(l_quantity)::DOUBLE AS val FROM lineitem GROUP BY 1, 2"),
    "w0": ("", "SELECT i AS row, j AS col, ((i * 7919 + j * 104729) % 2003) / 1001.5 - 1 AS val FROM generate_series(0, 63) a(i), generate_series(0, 7) b(j)"),
    "w1": ("", "SELECT i AS row, j AS col, (((i + 64) * 7919 + j * 104729) % 2003) / 1001.5 - 1 AS val FROM generate_series(0, 7) a(i), generate_series(0, 9) b(j)"),
    "b0": ("", "SELECT j AS col, ((j * 613) % 401) / 200.5 - 1 AS val FROM generate_series(0, 7) b(j)"),
    "b1": ("", "SELECT j AS col, ((j * 613 + 57) % 401) / 200.5 - 1 AS val FROM generate_series(0, 9) b(j)"),
    "z0": ("c w0 b0", "SELECT q.row, q.col, q.val + b0.val AS val FROM (SELECT c.row, w0.col, sum(c.val * w0.val) AS val FROM c JOIN w0 ON c.col = w0.row GROUP BY 1, 2) q JOIN b0 ON q.col = b0.col"),
    "g0": ("s z0", "SELECT s.row, z0.col, sum(s.val * z0.val) AS val FROM s JOIN z0 ON s.col = z0.row GROUP BY 1, 2"),
    "h0": ("g0", "SELECT row, col, greatest(val, 0.0) AS val FROM g0"),
    "z1": ("h0 w1 b1", "SELECT q.row, q.col, q.val + b1.val AS val FROM (SELECT h0.row, w1.col, sum(h0.val * w1.val) AS val FROM h0 JOIN w1 ON h0.col = w1.row GROUP BY 1, 2) q JOIN b1 ON q.col = b1.col"),
    "g1": ("s z1", "SELECT s.row, z1.col, sum(s.val * z1.val) AS val FROM s JOIN z1 ON s.col = z1.row GROUP BY 1, 2"),
    "n": ("x", "SELECT count(*) FILTER (row % 5 < 4) AS n FROM x"),
    "lse": ("g1", "SELECT g1.row, m.m + ln(sum(exp(g1.val - m.m))) AS lse FROM g1 JOIN (SELECT row, max(val) AS m FROM g1 GROUP BY row) m ON g1.row = m.row GROUP BY g1.row, m.m"),
    "ce": ("g1 lse x", "SELECT g1.row, x.label, lse.lse - g1.val AS loss FROM g1 JOIN lse ON g1.row = lse.row JOIN x ON x.row = g1.row AND x.label = g1.col"),
    "dg1": ("g1 lse x n", "SELECT g1.row, g1.col, CASE WHEN g1.row % 5 < 4 THEN (exp(g1.val - lse.lse) - (x.label = g1.col)::INT) / n.n ELSE 0.0 END AS val FROM n, g1 JOIN lse ON g1.row = lse.row JOIN x ON x.row = g1.row"),
    "dz1": ("s dg1", "SELECT s.col AS row, dg1.col, sum(s.val * dg1.val) AS val FROM s JOIN dg1 ON s.row = dg1.row GROUP BY 1, 2"),
    "dw1": ("h0 dz1", "SELECT h0.col AS row, dz1.col, sum(h0.val * dz1.val) AS val FROM h0 JOIN dz1 ON h0.row = dz1.row GROUP BY 1, 2"),
    "p": ("g1 x", "SELECT g1.row, any_value(x.label)::INT AS label, arg_max(g1.col, (g1.val, -g1.col))::INT AS pred FROM g1 JOIN x ON x.row = g1.row GROUP BY g1.row"),
    "cl": ("p", "SELECT k AS class, count(*) FILTER (label = k AND pred = k) AS tp, count(*) FILTER (pred = k) AS predicted, count(*) FILTER (label = k) AS actual FROM p, (SELECT label AS k FROM p UNION SELECT pred FROM p) GROUP BY k"),
    "pr": ("cl", "SELECT class, tp, predicted, actual, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END AS precision, CASE WHEN actual > 0 THEN tp / actual ELSE 0 END AS recall FROM cl"),
}


def _sql(needs: str, select: str) -> str:
    """``select`` after the common tables that it needs; _R(x) rounds."""
    order: list[str] = []

    def add(name: str) -> None:
        if name not in order:
            for n in _WITH[name][0].split():
                add(n)
            order.append(name)

    for n in needs.split():
        add(n)
    tables = ", ".join(f"{n} AS MATERIALIZED ({_WITH[n][1]})" for n in order)
    return (f"WITH {tables} " if tables else "") + select.replace("_V", "round(val, 6) + 0.0 AS val")


def query(needs: str = "", sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = _sql(needs, sql)
        return f

    return add


CELLS = "SELECT row::BIGINT AS row, col::BIGINT AS col, _V FROM "


def _cells(m: Coo | Dense | DataFrame) -> DataFrame:
    df = m.cells() if isinstance(m, Dense) else m.df if isinstance(m, Coo) else m
    return df.select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.round("val", 6).alias("val"))


def _rounded(name: str) -> Column:
    """6 places, halves away from zero, by arithmetic as in DuckDB. F.round goes by decimal text, which takes most of the time
    where all pairs are the result; it stays for numbers whose millionths a double doesn't hold."""
    y = F.abs(name) * 1e6
    whole = F.rint(y) + F.when(y - F.rint(y) >= 0.5, 1.0).otherwise(0.0)
    return F.when(F.abs(name) < 1e9, F.signum(name) * whole / 1e6 + 0.0).otherwise(F.round(name, 6)).alias(name)


def _vector(df: DataFrame) -> DataFrame:
    return df.select(F.col("idx").cast("long").alias("idx"), F.round("val", 6).alias("val"))


def features(spark: SparkSession, folder: str) -> Dense:
    df = table(spark, folder, "embeddings").select(F.col("vec_id").alias("row"), F.transform("embedding", lambda v: v.cast("double")).alias("vec"))
    return Dense(df, None, WIDTH)


def labels(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("row"), F.col("label").cast("int").alias("label"))


def neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return H.knn(features(spark, folder), K)


def vertices(spark: SparkSession, folder: str) -> Coo:
    return H.incidence(stored(neighbours(spark, folder)))


def order_parts(spark: SparkSession, folder: str) -> Coo:
    df = table(spark, folder, "lineitem").select(F.col("l_partkey").alias("row"), F.col("l_orderkey").alias("col"), F.col("l_quantity").cast("double").alias("val"))
    return S.dedupe(Coo(df))


def weights(n: int, m: int, offset: int = 0):
    import numpy as np

    i, j = np.arange(n)[:, None] + offset, np.arange(m)[None, :]
    return ((i * 7919 + j * 104729) % 2003) / 1001.5 - 1


def biases(m: int, offset: int = 0):
    import numpy as np

    return ((np.arange(m) * 613 + offset) % 401) / 200.5 - 1


def dense_weights(spark: SparkSession, n: int, m: int, offset: int = 0) -> Dense:
    return Dense(spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(weights(n, m, offset))], D.ROWS), n, m)


def small_params() -> dict:
    return {"W0": weights(WIDTH, HIDDEN), "b0": biases(HIDDEN), "W1": weights(HIDDEN, CLASSES, 64), "b1": biases(CLASSES, 57)}


def network(spark: SparkSession, folder: str) -> model.Network:
    s = Coo(stored(H.propagation(vertices(spark, folder)).df))
    return model.Network(model.Fixed(s), [WIDTH, HIDDEN, CLASSES])


def logits(spark: SparkSession, folder: str) -> Dense:
    return network(spark, folder).forward(features(spark, folder), small_params())


def is_train():
    return F.col("row") % 5 < 4


# Hypergraph


@query("d", "SELECT center, v, round(d, 6) + 0.0 AS d FROM d")
def pairwise_distance(spark, folder):
    return H.pairwise_distance(features(spark, folder)).select("center", "v", _rounded("d"))


@query("k", "SELECT center, v, rank::INT AS rank, round(d, 6) + 0.0 AS d FROM k WHERE rank <= 10")
def knn_topk(spark, folder):
    return neighbours(spark, folder).select("center", "v", "rank", F.round("d", 6).alias("d"))


@query("h", CELLS + "h")
def incidence_prob(spark, folder):
    return _cells(H.incidence(neighbours(spark, folder)))


@query("k", "SELECT v AS row, center AS col, 1.0::DOUBLE AS val FROM k WHERE rank <= 10")
def incidence_binary(spark, folder):
    return _cells(H.incidence(neighbours(spark, folder), probabilistic=False))


@query("k", "SELECT s::INT AS scale, v AS row, center AS col, round(exp(-pow(d / mean, 2)), 6) + 0.0 AS val FROM k, (VALUES (5), (10)) t(s) WHERE rank <= s")
def incidence_multiscale(spark, folder):
    return H.multiscale(features(spark, folder), [5, 10]).select("scale", "row", "col", F.round("val", 6).alias("val"))


@query("k x", CELLS + "(SELECT v AS row, center + i * (SELECT count(*) FROM x) AS col, exp(-pow(d / mean, 2)) AS val FROM k, (VALUES (5, 0), (10, 1)) t(s, i) WHERE rank <= s)")
def incidence_scales_joined(spark, folder):
    return _cells(H.joined_scales(features(spark, folder), [5, 10]))


@query("h x", CELLS + "(SELECT * FROM h UNION ALL SELECT row, col + (SELECT max(row) + 1 FROM x), val FROM h)")
def hyperedge_concat(spark, folder):
    h = vertices(spark, folder)
    return _cells(H.hyperedge_concat(h, None, h))


@query("c", CELLS + "(SELECT * FROM c UNION ALL SELECT row, col + 64, val FROM c)")
def feature_concat(spark, folder):
    x = features(spark, folder)
    return _cells(H.feature_concat(x, x))


@query("c", CELLS + "(SELECT row, col, val / max(abs(val)) OVER (PARTITION BY col) AS val FROM c)")
def feature_colnorm(spark, folder):
    return _cells(H.column_normalised(features(spark, folder)))


# Degrees and propagation


@query("dv", "SELECT idx, _V FROM dv")
def vertex_degree(spark, folder):
    return _vector(H.vertex_degree(vertices(spark, folder)))


@query("de", "SELECT idx, _V FROM de")
def edge_degree(spark, folder):
    return _vector(H.edge_degree(vertices(spark, folder)))


@query("l", CELLS + "l")
def left_factor(spark, folder):
    return _cells(H.left_factor(vertices(spark, folder)))


@query("r", CELLS + "r")
def right_factor(spark, folder):
    return _cells(H.right_factor(vertices(spark, folder)))


@query("s", CELLS + "s")
def propagation_matrix(spark, folder):
    return _cells(H.propagation(vertices(spark, folder)))


@query("a", CELLS + "(SELECT a.row, a.col, a.val * o_totalprice / 1000 AS val FROM a JOIN orders ON a.col = o_orderkey WHERE o_totalprice <> 0)")
def diag_scale(spark, folder):
    w = table(spark, folder, "orders").select(F.col("o_orderkey").alias("idx"), F.col("o_totalprice").cast("double").alias("val"))
    scaled = S.scale_cols(order_parts(spark, folder), w)
    return _cells(scaled.df.withColumn("val", F.col("val") / 1000))


@query("a", CELLS + "a")
def coo_dedupe_max(spark, folder):
    return _cells(order_parts(spark, folder))


@query("", CELLS + "(SELECT l_partkey AS row, l_orderkey AS col, sum(l_quantity)::DOUBLE AS val FROM lineitem GROUP BY 1, 2)")
def coo_dedupe_sum(spark, folder):
    df = table(spark, folder, "lineitem").select(F.col("l_partkey").alias("row"), F.col("l_orderkey").alias("col"), F.col("l_quantity").cast("double").alias("val"))
    return _cells(S.dedupe(Coo(df), F.sum))


@query("a", "SELECT count(*)::BIGINT AS nnz FROM a")
def coo_nnz(spark, folder):
    return order_parts(spark, folder).df.agg(F.count("*").alias("nnz"))


# Products


@query("a", CELLS + "(SELECT p.row, q.row AS col, sum(p.val * q.val) AS val FROM a p JOIN a q ON p.col = q.col GROUP BY 1, 2)")
def spgemm(spark, folder):
    a = order_parts(spark, folder)
    return _cells(S.spgemm(a, S.transpose(a)))


@query("a", CELLS + "(SELECT p.row, q.row AS col, min(p.val + q.val) AS val FROM a p JOIN a q ON p.col = q.col GROUP BY 1, 2)")
def spgemm_min_plus(spark, folder):
    a = order_parts(spark, folder)
    return _cells(S.spgemm(a, S.transpose(a), mul=lambda x, y: x + y, add=F.min))


@query("s c", CELLS + "(SELECT s.row, c.col, sum(s.val * c.val) AS val FROM s JOIN c ON s.col = c.row GROUP BY 1, 2)")
def spmm(spark, folder):
    return _cells(S.spmm(H.propagation(vertices(spark, folder)), features(spark, folder)))


@query("s c", CELLS + "(SELECT c.col AS row, s.col, sum(c.val * s.val) AS val FROM c JOIN s ON c.row = s.row GROUP BY 1, 2)")
def dense_spmm(spark, folder):
    s = Coo(stored(H.propagation(vertices(spark, folder)).df))
    return _cells(S.dense_spmm(D.transpose(features(spark, folder)), s))


@query("c w0", CELLS + "(SELECT c.row, w0.col, sum(c.val * w0.val) AS val FROM c JOIN w0 ON c.col = w0.row GROUP BY 1, 2)")
def dense_mult(spark, folder):
    return _cells(D.matmul(features(spark, folder), dense_weights(spark, WIDTH, HIDDEN)))


@query("c w0", CELLS + "(SELECT c.row, w0.col, sum(c.val * w0.val) AS val FROM c JOIN w0 ON c.col = w0.row GROUP BY 1, 2)")
def dense_mult_join(spark, folder):
    return _cells(D.matmul(features(spark, folder), dense_weights(spark, WIDTH, HIDDEN), most=0))


@query("x", CELLS + "(SELECT a.row, b.row AS col, list_dot_product(a.vec, b.vec) AS val FROM x a, x b)")
def dense_mult_bt(spark, folder):
    x = features(spark, folder)
    return D.bt_cells(x, x).df.select("row", "col", _rounded("val"))


@query("c", CELLS + "(SELECT a.col AS row, b.col, sum(a.val * b.val) AS val FROM c a JOIN c b ON a.row = b.row GROUP BY 1, 2)")
def dense_at_mult(spark, folder):
    x = features(spark, folder)
    return _cells(D.at_matmul(x, x))


@query("a", CELLS + "(SELECT col AS row, row AS col, val FROM a)")
def sparse_transpose(spark, folder):
    return _cells(S.transpose(order_parts(spark, folder)))


@query("c", CELLS + "(SELECT col AS row, row AS col, val FROM c)")
def dense_transpose(spark, folder):
    return _cells(D.transpose(features(spark, folder)))


# Elementwise maps and reductions


@query("c", CELLS + "(SELECT row, col, greatest(val, 0.0) AS val FROM c)")
def relu(spark, folder):
    return _cells(D.map_rows(features(spark, folder), V.relu))


@query("c", CELLS + "(SELECT row, col, (val > 0)::INT::DOUBLE AS val FROM c)")
def relu_grad(spark, folder):
    return _cells(D.map_rows(features(spark, folder), V.relu_grad))


@query("c", CELLS + "(SELECT row, col, val * val AS val FROM c)")
def hadamard(spark, folder):
    x = features(spark, folder)
    return _cells(D.hadamard(x, x))


@query("a", CELLS + "(SELECT p.row, p.col, p.val * q.val AS val FROM a p JOIN a q ON p.row = q.col AND p.col = q.row)")
def sparse_hadamard(spark, folder):
    a = order_parts(spark, folder)
    return _cells(S.hadamard(a, S.transpose(a)))


@query("c", CELLS + "(SELECT row, col, val + val AS val FROM c)")
def dense_add(spark, folder):
    x = features(spark, folder)
    return _cells(D.add(x, x))


@query("a", CELLS + "(SELECT row, col, sum(val) AS val FROM (SELECT * FROM a UNION ALL SELECT col, row, val FROM a) GROUP BY 1, 2)")
def sparse_add(spark, folder):
    a = order_parts(spark, folder)
    return _cells(S.add(a, S.transpose(a)))


@query("c x", CELLS + "(SELECT c.row, c.col, c.val + x.label AS val FROM c JOIN x ON c.row = x.row)")
def row_vec_add(spark, folder):
    w = labels(spark, folder).select(F.col("row").alias("idx"), F.col("label").cast("double").alias("val"))
    return _cells(D.add_to_rows(features(spark, folder), w))


@query("z0", CELLS + "z0")
def bias_add(spark, folder):
    return _cells(D.add_bias(D.times_local(features(spark, folder), weights(WIDTH, HIDDEN)), biases(HIDDEN)))


@query("c", CELLS + "(SELECT row, col, -0.1 * val AS val FROM c)")
def scalar_mult(spark, folder):
    return _cells(D.map_rows(features(spark, folder), lambda v: V.scale(v, F.lit(-0.1))))


@query("c", "SELECT idx, _V FROM (SELECT row AS idx, sum(val) AS val FROM c GROUP BY row)")
def row_sum(spark, folder):
    return _vector(D.row_sum(features(spark, folder)))


@query("c", "SELECT idx::BIGINT AS idx, _V FROM (SELECT col AS idx, sum(val) AS val FROM c GROUP BY col)")
def col_sum(spark, folder):
    return _vector(D.col_sum(features(spark, folder)))


@query("a", "SELECT max(row) + 1 AS n_rows, max(col) + 1 AS n_cols FROM a")
def matrix_shape(spark, folder):
    n, m = order_parts(spark, folder).shape()
    return spark.createDataFrame([(n, m)], "n_rows long, n_cols long")


@query("a x", "SELECT row, least(floor(row / greatest(1, (SELECT max(row) + 1 FROM x) // 3)), 2)::INT AS block FROM x")
def block_owner(spark, folder):
    x = features(spark, folder)
    return x.df.select("row", S.block_of("row", x.shape()[0], 3).alias("block"))


@query("s", "SELECT row AS idx, _V FROM s WHERE row = col")
def diag_extract(spark, folder):
    return _vector(S.diagonal(H.propagation(vertices(spark, folder))))


@query("c", CELLS + "c WHERE val > 0.1")
def nonzero_filter(spark, folder):
    cells = features(spark, folder).cells().withColumn("val", F.when(F.col("val") > 0.1, F.col("val")).otherwise(0.0))
    return _cells(S.nonzero(Coo(cells)))


# Loss and metrics


@query("lse", "SELECT row, round(lse, 6) + 0.0 AS lse FROM lse")
def log_sum_exp(spark, folder):
    return logits(spark, folder).df.select("row", F.round(V.log_sum_exp("vec"), 6).alias("lse"))


@query("ce", "SELECT round(avg(loss) FILTER (row % 5 < 4), 6) + 0.0 AS train_loss, round(avg(loss) FILTER (row % 5 = 4), 6) + 0.0 AS test_loss FROM ce")
def cross_entropy(spark, folder):
    losses = L.row_losses(logits(spark, folder), labels(spark, folder))
    part = lambda c, n: F.round(F.avg(F.when(c, F.col("loss"))), 6).alias(n)
    return losses.agg(part(is_train(), "train_loss"), part(~is_train(), "test_loss"))


@query("dg1", CELLS + "dg1")
def ce_gradient(spark, folder):
    return _cells(L.ce_gradient(logits(spark, folder), labels(spark, folder), is_train()))


@query("p", "SELECT row, label, pred FROM p")
def argmax_predict(spark, folder):
    return L.predictions(logits(spark, folder), labels(spark, folder))


@query("p", "SELECT avg((label = pred)::INT) AS accuracy FROM p")
def accuracy(spark, folder):
    return L.accuracy(logits(spark, folder), labels(spark, folder))


@query("pr", "SELECT class, round(precision, 6) AS precision FROM pr")
def class_precision(spark, folder):
    return L.per_class(L.predictions(logits(spark, folder), labels(spark, folder))).select("class", F.round("precision", 6).alias("precision"))


@query("pr", "SELECT class, round(recall, 6) AS recall FROM pr")
def class_recall(spark, folder):
    return L.per_class(L.predictions(logits(spark, folder), labels(spark, folder))).select("class", F.round("recall", 6).alias("recall"))


@query("pr", "SELECT round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM (SELECT avg(precision) AS p, avg(recall) AS r FROM pr)")
def macro_f1(spark, folder):
    found = L.macro(L.predictions(logits(spark, folder), labels(spark, folder)))
    return found.select(*(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


@query("x", "SELECT row, row < (SELECT (max(row) + 1) * 4 // 5 FROM x) AS is_train FROM x")
def train_test_split(spark, folder):
    x = features(spark, folder)
    return x.df.select("row", (F.col("row") < x.shape()[0] * 4 // 5).alias("is_train"))


@query("x", "SELECT row, (label + 1 - CASE WHEN min(label + 1) OVER () = 1 THEN 1 ELSE 0 END)::INT AS label FROM x")
def label_zero_base(spark, folder):
    return L.zero_based(labels(spark, folder).withColumn("label", F.col("label") + 1))


# Model


@query("h0", CELLS + "h0")
def layer_forward(spark, folder):
    net = network(spark, folder)
    net.forward(features(spark, folder), small_params())
    return _cells(D.map_rows(net.cache[0][2], V.relu))


@query("g1", CELLS + "g1")
def two_layer_forward(spark, folder):
    return _cells(logits(spark, folder))


def _gradients(spark, folder) -> dict:
    net, params = network(spark, folder), small_params()
    out = net.forward(features(spark, folder), params)
    return net.backward(L.ce_gradient(out, labels(spark, folder), is_train()), params)


def _matrix(spark, m) -> DataFrame:
    return spark.createDataFrame([(i, j, float(v)) for i, r in enumerate(m) for j, v in enumerate(r)], "row long, col long, val double")


@query("dw1", CELLS + "dw1")
def weight_gradient(spark, folder):
    return _cells(_matrix(spark, _gradients(spark, folder)["W1"]))


@query("dz1", "SELECT idx::BIGINT AS idx, _V FROM (SELECT col AS idx, sum(val) AS val FROM dz1 GROUP BY col)")
def bias_gradient(spark, folder):
    return _vector(spark.createDataFrame([(i, float(v)) for i, v in enumerate(_gradients(spark, folder)["b1"])], "idx long, val double"))


@query("l r c", """SELECT k AS idx, _V FROM (SELECT u.k, sum(u.val * v.val) AS val FROM
  (SELECT l.col AS k, c.col, sum(l.val * c.val) AS val FROM l JOIN c ON l.row = c.row GROUP BY 1, 2) u JOIN
  (SELECT r.row AS k, c.col, sum(r.val * c.val) AS val FROM r JOIN c ON r.col = c.row GROUP BY 1, 2) v ON u.k = v.k AND u.col = v.col GROUP BY 1)""")
def edge_weight_gradient(spark, folder):
    """The hyperedge weights' gradient for features both as input and as the gradient that comes back."""
    import numpy as np

    h, x = vertices(spark, folder), features(spark, folder)
    p = model.Factored(Coo(stored(H.left_factor(h).df)), Coo(stored(H.right_factor(h).df)))
    _, dw = p.backward(x, x, {"w": np.ones(x.shape()[0])})
    return _vector(spark.createDataFrame([(i, float(v)) for i, v in enumerate(dw)], "idx long, val double"))


@query("dw1 w1", CELLS + "(SELECT w1.row, w1.col, w1.val - 0.1 * dw1.val AS val FROM w1 JOIN dw1 ON w1.row = dw1.row AND w1.col = dw1.col)")
def sgd_step(spark, folder):
    return _cells(_matrix(spark, optim.Sgd(0.1).step(small_params(), _gradients(spark, folder))["W1"]))


@query("", "SELECT e::INT AS epoch, round(0.1 * pow(0.9, e // 10), 12) AS step_lr, round(0.1 * pow(0.9, (e + 9) // 10), 12) AS early_lr FROM generate_series(0, 199) t(e)")
def lr_step_schedule(spark, folder):
    rows = [(e, round(optim.step_lr(0.1, e, 10, 0.9), 12), round(optim.early_step_lr(0.1, e, 10, 0.9), 12)) for e in range(200)]
    return spark.createDataFrame(rows, "epoch int, step_lr double, early_lr double")


# Training, generators, files: no SQL; the tests check values


def _log(spark, log: list[model.Epoch]) -> DataFrame:
    return spark.createDataFrame([(e.epoch, e.train_loss, e.test_loss, e.test_acc, e.test_f1) for e in log], "epoch int, train_loss double, test_loss double, test_acc double, test_f1 double")


@query()
def train_sgd(spark, folder):
    return _log(spark, model.train(network(spark, folder), features(spark, folder), labels(spark, folder), is_train(), small_params(), optim.Sgd(0.1), 3)[1])


@query()
def train_adam(spark, folder):
    net = network(spark, folder)
    net.dropout = 0.5
    return _log(spark, model.train(net, features(spark, folder), labels(spark, folder), is_train(), model.init(net.dims), optim.Adam(0.001), 3, lambda e: optim.step_lr(0.001, e, 10, 0.9))[1])


@query()
def train_learnable_w(spark, folder):
    import numpy as np

    h, x = vertices(spark, folder), features(spark, folder)
    p = model.Factored(Coo(stored(H.left_factor(h).df)), Coo(stored(H.right_factor(h).df)))
    params = small_params() | {"w": np.ones(x.shape()[0])}
    return _log(spark, model.train(model.Network(p, [WIDTH, HIDDEN, CLASSES]), x, labels(spark, folder), is_train(), params, optim.Sgd(0.1), 2)[1])


@query()
def dropout_mask(spark, folder):
    return _cells(Dense(features(spark, folder).df.select("row", V.dropout("vec", "row", 0.5, 7).alias("vec"))))


@query()
def random_sparse(spark, folder):
    return generate.random_sparse(spark, 500, 1000, 10_000, seed=3).df


@query()
def random_dense(spark, folder):
    return generate.random_dense(spark, 200, 16, seed=3).cells()


@query()
def rmat_edges(spark, folder):
    return generate.rmat(spark, 10, seed=3).df


@query("s", CELLS + "s")
def matrix_market_roundtrip(spark, folder):
    path = scratch(spark, "mtx")
    matrix_market.write_coo(H.propagation(vertices(spark, folder)), path)
    return _cells(matrix_market.read_coo(spark, path))


@query("c", CELLS + "c")
def csv_roundtrip(spark, folder):
    path = scratch(spark, "csv")
    x = features(spark, folder)
    csv.write_dense(Dense(x.df.repartition(4), *x.shape()), path)
    return _cells(csv.read_dense(spark, path))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
