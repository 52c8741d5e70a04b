"""Hypergraphs from vectors: distances, nearest neighbours, incidence, degrees and propagation."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..types import Coo, Dense
from .dense import all_pairs, as_array
from .sparse import col_sum, row_sum, scale_cols, scale_rows, spgemm, transpose

#: Cells of a block of vectors; a matrix of one block is sent to all executors, others meet block by block.
BLOCK_CELLS = 4_000_000


def _distances(a, b, rows, others):
    """Of all vectors of ``a`` from all of ``b``; 0 where the rows are one."""
    import numpy as np

    dist = np.sqrt(np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * a @ b.T, 0))
    dist[rows[:, None] == others] = 0.0
    return dist


def _against_blocks(x: Dense, cells: int, each, schema: str) -> DataFrame:
    """``each(rows, other rows, distances)`` for all rows against blocks of rows that make up the whole.

    A matrix of up to ``cells`` cells is one block that every task gets. A larger one is cut into blocks of rows, and each
    pair of blocks meets in a group of its own; nothing passes the driver and no pair of rows is shuffled.
    """
    names = [c.split()[0] for c in schema.split(", ")]
    n, d = x.shape()
    step = max(1, cells // max(1, d))

    def compare(a_rows, a, b_rows, b) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(a), 256):
            rows = a_rows[at : at + 256]
            dist = _distances(a[at : at + 256], b, rows, b_rows)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in each(rows, b_rows, dist)], names)

    df = x.df.select(F.col("row").cast("long").alias("row"), "vec")
    if n <= step:
        told = x.df.sparkSession.sparkContext.broadcast(_block(df))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if len(batch) and len(told.value[0]):
                    yield from compare(batch.column("row").to_numpy(), as_array(batch), *told.value)

        return df.mapInArrow(run, schema)

    blocks = (n - 1) // step + 1
    every, own = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))), F.floor(F.col("row") / step).cast("int")
    left = df.select(F.col("row").alias("a"), F.col("vec").alias("u"), own.alias("i"), every.alias("j"))
    right = df.select(F.col("row").alias("b"), F.col("vec").alias("v"), every.alias("i"), own.alias("j"))

    def meet(ours: pa.Table, theirs: pa.Table) -> pa.Table:
        if not len(ours) or not len(theirs):
            return pa.table({c: pa.array([], pa.float64() if t == "double" else pa.int64()) for c, t in (x.split() for x in schema.split(", "))})
        (a, b) = (t.combine_chunks().to_batches()[0] for t in (ours, theirs))
        return pa.Table.from_batches(list(compare(a.column("a").to_numpy(), as_array(a, "u"), b.column("b").to_numpy(), as_array(b, "v"))))

    return left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(meet, schema)


def _block(df: DataFrame) -> tuple:
    import numpy as np

    t = df.toArrow().combine_chunks()
    batches = t.to_batches()
    return (batches[0].column("row").to_numpy(), as_array(batches[0])) if batches and len(batches[0]) else (np.zeros(0, "i8"), np.zeros((0, 0)))


def pairwise_distance(x: Dense, cells: int = BLOCK_CELLS) -> DataFrame:
    """center, v, d for all pairs: the Euclidean distances. The output is quadratic by definition; for neighbours use knn."""
    return all_pairs(x, x, _distances, "center long, v long, d double", cells)


def knn(x: Dense, k: int, cells: int = BLOCK_CELLS) -> DataFrame:
    """center, v, d, rank (from 1), mean: each row's k nearest, itself first, ties by smaller v, and the mean of its distances
    to all rows, itself included. Each block's k best are kept where they are found; a window picks among blocks."""

    def each(rows, ids, d):
        import numpy as np

        keep = min(k, len(ids))
        key = np.where(rows[:, None] == ids, -1.0, d)
        order = np.lexsort((np.broadcast_to(ids, d.shape), key), axis=1)[:, :keep]
        near = np.take_along_axis(d, order, axis=1)
        total = np.repeat(d.sum(axis=1), keep)
        last = np.tile(np.arange(keep) == 0, len(rows))
        return np.repeat(rows, keep), ids[order].ravel(), near.ravel(), np.where(last, total, 0.0), np.where(last, len(ids), 0)

    found = _against_blocks(x, cells, each, "center long, v long, d double, total double, n long")
    near = W.partitionBy("center")
    rank = F.row_number().over(near.orderBy((F.col("v") != F.col("center")).cast("int"), "d", "v"))
    mean = F.sum("total").over(near) / F.sum("n").over(near)
    return found.select("center", "v", "d", rank.alias("rank"), mean.alias("mean")).where(F.col("rank") <= k)


def _weight(probabilistic: bool, m_prob: float):
    spread = F.when(F.col("mean") > 0, F.col("d") / (m_prob * F.col("mean"))).otherwise(F.lit(0.0))
    return F.exp(-F.pow(spread, F.lit(2.0))) if probabilistic else F.lit(1.0)


def incidence(near: DataFrame, k: int | None = None, probabilistic: bool = True, m_prob: float = 1.0) -> Coo:
    """H (row vertex, col hyperedge): each center's hyperedge holds its k nearest, weighted exp(-(d / (m_prob mean))^2) or 1."""
    near = near if k is None else near.where(F.col("rank") <= k)
    return Coo(near.select(F.col("v").alias("row"), F.col("center").alias("col"), _weight(probabilistic, m_prob).alias("val")))


def multiscale(x: Dense, ks: list[int], probabilistic: bool = True, m_prob: float = 1.0) -> DataFrame:
    """scale, row, col, val: the incidence of each k, from one ranking."""
    near = knn(x, max(ks)).withColumn("scale", F.explode(F.array(*map(F.lit, ks)))).where("rank <= scale")
    return near.select("scale", F.col("v").alias("row"), F.col("center").alias("col"), _weight(probabilistic, m_prob).alias("val"))


def joined_scales(x: Dense, ks: list[int], probabilistic: bool = True, m_prob: float = 1.0) -> Coo:
    """The hyperedges of all scales side by side, from one ranking: scale i's centers are columns from i times the rows."""
    n = x.shape()[0]
    place = F.element_at(F.map_from_arrays(F.array(*map(F.lit, ks)), F.array(*map(F.lit, range(len(ks))))), F.col("scale"))
    df = multiscale(x, ks, probabilistic, m_prob).select("row", (F.col("col") + place.cast("long") * n).alias("col"), "val")
    return Coo(df, n, n * len(ks))


def split_scales(scales: DataFrame, ks: list[int], n: int) -> list[Coo]:
    """The incidence of each scale apart, of a stored result of ``multiscale``."""
    return [Coo(scales.where(F.col("scale") == k).select("row", "col", "val"), n, n) for k in ks]


def hyperedge_concat(*parts: Coo | None) -> Coo:
    """Hyperedges of all parts side by side; None is skipped."""
    out, width, n = None, 0, None
    for p in parts:
        if p is None:
            continue
        rows, cols = p.shape()
        moved = p.df.select("row", (F.col("col") + F.lit(width)).alias("col"), "val")
        out, width, n = moved if out is None else out.unionByName(moved), width + cols, max(n or 0, rows)
    if out is None:
        raise ValueError("no hyperedges to join")
    return Coo(out, n, width)


def feature_concat(*parts: Dense, normal_col: bool = False) -> Dense:
    """Vectors of equal rows end to end; with ``normal_col`` each column is first divided by its largest absolute value (0: stays)."""
    parts = tuple(column_normalised(p) for p in parts) if normal_col else parts
    df = parts[0].df.select("row", "vec")
    for p in parts[1:]:
        df = df.join(p.df.select("row", F.col("vec").alias("more")), "row").select("row", F.concat("vec", "more").alias("vec"))
    return Dense(df, parts[0].n_rows)


def column_normalised(x: Dense) -> Dense:
    """Each column divided by its largest absolute value; the maxima, one for each column, are collected."""
    d = x.shape()[1]
    top = x.df.agg(*(F.max(F.abs(F.get("vec", F.lit(i)))) for i in range(d))).first()
    inverse = F.array(*(F.lit(1.0 / t if t else 1.0) for t in top))
    return Dense(x.df.select("row", F.zip_with("vec", inverse, lambda a, b: a * b).alias("vec")), x.n_rows, d)


def vertex_degree(h: Coo, w: DataFrame | None = None) -> DataFrame:
    """idx, val: the sum of each vertex's incidence, times the hyperedges' weights if given."""
    return row_sum(scale_cols(h, w) if w is not None else h)


def edge_degree(h: Coo) -> DataFrame:
    return col_sum(h)


def _power(degree: DataFrame, p: float) -> DataFrame:
    """Powers of positive degrees; others, as of isolated vertices, are left out."""
    return degree.where("val > 0").select("idx", F.pow("val", F.lit(p)).alias("val"))


def left_factor(h: Coo) -> Coo:
    """L = Dv^-1/2 H."""
    return scale_rows(h, _power(vertex_degree(h), -0.5))


def right_factor(h: Coo) -> Coo:
    """R = De^-1 H^T Dv^-1/2."""
    return scale_cols(scale_rows(transpose(h), _power(edge_degree(h), -1.0)), _power(vertex_degree(h), -0.5))


def propagation(h: Coo, w: DataFrame | None = None) -> Coo:
    """S = L diag(w) R, w = 1 if not given."""
    left = left_factor(h)
    return spgemm(scale_cols(left, w) if w is not None else left, right_factor(h))


def propagations(hs: list[Coo]) -> list[Coo]:
    """The propagation matrix of each of several hypergraphs, as of scales apart."""
    return [propagation(h) for h in hs]
