"""Sparse matrices: products, scalings, reductions and structure as joins and aggregations of (row, col, val)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..types import Coo, Dense, same
from .dense import MOST_CELLS, ROWS, as_vectors, dense_of, local, sum_partial, sum_rows, summed

#: Cells of a sparse matrix that are multiplied at once in a worker.
ROWS_AT_ONCE = 4096


def dedupe(m: Coo, how: Callable[[Column], Column] = F.max) -> Coo:
    """Cells that occur more than once become one, by maximum or another aggregate such as F.sum."""
    return Coo(m.df.groupBy("row", "col").agg(how(F.col("val")).alias("val")), m.n_rows, m.n_cols)


def transpose(m: Coo) -> Coo:
    return Coo(m.df.select(F.col("col").alias("row"), F.col("row").alias("col"), "val"), m.n_cols, m.n_rows)


def spgemm(a: Coo, b: Coo, mul: Callable[[Column, Column], Column] = lambda x, y: x * y, add: Callable[[Column], Column] = F.sum) -> Coo:
    """A times B over a semiring: a join on the inner index and an aggregation of what meets in a cell.

    Spark picks the join; AQE splits a hub index of the shuffle join, whose partial sums combine before the next shuffle.
    """
    if a.n_cols is not None and b.n_rows is not None:
        same("inner extents", a.n_cols, b.n_rows)
    left, right = a.df.select("row", F.col("col").alias("k"), F.col("val").alias("x")), b.df.select(F.col("row").alias("k"), "col", F.col("val").alias("y"))
    return Coo(left.join(right, "k").groupBy("row", "col").agg(add(mul(F.col("x"), F.col("y"))).alias("val")), a.n_rows, b.n_cols)


def spmm(a: Coo, x: Dense, most: int = MOST_CELLS) -> Dense:
    """Sparse A times dense X: rows of X meet A's cells, scaled rows are summed, first within tasks. Rows of A without
    cells have no row in the result. X goes to all executors if it has at most ``most`` cells, so that only A's cells and
    one sum a row and task move; else its rows are joined."""
    if a.n_cols is not None and x.n_rows is not None:
        same("inner extents", a.n_cols, x.n_rows)
    small = local(x, most)
    if small is None:
        met = a.df.join(x.df.select(F.col("row").alias("col"), "vec"), "col")
        return Dense(sum_rows(met.select("row", "vec", "val")), a.n_rows, x.n_cols)
    told = a.df.sparkSession.sparkContext.broadcast(small)

    def scaled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), ROWS_AT_ONCE):
                row, col, val = (c.to_numpy(zero_copy_only=False) for c in batch.slice(at, ROWS_AT_ONCE).columns)
                there = col < len(told.value)
                yield pa.RecordBatch.from_arrays([pa.array(row[there]), as_vectors(told.value[col[there]] * val[there, None])], ["row", "vec"])

    cells = a.df.select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.col("val").cast("double").alias("val"))
    partial = cells.sortWithinPartitions("row").mapInArrow(lambda batches: summed(scaled(batches)), ROWS)
    return Dense(sum_partial(partial), a.n_rows, x.n_cols)


def dense_spmm(x: Dense, a: Coo) -> Dense:
    """Dense X times sparse A, by cells; columns of A without cells are 0."""
    n_cols = a.shape()[1]
    cells = spgemm(Coo(x.cells()), a).df
    return Dense(dense_of(cells, n_cols), x.n_rows, n_cols)


def scale_cols(a: Coo, w: DataFrame) -> Coo:
    """A diag(w) for w (idx, val): cells whose column has no weight vanish, as do those of weight 0."""
    w = w.select(F.col("idx").alias("col"), F.col("val").alias("w")).where("w != 0")
    return Coo(a.df.join(w, "col").select("row", "col", (F.col("val") * F.col("w")).alias("val")), a.n_rows, a.n_cols)


def scale_rows(a: Coo, w: DataFrame) -> Coo:
    """diag(w) A."""
    return transpose(scale_cols(transpose(a), w))


def add(a: Coo, b: Coo) -> Coo:
    return dedupe(Coo(a.df.unionByName(b.df), a.n_rows, a.n_cols), F.sum)


def hadamard(a: Coo, b: Coo) -> Coo:
    right = b.df.select("row", "col", F.col("val").alias("y"))
    return Coo(a.df.join(right, ["row", "col"]).select("row", "col", (F.col("val") * F.col("y")).alias("val")), a.n_rows, a.n_cols)


def diagonal(a: Coo) -> DataFrame:
    """idx, val of the diagonal's cells; equal cells are summed."""
    return a.df.where("row = col").groupBy(F.col("row").alias("idx")).agg(F.sum("val").alias("val"))


def row_sum(a: Coo) -> DataFrame:
    return a.df.groupBy(F.col("row").alias("idx")).agg(F.sum("val").alias("val"))


def col_sum(a: Coo) -> DataFrame:
    return a.df.groupBy(F.col("col").alias("idx")).agg(F.sum("val").alias("val"))


def nonzero(a: Coo) -> Coo:
    return Coo(a.df.where("val != 0"), a.n_rows, a.n_cols)


def block_offset(block: int, extent: int, blocks: int) -> int:
    """The first global index of a block when an extent is split evenly and the last block takes what is left over."""
    return block * (extent // blocks)


def block_of(index: str, extent: int, blocks: int) -> Column:
    """The block that owns a global index when an extent is split evenly and the last block takes what is left over."""
    return F.least(F.floor(F.col(index) / F.lit(max(1, extent // blocks))), F.lit(blocks - 1)).cast("int")
