"""Dense matrices as rows (row, vec)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..types import Coo, Dense, same

#: Most cells of a matrix that is sent to all executors (8 bytes each); a larger one is joined by blocks.
MOST_CELLS = 4_000_000
#: Rows of a block where all pairs are the result, most cells of a batch of them, and least blocks of a matrix, for parallel work on small ones.
PAIR_ROWS, PAIR_CELLS, LEAST_BLOCKS = 2048, 500_000, 4
ROWS = "row long, vec array<double>"


def dense_of(cells: DataFrame, n_cols: int) -> DataFrame:
    """Rows (row, vec) of cells (row, col, val), 0 where there is none."""


    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            for at in range(0, len(batch), step):
                some = batch.slice(at, step)
                cols, vals = some.column("cols"), some.column("vals")
                out = np.zeros((len(some), n_cols))
                size = np.diff(cols.offsets.to_numpy())
                out[np.repeat(np.arange(len(some)), size), cols.flatten().to_numpy()] = vals.flatten().to_numpy()
                yield pa.RecordBatch.from_arrays([some.column("row"), as_vectors(out)], ["row", "vec"])

    step = max(1, MOST_CELLS // max(1, n_cols))
    by_row = cells.groupBy("row").agg(F.collect_list(F.struct("col", "val")).alias("c"))
    by_row = by_row.select("row", F.col("c.col").cast("array<long>").alias("cols"), F.col("c.val").cast("array<double>").alias("vals"))
    return by_row.mapInArrow(run, ROWS)


def as_array(batch: pa.RecordBatch, column: str = "vec"):
    """A batch's vectors as a matrix."""
    import numpy as np

    x = batch.column(column)
    return np.asarray(x.flatten(), "f8").reshape(len(x), -1)


def as_vectors(x) -> pa.Array:
    import numpy as np

    x = np.ascontiguousarray(x, "f8")
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))


def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up the vectors of equal rows of a partition that is sorted by row; a row may run on into the next batch."""
    import numpy as np

    row, vec = None, None
    for batch in batches:
        if not len(batch):
            continue
        rows, x = batch.column("row").to_numpy(), as_array(batch)
        first = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
        keys, sums = rows[first], np.add.reduceat(x, first, axis=0)
        if row is not None:
            if keys[0] == row:
                sums[0] += vec
            else:
                keys, sums = np.concatenate(([row], keys)), np.vstack((vec[None], sums))
        if len(keys) > 1:
            yield pa.RecordBatch.from_arrays([pa.array(keys[:-1]), as_vectors(sums[:-1])], ["row", "vec"])
        row, vec = keys[-1], sums[-1]
    if row is not None:
        yield pa.RecordBatch.from_arrays([pa.array([int(row)]), as_vectors(vec[None])], ["row", "vec"])


def sum_rows(df: DataFrame) -> DataFrame:
    """The sum of the vectors of each row, each times its val where there is one: once within the tasks at hand, then after
    a shuffle, which a hub row so crosses with one vector a task."""

    def scaled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                x = as_array(batch) * batch.column("val").to_numpy(zero_copy_only=False)[:, None]
                yield pa.RecordBatch.from_arrays([batch.column("row"), as_vectors(x)], ["row", "vec"])

    if "val" in df.columns:
        partial = df.select("row", "vec", "val").sortWithinPartitions("row").mapInArrow(lambda batches: summed(scaled(batches)), ROWS)
    else:
        partial = df.select("row", "vec").sortWithinPartitions("row").mapInArrow(summed, ROWS)
    return sum_partial(partial)


def sum_partial(partial: DataFrame) -> DataFrame:
    """The sum of the vectors of each row of sums by task."""
    return partial.repartition("row").sortWithinPartitions("row").mapInArrow(summed, ROWS)


def local(b: Dense, most: int = MOST_CELLS):
    """B as an array on the driver if it has at most ``most`` cells, else None. Absent rows are 0."""
    import numpy as np

    n, d = b.shape()
    if n * d > most:
        return None
    out = np.zeros((n, d))
    for row, vec in b.df.select("row", "vec").collect():
        out[row] += vec
    return out


def times_local(x: Dense, b, then=None) -> Dense:
    """X times an array that fits everywhere, row by row without a shuffle, in products of at most MOST_CELLS cells; ``then``
    maps a product's array."""
    same("inner extents", x.n_cols if x.n_cols is not None else len(b), len(b))
    told = x.df.sparkSession.sparkContext.broadcast(b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), step):
                some = batch.slice(at, step)
                y = as_array(some) @ told.value
                yield pa.RecordBatch.from_arrays([some.column("row"), as_vectors(then(y) if then else y)], ["row", "vec"])

    step = max(1, MOST_CELLS // max(1, b.shape[1]))
    return Dense(x.df.select("row", "vec").mapInArrow(run, ROWS), x.n_rows, b.shape[1])


def matmul(x: Dense, b: Dense, most: int = MOST_CELLS) -> Dense:
    """X times B: B goes to all executors if it has at most ``most`` cells; else by blocks.

    B is cut into bands of rows, X into bands of columns and of rows, so that no block has more than about ``most`` cells.
    Where a block of X meets its band of B, one product is made; a row's products over bands are then added up. X is
    shuffled once, B once for each band of X's rows.
    """
    small = local(b, most)
    if small is not None:
        return times_local(x, small)
    (n, d), (m, e) = x.shape(), b.shape()
    same("inner extents", d, m)
    wide = max(1, most // max(1, e))  # rows of a band of B
    tall = max(1, most // wide)  # rows of a band of X
    bands, n_tall = -(-m // wide), -(-n // tall)
    part = F.explode(F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda j: F.struct(j.alias("j"), F.slice("vec", j * wide + 1, wide).alias("vec")))).alias("p")
    left = x.df.select("row", F.floor(F.col("row") / tall).cast("int").alias("i"), part).select(F.col("row").alias("r"), "i", "p.j", F.col("p.vec").alias("u"))
    every = F.explode(F.sequence(F.lit(0), F.lit(n_tall - 1))).alias("i")
    right = b.df.select(F.col("row").cast("long").alias("k"), F.floor(F.col("row") / wide).cast("int").alias("j"), F.col("vec").alias("v"), every)

    def times(ours: pa.Table, theirs: pa.Table) -> pa.Table:
        import numpy as np

        if not len(ours) or not len(theirs):
            return pa.table({"row": pa.array([], pa.int64()), "vec": pa.array([], pa.list_(pa.float64()))})
        ours, theirs = (t.combine_chunks().to_batches()[0] for t in (ours, theirs))
        a, rows = as_array(ours, "u"), theirs.column("k").to_numpy() % wide
        band = np.zeros((a.shape[1], e))
        band[rows] = as_array(theirs, "v")
        return pa.table({"row": ours.column("r"), "vec": as_vectors(a @ band)})

    made = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(times, ROWS)
    return Dense(sum_rows(made), n, e)


def all_pairs(x: Dense, b: Dense, each, schema: str, most: int = MOST_CELLS) -> DataFrame:
    """``each(vectors, other vectors, rows, other rows)``, an array, as the last of the schema's three columns, for all pairs of a
    row of X and a row of B. The result is quadratic by definition; nothing else is.

    Each matrix is dealt into blocks of about PAIR_ROWS rows (fewer if those have over ``most`` cells), by a hash, so whatever
    its indices are. That shuffles it once; a Cartesian product then reads, for each pair of blocks, the two and nothing more.
    So neither disk nor what a task holds goes by the number of pairs, and the driver sees no rows.
    """
    names = [c.split()[0] for c in schema.split(", ")]

    def blocks(m: Dense, row: str, vec: str) -> DataFrame:
        n, d = m.df.count(), m.n_cols or m.df.agg(F.max(F.size("vec"))).first()[0] or 1
        step = max(1, min(PAIR_ROWS, most // d))
        parts = max(LEAST_BLOCKS, -(-n // step))
        df = m.df.select(F.pmod(F.xxhash64(F.col("row").cast("long")), F.lit(parts)).cast("int").alias("block"), F.col("row").cast("long").alias("row"), "vec")
        packed = df.repartitionById(parts, "block").groupBy("block").agg(F.collect_list(F.struct("row", "vec")).alias("c"))
        return packed.select(F.col("c.row").alias(row), F.col("c.vec").alias(vec))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            for i in range(len(batch)):
                a_rows, u, b_rows, v = (batch.slice(i, 1).column(c).flatten() for c in ("a", "u", "b", "v"))
                a_rows, b_rows, u, v = a_rows.to_numpy(), b_rows.to_numpy(), vectors(u), vectors(v)
                step = max(1, PAIR_CELLS // len(b_rows))
                for at in range(0, len(a_rows), step):
                    rows = a_rows[at : at + step]
                    val = each(u[at : at + step], v, rows, b_rows)
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in (np.repeat(rows, len(b_rows)), np.tile(b_rows, len(rows)), val.ravel())], names)

    def vectors(of: pa.Array):
        import numpy as np

        return np.asarray(of.flatten(), "f8").reshape(len(of), -1)

    met = blocks(x, "a", "u").crossJoin(blocks(b, "b", "v").hint("shuffle_replicate_nl"))
    return met.mapInArrow(run, schema)


def bt_cells(x: Dense, b: Dense, most: int = MOST_CELLS) -> Coo:
    """X times the transpose of B by cells, each made where its two rows meet; whole rows of the product are never put together.
    A row that X or B has twice has its products twice."""
    if x.n_cols is not None and b.n_cols is not None:
        same("columns", x.n_cols, b.n_cols)
    return Coo(all_pairs(x, b, lambda u, v, rows, others: u @ v.T, "row long, col long, val double", most), x.n_rows, b.n_rows)


def matmul_bt(x: Dense, b: Dense, most: int = MOST_CELLS) -> Dense:
    """X times the transpose of B: B goes to all executors if it has at most ``most`` cells; else rows are put together of
    cells, after rows of equal index are added up. Where cells do, bt_cells leaves that out."""
    small = local(b, most)
    if small is not None:
        return times_local(x, small.T.copy())
    n = b.shape()[0]
    met = bt_cells(Dense(sum_rows(x.df), x.n_rows, x.n_cols), Dense(sum_rows(b.df), n, b.n_cols), most)
    return Dense(dense_of(met.df, n), x.n_rows, n)


def at_matmul_local(a: Dense, b: Dense):
    """The transpose of A times B as an array, of at most MOST_CELLS cells; both have their rows partitioned alike and few
    columns: each task adds up outer products, and one small matrix a task is summed by position."""
    import numpy as np

    d, e = a.shape()[1], b.shape()[1]
    if d * e > MOST_CELLS:
        raise ValueError(f"{d} x {e} is too large for the driver: use at_matmul")
    cells = at_matmul(a, b).df.collect()
    out = np.zeros((d, e))
    for row, vec in cells:
        out[row] = vec
    return out


def at_matmul(a: Dense, b: Dense) -> Dense:
    """The transpose of A times B: rows of equal index meet in a join; a task's outer products are one matrix, whose rows
    are summed over tasks."""
    met = a.df.select("row", F.col("vec").alias("u")).join(b.df.select("row", F.col("vec").alias("v")), "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        total = None
        for batch in batches:
            if len(batch):
                part = as_array(batch, "u").T @ as_array(batch, "v")
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), as_vectors(total)], ["row", "vec"])

    return Dense(sum_rows(met.select("u", "v").mapInArrow(run, ROWS)), a.n_cols, b.n_cols)


def transpose(x: Dense) -> Dense:
    """By cells; the number of rows becomes the length of the vectors."""
    n, d = x.shape()
    cells = x.cells().select(F.col("col").alias("row"), F.col("row").alias("col"), "val")
    return Dense(dense_of(cells, n), d, n)


def _agree(a: Dense, b: Dense) -> None:
    """Raises ValueError if extents that both know differ."""
    for what, n, m in (("rows", a.n_rows, b.n_rows), ("columns", a.n_cols, b.n_cols)):
        if n is not None and m is not None:
            same(what, n, m)


def _alike(vec: Column, other: Column, result: Column) -> Column:
    """``result``, or an error where two vectors differ in length."""
    return F.when(F.size(vec) == F.size(other), result).otherwise(F.raise_error(F.lit("vectors of different lengths")))


def add(a: Dense, b: Dense) -> Dense:
    """The sum of matrices of one shape; an absent row is 0."""
    _agree(a, b)
    met = a.df.select("row", "vec").join(b.df.select("row", F.col("vec").alias("other")), "row", "full")
    both = _alike(F.col("vec"), F.col("other"), V.add("vec", "other"))
    vec = F.when(F.col("vec").isNull(), F.col("other")).when(F.col("other").isNull(), F.col("vec")).otherwise(both)
    return Dense(met.select("row", vec.alias("vec")), a.n_rows, a.n_cols)


def hadamard(a: Dense, b: Dense) -> Dense:
    """The product by cells of matrices of one shape; an absent row is 0 and stays absent."""
    _agree(a, b)
    met = a.df.select("row", "vec").join(b.df.select("row", F.col("vec").alias("other")), "row")
    return Dense(met.select("row", _alike(F.col("vec"), F.col("other"), V.hadamard("vec", "other")).alias("vec")), a.n_rows, a.n_cols)


def add_to_rows(a: Dense, w: DataFrame) -> Dense:
    """Adds w (idx, val) to all entries of row idx; rows that w leaves out stay as they are."""
    met = a.df.join(w.select(F.col("idx").alias("row"), F.col("val").alias("w")), "row", "left")
    return Dense(met.select("row", V.shift("vec", F.coalesce("w", F.lit(0.0))).alias("vec")), a.n_rows, a.n_cols)


def add_bias(a: Dense, bias) -> Dense:
    """Adds bias, by column."""
    if a.n_cols is not None:
        same("columns", a.n_cols, len(bias))
    return Dense(a.df.select("row", V.add("vec", V.literal(bias)).alias("vec")), a.n_rows, a.n_cols)


def map_rows(a: Dense, f) -> Dense:
    return Dense(a.df.select("row", f("vec").alias("vec")), a.n_rows, a.n_cols)


def row_sum(a: Dense) -> DataFrame:
    return a.df.select(F.col("row").alias("idx"), V.total("vec").alias("val"))


def col_sum(a: Dense) -> DataFrame:
    return a.cells().groupBy(F.col("col").alias("idx")).agg(F.sum("val").alias("val"))
