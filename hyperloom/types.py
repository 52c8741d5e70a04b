"""Matrices as relations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Coo:
    """A sparse matrix: df has row, col (longs from 0) and val; absent cells are 0. Rows and columns may be None until asked for."""

    df: DataFrame
    n_rows: int | None = None
    n_cols: int | None = None

    def shape(self) -> tuple[int, int]:
        """Known numbers of rows and columns, or one more than the largest indices."""
        if self.n_rows is None or self.n_cols is None:
            r, c = self.df.agg(F.max("row"), F.max("col")).first()
            return self.n_rows or (0 if r is None else r + 1), self.n_cols or (0 if c is None else c + 1)
        return self.n_rows, self.n_cols

    def nnz(self) -> int:
        return self.df.count()


@dataclass(frozen=True)
class Dense:
    """A dense matrix: df has row and vec, an array of doubles, all of one length. Row order is the column row, never position."""

    df: DataFrame
    n_rows: int | None = None
    n_cols: int | None = None

    def shape(self) -> tuple[int, int]:
        if self.n_rows is None or self.n_cols is None:
            r, c = self.df.agg(F.max("row"), F.max(F.size("vec"))).first()
            return self.n_rows or (0 if r is None else r + 1), self.n_cols or (c or 0)
        return self.n_rows, self.n_cols

    def cells(self) -> DataFrame:
        """row, col, val of every cell."""
        return self.df.select("row", F.posexplode("vec").alias("col", "val")).select("row", F.col("col").cast("long").alias("col"), "val")


def same(what: str, a: int, b: int) -> None:
    """Raises ValueError unless two extents agree."""
    if a != b:
        raise ValueError(f"{what}: {a} and {b}")
