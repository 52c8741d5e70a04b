"""From features to propagation matrices and their files."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..operators import hypergraph as H
from ..operators import sparse as S
from ..sources import csv, matrix_market
from ..sources.storage import stored
from ..types import Coo, Dense


def assemble(mvcnn: Dense | None, gvcnn: Dense | None, use: tuple[bool, bool], structure: tuple[bool, bool], k: int = 10, probabilistic: bool = True, m_prob: float = 1.0) -> tuple[Dense, Coo]:
    """The features in use, end to end, and the hyperedges of each feature whose structure is used, side by side."""
    both = (mvcnn, gvcnn)
    chosen = [x for x, on in zip(both, use) if on]
    edges = [x for x, on in zip(both, structure) if on]
    if not chosen:
        raise ValueError("no feature is used")
    if not edges:
        raise ValueError("no structure is used")
    parts = [H.incidence(stored(H.knn(x, k)), None, probabilistic, m_prob) for x in edges]
    return H.feature_concat(*chosen), H.hyperedge_concat(*parts)


@dataclass(frozen=True)
class Matrices:
    """What training needs: L and R where hyperedge weights are learnt, else their product G."""

    features: Dense
    h: Coo
    left: Coo
    right: Coo
    g: Coo | None


def matrices(features: Dense, h: Coo, variable_weight: bool = False) -> Matrices:
    h = Coo(stored(h.df), h.n_rows, h.n_cols)
    left, right = (Coo(stored(m.df), *shape) for m, shape in ((H.left_factor(h), (h.n_rows, h.n_cols)), (H.right_factor(h), (h.n_cols, h.n_rows))))
    return Matrices(features, h, left, right, None if variable_weight else Coo(stored(S.spgemm(left, right).df), h.n_rows, h.n_rows))


def write(m: Matrices, folder: str, kind: str = "parquet") -> None:
    """Features and matrices under the folder, as Parquet, CSV or Matrix Market."""
    sparse = {"DVH": m.left, "invDE_HT_DVH": m.right, **({"G": m.g} if m.g else {})}
    if kind == "parquet":
        m.features.df.write.mode("overwrite").parquet(f"{folder}/features")
        for name, x in {"H": m.h, **sparse}.items():
            x.df.write.mode("overwrite").parquet(f"{folder}/{name}")
    elif kind == "csv":
        csv.write_dense(m.features, f"{folder}/features.csv")
        for name, x in sparse.items():
            csv.write_coo(x, f"{folder}/{name}_coo.csv")
    elif kind == "mtx":
        matrix_market.write_dense(m.features, f"{folder}/features.mtx")
        for name, x in sparse.items():
            matrix_market.write_coo(x, f"{folder}/{name}.mtx")
    else:
        raise ValueError(f"no format {kind}")


def read_sparse(spark: SparkSession, path: str) -> Coo:
    """By the path's ending: .mtx, .csv, else Parquet."""
    if path.endswith(".mtx"):
        return matrix_market.read_coo(spark, path)
    return csv.read_coo(spark, path) if path.endswith(".csv") else Coo(spark.read.parquet(path))


def read_features(spark: SparkSession, path: str) -> Dense:
    if path.endswith(".mtx"):
        return matrix_market.read_dense(spark, path)
    return csv.read_dense(spark, path) if path.endswith(".csv") else Dense(spark.read.parquet(path))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    if path.endswith(".mtx"):
        from pyspark.sql import functions as F

        return matrix_market.read_dense(spark, path).df.select("row", F.get("vec", F.lit(0)).cast("int").alias("label"))
    return csv.read_labels(spark, path)
