"""Seeded random matrices and graphs."""

from __future__ import annotations

import math

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..types import Coo, Dense

#: Sizes of the reference workload at scale 1: (rows, cols, cells) of L, R and G, and rows and cols of the features.
WORKLOAD = {"L": (12311, 24622, 246_220), "R": (24622, 12311, 246_220), "G": (12311, 12311, 863_793)}
FEATURES = (12311, 6144)


def random_sparse(spark: SparkSession, n_rows: int, n_cols: int, nnz: int, seed: int = 0) -> Coo:
    """About nnz cells at uniform places, uniform in [0, 1); equal places are drawn as one."""
    place = lambda salt, n: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(salt)), F.lit(n))
    value = F.pmod(F.xxhash64("id", F.lit(seed), F.lit(2)), F.lit(1 << 40)) / float(1 << 40)
    df = spark.range(nnz).select(place(0, n_rows).alias("row"), place(1, n_cols).alias("col"), value.alias("val"))
    return Coo(df.groupBy("row", "col").agg(F.max("val").alias("val")), n_rows, n_cols)


def random_dense(spark: SparkSession, n_rows: int, n_cols: int, mean: float = 0.0, std: float = 1.0, seed: int = 0) -> Dense:
    """Normal values, negative ones set to 0, rounded to 8 places; a hash of the place gives each, by Box and Muller."""
    unit = lambda i, salt: (F.pmod(F.xxhash64("id", i, F.lit(seed), F.lit(salt)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    normal = lambda i: F.sqrt(-2 * F.log(unit(i, 0))) * F.cos(2 * math.pi * unit(i, 1))
    vec = F.transform(F.sequence(F.lit(0), F.lit(n_cols - 1)), lambda i: F.round(F.greatest(normal(i) * std + mean, F.lit(0.0)), 8))
    return Dense(spark.range(n_rows).select(F.col("id").alias("row"), vec.alias("vec")), n_rows, n_cols)


def workload(spark: SparkSession, scale: float = 1, seed: int = 0) -> dict[str, Coo | Dense]:
    """The benchmark's inputs: rows and columns grow by the root of scale at constant density, features in rows only."""
    by = math.sqrt(scale)
    out: dict[str, Coo | Dense] = {k: random_sparse(spark, int(n * by), int(m * by), int(c * scale), seed + i) for i, (k, (n, m, c)) in enumerate(WORKLOAD.items())}
    return out | {"X": random_dense(spark, int(FEATURES[0] * by), FEATURES[1], seed=seed)}


def rmat(spark: SparkSession, scale: int, edge_factor: int = 16, seed: int = 0, a: float = 0.57, b: float = 0.19, c: float = 0.19) -> Coo:
    """An RMAT graph of 2^scale vertices: each edge takes a quadrant at each of ``scale`` levels; equal edges are summed,
    loops stay."""
    bit = lambda level: F.pmod(F.xxhash64("id", F.lit(seed), level), F.lit(1 << 30)) / float(1 << 30)
    levels = F.transform(F.sequence(F.lit(0), F.lit(scale - 1)), bit)
    number = lambda f: F.aggregate("u", F.lit(0).cast("long"), lambda acc, u: acc * 2 + F.when(f(u), 1).otherwise(0))
    df = spark.range(edge_factor << scale).select(levels.alias("u"))
    df = df.select(number(lambda u: u >= a + b).alias("row"), number(lambda u: ((u >= a) & (u < a + b)) | (u >= a + b + c)).alias("col"))
    return Coo(df.groupBy("row", "col").agg(F.count("*").cast("double").alias("val")), 1 << scale, 1 << scale)
