"""Timed products of the reference workload's shapes."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators import dense, sparse
from ..sources import generate
from ..sources.csv import append_log
from ..sources.storage import stored
from ..types import Coo, Dense


def timed(spark: SparkSession, kind: str, scale: float, product: Callable[[], DataFrame], iterations: int = 10, log: str | None = None) -> list[float]:
    """Milliseconds of each iteration of a product, evaluated whole; appended to the log by run, scale and iteration."""
    run_id, took = uuid.uuid4().hex, []
    for i in range(iterations):
        began = time.perf_counter()
        product().write.format("noop").mode("overwrite").save()
        took.append(1000 * (time.perf_counter() - began))
        if log:
            append_log(spark, log, run_id=run_id, kind=kind, scale=float(scale), iteration=i, ms=took[-1])
    return took


def products(spark: SparkSession, scale: float = 1, iterations: int = 10, log: str | None = None, width: int | None = None) -> dict[str, list[float]]:
    """Dense times dense (X times its transpose), and sparse times dense (G X), at a scale; ``width`` narrows X."""
    made = generate.workload(spark, scale)
    g, x = made["G"], made["X"]
    if width is not None:
        x = generate.random_dense(spark, x.n_rows, width)
    g, x = Coo(stored(g.df), g.n_rows, g.n_cols), Dense(stored(x.df), x.n_rows, x.n_cols)
    return {
        "dense": timed(spark, "dense", scale, lambda: dense.matmul_bt(x, x).df, iterations, log),
        "sparse": timed(spark, "sparse", scale, lambda: sparse.spmm(g, x).df, iterations, log),
    }
