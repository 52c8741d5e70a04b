"""Column functions over arrays of doubles; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def relu(vec) -> Column:
    return F.transform(_c(vec), lambda x: F.greatest(x, F.lit(0.0)))


def relu_grad(vec) -> Column:
    """1 where strictly positive, else 0."""
    return F.transform(_c(vec), lambda x: F.when(x > 0, 1.0).otherwise(0.0))


def add(a, b) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: x + y)


def hadamard(a, b) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: x * y)


def scale(vec, by) -> Column:
    return F.transform(_c(vec), lambda x: x * by)


def shift(vec, by) -> Column:
    return F.transform(_c(vec), lambda x: x + by)


def literal(values) -> Column:
    return F.array(*(F.lit(float(v)) for v in values))


def total(vec) -> Column:
    return F.aggregate(_c(vec), F.lit(0.0), lambda a, x: a + x)


def dot(a, b) -> Column:
    return total(hadamard(a, b))


def log_sum_exp(vec) -> Column:
    """Stable for logits of any size."""
    top = F.array_max(_c(vec))
    return top + F.log(total(F.transform(_c(vec), lambda x: F.exp(x - top))))


def argmax(vec) -> Column:
    """Position of the largest entry from 0; of equal ones the first."""
    return F.array_position(_c(vec), F.array_max(_c(vec))).cast("int") - 1


def softmax(vec) -> Column:
    """exp(x - log-sum-exp); the column should come from a stored frame, as it is named often."""
    lse = log_sum_exp(vec)
    return F.transform(_c(vec), lambda x: F.exp(x - lse))


def dropout(vec, row, rate: float, seed: int, epoch: int = 0) -> Column:
    """Inverted dropout by a seeded hash of epoch, row and position, so that runs and retries agree."""
    if not 0 <= rate < 1:
        raise ValueError(f"dropout rate {rate}")
    if rate == 0:
        return _c(vec)
    kept = lambda i: F.pmod(F.xxhash64(F.lit(seed), F.lit(epoch), _c(row), i), F.lit(1_000_003)) >= int(rate * 1_000_003)
    return F.transform(_c(vec), lambda x, i: F.when(kept(i), x / (1 - rate)).otherwise(0.0))
