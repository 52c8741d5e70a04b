"""Shared storage, skew-safe lookups and row filters for the corpus operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.storage import scratch, stored

__all__ = ["HEAVY", "MOST_IDS", "SPACE", "WORD", "keep_ids", "lean", "let", "lookup", "scratch", "small_batches", "stored", "text_of", "trim"]

#: At most HEAVY keys can each hold more than 1/HEAVY of all rows, so a table of them is safe to broadcast.
HEAVY = 10_000
#: Most ids that are broadcast to filter rows; more go through a shuffle join.
MOST_IDS = 1_000_000
#: Bytes at which a batch of rows for a Python worker ends, with the row that reaches them.
BATCH = 4 << 20
#: The white space of the word rule: space and the characters 9 to 13.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def trim() -> None:
    """Gives memory that Arrow and the C library hold unused back to the machine, where the C library can."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim_heap = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim_heap:
        trim_heap(0)


def lean(run: Callable) -> Callable:
    """A function of batches that trims its worker's memory when it ends, so that reused workers stay small."""

    def trimmed(batches):
        yield from run(batches)
        trim()

    return trimmed


def small_batches(spark: SparkSession) -> None:
    """From now on a batch of long texts for a worker ends at BATCH bytes, unless the session has a bound of its own: executor
    and worker each hold a batch or two for each task, outside the heap."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, str(BATCH))


def text_of(name: str = "text"):
    """The text column; null counts as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once a row. A column named in a lambda isn't safe: where a filter is pushed
    below the projection that makes it, its expression is computed for each element."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def lookup(rows: DataFrame, by_key: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``by_key``, which has one row a key and in ``n`` the key's number of rows.

    Keys that hold at least 1/HEAVY of the ``total`` rows (so at most HEAVY of them) are joined by broadcast, where a
    hot key stays spread over all tasks; the others by shuffle, where no key can fill a task. Both inputs are read
    twice, so they should be stored. Rows with a null key drop out.
    """
    hot = F.col(n) >= max(64, -(-total // HEAVY))
    heavy, light = by_key.where(hot), by_key.where(~hot)
    names = [*rows.columns, *(c for c in by_key.columns if c != key)]
    spread = rows.join(F.broadcast(heavy), key).select(*names)
    rest = rows.join(F.broadcast(heavy.select(key)), key, "left_anti").join(light, key).select(*names)
    return spread.unionByName(rest)


def keep_ids(docs: DataFrame, ids: DataFrame, key: str = "doc_id", most: int = MOST_IDS, keep: bool = True) -> DataFrame:
    """The rows of ``docs`` whose key is (``keep``) or isn't among ``ids``, a stored frame of one column.

    Up to ``most`` ids are broadcast, after a count; more meet their rows in a shuffle hash join whose hash table holds
    ids only. Rows with a null key are never among the ids.
    """
    ids = ids.select(F.col(ids.columns[0]).alias(key)).where(F.col(key).isNotNull())
    ids = F.broadcast(ids) if ids.count() <= most else ids.hint("shuffle_hash")
    return docs.join(ids, key, "left_semi" if keep else "left_anti").select(*docs.columns)
