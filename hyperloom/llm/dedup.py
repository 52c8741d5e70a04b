"""Exact deduplication against a persistent digest index."""

from __future__ import annotations

import secrets
import weakref

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import SPACE, lookup, stored, text_of


def digest(text: str = "text"):
    """SHA-256, as hex, of the text without its white space; null counts as empty."""
    return F.sha2(F.regexp_replace(text_of(text), SPACE + "+", "").cast("binary"), 256)


def _forget(spark: SparkSession, name: str) -> None:
    if spark.sparkContext._jsc is not None:  # the session hasn't been stopped
        spark.sql(f"DROP TABLE IF EXISTS {name} PURGE")


class DigestIndex:
    """A table of the digests seen so far, bucketed and sorted by digest, in the session's warehouse.

    A batch meets it in a sort-merge join that reads the index as it lies: the index is never shuffled again, and after
    ``compact``, which writes one file a bucket, not sorted again either. ``compact`` also changes the number of buckets.
    An index without a name of the caller's is deleted with its object, so that a job that fails leaves none behind.
    """

    def __init__(self, spark: SparkSession, name: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.name = name or f"digest_index_{secrets.token_hex(8)}"
        if not name:
            weakref.finalize(self, _forget, spark, self.name).atexit = False
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")  # where a bucket is one file
        if not spark.catalog.tableExists(self.name) and spark.catalog.tableExists(f"{self.name}_compact"):
            spark.sql(f"ALTER TABLE {self.name}_compact RENAME TO {self.name}")  # compact() was cut off before its last step
        if spark.catalog.tableExists(self.name):
            told = {r.col_name: r.data_type for r in spark.sql(f"DESCRIBE EXTENDED {self.name}").collect()}
            self.buckets = int(told["Num Buckets"])
        else:
            self.append(spark.createDataFrame([], "digest binary, keep_id long, batch long"))

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self) -> None:
        """Deletes the index."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name} PURGE")

    def append(self, rows: DataFrame, name: str | None = None) -> None:
        rows = rows.repartition(self.buckets, "digest")
        rows.write.mode("append").bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(name or self.name)

    def compact(self, buckets: int | None = None) -> None:
        """Writes the index anew, one file a bucket, in ``buckets`` buckets or as many as before. If it's cut off, the index
        is the old one or, found when it is next opened, the new one."""
        self.buckets = buckets or self.buckets
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}_compact PURGE")
        self.append(self.read(), f"{self.name}_compact")
        self.drop()
        self.spark.sql(f"ALTER TABLE {self.name}_compact RENAME TO {self.name}")

    def deduplicate(self, docs: DataFrame, batch: int | None = None) -> DataFrame:
        """doc_id, keep_id, group_size, kept, text_sha256 and n_chars for each row of ``docs``, whose new digests are appended.

        Texts are equal if they are without white space; null counts as empty. Of equal texts, the row with the most
        code points stays, then that with the smallest doc_id (null last), then the first read, so that of repeated
        rows one stays. If the index knew the text before, its keep_id stands and no row stays. group_size counts the
        batch's rows. Only doc_id and text are read, texts whole, however long. An empty table gives no rows.

        ``batch`` is the caller's number of the batch, an own one for each: a job that fails after its digests were appended
        and is run again with the same number gets the answer that the first run would have got.
        """
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(digest()).alias("digest"), F.length(text_of()).cast("long").alias("n_chars"))
        rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "digests")
        best = F.min(F.struct((-F.col("n_chars")).alias("n"), F.col("doc_id").isNull().alias("null"), "doc_id", "row")).alias("best")
        groups = stored(rows.groupBy("digest").agg(best, F.count("*").alias("group_size")), "groups")
        batch = secrets.randbits(62) if batch is None else batch
        new = groups.join(self.read().select("digest").hint("merge"), "digest", "left_anti")
        self.append(new.select("digest", F.col("best.doc_id").alias("keep_id"), F.lit(batch).alias("batch")))
        decided = groups.join(self.read().hint("merge"), "digest")
        stays = F.when(F.col("batch") == batch, F.col("best.row"))
        decided = stored(decided.select("digest", "keep_id", "group_size", stays.alias("stays")), "decided")
        total = decided.agg(F.sum("group_size")).first()[0] or 0
        found = lookup(rows, decided, "digest", "group_size", total)
        kept = F.coalesce(F.col("row") == F.col("stays"), F.lit(False))
        return found.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), "n_chars")


ORACLE = rf"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '{SPACE}+', '', 'g')) AS h FROM documents),
w AS (SELECT doc_id, h, first_value(doc_id) OVER (PARTITION BY h ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
  row_number() OVER (PARTITION BY h ORDER BY n DESC, doc_id) AS r FROM t)
SELECT doc_id, keep_id, group_size, r = 1 AS kept, h AS text_sha256 FROM w
"""
