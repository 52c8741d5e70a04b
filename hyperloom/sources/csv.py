"""CSV tables of numbers, and logs."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..types import Coo, Dense


def read_coo(spark: SparkSession, path: str) -> Coo:
    """row,col,val lines; a header or any line with a cell that isn't a number is left out."""
    cells = spark.read.text(path).select(F.split("value", ",").alias("c"))
    get = lambda i, t: F.expr(f"try_cast(trim(get(c, {i})) AS {t})")
    df = cells.select(get(0, "bigint").alias("row"), get(1, "bigint").alias("col"), get(2, "double").alias("val"))
    return Coo(df.where("row IS NOT NULL AND col IS NOT NULL AND val IS NOT NULL"))


def read_dense(spark: SparkSession, path: str) -> Dense:
    """Lines of numbers without a header; a line with a bad cell is left out, and the others keep their order as row.

    The order is that of files by name, numbers in names by value, and of lines in a file. Files are read in blocks; only
    the blocks' counts are gathered.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    vec = F.transform(F.split("value", ","), lambda x: x.try_cast("double"))
    lines = lines.select(vec.alias("vec"), "file", "block", F.monotonically_increasing_id().alias("at")).where("NOT exists(vec, x -> x IS NULL)")
    ranked = lines.withColumn("k", F.row_number().over(Window.partitionBy("file", "block").orderBy("at")) - 1)
    counts, shift, upto = lines.groupBy("file", "block").count().collect(), [], 0
    for file, block, n in sorted(counts, key=lambda c: (_by_number(c[0]), c[1])):
        shift.append((file, block, upto))
        upto += n
    before = spark.createDataFrame(shift, "file string, block long, shift long")
    return Dense(ranked.join(F.broadcast(before), ["file", "block"]).select((F.col("k") + F.col("shift")).alias("row"), "vec"), upto)


def _by_number(name: str) -> list:
    """A key that orders names with their numbers by value."""
    return [(int(x), "") if x.isdigit() else (-1, x) for x in re.split(r"(\d+)", name)]


def read_labels(spark: SparkSession, path: str, last: bool = False) -> DataFrame:
    """row, label: one integer a line, others are left out; with ``last``, the last of each line's cells."""
    d = read_dense(spark, path).df
    return (d if last else d.where("size(vec) = 1")).select("row", F.element_at("vec", F.lit(-1)).cast("int").alias("label"))


def write_coo(m: Coo, path: str) -> None:
    """Non-zero cells under the header row,col,val."""
    m.df.where("val != 0").select("row", "col", "val").write.mode("overwrite").csv(path, header=True)


def write_dense(m: Dense, path: str) -> None:
    """Rows in order, without a header."""
    m.df.orderBy("row").select(F.array_join(F.transform("vec", lambda x: x.cast("string")), ",").alias("value")).write.mode("overwrite").text(path)


def append_log(spark: SparkSession, path: str, **columns) -> None:
    """Adds a row to a log in Parquet."""
    spark.createDataFrame([tuple(columns.values())], list(columns)).coalesce(1).write.mode("append").parquet(path)


def hardware(spark: SparkSession, distributed: bool = True) -> dict:
    """What a run's hardware log holds, as this session's settings tell it."""
    get = lambda k, d: spark.conf.get(k, d)
    cores = int(get("spark.executor.cores", str(spark.sparkContext.defaultParallelism)))
    return {"distributed": distributed, "ntasks": int(get("spark.executor.instances", "1")), "tasks_per_node": 1, "cpus_per_task": cores, "mem_per_cpu": get("spark.executor.memory", get("spark.driver.memory", "1g"))}


def show(m: Coo | Dense, n: int = 20) -> str:
    """The first rows of a matrix as text, in order."""
    order = ["row", "col"] if isinstance(m, Coo) else ["row"]
    return "\n".join(str(tuple(r)) for r in m.df.select(*order, *(["val"] if isinstance(m, Coo) else ["vec"])).orderBy(*order).limit(n).collect())
