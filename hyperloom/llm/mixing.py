"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import WORD, stored, text_of

#: Sources by code point, null last, weigh so, repeating.
WEIGHTS = (3, 1, 2)
#: Words of the mix for each word of the corpus, and the most times that a source's words may be taken.
SHARE, EPOCHS = 1.5, 2
SEED = "mix"
#: Hex digits of a document's seeded digest that tell its bucket: 4096 buckets a source.
DIGITS = 3


def n_words(text: str = "text") -> Column:
    """Words of the whole text; null counts as empty."""
    return F.regexp_count(text_of(text), F.lit(WORD)).cast("long")


def ranked(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with its rows' global position in ``order``, from 0: sorted by ranges, of which only the counts are gathered."""
    df = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("_at", 33)
    counts, before, upto = sorted(df.groupBy(part.alias("p")).count().collect()), [], 0
    for p, n in counts:
        before.append((p, upto - (p << 33)))
        upto += n
    shift = df.sparkSession.createDataFrame(before, "_p long, _shift long")
    return df.join(F.broadcast(shift), part == F.col("_p")).withColumn(name, F.col("_at") + F.col("_shift")).drop("_at", "_p", "_shift")


def water_level(sources: DataFrame, total: float, cap: Column) -> float:
    """The level at which sources, each taking its weight times the level but no more than ``cap``, take ``total`` together.

    Sources over their cap at a level are clamped and what they leave raises the level of the others, until no more are
    clamped. Each round is one aggregation of scalars. If all are clamped, the level is infinite.
    """
    level, clamped = 0.0, -1
    while True:
        full = F.col("weight") * F.lit(level) >= cap
        n, taken, weight = sources.agg(F.count_if(full), F.coalesce(F.sum(F.when(full, cap)), F.lit(0)), F.sum(F.when(~full, F.col("weight")))).first()
        if n == clamped or not weight:
            return level if weight else float("inf")
        level, clamped = (total - float(taken)) / float(weight), n


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, seed: str = SEED) -> DataFrame:
    """doc_id, source, size, source_size, weight, target and taken for each row of ``docs``.

    size is the text's number of words (null: 0). Sources ordered by code point, null last (a source of its own), have
    ``weights`` in turn and share ``share`` times all words; a source's target stops at ``epochs`` times its words and
    the excess goes to the others by weight. Every document is taken as many whole times as the target holds its
    source; for the rest, documents are taken in the order of a seeded digest of doc_id (without one, of the text) until the
    target (rounded down) is reached, the last of them in part. Texts are counted whole, however long. Each source's taken words so equal its target rounded down, and no document
    exceeds ``epochs`` times its size. Ties of the digest (repeated or null doc_ids) go by size and text; equal rows
    are interchangeable. An empty table gives no rows; sources without words have target 0.

    A source's order is kept in 4096 buckets, so that one that holds most rows is no single task's: only the bucket in
    which the target falls is sorted.
    """
    source = F.col("source").cast("string")
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.xxhash64("text").cast("string")))
    digest = F.md5(F.concat(F.lit(seed + ":"), name))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), source.alias("source"), n_words().alias("size"), digest.alias("digest"), F.xxhash64("text").alias("tie"))
    rows = stored(rows.withColumn("key", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))).withColumn("bucket", F.conv(F.substring("digest", 1, DIGITS), 16, 10).cast("int")), "sizes")
    buckets = stored(rows.groupBy("key", "bucket").agg(F.sum("size").alias("words")), "buckets")
    sources = buckets.groupBy("key").agg(F.sum("words").alias("source_size"))
    sources = ranked(sources, [F.col("key") == "", F.col("key")], "rank")
    of_rank = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    sources = stored(sources.withColumn("weight", of_rank).drop("rank"), "sources")
    words = sources.agg(F.sum("source_size")).first()[0] or 0
    cap = F.lit(epochs) * F.col("source_size")
    level = water_level(sources, share * words, cap)
    target = F.least(F.col("weight") * F.lit(level), cap.cast("double"))
    sources = sources.withColumn("target", target).withColumn("whole", F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0)))
    sources = sources.withColumn("rest", F.floor("target") - F.col("whole") * F.col("source_size"))

    upto = W.partitionBy("key").orderBy("bucket").rowsBetween(W.unboundedPreceding, W.currentRow)
    filled = buckets.join(sources, "key").withColumn("before", F.sum("words").over(upto) - F.col("words"))
    found = rows.join(filled, ["key", "bucket"])
    cut = (F.col("before") < F.col("rest")) & (F.col("rest") < F.col("before") + F.col("words"))
    within = W.partitionBy("key", "bucket").orderBy("digest", "size", "tie").rowsBetween(W.unboundedPreceding, W.currentRow)
    extra = F.greatest(F.lit(0), F.least("size", F.col("rest") - F.col("before") - F.sum("size").over(within) + F.col("size")))
    clear = found.where(~cut).withColumn("extra", F.when(F.col("before") < F.col("rest"), F.col("size")).otherwise(0))
    both = clear.unionByName(found.where(cut).withColumn("extra", extra))
    taken = (F.col("whole") * F.col("size") + F.col("extra")).cast("long")
    return both.select("doc_id", "source", "size", "source_size", "weight", "target", taken.alias("taken"))


ORACLE = rf"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size,
  md5('{SEED}:' || CAST(doc_id AS VARCHAR)) AS digest FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS r FROM d GROUP BY source),
w AS (SELECT *, CASE r % 3 WHEN 1 THEN 3 WHEN 2 THEN 1 ELSE 2 END AS weight FROM s),
c AS (SELECT *, 2 * source_size / weight AS ratio,
  coalesce(sum(2 * source_size) OVER (ORDER BY 2 * source_size / weight, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS caps,
  sum(weight) OVER (ORDER BY 2 * source_size / weight, r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS left_weight,
  sum(source_size) OVER () AS words FROM w),
v AS (SELECT *, (1.5::DOUBLE * words::DOUBLE - caps::DOUBLE) / left_weight::DOUBLE AS level FROM c),
l AS (SELECT coalesce(arg_min(level, (ratio, r)) FILTER (ratio > level), 'inf'::DOUBLE) AS level FROM v),
t AS (SELECT source, source_size, least(weight * level, 2.0::DOUBLE * source_size) AS target FROM w, l),
p AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
x AS (SELECT d.doc_id, d.size, p.source_size, p.target, p.whole, CAST(floor(p.target) AS BIGINT) - p.whole * p.source_size AS rest,
  CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.digest ROWS UNBOUNDED PRECEDING) AS BIGINT) - d.size AS before
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, whole * size + greatest(0, least(size, rest - before)) AS taken FROM x
"""
