"""A corpus pipeline over documents: language, exact and near duplicates, mixing, packing.

Rows are known by a 64-bit hash of what decides on them, never by doc_id alone, so rows without a doc_id or with a repeated
one are judged one by one. Extra columns, of whatever names, go along unchanged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hyperloom.llm import components, dedup, language, mixing, packing, simhash
from hyperloom.llm.rules import words_of
from hyperloom.llm.shared import keep_ids, lookup, small_batches, stored

#: Copies of a document that one row of an intermediate result makes at most.
CHUNK = 1024


def _fresh(docs: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``docs`` has it."""
    while name in (c.lower() for c in docs.columns):
        name += "_"
    return name


def _without(docs: DataFrame, key: Column, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose ``key`` isn't among the stored ``ids``."""
    name = _fresh(docs, "row_key")
    return keep_ids(docs.withColumn(name, key), ids, name, keep=False).select(*docs.columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: rows in no known language go.

    Null, empty and blank texts are in none and go; null lang is no declaration, null sources are one host; equal rows get
    the same decision; long texts are read whole; an empty table stays empty.
    """
    small_batches(spark)
    key = F.xxhash64("doc_id", "text", "lang", "source")
    found = language.identify(docs.select(key.alias("doc_id"), "text", "lang", "source"))
    return _without(docs, key, stored(found.where("NOT kept").select("doc_id").distinct(), "rejected"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2 against a new index: of equal texts one row stays.

    That is the one with the most code points, then the smallest doc_id (null last). Null counts as empty. Of rows that
    are equal in doc_id, text without white space and length one stays. An empty table stays empty.
    """
    index = dedup.DigestIndex(spark)
    found = stored(index.deduplicate(docs.select("doc_id", "text")).select("doc_id", "kept", "text_sha256", "n_chars"), "found")
    index.drop()
    again = stored(found.groupBy("doc_id").count().where("count > 1 AND doc_id IS NOT NULL").select("doc_id"), "again")
    stays = found.where("kept")
    plain = keep_ids(docs, stored(keep_ids(stays, again, keep=False).select("doc_id"), "stays"))
    rare = docs.where("doc_id IS NULL").unionByName(keep_ids(docs, again))
    name, size, known = (_fresh(docs, x) for x in ("text_digest", "text_size", "stays_id"))
    rare = rare.withColumn(name, dedup.digest()).withColumn(size, F.length(F.coalesce("text", F.lit(""))).cast("long"))
    ids = stays.select(F.col("doc_id").alias(known), F.col("text_sha256").alias(f"{name}2"), F.col("n_chars").alias(f"{size}2"))
    same = rare["doc_id"].cast("long").eqNullSafe(ids[known]) & (rare[name] == ids[f"{name}2"]) & (rare[size] == ids[f"{size}2"])
    rare = rare.join(ids, same, "left_semi").dropDuplicates(["doc_id", name])
    return plain.unionByName(rare.select(*docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3, and texts whose five-word shingles are 0.8 similar: of each group one document stays.

    Fingerprints that operator 3 links and texts that ``simhash.similar`` finds make groups, directly or over others; of a
    group the row with the smallest doc_id stays (null last, then by a hash of the text). Null, empty and blank texts are
    one group. Rows equal in doc_id and text stay or go together. An empty table stays empty.
    """
    small_batches(spark)
    key = F.xxhash64("doc_id", "text")
    own = docs.select(key.alias("doc_id"), "text")
    groups = stored(simhash.near_duplicates(own).select("doc_id", "component_id").distinct(), "near")
    joined = simhash.similar(own, groups)
    edges = groups.select(F.col("doc_id").alias("a"), F.col("component_id").alias("b"))
    named = stored(components.components(edges.union(joined.select("node", "component"))), "groups")
    named = named.union(named.select(F.col("component").alias("node"), "component").distinct())
    ids = docs.select(key.alias("node"), F.col("doc_id").isNull().alias("none"), F.col("doc_id").cast("long").alias("doc_id"))
    members = stored(ids.join(named, "node").distinct(), "members")
    first = stored(members.groupBy("component").agg(F.min(F.struct("none", "doc_id", "node")).alias("first"), F.count("*").alias("n")), "first")
    bad = lookup(members, first, "component", "n", members.count()).where("node != first.node").select("node")
    return _without(docs, key, stored(bad, "rejected"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: a row for each time that the mix takes a document; one taken in part is cut after the words taken, which
    single spaces then join, and n_chars is that of the rest.

    Rows equal in all columns are taken as copies of one: none of what the mix takes is lost. Null and blank texts have no
    words and are never taken; a null source is a source of its own; an empty table stays empty.
    """
    uid, size, words = (_fresh(docs, x) for x in ("row_key", "row_size", "row_words"))
    own = docs.withColumn(uid, F.xxhash64(*docs.columns))
    taken = mixing.mix(own.select(F.col(uid).alias("doc_id"), "source", "text")).where("taken > 0").groupBy(F.col("doc_id").alias(uid))
    copies = F.sum(F.floor(F.col("taken") / F.col("size")))
    parts = F.collect_list(F.when(F.col("taken") % F.col("size") > 0, F.col("taken") % F.col("size")))  # a source has one at most
    taken = stored(taken.agg(F.count("*").alias("n"), F.first("size").alias(size), copies.alias("copies"), parts.alias("parts")), "taken")
    again = stored(taken.where("n > 1").select(uid), "again")
    if not again.isEmpty():
        own = keep_ids(own, again, uid, keep=False).unionByName(keep_ids(own, again, uid).dropDuplicates([uid]))
    chunks = F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("copies") / CHUNK)))
    whole = taken.select(uid, size, "parts", "copies", chunks.alias("chunk"))
    times = F.array_repeat(F.col(size), F.least(F.lit(CHUNK), F.col("copies") - F.col("chunk") * CHUNK).cast("int"))
    rest = F.when(F.col("chunk") == 0, F.col("parts")).otherwise(F.array().cast("array<bigint>"))
    pieces = whole.select(uid, size, F.explode(F.concat(times, rest)).alias(words))
    rows = own.join(pieces.hint("shuffle_hash"), uid)
    cut = F.col(words) < F.col(size)
    some = F.array_join(F.slice(words_of(F.col("text")), F.lit(1), F.col(words).cast("int")), " ")
    rows = rows.withColumn("text", F.when(cut, some).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(cut, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return rows.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: every row's tokens in sequences of 2048. Null and empty texts are their end id; an empty table gives no rows."""
    return packing.pack(docs)


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mixing", mix), ("packing", pack)]

#: The text model of language ID, fingerprints and tokens can't be had in SQL; tests/llm/test_pipeline.py compares each stage
#: with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over documents; what a stage keeps is written before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
