"""The registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import classifier, dedup, html, language, mixing, packing, pii, rules, simhash, token_files
from .shared import stored


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_html(spark: SparkSession, folder: str) -> DataFrame:
    return html.extract(_table(spark, folder, "pages"))


def op2_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    index = dedup.DigestIndex(spark)
    found = index.deduplicate(_table(spark, folder, "documents"))
    index.drop()  # what is found is written apart
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op3_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, folder, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(_table(spark, folder, "documents"))


def op5_rules(spark: SparkSession, folder: str) -> DataFrame:
    entries = stored(rules.ledger(_table(spark, folder, "documents")), "ledger")
    base = ~rules.passes("base")
    return entries.select("doc_id", *rules.MEASURES[:5], base.alias("base_failed"), rules.passes().alias("kept"))


def op6_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return classifier.scores(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op7_pii(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.sanitisation(_table(spark, folder, "documents"))
    of = lambda k: F.filter("base", lambda s: s["kind"] == k)  # noqa: E731  # a second parameter would be an element's position
    counts = [F.size(of(k)).cast("long").alias(f"n_{name}") for k, name in enumerate(pii.KINDS)]
    base = F.sha2(pii.written(F.col("base")).cast("binary"), 256).alias("base_sha256")
    return found.select("doc_id", *counts, base, pii.written(F.col("spans")).alias("spans"))


def op8_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(_table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_language(spark: SparkSession, folder: str) -> DataFrame:
    return language.identify(_table(spark, folder, "documents"))


def op10_token_files(spark: SparkSession, folder: str) -> DataFrame:
    return token_files.read(spark, token_files.write(_table(spark, folder, "documents")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_html, op2_exact_dedup, op3_simhash, op4_packing, op5_rules, op6_classifier, op7_pii, op8_mixing, op9_language, op10_token_files)}


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_dedup": dedup.ORACLE, "op5_rules": rules.ORACLE, "op8_mixing": mixing.ORACLE}
