"""Main text of web pages by removal of site templates."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .html_tree import kept_blocks, read
from .shared import lean, stored

#: A subtree is a template if it is on at least so many different pages of its host, however many pages the host has.
MIN_PAGES = 4
#: Most template hashes that are broadcast (8 bytes each); more reach their pages in a join.
MOST_TEMPLATES = 2_000_000


def host(url: str = "url"):
    """The lower-case host of an address; null or none: empty."""
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))


def _subtrees(pages: DataFrame) -> DataFrame:
    """uid, host, key, main for each element subtree of each page; key hashes host and subtree, main the main text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        signed = lambda x: x - (1 << 64) if x >> 63 else x
        for batch in batches:
            uid, hosts, keys, mains = [], [], [], []
            for u, h, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                page = read(html)
                main = signed(xxh64_intdigest("\n".join(kept_blocks(page, ())).encode("utf-8", "replace")))
                site = xxh64_intdigest(h.encode())
                own = {signed(xxh64_intdigest(s[1].to_bytes(8, "little"), site)) for s in page.subtrees}
                keys += own
                uid += [u] * len(own)
                hosts += [signed(site)] * len(own)
                mains += [main] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (uid, hosts, keys, mains)], ["uid", "host", "key", "main"])

    return pages.select("uid", "host", "html").mapInArrow(lean(run), "uid long, host long, key long, main long")


def templates(subtrees: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """The keys of subtrees that recur across pages of their host. Pages with one and the same main text count once, so
    that copies of a page don't make its text a template."""
    counts = subtrees.select("host", "key", "main").distinct().groupBy("host", "key").agg(F.count("*").alias("pages"))
    return counts.where(F.col("pages") >= min_pages).select("key")


def extract(pages: DataFrame, min_pages: int = MIN_PAGES, most: int = MOST_TEMPLATES) -> DataFrame:
    """page_id, url, text and n_chars for each row of ``pages``: the main text of the whole html.

    Element subtrees are hashed and counted per host over all pages; those on many different pages of the host are
    deleted, as are menus, headers, footers, sidebars, notices, adverts, forms, comments, scripts and styles told by
    element, role or class. Character references are decoded, white space in a block becomes one space, blocks are
    joined by one. Null and empty html give an empty text; null and odd urls share the empty host; repeated rows give
    the same text; other columns are ignored; an empty table gives no rows.

    Up to ``most`` template keys are broadcast after a count; more are joined to their pages by a shuffle.
    """
    spark = pages.sparkSession
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), host().alias("host"))
    rows = rows.withColumn("uid", F.xxhash64("page_id", "url", "html"))
    found = stored(_subtrees(rows), "subtrees")
    recurring = stored(templates(found, min_pages), "templates")
    n = recurring.count()
    told = None
    if n <= most:
        told = spark.sparkContext.broadcast(sorted(r[0] for r in recurring.toLocalIterator()))
        rows = rows.withColumn("keys", F.lit(None).cast("array<long>"))
    else:
        hits = found.join(recurring, "key")
        hits = hits.groupBy("uid").agg(F.collect_set("key").alias("keys"))
        rows = rows.join(hits, "uid", "left").select(*rows.columns, "keys")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        from xxhash import xxh64_intdigest

        known = np.array(told.value, "i8") if told else None
        for batch in batches:
            texts = []
            for h, html, own in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4))):
                page = read(html)
                site = xxh64_intdigest((h or "").encode())
                keys = np.array([xxh64_intdigest(s[1].to_bytes(8, "little"), site) for s in page.subtrees], "u8").view("i8")
                there = keys if known is None else known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] if len(known) else keys + 1
                hit = there == keys if known is not None else np.isin(keys, np.array(own or [], "i8"))
                texts.append(" ".join(kept_blocks(page, {s[1] for s, x in zip(page.subtrees, hit) if x})))
            columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    return rows.select("page_id", "url", "host", "html", "keys").mapInArrow(lean(run), "page_id long, url string, text string, n_chars long")
