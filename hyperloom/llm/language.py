"""Language identification by Bayesian fusion of text, declared language, address suffix and host."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .html import host
from .shared import lean, let, lookup, stored, text_of

#: Cells of the table of hashed byte trigrams.
CELLS = 1 << 16
#: About how many documents of each language the text model is fitted on, chosen by a hash; tasks that count them.
MOST_FIT, FIT_TASKS = 5_000, 8
#: A declared language is learnt if it has so many rows, whatever its share. Codes of two or three letters bound them.
MIN_ROWS = 10
#: Trigrams of a text overlap, so their evidence counts for this share.
TEMPER = 0.3
#: Rows that a level's parent counts for: of a host's suffix, of a suffix's whole, and of declared languages.
SMOOTH = 20.0
#: What a text's being in no known language counts before it is read.
OTHER = 0.001
#: A document is kept if its language's probability is at least this.
MIN_POSTERIOR = 0.5
UNKNOWN = "und"


def _cells(text: bytes):
    """The table cells of a text's byte trigrams, with its white space as single spaces and A-Z lowered."""
    import numpy as np

    raw = np.frombuffer(b" " + b" ".join(text.lower().split()) + b" ", "u1").astype("u4")
    return ((raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:]) * np.uint32(2654435761)) >> np.uint32(16)


def _prepared(docs: DataFrame, declared: str, site: Column, url: str | None) -> DataFrame:
    name = F.lower(F.regexp_extract(F.coalesce(F.col(declared).cast("string"), F.lit("")), "^[A-Za-z]{2,3}(?![A-Za-z])", 0))
    suffix = F.regexp_extract(host(url), r"\.([a-z]+)$", 1) if url else F.lit("")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"), name.alias("declared"), F.coalesce(site.cast("string"), F.lit("")).alias("host"), suffix.alias("suffix"))


class Model:
    """For each language the logarithms of the cells' probabilities less those of an even spread: a base, and what a cell
    that the language has adds to it. Kept by cell, so that size and work go by the cells seen, not by all languages."""

    def __init__(self, n: int, lang, cell, count) -> None:
        import numpy as np

        order = np.argsort(cell, kind="stable")
        self.n, self.lang = n, lang[order].astype("i4")
        total = np.bincount(lang, weights=count, minlength=n) + 0.5 * CELLS
        self.base = np.log(0.5 / total) + math.log(CELLS)
        self.more = np.log((count[order] + 0.5) / 0.5).astype("f4")
        self.start = np.searchsorted(cell[order], np.arange(CELLS + 1))

    def likely(self, text: bytes):
        import numpy as np

        seen = np.bincount(_cells(text), minlength=CELLS)
        at = np.flatnonzero(seen)
        out = self.base * seen[at].sum()
        for i in range(0, len(at), 4096):
            some = at[i : i + 4096]
            n = self.start[some + 1] - self.start[some]
            j = np.arange(n.sum()) + np.repeat(self.start[some] - np.cumsum(n) + n, n)
            out += np.bincount(self.lang[j], weights=self.more[j] * np.repeat(seen[some], n), minlength=self.n)
        return out


def fit(rows: DataFrame, most: int = MOST_FIT) -> tuple[list[str], Model]:
    """The declared languages, and the model of their texts, from about ``most`` documents of each."""
    import numpy as np

    counts = dict(rows.where("declared != ''").groupBy("declared").count().where(F.col("count") >= MIN_ROWS).collect())
    names = sorted(counts)
    if not names:
        return [], Model(0, *(np.zeros(0, "i8") for _ in range(3)))
    space = 1 << 40
    shares = rows.sparkSession.createDataFrame([(x, i, space * most // max(most, counts[x])) for i, x in enumerate(names)], "declared string, i long, below long")
    sample = rows.join(F.broadcast(shares), "declared").where(F.pmod(F.xxhash64("doc_id", "text", F.lit("fit")), F.lit(space)) < F.col("below"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums of what comes, given out whenever they are many."""
        keys, total = np.zeros(0, "i8"), np.zeros(0, "i8")
        for batch in batches:
            new, held = [np.zeros(0, "i8")], 0
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()).to_pylist()):
                new.append(_cells(text).astype("i8") + i * CELLS)
                held += len(new[-1])
                if held > 1 << 18:
                    keys, total = _added(keys, total, new)
                    new, held = [np.zeros(0, "i8")], 0
            keys, total = _added(keys, total, new)
            if len(keys) > 1 << 19:
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(total)], ["key", "n"])
                keys, total = np.zeros(0, "i8"), np.zeros(0, "i8")
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(total)], ["key", "n"])

    table = sample.select("i", "text").repartition(FIT_TASKS).mapInArrow(lean(count), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    key, n = (table.column(c).to_numpy() for c in ("key", "n"))
    return names, Model(len(names), key // CELLS, key % CELLS, n)


def _added(keys, total, new: list):
    """Sorted keys and their totals, with one more for each of ``new``."""
    import numpy as np

    more, times = np.unique(np.concatenate(new), return_counts=True)
    every, at = np.unique(np.concatenate((keys, more)), return_inverse=True)
    return every, np.bincount(at, weights=np.concatenate((total, times)), minlength=len(every)).astype("i8")


def _votes(seen: DataFrame, *keys: str) -> DataFrame:
    """keys, n and votes: the rows, and the number of votes for each language that has any."""
    each = seen.groupBy(*keys, "vote").agg(F.count("*").alias("c"))
    votes = F.map_from_entries(F.collect_list(F.when(F.col("vote").isNotNull(), F.struct("vote", "c"))))
    return each.groupBy(*keys).agg(F.sum("c").alias("n"), votes.alias("votes"))


def _smoothed(n: int, parent: Column) -> Column:
    """Of the column votes each language's share, smoothed by the array ``parent``."""
    total = F.aggregate(F.map_values("votes"), F.lit(0).cast("long"), lambda a, x: a + x)
    share = lambda t: F.transform(parent, lambda p, i: (F.coalesce(F.try_element_at("votes", i), F.lit(0)) + SMOOTH * p) / (t + SMOOTH))
    return let(total, share)


def identify(docs: DataFrame, declared: str = "lang", site: Column | None = None, url: str | None = None, most: int = MOST_FIT) -> DataFrame:
    """doc_id, lang, posterior, declared_lang, text_lang and kept for each row of ``docs``.

    The text gives each language a likelihood from its byte trigrams, learnt from documents that declare it. A text's
    likeliest language is a vote; votes are counted over all rows, and smoothed from the whole to address suffixes to
    hosts (``site``, or the column source), to give each host its prior, and to tell how far a declaration is to be
    trusted. The four are multiplied. A text without a letter or digit, or likelier in no known language, is "und", and
    isn't kept; nor is one whose language stays below MIN_POSTERIOR.

    Null text counts as empty, null declarations as none, null hosts as one host; repeated rows get the same answer;
    other columns are ignored; an empty table gives no rows, and without declarations every row is "und".
    """
    rows = _prepared(docs, declared, F.col("source") if site is None else site, url)
    names, fitted = fit(rows, most)
    spark = docs.sparkSession
    told = spark.sparkContext.broadcast(fitted)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = told.value
        for batch in batches:
            found = [model.likely(text) * TEMPER for text in batch.column(1).cast(pa.large_binary()).to_pylist()]
            columns = [batch.column(0), pa.array(found, pa.list_(pa.float64())), *(batch.column(i) for i in (2, 3, 4, 5))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "likely", "declared", "host", "suffix", "legible"])

    legible = rows.withColumn("legible", F.col("text").rlike(r"[\p{L}\p{N}]"))
    seen = legible.mapInArrow(lean(read), "doc_id long, likely array<double>, declared string, host string, suffix string, legible boolean")
    top = F.array_max("likely")
    vote = F.when(F.col("legible") & (top > math.log(OTHER)), F.array_position("likely", top).cast("int") - 1)
    seen = stored(seen.withColumn("vote", vote), "likelihoods")
    n = len(names)
    if not n:
        none = [F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("posterior"), F.col("declared").alias("declared_lang"), F.lit(UNKNOWN).alias("text_lang"), F.lit(False).alias("kept")]
        return seen.select("doc_id", *none)

    whole = dict(seen.where("vote IS NOT NULL").groupBy("vote").count().collect())
    whole = [(whole.get(i, 0) + 1) / (sum(whole.values()) + n) for i in range(n)]
    suffixes = _votes(seen, "suffix").select("suffix", _smoothed(n, F.lit(whole)).alias("of_suffix"))
    hosts = stored(_votes(seen, "host", "suffix").withColumn("at", F.xxhash64("host", "suffix")), "hosts")
    per_suffix = hosts.groupBy("suffix").agg(F.count("*").alias("hosts"))
    suffixes = stored(suffixes.join(per_suffix, "suffix"), "suffixes")
    hosts = lookup(hosts, suffixes, "suffix", "hosts", hosts.count())
    hosts = stored(hosts.select("at", "n", _smoothed(n, F.col("of_suffix")).alias("prior")), "priors")
    rows = stored(seen.withColumn("at", F.xxhash64("host", "suffix")).drop("host", "suffix"), "seen")
    total = hosts.agg(F.sum("n")).first()[0] or 0
    rows = lookup(rows, hosts, "at", "n", total)

    said = seen.where(F.col("declared").isin(names) & F.col("vote").isNotNull()).groupBy("declared", "vote").count().collect()
    said = {(d, i): c for d, i, c in said}
    given = [SMOOTH + sum(said.get((d, i), 0) for d in names) for i in range(n)]
    trust = [(d, [math.log((said.get((d, i), 0) + SMOOTH * (0.9 if d == names[i] else 0.1 / max(1, n - 1))) / given[i]) for i in range(n)]) for d in names]
    rows = rows.join(F.broadcast(spark.createDataFrame(trust, "declared string, trust array<double>")), "declared", "left")
    logs = F.transform("likely", lambda x, i: x + F.log(F.get("prior", i)) + F.coalesce(F.get("trust", i), F.lit(0.0)))
    rows = rows.withColumn("logs", F.concat(logs, F.array(F.lit(math.log(OTHER) - math.log(n)))))
    rows = rows.withColumn("best", F.array_max("logs"))
    rows = rows.withColumn("all", F.aggregate(F.transform("logs", lambda x: F.exp(x - F.col("best"))), F.lit(0.0), lambda a, x: a + x))
    name = F.array(*map(F.lit, [*names, UNKNOWN]))
    lang = F.when(F.col("legible"), F.get(name, F.array_position("logs", F.col("best")).cast("int") - 1)).otherwise(F.lit(UNKNOWN))
    rows = rows.withColumn("lang", lang).withColumn("posterior", F.when(F.col("legible"), 1 / F.col("all")).otherwise(F.lit(0.0)))
    kept = (F.col("lang") != UNKNOWN) & (F.col("posterior") >= MIN_POSTERIOR)
    text_lang = F.coalesce(F.get(name, F.col("vote")), F.lit(UNKNOWN))
    return rows.select("doc_id", "lang", "posterior", F.col("declared").alias("declared_lang"), text_lang.alias("text_lang"), kept.alias("kept"))
