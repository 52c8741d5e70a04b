"""Quality rules as a ledger of failure bits, with versioned policies; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import SPACE, let, text_of

WINDOW = 3
SYMBOLS = "[#*$%&|<>]"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_marks")

#: Rules in the order of their bits: a rule is failed where its condition on the measurements holds.
RULES = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "symbols": "20 * n_symbols > 3 * n_words",
    "repeated_lines": "n_dup_lines > 3 AND 10 * n_dup_lines > 3 * n_lines",
    "capitals": "2 * n_upper > n_letters",
    "exclamations": "4 * n_marks > n_words",
    "word_length": "word_chars < 2 * n_words OR word_chars > 15 * n_words",
    "no_letters": "2 * n_letters < word_chars",
}
BASE = ("few_words", "repeated_words")
#: The rules that each version enforces.
POLICIES = {"base": BASE, "2": tuple(RULES)}
POLICY = "2"


def mask(rules) -> int:
    """The bits of rules."""
    return sum(1 << list(RULES).index(r) for r in rules)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE + "+"), "")


def _repeated(words: Column) -> Column:
    """Words that stand in a window of WINDOW words found twice or more, its first place included. Windows are compared by
    their 64-bit hashes, sorted; an array without a repeated window, which a hash set tells, isn't sorted."""
    none = F.lit(0).cast("long")

    def of(windows: Column) -> Column:
        def twice(pairs: Column) -> Column:
            same = lambda x, j: (F.get(pairs, j - 1)["h"] == x["h"]) | (F.get(pairs, j + 1)["h"] == x["h"])
            places = F.array_sort(F.array_compact(F.transform(pairs, lambda x, j: F.when(same(x, j), x["i"]))))
            next_ = lambda p, i: F.coalesce(F.get(p, i + 1) - F.get(p, i), F.lit(WINDOW))
            covered = lambda p: F.aggregate(F.transform(p, lambda _, i: F.least(F.lit(WINDOW), next_(p, i))), none, lambda a, x: a + x)
            return let(places, covered)

        pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(windows)) < F.size(windows), let(pairs, twice)).otherwise(none)

    starts = F.slice(words, 1, F.greatest(F.size(words) - (WINDOW - 1), F.lit(0)))
    return let(F.transform(starts, lambda w, i: F.xxhash64(w, *(F.get(words, i + k) for k in range(1, WINDOW)))), of)


def measured(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and the measurements of each row's whole text. Lines count if they have a word."""
    df = docs.select(*keep, text_of().alias("_text"))
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counts = lambda w: F.struct(F.size(w).alias("n"), F.length(F.array_join(w, "")).alias("chars"), _repeated(w).alias("repeated"))
    of_lines = lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("different"))
    df = df.withColumn("_w", let(words_of(F.col("_text")), counts)).withColumn("_l", let(lines, of_lines))
    return df.select(
        *keep,
        F.col("_w.n").cast("long").alias("n_words"),
        F.col("_w.chars").cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.col("_l.n") - F.col("_l.different")).cast("long").alias("n_dup_lines"),
        F.col("_w.repeated").alias("n_repeat_words"),
        F.col("_l.n").cast("long").alias("n_lines"),
        F.length(F.regexp_replace("_text", r"[^\p{Lu}]+", "")).cast("long").alias("n_upper"),
        F.length(F.regexp_replace("_text", r"[^\p{L}]+", "")).cast("long").alias("n_letters"),
        F.regexp_count("_text", F.lit("!")).cast("long").alias("n_marks"),
    )


def ledger(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The measurements and ``failures``, a long with a bit for each rule failed. Every rule is evaluated once; policies
    and ablations need no text.

    A null text has no words. Repeated rows have their own entries; null doc_ids are kept; other columns are ignored;
    an empty table gives no rows; texts are measured whole.
    """
    bits = [F.when(F.expr(c), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, c in enumerate(RULES.values())]
    failures = bits[0]
    for b in bits[1:]:
        failures = failures.bitwiseOR(b)
    return measured(docs, keep).withColumn("failures", failures)


def passes(policy: str = POLICY) -> Column:
    """Whether a ledger's row fails none of the policy's rules."""
    return F.col("failures").bitwiseAND(F.lit(mask(POLICIES[policy]))) == 0


def ablations(entries: DataFrame, policy: str = POLICY) -> DataFrame:
    """For each rule of the policy: rows that fail it, and rows that only it rejects, so that leaving it out would keep.

    One aggregation of the bits' combinations, of which there are at most 2 to the number of rules.
    """
    rules = POLICIES[policy]
    counts = entries.groupBy(F.col("failures").bitwiseAND(F.lit(mask(rules))).alias("bits")).agg(F.count("*").alias("n"))
    rows = F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(mask([r])).cast("long").alias("bit")) for r in rules))).alias("r")
    counts = counts.select("bits", "n", rows).select("bits", "n", "r.*")
    hit = F.col("bits").bitwiseAND(F.col("bit")) != 0
    count = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("long")
    return counts.groupBy("rule").agg(count(hit).alias("fails"), count(F.col("bits") == F.col("bit")).alias("only"))


_FAILED = " OR ".join(f"({c})" for c in RULES.values())
ORACLE = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
a AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
g AS (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM a),
h AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n FROM g),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM h, (VALUES (0), (1), (2)) v(k) WHERE h.n > 1 GROUP BY doc_id),
m AS (SELECT a.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words, len(l) AS n_lines, length(regexp_replace(text, '[^\p{{Lu}}]+', '', 'g')) AS n_upper,
  length(regexp_replace(text, '[^\p{{L}}]+', '', 'g')) AS n_letters, length(regexp_replace(text, '[^!]+', '', 'g')) AS n_marks
  FROM a LEFT JOIN r ON a.doc_id = r.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT ({_FAILED}) AS kept FROM m
"""
