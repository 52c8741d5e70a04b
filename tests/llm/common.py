"""Awkward rows that every operator must take: nulls, empty and long texts, ties, repeats, and columns of odd names."""

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def awkward(spark):
    long = "word another thing " * 4000
    rows = [
        (1, "the cat sat on the mat and looked at the dog", "en", "a"), (2, None, "en", "a"), (3, "", None, "b"), (4, " \t\n", "de", None), (5, long, "en", "b"),
        (6, "THE cat sat on the mat and looked at the dog", "en", None), (7, "the  cat sat on\tthe mat and looked at the dog", "en", "a"), (7, "the  cat sat on\tthe mat and looked at the dog", "en", "a"),
        (None, "no id here", "fr", "c"), (None, None, None, None), (9, "x" * 3000, "en", "c"), (10, "émigré naïve 日本語 😀", "fr", "c"), (11, "a@b.cc 4242 4242 4242 4242 +1 (555) 123-4567 10.0.0.1", "xx", "d"),
        (12, "the  cat sat on\tthe mat and looked at the dog", "en", "e"),
    ]
    df = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], SCHEMA)
    return df.withColumns({c: F.lit(i) for i, c in enumerate(("fp", "digest", "row", "key", "kept", "component_id", "size", "ids", "_text", "_words", "at", "n"))})


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
