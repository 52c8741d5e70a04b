"""Personal data, and the terms that reveal it by co-occurrence; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import keep_ids, let, lookup, stored, text_of

#: Kinds in order, with the patterns that find them. Each finds what the plain pattern in its comment does: a start
#: within a run of the first class fails if the run's start failed, so only run starts and the end of the match before
#: are tried, and possessive loops don't back off. The time is so in proportion to the text, however long its runs.
PATTERNS = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # [0-9]([\x20-]?[0-9])+
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    # \+[0-9][\x20().0-9-]+[0-9]
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must have for a kind to be looked for.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){11}", "phone": r"\+[0-9]"}
KINDS = tuple(PATTERNS)
TERM = "term"

#: The letters that make a term.
LETTERS = r"\p{L}{3,}"
#: A term reveals an entity if so many different texts have both, if so large a share of the term's documents have the
#: entity, and if it raises the entity's probability by so many bits.
MIN_TEXTS, MIN_SHARE, MIN_BITS = 3, 0.5, 4.0

_BLOCK, _CELL = 64, 256


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def _upto(steps: Column) -> Column:
    """Running sums of an array, by blocks, so that the work is in proportion to its length."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size(steps) / _BLOCK).cast("int")), lambda b: _sum(F.slice(steps, b * _BLOCK + 1, F.lit(_BLOCK))))
    before = F.aggregate(blocks, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, F.lit(-1)) + x)))
    block = lambda i: F.floor(i / _BLOCK).cast("int")
    return let(before, lambda p: F.transform(steps, lambda _, i: F.get(p, block(i)) + _sum(F.slice(steps, block(i) * _BLOCK + 1, i % _BLOCK + 1))))


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]+", "")


def _luhn(digits: Column) -> Column:
    doubled = lambda v: F.when(v > 9, v - 9).otherwise(v)
    value = lambda i: F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int") * (i % 2 + 1)
    places = F.sequence(F.lit(0), F.length(digits) - 1)
    return _sum(F.transform(places, lambda i: doubled(value(i)))) % 10 == 0


def _valid(kind: str, hit: Column) -> Column:
    if kind == "ip":
        small = lambda p: let(F.regexp_replace(p, "^0+(?=.)", ""), lambda d: F.when(F.length(d) <= 3, d.cast("int") <= 255).otherwise(F.lit(False)))
        return F.forall(F.split(hit, r"\."), small)
    if kind == "card":
        return let(_digits(hit), lambda d: F.when(F.length(d).between(12, 19), _luhn(d)).otherwise(F.lit(False)))
    if kind == "phone":
        return F.length(_digits(hit)).between(9, 15)
    return F.lit(True)


def _matches(text: Column, kind: str, none: str) -> Column:
    """The kind's valid matches: start, kind, end and value."""
    pattern = PATTERNS[kind]

    def of(hits: Column) -> Column:
        def placed(gaps: Column) -> Column:
            length = lambda a, i: F.coalesce(F.length(F.get(a, i)), F.lit(0))
            steps = F.transform(hits, lambda h, i: length(gaps, i) + F.when(i > 0, length(hits, i - 1)).otherwise(F.lit(0)))
            made = lambda starts: F.transform(
                hits,
                lambda h, i: F.struct(
                    F.get(starts, i).alias("start"), F.lit(KINDS.index(kind)).alias("kind"), (F.get(starts, i) + F.length(h)).alias("end"), F.lower(h).alias("value"),
                ),
            )
            return let(steps, lambda s: let(_upto(s), made))

        found = let(F.split(text, pattern, -1), placed)
        return F.when(F.size(hits) > 0, F.filter(found, lambda m: _valid(kind, m["value"])))

    needed = F.contains(text, F.lit("@")) if kind == "email" else text.rlike(NEEDS[kind])
    return F.coalesce(F.when(needed, let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), of)), F.from_json(F.lit("[]"), none))


_MATCH = "array<struct<start:int,kind:int,end:int,value:string>>"


def entities(docs: DataFrame) -> DataFrame:
    """row, doc_id, text and ``found``, the matches of all kinds by start and then kind, for each row of ``docs``."""
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("_text"))
    df = df.select("doc_id", "_text", *(_matches(F.col("_text"), k, _MATCH).cast(_MATCH).alias(k) for k in KINDS))
    return df.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.col("_text").alias("text"), F.sort_array(F.concat(*KINDS)).alias("found"))


def _terms(text: Column) -> Column:
    """The hashes of a text's different terms outside addresses; no other kind has letters."""
    words = F.regexp_extract_all(F.lower(F.regexp_replace(text, PATTERNS["email"], " ")), F.lit(LETTERS), F.lit(0))
    return F.array_distinct(F.transform(words, lambda t: F.xxhash64(t)))


def _places(text: Column) -> Column:
    """All the terms of a text in order: term (its hash), start, end."""

    def placed(words: Column) -> Column:
        def at(gaps: Column) -> Column:
            steps = F.transform(words, lambda w, i: F.length(F.get(gaps, i)) + F.when(i > 0, F.length(F.get(words, i - 1))).otherwise(F.lit(0)))
            one = lambda starts: F.transform(
                words, lambda w, i: F.struct(F.xxhash64(F.lower(w)).alias("term"), F.get(starts, i).alias("start"), (F.get(starts, i) + F.length(w)).alias("end"))
            )
            return let(steps, lambda x: let(_upto(x), one))

        return let(F.split(text, LETTERS, -1), at)

    return let(F.regexp_extract_all(text, F.lit(LETTERS), F.lit(0)), placed)


def disclosures(found: DataFrame, min_texts: int = MIN_TEXTS, min_share: float = MIN_SHARE, min_bits: float = MIN_BITS) -> DataFrame:
    """term, entity, share, bits for each term that reveals an entity anywhere in its texts.

    share is P(entity | term in the document) and bits the logarithm of its ratio to P(entity), both counted over all
    rows. Equal texts count once as evidence, so that copies of a document don't make its words reveal anything.

    Counts of terms and of entities come first and leave out, before rows make pairs, only what no pair's counts could
    meet: an entity is with a term in at most all its rows and texts, so a term in more than 1 / min_share times as many
    rows has too small a share, and an entity in over 2 ** -min_bits of all rows can't gain so many bits.
    """
    all_rows = found.count()
    entity = found.select("row", F.xxhash64("text").alias("digest"), F.explode("found").alias("m"))
    entity = stored(entity.select("row", "digest", F.xxhash64("m.kind", "m.value").alias("entity")).distinct(), "entity")
    texts = entity.groupBy("entity", "digest").agg(F.count("*").alias("n")).groupBy("entity").agg(F.sum("n").alias("with_entity"), F.count("*").alias("texts"))
    texts = stored(texts.where((F.col("texts") >= min_texts) & (F.col("with_entity") <= all_rows * 2.0**-min_bits)).drop("texts"), "entities")
    sums = texts.agg(F.sum("with_entity"), F.max("with_entity")).first()
    entity = stored(lookup(entity, texts, "entity", "with_entity", sums[0] or 0), "having")
    having = stored(entity.select("row").distinct(), "rows")
    counts = found.select(F.explode(_terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("with_term"))
    counts = stored(counts.where((F.col("with_term") >= min_texts) & (F.col("with_term") * min_share <= (sums[1] or 0))), "counts")
    terms = stored(keep_ids(found, having, "row").select("row", F.explode(_terms(F.col("text"))).alias("term")), "terms")
    terms = lookup(terms, counts, "term", "with_term", terms.count())
    both = terms.join(entity, "row").where(F.col("with_term") * min_share <= F.col("with_entity"))
    both = both.groupBy("term", "entity", "with_term", "with_entity", "digest").agg(F.count("*").alias("n"))
    both = both.groupBy("term", "entity", "with_term", "with_entity").agg(F.sum("n").alias("together"), F.count("*").alias("texts"))
    share = F.try_divide("together", "with_term")
    bits = F.log2(share * F.lit(float(all_rows)) / F.col("with_entity"))
    told = both.where(F.col("texts") >= min_texts).select("term", "entity", share.alias("share"), bits.alias("bits"))
    return told.where((F.col("share") >= min_share) & (F.col("bits") >= min_bits))


def sanitisation(docs: DataFrame, **thresholds) -> DataFrame:
    """doc_id, base and spans for each row of ``docs``, both arrays of struct(start, kind, end) by start and kind, in
    code points with the end exclusive.

    base has the emails, IP addresses, card and phone numbers of the whole text. spans adds, as kind len(KINDS), the
    terms that reveal an entity by the corpus's co-occurrence counts, wherever they are, in texts without the entity too;
    a term within an email stays with it, and no other kind has letters.
    Null text counts as empty; repeated rows get the same spans; null doc_ids are kept; other columns are ignored; an
    empty table gives no rows.
    """
    found = stored(entities(docs), "entities")
    told = stored(disclosures(found, **thresholds).select("term").distinct(), "told")
    places = found.select("row", F.explode(_places(F.col("text"))).alias("t")).select("row", "t.*")
    spans = stored(keep_ids(places, told, "term").select("row", "start", "end"), "spans")
    emails = found.select("row", F.explode(F.filter("found", lambda m: m["kind"] == KINDS.index("email"))).alias("m")).select("row", "m.start", "m.end")
    spans = _clear(spans, emails).select("row", F.struct("start", F.lit(len(KINDS)).alias("kind"), "end").alias("s"))
    spans = spans.groupBy("row").agg(F.collect_list("s").alias("more"))
    base = F.transform("found", lambda m: F.struct(m["start"].alias("start"), m["kind"].alias("kind"), m["end"].alias("end")))
    df = found.select("row", "doc_id", base.alias("base")).join(spans, "row", "left")
    return df.select("doc_id", "base", F.when(F.col("more").isNull(), F.col("base")).otherwise(F.sort_array(F.concat("base", "more"))).alias("spans"))


def _clear(spans: DataFrame, taken: DataFrame) -> DataFrame:
    """The ``spans`` (row, start, end; stored) that overlap none of ``taken``. They meet by cells of _CELL characters, so that
    the work goes by the text's length, however many it has of both."""
    cell = F.explode(F.sequence(F.floor(F.col("start") / _CELL), F.floor((F.col("end") - 1) / _CELL))).alias("cell")
    there = taken.select("row", F.col("start").alias("from"), F.col("end").alias("upto"), cell)
    hit = spans.select("row", "start", "end", cell).join(there, ["row", "cell"]).where("start < upto AND from < end")
    return spans.join(hit.select("row", "start").distinct(), ["row", "start"], "left_anti").select("row", "start", "end")


def written(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    name = lambda s: F.element_at(F.array(*map(F.lit, (*KINDS, TERM))), s["kind"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s), s["start"].cast("string"), s["end"].cast("string"))), ",")


def generalised(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; a span that begins within another is part of it."""
    name = lambda s: F.element_at(F.array(*(F.lit(f"[{k.upper()}]") for k in (*KINDS, TERM))), s["kind"] + 1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    apart = lambda a, s: F.struct(s["end"].alias("at"), F.concat(a["out"], F.array(F.substring(text, a["at"] + 1, s["start"] - a["at"]), name(s))).alias("out"))
    within = lambda a, s: F.struct(F.greatest(a["at"], s["end"]).alias("at"), a["out"].alias("out"))
    done = F.aggregate(spans, start, lambda a, s: F.when(s["start"] >= a["at"], apart(a, s)).otherwise(within(a, s)))
    return let(done, lambda d: F.concat(F.array_join(d["out"], ""), F.substring(text, d["at"] + 1, F.length(text))))
