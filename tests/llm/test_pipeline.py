"""Each stage of the corpus pipeline against brute force, on awkward rows, empty tables and clashing columns."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from hyperloom.llm.tokens import vocabulary

from .common import SCHEMA, awkward, empty
from .test_dedup import fingerprint, shingles, squeezed, trees

CLASHING = ("row_key", "row_size", "row_words", "text_digest", "text_size", "stays_id", "copies", "parts", "none", "component", "taken", "uid", "first", "place", "comp", "a", "b", "count")


def clashing(df):
    return df.withColumns({c: F.lit(i) for i, c in enumerate(CLASHING) if c not in df.columns})


def counted(rows):
    return Counter(tuple(r) for r in rows)


def table(spark, rows):
    """Of (doc_id, text, lang, source)."""
    return spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], SCHEMA)


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES[:-1]])
def test_empty_tables_and_columns(spark, stage):
    for df in (empty(spark), clashing(awkward(spark))):
        out = stage(spark, df, "")
        assert out.schema.fieldNames() == df.schema.fieldNames() and [f.dataType for f in out.schema] == [f.dataType for f in df.schema]
        rows, all_rows = out.collect(), df.collect()
        assert len(rows) <= 2 * len(all_rows)
        if stage is not corpus_pipeline.mix:
            assert not counted(rows) - counted(all_rows)


def test_language_judges_rows(spark):
    """A rejected row goes though another of its doc_id is kept, and the other way round."""
    random.seed(1)
    english = [" ".join(random.choices("the of and to in that is was he for it with as his on be at by".split(), k=40)) for _ in range(40)]
    german = [" ".join(random.choices("der die und in den von zu das mit sich des auf für ist im dem nicht ein".split(), k=40)) for _ in range(40)]
    rows = [(i, t, "en", "a") for i, t in enumerate(english)] + [(i + 100, t, "de", "b") for i, t in enumerate(german)]
    odd = [(0, "?!?! ...", "en", "a"), (None, english[3], None, None), (None, " ", "en", "a"), (5, None, "en", "a"), (7, "", None, None)]
    got = counted(corpus_pipeline.language_id(spark, table(spark, rows + odd), "").select("doc_id", "text", "lang", "source").collect())
    assert got == counted(rows + [odd[1]])


def test_exact_dedup_equals_brute_force(spark):
    random.seed(2)
    texts = ["a b", "ab", "a  b", " ", None, "", "c d e", "cde ", "long " * 3000, "long " * 2999 + "long", "f"]
    rows = [(random.choice([None, 1, 2, 3, 4, 5]), random.choice(texts), random.choice(["en", None]), random.choice("xy")) for _ in range(300)]
    rows += [(100 + i, random.choice(texts), "en", "x") for i in range(50)]
    df = clashing(table(spark, rows))
    got = corpus_pipeline.exact_dedup(spark, df, "").collect()
    best = {}
    for i, t, *_ in rows:
        rank = (-len(t or ""), i is None, i or 0)
        key = squeezed(t)
        best[key] = min(best.get(key, rank), rank)
    assert len(got) == len(best) and not counted(got) - counted(df.collect())
    assert {squeezed(r.text): (-len(r.text or ""), r.doc_id is None, r.doc_id or 0) for r in got} == best
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("digest_index_")]


def near_groups(texts):
    """Brute force: the tree of each text by fingerprints and shingles."""
    prints, sets = [fingerprint(t) for t in texts], [shingles(t or "") for t in texts]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2 or sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    return trees(range(len(texts)), links)


def test_near_dedup_equals_brute_force(spark):
    """One row of each group stays, the smallest doc_id; rows without one or with a repeated one are judged by their own text."""
    random.seed(5)
    vocabulary = [f"w{i}" for i in range(2000)]
    texts = []
    for n in (8, 40, 150, 150, 700, 6000):
        base = random.choices(vocabulary, k=n)
        texts.append(" ".join(base))
        for c in range(1, 7):
            words = list(base)
            for _ in range(max(1, n * c // 100)):
                words[random.randrange(n)] = random.choice(vocabulary)
            texts.append(" ".join(words))
    texts += [None, "", " \n", "short", "Short", "quite another text"]
    ids = [random.choice([None, 7, 8]) if i % 9 == 0 else 1000 - i for i in range(len(texts))]
    df = clashing(table(spark, [(i, t, "en", "a") for i, t in zip(ids, texts)]))
    got = corpus_pipeline.near_dedup(spark, df, "").collect()
    groups = {}
    for i, root in near_groups(texts).items():
        groups.setdefault(root, []).append(i)
    number = {t: i for i, t in enumerate(texts)}
    stay = sorted(number[r.text] for r in got)
    assert len(stay) == len(groups) and not counted(got) - counted(df.collect())
    for members in groups.values():
        mine = [i for i in stay if i in members]
        least = min((ids[i] is None, ids[i] or 0) for i in members)
        assert len(mine) == 1 and (ids[mine[0]] is None, ids[mine[0]] or 0) == least
    assert 10 < len(groups) < len(texts) - 10


def test_mix_loses_no_words(spark):
    """Words out are what operator 8 takes, source by source, though rows repeat and doc_ids are null."""
    from hyperloom.llm import mixing

    random.seed(6)
    rows = [(i, " ".join(f"w{random.randrange(50)}" for _ in range(random.randint(0, 60))), "en", random.choice(["a", "a", "a", "b", "c", None])) for i in range(200)]
    rows += [rows[3]] * 7 + [rows[5]] * 2 + [(None, "one two three", "en", "a")] * 5 + [(None, None, None, "b"), (9, " ", "en", "c")]
    df = clashing(table(spark, rows))
    out = corpus_pipeline.mix(spark, df, "").collect()
    words, taken = Counter(), Counter()
    for r in out:
        words[r.source] += len((r.text or "").split())
        assert r.n_chars == len(r.text)
    for r in mixing.mix(df).where("taken > 0").collect():
        taken[r.source] += r.taken
        assert r.taken <= 2 * r.size
    exact = {s: sum(r.target for r in mixing.mix(df).select("source", "target").distinct().collect() if r.source == s) for s in taken}
    assert words == taken and all(abs(taken[s] - exact[s]) <= 1 for s in taken)
    whole = {re.sub(r"\s+", " ", r[1] or "").strip() for r in rows}
    cut = [r for r in out if " ".join(r.text.split()) not in whole]
    assert len(cut) <= 4 and all(any(w.startswith(r.text) for w in whole) for r in cut)


def test_pack_of_awkward_rows(spark):
    tokenizer = Tokenizer.from_file(vocabulary())
    df = clashing(awkward(spark))
    pieces = corpus_pipeline.pack(spark, df, "").collect()
    want = Counter()
    for r in df.collect():
        ids = np.array(tokenizer.encode(r.text or "", add_special_tokens=False).ids + [1], "<u4")
        want[r.doc_id, len(ids)] += len(ids)
    got = Counter()
    for p in pieces:
        got[p.doc_id, p.doc_tokens] += p.length
    assert got == want
    short = [p for p in pieces if p.length == p.doc_tokens == 1]
    assert short and all(p.ids_crc32 == zlib.crc32(b"\1\0\0\0") for p in short) and corpus_pipeline.pack(spark, empty(spark), "").count() == 0


def test_stages_one_after_another(spark, tmp_path):
    """run() over a small table: pieces of the documents that brute force lets through, whole or cut by the mix."""
    random.seed(7)
    words = "the of and to in that is was he for it with as his on be at by from they we say her she or an will my one all".split()
    texts = [" ".join(random.choices(words, k=random.randint(20, 80))) for _ in range(60)]
    rows = [(i, t, "en", "ab"[i % 2]) for i, t in enumerate(texts)] + [(100 + i, texts[i] + "\n", "en", "a") for i in range(9)] + [(200, "!!", "en", "a"), (201, None, None, None)]
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    groups = near_groups([t for _, t, *_ in rows[:60]])
    stay = {i + 100 if i < 9 else i for i in range(60) if i not in {k for k, v in groups.items() if k != v}}
    assert {p.doc_id for p in got} <= stay and len({p.doc_id for p in got}) > 20
    sequences = Counter()
    for p in got:
        sequences[p.sequence_id] += p.length
    assert max(sequences.values()) <= 2048
