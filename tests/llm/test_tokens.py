import io
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from hyperloom.llm import packing, token_files
from hyperloom.llm.eliasfano import EliasFano, TokenFile, TokenFileWriter
from hyperloom.llm.tokens import WordEncoder, vocabulary

from .common import awkward, empty


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(vocabulary())


def test_words_give_the_ids_of_whole_texts(tokenizer):
    random.seed(2)
    letters = "aéΣİ'’.!1٣ \tǅß日́̇<|>sStT‍😀½"
    texts = ["".join(random.choice(letters) for _ in range(random.randint(0, 40))) for _ in range(3000)]
    texts += ["<|endoftext|> <|ENDOFTEXT|> a<|endoftext|>b", "a" * 5000 + "!" * 3000, "don't we'll 's ''s", "a\x1cb\x85c d"]
    got = list(WordEncoder(vocabulary()).encode(pa.array([*texts, None])))
    for t, ids in zip(texts, got):
        assert np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() == bytes(ids), t
    assert not bytes(got[-1])


def ids_of(tokenizer, text, end):
    return np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [end], "<u4")


def test_packing(spark, tokenizer):
    rows = awkward(spark).where("doc_id IS NOT NULL AND doc_id != 7").union(awkward(spark).where("doc_id = 5").selectExpr("doc_id + 100", "repeat(text, 3)", *awkward(spark).columns[2:]))
    texts = {r.doc_id: ids_of(tokenizer, r.text, 1) for r in rows.collect()}
    pieces = packing.pack(rows, with_ids=True).collect()
    assert set(texts) == {p.doc_id for p in pieces}
    for doc, ids in texts.items():
        at = 0
        for p in sorted((p for p in pieces if p.doc_id == doc), key=lambda p: p.start):
            part = ids[at : at + p.length]
            assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(part.tobytes()) and p.ids == part.tolist()
            at += p.length
        assert at == len(ids)
    bins = {}
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == bins.get(p.sequence_id, 0)
        bins[p.sequence_id] = p.offset + p.length
    assert max(bins.values()) <= 2048 and sum(n < 1900 for n in bins.values()) <= rows.rdd.getNumPartitions()
    assert packing.pack(awkward(spark)).where("doc_id IS NULL").count() == 2 and packing.pack(empty(spark)).count() == 0


def test_packing_holds_little_at_once(spark):
    """Closed bins keep no ids, and batches of long texts end with the row that reaches a number of bytes."""
    bins = packing.HarmonicBins(2048, 0, lambda ids: None)
    closed = [p for i in range(50) for p in bins.add(i, 0, bytes(8192), 2048)]
    assert len(closed) == 50 and {p[2:4] for p in closed} == {(2048, zlib.crc32(bytes(8192)))} and {p[7] for p in closed} == {None}
    docs = spark.range(40, numPartitions=1).selectExpr("id AS doc_id", "repeat('ab cd ', IF(id = 9, 1000000, 50000)) AS text")
    pieces = packing.pack(docs).groupBy("doc_id").sum("length").collect()
    assert len(pieces) == 40 and len({p[1] for p in pieces}) == 2
    sizes = docs.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [len(b)], "b": [b.nbytes]}) for b in batches), "n long, b long").collect()
    assert sum(r.n for r in sizes) == 40 and all(r.b < (4 << 20) + 6_100_000 for r in sizes) and len(sizes) > 2


def test_class_plans_fill_bins():
    plans = packing.slots(2048, packing.PAD_SHARE)
    for rest, plan in enumerate(plans):
        assert sum(plan) == rest and all(n * (2048 // n) >= 2048 * 0.96 for n in plan)


@pytest.mark.parametrize("values", [[], [0], [0, 0, 0], [0, 5, 5, 9, 1000], list(range(300)), [0, 10**12]])
def test_elias_fano(values):
    e = EliasFano.of(values)
    assert [e.select(i) for i in range(len(values))] == values == e.all().tolist()
    with pytest.raises(IndexError):
        e.select(len(values))


def test_elias_fano_is_small():
    rng = np.random.default_rng(0)
    values = np.concatenate(([0], np.cumsum(rng.integers(1, 2000, 20_000))))
    e = EliasFano.of(values)
    assert (e.all() == values).all() and all(e.select(int(i)) == values[i] for i in rng.integers(0, len(values), 500))
    assert e.size() * 8 / len(values) < 2 + np.log2(values[-1] / len(values)) + 2


class Sink(io.BytesIO):
    def close(self):
        pass

    def read_at(self, n, at):
        return self.getvalue()[at : at + n]


@pytest.mark.parametrize("wide", [False, True])
def test_file_round_trip(wide):
    sink = Sink()
    w = TokenFileWriter(sink, wide)
    docs = [(None, [1]), (3, []), (4, [65_535, 0, 7]), (-1, [70_000] if wide else [9])]
    for key, ids in docs:
        w.add(key, np.array(ids, "<u4"))
    w.close()
    f = TokenFile(sink, len(sink.getvalue()))
    assert [(k, f.ids(i).tolist()) for i, k in enumerate(f.keys)] == docs
    with pytest.raises(ValueError):
        TokenFile(Sink(b"x" * 40), 40)


def test_token_files(spark, tokenizer):
    df = awkward(spark)
    got = token_files.read(spark, token_files.write(df.repartition(3))).collect()
    want, at = [], 0
    rows = sorted(df.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    starts = {}
    for r in rows:
        ids = ids_of(tokenizer, r.text, 2)
        want.append((r.doc_id or 0, len(ids), zlib.crc32(ids.tobytes())))
        starts.setdefault(r.doc_id, at)
        at += len(ids)
    assert sorted((r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in got) == sorted(want)
    for key, first in starts.items():
        assert min(r.start for r in got if r.doc_id == key) == first
    ends = sorted((r.start, r.start + r.n_tokens) for r in got)
    assert all(a[1] == b[0] for a, b in zip(ends, ends[1:]))
    assert token_files.read(spark, token_files.write(empty(spark))).count() == 0


def test_files_are_read_in_blocks():
    sink = io.BytesIO()
    sink.close, kept = (lambda: None), []
    writer = TokenFileWriter(sink, False)
    for k in range(50):
        kept.append((k if k % 7 else None, np.arange(k * 3 % 11, dtype="u4")))
        writer.add(*kept[-1])
    writer.close()
    data = sink.getvalue()

    class Source:
        reads = 0

        def read_at(self, n, at):
            self.reads += 1
            return data[at : at + n]

    for most in (1, 20, 1 << 20):
        source = Source()
        file = TokenFile(source, len(data))
        before, source.reads = 0, 0
        for (key, ids), (k, start, got) in zip(kept, file.documents(most), strict=True):
            assert (k, start, got.tolist()) == (key, before, ids.tolist())
            before += len(ids)
        assert source.reads <= 50 and (most < 1 << 20 or source.reads == 1)


def test_the_memo_starts_anew(tokenizer, monkeypatch):
    """Ids are the same whatever the memo holds, for words of letters that normalising splits too."""
    from hyperloom.llm import tokens

    random.seed(1)
    words = ["İstanbul", "क़लम", "naïve", "ﬁne", "Å", "日本", "e\u0301", "x" * 60, "ab!?", "c,", "don't", "½", "٣!", "ǆ."]
    texts = [" ".join(random.choices(words, k=30)) + " " + " ".join("".join(random.choices("abcdé", k=4)) for _ in range(20)) for _ in range(40)]
    want = [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    monkeypatch.setattr(tokens, "GROUP", 1000)
    for memo in (10, 1 << 20):
        monkeypatch.setattr(tokens, "MEMO", memo)
        coder = tokens.WordEncoder(vocabulary())
        assert [bytes(x) for at in (0, 20) for x in coder.encode(pa.array(texts[at : at + 20]))] == want
