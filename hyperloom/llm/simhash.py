"""SimHash near-duplicate classes by anchor points of a covering code."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components, forest
from .shared import MOST_IDS, keep_ids, lean, lookup, stored, text_of

SHINGLE = 3
SEED = 42
#: Fingerprints link at this many differing bits or fewer.
BITS = 2
#: Homes of an anchor that are compared in one place; an anchor with more is split.
HOMES = 4096
#: Comparisons made at once in a worker, which bounds its memory.
BLOCK = 1 << 18
#: The binary Golay code of length 23: its generator polynomial. It is perfect: every word is within 3 bits of one codeword.
GOLAY, LENGTH, INFO = 0xAE3, 23, 12


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id and fp, the 64-bit SimHash of the whole text as a signed long.

    A-Z are lowered, words are split at white space, shingles of ``shingle`` words (repeats included; a shorter text is
    one shingle) are hashed by XXH64. A bit is 1 if it is set in over half the hashes. A null, empty or blank text has 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        from xxhash import xxh64_intdigest

        def fingerprint(text: bytes | None) -> int:
            words = text.lower().split() if text else ()
            if not words:
                return 0
            parts = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else (b" ".join(words),)
            hashes = np.fromiter((xxh64_intdigest(p, seed) for p in parts), "<u8")
            ones = np.zeros(64, "i8")
            for at in range(0, len(hashes), 65_536):
                block = hashes[at : at + 65_536].view("u1").reshape(-1, 8)
                ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype="i4")
            return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little", signed=True)

        for batch in batches:
            found = [fingerprint(t.as_py()) for t in batch.column(1).cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(lean(run), "doc_id long, fp long")


class GolayAnchors:
    """Anchors in 46 of the 64 bits: pairs of codewords, one for each half of 23 bits.

    Each half is within 3 bits, the covering radius, of just one codeword, so a fingerprint's home is one anchor. One
    that differs in up to 2 bits lies within 3 + i and 3 + j bits of that anchor's halves, i + j <= 2; these anchors
    are the ones that ``near`` gives.
    """

    def __init__(self) -> None:
        import numpy as np

        def left(words):
            """Remainders modulo the generator."""
            words = words.copy()
            for bit in range(LENGTH - 1, LENGTH - INFO - 1, -1):
                words ^= np.where(words >> bit & 1, GOLAY << (bit - (LENGTH - INFO)), 0)
            return words

        info = np.arange(1 << INFO, dtype="i8") << (LENGTH - INFO)
        codewords = info | left(info)
        ones = 1 << np.arange(LENGTH, dtype="i8")
        errors = [np.zeros(1, "i8"), ones]
        errors += [(ones[i] | ones[i + 1 :]) for i in range(LENGTH)]
        errors += [(ones[i] | ones[j] | ones[j + 1 :]) for i in range(LENGTH) for j in range(i + 1, LENGTH)]
        leaders = np.concatenate(errors)
        self.leader = np.zeros(1 << (LENGTH - INFO), "i8")
        self.leader[left(leaders)] = leaders
        away = np.bitwise_count(self.leader[:, None] ^ codewords[None, :])
        self.more = {e: self._lists(away == 3 + e) for e in (1, 2)}
        self.left = left

    @staticmethod
    def _lists(near):
        """Row by row the positions that are true, filled up with -1."""
        import numpy as np

        out = np.full((len(near), int(near.sum(axis=1).max())), -1, "i8")
        row, value = np.nonzero(near)
        out[row, np.arange(len(row)) - np.searchsorted(row, row)] = value
        return out

    def halves(self, fp):
        import numpy as np

        fp = fp.astype("u8")
        found = []
        for shift in (0, LENGTH):
            word = (fp >> np.uint64(shift) & np.uint64((1 << LENGTH) - 1)).astype("i8")
            rest = self.left(word)
            found.append(((word ^ self.leader[rest]) >> (LENGTH - INFO), rest))
        return found

    def home(self, fp):
        (a, _), (b, _) = self.halves(fp)
        return a << INFO | b

    def near(self, fp):
        """(position in fp, anchor) of each further anchor to which a fingerprint is replicated: those within the covering
        radius plus BITS, as 3 + i and 3 + j bits of the halves with i + j <= BITS."""
        import numpy as np

        (a, s), (b, t) = self.halves(fp)
        at = np.arange(len(fp))
        for i, j in [(i, j) for i in range(BITS + 1) for j in range(BITS + 1 - i) if i + j]:
            x = self.more[i][s] if i else np.zeros((len(fp), 1), "i8")
            y = self.more[j][t] if j else np.zeros((len(fp), 1), "i8")
            x, y = x[:, :, None], y[:, None, :]
            anchor = (a[:, None, None] ^ x) << INFO | (b[:, None, None] ^ y)
            ok = (x >= 0) & (y >= 0)
            yield np.broadcast_to(at[:, None, None], ok.shape)[ok], anchor[ok]


@functools.cache
def anchors_of() -> GolayAnchors:
    """The worker's anchors; they last as long as it."""
    return GolayAnchors()


def _batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns.values()], list(columns))


def _met(batches: Iterator[pa.RecordBatch], block: int = BLOCK) -> Iterator[tuple]:
    """Of rows (place, role, others) sorted by place and role, 0 for a home and 1 for what is compared with the place's
    homes: positions i and j of what is compared and of a home, and the other columns of both, ``block`` pairs at once.
    Homes of the last place are held until the next begins."""
    import numpy as np

    held = None
    for batch in batches:
        if not len(batch):
            continue
        place, role, *others = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        probe = role == 1
        homes = [c[~probe] for c in (place, *others)]
        if held is not None:
            homes = [np.concatenate(x) for x in zip(held, homes)]
        probes = [c[probe] for c in (place, *others)]
        lo, hi = np.searchsorted(homes[0], probes[0], "left"), np.searchsorted(homes[0], probes[0], "right")
        upto, at = np.concatenate(([0], np.cumsum(hi - lo))), 0
        while at < len(lo):
            to = max(at + 1, int(np.searchsorted(upto, upto[at] + block, "right")) - 1)
            n = (hi - lo)[at:to]
            i = np.repeat(np.arange(at, to), n)
            yield i, np.arange(len(i)) - np.repeat(upto[at:to] - upto[at], n) + lo[i], probes[1:], homes[1:]
            at = to
        last = homes[0] == place[-1]
        held = [c[last] for c in homes]


def links(classes: DataFrame, homes: int = HOMES) -> DataFrame:
    """(a, b): links between the representatives of fingerprints (columns fp, rep; stored) that differ in at most BITS bits.

    No links' ends are lost, but links that a task's other links imply are left out. A fingerprint goes to its home
    anchor as one to compare with, and to all its anchors to be compared. Anchors that are home to more than ``homes``
    fingerprints are split: homes are dealt to parts, and what is compared goes to every part.
    """
    spark = classes.sparkSession

    def at_home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = anchors_of()
        for batch in batches:
            home = anchors.home(batch.column(0).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([pa.array(home)], ["anchor"])

    full = classes.select("fp").mapInArrow(lean(at_home), "anchor long").groupBy("anchor").count().where(F.col("count") > homes).toArrow()
    anchor, n = (full.column(i).to_numpy() for i in (0, 1))  # of 1 << 2 * INFO anchors at most
    order = anchor.argsort()
    told = spark.sparkContext.broadcast((anchor[order], -(-n[order] // homes)))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        anchors, (split, times) = anchors_of(), told.value

        def n_parts(anchor):
            if not len(split):
                return np.ones(len(anchor), "i8")
            i = np.minimum(np.searchsorted(split, anchor), len(split) - 1)
            return np.where(split[i] == anchor, times[i], 1)

        def rows(anchor, part, probe, fp, rep):
            return _batch(place=anchor << 32 | part, role=np.full(len(fp), probe, "i8"), fp=fp, rep=rep)

        for batch in batches:
            for at in range(0, len(batch), 4096):
                fp, rep = (batch.column(i).slice(at, 4096).to_numpy(zero_copy_only=False) for i in (0, 1))
                home = anchors.home(fp)
                yield rows(home, (fp * 0x9E3779B1 >> 20) % n_parts(home), 0, fp, rep)
                for i, anchor in [(np.arange(len(fp)), home), *anchors.near(fp)]:
                    n = n_parts(anchor)
                    again = np.repeat(np.arange(len(anchor)), n)
                    part = np.arange(len(again)) - np.repeat(np.cumsum(n) - n, n)
                    yield rows(anchor[again], part, 1, fp[i[again]], rep[i[again]])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        found, n_found = [], 0

        def out():
            a, b = forest(*(np.concatenate(x) for x in zip(*found)))
            return _batch(a=a, b=b)

        for i, j, (fp, rep), (fp2, rep2) in _met(batches):
            near = np.bitwise_count((fp[i] ^ fp2[j]).view("u8")) <= BITS
            near &= rep[i] != rep2[j]
            if near.any():
                found.append(forest(rep[i[near]], rep2[j[near]]))
                n_found += len(found[-1][0])
            if n_found > 500_000:
                yield out()
                found, n_found = [], 0
        if found:
            yield out()

    dealt = classes.select("fp", "rep").mapInArrow(lean(deal), "place long, role long, fp long, rep long")
    return dealt.repartition("place").sortWithinPartitions("place", "role").mapInArrow(lean(compare), "a long, b long")


#: Words of the shingles of which similar texts share most, and the share (shared to all) from which texts are similar.
WORDS, SIMILARITY = 5, 0.8
#: Documents that tell which shingles are frequent, and in how many of them one that is frequent is seen.
SAMPLE, FREQUENT = 4_000, 2
#: Rounds in which each document meets one other, before those that are left meet all.
ROUNDS = 2
#: A text's sketch: for each of 64 * SKETCH cells whether an odd number of its shingles is there.
SKETCH = 8
#: Texts whose sketches are few enough to broadcast.
FEW = 10_000
CELLS = [f"b{i}" for i in range(SKETCH)]
SKETCHED = ", ".join(f"{b} long" for b in CELLS)


def _shingles(text: bytes, words: int = WORDS):
    """The hashes of a text's different shingles, sorted, A-Z lowered; a shorter text is one shingle."""
    import numpy as np
    from xxhash import xxh64_intdigest

    w = text.lower().split()
    parts = map(b" ".join, zip(*(w[i:] for i in range(words)))) if len(w) >= words else (b" ".join(w),) if w else ()
    return np.unique(np.fromiter((xxh64_intdigest(p, SEED) for p in parts), "u8")).view("i8")


def _lists(lists: list) -> pa.Array:
    import numpy as np

    ends = pa.array(np.cumsum([0, *map(len, lists)], dtype="i4"))
    return pa.ListArray.from_arrays(ends, pa.array(np.concatenate(lists) if lists else np.zeros(0, "i8"), pa.int64()))


def _texts(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[tuple]:
    """Slices of a batch, which bound a worker's memory: doc_ids and texts as bytes."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            some = batch.slice(at, rows)
            yield some.column(0), (t.as_py() for t in some.column(1).cast(pa.large_binary()))


def _named(docs: DataFrame) -> DataFrame:
    return docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))


def shingle_sets(docs: DataFrame) -> DataFrame:
    """doc_id and shingles: the hashes of the text's different shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _texts(batches):
            yield pa.RecordBatch.from_arrays([ids, _lists([_shingles(t) for t in texts])], ["doc_id", "shingles"])

    return _named(docs).mapInArrow(lean(run), "doc_id long, shingles array<long>")


def _apart(size: int, similarity: float) -> int:
    """The most shingles of a text with ``size`` that a similar text lacks."""
    return size - math.ceil(similarity * size - 1e-6)


def _more(size: int, similarity: float) -> int:
    """How many shingles beyond those that a similar text may lack and one are dealt out: half as many again."""
    return (_apart(size, similarity) + 1) // 2


def signatures(docs: DataFrame, frequent: tuple, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, size, least, rare and the sketch b0.. b7 of each text with words. size is its number of different shingles;
    rare are so many of the rarest that a similar text has ``least`` of them, or more, among its own. Their order is that
    of ``frequent`` (sorted shingles, counts), which needn't be exact: any order common to all texts will do. Two sketches
    differ in at most as many bits as the sets differ in shingles.

    Of the _apart + 1 + _more shingles that come first, a similar text lacks _apart at most. Of those that both texts have,
    each text's first ones are the same, so both deal out 1 + _more of the smaller text, whose size is ``similarity`` of
    the other's or more.
    """
    told = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        known, times = told.value
        for ids, texts in _texts(batches):
            docs_, sizes, least, rare, sketches = [], [], [], [], []
            for doc, text in zip(ids.to_pylist(), texts):
                x = _shingles(text)
                if not len(x):
                    continue
                often = np.zeros(len(x), "i8")
                if len(known):
                    i = np.minimum(np.searchsorted(known, x), len(known) - 1)
                    often = np.where(known[i] == x, times[i], 0)
                docs_.append(doc)
                sizes.append(len(x))
                least.append(1 + _more(math.ceil(similarity * len(x) - 1e-6), similarity))
                rare.append(x[np.lexsort((x, often))][: _apart(len(x), similarity) + 1 + _more(len(x), similarity)])
                odd = np.bincount(x & 64 * SKETCH - 1, minlength=64 * SKETCH).astype("u1") & 1
                sketches.append(np.packbits(odd).view("i8"))
            columns = [pa.array(x, pa.int64()) for x in (docs_, sizes, least)] + [_lists(rare)]
            columns += [pa.array(np.array([s[i] for s in sketches], "i8")) for i in range(SKETCH)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "size", "least", "rare", *CELLS])

    return _named(docs).mapInArrow(lean(run), f"doc_id long, size long, least long, rare array<long>, {SKETCHED}")


def shared_places(docs: DataFrame, similarity: float = SIMILARITY, homes: int = HOMES, sample: int = SAMPLE) -> DataFrame:
    """place, doc_id, size, b0.. b7: the rare shingles (places) that several texts have, with each text that has one.
    Similar texts share one at least. Left out are shingles of a single text, and texts that share so few that none can be
    similar to them.

    Which shingles are frequent is told by about ``sample`` documents, at any size of the input. One that is expected in
    more than ``homes`` texts is spread over tasks.
    """
    spark, total = docs.sparkSession, docs.count()
    some = docs.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) < int((1 << 30) * min(1.0, sample / max(total, 1))))
    seen = shingle_sets(some).select(F.explode("shingles").alias("s")).groupBy("s").count().where(F.col("count") >= FREQUENT).toArrow()
    known, times = (seen.column(i).to_numpy() for i in (0, 1))
    order = known.argsort()
    known, times = known[order], times[order]
    prints = stored(signatures(docs, (known, times), similarity), "signatures")
    rows = prints.select("doc_id", F.explode("rare").alias("place"))
    parts = -(-times * max(1, total // sample) // homes)
    if (parts > 1).any():
        hot = spark.createDataFrame(pa.table({"place": known[parts > 1], "parts": parts[parts > 1]}))  # of the sample's shingles
        rows = rows.join(F.broadcast(hot), "place", "left")
        part = F.xxhash64("place", F.pmod(F.xxhash64("doc_id"), F.col("parts")))
        dealt = rows.select(F.when(F.col("parts") > 1, part).otherwise(F.col("place")).alias("key"), "doc_id", F.when(F.col("parts") > 1, F.col("place")).alias("hot"))
    else:
        dealt = rows.select(F.col("place").alias("key"), "doc_id", F.lit(None).cast("long").alias("hot"))

    def several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by key; those go that have no neighbour of the same key. The last one waits for the next batch."""
        import numpy as np

        last = None
        for batch in batches:
            if not len(batch):
                continue
            key, doc = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            now = [key, pc.coalesce(batch.column(2), batch.column(0)).to_numpy(zero_copy_only=False), doc]
            if last is not None:
                now = [np.concatenate(x) for x in zip(last[0], now)]
            same = now[0][1:] == now[0][:-1]
            keep = np.concatenate(([last is not None and last[1]], same)) | np.concatenate((same, [False]))
            last = [c[-1:] for c in now], bool(keep[-1])
            yield _batch(place=now[1][:-1][keep[:-1]], doc_id=now[2][:-1][keep[:-1]])
        if last is not None and last[1]:
            yield _batch(place=last[0][1], doc_id=last[0][2])

    dealt = dealt.repartition("key").sortWithinPartitions("key")
    shared = stored(dealt.mapInArrow(lean(several), "place long, doc_id long"), "places")
    counts = shared.groupBy("doc_id").agg(F.count("*").alias("n"))
    able = stored(prints.drop("rare").join(counts, "doc_id").where("n >= least").drop("n", "least"), "able")
    return shared.join(F.broadcast(able) if able.count() <= FEW else able, "doc_id").select("place", "doc_id", "size", *CELLS)


def _relabel(rows: DataFrame, links: DataFrame) -> DataFrame:
    """``rows`` with the column comp replaced by the component that ``links`` (a, b) make of it; stored."""
    joined = stored(components(links).select(F.col("node").alias("comp"), "component"), "joined")
    joined = F.broadcast(joined) if joined.count() <= MOST_IDS else joined
    columns = [F.coalesce("component", "comp").alias("comp") if c == "comp" else c for c in rows.columns]
    return stored(rows.join(joined, "comp", "left").select(*columns), "labelled")


def first_met(rows: DataFrame, seed: int, similarity: float) -> DataFrame:
    """doc_id, comp, partner, other: for each text one of another component (other), with the same place, that its sketch
    allows to be similar: of the places' chosen texts that which it meets most often. Not more rows than texts."""
    chosen = F.min(F.struct(F.xxhash64("doc_id", F.lit(seed)).alias("h"), "doc_id", "comp", "size", *CELLS))
    chosen = stored(rows.groupBy("place").agg(chosen.alias("c"), F.count("*").alias("n")).where("n > 1"), "chosen")
    met = lookup(rows, chosen, "place", "n", chosen.agg(F.sum("n")).first()[0] or 0).where("comp != c.comp")
    differ = sum((F.bit_count(F.col(b).bitwiseXOR(F.col(f"c.{b}"))) for b in CELLS), F.lit(0))
    met = met.where(differ * (1 + similarity) <= (1 - similarity) * (F.col("size") + F.col("c.size")) + 1e-6)
    met = met.groupBy("doc_id", "comp", F.col("c.doc_id").alias("partner"), F.col("c.comp").alias("other")).agg(F.count("*").alias("times"))
    best = met.groupBy("doc_id", "comp").agg(F.max(F.struct("times", "partner", "other")).alias("best"))
    return best.select("doc_id", "comp", "best.partner", "best.other")


def all_met(rows: DataFrame, similarity: float, homes: int = HOMES) -> DataFrame:
    """doc_id, comp, partner, other: all pairs of texts of different components that share a place and, by their sizes and
    sketches, can be similar.

    Places of one component are left out. At a place all texts are homes, and those that aren't of its largest component
    are compared with them, so that a large component is never compared with itself. Homes of a place with more than
    ``homes`` are dealt to parts, and what is compared goes to every part.
    """
    per = rows.groupBy("place", "comp").agg(F.count("*").alias("n")).groupBy("place")
    per = per.agg(F.max(F.struct("n", "comp")).alias("top"), F.sum("n").alias("n"), F.count("*").alias("comps"))
    per = stored(per.where("comps > 1").select("place", F.col("top.comp").alias("top"), "n"), "mixed")
    found = lookup(rows, per, "place", "n", per.agg(F.sum("n")).first()[0] or 0)
    parts = F.ceil(F.col("n") / homes).cast("long")
    own = F.pmod(F.xxhash64("doc_id"), parts)
    most = (F.col("comp") == F.col("top")).cast("long")
    roles = F.array(F.struct(own.alias("part"), F.lit(0).cast("long").alias("role")))
    every = F.transform(F.sequence(F.lit(0).cast("long"), parts - 1), lambda p: F.struct(p.alias("part"), F.lit(1).cast("long").alias("role")))
    found = found.withColumn("most", most).withColumn("r", F.explode(F.when(F.col("most") == 1, roles).otherwise(F.concat(roles, every))))
    dealt = found.select(F.xxhash64("place", "r.part").alias("key"), "r.role", "doc_id", "comp", "most", "size", *CELLS)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for i, j, probes, held in _met(batches, BLOCK >> 2):
            (doc, comp, _, size, *cells), (doc2, comp2, most2, size2, *cells2) = probes, held
            ok = (comp[i] != comp2[j]) & ((most2[j] == 1) | (comp2[j] < comp[i]))
            both = size[i] + size2[j]
            ok &= np.minimum(size[i], size2[j]) * (1 + similarity) >= similarity * both - 1e-6
            i, j, both = i[ok], j[ok], both[ok]
            differ = sum(np.bitwise_count((a[i] ^ b[j]).view("u8")).astype("i8") for a, b in zip(cells, cells2))
            ok = differ * (1 + similarity) <= (1 - similarity) * both + 1e-6
            i, j = i[ok], j[ok]
            if len(i):
                yield _batch(doc_id=doc[i], comp=comp[i], partner=doc2[j], other=comp2[j])

    return dealt.repartition("key").sortWithinPartitions("key", "role").mapInArrow(lean(compare), "doc_id long, comp long, partner long, other long").distinct()


def verified(docs: DataFrame, pairs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b): comp and other of the stored ``pairs`` whose texts are similar, by all their shingles. A partner of many is
    dealt to parts."""
    named = stored(pairs.select("doc_id").union(pairs.select("partner")).distinct(), "named")
    sets = stored(shingle_sets(keep_ids(docs, named)).dropDuplicates(["doc_id"]), "shingles")
    counts = stored(pairs.groupBy("partner").agg(F.count("*").alias("n")), "counts")
    parts = F.ceil(F.col("n") / 256).cast("long")
    total = counts.agg(F.sum("n")).first()[0] or 0
    told = lookup(pairs, counts, "partner", "n", total).withColumn("part", F.pmod(F.xxhash64("doc_id"), parts)).drop("n")
    other = sets.select(F.col("doc_id").alias("partner"), F.col("shingles").alias("theirs")).join(counts, "partner")
    other = other.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("n")
    both = told.join(sets, "doc_id").join(other, ["partner", "part"])
    shared = F.size(F.array_intersect("shingles", "theirs"))
    return both.where(shared >= similarity * (F.size("shingles") + F.size("theirs") - shared) - 1e-6).select(F.col("comp").alias("a"), F.col("other").alias("b")).distinct()


def similar(docs: DataFrame, groups: DataFrame, similarity: float = SIMILARITY, homes: int = HOMES, sample: int = SAMPLE, rounds: int = ROUNDS) -> DataFrame:
    """(node, component): which ``groups`` similar texts join. ``groups`` (stored) has doc_id and component_id, the smallest
    doc_id of its group, for each row; texts are similar if of the shingles of five words that either has they share
    ``similarity`` or more. A group that joins others and isn't the smallest is a node. Rows without doc_id or words join
    nothing; a doc_id stands for one text.

    No two groups with similar texts stay apart. Similar texts share one of the rare shingles, so all that can be similar
    meet there. First each text tries one that it meets, in each of ``rounds``, which joins most of a large group with
    work in proportion to its size; then what belongs to different groups still is compared wholly. What sizes and
    sketches allow is checked by all shingles.
    """
    rows = stored(shared_places(docs, similarity, homes, sample).join(groups.select("doc_id", F.col("component_id").alias("comp")).distinct(), "doc_id"), "labelled")
    links = docs.sparkSession.createDataFrame([], "a long, b long")
    for k in range(rounds + 1):
        pairs = stored(first_met(rows, k, similarity) if k < rounds else all_met(rows, similarity, homes), "pairs")
        new = stored(verified(docs, pairs, similarity), "similar")
        links = links.union(new)
        if k < rounds and not new.isEmpty():
            rows = _relabel(rows, new)
    return components(links)


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, homes: int = HOMES) -> DataFrame:
    """doc_id, fp, component_id and group_size (rows of the same fingerprint) for each row of ``docs``.

    Fingerprints within BITS bits link; component_id is the smallest doc_id that links reach. Equal texts have equal
    fingerprints; null and blank texts have 0 and link like others. Rows without a doc_id keep their fingerprint and
    get component_id null; they link nothing. Repeated rows get the same answer. An empty table gives no rows.
    """
    prints = stored(fingerprints(docs, shingle, seed), "prints")
    classes = prints.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"))
    classes = stored(classes, "classes")
    joined = components(links(classes, homes))
    named = classes.join(joined, F.col("rep") == F.col("node"), "left").select("fp", "n", F.coalesce("component", "rep").alias("component_id"))
    named = stored(named, "named")
    total = named.agg(F.sum("n")).first()[0] or 0
    found = lookup(prints.where("doc_id IS NOT NULL"), named, "fp", "n", total).withColumnRenamed("n", "group_size")
    none = prints.where("doc_id IS NULL").select("doc_id", "fp", F.lit(1).cast("long").alias("group_size"), F.lit(None).cast("long").alias("component_id"))
    return found.unionByName(none)
