"""Harmonic packing of documents into sequences of a fixed number of tokens."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from itertools import chain, repeat

import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import lean, small_batches
from .tokens import encoder, vocabulary

CAPACITY = 2048
END_ID = 1
#: Pieces that a task gives out at once, and bytes of their ids where these are asked for.
ROWS, IDS = 20_000, 4 << 20
#: A piece stays whole if its class would pad it by at most this share of the class's slot.
PAD_SHARE = 1 / 128


def slots(capacity: int, share: float) -> list[list[int]]:
    """For each rest shorter than ``capacity`` the lengths of the pieces that it is cut into.

    Class k takes lengths in (capacity/(k+1), capacity/k], k to a bin. A rest near the top of its class stays whole;
    else a piece as long as the next class's slot, so one without padding, is cut off and the remainder treated alike.
    """
    plans: list[list[int]] = [[]]
    for rest in range(1, capacity):
        k = capacity // rest
        if capacity // k - rest <= share * (capacity // k):
            plans.append([rest])
        else:
            top = capacity // (k + 1)
            plans.append([top, *plans[rest - top]])
    return plans


class HarmonicBins:
    """Bins of one worker. Class k's pieces fill bins of k pieces each; what bins the end finds open is joined and
    cut anew, so that a worker leaves at most one sequence short. Of a closed bin's ids only ``shown`` of them is given out."""

    def __init__(self, capacity: int, first: int, shown: Callable = bytes):
        self.capacity, self.next, self.open, self.shown = capacity, first, {}, shown

    def _close(self, pieces: list[tuple]) -> Iterator[tuple]:
        offset = 0
        for doc, start, ids, total in pieces:
            yield doc, start, len(ids) // 4, zlib.crc32(ids), total, self.next, offset, self.shown(ids)
            offset += len(ids) // 4
        self.next += 1

    def add(self, doc, start: int, ids: bytes, total: int) -> Iterator[tuple]:
        k = self.capacity // (len(ids) // 4)
        held = self.open.setdefault(k, [])
        held.append((doc, start, ids, total))
        if len(held) == k:
            del self.open[k]
            yield from self._close(held)

    def finish(self) -> Iterator[tuple]:
        bin_, room = [], self.capacity
        for k in sorted(self.open):
            for doc, start, ids, total in self.open[k]:
                while ids:
                    now, ids = ids[: 4 * room], ids[4 * room :]
                    bin_.append((doc, start, now, total))
                    start, room = start + len(now) // 4, room - len(now) // 4
                    if not room:
                        yield from self._close(bin_)
                        bin_, room = [], self.capacity
        if bin_:
            yield from self._close(bin_)
        self.open = {}


def pack(docs: DataFrame, vocab: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, share: float = PAD_SHARE, with_ids: bool = False) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and with ``with_ids`` the
    piece's ids.

    Each task reads its rows once, keeps at most one open bin a class, and numbers its sequences from its partition's
    number, so nothing is shuffled and a lost task is done again alone. A null or empty text is its end id alone;
    repeated rows are documents of their own; a null doc_id is kept as null; other columns are ignored; an empty table
    gives no rows. Texts of any length are cut into full sequences and a rest.
    """
    small_batches(docs.sparkSession)
    path = vocab or vocabulary()
    fields = [(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
    fields += [("ids", pa.list_(pa.int64()))] if with_ids else []
    schema = pa.schema(fields)
    ddl = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<long>" * with_ids

    def out(rows: list[tuple]) -> pa.RecordBatch:
        *columns, ids = zip(*rows)
        arrays = [pa.array(c, pa.int64()) for c in columns]
        if with_ids:
            import numpy as np

            arrays.append(pa.array([np.frombuffer(x, "<u4").astype("i8") for x in ids], pa.list_(pa.int64())))
        return pa.RecordBatch.from_arrays(arrays, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        plans, end = slots(capacity, share), end_id.to_bytes(4, "little")
        bins = HarmonicBins(capacity, TaskContext.get().partitionId() << 40, bytes if with_ids else lambda ids: None)
        coder, rows, most = encoder(path), [], max(1, min(ROWS, IDS // (4 * capacity))) if with_ids else ROWS
        for batch in batches:
            for doc, ids in zip(batch.column(0).to_pylist(), coder.encode(batch.column(1))):
                ids = bytes(ids) + end
                total, start = len(ids) // 4, 0
                for n in chain(repeat(capacity, total // capacity), plans[total % capacity]):
                    rows.extend(bins.add(doc, start, ids[4 * start : 4 * (start + n)], total))
                    start += n
                    if len(rows) >= most:
                        yield out(rows)
                        rows = []
        rows.extend(bins.finish())
        if rows:
            yield out(rows)

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(lean(run), ddl)
