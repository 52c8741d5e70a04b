"""Token ids of documents in binary files, in ascending order of doc_id."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .eliasfano import TokenFile, TokenFileWriter
from .shared import lean, scratch, stored, text_of
from .tokens import encoder, vocabulary

END_ID = 2
#: Ids below this are written in two bytes, else in four.
NARROW = 1 << 16

MANIFEST = "part long, path string, first long, documents long, tokens long"
ROWS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _file_system(uri: str):
    """The file system of a shared folder's address, and the path in it: file, HDFS, S3, GCS or Azure."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


def write(docs: DataFrame, folder: str | None = None, vocab: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Writes every document's ids, each with ``end_id``, and returns the manifest: a row a file with the ids before it.

    Documents are dealt to files by ranges of doc_id (null first), and of their texts' hash where doc_ids repeat, and
    sorted so within. A file has a name of its own for each attempt at a task, and the manifest names those of the
    attempts that counted, so that a task that is run again leaves no wrong file in the result. The driver gathers one
    row a file. Null and empty texts are the end id alone; long texts are encoded whole; equal rows lie side by side; an empty table makes no file; other columns are ignored.
    """
    spark = docs.sparkSession
    folder, path = folder or scratch(spark, "tokens"), vocab or vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        from pyspark import TaskContext

        coder, part, writer, documents, tokens = encoder(path), TaskContext.get().partitionId(), None, 0, 0
        wide, end = coder.size >= NARROW or end_id >= NARROW, np.array([end_id], "<u4")
        for batch in batches:
            for doc, ids in zip(batch.column(0).to_pylist(), coder.encode(batch.column(1))):
                if writer is None:
                    system, root = _file_system(folder)
                    system.create_dir(root, recursive=True)
                    name = f"{root}/{part:06d}-{uuid.uuid4().hex}.tok"
                    writer = TokenFileWriter(system.open_output_stream(name), wide)
                ids = np.concatenate((np.frombuffer(ids, "<u4"), end))
                writer.add(doc, ids)
                documents, tokens = documents + 1, tokens + len(ids)
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pydict({"part": [part], "path": [name.rpartition("/")[2]], "documents": [documents], "tokens": [tokens]})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    order = ["doc_id", F.xxhash64("text")]
    files = rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(lean(run), "part long, path string, documents long, tokens long")
    made, first = [], 0
    for part, name, documents, tokens in sorted(stored(files, "manifest").collect()):
        made.append((part, f"{folder}/{name}", first, documents, tokens))
        first += tokens
    return spark.createDataFrame(made, MANIFEST)


def read(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files: start counts the ids of all documents before it.
    A file's ids are read in blocks."""

    def told(out: list[tuple]) -> pa.RecordBatch:
        names = ("doc_id", "start", "n_tokens", "ids_crc32")
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in batch.to_pylist():
                system, name = _file_system(at["path"])
                with system.open_input_file(name) as source:
                    out = []
                    for key, start, ids in TokenFile(source, source.size()).documents():
                        out.append((key, at["first"] + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        if len(out) == 10_000:
                            yield told(out)
                            out = []
                    if out:
                        yield told(out)

    return manifest.repartition(max(1, manifest.count())).mapInArrow(lean(run), ROWS)
