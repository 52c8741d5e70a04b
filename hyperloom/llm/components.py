"""Connected components of a graph given as edges."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import lean, lookup, stored

#: Edges up to this number go through one task; more through rounds over all tasks.
FEW = 10_000


def forest(a, b):
    """Of links a-b (arrays) the trees: each node that isn't the smallest of its tree, and the smallest."""
    import numpy as np

    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    u, v, label = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        for end in (u, v, label[u], label[v]):
            np.minimum.at(new, end, low)
        new = new[new]
        if (new == label).all():
            rest = label != np.arange(len(nodes))
            return nodes[rest], nodes[label[rest]]
        label = new


def _at_once(edges: DataFrame) -> DataFrame:
    """The components of few edges, in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        ends = [[c.to_numpy() for c in batch.columns] for batch in batches if len(batch)]
        if ends:
            node, component = forest(*(np.concatenate(x) for x in zip(*ends)))
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(component)], ["node", "component"])

    return edges.coalesce(1).mapInArrow(lean(run), "node long, component long")


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over stored edges (a, b), b < a. Each node's smallest neighbour m becomes the neighbour of its
    larger neighbours (large star) or of its smaller neighbours and itself (small star). A node may have any number of
    neighbours: hubs are joined by broadcast and never gathered."""
    both = edges
    if large:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = stored(both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), "least")
    total = least.agg(F.sum("n")).first()[0] or 0
    met = lookup(both, least, "a", "n", total)
    if large:
        made = met.where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
    else:
        made = met.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return stored(made.where("a != b").distinct(), "edges")


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.pmod(F.xxhash64("b", "a"), F.lit(1 << 31)))).first())


def components(edges: DataFrame, few: int = FEW) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b; longs) that isn't the smallest of its component; component
    is the smallest. Large and small stars alternate until nothing changes, with edges written between the steps; up to
    ``few`` edges go through one task.
    Loops and repeated edges are harmless; edges with a null end are dropped."""
    edges = edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = stored(edges.distinct(), "edges")
    mark = _mark(edges)
    if mark[0] <= few:
        return _at_once(edges)
    while True:
        edges = _star(_star(edges, large=True), large=False)
        if (now := _mark(edges)) == mark:
            break
        mark = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
