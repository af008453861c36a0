"""Distributed union-find by contraction.

Each task joins the edges it holds into stars. A node that is no star's middle anywhere is settled by its
least middle and leaves the graph; what is left are the middles, and edges between those that share a node.
Where this takes little away, a large-star and a small-star step shorten the paths. Once no more edges are
left than one task may hold, one task settles them, and the settled nodes follow from their middles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orebed.storage import forget, materialize

#: Edges that one task may settle, and that a task joins into stars at a time.
FINISH, CHUNK = 1 << 19, 1 << 19


def least_labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids in order, least id of each one's component) of the edges (a, b)."""
    ids, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    one, two = at[: len(a)], at[len(a) :]
    label = np.arange(len(ids))
    while True:
        x, y = label[one], label[two]
        apart = x != y
        if not apart.any():
            return ids, ids[label]
        one, two, x, y = one[apart], two[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := label[label], label):
            label = up


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The stars (u, v), u > v, of a task's edges, CHUNK at a time."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def stars() -> Iterator[pa.RecordBatch]:
        if held:
            ids, least = least_labels(*(np.concatenate(x) for x in zip(*held, strict=True)))
            off = ids != least
            yield pa.RecordBatch.from_arrays([pa.array(ids[off]), pa.array(least[off])], ["u", "v"])
        held.clear()

    for b in batches:
        if b.num_rows:
            held.append((b.column(0).to_numpy(), b.column(1).to_numpy()))
        if sum(len(x) for x, _ in held) >= CHUNK:
            yield from stars()
    yield from stars()


def _stars_of(edges: DataFrame) -> tuple[DataFrame, int]:
    e = materialize(edges.mapInArrow(_forest, "u long, v long"), "edges")
    return e, e.count()


def _contracted(e: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(u, m): the nodes that are no middle and each one's least middle; and the edges (u, v) that are left."""
    least = materialize(e.groupBy("u").agg(F.min("v").alias("m"), F.max("v").alias("most")), "least")
    middles = e.select(F.col("v").alias("u")).distinct()
    several = e.join(least.where("m <> most"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    inner = least.select("u", F.col("m").alias("v")).join(middles, "u", "left_semi")
    return least.join(middles, "u", "left_anti").select("u", "m"), several.unionByName(inner).distinct()


def _shortened(e: DataFrame) -> DataFrame:
    """A large-star and a small-star step: the same components over shorter paths."""
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = materialize(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "edges")
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return small.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) of every id in `edges` (a, b); component is the smallest id reachable.

    Loops and repeated edges do no harm, edges with a null end are left out, no edges give no rows. Aggregates
    combine before their shuffle, so a node of very many neighbours is no single task's group.
    """
    spark = edges.sparkSession
    e, n = _stars_of(edges.select("a", "b").where("a <> b"))
    settled = []
    while n > FINISH:
        leaves, left = _contracted(e)
        settled.append(materialize(leaves, "settled"))
        old, before = e, n
        e, n = _stars_of(left)
        if n > FINISH and 4 * n > 3 * before:
            e, n = _stars_of(_shortened(e))
        forget(spark, old)
    found = e.repartition(1).mapInArrow(_labels, "id long, component long")
    for leaves in reversed(settled):
        found = materialize(found, "found")
        below = leaves.join(found.select(F.col("id").alias("m"), "component"), "m", "left")
        below = below.select(F.col("u").alias("id"), F.coalesce("component", "m").alias("component"))
        middles = leaves.select(F.col("m").alias("id")).distinct().join(found, "id", "left_anti").select("id", F.col("id").alias("component"))
        found = found.unionByName(below).unionByName(middles)
    return materialize(found, "components")


def _labels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, component) of all of FINISH edges at most."""
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if parts:
        ids, least = least_labels(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(least)], ["id", "component"])
