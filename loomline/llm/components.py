"""Connected components of a large graph by randomised contraction.

Each round every node looks at its closed neighbourhood and points to the member whose hash (new in
every round) is least; the edges are then rewritten to the nodes pointed to, made distinct, and loops
dropped. A constant share of the nodes vanishes per round whatever the graph's shape, so long chains take
a logarithmic number of rounds too. A small rest is finished by one task. Nothing is collected; every round ends in a table of the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.layout import unbroadcast
from loomline.scratch import materialize


#: Edges up to which one task finishes a graph (16 bytes each); larger ones are contracted round by round.
ONE_TASK = 16_384


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star forest (node, root) with the same components as the edges given, by union-find."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = np.arange(len(nodes))
    x, y = at[: len(a)], at[len(a) :]
    while True:
        # hook larger roots to smaller ones, then halve the paths until all are flat
        rx, ry = parent[x], parent[y]
        differ = rx != ry
        if not differ.any():
            break
        np.minimum.at(parent, np.maximum(rx, ry)[differ], np.minimum(rx, ry)[differ])
        while not np.array_equal(up := parent[parent], parent):
            parent = up
    moved = parent != np.arange(len(nodes))
    return nodes[moved], nodes[parent[moved]]


def _thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace a task's edges by a forest, batch by batch."""
    for b in batches:
        u, v = forest(b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False))
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["a", "b"])


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All nodes of a task's edges with their roots."""
    parts = [tuple(b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1)) for b in batches if b.num_rows]
    if not parts:
        return
    a, b = (np.concatenate(c) for c in zip(*parts, strict=True))
    node, root = forest(a, b)
    top = np.unique(np.setdiff1d(np.concatenate([a, b]), node))
    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([node, top])), pa.array(np.concatenate([root, top]))], names=["node", "root"])


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (columns a, b of long); isolated nodes do not occur.

    Repeated edges, loops and both directions are allowed; nulls are ignored; no edges give no rows.
    """
    graph = materialize(edges.select("a", "b").where("a <> b").mapInArrow(_thin, "a long, b long").distinct(), "edges")
    steps: list[DataFrame] = []
    while n := graph.count():
        k = len(steps)
        if n <= ONE_TASK:
            steps.append(materialize(graph.coalesce(1).mapInArrow(_finish, "node long, root long"), f"hook{k}"))
            break
        order = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(k)).alias("h"), F.col(c).alias("v"))  # noqa: B023,E731
        both = graph.select("a", order("b").alias("o")).unionByName(graph.select(F.col("b").alias("a"), order("a").alias("o")))
        # the node's own hash takes part through least()
        rep = both.groupBy("a").agg(F.min("o").alias("o")).select(F.col("a").alias("node"), F.least("o", order("a"))["v"].alias("root"))
        rep = materialize(rep, f"hook{k}")
        steps.append(rep)
        moved = (
            unbroadcast(graph).join(unbroadcast(rep).select(F.col("node").alias("a"), F.col("root").alias("x")), "a")
            .join(unbroadcast(rep).select(F.col("node").alias("b"), F.col("root").alias("y")), "b")
            .where("x <> y")
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
            .distinct()
        )
        graph = materialize(moved, f"edges{k}")
    if not steps:
        return edges.sparkSession.createDataFrame([], "node long, root long")
    out = steps[0]
    for rep in steps[1:]:
        out = unbroadcast(out).join(rep.select(F.col("node").alias("root"), F.col("root").alias("up")), "root", "left").select("node", F.coalesce("up", "root").alias("root"))
    return out
