"""Centroid clustering in exact integers, with Hamerly's bounds.

Every vector keeps two numbers from round to round, in a table of the shared folder beside its integers: an upper bound of its distance
to its centroid and a lower bound of that to the second nearest. A round loosens them by how far the centroids moved; where the
upper one stays below the lower one, the centroid is still the only nearest one and nothing is computed. The others get the
exact distance to their own centroid, and, if that does not settle it, a scan of all centroids in exact integers. Bounds are
floating-point numbers rounded outwards, so they can cause a scan too many, never a wrong centroid.

Sums of a round are made per task, then per slice of tasks; the driver sees one row a centroid and slice.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomline.scratch import discard, materialize

DIM, CLUSTERS, ROUNDS, SCALE = 64, 40, 5, 256
#: Integers up to which all squared distances fit in 64 bits: vectors with a larger component take no part.
RANGE = 1 << 27
#: Integers up to which a product of matrices in double precision is exact (64 products below 2^44 each).
EXACT = 1 << 22
#: Relative margin that covers the rounding of roots and sums.
MARGIN = 1e-12
#: Vectors scanned at a time, slices of tasks summed apart (memory and fan-in only).
AT_ONCE, SLICES = 8192, 64


def integers(vec: Column) -> Column:
    """The integers of a vector; null where it is null, of another length, or holds a null, a non-finite or a too large component."""
    top = float(RANGE) / SCALE
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) > top))
    return F.when((F.size(vec) == DIM) & ~bad, F.transform(vec, lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double")).cast("int")))


def squared(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of every vector to every centroid, as int64."""
    if max(np.abs(q).max(initial=0), np.abs(c).max(initial=0)) < EXACT:
        x, y = q.astype(np.float64), c.astype(np.float64)
        return ((x * x).sum(1)[:, None] - 2.0 * (x @ y.T) + (y * y).sum(1)).astype(np.int64)
    return np.stack([((q - one) ** 2).sum(1) for one in c], axis=1)


def own_distance(q: np.ndarray, c: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Exact squared distance of every vector to the centroid that it has."""
    return ((q - c[a]) ** 2).sum(1)


def nearest(q: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of the nearest centroid (the smaller one on ties), an upper bound of the distance to it, a lower one of that to the second."""
    d = squared(q, c)
    a = d.argmin(1)
    first = np.sqrt(d[np.arange(len(q)), a].astype(np.float64)) * (1 + MARGIN)
    second = np.sqrt(np.partition(d, 1, axis=1)[:, 1].astype(np.float64)) * (1 - MARGIN) if len(c) > 1 else np.full(len(q), np.inf)
    return a, first, second


def drift(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """How far each centroid moved, rounded up."""
    return np.sqrt(((old - new) ** 2).sum(1).astype(np.float64)) * (1 + MARGIN)


def step(q: np.ndarray, a: np.ndarray, upper: np.ndarray, lower: np.ndarray, c: np.ndarray, moved: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One round of bounds: new numbers and bounds, and which vectors were scanned."""
    order = np.argsort(moved)
    far = np.full(len(c), moved[order[-1]])
    far[order[-1]] = moved[order[-2]] if len(c) > 1 else 0.0
    a = a.copy()
    upper = (upper + moved[a]) * (1 + MARGIN)
    # a difference of nearly equal numbers loses digits: the margin is taken of the larger one
    lower = lower - far[a] - MARGIN * np.where(np.isfinite(lower), lower, 0.0)
    open_ = np.flatnonzero(~(upper < lower))
    upper[open_] = np.sqrt(own_distance(q[open_], c, a[open_]).astype(np.float64)) * (1 + MARGIN)
    open_ = open_[~(upper[open_] < lower[open_])]
    if len(open_):
        a[open_], upper[open_], lower[open_] = nearest(q[open_], c)
    scanned = np.zeros(len(q), bool)
    scanned[open_] = True
    return a, upper, lower, scanned


def _vectors(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, DIM)


def _assign(state: DataFrame, c: np.ndarray, moved: np.ndarray | None) -> DataFrame:
    """``state`` (row columns, q, and after the first round a, u, l) with new numbers and bounds, and ``scanned``."""
    kept = [f for f in state.schema.fields if f.name not in ("a", "u", "l", "scanned")]
    schema = T.StructType([*kept, T.StructField("a", T.IntegerType()), T.StructField("u", T.DoubleType()), T.StructField("l", T.DoubleType()), T.StructField("scanned", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, AT_ONCE):
                b = whole.slice(first, AT_ONCE)
                col = lambda k: b.column(b.schema.get_field_index(k))  # noqa: B023,E731
                q = _vectors(col("q"))
                if moved is None:
                    a, u, low = nearest(q, c)
                    scanned = np.ones(len(q), bool)
                else:
                    a, u, low, scanned = step(q, *(col(k).to_numpy(zero_copy_only=False) for k in ("a", "u", "l")), c, moved)
                arrays = [col(f.name) for f in kept] + [pa.array(a.astype(np.int32)), pa.array(u), pa.array(low), pa.array(scanned)]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return state.mapInArrow(run, schema)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (number, count, sums or one vector) of a task added up by number."""
    n, s = {}, {}
    for b in batches:
        a, count, q = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False), _vectors(b.column(2))
        for k in np.unique(a).tolist():
            n[k] = n.get(k, 0) + int(count[a == k].sum())
            s[k] = s.get(k, 0) + q[a == k].sum(0)
    yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.int32()), pa.array(list(n.values()), pa.int64()), pa.array([s[k].tolist() for k in n], pa.list_(pa.int64()))], names=["a", "n", "s"])


def _sums(state: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """Per cluster that has vectors: their count and componentwise sums. One row a cluster and slice reaches the driver, 64-bit sums up to 2^36 vectors a slice."""
    schema = "a int, n long, s array<bigint>"
    part = state.select("a", F.lit(1).cast("long").alias("n"), "q").mapInArrow(_summed, schema)
    part = part.withColumn("slice", F.pmod(F.spark_partition_id(), F.lit(SLICES))).repartition("slice").select("a", "n", "s").mapInArrow(_summed, schema)
    out: dict[int, tuple[int, list[int]]] = {}
    for r in part.collect():
        n, s = out.get(r["a"], (0, [0] * DIM))
        out[r["a"]] = n + r["n"], [x + y for x, y in zip(s, r["s"], strict=True)]
    return out


def _moved_to(c: np.ndarray, sums: dict[int, tuple[int, list[int]]]) -> np.ndarray:
    new = c.copy()
    for k, (n, s) in sums.items():
        new[k] = [x // n for x in s]  # floor, below zero too
    return new


def seeds(state: DataFrame, id_col: str, clusters: int) -> np.ndarray:
    """The first centroids: vectors with the least SHA-256 of ``2:<id>``, equal ids by their integers; rows without an id come last."""
    key = F.sha2(F.concat(F.lit("2:"), F.col(id_col).cast("string")), 256)
    rows = state.select(key.alias("h"), "q").orderBy(F.asc_nulls_last("h"), "q").limit(clusters).collect()
    return np.array([r["q"] for r in rows], np.int64).reshape(-1, DIM)


def centroid_hash(c: np.ndarray) -> list[str]:
    return [hashlib.sha256(",".join(map(str, one)).encode()).hexdigest() for one in c.tolist()]


def cluster(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS, report: list | None = None) -> DataFrame:
    """Per vector: id, ``cluster``, ``distance`` (squared, exact), ``cluster_inertia``, ``inertia`` and ``centroid_sha256`` of its centroid.

    Vectors that are null, not of 64 components, or hold a null or a non-finite component take no part, nor do those whose integers
    pass 2^27 in size (components beyond 524,288), as their squared distances do not fit in 64 bits. Repeated rows count and come back
    each; rows without an id take part and seed no cluster while others are left. Fewer vectors than ``clusters`` give as many
    centroids; equal ones leave the later empty, which stays where it is. No vector gives no rows. An inertia beyond 64 bits
    is null. Only the two columns named are read. ``report`` receives (round, vectors, scanned) after each assignment.
    """
    spark = df.sparkSession
    kind = df.schema[id_col].dataType.simpleString()
    kept = df.select(F.col(id_col).alias("id"), integers(F.col(vec_col)).alias("q")).where("q is not null")
    state = materialize(kept, "vectors")
    c = seeds(state, "id", clusters)
    out = f"{id_col} {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not len(c):
        return spark.createDataFrame([], out)
    moved = None
    for r in range(rounds + 1):
        following = materialize(_assign(state, c, moved), f"bounds{r}")
        discard(state)
        state = following
        if report is not None:
            got = state.agg(F.count("*").alias("n"), F.count_if("scanned").alias("scanned")).first()
            report.append((r, got["n"], got["scanned"]))
        if r < rounds:
            new = _moved_to(c, _sums(state))
            moved, c = drift(c, new), new

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a = b.column(1).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(own_distance(_vectors(b.column(2)), c, a), pa.int64())], names=["id", "cluster", "distance"])

    last = materialize(state.select("id", "a", "q").mapInArrow(final, f"id {kind}, cluster int, distance long"), "clustered")
    discard(state)
    big = F.sum(F.col("distance").cast("decimal(38,0)"))
    sums = {r["cluster"]: int(r["s"]) for r in last.groupBy("cluster").agg(big.alias("s")).collect()}  # one row a cluster
    fits = lambda n: n if n < 1 << 63 else None
    side = [(k, fits(s), fits(sum(sums.values())), h) for (k, h) in enumerate(centroid_hash(c)) if (s := sums.get(k)) is not None]
    side = spark.createDataFrame(side, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return last.withColumnRenamed("id", id_col).join(F.broadcast(side), "cluster").select(id_col, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
