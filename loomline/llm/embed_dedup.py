"""Embedding near-duplicates by int8 tile products with rigorous error bounds.

Every vector is scaled to unit length and quantised to int8 with a scale of its own. The norm of what
quantisation lost is kept beside it; by Cauchy-Schwarz the true cosine lies within
``|e_x| (|y'| + |e_y|) + |x'| |e_y|`` of the product of the dequantised vectors x', y'. A tile is the product of two
blocks of vectors; only its pairs whose upper bound reaches the threshold are computed again in double
precision from the original components.

Equal vectors are one representative with a weight. Blocks are ranges of the projection on the leading
principal direction of a bounded sample: unit vectors of cosine c are sqrt(2 - 2c) apart, and so at most
that far in any projection, so tiles of ranges further apart are skipped without loss. A range with too
many vectors is split by hash. A tile returns link counts and a spanning forest of its links, never its pairs.
"""

from __future__ import annotations

import io
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.llm.components import components, forest
from loomline.llm.files import open_fs
from loomline.scratch import fresh_path, materialize

#: Vectors of a block, and rows of a tile multiplied at a time.
BLOCK, STRIP = 2048, 512
#: Vectors that the principal direction is estimated from, and ranges at most. Both only order the work.
SAMPLE, RANGES = 4096, 1024
#: Blocks at most on a side of a square of tiles that one task computes, and bytes that the blocks of both sides may take.
SIDE, HELD = 16, 128 << 20
#: Slack for rounding in the float32 product and in the bounds.
ROUNDING = 1e-5


def is_valid(vector: Column) -> Column:
    """Neither null, empty nor zero, and without null, NaN or infinite components."""
    fine = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales, and the norms of the dequantised vectors and of their errors, for unit rows."""
    scale = np.abs(x).max(1) / 127
    q = np.rint(x / scale[:, None]).astype(np.int8)
    back = q * scale[:, None]
    return q, scale, np.linalg.norm(back, axis=1), np.linalg.norm(x - back, axis=1)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # neither overflow nor underflow in the norm
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _prepared(x: np.ndarray) -> tuple[np.ndarray, ...]:
    """Unit rows, their codes, scales, norms and errors: made once a block."""
    u = unit(x)
    return (u, *quantise(u))


def tile_links(x: np.ndarray, y: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray, int]:
    """Indexes (i, j) of linked rows of two blocks (i < j if they are the same), and how many pairs were recomputed."""
    return _links(_prepared(x), _prepared(y), threshold, same)


def _links(left: tuple[np.ndarray, ...], right: tuple[np.ndarray, ...], threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray, int]:
    (ux, qx, sx, nx, ex), (uy, qy, sy, ny, ey) = left, right
    kind = np.float32 if ux.shape[1] <= 1040 else np.float64  # sums of 1040 products of int8 are exact in float32
    wide = qy.T.astype(kind)
    rows, cols, tried = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    for s in range(0, len(ux), STRIP):
        e = min(s + STRIP, len(ux))
        dot = qx[s:e].astype(kind) @ wide
        dot *= sx[s:e, None].astype(kind)
        dot *= sy.astype(kind)
        least = ex[s:e, None].astype(kind) * (ny + ey).astype(kind)
        least += nx[s:e, None].astype(kind) * ey.astype(kind)
        dot += least
        i, j = np.nonzero(dot >= threshold - ROUNDING)
        i += s
        if same:
            on = i < j
            i, j = i[on], j[on]
        tried += len(i)
        for a in range(0, len(i), 1 << 15):
            p, r = i[a : a + (1 << 15)], j[a : a + (1 << 15)]
            keep = np.einsum("ij,ij->i", ux[p], uy[r]) >= threshold
            rows.append(p[keep])
            cols.append(r[keep])
    return np.concatenate(rows), np.concatenate(cols), tried


def _write_block(folder: str):
    """One row for a block: its number, the last block near it, and the file with its ids, weights and components."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        block, dim, buf = int(group["block"].iloc[0]), int(group["dim"].iloc[0]), io.BytesIO()
        np.savez(buf, ids=group["rep"].to_numpy(np.int64), weights=group["weight"].to_numpy(np.int64), parts=np.stack(group["v"].to_list()))
        fs, root = open_fs(folder)
        path = f"{root}/{block}-{dim}-{uuid.uuid4().hex}"  # a name of its own for each attempt
        with fs.open_output_stream(path) as f:
            f.write(buf.getbuffer())
        return pd.DataFrame({"block": [block], "dim": [dim], "last": [int(group["last"].iloc[0])], "path": [path]})

    return run


def _tile(x: tuple[np.ndarray, ...], y: tuple[np.ndarray, ...], threshold: float, same: bool) -> tuple[np.ndarray, ...] | None:
    """Of two blocks (ids, weights, prepared rows): ids with their numbers of links, and a forest of the links."""
    (xi, xw, left), (yi, yw, right) = x, y
    i, j, _ = _links(left, right, threshold, same)
    if not len(i):
        return None
    near_x, near_y = np.bincount(i, yw[j], len(xi)).astype(np.int64), np.bincount(j, xw[i], len(yi)).astype(np.int64)
    return np.concatenate([xi[near_x > 0], yi[near_y > 0]]), np.concatenate([near_x[near_x > 0], near_y[near_y > 0]]), *forest(xi[i], yi[j])


def _squares(folder: str, threshold: float):
    """Rows (a, null, w) and (a, b, null) of squares of tiles; a task reads a block once a square."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = open_fs(folder)

        def read(entry: dict) -> tuple[np.ndarray, ...]:
            with fs.open_input_file(entry["path"]) as f, np.load(io.BytesIO(f.read())) as z:
                return z["ids"], z["weights"], _prepared(z["parts"].astype(np.float64))

        for b in batches:
            for one, two in zip(b.column("rows").to_pylist(), b.column("cols").to_pylist(), strict=True):
                blocks: dict[str, tuple[np.ndarray, ...]] = {}
                for p in one:
                    for q in two:
                        if p["dim"] != q["dim"] or not p["block"] <= q["block"] <= p["last"]:
                            continue
                        for x in (p, q):
                            if x["path"] not in blocks:
                                blocks[x["path"]] = read(x)
                        found = _tile(blocks[p["path"]], blocks[q["path"]], threshold, p["block"] == q["block"])
                        if found:
                            ids, links, u, v = found
                            none = lambda n: pa.nulls(n, pa.int64())
                            yield pa.RecordBatch.from_arrays([pa.array(ids), none(len(ids)), pa.array(links)], names=["a", "b", "w"])
                            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), none(len(u))], names=["a", "b", "w"])

    return run


def _linked(reps: DataFrame, n: int, threshold: float) -> DataFrame:
    """Rows (a, null, w): a has links to w rows in a tile; rows (a, b, null): a and b are connected in a tile."""
    sample = [r["v"] for r in reps.select("v", F.xxhash64("rep").alias("h")).orderBy("h").limit(SAMPLE).collect()]
    dims = [len(v) for v in sample]
    dim = max(set(dims), key=dims.count)
    x = unit(np.array([v for v in sample if len(v) == dim], np.float64))
    axis = np.linalg.eigh(x.T @ x)[1][:, -1]
    reach = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-6

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.zeros(b.num_rows)
            vectors = b.column("v").to_pylist()
            own = [i for i, v in enumerate(vectors) if len(v) == dim]
            if own:
                at[own] = unit(np.array([vectors[i] for i in own], np.float64)) @ axis
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at)], names=[*b.schema.names, "at"])

    kind = reps.schema["v"].dataType.simpleString()
    placed = materialize(reps.select("rep", "weight", "dim", "v").mapInArrow(project, f"rep long, weight long, dim int, v {kind}, at double"), "placed")
    parts = min(RANGES, max(1, math.ceil(n / BLOCK)))
    cuts = np.unique(placed.approxQuantile("at", [k / parts for k in range(1, parts)], 1 / (4 * parts)) if parts > 1 else [])
    # at most RANGES rows reach the driver
    range_of = F.lit(0) if not len(cuts) else F.size(F.filter(F.array(*map(F.lit, cuts.tolist())), lambda c: c <= F.col("at"))) if len(cuts) < 64 else _searched(cuts)
    ranged = placed.withColumn("range", range_of.cast("int"))
    facts = {r["range"]: r for r in ranged.groupBy("range").agg(F.count("*").alias("n"), F.min("at").alias("lo"), F.max("at").alias("hi")).collect()}
    order = sorted(facts)
    blocks = {k: max(1, math.ceil(facts[k]["n"] / BLOCK)) for k in order}
    begin, total = {}, 0
    for k in order:
        begin[k] = total
        total += blocks[k]
    near = {k: [m for m in order if facts[m]["lo"] - facts[k]["hi"] <= reach and facts[k]["lo"] - facts[m]["hi"] <= reach] for k in order}
    table = F.create_map(*(x for k in order for x in (F.lit(k), F.struct(F.lit(begin[k]).alias("begin"), F.lit(blocks[k]).alias("blocks"), F.lit(begin[near[k][-1]] + blocks[near[k][-1]] - 1).alias("last")))))
    row = ranged.withColumn("t", table[F.col("range")]).select("rep", "weight", "dim", "v", (F.col("t.begin") + F.pmod(F.xxhash64("rep"), F.col("t.blocks"))).cast("int").alias("block"), F.col("t.last").alias("last"))
    spark = reps.sparkSession
    folder = fresh_path(spark, "block-files")
    packed = materialize(row.groupBy("block", "dim").applyInPandas(_write_block(folder), "block int, dim int, last int, path string"), "blocks")
    # squares as large as memory allows, but enough of them for all cores
    side = max(1, min(SIDE, HELD // (2 * BLOCK * 9 * max(dims)), total // math.ceil(math.sqrt(8 * spark.sparkContext.defaultParallelism))))
    entry = F.struct("block", "dim", "last", "path")
    strips = packed.groupBy(F.floor(F.col("block") / side).cast("int").alias("p")).agg(F.collect_list(entry).alias("entries"), F.floor(F.max("last") / side).cast("int").alias("q"))
    rows = strips.select("p", F.col("entries").alias("rows"), F.explode(F.sequence("p", F.greatest("p", "q"))).alias("q"))
    squares = materialize(rows.join(strips.select(F.col("p").alias("q"), F.col("entries").alias("cols")), "q").select("rows", "cols"), "squares")
    # a square a task, as long as they are not too many
    return squares.repartition(max(1, min(squares.count(), 4096))).mapInArrow(_squares(folder, threshold), "a long, b long, w long")


def _searched(cuts: np.ndarray) -> Column:
    """Number of cuts at or below ``at``, by binary search in Arrow batches."""

    @F.pandas_udf("int")
    def search(at: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, at.to_numpy(), side="right").astype(np.int32))

    return search("at")


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95) -> DataFrame:
    """Per row: id, ``n_links`` (other rows linked directly), ``component_id`` (least id reachable), ``kept``.

    Vectors that are null, empty, zero or hold a null, NaN or infinite component link with nothing, nor do
    rows without an id: 0 links, themselves as component, kept. Vectors of unlike lengths do not link.
    Repeated rows (equal vectors) link with each other. Other columns of ``df`` are not read. An empty
    table gives no rows.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    fine = is_valid(F.col("v")) & F.col("id").isNotNull()
    good = rows.where(fine)
    reps = materialize(good.groupBy("v").agg(F.min("id").alias("rep"), F.count("*").alias("weight")).withColumn("dim", F.size("v")), "reps")
    facts = reps.select("v", "rep", "weight")
    if n := reps.count():
        marked = materialize(_linked(reps, n, threshold), "links")
        degree = marked.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("w").alias("links"))
        roots = components(marked.where("b is not null").select("a", "b"))
        least = roots.groupBy("root").agg(F.min("node").alias("least"))
        label = roots.join(least, "root").select(F.col("node").alias("rep"), "least")
        facts = facts.join(degree, "rep", "left").join(label, "rep", "left")
    else:
        facts = facts.withColumns({"links": F.lit(0), "least": F.lit(None).cast("long")})
    found = good.join(facts, "v").select("id", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("least", "rep").alias("component_id"))
    alone = rows.where(~fine).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return found.unionByName(alone).select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
