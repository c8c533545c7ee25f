"""Approximate nearest neighbours by multiprobe p-stable hashing.

Largest inner product is turned into least Euclidean distance by one more component that gives all
candidates the same length. Each table hashes a vector with a few functions floor((a.x + b) / w), a
Gaussian. A neighbour of a query may fall into the query's own slot or the next slot on either side, for each
function; the chance of each follows from the query's place in its slot and the typical distance of a
neighbour. Buckets are probed in the order of the product of these chances until their sum reaches
the table's share of success. Candidates of all tables are reranked exactly.

A bucket is cut into blocks of bounded size by hash, each query that probes it goes to each of its blocks, and a
block returns the best candidates of each query. The likeliest buckets are probed first: the k-th best score found
there bounds what the other buckets have to return, which keeps the rows per query level as the table grows. Equal
vectors are hashed once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomline.llm.embed_dedup import is_valid
from loomline.scratch import materialize

#: Rows that the scale of distances and the least scores of queries are taken from (bound of what is fitted).
SAMPLE = 2048
#: Probes of each table, likeliest first, that are made before the others and bound their results.
FIRST = 4
#: Rows of a bucket handled together.
BLOCK = 2048


class Tables:
    """Hash functions of all tables, for vectors of one length."""

    def __init__(self, dim: int, radius: float, spread: float, tables: int, hashes: int, width: float, seed: int = 7):
        """radius: length that all candidates are brought to; spread: typical distance of a neighbour; width: of a slot, in spreads."""
        rng = np.random.default_rng(seed)
        self.radius, self.spread, self.w = radius, spread, width * spread
        self.a = rng.normal(size=(tables, hashes, dim + 1))
        self.b = rng.uniform(0, self.w, (tables, hashes))
        steps = np.array(np.meshgrid(*[[-1, 0, 1]] * hashes, indexing="ij")).reshape(hashes, -1).T
        self.steps = steps
        self.mix = rng.integers(1, 1 << 62, hashes + 1, dtype=np.int64) | 1

    def _key(self, t: int, slots: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = (slots.astype(np.int64) * self.mix[:-1]).sum(-1) + np.int64(t + 1) * self.mix[-1]
            return h ^ (h >> 31)

    def keys(self, x: np.ndarray) -> np.ndarray:
        """Bucket of each candidate in each table."""
        rest = np.sqrt(np.maximum(0, self.radius**2 - (x * x).sum(1)))
        x = np.concatenate([x, rest[:, None]], 1)
        return np.stack([self._key(t, np.floor((x @ a.T + b) / self.w)) for t, (a, b) in enumerate(zip(self.a, self.b, strict=True))], 1)

    def probes(self, q: np.ndarray, share: float) -> Iterator[tuple[int, int, np.ndarray]]:
        """For each query and table the buckets to probe, likeliest first."""
        q = q * (self.radius / np.linalg.norm(q, axis=1, keepdims=True))
        q = np.concatenate([q, np.zeros((len(q), 1))], 1)
        for t, (a, b) in enumerate(zip(self.a, self.b, strict=True)):
            place = (q @ a.T + b) / self.w
            slot = np.floor(place)
            inside, s = place - slot, math.sqrt(2) * self.spread / self.w
            below, upto, beyond = (_normal((c - inside) / s) for c in (np.zeros_like(inside), np.ones_like(inside), np.full_like(inside, 2.0)))
            chance = np.stack([below - _normal((-1 - inside) / s), upto - below, beyond - upto], 2)
            for i in range(len(q)):
                odds = np.ones(1)
                for c in chance[i]:
                    odds = (odds[:, None] * c).ravel()
                order = np.argsort(-odds, kind="stable")
                n = min(int(np.searchsorted(np.cumsum(odds[order]), share)) + 1, len(order))
                yield i, t, self._key(t, slot[i] + self.steps[order[:n]])


def _normal(z: np.ndarray) -> np.ndarray:
    """Logistic approximation of the Gaussian distribution function of sqrt(2) z (only orders probes)."""
    z = z * math.sqrt(2)
    return 1 / (1 + np.exp(-np.clip(1.5976 * z + 0.070565992 * z**3, -60, 60)))


def _array(column) -> np.ndarray:
    return np.array(column.to_pylist() if isinstance(column, pa.Array) else list(column), np.float64)


def search(df: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", tables: int = 2, hashes: int = 6, width: float = 2.5, share: float = 0.7) -> DataFrame:
    """Per query its ``k`` nearest candidates found: ``query_id, rank, vec_id, score`` (inner product, double).

    ``queries`` and ``df`` have the same two columns; a candidate with the query's own id is left out. Ties go to the
    smaller id. Fewer than k candidates give fewer rows. Vectors that are null, empty, zero or hold null or
    non-finite components, and rows without an id, take no part. Vectors of each length are searched among themselves.
    Repeated rows of one id count as one (the least vector). An empty table gives no rows.
    share: success that each table aims at; all tables reach 1 - (1 - share)^tables.
    """
    spark = df.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    pick = lambda d: d.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(is_valid(F.col("v")) & F.col("id").isNotNull())
    single = lambda d: pick(d).groupBy("id").agg(F.min("v").alias("v"))
    rows = materialize(single(df), "rows")
    asked = materialize(single(queries), "asked")
    dims = sorted(r["dim"] for r in asked.select(F.size("v").alias("dim")).distinct().join(rows.select(F.size("v").alias("dim")).distinct(), "dim").collect())
    found = [_search(rows.where(F.size("v") == d), asked.where(F.size("v") == d), d, k, tables, hashes, width, share) for d in dims]
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], schema)


def _search(own: DataFrame, asked: DataFrame, dim: int, k: int, tables: int, hashes: int, width: float, share: float) -> DataFrame:
    """The search among valid vectors of length ``dim``, one row an id (columns id and v), of which there is one at least."""
    x = np.array([r["v"] for r in own.orderBy(F.xxhash64("id"), "id").select("v").limit(SAMPLE).collect()])
    n, top = own.agg(F.count("*"), F.max(F.aggregate("v", F.lit(0.0), lambda s, y: s + y * y))).first()
    radius = math.sqrt(top)
    # distance of the k-th neighbour of a candidate-long query, as far as the sample shows it
    s = x[:256] * (radius / np.linalg.norm(x[:256], axis=1, keepdims=True)) @ x.T
    at = min(len(x) - 1, max(1, round(k * len(x) / n)))
    gain = float(np.median(-np.sort(-s, axis=1)[:, at]))
    spread = math.sqrt(max(2 * radius**2 - 2 * gain, 1e-6 * radius**2))
    hashing = Tables(dim, radius, spread, tables, hashes, width)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = hashing.keys(_array(b.column("v"))) if b.num_rows else np.zeros((0, tables), np.int64)
            for t in range(tables):
                yield pa.RecordBatch.from_arrays([b.column("rep"), pa.array(keys[:, t].copy())], names=["rep", "bucket"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                ids, q = part.column("rep").to_numpy(), _array(part.column("v"))
                own, bucket, later = [], [], []
                for i, _, keys in hashing.probes(q, share):
                    own.append(np.full(len(keys), i))
                    bucket.append(keys)
                    later.append(np.arange(len(keys)) >= FIRST)
                if not own:
                    continue
                own = np.concatenate(own)
                # a place well below the k-th best of the sample bounds the k-th best of all from below
                at_least = 2 * k + 1
                least = np.sort(q @ x.T, axis=1)[:, -at_least] if len(x) >= at_least else np.full(len(q), -np.inf)
                least = least - 1e-9 * np.abs(least)
                yield pa.RecordBatch.from_arrays([pa.array(ids[own]), pa.array(np.concatenate(bucket)), pa.array(np.concatenate(later)), pa.array(least[own])], names=["rep", "bucket", "later", "least"])

    reps = materialize(own.groupBy("v").agg(F.min("id").alias("rep")), "reps")
    q_reps = materialize(asked.groupBy("v").agg(F.min("id").alias("rep")), "q-reps")
    placed = materialize(reps.mapInArrow(index, "rep long, bucket long"), "placed")
    sizes = materialize(placed.groupBy("bucket").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "sizes")
    data = materialize(placed.join(sizes, "bucket").join(reps, "rep").select("bucket", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int").alias("block"), F.lit(False).alias("asks"), "rep", "v", F.lit(0.0).alias("least")), "data")
    probed = materialize(q_reps.mapInArrow(probe, "rep long, bucket long, later boolean, least double").join(sizes, "bucket"), "probes")

    def best(group: pd.DataFrame) -> pd.DataFrame:
        q, c = group[group["asks"]], group[~group["asks"]]
        out = []
        if len(q) and len(c):
            y, ids = _array(c["v"]), c["rep"].to_numpy(np.int64)
            order = np.argsort(ids)
            y, ids = y[order], ids[order]
            for at in range(0, len(q), 512):
                part = q.iloc[at : at + 512]
                z = _array(part["v"])
                s = z @ y.T
                s[s < part["least"].to_numpy()[:, None]] = -np.inf
                m = min(k + 1, s.shape[1])
                if s.shape[1] > m + 8:
                    # all that reach the m-th best, ties included
                    floor = np.partition(s, -m, axis=1)[:, -m]
                    s[s < (floor - 1e-9 * np.abs(floor))[:, None]] = -np.inf
                i, j = np.nonzero(s > -np.inf)
                out.append(pd.DataFrame({"q": part["rep"].to_numpy(np.int64)[i], "rep": ids[j], "score": np.einsum("ij,ij->i", z[i], y[j])}))
        return pd.concat(out) if out else pd.DataFrame({"q": pd.Series([], dtype="int64"), "rep": pd.Series([], dtype="int64"), "score": pd.Series([], dtype="float64")})

    def ask(probes: DataFrame) -> DataFrame:
        asks = probes.join(q_reps, "rep").select("bucket", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(True).alias("asks"), "rep", "v", "least")
        return data.unionByName(asks).groupBy("bucket", "block").applyInPandas(best, "q long, rep long, score double")

    order = Window.partitionBy("q").orderBy(F.desc("score"), "rep")
    once = lambda h: h.groupBy("q", "rep").agg(F.max("score").alias("score"))
    early = materialize(once(ask(probed.where("not later"))), "early")
    bound = early.withColumn("r", F.row_number().over(order)).where(F.col("r") == k + 1).select(F.col("q").alias("rep"), (F.col("score") - 1e-9 * F.abs("score")).alias("bound"))
    late = ask(probed.where("later").join(bound, "rep", "left").withColumn("least", F.greatest("least", "bound")))
    hits = once(early.unionByName(late))
    near = hits.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1).drop("r")
    # of equal vectors the k+1 least ids suffice; hot vectors are thinned by salt first
    member = own.join(reps, "v").select("rep", "id", F.pmod(F.xxhash64("id"), F.lit(256)).alias("salt"))
    member = member.withColumn("r", F.row_number().over(Window.partitionBy("rep", "salt").orderBy("id"))).where(F.col("r") <= k + 1)
    member = member.withColumn("r", F.row_number().over(Window.partitionBy("rep").orderBy("id"))).where(F.col("r") <= k + 1).select("rep", "id")
    lists = near.join(member, "rep").withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))).where(F.col("r") <= k + 1)
    each = asked.join(q_reps, "v").select(F.col("id").alias("query_id"), F.col("rep").alias("q"))
    ranked = each.join(lists.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("r", "id", "score"))).alias("l")), "q")
    found = ranked.select("query_id", F.posexplode(F.slice(F.filter("l", lambda x: x["id"] != F.col("query_id")), 1, k)).alias("rank", "x"))
    return found.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"), F.col("x.score").alias("score"))
