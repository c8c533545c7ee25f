"""Near copies by the Jaccard similarity of word shingles, found by SimHash and by minima of hashes, decided on the whole sets.

Texts with the same set of shingles are one class. Candidates come in three steps, and each leaves out pairs that are joined already:
SimHash fingerprints within the radius that the grid range-join of segment bit counts can search; then, for what
differs in more bits, places of a few minima, where in every round each component of a place is compared with one drawn member;
last, every pair of a place whose sides are in different components still. A sketch of four bits a minimum spares the
texts of nearly all pairs below the threshold; the others are compared by their whole sets. In large places the last
step goes tile by tile, a block of members against a block of those outside, and returns links only.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomline.layout import unbroadcast
from loomline.llm import simhash
from loomline.llm.arrow import per_text, release
from loomline.llm.components import components
from loomline.scratch import materialize, tidy

WIDTH, THRESHOLD = 5, 0.8
#: A pair at the threshold misses all bands with a chance of (1 - 0.8^5)^32, 4 in a million.
BANDS, ROWS = 32, 5
#: Of the 160 minima of a pair at the threshold, 30 differ in the sketch, give or take 4.9; a pair is dismissed beyond this many, 4.4 deviations.
DIFFERENT = 52
#: Rounds in which components meet one drawn member of a place, before all pairs that are left do.
DRAWS = 2
#: Pairs of a place, of members with those outside its largest component, up to which they are joined one by one; in larger
#: places, tiles of so many members and others (about) are compared at once.
LARGE, MEMBERS, OTHERS = 4096, 512, 256
_RNG = np.random.default_rng(42)
_MULTIPLY = _RNG.integers(0, 1 << 63, (BANDS * ROWS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FLIP = _RNG.integers(0, 1 << 63, (BANDS * ROWS, 1), dtype=np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Shingles hashed at a time (memory only).
AT_ONCE = 1 << 12


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Distinct hashes of the word shingles of a whole text, in order."""
    return np.unique(simhash.shingle_hashes(text, width))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two arrays of distinct values; 1 for two empty ones."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    union = len(a) + len(b) - both
    return both / union if union else 1.0


def minima(h: np.ndarray) -> np.ndarray:
    """The least value of a set under each of the hash functions."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for s in range(0, len(h), AT_ONCE):
        least = np.minimum(least, ((h[s : s + AT_ONCE] ^ _FLIP) * _MULTIPLY).min(1))
    return least


def places(least: np.ndarray) -> list[int]:
    """The place of a set in each band, from its minima."""
    import xxhash

    return [xxhash.xxh64_intdigest(m.tobytes(), k) - (1 << 63) for k, m in enumerate(least.reshape(BANDS, ROWS))]


def sketch(least: np.ndarray) -> np.ndarray:
    """Four bits of each minimum, sixteen minima to a word."""
    nibbles = (least * _MIX >> np.uint64(60)).reshape(-1, 16) << (np.arange(16, dtype=np.uint64) * np.uint64(4))
    return np.bitwise_or.reduce(nibbles, axis=1).view(np.int64)


def different(a: Column, b: Column) -> Column:
    """Minima that differ in two sketches."""
    out = []
    for k in range(BANDS * ROWS // 16):
        x = a[k].bitwiseXOR(b[k])
        x = reduce(lambda p, q: p.bitwiseOR(q), [F.shiftrightunsigned(x, s) for s in (1, 2, 3)], x)
        out.append(F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111))))
    return reduce(lambda p, q: p + q, out)


def _sets(df: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """Per row the key of its class, the number of shingles, fingerprint, places, sketch and the text."""

    def make():
        def f(texts):
            out = {k: [] for k in ("key", "n", "fp", "places", "sketch")}
            for t in texts:
                every = simhash.shingle_hashes(t, width)
                h = np.unique(every)
                least = minima(h)
                out["key"].append(_key(h))
                out["n"].append(len(h))
                out["fp"].append(simhash.of_hashes(h))
                out["places"].append(places(least) if len(h) else [])
                out["sketch"].append(sketch(least))
            arrays = {"key": pa.array(out["key"], pa.int64()), "n": pa.array(out["n"], pa.int64()), "fp": pa.array(np.array(out["fp"], np.uint64).view(np.int64))}
            lists = {k: pa.array(out[k], pa.list_(pa.int64())) for k in ("places", "sketch")}
            return arrays | lists | {"body": pa.array(texts, pa.string())}

        return f

    return per_text(df, id_col, text_col, "key long, n long, fp long, places array<bigint>, sketch array<bigint>, body string", make)


def with_key(df: DataFrame, text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """``df`` with the ``key`` of each text's class, as :func:`near_duplicates` returns it."""
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = pa.array([_key(shingle_set(t, width)) for t in b.column(at).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns, keys], names=[*b.schema.names, "key"])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("key", T.LongType())]))


def _key(h: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(h.tobytes(), 7) - (1 << 63)


def _alike(m: Column, n: Column, threshold: float) -> Column:
    """Whether sets of two sizes can have the threshold at all."""
    return F.least(m, n) >= F.lit(threshold) * F.greatest(m, n) - 1e-9


def _bodies(rows: DataFrame, used: DataFrame) -> DataFrame:
    """One text of each class of ``used``; texts of a class have one set, so any of them stands for it."""
    used = materialize(used, "used")  # its size is known then, and a small one needs no shuffle of texts
    return materialize(rows.select("key", "body").join(used, "key", "left_semi").groupBy("key").agg(F.min("body").alias("body")), "bodies")


def _similar(pairs: DataFrame, bodies: DataFrame, width: int, threshold: float) -> DataFrame:
    """Those of ``pairs`` (a, b: keys) whose sets have at least the threshold, by the texts of ``bodies``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, None
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                a, b, x, y = (c.to_pylist() for c in batch.slice(first, 500).columns)
                good = []
                for k, s, t in zip(a, x, y, strict=True):
                    if k != last:  # pairs with one left side often come together
                        last, own = k, shingle_set(s, width)
                    good.append(jaccard(own, shingle_set(t, width)) >= threshold)
                yield pa.RecordBatch.from_arrays([pa.array([v for v, g in zip(c, good, strict=True) if g], pa.int64()) for c in (a, b)], names=["a", "b"])
        release()

    side = lambda k, c: bodies.select(F.col("key").alias(k), F.col("body").alias(c))
    both = pairs.join(side("b", "y"), "b").join(side("a", "x"), "a").select("a", "b", "x", "y")
    return both.mapInArrow(run, "a long, b long")


class _Tile:
    """Members and others of one tile; all their pairs are compared at once by the members' postings."""

    def __init__(self, name: int):
        self.name, self.members, self.others = name, [], []

    def links(self, threshold: float) -> Iterator[tuple[int, int]]:
        """Of each other, one link to each component of members that it has a link with."""
        if not self.members or not self.others:
            return
        keys, roots, sets = zip(*self.members, strict=True)
        roots, size = np.array(roots), np.array([len(h) for h in sets])
        flat = np.concatenate(sets)
        order = np.argsort(flat, kind="stable")
        owner, flat = np.repeat(np.arange(len(sets)), size)[order], flat[order]
        for key, root, h in self.others:
            lo, hi = np.searchsorted(flat, h), np.searchsorted(flat, h, side="right")
            n = hi - lo
            both = np.bincount(owner[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))], minlength=len(sets))
            good = np.flatnonzero((both >= threshold * (size + len(h) - both) - 1e-9) & (roots != root))
            for i in good[np.unique(roots[good], return_index=True)[1]].tolist():
                yield keys[i], key


def _tiles(here: DataFrame, bodies: DataFrame, width: int, threshold: float) -> DataFrame:
    """Links of large places: blocks of members against blocks of the others, by whole sets. Equal pairs of several places may come twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile = _Tile(0)
        out: list[tuple[int, int]] = []

        def flush() -> pa.RecordBatch:
            got = pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in (0, 1)], names=["a", "b"])
            out.clear()
            return got

        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                for name, other, key, root, body in zip(*(c.to_pylist() for c in batch.slice(first, 500).columns), strict=True):
                    if name != tile.name:
                        out += tile.links(threshold)
                        tile = _Tile(name)
                    (tile.others if other else tile.members).append((key, root, shingle_set(body, width)))
                yield flush()
        out += tile.links(threshold)
        yield flush()
        release()

    blocks = lambda n, size: F.greatest(F.lit(1), F.ceil(F.col(n) / size)).cast("int")
    here = here.withColumns({"m": blocks("total", MEMBERS), "o": blocks("outside", OTHERS)})
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    at = lambda n: F.pmod(F.xxhash64("key"), F.col(n)).cast("int")
    member = here.select("place", at("m").alias("i"), every("o").alias("j"), F.lit(False).alias("other"), "key", "root")
    other = here.where("root <> top").select("place", every("m").alias("i"), at("o").alias("j"), F.lit(True).alias("other"), "key", "root")
    rows_of = member.unionByName(other).select(F.xxhash64("place", "i", "j").alias("tile"), "other", "key", "root")
    full = rows_of.join(bodies, "key").select("tile", "other", "key", "root", "body")
    return full.repartition("tile").sortWithinPartitions("tile").mapInArrow(run, "a long, b long")


class _Groups:
    """Classes, and the components that the links found so far make of them."""

    def __init__(self, bodies: DataFrame, classes: DataFrame, width: int, threshold: float):
        self.bodies, self.classes, self.width, self.threshold = bodies, classes, width, threshold
        self.roots = classes.select("key", F.col("key").alias("root"))

    def test(self, pairs: DataFrame, name: str) -> None:
        """Compare candidate pairs (a, b, and sizes m, n and sketches s, t), and join the components of those alike."""
        pairs = pairs.where(_alike(F.col("m"), F.col("n"), self.threshold) & (different(F.col("s"), F.col("t")) <= DIFFERENT)).select("a", "b").distinct()
        pairs = materialize(pairs, f"{name}_pairs")
        if pairs.isEmpty():
            return
        self.join(_similar(pairs, self.bodies, self.width, self.threshold), name)

    def join(self, found: DataFrame, name: str) -> None:
        """Join the components of linked classes (a, b: keys)."""
        found = materialize(found, f"{name}_found")
        up = lambda k, c: unbroadcast(self.roots).select(F.col("key").alias(k), F.col("root").alias(c))
        # links between components; nodes of this graph are roots
        links = found.join(up("a", "x"), "a").join(up("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
        moved = components(links).select(F.col("node").alias("root"), F.col("root").alias("up"))
        self.roots = materialize(unbroadcast(self.roots).join(moved, "root", "left").select("key", F.coalesce("up", "root").alias("root")), f"{name}_roots")

    def side(self, key: str, size: str, own: str) -> DataFrame:
        return unbroadcast(self.classes).select(F.col("key").alias(key), F.col("n").alias(size), F.col("sketch").alias(own))

    def with_sides(self, pairs: DataFrame) -> DataFrame:
        return pairs.join(self.side("a", "m", "s"), "a").join(self.side("b", "n", "t"), "b")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, threshold: float = THRESHOLD) -> DataFrame:
    """Per row: id, ``key`` of the class, ``component_id``, the least id reachable over pairs of texts with at least the Jaccard ``threshold``,
    and ``leads``: whether the row has the component's least id and, of the classes with that id, the least key.

    Texts without words are alike. Repeated rows come back repeated, and equal ones lead together; a null id is never a component_id unless its
    component has no other. An empty table gives no rows; very long texts count as a whole. Only the two columns named are read.
    Classes are told apart by 64-bit keys of their sets. Working tables are dropped at the end.
    """
    with tidy() as keep:
        return keep(materialize(_near_duplicates(df, id_col, text_col, width, threshold), "near"))


def _near_duplicates(df: DataFrame, id_col: str, text_col: str, width: int, threshold: float) -> DataFrame:
    rows = materialize(_sets(df, id_col, text_col, width), "sets")
    # one row of a class stands for it: the sets, and with them all that is made of them, are equal
    one = ["n", "fp", "places", "sketch"]
    classes = materialize(rows.groupBy("key").agg(F.min(id_col).alias("least"), *(F.first(c).alias(c) for c in one)), "classes")

    # SimHash: classes of one fingerprint, and fingerprints within the radius
    prints = classes.groupBy("fp").agg(F.min("key").alias("rep"))
    same = unbroadcast(classes).join(prints, "fp").where("key <> rep").select(F.col("rep").alias("a"), F.col("key").alias("b"))
    rep = lambda f, k: unbroadcast(prints).select(F.col("fp").alias(f), F.col("rep").alias(k))
    near = simhash.links(prints.select("fp")).distinct().select(F.col("a").alias("f"), F.col("b").alias("g")).join(rep("f", "a"), "f").join(rep("g", "b"), "g").select("a", "b")
    close = materialize(same.unionByName(near), "close")

    placed = classes.select("key", F.posexplode("places").alias("band", "place")).select("key", F.xxhash64("band", "place").alias("place"))
    shared = materialize(placed.groupBy("place").agg(F.count("*").alias("many")).where("many > 1").select("place"), "shared")
    placed = materialize(unbroadcast(placed).join(shared, "place"), "placed")
    # texts are moved once, and only those of classes that any step may compare
    each = [d.select(F.col(c).alias("key")) for d, c in ((placed, "key"), (close, "a"), (close, "b"))]
    bodies = _bodies(rows, reduce(DataFrame.unionByName, each).distinct())
    groups = _Groups(bodies, classes, width, threshold)
    groups.test(groups.with_sides(close), "simhash")
    for k in range(DRAWS):
        here = unbroadcast(placed).join(groups.roots, "key")
        # a component's member and a place's: the least hashes, new in every round
        drawn = here.groupBy("place", "root").agg(F.min(F.struct(F.xxhash64("key", F.lit(k)).alias("h"), "key")).alias("d"))
        centre = drawn.groupBy("place").agg(F.min(F.struct("d", "root")).alias("c"), F.count("*").alias("many")).where("many > 1")
        pairs = unbroadcast(drawn).join(centre, "place").where(F.col("root") != F.col("c.root")).select(F.col("c.d.key").alias("a"), F.col("d.key").alias("b")).distinct()
        groups.test(groups.with_sides(pairs), f"draw{k}")

    # all that is left: members outside a place's largest component against all of the place
    here = unbroadcast(placed).join(groups.roots, "key")
    sizes = here.groupBy("place", "root").agg(F.count("*").alias("size"))
    most = sizes.groupBy("place").agg(F.max(F.struct("size", "root")).alias("top"), F.sum("size").alias("total"), F.count("*").alias("many")).where("many > 1")
    here = unbroadcast(here).join(most.select("place", F.col("top.root").alias("top"), "total", (F.col("total") - F.col("top.size")).alias("outside")), "place")
    here = materialize(here, "left")
    few = F.col("total") * F.col("outside") <= LARGE
    large, small = here.where(~few), unbroadcast(here.where(few)).join(classes.select("key", "n", "sketch"), "key")
    if not large.isEmpty():
        groups.join(_tiles(large, bodies, width, threshold), "tiles")
    member = small.select("place", F.col("key").alias("a"), F.col("n").alias("m"), F.col("sketch").alias("s"), F.col("root").alias("x"), "top")
    other = small.where("root <> top").select("place", F.col("key").alias("b"), "n", F.col("sketch").alias("t"), F.col("root").alias("y"))
    # of two that are both outside the largest component, the lesser key is the member
    met = (F.col("x") != F.col("y")) & ((F.col("x") == F.col("top")) | (F.col("a") < F.col("b")))
    alike = _alike(F.col("m"), F.col("n"), threshold) & (different(F.col("s"), F.col("t")) <= DIFFERENT)
    pairs = unbroadcast(member).join(other, (member["place"] == other["place"]) & met & alike)
    groups.test(pairs.select("a", "b", "m", "n", "s", "t"), "left")

    roots = unbroadcast(classes.select("key", "least")).join(groups.roots, "key")
    first = F.min(F.struct(F.col("least").isNull().alias("none"), "least", "key")).alias("first")
    lead = roots.groupBy("root").agg(first).select("root", F.col("first.least").alias("component_id"), F.col("first.key").alias("lead"))
    found = unbroadcast(roots.select("key", "root")).join(lead, "root").select("key", "component_id", "lead")
    leads = F.col(id_col).eqNullSafe(F.col("component_id")) & (F.col("key") == F.col("lead"))
    return unbroadcast(rows.select(id_col, "key")).join(found, "key").select(id_col, "key", "component_id", leads.alias("leads"))
