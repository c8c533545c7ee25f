"""SimHash near-duplicates: fingerprints, and their links within a Hamming radius.

Links are searched in the space of *segment bit counts*: a fingerprint becomes the vector of the number
of set bits in each of its segments, and the Manhattan distance of two such vectors never exceeds the
Hamming distance. The vector is cut into two halves, so that for a radius of 3 one half is within
Manhattan distance 1; the half vectors are cells of a unit grid, and the range join looks up a cell and
its neighbours. Of a pair of neighbouring cells only the one with the smaller count looks, so a pair is
met once a half. The exact Hamming test is part of the join condition.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.layout import unbroadcast
from loomline.llm.arrow import per_text
from loomline.llm.components import components
from loomline.scratch import materialize

SEED = 42
SEGMENT_BITS = 2
#: Shingles whose hashes are counted at a time (memory only).
COUNTED = 1 << 16


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """Hash of each word shingle of a whole text (of all its words, if they are fewer); none without a word."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line = memoryview(b" ".join(words))
    n = max(1, len(words) - width + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    first = [0, *(ends[: n - 1] + 1).tolist()]
    last = ends[-n:].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[s:e], SEED) for s, e in zip(first, last, strict=True)], np.uint64)


def fingerprint(text: str | None, width: int = 3) -> int:
    """64-bit SimHash of the word shingles of a whole text; 0 without a word."""
    return of_hashes(shingle_hashes(text, width))


def of_hashes(h: np.ndarray) -> int:
    """64-bit SimHash of hashes: each bit as in most of them; 0 without any."""
    n = len(h)
    set_in = np.zeros(64, np.int64)
    for s in range(0, n, COUNTED):
        part = h[s : s + COUNTED]
        set_in += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * set_in > n).tolist())


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """``fp`` (long, the 64 bits) of every whole text. Null and empty texts have fingerprint 0."""

    def make():
        def f(texts):
            return {"fp": pa.array(np.array([fingerprint(t, width) for t in texts], np.uint64).view(np.int64))}

        return f

    return per_text(df, id_col, text_col, "fp long", make)


def links(fps: DataFrame, radius: int = 3) -> DataFrame:
    """Pairs ``a, b`` (a link may come more than once) of different values of ``fp`` that differ in 1 to ``radius`` bits.

    ``fps`` holds distinct fingerprints. radius is 2 or 3: then one of two halves is within distance 1.
    """
    if radius not in (2, 3):
        raise ValueError("radius must be 2 or 3")
    per_half, mask = 32 // SEGMENT_BITS, (1 << SEGMENT_BITS) - 1
    count = lambda half, i: F.bit_count(F.shiftrightunsigned("fp", 32 * half + SEGMENT_BITS * i).bitwiseAND(F.lit(mask)))
    cells, steps = [], []
    for half in (0, 1):
        c = [count(half, i) for i in range(per_half)]
        cell = sum((c[i].cast("long") * (1 << (2 * i)) for i in range(1, per_half)), c[0].cast("long")) * 2 + half
        cells.append(cell)
        # a cell itself, and the next cell along each segment that is not full
        steps.append(F.array(F.lit(0).cast("long"), *(F.when(c[i] < SEGMENT_BITS, F.lit(2 << (2 * i)).cast("long")) for i in range(per_half))))
    index = fps.select("fp", F.explode(F.array(*cells)).alias("cell"))
    both = fps.select("fp", F.explode(F.array(*(F.struct(c.alias("cell"), s.alias("steps")) for c, s in zip(cells, steps, strict=True)))).alias("x"))
    probe = both.select(F.col("fp").alias("q"), F.col("x.cell").alias("own"), F.explode(F.array_compact("x.steps")).alias("d")).select("q", (F.col("own") + F.col("d")).alias("cell"), "d")
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("q"))) <= radius
    pairs = unbroadcast(index).join(probe, (index["cell"] == probe["cell"]) & near & ((F.col("d") != 0) | (F.col("q") < F.col("fp"))))
    return pairs.select(F.col("q").alias("a"), F.col("fp").alias("b"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 3) -> DataFrame:
    """Per row: id, ``fingerprint`` (16 hex digits) and ``component_id``, the least id reachable over links.

    Rows with one fingerprint are linked; texts without words share fingerprint zero and are linked
    like any other. Repeated rows come back repeated; a null id is returned but never a component_id unless
    its component has no other; other columns of ``df`` are not touched. An empty table gives no rows.
    """
    prints = materialize(fingerprints(df, id_col, text_col, width), "prints")
    classes = materialize(prints.groupBy("fp").agg(F.min(id_col).alias("least")), "classes")
    found = components(links(classes.select("fp"), radius))
    roots = unbroadcast(classes).join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = unbroadcast(roots.select("fp", "root")).join(least, "root").select("fp", "component_id")
    return unbroadcast(prints).join(labels, "fp").select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
