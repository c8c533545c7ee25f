"""Sequence packing as a cutting-stock problem, solved by column generation.

Documents longer than a sequence give whole sequences; what is left of each (or the whole of a short one)
has one of capacity - 1 lengths. The linear program covers the histogram of these lengths with patterns, multisets
of lengths that fit a sequence. Its columns are generated: a knapsack dynamic program over the dual prices, smoothed
towards those of the best bound so far, finds the patterns that improve most, until the cover is within ``GAP`` of that bound.
The solution is rounded down; what rounding leaves is a smaller histogram, covered by patterns that a knapsack bounded by
the lengths still there finds at the same prices. Documents of a length are ranked, and a rank alone tells the document's
pattern, sequence and place there, so that assigning needs neither a shuffle of texts nor a group.
Only what no pattern fills to within a few tokens is laid end to end and cut at every full sequence; the last, partial one
is cut into powers of two. Its size is bounded by the number of lengths, not by the data.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomline.llm.arrow import blocks, release
from loomline.llm.bpe import BLOCK, encoder, load_vocabulary
from loomline.scratch import materialize

#: Relative gap to the dual bound at which pricing ends, and pricings in which the cover does not shrink by as much, after which it ends too.
GAP, STALLED = 1e-4, 40
#: Weight of the best bound's prices in those that are priced, and columns taken from one dynamic program.
SMOOTHING, COLUMNS = 0.7, 15
#: Padding a kept pattern may have.
PADDING = 4
#: Lengths among which a pattern for what rounding left is looked for first; if they give none, all lengths are.
FEW = 256
#: Rows handled at a time in a worker (memory only).
AT_ONCE = 2000
#: Cut documents up to which their table is broadcast (each is a few dozen bytes); beyond, they are joined by shuffle.
CUT_BROADCAST = 50_000


def knapsack(sizes: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Greatest value of a multiset of sizes (ascending) within each weight up to capacity, and the index taken there (-1: none)."""
    value, take = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fits = np.searchsorted(sizes, np.arange(capacity + 1), side="right").tolist()
    for w in range(int(sizes[0]), capacity + 1):
        v = value[w - sizes[: fits[w]]]
        v += prices[: fits[w]]
        i = int(v.argmax())
        best = value[w - 1]
        if v[i] > best + 1e-12:
            best, take[w] = v[i], i
        value[w] = best
    return value, take


def trace(take: np.ndarray, sizes: np.ndarray, weight: int, first: int) -> dict[int, int]:
    """Counts of the best multiset within a weight that holds the index ``first``."""
    counts, w = {first: 1}, weight - int(sizes[first])
    while w > 0:
        if (i := int(take[w])) < 0:
            w -= 1
        else:
            counts[i] = counts.get(i, 0) + 1
            w -= int(sizes[i])
    return counts


def bounded_knapsack(sizes: np.ndarray, counts: np.ndarray, prices: np.ndarray, capacity: int) -> dict[int, int]:
    """Most valuable multiset of sizes within capacity that takes no index more often than ``counts`` says."""
    value, steps = np.zeros(capacity + 1), []
    for i in np.flatnonzero(counts).tolist():
        s, p = int(sizes[i]), prices[i]
        for _ in range(min(int(counts[i]), capacity // s)):
            taken = value[:-s] + p
            steps.append((i, s, taken > value[s:] + 1e-12))
            np.maximum(value[s:], taken, out=value[s:])
    out: dict[int, int] = {}
    w = capacity
    for i, s, better in reversed(steps):
        if w >= s and better[w - s]:
            out[i] = out.get(i, 0) + 1
            w -= s
    return out


def first_basis(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[list[dict[int, int]], np.ndarray]:
    """Patterns filled with the largest lengths first, one for each length, that cover the demand exactly.

    Each uses up one length, which later ones lack, so the basis is triangular.
    """
    left, alive = demand.astype(float).copy(), list(range(len(sizes)))
    patterns, runs = [], []
    while alive:
        own = [int(sizes[i]) for i in alive]
        room, end, p = capacity, len(alive), {}
        while (k := bisect_right(own, room, 0, end)) > 0:
            i = alive[k - 1]
            p[i] = room // own[k - 1]
            room -= p[i] * own[k - 1]
            end = k - 1
        i = min(p, key=lambda i: left[i] / p[i])
        x = left[i] / p[i]
        for j, a in p.items():
            left[j] = max(0.0, left[j] - a * x)
        patterns.append(p)
        runs.append(x)
        alive.remove(i)
    return patterns, np.array(runs)


@dataclass
class Cover:
    """Solution of the linear program: patterns, how often each is used, prices of the lengths, the bound they prove, and pivots done."""

    patterns: list[dict[int, int]]
    runs: np.ndarray
    prices: np.ndarray
    bound: float
    pivots: int


def solve(sizes: np.ndarray, demand: np.ndarray, capacity: int, gap: float = GAP) -> Cover:
    """Fractional cover of the demand with patterns by column generation.

    Prices of any kind, divided by the value of the best pattern at them, are feasible in the dual program and prove a bound;
    a length's share of the capacity is the first such price. Pricing at a mean of the current and the best prices keeps them
    from swinging; where it finds no column, the weight of the best ones is halved, and at weight zero none is left.
    """
    patterns, _ = first_basis(sizes, demand, capacity)
    m = len(sizes)
    basis = np.zeros((m, m))
    for k, p in enumerate(patterns):
        for i, a in p.items():
            basis[i, k] = a
    inverse = np.linalg.inv(basis)
    del basis
    x = np.maximum(0, inverse @ demand)
    best = sizes / capacity
    bound, weight, pivots, lowest, idle = float(best @ demand), SMOOTHING, 0, float(x.sum()), 0
    while x.sum() > bound * (1 + gap) and idle < STALLED:
        own = inverse.sum(0)
        prices = (1 - weight) * own + weight * best
        value, take = knapsack(sizes, prices, capacity)
        feasible = np.maximum(prices, 0) / max(float(value[capacity]), 1e-9)
        if float(feasible @ demand) > bound:
            bound, best = float(feasible @ demand), feasible
        worth, seen, before = value[capacity - sizes] + prices, set(), pivots
        for first in np.argsort(-worth, kind="stable")[:COLUMNS].tolist():
            column = trace(take, sizes, capacity, first)
            key = frozenset(column.items())
            if key in seen:
                continue
            seen.add(key)
            which, times = np.array(list(column)), np.array(list(column.values()), float)
            gain = float(times @ own[which]) - 1
            if gain <= 1e-9:
                continue
            u = inverse[:, which] @ times
            up = np.flatnonzero(u > 1e-9)
            if not len(up):
                continue
            r = int(up[np.argmin(x[up] / u[up])])
            step = x[r] / u[r]
            x -= step * u
            x[r] = step
            np.maximum(x, 0, out=x)
            row = inverse[r] / u[r]
            u[r] = 0
            rows, cols = np.flatnonzero(np.abs(u) > 1e-12), np.flatnonzero(row)
            if 3 * len(rows) * len(cols) < m * m:
                inverse[np.ix_(rows, cols)] -= np.outer(u[rows], row[cols])
            else:
                inverse -= np.outer(u, row)
            inverse[r] = row
            own = own - gain * row
            patterns[r] = column
            pivots += 1
        if pivots > before:
            weight = SMOOTHING
        elif weight == 0:
            break
        else:
            weight = weight / 2 if weight > 0.1 else 0.0
        z = float(x.sum())
        if z < lowest - gap * bound:
            lowest, idle = z, 0
        else:
            idle += 1
    return Cover(patterns, x, best, bound, pivots)


#: Bits of a rank in the key of a slot.
RANK_BITS = 48


@dataclass
class Plan:
    """Where each rank of each length goes. Sequences: those of the patterns, then the line's, then whole blocks."""

    capacity: int
    #: one row a length of a pattern, by (length, first rank): key, first rank, sequence base, copies, place of the first copy
    slots: np.ndarray
    #: by length: first rank on the line, its position there
    line_rank: np.ndarray
    line_at: np.ndarray
    pattern_sequences: int = 0
    line_tokens: int = 0
    padding: int = 0
    bound: float = 0.0
    #: columns that pricing brought into the basis, and patterns found for what rounding left
    pivots: int = 0
    late_patterns: int = 0

    @property
    def line_sequences(self) -> int:
        return self.line_tokens // self.capacity + bin(self.line_tokens % self.capacity).count("1")

    @property
    def first_block(self) -> int:
        return self.pattern_sequences + self.line_sequences

    def cut_at(self, pos: int) -> tuple[int, int, int]:
        """Sequence, its start and its end on the line, of a position there."""
        k, rest = divmod(pos, self.capacity)
        if k < self.line_tokens // self.capacity:
            return self.pattern_sequences + k, k * self.capacity, (k + 1) * self.capacity
        start, number, over = k * self.capacity, self.pattern_sequences + k, self.line_tokens % self.capacity
        for b in range(over.bit_length() - 1, -1, -1):
            if over >> b & 1:
                if rest < (1 << b):
                    return number, start, start + (1 << b)
                rest, start, number = rest - (1 << b), start + (1 << b), number + 1
        raise ValueError("beyond the line")

    def on_pattern(self, length: np.ndarray, rank: np.ndarray) -> np.ndarray:
        return rank < self.line_rank[length]

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of rests that lie on patterns."""
        _, first, base, copies, at = self.slots[np.searchsorted(self.slots[:, 0], (length << RANK_BITS) + rank, side="right") - 1].T
        q, c = np.divmod(rank - first, copies)
        return base + q, at + c * length

    def cut(self, length: int, rank: int) -> list[tuple[int, int, int, int]]:
        """Pieces (start within the rest, length, sequence, offset) of a rest that lies on the line."""
        pos = int(self.line_at[length]) + (rank - int(self.line_rank[length])) * length
        out, done = [], 0
        while done < length:
            seq, lo, hi = self.cut_at(pos + done)
            n = min(length - done, hi - pos - done)
            out.append((done, n, seq, pos + done - lo))
            done += n
        return out


def plan(histogram: dict[int, int], capacity: int = 2048, padding: int = PADDING) -> Plan:
    """Plan for a histogram of lengths below capacity. padding: most unused places of a kept pattern."""
    out = Plan(capacity, np.zeros((0, 5), np.int64), np.zeros(capacity, np.int64), np.zeros(capacity, np.int64))
    sizes = np.array(sorted(s for s, n in histogram.items() if n > 0 and 0 < s < capacity), np.int64)
    if not len(sizes):
        return out
    demand = np.array([histogram[int(s)] for s in sizes], np.int64)
    cover = solve(sizes, demand.astype(float), capacity)
    out.bound, out.pivots = cover.bound, cover.pivots
    used, slots = np.zeros(len(sizes), np.int64), []

    def keep(p: dict[int, int], n: int, waste: int) -> None:
        at = 0
        for i, a in sorted(p.items(), reverse=True):
            slots.append(((int(sizes[i]) << RANK_BITS) + int(used[i]), int(used[i]), out.pattern_sequences, a, at))
            used[i] += a * n
            at += a * int(sizes[i])
        out.pattern_sequences += n
        out.padding += waste * n

    for p, n in sorted(zip(cover.patterns, np.floor(cover.runs + 1e-7).astype(np.int64).tolist(), strict=True), key=lambda t: sorted(t[0].items())):
        waste = capacity - sum(int(sizes[i]) * a for i, a in p.items())
        n = min([n, *(int(demand[i] - used[i]) // a for i, a in p.items())])
        if n > 0 and waste <= padding:
            keep(p, n, waste)
    # of equal value, patterns with large lengths first: small ones fit anywhere later
    prices = cover.prices + 1e-3 * (sizes / capacity) ** 2
    few, rng = FEW, np.random.default_rng(1)
    while int(sizes @ (left := demand - used)) >= capacity - padding:
        there = np.flatnonzero(left)
        if len(there) > few:
            # the largest, and others drawn anew each time
            some = np.zeros_like(left)
            chosen = np.concatenate([there[-few // 8 :], rng.choice(there, few - few // 8, replace=False)])
            some[chosen] = left[chosen]
        else:
            some = left
        p = bounded_knapsack(sizes, some, prices, capacity)
        waste = capacity - sum(int(sizes[i]) * a for i, a in p.items())
        if waste > padding:
            if some is left:
                break
            few *= 2
            continue
        keep(p, min(int(demand[i] - used[i]) // a for i, a in p.items()), waste)
        out.late_patterns += 1
    out.slots = np.array(sorted(slots), np.int64).reshape(-1, 5)
    out.line_rank[sizes] = used
    left = (demand - used) * sizes
    out.line_at[sizes] = np.cumsum(left) - left
    out.line_tokens = int(left.sum())
    return out


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def pack(df: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", padding: int = PADDING) -> DataFrame:
    """Pieces of all documents: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's ids are those of its whole text (null: empty), then ``end_id``; every document has a piece
    then. Each id lies in one piece; pieces of a sequence lie side by side from offset 0. Repeated rows
    are packed each; ids may be null; other columns of ``df`` are not read. An empty table gives no rows.
    """
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(load_vocabulary(vocabulary))
    src = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("h", F.xxhash64("id", "text"))
    id_type = src.schema["id"].dataType.simpleString()

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, ranks = encoder(shared.value), TaskContext.get().partitionId(), [0] * capacity
        for batch in batches:
            for first in range(0, batch.num_rows, AT_ONCE):
                b = batch.slice(first, AT_ONCE)
                texts = [t or "" for t in b.column(1).to_pylist()]
                n, block_crcs, rest_crc, local, blocks_before = [], [], [], [], []
                for s, e in blocks(texts, BLOCK):
                    for ids in enc.encode_batch(texts[s:e]):
                        ids = np.append(ids, end_id).astype("<u4")
                        full, rest = divmod(len(ids), capacity)
                        n.append(len(ids))
                        block_crcs.append([_crc(ids[k * capacity : (k + 1) * capacity]) for k in range(full)])
                        rest_crc.append(_crc(ids[full * capacity :]))
                        local.append(ranks[rest])
                        blocks_before.append(ranks[0])
                        if rest:
                            ranks[rest] += 1
                        ranks[0] += full  # length 0 stands for whole blocks
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(2), pa.array([part] * len(n), pa.int32()), pa.array(n, pa.int64()), pa.array(block_crcs, pa.list_(pa.int64())), pa.array(rest_crc, pa.int64()), pa.array(local, pa.int64()), pa.array(blocks_before, pa.int64())],
                    names=["id", "h", "part", "n", "block_crcs", "rest_crc", "local", "blocks_before"],
                )
                del b, texts
        enc.forget()
        release()

    measured = materialize(src.mapInArrow(sizes, f"id {id_type}, h long, part int, n long, block_crcs array<long>, rest_crc long, local long, blocks_before long"), "lengths")
    rest = (F.col("n") % capacity).cast("int")
    rests = measured.where(rest > 0).groupBy("part", rest.alias("rest")).agg(F.count("*").alias("k"))
    whole = measured.groupBy("part").agg(F.sum(F.size("block_crcs")).alias("k")).select("part", F.lit(0).alias("rest"), "k")
    counts = materialize(rests.unionByName(whole), "counts")
    # capacity rows at most
    histogram = {r["rest"]: r["k"] for r in counts.groupBy("rest").agg(F.sum("k").alias("k")).collect()}
    histogram.pop(0, None)
    made = plan(histogram, capacity, padding)
    shared_plan = spark.sparkContext.broadcast(made)
    before = Window.partitionBy("rest").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("part", "rest", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("first"))
    ranked = (
        measured.withColumn("rest", rest)
        .join(first.where("rest > 0").withColumnRenamed("first", "rank0"), ["part", "rest"], "left")
        .join(first.where("rest = 0").select("part", F.col("first").alias("block0")), "part")
        .select("id", "h", "n", "block_crcs", "rest_crc", (F.coalesce("rank0", F.lit(0)) + F.col("local")).alias("rank"), (F.col("block0") + F.col("blocks_before")).alias("block"))
    )

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p: Plan = shared_plan.value
        for batch in batches:
            for first in range(0, batch.num_rows, AT_ONCE):
                b = batch.slice(first, AT_ONCE)
                n, crc, rank, block = (b.column(k).to_numpy(zero_copy_only=False) for k in (2, 4, 5, 6))
                full, over = np.divmod(n, capacity)
                # whole blocks
                at = np.repeat(np.arange(len(n)), full)
                k = np.arange(len(at)) - np.repeat(np.cumsum(full) - full, full)
                whole = [at, k * capacity, np.full(len(at), capacity), b.column(3).flatten().to_numpy(zero_copy_only=False), p.first_block + block[at] + k, np.zeros(len(at), np.int64), np.ones(len(at), bool)]
                # rests on patterns, then those cut on the line
                has = np.flatnonzero(over)
                fits = p.on_pattern(over[has], rank[has])
                on, off = has[fits], has[~fits]
                sequence, offset = p.place(over[on], rank[on])
                placed = [on, full[on] * capacity, over[on], crc[on], sequence, offset, np.ones(len(on), bool)]
                cuts = []
                for i in off.tolist():
                    got = p.cut(int(over[i]), int(rank[i]))
                    cuts += [(i, int(full[i]) * capacity + s, m, int(crc[i]), q, o, len(got) == 1) for s, m, q, o in got]
                out = [np.concatenate(c) for c in zip(whole, placed, [np.array(c, np.int64) for c in zip(*cuts, strict=True)] or [np.zeros(0, np.int64)] * 7, strict=True)]
                at = pa.array(out[0], pa.int64())
                known = pa.array(out[3], pa.int64(), mask=~out[6].astype(bool))
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), b.column(2).take(at), *(pa.array(c, pa.int64()) for c in out[1:3]), known, *(pa.array(c, pa.int64()) for c in out[4:6])], names=["id", "h", "n", "start", "length", "crc", "sequence", "offset"])
        release()

    pieces = materialize(ranked.mapInArrow(assign, f"id {id_type}, h long, n long, start long, length long, crc long, sequence long, offset long"), "pieces")
    # one document at most is cut at each end of a sequence on the line, which the number of lengths bounds
    cut = pieces.where("crc is null").groupBy("h").agg(F.collect_set(F.struct("start", "length")).alias("cuts"))

    small = F.broadcast if made.line_sequences <= CUT_BROADCAST else (lambda d: d)

    def recut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(shared.value)
        for batch in batches:
            for first in range(0, batch.num_rows, AT_ONCE):
                rows, out = batch.slice(first, AT_ONCE).to_pydict(), []
                texts = [t or "" for t in rows["text"]]
                for s, e in blocks(texts, BLOCK):
                    for ids, h, cuts in zip(enc.encode_batch(texts[s:e]), rows["h"][s:e], rows["cuts"][s:e], strict=True):
                        ids = np.append(ids, end_id)
                        out += [(h, c["start"], c["length"], _crc(ids[c["start"] : c["start"] + c["length"]])) for c in cuts]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(4)], names=["h", "start", "length", "crc2"])
        enc.forget()
        release()

    again = src.select("h", "text").join(small(cut), "h").mapInArrow(recut, "h long, start long, length long, crc2 long").groupBy("h", "start", "length").agg(F.min("crc2").alias("crc2"))
    done = pieces.where("crc is not null").withColumn("crc2", F.col("crc")).unionByName(pieces.where("crc is null").join(small(again), ["h", "start", "length"]))
    return done.select(F.col("id").alias(id_col), "start", "length", F.col("crc2").alias("ids_crc32"), F.col("n").alias("doc_tokens"), F.col("sequence").alias("sequence_id"), "offset")


def sequences(pieces: DataFrame, ids: DataFrame, end_id: int = 1, id_col: str = "doc_id") -> DataFrame:
    """The packed ids themselves, ``sequence_id, ids``: ``ids`` holds one row a document (id, ids without the end)."""
    own = ids.select(id_col, F.concat("ids", F.array(F.lit(end_id))).alias("all"))
    parts = pieces.join(own, id_col).select("sequence_id", F.struct("offset", F.slice("all", F.col("start").cast("int") + 1, F.col("length").cast("int")).alias("ids")).alias("p"))
    # a sequence has capacity ids at most
    return parts.groupBy("sequence_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list("p")), lambda p: p["ids"])).alias("ids"))
