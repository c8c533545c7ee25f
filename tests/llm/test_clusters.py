import hashlib
import math

import numpy as np
import pytest

from loomline.llm import hamerly
from loomline.llm.queries import op13_hamerly_clusters

SCHEMA = "vec_id long, embedding array<double>, label int, id string, q string, a string, cluster string"


def slow(rows, clusters=hamerly.CLUSTERS, rounds=hamerly.ROUNDS):
    """The contract with Python's integers, one vector and centroid at a time."""
    kept = [(v, [math.floor(256 * x) for x in e]) for v, e in rows if e is not None and len(e) == 64 and all(x is not None and math.isfinite(x) for x in e)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1])
    cents = [q for _, q in sorted(kept, key=key)[:clusters]]
    d2 = lambda x, y: sum((s - t) ** 2 for s, t in zip(x, y, strict=True))
    near = lambda q: min(range(len(cents)), key=lambda k: (d2(q, cents[k]), k))
    for _ in range(rounds):
        at = [near(q) for _, q in kept]
        for k in range(len(cents)):
            own = [q for (_, q), a in zip(kept, at, strict=True) if a == k]
            if own:
                cents[k] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    out = [(v, a, d2(q, cents[a])) for v, q in kept for a in [near(q)]]
    sums = {k: sum(d for _, a, d in out if a == k) for k in range(len(cents))}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return sorted(((v, a, d, sums[a], sum(sums.values()), sha[a]) for v, a, d in out), key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(v, e, 1, "clash", "clash", "clash", "clash") for v, e in rows], SCHEMA).repartition(3)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_equals_a_plain_version_on_the_table(spark, sf):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert got(op13_hamerly_clusters(spark, sf)) == slow(rows)


def test_ties_repeats_and_what_takes_no_part(spark):
    rng = np.random.default_rng(5)
    rows = [(k, rng.normal(size=64).round(1).tolist()) for k in range(90)]
    rows += [(200 + k, [0.0] * 64) for k in range(5)] + rows[:7] + [(None, [0.25] * 64), (None, None)]
    # equal and mirrored vectors give centroids at equal distances
    rows += [(300, [1.0] + [0.0] * 63), (301, [-1.0] + [0.0] * 63)]
    rows += [(400, None), (401, []), (402, [1.0] * 63), (403, [1.0] * 65), (404, [float("nan")] * 64), (405, [float("inf")] + [0.0] * 63), (406, [None] + [0.0] * 63)]
    assert got(hamerly.cluster(frame(spark, rows))) == slow(rows)
    assert len(hamerly.cluster(frame(spark, [*rows, (500, [1e300] + [0.0] * 63)])).collect()) == len(slow(rows))


def test_few_vectors_and_none(spark):
    rows = [(k, [float(k)] * 64) for k in range(4)]
    assert got(hamerly.cluster(frame(spark, rows))) == slow(rows)
    assert got(hamerly.cluster(frame(spark, rows[:1]))) == slow(rows[:1])
    assert hamerly.cluster(frame(spark, []).where("vec_id > 0")).collect() == []


def test_large_components_are_exact(spark):
    rng = np.random.default_rng(6)
    rows = [(k, (rng.normal(size=64) * 100_000).tolist()) for k in range(60)]
    assert got(hamerly.cluster(frame(spark, rows), clusters=5)) == slow(rows, clusters=5)


def test_bounds_hold_and_spare_scans(spark):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(8, 64)) * 4
    rows = [(k, (centres[k % 8] + rng.normal(size=64) * 0.1).tolist()) for k in range(400)]
    report = []
    assert got(hamerly.cluster(frame(spark, rows), clusters=8, report=report)) == slow(rows, clusters=8)
    assert report[0][1:] == (400, 400) and sum(s for _, _, s in report[2:]) < 400


@pytest.mark.parametrize("size", [1.0, 3000.0])
def test_one_round_of_bounds(size):
    rng = np.random.default_rng(8)
    q, c = (rng.integers(-300, 300, (500, 64)) * size).astype(np.int64), (rng.integers(-300, 300, (9, 64)) * size).astype(np.int64)
    a, u, low = hamerly.nearest(q, c)
    for _ in range(4):
        new = c + rng.integers(-40, 40, c.shape)
        a, u, low, _ = hamerly.step(q, a, u, low, new, hamerly.drift(c, new))
        c = new
        d = np.array([[sum((x - y) ** 2 for x, y in zip(v, w, strict=True)) for w in c.tolist()] for v in q.tolist()])
        assert (d.argmin(1) == a).all()
        own, second = np.sqrt(d[np.arange(len(q)), a]), np.sqrt(np.partition(d, 1, axis=1)[:, 1])
        assert (u >= own).all() and (low <= second).all()
