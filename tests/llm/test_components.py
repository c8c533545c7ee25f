import random

import numpy as np
import pytest

from loomline.llm import components as module
from loomline.llm.components import components, forest


def plain(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(parent)}


def groups(labels):
    out = {}
    for k, v in labels.items():
        out.setdefault(v, set()).add(k)
    return {frozenset(g) for g in out.values()}


def test_forest_keeps_components():
    rng = random.Random(3)
    for _ in range(20):
        e = [(rng.randrange(30), rng.randrange(30)) for _ in range(rng.randrange(1, 40))]
        a, b = (np.array(x) for x in zip(*e, strict=True))
        u, v = forest(a, b)
        want = {g for g in groups(plain(e)) if len(g) > 1}
        assert groups(plain(zip(u.tolist(), v.tolist(), strict=True))) == want


@pytest.mark.parametrize("one_task", [0, 16_384])
def test_chains_stars_and_clumps(spark, monkeypatch, one_task):
    monkeypatch.setattr(module, "ONE_TASK", one_task)
    rng = random.Random(5)
    e = [(k, k + 1) for k in range(100)] + [(1000, 1000 + k) for k in range(1, 200)] + [(rng.randrange(5000, 5400), rng.randrange(5000, 5400)) for _ in range(300)] + [(7, 7), (None, 1), (2, 1)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(e, "a long, b long").repartition(7)).collect()}
    want = plain([x for x in e if None not in x and x[0] != x[1]])
    assert groups(got) == groups(want)


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
