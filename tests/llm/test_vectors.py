import numpy as np
import pytest

from loomline.llm import ann, embed_dedup
from loomline.llm.queries import op7_ann, op9_embedding_dedup
from tests.llm.test_components import plain


def planted(n=300, dim=24, seed=4):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    for k in range(0, n, 5):  # near copies, a chain, scaled and equal ones
        x[k + 1] = x[k] + 0.05 * rng.normal(size=dim)
        x[k + 2] = x[k + 1] + 0.2 * rng.normal(size=dim)
    x[10], x[11] = 3 * x[9], x[9]
    return x.astype(np.float32)


def odd_rows(dim=24):
    nan, inf = float("nan"), float("inf")
    return [(9001, None), (9002, [0.0] * dim), (9003, [nan] + [1.0] * (dim - 1)), (9004, [inf] + [1.0] * (dim - 1)), (9005, [None] + [1.0] * (dim - 1)), (9006, []), (9007, [1.0, 2.0]), (None, [1.0] * dim), (9009, [-0.0, 1.0] + [0.0] * (dim - 2)), (9010, [0.0, 1.0] + [0.0] * (dim - 2))]


def slow_links(ids, vectors, threshold):
    u = [None if v is None or not len(v) or any(c is None or not np.isfinite(c) for c in v) or not np.any(np.array(v, float)) or i is None else np.array(v, np.float64) for i, v in zip(ids, vectors, strict=True)]
    pairs = [(i, j) for i in range(len(u)) for j in range(i) if u[i] is not None and u[j] is not None and len(u[i]) == len(u[j]) and u[i] @ u[j] / (np.linalg.norm(u[i]) * np.linalg.norm(u[j])) >= threshold]
    root = plain([*pairs, *((i, i) for i in range(len(u)))])
    least = {}
    for i in range(len(u)):
        if ids[i] is not None:
            least[root[i]] = min(least.get(root[i], ids[i]), ids[i])
    deg = np.bincount([x for p in pairs for x in p] or [0], minlength=len(u)) if pairs else np.zeros(len(u), int)
    return sorted(((ids[i], int(deg[i]), least.get(root[i])) for i in range(len(u))), key=str)


@pytest.mark.parametrize("threshold", [0.9, 0.95, 0.99])
def test_dedup_against_all_pairs(spark, monkeypatch, threshold):
    monkeypatch.setattr(embed_dedup, "BLOCK", 40)
    rows = [(i, v.tolist()) for i, v in enumerate(planted())] + [(7, planted()[7].tolist())] + odd_rows()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "'c' as v", "'c' as rep", "'c' as id")
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in embed_dedup.near_duplicates(df, threshold=threshold).collect()), key=str)
    assert got == slow_links([i for i, _ in rows], [v for _, v in rows], threshold)


def test_dedup_query_and_empty(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    got = op9_embedding_dedup(spark, sf).collect()
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in got), key=str) == slow_links([r["vec_id"] for r in rows], [r["embedding"] for r in rows], 0.95)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)
    assert embed_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_bounds_hold():
    x = planted(200)
    i, j, tried = embed_dedup.tile_links(x.astype(float), x.astype(float), 0.95, True)
    u = embed_dedup.unit(x.astype(float))
    s = u @ u.T
    want = {(a, b) for a in range(200) for b in range(a + 1, 200) if s[a, b] >= 0.95}
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == want and tried < 2000
    q, scale, norm, err = embed_dedup.quantise(u)
    approx = (q * scale[:, None]) @ (q * scale[:, None]).T
    slack = err[:, None] * (norm + err) + norm[:, None] * err
    assert (np.abs(s - approx) <= slack + 1e-12).all()


def exact(ids, x, queries, k):
    out = {}
    for q in queries:
        s = [(-(x[i] @ x[ids.index(q)]), ids[i]) for i in range(len(ids)) if ids[i] != q]
        out[q] = [v for _, v in sorted(s)[:k]]
    return out


def test_ann_recall_order_and_scores(spark):
    x = np.random.default_rng(8).normal(size=(1200, 16)).astype(np.float32).astype(float)
    x[50:80] = x[40]  # equal vectors
    ids = list(range(1200))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x, strict=True)] + odd_rows(16), "vec_id long, embedding array<float>")
    rows = ann.search(df, df.where("vec_id % 20 = 0 and vec_id < 9000")).collect()
    want, by = exact(ids, x, ids[::20], 20), {}
    for r in rows:
        by.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hit = 0
    for q, top in want.items():
        got = sorted(by[q])
        assert [r for r, *_ in got] == list(range(1, len(got) + 1))
        assert all(abs(s - x[v] @ x[q]) < 1e-9 for _, v, s in got) and q not in [v for _, v, _ in got]
        assert [v for _, v, _ in got] == [v for _, v in sorted((-s, v) for _, v, s in got)]
        hit += len({v for _, v, _ in got} & set(top))
    assert hit >= 0.9 * 20 * len(want)
    # ties go to the smaller id: 60 is one of 31 equal vectors
    assert [v for _, v, _ in sorted(by[60])] == [v for v in [40, *range(50, 80)] if v != 60][:20]


def test_ann_query_few_and_none(spark, sf):
    n = spark.read.parquet(f"{sf}/embeddings.parquet").where("vec_id % 20 = 0").count()
    rows = op7_ann(spark, sf).groupBy("query_id").count().collect()
    assert len(rows) == n and all(r["count"] <= 20 for r in rows)
    few = spark.createDataFrame([(0, [1.0, 0.0]), (20, [0.5, 0.5]), (3, [0.0, 1.0])], "vec_id long, embedding array<float>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ann.search(few, few.where("vec_id % 20 = 0")).collect())
    assert got == [(0, 1, 20, 0.5), (0, 2, 3, 0.0), (20, 1, 0, 0.5), (20, 2, 3, 0.5)]
    assert ann.search(few.limit(0), few.limit(0)).count() == 0


def test_ann_searches_each_length(spark):
    few = [(0, [1.0, 0.0]), (20, [0.5, 0.5]), (3, [0.0, 1.0]), (4, [1.0, 1.0]), (40, [1.0, 0.0, 0.0]), (5, [0.5, 0.5, 0.0]), (60, [1.0]), (None, [1.0, 2.0, 3.0, 4.0])]
    df = spark.createDataFrame(few, "vec_id long, embedding array<float>")
    got = sorted((r["query_id"], r["vec_id"], r["score"]) for r in ann.search(df, df.where("vec_id % 20 = 0")).collect() if r["query_id"] >= 40)
    assert got == [(40, 5, 0.5)]


def test_recall_of_the_registered_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r["vec_id"], np.array(r["embedding"], float)) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    found = {}
    for r in op7_ann(spark, sf).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    ids, v = np.array([i for i, _ in rows]), np.stack([x for _, x in rows])
    hit = total = 0
    for q, x in rows:
        if q % 20 == 0:
            score = v @ x
            score[ids == q] = -np.inf
            best = set(ids[np.lexsort((ids, -score))[:20]].tolist())
            assert len(found[q]) == 20
            hit, total = hit + len(best & found[q]), total + 20
    assert hit >= 0.9 * total


def test_tiles_move_names_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "BLOCK", 40)
    reps = spark.createDataFrame([(i, 1, 24, v.tolist()) for i, v in enumerate(planted())], "rep long, weight long, dim int, v array<float>")
    marked = embed_dedup._linked(reps, 300, 0.95)
    plan = marked._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroups" not in plan and "parts" not in plan  # tiles get no vectors by a shuffle
    assert marked.count() > 0
