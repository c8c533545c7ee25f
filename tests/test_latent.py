import random

import numpy as np
import pytest

from loomline.operators import frequency as Q
from loomline.operators import latent as L
from loomline.plans import queries
from loomline.plans.narratives import narratives


def dense(entries, n):
    """doc -> matrix of its entries, columns by first use."""
    out = {}
    for doc, size in n.items():
        es = sorted((i, t, v) for d, i, t, v in entries if d == doc)
        cols = {t: k for k, t in enumerate(dict.fromkeys(t for _, t, _ in es))}
        m = np.zeros((size, max(1, len(cols))))
        for i, t, v in es:
            m[i, cols[t]] += v
        out[doc] = m
    return out


def reference_space(m, k):
    u, s, _ = np.linalg.svd(m, full_matrices=False)
    k = min(k, len(m) - 1, len(s))
    x = u[:, :k] * s[:k]
    # rows without an entry have rounding errors for a vector
    return np.where(np.linalg.norm(x, axis=1, keepdims=True) > 1e-9 * s[0], x, 0.0)


def cosines(x):
    norm = np.linalg.norm(x, axis=1)
    both = np.outer(norm, norm)
    return np.where(both > 1e-18, x @ x.T / np.where(both > 1e-18, both, 1), 0.0)


def report(c):
    n = len(c)
    r = np.floor(c * 10000 + 0.5) / 10000 + 0.0
    pairs = [(r[i, j], i, j) for i in range(n) for j in range(i + 1, n)]
    return round(sum(p[0] for p in pairs) / len(pairs), 4), max(pairs), min(pairs)


def corpus(seed, docs=12):
    rng = random.Random(seed)
    rows = []
    for d in range(docs):
        n = [1, 2, 3, 4, 30][d % 5]
        for i in range(n):
            for t in {rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(0 if n > 3 else 1, 6))}:
                rows.append((d, i, t, rng.choice([0.5, 1.0, 1.25, 2.0])))
    return rows, {d: [1, 2, 3, 4, 30][d % 5] for d in range(docs)}


def frames(spark, rows, n):
    return spark.createDataFrame(rows, "doc_id long, sent_ix int, token string, value double").repartition(4), spark.createDataFrame(list(n.items()), "doc_id long, n int")


def test_sentence_vectors_equal_singular_vectors(spark):
    rows, n = corpus(1)
    entries, sizes = frames(spark, rows, n)
    got = {}
    for r in L.sentence_vectors(entries, sizes).collect():
        got.setdefault(r["doc_id"], {})[r["sent_ix"]] = r["vector"]
    for doc, m in dense(rows, n).items():
        mine = np.array([got[doc][i] for i in range(n[doc])])
        want = m if n[doc] < 3 else reference_space(m, 5)
        assert np.allclose(cosines(mine), cosines(want), atol=1e-8)
        # lengths too: U times S, up to signs
        assert np.allclose(np.linalg.norm(mine, axis=1), np.linalg.norm(want, axis=1), atol=1e-8)


def test_pairs_against_all_pairs(spark):
    rows, n = corpus(2, 20)
    entries, sizes = frames(spark, rows, n)
    m = dense(rows, n)
    for latent in (True, False):
        got = {r["doc_id"]: r for r in L.semantic_pairs(entries, sizes, latent=latent).collect()}
        assert set(got) == {d for d, k in n.items() if k > 1}
        for doc, r in got.items():
            space = m[doc] if n[doc] < 3 or not latent else reference_space(m[doc], 5)
            mean, most, least = report(cosines(space))
            assert abs(r["coherence"] - mean) < 2e-4 and r["n"] == n[doc]
            assert abs(r["most"] - most[0]) < 2e-4 and abs(r["least"] - least[0]) < 2e-4
            if not latent:
                assert (r["most_i"], r["most_j"], r["least_i"], r["least_j"]) == (*most[1:], *least[1:])


def test_blocks_change_nothing(monkeypatch):
    rng = np.random.default_rng(3)
    u = L.unit(rng.integers(-2, 3, (40, 4)).astype(float))
    whole = L.pair_report(u)
    mean, most, least = report(u @ u.T)
    assert whole[1:] == (most, least) and abs(whole[0] - mean) < 1e-4
    monkeypatch.setattr(L, "AT_ONCE", 7)
    assert L.pair_report(u) == whole


@pytest.mark.parametrize("seed", [4, 5])
def test_power_iteration_equals_singular_vectors(spark, seed):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(60, 6)) @ (np.diag([9, 7, 5, 4, 3, 2]) @ rng.normal(size=(6, 25))) + 0.1 * rng.normal(size=(60, 25))
    base[rng.random(base.shape) < 0.6] = 0.0
    rows = [(i, 0, f"t{j}", float(base[i, j])) for i in range(60) for j in range(25) if base[i, j]]
    entries = spark.createDataFrame(rows, "doc_id long, sent_ix int, token string, value double").repartition(4)
    got = {r["doc_id"]: r["vector"] for r in L.corpus_vectors(entries, ["doc_id"], "token").collect()}
    ids = sorted(got)
    mine = np.array([got[i] for i in ids])
    u, s, _ = np.linalg.svd(base, full_matrices=False)
    assert np.allclose(np.linalg.norm(mine, axis=0), s[:5], rtol=1e-6)
    assert np.abs(cosines(mine) - cosines((u[:, :5] * s[:5])[ids])).max() < 5e-5
    # and the way for single documents agrees
    sizes = spark.createDataFrame([(0, 60)], "doc_id long, n int")
    one = L.sentence_vectors(entries.selectExpr("0L as doc_id", "cast(doc_id as int) as sent_ix", "token", "value"), sizes)
    other = {r["sent_ix"]: r["vector"] for r in one.collect()}
    assert np.abs(cosines(mine) - cosines(np.array([other[i] for i in ids]))).max() < 5e-5


def test_low_rank_and_nothing(spark):
    schema = "doc_id long, sent_ix int, token string, value double"
    rank1 = spark.createDataFrame([(i, 0, t, float((i + 1) * w)) for i in range(4) for t, w in (("a", 1), ("b", 2))], schema)
    got = [r["vector"] for r in L.corpus_vectors(rank1, ["doc_id"], "token").collect()]
    assert all(len(v) == 1 for v in got) and np.allclose(sorted(abs(v[0]) for v in got), [np.sqrt(5) * k for k in (1, 2, 3, 4)])
    none = spark.createDataFrame([], schema)
    assert L.corpus_vectors(none, ["doc_id"], "token").collect() == []
    sizes = spark.createDataFrame([(1, 3)], "doc_id long, n int")
    assert [tuple(r)[1:] for r in L.semantic_pairs(none, sizes).collect()] == [(3, 0.0, 0.0, 1, 2, 0.0, 0, 1)]
    assert L.semantic_pairs(none, sizes.limit(0)).collect() == []


def test_narratives_in_their_latent_space(spark, sf):
    n = narratives(spark, sf).where("doc_id < 40").cache()
    entries = [tuple(r) for r in Q.tf_idf(n).select("doc_id", "sent_ix", "token", "value").collect()]
    sizes = {r["doc_id"]: r["n"] for r in L.sentence_counts(n).collect()}
    m = dense(entries, sizes)
    for r in queries.latent_similarity(spark, sf).where("doc_id < 40").collect():
        space = m[r["doc_id"]] if r["n"] < 3 else reference_space(m[r["doc_id"]], 5)
        mean, most, least = report(cosines(space))
        assert abs(r["most"] - most[0]) < 2e-4 and abs(r["least"] - least[0]) < 2e-4 and abs(r["coherence"] - mean) < 2e-3
