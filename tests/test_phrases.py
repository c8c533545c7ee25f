"""Phrases are counted where the document's row is, whatever their number and size."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from loomline.operators import joined as J
from loomline.operators import phrases as P
from loomline.plans.queries import QUERIES


def plain(spark, d, p):
    hits = J.phrase_hits(J.sentence_table(d), p.select("term").where("term is not null").distinct())
    hits.createOrReplaceTempView("phrase_hits_plain")
    return sorted(tuple(r) for r in spark.sql("select term, count(*), count(distinct doc_id) from phrase_hits_plain group by term").collect())


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abéA😀ßİ") for _ in range(rng.randrange(1, 7)))
    made = [". ".join(" ".join(word() for _ in range(rng.randrange(1, 9))).capitalize() for _ in range(rng.randrange(1, 12))) for _ in range(60)]
    return [*made, None, "", " ", "a", "Same. Same. Same.", "x" * 90 + ". " + "X" * 65]


@pytest.fixture(scope="module")
def terms(texts):
    rng = random.Random(4)
    low = [t.lower() for t in texts if t]
    return [t[i : i + rng.randrange(1, 20)] for t in low for i in (0, 5, len(t) // 2)] + ["zzz", "", None, "a", "a", "same", "x" * 64, "x" * 65, "x" * 91]


@pytest.mark.parametrize("most", [27, 5])
def test_counts_equal_those_of_all_hits(spark, monkeypatch, texts, terms, most):
    monkeypatch.setattr(P, "MOST", most)
    monkeypatch.setattr(P, "LEAST", min(P.LEAST, most))  # a small filter lets nearly all pass
    rng = random.Random(5)
    d = spark.createDataFrame([(rng.choice([k, k, 5, None]), t) for k, t in enumerate(texts)], "doc_id long, text string")
    p = spark.createDataFrame([(t,) for t in terms], "term string")
    assert sorted(tuple(r) for r in P.phrase_counts(d, p).collect()) == plain(spark, d, p)
    assert P.phrase_counts(d, p.limit(0)).collect() == []
    unique = d.where("doc_id is not null").dropDuplicates(["doc_id"])
    assert sorted(tuple(r) for r in P.phrase_counts(unique, p).collect()) == plain(spark, unique, p)


@pytest.mark.parametrize("chunk,slots", [(1 << 18, 18), (60, 2), (7, 18), (1, 1)])
def test_chunks_and_slots_change_no_count(monkeypatch, texts, terms, chunk, slots):
    # small chunks cut documents, few slots make windows collide, equal hashes make them look alike
    monkeypatch.setattr(P, "CHUNK", chunk)
    monkeypatch.setattr(P, "SLOTS", slots)
    known = [t for t in terms if t and len(t) <= P.LONGEST]
    full = lambda ks: {k: (12, np.full(1 << 9, 255, np.uint8)) for k in ks}
    filters = full({len(t) for t in known}), full({P._begin(len(t)) for t in known if len(t) > P.PACKED})
    sents = [[s.lower() for s in (t or "").split(". ")] for t in texts]
    for by_id in (False, True):
        n, docs = Counter(), Counter()
        for b in P._count(iter([pa.RecordBatch.from_arrays([pa.array(range(len(sents))), pa.array(sents)], names=["id", "s"])]), filters, by_id):
            for i, t, k, m in zip(*(c.to_pylist() for c in b.columns), strict=True):
                n[t] += k
                docs[t] += m
                if i is not None:
                    docs[t, i] = 1
        for t in list(docs):
            if isinstance(t, tuple):
                docs[t[0]] += 1
        for t in known:
            assert (n[t], docs[t]) == (sum(t in s for x in sents for s in x), sum(any(t in s for s in x) for x in sents)), t


def test_equal_hashes_of_different_windows_are_told_apart():
    points = np.frombuffer("abcdabceabcdabce".encode(), np.uint8)
    pos = np.array([0, 4, 8, 12])
    same = P._alike(points, pos, np.zeros(4, np.uint64), 4)
    assert same[0] == same[2] != same[1] == same[3]


def test_query_shuffles_neither_sentences_nor_hits(spark, sf):
    plan = QUERIES["phrase_index"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Generate" not in plan
