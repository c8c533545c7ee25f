"""Counts of a document are made where its row is: no token, pair of words or sentence is shuffled."""

import re

import numpy as np
import pytest

from loomline.operators import frequency as Q
from loomline.operators import latent as L


def exchanges(df):
    return len(re.findall(r"Exchange hashpartitioning", df._jdf.queryExecution().executedPlan().toString()))


@pytest.fixture(scope="module")
def docs(spark):
    words = np.random.default_rng(1).choice(["storm", "river", "quiet", "meadow", "lantern", "harbour"], (12, 40))
    rows = [(i, " ".join(f"{a.capitalize()} {b} {c}." for a, b, c in w[:39].reshape(-1, 3).tolist())) for i, w in enumerate(words)]
    return spark.createDataFrame([*rows, (12, None), (13, ""), (None, "Storm river. Quiet meadow.")], "doc_id long, text string")


def test_document_tables_need_no_shuffle(docs):
    terms = Q.sentence_terms(docs)
    assert [exchanges(x) for x in (Q.tf_idf(docs), L.document_pairs(terms), L.document_pairs(terms, latent=False), L.similar_sentences(terms))] == [0, 0, 0, 0]
    assert exchanges(Q.pmi(docs)) == 1  # the rank of pairs that occur twice


def test_both_forms_agree(docs, monkeypatch):
    terms, entries, sizes = Q.sentence_terms(docs), Q.tf_idf(docs), L.sentence_counts(docs.where("doc_id is not null"))
    want = sorted(L.semantic_pairs(entries, sizes, latent=False).collect())
    pairs = sorted(Q.sentence_similarity(entries).collect())
    for block, cells in ((256, 1 << 22), (5, 1 << 22), (5, 1)):
        monkeypatch.setattr(L, "AT_ONCE", block)
        monkeypatch.setattr(L, "CELLS", cells)
        assert sorted(L.document_pairs(terms, latent=False).collect()) == want and len(want) == 12
        assert sorted(L.similar_sentences(terms).collect()) == pairs and pairs


def test_few_columns_are_factored_in_one_pass(spark, monkeypatch):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(50, 20)) * (rng.random((50, 20)) < 0.5) * np.geomspace(8, 1, 20)
    rows = [(i, f"t{j}", float(base[i, j])) for i in range(50) for j in range(20) if base[i, j]]
    m = spark.createDataFrame(rows, "doc_id long, token string, value double").repartition(3)
    monkeypatch.setattr(L, "ROUNDS", 0)
    got = {r["doc_id"]: r["vector"] for r in L.corpus_vectors(m, ["doc_id"], "token", rounds=0).collect()}
    mine, s = np.array([got[i] for i in sorted(got)]), np.linalg.svd(base, compute_uv=False)
    assert np.allclose(np.linalg.norm(mine, axis=0), s[:5], rtol=1e-9)  # no round of iteration is needed


def test_few_phrases_are_searched_where_the_sentence_is(spark, docs, monkeypatch):
    from loomline.operators import joined as J

    s = J.sentence_table(docs)
    phrases = spark.createDataFrame([("storm river",), ("a",), ("",), (None,), ("m lantern quiet",), ("a",)], "term string")
    few = J.phrase_hits(s, phrases)
    assert exchanges(few) == 0
    got = sorted(few.where("doc_id is not null").collect())
    monkeypatch.setattr(J, "FEW", 0)
    assert got == sorted(J.phrase_hits(s, phrases).where("doc_id is not null").collect()) and got
