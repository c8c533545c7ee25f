"""Sentence scores by a lexicon table: nothing is shuffled, and sums do not depend on where batches end."""

import pytest

from loomline.functions.lexicon import Entry, Lexicon, starter
from loomline.operators import joined as J


@pytest.fixture(scope="module")
def docs(spark):
    texts = ["I love you. I am not happy. Oh great, another plan!", "", None, "The cold shoulder. He let down my hope and made up.", "No words here", "Very happy. " * 60]
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_no_shuffle_and_the_same_sums(spark, docs, monkeypatch):
    lex = Lexicon.of([*starter().entries, Entry("tired", -1.0)], negators=starter().negators, intensifiers=starter().intensifiers, diminishers=starter().diminishers, sarcasm=starter().sarcasm)
    terms = lex.table(spark).where("not is_phrase").drop("is_phrase")
    twice = terms.unionByName(terms.where("term = 'happy'"))  # a term may be listed twice
    got = J.score_sentences(docs, twice, lex)
    assert "Exchange hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()
    many = rows(got)
    with_batches = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        assert rows(J.score_sentences(docs, twice, lex)) == many
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", with_batches)
    monkeypatch.setattr(J, "TERMS", 0)
    assert rows(J.score_sentences(docs, twice, lex)) == many and any(r[2] for r in many)
