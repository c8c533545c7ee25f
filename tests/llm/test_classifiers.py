import zlib

import numpy as np

from loomline.llm import langid, quality_crf
from loomline.llm.queries import language_model, op1_quality_crf, op6_language_id, quality_model
from tests.llm.cases import edge_docs, no_docs


def test_chain_against_all_labellings():
    rng = np.random.default_rng(0)
    lines = np.array([1, 4, 3, 6])
    u, t = rng.normal(size=lines.sum()) * 2, rng.normal(size=(2, 2))
    p, pairs = quality_crf.chain(u, t, lines, True)
    at, expected = 0, np.zeros((2, 2))
    for n in lines:
        z, own = 0.0, np.zeros(n)
        for k in range(1 << n):
            y = [k >> i & 1 for i in range(n)]
            w = np.exp(sum(u[at + i] * y[i] for i in range(n)) + sum(t[y[i], y[i + 1]] for i in range(n - 1)))
            z += w
            own += w * np.array(y)
        for k in range(1 << n):
            y = [k >> i & 1 for i in range(n)]
            w = np.exp(sum(u[at + i] * y[i] for i in range(n)) + sum(t[y[i], y[i + 1]] for i in range(n - 1))) / z
            for i in range(n - 1):
                expected[y[i], y[i + 1]] += w
        assert np.allclose(p[at : at + n], own / z)
        at += n
    assert np.allclose(pairs, expected)


def test_measures_do_not_depend_on_the_block():
    texts = ["One line.\nTWO!! TWO!! lines\n\n| a | b |", "", "x", "é ñ 123 *** ###"]
    whole = quality_crf.measure(texts)
    parts = [quality_crf.measure([t]) for t in texts]
    assert np.allclose(whole[0], np.concatenate([p[0] for p in parts])) and whole[2].tolist() == [4, 1, 1, 1]


def test_quality_query_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = op1_quality_crf(spark, sf).collect()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    held = [(labels[r["doc_id"]], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert np.mean([y == p for y, p in held]) > 0.95


def test_language_query_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op6_language_id(spark, sf).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in rows)
    assert np.mean([lang[r["doc_id"]] == r["lang_pred"] for r in rows if r["held_out"]]) > 0.95


def test_codewords_keep_apart():
    for n in (2, 4, 6, 9, 30):
        c = langid.codewords(n)
        d = (c.shape[1] - c @ c.T) / 2
        assert len(c) == n and d[~np.eye(n, dtype=bool)].min() >= 1


def test_edges(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    q, m = quality_model(docs, labels), language_model(docs)
    df = edge_docs(spark)
    got = quality_crf.classify(df, q).collect()
    assert len(got) == df.count() and all(0 <= r["score"] <= 1 for r in got)
    assert len({round(r["score"], 9) for r in got if r["doc_id"] in (1, 2)}) == 1
    found = {r["doc_id"]: r["lang_pred"] for r in langid.identify(df, m).collect()}
    assert found[1] == found[2] == found[3] == found[8] == "und" and found[4] != "und"
    assert quality_crf.line_labels(df.where("doc_id = 5"), q).select("line", "start", "length").collect()[0].asDict() == {"line": 0, "start": 0, "length": 23}
    for f in (quality_crf.classify, langid.identify):
        assert f(no_docs(spark), q if f is quality_crf.classify else m).count() == 0


def test_nothing_to_learn_from(spark):
    none = quality_model(no_docs(spark), spark.createDataFrame([], "doc_id long, quality int"))
    assert all(r["predicted"] == 1 for r in quality_crf.classify(edge_docs(spark), none).collect())
    assert {r["lang_pred"] for r in langid.identify(edge_docs(spark), language_model(no_docs(spark))).collect()} == {"und"}
    one = langid.train(edge_docs(spark).where("doc_id = 5"))
    assert {r["lang_pred"] for r in langid.identify(edge_docs(spark).where("doc_id = 5"), one).collect()} == {"en"}
