import random

import corpus_pipeline
from loomline import scratch
from loomline.llm import langid, packing, quality_crf, secret_scan, simhash
from loomline.llm.queries import language_model, quality_model, vocabulary
from tests.llm.cases import edge_docs, no_docs, words
from tests.llm.test_near_copies import slow_groups


def test_stages_against_a_plain_version(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [r.asDict() for r in docs.collect()]
    m = language_model(docs)
    lang, score = m.predict([r["text"] for r in rows])
    rows = [r for r, v, s in zip(rows, lang, score, strict=True) if v != "und" and s >= langid.AMBIGUOUS]
    kept = corpus_pipeline.language_id(spark, docs, sf).cache()
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(r["doc_id"] for r in rows)
    q = quality_model(kept, spark.read.parquet(f"{sf}/labels.parquet"))
    rows = [r for r, s in zip(rows, q.score([r["text"] for r in rows]), strict=True) if s >= quality_crf.GOOD_FROM]
    groups = dict(slow_groups([(r["doc_id"], r["text"]) for r in rows]))
    rows = [r for r in rows if groups[r["doc_id"]] == r["doc_id"]]
    for r in rows:
        r["text"] = secret_scan.redact(r["text"], secret_scan.scan(r["text"])[0])
        r["n_chars"] = len(r["text"])
    last = spark.createDataFrame(rows, docs.schema)
    key = lambda d: sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in d.collect())
    whole = lambda d: {(r["doc_id"], r["doc_tokens"]) for r in d.collect()}
    got, want = corpus_pipeline.run(spark, sf), packing.pack(last.repartition(1), vocabulary())
    assert whole(got) == whole(want) and sum(k[2] for k in key(got)) == sum(k[2] for k in key(want))
    assert 0 < len(rows) < docs.count()


def test_edges_and_nothing(spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    assert labels.count()
    for df in (edge_docs(spark), no_docs(spark)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, df, sf)
            assert out.columns == corpus_pipeline.COLUMNS and out.count() <= df.count()
        packed = corpus_pipeline.pack(spark, df, sf)
        assert {r["doc_id"] for r in packed.collect()} == {r["doc_id"] for r in df.collect()}
    one = corpus_pipeline.near_duplicates(spark, edge_docs(spark), sf).collect()
    ids = [r["doc_id"] for r in one if r["doc_id"] is not None]
    assert len(ids) == len(set(ids)) and 5 in ids and 6 not in ids


def test_run_on_edges_and_nothing(spark, sf, tmp_path):
    """run() reads its tables from a folder: rows with null ids and texts, repeated ids, clashing columns; and no rows at all."""
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    more = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    for name, df in (("edges", edge_docs(spark).unionByName(more, allowMissingColumns=True)), ("none", no_docs(spark))):
        df.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/{name}/labels.parquet")
        got = corpus_pipeline.run(spark, f"{tmp_path}/{name}")
        assert got.columns[0] == "doc_id" and (got.count() > 0) == (name == "edges")


def test_different_texts_of_one_id_stay(spark, sf):
    a, b, c = "one text that says a thing of its own here", "another text that has quite a different thing to say", "a third text with nothing of the other two in it at all"
    rows = [(5, a), (5, b), (5, a), (7, b), (7, c), (3, "a  third text with nothing of the other two in it at all")]
    df = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = sorted((r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, df, sf).collect())
    assert kept == sorted([(5, a), (5, b), (3, rows[-1][1])])


def test_without_columns_that_clash(spark):
    assert simhash.near_duplicates(edge_docs(spark)).columns == ["doc_id", "fingerprint", "component_id"]


def test_one_document_a_group_under_equal_and_null_ids(spark, sf):
    rng = random.Random(7)
    a, b = words(rng, 200), words(rng, 200)
    rows = [(5, a), (5, a + " more"), (5, b), (None, b + " more"), (None, a + " much more"), (None, c := words(rng, 200)), (None, c), (None, c + " again"), (9, b)]
    df = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    kept = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, df, sf).collect()]
    groups = [[x for x in kept if x[1].startswith(t)] for t in (a, b, c)]
    assert [len(g) for g in groups] == [1, 1, 1] and len(kept) == 3
    assert groups[0][0][0] == 5 and groups[1][0] == (5, b) and groups[2][0][0] is None


def test_run_leaves_nothing_behind(spark, sf, tmp_path):
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(50)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    made = set(scratch._TABLES.values())
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() and set(scratch._TABLES.values()) - made == {scratch._TABLES[out]}
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before
