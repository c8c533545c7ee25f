"""Queries over pairs of sentences against brute force: no sentence and no narrative is left out."""

import itertools
import math
import random
from collections import Counter

from loomline.functions import text as T
from loomline.operators import frequency as Q
from loomline.operators import joined as J
from loomline.plans import queries
from loomline.plans.narratives import narratives
from pyspark.sql import functions as F


def sentences_of(df):
    rows = J.sentence_table(df).select("doc_id", "sent_ix", T.tokens(F.col("sentence")).alias("w")).collect()
    out = {}
    for r in sorted(rows, key=lambda r: r["sent_ix"]):
        out.setdefault(r["doc_id"], []).append(r["w"])
    return out


def test_sentence_pairs_over_all_sentences(spark, sf):
    want = {}
    for k, ws in sentences_of(narratives(spark, sf)).items():
        pairs = list(itertools.combinations([sorted(set(w)) for w in ws], 2))
        if pairs:
            want[k] = (len(pairs), sum(bool(set(a) & set(b)) for a, b in pairs), sum(a == b for a, b in pairs))
    got = {r["doc_id"]: (r["pairs"], r["overlapping"], r["equal"]) for r in queries.sentence_pairs(spark, sf).collect()}
    assert got == want and max(n for n, *_ in want.values()) > 190


def test_pairs_of_segments_without_tokens(spark):
    df = spark.createDataFrame([(1, []), (1, []), (1, ["a"]), (1, ["a", "b"]), (1, ["a", "b"]), (2, ["a"])], "doc_id long, w array<string>")
    assert [tuple(r) for r in J.pair_counts(df, "doc_id", "w").collect()] == [(1, 10, 3, 2)]


def test_sentence_similarity_over_all_narratives(spark, sf):
    vectors = {}
    for r in Q.tf_idf(narratives(spark, sf)).collect():
        vectors.setdefault(r["doc_id"], {}).setdefault(r["sent_ix"], {})[r["token"]] = r["value"]
    want = {}
    for k, by in vectors.items():
        norm = {i: math.sqrt(sum(x * x for x in v.values())) for i, v in by.items()}
        cos = [sum(x * by[j].get(t, 0.0) for t, x in by[i].items()) / (norm[i] * norm[j]) for i, j in itertools.combinations(sorted(by), 2) if by[i].keys() & by[j].keys()]
        if cos:
            want[k] = (len(cos), sum(cos), max(cos))
    got = {r["doc_id"]: r for r in queries.sentence_similarity(spark, sf).collect()}
    assert got.keys() == want.keys() and Counter(k % 2 for k in got)[1] > 0
    for k, (n, total, top) in want.items():
        assert got[k]["pairs"] == n and abs(got[k]["total"] / 10000 - total) <= 1e-4 * n and abs(got[k]["top"] - top) <= 1e-4


def test_pair_counts_by_bitmaps(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(d, sorted({rng.choice("abcdefghij") for _ in range(rng.randrange(4))})) for d, n in ((1, 40), (2, 3), (3, 1), (None, 9)) for _ in range(n)] + [(4, None), (4, ["a"]), (4, ["a", "a"])]
    df = spark.createDataFrame(rows, "doc_id long, w array<string>").repartition(3)
    want = {}
    for d in (1, 2, None, 4):
        pairs = list(itertools.combinations([w for k, w in rows if k == d], 2))
        want[d] = (len(pairs), sum(bool(set(a or ()) & set(b or ())) for a, b in pairs), sum(a == b for a, b in pairs))
    for block, at_once in ((J.BLOCK, J.ROWS), (16, 3)):
        monkeypatch.setattr(J, "BLOCK", block)
        monkeypatch.setattr(J, "ROWS", at_once)
        assert {r["doc_id"]: (r["pairs"], r["overlapping"], r["equal"]) for r in J.pair_counts(df, "doc_id", "w").collect()} == want
    assert J.pair_counts(df.limit(0), "doc_id", "w").collect() == []


def test_a_word_in_all_segments_costs_no_pairs():
    rng = random.Random(6)
    segments = [[0, *(1 + rng.randrange(200) for _ in range(5))] for _ in range(20_000)]
    assert J.overlapping_pairs(segments, 201) == 20_000 * 19_999 // 2


def test_phrases_of_a_table_of_any_size(spark):
    rng = random.Random(7)
    text = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    sents = [(k % 7, k, text(rng.randrange(0, 60)).upper() if k % 3 else text(40)) for k in range(120)]
    terms = sorted({s[rng.randrange(len(s)) :][: rng.randrange(1, 9)].lower() for _, _, s in sents for _ in range(3) if s} - {""}) + ["zzz", "z", "abcdx", "", "a"]
    s = spark.createDataFrame(sents, "doc_id long, sent_ix int, sentence string")
    p = spark.createDataFrame([(t, k) for k, t in enumerate(terms)] + [(None, -1)], "term string, s int")
    got = sorted((r["doc_id"], r["sent_ix"], r["term"], r["s"]) for r in J.phrase_hits(s, p).collect())
    assert got == sorted((d, i, t, k) for d, i, x in sents for k, t in enumerate(terms) if t and t in x.lower())
    assert J.phrase_hits(s, p.limit(0)).columns == ["doc_id", "sent_ix", "term", "s"] and J.phrase_hits(s, p.limit(0)).count() == 0


def test_ten_thousand_phrases_without_a_nested_loop(spark):
    p = spark.range(10_000).selectExpr("concat('term ', id) as term", "id as s")
    s = spark.range(200).selectExpr("id as doc_id", "0 as sent_ix", "concat('one term ', id * 40, '!') as sentence")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        hits = J.phrase_hits(s, p)
        plan = hits._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
        want = sum(f"term {k}" in f"one term {40 * d}!" for d in range(200) for k in {int(str(40 * d)[:n]) for n in range(1, 5)})
        assert hits.count() == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_grams_are_whole_characters(spark):
    df = spark.createDataFrame([("aXb\n😀cd",), ("",), ("ab",)], "t string")
    got = [sorted(r[0]) for r in df.select(J._grams(F.col("t"), 3)).collect()]
    assert got == [sorted(["aXb", "Xb\n", "b\n😀", "\n😀c", "😀cd"]), [], []]
    plan = df.select(J._grams(F.col("t"), 3).alias("g"))._jdf.queryExecution().optimizedPlan().toString()
    assert "substring" not in plan  # linear in the text
