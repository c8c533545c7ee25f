import math
from functools import reduce

import pytest
from pyspark.sql import functions as F

from loomline.functions import metrics as M
from loomline.functions import scoring as S
from loomline.functions.lexicon import Entry, Lexicon, read_csv, starter
from loomline.operators import documents as D
from loomline.operators import evaluation as E
from loomline.sources import samples

LEX = Lexicon.of(
    [Entry("good", 2.0, 1.1, ("joy",)), Entry("bad", -2.0, 1.0, ("anger", "fear"), "contempt"), Entry("cold shoulder", -1.5, 1.0, ("sadness",), "stonewalling"), Entry("good", 2.0, 1.0, ("joy",))],
    negators=("not", "no"), intensifiers={"very": 1.4, "so": 1.2}, diminishers={"a bit": 0.7, "hardly": 0.4}, sarcasm=(r"\boh,?\s+great\b",),
)


def squash(s):
    return math.floor(s / math.sqrt(s * s + 15) * 1e4 + 0.5) / 1e4


@pytest.mark.parametrize(
    ("sentence", "total"),
    [
        ("It is good.", 2.0), ("It is very good.", 2.8), ("It is not good.", -1.4), ("not one two three good", -1.4), ("not one two three four good", 2.0), ("also good", 2.4),  # "so" inside "also"
        ("a bit very good", 2.8), ("very a bit good", 1.4), ("a person good", 2.4), ("hardly so good", 0.8), ("good bad", 0.0), ("the cold shoulder and the cold shoulder", -1.5), ("Oh great, good and bad", -4.0), ("nothing here", 0.0), ("", 0.0), ("no so bad", 1.68),
    ],
)
def test_sentence_rules(spark, sentence, total):
    got = spark.createDataFrame([([sentence],)], "s array<string>").select(S.score_sentences(F.col("s"), LEX)[0].alias("x")).first()["x"]
    assert got["compound"] == squash(total) + 0.0


def test_tags(spark):
    got = spark.createDataFrame([(["good bad bad cold shoulder"],)], "s array<string>").select(S.score_sentences(F.col("s"), LEX)[0].alias("x")).first()["x"]
    assert sorted(got["emotions"]) == ["anger", "anger", "fear", "fear", "joy", "sadness"] and got["horsemen"] == ["contempt", "contempt", "stonewalling"]


def test_lexicon_keeps_the_last_of_equal_terms(tmp_path):
    assert next(e for e in LEX.words if e.term == "good").i == 1.0 and len(LEX.phrases) == 1
    (tmp_path / "l.csv").write_text("term,s,i,emotions,horseman\nnice,1.5,,joy;trust,\ncold look,-1,1.2,,contempt\n")
    got = read_csv(str(tmp_path / "l.csv"), negators=("not",))
    assert got.entries == (Entry("nice", 1.5, 1.0, ("joy", "trust")), Entry("cold look", -1.0, 1.2, (), "contempt")) and got.negators == ("not",)


def slow_lewi(s):
    n = len(s)
    if n < 4:
        return None
    w = max(1, n // 4)
    add = lambda v: reduce(lambda a, b: a + b, v, 0.0)  # noqa: E731  plain sums: sum() compensates
    sm = [add(s[max(0, i - w) : min(n, i + w + 1)]) / (min(n, i + w + 1) - max(0, i - w)) for i in range(n)]
    if max(sm) - min(sm) < 0.01:
        sm = s
    d = [b - a for a, b in zip(sm, sm[1:], strict=False)]
    turns = [(abs(d[i - 1] - d[i]), -i) for i in range(1, len(d) - 1) if d[i - 1] * d[i] < 0]
    return -max(turns)[1] if turns else max(range(len(d)), key=lambda i: abs(d[i]))


def test_watershed_arc_and_gradient(spark):
    import random

    rng = random.Random(4)
    series = [[0.1] * 5, [0.1, 0.2, 0.3, 0.4, 0.5], [0.5, 0.4, -0.1, 0.9], [0.1, 0.2, 0.3], [], *[[round(rng.uniform(-1, 1), 4) for _ in range(rng.randrange(4, 40))] for _ in range(60)]]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(series)], "i int, s array<double>").select("i", M.lewi(F.col("s")).alias("l"), M.nava(F.col("s")).alias("n"), M.nava(F.reverse("s")).alias("m"), M.teg(F.col("s")).alias("t"), M.teg(F.reverse("s")).alias("u")).collect()
    for r in rows:
        s = series[r["i"]]
        assert (r["l"]["idx"] if r["l"] else None) == slow_lewi(s), s
        assert r["t"] == r["u"] and r["t"] >= 0
        assert (r["n"] is None) == (len(s) < 4) and (r["n"] is None or abs(r["n"] + r["m"]) < 1.01e-4)


def test_engineered_texts_meet_their_predicates(spark):
    rows = D.doc_metrics(samples.engineered(spark), starter())
    for key, (_, predicates) in samples.NARRATIVES.items():
        got = E.validation_suite(rows.where(F.col("doc_id") == key), {p: p for p in predicates}).collect()
        assert all(r["passed"] == 1 for r in got), (key, [r["name"] for r in got if not r["passed"]])


def test_ranges(spark, sf):
    from loomline.plans.queries import doc_metrics

    m = doc_metrics(spark, sf)
    bad = m.where("gase not between -1 and 1 or pti not between -1 and 1 or rci not between 0 and 1 or cd_index not between 0 and 1 or vads not between 0 and 1 or pai not between 0 and 1 or ties < 0 or teg < 0")
    assert bad.count() == 0 and m.count() > 0


def test_gold_sentences(spark):
    g = D.score_text(samples.gold_sentences(spark), starter(), "id")
    from loomline.functions.text import label

    rows = g.join(samples.gold_sentences(spark), "id").withColumn("pred", label(F.col("mean"))).collect()
    assert sum(r["pred"] == r["sentiment"] for r in rows) == len(rows)


def test_empty_and_null_documents(spark):
    df = spark.createDataFrame([(1, ""), (2, None), (3, "word"), (4, "  ")], "doc_id int, text string")
    s = {r["doc_id"]: r for r in D.doc_stats(df, starter()).collect()}
    assert s[1]["n_words"] == s[1]["n_sents"] == 1 and s[1]["n_paras"] == 0 and s[2]["smog"] is None and s[3]["honore_r"] == 0.0
    assert [r["doc_id"] for r in D.doc_metrics(df, starter()).collect()] == [3]


def test_snippets_rules_and_nspl(spark):
    df = spark.createDataFrame([(1, "You're overreacting, that never happened. I never said that. You're crazy."), (2, "Calm. Plain words here.")], "doc_id int, text string")
    got = {(r["doc_id"], r["category"]): r["snippets"] for r in D.snippets(df).collect()}
    assert len(got[(1, "Gaslighting")]) == 3 and all(k[0] == 1 for k in got)
    n = {r["doc_id"]: r["nspl"] for r in D.nspl(df.unionByName(spark.createDataFrame([(3, "One only.")], df.schema)), starter()).collect()}
    assert n[3] == 0.0 and 0 < n[1] <= 1 and 0 < n[2] <= 1
