"""Counts by RE2 are those of the JVM's patterns, in one pass."""

from pyspark.sql import functions as F

from loomline.functions import metrics as M
from loomline.functions import text as T
from loomline.functions.patterns import match_counts


def test_counts_and_syllables_are_those_of_the_plain_forms(spark):
    texts = ["never ever, i never", "ruinruin ruined.destroyed", "éalways alwaysé _always 一always alwayś always", "worst ever worst of all always\r\nalways", "", "it’s over and it's over", "100% i am a failure", None, "they are \U0001f600 toxic he is awful", "end ofend of"]
    d = spark.createDataFrame([(t,) for t in texts], "low string")
    both = d.select(match_counts(F.col("low"), M.COUNTED).alias("a"), F.array(*(F.coalesce(T.matches(F.col("low"), p), F.lit(0)) for p in M.COUNTED)).alias("b")).collect()
    assert all(r["a"] == r["b"] for r in both) and sum(map(sum, (r["a"] for r in both))) > 10
    words = spark.createDataFrame([(["tree", "agree", "rhythms", "a", "the", "agrees", "b'c'd", "used", "ee", "eeed"],), ([],)], "w array<string>")
    assert all(r[0] == r[1] for r in words.select(T.total_syllables(F.col("w")), F.aggregate(F.transform("w", T.syllables), F.lit(0), lambda a, x: a + x)).collect())


def test_a_metric_row_counts_its_patterns_in_one_pass(spark, sf):
    from loomline.plans import queries

    plan = queries.doc_metrics(spark, sf).select("cd_index", "vads")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_extracts_count_their_patterns_in_one_pass(spark, sf):
    from loomline.plans import queries

    plan = queries.extracts(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_extractor_counts_are_those_of_the_plain_forms(spark):
    gaps = [" ", "  ", "\t", "\n", "\r\n", "\x0b", "\f", "\x1c", "\x02", "\x85", "\u2028", "\u2029", "\xa0", "\u3000", "_", "é", ""]
    said = ["you{}crazy", "you're{}so x{}bad", "that{}never{}happen that{}didn't{}happen", "guilt{}tripping guilt{}trip", "sorry{}but{}again{}sorry again", "what{}if{}only", "keep{}thinking{}over{}and{}over", "threatened{}to leave{}you", "kids{}stay{}house{}together", "not{}the same"]
    texts = [t.replace("{}", g) for t in said for g in gaps] + ["x".join(said).replace("{}", " "), " ".join(said).replace("{}", " ").replace("a", "a\u0301"), "you crazyé you crazy\u0301", "", None, "épast past_ past.ex"]
    d = spark.createDataFrame([(t,) for t in texts], "low string")
    plain = F.array(*(F.coalesce(T.matches(F.col("low"), p), F.lit(0)) for p in M.EXTRACTED))
    rows = d.select("low", M.extractor_counts(F.col("low")).alias("a"), plain.alias("b"), F.coalesce(F.array(*(F.col("low").rlike(p) for p in M.EXTRACTED)), F.array()).alias("c")).collect()
    assert all(r["a"] == r["b"] for r in rows) and sum(map(sum, (r["a"] for r in rows))) > 100
    assert all([x > 0 for x in r["a"]] == [bool(x) for x in r["c"]] for r in rows)


def test_blaming_sentences_are_those_of_the_plain_form(spark):
    sents = [p.replace("\\b", "") + end for ps in (M.fixed.SELF_BLAME_PATTERNS, M.fixed.OTHER_BLAME_PATTERNS) for p in ps for end in ("", "x", "é", "_", " now")] + ["", "xmy fault", "émy fault", "I  should"]
    d = spark.createDataFrame([(sents,)], "s array<string>")
    b = M.blame(F.col("s"))
    old = [F.size(F.filter("s", lambda s: F.lower(s).rlike("|".join(f"(?:{p})" for p in ps)))) for ps in (M.fixed.SELF_BLAME_PATTERNS, M.fixed.OTHER_BLAME_PATTERNS)]
    r = d.select(b["self"].alias("a"), b["other"].alias("b"), old[0].alias("c"), old[1].alias("d")).first()
    assert (r["a"], r["b"]) == (r["c"], r["d"]) and r["a"] > 9


def test_sets_and_themes_are_those_of_the_plain_forms(spark):
    sets = spark.createDataFrame([(["a", "b"], ["b", "c"]), ([], []), (["a"], []), (["a"], ["a"])], "a array<string>, b array<string>")
    assert all(r[0] == r[1] for r in sets.select(T.jaccard_of_sets(F.col("a"), F.col("b")), T.jaccard(F.col("a"), F.col("b"))).collect())
    paras = ["The pain. End", "painful ending", "émpain why", "WHY not", "", "why's the end"]
    d = spark.createDataFrame([(paras[:k],) for k in range(len(paras) + 1)], "p array<string>")
    got = d.select(F.size("p"), M.rumination(F.lit(""), F.array(), F.col("p"))["repeats"]).collect()
    bags = [set(r[0]) for r in d.where(F.size("p") == len(paras)).select(F.explode("p").alias("x")).select(T.tokens(F.col("x"))).collect()]
    assert [r[1] for r in sorted(got)] == [sum(sum(th in b for b in bags[:n]) > n / 2 for th in M.fixed.RUMINATION_THEMES) for n in range(len(paras) + 1)]
