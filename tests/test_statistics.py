import math
import random

import pytest
from pyspark.sql import functions as F

from loomline.operators import evaluation as E
from loomline.operators import statistics as St


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def ranks(v):
    return [sum(x < y for x in v) + (sum(x == y for x in v) + 1) / 2 for y in v]


def corr(x, y):
    n, mx, my = len(x), sum(x) / len(x), sum(y) / len(y)
    d = math.sqrt(sum((a - mx) ** 2 for a in x)) * math.sqrt(sum((b - my) ** 2 for b in y))
    return sum((a - mx) * (b - my) for a, b in zip(x, y, strict=True)) / d if d and n >= 3 else 0.0


@pytest.fixture(scope="module")
def pairs():
    rng = random.Random(6)
    return [(rng.randrange(20) / 10, rng.randrange(30) / 10) for _ in range(200)]


def test_correlations(spark, pairs):
    df = frame(spark, [("a", *p) for p in pairs] + [("a", None, 1.0), ("a", float("nan"), 1.0)], "k string, x double, y double")
    x, y = zip(*pairs, strict=True)
    assert St.pearson(df, ["k"], "x", "y").first()["r"] == pytest.approx(corr(x, y), abs=6e-5)
    for keys in (["k"], []):
        got = St.spearman(df, keys, "x", "y").first()
        assert got["rho"] == pytest.approx(corr(ranks(x), ranks(y)), abs=6e-5) and got["n"] == 200


def test_no_variance_and_few_rows(spark):
    df = frame(spark, [("c", 1.0, float(i)) for i in range(5)] + [("f", 1.0, 2.0), ("f", 2.0, 3.0)], "k string, x double, y double")
    assert {(r["k"], r["r"], r["p"]) for r in St.pearson(df, ["k"], "x", "y").collect()} == {("c", 0.0, 1.0), ("f", 0.0, 1.0)}


def test_perfect_and_steps_of_p(spark):
    df = frame(spark, [(float(i), 2.0 * i) for i in range(30)], "x double, y double")
    got = St.pearson(df, [], "x", "y").first()
    assert got["r"] == 1.0 and got["p"] == 0.0001 and got["sig"] == "***"
    t = frame(spark, [(v,) for v in (5.0, -4.0, 3.0, 2.0, 1.7, 1.0)], "t double").select(St.p_of_t(F.col("t"), F.lit(10)).alias("p")).collect()
    assert [r["p"] for r in t] == [0.0001, 0.001, 0.01, 0.05, 0.1, 0.5]


def test_auc_is_the_share_of_ordered_pairs(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(8) / 8, rng.random() < 0.4) for _ in range(150)]
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    want = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))
    df = frame(spark, rows, "s double, y boolean")
    assert St.auc(df, [], "s", F.col("y")).first()["auc"] == pytest.approx(want, abs=6e-5)
    assert St.auc(df.withColumn("s", -F.col("s")), [], "s", F.col("y")).first()["auc"] == pytest.approx(1 - want, abs=1.1e-4)
    assert St.auc(df.where("y"), [], "s", F.col("y")).first()["auc"] == 0.5
    c = St.roc_curve(df, [], "s", F.col("y")).orderBy("fpr", "tpr").collect()
    assert (c[-1]["fpr"], c[-1]["tpr"]) == (1.0, 1.0)


def test_precision_recall(spark):
    df = frame(spark, [("pos", "pos"), ("pos", "neg"), ("neg", "neg"), ("neu", "pos")], "g string, p string")
    r = St.precision_recall(df, [], "g", "p").first()
    assert (r["p_pos"], r["r_pos"], r["f1_neu"], r["accuracy"]) == (0.5, 0.5, 0.0, 0.5) and r["macro_f1"] == pytest.approx((0.5 + 2 / 3) / 3, abs=6e-4)
    m = {x["gold"]: x for x in St.confusion_matrix(df, [], "g", "p").collect()}
    assert m["pos"]["pred_pos"] == m["pos"]["pred_neg"] == 1


def test_agreement(spark):
    rows = [("i1", "r1", "a"), ("i1", "r2", "a"), ("i2", "r1", "a"), ("i2", "r2", "b"), ("i3", "r1", "b"), ("i3", "r2", "b")]
    df = frame(spark, rows, "item string, rater string, label string")
    assert St.percent_agreement(df, [], "item", "label").first()["agreement"] == pytest.approx(2 / 3, abs=6e-5)
    assert St.fleiss_kappa(df, [], "item", "label").first()["kappa"] == pytest.approx((2 / 3 - 0.5) / 0.5, abs=6e-5)
    two = frame(spark, [("a", "a"), ("a", "b"), ("b", "b"), (None, "a")], "x string, y string")
    assert St.cohen_kappa(two, [], "x", "y").first()["kappa"] == pytest.approx((2 / 3 - 4 / 9) / (5 / 9), abs=6e-5)
    alpha = St.krippendorff(two, [], "x", "y").first()["alpha"]
    assert alpha == pytest.approx(1 - (1 / 3) / (2 * 3 * 3 / (6 * 5)), abs=6e-5)
    assert St.krippendorff(two.where("x = y and x = 'a'"), [], "x", "y").collect()[0]["alpha"] is None


def test_icc_published_example(spark):
    table = [[9, 2, 5, 8], [6, 1, 3, 2], [8, 4, 6, 8], [7, 1, 2, 6], [10, 5, 6, 9], [6, 2, 4, 7]]  # 0.29 in the literature
    df = frame(spark, [(i, j, float(v)) for i, row in enumerate(table) for j, v in enumerate(row)], "item int, rater int, v double")
    assert St.icc(df, [], "item", "rater", "v").first()["icc"] == pytest.approx(0.2898, abs=1e-4)


def test_effect_wilcoxon_mcnemar(spark):
    df = frame(spark, [(1.0, True), (2.0, True), (3.0, True), (4.0, False), (5.0, False), (6.0, False)], "v double, a boolean")
    r = St.effect_size(df, [], "v", F.col("a")).first()
    assert r["cohens_d"] == -3.0 and r["hedges_g"] == -2.4 and r["size"] == "large"
    w = frame(spark, [(float(x), float(y)) for x, y in [(125, 110), (115, 122), (130, 125), (140, 120), (140, 140), (115, 124), (140, 123), (125, 137), (140, 135), (135, 145)]], "x double, y double")
    assert St.wilcoxon(w, [], "x", "y").first()["w"] == 18.0
    assert St.wilcoxon(w.limit(3), [], "x", "y").first()["w"] is None
    m = frame(spark, [(True, False)] * 20 + [(False, True)] * 5 + [(True, True)] * 10, "a boolean, b boolean")
    assert St.mcnemar(m, [], F.col("a"), F.col("b")).first()["chi2"] == round(14**2 / 25, 3)


def test_bootstrap(spark):
    df = frame(spark, [("g", i, float(i % 50)) for i in range(400)] + [("one", 1000, 3.0)], "k string, id int, v double")
    got = {r["k"]: r for r in St.bootstrap_mean(df, ["k"], "v").collect()}
    assert got["one"]["lo"] == got["one"]["hi"] == 3.0
    assert got["g"]["lo"] < got["g"]["point"] == 24.5 < got["g"]["hi"] and 2 < got["g"]["hi"] - got["g"]["lo"] < 4
    again = {r["k"]: r for r in St.bootstrap_mean(df.repartition(5), ["k"], "v").collect()}
    assert again == got
    import numpy as np

    med = St.bootstrap(df.where("k = 'g'"), ["k"], "v", np.median).first()
    assert med["lo"] <= med["point"] <= med["hi"]


def test_describe_and_rollup(spark):
    df = frame(spark, [("a", 1.0), ("a", 3.0), ("a", None), ("b", 5.0)], "k string, v double")
    d = {r["k"]: r for r in St.describe(df, ["k"], ["v"]).collect()}
    assert (d["a"]["mean"], d["a"]["median"], d["a"]["n"], d["b"]["sd"]) == (2.0, 2.0, 2, 0.0)
    r = {x["k"]: x["v"] for x in E.rollup(df.where("v is not null").groupBy("k").agg(F.avg("v").alias("v")), "k", ["v"]).collect()}
    assert r == {"a": 2.0, "b": 5.0, "mean": 3.5}


def test_p_values_at_their_edges(spark):
    """No correlation has p 1, no discordant pair chi-square 0 and p 1, and the stepped p of 0.05 does not do for a verdict."""
    from loomline.operators import evaluation as E

    flat = spark.createDataFrame([(-1.0, 1.0), (1.0, 1.0), (-1.0, -1.0), (1.0, -1.0)], "x double, y double")
    assert tuple(St.pearson(flat, [], "x", "y").first()) == (0.0, 1.0, "ns", 4)
    assert St.spearman(flat, [], "x", "y").first()["p"] == 1.0
    same = spark.createDataFrame([(k % 2 == 0,) for k in range(40)], "a boolean")
    assert tuple(St.mcnemar(same, [], F.col("a"), F.col("a")).first()[k] for k in ("chi2", "p")) == (0.0, 1.0)
    even = spark.createDataFrame([(k, float(k)) for k in (-3, -2, -1, 1, 2, 3)], "k int, x double").withColumn("y", F.lit(0.0))
    assert St.wilcoxon(even, [], "x", "y").first()["p"] == 1.0
    # t between 1.960 and 2.576
    rows = [("a", float(k), float(k if k % 10 < 4 else (k * 37) % 61)) for k in range(60)]
    got = E.experiment(spark.createDataFrame(rows, "d string, x double, y double"), ["d"], "x", "y", 0.2).first()
    t = got["r"] * (58 / (1 - got["r"] ** 2)) ** 0.5
    assert (1.960 < t <= 2.576) == (got["p"] == 0.05) and got["supported"] == (got["r"] > 0.2 and got["p"] < 0.05)
    few = spark.createDataFrame([("a", 1.0, 2.0)], "dataset string, nava double, lewi_drop double")
    assert tuple(E.drop_validation(few, ["dataset"]).select("r", "p", "n", "supported", "lewi_sd").first()) == (0.0, 1.0, 1, False, 0.0)


def test_hypotheses_and_summary(spark):
    from loomline.operators import evaluation as E

    rng = random.Random(9)
    names = ["sentiment", "gase", "pti", "teg", "pai", "nava", "lewi_drop", "cd_index", "vads", "ties", "vader_score", "nrc_score", "liwc_score"]
    rows = []
    for k in range(80):
        z = rng.uniform(-1, 1)
        rows.append(("d", ["pos", "neg", "neu"][k % 3], *(round(z + rng.uniform(-0.5, 0.5), 4) for _ in names)))
    df = spark.createDataFrame(rows, "dataset string, gold_sentiment string, " + ", ".join(f"{n} double" for n in names))
    got = {r["id"]: r for r in E.hypothesis_results(df, ["dataset"]).collect()}
    assert set(got) == {"H1", "H2", "H3", "H6", "H7"}
    assert got["H2"]["supported"] and not got["H6"]["supported"] and got["H1"]["statistic"] == E.drop_validation(df, ["dataset"]).first()["r"]
    s = E.dataset_summary(df, ["dataset"]).first()
    assert s["n"] == 80 and s["directions"] == 10 and s["directions_right"] == sum(h == "positive" for _, _, h in E.PAIRS)


def test_ranks_and_medians_over_range_partitions(spark):
    from pyspark.sql import Window

    from loomline.operators import ranks

    rng = random.Random(12)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([0.0, -0.0, 1.5, rng.random(), rng.random() * 5]), rng.random()) for _ in range(600)] + [("c", 2.0, 1.0), ("d", 1.0, 0.0), ("d", 2.0, 0.0)]
    df = spark.createDataFrame(rows, "k string, x double, y double").repartition(7)
    got = {r["k"]: r["median"] for r in ranks.medians(df, ["k"], "x").collect()}
    for k in ("a", "b", None, "c", "d"):
        v = sorted(x for key, x, _ in rows if key == k)
        assert got[k] == (v[(len(v) - 1) // 2] / 2 + v[len(v) // 2] / 2)
    assert ranks.medians(df, [], "x").first()[0] == (lambda v: v[(len(v) - 1) // 2] / 2 + v[len(v) // 2] / 2)(sorted(x for _, x, _ in rows))
    counts = df.groupBy("k", "x").agg(F.count("*").alias("n"))
    plain = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("k").orderBy("x").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    want = sorted(((r["k"], r["x"], r["n"], r["before"]) for r in plain.collect()), key=repr)
    assert sorted(((r["k"], r["x"], r["n"], r["before_n"]) for r in ranks.positions(counts, ["k"], "x", ["n"]).collect()), key=repr) == want
    x, y = ([r[i] for r in rows if r[0] == "a"] for i in (1, 2))
    assert math.isclose(St.spearman(df.where("k = 'a'"), [], "x", "y").first()["rho"], corr(ranks_of(x), ranks_of(y)), abs_tol=1e-4)


def ranks_of(v):
    return ranks(v)


def test_no_window_over_a_whole_key(spark):
    df = spark.range(1000).selectExpr("id % 2 as k", "rand(1) as x", "rand(2) as y")
    for out in (St.spearman(df, ["k"], "x", "y"), St.describe(df, ["k"], ["x", "y"]), St.wilcoxon(df, ["k"], "x", "y"), St.auc(df, ["k"], "x", F.col("y") > 0.5), St.roc_curve(df, [], "x", F.col("y") > 0.5)):
        text = out._jdf.queryExecution().optimizedPlan().toString()
        windows = [line for line in text.splitlines() if line.strip(" :+-").startswith("Window")]
        # one over the rows of a range partition, one over the totals of the partitions
        assert windows and all("_part" in line for line in windows), windows
        assert "percentile" not in text and "median" not in text.lower().replace("median#", "").replace("as median", "")


def test_bootstrap_of_sums_against_a_plain_version(spark):
    import numpy as np

    rng = random.Random(13)
    rows = [(rng.choice(["a", "b", None]), k, rng.gauss(3, 2)) for k in range(400)] + [("one", 900, 7.25), ("a", 901, float("nan")), ("a", 902, None)]
    df = spark.createDataFrame(rows, "k string, id long, x double").repartition(5)
    variance = F.col("ss") / F.col("w") - (F.col("s") / F.col("w")) * (F.col("s") / F.col("w"))
    got = {r["k"]: r for r in St.bootstrap_sums(df, ["k"], {"s": F.col("x"), "ss": F.col("x") * F.col("x")}, variance, draws=200).collect()}
    hashes = {r["id"]: r["h"] for r in df.select("id", F.xxhash64("k", "id", "x").alias("h")).collect()}
    for k in ("a", "b", None, "one"):
        mine = [(hashes[i], x) for key, i, x in rows if key == k and x is not None and not math.isnan(x)]
        w = St._draw_weights(np.array([h for h, _ in mine], np.int64), 200, 11)
        x = np.array([x for _, x in mine])
        drawn = sorted(float((c * x * x).sum() / c.sum() - ((c * x).sum() / c.sum()) ** 2) for c in w.T if c.sum())
        assert got[k]["n"] == len(mine) and math.isclose(got[k]["point"], x.var(), abs_tol=1e-4)
        if len(mine) > 1:
            assert math.isclose(got[k]["lo"], drawn[int(0.025 * len(drawn))], abs_tol=2e-4) and math.isclose(got[k]["hi"], drawn[min(len(drawn) - 1, int(0.975 * len(drawn)))], abs_tol=2e-4)
            assert got[k]["lo"] < got[k]["point"] < got[k]["hi"]
    w = St._draw_weights(np.arange(20_000), 50, 1)
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02 and abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.03
