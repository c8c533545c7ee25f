"""Grouped statistics. Every function takes a frame and grouping keys (maybe none) and returns one frame.

Rank-based statistics first collapse to distinct values. Where these may be many they are placed by range partitions
(:mod:`loomline.operators.ranks`); scores that are rounded to 4 places in [-1, 1] have 20,001 values a group at most, however many rows
there are, and callers that have such scores may say ``bounded`` for a plain window over them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions import text as T
from loomline.operators import ranks
from loomline.scratch import materialize

CLASSES = ("pos", "neg", "neu")


def _zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def p_of_t(t: Column, df: Column) -> Column:
    """Two-tailed p of a t statistic, in the steps that reports use."""
    a = F.abs(t)
    out = F.when(df <= 0, 1.0)
    # t = 0 leaves nothing to test, nor does one that vanishes beside the degrees of freedom
    out = out.when(df / (df + a * a) >= 1, 1.0)
    for edge, p in ((4.417, 0.0001), (3.291, 0.001), (2.576, 0.01), (1.960, 0.05), (1.645, 0.10)):
        out = out.when(a > edge, p)
    return out.otherwise(0.5)


def stars(p: Column) -> Column:
    return F.when(p <= 0.001, "***").when(p <= 0.01, "**").when(p <= 0.05, "*").otherwise("ns")


def _finite(*cols: str) -> Column:
    return F.forall(F.array(*(F.col(c).cast("double") for c in cols)), lambda v: v.isNotNull() & ~F.isnan(v))


def describe(df: DataFrame, keys: Sequence[str], metrics: Sequence[str], places: int | None = None) -> DataFrame:
    """Per metric: mean, sample sd, median, min, max, n of the non-null values. ``places``: to how many the values are rounded, for an exact mean."""
    long = df.select(*keys, *(F.col(m).cast("double").alias(m) for m in metrics)).unpivot(list(keys), list(metrics), "metric", "v").where(F.col("v").isNotNull() & ~F.isnan("v"))
    r = T.rounded
    plain = long.groupBy(*keys, "metric").agg(r(F.avg("v") if places is None else T.mean_of_places(F.col("v"), places)).alias("mean"), r(_zero(F.stddev_samp("v"))).alias("sd"), F.min("v").alias("min"), F.max("v").alias("max"), F.count("*").alias("n"))
    median = ranks.medians(long, [*keys, "metric"], "v").withColumn("median", r(F.col("median")))
    return ranks.join_on(plain, median, [*keys, "metric"]).select(*keys, "metric", "mean", "sd", "median", "min", "max", "n")


def confusion(df: DataFrame, keys: Sequence[str], gold: str, pred: str) -> DataFrame:
    """Counts of every (gold, predicted) pair that occurs."""
    return df.groupBy(*keys, F.col(gold).alias("gold"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))


def confusion_matrix(df: DataFrame, keys: Sequence[str], gold: str, pred: str, classes: Sequence[str] = CLASSES) -> DataFrame:
    """One row per gold class, a column per predicted class."""
    return df.groupBy(*keys, F.col(gold).alias("gold")).agg(*(F.count_if(F.col(pred) == c).alias(f"pred_{c}") for c in classes))


def precision_recall(df: DataFrame, keys: Sequence[str], gold: str, pred: str, classes: Sequence[str] = CLASSES) -> DataFrame:
    """Per class P, R, F1 (3 places) with macro-F1 over them and accuracy; 0 where undefined."""
    is_ = lambda c, k: F.col(c) == k
    agg = [F.count("*").alias("n"), F.count_if(F.col(gold) == F.col(pred)).alias("right")]
    for c in classes:
        agg += [F.count_if(is_(gold, c) & is_(pred, c)).alias(f"tp_{c}"), F.count_if(is_(gold, c)).alias(f"g_{c}"), F.count_if(is_(pred, c)).alias(f"p_{c}")]
    s = df.groupBy(*keys).agg(*agg)
    r = lambda x: T.rounded(_zero(x), 3)
    f1 = lambda c: _zero(F.try_divide(2.0 * F.col(f"tp_{c}"), F.col(f"g_{c}") + F.col(f"p_{c}")))
    cols = [c for k in classes for c in (r(F.try_divide(f"tp_{k}", f"p_{k}")).alias(f"p_{k}"), r(F.try_divide(f"tp_{k}", f"g_{k}")).alias(f"r_{k}"), r(f1(k)).alias(f"f1_{k}"))]
    return s.select(*keys, "n", *cols, r(sum((f1(c) for c in classes), F.lit(0.0)) / len(classes)).alias("macro_f1"), r(F.try_divide("right", "n")).alias("accuracy"))


def _value_counts(df: DataFrame, keys: Sequence[str], score: Column, positive: Column) -> DataFrame:
    return df.groupBy(*keys, score.alias("v")).agg(F.count_if(positive).alias("p"), F.count_if(~positive).alias("q"))


def _below(c: DataFrame, keys: Sequence[str], weights: Sequence[str], bounded: bool) -> DataFrame:
    """Value counts with the sums of ``weights`` over smaller values."""
    if not bounded:
        return ranks.positions(c, keys, "v", weights)
    w = Window.partitionBy(*keys).orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    return c.withColumns({f"before_{k}": F.coalesce(F.sum(k).over(w), F.lit(0)) for k in weights})


def roc_curve(df: DataFrame, keys: Sequence[str], score: str, positive: Column, bounded: bool = False) -> DataFrame:
    """Points of the ROC curve: for each distinct score the rates at or above it."""
    c = _value_counts(df.where(F.col(score).isNotNull()), keys, F.col(score), positive)
    total = c.groupBy(*keys).agg(F.sum("p").alias("np"), F.sum("q").alias("nq"))
    x = ranks.join_on(_below(c, keys, ["p", "q"], bounded), total, list(keys))
    rate = lambda k: _zero(F.try_divide(F.col(f"n{k}") - F.col(f"before_{k}"), f"n{k}"))
    return x.select(*keys, F.col("v").alias("threshold"), rate("q").alias("fpr"), rate("p").alias("tpr"))


def auc(df: DataFrame, keys: Sequence[str], score: str, positive: Column, bounded: bool = False) -> DataFrame:
    """Area under the ROC curve by ranks (ties count half); 0.5 if one side is empty."""
    c = _value_counts(df, keys, F.col(score), positive)
    x = _below(c, keys, ["q"], bounded).withColumn("win", F.col("p") * (F.col("before_q") + F.col("q") / 2.0))
    return x.groupBy(*keys).agg(F.sum("p").alias("n_pos"), F.sum("q").alias("n_neg"), F.sum("win").alias("w")).select(*keys, "n_pos", "n_neg", T.rounded(F.coalesce(F.try_divide("w", F.col("n_pos") * F.col("n_neg").cast("double")), F.lit(0.5))).alias("auc"))


def multiclass_auc(df: DataFrame, keys: Sequence[str], score: str, gold: str, bounded: bool = False) -> DataFrame:
    """One-versus-rest areas: the score for pos, its negative for neg, the negative of its size for neu; and their mean."""
    s = F.col(score)
    long = df.select(*keys, gold, F.explode(F.array(*(F.struct(F.lit(c).alias("class"), v.alias("s")) for c, v in zip(CLASSES, (s, -s, -F.abs(s)), strict=True)))).alias("x")).select(*keys, F.col("x.class").alias("class"), (F.col("x.s") + 0.0).alias("s"), (F.col(gold) == F.col("x.class")).alias("is"))
    a = auc(long, [*keys, "class"], "s", F.col("is"), bounded)
    return a.groupBy(*keys).agg(*(F.max(F.when(F.col("class") == c, F.col("auc"))).alias(f"auc_{c}") for c in CLASSES), T.rounded(F.avg("auc")).alias("macro_auc"))


def _with_p(m: DataFrame, keys: Sequence[str]) -> DataFrame:
    """r, p, stars and n from n, the covariance and the product of the standard deviations."""
    r = F.when((F.col("n") < 3) | ~(F.col("_dev") > 1e-15), 0.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide("_cov", "_dev"))))
    m = m.select(*keys, "n", r.alias("r"), (F.col("_dev") > 1e-15).alias("ok"))
    t = F.col("r") * F.sqrt(F.greatest(F.col("n") - 2, F.lit(0))) / F.sqrt(F.greatest(F.lit(1e-9), 1 - F.col("r") * F.col("r")))
    m = m.withColumn("p", F.when((F.col("n") < 3) | ~F.col("ok"), 1.0).otherwise(p_of_t(t, F.col("n") - 2)))
    return m.select(*keys, T.rounded(F.col("r")).alias("r"), "p", stars(F.col("p")).alias("sig"), "n")


def pearson(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """r, p, stars, n over rows where both are numbers; r = 0 and p = 1 below three rows or without variance."""
    rows = df.where(_finite(x, y)).select(*keys, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    m = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.covar_pop("x", "y").alias("_cov"), (F.sqrt(F.var_pop("x")) * F.sqrt(F.var_pop("y"))).alias("_dev"))
    return _with_p(m, keys)


def spearman(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Rank correlation with mean ranks of ties, and its p as in :func:`pearson`.

    Equal pairs are one row with its weight throughout; ranks have a known mean, so their moments are weighted sums.
    """
    ks = list(keys)
    pairs = materialize(df.where(_finite(x, y)).groupBy(*ks, (F.col(x).cast("double") + 0.0).alias("x"), (F.col(y).cast("double") + 0.0).alias("y")).agg(F.count("*").alias("w")), "pairs")
    total = pairs.groupBy(*ks).agg(F.sum("w").alias("n"))
    side = lambda v: ranks.mean_ranks(pairs.groupBy(*ks, v).agg(F.sum("w").alias("_n")), ks, v).select(*ks, v, F.col("rank").alias(f"rank_{v}"))
    ranked = ranks.join_on(ranks.join_on(ranks.join_on(pairs, side("x"), [*ks, "x"]), side("y"), [*ks, "y"]), total, ks)
    off = lambda v: F.col(f"rank_{v}") - (F.col("n") + 1) / 2.0
    mean = lambda c: F.sum(F.col("w") * c) / F.max("n")
    m = ranked.groupBy(*ks).agg(F.max("n").alias("n"), mean(off("x") * off("y")).alias("_cov"), (F.sqrt(mean(off("x") * off("x"))) * F.sqrt(mean(off("y") * off("y")))).alias("_dev"))
    return _with_p(m, ks).withColumnRenamed("r", "rho")


def effect_size(df: DataFrame, keys: Sequence[str], v: str, first: Column) -> DataFrame:
    """Cohen's d and Hedges' g of the rows where ``first`` holds against the others; 0 below two rows or without variance."""
    a, b = F.when(first, F.col(v).cast("double")), F.when(~first, F.col(v).cast("double"))
    s = df.groupBy(*keys).agg(F.count(a).alias("n1"), F.count(b).alias("n2"), F.avg(a).alias("m1"), F.avg(b).alias("m2"), F.var_samp(a).alias("v1"), F.var_samp(b).alias("v2"))
    n1, n2 = F.col("n1"), F.col("n2")
    pooled = F.sqrt(F.try_divide((n1 - 1) * F.col("v1") + (n2 - 1) * F.col("v2"), n1 + n2 - 2))
    d = F.when((n1 < 2) | (n2 < 2), 0.0).otherwise(_zero(F.try_divide(F.col("m1") - F.col("m2"), pooled)))
    s = s.withColumn("d", d)
    g = F.col("d") * (1 - 3 / (4 * (n1 + n2) - 9))
    size = F.abs("d")
    return s.select(*keys, "n1", "n2", T.rounded(F.col("d")).alias("cohens_d"), T.rounded(g).alias("hedges_g"), F.when(size >= 0.8, "large").when(size >= 0.5, "medium").when(size >= 0.2, "small").otherwise("negligible").alias("size"))


def wilcoxon(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Signed-rank test of paired values without zero differences: W, z, p; null below five pairs."""
    ks = list(keys)
    d = df.where(_finite(x, y)).select(*ks, (F.col(x).cast("double") - F.col(y).cast("double")).alias("d")).where("d <> 0").select(*ks, F.abs("d").alias("a"), (F.col("d") > 0).alias("up"))
    c = d.groupBy(*ks, "a").agg(F.count("*").alias("_n"), F.count_if("up").alias("up"))
    s = ranks.mean_ranks(c, ks, "a").groupBy(*ks).agg(F.sum("_n").cast("double").alias("n"), F.sum(F.col("rank") * F.col("up")).alias("plus"))
    n = F.col("n")
    s = s.withColumn("w", F.least("plus", n * (n + 1) / 2 - F.col("plus"))).withColumn("z", F.try_divide(F.abs(F.col("w") - n * (n + 1) / 4), F.sqrt(n * (n + 1) * (2 * n + 1) / 24)))
    few = n < 5
    p = F.when(few, 1.0).otherwise(p_of_t(F.col("z"), F.lit(1000)))
    return s.select(*ks, n.cast("long").alias("n"), F.when(~few, T.rounded(F.col("w"), 2)).alias("w"), F.when(~few, T.rounded(F.col("z"))).alias("z"), p.alias("p"))


def icc(df: DataFrame, keys: Sequence[str], item: str, rater: str, value: str) -> DataFrame:
    """ICC(2,1) of a complete item by rater table, within [-1, 1]; 0 below two items or raters."""
    v = df.select(*keys, F.col(item).alias("i"), F.col(rater).alias("j"), F.col(value).cast("double").alias("v"))
    rows = v.groupBy(*keys, "i").agg(F.avg("v").alias("m")).groupBy(*keys).agg(F.count("*").alias("n"), F.var_pop("m").alias("vr"))
    cols = v.groupBy(*keys, "j").agg(F.avg("v").alias("m")).groupBy(*keys).agg(F.count("*").alias("k"), F.var_pop("m").alias("vc"))
    total = v.groupBy(*keys).agg(F.var_pop("v").alias("vt"))
    x = rows.join(cols, list(keys)).join(total, list(keys)) if keys else rows.crossJoin(cols).crossJoin(total)  # one row each
    n, k = F.col("n").cast("double"), F.col("k").cast("double")
    ss_r, ss_c = k * n * F.col("vr"), n * k * F.col("vc")
    ms_r, ms_c = ss_r / F.greatest(F.lit(1.0), n - 1), ss_c / F.greatest(F.lit(1.0), k - 1)
    ms_e = (n * k * F.col("vt") - ss_r - ss_c) / F.greatest(F.lit(1.0), (n - 1) * (k - 1))
    value_ = F.try_divide(ms_r - ms_e, ms_r + (k - 1) * ms_e + k * (ms_c - ms_e) / n)
    return x.select(*keys, "n", "k", F.when((n < 2) | (k < 2), 0.0).otherwise(T.rounded(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), _zero(value_))))).alias("icc"))


def cohen_kappa(df: DataFrame, keys: Sequence[str], a: str, b: str) -> DataFrame:
    """Agreement of two label columns against that of their marginals."""
    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    both = rows.select(*keys, F.explode(F.array(F.struct(F.col(a).alias("l"), F.lit(1).alias("x"), F.lit(0).alias("y")), F.struct(F.col(b).alias("l"), F.lit(0).alias("x"), F.lit(1).alias("y")))).alias("t"))
    marg = both.groupBy(*keys, "t.l").agg(F.sum("t.x").alias("x"), F.sum("t.y").alias("y")).groupBy(*keys).agg(F.sum(F.col("x").cast("double") * F.col("y")).alias("e"))
    obs = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(F.col(a) == F.col(b)).alias("o"))
    x = obs.join(marg, list(keys)) if keys else obs.crossJoin(marg)  # one row each
    po, pe = F.col("o") / F.col("n"), F.col("e") / (F.col("n").cast("double") * F.col("n"))
    return x.select(*keys, "n", T.rounded(po).alias("accuracy"), T.rounded(_zero(F.try_divide(po - pe, 1 - pe))).alias("kappa"))


def krippendorff(df: DataFrame, keys: Sequence[str], a: str, b: str, ordinal: bool = False) -> DataFrame:
    """Alpha of two raters; ordinal distances are squared differences of the values' ranks. Null below two pairs, 1 for one value."""
    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*keys, F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    pooled = rows.select(*keys, F.explode(F.array("a", "b")).alias("v"), "n").groupBy(*keys, "v").agg(F.sum("n").cast("double").alias("c"))
    # distinct labels are few; their list travels with each group
    lists = pooled.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("v", "c"))).alias("l"), F.sum("c").alias("t"))
    dist = (lambda i, j: (i - j) * (i - j)) if ordinal else (lambda i, j: (i != j).cast("int"))
    expected = F.aggregate(F.transform("l", lambda p, i: F.aggregate(F.transform("l", lambda q, j: p["c"] * q["c"] * dist(i, j)), F.lit(0.0), lambda s, x: s + x)), F.lit(0.0), lambda s, x: s + x)
    lists = lists.select(*keys, "l", "t", (expected / F.greatest(F.lit(1.0), F.col("t") * (F.col("t") - 1))).alias("de"))
    x = rows.join(lists, list(keys)) if keys else rows.crossJoin(lists)  # the list is one row
    place = lambda c: F.array_position(F.transform("l", lambda p: p["v"]), F.col(c))
    g = x.groupBy(*keys).agg(F.sum("n").alias("n"), (F.sum(F.col("n") * dist(place("a"), place("b"))) / F.sum("n")).alias("do"), F.first("de").alias("de"), F.first(F.size("l")).alias("k"))
    return g.select(*keys, "n", F.when(F.col("n") < 2, None).when((F.col("k") < 2) | (F.col("de") == 0), 1.0).otherwise(T.rounded(1 - F.try_divide("do", "de"))).alias("alpha"))


def fleiss_kappa(df: DataFrame, keys: Sequence[str], item: str, category: str) -> DataFrame:
    """From one row per rating: kappa and expected agreement; items with one rating agree not at all."""
    per = df.where(F.col(category).isNotNull()).groupBy(*keys, item, category).agg(F.count("*").alias("r"))
    items = per.groupBy(*keys, item).agg(F.sum("r").alias("n"), F.sum(F.col("r") * (F.col("r") - 1)).alias("s"))
    pbar = items.groupBy(*keys).agg(F.count("*").alias("items"), F.avg(_zero(F.try_divide(F.col("s").cast("double"), F.col("n") * (F.col("n") - 1)))).alias("pbar"), F.sum("n").alias("t"))
    cats = per.groupBy(*keys, category).agg(F.sum("r").alias("c")).groupBy(*keys).agg(F.sum(F.col("c").cast("double") * F.col("c")).alias("c2"))
    x = pbar.join(cats, list(keys)) if keys else pbar.crossJoin(cats)  # one row each
    pe = F.col("c2") / (F.col("t").cast("double") * F.col("t"))
    return x.select(*keys, "items", T.rounded(F.col("pbar")).alias("p_bar"), T.rounded(pe).alias("p_e"), T.rounded((F.col("pbar") - pe) / F.greatest(F.lit(1e-9), 1 - pe)).alias("kappa"))


def fleiss_by_category(df: DataFrame, keys: Sequence[str], item: str, category: str) -> DataFrame:
    """Kappa of each category as a yes-or-no rating, observed agreement over the yes side only."""
    per = df.where(F.col(category).isNotNull()).groupBy(*keys, item, F.col(category).alias("category")).agg(F.count("*").alias("r"))
    n_i = per.groupBy(*keys, item).agg(F.sum("r").alias("n"))
    whole = n_i.groupBy(*keys).agg(F.count("*").alias("items"), F.sum("n").alias("t"))
    po = F.sum(F.when(F.col("n") >= 2, F.col("r") / F.col("n") * (F.col("r") - 1) / (F.col("n") - 1)).otherwise(0.0))
    g = per.join(n_i, [*keys, item]).groupBy(*keys, "category").agg(F.sum("r").alias("c"), po.alias("po"))
    x = g.join(whole, list(keys)) if keys else g.crossJoin(whole)  # one row on the right
    p = F.col("c") / F.col("t")
    pe = p * p + (1 - p) * (1 - p)
    return x.select(*keys, "category", T.rounded(_zero(F.try_divide(F.col("po") / F.col("items") - pe, 1 - pe))).alias("kappa"))


def percent_agreement(df: DataFrame, keys: Sequence[str], item: str, category: str) -> DataFrame:
    """Share of items whose ratings are all equal."""
    per = df.groupBy(*keys, item).agg(F.min(category).alias("lo"), F.max(category).alias("hi"))
    return per.groupBy(*keys).agg(F.count("*").alias("items"), T.rounded(F.avg((F.col("lo") == F.col("hi")).cast("double"))).alias("agreement"))


def mcnemar(df: DataFrame, keys: Sequence[str], right_a: Column, right_b: Column) -> DataFrame:
    """Two systems on the same rows: discordant counts, chi-square with continuity correction and its p in steps (0 and 1 without a discordant row); null below 30 rows."""
    s = df.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(right_a & ~right_b).alias("b"), F.count_if(~right_a & right_b).alias("c"), T.rounded(F.avg(right_a.cast("double"))).alias("acc_a"), T.rounded(F.avg(right_b.cast("double"))).alias("acc_b"))
    chi = _zero(F.try_divide((F.abs(F.col("b") - F.col("c")) - 1) * (F.abs(F.col("b") - F.col("c")) - 1).cast("double"), F.col("b") + F.col("c")))
    s = s.withColumn("chi2", F.when(F.col("n") >= 30, T.rounded(chi, 3)))
    p = F.when(F.col("chi2").isNull(), None).when(F.col("b") + F.col("c") == 0, 1.0)
    for edge, v in ((10.83, 0.001), (6.63, 0.01), (3.84, 0.05), (2.71, 0.10)):
        p = p.when(F.col("chi2") > edge, v)
    return s.withColumn("p", p.otherwise(0.5))


def label_distribution(df: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """Count and percentage of each label."""
    g = df.groupBy(*keys, F.col(label).alias("label")).agg(F.count("*").alias("n"))
    return g.withColumn("pct", T.rounded(100 * F.col("n") / F.sum("n").over(Window.partitionBy(*keys)), 1))


#: Chances of a Poisson(1) number being at most 0, 1, 2 and so on, as thresholds of 64-bit hashes; beyond the last it is one more.
_POISSON = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253, 0.999998874797402, 0.9999998885745217]


def _draw_weights(h, draws: int, seed: int):
    """Poisson(1) weights of rows with hashes ``h`` in each resample: functions of hash, resample and seed only (a SplitMix64 step)."""
    import numpy as np

    x = h.astype(np.uint64)[:, None] + (np.arange(1, draws + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))[None, :]
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return np.searchsorted(np.array(_POISSON), ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / float(1 << 53), side="right")


def bootstrap_sums(df: DataFrame, keys: Sequence[str], sums: dict[str, Column], statistic: Column, draws: int = 500, ci: float = 0.95, seed: int = 11) -> DataFrame:
    """Percentile interval of any statistic of sums over rows: point, lo, hi, and n.

    ``sums`` names terms of a row (say s and ss for a value and its square), ``statistic`` is a Column over their sums and ``w``, the number of rows. A resample
    gives each row a Poisson(1) weight, a function of the row's own hash, the resample and the seed: so all resamples are weighted
    sums over one pass, partial sums merge over tasks, no task gets a group, and a lost task repeats the same draws. Equal
    rows draw alike unless an id sets them apart. Rows with a term that is no number are left out; so are resamples without a row or
    with an undefined statistic. One row has its point as both ends.
    """
    import numpy as np
    import pyarrow as pa

    names, ks = list(sums), list(keys)
    terms = df.withColumn("_h", F.xxhash64(*df.columns)).select(*ks, "_h", *(c.cast("double").alias(f"_{n}") for n, c in sums.items())).where(_finite(*(f"_{n}" for n in names)))
    group = F.struct(*(F.col(k) for k in ks)) if ks else F.struct(F.lit(0).alias("_all"))
    rows = terms.select(F.to_json(group, {"ignoreNullFields": "false"}).alias("g"), "_h", *(f"_{n}" for n in names))

    def weighted(batches):
        acc: dict[str, np.ndarray] = {}
        for b in batches:
            for first in range(0, b.num_rows, 2048):
                part = b.slice(first, 2048)
                gs, at = np.unique(np.array(part.column(0).to_pylist(), object), return_inverse=True)
                w = _draw_weights(part.column(1).to_numpy(zero_copy_only=False), draws, seed).astype(float)
                values = [np.ones(part.num_rows), *(part.column(2 + i).to_numpy(zero_copy_only=False) for i in range(len(names)))]
                for k, g in enumerate(gs.tolist()):
                    mine = at == k
                    got = acc.setdefault(g, np.zeros((len(values), draws)))
                    for i, v in enumerate(values):
                        got[i] += v[mine] @ w[mine]
            if len(acc) > 512:  # many groups: hand partial sums on
                yield batch(acc)
                acc = {}
        if acc:
            yield batch(acc)

    def batch(acc):
        return pa.RecordBatch.from_arrays([pa.array(list(acc)), *(pa.array([x[i].tolist() for x in acc.values()], pa.list_(pa.float64())) for i in range(len(names) + 1))], names=["g", "w", *names])

    parts = rows.mapInArrow(weighted, ", ".join(["g string", "w array<double>", *(f"{n} array<double>" for n in names)]))
    each = parts.select("g", F.posexplode(F.arrays_zip("w", *names)).alias("i", "x")).groupBy("g", "i").agg(*(F.sum(f"x.{n}").alias(n) for n in ("w", *names)))
    drawn = each.where("w > 0").select("g", statistic.cast("double").alias("v")).where(_finite("v")).groupBy("g").agg(F.sort_array(F.collect_list("v")).alias("m"))  # draws values
    at = lambda q: F.get("m", F.least(F.size("m") - 1, F.floor(F.lit(q) * F.size("m")).cast("int")))
    point = rows.groupBy("g").agg(F.count("*").cast("double").alias("w"), *(F.sum(f"_{n}").alias(n) for n in names)).select("g", F.col("w").cast("long").alias("n"), statistic.cast("double").alias("p"))
    out = point.join(drawn, "g", "left").withColumn("k", F.from_json("g", rows_schema(df, ks)))
    end = lambda q: F.when(F.col("n") == 1, F.col("p")).otherwise(T.rounded(at(q)))
    return out.select(*(F.col("k")[k].alias(k) for k in ks), "n", T.rounded(F.col("p")).alias("point"), end((1 - ci) / 2).alias("lo"), end((1 + ci) / 2).alias("hi"))


def rows_schema(df: DataFrame, keys: Sequence[str]) -> str:
    """Columns of a group key as a schema."""
    return ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys) or "_all int"


def bootstrap_mean(df: DataFrame, keys: Sequence[str], value: str, draws: int = 500, ci: float = 0.95, seed: int = 11) -> DataFrame:
    """Percentile interval of the mean: n, point, lo, hi. See :func:`bootstrap_sums`."""
    return bootstrap_sums(df, keys, {"s": F.col(value)}, F.col("s") / F.col("w"), draws, ci, seed)


def bootstrap(df: DataFrame, keys: Sequence[str], value: str, statistic, draws: int = 500, ci: float = 0.95, seed: int = 11) -> DataFrame:
    """As :func:`bootstrap_mean` for any ``statistic(numpy array) -> float``; a group must fit in a task."""
    import numpy as np
    import pandas as pd

    def one(group: pd.DataFrame) -> pd.DataFrame:
        v = np.sort(group[value].dropna().to_numpy(float))
        rng = np.random.default_rng(seed)
        got = sorted(statistic(rng.choice(v, len(v))) for _ in range(draws)) if len(v) > 1 else [statistic(v)] * draws
        return pd.DataFrame([[*(group[k].iloc[0] for k in keys), statistic(v), got[int((1 - ci) / 2 * draws)], got[int((1 + ci) / 2 * draws)]]], columns=[*keys, "point", "lo", "hi"])

    schema = ", ".join([*(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys), "point double", "lo double", "hi double"])
    return df.groupBy(*keys).applyInPandas(one, schema)
