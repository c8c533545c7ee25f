"""Corpus-level evaluation over the metric table: baselines, metric pairs, experiments, rollups, registries."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomline.functions import metrics as M
from loomline.functions import scoring as S
from loomline.functions import text as T
from loomline.operators import statistics as St
from loomline.scratch import materialize

SYSTEMS = {"main": "sentiment", "vader": "vader_score", "nrc": "nrc_score", "liwc": "liwc_score"}
SUMMARY = ["n_words", "flesch_re", "sentiment", "gase", "pti", "teg", "rci", "pai", "nava", "lewi_drop", "cd_index", "vads", "ties", "vader_score", "nrc_score"]
# The metric pairs tested with the direction expected, and the hypotheses registered with their thresholds.
PAIRS = [
    ("sentiment", "gase", "positive"),
    ("sentiment", "cd_index", "negative"),
    ("sentiment", "vads", "positive"),
    ("pti", "cd_index", "positive"),
    ("pti", "pai", "positive"),
    ("gase", "lewi_drop", "negative"),
    ("teg", "ties", "positive"),
    ("vads", "gase", "positive"),
    ("nava", "lewi_drop", "positive"),
    ("cd_index", "ties", "positive"),
]
HYPOTHESES = [
    ("H1", "lewi_drop", "LEWI correlates with human turning points", "r > 0.30"),
    ("H2", "pti", "higher PTI correlates with relational dominance", "r > 0.25, p < 0.05"),
    ("H3", "teg", "TEG correlates with emotional instability", "r > 0.20, p < 0.05"),
    ("H4", "gase", "GASE is lower in dissolution than in stable narratives", "d > 0.50, p < 0.05"),
    ("H5", "nava", "NAVA classifies the arc with more than half accuracy", "accuracy > 0.50"),
    ("H6", "cd_index", "CD-index correlates negatively with sentiment", "r < -0.15, p < 0.05"),
    ("H7", "sentiment", "the main system and the VADER-like one differ (McNemar)", "p < 0.05"),
]


#: Range and risk of every metric.
CATALOG = [
    ("sentiment", "mean of squashed sentence sums", -1.0, 1.0, "low"), ("gase", "0.30 S + 0.25 (1-H) + 0.25 (1-A) + 0.20 (1-G)", -1.0, 1.0, "high"), ("pti", "(I - You) / (I + You + We + 1)", -1.0, 1.0, "medium"),
    ("teg", "mean |step| of sentence scores", 0.0, 2.0, "medium"), ("rci", "mean pairwise Jaccard of segments", 0.0, 1.0, "low"), ("pai", "mean of control, imbalance, apology", 0.0, 1.0, "high"),
    ("nava", "first part less last part", -2.0, 2.0, "medium"), ("lewi_drop", "mean before less mean after the watershed", -2.0, 2.0, "medium"), ("cd_index", "mean capped distortion load", 0.0, 1.0, "high"),
    ("vads", "10 x weighted disclosure per word", 0.0, 1.0, "medium"), ("ties", "entropy x contradiction density", 0.0, None, "medium"), ("nspl", "layered composite", None, 1.0, "high"), ("ri", "rumination per thousand words", 0.0, None, "medium"),
]
CATALOG_COLUMNS = ["metric", "formula", "range_lo", "range_hi", "risk"]


def baselines(df: DataFrame, keys: Sequence[str], gold: str = "gold_sentiment") -> DataFrame:
    """Per system: macro-F1, accuracy, Pearson against gold as 1, 0, -1, and one-versus-rest areas."""
    # three statistics read the scores, which are made from the texts once
    scores = materialize(df.select(*keys, gold, *(F.col(c).cast("double").alias(s) for s, c in SYSTEMS.items())), "scores")
    long = scores.unpivot([*keys, gold], list(SYSTEMS), "system", "score")
    long = long.withColumns({"pred": T.label(F.col("score")), "number": F.when(F.col(gold) == "pos", 1.0).when(F.col(gold) == "neg", -1.0).otherwise(0.0)})
    ks = [*keys, "system"]
    f = St.precision_recall(long, ks, gold, "pred").select(*ks, "macro_f1", "accuracy")
    r = St.pearson(long, ks, "score", "number").select(*ks, F.col("r").alias("pearson_r"), F.col("p").alias("pearson_p"))
    return f.join(r, ks).join(St.multiclass_auc(long, ks, "score", gold, bounded=True), ks)


def system_agreement(df: DataFrame, keys: Sequence[str], gold: str = "gold_sentiment", main: str = "main") -> DataFrame:
    """Every system's labels against gold (macro-F1, accuracy) and against the main system's (kappa with pooled expected agreement)."""
    long = df.withColumn("_main", T.label(F.col(SYSTEMS[main]))).select(*keys, gold, "_main", *(F.col(c).cast("double").alias(s) for s, c in SYSTEMS.items())).unpivot([*keys, gold, "_main"], list(SYSTEMS), "system", "score")
    long = long.withColumn("pred", T.label(F.col("score")))
    ks = [*keys, "system"]
    f = St.precision_recall(long, ks, gold, "pred").select(*ks, "n", "macro_f1", "accuracy")
    share = lambda c, k: F.avg((F.col(c) == k).cast("double"))
    pe = sum((((share("pred", c) + share("_main", c)) / 2) * ((share("pred", c) + share("_main", c)) / 2) for c in St.CLASSES), F.lit(0.0))
    k = long.groupBy(*ks).agg(F.avg((F.col("pred") == F.col("_main")).cast("double")).alias("po"), pe.alias("pe"))
    return f.join(k, ks).select(*ks, "n", "macro_f1", "accuracy", T.rounded(F.coalesce(F.try_divide(F.col("po") - F.col("pe"), 1 - F.col("pe")), F.lit(0.0))).alias("kappa"))


def statistical_report(df: DataFrame, keys: Sequence[str], x: str, y: str, first) -> DataFrame:
    """Long table (test, name, value) of the paired and two-sample statistics of two columns."""
    p, s, w, e = St.pearson(df, keys, x, y), St.spearman(df, keys, x, y), St.wilcoxon(df, keys, x, y), St.effect_size(df, keys, x, first)
    rows = [(p, "pearson", ("r", "p", "n")), (s, "spearman", ("rho", "p")), (w, "wilcoxon", ("w", "z", "p")), (e, "effect", ("cohens_d", "hedges_g"))]
    parts = [d.select(*keys, F.lit(t).alias("test"), F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in cs))).alias("v")).select(*keys, "test", "v.name", "v.value") for d, t, cs in rows]
    return union_all(parts)


def metric_pairs(df: DataFrame, keys: Sequence[str], pairs=PAIRS, least: int = 5) -> DataFrame:
    """Pearson and Spearman of each pair on pairwise complete rows, and whether the direction is as expected."""
    x = df.select(*keys, F.explode(F.array(*(F.struct(F.lit(a).alias("metric_1"), F.lit(b).alias("metric_2"), F.lit(h).alias("hypothesis"), F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y")) for a, b, h in pairs))).alias("t"))
    ks = [*keys, "metric_1", "metric_2", "hypothesis"]
    long = x.select(*keys, "t.metric_1", "t.metric_2", "t.hypothesis", "t.x", "t.y")
    p = St.pearson(long, ks, "x", "y").select(*ks, F.col("r").alias("pearson_r"), F.col("p").alias("pearson_p"), F.col("sig").alias("pearson_sig"), "n")
    s = St.spearman(long, ks, "x", "y").select(*ks, F.col("rho").alias("spearman_rho"), F.col("p").alias("spearman_p"), F.col("sig").alias("spearman_sig"))
    right = F.when(F.col("hypothesis") == "positive", F.col("pearson_r") > 0).otherwise(F.col("pearson_r") < 0)
    return p.join(s, ks).where(F.col("n") >= least).withColumn("direction_correct", right)


def capped(df: DataFrame, keys: Sequence[str], order: str, most: int) -> DataFrame:
    """The first ``most`` rows of each key by a declared order."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where(F.col("_r") <= most).drop("_r")


def ablation_table(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    r = T.rounded
    z = lambda c: F.coalesce(c, F.lit(0.0))
    return df.groupBy(*keys).agg(
        F.count("*").alias("n"), r(T.mean_of_places(F.col("gase"))).alias("gase_mean"), r(z(F.stddev_samp("gase"))).alias("gase_sd"), r(z(T.mean_of_places(F.col("lewi_drop")))).alias("lewi_mean"), r(z(F.stddev_samp("lewi_drop"))).alias("lewi_sd"),
        r(100 * F.avg((F.abs("rci") > 0.001).cast("double")), 1).alias("rci_nonzero_pct"), F.count("nava").alias("nava_valid_n"),
    )


def experiment(df: DataFrame, keys: Sequence[str], x: str, y: str, floor: float, least: int = 10, all_keys: bool = False) -> DataFrame:
    """One correlation experiment: mean of ``x``, r, p, stars, n, and whether r exceeds ``floor`` at p below 0.05 (p is stepped, so 0.05 itself does not do).

    Keys with fewer than ``least`` complete rows are left out, or, with ``all_keys``, have r 0 and p 1.
    """
    mean = df.where(F.col(y).isNotNull()).groupBy(*keys).agg(T.rounded(T.mean_of_places(F.col(x))).alias(f"{x}_mean"))
    p = St.pearson(df, keys, x, y).join(mean, list(keys), "left")
    enough = F.col("n") >= least
    if all_keys:
        p = df.select(*keys).distinct().join(p, list(keys), "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
        p = p.withColumns({"r": F.when(enough, F.col("r")).otherwise(0.0), "p": F.when(enough, F.col("p")).otherwise(1.0), "sig": F.when(enough, F.col("sig")).otherwise("ns")})
    else:
        p = p.where(enough)
    return p.withColumn("supported", (F.col("r") > floor) & (F.col("p") < 0.05))


def drop_validation(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Of every key: spread of the drop (sample sd over all values), and the drop against the arc where both exist; supported above r 0.30."""
    sd = df.groupBy(*keys).agg(T.rounded(F.coalesce(F.stddev_samp("lewi_drop"), F.lit(0.0))).alias("lewi_sd"))
    return experiment(df, keys, "nava", "lewi_drop", 0.30, all_keys=True).drop("nava_mean").join(sd, list(keys))


def systems_differ(df: DataFrame, keys: Sequence[str], gold: str = "gold_sentiment", least: int = 30) -> DataFrame:
    """McNemar of the main and the VADER-like system over rows with a gold class, for keys with ``least`` rows: and whether they differ at p below 0.05."""
    known = df.where(F.col(gold).isin(*St.CLASSES))
    right = lambda c: T.label(F.coalesce(F.col(c), F.lit(0.0))) == F.col(gold)
    out = St.mcnemar(known, keys, right(SYSTEMS["main"]), right(SYSTEMS["vader"])).where(F.col("n") >= least)
    return out.withColumns({"sig": St.stars(F.col("p")), "supported": F.col("p") < 0.05})


def hypothesis_results(df: DataFrame, keys: Sequence[str], gold: str = "gold_sentiment") -> DataFrame:
    """The registered hypotheses that metric rows can decide, per key: id, statistic, p, n, supported. The others need annotations (H1 in full, H5) or two corpora (H4)."""
    ks, wide = list(keys), F.col("teg") > 0
    low = St.pearson(df, ks, "cd_index", "sentiment").where("n >= 10").withColumn("supported", (F.col("r") < -0.15) & (F.col("p") < 0.05))
    parts = {"H1": drop_validation(df, ks), "H2": experiment(df, ks, "pti", "pai", 0.25), "H3": experiment(df.where(wide), ks, "teg", "ties", 0.20), "H6": low}
    rows = [d.select(*ks, F.lit(h).alias("id"), F.col("r").alias("statistic"), "p", "n", "supported") for h, d in parts.items()]
    h7 = systems_differ(df, ks, gold).select(*ks, F.lit("H7").alias("id"), F.col("chi2").alias("statistic"), "p", "n", "supported")
    return union_all([*rows, h7])


def dataset_summary(df: DataFrame, keys: Sequence[str], gold: str = "gold_sentiment") -> DataFrame:
    """One row a dataset: n, F1, area and r of the main system, F1 of the VADER-like one, pairs in the expected direction and tested, effect size of positive against negative."""
    ks = list(keys)
    b = baselines(df, ks, gold)
    one = lambda s, c: F.max(F.when(F.col("system") == s, F.col(c)))
    scores = b.groupBy(*ks).agg(one("main", "macro_f1").alias("main_f1"), one("main", "macro_auc").alias("main_auc"), one("main", "pearson_r").alias("main_r"), one("vader", "macro_f1").alias("vader_f1"))
    pairs = metric_pairs(df, ks).groupBy(*ks).agg(F.count_if("direction_correct").alias("directions_right"), F.count("*").alias("directions"))
    d = St.effect_size(df.where(F.col(gold).isin("pos", "neg")), ks, "sentiment", F.col(gold) == "pos").select(*ks, "cohens_d", "hedges_g", F.when(F.abs("cohens_d") >= 0.8, "Large").when(F.abs("cohens_d") >= 0.5, "Medium").otherwise("Small").alias("effect_size"))
    n = df.groupBy(*ks).agg(F.count("*").alias("n"))
    return n.join(scores, ks).join(pairs, ks, "left").join(d, ks, "left").na.fill(0, ["directions_right", "directions", "cohens_d", "hedges_g"]).na.fill("Small", ["effect_size"])


def rollup(per_dataset: DataFrame, key: str, metrics: Sequence[str]) -> DataFrame:
    """The rows of each dataset and one of their unweighted means."""
    total = per_dataset.agg(*(T.rounded(T.mean_of_places(F.col(m)), 3).alias(m) for m in metrics)).select(F.lit("mean").alias(key), *metrics)
    return per_dataset.select(key, *(T.rounded(F.col(m), 3).alias(m) for m in metrics)).unionByName(total)


def domain_profile(df: DataFrame, keys: Sequence[str], order: str, metrics: Sequence[str], most: int = 30) -> DataFrame:
    return St.describe(capped(df, keys, order, most), keys, metrics, 4).drop("median")


def correlation_matrix(df: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Pearson r (3 places) of every pair of metrics, both ways and with itself."""
    cells = [F.struct(F.lit(a).alias("row"), F.lit(b).alias("col"), F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y")) for a in metrics for b in metrics]
    long = df.select(*keys, F.explode(F.array(*cells)).alias("t")).select(*keys, F.col("t.row").alias("row"), F.col("t.col").alias("col"), "t.x", "t.y")
    m = long.groupBy(*keys, "row", "col").agg(F.covar_pop("x", "y").alias("c"), (F.sqrt(F.var_pop("x")) * F.sqrt(F.var_pop("y"))).alias("d"))
    return m.select(*keys, "row", "col", F.when(F.col("d") > 1e-15, T.rounded(F.try_divide("c", "d"), 3)).otherwise(0.0).alias("r"))


def construct_validity(df: DataFrame, keys: Sequence[str], text_col: str = "text") -> DataFrame:
    """Each metric against its word-list proxy: r, p and whether the direction is positive as expected."""
    from loomline.functions import fixed

    names = {"cds": "cd_index"}
    # the proxies of a text come from one array of its tokens, and the metric rows are made once
    proxies = T.bound(T.tokens(F.col(text_col)), lambda t: F.struct(*(M.proxy(t, m).alias(m) for m in fixed.CONSTRUCT_PROXIES)))
    rows = materialize(df.select(*keys, F.struct(*(F.col(names.get(m, m)).cast("double").alias(m) for m in fixed.CONSTRUCT_PROXIES)).alias("_x"), proxies.alias("_y")), "proxies")
    long = rows.select(*keys, F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col("_x")[m].alias("x"), F.col("_y")[m].alias("y")) for m in fixed.CONSTRUCT_PROXIES))).alias("t"))
    out = St.pearson(long.select(*keys, "t.metric", "t.x", "t.y"), [*keys, "metric"], "x", "y")
    return out.withColumn("hit", F.col("r") > 0)


def compare(df: DataFrame, id_col: str, left: str, right: str, metrics: Sequence[str]) -> DataFrame:
    """Two documents side by side; the winner has the larger value, the second on ties."""
    long = df.where(F.col(id_col).isin(left, right)).select(id_col, *(F.col(m).cast("double").alias(m) for m in metrics)).unpivot([id_col], list(metrics), "metric", "v")
    side = lambda k: F.max(F.when(F.col(id_col) == k, F.col("v")))
    return long.groupBy("metric").agg(side(left).alias("first"), side(right).alias("second")).withColumn("winner", F.when(F.col("first") > F.col("second"), "first").otherwise("second"))


def ranking(df: DataFrame, id_col: str, metric: str = "gase") -> DataFrame:
    """Documents by a metric, best first, ties by id. The sort is by range, without a rank column over one partition."""
    return df.select(id_col, "n_words", "sentiment", metric, "pti").orderBy(F.desc(metric), id_col)


def validation_suite(df: DataFrame, predicates: dict[str, str]) -> DataFrame:
    """Share of rows for which each named SQL predicate over the metric row holds."""
    long = df.select(F.explode(F.array(*(F.struct(F.lit(k).alias("name"), F.coalesce(F.expr(e), F.lit(False)).alias("ok")) for k, e in predicates.items()))).alias("t"))
    return long.groupBy("t.name").agg(F.count("*").alias("n"), F.count_if("t.ok").alias("passed"), T.rounded(F.avg(F.col("t.ok").cast("double"))).alias("rate"))


def hypothesis_registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(HYPOTHESES, "id string, metric string, claim string, threshold string")


def metric_catalog(spark: SparkSession) -> DataFrame:
    """Range and risk of every metric. All are linguistic indicators, not diagnoses."""
    return spark.createDataFrame(CATALOG, "metric string, formula string, range_lo double, range_hi double, risk string")


def banded(df: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Add ``<metric>_band`` for metrics with presentation bands; null stays null."""
    return df.withColumns({f"{m}_band": F.when(F.col(m).isNotNull(), S.band(F.col(m), *M.BANDS[m])) for m in metrics})


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
