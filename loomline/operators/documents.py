"""Per-document operators: annotation once, then any metric as a projection of it."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from loomline.functions import fixed
from loomline.functions import metrics as M
from loomline.functions import scoring as S
from loomline.functions import text as T
from loomline.functions.lexicon import Lexicon

EMOTIONS = ("anger", "sadness", "fear", "joy", "trust", "disgust", "surprise", "anticipation")
PARAGRAPH_METRICS = ["sentiment", "pti", "teg", "cd_index", "vads", "ties"]
HORSEMEN = ("criticism", "contempt", "defensiveness", "stonewalling")


def annotate(df: DataFrame, lex: Lexicon | None = None, text_col: str = "text") -> DataFrame:
    """Add low, toks, sents, paras and, with a lexicon, scored, compounds, emotions, horsemen, n_sarcasm.

    Each is computed once a row; Catalyst drops those that nothing reads. A null text counts as empty.
    """
    c = F.coalesce(F.col(text_col), F.lit(""))
    out = df.withColumn(text_col, c).withColumns({"low": F.lower(c), "toks": T.tokens(c), "sents": T.sentences(c), "paras": T.paragraphs(c)})
    if lex is not None:
        out = out.withColumn("scored", S.score_sentences(F.col("sents"), lex))
        out = out.withColumns({"compounds": F.col("scored.compound"), "emotions": F.flatten("scored.emotions"), "horsemen": F.flatten("scored.horsemen"), "n_sarcasm": F.size(F.filter("scored.sarcasm", lambda x: x))})
    return out


@F.pandas_udf(DoubleType())
def mean_jaccard(sets: pd.Series) -> pd.Series:
    """Mean Jaccard over all pairs of a document's sets, from the pairs that share an element only."""

    def one(groups) -> float:
        n = len(groups)
        if n < 2:
            return 0.0
        sizes, seen, total = [len(g) for g in groups], {}, 0.0
        for i, g in enumerate(groups):
            shared: dict[int, int] = {}
            for t in g:
                for j in seen.setdefault(t, []):
                    shared[j] = shared.get(j, 0) + 1
                seen[t].append(i)
            for j in sorted(shared):
                total += shared[j] / (sizes[i] + sizes[j] - shared[j])
        return total / (n * (n - 1) // 2)

    return sets.map(one)


# a filter on the result stays above it and does not run it a second time
mean_jaccard = mean_jaccard.asNondeterministic()


def content_sets(segments):
    return F.transform(segments, lambda s: F.array_distinct(T.content_words(T.tokens(s))))


def doc_stats(df: DataFrame, lex: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, readability, richness, coverage and the confidence badge of every document."""
    a = annotate(df.select(id_col, text_col), None, text_col)
    s = M.stats(F.col(text_col), F.col("toks"), F.col("sents"), F.col("paras"), [e.term for e in lex.words])
    return a.select(id_col, *(v.alias(k) for k, v in s.items())).withColumn("confidence", M.confidence(F.col("n_words"), F.col("coverage")))


def has_text(c):
    """Whether a document has a metric row."""
    return T.strip(F.coalesce(c, F.lit(""))) != ""


def doc_metrics(df: DataFrame, lex: Lexicon, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """The wide metric row of every document with some text; ``keep`` columns pass through."""
    base = df.select(id_col, *keep, text_col).where(has_text(F.col(text_col))).withColumn(text_col, T.strip(F.col(text_col)))
    a = annotate(base, lex, text_col).withColumn("segments", M.rci_segments(F.col(text_col), F.col("sents")))
    c, toks, low, sents = F.col(text_col), F.col("toks"), F.col("low"), F.col("sents")
    n_sents = F.greatest(F.lit(1), F.size(sents))
    s = M.stats(c, toks, sents, F.col("paras"), [])
    styles = M.attachment(low)
    a = a.withColumns({
        "gase": M.gase(F.col("compounds"), F.col("emotions"), F.col("horsemen"), toks, n_sents)["gase"], "nava": M.nava(F.col("compounds")), "lewi": M.lewi(F.col("compounds")),
        "nrc": S.nrc_like(c), "liwc": S.liwc_like(c), "rci": T.rounded(mean_jaccard(content_sets(F.col("segments")))), "hits": M.counted(low),
    })
    hits = F.col("hits")
    tag = lambda col, k: F.size(F.filter(col, lambda x: x == k))
    return a.select(
        id_col, *keep, s["n_words"].alias("n_words"), s["n_sents"].alias("n_sents"), s["flesch_re"].alias("flesch_re"), T.rounded(S.mean_of_rounded(F.col("compounds"))).alias("sentiment"),
        "gase", M.pti(toks).alias("pti"), M.teg(F.col("compounds")).alias("teg"), "rci", M.pai(low, toks).alias("pai"), "nava", M.nava_arc(F.col("nava")).alias("nava_arc"),
        F.col("lewi.idx").alias("lewi_idx"), F.col("lewi.drop").alias("lewi_drop"), M.cd_index(low, toks, hits).alias("cd_index"), M.vads(low, toks, hits).alias("vads"), M.ties(low, sents, hits).alias("ties"),
        T.first_largest(list(styles.items())).alias("attachment"), F.size("horsemen").alias("horsemen_total"), *(tag("horsemen", h).alias(h) for h in HORSEMEN),
        S.vader_like(c).alias("vader_score"), F.col("nrc.compound").alias("nrc_score"), F.col("liwc.compound").alias("liwc_score"), *(tag("emotions", e).alias(f"emo_{e}") for e in EMOTIONS),
    )


def paragraph_metrics(df: DataFrame, lex: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The six metrics of paragraphs taken as texts: sentiment, pti, teg, cd_index, vads, ties. One row a row of ``df``."""
    a = annotate(df.select(id_col, text_col), lex, text_col)
    toks, low = F.col("toks"), F.col("low")
    return a.select(id_col, T.rounded(S.mean_of_rounded(F.col("compounds"))).alias("sentiment"), M.pti(toks).alias("pti"), M.teg(F.col("compounds")).alias("teg"), M.cd_index(low, toks).alias("cd_index"), M.vads(low, toks).alias("vads"), M.ties(low, F.col("sents")).alias("ties"))


def sentence_scores(df: DataFrame, lex: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per sentence: sent_ix (from 0), sentence, compound, sarcasm, emotions, horsemen."""
    a = annotate(df.select(id_col, text_col), lex, text_col)
    x = a.select(id_col, F.posexplode(F.arrays_zip("sents", "scored")).alias("sent_ix", "x"))
    return x.select(id_col, "sent_ix", F.col("x.sents").alias("sentence"), "x.scored.compound", "x.scored.sarcasm", "x.scored.emotions", "x.scored.horsemen")


def score_text(df: DataFrame, lex: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: mean of the rounded compounds, band, emotion totals (map), sarcastic sentences, behaviours (map)."""
    a = annotate(df.select(id_col, text_col), lex, text_col)
    totals = lambda col: F.map_from_entries(F.transform(F.array_distinct(col), lambda v: F.struct(v, F.size(F.filter(col, lambda x: x == v)))))
    out = a.select(id_col, S.mean_of_rounded(F.col("compounds")).alias("mean"), totals("emotions").alias("emotion_totals"), "n_sarcasm", totals("horsemen").alias("horsemen"), F.size("sents").alias("n_sents"))
    return out.withColumn("band", S.band(F.col("mean"), *M.BANDS["sentiment"]))


def paragraph_timeline(df: DataFrame, lex: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Whole paragraphs scored as one sentence each, and the mean absolute step between them."""
    a = annotate(df.select(id_col, text_col), None, text_col).withColumn("c", S.score_sentences(F.col("paras"), lex)["compound"])
    return a.select(id_col, F.size("paras").alias("n_paras"), F.col("c").alias("compounds"), M.teg(F.col("c")).alias("teg"))


def sentence_lengths(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Words between blanks of every sentence: mean, sample sd, longest and shortest (first of equal ones), buckets."""
    a = annotate(df.select(id_col, text_col), None, text_col)
    s = a.select(id_col, F.posexplode("sents").alias("ix", "s")).withColumn("n", T.blank_words(F.col("s")))
    between = lambda lo, hi: F.count_if(F.col("n").between(lo, hi))
    return s.groupBy(id_col).agg(
        F.avg("n").alias("mean_len"), F.coalesce(F.stddev_samp("n"), F.lit(0.0)).alias("sd_len"), F.max_by("ix", F.struct("n", -F.col("ix"))).alias("longest_ix"), F.min_by("ix", F.struct("n", "ix")).alias("shortest_ix"),
        F.max("n").alias("longest"), F.min("n").alias("shortest"), between(0, 5).alias("b_5"), between(6, 10).alias("b_10"), between(11, 20).alias("b_20"), between(21, 30).alias("b_30"), F.count_if(F.col("n") > 30).alias("b_more"),
    )


def extracts(df: DataFrame, lex: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every extractor's scalar results in one row per document."""
    a = annotate(df.select(id_col, text_col), lex, text_col)
    c, toks, low, sents, paras = F.col(text_col), F.col("toks"), F.col("low"), F.col("sents"), F.col("paras")
    styles, total = M.attachment(low), sum(M.attachment(low).values(), F.lit(0))
    a = a.withColumn("found", M.extractor_counts(low))
    found = M.counts_by_pattern(F.col("found"))
    got, blame, power, flags, rum = M.gottman(low, F.col("horsemen"), F.size(sents), found), M.blame(sents), M.power(low, toks), M.red_flags(low, found), M.rumination(low, toks, paras, found)
    name = lambda k: k.lower().replace(" & ", "_").replace(" ", "_")
    exits = {k: T.n_contained(low, ms) for k, ms in fixed.EXIT_SIGNALS.items()}
    a = a.withColumns({"tense": M.tense(paras), "gone": M.dissolution(paras)})
    first = F.when((F.col("tense.past") >= F.col("tense.present")) & (F.col("tense.past") >= F.col("tense.future")), "past").when(F.col("tense.present") >= F.col("tense.future"), "present").otherwise("future")
    return a.select(
        id_col, *(v.alias(f"att_{k}") for k, v in styles.items()), T.rounded(styles["anxious"] / F.greatest(F.lit(1), total) * 100, 1).alias("att_anxious_pct"), T.first_largest(list(styles.items())).alias("attachment"),
        *(got[h].alias(h) for h in HORSEMEN), got["load"].alias("gottman_load"), F.col("gone.phase").alias("phase"), F.col("gone.para").alias("phase_para"),
        blame["self"].alias("blame_self"), blame["other"].alias("blame_other"), blame["self_pct"].alias("blame_self_pct"), *(v.alias(f"exit_{name(k)}") for k, v in exits.items()), sum(exits.values(), F.lit(0)).alias("exit_total"),
        power["control"].alias("control"), power["sacrifice"].alias("sacrifice"), power["initiation"].alias("initiation"), power["apology"].alias("apology"),
        *(T.occurrences(low, r).alias(f"role_{r}") for r in fixed.ROLES), F.size(M.dates_of(c)).alias("n_dates"), F.col("tense.past").alias("past"), F.col("tense.present").alias("present"), F.col("tense.future").alias("future"), first.alias("tense"),
        *(v.alias(f"flag_{name(k)}") for k, v in flags.items()), rum["ri"].alias("ri"), rum["hits"].alias("rumination"), rum["repeats"].alias("repeats"), F.array_join(M.rules_fired(low, found).cast("array<string>"), ",").alias("rules"), M.coherence(sents).alias("coherence"),
    )


def snippets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", around: int = 20, most: int = 3) -> DataFrame:
    """Per document and red-flag category the first matches (by pattern, then place) with ``around`` characters on each side."""
    import re

    flags = {k: [re.compile(p) for p in ps] for k, ps in fixed.RED_FLAGS.items()}

    @F.pandas_udf("array<struct<category:string,snippets:array<string>>>")
    def find(texts: pd.Series) -> pd.Series:
        def one(t):
            low, out = (t or "").lower(), []
            for k, ps in flags.items():
                hits = [low[max(0, m.start() - around) : m.end() + around].strip() for p in ps for m in p.finditer(low)][:most]
                if hits:
                    out.append({"category": k, "snippets": hits})
            return out

        return texts.map(one)

    return df.select(id_col, F.explode(find(text_col)).alias("x")).select(id_col, "x.category", "x.snippets")


def word_migration(df: DataFrame, lex: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document and key word found in both halves: mean compounds of its sentences there, and their difference."""
    a = annotate(df.select(id_col, text_col), lex, text_col)
    half = F.greatest(F.lit(1), F.floor(F.size("sents") / 2).cast("int"))
    rows = a.select(id_col, half.alias("half"), F.posexplode(F.arrays_zip("sents", "compounds")).alias("ix", "x"))
    found = rows.select(id_col, (F.col("ix") < F.col("half")).alias("early"), F.col("x.compounds").alias("v"), F.explode(F.array_compact(F.array(*(F.when(F.col("x.sents").rlike(rf"(?iu)\b{w}\b"), F.lit(w)) for w in fixed.KEY_RELATIONSHIP_WORDS)))).alias("word"))
    part = lambda early: F.try_divide(F.sum(F.when(F.col("early") == early, F.round(F.col("v") * 10000).cast("long"))).cast("double"), F.count_if(F.col("early") == early)) / 10000.0
    g = found.groupBy(id_col, "word").agg(part(True).alias("m1"), part(False).alias("m2"), F.count_if("early").alias("c1"), F.count_if(~F.col("early")).alias("c2"))
    return g.where("m1 is not null and m2 is not null").select(id_col, "word", T.rounded(F.col("m1")).alias("first_mean"), T.rounded(F.col("m2")).alias("second_mean"), T.rounded(F.col("m2") - F.col("m1")).alias("delta"), "c1", "c2")


def phase_table(df: DataFrame, markers: dict[str, list[str]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document, phase (or theme) and paragraph with a marker: the number of markers contained."""
    a = annotate(df.select(id_col, text_col), None, text_col)
    hits = M.phase_hits(F.col("paras"), markers)
    long = a.select(id_col, F.explode(F.array(*(F.struct(F.lit(k).alias("phase"), v.alias("hits")) for k, v in hits.items()))).alias("x"))
    return long.select(id_col, "x.phase", F.explode("x.hits").alias("h")).select(id_col, "phase", "h.para", F.size("h.markers").alias("n_markers"))


def naive_bayes(df: DataFrame, lex: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Multinomial naive Bayes trained on a lexicon's single words (Laplace 1): label and probabilities.

    A word counts max(1, int |s|) for its side; a token outside the lexicon has the chance of a count of 0 under each class.
    """
    import math

    classes, counts = ("positive", "negative", "neutral"), {}
    for e in lex.words:
        c = "positive" if e.s > 0.5 else "negative" if e.s < -0.5 else "neutral"
        counts[e.term] = (c, max(1, int(abs(e.s))) if c != "neutral" else 1)
    totals = {c: sum(n for k, n in counts.values() if k == c) for c in classes}
    size, n_docs = len(counts), sum(totals.values())
    toks = F.filter(T.tokens(F.coalesce(F.col(text_col), F.lit(""))), lambda t: ~T.is_stop(t))
    a = df.select(id_col, toks.alias("t")).select(id_col, F.size("t").alias("n"), F.filter("t", lambda t: t.isin(list(counts))).alias("hit"))

    def score(c: str):
        # all tokens as unseen, then what the seen ones of this class add
        unseen, own = math.log(1 / (totals[c] + size)), [(w, n) for w, (k, n) in counts.items() if k == c]
        gain = F.create_map(*(x for w, n in own for x in (F.lit(w), F.lit(math.log(n + 1))))) if own else None
        more = F.aggregate("hit", F.lit(0.0), lambda s, t: s + F.coalesce(F.try_element_at(gain, t), F.lit(0.0))) if own else F.lit(0.0)
        return math.log(max(1, totals[c]) / max(1, n_docs)) + F.col("n") * unseen + more

    s = a.select(id_col, *(score(c).alias(c) for c in classes)).withColumn("top", F.greatest(*classes))
    e = s.select(id_col, *(F.exp(F.col(c) - F.col("top")).alias(c) for c in classes)).withColumn("z", sum((F.col(c) for c in classes), F.lit(0.0)))
    p = e.select(id_col, *(T.rounded(F.col(c) / F.col("z")).alias(f"p_{c}") for c in classes))
    return p.withColumn("label", T.first_largest([(c, F.col(f"p_{c}")) for c in classes]))


def nspl(df: DataFrame, lex: Lexicon, id_col: str = "doc_id", text_col: str = "text", most: int = 20) -> DataFrame:
    """Layered score of GASE, semantic coherence of the first ``most`` sentences (LSA), gradient and pronouns; 0 below two sentences."""
    import numpy as np

    stop = set(fixed.STOP_WORDS)

    @F.pandas_udf("double")
    def coherence(bags: pd.Series) -> pd.Series:
        def one(docs) -> float:
            n = len(docs)
            if n < 2:
                return 0.0
            df_, first = {}, {}
            for d in docs:
                for t in dict.fromkeys(d):
                    if t not in stop and len(t) > 2:
                        df_[t] = df_.get(t, 0) + 1
                        first.setdefault(t, len(first))
            vocab = sorted(df_, key=lambda t: (-df_[t], t))[:500]
            at = {t: k for k, t in enumerate(vocab)}
            m = np.zeros((n, max(1, len(vocab))))
            for i, d in enumerate(docs):
                for t in d:
                    if t in at:
                        m[i, at[t]] += np.log(n / df_[t]) / max(1, len(d))
            if n >= 3:
                u, s, _ = np.linalg.svd(m, full_matrices=False)
                k = min(5, n - 1, len(s))
                m = u[:, :k] * s[:k]
            norm = np.linalg.norm(m, axis=1)
            with np.errstate(divide="ignore", invalid="ignore"):
                sim = np.where(np.outer(norm, norm) > 0, m @ m.T / np.outer(norm, norm), 0.0)
            sim = np.round(sim, 4)
            return float(np.round((sim.sum() - np.trace(sim)) / (n * (n - 1)), 4))

        return bags.map(one)

    a = annotate(df.select(id_col, text_col), lex, text_col)
    bags = F.transform(F.slice("sents", 1, most), T.tokens)
    a = a.select(id_col, F.size("sents").alias("n"), coherence(bags).alias("sem_coh"), M.gase(F.col("compounds"), F.col("emotions"), F.col("horsemen"), F.col("toks"), F.size("sents"))["gase"].alias("gase"), M.pti(F.col("toks")).alias("pti"), M.teg(F.col("compounds")).alias("teg"))
    value = 0.35 * (F.col("gase") + 1) / 2 + 0.30 * F.greatest(F.lit(0.0), F.col("sem_coh")) + 0.20 * (1 - F.least(F.lit(1.0), F.abs("teg"))) + 0.15 * (1 - F.abs("pti"))
    return a.select(id_col, "sem_coh", F.when(F.col("n") >= 2, T.rounded(value)).otherwise(0.0).alias("nspl"))


def ablation(df: DataFrame, lex: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The composite, the contribution of each part, and the composite without it (entropy term included as intended)."""
    a = annotate(df.select(id_col, text_col), lex, text_col)
    g = M.gase(F.col("compounds"), F.col("emotions"), F.col("horsemen"), F.col("toks"), F.size("sents"))
    a = a.select(id_col, *(v.alias(k) for k, v in g.items()))
    parts = {"s": 0.30 * F.col("s"), "h": 0.25 * (1 - F.col("h_norm")), "a": 0.25 * (1 - F.col("a")), "g": 0.20 * (1 - F.col("g"))}
    total = sum(parts.values(), F.lit(0.0))
    return a.select(id_col, "gase", *(T.rounded(v).alias(f"part_{k}") for k, v in parts.items()), *(T.rounded(total - v).alias(f"without_{k}") for k, v in parts.items()))
