"""Registered queries of the library: each runs an operator over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.functions import fixed
from loomline.functions import metrics as M
from loomline.functions import scoring as S
from loomline.functions import text as T
from loomline.functions.lexicon import starter
from loomline.layout import spread
from loomline.operators import documents as D
from loomline.operators import evaluation as E
from loomline.operators import frequency as Q
from loomline.operators import joined as J
from loomline.operators import latent as L
from loomline.operators import phrases as P
from loomline.operators import statistics as St
from loomline.plans.narratives import corpus_lexicon, narratives
from loomline.scratch import materialize
from loomline.sources import readers as R
from loomline.streaming.watch import windowed_labels

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark, sf_dir) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def narr(spark, sf_dir) -> DataFrame:
    return narratives(spark, sf_dir)


def annotated(spark, sf_dir) -> DataFrame:
    return D.annotate(narr(spark, sf_dir), starter())


# --- text ---------------------------------------------------------------------------------------------------------


@query
def text_units(spark, sf_dir):
    """Tokens, sentences, paragraphs: their numbers and digests."""
    a = D.annotate(documents(spark, sf_dir))
    join = lambda c, sep: F.md5(F.array_join(c, sep))
    return a.select("doc_id", F.size("toks").alias("n_tokens"), join("toks", " ").alias("tokens_md5"), F.size("sents").alias("n_sents"), join("sents", "|").alias("sents_md5"), F.size("paras").alias("n_paras"), F.size(T.literal_paragraphs(F.col("text"))).alias("n_literal"))


@query
def lexical_units(spark, sf_dir):
    """Syllables, n-grams, content words, the other tokenisers and word counts."""
    a = D.annotate(documents(spark, sf_dir))
    c, toks = F.col("text"), F.col("toks")
    return a.select(
        "doc_id", F.aggregate(F.transform(toks, T.syllables), F.lit(0), lambda s, x: s + x).alias("n_syllables"), F.size(F.array_distinct(T.ngrams(toks, 2))).alias("n_bigrams"), F.size(F.array_distinct(T.ngrams(toks, 3))).alias("n_trigrams"),
        F.size(T.content_words(toks)).alias("n_content"), F.size(T.plain_tokens(c, True)).alias("n_apostrophe_tokens"), F.size(T.plain_tokens(c)).alias("n_plain_tokens"), T.blank_words(c).alias("n_blank_words"), T.word_count(c).alias("n_word_runs"),
    )


@query
def clean_posts(spark, sf_dir):
    """Cleaning, title and body, quality filter and text cap, on posts made from parts."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey").cast("string")
    body = F.concat(F.lit("See [the "), F.col("p_name"), F.lit("](http://x.example/"), k, F.lit(") and **"), F.col("p_brand"), F.lit("** now.\n## Part &amp; parcel\n\n\n\nhttps://y.example/"), k, F.lit(" *end* &lt;b&gt; "), F.col("p_type"))
    posts = p.select(F.col("p_partkey").alias("id"), F.col("p_type").alias("title"), F.when(F.col("p_partkey") % 7 == 0, "[removed]").when(F.col("p_partkey") % 11 == 0, "").otherwise(body).alias("selftext"), F.col("p_size").alias("score"))
    return R.quality_posts(posts, 10, 5).select("id", F.substring("text", 1, 2000).alias("text"), "n_words", "score")


@query
def weak_labels(spark, sf_dir):
    """Word-list sentiment and emotion labels, narrow and wide lists."""
    c = F.col("text")
    return narr(spark, sf_dir).select("doc_id", T.weak_sentiment(c).alias("sentiment"), T.weak_sentiment(c, True).alias("sentiment_wide"), T.weak_emotion(c).alias("emotion"), T.weak_emotion(c, True).alias("emotion_wide"))


@query
def label_filters(spark, sf_dir):
    """Consensus of three baselines and the confidence filter, per paragraph of the narratives."""
    p = narr(spark, sf_dir).select("doc_id", F.posexplode(T.paragraphs(F.col("text"))).alias("ix", "p"))
    c = F.col("p")
    x = p.select("doc_id", "ix", S.vader_like(c).alias("v"), S.nrc_like(c)["compound"].alias("n"), S.liwc_like(c)["compound"].alias("l"))
    x = x.select("doc_id", "ix", T.label(F.col("v")).alias("vader"), T.label(F.col("n")).alias("nrc"), T.label(F.col("l")).alias("liwc"), T.confident_label(F.col("v")).alias("confident"))
    return x.withColumn("consensus", (F.col("vader") == F.col("nrc")) & (F.col("nrc") == F.col("liwc"))).where("consensus or confident is not null")


@query
def substring_counts(spark, sf_dir):
    """Non-overlapping substring counts, presence and pattern counts."""
    low = F.lower("text")
    return documents(spark, sf_dir).select("doc_id", T.occurrences(low, "the").alias("n_the"), T.total_occurrences(low, ["en", "on", "anan"]).alias("n_some"), T.n_contained(low, ["wh", "zz", "tion"]).alias("present"), T.matches(low, r"[aeiou]{2}").alias("pairs"), low.rlike(r"\bth[a-z]+ed\b").alias("shape"))


# --- document statistics ------------------------------------------------------------------------------------------


@query
def doc_stats(spark, sf_dir):
    """Counts, readability, richness, coverage and confidence of every document."""
    return D.doc_stats(documents(spark, sf_dir), corpus_lexicon())


@query
def sentence_lengths(spark, sf_dir):
    d = D.sentence_lengths(documents(spark, sf_dir))
    return d.withColumns({"mean_len": T.rounded(F.col("mean_len")), "sd_len": T.rounded(F.col("sd_len"))})


@query
def character_shares(spark, sf_dir):
    c, n = F.col("text"), F.greatest(F.lit(1), F.length("text"))
    part = lambda p: T.rounded(F.length(F.regexp_replace(c, p, "")) / n)
    return documents(spark, sf_dir).select("doc_id", part(r"\P{L}").alias("letters"), part(r"\P{Nd}").alias("digits"), part(r"[^ ]").alias("spaces"), T.rounded((F.length(c) - F.length(F.translate(c, fixed.PUNCTUATION, ""))) / n).alias("punctuation"))


@query
def word_lengths(spark, sf_dir):
    return Q.word_lengths(documents(spark, sf_dir))


@query
def hapax(spark, sf_dir):
    """Tokens that occur once in a document, in order of occurrence."""
    h = Q.hapax(documents(spark, sf_dir)).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("first", "token"))).alias("l"))
    return h.select("doc_id", F.size("l").alias("n"), F.md5(F.array_join(F.transform("l", lambda x: x["token"]), " ")).alias("words_md5"))


# --- sentiment ----------------------------------------------------------------------------------------------------


@query
def sentence_scores(spark, sf_dir):
    return D.sentence_scores(narr(spark, sf_dir), starter()).select("doc_id", "sent_ix", "compound", "sarcasm", F.size("emotions").alias("n_emotions"), F.array_join(F.array_sort("horsemen"), ",").alias("horsemen"))


@query
def sentence_scores_corpus(spark, sf_dir):
    """The same operator over the driver's prose, with a lexicon of its frequent tokens."""
    return D.sentence_scores(documents(spark, sf_dir), corpus_lexicon()).select("doc_id", "sent_ix", "compound", F.size("emotions").alias("n_emotions"))


@query
def sentence_scores_joined(spark, sf_dir):
    """The same scores by a join with a lexicon table, the form for lexicons of any size."""
    lex = corpus_lexicon()
    return J.score_sentences(documents(spark, sf_dir), lex.table(spark).where("not is_phrase").drop("is_phrase"), lex)


@query
def sentence_scores_joined_phrases(spark, sf_dir):
    lex = starter()
    return J.score_sentences(narr(spark, sf_dir), lex.table(spark).where("not is_phrase").drop("is_phrase"), lex)


@query
def phrase_index(spark, sf_dir):
    """Sentences that hold a phrase, for a phrase out of every document."""
    d = documents(spark, sf_dir)
    phrases = d.select(F.explode(T.bound(F.lower("text"), lambda x: F.array(F.substring(x, 6, 13), F.substring(x, 40, 2)))).alias("term")).distinct().where("length(term) > 0")
    return P.phrase_counts(d, phrases)


@query
def stop_word_antijoin(spark, sf_dir):
    t = J.without_words(Q.token_table(documents(spark, sf_dir)), fixed.STOP_WORDS, spark)
    return t.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_distinct("token").alias("types"))


@query
def neighbour_sentences(spark, sf_dir):
    """Adjacent-pair join: Jaccard of each sentence's tokens with the next one's."""
    s = J.neighbours(J.sentence_table(narr(spark, sf_dir)), "doc_id", "sent_ix", "sentence")
    both = s.select("doc_id", "sent_ix", T.jaccard(F.array_distinct(T.tokens(F.col("sentence"))), F.array_distinct(T.tokens(F.col("next")))).alias("j"))
    return both.groupBy("doc_id").agg(F.count("*").alias("pairs"), T.rounded(F.avg(F.floor(F.col("j") * 1000) / 1000), 3).alias("mean_jaccard"))


@query
def sentence_pairs(spark, sf_dir):
    """All pairs of a document's sentences as sets of tokens: their number, equal ones, and pairs that share a token."""
    s = J.sentence_table(narr(spark, sf_dir)).select("doc_id", F.array_sort(F.array_distinct(T.tokens(F.col("sentence")))).alias("w"))
    return J.pair_counts(s, "doc_id", "w")


@query
def score_text(spark, sf_dir):
    s = D.score_text(narr(spark, sf_dir), starter())
    flat = lambda m: F.array_join(F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))), ",")
    return s.select("doc_id", T.rounded(F.col("mean")).alias("mean"), "band", "n_sarcasm", "n_sents", flat("emotion_totals").alias("emotions"), flat("horsemen").alias("horsemen"))


@query
def paragraph_timeline(spark, sf_dir):
    return D.paragraph_timeline(narr(spark, sf_dir), starter()).select("doc_id", "n_paras", "teg", S.band(F.col("teg"), *M.BANDS["teg"]).alias("band"))


@query
def baseline_scores(spark, sf_dir):
    c = F.col("text")
    x = narr(spark, sf_dir).select("doc_id", S.vader_like(c).alias("vader"), S.nrc_like(c).alias("n"), S.liwc_like(c).alias("l"))
    return x.select("doc_id", "vader", F.col("n.compound").alias("nrc"), *(F.col(f"n.{e}").alias(f"nrc_{e}") for e in fixed.NRC_EMOTIONS), F.col("l.compound").alias("liwc"), F.col("l.positive_emotion").alias("liwc_pos"), F.col("l.negative_emotion").alias("liwc_neg"), F.col("l.cognitive_process").alias("liwc_cog"), F.col("l.social_process").alias("liwc_soc"))


@query
def naive_bayes(spark, sf_dir):
    p = narr(spark, sf_dir).select(F.col("doc_id"), F.posexplode(T.sentences(F.col("text"))).alias("ix", "text"))
    return D.naive_bayes(p.withColumn("id", F.struct("doc_id", "ix")), starter(), "id").select("id.doc_id", "id.ix", "p_positive", "p_negative", "p_neutral", "label")


# --- metrics ------------------------------------------------------------------------------------------------------


@query
def gase(spark, sf_dir):
    a = annotated(spark, sf_dir)
    g = M.gase(F.col("compounds"), F.col("emotions"), F.col("horsemen"), F.col("toks"), F.size("sents"))
    return a.select("doc_id", *(v.alias(k) for k, v in g.items())).withColumn("band", S.band(F.col("gase"), *M.BANDS["gase"]))


@query
def pronouns_power(spark, sf_dir):
    """Pronoun triangulation and counts, power asymmetry, disclosure, distortion load."""
    a = D.annotate(narr(spark, sf_dir))
    toks, c = F.col("toks"), F.col("text")
    return a.select("doc_id", M.pti(toks).alias("pti"), *(v.alias(f"n_{k}") for k, v in M.pronouns(toks).items()), M.pai(F.col("low"), toks).alias("pai"), M.vads(F.col("low"), toks).alias("vads"), *(v.alias(f"vads_{k.lower()}") for k, v in M.vads_hits(F.col("low")).items()), M.cd_index(F.col("low"), toks).alias("cd_index"))


@query
def arcs(spark, sf_dir):
    """Gradient, arc asymmetry and watershed of the sentence scores."""
    a = annotated(spark, sf_dir).withColumns({"nava": M.nava(F.col("compounds")), "lewi": M.lewi(F.col("compounds"))})
    return a.select("doc_id", M.teg(F.col("compounds")).alias("teg"), "nava", M.nava_arc(F.col("nava")).alias("arc"), F.col("lewi.idx").alias("lewi_idx"), F.col("lewi.pre").alias("pre"), F.col("lewi.post").alias("post"), F.col("lewi.drop").alias("drop"))


@query
def arcs_corpus(spark, sf_dir):
    a = D.annotate(documents(spark, sf_dir), corpus_lexicon()).withColumn("lewi", M.lewi(F.col("compounds")))
    return a.select("doc_id", M.teg(F.col("compounds")).alias("teg"), M.nava(F.col("compounds")).alias("nava"), F.col("lewi.idx").alias("lewi_idx"), F.col("lewi.drop").alias("drop"))


@query
def rci(spark, sf_dir):
    """Relational coherence: mean Jaccard over all pairs of segments, for narratives and prose."""
    both = narr(spark, sf_dir).select(F.lit("n").alias("kind"), "doc_id", "text").unionByName(documents(spark, sf_dir).select(F.lit("d").alias("kind"), "doc_id", "text"))
    a = D.annotate(both)
    return a.select("kind", "doc_id", T.rounded(D.mean_jaccard(D.content_sets(M.rci_segments(F.col("text"), F.col("sents"))))).alias("rci"))


@query
def ties(spark, sf_dir):
    return D.annotate(narr(spark, sf_dir)).select("doc_id", M.ties(F.col("low"), F.col("sents")).alias("ties"))


@query
def rumination(spark, sf_dir):
    a = D.annotate(narr(spark, sf_dir))
    return a.select("doc_id", *(v.alias(k) for k, v in M.rumination(F.col("low"), F.col("toks"), F.col("paras")).items()))


@query
def archetypes(spark, sf_dir):
    s = M.rasp(F.lower("text"))
    name = lambda k: "".join(c if c.isascii() and c.isalnum() else "_" for c in k.lower())
    return narr(spark, sf_dir).select("doc_id", *(v.alias(name(k)) for k, v in s.items()), T.first_largest(list(s.items())).alias("dominant"))


@query
def word_migration(spark, sf_dir):
    return D.word_migration(narr(spark, sf_dir), starter())


@query
def coherence_proxies(spark, sf_dir):
    a = D.annotate(narr(spark, sf_dir))
    return a.select("doc_id", M.coherence(F.col("sents")).alias("coherence"), *(T.rounded(M.proxy(F.col("toks"), m), 6).alias(f"proxy_{m}") for m in fixed.CONSTRUCT_PROXIES))


@query
def doc_metrics(spark, sf_dir):
    """The wide metric row of every narrative."""
    return D.doc_metrics(narr(spark, sf_dir), starter(), keep=("dataset", "gold"))


@query
def doc_metrics_corpus(spark, sf_dir):
    """The wide metric row of every document of the driver's prose."""
    return D.doc_metrics(documents(spark, sf_dir), corpus_lexicon())


@query
def nspl(spark, sf_dir):
    """Layered score with LSA coherence (no SQL: singular values)."""
    return D.nspl(narr(spark, sf_dir), starter())


@query
def gase_ablation(spark, sf_dir):
    return D.ablation(narr(spark, sf_dir), starter())


# --- extractors ---------------------------------------------------------------------------------------------------


@query
def attachment(spark, sf_dir):
    low = F.lower("text")
    s = M.attachment(low)
    total = F.greatest(F.lit(1), sum(s.values(), F.lit(0)))
    return narr(spark, sf_dir).select("doc_id", *(v.alias(k) for k, v in s.items()), *(T.rounded(v / total * 100, 1).alias(f"pct_{k}") for k, v in s.items()), T.first_largest(list(s.items())).alias("dominant"))


@query
def gottman(spark, sf_dir):
    a = annotated(spark, sf_dir)
    return a.select("doc_id", *(v.alias(k) for k, v in M.gottman(F.col("low"), F.col("horsemen"), F.size("sents")).items()))


@query
def phases(spark, sf_dir):
    return D.phase_table(narr(spark, sf_dir), fixed.PHASE_MARKERS)


@query
def trauma_themes(spark, sf_dir):
    return D.phase_table(narr(spark, sf_dir), fixed.TRAUMA_THEMES)


@query
def dissolution(spark, sf_dir):
    a = D.annotate(narr(spark, sf_dir)).withColumn("g", M.dissolution(F.col("paras")))
    return a.select("doc_id", "g.phase", "g.para")


@query
def blame(spark, sf_dir):
    b = M.blame(F.col("sents"))
    a = D.annotate(narr(spark, sf_dir))
    return a.select("doc_id", b["self"].alias("own"), b["other"].alias("other"), b["self_pct"].alias("own_pct"), b["other_pct"].alias("other_pct"), F.array_join(b["self_evidence"], "|").alias("own_evidence"), F.array_join(b["other_evidence"], "|").alias("other_evidence"), M.blame_band(b["self"], b["other"]).alias("band"))


@query
def exit_signals(spark, sf_dir):
    low = F.lower("text")
    s = {k: T.n_contained(low, ms) for k, ms in fixed.EXIT_SIGNALS.items()}
    total = sum(s.values(), F.lit(0))
    return narr(spark, sf_dir).select("doc_id", *(v.alias(k.lower().replace(" ", "_")) for k, v in s.items()), total.alias("total"), S.band(total, *M.BANDS["exit"]).alias("band"))


@query
def power_dynamics(spark, sf_dir):
    a = D.annotate(narr(spark, sf_dir))
    p = M.power(F.col("low"), F.col("toks"))
    top = F.array_join(F.transform(p.pop("control_top"), lambda x: F.concat_ws("=", x["word"], x["n"].cast("string"))), ",")
    return a.select("doc_id", *(v.alias(k) for k, v in p.items()), top.alias("control_top"), M.pronoun_band(p["i"], p["you"], p["we"]).alias("band"))


@query
def entities(spark, sf_dir):
    """Roles, dates, and the ten commonest names."""
    c = F.col("text")
    n = narr(spark, sf_dir)
    names = n.select("doc_id", F.posexplode(M.names_of(c)).alias("ix", "name")).groupBy("doc_id", "name").agg(F.count("*").alias("n"), F.min("ix").alias("first"))
    top = names.groupBy("doc_id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "first", "name"))), 1, 10).alias("l"))
    own = n.select("doc_id", F.array_join(M.dates_of(c), "|").alias("dates"), *(T.occurrences(F.lower(c), r).alias(f"role_{r}") for r in fixed.ROLES))
    return own.join(top, "doc_id", "left").select(*own.columns, F.coalesce(F.array_join(F.transform("l", lambda x: F.concat_ws("=", x["name"], (-x["k"]).cast("string"))), ","), F.lit("")).alias("names"))


@query
def tense(spark, sf_dir):
    a = D.annotate(narr(spark, sf_dir)).withColumn("t", M.tense(F.col("paras")))
    p, q, f = F.col("t.past"), F.col("t.present"), F.col("t.future")
    return a.select("doc_id", p.alias("past"), q.alias("present"), f.alias("future"), F.when((p >= q) & (p >= f), "past").when(q >= f, "present").otherwise("future").alias("dominant"))


@query
def red_flags(spark, sf_dir):
    low = F.lower("text")
    name = lambda k: k.lower().replace(" & ", "_").replace(" ", "_")
    return narr(spark, sf_dir).select("doc_id", *(v.alias(name(k)) for k, v in M.red_flags(low).items()))


@query
def red_flag_snippets(spark, sf_dir):
    """Snippets around the matches (no SQL: exact places of matches)."""
    return D.snippets(narr(spark, sf_dir))


@query
def rules_fired(spark, sf_dir):
    return narr(spark, sf_dir).select("doc_id", F.array_join(M.rules_fired(F.lower("text")).cast("array<string>"), ",").alias("rules"))


def _worst(modes):
    """The highest severity among some failure modes."""
    of = lambda level: F.arrays_overlap(modes, F.array(*(F.lit(k) for k, v in M.SEVERITY.items() if v == level)))
    return F.when(of("high"), "high").when(of("medium"), "medium").when(of("low"), "low").otherwise("none")


@query
def failure_modes(spark, sf_dir):
    a = annotated(spark, sf_dir)
    n = F.greatest(F.lit(1), F.size("toks"))
    return a.select("doc_id", F.array_join(M.failure_modes(F.col("text"), n, T.among(F.col("toks"), [e.term for e in starter().words]) / n, F.col("n_sarcasm"), F.col("paras")), ",").alias("modes")).withColumn("worst", _worst(F.split("modes", ",")))


@query
def extracts(spark, sf_dir):
    """All extractors in one row."""
    return D.extracts(narr(spark, sf_dir), starter())


@query
def bands(spark, sf_dir):
    """Presentation bands over arbitrary values."""
    v = table(spark, sf_dir, "orders").select("o_orderkey", ((F.col("o_orderkey") * 37 % 2001) / 1000.0 - 1.0).alias("v"))
    return v.select("o_orderkey", *(S.band(F.col("v"), *b).alias(k) for k, b in M.BANDS.items()))


# --- frequency and association --------------------------------------------------------------------------------------


@query
def top_words(spark, sf_dir):
    return Q.top_words(documents(spark, sf_dir))


@query
def keywords(spark, sf_dir):
    return Q.keywords(documents(spark, sf_dir))


@query
def top_bigrams(spark, sf_dir):
    return Q.top_ngrams(narr(spark, sf_dir), 2)


@query
def top_trigrams(spark, sf_dir):
    return Q.top_ngrams(narr(spark, sf_dir), 3)


@query
def pmi(spark, sf_dir):
    return Q.pmi(documents(spark, sf_dir))


@query
def chi_square_words(spark, sf_dir):
    return Q.chi_square_words(narr(spark, sf_dir), starter(), "dataset")


@query
def tf_idf(spark, sf_dir):
    v = Q.tf_idf(narr(spark, sf_dir))
    return v.groupBy("doc_id", "sent_ix").agg(F.count("*").alias("n_terms"), T.rounded(F.sum("value"), 6).alias("total"), T.rounded(F.max("value"), 6).alias("top"))


@query
def sentence_similarity(spark, sf_dir):
    s = L.similar_sentences(Q.sentence_terms(narr(spark, sf_dir)))
    return s.groupBy("doc_id").agg(F.count("*").alias("pairs"), F.sum(F.round(F.col("cosine") * 10000).cast("long")).alias("total"), F.max("cosine").alias("top"))


@query
def latent_similarity(spark, sf_dir):
    """Coherence, most and least similar sentences of every narrative in its latent space, all sentences (no SQL: singular values)."""
    return L.document_pairs(Q.sentence_terms(narr(spark, sf_dir)))


@query
def extreme_pairs(spark, sf_dir):
    """The same by the cosine of the TF-IDF rows themselves."""
    return L.document_pairs(Q.sentence_terms(narr(spark, sf_dir)), latent=False)


@query
def corpus_latent(spark, sf_dir):
    """Documents in the latent space of the whole corpus: cosine of each with the document of the next id (no SQL: singular values)."""
    v = L.corpus_vectors(Q.corpus_tf_idf(documents(spark, sf_dir)), ["doc_id"], "token")
    nxt = v.select((F.col("doc_id") - 1).alias("doc_id"), F.col("vector").alias("next"))
    return v.join(nxt, "doc_id").select("doc_id", T.rounded(T.cosine(F.col("vector"), F.col("next"))).alias("cosine"))


@query
def embedding_cosine(spark, sf_dir):
    """Cosine of every vector with the one of the next id."""
    v = table(spark, sf_dir, "embeddings")
    nxt = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    return v.join(nxt, "vec_id").select("vec_id", T.rounded(T.cosine(F.col("embedding"), F.col("next"))).alias("cosine"))


@query
def vocabulary_overlap(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return Q.vocabulary_overlap(d.where("lang = 'en'"), d.where("lang = 'fr'")).groupBy("side").agg(F.count("*").alias("n"), F.min("word").alias("first_word"))


@query
def corpus_union(spark, sf_dir):
    """Union of two corpora with different columns, then counts by origin."""
    a = table(spark, sf_dir, "documents").select(F.lit("documents").alias("origin"), "lang", "text")
    b = table(spark, sf_dir, "conversations").select(F.lit("conversations").alias("origin"), "role", "text")
    return E.union_all([a, b]).groupBy("origin", "lang", "role").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query
def capped_rows(spark, sf_dir):
    """The first rows of every group by a declared order (the cap is the feature)."""
    return E.capped(table(spark, sf_dir, "documents"), ["source"], "doc_id", 5).select("source", "doc_id")


# --- statistics ---------------------------------------------------------------------------------------------------


def _orders(spark, sf_dir) -> DataFrame:
    q = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_quantity").alias("qty"), F.count("*").alias("n_lines"), F.sum("l_discount").alias("disc"))
    return table(spark, sf_dir, "orders").join(q, "o_orderkey").select("o_orderkey", "o_custkey", F.col("o_orderpriority").alias("dataset"), F.col("o_totalprice").alias("price"), "qty", "n_lines", T.rounded(F.col("disc"), 2).alias("disc"))


def _scored(spark, sf_dir) -> DataFrame:
    """Labels with two scores from their documents: gold pos, neg or neu, and values in [-1, 1]."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", (F.length("text") % 201 / 100.0 - 1.0).alias("s1"), ((F.col("doc_id") * 7919 + F.length("text") * 31) % 101 / 50.0 - 1.0).alias("s2"))
    x = table(spark, sf_dir, "labels").join(d, "doc_id")
    gold = F.when(F.col("toxic") == 1, "neg").when((F.col("quality") == 1) & (F.col("doc_id") % 3 > 0), "pos").otherwise("neu")
    return x.select("doc_id", "lang", gold.alias("gold"), T.rounded(F.col("s1"), 2).alias("s1"), T.rounded(F.col("s2"), 2).alias("s2"))


@query
def describe(spark, sf_dir):
    return St.describe(_orders(spark, sf_dir), ["dataset"], ["price", "qty", "n_lines", "disc"]).withColumn("mean", T.rounded(F.col("mean"), 2)).withColumn("sd", T.rounded(F.col("sd"), 2))


@query
def confusion(spark, sf_dir):
    return St.confusion(_scored(spark, sf_dir).withColumn("pred", T.label(F.col("s1"))), ["lang"], "gold", "pred")


@query
def confusion_matrix(spark, sf_dir):
    return St.confusion_matrix(_scored(spark, sf_dir).withColumn("pred", T.label(F.col("s1"))), [], "gold", "pred")


@query
def precision_recall(spark, sf_dir):
    return St.precision_recall(_scored(spark, sf_dir).withColumn("pred", T.label(F.col("s1"))), ["lang"], "gold", "pred")


@query
def roc_curve(spark, sf_dir):
    c = St.roc_curve(_scored(spark, sf_dir), ["lang"], "s1", F.col("gold") == "pos")
    return c.withColumns({"fpr": T.rounded(F.col("fpr"), 6), "tpr": T.rounded(F.col("tpr"), 6)})


@query
def auc(spark, sf_dir):
    return St.auc(_scored(spark, sf_dir), ["lang"], "s2", F.col("gold") == "pos")


@query
def multiclass_auc(spark, sf_dir):
    return St.multiclass_auc(_scored(spark, sf_dir), ["lang"], "s1", "gold")


@query
def baselines(spark, sf_dir):
    """Four systems against gold labels, per dataset."""
    c = F.col("text")
    x = annotated(spark, sf_dir).select("dataset", F.col("gold").alias("gold_sentiment"), T.rounded(S.mean_of_rounded(F.col("compounds"))).alias("sentiment"), S.vader_like(c).alias("vader_score"), S.nrc_like(c)["compound"].alias("nrc_score"), S.liwc_like(c)["compound"].alias("liwc_score"))
    return E.baselines(x, ["dataset"])


@query
def system_agreement(spark, sf_dir):
    """Systems against gold and against the main one, over two scores of the labelled documents."""
    x = _scored(spark, sf_dir).select("lang", F.col("gold").alias("gold_sentiment"), F.col("s1").alias("sentiment"), F.col("s2").alias("vader_score"), (-F.col("s1")).alias("nrc_score"), F.lit(0.0).alias("liwc_score"))
    return E.system_agreement(x, ["lang"])


@query
def statistical_report(spark, sf_dir):
    return E.statistical_report(_orders(spark, sf_dir).withColumn("y", F.col("n_lines") * 25.0), ["dataset"], "qty", "y", F.col("n_lines") > 3).where("value is not null")


@query
def pearson(spark, sf_dir):
    return St.pearson(_orders(spark, sf_dir), ["dataset"], "price", "qty")


@query
def spearman(spark, sf_dir):
    return St.spearman(_orders(spark, sf_dir), ["dataset"], "disc", "qty")


@query
def effect_size(spark, sf_dir):
    o = _orders(spark, sf_dir)
    return St.effect_size(o, ["dataset"], "price", F.col("n_lines") > 3)


@query
def wilcoxon(spark, sf_dir):
    return St.wilcoxon(_orders(spark, sf_dir).withColumn("y", F.col("n_lines") * 25.0), ["dataset"], "qty", "y")


def _ratings(spark, sf_dir) -> DataFrame:
    """Three raters of every labelled document: their labels are steps of three scores."""
    s = _scored(spark, sf_dir).withColumn("s3", T.rounded((F.col("s1") + F.col("s2")) / 2, 2))
    return s.select("lang", "doc_id", F.explode(F.array(*(F.struct(F.lit(f"r{k}").alias("rater"), F.col(f"s{k}").alias("value")) for k in (1, 2, 3)))).alias("t")).select("lang", "doc_id", "t.rater", "t.value", T.label(F.col("t.value"), 0.3).alias("label"))


@query
def icc(spark, sf_dir):
    return St.icc(_ratings(spark, sf_dir), ["lang"], "doc_id", "rater", "value").withColumn("n", F.col("n").cast("long")).withColumn("k", F.col("k").cast("long"))


@query
def cohen_kappa(spark, sf_dir):
    x = _scored(spark, sf_dir)
    return St.cohen_kappa(x.select("lang", T.label(F.col("s1"), 0.3).alias("a"), "gold"), ["lang"], "a", "gold")


@query
def krippendorff(spark, sf_dir):
    x = _scored(spark, sf_dir).select("lang", T.label(F.col("s1"), 0.3).alias("a"), T.label(F.col("s2"), 0.3).alias("b"))
    nominal = St.krippendorff(x, ["lang"], "a", "b").select("lang", "n", F.col("alpha").alias("nominal"))
    return nominal.join(St.krippendorff(x, ["lang"], "a", "b", True).select("lang", F.col("alpha").alias("ordinal")), "lang")


@query
def fleiss_kappa(spark, sf_dir):
    return St.fleiss_kappa(_ratings(spark, sf_dir), ["lang"], "doc_id", "label")


@query
def fleiss_by_category(spark, sf_dir):
    return St.fleiss_by_category(_ratings(spark, sf_dir), ["lang"], "doc_id", "label")


@query
def percent_agreement(spark, sf_dir):
    return St.percent_agreement(_ratings(spark, sf_dir), ["lang"], "doc_id", "label")


@query
def mcnemar(spark, sf_dir):
    x = _scored(spark, sf_dir)
    return St.mcnemar(x, ["lang"], T.label(F.col("s1")) == F.col("gold"), T.label(F.col("s2")) == F.col("gold"))


@query
def label_distribution(spark, sf_dir):
    return St.label_distribution(_scored(spark, sf_dir), ["lang"], "gold")


@query
def bootstrap(spark, sf_dir):
    """Bootstrap interval of a mean per group (no SQL: random draws, seeded)."""
    return St.bootstrap_mean(_orders(spark, sf_dir).select("dataset", "o_orderkey", "price"), ["dataset"], "price")


# --- experiments ----------------------------------------------------------------------------------------------------


def _labelled(docs: DataFrame) -> DataFrame:
    return D.doc_metrics(docs.withColumnRenamed("gold", "gold_sentiment"), starter(), keep=("dataset", "gold_sentiment"))


def _metric_rows(spark, sf_dir, *metrics: str) -> DataFrame:
    """Metric rows of all narratives with dataset, gold label and the ``metrics`` that the query reads (all, if none is named), written once: the second level reads them several times.

    What is written is computed, so that a metric that nobody reads would cost as much as any other.
    """
    rows = _labelled(narr(spark, sf_dir))
    return materialize(rows.select("doc_id", "dataset", "gold_sentiment", *dict.fromkeys(metrics)) if metrics else rows, "metrics")


#: What the registered pairs and the four systems read.
PAIRED = [c for a, b, _ in E.PAIRS for c in (a, b)]
SYSTEMS = list(E.SYSTEMS.values())
DESCRIBED = ["sentiment", "gase", "pti", "teg", "rci", "pai", "nava", "lewi_drop", "cd_index", "vads", "ties", "vader_score", "nrc_score", "liwc_score", "n_words"]


@query
def metric_pairs(spark, sf_dir):
    """The ten registered pairs over the metric rows of every dataset."""
    return E.metric_pairs(_metric_rows(spark, sf_dir, *PAIRED), ["dataset"])


@query
def ablation_table(spark, sf_dir):
    return E.ablation_table(_metric_rows(spark, sf_dir, "gase", "lewi_drop", "rci", "nava"), ["dataset"])


@query
def lewi_nava_validation(spark, sf_dir):
    return E.drop_validation(_metric_rows(spark, sf_dir, "nava", "lewi_drop"), ["dataset"])


@query
def dominance_experiment(spark, sf_dir):
    return E.experiment(_metric_rows(spark, sf_dir, "pti", "pai"), ["dataset"], "pti", "pai", 0.25)


@query
def instability_experiment(spark, sf_dir):
    return E.experiment(_metric_rows(spark, sf_dir, "teg", "ties").where("teg > 0"), ["dataset"], "teg", "ties", 0.20)


@query
def systems_differ(spark, sf_dir):
    """McNemar of two systems over the metric rows of every dataset."""
    return E.systems_differ(_metric_rows(spark, sf_dir, "sentiment", "vader_score"), ["dataset"])


@query
def hypothesis_results(spark, sf_dir):
    """Verdicts on the registered hypotheses that metric rows can decide."""
    return E.hypothesis_results(_metric_rows(spark, sf_dir, "sentiment", "vader_score", "pti", "pai", "teg", "ties", "nava", "lewi_drop", "cd_index"), ["dataset"])


@query
def dataset_summary(spark, sf_dir):
    """One row a dataset: agreement with gold, directions, effect size."""
    return E.dataset_summary(_metric_rows(spark, sf_dir, *PAIRED, *SYSTEMS), ["dataset"])


@query
def dataset_rollup(spark, sf_dir):
    """F1, area and r of every dataset, and their unweighted means."""
    return E.rollup(E.dataset_summary(_metric_rows(spark, sf_dir, *PAIRED, *SYSTEMS), ["dataset"]), "dataset", ["main_f1", "main_auc", "main_r"])


@query
def metric_summary(spark, sf_dir):
    """Descriptives of the metric rows."""
    return St.describe(_metric_rows(spark, sf_dir, *DESCRIBED), ["dataset"], DESCRIBED, 4)


@query
def domain_profile(spark, sf_dir):
    """Descriptives of the first narratives of every dataset; the rest have no metric row made, since the profile is of these alone."""
    docs = narr(spark, sf_dir)
    first = E.capped(docs.where(D.has_text(F.col("text"))), ["dataset"], "doc_id", 30)
    return E.domain_profile(_labelled(first), ["dataset"], "doc_id", ["gase", "pti", "teg", "pai", "rci"])


@query
def correlation_matrix(spark, sf_dir):
    return E.correlation_matrix(_metric_rows(spark, sf_dir, "gase", "pti", "pai", "ties", "rci"), ["dataset"], ["gase", "pti", "pai", "ties", "rci"])


@query
def paragraph_correlation(spark, sf_dir):
    """Per document with three long paragraphs or more: correlation of the six paragraph metrics."""
    p = narr(spark, sf_dir).select("doc_id", F.filter(T.literal_paragraphs(F.col("text")), lambda x: F.length(x) > 30).alias("l")).where(F.size("l") >= 3).select("doc_id", F.explode("l").alias("text"))
    return E.correlation_matrix(D.paragraph_metrics(p, starter()), ["doc_id"], D.PARAGRAPH_METRICS).where("row < col")


@query
def construct_validity(spark, sf_dir):
    """Metrics against word-list proxies, over all narratives."""
    m = D.doc_metrics(narr(spark, sf_dir).withColumn("body", F.col("text")), starter(), keep=("body",))
    return E.construct_validity(m, [], "body")


@query
def compare_documents(spark, sf_dir):
    """Two documents side by side."""
    # read once, so nothing is written, and the filter goes below the metrics
    m = _labelled(narr(spark, sf_dir)).withColumn("doc_id", F.col("doc_id").cast("string"))
    return E.compare(m, "doc_id", "1", "2", ["gase", "pti", "pai", "ties"])


@query
def ranking(spark, sf_dir):
    return E.ranking(_metric_rows(spark, sf_dir, "n_words", "sentiment", "gase", "pti"), "doc_id")


@query
def validation_suite(spark, sf_dir):
    """Share of the scored narratives that show what each of the 19 claims asks."""
    return E.validation_suite(_metric_rows(spark, sf_dir), {f"{of}: {claim}": test for of, claim, test in fixed.VALIDATION})


@query
def hypothesis_registry(spark, sf_dir):
    return E.hypothesis_registry(spark)


@query
def metric_catalog(spark, sf_dir):
    return E.metric_catalog(spark)


# --- sources ------------------------------------------------------------------------------------------------------


@query
def session_transcript(spark, sf_dir):
    """User turns of every conversation, joined in order."""
    c = table(spark, sf_dir, "conversations").withColumn("speaker", F.when(F.col("role") == "user", "C").otherwise("T"))
    return R.session_transcript(c, ("turn",), "conv_id").select("id", F.length("text").alias("chars"), F.md5("text").alias("text_md5"))


@query
def session_runs(spark, sf_dir):
    """Run-length version over line order within a file (here: a region of event ids)."""
    e = table(spark, sf_dir, "events").select((F.col("event_id") % 50).alias("file"), "event_id", F.col("user_id").alias("session_id"), F.when(F.col("event_type") == "click", "T").otherwise("C").alias("speaker"), F.col("event_type").alias("text"))
    return R.session_runs(e, "event_id", chunk="file").select("file", "id", "run", "text")


@query
def rater_matrix(spark, sf_dir):
    s = _scored(spark, sf_dir)
    own = lambda c, keep: s.where(keep).select(F.col("doc_id").cast("string").alias("id"), T.label(F.col(c), 0.3).alias("sentiment"))
    return R.rater_matrix([own("s1", F.lit(True)), own("s2", F.col("doc_id") % 5 > 0), own("s1", F.col("doc_id") % 2 == 0)])


@query
def multi_label_emotions(spark, sf_dir):
    """Multi-label rows made from line items: ids 0-27, and words from the part's name."""
    x = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    x = x.select("l_orderkey", "l_linenumber", "l_partkey", F.concat_ws(" ", F.lit("a part named"), "p_name", "p_type").alias("text"), F.concat_ws(",", (F.col("l_orderkey") % 28).cast("string"), (F.col("l_partkey") % 31).cast("string")).alias("emotion_ids"))
    return R.multi_label(x).groupBy("sentiment", "emotion").agg(F.count("*").alias("n"))


@query
def tweet_lines(spark, sf_dir):
    """Tab-separated lines made from orders."""
    o = table(spark, sf_dir, "orders")
    lab = F.element_at(F.array(*map(F.lit, ["positive", "negative", "neutral", "Joy", "fear"])), (F.col("o_orderkey") % 5 + 1).cast("int"))
    lines = o.select(F.concat_ws("\t", F.col("o_orderkey").cast("string"), lab, F.concat(F.lit("order of customer "), F.col("o_custkey").cast("string")), "o_orderpriority").alias("value"))
    return R.tweet_rows(lines).select("id", F.replace("text", F.lit("\t"), F.lit("~")).alias("text"), "sentiment")


@query
def dialogue_turns(spark, sf_dir):
    """Conversations as parallel arrays, zipped into rows of five words or more."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("l"))
    d = c.select("conv_id", F.transform("l", lambda x: x["text"]).alias("dialog"), F.transform("l", lambda x: (x["turn"] % 7).cast("int")).alias("emotion"))
    return R.dialogue_rows(d).groupBy("conv_id", "emotion", "sentiment").agg(F.count("*").alias("n"))


@query
def api_pages(spark, sf_dir):
    """Posts out of API pages in JSON, made from parts."""
    p = table(spark, sf_dir, "part")
    page = F.to_json(F.struct(F.struct(F.lit("t3").alias("after"), F.array(F.struct(F.struct(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("title"), F.col("p_type").alias("selftext"), F.col("p_size").alias("score")).alias("data"))).alias("children")).alias("data")))
    return R.api_pages(p.select(page.alias("page"))).select("after", "id", "title", "selftext", "score")


@query
def post_rows(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.when(F.col("p_partkey") % 4 == 0, "[deleted]").when(F.col("p_partkey") % 9 == 0, F.lit(None)).otherwise(F.col("p_type")).alias("selftext"))
    return R.post_rows(p).select("id", "text")


@query
def aliased_corpus(spark, sf_dir):
    """A frame with unknown headers, resolved by alias."""
    o = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 3).alias("junk"), F.concat(F.lit("'order placed by "), F.col("o_custkey").cast("string"), F.lit("'")).alias("Utterance"), F.element_at(F.array(*map(F.lit, ["joyful", "afraid", "2", "0", "else"])), (F.col("o_orderkey") % 5 + 1).cast("int")).alias("Context"))
    return R.aliased(o).groupBy("text", "sentiment", "emotion").agg(F.count("*").alias("n"))


# --- streaming ----------------------------------------------------------------------------------------------------


@query
def windowed_labels_batch(spark, sf_dir):
    """The streaming aggregate on a batch frame: label counts per hour."""
    e = table(spark, sf_dir, "events").select("ts", (F.col("event_id") % 21 / 10.0 - 1.0).alias("score"))
    return windowed_labels(e, "ts", "score").withColumn("total", T.rounded(F.col("total"), 2))
