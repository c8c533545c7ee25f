"""Composite document metrics and extractors as Columns over text, tokens, segments and sentence scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomline.functions import fixed
from loomline.functions import text as T
from loomline.functions.patterns import match_counts
from loomline.functions.scoring import counts_of, mean, mean_of_rounded

PRONOUNS = {
    "i": ["i", "me", "my", "myself", "mine"], "you": ["you", "your", "yourself", "yours"], "we": ["we", "us", "our", "ourselves", "ours"],
    "he": ["he", "him", "his", "himself"], "she": ["she", "her", "hers", "herself"], "they": ["they", "them", "their", "themselves"],
}


#: Patterns that a metric row counts in the whole text.
COUNTED = list(dict.fromkeys([p for ps in fixed.DISTORTIONS.values() for p in ps] + [p.lower() for _, p in fixed.DISCLOSURE_TIERS.values()] + [p for pair in fixed.ABSOLUTE_PAIRS for p in pair]))


def counted(low: Column) -> Column:
    """Array of the matches of ``COUNTED``, made in one pass; metrics that take it as ``hits`` search the text no more."""
    return match_counts(low, COUNTED)


def _times(low: Column, pattern: str, hits: Column | None) -> Column:
    return T.matches(low, pattern) if hits is None else hits[COUNTED.index(pattern)]


def stats(c: Column, toks: Column, sents: Column, paras: Column, lexicon_words: list[str]) -> dict[str, Column]:
    """Counts, readability and richness of a document. n_words and n_sents are 1 at least."""
    n_w, n_s = F.greatest(F.lit(1), F.size(toks)), F.greatest(F.lit(1), F.size(sents))
    syl = F.transform(toks, T.syllables)
    n_syl = F.greatest(F.lit(1), T.total_syllables(toks))
    poly = F.size(F.filter(syl, lambda s: s >= 3))
    asl, asw = n_w / n_s, n_syl / n_w
    letters, chars = F.length(F.regexp_replace(c, r"\P{L}", "")), F.length(F.replace(c, F.lit(" "), F.lit("")))
    unique, vocab = F.size(F.array_distinct(toks)), F.size(F.array_distinct(T.content_words(toks)))
    sorted_toks = F.array_sort(toks)
    once = F.transform(F.array(sorted_toks), lambda a: F.size(F.filter(a, lambda t, i: (F.coalesce(F.get(a, i - 1), F.lit("")) != t) & (F.coalesce(F.get(a, i + 1), F.lit("")) != t))))[0]
    v = F.greatest(F.lit(1), unique)
    r = T.rounded
    return {
        "n_chars": F.length(c), "n_chars_nospace": chars, "n_letters": letters, "n_digits": F.length(F.regexp_replace(c, r"\P{Nd}", "")),
        "n_punct": F.length(c) - F.length(F.translate(c, fixed.PUNCTUATION, "")), "n_words": n_w, "n_unique": unique, "n_sents": n_s, "n_paras": F.size(paras),
        "n_syllables": T.total_syllables(toks), "n_content": F.size(T.content_words(toks)), "n_vocab": vocab, "n_once": once,
        "asl": r(asl, 2), "asw": r(asw, 2),
        "flesch_re": r(F.greatest(F.lit(0.0), F.least(F.lit(100.0), 206.835 - 1.015 * asl - 84.6 * asw)), 1), "flesch_kg": r(0.39 * asl + 11.8 * asw - 15.59, 1),
        "gunning_fog": r(0.4 * (asl + 100 * (poly / n_w)), 1), "smog": F.when(n_s >= 30, r(3 + F.sqrt(poly * (30 / n_s)), 1)),
        "coleman_liau": r(0.0588 * (letters / n_w * 100) - 0.296 * (n_s / n_w * 100) - 15.8, 1), "ari": r(4.71 * (chars / n_w) + 0.5 * asl - 21.43, 1),
        "ttr": r(unique / n_w, 3), "lexical_density": r(vocab / n_w, 3), "brunet_w": r(F.pow(n_w.cast("double"), F.pow(v.cast("double"), F.lit(-0.165))), 2),
        "honore_r": F.when(n_w > 1, r(100 * F.log(n_w.cast("double")) / F.greatest(F.lit(1e-9), 1 - once / v), 1)).otherwise(0.0),
        "rt_silent": n_w / 200, "rt_aloud": n_w / 130, "coverage": T.among(toks, lexicon_words) / n_w,
    }


def confidence(n_words: Column, coverage: Column) -> Column:
    return F.when((n_words < 50) | (coverage < 0.05), "LOW").when((n_words < 200) | (coverage < 0.10), "MODERATE").otherwise("HIGH")


def pronouns(toks: Column) -> dict[str, Column]:
    return {k: T.among(toks, ws) for k, ws in PRONOUNS.items()}


def pti(toks: Column) -> Column:
    p = pronouns(toks)
    return T.rounded((p["i"] - p["you"]) / (p["i"] + p["you"] + p["we"] + 1))


def pai(low: Column, toks: Column) -> Column:
    """Control verbs, pronoun imbalance and apologies, each up to 1, averaged."""
    n = F.greatest(F.lit(1), F.size(toks))
    control = F.least(F.lit(1.0), T.among(toks, fixed.CONTROL_VERBS) / (n * 0.1 + 1))
    i, you = T.among(toks, ["i", "me", "my"]), T.among(toks, ["you", "your", "yourself"])
    sorry = T.total_occurrences(low, fixed.APOLOGY_WORDS)
    return T.rounded(F.least(F.lit(1.0), (control + F.abs(i - you) / F.greatest(F.lit(1), i + you) + F.when(sorry == 0, 0.0).otherwise(F.least(F.lit(1.0), 0.5 + sorry / 10))) / 3))


def gase(compounds: Column, emotions: Column, horsemen: Column, toks: Column, n_sents: Column) -> dict[str, Column]:
    """Composite and its parts s, h_norm, a, g. emotions and horsemen: all tags of the document."""
    s = mean_of_rounded(compounds)
    h = T.bound(counts_of(emotions), lambda c: F.when(F.size(c) > 1, T.entropy(c) / F.log2(F.greatest(F.lit(2), F.size(c)).cast("double"))).otherwise(0.0))
    times = lambda line, style: T.total_occurrences(line, fixed.ATTACHMENT[style])
    # the joined tokens are made once, not once a needle
    a = T.bound(F.array_join(toks, " "), lambda line: F.least(F.lit(1.0), (times(line, "anxious") * 1.2 + times(line, "avoidant") * 0.8) / (10 + times(line, "secure") + 1)))
    g = F.least(F.lit(1.0), F.size(horsemen) / (F.greatest(F.lit(1), n_sents) * 0.5 + 1))
    total = 0.30 * s + 0.25 * (1 - h) + 0.25 * (1 - a) + 0.20 * (1 - g)
    return {"gase": T.rounded(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), total))), "s": T.rounded(s), "h_norm": T.rounded(h), "a": T.rounded(a), "g": T.rounded(g)}


def teg(scores: Column) -> Column:
    """Mean absolute step between neighbouring scores; 0 for fewer than two."""
    n = F.size(scores)
    steps = F.zip_with(F.slice(scores, 2, F.greatest(n - 1, F.lit(0))), F.slice(scores, 1, F.greatest(n - 1, F.lit(0))), lambda a, b: F.abs(a - b))
    return F.when(n > 1, T.rounded(mean_of_rounded(steps))).otherwise(0.0)


def nava(scores: Column) -> Column:
    """First part's mean less the last part's (quarters below nine scores, else thirds); null below four."""
    n = F.size(scores)
    part = F.greatest(F.lit(1), F.when(n < 9, F.floor(n / 4)).otherwise(F.floor(n / 3)).cast("int"))
    return F.when(n >= 4, T.rounded(mean_of_rounded(F.slice(scores, 1, part)) - mean_of_rounded(F.slice(scores, n - part + 1, part))))


def nava_arc(value: Column) -> Column:
    return F.when(value.isNull(), "NA").when(value > 0.15, "tragic").when(value < -0.15, "redemptive").when(F.abs(value) < 0.05, "flat").when(value > 0, "mildly declining").otherwise("mildly improving")


def lewi(scores: Column) -> Column:
    """Struct (idx, pre, post, drop) of the primary watershed; null below four scores.

    The smoothed series is a truncated moving average of radius max(1, n/4), or the raw series if that is flat.
    The watershed is the largest change of slope at a change of its sign (first of equal ones), else
    the steepest slope; the means on either side are of the raw scores.
    """
    n = F.size(scores)
    w = F.greatest(F.lit(1), F.floor(n / 4).cast("int"))
    smooth = F.transform(scores, lambda _, i: mean(F.slice(scores, F.greatest(i - w, F.lit(0)) + 1, F.least(n, i + w + 1) - F.greatest(i - w, F.lit(0)))))

    def slopes(s: Column) -> Column:
        used = F.when(F.array_max(s) - F.array_min(s) < 0.01, scores).otherwise(s)
        return F.transform(F.array(used), lambda u: F.zip_with(F.slice(u, 2, F.size(u) - 1), F.slice(u, 1, F.size(u) - 1), lambda b, a: b - a))[0]

    def at(d: Column) -> Column:
        turn = F.transform(F.slice(d, 2, F.greatest(F.size(d) - 2, F.lit(0))), lambda x, i: F.when(F.get(d, i) * x < 0, F.struct(F.abs(F.get(d, i) - x).alias("m"), (-(i + 1)).alias("o"))))
        steep = F.array_max(F.transform(d, lambda x, i: F.struct(F.abs(x).alias("m"), (-i).alias("o"))))
        best = F.array_max(F.array_compact(turn))
        return -F.coalesce(best["o"], steep["o"])

    index = F.transform(F.transform(F.array(smooth), slopes), at)

    def ends(i: Column) -> Column:
        pre, post = T.rounded(mean_of_rounded(F.slice(scores, 1, i))), T.rounded(mean_of_rounded(F.slice(scores, i + 1, n - i)))
        return F.struct(i.alias("idx"), pre.alias("pre"), post.alias("post"), T.rounded(pre - post).alias("drop"))

    return F.when(n >= 4, F.transform(index, ends)[0])


def cd_parts(low: Column, toks: Column, hits: Column | None = None) -> dict[str, Column]:
    """Rounded load of each distortion: matches against one per 200 tokens, up to 1."""
    cap = F.greatest(F.lit(1.0), F.size(toks) / 200)
    return {name: T.rounded(F.least(F.lit(1.0), sum((_times(low, p, hits) for p in ps), F.lit(0)) / cap)) for name, ps in fixed.DISTORTIONS.items()}


def cd_index(low: Column, toks: Column, hits: Column | None = None) -> Column:
    parts = cd_parts(low, toks, hits)
    return T.rounded(sum(parts.values(), F.lit(0.0)) / len(parts))


def vads_hits(low: Column, hits: Column | None = None) -> dict[str, Column]:
    return {tier: _times(low, p.lower(), hits) for tier, (_, p) in fixed.DISCLOSURE_TIERS.items()}


def vads(low: Column, toks: Column, hits: Column | None = None) -> Column:
    found = vads_hits(low, hits)
    # weights are tenths and the load is scaled by ten
    load = sum((round(fixed.DISCLOSURE_TIERS[k][0] * 10) * v for k, v in found.items()), F.lit(0))
    return T.rounded(F.least(F.lit(1.0), load / F.greatest(F.lit(1), F.size(toks))))


def ties(low: Column, sents: Column, hits: Column | None = None) -> Column:
    """Entropy of absolute terms times the density of contradictions within and between neighbouring segments."""
    paras, long = T.literal_paragraphs(low), F.filter(sents, lambda s: F.length(s) > 8)
    segs = T.bound(F.when(F.size(paras) > 0, paras).otherwise(F.array(low)), lambda p: F.when(F.size(p) >= 2, p).otherwise(T.bound(long, lambda s: F.when(F.size(s) >= 2, F.transform(s, F.lower)).otherwise(p))))
    # a plain search comes first: the terms are rare
    word = lambda p: p.replace("\\b", "")
    has = lambda s, p: s.contains(word(p)) & s.rlike(T.guarded(p))
    n = range(len(fixed.ABSOLUTE_PAIRS))
    flags = F.transform(segs, lambda s: F.struct(*(has(s, p).alias(f"{side}{k}") for k, pair in enumerate(fixed.ABSOLUTE_PAIRS) for side, p in zip("ab", pair, strict=True))))

    def count(x: Column) -> Column:
        own = F.aggregate(x, F.lit(0), lambda a, f: a + sum(((f[f"a{k}"] & f[f"b{k}"]).cast("int") for k in n), F.lit(0)))
        pairs = F.zip_with(F.slice(x, 1, F.size(x) - 1), F.slice(x, 2, F.size(x) - 1), lambda f, g: sum((((f[f"a{k}"] & g[f"b{k}"]) | (f[f"b{k}"] & g[f"a{k}"])).cast("int") for k in n), F.lit(0)))
        return (own + F.aggregate(pairs, F.lit(0), lambda a, v: a + v)) / F.greatest(F.lit(1), F.size(x))

    times = lambda p: F.when(low.contains(word(p)), T.matches(low, p)).otherwise(0) if hits is None else _times(low, p, hits)
    h = T.entropy(F.filter(F.array(*(times(a) + times(b) for a, b in fixed.ABSOLUTE_PAIRS)), lambda v: v > 0))
    return T.rounded(h * T.bound(flags, count))


def rci_segments(c: Column, sents: Column) -> Column:
    """Paragraphs, or sentences above 15 characters, or any pieces above 10, whichever first gives two."""
    paras, long = T.paragraphs(c), F.filter(sents, lambda s: F.length(s) > 15)
    rest = F.filter(F.transform(F.split(c, r"(?<=[.!?])\s+"), T.strip), lambda s: F.length(s) > 10)
    return F.when(F.size(paras) >= 2, paras).when(F.size(long) >= 2, long).otherwise(rest)


def attachment(low: Column) -> dict[str, Column]:
    return {style: T.total_occurrences(low, ms) for style, ms in fixed.ATTACHMENT.items()}


#: Patterns of the extractors, in the order of :func:`extractor_counts`.
EXTRACTED = list(dict.fromkeys([*(p for by in (fixed.HORSEMAN_PATTERNS, fixed.RED_FLAGS) for ps in by.values() for p in ps), *fixed.RUMINATION_MARKERS, *fixed.RULE_PATTERNS]))


def extractor_counts(low: Column) -> Column:
    """Numbers of matches of all patterns that the extractors share, by one pass; :func:`counts_by_pattern` looks into it."""
    return match_counts(low, EXTRACTED)


def counts_by_pattern(found: Column) -> dict[str, Column]:
    return {p: found[k] for k, p in enumerate(EXTRACTED)}


def rumination(low: Column, toks: Column, paras: Column, found: dict[str, Column] | None = None) -> dict[str, Column]:
    """Index (per thousand words), patterns present, and themes in more than half of the paragraphs.

    Here as below ``found`` holds numbers of matches that are already counted.
    """
    hits = sum(((found[p] > 0 if found else low.rlike(p)).cast("int") for p in fixed.RUMINATION_MARKERS), F.lit(0))
    # a paragraph without the letters of a theme has no such token
    bags = F.transform(paras, lambda p: F.when(T.bound(F.lower(p), lambda x: T.n_contained(x, fixed.RUMINATION_THEMES)) > 0, T.tokens(p)).otherwise(F.array().cast("array<string>")))
    often = F.transform(F.array(bags), lambda b: sum(((F.size(F.filter(b, lambda p: F.array_contains(p, th))) > F.size(b) / 2).cast("int") for th in fixed.RUMINATION_THEMES), F.lit(0)))[0]
    return {"ri": T.rounded(hits / F.greatest(F.lit(1), F.size(toks)) * (1 + often) * 1000, 3), "hits": hits, "repeats": often}


def rasp(low: Column) -> dict[str, Column]:
    return {name: T.rounded(F.least(F.lit(1.0), T.n_contained(low, ss) / (len(ss) * 0.4))) for name, ss in fixed.ARCHETYPES.items()}


def gottman(low: Column, tags: Column, n_sents: Column, found: dict[str, Column] | None = None) -> dict[str, Column]:
    """Counts of the four behaviours from lexicon tags and patterns, and their weighted load per sentence."""
    counts = {h: F.size(F.filter(tags, lambda t: t == h)) + sum((found[p] if found else T.matches(low, p) for p in ps), F.lit(0)) for h, ps in fixed.HORSEMAN_PATTERNS.items()}  # noqa: B023
    return counts | {"load": T.rounded(sum((fixed.HORSEMAN_WEIGHTS[h] * n for h, n in counts.items()), F.lit(0.0)) / F.greatest(F.lit(1), n_sents))}


def phase_hits(paras: Column, markers: dict[str, list[str]]) -> dict[str, Column]:
    """For each phase the paragraphs (from 1) that hold a marker, with the markers."""
    low = F.transform(paras, F.lower)
    return {k: F.filter(F.transform(low, lambda p, i: F.struct((i + 1).alias("para"), T.contained(p, ms).alias("markers"))), lambda x: F.size(x["markers"]) > 0) for k, ms in markers.items()}  # noqa: B023


def dissolution(paras: Column) -> Column:
    """Struct (phase, para): the last phase with a hit, and its last paragraph."""
    hits, out = phase_hits(paras, fixed.PHASE_MARKERS), F.struct(F.lit("unknown").alias("phase"), F.lit(0).alias("para"))
    for k, v in hits.items():
        out = F.when(F.size(v) > 0, F.struct(F.lit(k).alias("phase"), F.array_max(v["para"]).alias("para"))).otherwise(out)
    return out


def blame(sents: Column) -> dict[str, Column]:
    """Sentences that blame oneself, and that blame the other."""
    own, other = (F.filter(sents, lambda s: T.any_match(F.lower(s), ps)) for ps in (fixed.SELF_BLAME_PATTERNS, fixed.OTHER_BLAME_PATTERNS))  # noqa: B023
    total = F.greatest(F.lit(1), F.size(own) + F.size(other))
    cut = lambda a: F.transform(F.slice(a, 1, 5), lambda s: F.substring(s, 1, 80))
    return {"self": F.size(own), "other": F.size(other), "self_pct": T.rounded(F.size(own) / total * 100, 1), "other_pct": T.rounded(F.size(other) / total * 100, 1), "self_evidence": cut(own), "other_evidence": cut(other)}


def blame_band(own: Column, other: Column) -> Column:
    """Whether more than 70 % of the blaming sentences blame oneself or the other; null without any."""
    total = own + other
    share = lambda n: T.rounded(n / total * 100, 1)
    return F.when(total > 0, F.when(share(own) > 70, "self").when(share(other) > 70, "other").otherwise("balanced"))


def pronoun_band(i: Column, you: Column, we: Column) -> Column:
    """Whose pronouns dominate: self or other (more than twice the other's), else partnership (more we than I), else none."""
    return F.when(i > you * 2, "self").when(you > i * 2, "other").when(we > i, "partnership").otherwise("none")


def tense(paras: Column) -> Column:
    """Struct (past, present, future): means of the paragraphs' rounded percentages."""
    names = ("past", "present", "future")
    low = F.transform(paras, lambda p: F.struct(*(T.matches(F.lower(p), m).alias(k) for k, m in zip(names, (fixed.PAST_MARKERS, fixed.PRESENT_MARKERS, fixed.FUTURE_MARKERS), strict=True))))
    share = F.transform(low, lambda x: F.struct(*(T.rounded(x[k] / F.greatest(F.lit(1), x["past"] + x["present"] + x["future"]) * 100, 1).alias(k) for k in names)))
    return F.transform(F.array(share), lambda s: F.struct(*(T.rounded(mean_of_rounded(s[k], 1), 1).alias(k) for k in names)))[0]


def power(low: Column, toks: Column) -> dict[str, Column]:
    count = lambda ws: T.among(toks, ws)
    top = lambda ws: F.slice(F.filter(F.array(*(F.struct(F.lit(w).alias("word"), T.among(toks, [w]).alias("n")) for w in ws)), lambda x: x["n"] > 0), 1, 5)
    out = {"control": count(fixed.CONTROL_VERBS), "sacrifice": count(fixed.SACRIFICE_VERBS), "initiation": count(fixed.INITIATE_VERBS), "apology": T.total_occurrences(low, fixed.APOLOGY_WORDS)}
    out |= {"control_top": top(fixed.CONTROL_VERBS), "i": count(["i", "me", "my"]), "you": count(["you", "your"]), "we": count(["we", "us", "our"])}
    return out


DATES = r"\b(\d{1,2}[/\-]\d{1,2}(?:[/\-]\d{2,4})?|\b(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2}(?:,\s*\d{4})?)\b"


def names_of(c: Column) -> Column:
    """Capitalised words of three letters or more that are not common openers, in order."""
    return F.filter(F.regexp_extract_all(c, F.lit(r"\b([A-Z][a-z]{2,})\b"), F.lit(1)), lambda n: ~n.isin(fixed.COMMON_CAPS))


def dates_of(c: Column) -> Column:
    return F.slice(F.regexp_extract_all(c, F.lit(DATES), F.lit(1)), 1, 10)


def coherence(sents: Column) -> Column:
    """Mean Jaccard of the content sets of neighbouring sentences; null below three sentences."""
    sets = F.transform(sents, lambda s: F.array_distinct(T.content_words(T.tokens(s))))
    pairs = F.transform(F.array(sets), lambda x: F.zip_with(F.slice(x, 1, F.size(x) - 1), F.slice(x, 2, F.size(x) - 1), T.jaccard_of_sets))[0]
    return F.when(F.size(sents) >= 3, T.rounded(mean(pairs)))


def proxy(toks: Column, name: str) -> Column:
    """Listed tokens for less those against, over all tokens; entries of several words never match."""
    pos, neg = fixed.CONSTRUCT_PROXIES[name]
    return (T.among(toks, pos) - (T.among(toks, neg) if neg else F.lit(0))) / F.greatest(F.lit(1), F.size(toks))


def red_flags(low: Column, found: dict[str, Column] | None = None) -> dict[str, Column]:
    return {k: sum((found[p] if found else T.matches(low, p) for p in ps), F.lit(0)) for k, ps in fixed.RED_FLAGS.items()}


def rules_fired(low: Column, found: dict[str, Column] | None = None) -> Column:
    """Numbers (from 1) of the advice rules whose pattern occurs."""
    return F.array_compact(F.array(*(F.when(found[p] > 0 if found else low.rlike(p), F.lit(k)) for k, p in enumerate(fixed.RULE_PATTERNS, 1))))


def rule_messages(low: Column, messages: list[str], sensitivity: str = "honest") -> Column:
    """What the rules that fire have to say, from a list of one message a rule: mild ones end at the first full stop, brutal ones ask to be read again."""
    if sensitivity not in ("mild", "honest", "brutal"):
        raise ValueError("sensitivity is mild, honest or brutal")
    said = {"mild": lambda t: t.split(".")[0] + ".", "honest": lambda t: t, "brutal": lambda t: t + " Read that again."}[sensitivity]
    return F.array_compact(F.array(*(F.when(low.rlike(p), F.lit(said(m))) for p, m in zip(fixed.RULE_PATTERNS, messages, strict=True))))


#: How much each reason to distrust a document's scores weighs.
SEVERITY = {"short": "high", "low_coverage": "high", "sarcasm": "medium", "negation_scope": "medium", "few_paragraphs": "low", "non_ascii": "low"}


def failure_modes(c: Column, n_words: Column, coverage: Column, sarcastic: Column, paras: Column) -> Column:
    """Reasons to distrust a document's scores, with their severities as in ``SEVERITY``."""
    flags = {
        "short": n_words < 100, "low_coverage": coverage < 0.08, "sarcasm": sarcastic > 0, "negation_scope": F.lower(c).rlike(fixed.LONG_NEGATION),
        "few_paragraphs": F.size(paras) < 3, "non_ascii": c.rlike(r"[^\x00-\x7F]"),
    }
    return F.array_compact(F.array(*(F.when(v, F.lit(k)) for k, v in flags.items())))


#: Presentation bands: edges from the top, each with the label above it, and the label below all.
BANDS = {
    "sentiment": ([(0.3, "very positive"), (0.05, "positive"), (-0.05, "neutral"), (-0.3, "negative")], "very negative"),
    "teg": ([(0.3, "high"), (0.15, "moderate")], "low"), "gase": ([(0.5, "healthy"), (0.2, "moderate"), (-0.1, "strained")], "distressed"),
    "pti": ([(0.5, "strong self"), (0.2, "self"), (-0.2, "balanced"), (-0.5, "other")], "strong other"), "rci": ([(0.4, "high"), (0.2, "moderate")], "low"),
    "ri": ([(5, "high"), (2, "moderate")], "low"), "gottman": ([(0.5, "high"), (0.2, "moderate")], "low"), "exit": ([(5, "strong"), (2, "moderate")], "weak"),
    "vads": ([(0.6, "deep"), (0.35, "mid"), (0.15, "surface")], "none"), "ties": ([(0.5, "high"), (0.1, "moderate")], "low"), "lewi_drop": ([(0.1, "decline"), (0.03, "slight decline"), (-0.03, "stable"), (-0.1, "slight rise")], "rise"),
    "cd_index": ([(0.5, "high"), (0.2, "moderate")], "low"), "nspl": ([(0.6, "integrated"), (0.4, "mixed")], "fragmented"), "effect": ([(0.8, "large"), (0.5, "medium"), (0.2, "small")], "negligible"),
    "kappa": ([(0.8, "almost perfect"), (0.6, "substantial"), (0.4, "moderate"), (0.2, "fair")], "poor"), "alpha": ([(0.8, "reliable"), (0.667, "tentative")], "unreliable"), "icc": ([(0.9, "excellent"), (0.75, "good"), (0.5, "moderate")], "poor"),
}
