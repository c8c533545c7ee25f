"""Sentence and document scores as Columns over arrays: no shuffle, no Python.

Tokens are matched against a lexicon by hash set; weights and modifiers are looked up for hits only. Nested
``transform`` calls bind each intermediate value once, so that nothing is computed twice inside a lambda.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomline.functions import fixed
from loomline.functions import text as T
from loomline.functions.lexicon import Lexicon

NO_STRINGS = "array<string>"


def _strings(values) -> Column:
    return F.array(*map(F.lit, values)).cast(NO_STRINGS)


def _map(pairs, kind: str) -> Column:
    flat = [x for k, v in pairs for x in (F.lit(k), v)]
    return F.create_map(*flat) if flat else F.create_map().cast(f"map<string,{kind}>")


def score_sentences(sents: Column, lex: Lexicon) -> Column:
    """Array of struct (compound, emotions, horsemen, sarcasm), one for each string of ``sents``.

    A lexicon word scores s * i times a modifier from the two tokens before it: the largest intensifier found as a
    substring of them, then the least diminisher. It is reversed and weakened if one of the four tokens
    before is a negator. A phrase scores once a sentence. A sarcasm pattern turns positive scores negative.
    The sum is squashed to (-1, 1) and rounded to 4 places.
    """
    words, phrases = lex.words, lex.phrases
    weight = _map([(e.term, F.lit(float(e.weight))) for e in words], "double")
    emotion = _map([(e.term, _strings(e.emotions)) for e in words if e.emotions], NO_STRINGS)
    horse = _map([(e.term, F.lit(e.horseman)) for e in words if e.horseman], "string")
    terms, negators = [e.term for e in words], list(lex.negators)
    # two levels first: the sentence in lower case with its tokens, then its hits
    base = F.transform(sents, lambda s: F.struct(F.lower(s).alias("low"), T.tokens(s).alias("toks")))

    def hits(x: Column) -> Column:
        at = F.array_compact(F.transform(x["toks"], lambda t, i: F.when(t.isin(terms), F.struct(t.alias("t"), i.alias("i"))))) if terms else F.array().cast("array<struct<t:string,i:int>>")
        return F.transform(
            at,
            lambda h: F.struct(
                h["t"].alias("t"),
                F.array_join(F.slice(x["toks"], F.greatest(h["i"] - 1, F.lit(1)), F.least(h["i"], F.lit(2))), " ").alias("before"),
                (F.exists(F.slice(x["toks"], F.greatest(h["i"] - 3, F.lit(1)), F.least(h["i"], F.lit(4))), lambda t: t.isin(negators)) if negators else F.lit(False)).alias("negated"),
            ),
        )

    def modifier(before: Column) -> Column:
        up = F.greatest(F.lit(1.0), *(F.when(before.contains(w), F.lit(float(m))).otherwise(1.0) for w, m in lex.intensifiers.items())) if lex.intensifiers else F.lit(1.0)
        return F.least(up, *(F.when(before.contains(w), F.lit(float(m))) for w, m in lex.diminishers.items())) if lex.diminishers else up

    # one constant, so that a sentence is searched for each phrase once
    listed = F.array(*(F.struct(F.lit(p.term).alias("t"), F.lit(float(p.weight)).alias("w"), _strings(p.emotions).alias("e"), F.lit(p.horseman).cast("string").alias("h")) for p in phrases)).cast("array<struct<t:string,w:double,e:array<string>,h:string>>")
    found = F.transform(base, lambda x: F.struct(x["low"].alias("low"), hits(x).alias("hits"), F.filter(listed, lambda p: F.contains(x["low"], p["t"])).alias("said")))

    def parts(x: Column) -> Column:
        own = F.transform(x["hits"], lambda h: F.element_at(weight, h["t"]) * modifier(h["before"]) * F.when(h["negated"], -0.7).otherwise(1.0))
        extra = F.transform(x["said"], lambda p: p["w"])
        emo = F.flatten(F.concat(F.transform(x["hits"], lambda h: F.coalesce(F.try_element_at(emotion, h["t"]), F.array().cast(NO_STRINGS))), F.transform(x["said"], lambda p: p["e"])))
        hor = F.array_compact(F.concat(F.transform(x["hits"], lambda h: F.try_element_at(horse, h["t"])), F.transform(x["said"], lambda p: p["h"])))
        sarcastic = T.any_match(x["low"], lex.sarcasm)
        return F.struct(F.concat(own, extra).alias("scores"), emo.alias("emotions"), hor.alias("horsemen"), sarcastic.alias("sarcasm"))

    def squash(x: Column) -> Column:
        total = F.aggregate(x["scores"], F.lit(0.0), lambda a, s: a + F.when(x["sarcasm"] & (s > 0), -s).otherwise(s))
        return F.struct(total.alias("sum"), x["emotions"].alias("emotions"), x["horsemen"].alias("horsemen"), x["sarcasm"].alias("sarcasm"))

    sums = F.transform(F.transform(found, parts), squash)
    return F.transform(sums, lambda x: F.struct(T.rounded(x["sum"] / F.sqrt(x["sum"] * x["sum"] + 15)).alias("compound"), x["emotions"].alias("emotions"), x["horsemen"].alias("horsemen"), x["sarcasm"].alias("sarcasm")))


def mean(values: Column) -> Column:
    """Mean of an array of numbers, left to right; 0 of none."""
    return F.coalesce(F.try_divide(F.aggregate(values, F.lit(0.0), lambda a, x: a + x), F.size(values)), F.lit(0.0))


def mean_of_rounded(values: Column, places: int = 4) -> Column:
    """Mean of numbers that are rounded already, exact: summed as whole multiples of their last place; 0 of none."""
    k = float(10**places)
    whole = F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + F.round(x * k).cast("long"))
    return F.coalesce(F.try_divide(whole.cast("double"), F.size(values)) / k, F.lit(0.0))


def counts_of(values: Column) -> Column:
    """Counts of the distinct strings of an array, in order of first occurrence."""
    return F.transform(F.array_distinct(values), lambda v: F.size(F.filter(values, lambda x: x == v)))


def vader_like(c: Column) -> Column:
    """Seed words, reversed if one of six negators is among the three tokens before; squashed."""
    seeds, neg = fixed.VADER_SEEDS, ["not", "never", "no", "neither", "nor", "nothing"]
    weight = _map([(w, F.lit(float(s))) for w, s in seeds.items()], "double")

    def per(toks: Column) -> Column:
        hit = F.array_compact(F.transform(toks, lambda t, i: F.when(t.isin(list(seeds)), F.struct(t.alias("t"), i.alias("i")))))
        # weights have one place and the factor two, so the sum is exact in thousandths
        negated = lambda h: F.exists(F.slice(toks, F.greatest(h["i"] - 2, F.lit(1)), F.least(h["i"], F.lit(3))), lambda t: t.isin(neg))
        return F.aggregate(hit, F.lit(0).cast("long"), lambda a, h: a + F.round(F.element_at(weight, h["t"]) * F.when(negated(h), -0.74).otherwise(1.0) * 1000).cast("long")) / 1000.0

    total = F.transform(F.array(T.plain_tokens(c, True)), per)
    return F.element_at(F.transform(total, lambda s: T.rounded(s / F.sqrt(s * s + 15))), 1)


def nrc_like(c: Column) -> Column:
    """Struct (compound, one rate per emotion) of seed words over all tokens."""
    seeds = fixed.NRC_SEEDS
    of = {e: [w for w, es in seeds.items() if e in es] for e in (*fixed.NRC_EMOTIONS, "positive", "negative")}

    def per(x: Column) -> Column:
        n = F.greatest(F.lit(1), F.size(x["toks"]))
        rate = lambda e: T.among(x["hits"], of[e]) / n
        return F.struct(T.rounded(rate("positive") - rate("negative")).alias("compound"), *(T.rounded(rate(e)).alias(e) for e in fixed.NRC_EMOTIONS))

    base = F.transform(F.array(T.plain_tokens(c)), lambda t: F.struct(t.alias("toks"), F.filter(t, lambda w: w.isin(list(seeds))).alias("hits")))
    return F.element_at(F.transform(base, per), 1)


def liwc_like(c: Column) -> Column:
    """Struct (compound, rate per 100 words of each category); the compound uses the rounded rates."""
    cats = fixed.LIWC_CATEGORIES
    name = lambda k: k.lower().replace(" ", "_")
    base = F.transform(F.array(T.plain_tokens(c)), lambda t: F.struct(F.size(t).alias("n"), F.filter(t, lambda w: w.isin(sorted({w for ws in cats.values() for w in ws}))).alias("hits")))
    rates = F.transform(base, lambda x: F.struct(*(T.rounded(100 * T.among(x["hits"], ws) / F.greatest(F.lit(1), x["n"]), 2).alias(name(k)) for k, ws in cats.items())))

    def per(r: Column) -> Column:
        p, n = r["positive_emotion"], r["negative_emotion"]
        return F.struct(F.when(p + n > 0, T.rounded((p - n) / F.greatest(F.lit(1.0), p + n + 0.001))).otherwise(0.0).alias("compound"), *(r[name(k)].alias(name(k)) for k in cats))

    return F.element_at(F.transform(rates, per), 1)


def band(x: Column, edges: list[tuple[float, str]], rest: str) -> Column:
    """Label of the first edge that x lies above, else ``rest``."""
    out = None
    for edge, name in edges:
        out = F.when(x > edge, name) if out is None else out.when(x > edge, name)
    return out.otherwise(rest)
