"""Text as Columns: tokens, sentences, paragraphs, counts, cleaning, weak labels. All of it runs in the JVM."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomline.functions import fixed

SENTENCE_GAP, SENTENCE_LINE = r"(?<=[.!?])\s+(?=[A-Z])", r"(?<=[.!?])\s*\n"
LABELS = ("pos", "neg", "neu")


def rounded(x: Column, places: int = 4) -> Column:
    """Half-up on the binary value, and never minus zero: the same IEEE steps in any engine."""
    k = float(10**places)
    return F.floor(x * k + 0.5) / k + 0.0


def mean_of_places(x: Column, places: int = 4) -> Column:
    """Aggregate mean of numbers rounded to ``places``, from the sum of whole multiples of the last place: no order of rows changes it."""
    k = float(10**places)
    return F.sum(F.round(x * k).cast("long")).cast("double") / F.count(x) / k


#: What counts as white space at the ends of a text.
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def bound(value: Column, f) -> Column:
    """f(value) with value computed once, however often f uses it."""
    return F.transform(F.array(value), f)[0]


def tokens(c: Column) -> Column:
    """Lower-cased runs of a-z and apostrophes between Unicode word boundaries."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"(?U)\b[a-z']+\b"), F.lit(0))


def plain_tokens(c: Column, apostrophes: bool = False) -> Column:
    """Runs of a-z (and apostrophes) anywhere, also inside accented words."""
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z']+" if apostrophes else "[a-z]+"), F.lit(0))


def sentences(c: Column) -> Column:
    """Pieces that end in . ! or ? before white space and a capital, or before a line end. Never empty."""

    def cut(x: Column) -> Column:
        parts = F.flatten(F.transform(F.split(x, SENTENCE_GAP), lambda s: F.split(s, SENTENCE_LINE)))
        return bound(F.filter(F.transform(parts, strip), lambda s: s != ""), lambda kept: F.when(F.size(kept) > 0, kept).otherwise(F.array(x)))

    return bound(strip(c), cut)


def paragraphs(c: Column) -> Column:
    """Pieces between blank lines; may be none."""
    return F.filter(F.transform(F.split(c, r"\n\s*\n"), strip), lambda p: p != "")


def literal_paragraphs(c: Column) -> Column:
    """Pieces between two newlines in a row, stripped, without empty ones."""
    return F.filter(F.transform(F.split(c, "\n\n"), strip), lambda p: p != "")


def syllables(word: Column) -> Column:
    """Runs of vowels without a trailing es, ed or e; 1 for words of up to three letters."""
    stem = F.regexp_replace(word, "(?:es|ed|e)$", "")
    return F.when(F.length(word) <= 3, 1).otherwise(F.greatest(F.lit(1), F.regexp_count(stem, F.lit("[aeiou]+"))))


def total_syllables(toks: Column) -> Column:
    """Sum of :func:`syllables` over an array of tokens, from the line of its long words: their runs of vowels, and one for each word that has none."""

    def of(long: Column) -> Column:
        stems = F.regexp_replace(F.array_join(long, " "), "(?:es|ed|e)(?= |$)", "")
        return bound(stems, lambda line: F.regexp_count(line, F.lit("[aeiou]+")) + F.regexp_count(line, F.lit("(?<![^ ])[^aeiou ]+(?![^ ])"))) - F.size(long)

    return F.size(toks) + bound(F.filter(toks, lambda t: F.length(t) > 3), of)


def ngrams(toks: Column, n: int) -> Column:
    """Sliding windows of n tokens, joined by a blank."""
    return F.when(F.size(toks) >= n, F.transform(F.sequence(F.lit(1), F.size(toks) - (n - 1)), lambda i: F.array_join(F.slice(toks, i, n), " "))).otherwise(F.array().cast("array<string>"))


def is_stop(t: Column) -> Column:
    return t.isin(fixed.STOP_WORDS)


def content_words(toks: Column, least: int = 3) -> Column:
    """Tokens that are neither stop words nor shorter than ``least`` nor hold an apostrophe."""
    return F.filter(toks, lambda t: ~is_stop(t) & (F.length(t) >= least) & ~t.contains("'"))


def blank_words(c: Column) -> Column:
    """Number of pieces between white space."""
    return F.size(F.filter(F.split(c, r"(?U)\s+"), lambda w: w != ""))


def word_count(c: Column) -> Column:
    """Number of runs of word characters."""
    return F.regexp_count(c, F.lit(r"(?U)\b\w+\b"))


def among(toks: Column, words: Sequence[str]) -> Column:
    """How many of the tokens are in a word list."""
    return F.size(F.filter(toks, lambda t: t.isin(list(words))))


def occurrences(c: Column, needle: str) -> Column:
    """Non-overlapping occurrences of a literal string, inside words too."""
    return ((F.length(c) - F.length(F.replace(c, F.lit(needle), F.lit("")))) / len(needle)).cast("int")


def constants(words: Sequence[str]) -> Column:
    """A constant array of strings as one small expression (folded before the query runs)."""
    return F.split(F.lit("\x1f".join(words)), "\x1f")


def total_occurrences(c: Column, needles: Sequence[str]) -> Column:
    """Occurrences of each needle, summed. Only needles that occur are counted; the others cost a search, not a copy of the text."""
    times = lambda x: F.aggregate(contained(x, needles), F.lit(0), lambda a, n: a + ((F.length(x) - F.length(F.replace(x, n, F.lit("")))) / F.length(n)).cast("int"))
    return bound(c, times)


def contained(c: Column, needles: Sequence[str]) -> Column:
    """The needles that occur, in their order."""
    return F.filter(constants(needles), lambda n: F.contains(c, n))


def n_contained(c: Column, needles: Sequence[str]) -> Column:
    return F.size(contained(c, needles))


def _alternatives(inner: str) -> list[str]:
    """The parts of a pattern between its outermost bars."""
    parts, depth, escaped = [""], 0, False
    for ch in inner:
        depth += 0 if escaped else (ch in "([") - (ch in ")]")
        if ch == "|" and depth == 0 and not escaped:
            parts.append("")
        else:
            parts[-1] += ch
        escaped = ch == "\\" and not escaped
    return parts


def guarded(pattern: str) -> str:
    """The same pattern in a form that fails sooner; matches are the same, in number and place.

    ``\\bword\\b`` looks for the word first. ``\\b(one|two|...)`` asks for one of the first letters before the boundary, and
    tries only the alternatives of that letter, in their order. Any other pattern is returned as it is.
    """
    word = re.fullmatch(r"\\b([a-z](?:[a-z' ]*[a-z])?)\\b", pattern)
    if word:
        return f"{word[1]}(?<=\\b{word[1]})\\b"
    if not pattern.startswith(r"\b(") or pattern.startswith(r"\b(?") or re.search(r"\\[1-9QE]|\(\?[^:=!]", pattern):
        return pattern
    depth, end, escaped, of_class = 0, None, False, False
    for at, ch in enumerate(pattern):
        if not escaped:
            of_class = ch == "[" or of_class and ch != "]"
            depth += 0 if of_class else (ch == "(") - (ch == ")")
            if ch == ")" and depth == 0 and not of_class:
                end = at
                break
        escaped = ch == "\\" and not escaped
    parts = _alternatives(pattern[3:end]) if end and pattern[end + 1 : end + 2] not in tuple("?*+{") else []
    if not parts or not all(re.match(r"[a-z0-9](?![?*+{])", x) for x in parts):
        return pattern
    by: dict[str, list[str]] = {}
    for x in parts:
        by.setdefault(x[0], []).append(x[1:])
    return f"(?=[{''.join(by)}])\\b(?:{'|'.join(f'{k}(?:{"|".join(v)})' for k, v in by.items())})" + pattern[end + 1 :]


def matches(c: Column, pattern: str, ignore_case: bool = False) -> Column:
    """Number of matches of a pattern."""
    return F.regexp_count(c, F.lit("(?iu)" + pattern if ignore_case else guarded(pattern)))


def any_match(c: Column, patterns: Sequence[str]) -> Column:
    """Whether one of the patterns occurs. Those that begin with a word's first letter are one pattern, so that the text is read once."""
    words = [p for p in patterns if re.match(r"\\b[a-z](?![?*+{])", p) and not re.search(r"\\[1-9QE]|\(\?[^:=!]", p) and len(_alternatives(p)) == 1]
    one = [guarded(rf"\b({'|'.join(p[2:] for p in words)})")] if words else []
    return reduce(lambda a, p: a | c.rlike(p), one + [p for p in patterns if p not in words], F.lit(False))


def first_largest(pairs: Sequence[tuple[str, Column]]) -> Column:
    """Name of the largest value, the first-listed of equal ones."""
    best = F.array_max(F.array(*(F.struct(v.cast("double").alias("v"), F.lit(-i).alias("o"), F.lit(n).alias("n")) for i, (n, v) in enumerate(pairs))))
    return best["n"]


def clean_text(c: Column) -> Column:
    """Strip markup of a post: links, emphasis, headings, entities, runs of newlines; deleted posts become empty."""
    x = F.regexp_replace(c, r"http\S+", "")
    for pattern, put in ((r"\*+([^*]+)\*+", "$1"), (r"#+\s*", ""), (r"\[([^\]]+)\]\([^)]+\)", "$1"), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), (r"\n{3,}", "\n\n")):
        x = F.regexp_replace(x, pattern, put)
    return F.when(c.isNull() | c.isin("[deleted]", "[removed]", ""), "").otherwise(strip(x))


def title_and_body(title: Column, body: Column) -> Column:
    return F.when(F.coalesce(body, F.lit("")) != "", F.concat(title, F.lit(". "), body)).otherwise(title)


def label(score: Column, edge: float = 0.05) -> Column:
    """pos, neg or neu by a score; null counts as 0."""
    s = F.coalesce(score, F.lit(0.0))
    return F.when(s > edge, "pos").when(s < -edge, "neg").otherwise("neu")


def weak_sentiment(c: Column, wide: bool = False) -> Column:
    """Label by counts of listed words, one side 1.5 times the other. A two-word entry never matches a token."""
    toks = plain_tokens(c)
    p = among(toks, fixed.WIDE_POS if wide else fixed.WEAK_POS)
    n = among(toks, fixed.WIDE_NEG if wide else fixed.WEAK_NEG)
    return F.when(p > n * 1.5, "pos").when(n > p * 1.5, "neg").otherwise("neu")


def weak_emotion(c: Column, wide: bool = False) -> Column:
    """Emotion whose words occur most, the first-listed of equal ones; none without an occurrence."""
    low = F.lower(c)
    counts = [(e, total_occurrences(low, ws)) for e, ws in (fixed.WIDE_EMOTIONS if wide else fixed.WEAK_EMOTIONS).items()]
    return F.when(F.greatest(*(n for _, n in counts)) > 0, first_largest(counts)).otherwise("none")


def confident_label(score: Column) -> Column:
    """pos above 0.35, neg below -0.35, neu within 0.05 of zero, else null (the row is dropped)."""
    return F.when(score > 0.35, "pos").when(score < -0.35, "neg").when(F.abs(score) < 0.05, "neu")


def entropy(counts: Column) -> Column:
    """Shannon entropy in bits of an array of positive counts; 0 for none."""
    share = lambda x: F.try_divide(x["n"], x["total"])
    # counts and their total are computed once, not once an element
    each = lambda ns: bound(F.aggregate(ns, F.lit(0.0), lambda a, n: a + n), lambda total: F.transform(ns, lambda n: F.struct(n.alias("n"), total.alias("total"))))
    return bound(bound(counts, each), lambda xs: F.coalesce(F.aggregate(xs, F.lit(0.0), lambda a, x: a - F.when(x["n"] > 0, bound(share(x), lambda p: p * F.log2(p))).otherwise(0.0)), F.lit(0.0)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if both are empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def jaccard_of_sets(a: Column, b: Column) -> Column:
    """The same of two arrays without repeated elements, whose union need not be made."""
    return bound(F.size(F.array_intersect(a, b)), lambda n: F.coalesce(F.try_divide(n, F.size(a) + F.size(b) - n), F.lit(0.0)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers, 0 if a norm is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))
