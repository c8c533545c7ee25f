import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomline.functions import text as T


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("text", "tokens"),
    [("Don't stop, I'm late!", ["don't", "stop", "i'm", "late"]), ("", []), ("café naïve", []), ("a1 b2 c", ["c"]), ("''hi''", ["hi"]), ("x_y z", ["z"]), ("tab\tnew\nline", ["tab", "new", "line"])],
)
def test_tokens(spark, text, tokens):
    import re

    assert one(spark, text, T.tokens) == re.findall(r"\b[a-z']+\b", text.lower()) == tokens


def test_sentences(spark):
    cases = {
        "": [""], "   ": [""], "One. Two! three? Four": ["One.", "Two! three?", "Four"], "End.\nnext line": ["End.", "next line"], "No end": ["No end"], "A.  B.\n\nC": ["A.", "B.", "C"], "Mr. Smith went. he left.": ["Mr.", "Smith went. he left."],
    }
    for text, want in cases.items():
        assert one(spark, text, T.sentences) == want, text


def test_sentences_as_two_splits(spark):
    import re

    texts = ["x. Y z! \n A", "Hello there.\nWorld? Yes.\n\nNo", "a.b.c D", "…. E", " . A ", "!? B\x85 C. D"]
    for text in texts:
        raw = re.split(r"(?<=[.!?])\s+(?=[A-Z])", text.strip())
        want = [x.strip() for s in raw for x in re.split(r"(?<=[.!?])\s*\n", s) if x.strip()] or [text.strip()]
        assert one(spark, text, T.sentences) == want


def test_paragraphs(spark):
    assert one(spark, "a\n\nb\n \n c \n\n\n", T.paragraphs) == ["a", "b", "c"] and one(spark, "  ", T.paragraphs) == []
    assert one(spark, "a\n \nb\n\nc", T.literal_paragraphs) == ["a\n \nb", "c"]


def test_syllables(spark):
    for word, n in {"a": 1, "the": 1, "love": 1, "beautiful": 3, "created": 1, "boxes": 1, "rhythm": 1, "queue": 1, "idea": 2}.items():
        assert one(spark, word, T.syllables) == n, word


def test_clean_text_order_of_steps(spark):
    assert one(spark, "[t](http://x.y) **b** ## H &amp;lt; \n\n\n\nz", T.clean_text) == "[t]( b H < \n\nz"
    assert [one(spark, v, T.clean_text) for v in ("[deleted]", "", None)] == ["", "", ""]


def test_counts(spark):
    assert one(spark, "banana anan", lambda c: T.occurrences(c, "an")) == "banana anan".count("an")
    assert one(spark, "aaaa", lambda c: T.occurrences(c, "aa")) == 2
    assert one(spark, "  a\tb c ", T.blank_words) == 3 and one(spark, "", T.blank_words) == 0
    assert one(spark, ["a", "b", "c"], lambda c: T.ngrams(c, 2), "array<string>") == ["a b", "b c"] and one(spark, ["a"], lambda c: T.ngrams(c, 2), "array<string>") == []


def test_labels(spark):
    assert [one(spark, v, T.label, "double") for v in (0.06, 0.05, -0.05, -0.051, None)] == ["pos", "neu", "neu", "neg", "neu"]
    assert [one(spark, v, T.confident_label, "double") for v in (0.4, 0.2, 0.0, -0.36)] == ["pos", None, "neu", "neg"]
    assert one(spark, "happy happy sad", T.weak_sentiment) == "pos" and one(spark, "happy sad", T.weak_sentiment) == "neu"
    assert one(spark, "sad and scared", T.weak_emotion) == "sadness" and one(spark, "stone", T.weak_emotion) == "none"


def test_entropy_jaccard_cosine(spark):
    assert one(spark, [1.0, 1.0], T.entropy, "array<double>") == 1.0 and one(spark, [], T.entropy, "array<double>") == 0.0
    row = spark.createDataFrame([(["a", "b"], ["b", "c"], [1.0, 0.0], [0.0, 0.0])], "a array<string>, b array<string>, u array<double>, v array<double>")
    assert row.select(T.jaccard(F.col("a"), F.col("b"))).first()[0] == pytest.approx(1 / 3) and row.select(T.cosine(F.col("u"), F.col("v"))).first()[0] == 0


@settings(max_examples=25, deadline=None)
@given(st.lists(st.floats(-1, 1), min_size=1, max_size=30))
def test_rounding_never_gives_minus_zero(spark, values):
    got = spark.createDataFrame([(v,) for v in values], "x double").select(T.rounded(F.col("x")).alias("y")).collect()
    assert all(abs(r["y"] - v) <= 5.0001e-5 and str(r["y"]) != "-0.0" for r, v in zip(got, values, strict=True))


def test_guarded_patterns_match_alike(spark):
    import random

    from loomline.functions import fixed

    ps = [p for v in fixed.DISTORTIONS.values() for p in v] + [p.lower() for _, p in fixed.DISCLOSURE_TIERS.values()] + [p for a in fixed.ABSOLUTE_PAIRS for p in a] + [p for v in (*fixed.HORSEMAN_PATTERNS.values(), *fixed.RED_FLAGS.values()) for p in v]
    ps += [r"\b(a|ab|abc|b(c|d)?|b[|)]x)\b", r"\b(a?|b)", r"\b(x\|y|xz)", r"\b(ab|ac)+", "plain", r"\bit's\b", r"\b(?i)Ab\b"]
    ps = [*dict.fromkeys(ps)]
    assert sum(T.guarded(p) != p for p in ps) > 60 and T.guarded(r"\b(a?|b)") == r"\b(a?|b)"
    rng, pieces = random.Random(3), sorted({w for p in ps for w in re.findall(r"[a-z']+", p)})
    texts = ["", "ab abc bc b|x b)x x|y xz abac it's ánever neveré never_ever"] + ["".join(rng.choice(pieces) + rng.choice([" ", " ", " ", ".", "", "é", "_", "\n", "-"]) for _ in range(120)) for _ in range(150)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(4)
    both = df.select(*(F.array(F.regexp_extract_all("t", F.lit(p), F.lit(0)), F.regexp_extract_all("t", F.lit(T.guarded(p)), F.lit(0))).alias(f"p{k}") for k, p in enumerate(ps)))
    hits = 0
    for row in both.collect():
        for k, p in enumerate(ps):
            assert row[k][0] == row[k][1], p
            hits += len(row[k][0])
    assert hits > 1000
    sarcasm = [*fixed.SARCASM_PATTERNS, "no start", r"\b(yes|no) way"]
    lines = ["oh, great news", "Oh great", "suddenly  cares", "fantastic! that is right", "fantastic! that", "yeah right", "no way", "a no start", "", "thanks for nothing", "xoh great"]
    alone = F.lit(False)
    for p in sarcasm:
        alone = alone | F.col("t").rlike(p)
    assert all(a == b for a, b in spark.createDataFrame([(t,) for t in lines], "t string").select(T.any_match(F.col("t"), sarcasm), alone).collect())


def test_shared_values_are_computed_once(spark):
    # an entropy, or occurrences, of a value must not compute it once an element or needle
    df = spark.createDataFrame([("Abab ba",)], "t string")
    e, n = T.entropy(F.array(F.length(F.lower("t")), F.lit(14), F.lit(21))), T.total_occurrences(F.lower("t"), ["ab", "b", "zz"])
    row = df.select(e, n).first()
    assert abs(row[0] - 1.4591479170272448) < 1e-12 and row[1] == 5
    for c in (e, n):
        plan = df.select(c.alias("y"))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("lower(") == 1, plan
