"""Fixtures shared by the tests of the training-data operators."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, fp string, score string, h string, part string"
LONG = ("lorem ipsum dolor sit amet, consectetur " * 4000) + "x" * 30000


def edge_rows():
    """Null ids and texts, empty and blank texts, a very long one, ties, repeated rows; columns with clashing names."""
    tail = ("en", "s", 1, "clash", "clash", "clash", "clash", "clash")
    rows = [(1, None), (2, ""), (3, "   \n\t "), (4, LONG), (5, "the same text once more"), (6, "the same text once more"), (6, "the same text once more"), (None, "a text without an id"), (None, None), (7, "é漢字🙂 <|endoftext|> \x1c\x85 end"), (8, "12345 !!!")]
    return [(*r, *tail) for r in rows]


def edge_docs(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA)


def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def words(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(["ba", "ke", "lo", "mi", "su", "ta"]) + rng.choice(["n", "r", "st", "ll"]) + rng.choice(["a", "e", "o"]) for _ in range(n))
