"""Language identification with error-correcting output codes.

Every language gets a codeword; for each bit a logistic classifier on hashed byte n-grams tells the
languages with a 1 from those with a 0. A text goes to the codeword with the least weighted loss, each
bit weighted by how well its classifier does on the training texts, and is ambiguous if the second least is close.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.arrow import per_text

#: Buckets of the hashed n-grams (bigrams and trigrams of bytes share them).
BUCKETS = 4096
#: Training texts for each language at most (in expectation; chosen by hash). Bounds what the driver fits on.
PER_LANGUAGE = 500
#: A score below this is ambiguous.
AMBIGUOUS = 0.5
_LETTER = regex.compile(r"\p{L}")
#: All bytes but letters and the bytes of other scripts count as one blank.
_PLAIN = np.array([b if b >= 128 or chr(b).isalpha() else 32 for b in range(256)], np.uint32)


def features(text: str) -> np.ndarray:
    """Counts of hashed n-grams of a whole text, lower-cased."""
    b = _PLAIN[np.frombuffer((" " + text.lower() + " ").encode("utf-8", "replace"), np.uint8)]
    if len(b) < 3:
        return np.zeros(BUCKETS, np.float32)
    # runs of blanks count as one
    b = b[np.concatenate([[True], (b[1:] != 32) | (b[:-1] != 32)])]
    two = b[:-1] * np.uint32(0x9E3779B1) + b[1:] * np.uint32(0x85EBCA6B)
    three = two[:-1] ^ (b[2:] * np.uint32(0xC2B2AE35) + np.uint32(0x27D4EB2F))
    fold = lambda h: ((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(20)
    return (np.bincount(fold(two), minlength=BUCKETS) + np.bincount(fold(three), minlength=BUCKETS)).astype(np.float32)


def normalised(x: np.ndarray) -> np.ndarray:
    x = np.sqrt(x)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def codewords(n: int, seed: int = 5) -> np.ndarray:
    """n codewords of +1 and -1: all splits of up to 6 languages, else the random code with the largest least distance."""
    if n <= 6:
        bits = [[1 if b == 0 else 1 - 2 * ((s >> (b - 1)) & 1) for b in range(n)] for s in range(1, 1 << (n - 1))]
        return np.array(bits, np.float32).T.reshape(n, -1)
    rng, best, most = np.random.default_rng(seed), None, -1
    for _ in range(50):
        c = rng.choice([-1, 1], (n, math.ceil(10 * math.log2(n)))).astype(np.float32)
        d = (c.shape[1] - c @ c.T) / 2
        least = d[~np.eye(n, dtype=bool)].min()
        if least > most:
            best, most = c, least
    return best


@dataclass
class Model:
    """Fitted languages, their codewords, classifiers (a column a bit, the last row is the bias) and bit weights."""

    languages: list[str]
    codes: np.ndarray
    weights: np.ndarray
    trust: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text; ``und`` and 0 where there is no letter or no language was learned."""
        has = np.array([bool(t) and _LETTER.search(t) is not None for t in texts], bool)
        out, score = ["und"] * len(texts), np.zeros(len(texts))
        if not self.languages or not has.any():
            return out, score
        at = np.flatnonzero(has)
        for s in range(0, len(at), 256):
            rows = at[s : s + 256]
            x = normalised(np.stack([features(texts[i]) for i in rows.tolist()]))
            margin = x @ self.weights[:-1] + self.weights[-1]
            # loss of bit b under codeword c: log(1 + exp(-c_b f_b)), weighted
            loss = (np.logaddexp(0, -margin[:, None, :] * self.codes[None]) * self.trust).sum(2)
            p = np.exp(loss.min(1, keepdims=True) - loss)
            best = loss.argmin(1)
            score[rows] = (p / p.sum(1, keepdims=True))[np.arange(len(rows)), best]
            for i, k in zip(rows.tolist(), best.tolist(), strict=True):
                out[i] = self.languages[k]
        return out, score


def fit(counts: np.ndarray, labels: list[str], steps: int = 200, ridge: float = 1e-4) -> Model:
    """Fit on n-gram counts. Languages weigh alike however many texts they have."""
    languages = sorted(set(labels))
    if len(languages) < 2:
        return Model(languages, np.ones((len(languages), 1), np.float32), np.zeros((BUCKETS + 1, 1), np.float32), np.ones(1))
    y = np.array([languages.index(v) for v in labels])
    codes = codewords(len(languages))
    x = np.concatenate([normalised(counts), np.ones((len(y), 1), np.float32)], 1).astype(np.float32)
    target = codes[y]
    share = (1 / np.bincount(y)[y] / len(languages)).astype(np.float32)
    w, v = np.zeros((x.shape[1], codes.shape[1]), np.float32), np.zeros((x.shape[1], codes.shape[1]), np.float32)
    rate = 4 / float((share * (x * x).sum(1)).sum())
    for k in range(steps):  # accelerated gradient
        g = x.T @ (-(target / (1 + np.exp(np.clip(target * (x @ v), -30, 30)))) * share[:, None]) + np.float32(ridge) * v
        new = v - np.float32(rate) * g
        v = new + np.float32(k / (k + 3)) * (new - w)
        w = new
    wrong = (share[:, None] * (target * (x @ w) <= 0)).sum(0)
    trust = np.log((1 - np.clip(wrong, 1e-3, 0.499)) / np.clip(wrong, 1e-3, 0.499))
    # steepen so that the typical training margin counts as certain
    scale = 6 / max(1e-6, float(np.median(np.abs(x @ w))))
    return Model(languages, codes, (w * scale).astype(np.float32), trust / trust.sum() * min(8.0, codes.shape[1]))


def train(df: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", per_language: int = PER_LANGUAGE) -> Model:
    """Fit on about ``per_language`` texts of each language of ``df`` (null text or language: not used).

    Only n-gram counts of the chosen texts reach the driver, BUCKETS numbers a text.
    """
    rows = df.select(F.col(id_col).alias("i"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("lang is not null and text is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return fit(np.zeros((0, BUCKETS), np.float32), [])
    share = F.create_map(*(x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, per_language / n)))))
    luck = (F.xxhash64("i", F.lit("language")).cast("double") / float(1 << 64)) + 0.5
    chosen = rows.where(luck < share[F.col("lang")])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [features(t).astype(np.uint32).tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("lang"), pa.array(got, pa.binary())], names=["lang", "counts"])

    got = chosen.mapInArrow(count, "lang string, counts binary").collect()
    return fit(np.array([np.frombuffer(r["counts"], np.uint32) for r in got], np.float32).reshape(-1, BUCKETS), [r["lang"] for r in got])


def identify(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``lang_pred, score, ambiguous`` of every whole text, one row per input row.

    Null, empty and letterless texts are ``und`` with score 0 and ambiguous, as is everything if no language
    was learned. Repeated rows get equal results; other columns of ``df`` are not read.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make():
        def f(texts):
            lang, score = shared.value.predict(texts)
            return {"lang_pred": pa.array(lang, pa.string()), "score": pa.array(score), "ambiguous": pa.array(score < AMBIGUOUS)}

        return f

    return per_text(df, id_col, text_col, "lang_pred string, score double, ambiguous boolean", make)
