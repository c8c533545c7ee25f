"""Quality classification with a linear-chain conditional random field over lines.

Each line is good or bad. Its potential depends on its own measures and on those of the lines before and
after it, neighbouring labels on each other. The forward-backward marginals of a document's lines, weighted
by their length, give the document's share of good text, which a logistic curve turns into the score.
Labels of training documents hold for all their lines.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.arrow import blocks, per_text

#: Documents of each label that the field is fitted on at most (in expectation; chosen by hash).
PER_LABEL = 1200
#: Characters measured at a time (memory only).
MEASURED = 1 << 20
GOOD_FROM = 0.3

#: Classes of bytes: lower case, upper case, digit, blank, sentence mark, exclamation, bar, other symbol, beyond ASCII.
LOWER, UPPER, DIGIT, BLANK, MARK, CRY, BAR, SYMBOL, BEYOND = range(9)


def _kinds() -> np.ndarray:
    t = np.full(256, SYMBOL, np.uint8)
    t[[9, 10, 11, 12, 13, 32]] = BLANK
    t[128:] = BEYOND
    t[ord("a") : ord("z") + 1], t[ord("A") : ord("Z") + 1], t[ord("0") : ord("9") + 1] = LOWER, UPPER, DIGIT
    t[[ord(c) for c in ".,;:?'\"()-"]] = MARK
    t[ord("!")], t[ord("|")] = CRY, BAR
    return t


_KIND = _kinds()
N_OWN = 18


def measure(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Measures of every line of the texts, the lines' lengths in bytes, and the lines per text."""
    raw = ("\n".join(texts) + "\n").encode("utf-8", "replace")
    a = np.frombuffer(raw, np.uint8)
    per_text_lines = np.array([t.count("\n") + 1 for t in texts])
    end = np.flatnonzero(a == 10)
    start = np.concatenate([[0], end[:-1] + 1])
    size = end - start
    kind = _KIND[a]
    counts = np.stack([np.add.reduceat((kind == k).astype(np.int32), start) for k in range(9)], 1).astype(np.float64)
    counts[:, BLANK] -= 1  # the line's own end
    full = kind != BLANK
    begins = np.flatnonzero(full & ~np.concatenate([[False], full[:-1]]))
    ends = np.flatnonzero(full & ~np.concatenate([full[1:], [False]])) + 1
    line_of = np.searchsorted(end, begins)
    words = np.bincount(line_of, minlength=len(end)).astype(np.float64)
    fold = (a | 0x20).astype(np.int64)
    s1 = np.concatenate([[0], np.cumsum(fold)])
    s2 = np.concatenate([[0], np.cumsum(fold * (np.arange(len(a), dtype=np.int64) & 0xFFFFF))])
    sum1 = s1[ends] - s1[begins]
    sum2 = s2[ends] - s2[begins] - (begins & 0xFFFFF) * sum1
    n = ends - begins
    # equal length, sum and moment: taken as the same word
    same = (n[1:] == n[:-1]) & (sum1[1:] == sum1[:-1]) & (sum2[1:] == sum2[:-1]) & (line_of[1:] == line_of[:-1])
    again = np.bincount(line_of[1:][same], minlength=len(end)).astype(np.float64)
    capital = np.bincount(line_of, kind[begins] == UPPER, len(end)) if len(begins) else np.zeros(len(end))
    marked = np.bincount(line_of, np.isin(kind[ends - 1], (SYMBOL, CRY, BAR)), len(end)) if len(begins) else np.zeros(len(end))
    chars, some = np.maximum(size, 1), np.maximum(words, 1)
    letters = np.maximum(counts[:, LOWER] + counts[:, UPPER] + counts[:, BEYOND], 1)
    last = kind[np.maximum(end - 1, start)]
    x = np.column_stack([
        counts[:, LOWER] / chars, counts[:, UPPER] / letters, counts[:, DIGIT] / chars, counts[:, BLANK] / chars, counts[:, MARK] / chars, counts[:, CRY] / some, counts[:, BAR] / some, counts[:, SYMBOL] / some, counts[:, BEYOND] / letters,
        again / some, marked / some, capital / some, np.log1p(size) / 5, np.log1p(words) / 4, np.minimum((chars - counts[:, BLANK]) / some, 40) / 10, size == 0, last == MARK, again > 0,
    ])
    return x, size, per_text_lines


def with_neighbours(x: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Own measures, those of the line before and after (zero beyond the document), and whether there is one."""
    first = np.cumsum(lines) - lines
    has_before, has_after = np.ones(len(x), bool), np.ones(len(x), bool)
    has_before[first] = False
    has_after[first + lines - 1] = False
    before, after = np.roll(x, 1, 0) * has_before[:, None], np.roll(x, -1, 0) * has_after[:, None]
    return np.column_stack([x, before, after, has_before, has_after, np.ones(len(x))])


def chain(unary: np.ndarray, trans: np.ndarray, lines: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Marginal chance of label 1 of each line, and the expected label pairs, by forward-backward.

    unary: log potential of label 1 against 0; trans: 2 x 2 log potentials. All documents advance together.
    """
    first = np.cumsum(lines) - lines
    order = np.argsort(-lines, kind="stable")
    first, n = first[order], lines[order]
    longest = int(n[0]) if len(n) else 0
    alive = np.searchsorted(-n, -np.arange(longest), side="left")  # documents with more than t lines
    e = np.exp(trans)
    u = np.exp(-np.abs(unary))
    one, zero = np.where(unary >= 0, 1, u), np.where(unary >= 0, u, 1)
    alpha = np.zeros((len(unary), 2))
    beta = np.ones((len(unary), 2))
    prev = None
    for t in range(longest):
        at = first[: alive[t]] + t
        f0, f1 = zero[at], one[at]
        if t:
            p = prev[: alive[t]]
            f0, f1 = f0 * (p[:, 0] * e[0, 0] + p[:, 1] * e[1, 0]), f1 * (p[:, 0] * e[0, 1] + p[:, 1] * e[1, 1])
        prev = np.column_stack([f0, f1]) / (f0 + f1)[:, None]
        alpha[at] = prev
    expected = np.zeros((2, 2))
    for t in range(longest - 2, -1, -1):
        at = first[: alive[t + 1]] + t
        b0, b1 = beta[at + 1, 0] * zero[at + 1], beta[at + 1, 1] * one[at + 1]
        r0, r1 = e[0, 0] * b0 + e[0, 1] * b1, e[1, 0] * b0 + e[1, 1] * b1
        scale = r0 + r1
        beta[at, 0], beta[at, 1] = r0 / scale, r1 / scale
        if pairs:
            m = alpha[at][:, :, None] * e[None] * np.stack([b0, b1], 1)[:, None, :]
            expected += (m / m.sum((1, 2), keepdims=True)).sum(0)
    p = alpha * beta
    return p[:, 1] / p.sum(1), expected


@dataclass
class Model:
    """Weights of the measures, label pairs, and the curve from share of good text to score."""

    mean: np.ndarray
    sd: np.ndarray
    weights: np.ndarray
    trans: np.ndarray
    curve: tuple[float, float] = (1.0, 0.0)

    def shares(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Length-weighted share of good text (0.5 without a character) and the lines of each text."""
        out, count = np.full(len(texts), 0.5), np.zeros(len(texts), np.int64)
        plain = [t or "" for t in texts]
        for s, e in blocks(plain, MEASURED):
            x, size, lines = measure(plain[s:e])
            p, _ = chain(np.clip((with_neighbours(x, lines) - self.mean) / self.sd @ self.weights, -30, 30), self.trans, lines)
            doc = np.repeat(np.arange(len(lines)), lines)
            w = np.bincount(doc, size, len(lines))
            got = np.bincount(doc, size * p, len(lines))
            out[s:e] = np.where(w > 0, got / np.maximum(w, 1), 0.5)
            count[s:e] = lines
        return out, count

    def score(self, texts: list[str | None]) -> np.ndarray:
        a, b = self.curve
        return 1 / (1 + np.exp(-np.clip(a * _logit(self.shares(texts)[0]) + b, -30, 30)))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def fit(texts: list[str], labels: list[int], prior: float, steps: int = 60, ridge: float = 1e-3, rate: float = 0.15) -> Model:
    """Fit by the likelihood of the label chains (Adam). prior: share of label 1 among all labelled rows, for the curve."""
    dim = 3 * N_OWN + 3
    if not texts or len(set(labels)) < 2:
        # nothing to tell apart: everything scores as the labels say, or good
        b = 3.0 if not labels or labels[0] else -3.0
        return Model(np.zeros(dim), np.ones(dim), np.zeros(dim), np.zeros((2, 2)), (0.0, b))
    parts = [measure(texts[s:e]) for s, e in blocks(texts, MEASURED)]
    lines = np.concatenate([p[2] for p in parts])
    x = np.concatenate([with_neighbours(p[0], p[2]) for p in parts])
    mean, sd = x.mean(0), x.std(0)
    mean[-1], sd[-1] = 0, 1
    sd[sd < 1e-6] = 1
    x = ((x - mean) / sd).astype(np.float32)
    y_doc = np.array(labels, np.float64)
    y = np.repeat(y_doc, lines)
    # a document counts once, however many lines it has; labels weigh alike
    weight = np.repeat(1 / lines / np.where(y_doc == 1, y_doc.sum(), len(y_doc) - y_doc.sum()), lines) / 2
    w, trans = np.zeros(dim), np.zeros((2, 2))
    seen = np.array([[((lines - 1) * (y_doc == 0)).sum(), 0.0], [0.0, ((lines - 1) * (y_doc == 1)).sum()]])
    total = max(1.0, seen.sum())
    m1, m2 = np.zeros(dim + 4), np.zeros(dim + 4)
    for k in range(1, steps + 1):
        p, pairs = chain(np.clip(x @ w, -30, 30), trans, lines, True)
        g = np.concatenate([x.T @ ((y - p) * weight) - ridge * w, ((seen - pairs) / total - 0.02 * trans).ravel()])
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        step = rate * (m1 / (1 - 0.9**k)) / (np.sqrt(m2 / (1 - 0.99**k)) + 1e-8)
        w, trans = w + step[:dim], np.clip(trans + step[dim:].reshape(2, 2), -2, 2)
    model = Model(mean, sd, w, trans)
    z = _logit(model.shares(texts)[0])
    share = np.where(y_doc == 1, prior / y_doc.mean(), (1 - prior) / (1 - y_doc.mean())) / len(y_doc)
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton steps of a logistic curve
        q = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        r, h = share * (y_doc - q), share * q * (1 - q) + 1e-9
        hess = np.array([[(h * z * z).sum() + 1e-3, (h * z).sum()], [(h * z).sum(), h.sum() + 1e-6]])
        da, db = np.linalg.solve(hess, [(r * z).sum() - 1e-3 * (a - 1), r.sum()])
        a, b = a + float(np.clip(da, -1, 1)), b + float(np.clip(db, -1, 1))
    model.curve = (a, b)
    return model


def train(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_label: int = PER_LABEL) -> Model:
    """Fit on about ``per_label`` labelled documents of each label (0 and 1; others and nulls are ignored)."""
    known = labels.select(F.col(id_col).alias("i"), F.col(label_col).cast("int").alias("y")).where("i is not null and y in (0, 1)")
    sizes = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return fit([], [], 1.0)
    share = F.create_map(*(x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, per_label / n)))))
    luck = F.xxhash64("i", F.lit("quality")).cast("double") / float(1 << 64) + 0.5
    # per_label rows of each label at most, in expectation: small enough to send to all tasks
    chosen = F.broadcast(known.where(luck < share[F.col("y")]))
    rows = df.select(F.col(id_col).alias("i"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t")).join(chosen, "i").collect()
    rows.sort(key=lambda r: r["i"])
    return fit([r["t"] for r in rows], [r["y"] for r in rows], sizes.get(1, 0) / sum(sizes.values()))


def classify(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``score`` (0 to 1, higher: likelier good), ``predicted`` (1 from 0.3 on), ``good_share`` and ``n_lines`` of every whole text.

    A null or empty text is one empty line; its share is 0.5 and its score the curve's value there. Repeated
    rows get equal results; other columns of ``df`` are not read; an empty table gives no rows.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make():
        def f(texts):
            m: Model = shared.value
            share, lines = m.shares(texts)
            score = 1 / (1 + np.exp(-np.clip(m.curve[0] * _logit(share) + m.curve[1], -30, 30)))
            return {"score": pa.array(score), "predicted": pa.array((score >= GOOD_FROM).astype(np.int32)), "good_share": pa.array(share), "n_lines": pa.array(lines)}

        return f

    return per_text(df, id_col, text_col, "score double, predicted int, good_share double, n_lines long", make)


def line_labels(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``line, start, length, p_good``: every line of every text with its marginal (positions in UTF-8 bytes)."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    src = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        for b in batches:
            ids, texts = b.column(0), [t or "" for t in b.column(1).to_pylist()]
            for s, e in blocks(texts, MEASURED):
                x, size, lines = measure(texts[s:e])
                p, _ = chain(np.clip((with_neighbours(x, lines) - m.mean) / m.sd @ m.weights, -30, 30), m.trans, lines)
                doc = np.repeat(np.arange(s, e), lines)
                first = np.cumsum(lines) - lines
                number = np.arange(len(x)) - np.repeat(first, lines)
                begin = np.cumsum(size + 1) - size - 1
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(doc)), pa.array(number), pa.array(begin - np.repeat(begin[first], lines)), pa.array(size), pa.array(p)], names=[id_col, "line", "start", "length", "p_good"])

    return src.mapInArrow(run, f"{id_col} {src.schema['id'].dataType.simpleString()}, line long, start long, length long, p_good double")
