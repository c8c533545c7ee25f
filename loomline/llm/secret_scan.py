"""Secret scans: fixed patterns, and guess-cost dynamic programming on values in a credential context.

A value that follows a credential word (``pwd: ...``, ``Authorization: Bearer ...``, ``access key = ...``) is a secret if it
is hard to guess. Its cost is the least over all segmentations into spans, each a known word, a date, a
repetition, a keyboard walk or brute force; the costs of the spans multiply, times the factorial of their
number (an attacker tries short segmentations first). Values that a person would write as a placeholder or a plain word cost little.

Repetitions are the maximal runs of a block, of any length, taken from the run's left end and up to its right end; a run
costs what its block costs by its own cheapest segmentation, times the number of blocks.

Where a value ends: one that a quote opens, at that quote; any other, at white space. Of what stands there, the reading runs to the last piece between
the separators ``, ; < >`` and quotes that is itself hard to guess and is no pair of a name and a value; closing brackets and
punctuation are no part of it.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.arrow import per_text, release

# The base patterns and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
LEAST_ASSIGN, LEAST_ACCESS = 8, 16

#: Context of the added spans: a name that holds a credential word, a separator, and a value without blanks. A name is one
#: run of letters, digits, _ and -, looked at once; the first word of a name of two words may stand before it.
NAME = re.compile(r"""(?<![A-Za-z0-9_-])([A-Za-z0-9_-]++)["']?([\x20\t]*[:=][\x20\t]*(?:basic[\x20\t]+|bearer[\x20\t]+)?|(?<=bearer)[\x20\t]+)(["']?)(?=\S{8})""", re.I | re.A)
CREDENTIAL = re.compile(r"pwd|passphrase|passcode|credential|bearer|authorization|auth[_-]?key|access[_ -]?key|private[_ -]?key|client[_ -]?secret|password|passwd|secret|token|api[_ -]?key", re.I | re.A)
BEARER = re.compile(r"(?:.*-)?bearer", re.I | re.A)
#: A name that is a credential word only together with a scheme.
SCHEME = re.compile(r"(?:.*-)?authorization", re.I | re.A)
LEAST_VALUE = 8
WHITE = re.compile(r"\s")
PIECES = re.compile(r"""[,;<>"']+""")
PAIR = re.compile(r"[A-Za-z0-9_.-]+[:=].")
CLOSING = ")]}.:!?"
#: Characters before a name in which the first of two words may stand ("private ").
BEFORE = 8
#: Words one of which any name with a credential word, and any match of ASSIGN, holds, for a quick first look.
HINTS = ("pass", "pwd", "secret", "token", "key", "credential", "bearer", "authorization")
#: Least cost, as a power of ten, from which a value in context is a secret.
LEAST_COST = 10.0

# Common parts of passwords, by rank.
WORDS = (
    "password pass admin root user login welcome qwerty letmein monkey dragon master hello secret changeme default guest test example sample "
    "your here none null true false token value string placeholder key api my the and for love baby angel summer winter spring autumn "
    "football baseball princess sunshine shadow superman batman access money company server database mysql postgres oracle redis mongo"
).split()
ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
KEYPLACE = {c: (r, i) for r, row in enumerate(ROWS) for i, c in enumerate(row)}
LEET = str.maketrans("430157$@!", "aeoistsai")
DATES = [
    re.compile(r"(?:19|20)\d\d[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:0[1-9]|[12]\d|3[01])"),
    re.compile(r"(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)\d\d"),
    re.compile(r"(?:19|20)\d\d"),
]


def _alphabet(s: str) -> int:
    return 26 * any("a" <= c <= "z" for c in s) + 26 * any("A" <= c <= "Z" for c in s) + 10 * any(c.isdigit() for c in s) + 33 * any(not c.isalnum() for c in s)


def _near(a: str, b: str) -> bool:
    p, q = KEYPLACE.get(a), KEYPLACE.get(b)
    return p is not None and q is not None and p != q and abs(p[0] - q[0]) <= 1 and abs(p[1] - q[1]) <= 1


class Words(dict):
    """Words with their ranks, from 1; ``longest`` is the length of the longest."""

    def __init__(self, ranked):
        super().__init__()
        for w in ranked:
            self.setdefault(w, len(self) + 1)
        self.longest = max(map(len, self), default=0)


def read_words(path: str, before: tuple[str, ...] | list[str] = ()) -> Words:
    """A dictionary from a file, after the words of ``before``: lower-case words of three letters or more, commonest first. A file of a public tokenizer
    (JSON, model.vocab) gives its pieces by number; any other file holds a word a line."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith(".json"):
        vocab = json.loads(text)["model"]["vocab"]
        lines = [w.lstrip("\u0120") for w in sorted(vocab, key=vocab.get)]
    else:
        lines = [line.strip().lower() for line in text.splitlines()]
    return Words([*before, *(w for w in lines if len(w) >= 3 and w.isascii() and w.isalpha() and w.islower())])


#: Periods up to which every period of a value is tried; longer ones are looked for from anchors of so many characters.
EVERY_PERIOD, ANCHOR = 2048, 64


def _alike(x: np.ndarray, y: np.ndarray) -> int:
    """How many of the first elements are equal."""
    n, done, step = min(len(x), len(y)), 0, ANCHOR
    while done < n:
        same = x[done : min(n, done + step)] == y[done : min(n, done + step)]
        if not same.all():
            return done + int(same.argmin())
        done, step = done + len(same), 2 * step
    return n


def runs_of(value: str) -> list[tuple[int, int, int]]:
    """Maximal runs (start, end, period) of two whole blocks or more (three of one character), of primitive blocks, whatever their length."""
    n, found = len(value), []
    codes = np.frombuffer(value.encode("utf-32-le"), np.uint32)
    seen: set[tuple[int, int]] = set()

    def put(s: int, e: int, p: int) -> None:
        # a run with a shorter period that divides this one spans the same characters
        if e - s >= max(2 * p, 3) and (s, e) not in seen and not any(x <= s and e <= y and p % q == 0 for x, y, q in found):
            seen.add((s, e))
            found.append((s, e, p))

    for p in range(1, min(n // 2, EVERY_PERIOD) + 1):
        same = np.concatenate([[0], codes[p:] == codes[:-p], [0]]).astype(np.int8)
        edge = np.flatnonzero(np.diff(same))
        for s, e in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if e - s >= p:
                put(s, e + p, p)
    # a longer run holds, near its left end, an anchor that is not part of a run of short period, and the anchor again a period on
    covered = np.zeros(n + 1, np.int64)
    if n // 2 > EVERY_PERIOD:
        for s, e, p in found:
            if e - s > ANCHOR:
                covered[s] += 1
                covered[e - ANCHOR + 1] -= 1
        free = np.flatnonzero(np.cumsum(covered)[:n] == 0)
        step = EVERY_PERIOD // 2
        for at in range(0, n - EVERY_PERIOD, step):
            k = int(np.searchsorted(free, at))
            if k == len(free) or free[k] >= at + step:
                continue
            a = int(free[k])
            anchor = value[a : a + ANCHOR]
            j = value.find(anchor, a + EVERY_PERIOD + 1)
            while j >= 0:
                put(a - _alike(codes[:a][::-1], codes[:j][::-1]), j + _alike(codes[a:], codes[j:]), j - a)
                j = value.find(anchor, j + 1)
    return found


def spans_of(value: str, words: dict[str, int]) -> list[tuple[int, int, str, float]]:
    """Candidate spans (start, end, kind, log10 of guesses) besides brute force."""
    out, low = [], value.lower()
    plain, n = low.translate(LEET), len(value)
    longest = words.longest if isinstance(words, Words) else max(map(len, words), default=0)
    for i in range(n):
        for j in range(i + 3, min(n, i + longest) + 1):
            if (r := words.get(plain[i:j])) is not None:
                twist = (value[i:j] != low[i:j]) + (plain[i:j] != low[i:j])
                out.append((i, j, "word", math.log10(r + 1) + 0.5 * twist))
    for i in range(n):  # overlapping ones too
        for m in filter(None, (d.match(value, i) for d in DATES)):
            out.append((m.start(), m.end(), "date", math.log10(365 * 120 if m.end() - m.start() > 4 else 120)))
    for s, e, p in runs_of(value):
        count = (e - s) // p
        for start in {s, e - count * p}:
            block = value[start : start + p]
            cost = math.log10(95) if p == 1 else guess_cost(block, words)[0]
            out.append((start, start + count * p, "repeat", cost + math.log10(count)))
    for step in ("keys", 1, -1):  # walks over the keyboard, and ascending or descending runs
        i = 0
        while i < n - 1:
            j = i + 1
            while j < n and (_near(low[j - 1], low[j]) if step == "keys" else ord(low[j]) - ord(low[j - 1]) == step):
                j += 1
            if j - i >= (4 if step == "keys" else 3):
                out.append((i, j, "walk", math.log10(47 * (j - i) * (4 if step == "keys" else 1))))
            i = j if j - i > 1 else i + 1
    return out


def _factorial(k: int) -> float:
    return math.lgamma(k + 1) / math.log(10)


def _undominated(states: dict[int, tuple]) -> dict[int, tuple]:
    """States by number of spans that can still win: more spans must cost less, their factorial included, than any fewer."""
    out, least = {}, math.inf
    for k in sorted(states):
        total = states[k][0] + _factorial(k)
        if total < least:
            out[k], least = states[k], total
    return out


def guess_cost(value: str, words: dict[str, int] | None = None) -> tuple[float, list[tuple[int, int, str]]]:
    """log10 of the guesses that the cheapest segmentation needs, and that segmentation, of any number of spans."""
    words = _RANKS if words is None else words
    n, per_char = len(value), math.log10(max(2, _alphabet(value)))
    ending: dict[int, list[tuple[int, str, float]]] = {}
    marks = {0, n}
    for i, j, kind, cost in spans_of(value, words):
        ending.setdefault(j, []).append((i, kind, cost))
        marks |= {i, j}
    # two brute spans side by side cost more than one, so a brute span lies between marks and the work grows with their number;
    # best[j]: by number of spans, so that the factorial can be part of the cost. open_: the same, less what brute force costs up to j.
    # what follows adds the same to two states of a place, and more to the one of more spans: dominated ones go
    best: dict[int, dict[int, tuple[float, int, int, str]]] = {0: {0: (0.0, 0, 0, "")}}
    open_: dict[int, tuple[float, int]] = {0: (0.0, 0)}
    for j in sorted(marks - {0}):
        here: dict[int, tuple[float, int, int, str]] = {}
        for i, kind, cost in ending.get(j, ()):
            for k, (c, *_) in best[i].items():
                if (k + 1) not in here or c + cost < here[k + 1][0]:
                    here[k + 1] = (c + cost, i, k, kind)
        ended = {k: c for k, (c, *_) in here.items()}
        for k, (c, i) in open_.items():
            if (k + 1) not in here or c + per_char * j < here[k + 1][0]:
                here[k + 1] = (c + per_char * j, i, k, "brute")
        for k, c in ended.items():
            if k not in open_ or c - per_char * j < open_[k][0]:
                open_[k] = (c - per_char * j, j)
        if ended:
            open_ = _undominated(open_)
        best[j] = _undominated(here)
    if not n:
        return 0.0, []
    k = min(best[n], key=lambda k: best[n][k][0] + _factorial(k))
    total, parts, j = best[n][k][0] + _factorial(k), [], n
    while j:
        _, i, before, kind = best[j][k]
        parts.append((i, j, kind))
        j, k = i, before
    return total, parts[::-1]


_RANKS = Words(WORDS)
KINDS = ("assign", "access", "hex", "guess")


def _reading(piece: str, least_cost: float, words: dict[str, int]) -> int:
    """Length of the value at the start of ``piece``, which holds neither white space nor the quote that opened it."""
    piece = piece.rstrip(CLOSING)
    cuts = [(m.start(), m.end()) for m in PIECES.finditer(piece)]
    # from the last piece to the first: one that is cheap, or a pair of its own, is not part of the value
    for k in range(len(cuts) - 1, -1, -1):
        start, end = cuts[k][1], cuts[k + 1][0] if k + 1 < len(cuts) else len(piece)
        rest = piece[start:end].rstrip(CLOSING)
        if rest and not PAIR.match(rest) and guess_cost(rest, words)[0] >= least_cost and not any(PAIR.match(piece[s:]) for _, s in cuts[:k]):
            return start + len(rest)
    return len(piece[: cuts[0][0]].rstrip(CLOSING)) if cuts else len(piece)


def values(text: str, least_cost: float = LEAST_COST, words: dict[str, int] | None = None) -> Iterator[tuple[int, int]]:
    """Places of the values that follow a name with a credential word, from left to right."""
    at, words = 0, _RANKS if words is None else words
    while m := NAME.search(text, at):
        name, at = m[1], m.end(2)
        scheme = m[2].strip(" \t:=") != ""
        if m[2].isspace():
            known = BEARER.fullmatch(name)
        elif SCHEME.fullmatch(name):
            known = scheme
        else:
            lead = text[max(0, m.start() - BEFORE) : m.start()] if text[max(0, m.start() - 1) : m.start()] == " " else ""
            known = any(c.end() > len(lead) for c in CREDENTIAL.finditer(lead + name))
        if not known:
            if scheme:  # the scheme may be the name of what follows
                at = m.end(1) + 1
            continue
        blank = WHITE.search(text, m.end())
        stop = blank.start() if blank else len(text)
        if m[3] and 0 <= (quote := text.find(m[3], m.end(), stop)):
            length = quote - m.end()
        else:
            length = _reading(text[m.end() : stop], least_cost, words)
        if length >= LEAST_VALUE:
            at = m.end() + length
            yield m.end(), at


def scan(text: str | None, least_cost: float = LEAST_COST, words: dict[str, int] | None = None) -> tuple[list[tuple[int, str, int]], float]:
    """Spans (start, kind, end) in order, code points, end exclusive; and the largest cost of a value in context."""
    if not text:
        return [], 0.0
    found: list[tuple[int, str, int]] = []
    low, most = text.lower(), 0.0
    if any(h in low for h in HINTS):
        found += [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
        taken = [(s, e) for s, _, e in found]
        for start, end in values(text, least_cost, words):
            cost, _ = guess_cost(text[start:end], words)
            most = max(most, cost)
            if cost >= least_cost and not any(s <= start and end <= e for s, e in taken):
                found.append((start, "guess", end))
    if "AKIA" in text:
        found += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]
    found.sort(key=lambda x: (x[0], KINDS.index(x[1]), x[2]))
    return found, most


def spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_cost: float = LEAST_COST, words: dict[str, int] | None = None) -> DataFrame:
    """``spans`` (array of start, kind, end) and ``max_cost`` of every whole text, by a dictionary of ``words`` (our own short one, if none is given).

    Null and empty texts have none. Kinds may overlap; within a kind spans do not. Repeated rows get equal
    results; other columns of ``df`` are not read.
    """
    kind = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64())]))

    shared = df.sparkSession.sparkContext.broadcast(words)  # as large as its file

    def make():
        def f(texts):
            got = [scan(t, least_cost, shared.value) for t in texts]
            return {"spans": pa.array([[{"start": s, "kind": k, "end": e} for s, k, e in g] for g, _ in got], kind), "max_cost": pa.array([c for _, c in got], pa.float64())}

        return f

    return per_text(df, id_col, text_col, "spans array<struct<start:bigint,kind:string,end:bigint>>, max_cost double", make)


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts by kind and the spans as text, from :func:`spans`."""
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    line = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = line(F.filter("spans", lambda x: x["kind"] != "guess"))
    return found.select(id_col, *(count(k) for k in KINDS), F.sha2(base, 256).alias("base_sha256"), line(F.col("spans")).alias("spans"), "max_cost")


def redact(text: str, found: list[tuple[int, str, int]], mask: str = "[secret]") -> str:
    """The text with every span (overlapping ones together) replaced."""
    out, last = [], 0
    for s, _, e in found:
        if e <= last:
            continue
        if s >= last:
            out += [text[last:s], mask]
        last = e
    return "".join(out) + text[last:]


def redacted(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", mask: str = "[secret]") -> DataFrame:
    """``df`` with the secrets of ``text_col`` masked; null stays null, all other columns pass unchanged."""

    @F.pandas_udf("string")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: t if t is None else redact(t, scan(t)[0], mask))
        release()

    return df.withColumn(text_col, clean(text_col))


