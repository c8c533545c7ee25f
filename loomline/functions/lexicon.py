"""Lexicons: data that a scorer is given, never part of it."""

from __future__ import annotations

import csv
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

#: Terms above which scoring should join a lexicon table instead of carrying literals.
LITERAL_TERMS = 5000


@dataclass(frozen=True)
class Entry:
    """A term, its sentiment s and intensity i, its emotions, and the conflict behaviour it signals."""

    term: str
    s: float
    i: float = 1.0
    emotions: tuple[str, ...] = ()
    horseman: str | None = None

    @property
    def weight(self) -> float:
        return self.s * self.i

    @property
    def is_phrase(self) -> bool:
        return " " in self.term


@dataclass(frozen=True)
class Lexicon:
    """Entries with distinct terms (the last of equal ones counts), and the words that change their weight."""

    entries: tuple[Entry, ...]
    negators: tuple[str, ...] = ()
    intensifiers: dict[str, float] = field(default_factory=dict)
    diminishers: dict[str, float] = field(default_factory=dict)
    sarcasm: tuple[str, ...] = ()

    @staticmethod
    def of(entries: Iterable[Entry], **modifiers) -> Lexicon:
        kept = tuple({e.term: e for e in entries}.values())
        if len(kept) > LITERAL_TERMS:
            raise ValueError(f"a lexicon of literals holds {LITERAL_TERMS} terms at most")
        return Lexicon(kept, **modifiers)

    @property
    def words(self) -> list[Entry]:
        return [e for e in self.entries if not e.is_phrase]

    @property
    def phrases(self) -> list[Entry]:
        return [e for e in self.entries if e.is_phrase]

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(e.term, e.is_phrase, e.s, e.i, list(e.emotions), e.horseman) for e in self.entries]
        return spark.createDataFrame(rows, "term string, is_phrase boolean, s double, i double, emotions array<string>, horseman string")


def read_csv(path: str, **modifiers) -> Lexicon:
    """From a CSV file with columns term, s, i, emotions (separated by ;), horseman."""
    with open(path, newline="", encoding="utf-8") as f:
        return Lexicon.of((Entry(r["term"], float(r["s"]), float(r.get("i") or 1), tuple(x for x in (r.get("emotions") or "").split(";") if x), r.get("horseman") or None) for r in csv.DictReader(f)), **modifiers)


def standard_modifiers() -> dict:
    from loomline.functions import fixed

    return {"negators": tuple(fixed.NEGATORS), "intensifiers": fixed.INTENSIFIERS, "diminishers": fixed.DIMINISHERS, "sarcasm": tuple(fixed.SARCASM_PATTERNS)}


def starter() -> Lexicon:
    """A small lexicon of our own for narratives; load a full one with :func:`read_csv`."""
    rows = [
        ("love", 2.4, 1.1, ("love", "joy")), ("trust", 2.0, 1.0, ("trust",)), ("happy", 2.2, 1.0, ("joy",)), ("grateful", 2.1, 1.0, ("joy", "trust")), ("hope", 1.6, 1.0, ("anticipation",)),
        ("safe", 1.5, 1.0, ("trust",)), ("kind", 1.4, 1.0, ("trust",)), ("wonderful", 2.7, 1.1, ("joy",)), ("proud", 1.7, 1.0, ("joy",)), ("calm", 1.2, 1.0, ("trust",)),
        ("hate", -2.7, 1.2, ("anger", "disgust")), ("angry", -2.0, 1.1, ("anger",)), ("afraid", -1.9, 1.0, ("fear",)), ("lonely", -2.0, 1.0, ("sadness",)), ("betrayed", -2.6, 1.2, ("anger", "sadness")),
        ("hurt", -2.1, 1.0, ("sadness",)), ("tired", -1.1, 1.0, ("sadness",)), ("broken", -2.2, 1.1, ("sadness",)), ("terrible", -2.3, 1.1, ("fear",)), ("shocked", -0.8, 1.0, ("surprise",)),
        ("plan", 0.3, 1.0, ("anticipation",)), ("gross", -1.6, 1.0, ("disgust",)), ("space", 0.0, 1.0, ()),
    ]
    tagged = [
        ("blaming", -1.7, 1.0, ("anger",), "criticism"), ("scorn", -2.3, 1.2, ("disgust", "anger"), "contempt"), ("excuse", -1.2, 1.0, ("fear",), "defensiveness"), ("shutdown", -1.6, 1.0, ("sadness",), "stonewalling"),
        ("picked apart", -1.9, 1.0, ("anger",), "criticism"), ("cold shoulder", -1.8, 1.1, ("sadness",), "stonewalling"), ("made up", 1.6, 1.0, ("joy", "trust"), None), ("let down", -1.7, 1.0, ("sadness",), None),
    ]
    return Lexicon.of([Entry(*r) for r in [*rows, *tagged]], **standard_modifiers())
