"""Quality rules over whole corpora: lines that many documents of a host share go, and documents that lose too much with them.

Every document is measured by itself (words, symbols, repeated lines, repeated five-word windows), and its lines are hashed
after normalisation: words joined by one blank, A-Z lower-cased, digits as 0. A line counts once a document, and equal texts of a
host are one document, so that copies of a clean document (a matter of deduplication) do not make its lines common; counts are
made per host and line, before and after the shuffle. Lines above the limits of their host are removed, and a document of which too
little is left is rejected. Lines and texts are told apart by 64-bit hashes: a collision can only move a count near its limit.

Only lines above a limit travel back. Those that are in so many documents that one key would burden a task are few by
arithmetic (all lines through their least count) and are broadcast; the others are joined by key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.arrow import blocks, release
from loomline.scratch import materialize

#: A line goes if more documents of its host than this hold it, and more than this share of them.
MOST_DOCS, MOST_SHARE = 10, 0.005
#: A document is rejected if fewer words than this are left, or less than this share of its words.
LEAST_WORDS, LEAST_SHARE = 10, 0.5
#: Base rules: fewer words, or a larger percentage of words in repeated windows.
BASE_WORDS, BASE_REPEAT, WINDOW = 10, 20, 5
#: Documents from which a line is broadcast, at least; and how many lines may be at most (24 bytes each).
HEAVY, HEAVY_LINES = 1 << 16, 100_000
SYMBOLS = frozenset("#*$%&|<>")
#: Characters that separate words, as blanks; A-Z lower-cased, digits as 0.
_SPLIT = dict.fromkeys([0x20, *range(0x09, 0x0E)], " ")
_FOLD = {c: c + 32 for c in range(65, 91)} | dict.fromkeys(range(48, 58), "0")


def words(text: str) -> list[str]:
    """Runs of anything but blank, tab, line feed, vertical tab, form feed and carriage return."""
    return [w for w in text.translate(_SPLIT).split(" ") if w]


def normalised(line: str) -> str:
    """The form in which lines are compared; empty for a line without a word."""
    return " ".join(words(line)).translate(_FOLD)


def repeated_words(per_text: list[list[str]], width: int = WINDOW) -> list[int]:
    """Per text the words that lie in a window of ``width`` words that occurs twice or more in it.

    All texts of a block at once: windows are numbered by pairs of numbers of shorter ones, so that equal numbers mean equal words.
    """
    size = np.array([len(w) for w in per_text], np.int64)
    n = int(size.sum())
    if n < width:
        return [0] * len(per_text)
    known: dict[str, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for ws in per_text for w in ws], np.int64)
    doc = np.repeat(np.arange(len(per_text)), size)
    # windows of one word, told apart by text; each further word makes them longer by one
    code = np.unique(doc * len(known) + ids, return_inverse=True)[1]
    for k in range(1, width):
        code = np.unique(code[: n - k] * len(known) + ids[k:], return_inverse=True)[1]
    whole = doc[: n - width + 1] == doc[width - 1 :]
    twice = whole & (np.bincount(code[whole], minlength=int(code.max()) + 1)[code] > 1)
    inside = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(inside, at, 1)
    np.add.at(inside, at + width, -1)
    return np.bincount(doc[np.cumsum(inside)[:n] > 0], minlength=len(per_text)).tolist()


_FIELDS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _measure(texts: list[str]) -> dict[str, list]:
    import xxhash

    per_text = [words(t) for t in texts]
    out = {
        "n_words": [len(w) for w in per_text], "word_chars": [sum(map(len, w)) for w in per_text], "n_symbols": [sum(map(t.count, SYMBOLS)) for t in texts],
        "n_dup_lines": [], "n_repeat_words": repeated_words(per_text), "body": [xxhash.xxh64_intdigest(t) - (1 << 63) for t in texts], "lines": [],
    }
    for t in texts:
        raw, shared, dup = set(), {}, 0
        for line in t.split("\n"):
            w = words(line)
            if not w:
                continue
            dup += line in raw
            raw.add(line)
            h = xxhash.xxh64_intdigest(" ".join(w).translate(_FOLD)) - (1 << 63)
            shared[h] = shared.get(h, 0) + len(w)
        out["n_dup_lines"].append(dup)
        # a line counts once a document; its words count as often as it stands there
        out["lines"].append([{"h": h, "w": k} for h, k in shared.items()])
    return out


def measures(df: DataFrame, id_col: str, text_col: str, host_col: str, with_text: bool) -> DataFrame:
    """Per row: id, host, the base counts, a hash of the text, and its distinct lines (hash, words). Null texts and hosts count as empty."""
    id_type = df.schema[id_col].dataType.simpleString()
    src = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"), F.col(text_col).cast("string").alias("text"))
    schema = f"id {id_type}, host string, {', '.join(f'{c} long' for c in _FIELDS)}, body long, lines array<struct<h:bigint,w:bigint>>" + (", text string" if with_text else "")
    names = ["id", "host", *_FIELDS, "body", "lines"] + ["text"] * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(2).to_pylist()
            for s, e in blocks(["" if t is None else t for t in texts]):
                m = _measure(["" if t is None else t for t in texts[s:e]])
                arrays = [b.column(0).slice(s, e - s), b.column(1).slice(s, e - s), *(pa.array(m[c], pa.int64()) for c in (*_FIELDS, "body")), pa.array(m["lines"], pa.list_(pa.struct([("h", pa.int64()), ("w", pa.int64())])))]
                yield pa.RecordBatch.from_arrays(arrays + [b.column(2).slice(s, e - s)] * with_text, names=names)
        release()

    return src.mapInArrow(run, schema)


def frequent_lines(rows: DataFrame, most_docs: int = MOST_DOCS, most_share: float = MOST_SHARE) -> DataFrame:
    """``host, h, docs`` of the lines above the limits; ``rows`` as :func:`measures` returns them."""
    docs = rows.groupBy("host", "body").agg(F.first("lines").alias("lines"))  # equal texts have equal lines
    hosts = docs.groupBy("host").agg(F.count("*").alias("of"))
    lines = docs.select("host", F.explode("lines.h").alias("h")).groupBy("host", "h").agg(F.count("*").alias("docs")).where(F.col("docs") > most_docs)
    return lines.join(hosts, "host").where(F.col("docs") > F.lit(most_share) * F.col("of")).select("host", "h", "docs")


def rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", with_text: bool = False) -> DataFrame:
    """Per row: id, ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words``, ``n_removed`` words of lines that go,
    ``base_failed``, ``kept``, and with ``with_text`` the ``cleaned`` text without those lines (null stays null).

    Null texts are texts without a word and fail the base rules, as empty and blank ones do; a null host is one host. Repeated
    rows come back each, with or without an id, and count as one document for the lines. Whole texts of any length count. An empty table
    gives no rows. Only the three columns named are read.
    """
    rows = materialize(measures(df, id_col, text_col, host_col, with_text).withColumn("row", F.monotonically_increasing_id()), "measures")
    often = materialize(frequent_lines(rows), "frequent")
    total = rows.agg(F.sum(F.size("lines")).alias("n")).first()["n"] or 0
    heavy = F.col("docs") >= max(HEAVY, -(-total // HEAVY_LINES))  # at most HEAVY_LINES of them
    lines = rows.select("row", "host", F.explode("lines").alias("x")).select("row", "host", "x.h", "x.w")
    wide, narrow = often.where(heavy).select("host", "h"), often.where(~heavy).select("host", "h")
    # the two joins have no line in common
    hits = lines.join(F.broadcast(wide), ["host", "h"]).unionByName(lines.join(narrow, ["host", "h"]))
    hits = materialize(hits.groupBy("row").agg(F.sum("w").alias("n_removed"), *([F.collect_set("h").alias("gone")] if with_text else [])), "removed")
    x = rows.join(hits, "row", "left").withColumn("n_removed", F.coalesce("n_removed", F.lit(0).cast("long")))
    left = F.col("n_words") - F.col("n_removed")
    failed = (F.col("n_words") < BASE_WORDS) | (100 * F.col("n_repeat_words") > BASE_REPEAT * F.col("n_words"))
    kept = ~failed & (left >= LEAST_WORDS) & (left >= LEAST_SHARE * F.col("n_words"))
    out = x.select(F.col("id").alias(id_col), *_FIELDS, "n_removed", failed.alias("base_failed"), kept.alias("kept"), *(["text", "gone"] if with_text else []))
    return _without_lines(out) if with_text else out


def _without_lines(df: DataFrame) -> DataFrame:
    """``text, gone`` replaced by the text without the lines whose hash is in ``gone``; other lines stay as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            out = []
            for text, gone in zip(b.column(b.num_columns - 2).to_pylist(), b.column(b.num_columns - 1).to_pylist(), strict=True):
                if text is not None and gone:
                    drop = set(gone)
                    text = "\n".join(line for line in text.split("\n") if not (n := normalised(line)) or xxhash.xxh64_intdigest(n) - (1 << 63) not in drop)
                out.append(text)
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(out, pa.string())], names=[*b.schema.names[:-2], "cleaned"])

    schema = ", ".join(f"`{n}` {t}" for n, t in df.dtypes[:-2])
    return df.mapInArrow(run, f"{schema}, cleaned string")
