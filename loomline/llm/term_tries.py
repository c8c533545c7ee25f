"""Source divergence audit: how far the sources of a language are apart in their terms, by mergeable byte tries.

Every task gathers the terms of its documents in a radix trie over UTF-8 bytes, whose leaves have counters of occurrences and documents per
source (of a language). The trie is kept as arrays: leaves in byte order, each with the depth at which it leaves the path of the leaf before and
the label from there on, and the counters beside them; so a block of documents is counted at once, and Python meets
a term once a block, not once an occurrence. A trie leaves the task cut by prefix ranges: the subtree of a range is one row. Ranges that hold too many counters are cut at a longer prefix, and ranges of very many subtrees are first merged
slice by slice, so that no task meets more than a bounded part of either. Merged, a subtree yields its kept terms; a
traversal of these in byte order streams the differences of all pairs of sources, block by block, and the candidates of the term report, for
which byte order breaks ties.

All arithmetic is in integers.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomline.llm.arrow import release
from loomline.scratch import materialize

#: Documents of a language that must hold a term; smoothing added to a count; scale of a share; terms of the report.
LEAST_DOCS, ADDED, SCALE, TOP = 30, 5, 1_000_000_000, 50
#: Bytes of a prefix range at first and at most, and leaf counters of a range above which it is cut at one more byte.
PREFIX, LONGEST, RANGE_LEAVES = 2, 16, 1 << 21
#: Subtrees of a range that one task merges.
FAN = 1 << 10
#: Kept terms of one traversal; entries of one block of counts; sources whose pairs are summed together.
RANGE_TERMS, BLOCK, TILE = 1 << 14, 1 << 18, 256
#: Bytes of texts counted at a time, and terms of a task's trie at which it is handed on (memory only).
CHARS, TERMS = 1 << 22, 1 << 19
#: Bytes of terms as they are (A-Z lower-cased, others beyond ASCII unchanged), all others as a blank.
_TERM = bytes((c + 32 if 65 <= c <= 90 else c) if 65 <= c <= 90 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


class Trie:
    """Radix trie over bytes. While it grows its leaves are numbered as they come; counters are arrays of (number, group, occurrences, documents), added
    up when the trie is read. Read, its leaves are in byte order: see :func:`depths`."""

    def __init__(self):
        self.numbers: dict[bytes, int] = {}
        self.groups: dict[tuple[str, str], int] = {}
        self._parts: list[np.ndarray] = []

    def __len__(self) -> int:
        return len(self.numbers)

    def add(self, terms: list[bytes], term: np.ndarray, group: np.ndarray, occurrences: np.ndarray, documents: np.ndarray) -> None:
        """Counters of ``terms[term]`` in groups (numbers of ``groups``)."""
        known = self.numbers
        numbers = np.fromiter((known.setdefault(t, len(known)) for t in terms), np.int64, len(terms))
        self._parts.append(np.stack([numbers[term], group, occurrences, documents]))

    def leaves(self) -> tuple[list[bytes], np.ndarray]:
        """Terms in byte order, and the place of every number among them."""
        terms = sorted(self.numbers)
        place = np.empty(len(terms), np.int64)
        place[np.fromiter(map(self.numbers.__getitem__, terms), np.int64, len(terms))] = np.arange(len(terms))
        return terms, place

    def counters(self, place: np.ndarray) -> np.ndarray:
        """Rows place, group, occurrences, documents, added up and in order; ``place`` of every number."""
        if not self._parts:
            return np.zeros((4, 0), np.int64)
        number, group, occurrences, documents = np.concatenate(self._parts, axis=1)
        self._parts = []
        width = max(1, len(self.groups))
        key = place[number] * width + group
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        return np.stack([key[first] // width, key[first] % width, np.add.reduceat(occurrences[order], first), np.add.reduceat(documents[order], first)])


#: Depth up to which paths are shared.
DEPTH = 64


def depths(terms: list[bytes]) -> np.ndarray:
    """Of leaves in byte order, how many bytes (``DEPTH`` at most) each shares with the one before."""
    if not terms:
        return np.zeros(0, np.int64)
    head = np.array([t[:DEPTH] for t in terms], dtype=f"S{min(DEPTH, max(map(len, terms)))}")
    letters = head.view(np.uint8).reshape(len(terms), -1)
    same = letters[1:] == letters[:-1]
    return np.concatenate([[0], np.where(same.all(1), same.shape[1], same.argmin(1))])


#: A subtree as a row: its prefix; its leaves in byte order, as depths shared with the leaf before, lengths of labels and the labels; and the counters of
#: each leaf, group by group: how many, then which group (of ``langs`` and ``sources``), occurrences and documents, of all leaves one after another.
SUBTREE = "prefix binary, slice long, leaves long, langs array<string>, sources array<string>, depths binary, lengths binary, labels binary, n binary, groups binary, occurrences binary, documents binary"
_KINDS = [pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.string()), *([pa.binary()] * 7)]
_NAMES = [c.split()[0] for c in SUBTREE.split(", ")]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    got = pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(_KINDS)], names=_NAMES)
    rows.clear()
    return got


def _rows(terms: list[bytes], counters: np.ndarray, groups: list[tuple[str, str]], cut: int) -> Iterator[tuple]:
    """Rows of ``SUBTREE`` of leaves in byte order, one a prefix of ``cut`` bytes."""
    if not terms:
        return
    shared = depths(terms)
    starts = np.flatnonzero(shared < cut)  # two leaves that share less have different prefixes
    shared[starts] = 0
    size = np.fromiter(map(len, terms), np.int64, len(terms))
    first = np.concatenate([[0], np.cumsum(size)])
    letters = np.frombuffer(b"".join(terms), np.uint8)
    label = np.arange(len(letters)) - np.repeat(first[:-1], size) >= np.repeat(shared, size)
    labels, ends = letters[label], np.concatenate([[0], np.cumsum(size - shared)])
    for start, end in zip(starts.tolist(), [*starts[1:].tolist(), len(terms)], strict=True):
        a, b = np.searchsorted(counters[0], [start, end])
        place, group, occurrences, documents = counters[:, a:b]
        used, group = np.unique(group, return_inverse=True)
        names = [groups[g] for g in used.tolist()]
        n = np.bincount(place - start, minlength=end - start)
        path = (shared[start:end].astype(np.uint8).tobytes(), (size - shared)[start:end].astype(np.int32).tobytes(), labels[ends[start] : ends[end]].tobytes())
        yield (terms[start][:cut], 0, int(b - a), [x for x, _ in names], [x for _, x in names], *path, *(x.astype(np.int64).tobytes() for x in (n, group, occurrences, documents)))


def _cut_rows(trie: Trie, cut: int) -> Iterator[tuple]:
    """A trie as rows of ``SUBTREE``."""
    terms, place = trie.leaves()
    yield from _rows(terms, trie.counters(place), list(trie.groups), cut)


def _read(row: dict) -> tuple[list[bytes], np.ndarray, list[tuple[str, str]]]:
    """Terms, counters (place, group, occurrences, documents) and groups of a subtree's row."""
    n, group, occurrences, documents = (np.frombuffer(row[k], np.int64) for k in ("n", "groups", "occurrences", "documents"))
    terms, last, at, labels = [], b"", 0, row["labels"]
    for depth, size in zip(row["depths"], np.frombuffer(row["lengths"], np.int32).tolist(), strict=True):
        last = last[:depth] + labels[at : at + size]
        terms.append(last)
        at += size
    return terms, np.stack([np.repeat(np.arange(len(n)), n), group, occurrences, documents]), list(zip(row["langs"], row["sources"], strict=True))


def _pieces(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, at most about ``CHARS`` bytes of it at a time."""
    done = 0
    while len(text) - done > CHARS:
        piece = text[done : done + CHARS].translate(_TERM)
        end = piece.rfind(b" ") + 1
        if not end:  # a term longer than a piece
            break
        yield piece[:end].split()
        done += end
    yield text[done:].translate(_TERM).split()


def _many(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Distinct terms of a block of texts; and of each text and term that occur together both numbers and the occurrences."""
    joined = np.frombuffer(b" ".join(texts).translate(_TERM), np.uint8)
    inside = joined != 32
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
    first, last = edge[::2], edge[1::2]
    # the bytes of all terms one after another, cut by their lengths
    ends = np.concatenate([[0], np.cumsum(last - first)]).astype(np.int32)
    terms = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends), pa.py_buffer(joined[inside])]).dictionary_encode()
    known, ids = terms.dictionary.to_pylist(), terms.indices.to_numpy()
    # the blank that ends a text belongs to it
    starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    text = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(first, starts)))
    both, n = np.unique(text * max(1, len(known)) + ids, return_counts=True)
    return known, both // max(1, len(known)), both % max(1, len(known)), n


def _count(trie: Trie, texts: list[bytes], langs: list[str], sources: list[str]) -> None:
    """Add a block of texts to the trie."""
    group = np.array([trie.groups.setdefault(g, len(trie.groups)) for g in zip(langs, sources, strict=True)], np.int64)
    if len(texts) == 1:  # maybe a very long one
        once: Counter = Counter()
        for piece in _pieces(texts[0]):
            once.update(piece)
        n = len(once)
        trie.add(list(once), np.arange(n), np.repeat(group, n), np.array(list(once.values()), np.int64), np.ones(n, np.int64))
        return
    known, text, term, n = _many(texts)
    # a group's counters of a term: sums over its texts
    width = len(trie.groups)
    key = term * width + group[text]
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    if len(first):
        trie.add(known, key[first] // width, key[first] % width, np.add.reduceat(n[order], first), np.diff(np.append(first, len(key))))


def subtrees(docs: DataFrame, prefix: int = PREFIX) -> DataFrame:
    """Rows of ``SUBTREE`` for ``docs`` (text, lang, source): each task's trie, cut by prefixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie()
        for b in batches:
            texts, langs, sources = (c.to_pylist() for c in b.columns)
            start = size = 0
            for i, t in enumerate(texts):
                texts[i] = t = t.encode()
                if i > start and size + len(t) > CHARS:
                    _count(trie, texts[start:i], langs[start:i], sources[start:i])
                    start, size = i, 0
                    if len(trie) > TERMS:
                        yield _batch(list(_cut_rows(trie, prefix)))
                        trie = Trie()
                size += len(t)
            if texts:
                _count(trie, texts[start:], langs[start:], sources[start:])
        yield _batch(list(_cut_rows(trie, prefix)))
        release()

    return docs.select("text", "lang", "source").mapInArrow(run, SUBTREE)


def _cut(rows: DataFrame) -> DataFrame:
    """Every subtree cut at one byte more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                yield _batch(list(_rows(*_read(row), len(row["prefix"]) + 1)))

    return rows.mapInArrow(run, SUBTREE)


def _merged(rows: DataFrame, keep: int | None) -> DataFrame:
    """Subtrees of one prefix and slice merged into one; with ``keep``, the terms that so many documents of a language hold, a row a language and term."""

    def close(key: tuple, trie: Trie) -> pa.RecordBatch:
        if keep is None:
            return _batch(list(_cut_rows(trie, len(key[0]))))
        terms, place = trie.leaves()
        at, group, occurrences, documents = trie.counters(place)
        groups, langs = list(trie.groups), {}
        lang = np.array([langs.setdefault(x, len(langs)) for x, _ in groups], np.int64)
        # documents by term and language
        own = at * max(1, len(langs)) + lang[group] if len(at) else at
        order = np.argsort(own, kind="stable")
        own = own[order]
        first = np.flatnonzero(np.diff(own, prepend=-1))
        held = np.add.reduceat(documents[order], first) if len(first) else documents
        out, names, ends = [], list(langs), np.append(first, len(own))
        for k in np.flatnonzero(held >= keep).tolist():
            es = order[ends[k] : ends[k + 1]]
            out.append((names[int(own[first[k]]) % len(langs)], key[0], terms[int(own[first[k]]) // len(langs)], [groups[g][1] for g in group[es].tolist()], occurrences[es].tolist()))
        kinds = (pa.string(), pa.binary(), pa.binary(), pa.list_(pa.string()), pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate(kinds)], names=["lang", "prefix", "term", "source", "occurrences"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, trie = None, Trie()
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                here = (row["prefix"], row["slice"])
                if here != key:
                    if key is not None:
                        yield close(key, trie)
                    key, trie = here, Trie()
                terms, (term, group, occurrences, documents), groups = _read(row)
                mine = np.array([trie.groups.setdefault(g, len(trie.groups)) for g in groups], np.int64)
                trie.add(terms, term, mine[group], occurrences, documents)
        if key is not None:
            yield close(key, trie)
        release()

    by = ["prefix", "slice"]
    schema = SUBTREE if keep is None else "lang string, prefix binary, term binary, source array<string>, occurrences array<bigint>"
    return rows.repartition(*by).sortWithinPartitions(*by).mapInArrow(run, schema)


def kept_terms(docs: DataFrame, least: int = LEAST_DOCS, prefix: int = PREFIX, range_leaves: int = RANGE_LEAVES, fan: int = FAN) -> DataFrame:
    """``lang, prefix, term`` with ``source`` and ``occurrences`` (arrays) of each term that ``least`` documents of its language hold; ``docs``: text, lang, source."""
    rows = materialize(subtrees(docs, prefix), "tries")
    parts = []
    size = lambda d: d.groupBy("prefix").agg(F.sum("leaves").alias("all"), F.count("*").alias("many"))
    # ranges that hold too many counters are cut at longer prefixes, as long as that makes them smaller
    for cut in range(prefix, LONGEST):
        large = size(rows).where((F.col("all") > range_leaves) & (F.length("prefix") == cut)).select("prefix")
        large = materialize(large, "large")
        if large.isEmpty():
            break
        parts.append(rows.join(large, "prefix", "left_anti"))
        rows = materialize(_cut(rows.join(large, "prefix", "left_semi")), f"tries{cut}")
    for p in parts:
        rows = rows.unionByName(p)
    # ranges of very many subtrees: slices of them first
    many = materialize(size(rows).where(F.col("many") > fan).select("prefix", "many"), "many")
    while not many.isEmpty():
        sliced = rows.join(many, "prefix").withColumn("slice", F.pmod(F.xxhash64("labels", "groups", "occurrences"), F.ceil(F.col("many") / fan))).drop("many")
        rows = rows.join(many, "prefix", "left_anti").unionByName(_merged(sliced, None))
        rows = materialize(rows, "sliced")
        many = materialize(size(rows).where(F.col("many") > fan).select("prefix", "many"), "many")
    return materialize(_merged(rows.withColumn("slice", F.lit(0).cast("long")), least), "kept")


def share(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * count / total) in 64-bit integers, exact for totals below 9 * 10^15: the scale is brought in by thousands."""
    total = np.maximum(total, 1)
    q, rest = np.divmod(count, total)
    for _ in range(3):
        step, rest = np.divmod(rest * 1000, total)
        q = q * 1000 + step
    return 1 + q


def _traverse(rows: DataFrame, top: int) -> DataFrame:
    """Of each range: sums of differences of all pairs of sources (part pair: source before item), and each source's first ``top`` terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, names, n, v, terms = None, [], [], 0, []
        out: dict[str, list] = {k: [] for k in ("lang", "source", "part", "item", "value")}

        def put(source: str, part: str, item: str, value: int) -> None:
            for k, x in zip(out, (key[0], source, part, item, value), strict=True):
                out[k].append(x)

        def batch() -> pa.RecordBatch:
            got = pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k == "value" else pa.string()) for k, c in out.items()], names=list(out))
            for c in out.values():
                c.clear()
            return got

        def counts(block: list) -> np.ndarray:
            got = np.zeros((len(block), len(names)), np.int64)
            where = {s: i for i, s in enumerate(names)}
            for i, (_, sources, occurrences) in enumerate(block):
                got[i, [where[s] for s in sources]] = occurrences
            return got

        def close() -> Iterator[pa.RecordBatch]:
            if key is None:
                return
            size, total = max(1, BLOCK // max(1, len(names))), np.array(n, np.int64)
            best: list[list] = [[] for _ in names]
            for first in range(0, len(names), TILE):
                tile = range(first, min(first + TILE, len(names)))
                sums = np.zeros((len(tile), len(names)), np.int64)
                for s in range(0, len(terms), size):
                    c = counts(terms[s : s + size])
                    p = share(c + ADDED, total + ADDED * v)
                    for k, i in enumerate(tile):
                        sums[k, i + 1 :] += np.abs(p[:, i : i + 1] - p[:, i + 1 :]).sum(0)
                    # terms of the language as a whole
                    q = share(c.sum(1) + ADDED, np.full(len(c), total.sum() + ADDED * v))
                    over = np.where(c[:, tile.start : tile.stop] > 0, p[:, tile.start : tile.stop] - q[:, None], 0)
                    for k, i in enumerate(tile):
                        more = np.flatnonzero(over[:, k] > 0)
                        # terms come in byte order, and a stable sort leaves ties in it
                        pool = best[i] + [(-x, s + j) for x, j in zip(over[more, k].tolist(), more.tolist(), strict=True)]
                        best[i] = sorted(pool)[:top]
                for k, i in enumerate(tile):
                    for j in range(i + 1, len(names)):
                        put(names[i], "pair", names[j], int(sums[k, j]))
                    for x, j in best[i]:
                        put(names[i], "term", terms[j][0].decode(), -x)
                yield batch()

        for b in batches:
            for lang, rid, term, sources, occurrences, source, of, kept in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (lang, rid) != key:
                    yield from close()
                    key, names, n, v, terms = (lang, rid), [], [], 0, []
                if term is None:
                    names.append(source)
                    n.append(of)
                    v = kept
                else:
                    terms.append((term, sources, occurrences))
        yield from close()
        yield batch()
        release()

    order = ["lang", "rid", F.col("term").asc_nulls_first(), "of_source"]
    return rows.repartition("lang", "rid").sortWithinPartitions(*order).mapInArrow(run, "lang string, source string, part string, item string, value long")


def audit(df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least: int = LEAST_DOCS, top: int = TOP, **tries) -> DataFrame:
    """``lang, source, part, item, value, rank``: for every (language, source) that occurs, all other sources of the language by their distance
    over the kept terms (part ``pair``), and up to ``top`` terms that are commoner there than in the language (part ``term``).

    Null texts, languages and sources count as empty ones. Ranks run from 1 by falling value, equal values by the item's bytes. A language without
    a kept term has pairs at distance 0; one with a single source has none. Repeated rows are documents of their own, whatever their ids.
    Whole texts of any length count; an empty table gives no rows. Only the three columns named are read. ``tries``: see :func:`kept_terms`.
    """
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    docs = df.select(empty(text_col).alias("text"), empty(lang_col).alias("lang"), empty(source_col).alias("source"))
    kept = kept_terms(docs, least, **tries)
    # sizes of the groups, groups without a kept term too
    each = kept.select("lang", F.explode(F.arrays_zip("source", "occurrences")).alias("x")).groupBy("lang", "x.source").agg(F.sum("x.occurrences").alias("of"))
    v = kept.groupBy("lang").agg(F.count("*").alias("kept"))
    groups = docs.select("lang", "source").distinct().join(each, ["lang", "source"], "left").join(v, "lang", "left").na.fill(0, ["of", "kept"])
    groups = materialize(groups, "groups")
    # ranges of terms in byte order; every language has one at least, which carries its sources
    sizes = kept.groupBy("lang", "prefix").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("lang").orderBy("prefix")) - F.col("n")
    ranges = sizes.select("lang", "prefix", F.floor(before / RANGE_TERMS).alias("rid"))
    ids = ranges.select("lang", "rid").unionByName(groups.select("lang", F.lit(0).cast("long").alias("rid"))).distinct()
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    heads = ids.join(groups, "lang").select("lang", "rid", none("binary", "term"), none("array<string>", "source"), none("array<bigint>", "occurrences"), F.col("source").alias("of_source"), "of", "kept")
    rows = kept.join(ranges, ["lang", "prefix"]).select("lang", "rid", "term", "source", "occurrences", none("string", "of_source"), none("long", "of"), none("long", "kept"))
    found = materialize(_traverse(heads.unionByName(rows), top), "found")
    pairs = found.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    both = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item"))))
    pairs = pairs.select("lang", "part", "value", both.alias("x")).select("lang", "x.source", "part", "x.item", "value")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank")
    terms = found.where("part = 'term'").select(*found.columns, rank).where(F.col("rank") <= top)
    return pairs.select(*found.columns, rank).unionByName(terms)
