"""Counts of sentences and documents by phrase, for any number of phrases: windows of a text are looked up where its row is."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.functions import text as T
from loomline.operators.joined import phrase_hits, sentence_table
from loomline.scratch import materialize

#: By size the bits of a place and the filter, of phrases and of their beginnings.
Filters = tuple[dict[int, tuple[int, np.ndarray]], dict[int, tuple[int, np.ndarray]]]
#: Characters of the longest phrase that is found by its window; longer ones are joined by their grams.
LONGEST = 64
#: Bits of the filters a phrase, powers of two of the least bits of one and of the most of all before each is rounded up (so 32 MB), and bits that a phrase sets.
BITS, LEAST, MOST, PROBES = 64, 12, 27, 3
#: The same for the filters of beginnings, in which a beginning sets one bit (so 4 MB; a task holds a byte a bit).
FIRST_BITS, FIRST_MOST = 16, 24
#: Characters looked up at a time (memory only).
CHUNK = 1 << 18
#: Slots in which equal windows of a chunk meet.
SLOTS = 18
#: Bits of a character: windows of up to ``PACKED`` characters are numbers.
WIDE, NARROW, PACKED = 21, 7, 2
_ODD = [np.uint64(v) for v in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
BASE = 0xBF58476D1CE4E5B9


def _begin(k: int) -> int:
    """The largest power of two up to k: a window of k characters begins with one of these."""
    return 1 << (k.bit_length() - 1)


def _powers(points: np.ndarray, most: int) -> dict[int, np.ndarray]:
    """Hashes of the windows at every place, by their size: powers of two up to ``most``."""
    power, size = {1: points.astype(np.uint64)}, 1
    while 2 * size <= most:
        h = power[size]
        both = h[: max(len(h) - size, 0)] * np.uint64(pow(BASE, size, 1 << 64))
        both += h[size:]
        size *= 2
        power[size] = both
    return power


def _hash(power: dict[int, np.ndarray], pos: np.ndarray, k: int) -> np.ndarray:
    """Hash of the windows of k characters at ``pos``."""
    done = _begin(k)
    h = power[done][pos]
    for p in sorted((p for p in power if k & p and p < done), reverse=True):
        h, done = h * np.uint64(pow(BASE, p, 1 << 64)) + power[p][pos + done], done + p
    return h


def _slots(h: np.ndarray, bits: int, probe: int) -> np.ndarray:
    return (h ^ (h >> np.uint64(29))) * _ODD[probe] >> np.uint64(64 - bits)


def _first_slots(h: np.ndarray, bits: int) -> np.ndarray:
    h = h * _ODD[3]
    h >>= np.uint64(64 - bits)
    return h


def _passes(h: np.ndarray, bits: int, held: np.ndarray) -> np.ndarray:
    """Places in ``h`` of the hashes that a filter lets through."""
    at = np.arange(len(h))
    for probe in range(PROBES):
        slot = _slots(h[at], bits, probe)
        at = at[(held[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 > 0]
    return at


def _points(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint8) if data.isascii() else np.frombuffer(data.decode().encode("utf-32-le"), np.uint32)


def _texts(strings: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Characters of all strings in a row, and of each string its length in characters and its first byte."""
    strings = strings.cast(pa.large_string())
    at = np.frombuffer(strings.buffers()[1], np.int64)[strings.offset : strings.offset + len(strings) + 1]
    data = strings.buffers()[2]
    return pc.utf8_length(strings).to_numpy(zero_copy_only=False), at, memoryview(data) if data is not None else memoryview(b"")


def _strings(chars: np.ndarray) -> pa.Array:
    """A row of characters a string."""
    size = 1 + (chars > 0x7F).astype(np.int64) + (chars > 0x7FF) + (chars > 0xFFFF)
    at = np.concatenate([[0], np.cumsum(size.sum(1))])
    return pa.LargeStringArray.from_buffers(len(chars), pa.py_buffer(at), pa.py_buffer(chars.astype("<u4").tobytes().decode("utf-32-le").encode())).cast(pa.string())


def _alike(points: np.ndarray, pos: np.ndarray, h: np.ndarray, k: int) -> np.ndarray:
    """For each window at ``pos`` the place of one that holds the same characters, the same place for all of these."""
    same, left = np.empty(len(pos), np.int64), np.arange(len(pos))
    first, turn = np.empty(1 << SLOTS, np.int64), 0
    while len(left):
        slot = _slots(h[left] + np.uint64(turn), SLOTS, turn % len(_ODD))
        first[slot] = left
        meet = first[slot]
        ok = h[meet] == h[left]
        here = np.flatnonzero(ok)
        a, b = pos[left[here]], pos[meet[here]]
        ok[here] = np.logical_and.reduce([points[a + j] == points[b + j] for j in range(k)])
        same[left[ok]] = pos[meet[ok]]
        left, turn = left[~ok], turn + 1
    return same


def _distinct(x: np.ndarray) -> np.ndarray:
    x.sort()
    return x[_changes(x)]


def _changes(x: np.ndarray) -> np.ndarray:
    """Where a value differs from the one before."""
    new = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=new[1:])
    return new


def _packed(points: np.ndarray, sent: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of windows of few characters the distinct pairs with sentences: the number of the window, its characters and the sentence."""
    width, low = NARROW if points.dtype == np.uint8 else WIDE, max(n - 1, 1).bit_length()
    kind = np.uint32 if k * width + low <= 32 else np.uint64  # of up to 2 ** 22 sentences; a chunk has no more than characters
    m = len(sent) - k + 1
    pair = points[:m].astype(kind)
    for j in range(1, k):
        pair <<= kind(width)
        pair |= points[j : m + j]
    pair <<= kind(low)
    pair |= sent[:m].astype(kind)
    pair = _distinct(pair[sent[:m] == sent[k - 1 :]])
    term = pair >> kind(low)
    mask = kind((1 << width) - 1)
    return term, np.stack([(term >> kind(width * (k - 1 - j))) & mask for j in range(k)], 1), (pair & kind((1 << low) - 1)).astype(np.int64)


def _counted(points: np.ndarray, sizes: np.ndarray, owner: np.ndarray, filters: Filters, by_owner: bool) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """Of sentences laid end to end, with their owners in ascending order, the phrases that pass the filter, with their sentences and owners (or with each owner and its sentences)."""
    whole, first = filters
    sent, n, total = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes), np.int64(len(sizes)), len(points)
    power = _powers(points, _begin(max(whole))) if max(whole) > PACKED else {}
    begins = {c: np.flatnonzero(held[_first_slots(power[c], bits)]) for c, (bits, held) in first.items()}
    for k, (bits, held) in sorted(whole.items()):
        if total < k:
            continue
        if k <= PACKED:
            term, chars, at = _packed(points, sent, len(sizes), k)
            heads = np.flatnonzero(_changes(term))
            known = np.zeros(len(heads), bool)
            known[_passes(_hash(_powers(chars[heads].ravel(), k), np.arange(0, len(heads) * k, k), k), bits, held)] = True
            kept = np.repeat(known, np.diff(np.append(heads, len(term))))
            term, chars, at = term[kept], chars[kept], at[kept]
        else:
            pos = begins[_begin(k)]
            pos = pos[pos <= total - k]
            pos = pos[sent[pos] == sent[pos + k - 1]]
            h = _hash(power, pos, k)
            ok = _passes(h, bits, held)
            pos = pos[ok]
            pair = _distinct(_alike(points, pos, h[ok], k) * n + sent[pos])
            term, at = pair // n, pair % n
            chars = points[term[:, None] + np.arange(k)]
        if not len(term):
            continue
        whose, new_term = owner[at], _changes(term)
        new = new_term | _changes(whose)
        if by_owner:
            at = np.flatnonzero(new)
            second = whose[at]
        else:
            at = np.flatnonzero(new_term)
            second = np.add.reduceat(new.astype(np.int64), at)
        yield _strings(chars[at]), np.diff(np.append(at, len(term))), second


def _chunks(sizes: np.ndarray, owner: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of sentences of about ``CHUNK`` characters that end with their owner, where one owner has no more than these."""
    s = 0
    ends = np.cumsum(sizes)
    while s < len(sizes):
        most = (ends[s - 1] if s else 0) + CHUNK
        e = min(max(int(np.searchsorted(ends, most, "right")), s + 1), s + CHUNK)
        if e < len(sizes) and owner[e] == owner[e - 1]:
            whole = int(np.searchsorted(owner, owner[e - 1], "left"))
            e = whole if whole > s else e
        yield s, e
        s = e


def _count(batches: Iterator[pa.RecordBatch], filters: Filters, by_id: bool) -> Iterator[pa.RecordBatch]:
    """Of rows (id, sentences) the phrases (id, term, n_sentences, n_docs): by id, or of all rows, each a document, with a null id."""
    whole, first = filters
    # a byte a bit, so that a look is one read
    filters = whole, {c: (bits, np.unpackbits(held, bitorder="little").view(bool)) for c, (bits, held) in first.items()}
    for b in batches:
        ids, lists = b.column(0), b.column(1)
        owner = np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
        flat = pc.fill_null(lists.flatten(), "")
        sizes, at, data = _texts(flat)
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        for s, e in _chunks(sizes, owner):
            # a document that is cut, or one without an id, is not counted with others
            cut = (s > 0 and owner[s - 1] == owner[s]) or (e < len(owner) and owner[e] == owner[e - 1])
            single = by_id or cut or not known[owner[s:e]].all()
            for term, n, second in _counted(_points(bytes(data[at[s] : at[e]])), sizes[s:e], owner[s:e], filters, single):
                if single:
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(second)), term, pa.array(n), pa.array(np.zeros(len(n), np.int64))], names=["id", "term", "n_sentences", "n_docs"])
                else:
                    yield pa.RecordBatch.from_arrays([pa.nulls(len(n), ids.type), term, pa.array(n), pa.array(second)], names=["id", "term", "n_sentences", "n_docs"])


def _marks(batches: Iterator[pa.RecordBatch], bits: dict[int, int]) -> Iterator[pa.RecordBatch]:
    """Words (size, place, word) of the filters in which the phrases of a batch set their bits; sizes of beginnings are negative."""

    def words(size: int, slot: np.ndarray) -> pa.RecordBatch:
        slot = np.unique(slot)
        word = (slot >> np.uint64(5)).astype(np.int64)
        at = np.flatnonzero(_changes(word))
        value = np.bitwise_or.reduceat(np.int64(1) << (slot & np.uint64(31)).astype(np.int64), at)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(at), size, np.int32)), pa.array(word[at]), pa.array(value)], names=["size", "place", "word"])

    for b in batches:
        size = pc.utf8_length(b.column(0)).to_numpy(zero_copy_only=False)
        for k in np.unique(size).tolist():
            points = _points("".join(b.column(0).filter(pa.array(size == k)).to_pylist()).encode())
            power, at, c = _powers(points, _begin(k)), np.arange(0, len(points), k), _begin(k)
            h = _hash(power, at, k)
            yield words(k, np.concatenate([_slots(h, bits[k], p) for p in range(PROBES)]))
            if k > PACKED:
                yield words(-c, _first_slots(power[c][at], bits[-c]))


def _sized(rows: dict[int, int], a_phrase: int, most: int) -> dict[int, int]:
    """Bits of a place in the filter of each size, for the number of its phrases."""
    each = min(a_phrase, (1 << most) / max(sum(rows.values()), 1))
    return {k: max(LEAST, int(each * n).bit_length()) for k, n in rows.items()}


def _filters(phrases: DataFrame, rows: dict[int, int]) -> Filters:
    """For each size of phrases the bits of a place and the bytes of a filter that all of them pass, and few others; and the same for their beginnings."""
    firsts: dict[int, int] = {}
    for k, n in rows.items():
        if k > PACKED:
            firsts[_begin(k)] = firsts.get(_begin(k), 0) + n
    bits = _sized(rows, BITS, MOST) | {-c: v for c, v in _sized(firsts, FIRST_BITS, FIRST_MOST).items()}
    marks = phrases.select("term").mapInArrow(lambda x: _marks(x, bits), "size int, place long, word long")
    held = {k: np.zeros(1 << (v - 5), "<u4") for k, v in bits.items()}
    found = marks.groupBy("size", "place").agg(F.bit_or("word").alias("word")).toArrow()
    size, place, word = (found.column(c).to_numpy() for c in ("size", "place", "word"))
    for k, v in held.items():
        v[place[size == k]] = word[size == k]
    made = lambda k: (bits[k], held[k].view(np.uint8))
    return {k: made(k) for k in rows}, {c: made(-c) for c in firsts}


def phrase_counts(docs: DataFrame, phrases: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each phrase (``term``) the sentences whose lower-cased text contains it (n_sentences) and the documents of these (n_docs), if there are any.

    A filter of bits a size (32 MB for all at most, whatever the number of phrases) goes to the documents. Every window of a phrase's size that
    passes is counted with its characters where the row is, and sums by window are joined with the phrases: neither sentences nor hits
    are shuffled, and what the filter lets through by chance meets no phrase. Phrases above ``LONGEST`` characters are joined by their grams.
    Documents with the same id count once, and those without an id as none. Null and empty phrases match nothing; repeated ones count once.
    """
    spark = docs.sparkSession
    terms = materialize(phrases.select("term").where("length(term) > 0").distinct(), "terms")
    rows = {r[0]: r[1] for r in terms.groupBy(F.least(F.length("term"), F.lit(LONGEST + 1)).alias("k")).count().collect()}  # LONGEST rows at most
    long = terms.where(F.length("term") > LONGEST)
    short = terms.where(F.length("term") <= LONGEST)
    kind = docs.schema[id_col].dataType.simpleString()
    found = None
    if few := {k: n for k, n in rows.items() if k <= LONGEST}:
        shared = spark.sparkContext.broadcast(_filters(short, few))
        d = docs.select(F.col(id_col).alias("id"), F.transform(T.sentences(F.coalesce(F.col(text_col), F.lit(""))), F.lower).alias("s"))
        count = lambda x, by_id: x.mapInArrow(lambda b: _count(b, shared.value, by_id), f"id {kind}, term string, n_sentences long, n_docs long")
        again = materialize(d.where("id is not null").groupBy("id").count().where("count > 1").select("id"), "again")
        if again.limit(1).count():
            # ids of several rows are counted by id
            parts = count(d.join(again, "id", "left_anti"), False).unionByName(count(d.join(again, "id", "left_semi"), True))
        else:
            parts = count(d, False)
        # rows with an id are one document by id; the rest is summed already
        by_id = parts.groupBy("term", "id").agg(F.sum("n_sentences").alias("n_sentences"), F.sum("n_docs").alias("n_docs"))
        found = by_id.groupBy("term").agg(F.sum("n_sentences").alias("n_sentences"), (F.sum("n_docs") + F.count("id")).alias("n_docs")).join(short, "term", "left_semi")
    if LONGEST + 1 in rows:
        more = phrase_hits(sentence_table(docs, id_col, text_col), long, id_col).groupBy("term").agg(F.count("*").alias("n_sentences"), F.count_distinct(id_col).alias("n_docs"))
        found = more if found is None else found.unionByName(more)
    if found is None:
        return terms.select("term", F.lit(0).cast("long").alias("n_sentences"), F.lit(0).cast("long").alias("n_docs")).limit(0)
    return found
