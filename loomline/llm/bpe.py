"""Byte-level BPE encoding and decoding by *speculate and verify*.

A word is first cut greedily into the longest vocabulary entries. The cut equals the result of the merge
procedure exactly when every two neighbouring tokens are compatible, that is when merging their joint
bytes yields these two tokens again; the test unwinds the merges on either side of the seam and needs no
other context. All seams of a batch are tested together in numpy. Only words with a bad seam are merged
exactly, all of one length class in lock-step.

Texts are cut into space-delimited chunks first, each chunk is encoded once and remembered, and a text's ids are
gathered from those of its chunks. A text where white space touches a space, or which holds a special
token, is cut by the full pattern instead.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import json
from functools import lru_cache
from itertools import chain, compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from loomline.llm.arrow import per_text, release

#: The published pre-tokenisation pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
NO_LIMIT = np.int64(1 << 40)
#: Chunks remembered by a worker; the store is emptied when it is full (speed only).
REMEMBERED = 300_000
#: Characters handled at a time: the more, the fewer chunks are looked up twice.
BLOCK = 1 << 20
#: Words up to this many bytes are merged in lock-step, longer ones with a heap.
LOCKSTEP = 32
#: Marks that often end a chunk of letters.
MARKS = frozenset(".,;:!?")
#: Size of the tables of merges, as a power of two.
HASH_BITS = 20


def byte_symbols() -> dict[str, int]:
    """The printable stand-in character of every byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tables of one vocabulary. Inner ids: 0-255 the bytes, then the merges in order of rank."""

    def __init__(self, content: str):
        spec = json.loads(content)
        symbols = byte_symbols()
        raw = lambda s: bytes(symbols[c] for c in s)
        vocab = {raw(s): i for s, i in spec["model"]["vocab"].items() if all(c in symbols for c in s)}
        self.specials = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        self.inner: dict[bytes, int] = {bytes([b]): b for b in range(256)}
        tokens = [bytes([b]) for b in range(256)]
        left, right = list(range(256)), list(range(256))
        for m in spec["model"]["merges"]:
            a, b = map(raw, m.split(" ") if isinstance(m, str) else m)
            if a + b in self.inner:
                raise ValueError("two merges make the same token; this vocabulary is not supported")
            left.append(self.inner[a])
            right.append(self.inner[b])
            self.inner[a + b] = len(tokens)
            tokens.append(a + b)
        self.left, self.right = np.array(left, np.int64), np.array(right, np.int64)
        n = len(tokens)
        self.n = n
        self._hash(self.left[256:] * n + self.right[256:])
        self.outer = np.array([vocab.get(t, -1) for t in tokens], np.int64)
        self.bytes_of: dict[int, bytes] = {i: t for t, i in vocab.items()} | {i: s.encode() for s, i in self.specials.items()}
        self._trie()
        made = np.arange(256, n)
        sound = np.ones(n, bool)
        sound[256:] = self.compatible(self.left[256:], self.right[256:], made)
        self.sound = sound & (self.outer >= 0)
        for i in range(256, n):
            if not (self.sound[left[i]] and self.sound[right[i]]):
                self.sound[i] = False
        self.special_pattern = regex.compile("|".join(regex.escape(s) for s in sorted(self.specials, key=len, reverse=True))) if self.specials else None

    def _hash(self, keys: np.ndarray) -> None:
        """Two tables from a pair's key to its merge; keys whose place in the first is taken go to the second."""
        self.keys = np.append(keys, -1)
        rng, todo, self.tables = np.random.default_rng(1), np.arange(len(keys)), []
        while len(todo):
            while True:
                mult = int(rng.integers(1 << 61, 1 << 62)) | 1
                place = self._place(keys[todo], mult)
                _, at = np.unique(place, return_index=True)
                if not self.tables or len(at) == len(todo):
                    break
            table = np.full(1 << HASH_BITS, len(keys), np.int32)
            table[place[at]] = todo[at]
            self.tables.append((mult, table))
            todo = np.delete(todo, at)

    @staticmethod
    def _place(k: np.ndarray, mult: int) -> np.ndarray:
        return (k.astype(np.uint64) * np.uint64(mult)) >> np.uint64(64 - HASH_BITS)

    def lookup(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Inner id that merges a and b, or NO_LIMIT."""
        k = a * self.n + b
        at = self.tables[0][1][self._place(k, self.tables[0][0])]
        if len(self.tables) > 1:
            taken = np.flatnonzero((self.keys[at] != k) & (at < len(self.keys) - 1))
            if len(taken):
                mult, table = self.tables[1]
                at[taken] = table[self._place(k[taken], mult)]
        return np.where(self.keys[at] == k, at + np.int64(256), NO_LIMIT)

    def compatible(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """Whether merging the bytes of a and b gives back a and b, for each pair.

        The merges of both sides are undone from the latest on. If, before a merge that formed a side,
        the tokens at the seam could merge at a lower rank, the procedure would have joined them first.
        """
        a, b = a.astype(np.int64).copy(), b.astype(np.int64).copy()
        limit = np.full(len(a), NO_LIMIT) if limit is None else limit.astype(np.int64).copy()
        good = np.zeros(len(a), bool)
        live = np.arange(len(a))
        while len(live):
            x, y, lim = a[live], b[live], limit[live]
            ok = self.lookup(x, y) >= lim
            live, x, y, lim = live[ok], x[ok], y[ok], lim[ok]
            undo_left = (x > y) & (x >= 256)
            undo_right = ~undo_left & (y >= 256)
            # a base byte cannot be undone; then the other side is
            undo_left |= ~undo_right & (x >= 256)
            done = ~undo_left & ~undo_right
            good[live[done]] = True
            lim = np.where(undo_left, x, np.where(undo_right, y + 1, lim))
            a[live] = np.where(undo_left, self.right[x], x)
            b[live] = np.where(undo_right, self.left[y], y)
            limit[live] = lim
            live = live[~done]
        return good

    def _trie(self) -> None:
        """Dense child table of the inner nodes of the entries' trie, and the entry that ends at each node."""
        children: dict[tuple[int, int], int] = {}
        ends = [-1]
        for t, i in self.inner.items():
            node = 0
            for c in t:
                if (nxt := children.get((node, c))) is None:
                    nxt = children[node, c] = len(ends)
                    ends.append(-1)
                node = nxt
            ends[node] = i
        inner = sorted({n for n, _ in children})
        row = np.zeros(len(ends), np.int32)
        row[inner] = np.arange(1, len(inner) + 1)
        self.child = np.full((len(inner) + 1, 257), -1, np.int32)
        for (n, c), nxt in children.items():
            self.child[row[n], c] = nxt
        self.row, self.ends = row, np.array(ends, np.int64)

    def greedy_all(self, buffer: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Longest entries from the left, all words in lock-step: flat ids and ids per word. Words are runs of bytes of the buffer."""
        n = len(start)
        flat, at, end = np.append(buffer.astype(np.int16), 256), start, start + size
        live = np.flatnonzero(at < end)
        cur, node = at[live], np.zeros(len(live), np.int32)
        stop, entry, last = cur.copy(), np.full(len(live), -1), end[live]
        owners, ids = [], []
        while len(live):
            byte = np.where(cur < last, flat[cur], 256)
            nxt = self.child[self.row[node], byte]
            on = nxt >= 0
            node = np.where(on, nxt, 0)
            cur = np.where(on, cur + 1, stop)
            hit = np.where(on, self.ends[node], -1)
            if not on.all():
                off = ~on
                owners.append(live[off])
                ids.append(entry[off])
            good = hit >= 0
            stop, entry = np.where(good, cur, stop), np.where(good, hit, entry)
            left = on | (cur < last)
            if not left.all():
                live, cur, node, stop, entry, last = live[left], cur[left], node[left], stop[left], entry[left], last[left]
        if not owners:
            return np.zeros(0, np.int64), np.zeros(n, np.int64)
        owner = np.concatenate(owners)
        order = np.argsort(owner, kind="stable")
        return np.concatenate(ids)[order], np.bincount(owner, minlength=n)

    def merge_long(self, word: bytes) -> list[int]:
        """Exact merging with a heap: n log n for any length."""
        toks, n = list(word), len(word)
        prev, nxt = list(range(-1, n - 1)), [*range(1, n), -1]
        a = np.frombuffer(word, np.uint8).astype(np.int64)
        heap = [(int(r), i) for i, r in enumerate(self.lookup(a[:-1], a[1:])) if r < NO_LIMIT]
        heapq.heapify(heap)
        pair = {(int(x), int(y)): i for x, y, i in zip(self.left[256:], self.right[256:], range(256, self.n), strict=True)} if n > 4096 else None
        one = (lambda x, y: pair.get((x, y), NO_LIMIT)) if pair is not None else (lambda x, y: int(self.lookup(np.array([x]), np.array([y]))[0]))
        while heap:
            r, i = heapq.heappop(heap)
            j = nxt[i] if toks[i] >= 0 else -1
            if j < 0 or self.left[r] != toks[i] or self.right[r] != toks[j]:
                continue
            toks[i], toks[j], nxt[i] = r, -1, nxt[j]
            if nxt[i] >= 0:
                prev[nxt[i]] = i
                if (s := one(r, toks[nxt[i]])) < NO_LIMIT:
                    heapq.heappush(heap, (s, i))
            if prev[i] >= 0 and (s := one(toks[prev[i]], r)) < NO_LIMIT:
                heapq.heappush(heap, (s, prev[i]))
        return [t for t in toks if t >= 0]

    def merge_all(self, buffer: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact merging of words of at most LOCKSTEP bytes, one merge of each word per step: flat inner ids and ids per word.

        A token stays in the place of its first byte; places are linked, and those swallowed hold -1.
        """
        n, width = len(start), int(size.max())
        far = np.int32(np.iinfo(np.int32).max)
        cols = np.arange(width + 1, dtype=np.int32)
        inside = cols < size[:, None]
        toks = np.full((n, width + 1), -1, np.int32)
        toks[inside] = buffer[_spans(start, size)]
        rank = np.full((n, width + 1), far, np.int32)
        seam = inside[:, 1:]
        rank[:, :-1][seam] = np.minimum(self.lookup(toks[:, :-1][seam].astype(np.int64), toks[:, 1:][seam]), far)
        # the last place of each row is no token: the next of a word's last one
        after = np.where(cols + 1 < size[:, None], cols + 1, width).astype(np.int32)
        before = np.repeat(cols[None] - 1, n, 0)
        done, rows = [], np.arange(n)
        number = rows
        while len(rows):
            j = rank.argmin(1)
            best = rank[rows, j]
            on = best < far
            live = int(on.sum())
            if live < 0.8 * len(rows):
                done.append((number[~on], toks[~on]))
                toks, rank, after, before, number, j, best = (x[on] for x in (toks, rank, after, before, number, j, best))
                rows = np.arange(live)
                at = rows
            else:
                at, j, best = np.flatnonzero(on), j[on], best[on]
            if not live:
                if len(rows):
                    done.append((number, toks))
                break
            k = after[at, j]
            further = after[at, k]
            toks[at, j], toks[at, k] = best, -1
            rank[at, k] = far
            after[at, j] = further
            before[at, further] = j
            best = best.astype(np.int64)
            nxt, prev = toks[at, further], before[at, j]
            rank[at, j] = np.where(nxt >= 0, np.minimum(self.lookup(best, np.maximum(nxt, 0)), far), far)
            has = prev >= 0
            at, prev = at[has], prev[has]
            rank[at, prev] = np.minimum(self.lookup(toks[at, prev].astype(np.int64), best[has]), far)
        table = np.full((n, width + 1), -1, np.int32)
        for i, t in done:
            table[i] = t
        kept = table >= 0
        return table[kept].astype(np.int64), kept.sum(1)

    def encode_words(self, buffer: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """The vocabulary's ids of each word (a run of bytes of the buffer) as flat ids and ids per word, and how many words were merged exactly."""
        flat, size = self.greedy_all(buffer, start, length)
        owner = np.repeat(np.arange(len(start)), size)
        same = owner[1:] == owner[:-1]
        pairs, at = np.unique((flat[:-1] * self.n + flat[1:])[same], return_inverse=True)
        fine = self.compatible(pairs // self.n, pairs % self.n)[at]
        bad = np.zeros(len(start), bool)
        bad[owner[:-1][same][~fine]] = True
        bad[owner[~self.sound[flat]]] = True
        todo = np.flatnonzero(bad)
        if not len(todo):
            return self.outer[flat], size, 0
        kept = ~bad[owner]
        owners, ids = [owner[kept]], [flat[kept]]
        for lo, hi in ((0, 8), (8, 12), (12, 16), (16, LOCKSTEP)):
            which = todo[(length[todo] > lo) & (length[todo] <= hi)]
            for s in range(0, len(which), 20_000):
                part = which[s : s + 20_000]
                got, n = self.merge_all(buffer, start[part], length[part])
                owners.append(np.repeat(part, n))
                ids.append(got)
        for i in todo[length[todo] > LOCKSTEP].tolist():
            got = np.array(self.merge_long(buffer[start[i] : start[i] + length[i]].tobytes()), np.int64)
            owners.append(np.full(len(got), i))
            ids.append(got)
        owner = np.concatenate(owners)
        order = np.argsort(owner, kind="stable")
        return self.outer[np.concatenate(ids)[order]], np.bincount(owner, minlength=len(start)), len(todo)


def runs(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all words in a row, and where each starts and how long it is."""
    raw = [w.encode() for w in words]
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum(size) - size, size


def spaced(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``runs``, each word after a space; the words hold none themselves."""
    flat = np.frombuffer((" " + " ".join(words)).encode() if words else b"", np.uint8)
    start = np.flatnonzero(flat == 32)
    return flat, start, np.diff(np.append(start, len(flat)))


class _Numbered(dict):
    """Numbers its keys in order of first use and lists the new ones."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        n = self[key] = len(self)
        self.new.append(key)
        return n


class Encoder:
    """Encodes texts to the vocabulary's ids, as its pre-tokeniser, merges and special tokens define them."""

    def __init__(self, content: str):
        self.v = Vocabulary(content)
        self.pattern = regex.compile(PATTERN)
        self.exact = self.words = 0
        self.forget()

    def forget(self) -> None:
        """Empty the store of known chunks."""
        self.known = _Numbered()
        self.flat = np.zeros(1 << 16, np.int32)
        self.start = np.zeros(1 << 12, np.int64)
        self.size = np.zeros(1 << 12, np.int64)
        self.odd = np.zeros(1 << 12, bool)
        self.used = 0

    def _learn(self) -> None:
        """Encode the chunks met for the first time.

        A chunk stands for itself after a space, or at a text's start if it is marked with \\1. Letters only are one
        word; so is what follows a NUL, any match of the pattern. Every other chunk is made of words, which are
        numbered like chunks and encoded with the rest.
        """
        if not self.known.new:
            return
        # many small tuples are made here, and none of them in cycles
        collecting = gc.isenabled()
        gc.disable()
        try:
            self._learn_new()
        finally:
            if collecting:
                gc.enable()

    def _learn_new(self) -> None:
        known = self.known
        first, number, find = len(known) - len(known.new), known.__getitem__, self.pattern.findall
        several, parts, odd = [], [], []
        new = known.new  # grows while words of chunks are numbered
        for k, c in enumerate(known.new.copy()):
            if c.isalpha() or c[:1] == "\0":
                continue
            if c[-1:] in MARKS and c[:-1].isalpha():
                part, bad = (number(c[:-1]), number("\0" + c[-1])), False
            else:
                # white space at either end (or nothing else): cutting at the spaces was not exact
                bad = not c or c[-1].isspace() or c[0].isspace()
                found = find(c[1:] if c[:1] == "\1" else " " + c)
                part = tuple([number(w[1:] if w[0] == " " and w[1:].isalpha() else "\0" + w) for w in found])
            several.append(k)
            parts.append(part)
            odd.append(bad)
        known.new = []
        is_one = np.ones(len(new), bool)
        is_one[several] = False
        # letters only stand after a space; what follows a NUL stands as it is. Both are numbered in this order
        letters = np.fromiter((c[:1] != "\0" for c in new), bool, len(new)) & is_one
        marked = is_one & ~letters
        (flat, start, size), (flat2, start2, size2) = spaced(list(compress(new, letters.tolist()))), runs([c[1:] for c in compress(new, marked.tolist())])
        ids, n_ids, exact = self.v.encode_words(np.concatenate([flat, flat2]), np.concatenate([start, start2 + len(flat)]), np.concatenate([size, size2]))
        words = np.concatenate([np.flatnonzero(letters), np.flatnonzero(marked)])
        self.exact += exact
        self.words += len(words)
        last = len(known)
        while last > len(self.start):
            self.start, self.size, self.odd = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size, self.odd))
        start, size = self.start[first:last], self.size[first:last]
        self._keep(ids)
        start[words] = self.used - len(ids) + np.cumsum(n_ids) - n_ids
        size[words] = n_ids
        if several:
            n_words = np.fromiter(map(len, parts), np.int64, len(parts))
            of = np.fromiter(chain.from_iterable(parts), np.int64, int(n_words.sum()))
            self._keep(self._gather(of))
            sums = np.concatenate([[0], np.cumsum(self.size[of])])
            ends = np.cumsum(n_words)
            n = sums[ends] - sums[ends - n_words]
            start[several] = self.used - int(sums[-1]) + np.cumsum(n) - n
            size[several] = n
            self.odd[first:last][several] = odd

    def _keep(self, ids: np.ndarray) -> None:
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.used += len(ids)

    def _gather(self, rows: np.ndarray) -> np.ndarray:
        return self.flat[_spans(self.start[rows], self.size[rows])]

    def _by_pattern(self, text: str) -> np.ndarray:
        """The plain way for a text of any form."""
        out, last = [], 0
        cuts = [(m.start(), m.end(), self.v.specials[m.group()]) for m in self.v.special_pattern.finditer(text)] if self.v.special_pattern else []
        for s, e, i in [*cuts, (len(text), len(text), None)]:
            words = self.pattern.findall(text[last:s])
            rows = np.fromiter((self.known["\0" + w] for w in words), np.int64, len(words))
            self._learn()
            out.append(self._gather(rows))
            if i is not None:
                out.append(np.array([i], np.int32))
            last = e
        return np.concatenate(out)

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text. The chunks of all texts are cut and made distinct together, so that each is looked up once."""
        if len(self.known) > REMEMBERED or self.used > 8 * REMEMBERED:
            self.forget()
        special = ["\0", "\1", *self.v.specials]
        plain = np.array([not any(s in t for s in special) for t in texts], bool)
        # a chunk stands after a space, or is marked as the text's first
        marked = [t[1:] if t[:1] == " " else "\1" + t for t, ok in zip(texts, plain.tolist(), strict=True) if ok and t]
        cut = pc.split_pattern(pa.array(marked, pa.large_string()), " ")
        chunks = cut.flatten().dictionary_encode()
        numbers = np.fromiter(map(self.known.__getitem__, chunks.dictionary.to_numpy(zero_copy_only=False)), np.int64, len(chunks.dictionary))
        self._learn()
        rows = numbers[chunks.indices.to_numpy()]
        ends = np.zeros(len(texts) + 1, np.int64)
        ends[1:][plain & np.fromiter(map(len, texts), np.int64, len(texts)).astype(bool)] = np.diff(cut.offsets.to_numpy())
        ends = np.cumsum(ends)
        # cutting at each space is exact if no white space touches a space
        odd = np.concatenate([[0], np.cumsum(self.odd[rows])])[ends]
        plain &= odd[1:] == odd[:-1]
        size = self.size[rows]
        ids = self.flat[_spans(self.start[rows], size)]
        at = np.concatenate([[0], np.cumsum(size)])[ends].tolist()
        return [ids[s:e] if ok else self._by_pattern(t) for t, s, e, ok in zip(texts, at[:-1], at[1:], plain.tolist(), strict=True)]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.v.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


def _spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indexes of all elements of runs, one run after the other."""
    ends = np.cumsum(size)
    return np.repeat(start - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)


@lru_cache(maxsize=2)
def encoder(content: str) -> Encoder:
    """One encoder per worker process."""
    made = Encoder(content)
    release()  # building leaves as much behind as it keeps
    return made


def load_vocabulary(path: str) -> str:
    """The vocabulary file's content, read on the driver and sent with the tasks (its size is fixed)."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``ids`` (array of int) of every whole text; a null text counts as empty and has no ids.

    One row per input row, repeated rows and null ids included; an empty table gives an empty table.
    """
    shared = df.sparkSession.sparkContext.broadcast(load_vocabulary(vocabulary))

    def make():
        enc = encoder(shared.value)

        def f(texts):
            got = enc.encode_batch([t or "" for t in texts])
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in got])]).astype(np.int32)
            return {"ids": pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(got).astype(np.int32) if got else np.zeros(0, np.int32)))}

        f.close = enc.forget
        return f

    return per_text(df, id_col, text_col, "ids array<int>", make, BLOCK)


def decode(df: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``text`` of every list of ids, special tokens included; null ids give null."""
    from pyspark.sql import functions as F

    shared = df.sparkSession.sparkContext.broadcast(load_vocabulary(vocabulary))
    src = df.select(F.col(id_col).alias(id_col), F.col(ids_col).cast("array<int>").alias("ids"))

    def run(batches):
        enc = encoder(shared.value)
        for b in batches:
            out = [None if x is None else enc.decode(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=[id_col, "text"])

    return src.mapInArrow(run, f"{id_col} {src.schema[id_col].dataType.simpleString()}, text string")


def round_trip(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digest of encoding then decoding every whole text in one pass: n_tokens, ids_sha256, decoded_sha256.

    Null texts count as empty (0 tokens, digests of the empty string).
    """
    shared = df.sparkSession.sparkContext.broadcast(load_vocabulary(vocabulary))

    def make():
        enc = encoder(shared.value)
        name = {i: str(i) for i in enc.v.bytes_of}.__getitem__
        raw = enc.v.bytes_of.__getitem__

        def f(texts):
            got = [x.tolist() for x in enc.encode_batch([t or "" for t in texts])]
            sha = lambda b: hashlib.sha256(b).hexdigest()
            return {
                "n_tokens": pa.array([len(x) for x in got], pa.int64()),
                "ids_sha256": pa.array([sha(",".join(map(name, x)).encode()) for x in got], pa.string()),
                "decoded_sha256": pa.array([sha(b"".join(map(raw, x)).decode("utf-8", "replace").encode()) for x in got], pa.string()),
            }

        f.close = enc.forget
        return f

    return per_text(df, id_col, text_col, "n_tokens long, ids_sha256 string, decoded_sha256 string", make, BLOCK)
