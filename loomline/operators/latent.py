"""Latent vectors of sparse matrices in long form, and the extreme pairs of their rows.

Two ways to the same vectors (left singular vectors times singular values). Where every document is a matrix of its own, whose
columns a vocabulary bounds, a task adds up the products of its columns and takes their eigenvectors: rows stream by, however many
there are. One matrix over a whole corpus is factored by block power iteration: its entries stay a table, the block of vectors is a table
with one row a column, both products are joins with a sum, and the driver sees matrices of the block's width only.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.functions import text as T
from loomline.scratch import materialize

#: Latent dimensions; vectors iterated beside these; rounds at most, and the relative change of the singular values that ends them.
COMPONENTS, BESIDE, ROUNDS, TOLERANCE = 5, 10, 24, 1e-9
#: Rows of a document compared with all others at a time.
AT_ONCE = 256


def _eigen(gram: np.ndarray, k: int) -> np.ndarray:
    """The eigenvectors of the k largest eigenvalues, as columns, largest first; those of value zero are left out."""
    w, v = np.linalg.eigh(gram)
    order = np.argsort(w)[::-1][:k]
    return v[:, order[w[order] > 1e-12 * max(w.max(initial=0.0), 1e-300)]]


class _Document:
    """Rows of one document, with its columns numbered as they come."""

    def __init__(self):
        self.columns: dict[str, int] = {}
        self.rows: dict[int, list[tuple[int, float]]] = {}

    def add(self, row: int, column: str, value: float) -> None:
        self.rows.setdefault(row, []).append((self.columns.setdefault(column, len(self.columns)), value))

    def vectors(self, n: int, k: int) -> np.ndarray:
        """``n`` rows in latent space, rows without an entry as zeros; below three rows the matrix itself."""
        m = len(self.columns)
        order = sorted(self.rows)
        if n < 3:
            out = np.zeros((n, max(1, m)))
            for i in order:
                for c, x in self.rows[i]:
                    out[i, c] += x
            return out
        gram = np.zeros((m, m))
        for i in order:
            c, x = (np.array(z) for z in zip(*self.rows[i], strict=True))
            gram[np.ix_(c, c)] += np.outer(x, x)
        v = _eigen(gram, min(k, n - 1, m))
        out = np.zeros((n, max(1, v.shape[1])))
        for i in order:
            c, x = (np.array(z) for z in zip(*self.rows[i], strict=True))
            out[i, : v.shape[1]] = x @ v[c]
        return out


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length 1; zeros stay."""
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    # what is left of a row that is orthogonal to all that was kept is rounding, not a direction
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 1e-9 * max(float(norm.max(initial=0.0)), 1e-300))


def cosines(u: np.ndarray, first: int, last: int) -> np.ndarray:
    """Cosines of rows ``first`` to ``last`` with all rows, half-up at 4 places."""
    return np.floor(u[first:last] @ u.T * 10000 + 0.5) / 10000 + 0.0


def pair_report(u: np.ndarray) -> tuple[float, tuple[float, int, int], tuple[float, int, int]]:
    """Mean cosine of all pairs of unit rows, the most similar pair (the last of equal ones by i, then j) and the least similar one (the first). Two rows at least."""
    n = len(u)
    total, most, least = 0.0, (-2.0, 0, 0), (2.0, 0, 0)
    for s in range(0, n, AT_ONCE):
        c = cosines(u, s, min(n, s + AT_ONCE))
        i, j = np.arange(s, s + len(c))[:, None], np.arange(n)[None, :]
        total += float(np.round(c[j > i] * 10000).sum())
        hi, lo = np.where(j > i, c, -3.0), np.where(j > i, c, 3.0)
        if hi.max() >= most[0]:
            r = np.flatnonzero(hi.max(1) == hi.max())[-1]
            most = max(most, (float(hi[r].max()), s + int(r), int(np.flatnonzero(hi[r] == hi[r].max())[-1])))
        if lo.min() < least[0]:
            r = np.flatnonzero(lo.min(1) == lo.min())[0]
            least = (float(lo[r].min()), s + int(r), int(lo[r].argmin()))
    return total / (n * (n - 1) // 2) / 10000, most, least


def _by_document(entries: DataFrame, sizes: DataFrame, id_col: str, schema: str, one) -> DataFrame:
    """``one(id, n, document)`` -> rows, for each document; entries stream by in the order of documents and rows."""
    kind = sizes.schema[id_col].dataType.simpleString()
    heads = sizes.select(F.col(id_col).alias("id"), F.lit(-1).alias("ix"), F.lit("").alias("token"), F.col("n").cast("double").alias("value"))
    rows = heads.unionByName(entries.select(F.col(id_col).alias("id"), F.col("sent_ix").alias("ix"), "token", "value"))
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n, doc, out = None, 0, _Document(), []

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) or [[] for _ in range(len(names) + 1)]
            got = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["id", *names])
            out.clear()
            return got

        kinds = None
        for b in batches:
            if kinds is None:
                kinds = [b.schema.field(0).type, *({"int": pa.int32(), "double": pa.float64(), "array<double>": pa.list_(pa.float64())}[x.split()[1]] for x in schema.split(", "))]
            for k, ix, token, value in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if ix < 0:  # a document's head comes first
                    if key is not None:
                        out.extend(one(key[0], n, doc))
                        if len(out) > 10_000:
                            yield flush()
                    key, n, doc = (k,), int(value), _Document()
                else:
                    doc.add(ix, token, value)
        if key is not None:
            out.extend(one(key[0], n, doc))
        if kinds is not None:
            yield flush()

    got = rows.repartition("id").sortWithinPartitions("id", "ix", "token").mapInArrow(run, f"id {kind}, {schema}")
    return got.withColumnRenamed("id", id_col)


def sentence_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document the number ``n`` of its sentences."""
    return df.select(id_col, F.size(T.sentences(F.coalesce(F.col(text_col), F.lit("")))).alias("n"))


def sentence_vectors(entries: DataFrame, sizes: DataFrame, id_col: str = "doc_id", k: int = COMPONENTS) -> DataFrame:
    """Sentences in the latent space of their document: id, sent_ix, ``vector`` (at most k and one less than the sentences; signs are arbitrary).

    ``entries``: id, sent_ix, token, value as from TF-IDF, ``sizes``: id, n. Sentences without an entry have zeros; documents of one or two
    sentences keep their own columns, in the order of first use. A document id must be unique and not null.
    """

    def one(doc, n, document):
        return [(doc, i, v.tolist()) for i, v in enumerate(document.vectors(n, k))]

    return _by_document(entries, sizes, id_col, "sent_ix int, vector array<double>", one)


def semantic_pairs(entries: DataFrame, sizes: DataFrame, id_col: str = "doc_id", k: int = COMPONENTS, latent: bool = True) -> DataFrame:
    """Per document of two sentences or more: ``coherence`` (mean cosine of all pairs at 4 places), the most similar pair and the least similar one
    (``most, most_i, most_j, least, least_i, least_j``), in latent space or, without ``latent``, of the entries themselves.

    Every pair is compared, a block of rows against all, and none is written. Of equal cosines the most similar pair is the last by
    (i, j), the least similar one the first. Sentences without an entry have cosine 0 with all.
    """

    def one(doc, n, document):
        if n < 2:
            return []
        mean, most, least = pair_report(unit(document.vectors(n, k))) if latent else sparse_report(document, n)
        return [(doc, n, float(np.floor(mean * 10000 + 0.5) / 10000) + 0.0, *most, *least)]

    return _by_document(entries, sizes, id_col, "n int, coherence double, most double, most_i int, most_j int, least double, least_i int, least_j int", one)


def _matrix(n: int, entries: pa.StructScalar | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Rows, columns (numbered as they come) and values of a document's entries, and the number of columns."""
    parts = entries.flatten() if entries is not None and len(entries) else None
    if parts is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), 0
    token = parts[1].dictionary_encode()
    return parts[0].to_numpy(), token.indices.to_numpy(), parts[2].to_numpy(), len(token.dictionary)


#: Cells of a document's matrix up to which it is held whole; larger ones go by the products of their columns or by postings.
CELLS = 1 << 22


def document_pairs(terms: DataFrame, id_col: str = "doc_id", k: int = COMPONENTS, latent: bool = True) -> DataFrame:
    """As :func:`semantic_pairs`, from one row a document: ``total`` and ``entries`` as of ``frequency.sentence_terms``. Nothing is shuffled."""
    kind = terms.schema[id_col].dataType.simpleString()
    names = ["n", "coherence", "most", "most_i", "most_j", "least", "least_i", "least_j"]

    def report(n: int, entries) -> tuple:
        r, c, x, m = _matrix(n, entries)
        if n * max(1, m) > CELLS:
            document = _Document()
            for e in entries.to_pylist():
                document.add(e["sent_ix"], e["token"], e["value"])
            return pair_report(unit(document.vectors(n, k))) if latent else sparse_report(document, n)
        dense = np.zeros((n, max(1, m)))
        dense[r, c] = x
        if latent and n > 2 and m:
            u, s, _ = np.linalg.svd(dense, full_matrices=False)
            keep = min(k, n - 1, int((s > 1e-6 * max(float(s[0]), 1e-150)).sum()))
            dense = u[:, :keep] * s[:keep]
        return pair_report(unit(dense))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, out = [], []
            for i, n in enumerate(b.column("total").to_pylist()):
                if n > 1:
                    mean, most, least = report(n, b.column("entries")[i].values)
                    ids.append(i)
                    out.append((n, float(np.floor(mean * 10000 + 0.5) / 10000) + 0.0, *most, *least))
            kinds = [pa.float64() if x in ("coherence", "most", "least") else pa.int32() for x in names]
            cols = list(zip(*out, strict=True)) or [[] for _ in names]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(ids, pa.int64())), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=["id", *names])

    got = terms.select(F.col(id_col).alias("id"), "total", "entries").mapInArrow(run, f"id {kind}, n int, coherence double, most double, most_i int, most_j int, least double, least_i int, least_j int")
    return got.withColumnRenamed("id", id_col)


def similar_sentences(terms: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Cosine (rounded) of the sentence pairs i < j of a document that share a term, from ``frequency.sentence_terms``; others are 0.

    Sentences of a document meet block by block where its row is, so no pair is shuffled to be made.
    """
    kind = terms.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0)
            for d, n in enumerate(b.column("total").to_pylist()):
                r, c, x, m = _matrix(n, b.column("entries")[d].values)
                norm = np.sqrt(np.bincount(r, x * x, n))

                def block(s: int) -> np.ndarray:
                    lo, hi = np.searchsorted(r, (s, s + AT_ONCE))  # noqa: B023
                    out = np.zeros((min(AT_ONCE, n - s), m))  # noqa: B023
                    out[r[lo:hi] - s, c[lo:hi]] = x[lo:hi]  # noqa: B023
                    return out

                for s in range(0, n if m else 0, AT_ONCE):
                    left = block(s)
                    for t in range(s, n, AT_ONCE):
                        dot = left @ (left if t == s else block(t)).T
                        i, j = np.nonzero(np.triu(dot, 1) if t == s else dot)  # values are positive: a product above 0 is a term shared
                        cos = np.floor(dot[i, j] / (norm[i + s] * norm[j + t]) * 10000 + 0.5) / 10000 + 0.0
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array(np.full(len(i), d))), pa.array(i + s, pa.int32()), pa.array(j + t, pa.int32()), pa.array(cos)], names=["id", "i", "j", "cosine"])

    return terms.select(F.col(id_col).alias("id"), "total", "entries").mapInArrow(run, f"id {kind}, i int, j int, cosine double").withColumnRenamed("id", id_col)


def sparse_report(document: _Document, n: int) -> tuple[float, tuple[float, int, int], tuple[float, int, int]]:
    """As :func:`pair_report` by postings: only rows that share a column meet; all other pairs have cosine 0 and are counted."""
    rows = {}
    for i, es in document.rows.items():
        c, x = (np.array(z) for z in zip(*es, strict=True))
        size = np.sqrt((x * x).sum())
        if size > 0:
            rows[i] = (c, x / size)
    # postings of every column, in the order of rows
    postings: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    at: dict[int, list] = {}
    for i in sorted(rows):
        for c, x in zip(*(z.tolist() for z in rows[i]), strict=True):
            at.setdefault(c, []).append((i, x))
    for c, es in at.items():
        postings[c] = (np.array([i for i, _ in es]), np.array([x for _, x in es]))
    total, most, least = 0, (-2.0, 0, 0), (2.0, 0, 0)
    acc = np.zeros(n)
    for i in range(n - 1):
        acc[:] = 0.0
        for c, x in zip(*(z.tolist() for z in rows[i]), strict=True) if i in rows else ():
            js, xs = postings[c]
            acc[js] += x * xs
        cos = np.floor(acc[i + 1 :] * 10000 + 0.5)
        total += int(cos.sum())
        top, low = float(cos.max()) / 10000, float(cos.min()) / 10000
        if top >= most[0]:
            most = (top, i, i + 1 + int(np.flatnonzero(cos == cos.max())[-1]))
        if low < least[0]:
            least = (low, i, i + 1 + int(cos.argmin()))
    return total / (n * (n - 1) // 2) / 10000, most, least


#: Columns up to which a matrix is factored by the products of its columns (numbers on the driver: their square).
FEW = 1024


def _by_columns(m: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The vectors of a matrix of few columns from the products of its columns: one pass adds them up, one projects the rows."""
    names = sorted(r[0] for r in m.select("column").distinct().collect())  # FEW at most
    at = {c: i for i, c in enumerate(names)}
    rows = materialize(m.groupBy(*keys, "column").agg(F.sum("value").alias("value")).groupBy(*keys).agg(F.collect_list("column").alias("columns"), F.collect_list("value").alias("values")), "rows")
    rows_of = lambda b: zip(b.column("columns").to_pylist(), b.column("values").to_pylist(), strict=True)

    def dense(part: list[tuple[list, list]]) -> np.ndarray:
        out = np.zeros((len(part), len(at)))
        for i, (cs, xs) in enumerate(part):
            out[i, [at[c] for c in cs]] = xs
        return out

    def parts(b: pa.RecordBatch) -> Iterator[np.ndarray]:
        every = list(rows_of(b))
        for s in range(0, len(every), 1024):
            yield dense(every[s : s + 1024])

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(at), len(at)))
        for b in batches:
            for x in parts(b):
                total += x.T @ x
        i, j = np.nonzero(np.triu(total))
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], names=["i", "j", "x"])

    g = np.zeros((len(at), len(at)))
    for r in rows.mapInArrow(gram, "i int, j int, x double").groupBy("i", "j").agg(F.sum("x").alias("x")).collect():
        g[r["i"], r["j"]] = g[r["j"], r["i"]] = r["x"]
    v = _eigen(g, k)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y = np.concatenate([np.zeros((0, v.shape[1])), *(x @ v for x in parts(b))])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keys), pa.array(list(y), pa.list_(pa.float64()))], names=[*keys, "vector"])

    kinds = ", ".join(f"`{c}` {m.schema[c].dataType.simpleString()}" for c in keys)
    return rows.select(*keys, "columns", "values").mapInArrow(project, f"{kinds}, vector array<double>")


def corpus_vectors(entries: DataFrame, row: Sequence[str], column: str, value: str = "value", k: int = COMPONENTS, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """Rows of one large sparse matrix in latent space: the ``row`` columns and ``vector`` (k numbers, fewer where the rank is less; signs are arbitrary).

    Of up to ``FEW`` columns the products are added up in one pass, and their eigenvectors give the vectors exactly. Beyond that, block power iteration: k + 10 vectors are multiplied by the matrix and its transpose until the singular values stand still (to
    ``tolerance`` relative, or ``rounds``), made orthogonal again each round by the block's own Gram matrix, which is all that reaches the
    driver. Directions of vanishing length are deflated: they leave the block. Rows without an entry do not occur; no entries give no rows.
    """
    size, keys = k + BESIDE, list(row)
    m = materialize(entries.select(*keys, F.col(column).alias("column"), F.col(value).cast("double").alias("value")).where("value <> 0"), "matrix")
    start = lambda j: (F.pmod(F.xxhash64("column", F.lit(j)), F.lit(1 << 20)) / float(1 << 19) - 1.0).alias(f"v{j}")
    if (columns := m.select("column").distinct().limit(FEW + 1).count()) <= FEW:
        return _by_columns(m, keys, k) if columns else m.select(*keys, F.array().cast("array<double>").alias("vector"))
    v = materialize(m.select("column").distinct().select("column", *(start(j) for j in range(size))), "block")
    product = lambda of, by, n: m.join(of, "column" if by is keys else keys).groupBy(*by).agg(*(F.sum(F.col("value") * F.col(f"v{j}")).alias(f"v{j}") for j in range(n)))

    def gram(x: DataFrame, n: int) -> np.ndarray:
        got = x.agg(*(F.sum(F.col(f"v{i}") * F.col(f"v{j}")).alias(f"g{i}_{j}") for i in range(n) for j in range(i, n))).first()
        out = np.zeros((n, n))
        for i in range(n):
            for j in range(i, n):
                out[i, j] = out[j, i] = got[f"g{i}_{j}"] or 0.0
        return out

    def turned(x: DataFrame, by: list[str], r: np.ndarray) -> DataFrame:
        return x.select(*by, *(sum((F.col(f"v{i}") * float(r[i, j]) for i in range(1, r.shape[0])), F.col("v0") * float(r[0, j])).alias(f"v{j}") for j in range(r.shape[1])))

    n, last = size, None
    for r in range(rounds + 1):
        # an orthonormal block of the same span, without directions of vanishing length
        w, q = np.linalg.eigh(gram(v, n))
        keep = np.argsort(w)[::-1]
        keep = keep[w[keep] > 1e-14 * max(w.max(), 1e-300)]
        if not len(keep):
            break
        v, n = turned(v, ["column"], q[:, keep] / np.sqrt(w[keep])), len(keep)
        # of M'M times an orthonormal block the lengths tend to the squared singular values
        now = np.sqrt(w[keep])[:k]
        if r == rounds or (r > 1 and len(last) == len(now) and np.abs(now - last).max() <= tolerance * now.max()):
            break
        last = now
        v = materialize(product(product(v, keys, n), ["column"], n), "block")
    y = materialize(product(v, keys, n), "projected")
    g = gram(y, n)
    out = turned(y, keys, _eigen(g, k)) if g.any() else y.limit(0)
    width = len([c for c in out.columns if c not in keys])
    return out.select(*keys, F.array(*(F.col(f"v{j}") for j in range(width))).alias("vector"))
