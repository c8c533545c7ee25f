import zlib
from collections import Counter, defaultdict
from itertools import product

import numpy as np
import pyarrow.parquet as pq
import pytest

from loomline.llm import bpe, packing
from loomline.llm.arrow import blocks
from loomline.llm.queries import op5_packing, vocabulary
from tests.llm.cases import edge_docs, no_docs

tokenizers = pytest.importorskip("tokenizers")
TOK = tokenizers.Tokenizer.from_file(vocabulary())


def test_knapsack_against_all_multisets():
    rng = np.random.default_rng(1)
    for _ in range(20):
        sizes = np.unique(rng.integers(2, 12, 4))
        prices = rng.random(len(sizes))
        best = np.zeros(21)
        for w in range(1, 21):
            best[w] = max([best[w - 1], *(best[w - s] + p for s, p in zip(sizes, prices, strict=True) if s <= w)])
        value, take = packing.knapsack(sizes, prices, 20)
        assert value == pytest.approx(best)
        first = int(np.argmax(value[20 - sizes] + prices))
        counts = packing.trace(take, sizes, 20, first)
        assert sum(prices[i] * n for i, n in counts.items()) == pytest.approx(value[20]) and sum(sizes[i] * n for i, n in counts.items()) <= 20


def test_bounded_knapsack_against_all_multisets():
    rng = np.random.default_rng(2)
    for _ in range(30):
        sizes = np.unique(rng.integers(2, 12, 4))
        prices, counts = rng.random(len(sizes)), rng.integers(0, 4, len(sizes))
        ways = [w for w in product(*(range(c + 1) for c in counts)) if sizes @ np.array(w) <= 20]
        got = packing.bounded_knapsack(sizes, counts, prices, 20)
        taken = np.array([got.get(i, 0) for i in range(len(sizes))])
        assert (taken <= counts).all() and sizes @ taken <= 20
        assert prices @ taken == pytest.approx(max(prices @ np.array(w) for w in ways))


def test_linear_program_reaches_its_bound():
    # the classic: pairs fill a sequence exactly, greedy filling does not
    sizes, demand = np.array([3, 4, 5, 6, 7]), np.array([10.0, 10, 10, 10, 10])
    cover = packing.solve(sizes, demand, 10, gap=1e-9)
    patterns, x, bound = cover.patterns, cover.runs, cover.bound
    covered = sum(n * np.array([p.get(i, 0) for i in range(5)]) for p, n in zip(patterns, x, strict=True))
    assert np.allclose(covered, demand) and all(sum(int(sizes[i]) * a for i, a in p.items()) <= 10 for p in patterns)
    assert x.sum() == pytest.approx(bound, rel=1e-6)


def place(p, length, rank):
    """Pieces (start within the rest, length, sequence, offset) of one rest."""
    one, at = np.array([length]), np.array([rank])
    if p.on_pattern(one, at)[0]:
        (sequence,), (offset,) = p.place(one, at)
        return [(0, length, int(sequence), int(offset))]
    return p.cut(length, rank)


@pytest.mark.parametrize(("sf", "share"), [("sf0.001", 0.03), ("sf0.01", 0.01), ("sf0.1", 0.001)])
def test_columns_are_priced_in_and_little_is_cut(sf, share):
    texts = pq.read_table(f"/root/testdata/{sf}/documents.parquet", columns=["text"]).column(0).to_pylist()
    enc = bpe.Encoder(bpe.load_vocabulary(vocabulary()))
    lengths = Counter((len(x) + 1) % 2048 for s, e in blocks([t or "" for t in texts]) for x in enc.encode_batch([t or "" for t in texts[s:e]]))
    lengths.pop(0, None)
    p = packing.plan(lengths)
    rest = sum(k * n for k, n in lengths.items())
    assert p.pivots > 0 and p.late_patterns > 0
    assert p.line_tokens <= share * rest and p.padding <= 0.001 * rest
    # no plan has fewer sequences than the proven bound, and this one has hardly more
    assert p.bound - 1e-6 <= p.pattern_sequences + p.line_tokens / 2048 + p.padding / 2048 <= p.bound * 1.002 + 1


def test_bimodal_lengths_are_not_cut():
    # pairs of 1500 and 548 fill a sequence; 1300 finds no partner, and its pattern is too empty to be kept
    p = packing.plan({1500: 400, 548: 400, 1300: 50})
    assert p.pattern_sequences >= 400 and p.line_tokens <= 50 * 1300


@pytest.mark.parametrize("seed", range(4))
def test_plan_places_every_length_once(seed):
    rng = np.random.default_rng(seed)
    h = Counter(np.minimum(63, rng.geometric(0.07, 3000)).tolist())
    p = packing.plan(h, 64)
    by = defaultdict(list)
    for length, n in h.items():
        for k in range(n):
            pieces = place(p, length, k)
            assert [s for s, *_ in pieces] == list(np.cumsum([0, *(m for _, m, *_ in pieces)])[:-1]) and sum(m for _, m, *_ in pieces) == length
            for _, m, seq, at in pieces:
                by[seq].append((at, at + m))
    for spans in by.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False)) and spans[-1][1] <= 64
    assert set(by) == set(range(p.first_block))


def check(rows, texts):
    """Pieces against the library's ids: coverage, digests, gapless sequences; returns the share of padding."""
    by, per = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
        per[r["doc_id"]].append(r)
    ids = {k: [*TOK.encode(t or "", add_special_tokens=False).ids, 1] for k, t in texts.items()}
    assert set(per) == set(ids)
    for k, pieces in per.items():
        pieces.sort(key=lambda r: r["start"])
        at = 0
        for r in pieces:
            assert r["start"] == at and r["doc_tokens"] == len(ids[k]) and r["length"] > 0
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[k][at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids[k])
    pad = 0
    for spans in by.values():
        spans.sort()
        at = 0
        for o, n in spans:
            assert o == at
            at += n
        assert at <= 2048
        pad += 0 if at & (at - 1) == 0 else 2048 - at
    return pad / sum(len(x) for x in ids.values())


def test_query(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert check(op5_packing(spark, sf).collect(), texts) < 0.002


def test_edges(spark):
    df = edge_docs(spark).where("doc_id is not null and doc_id <> 6")
    check(packing.pack(df, vocabulary()).collect(), {r["doc_id"]: r["text"] for r in df.collect()})
    # repeated rows and rows without an id are packed each
    whole = packing.pack(edge_docs(spark), vocabulary()).groupBy().sum("length").first()[0]
    assert whole == sum(len(TOK.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in edge_docs(spark).collect())
    assert packing.pack(no_docs(spark), vocabulary()).count() == 0


def test_sequences_hold_the_ids(spark):
    df = edge_docs(spark).where("doc_id in (4, 5, 7)")
    ids = bpe.encode(df, vocabulary())
    got = packing.sequences(packing.pack(df, vocabulary()), ids).collect()
    assert sorted(x for r in got for x in r["ids"]) == sorted(x for r in ids.collect() for x in [*r["ids"], 1])
