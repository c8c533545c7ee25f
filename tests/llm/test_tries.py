import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomline.llm import term_tries
from loomline.llm.queries import op12_source_divergence
from tests.llm.cases import edge_docs, no_docs

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def slow(rows, least=30, top=50):
    """(text, lang, source) rows; dictionaries and Python's integers."""
    count, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        w = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t) for t in TERM.findall(text or "")]
        groups[lang].add(source)
        count[lang, source].update(w)
        docs[lang].update(set(w))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        p = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[x] for x in kept) + 5 * len(kept)) for t in kept}  # noqa: B023,E731
        q = p(sum((count[lang, s] for s in sources), Counter()))
        ps = {s: p(count[lang, s]) for s in sources}
        for s in sources:
            pairs = [("pair", o, sum(abs(ps[s][t] - ps[o][t]) for t in kept)) for o in sources if o != s]
            terms = [("term", t, ps[s][t] - q[t]) for t in kept if count[lang, s][t] and ps[s][t] > q[t]]
            for part in (pairs, terms):
                part.sort(key=lambda r: (-r[2], r[1].encode()))
                out += [(lang, s, *r, k) for k, r in enumerate(part, 1) if r[0] == "pair" or k <= top]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.collect())


def frame(spark, rows, parts=5):
    return spark.createDataFrame([(k, *r, "clash", "clash", "clash") for k, r in enumerate(rows)], "doc_id long, text string, lang string, source string, term string, prefix string, part string").repartition(parts)


def some(seed, n=120, sources=6):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abé") for _ in range(rng.randrange(1, 5))) for _ in range(60)] + ["Ünd", "ÜND", "漢字", "á", "X" * 40, "X" * 40 + "y"]
    return [(" -".join(rng.choice(vocabulary) for _ in range(rng.randrange(60))), rng.choice(["en", "de", None]), f"s{min(rng.randrange(sources), rng.randrange(sources))}" if rng.random() < 0.95 else None) for _ in range(n)]


def test_equals_a_plain_version_on_the_table(spark, sf):
    rows = [(r["text"], r["lang"], r["source"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert got(op12_source_divergence(spark, sf)) == slow(rows)


@pytest.mark.parametrize("tries", [{}, {"prefix": 1, "range_leaves": 20}, {"fan": 2}, {"prefix": 1, "range_leaves": 10, "fan": 2}])
def test_cut_ranges_and_slices_change_nothing(spark, monkeypatch, tries):
    monkeypatch.setattr(term_tries, "RANGE_TERMS", 7)
    rows = some(1)
    assert got(term_tries.audit(frame(spark, rows, 9), least=3, top=4, **tries)) == slow(rows, 3, 4)


def test_blocks_and_tiles_change_nothing(spark, monkeypatch):
    for name, v in (("TILE", 2), ("BLOCK", 40), ("CHARS", 50), ("TERMS", 30)):
        monkeypatch.setattr(term_tries, name, v)
    rows = some(2)
    assert got(term_tries.audit(frame(spark, rows), least=2, top=5)) == slow(rows, 2, 5)


def test_ties_and_groups_without_terms(spark):
    # equal counts everywhere: all values tie; a source without a term; a language without kept terms; a single source
    rows = [(t, "en", s) for s in ("b", "a", "ä", "z") for t in ("one two three", "Three TWO one")] + [("123", "en", "empty"), (None, "en", None), ("rare", "xx", "a"), ("", "xx", "b"), ("only", "yy", "a")]
    for least in (2, 9):
        assert got(term_tries.audit(frame(spark, rows), least=least)) == slow(rows, least)


def test_edges(spark):
    rows = [(r["text"], r["lang"], r["source"]) for r in edge_docs(spark).collect()]
    for least in (1, 2):
        assert got(term_tries.audit(edge_docs(spark), least=least)) == slow(rows, least)
    assert term_tries.audit(no_docs(spark)).collect() == []


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.tuples(st.binary(min_size=1, max_size=6).map(lambda b: bytes(97 + x % 4 for x in b)), st.sampled_from("st"), st.integers(1, 5)), max_size=20), max_size=3))
def test_trie_is_a_sorted_table(adds):
    trie, want = term_tries.Trie(), Counter()
    for block in adds:
        terms = sorted({t for t, _, _ in block})
        group = [trie.groups.setdefault(("en", s), len(trie.groups)) for _, s, _ in block]
        trie.add(terms, np.array([terms.index(t) for t, _, _ in block], np.int64), np.array(group, np.int64), np.array([n for *_, n in block], np.int64), np.ones(len(block), np.int64))
        for t, s, n in block:
            want[t, s] += n
            want[t, s, "docs"] += 1
    assert trie.leaves()[0] == sorted({k[0] for k in want})
    back = Counter()
    for row in term_tries._cut_rows(trie, 2):
        row = dict(zip(term_tries._NAMES, row, strict=True))
        terms, counters, groups = term_tries._read(row)
        assert terms == sorted(terms) and {t[:2] for t in terms} == {row["prefix"]} and row["leaves"] == counters.shape[1]
        for t, g, o, d in counters.T.tolist():
            back[terms[t], groups[g][1]] += o
            back[terms[t], groups[g][1], "docs"] += d
    assert back == want


def test_shares_are_exact():
    rng = random.Random(3)
    totals = [1, 7, 10**9, 9 * 10**15, *(rng.randrange(1, 9 * 10**15) for _ in range(200))]
    counts = [rng.randrange(t + 1) for t in totals]
    assert term_tries.share(np.array(counts), np.array(totals)).tolist() == [1 + 10**9 * c // t for c, t in zip(counts, totals, strict=True)]
