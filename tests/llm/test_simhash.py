import random

import xxhash
from pyspark.sql import functions as F

from loomline.llm import simhash
from loomline.llm.queries import op8_simhash
from tests.llm.cases import edge_docs, no_docs, words
from tests.llm.test_components import plain


def slow_print(text, width=3):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    s = [" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0


def slow_groups(rows, radius=3):
    """(id, print, component) of each row by comparing all pairs."""
    fps = [slow_print(t) for _, t in rows]
    edges = [(i, j) for i in range(len(rows)) for j in range(i, len(rows)) if bin(fps[i] ^ fps[j]).count("1") <= radius]
    root = plain(edges)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[root[i]] = min(least.get(root[i], k), k)
    return sorted(((k, f"{fps[i]:016x}", least.get(root[i])) for i, (k, _) in enumerate(rows)), key=str)


def got(df):
    return sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in df.collect()), key=str)


def test_query(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert got(op8_simhash(spark, sf)) == slow_groups(rows)


def test_near_copies_and_edges(spark):
    rng = random.Random(2)
    rows = [(r["doc_id"], r["text"]) for r in edge_docs(spark).collect()]
    for g in range(12):
        base = words(rng, 150).split()
        for c in range(5):
            w = list(base)
            for _ in range(c):
                w[rng.randrange(len(w))] = "zz"
            rows.append((100 * g + c + 20, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(simhash.near_duplicates(df)) == slow_groups(rows)
    assert got(simhash.near_duplicates(edge_docs(spark))) == slow_groups([(r["doc_id"], r["text"]) for r in edge_docs(spark).collect()])
    assert simhash.near_duplicates(no_docs(spark)).count() == 0


def test_links_at_each_distance(spark):
    rng = random.Random(9)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = set(base)
    for b in base:
        for d in (1, 2, 3, 4):
            fps.add(b ^ sum(1 << k for k in rng.sample(range(64), d)))
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    for radius in (2, 3):
        want = {frozenset((a, b)) for a in signed for b in signed if a < b and bin((a ^ b) & (1 << 64) - 1).count("1") <= radius}
        assert {frozenset((r["a"], r["b"])) for r in simhash.links(df, radius).collect()} == want and want


def test_no_exploded_table_is_broadcast(spark):
    # a small file of fingerprints becomes tens of rows each: Spark's estimate calls that small, and it went through the driver
    fps = spark.range(100).select(F.xxhash64("id").alias("fp"))
    plan = simhash.links(fps)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
