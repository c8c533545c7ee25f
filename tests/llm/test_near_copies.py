import random

import corpus_pipeline
from loomline.llm import near_copies
from tests.llm.cases import edge_docs, no_docs, words
from tests.llm.test_components import plain


def slow_sets(texts, width=5):
    out = []
    for t in texts:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split()
        out.append({b" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    return out


def slow_links(texts):
    """All pairs with a five-word Jaccard of 0.8 or more, by brute force."""
    s = slow_sets(texts)
    return [(i, j) for i in range(len(s)) for j in range(i, len(s)) if 5 * len(s[i] & s[j]) >= 4 * len(s[i] | s[j])]


def slow_groups(rows):
    root, least = plain(slow_links([t for _, t in rows])), {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[root[i]] = min(least.get(root[i], k), k)
    return sorted(((k, least.get(root[i])) for i, (k, _) in enumerate(rows)), key=str)


def got(df):
    return sorted(((r["doc_id"], r["component_id"]) for r in df.collect()), key=str)


def varied():
    rng, rows = random.Random(5), []
    for g in range(15):
        base = words(rng, 120).split()
        for c in range(6):
            w = list(base)
            for _ in range(c):
                w[rng.randrange(len(w))] = f"zz{rng.randrange(1000)}"
            rows.append((100 * g + c + 20, " ".join(w)))
    return rows


def test_groups_against_brute_force(spark, sf):
    rows = [*varied(), *((r["doc_id"], r["text"]) for r in edge_docs(spark).collect()), (90001, "x " * 6), (90002, "x " * 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(near_copies.near_duplicates(df)) == slow_groups(rows)
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert got(near_copies.near_duplicates(spark.read.parquet(f"{sf}/documents.parquet"))) == slow_groups(rows)
    assert near_copies.near_duplicates(no_docs(spark)).count() == 0


def test_sketch_counts_minima_that_differ(spark):
    from pyspark.sql import functions as F

    a, b = near_copies.minima(near_copies.shingle_set("one two three four five six seven eight")), near_copies.minima(near_copies.shingle_set("one two three four five six seven nine"))
    x, y = near_copies.sketch(a), near_copies.sketch(b)
    want = sum((int(p) >> 4 * k & 15) != (int(q) >> 4 * k & 15) for p, q in zip(x, y, strict=True) for k in range(16))
    df = spark.createDataFrame([(x.tolist(), y.tolist())], "a array<long>, b array<long>")
    assert df.select(near_copies.different(F.col("a"), F.col("b"))).first()[0] == want > 0


def test_a_large_group_of_near_copies(spark, monkeypatch):
    """Members that are mostly too far from each other, over several parts of a place, against brute force."""
    rng, base = random.Random(3), words(random.Random(4), 80).split()
    rows = []
    for k in range(400):
        w = list(base)
        for _ in range(rng.randrange(1, 6)):
            w[rng.randrange(len(w))] = f"zz{rng.randrange(10**6)}"
        rows.append((k, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for name, value in (("LARGE", 500), ("MEMBERS", 40), ("OTHERS", 16)):
        monkeypatch.setattr(near_copies, name, value)
    assert got(near_copies.near_duplicates(df)) == slow_groups(rows)


def test_stage_finds_what_three_bits_miss(spark, sf):
    rows = varied()
    df = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, df, sf).collect())
    assert kept == sorted({c for _, c in slow_groups(rows)}) and len(kept) < len(rows)


def test_whole_run_against_a_plain_version(spark, sf):
    """The run with the near-copy rule of five words and 0.8, by brute force."""
    from loomline.llm import packing, secret_scan
    from loomline.llm.queries import vocabulary

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = corpus_pipeline.quality(spark, corpus_pipeline.language_id(spark, docs, sf).cache(), sf)
    rows = [r.asDict() for r in kept.collect()]
    groups = dict(slow_groups([(r["doc_id"], r["text"]) for r in rows]))
    rows = [r for r in rows if groups[r["doc_id"]] == r["doc_id"]]
    for r in rows:
        r["text"] = secret_scan.redact(r["text"], secret_scan.scan(r["text"])[0])
    want = packing.pack(spark.createDataFrame(rows, kept.schema).repartition(1), vocabulary())
    whole = lambda d: {(r["doc_id"], r["doc_tokens"]) for r in d.collect()}
    assert whole(corpus_pipeline.run(spark, sf)) == whole(want)
