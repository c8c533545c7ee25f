import random
from collections import Counter, defaultdict

from loomline.llm import line_rules
from loomline.llm.queries import op11_line_rules
from tests.llm.cases import LONG, edge_docs, edge_rows, no_docs, words

SEPARATORS = " \t\n\v\f\r"


def split(text):
    for c in SEPARATORS:
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def slow(rows, most_docs=line_rules.MOST_DOCS, most_share=line_rules.MOST_SHARE):
    """(doc_id, text, host) rows one at a time; digits and letters folded by hand."""
    fold = lambda s: "".join("0" if c in "0123456789" else chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)
    forms = lambda t: [(fold(" ".join(split(line))), len(split(line))) for line in t.split("\n") if split(line)]
    texts, docs = defaultdict(set), Counter()
    for _, t, host in rows:
        texts[host or ""].add(t or "")
    for host, ts in texts.items():
        for t in ts:
            docs.update({(host, f) for f, _ in forms(t)})
    out = []
    for doc_id, t, host in rows:
        t, host = t or "", host or ""
        w = split(t)
        five = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        many = Counter(five)
        inside = {i + k for i, f in enumerate(five) if many[f] > 1 for k in range(5)}
        lines = [x for x in t.split("\n") if split(x)]
        removed = sum(n for f, n in forms(t) if docs[host, f] > most_docs and docs[host, f] > most_share * len(texts[host]))
        failed = len(w) < 10 or 100 * len(inside) > 20 * len(w)
        left = len(w) - removed
        out.append((doc_id, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(inside), removed, failed, not failed and left >= 10 and left >= 0.5 * len(w)))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_equals_a_plain_version_on_the_table(spark, sf):
    rows = [(r["doc_id"], r["text"], r["source"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = slow(rows)
    assert got(op11_line_rules(spark, sf)) == want
    assert any(r[7] for r in want) and any(r[8] for r in want)


def test_common_lines_deplete_documents(spark, monkeypatch):
    rng = random.Random(3)
    menu = "Home News 12 Sport Weather and all the other pages"
    rows = []
    for k in range(60):
        body = words(rng, 30)
        # the same line in other spacing, case and digits; documents that hold little else go
        line = menu.replace(" ", "  ").upper().replace("12", str(k + 10)) if k % 2 else menu
        rows.append((k, f"{line}\n{body}" if k % 3 else f"{line}\n{line}\n{words(rng, 3)}", "a" if k < 40 else "b"))
    # copies of one clean text are one document; other hosts have their own counts
    rows += [(100 + k, "a clean text that was copied many times over as it stands here", "a") for k in range(30)]
    rows += [(200 + k, f"{menu}\n{words(rng, 30)}", "c") for k in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    want = slow(rows)
    for heavy in (line_rules.HEAVY, 20):  # by key, and broadcast
        monkeypatch.setattr(line_rules, "HEAVY", heavy)
        assert got(line_rules.rules(df)) == want
    kept = {r[0] for r in want if r[8]}
    assert {k for k in range(60) if k % 3} <= kept and not {k for k in range(60) if k % 3 == 0} & kept
    assert set(range(100, 130)) <= kept and set(range(200, 210)) <= kept
    cleaned = {r["doc_id"]: r["cleaned"] for r in line_rules.rules(df, with_text=True).collect()}
    text = {r[0]: r[1] for r in rows}
    assert cleaned[1] == text[1].split("\n")[1] and cleaned[0] == text[0].split("\n")[2] and cleaned[200] == text[200] and cleaned[100] == text[100]


def test_edges(spark):
    rows = [(r[0], r[1], r[3]) for r in edge_rows()]
    assert got(line_rules.rules(edge_docs(spark))) == slow(rows)
    assert got(line_rules.rules(edge_docs(spark).selectExpr("doc_id", "text", "cast(null as string) as source"))) == slow([(a, b, None) for a, b, _ in rows])
    assert line_rules.rules(no_docs(spark)).collect() == []
    cleaned = {r["doc_id"]: r["cleaned"] for r in line_rules.rules(edge_docs(spark), with_text=True).collect()}
    assert cleaned[1] is None and cleaned[2] == "" and cleaned[4] == LONG


def test_repeated_windows():
    rng = random.Random(4)
    texts = [[rng.choice("abc") for _ in range(rng.randrange(40))] for _ in range(200)] + [[], ["x"] * 5, ["x"] * 6, list("abcdeabcde"), list("abcd") * 2]
    for t, n in zip(texts, line_rules.repeated_words(texts), strict=True):
        five = [tuple(t[i : i + 5]) for i in range(len(t) - 4)]
        assert n == len({i + k for i, f in enumerate(five) if five.count(f) > 1 for k in range(5)})
    assert line_rules.repeated_words([]) == []
