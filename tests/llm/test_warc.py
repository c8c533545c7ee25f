import base64
import hashlib
import os

from loomline.llm import warc
from loomline.llm.queries import op10_warc


def digest(x: bytes) -> str:
    return base64.b32encode(hashlib.sha1(x).digest()).decode()


def slow(rows, least=0):
    first = {}
    for k, h in rows:
        p = (h or "").encode()
        if k is not None and len(p) >= least:
            first[p] = min(first.get(p, k), k)
    out = []
    for k, h in rows:
        p = (h or "").encode()
        back = k is not None and p in first and first[p] != k
        out.append((k, len(p), digest(p), "revisit" if back else "response", first[p] if back else None))
    return sorted(out, key=str)


def got(df, key="page"):
    return sorted(((r[key], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in df.collect()), key=str)


ROWS = [(5, "http://a/\r\nX: y", "same"), (3, None, "same"), (9, "u", "same"), (9, "u", "same"), (1, "u", None), (2, "u", ""), (4, "u", "é漢\r\n\r\n\x1f\x8b\x08 tail"), (None, "u", "same"), (6, "u", "x" * 200_000), (7, "u", os.urandom(60_000).hex()), (8, "u", "\r\n\r\n")]


def test_query(spark, sf):
    rows = [(r["page_id"], r["html"]) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    assert got(op10_warc(spark, sf), "page_id") == slow(rows)


def test_edges_and_split_sizes(spark):
    df = spark.createDataFrame([(*r, "c", "c") for r in ROWS], "page_id long, url string, html string, digest string, page string").repartition(3)
    for split in (1 << 20, 4096, 64):
        assert got(warc.archive(df, split=split)) == slow([(k, h) for k, _, h in ROWS])
    assert got(warc.archive(df, least=5)) == slow([(k, h) for k, _, h in ROWS], 5)
    assert warc.archive(df.limit(0)).count() == 0


def test_payloads_come_back(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "page_id long, url string, html string").coalesce(1)
    files = warc.write(df, f"file://{tmp_path}/a")
    listing = spark.createDataFrame(files.collect(), files.schema)
    back = warc.read(listing, split=1000).collect()
    assert all(r["intact"] for r in back) and all((r["payload"] is None) == (r["record_type"] == "revisit") for r in back)
    whole = {r["page"]: r["payload"] for r in back if r["payload"] is not None and r["page"] is not None}
    texts = {k: (h or "").encode() for k, _, h in ROWS if k is not None}
    for r in back:
        assert whole[r["refers_to"] or r["page"]] == texts[r["page"]] if r["page"] is not None else r["payload"] == b"same"


def test_false_magic_and_damage(spark, tmp_path):
    import zlib

    good = [warc.member(k, "u", f"payload {k}".encode(), digest(f"payload {k}".encode()), None) for k in range(4)]
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    other = c.compress(b"not a record") + c.flush()
    broken = good[1][:-20]
    data = b"junk" + good[0] + other + b"\x1f\x8b\x08\x00" + broken + good[2] + good[3]
    (tmp_path / "x.warc.gz").write_bytes(data)
    listing = spark.createDataFrame([(f"file://{tmp_path}/x.warc.gz", len(data))], "path string, bytes long")
    for split in (len(data), 50, 7):
        assert sorted(r["page"] for r in warc.read(listing, split=split).collect()) == [0, 2, 3]


def test_very_long_urls(spark, tmp_path):
    urls = {1: "data:," + "x" * 200_000, 2: "http://a/" + " " * 100_000, 3: "http://b/" + os.urandom(100_000).hex(), 4: "u"}
    rows = [(k, u, "same") for k, u in urls.items()]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    for split in (1 << 20, 4096):
        assert got(warc.archive(df, split=split)) == slow([(k, h) for k, _, h in rows])
    files = warc.write(df, f"file://{tmp_path}/a")
    back = {r["page"]: r["url"] for r in warc.read(spark.createDataFrame(files.collect(), files.schema), split=1000).collect()}
    assert back.keys() == urls.keys() and back[1] == urls[1] and back[3] == urls[3] and len(back[2]) >= 100_000
