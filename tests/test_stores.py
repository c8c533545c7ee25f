import io
import json
import os
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from loomline.sources import archives, pages, sinks
from loomline.sources import readers as R

ANSWERS = {
    "first": [{"status": 429}, {"status": 429}, {"status": 200, "body": {"data": {"after": "t2", "children": [{"data": {"id": "a", "title": "A", "selftext": "one", "score": 3}}, {"data": {"id": "b"}}]}}}],
    "t2": {"status": 200, "body": {"data": {"after": "t3", "children": []}}},
    "t3": {"status": 200, "body": {"data": {"after": None, "children": [{"data": {"id": "c", "title": "C", "selftext": "three", "score": 1}}]}}},
}


def record(folder, answers):
    folder.mkdir(exist_ok=True)
    for k, v in answers.items():
        (folder / f"{k}.json").write_text(json.dumps(v))
    return str(folder)


def test_pages_follow_the_cursor(spark, tmp_path):
    spark.dataSource.register(pages.PagedJson)
    load = lambda p, **o: [tuple(r) for r in spark.read.format("paged_json").options(path=p, wait="0.01", **o).load().collect()]
    p = record(tmp_path / "ok", ANSWERS)
    want = [("t2", "a", "A", "one", 3), ("t2", "b", None, None, None), (None, "c", "C", "three", 1)]
    assert load(p) == want and load(p, pages="2") == want[:2] and load(p, attempts="2") == []
    assert load(record(tmp_path / "no", ANSWERS | {"t2": {"status": 403}})) == want[:2]
    assert load(str(tmp_path / "nothing")) == []
    posts = R.post_rows(spark.read.format("paged_json").options(path=p, wait="0.01").load())
    assert [(r["id"], r["text"]) for r in posts.collect()] == [("a", "A. one"), ("c", "C. three")]


def test_pages_as_a_stream(spark, tmp_path):
    spark.dataSource.register(pages.PagedJson)
    p = record(tmp_path / "s", {k: ANSWERS[k] for k in ("first",)})
    stream = spark.readStream.format("paged_json").options(path=p, wait="0.01").load()
    run = lambda: stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").start(f"{tmp_path}/out")
    q = run()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert sorted(r["id"] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["a", "b"]
    record(tmp_path / "s", ANSWERS)  # later pages come up, the stream goes on from its cursor
    q = run()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert sorted(r["id"] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["a", "b", "c"]


def test_lines_of_archives(spark, tmp_path):
    files = {"GOLD/Subtask_A/x.txt": "1\tpositive\tone two three four\n2\tneutral\tbad\n", "GOLD/Subtask_A/README.txt": "no\n", "other/y.txt": "3\tnegative\tfive six seven eight\r\n", "__MACOSX/Subtask_A/z.txt": "no\n", "a.csv": "no\n"}
    with zipfile.ZipFile(tmp_path / "one.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for k, v in files.items():
            z.writestr(k, v)
    with zipfile.ZipFile(tmp_path / "two.zip", "w") as z:
        z.writestr("w.txt", "4\tpos\tnine ten eleven twelve\nlast é")
    with tarfile.open(tmp_path / "three.tar.gz", "w:gz") as t:
        for k, v in files.items():
            info = tarfile.TarInfo(k)
            info.size = len(v.encode())
            t.addfile(info, io.BytesIO(v.encode()))
    (tmp_path / "ignored.txt").write_text("no")
    got = lambda **o: sorted((os.path.basename(r["archive"]), r["member"], r["line"], r["value"]) for r in archives.archive_lines(spark, str(tmp_path), **o).collect())
    x = [("GOLD/Subtask_A/x.txt", 0, "1\tpositive\tone two three four"), ("GOLD/Subtask_A/x.txt", 1, "2\tneutral\tbad")]
    y, w = [("other/y.txt", 0, "3\tnegative\tfive six seven eight")], [("w.txt", 0, "4\tpos\tnine ten eleven twelve"), ("w.txt", 1, "last é")]
    assert got() == sorted([(a, *r) for a in ("one.zip", "three.tar.gz") for r in x + y] + [("two.zip", *r) for r in w])
    assert got(prefer="Subtask_A") == sorted([(a, *r) for a in ("one.zip", "three.tar.gz") for r in x] + [("two.zip", *r) for r in w])
    tweets = R.tweet_rows(archives.archive_lines(spark, str(tmp_path / "one.zip"), prefer="Subtask_A"))
    assert [(r["id"], r["sentiment"]) for r in tweets.collect()] == [("1", "pos")]
    (tmp_path / "empty").mkdir()
    with zipfile.ZipFile(tmp_path / "empty" / "e.zip", "w"):
        pass
    assert archives.archive_lines(spark, str(tmp_path / "empty")).count() == 0


def test_one_file_a_document(spark, tmp_path):
    spark.dataSource.register(sinks.TextFiles)
    out = tmp_path / "posts"
    df = spark.createDataFrame([("a", "one"), ("b/c", "two\nlines"), ("é", None)], "id string, text string").repartition(3)
    df.write.format("text_files").mode("append").option("path", str(out)).save()
    assert {p.name: p.read_text() for p in out.iterdir()} == {"a.txt": "one", "b%002fc.txt": "two\nlines", "%00e9.txt": ""}
    bad = df.withColumn("id", F.when(F.col("id") == "a", None).otherwise(F.col("id"))).withColumn("text", F.lit("new"))
    with pytest.raises(Exception, match="without an id"):
        bad.write.format("text_files").mode("append").option("path", str(out)).save()
    assert {p.name: p.read_text() for p in out.iterdir()} == {"a.txt": "one", "b%002fc.txt": "two\nlines", "%00e9.txt": ""}


def test_versions_behind_a_manifest(spark, tmp_path):
    path = str(tmp_path / "table")
    with pytest.raises(FileNotFoundError):
        sinks.read_version(spark, path)
    assert sinks.write_version(spark.range(3), path) == 1
    assert sinks.write_version(sinks.read_version(spark, path).selectExpr("id + 10 as id"), path) == 2
    assert sorted(r[0] for r in sinks.read_version(spark, path).collect()) == [10, 11, 12] and sinks.read_version(spark, path, 1).count() == 3
    with pytest.raises(Exception, match="(?i)divi"):
        sinks.write_version(spark.range(5).selectExpr("1 / (id - 3) as id"), path)
    assert sorted(r[0] for r in sinks.read_version(spark, path).collect()) == [10, 11, 12]
    assert [sinks.write_version(spark.range(k), path) for k in (4, 5, 6)] == [3, 4, 5]
    assert sinks.read_version(spark, path).count() == 6 and sinks.read_version(spark, path, 3).count() == 4
    with pytest.raises(FileNotFoundError):
        sinks.read_version(spark, path, 1)
