import os
import time

from loomline.functions.lexicon import starter
from loomline.streaming import changes, watch


def test_one_row_a_change(spark, tmp_path):
    spark.dataSource.register(changes.ChangedFiles)
    folder, out = tmp_path / "in", []
    (folder / "sub").mkdir(parents=True)
    put = lambda name, text: (folder / name).write_text(text)
    said = []
    listener = changes.Progress(said.append)
    spark.streams.addListener(listener)

    def run():
        out.clear()
        files = spark.readStream.format("changed_files").options(path=str(folder), suffix=".txt").load()
        each = lambda b, _: out.extend((os.path.basename(r["doc_id"]), r["text"], r["version"]) for r in b.collect())
        q = changes.changed(files).writeStream.queryName("watched").foreachBatch(each).option("checkpointLocation", f"{tmp_path}/c").start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
        return sorted(out)

    try:
        assert run() == []
        put("a.txt", "one")
        put("sub/b.txt", "two")
        put("c.csv", "no")
        assert run() == [("a.txt", "one", 1), ("b.txt", "two", 1)]
        assert run() == []
        put("a.txt", "one more")
        os.utime(folder / "sub" / "b.txt", ns=(time.time_ns() + 10**9, time.time_ns() + 10**9))  # a moved stamp, no change
        assert run() == [("a.txt", "one more", 2)]
        time.sleep(1.1)
        put("a.txt", "one")
        assert run() == [("a.txt", "one", 3)]
        (folder / "a.txt").unlink()
        assert run() == []
        deadline = time.time() + 20
        while not said and time.time() < deadline:
            time.sleep(0.2)
        assert said and said[0].startswith("watched: batch ") and listener.lines == said
    finally:
        spark.streams.removeListener(listener)


def test_metrics_of_changed_files(spark, tmp_path):
    spark.dataSource.register(changes.ChangedFiles)
    (tmp_path / "t.txt").write_text("I love you. I am happy.")
    rows = []
    files = spark.readStream.format("changed_files").options(path=str(tmp_path / "t.txt")).load()
    q = changes.changed(files).writeStream.foreachBatch(lambda b, _: rows.extend(watch.measured(b, starter()).collect())).option("checkpointLocation", f"{tmp_path}/c").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert [r["n_words"] for r in rows] == [6]
