import json
import os
import random

from pyspark.sql import functions as F

from loomline.functions.lexicon import starter
from loomline.operators import evaluation as E
from loomline.sources import readers as R
from loomline.sources import writers as W
from loomline.streaming import watch


def put(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_files_and_corpora(spark, tmp_path):
    (tmp_path / "t").mkdir()
    put(tmp_path / "t" / "a.txt", "one\ntwo")
    put(tmp_path / "t" / "b.txt", "three")
    assert {(r["id"], r["text"]) for r in R.text_files(spark, str(tmp_path / "t")).collect()} == {("a.txt", "one\ntwo"), ("b.txt", "three")}
    p = put(tmp_path / "c.csv", 'id,text,sentiment,emotion\n1," Hello, ""you"" \nthere ",Positive,JOY\n2,x,,\n')
    rows = R.labelled_csv(spark, p).orderBy("id").collect()
    assert rows[0].asDict() == {"id": "1", "text": 'Hello, "you" \nthere', "sentiment": "pos", "emotion": "joy", "attachment": "none"} and rows[1]["sentiment"] == "neu"
    j = put(tmp_path / "c.jsonl", '{"id":"a","text":"t","sentiment":"NEG"}\n\n')
    assert R.labelled_jsonl(spark, j).first()["sentiment"] == "neg"


def test_posts_drop_bad_lines(spark, tmp_path):
    lines = [json.dumps({"id": "1", "title": "T", "selftext": "body"}), "{broken", json.dumps({"id": "2", "title": "T", "selftext": "[deleted]"}), json.dumps({"id": "3", "title": "T"})]
    p = put(tmp_path / "p.jsonl", "\n".join(lines))
    assert [(r["id"], r["text"]) for r in R.posts(spark, p).collect()] == [("1", "T. body")]


def test_headers_and_separators(spark, tmp_path):
    assert R.resolve_headers(["Id", "Utterance", "Context"]) == ("Utterance", "Context") and R.resolve_headers(["a", "b"]) == ("a", None)
    p = put(tmp_path / "s.csv", "text|label\nfive words are in here|anger\ntoo short|joy\n")
    assert [(r["text"], r["sentiment"]) for r in R.sniffed_csv(spark, p).collect()] == [("five words are in here", "neg")]
    R.aliased(spark.createDataFrame([("a b c", "joy")], "text string, emotion string")).write.parquet(str(tmp_path / "q"))
    assert R.parquet_emotions(spark, str(tmp_path / "q")).first()["sentiment"] == "pos"


def test_tweets_dialogues_and_parallel_files(spark, tmp_path):
    p = put(tmp_path / "t.tsv", "1\tnegative\tone two three\tfour\n2\tpositive\tshort\nbad line\n")
    assert [(r["id"], r["text"], r["sentiment"]) for r in R.tweets(spark, p).collect()] == [("1", "one two three\tfour", "neg")]
    d = spark.createDataFrame([(1, "['it is a fine day', 'no']", "[4, 0]"), (2, "['you''re late again my friend']".replace("''", "'"), "[1]")], "id int, dialog string, emotion string")
    got = {(r["id"], r["text"], r["emotion"], r["sentiment"]) for r in R.dialogue_rows(d).collect()}
    assert (1, "it is a fine day", "happiness", "pos") in got and not any(t == "no" for _, t, *_ in got)
    e = spark.createDataFrame([("how are you today friend __eou__ ok __eou__",)], "value string")
    assert [r["text"] for r in R.split_dialogue(e).collect()] == ["how are you today friend"]
    a, b = put(tmp_path / "x.txt", "a b c\nd e f\ng\n"), put(tmp_path / "y.txt", "0\n2\n1\n")
    assert {(r["text"], r["sentiment"]) for r in R.parallel_files(spark, a, b).collect()} == {("a b c", "neg"), ("d e f", "pos")}
    u = spark.createDataFrame([("we are all here now", "Joy")], "Utterance string, Emotion string")
    assert [r["sentiment"] for r in R.utterances([u, u]).collect()] == ["pos", "pos"]


def test_metric_files_annotations_and_registry(spark, tmp_path):
    p = put(tmp_path / "m.csv", "dataset,id,nava,gase\nd,1,NA,0.5\nd,2,,0.25\nd,3,0.5,nan\n")
    got = R.metric_files(spark, p, ["nava", "gase"], "id", 2).orderBy("id").collect()
    assert [(r["nava"], r["gase"]) for r in got] == [(None, 0.5), (None, 0.25)]
    put(tmp_path / "n.annotations.json", json.dumps([{"para_idx": 0, "text_snippet": "x", "sentiment": "pos", "conflict": True}]))
    assert R.annotations(spark, str(tmp_path / "n")).first()["conflict"] is True
    put(tmp_path / "o_annotations.csv", "para_idx,sentiment\n0,neg\n")
    assert R.annotations(spark, str(tmp_path / "o")).first()["sentiment"] == "neg"
    reg = R.Registry()
    reg.add("a", lambda s: s.createDataFrame([(str(i), "t") for i in range(5)], "id string, text string"), 2, source="x")
    reg.add("b", lambda s: s.createDataFrame([("9", "t", 1)], "id string, text string, extra int"))
    assert sorted((r["dataset"], r["id"]) for r in reg.load(spark).collect()) == [("a", "0"), ("a", "1"), ("b", "9")]


def test_sessions_keep_runs_apart(spark):
    rows = [(1, "s1", "C", "a"), (2, "s1", "T", "x"), (3, "s1", "C", "b"), (4, "s2", "C", "c"), (5, "s1", "C", "d")]
    df = spark.createDataFrame(rows, "line int, session_id string, speaker string, text string")
    assert [(r["id"], r["text"]) for r in R.session_runs(df, "line").orderBy("run").collect()] == [("ss1", "a b"), ("ss2", "c"), ("ss1", "d")]
    assert {(r["id"], r["text"]) for r in R.session_transcript(df, ("line",)).collect()} == {("ss1", "a b d"), ("ss2", "c")}


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("d1", "1", 0.5), ("d2", "2", None)], "dataset string, id string, gase double")
    W.metrics(df, str(tmp_path / "m"))
    assert sorted(os.listdir(tmp_path / "m"))[-2:] == ["dataset=d1", "dataset=d2"] and spark.read.parquet(str(tmp_path / "m")).count() == 2
    W.small_csv(df, str(tmp_path / "c"))
    assert len([f for f in os.listdir(tmp_path / "c") if f.endswith(".csv")]) == 1
    W.jsonl(df, str(tmp_path / "j"))
    W.per_document(df.select("id", F.lit("text").alias("text")), str(tmp_path / "p"))
    W.annotation_template(df.select("id", F.lit("t").alias("text")), str(tmp_path / "a"), "me")
    assert spark.read.csv(str(tmp_path / "a"), header=True).columns == ["id", "text", "rater_name", "sentiment", "emotion", "attachment", "notes"]
    rows = df.collect()
    assert r"d1 & 1 & 0.5 \\" in W.latex(rows, "A_b") and r"A\_b" in W.latex(rows, "A_b") and W.latex([], "x") == ""
    assert "dataset=d1" in W.report({"T": rows}) and "<td>0.5</td>" in W.html({"T": rows}, "x")


def test_watch_measures_new_files(spark, tmp_path):
    folder, seen = tmp_path / "in", []
    folder.mkdir()
    put(folder / "one.txt", "I love you. We are happy.")
    each = lambda df, n: seen.extend(df.select("doc_id", "sentiment").collect())
    for name in (None, "two.txt"):
        if name:
            put(folder / name, "I hate this. I am angry.")
        watch.watch(spark, str(folder), starter(), str(tmp_path / "cp"), each, once=True).awaitTermination(120)
    assert [(r["doc_id"], r["sentiment"] > 0) for r in seen] == [("one.txt", True), ("two.txt", False)]


def test_windows_on_a_stream(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01 10:05:00", 0.5), ("2024-01-01 10:55:00", -0.5), ("2024-01-01 11:05:00", 0.0)], "ts string, score double").selectExpr("cast(ts as timestamp) ts", "score")
    rows.coalesce(1).write.parquet(str(tmp_path / "s"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "s"))
    q = watch.windowed_labels(stream, "ts", "score").writeStream.outputMode("complete").format("memory").queryName("labels").trigger(availableNow=True).start()
    q.awaitTermination(120)
    key = lambda d: sorted((str(r["start"]), r["label"], r["n"]) for r in d.collect())
    assert key(spark.table("labels")) == key(watch.windowed_labels(rows, "ts", "score")) and spark.table("labels").count() == 3


def test_registry_tables_and_compare(spark):
    assert E.hypothesis_registry(spark).count() == 7 and E.metric_catalog(spark).where("risk is null").count() == 0
    m = spark.createDataFrame([("a", 1.0, 2.0), ("b", 1.0, 1.0)], "id string, x double, y double")
    assert {(r["metric"], r["winner"]) for r in E.compare(m, "id", "a", "b", ["x", "y"]).collect()} == {("x", "second"), ("y", "first")}


def test_multi_label_rows_without_a_known_id_go(spark):
    df = spark.createDataFrame([("one two three four", "0"), ("one two three four five", "999"), ("one two three four six", "")], "text string, emotion_ids string")
    assert [r["text"] for r in R.multi_label(df).collect()] == ["one two three four"]


def test_numbers_of_lines_over_byte_ranges(spark, tmp_path):
    lines = [f"line {k} " + "x" * (k % 97) for k in range(20_000)]
    lines[5] = lines[6] = ""
    p = put(tmp_path / "long.txt", "\n".join(lines) + "\n")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
        spark.conf.set("spark.sql.files.openCostInBytes", "1k")
        df = R.numbered_lines(spark, p)
        assert spark.read.text(p).rdd.getNumPartitions() > 8
        assert [r["value"] for r in df.orderBy("line").collect()] == lines and sorted(r["line"] for r in df.collect()) == list(range(20_000))
        labels = put(tmp_path / "labels.txt", "\n".join("021x"[k % 4] for k in range(20_000)))
        got = {r["id"]: (r["text"], r["sentiment"]) for r in R.parallel_files(spark, p, labels, least_words=2).collect()}
        want = {f"p{k:05d}": (t.strip(), ("neg", "pos", "neu")[k % 4]) for k, t in enumerate(lines) if k % 4 < 3 and len(t.split()) >= 2}
        assert got == want
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_rows_without_an_id_are_numbered(spark, tmp_path):
    (tmp_path / "n").mkdir()
    put(tmp_path / "n" / "a.csv", 'text,sentiment\nsame text,pos\n"two\nlines",neg\nsame text,neu\n')
    rows = R.labelled_csv(spark, str(tmp_path / "n" / "a.csv")).orderBy("id").collect()
    assert [(r["id"], r["text"], r["sentiment"]) for r in rows] == [("r0000", "same text", "pos"), ("r0001", "two\nlines", "neg"), ("r0002", "same text", "neu")]
    put(tmp_path / "n" / "b.csv", "text,sentiment\nother,pos\n")
    several = R.numbered(spark.read.csv(str(tmp_path / "n"), header=True, multiLine=True)).collect()
    assert sorted((r["_file"][-5:], r["_row"]) for r in several) == [("a.csv", 0), ("a.csv", 1), ("a.csv", 2), ("b.csv", 0)]
    assert R.labelled_csv(spark, put(tmp_path / "none.csv", "text,sentiment\n")).count() == 0


def test_session_runs_over_ranges_of_lines(spark):
    from pyspark.sql import Window

    rng = random.Random(2)
    rows, session = [], 0
    for k in range(600):
        session = rng.choice([session, session, session, rng.randrange(4), None])
        rows.append((k, session, rng.choice("CCCT"), f"t{k}", k % 2))
    df = spark.createDataFrame(rows, "line long, session_id long, speaker string, text string, file int").repartition(6)

    def plain(by):
        w = Window.partitionBy(*by).orderBy("line")
        x = df.where("speaker = 'C'").withColumn("new", F.coalesce(F.lag("session_id").over(w) != F.col("session_id"), F.lit(True)).cast("int")).withColumn("run", F.sum("new").over(w))
        out = {}
        for r in x.orderBy("line").collect():
            out.setdefault((*(r[b] for b in by), r["run"], None if r["session_id"] is None else f"s{r['session_id']}"), []).append(r["text"])
        return sorted(((*k, " ".join(v)) for k, v in out.items()), key=repr)

    for by in ([], ["file"]):
        got = R.session_runs(df, "line", chunk=by[0] if by else None)
        assert sorted(((*(r[b] for b in by), r["run"], r["id"], r["text"]) for r in got.collect()), key=repr) == plain(by)
        windows = [x for x in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if x.strip(" :+-").startswith("Window")]
        assert windows and all("_part" in x for x in windows)
    assert R.session_runs(df.limit(0), "line").count() == 0


def test_dialogue_layouts(spark, tmp_path):
    rows = lambda df: sorted((r["id"], r["text"], r["emotion"], r["sentiment"]) for r in df.collect())
    a = put(tmp_path / "train.csv", "dialog,emotion,act\n\"['it is a fine day', \"\"you're late again my friend\"\", 'no']\",\"[4, 1, 0]\",x\n\"what a great surprise this is __eou__ ok __eou__\",\"[6, 0]\",x\n")
    assert rows(R.dialogue_csv(spark, a, "train")) == [("dd_tr_0000_00", "it is a fine day", "joy", "pos"), ("dd_tr_0000_01", "you're late again my friend", "anger", "neg"), ("dd_tr_0001_00", "what a great surprise this is", "surprise", "pos")]
    b = put(tmp_path / "test.csv", "Utterance,emotion\nwe are here now,3\ntoo short,1\nand one more line,x\n")
    assert rows(R.dialogue_csv(spark, b, "test")) == [("dd_te_00000", "we are here now", "fear", "neg"), ("dd_te_00002", "and one more line", "neu", "neu")]
    c = put(tmp_path / "valid.csv", "what,ever\none two three four five,1\nshort,2\n")
    assert rows(R.dialogue_csv(spark, c, "valid")) == [("dd_va_00000", "one two three four five", "none", "neu")]
    t = put(tmp_path / "dialogues_text.txt", "how are you today friend __eou__ ok __eou__\nthat is really very sad news __eou__\n")
    e = put(tmp_path / "dialogues_emotion.txt", "4 0\n5\n")
    assert rows(R.paired_dialogues(spark, t, e)) == [("dd_0000_00", "how are you today friend", "joy", "pos"), ("dd_0001_00", "that is really very sad news", "sadness", "neg")]


def test_turn_ids_separators_and_fallback(spark, tmp_path):
    p = put(tmp_path / "ed.csv", "conv_id,utterance_idx,context,utterance\nhit:1,2,joyful,I got a new dog\nhit:1,3,joyful,no\n")
    assert [(r["id"], r["sentiment"], r["emotion"]) for r in R.turn_csv(spark, p, "train").collect()] == [("ed_train_hit:1_2", "pos", "joyful")]
    q = put(tmp_path / "no_ids.csv", "text,label\nonly three words,x\nI got a new dog,afraid\n")
    assert [(r["id"], r["sentiment"]) for r in R.turn_csv(spark, q, "test").collect()] == [("ed_test_00001_0", "neg")]
    # the comma of the header cuts it, but only the bar yields rows
    s = put(tmp_path / "bars.csv", "label, old|text\nanger|five words are in here, yes\n")
    assert [r["text"] for r in R.sniffed_csv(spark, s).collect()] == ["five words are in here, yes"]
    (tmp_path / "posts").mkdir()
    put(tmp_path / "posts" / "p1.txt", " a post \n")
    put(tmp_path / "posts" / "p2.txt", "  ")
    put(tmp_path / "posts" / "x.md", "no")
    assert [(r["id"], r["text"], r["sentiment"]) for r in R.corpus_or_folder(spark, str(tmp_path / "none.csv"), str(tmp_path / "posts")).collect()] == [("p1", "a post", "neu")]
    c = put(tmp_path / "corpus.csv", "id,text,sentiment\n1,one,pos\n2, ,neg\n")
    assert [r["id"] for r in R.corpus_or_folder(spark, c, str(tmp_path / "posts")).collect()] == ["1"]
