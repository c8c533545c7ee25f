"""Readers. Each returns rows of the corpus schema (id, text, sentiment, emotion, attachment) unless it says otherwise."""

from __future__ import annotations

import ast
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomline.functions import text as T
from loomline.scratch import materialize

CORPUS = "id string, text string, sentiment string, emotion string, attachment string"
# Header names that hold texts and labels, the names of multi-label emotions by number, and what labels stand for.
TEXT_HEADERS = ["utterance", "text", "sentence", "utt", "response", "tweet", "content", "comment"]
LABEL_HEADERS = ["context", "emotion", "label", "emo", "sentiment", "feeling", "tag", "category", "class"]
EMOTION_NAMES = [
    "admiration", "amusement", "anger", "annoyance", "approval", "caring", "confusion", "curiosity", "desire", "disappointment", "disapproval", "disgust", "embarrassment", "excitement",
    "fear", "gratitude", "grief", "joy", "love", "nervousness", "optimism", "pride", "realization", "relief", "remorse", "sadness", "surprise", "neutral",
]
POSITIVE = [
    "admiration", "amusement", "approval", "caring", "desire", "excitement", "gratitude", "joy", "love", "optimism", "pride", "relief", "happy", "happiness", "hopeful", "grateful", "proud", "confident",
    "trusting", "content", "faithful", "prepared", "impressed", "joyful",
]
NEGATIVE = [
    "anger", "annoyance", "disappointment", "disapproval", "disgust", "embarrassment", "fear", "grief", "nervousness", "remorse", "sadness", "angry", "sad", "afraid", "terrified", "anxious", "ashamed", "guilty",
    "jealous", "lonely", "devastated", "disgusted", "furious", "annoyed", "embarrassed", "disappointed", "shame", "guilt",
]
DIALOGUE_NAMES = ["neu", "anger", "disgust", "fear", "joy", "sadness", "surprise"]
DIALOGUE_SENTIMENT = {"joy": "pos", "surprise": "pos", "neu": "neu", "anger": "neg", "disgust": "neg", "fear": "neg", "sadness": "neg"}
DIALOGUE_TEXTS = ["utterance", "text", "sentence"]
TURN_IDS = ["conv_id", "id", "dialog_id"]
TURN_NUMBERS = ["utterance_idx", "turn_idx", "idx"]
DIALOGUE_EMOTIONS = ["none", "anger", "disgust", "fear", "happiness", "sadness", "surprise"]


def words_at_least(df: DataFrame, n: int, text_col: str = "text") -> DataFrame:
    return df.where(T.blank_words(F.coalesce(F.col(text_col), F.lit(""))) >= n)


def sentiment_of(emotion: Column) -> Column:
    """pos, neg or neu for an emotion's name; plain labels and prefixes are understood too."""
    e = F.lower(F.trim(emotion))
    return F.when(e.isin(POSITIVE) | e.startswith("pos") | (e == "2"), "pos").when(e.isin(NEGATIVE) | e.startswith("neg") | (e == "0"), "neg").otherwise("neu")


def corpus_rows(df: DataFrame) -> DataFrame:
    """Any frame with a text as corpus rows: labels lower-cased, sentiment cut to 3 letters, defaults neu and none.

    Rows without an ``id`` column are named by their number in the file, where the reader gave one (``_row``, from 0): r0000, r0001 and
    on. Frames without either have no order to number; their ids are hashes of the text, equal for equal texts.
    """
    has = set(df.columns)
    number = F.concat(F.lit("r"), F.when(F.col("_row") < 10000, F.lpad(F.col("_row").cast("string"), 4, "0")).otherwise(F.col("_row").cast("string"))) if "_row" in has else F.concat(F.lit("r"), F.sha1(F.coalesce("text", F.lit(""))).substr(1, 12))
    low = lambda c, d: F.lower(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(d)))) if c in has else F.lit(d)
    return df.select(
        (F.col("id").cast("string") if "id" in has else number).alias("id"),
        T.strip(F.coalesce("text", F.lit(""))).alias("text"), F.substring(low("sentiment", "neu"), 1, 3).alias("sentiment"), low("emotion", "none").alias("emotion"), low("attachment", "none").alias("attachment"),
    )


def numbered(scan: DataFrame, name: str = "_row") -> DataFrame:
    """The rows of a file scan (a frame as a reader returns it) with their number in their file, from 0, and ``_file``.

    Files are read in byte ranges. A first pass counts the rows of each range and finds the first of them in the task's order; running sums of
    the counts over a file's ranges (one row a range) say with which number a range begins; the second read numbers its rows from there. No task
    reads more than its ranges, however long the file is.
    """
    columns = scan.columns
    x = scan.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"))
    ranges = x.groupBy("_file", "_block").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    earlier = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.select("_file", "_block", "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    return x.join(starts, ["_file", "_block"]).select(*columns, "_file", (F.col("_start") + F.col("_at") - F.col("_first")).alias(name))


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """Whole files (one, a glob, a folder) as documents: id is the file's name."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("id"), F.col("value").alias("text"))


def labelled_csv(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """Corpus rows of a CSV file; without an ``id`` column the ids are row numbers."""
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"', sep=sep)
    return corpus_rows(raw if "id" in raw.columns else numbered(raw))


def labelled_jsonl(spark: SparkSession, path: str) -> DataFrame:
    return corpus_rows(spark.read.schema(CORPUS).json(path))


def posts(spark: SparkSession, path: str) -> DataFrame:
    """Post lines with title and selftext: malformed, deleted, removed and empty ones go."""
    raw = spark.read.schema("id string, title string, selftext string, subreddit string, score int, created long").json(path, mode="DROPMALFORMED")
    return post_rows(raw)


def post_rows(raw: DataFrame) -> DataFrame:
    body = F.coalesce("selftext", F.lit(""))
    return raw.where(~body.isin("[deleted]", "[removed]", "")).withColumn("text", F.concat("title", F.lit(". "), body))


def api_pages(pages: DataFrame, json_col: str = "page") -> DataFrame:
    """Posts of API pages kept as JSON strings: data.children[].data, with the page's cursor."""
    shape = "data struct<after:string,children:array<struct<data:struct<id:string,title:string,selftext:string,score:int>>>>"
    x = pages.select(F.from_json(json_col, shape).alias("p")).select("p.data.after", F.explode("p.data.children").alias("c"))
    return x.select("after", "c.data.*")


def quality_posts(df: DataFrame, least_words: int, least_score: int) -> DataFrame:
    """Cleaned text of title and body with enough words and score."""
    body = T.clean_text(F.col("selftext"))
    x = df.withColumn("text", T.title_and_body(T.clean_text(F.col("title")), body)).where((body != "") & (F.col("score") >= least_score))
    return x.withColumn("n_words", T.word_count(F.col("text"))).where(F.col("n_words") >= least_words)


def session_transcript(df: DataFrame, order: Sequence[str] = ("turn_id",), session: str = "session_id", speaker: str = "speaker", text: str = "text", keep: str = "C") -> DataFrame:
    """Runs of consecutive rows of one session, of one speaker's turns only, joined by blanks: session, run, text.

    Rows are ordered by session and ``order``. A session's turns stay together, so its rows form one run unless the
    order brings another session in between; with a global file order pass a line number and :func:`session_runs`.
    """
    kept = df.where(F.upper(speaker) == keep)
    parts = kept.groupBy(session).agg(F.sort_array(F.collect_list(F.struct(*order, F.col(text).alias("t")))).alias("l"))
    return parts.select(F.concat(F.lit("s"), F.col(session).cast("string")).alias("id"), F.array_join(F.transform("l", lambda x: x["t"]), " ").alias("text"))


def session_runs(df: DataFrame, line: str, session: str = "session_id", speaker: str = "speaker", text: str = "text", keep: str = "C", chunk: str | None = None) -> DataFrame:
    """Run-length version over a file's line order, per file (``chunk``) or over all rows: a session that comes back starts a new run.

    A segmented scan: rows are dealt in ranges of lines; inside a range a run starts where the session differs from the row before, and the first row of
    a range is compared with the last of the range before (one row a range); run numbers are running sums of starts, carried from range to
    range. No task gets a whole file. Rows without a session start a run each.
    """
    from loomline.operators.ranks import join_on

    by = [chunk] if chunk else []
    kept = df.where(F.upper(speaker) == keep).select(*by, F.col(line).alias("_line"), F.col(session).alias("_s"), F.col(text).alias("_t"))
    rows = materialize(kept.repartitionByRange(*by, "_line").withColumn("_part", F.spark_partition_id()), "lines")
    starts = lambda before: F.coalesce(before != F.col("_s"), F.lit(True)).cast("int")
    inside = Window.partitionBy(*by, "_part").orderBy("_line")
    ranges = Window.partitionBy(*by).orderBy("_part")
    x = rows.withColumns({"_first": F.row_number().over(inside) == 1, "_new": starts(F.lag("_s").over(inside))})
    ends = rows.groupBy(*by, "_part").agg(F.max_by("_s", "_line").alias("_last"), F.min_by("_s", "_line").alias("_s"))
    stitched = ends.select(*by, "_part", starts(F.lag("_last").over(ranges)).alias("_head"))
    own = x.groupBy(*by, "_part").agg(F.sum(F.when(F.col("_first"), 0).otherwise(F.col("_new"))).alias("_more"))
    heads = join_on(stitched, own, [*by, "_part"])
    carry = heads.select(*by, "_part", "_head", F.coalesce(F.sum(F.col("_head") + F.col("_more")).over(ranges.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    run = F.col("_before") + F.sum(F.when(F.col("_first"), F.col("_head")).otherwise(F.col("_new"))).over(inside)
    runs = join_on(x, carry, [*by, "_part"]).withColumn("run", run)
    g = runs.groupBy(*by, "run", "_s").agg(F.sort_array(F.collect_list(F.struct("_line", "_t"))).alias("l"))
    return g.select(*by, F.concat(F.lit("s"), F.col("_s").cast("string")).alias("id"), "run", F.array_join(F.transform("l", lambda x: x["_t"]), " ").alias("text"))


def multi_label(df: DataFrame, least_words: int = 4, names: Sequence[str] = tuple(EMOTION_NAMES)) -> DataFrame:
    """``text`` and comma-separated ``emotion_ids``: pos if any is positive, else neg if any is negative, else neu. Rows without a known id go."""
    ids = F.filter(F.transform(F.split("emotion_ids", ","), lambda x: F.get(F.array(*map(F.lit, names)), F.try_to_number(F.trim(x), F.lit("999")).cast("int"))), lambda x: x.isNotNull())
    x = words_at_least(df, least_words).withColumn("_e", ids).where(F.size("_e") > 0)
    any_ = lambda ws: F.exists("_e", lambda e: e.isin(ws))
    return x.withColumns({"sentiment": F.when(any_(POSITIVE), "pos").when(any_(NEGATIVE), "neg").otherwise("neu"), "emotion": F.coalesce(F.get("_e", F.lit(0)), F.lit("neutral"))}).drop("_e")


def resolve_headers(columns: Sequence[str]) -> tuple[str, str | None]:
    """The text and label columns of a file by alias, in the aliases' order; else the first column and none."""
    low = {c.strip().lower(): c for c in columns}
    pick = lambda names: next((low[n] for n in names if n in low), None)
    text = pick(TEXT_HEADERS) or columns[0]
    return text, next((low[n] for n in LABEL_HEADERS if n in low and low[n] != text), None)


def _padded(n: Column, width: int) -> Column:
    """A number in ``width`` digits at least."""
    t = n.cast("string")
    return F.when(F.length(t) < width, F.lpad(t, width, "0")).otherwise(t)


def turn_ids(df: DataFrame, split: str, kind: str = "ed") -> Column:
    """``<kind>_<split>_<conversation>_<turn>`` from the columns that hold them by alias; without a conversation its row number in five digits, without a turn 0."""
    low = {c.strip().lower(): c for c in df.columns}
    pick = lambda names: next((low[n] for n in names if n in low), None)
    conv, turn = pick(TURN_IDS), pick(TURN_NUMBERS)
    return F.concat_ws("_", F.lit(kind), F.lit(split), F.col(conv).cast("string") if conv else _padded(F.col("_row"), 5), F.col(turn).cast("string") if turn else F.lit("0"))


def turn_csv(spark: SparkSession, path: str, split: str, least_words: int = 4) -> DataFrame:
    """As :func:`aliased_csv`, with ids by :func:`turn_ids`."""
    raw = numbered(spark.read.csv(path, header=True, multiLine=True, escape='"')).drop("_file")
    named = raw.withColumn("_id", turn_ids(raw, split))
    return aliased(named.drop("_row"), least_words, "_id")


def aliased(df: DataFrame, least_words: int = 3, id_col: str | None = None) -> DataFrame:
    """Corpus rows of a frame with unknown headers; ``id_col`` names a column of ids."""
    text, label = resolve_headers([c for c in df.columns if c != id_col])
    emotion = F.lower(F.trim(F.regexp_replace(F.col(label).cast("string"), "^[\"']+|[\"']+$", ""))) if label else F.lit("none")
    x = df.select(*([F.col(id_col).alias("id")] if id_col else []), T.strip(F.regexp_replace(F.col(text).cast("string"), "^[\"']+|[\"']+$", "")).alias("text"), emotion.alias("emotion"))
    return corpus_rows(words_at_least(x.withColumn("sentiment", sentiment_of(F.col("emotion"))), least_words))


def aliased_csv(spark: SparkSession, path: str, least_words: int = 3, sep: str = ",") -> DataFrame:
    return aliased(spark.read.csv(path, header=True, multiLine=True, escape='"', sep=sep), least_words)


def sniffed_csv(spark: SparkSession, path: str, least_words: int = 5) -> DataFrame:
    """As :func:`aliased_csv` with the first of comma, bar, tab and semicolon that cuts a known text header out and yields rows with enough words; comma if none does."""
    head = spark.read.text(path).first()
    line = head[0] if head else ""
    for sep in (",", "|", "\t", ";"):
        if sep in line and any(c.strip(' "').lower() in TEXT_HEADERS for c in line.split(sep)):
            rows = aliased_csv(spark, path, least_words, sep)
            if not rows.isEmpty():
                return rows
    return aliased_csv(spark, path, least_words)


def corpus_or_folder(spark: SparkSession, table: str, folder: str) -> DataFrame:
    """Corpus rows of a CSV file with some text; where there is no such file, of the text files of a folder, named by their stems."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table)
    if hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        rows = labelled_csv(spark, table)
    else:
        files = spark.read.option("pathGlobFilter", "*.txt").text(folder, wholetext=True)
        rows = corpus_rows(files.select(F.regexp_replace(F.col("_metadata.file_name"), r"\.txt$", "").alias("id"), F.col("value").alias("text")))
    return rows.where("text <> ''")


def parquet_emotions(spark: SparkSession, path: str, least_words: int = 3) -> DataFrame:
    return aliased(spark.read.parquet(path), least_words)


def tweet_rows(lines: DataFrame, least_words: int = 4, column: str = "value") -> DataFrame:
    """Lines ``id \\t label \\t text...``; further tabs belong to the text."""
    p = F.split(column, "\t")
    x = lines.where(F.size(p) >= 3).select(p[0].alias("id"), sentiment_of(p[1]).alias("sentiment"), F.array_join(F.slice(p, 3, F.size(p) - 2), "\t").alias("text"))
    return corpus_rows(words_at_least(x, least_words))


def tweets(spark: SparkSession, path: str, least_words: int = 4) -> DataFrame:
    return tweet_rows(spark.read.text(path), least_words)


def dialogue_rows(df: DataFrame, least_words: int = 5) -> DataFrame:
    """``dialog`` (array of utterances, or such a list as text) and ``emotion`` (array of numbers) zipped into rows."""
    listed = lambda c, kind: F.from_json(F.regexp_replace(c, r"(?<=[\[,\s])'|'(?=[\],])", '"'), kind) if dict(df.dtypes)[c] == "string" else F.col(c).cast(kind)
    x = df.withColumn("_z", F.arrays_zip(listed("dialog", "array<string>").alias("u"), listed("emotion", "array<int>").alias("e")))
    r = x.select(*(c for c in df.columns if c not in ("dialog", "emotion")), F.posexplode("_z").alias("turn", "z")).where("z.u is not null and z.e is not null")
    name = F.coalesce(F.get(F.array(*map(F.lit, DIALOGUE_EMOTIONS)), F.col("z.e")), F.lit("none"))
    return words_at_least(r.select("*", T.strip(F.col("z.u")).alias("text"), name.alias("emotion")).drop("z"), least_words).withColumn("sentiment", sentiment_of(F.col("emotion")))


def split_dialogue(df: DataFrame, column: str = "value", least_words: int = 5) -> DataFrame:
    """Lines whose utterances end in ``__eou__``: one row an utterance, with its turn."""
    x = df.select("*", F.posexplode(F.split(column, "__eou__")).alias("turn", "text")).withColumn("text", T.strip(F.col("text")))
    return words_at_least(x, least_words)


def _dialogue(df: DataFrame, least_words: int) -> DataFrame:
    """Corpus rows of id, text and the emotion's number as text."""
    e = F.coalesce(F.get(F.array(*map(F.lit, DIALOGUE_NAMES)), F.expr("try_cast(trim(emotion) as int)")), F.lit("neu"))
    names = F.create_map(*(F.lit(x) for p in DIALOGUE_SENTIMENT.items() for x in p))
    x = df.select("id", T.strip(F.col("text")).alias("text"), e.alias("emotion"))
    return corpus_rows(words_at_least(x, least_words).withColumn("sentiment", names[F.col("emotion")]))


def dialogue_csv(spark: SparkSession, path: str, split: str) -> DataFrame:
    """A CSV file of dialogues in any of three layouts: a dialogue a row, as two lists written out (``dialog``, ``emotion``); an utterance a row
    (``utterance``, ``text`` or ``sentence``, and ``emotion`` by number); else texts in the first column, without labels. Ids name the split's first two letters,
    the row and the utterance."""
    raw = numbered(spark.read.csv(path, header=True, multiLine=True, escape='"')).drop("_file")
    low = {c.strip().lower(): c for c in raw.columns}
    tag = F.lit(f"dd_{split[:2]}")
    if "dialog" in low:

        @F.pandas_udf("array<struct<text:string,emotion:string>>")
        def turns(dialogs: pd.Series, emotions: pd.Series) -> pd.Series:
            def one(d: str | None, e: str | None) -> list[dict]:
                try:
                    said = [str(u) for u in ast.literal_eval((d or "").strip())]
                except (ValueError, SyntaxError, TypeError):
                    said = (d or "").strip().strip("[]'\"").split("__eou__")
                try:
                    felt = list(ast.literal_eval((e or "").strip()))
                except (ValueError, SyntaxError, TypeError):
                    felt = [0] * len(said)
                return [{"text": t, "emotion": str(f)} for t, f in zip(said, felt, strict=False)]

            return pd.Series([one(d, e) for d, e in zip(dialogs, emotions, strict=True)])

        felt = F.col(low["emotion"]) if "emotion" in low else F.lit(None).cast("string")
        x = raw.select("_row", F.posexplode(turns(F.col(low["dialog"]), felt)).alias("_u", "t")).select(F.concat_ws("_", tag, _padded(F.col("_row"), 4), _padded(F.col("_u"), 2)).alias("id"), "t.text", "t.emotion")
        return _dialogue(x, 5)
    named = F.concat_ws("_", tag, _padded(F.col("_row"), 5)).alias("id")
    text = next((low[n] for n in DIALOGUE_TEXTS if n in low), None)
    if text:
        return _dialogue(raw.select(named, F.col(text).alias("text"), (F.col(low["emotion"]) if "emotion" in low else F.lit("0")).alias("emotion")), 4)
    return corpus_rows(words_at_least(raw.select(named, T.strip(F.col(raw.columns[0])).alias("text")), 5))


def paired_dialogues(spark: SparkSession, texts: str, emotions: str) -> DataFrame:
    """Two files by line: utterances ended by ``__eou__``, and as many emotions by number between blanks."""
    t = numbered_lines(spark, texts).select("line", F.split("value", "__eou__").alias("u"))
    e = numbered_lines(spark, emotions).select("line", F.filter(F.split("value", r"\s+"), lambda x: x != "").alias("e"))
    z = t.join(e, "line").select("line", F.posexplode(F.arrays_zip("u", "e")).alias("_u", "z")).where("z.u is not null and z.e is not null")
    return _dialogue(z.select(F.concat_ws("_", F.lit("dd"), _padded(F.col("line"), 4), _padded(F.col("_u"), 2)).alias("id"), F.col("z.u").alias("text"), F.col("z.e").alias("emotion")), 5)


def utterances(frames: Sequence[DataFrame], least_words: int = 4) -> DataFrame:
    """Union of splits with columns Utterance and Emotion."""
    from loomline.operators.evaluation import union_all

    x = union_all([f.select(F.col("Utterance").alias("text"), F.lower("Emotion").alias("emotion")) for f in frames])
    return corpus_rows(words_at_least(x.withColumn("sentiment", sentiment_of(F.col("emotion"))), least_words))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of one file with their number (``line``, from 0), by byte ranges: see :func:`numbered`. Lines end in a line feed only."""
    return numbered(spark.read.text(path, lineSep="\n"), "line").select("line", "value")


def parallel_files(spark: SparkSession, texts: str, labels: str, least_words: int = 3, prefix: str = "p") -> DataFrame:
    """Two files matched by line number; labels 0, 1, 2 are neg, neu, pos, and lines with any other go. Ids are ``prefix`` and the number, in five digits."""
    t = numbered_lines(spark, texts).select("line", T.strip(F.col("value")).alias("text"))
    names = F.create_map(*(F.lit(x) for p in (("0", "neg"), ("1", "neu"), ("2", "pos")) for x in p))
    y = numbered_lines(spark, labels).select("line", F.try_element_at(names, T.strip(F.col("value"))).alias("sentiment")).where("sentiment is not null")
    number = F.col("line").cast("string")
    x = t.join(y, "line").withColumn("id", F.concat(F.lit(prefix), F.when(F.col("line") < 100_000, F.lpad(number, 5, "0")).otherwise(number)))
    return corpus_rows(words_at_least(x, least_words))


def metric_files(spark: SparkSession, path: str, metrics: Sequence[str], order: str, most: int = 5000) -> DataFrame:
    """Metric CSVs of several datasets (a ``dataset`` column or folder): "", None, NA and nan become null; capped by a declared order."""
    from loomline.operators.evaluation import capped

    raw = spark.read.csv(path, header=True, multiLine=True, escape='"')
    clean = raw.withColumns({m: F.expr(f"try_cast(case when trim({m}) in ('', 'None', 'NA', 'nan') then null else {m} end as double)") for m in metrics})
    return capped(clean, ["dataset"], order, most)


def annotations(spark: SparkSession, stem: str) -> DataFrame:
    """``<stem>.annotations.json`` if there is one, else ``<stem>_annotations.csv``."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(stem + ".annotations.json")
    if hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.read.schema("para_idx int, text_snippet string, sentiment string, conflict boolean, attachment string").json(stem + ".annotations.json", multiLine=True)
    return spark.read.csv(stem + "_annotations.csv", header=True, multiLine=True, escape='"')


def rater_matrix(raters: Sequence[DataFrame], default: str = "neu") -> DataFrame:
    """Labels of several raters aligned on the first rater's ids; what a rater lacks is ``default``. One row per id and rater."""
    first = raters[0].select("id")
    rows = [first.join(r.select("id", F.col("sentiment").alias("label")), "id", "left").select("id", F.lit(f"r{k}").alias("rater"), F.coalesce("label", F.lit(default)).alias("label")) for k, r in enumerate(raters, 1)]
    from loomline.operators.evaluation import union_all

    return union_all(rows)


def session_record(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("filepath string, timestamp string, mean_sentiment double, gase double, pti double, teg double, rci double, pai double, n_words int, flesch_re double").json(path)


def one_text(spark: SparkSession, text: str, doc_id: str = "text") -> DataFrame:
    return spark.createDataFrame([(doc_id, text)], "id string, text string")


class Registry:
    """Named datasets: a loader, a description and a row cap each; :meth:`load` unions them with a ``dataset`` column."""

    def __init__(self):
        self.entries: dict[str, tuple[Callable[[SparkSession], DataFrame], dict, int | None]] = {}

    def add(self, key: str, loader: Callable[[SparkSession], DataFrame], most: int | None = None, **meta) -> None:
        self.entries[key] = (loader, meta, most)

    def load(self, spark: SparkSession, keys: Sequence[str] | None = None, order: str = "id") -> DataFrame:
        from loomline.operators.evaluation import capped, union_all

        frames = []
        for k in keys or list(self.entries):
            loader, _, most = self.entries[k]
            df = loader(spark).withColumn("dataset", F.lit(k))
            frames.append(capped(df, ["dataset"], order, most) if most else df)
        return union_all(frames)
