"""Watch mode: new text files are measured as they come; running label counts over an event-time window."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.functions import text as T
from loomline.functions.lexicon import Lexicon
from loomline.operators import documents as D


def text_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Files of a folder as they appear, one document each. A changed file counts only under a new name."""
    return spark.readStream.option("wholetext", True).format("text").load(folder).select(F.col("_metadata.file_name").alias("doc_id"), F.col("value").alias("text"))


def measured(stream: DataFrame, lex: Lexicon) -> DataFrame:
    """The stateless per-document operators apply to a stream as they are."""
    return D.doc_metrics(stream, lex)


def watch(spark: SparkSession, folder: str, lex: Lexicon, checkpoint: str, each: Callable[[DataFrame, int], None], every: str = "1500 milliseconds", once: bool = False):
    """Start the query: ``each(batch, number)`` gets the metric rows of new files. once: what is there now, then stop."""
    w = measured(text_stream(spark, folder), lex).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime=every)).start()


def windowed_labels(stream: DataFrame, ts: str, score: str, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Label counts per tumbling window, with a watermark that bounds the state. Also works on a batch frame."""
    w = stream.withWatermark(ts, late) if stream.isStreaming else stream
    g = w.groupBy(F.window(ts, window).alias("w"), T.label(F.col(score)).alias("label")).agg(F.count("*").alias("n"), F.sum(score).alias("total"))
    return g.select(F.col("w.start").alias("start"), "label", "n", "total")
