"""Corpus pipeline: every stage works on all that the one before kept; ``run`` applies them to ``documents``."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.layout import unbroadcast
from loomline.llm import langid, near_copies, packing, quality_crf, secret_scan
from loomline.llm.arrow import batch_limit, release, small_batches
from loomline.llm.queries import language_model, quality_model, vocabulary
from loomline.scratch import materialize, tidy

#: Columns that all stages but the last return.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a recognised language: null texts, texts without a letter, and ambiguous decisions.

    Whole texts of any length count; every row is judged by itself, so repeated rows share their fate. An empty table stays
    empty, and so does one without a labelled text to learn from.
    """
    small_batches(spark)
    shared = spark.sparkContext.broadcast(language_model(docs))

    @F.pandas_udf("boolean")
    def known(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            lang, score = shared.value.predict(texts.tolist())
            yield pd.Series([v != "und" and s >= langid.AMBIGUOUS for v, s in zip(lang, score, strict=True)], dtype=bool)
        release()

    return docs.where(known("text")).select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose quality score is below the operator's threshold; null and empty texts have the score of no line.

    Whole texts of any length count; every row is judged by itself, repeated rows too. An empty table stays empty.
    """
    small_batches(spark)
    shared = spark.sparkContext.broadcast(quality_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))

    @F.pandas_udf("boolean")
    def good(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(shared.value.score(texts.tolist()) >= quality_crf.GOOD_FROM)
        release()

    return docs.where(good("text")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of texts linked by a five-word Jaccard of 0.8 or more: the one with the group's least id.

    Of several texts of a group under that id, or of a group without any id, one stays: that of the least key of its shingles, and of
    equal texts the row that is least by its other columns. Unrelated texts of one id lead groups of their own, and stay. Null,
    empty and blank texts are one group; long texts count as a whole. An empty table stays empty.
    """
    small_batches(spark)
    near = near_copies.near_duplicates(docs)
    ids = materialize(near.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("rows"), F.count_if("leads").alias("kept")).where("rows > 1 or kept = 0"), "ids")
    # whatever id is not listed has one row, which stays
    single = docs.where("doc_id is not null").join(ids.select("doc_id"), "doc_id", "left_anti").select(*COLUMNS)
    # only rows of ids that repeat, and rows without one, are grouped
    rest = [c for c in COLUMNS if c != "doc_id"]
    again = docs.select(*COLUMNS).join(ids.where("rows > 1 and kept > 0").select("doc_id"), "doc_id", "left_semi").select(*COLUMNS)
    several = near_copies.with_key(again.unionByName(docs.select(*COLUMNS).where("doc_id is null")))
    lead = near.where("leads").select(F.col("doc_id").alias("lead_id"), F.col("key").alias("lead_key")).distinct()
    mine = F.col("doc_id").eqNullSafe(F.col("lead_id")) & (F.col("key") == F.col("lead_key"))
    one = unbroadcast(several).join(lead, mine, "left_semi").groupBy("doc_id", "key").agg(F.min(F.struct(*rest)).alias("r")).select("doc_id", *(f"r.{c}" for c in rest))
    return single.unionByName(one.select(*COLUMNS))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask every secret in the texts, however long; n_chars follows the text (null texts stay null and keep theirs). No row goes."""
    small_batches(spark)
    clean = secret_scan.redacted(docs.select(*COLUMNS))
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack all that is left into sequences: pieces of every row, null texts as empty ones, rows with one id each by itself."""
    small_batches(spark)
    return packing.pack(docs, vocabulary())


STAGES = [("language_id", language_id), ("quality", quality), ("near_duplicates", near_duplicates), ("secrets", secrets), ("packing", pack)]

#: Classifiers, minimum-cost segmentation and column generation have no SQL; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage, each stage's rows written and reread in between, and dropped with all working tables at the end.

    Every stage but the last returns the five columns of documents (``COLUMNS``) and no others. The session's limit of an Arrow batch, which
    the stages lower, is as before afterwards.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with batch_limit(spark), tidy() as keep:
        for name, stage in STAGES:
            docs = materialize(stage(spark, docs, sf_dir), name)
        return keep(docs)
