"""Table forms of the implicit joins: for lexicons too large for literals, and for segment tables."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomline.functions import text as T
from loomline.functions.lexicon import Lexicon
from loomline.scratch import materialize


def sentence_table(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per sentence: sent_ix (from 0), sentence."""
    return df.select(id_col, F.posexplode(T.sentences(F.coalesce(F.col(text_col), F.lit("")))).alias("sent_ix", "sentence"))


def _contexts(lex: Lexicon) -> Column:
    """Of the array ``toks`` each token (``term``) with its place, its two tokens before and whether one of four before is a negator."""
    neg = list(lex.negators)
    return F.transform(
        "toks",
        lambda t, i: F.struct(
            t.alias("term"), i.alias("tok_ix"), F.array_join(F.slice("toks", F.greatest(i - 1, F.lit(1)), F.least(i, F.lit(2))), " ").alias("before"),
            (F.exists(F.slice("toks", F.greatest(i - 3, F.lit(1)), F.least(i, F.lit(4))), lambda x: x.isin(neg)) if neg else F.lit(False)).alias("negated"),
        ),
    )


def lexicon_hits(sentences: DataFrame, terms: DataFrame, lex: Lexicon, id_col: str = "doc_id") -> DataFrame:
    """Equi-join of tokens with a table ``terms`` (term, s, i, emotions, horseman), each hit with its two tokens before and whether it is negated.

    The context is cut from the token array before the join, so no window is needed and only hits travel on.
    ``lex`` gives the modifiers. Spark picks the join by the table's size.
    """
    toks = sentences.select(id_col, "sent_ix", T.tokens(F.col("sentence")).alias("toks"))
    return toks.select(id_col, "sent_ix", F.explode(_contexts(lex)).alias("x")).select(id_col, "sent_ix", "x.*").join(terms, "term")


#: Characters of a gram: a phrase is keyed by grams of the largest of these sizes that it holds.
GRAMS = (1, 2, 3, 6, 12)
#: Phrases up to which every sentence is searched for each of them.
FEW = 256
#: Terms up to which a lexicon's table is sent to the sentences.
TERMS = 1 << 17


def _grams(c: Column, size: int) -> Column:
    """Distinct substrings of ``size`` characters, in one pass (a substring by its place reads the text from the start again)."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(rf"(?s)(?=(.{{{size}}}))."), F.lit(1)))


def phrase_hits(sentences: DataFrame, phrases: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Join of sentences (id, sent_ix, sentence) with phrases (``term`` and more) that their lower-cased text contains as a substring, one row a phrase and sentence.

    A phrase is keyed by the one of its grams of up to twelve characters that fewest sentences hold, sentences by all of theirs of these sizes; the join
    is by equality and moves ids and grams only. A phrase that is its own gram is found by that; for longer ones the sentences met are
    read again by id, and the whole phrase is compared. So phrases may be many: no task gets all of them unless Spark finds their table small.
    Up to ``FEW`` phrases are sent to the sentences instead. A phrase one of whose grams no sentence holds is left out before. Null and empty phrases match nothing; repeated ones match each.
    """
    low = F.lower("sentence")
    size = F.greatest(*(F.when(F.length("term") >= k, F.lit(k)) for k in GRAMS))
    known = phrases.where(F.length("term") > 0).withColumn("_size", size)
    if known.select("term").limit(FEW + 1).count() <= FEW:
        # a search each, and neither grams nor sentences are shuffled
        texts = sentences.select(id_col, "sent_ix", low.alias("_low"))
        return texts.join(F.broadcast(known.drop("_size")), F.contains("_low", F.col("term"))).select(id_col, "sent_ix", *phrases.columns)
    sizes = [r[0] for r in known.select("_size").distinct().collect()]  # one of GRAMS each
    if not sizes:
        return sentences.select(id_col, "sent_ix").limit(0).crossJoin(phrases.limit(0))
    at = lambda c, k: F.transform(_grams(c, k), lambda g: F.struct(F.lit(k).alias("_size"), g.alias("_gram")))
    held = sentences.select(id_col, "sent_ix", F.explode(T.bound(low, lambda c: F.concat(*(at(c, k) for k in sizes)))).alias("_g")).select(id_col, "sent_ix", "_g.*")
    own = known.select("term", "_size").distinct().select("term", "_size", F.explode(F.concat(*(F.when(F.col("_size") == k, _grams(F.col("term"), k)).otherwise(F.array().cast("array<string>")) for k in sizes))).alias("_gram"))
    # counted before the shuffle, so that grams travel once a task and not once a sentence
    often = held.groupBy("_size", "_gram").agg(F.count("*").alias("_n"))
    # the rarest gram, if sentences hold all of them
    counted = own.join(often, ["_size", "_gram"], "left").groupBy("term", "_size").agg(F.min_by("_gram", F.struct("_n", "_gram")).alias("_gram"), F.count_if(F.col("_n").isNull()).alias("_none")).where("_none = 0")
    keyed = materialize(counted.select("term", "_size", "_gram"), "keyed")  # its size is known then, and a small one needs no shuffle of grams
    met = held.join(keyed, ["_size", "_gram"])
    whole = met.where(F.length("term") == F.col("_size")).select(id_col, "sent_ix", "term")
    part = met.where(F.length("term") > F.col("_size")).select(id_col, "sent_ix", "term")
    same = F.col(id_col).eqNullSafe(F.col("_id")) & (F.col("sent_ix") == F.col("_ix"))
    text = sentences.select(F.col(id_col).alias("_id"), F.col("sent_ix").alias("_ix"), low.alias("_low"))
    part = part.join(text, same).where(F.contains("_low", F.col("term"))).select(id_col, "sent_ix", "term")
    found = whole.unionByName(part).withColumnRenamed("term", "_term")
    return found.join(known.drop("_size"), F.col("_term") == F.col("term")).select(id_col, "sent_ix", *phrases.columns)


def _sum_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (id, sent_ix, sarcasm, last, plain, turned, n_emotions) those with ``last``, with the sums of the rows since the one before."""
    carry = [0.0, 0.0, 0]
    for b in batches:
        ends = np.flatnonzero(b.column(3).to_numpy(zero_copy_only=False))
        values = [b.column(k).to_numpy(zero_copy_only=False) for k in (4, 5, 6)]
        done = ends[-1] + 1 if len(ends) else 0
        if done:
            sums = [np.add.reduceat(v[:done], np.concatenate([[0], ends[:-1] + 1])) for v in values]
            for k, s in enumerate(sums):
                s[0] += carry[k]
            at = pa.array(ends)
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(at) for k in range(3)), *map(pa.array, sums)], names=[b.schema.names[k] for k in (0, 1, 2, 4, 5, 6)])
            carry = [0.0, 0.0, 0]
        carry = [c + v[done:].sum() for c, v in zip(carry, values, strict=True)]


def _scored_in_place(s: DataFrame, terms: DataFrame, lex: Lexicon, modifier: Column, id_col: str) -> DataFrame:
    """Sums of every sentence without a shuffle: its tokens meet the broadcast lexicon in their order and are followed by a row that closes it.

    A task holds the lexicon and one batch of rows, however many sentences it reads.
    """
    listed = F.array(*(F.struct(F.lit(p.term).alias("t"), F.lit(float(p.weight)).alias("w"), F.lit(len(p.emotions)).alias("e")) for p in lex.phrases)).cast("array<struct<t:string,w:double,e:int>>")
    said = F.filter(listed, lambda p: F.contains(F.lower("sentence"), p["t"]))
    x = s.select(id_col, "sent_ix", T.any_match(F.lower("sentence"), lex.sarcasm).alias("sarcasm"), T.tokens(F.col("sentence")).alias("toks"), said.alias("said"))
    end = F.struct(F.lit(None).cast("string").alias("term"), F.lit(-1).alias("tok_ix"), F.lit("").alias("before"), F.lit(False).alias("negated"))
    rows = x.select(id_col, "sent_ix", "sarcasm", "said", F.explode(F.concat(_contexts(lex), F.array(end))).alias("x")).select(id_col, "sent_ix", "sarcasm", "said", "x.*")
    met = rows.join(F.broadcast(terms.withColumn("_hit", F.lit(True))), "term", "left").where("tok_ix = -1 or _hit")
    turn = lambda v: F.when(v > 0, -v).otherwise(v)
    last, v = F.col("tok_ix") == -1, F.coalesce(F.col("s") * F.col("i") * modifier * F.when(F.col("negated"), -0.7).otherwise(1.0), F.lit(0.0))
    total = lambda f, zero: F.aggregate("said", zero, lambda a, p: a + f(p))
    parts = met.select(
        F.col(id_col).alias("id"), "sent_ix", "sarcasm", last.alias("last"), F.when(last, total(lambda p: p["w"], F.lit(0.0))).otherwise(v).alias("plain"), F.when(last, total(lambda p: turn(p["w"]), F.lit(0.0))).otherwise(turn(v)).alias("turned"),
        F.when(last, total(lambda p: p["e"], F.lit(0))).otherwise(F.coalesce(F.greatest(F.size("emotions"), F.lit(0)), F.lit(0))).cast("long").alias("n_emotions"),
    )
    kind = s.schema[id_col].dataType.simpleString()
    return parts.mapInArrow(_sum_runs, f"id {kind}, sent_ix int, sarcasm boolean, plain double, turned double, n_emotions long").withColumnRenamed("id", id_col)


def score_sentences(df: DataFrame, terms: DataFrame, lex: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Sentence compounds as in the array form, with single words from a table of any size and phrases from ``lex``.

    Up to ``TERMS`` words and ``FEW`` phrases go to the sentences, and nothing is shuffled; hits of more are joined and summed by sentence.
    """
    s = sentence_table(df, id_col, text_col)
    up = F.greatest(F.lit(1.0), *(F.when(F.col("before").contains(w), F.lit(float(m))).otherwise(1.0) for w, m in lex.intensifiers.items())) if lex.intensifiers else F.lit(1.0)
    mod = F.least(up, *(F.when(F.col("before").contains(w), F.lit(float(m))) for w, m in lex.diminishers.items())) if lex.diminishers else up
    result = lambda x: x.select(id_col, "sent_ix", T.rounded(F.col("t") / F.sqrt(F.col("t") * F.col("t") + 15)).alias("compound"), F.coalesce("n_emotions", F.lit(0)).cast("int").alias("n_emotions"))
    summed = F.when(F.col("sarcasm"), F.col("turned")).otherwise(F.col("plain"))
    if len(lex.phrases) <= FEW and terms.select("term").limit(TERMS + 1).count() <= TERMS:
        return result(_scored_in_place(s, terms, lex, mod, id_col).withColumn("t", summed))
    h = lexicon_hits(s, terms, lex, id_col)
    own = h.select(id_col, "sent_ix", (F.col("s") * F.col("i") * mod * F.when(F.col("negated"), -0.7).otherwise(1.0)).alias("v"), F.size("emotions").alias("e"))
    if lex.phrases:
        p = Lexicon.of(lex.phrases).table(df.sparkSession).drop("is_phrase")
        own = own.unionByName(phrase_hits(s, p, id_col).select(id_col, "sent_ix", (F.col("s") * F.col("i")).alias("v"), F.size("emotions").alias("e")))
    irony = T.any_match(F.lower("sentence"), lex.sarcasm)
    total = own.groupBy(id_col, "sent_ix").agg(F.sum("v").alias("plain"), F.sum(F.when(F.col("v") > 0, -F.col("v")).otherwise(F.col("v"))).alias("turned"), F.sum("e").alias("n_emotions"))
    x = s.select(id_col, "sent_ix", irony.alias("sarcasm")).join(total, [id_col, "sent_ix"], "left").withColumn("t", F.coalesce(summed, F.lit(0.0)))
    return result(x)


def without_words(tokens: DataFrame, words: Sequence[str], spark: SparkSession) -> DataFrame:
    """Anti-join of a token table with a word list."""
    return tokens.join(F.broadcast(spark.createDataFrame([(w,) for w in words], "token string")), "token", "left_anti")


def neighbours(segments: DataFrame, id_col: str, ix: str, value: str) -> DataFrame:
    """Each segment with the next one of its document."""
    nxt = F.lead(value).over(Window.partitionBy(id_col).orderBy(ix))
    return segments.withColumn("next", nxt).where("next is not null")


#: Segments whose bits make a block, and segments whose unions are made at a time (memory only).
BLOCK, ROWS = 8192, 1024


def overlapping_pairs(segments: list[list[int]], tokens: int) -> int:
    """Of all pairs of segments (lists of token numbers below ``tokens``) those that share a token.

    Per block of segments every token has a bitmap of the segments that hold it; a segment's union of these is counted, so no pair is written.
    """
    n, total = len(segments), 0
    size = np.array([len(s) for s in segments], np.int64)
    flat = np.fromiter((t for s in segments for t in s), np.int64, int(size.sum()))
    owner, ends = np.repeat(np.arange(n), size), np.concatenate([[0], np.cumsum(size)])
    for b in range(0, n, BLOCK):
        e = min(n, b + BLOCK)
        here, place = np.unique(flat[ends[b] : ends[e]], return_inverse=True)
        if not len(here):
            continue
        bits = np.zeros((len(here) + 1, BLOCK // 8), np.uint8)  # the last row stands for tokens that the block lacks
        at = owner[ends[b] : ends[e]] - b
        np.bitwise_or.at(bits, (place, at // 8), (1 << (at % 8)).astype(np.uint8))
        row = np.full(tokens, len(here), np.int64)
        row[here] = np.arange(len(here))
        # pairs (i, j) with j in the block and i before j
        for s in range(0, e, ROWS):
            t = min(e, s + ROWS)
            some = np.flatnonzero(size[s:t])
            if not len(some):
                continue
            union = np.bitwise_or.reduceat(bits[row[flat[ends[s] : ends[t]]]], (ends[s:t] - ends[s])[some])
            if t > b:  # of a segment of the block itself only later ones count
                i = some + s - b
                later = np.arange(BLOCK)[None, :] > i[:, None]
                union = union & np.packbits(later, axis=1, bitorder="little")
            total += int(np.bitwise_count(union).sum(dtype=np.int64))
    return total


def pair_counts(segments: DataFrame, id_col: str, value: str) -> DataFrame:
    """Of all pairs of a document's segments: ``pairs``, those ``overlapping`` (the arrays ``value`` share a token) and those ``equal``.

    A document's segments pass through one task, which counts shared tokens in bitmaps of segment numbers: a document of very many
    segments with a word in all of them costs blocks of bits, not rows of pairs.
    """
    twos = lambda n: F.floor(n * (n - 1) / 2).cast("long")
    kinds = segments.groupBy(id_col, value).agg(F.count("*").alias("n"))
    own = kinds.groupBy(id_col).agg(F.sum("n").alias("all"), F.sum(twos(F.col("n"))).alias("equal")).where(F.col("all") > 1)
    kind = segments.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, known = None, [], {}
        ids, counts = [], []

        def close() -> None:
            if key is not None:
                ids.append(key[0])
                counts.append(overlapping_pairs(held, len(known)))

        for b in batches:
            for k, tokens in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if key != (k,):
                    close()
                    key, held, known = (k,), [], {}
                held.append([known.setdefault(t, len(known)) for t in dict.fromkeys(tokens or ())])
            if len(ids) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(ids, b.schema.field(0).type), pa.array(counts, pa.int64())], names=["id", "overlapping"])
                ids, counts = [], []
        close()
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.schema.field(0).type), pa.array(counts, pa.int64())], names=["id", "overlapping"])

    met = segments.select(F.col(id_col).alias("id"), value).repartition("id").sortWithinPartitions("id").mapInArrow(run, f"id {kind}, overlapping long")
    both = own.join(met.withColumnRenamed("id", "_id"), F.col(id_col).eqNullSafe(F.col("_id")))
    return both.select(id_col, twos(F.col("all")).alias("pairs"), "overlapping", "equal")
