"""Constructed narratives: sentences picked by the keys of ``lineitem``, an order a paragraph, a customer a document.

The driver's prose is invented, so that pronouns, patterns and phases never occur in it. These texts make the operators
for them bite, at any scale, and the same rule is stated once for Spark and once as SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.functions.lexicon import Entry, Lexicon

TEMPLATES = [
    "I love you and I am very happy with us.", "You never listen to me.", "I was so angry that I could not talk.", "He said it was my fault.", "We were happy together in the early days.",
    "I am afraid you will leave me again.", "You always make it about you.", "I should have known better.", "Nothing ever changes and I feel lonely.", "She told me that everything is perfect.",
    "I am not happy, I am slightly hurt.", "They think I am a failure.", "It was the first date on 12/05/2019 and I felt calm.", "Oh great, another plan.", "I'm sorry, I was wrong.",
    "You made me hate this place.", "My husband Daniel gave me the cold shoulder.", "We broke up and I want closure.", "I don't trust him anymore.", "Why did I stay so long?",
    "I keep thinking about the pain.", "I demand that you tell me the truth!", "Everyone knows that nobody cares.", "Maybe someday I will be proud.", "He is hot and cold, back and forth.",
    "I feel nothing and I am tired.", "This is terrible, a complete disaster.", "I was hardly grateful, really.", "The weather is fine.", "I can't do this anymore.",
    "You picked apart my work with scorn.", "I asked for space and distance.", "Sure, because that makes sense.", "There's no point, it will never work.", "I feel safe when we talk it out.",
    "I am without hope and completely broken.", "Not at all, not once.", "What if I could have been kind?", "On May 4, 2020 we made up and I was shocked.", "I gave up, I sacrifice and accept.",
    "Every time I call, you let down my mother.", "I went home and he came back.", "You're overreacting, that never happened.", "I had no one to talk to.",
]


def narratives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id (customer), text, gold (a label made from the key) and dataset (the customer's market segment)."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    pick = (F.col("l_orderkey") * 131 + F.col("l_linenumber") * 17 + F.col("l_partkey")) % len(TEMPLATES) + 1
    # numbers travel, in the order of their sentences; the text is made where it stays
    ordered = sorted(TEMPLATES)
    lines = read("lineitem").select("l_orderkey", "l_linenumber", F.element_at(F.array(*(F.lit(ordered.index(s) + 1) for s in TEMPLATES)), pick.cast("int")).alias("s"))
    listed = lambda order, c: F.transform(F.sort_array(F.collect_list(F.struct(order, c))), lambda x: x[c])
    paras = lines.groupBy("l_orderkey").agg(listed("l_linenumber", "s").alias("p"))
    sentence = lambda k: F.element_at(F.array(*map(F.lit, ordered)), k)
    text = F.array_join(F.transform(listed("o_orderkey", "p"), lambda p: F.array_join(F.transform(p, sentence), " ")), "\n\n")
    orders = read("orders").select("o_orderkey", "o_custkey").join(paras, F.col("o_orderkey") == F.col("l_orderkey"))
    # what follows costs far more than its bytes suggest: keep the partitions that coalescing would join
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    docs = orders.repartition(n, "o_custkey").groupBy(F.col("o_custkey").alias("doc_id")).agg(text.alias("text"))
    who = read("customer").select(F.col("c_custkey").alias("doc_id"), F.col("c_mktsegment").alias("dataset"))
    gold = F.element_at(F.array(F.lit("pos"), F.lit("neg"), F.lit("neu")), (F.pmod(F.col("doc_id") * 7 + F.length("text"), F.lit(3)) + 1).cast("int"))
    return docs.join(who, "doc_id").withColumn("gold", gold)


def q(s: str) -> str:
    """A SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def sql_list(items) -> str:
    return "[" + ", ".join(q(x) if isinstance(x, str) else str(x) for x in items) + "]"


NARRATIVES = f"""nlines as (select l.l_orderkey as ok, l.l_linenumber as ln, o.o_custkey as doc_id,
  list_extract({sql_list(TEMPLATES)}, ((l.l_orderkey * 131 + l.l_linenumber * 17 + l.l_partkey) % {len(TEMPLATES)} + 1)::int) as s
  from lineitem l join orders o on o.o_orderkey = l.l_orderkey),
nparas as (select doc_id, ok, string_agg(s, ' ' order by ln, s) as p from nlines group by doc_id, ok),
ndocs as (select doc_id, string_agg(p, chr(10) || chr(10) order by ok) as text from nparas group by doc_id),
docs as (select doc_id, text, c_mktsegment as dataset, list_extract(['pos', 'neg', 'neu'], ((doc_id * 7 + length(text)) % 3 + 1)::int) as gold
  from ndocs join customer on c_custkey = doc_id)"""

#: A lexicon of frequent tokens of the driver's prose, with weights by rule, for queries over ``documents``.
FREQUENT = ["the", "of", "and", "a", "that", "for", "with", "this"]


def corpus_lexicon() -> Lexicon:
    rows = [Entry(w, (1.0 if k % 2 else -1.0) * (1 + len(w) % 3) / 2, 1.0 + 0.1 * (k % 3), ("joy",) if k % 2 else ("anger", "fear"), ("contempt" if k % 4 == 0 else None)) for k, w in enumerate(FREQUENT)]
    return Lexicon.of(rows, negators=("is", "was", "no"), intensifiers={"to": 1.2, "it": 1.3, "th": 1.1}, diminishers={"by": 0.7, "in": 0.8})
