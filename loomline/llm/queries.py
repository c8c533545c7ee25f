"""The registered queries of this subpackage, with their production parameters, and their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.layout import spread
from loomline.llm import ann, bpe, embed_dedup, hamerly, langid, line_rules, packing, quality_crf, secret_scan, simhash, term_tries, url_filter, warc

#: Rules of op4 (fixed by its contract).
RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def vocabulary() -> str:
    """Path of the public byte-level vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def _fold(mod: int, at: int):
    """Whether crc32 of the id as text leaves ``at``."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(mod)) == at, F.lit(False))


def quality_model(docs: DataFrame, labels: DataFrame) -> quality_crf.Model:
    return quality_crf.train(docs, labels.where(~_fold(5, 0)))


def language_model(docs: DataFrame) -> langid.Model:
    return langid.train(docs.where(~_fold(4, 2)))


def op1_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learnt from labelled rows outside the held-out fold; null and empty texts are scored as texts of no line."""
    docs = table(spark, sf_dir, "documents")
    scored = quality_crf.classify(docs, quality_model(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", _fold(5, 0).alias("held_out"), "score", "predicted", "good_share", "n_lines")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: counts by kind, and spans by the base patterns and by guess cost, with a public vocabulary as the dictionary of words; null texts are empty."""
    return secret_scan.digest(secret_scan.spans(table(spark, sf_dir, "documents"), words=secret_scan.read_words(vocabulary(), secret_scan.WORDS)))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document and their decoded text, as digests; null texts are empty."""
    return bpe.round_trip(table(spark, sf_dir, "documents"), vocabulary())


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, fitting rule and verdict of every page; null URLs have an empty host and path."""
    return url_filter.judge(table(spark, sf_dir, "pages"), RULES)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens, a row a piece; null texts are empty."""
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary())


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learnt outside the held-out fold; und for texts without a letter."""
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, language_model(docs))
    return found.select("doc_id", _fold(4, 2).alias("held_out"), "lang_pred", "score", "ambiguous")


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors found for each whose id 20 divides; invalid vectors take no part."""
    rows = table(spark, sf_dir, "embeddings")
    return ann.search(rows, rows.where(F.col("vec_id") % 20 == 0))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document; texts without words share fingerprint zero."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector by cosine; invalid vectors link with nothing."""
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives and read back: digest, record type and what a revisit refers to; null payloads are empty."""
    return warc.archive(table(spark, sf_dir, "pages")).select(F.col("page").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base rules and the verdict by cross-document line frequency, per document."""
    return line_rules.rules(table(spark, sf_dir, "documents"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances of all pairs of sources of a language, and each source's own terms."""
    return term_tries.audit(table(spark, sf_dir, "documents"))


def op13_hamerly_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster, exact distances and centroid hash, per vector."""
    return hamerly.cluster(table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of the corpus pipeline, one after the other."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_quality_crf, op2_secret_scan, op3_bpe, op4_url_filter, op5_packing, op6_language_id, op7_ann, op8_simhash, op9_embedding_dedup, op10_warc, op11_line_rules, op12_source_divergence, op13_hamerly_clusters, pipeline)}


def _op4_sql() -> str:
    esc = lambda t: t.replace("'", "''")
    # '+' in front of and behind the URL stands for its ends
    hit = lambda t: f"regexp_matches(u, '[^a-z0-9]{esc(t)}[^a-z0-9]')::int"
    plus = lambda terms: " + ".join(map(hit, terms))
    fit = lambda r: f"((host = '{r.partition('/')[0]}' or ends_with(host, '.{r.partition('/')[0]}')) and starts_with(path, '/{r.partition('/')[2]}'))"
    order = sorted(RULES, key=lambda r: -len(r[1]))
    return f"""
with p as (select page_id, url, strpos(coalesce(url, ''), '://') as k from pages),
q as (select page_id, url, case when k > 0 then substr(url, k + 3) else '' end as rest from p),
h as (select page_id, '+' || translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || '+' as u,
  translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from q),
r as (select page_id, host, path, case {' '.join(f"when {fit(x[1])} then '{x[1]}'" for x in order)} end as rule,
  cast({plus(url_filter.STRICT)} as integer) as n_strict, cast({plus(url_filter.SOFT)} as integer) as n_soft from h)
select page_id, host, path, rule, case {' '.join(f"when rule = '{x[1]}' then '{x[0]}'" for x in order)}
  when n_strict > 0 or n_soft >= {url_filter.SOFT_HITS} then 'block' else 'allow' end as verdict, n_strict, n_soft
from r"""


def _op10_sql() -> str:
    # base32 of the 40 hexadecimal digits: five digits give four letters
    letter = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(d, 5 * i + 1, 5))::bigint >> s) & 31)::int, 1)"
    return f"""
with p as (select page_id, coalesce(html, '') as html from pages),
s as (select page_id, strlen(html) as payload_bytes, sha1(html) as d from p),
m as (select d, min(page_id) as first from s group by d),
b as (select d, string_agg({letter}, '' order by i, s desc) as payload_digest
  from m, range(8) a(i), (values (15), (10), (5), (0)) v(s) group by d)
select s.page_id, s.payload_bytes::bigint as payload_bytes, b.payload_digest,
  case when s.page_id = m.first then 'response' else 'revisit' end as record_type,
  case when s.page_id <> m.first then m.first end as refers_to
from s join m on s.d = m.d join b on s.d = b.d"""


def _op9_sql() -> str:
    return """
with recursive e as (select vec_id, list_transform(embedding, lambda x: x::double) as v from embeddings),
ok as (select vec_id, v from e where v is not null and len(list_filter(v, lambda x: x is null or not isfinite(x))) = 0 and list_dot_product(v, v) > 0),
links as (select a.vec_id as a, b.vec_id as b from ok a join ok b on a.vec_id <> b.vec_id and len(a.v) = len(b.v)
  where list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)) >= 0.95),
reach(a, c) as (select vec_id, vec_id from embeddings union select reach.a, links.b from reach join links on links.a = reach.c)
select e.vec_id, (select count(*) from links l where l.a = e.vec_id) as n_links, min(r.c) as component_id, e.vec_id = min(r.c) as kept
from embeddings e join reach r on r.a = e.vec_id group by e.vec_id"""


def _op11_sql() -> str:
    # 10 documents and 0.5 % of the host's are the limits of a line; 10 words and half of all words those of a document
    word, upper, lower = "'[^\x20\x09-\x0D]+'", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "abcdefghijklmnopqrstuvwxyz0000000000"
    return f"""
with d as materialized (select row_number() over () as r, doc_id, coalesce(source, '') as host, coalesce(text, '') as t from documents),
w as materialized (select r, doc_id, host, t, regexp_extract_all(t, {word}) as ws from d),
l as (select r, host, t, unnest(string_split(t, chr(10))) as line from d),
n as materialized (select r, host, t, line, translate(array_to_string(regexp_extract_all(line, {word}), ' '), '{upper}', '{lower}') as form, len(regexp_extract_all(line, {word})) as k from l),
dup as (select r, count(*) - count(distinct line) as n_dup_lines from n where k > 0 group by r),
win as (select r, i, array_to_string(ws[i:i + 4], ' ') as five from (select r, ws, unnest(range(1, len(ws) - 3)) as i from w where len(ws) >= 5)),
twice as (select r, five from win group by r, five having count(*) > 1),
rep as (select r, count(*) as n_repeat_words from (select distinct r, unnest(range(i, i + 5)) as at from win join twice using (r, five)) group by r),
hosts as (select host, count(distinct t) as total from d group by host),
often as (select host, form from (select host, form, count(distinct t) as docs from n where k > 0 group by host, form) join hosts using (host) where docs > 10 and docs > 0.005 * total),
gone as (select r, sum(k) as n_removed from n join often using (host, form) group by r),
x as (select doc_id, len(ws) as n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) as word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as n_symbols,
  coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words, coalesce(n_removed, 0)::bigint as n_removed
  from w left join dup using (r) left join rep using (r) left join gone using (r)),
y as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from x)
select *, not base_failed and n_words - n_removed >= 10 and 2 * (n_words - n_removed) >= n_words as kept from y"""


def _op12_sql() -> str:
    p = lambda c, n: f"(1 + (1000000000::hugeint * ({c} + 5)) // ({n} + 5 * v))::bigint"
    return f"""
with d as materialized (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source,
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
w as materialized (select r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
kept as materialized (select lang, term, count(*) as c from w group by lang, term having count(distinct r) >= 30),
size as (select lang, count(*) as v, sum(c) as n from kept group by lang),
groups as materialized (select distinct lang, source from d),
here as materialized (select lang, source, term, count(*) as c from w join kept using (lang, term) group by lang, source, term),
total as (select lang, source, sum(c) as n from here group by lang, source),
g as materialized (select lang, source, coalesce(total.n, 0) as n, coalesce(v, 0) as v, coalesce(size.n, 0) as m from groups left join total using (lang, source) left join size using (lang)),
shares as materialized (select lang, source, term, coalesce(here.c, 0) as c, {p("coalesce(here.c, 0)", "g.n")} as p, {p("kept.c", "g.m")} as q
  from g join kept using (lang) left join here using (lang, source, term)),
pairs as (select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as value from shares a join shares b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
f as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0)::bigint as value
  from groups a join groups b on a.lang = b.lang and a.source <> b.source left join pairs on pairs.lang = a.lang and pairs.source = a.source and pairs.item = b.source
  union all select lang, source, 'term', term, p - q from shares where c > 0 and p > q),
o as (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from f)
select lang, source, part, item, value, rank::integer as rank from o where part = 'pair' or rank <= 50"""


def _op13_sql() -> str:
    rounds = ""
    near = lambda k: f"""
a{k} as materialized (select r, min(list_dot_product(list_transform(q, lambda x, i: (x - z[i])::double), list_transform(q, lambda x, i: (x - z[i])::double))::bigint * 40 + c) as best from k cross join c{k} group by r)"""  # noqa: E731
    for k in range(5):
        rounds += f""",{near(k)},
s{k} as (select best % 40 as c, i, sum(q[i])::hugeint as s, count(*) as n from a{k} join k using (r), range(1, 65) t(i) group by all),
m{k} as (select c, list(((s - ((s % n) + n) % n) // n)::bigint order by i) as z from s{k} group by c),
c{k + 1} as materialized (select c, coalesce(m{k}.z, c{k}.z) as z from c{k} left join m{k} using (c))"""
    return f"""
with k as materialized (select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as q from embeddings
  where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
c0 as materialized (select c, z from (select row_number() over (order by sha256('2:' || vec_id), q) - 1 as c, q as z from k) where c < 40){rounds},{near(5)},
x as (select vec_id, (best % 40)::integer as cluster, best // 40 as distance from a5 join k using (r))
select vec_id, cluster, distance, sum(distance) over (partition by cluster)::bigint as cluster_inertia, sum(distance) over ()::bigint as inertia,
  sha256(array_to_string(z, ',')) as centroid_sha256
from x join c5 on c5.c = x.cluster"""


ORACLE_SQL = {
    "op4_url_filter": _op4_sql(), "op9_embedding_dedup": _op9_sql(), "op10_warc": _op10_sql(), "op11_line_rules": _op11_sql(), "op12_source_divergence": _op12_sql(), "op13_hamerly_clusters": _op13_sql(),
}
