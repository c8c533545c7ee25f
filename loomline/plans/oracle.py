"""SQL of the registered queries, for an engine other than Spark, written from the operators' definitions."""

from __future__ import annotations

from loomline.functions import fixed
from loomline.functions import metrics as M
from loomline.functions.lexicon import starter
from loomline.operators.evaluation import CATALOG, CATALOG_COLUMNS, HYPOTHESES
from loomline.plans.narratives import NARRATIVES, corpus_lexicon, q, sql_list
from loomline.plans.sqltext import among, avg4, band, content, explode, first_max, found, has, hits, mean4, narr, occ, occs, p_of_t, paras, r, scored, seg_sents, sents, stars, toks, trim
from loomline.sources import readers as R

SQL: dict[str, str] = {}
LEX, CORPUS = starter(), corpus_lexicon()
DOCS = "docs as (select doc_id, coalesce(text, '') as text from documents)"

# --- text ---
SQL["text_units"] = f"""with {DOCS}, t as (select doc_id, {toks('text')} as t, {sents('text')} as s, {paras('text')} as p,
  list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda z: {trim('z')}), lambda z: z <> '') as lp from docs)
select doc_id, len(t)::int as n_tokens, md5(array_to_string(t, ' ')) as tokens_md5, len(s)::int as n_sents, md5(array_to_string(s, '|')) as sents_md5, len(p)::int as n_paras, len(lp)::int as n_literal from t"""

SYL = "(case when length(w) <= 3 then 1 else greatest(1, len(regexp_extract_all(regexp_replace(w, '(?:es|ed|e)$', ''), '[aeiou]+'))) end)"


def _grams(t: str, n: int) -> str:
    return f"len(list_distinct(list_transform(range(1, greatest(len({t}) - {n - 1}, 0) + 1), lambda i: array_to_string(list_slice({t}, i, i + {n - 1}), ' '))))"


SQL["lexical_units"] = f"""with {DOCS}, t as (select doc_id, text, {toks('text')} as t from docs)
select doc_id, coalesce(list_sum(list_transform(t, lambda w: {SYL})), 0)::int as n_syllables, {_grams('t', 2)}::int as n_bigrams, {_grams('t', 3)}::int as n_trigrams, len({content('t')})::int as n_content,
  len(regexp_extract_all(lower(text), '[a-z'']+'))::int as n_apostrophe_tokens, len(regexp_extract_all(lower(text), '[a-z]+'))::int as n_plain_tokens,
  len(list_filter(regexp_split_to_array(text, '\\s+'), lambda z: z <> ''))::int as n_blank_words, len(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}\\p{{M}}_]+'))::int as n_word_runs from t"""

SQL["clean_posts"] = r"""with p as (select p_partkey as id, p_type as title, p_size as score, case when p_partkey % 7 = 0 then '[removed]' when p_partkey % 11 = 0 then '' else
  'See [the ' || p_name || '](http://x.example/' || p_partkey || ') and **' || p_brand || '** now.' || chr(10) || '## Part &amp; parcel' || chr(10) || chr(10) || chr(10) || chr(10) || 'https://y.example/' || p_partkey || ' *end* &lt;b&gt; ' || p_type end as body from part),
c as (select id, score, title, body, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(body, 'http\S+', '', 'g'), '\*+([^*]+)\*+', '\1', 'g'), '#+\s*', '', 'g'), '\[([^\]]+)\]\([^)]+\)', '\1', 'g'), '&amp;', '&', 'g') as b1 from p where body not in ('[removed]', '')),
d as (select id, score, title, regexp_replace(regexp_replace(replace(replace(b1, '&lt;', '<'), '&gt;', '>'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') as b from c),
e as (select id, title || '. ' || b as text, score from d where b <> '' and score >= 5)
select id, substr(text, 1, 2000) as text, len(regexp_extract_all(text, '\w+'))::int as n_words, score from e where len(regexp_extract_all(text, '\w+')) >= 10"""


def _weak(pos, neg) -> str:
    p, n = among("w", pos), among("w", neg)
    return f"case when {p} > {n} * 1.5 then 'pos' when {n} > {p} * 1.5 then 'neg' else 'neu' end"


def _emotion(table) -> str:
    pairs = [(e, occs("lower(text)", ws)) for e, ws in table.items()]
    return f"case when greatest({', '.join(x for _, x in pairs)}) > 0 then {first_max(pairs)} else 'none' end"


SQL["weak_labels"] = narr(f"""select doc_id, {_weak(fixed.WEAK_POS, fixed.WEAK_NEG)} as sentiment, {_weak(fixed.WIDE_POS, fixed.WIDE_NEG)} as sentiment_wide, {_emotion(fixed.WEAK_EMOTIONS)} as emotion, {_emotion(fixed.WIDE_EMOTIONS)} as emotion_wide
from (select *, regexp_extract_all(lower(text), '[a-z]+') as w from docs)""")


def _vader(rel: str, key: str) -> str:
    """CTE rows (key, vader)."""
    seeds = ", ".join(f"({q(w)}, {s}::double)" for w, s in fixed.VADER_SEEDS.items())
    return f"""vt as ({explode(rel, "regexp_extract_all(lower(text), '[a-z'']+')", 'tix', 'tok', key)}),
vn as (select *, max((tok in ('not', 'never', 'no', 'neither', 'nor', 'nothing'))::int) over (partition by {key} order by tix rows between 3 preceding and 1 preceding) as neg from vt),
vs as (select {key}, sum(round(s * (case when neg = 1 then -0.74 else 1.0 end)::double * 1000)::bigint)::double / 1000.0 as t from vn join (values {seeds}) v(w, s) on w = tok group by {key}),
vader as (select {', '.join('d.' + k.strip() for k in key.split(','))}, {r('coalesce(t, 0.0) / sqrt(coalesce(t, 0.0) * coalesce(t, 0.0) + 15)')} as vader from {rel} d left join vs using ({key}))"""


def _nrc(e: str) -> str:
    return f"{among('w', [w for w, es in fixed.NRC_SEEDS.items() if e in es])} / greatest(1, len(w))::double"


def _liwc(k: str) -> str:
    return r(f"100 * {among('w', fixed.LIWC_CATEGORIES[k])} / greatest(1, len(w))::double", 2)


def _wordy(rel: str, key: str) -> str:
    nrc = r(f"{_nrc('positive')} - {_nrc('negative')}")
    return f"""words as (select {key}, regexp_extract_all(lower(text), '[a-z]+') as w from {rel}),
nrc as (select {key}, {nrc} as nrc, {', '.join(f"{r(_nrc(e))} as nrc_{e}" for e in fixed.NRC_EMOTIONS)} from words),
lrate as (select {key}, {_liwc('Positive Emotion')} as liwc_pos, {_liwc('Negative Emotion')} as liwc_neg, {_liwc('Cognitive Process')} as liwc_cog, {_liwc('Social Process')} as liwc_soc from words),
liwc as (select *, case when liwc_pos + liwc_neg > 0 then {r('(liwc_pos - liwc_neg) / greatest(1.0, liwc_pos + liwc_neg + 0.001)')} else 0.0 end as liwc from lrate)"""


LABEL = lambda x, e=0.05: f"(case when {x} > {e} then 'pos' when {x} < -{e} then 'neg' else 'neu' end)"

SQL["label_filters"] = narr(
    f"""select doc_id, ix::int as ix, vader, nrc, liwc, confident, vader = nrc and nrc = liwc as consensus from (select doc_id, ix, {LABEL('vader')} as vader, {LABEL('nrc')} as nrc, {LABEL('liwc')} as liwc,
  case when vader > 0.35 then 'pos' when vader < -0.35 then 'neg' when abs(vader) < 0.05 then 'neu' end as confident from vader join nrc using (doc_id, ix) join liwc using (doc_id, ix)) where (vader = nrc and nrc = liwc) or confident is not null""",
    f"ps as ({explode('docs', paras('text'), 'ix', 'text')})", _vader("ps", "doc_id, ix"), _wordy("ps", "doc_id, ix"),
)

SQL["substring_counts"] = f"""with {DOCS}, l as (select doc_id, lower(text) as t from docs)
select doc_id, {occ('t', 'the')}::int as n_the, {occs('t', ['en', 'on', 'anan'])}::int as n_some, {has('t', ['wh', 'zz', 'tion'])}::int as present, {hits('t', '[aeiou]{2}')}::int as pairs,
  regexp_matches(regexp_replace(t, '[^\\x00-\\x7F]', '0', 'g'), '\\bth[a-z]+ed\\b') as shape from l"""

# --- document statistics ---
STATS = f"""{DOCS}, t as (select doc_id, text, {toks('text')} as t, len({sents('text')}) as ns, len({paras('text')}) as np from docs),
f as (select doc_id, count(*) as k, count(*) filter (n = 1) as once from (select doc_id, tok, count(*) as n from (select doc_id, unnest(t) as tok from t) group by doc_id, tok) group by doc_id),
c as (select t.doc_id, text, ns::double as ns, np, greatest(1, len(t))::double as nw, coalesce(k, 0) as uniq, coalesce(once, 0) as once,
  coalesce(list_sum(list_transform(t, lambda w: {SYL})), 0) as syl, len(list_filter(t, lambda w: {SYL} >= 3)) as poly,
  length(regexp_replace(text, '\\P{{L}}', '', 'g')) as letters, length(replace(text, ' ', '')) as nospace, {content('t')} as cw, {among('t', [e.term for e in CORPUS.words])} as cov from t left join f using (doc_id)),
e as (select *, nw / ns as asl, greatest(1, syl) / nw as asw, len(list_distinct(cw)) as vocab, greatest(1, uniq) as v from c)"""
PUNCT = "length(text) - length(translate(text, " + q(fixed.PUNCTUATION) + ", ''))"
SQL["doc_stats"] = f"""with {STATS}
select doc_id, length(text)::int as n_chars, nospace::int as n_chars_nospace, letters::int as n_letters, length(regexp_replace(text, '\\P{{Nd}}', '', 'g'))::int as n_digits, ({PUNCT})::int as n_punct,
  nw::int as n_words, uniq::int as n_unique, ns::int as n_sents, np::int as n_paras, syl::int as n_syllables, len(cw)::int as n_content, vocab::int as n_vocab, once::int as n_once, {r('asl', 2)} as asl, {r('asw', 2)} as asw,
  {r('greatest(0.0, least(100.0, 206.835 - 1.015 * asl - 84.6 * asw))', 1)} as flesch_re, {r('0.39 * asl + 11.8 * asw - 15.59', 1)} as flesch_kg, {r('0.4 * (asl + 100 * (poly / nw))', 1)} as gunning_fog,
  case when ns >= 30 then {r('3 + sqrt(poly * (30 / ns))', 1)} end as smog, {r('0.0588 * (letters / nw * 100) - 0.296 * (ns / nw * 100) - 15.8', 1)} as coleman_liau, {r('4.71 * (nospace / nw) + 0.5 * asl - 21.43', 1)} as ari,
  {r('uniq / nw', 3)} as ttr, {r('vocab / nw', 3)} as lexical_density, {r('pow(nw, pow(v::double, -0.165))', 2)} as brunet_w,
  case when nw > 1 then {r('100 * ln(nw) / greatest(1e-9, 1 - once / v::double)', 1)} else 0.0 end as honore_r, nw / 200 as rt_silent, nw / 130 as rt_aloud, cov / nw as coverage,
  case when nw < 50 or cov / nw < 0.05 then 'LOW' when nw < 200 or cov / nw < 0.10 then 'MODERATE' else 'HIGH' end as confidence from e"""

SQL["sentence_lengths"] = f"""with {DOCS}, s as ({explode('docs', sents('text'), 'ix', 's')}), n as (select doc_id, ix, len(list_filter(regexp_split_to_array(s, '\\s+'), lambda z: z <> '')) as n from s)
select doc_id, {r('avg(n)')} as mean_len, {r('coalesce(stddev_samp(n), 0.0)')} as sd_len, arg_max(ix, n * 1000000 - ix)::int as longest_ix, arg_min(ix, n * 1000000 + ix)::int as shortest_ix, max(n)::int as longest, min(n)::int as shortest,
  count(*) filter (n <= 5) as b_5, count(*) filter (n between 6 and 10) as b_10, count(*) filter (n between 11 and 20) as b_20, count(*) filter (n between 21 and 30) as b_30, count(*) filter (n > 30) as b_more from n group by doc_id"""

SQL["character_shares"] = f"""with {DOCS}, x as (select *, greatest(1, length(text))::double as n from docs) select doc_id, {r("length(regexp_replace(text, '\\P{L}', '', 'g')) / n")} as letters, {r("length(regexp_replace(text, '\\P{Nd}', '', 'g')) / n")} as digits,
  {r("length(regexp_replace(text, '[^ ]', '', 'g')) / n")} as spaces, {r(f"({PUNCT}) / n")} as punctuation from x"""

TOK = f"tok as ({explode('docs', toks('text'), 'ix', 'token')})"
SQL["word_lengths"] = f"""with {DOCS}, {TOK}, c as (select doc_id, length(token)::int as length, count(*) as n from tok where strpos(token, '''') = 0 group by all)
select doc_id, length, n from (select *, row_number() over (partition by doc_id order by length) as rn from c) where rn <= 15"""
COUNTS = "cnt as (select doc_id, token, count(*) as n, min(ix) as first from tok group by doc_id, token)"
STOP = f"list_contains({sql_list(fixed.STOP_WORDS)}, token)"
SQL["hapax"] = f"""with {DOCS}, {TOK}, {COUNTS} select doc_id, count(*)::int as n, md5(string_agg(token, ' ' order by first)) as words_md5 from cnt where n = 1 and not {STOP} and length(token) > 2 group by doc_id"""

# --- sentiment ---
TAGS = "tg as (select doc_id, ix, sum(len(emo))::int as n_emotions, coalesce(string_agg(horse, ','), '') as horsemen from tags group by doc_id, ix)"
SQL["sentence_scores"] = narr("select s.doc_id, s.ix::int as sent_ix, compound, sarcasm, coalesce(n_emotions, 0)::int as n_emotions, coalesce(horsemen, '') as horsemen from sc s left join tg using (doc_id, ix)", seg_sents(), scored(LEX), "tg as (select doc_id, ix, sum(len(emo))::int as n_emotions, coalesce(string_agg(horse, ',' order by horse), '') as horsemen from tags group by doc_id, ix)")
SQL["sentence_scores_corpus"] = "with " + ",\n".join([DOCS, seg_sents(), scored(CORPUS), TAGS]) + "\nselect s.doc_id, s.ix::int as sent_ix, compound, coalesce(n_emotions, 0)::int as n_emotions from sc s left join tg using (doc_id, ix)"
SQL["sentence_scores_joined"] = SQL["sentence_scores_corpus"]
SQL["sentence_scores_joined_phrases"] = narr("select s.doc_id, s.ix::int as sent_ix, compound, coalesce(n_emotions, 0)::int as n_emotions from sc s left join tg using (doc_id, ix)", seg_sents(), scored(LEX), TAGS)
SQL["phrase_index"] = f"""with {DOCS}, {seg_sents()}, lw as (select doc_id, ix, lower(s) as s from segs), tm as (select distinct term from (select substr(lower(text), 6, 13) as term from docs union all select substr(lower(text), 40, 2) from docs) where length(term) > 0)
select term, count(*) as n_sentences, count(distinct doc_id) as n_docs from tm join lw on contains(lw.s, tm.term) group by term"""
SQL["stop_word_antijoin"] = f"with {DOCS}, {TOK} select doc_id, count(*) as n, count(distinct token) as types from tok where not {STOP} group by doc_id"
_both = "list_distinct(list_concat(a, b))"
SQL["neighbour_sentences"] = narr(
    f"select doc_id, count(*) as pairs, {r('avg(floor(case when len({0}) = 0 then 0.0 else len(list_intersect(a, b)) / len({0})::double end * 1000) / 1000)'.format(_both), 3)} as mean_jaccard from np where b is not null group by doc_id",
    seg_sents(), f"nt as (select doc_id, ix, list_distinct({toks('s')}) as a from segs)", "np as (select doc_id, a, lead(a) over (partition by doc_id order by ix) as b from nt)",
)
SQL["sentence_pairs"] = narr(
    "select a.doc_id, count(*) as pairs, count(*) filter (list_has_any(a.w, b.w)) as overlapping, count(*) filter (a.s = b.s) as equal from nt a join nt b on a.doc_id = b.doc_id and a.ix < b.ix group by a.doc_id",
    seg_sents(), f"nt as (select doc_id, ix, array_to_string(list_sort(list_distinct({toks('s')})), ' ') as s, {toks('s')} as w from segs)",
)
EMO = "em as (select doc_id, e, count(*) as n from (select doc_id, unnest(emo) as e from tags) group by doc_id, e)"
HOR = "ho as (select doc_id, horse, count(*) as n from tags where horse is not null group by doc_id, horse)"
ME = f"me as (select doc_id, {avg4('compound')} as m, count(*) as ns, count(*) filter (sarcasm) as n_sarcasm from sc group by doc_id)"
SQL["score_text"] = narr(
    f"""select doc_id, {r('m')} as mean, {band('m', *M.BANDS['sentiment'])} as band, n_sarcasm::int as n_sarcasm, ns::int as n_sents,
  coalesce((select string_agg(e || '=' || n, ',' order by e || '=' || n) from em where em.doc_id = me.doc_id), '') as emotions, coalesce((select string_agg(horse || '=' || n, ',' order by horse || '=' || n) from ho where ho.doc_id = me.doc_id), '') as horsemen from me""",
    seg_sents(), scored(LEX), EMO, HOR, ME,
)
STEP = "lg as (select doc_id, ix, abs(compound - lag(compound) over (partition by doc_id order by ix)) as d from sc)"
TEG = f"tg as (select doc_id, case when count(*) < 2 then 0.0 else {r(avg4('d'))} end as teg, count(*) as n from lg group by doc_id)"
SQL["paragraph_timeline"] = narr(f"select d.doc_id, coalesce(n, 0)::int as n_paras, coalesce(teg, 0.0) as teg, {band('coalesce(teg, 0.0)', *M.BANDS['teg'])} as band from docs d left join tg using (doc_id)", f"segs as ({explode('docs', paras('text'), 'ix', 's')})", scored(LEX), STEP, TEG)
SQL["baseline_scores"] = narr(f"select doc_id, vader, nrc, {', '.join('nrc_' + e for e in fixed.NRC_EMOTIONS)}, liwc, liwc_pos, liwc_neg, liwc_cog, liwc_soc from vader join nrc using (doc_id) join liwc using (doc_id)", _vader("docs", "doc_id"), _wordy("docs", "doc_id"))


def _bayes() -> str:
    rows, total = [], {}
    for e in LEX.words:
        c = "positive" if e.s > 0.5 else "negative" if e.s < -0.5 else "neutral"
        n = max(1, int(abs(e.s))) if c != "neutral" else 1
        rows.append((e.term, c, n))
        total[c] = total.get(c, 0) + n
    size, docs, cs = len(rows), sum(total.values()), ("positive", "negative", "neutral")
    own = lambda c: " + ".join([f"ln(greatest(1, {total[c]}) / {docs}.0)", f"n * ln(1.0 / {total[c] + size})", f"coalesce(g_{c}, 0.0)"])
    return narr(
        f"select doc_id, ix::int as ix, p_positive, p_negative, p_neutral, {first_max([(c, f'p_{c}') for c in cs])} as label from pr",
        seg_sents(), f"bt as ({explode('segs', toks('s'), 'tix', 'tok', 'doc_id, ix')})",
        f"bs as (select g.doc_id, g.ix, count(tok) filter (not list_contains({sql_list(fixed.STOP_WORDS)}, tok)) as n, {', '.join(f'sum(ln(k + 1)) filter (c = {q(c)} and not list_contains({sql_list(fixed.STOP_WORDS)}, tok)) as g_{c}' for c in cs)} from segs g left join bt using (doc_id, ix) left join (values {', '.join(f'({q(w)}, {q(c)}, {n})' for w, c, n in rows)}) l(w, c, k) on w = tok group by g.doc_id, g.ix)",
        f"sx as (select doc_id, ix, {', '.join(f'{own(c)} as {c}' for c in cs)} from bs)", "mx as (select *, greatest(positive, negative, neutral) as top from sx)",
        "ex as (select doc_id, ix, exp(positive - top) as a, exp(negative - top) as b, exp(neutral - top) as c from mx)", f"pr as (select doc_id, ix, {r('a / (a + b + c)')} as p_positive, {r('b / (a + b + c)')} as p_negative, {r('c / (a + b + c)')} as p_neutral from ex)",
    )


SQL["naive_bayes"] = _bayes()

# --- metrics ---
ATT = lambda x: {k: occs(x, v) for k, v in fixed.ATTACHMENT.items()}
_line = ATT("line")
GASE = f"""en as (select doc_id, count(*) as k, -sum(n / t * log2(n / t)) as h from (select doc_id, n::double as n, sum(n) over (partition by doc_id)::double as t from em) group by doc_id),
hs as (select doc_id, sum(n) as n from ho group by doc_id), ln as (select doc_id, array_to_string({toks('text')}, ' ') as line from docs),
gp as (select me.doc_id, m as s, case when coalesce(k, 0) > 1 then h / log2(k) else 0.0 end as h, least(1.0, ({_line['anxious']} * 1.2 + {_line['avoidant']} * 0.8) / (10 + {_line['secure']} + 1)) as a, least(1.0, coalesce(hs.n, 0) / (ns * 0.5 + 1)) as g
  from me left join en using (doc_id) left join hs using (doc_id) join ln using (doc_id)),
ga as (select doc_id, {r('greatest(-1.0, least(1.0, 0.30 * s + 0.25 * (1 - h) + 0.25 * (1 - a) + 0.20 * (1 - g)))')} as gase, {r('s')} as s, {r('h')} as h_norm, {r('a')} as a, {r('g')} as g from gp)"""
SCORED = (seg_sents(), scored(LEX), EMO, HOR, ME)
SQL["gase"] = narr(f"select doc_id, gase, s, h_norm, a, g, {band('gase', *M.BANDS['gase'])} as band from ga", *SCORED, GASE)
_parts = {"s": "0.30 * s", "h": "0.25 * (1 - h_norm)", "a": "0.25 * (1 - a)", "g": "0.20 * (1 - g)"}
_all = " + ".join(_parts.values())
SQL["gase_ablation"] = narr("select doc_id, gase, " + ", ".join(f"{r(v)} as part_{k}" for k, v in _parts.items()) + ", " + ", ".join(f"{r(f'{_all} - {v}')} as without_{k}" for k, v in _parts.items()) + " from ga", *SCORED, GASE)

PRON = {k: among("t", v) for k, v in M.PRONOUNS.items()}
PTI = r(f"({PRON['i']} - {PRON['you']}) / ({PRON['i']} + {PRON['you']} + {PRON['we']} + 1)::double")
_i, _y, _apo = among("t", ["i", "me", "my"]), among("t", ["you", "your", "yourself"]), occs("lower(text)", fixed.APOLOGY_WORDS)
PAI = r(f"least(1.0, (least(1.0, {among('t', fixed.CONTROL_VERBS)} / (greatest(1, len(t)) * 0.1 + 1)) + abs({_i} - {_y}) / greatest(1, {_i} + {_y})::double + case when {_apo} = 0 then 0.0 else least(1.0, 0.5 + {_apo} / 10.0) end) / 3)")
VADS_HITS = {k: hits("text", p, True) for k, (_, p) in fixed.DISCLOSURE_TIERS.items()}
VADS = r("least(1.0, (" + " + ".join(f"{round(10 * fixed.DISCLOSURE_TIERS[k][0])} * {v}" for k, v in VADS_HITS.items()) + ") / greatest(1, len(t))::double)")
CD = r("(" + " + ".join(r(f"least(1.0, ({' + '.join(hits('text', p, True) for p in ps)}) / greatest(1.0, len(t) / 200.0))") for ps in fixed.DISTORTIONS.values()) + f") / {len(fixed.DISTORTIONS)}")
TT = f"tt as (select *, {toks('text')} as t from docs)"
SQL["pronouns_power"] = narr(f"select doc_id, {PTI} as pti, {', '.join(f'{v}::int as n_{k}' for k, v in PRON.items())}, {PAI} as pai, {VADS} as vads, {', '.join(f'{v}::int as vads_{k.lower()}' for k, v in VADS_HITS.items())}, {CD} as cd_index from tt", TT)

ARRAYS = "ar as (select doc_id, list(compound order by ix) as c, count(*) as n from sc group by doc_id)"
NAVA = f"nv as (select doc_id, case when n >= 4 then {r(f'{mean4("list_slice(c, 1, part)")} - {mean4("list_slice(c, n - part + 1, n)")}')} end as nava from (select *, greatest(1, case when n < 9 then n // 4 else n // 3 end) as part from ar))"
ARC = "case when nava is null then 'NA' when nava > 0.15 then 'tragic' when nava < -0.15 then 'redemptive' when abs(nava) < 0.05 then 'flat' when nava > 0 then 'mildly declining' else 'mildly improving' end"
_win = "list_slice(c, greatest(i - w, 0) + 1, least(n, i + w + 1))"
LEWI = f"""lw0 as (select doc_id, c, n, greatest(1, n // 4) as w from ar where n >= 4),
lw1 as (select *, list_transform(range(0, n), lambda i: list_reduce(list_prepend(0.0::double, {_win}), lambda a, b: a + b) / len({_win})) as sm from lw0),
lw2 as (select doc_id, c, n, case when list_max(sm) - list_min(sm) < 0.01 then c else sm end as u from lw1),
lw3 as (select doc_id, c, n, list_transform(range(1, n), lambda i: u[i + 1] - u[i]) as d from lw2),
lw4 as (select doc_id, n, i, abs(d[i] - d[i + 1]) as m, d[i] * d[i + 1] < 0 as turn, abs(d[i + 1]) as steep0, c from (select *, unnest(range(0, n - 1)) as i from lw3)),
lw5 as (select doc_id, any_value(n) as n, any_value(c) as c, arg_max(i, (m, -i)) filter (turn and i >= 1 and i <= n - 3) as t, arg_max(i, (steep0, -i)) as s from lw4 group by doc_id),
lw6 as (select doc_id, n, c, coalesce(t, s) as idx from lw5),
lw as (select doc_id, idx, {r(mean4('list_slice(c, 1, idx)'))} as pre, {r(mean4('list_slice(c, idx + 1, n)'))} as post from lw6)"""
ARCS = f"select ar.doc_id, teg, nava, {{}}lw.idx::int as lewi_idx, {{}}{r('pre - post')} as drop from ar join tg using (doc_id) join nv using (doc_id) left join lw using (doc_id)"
SQL["arcs"] = narr(ARCS.format(f"{ARC} as arc, ", "pre, post, "), seg_sents(), scored(LEX), STEP, TEG, ARRAYS, NAVA, LEWI)
SQL["arcs_corpus"] = "with " + ",\n".join([DOCS, seg_sents(), scored(CORPUS), STEP, TEG, ARRAYS, NAVA, LEWI]) + "\n" + ARCS.format("", "")


def _rci(rel: str, key: str) -> str:
    """CTEs that end in rc(key, rci)."""
    return f"""rs0 as (select {key}, {paras('text')} as p, list_filter({sents('text')}, lambda z: length(z) > 15) as s, text from {rel}),
rs1 as (select {key}, case when len(p) >= 2 then p when len(s) >= 2 then s else list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda z: {trim('z')}), lambda z: length(z) > 10) end as l from rs0),
rs2 as (select {key}, generate_subscripts(l, 1) as i, unnest(l) as g from rs1),
rs3 as (select {key}, i, list_distinct({content(toks('g'))}) as w from rs2),
rs4 as (select {key}, i, len(w) as k, unnest(w) as t from rs3),
rs5 as (select {', '.join('a.' + k.strip() for k in key.split(','))}, a.i, b.i as j, count(*) as shared, any_value(a.k) as ka, any_value(b.k) as kb from rs4 a join rs4 b on {' and '.join(f'a.{k.strip()} = b.{k.strip()}' for k in key.split(','))} and a.t = b.t and a.i < b.i group by all),
rs6 as (select {key}, sum(shared / (ka + kb - shared)::double) as t from rs5 group by all),
rc as (select {', '.join('x.' + k.strip() for k in key.split(','))}, case when len(l) < 2 then 0.0 else {r('coalesce(t, 0.0) / (len(l) * (len(l) - 1) // 2)')} end as rci from rs1 x left join rs6 using ({key}))"""


SQL["rci"] = narr("select kind, doc_id, rci from rc", "ud as (select 'n' as kind, doc_id, text from docs union all select 'd', doc_id, text from documents)", _rci("ud", "kind, doc_id"))


def _ties() -> str:
    own = " + ".join(f"({found('s', a, True)} and {found('s', b, True)})::int" for a, b in fixed.ABSOLUTE_PAIRS)
    cross = " + ".join(f"(({found('s', a, True)} and {found('nx', b, True)}) or ({found('s', b, True)} and {found('nx', a, True)}))::int" for a, b in fixed.ABSOLUTE_PAIRS)
    counts = "[" + ", ".join(f"({hits('text', a, True)} + {hits('text', b, True)})::double" for a, b in fixed.ABSOLUTE_PAIRS) + "]"
    return f"""ts0 as (select doc_id, text, list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda z: {trim('z')}), lambda z: z <> '') as p, list_filter({sents('text')}, lambda z: length(z) > 8) as s from docs),
ts1 as (select doc_id, case when len(p) >= 2 then p when len(s) >= 2 then s when len(p) > 0 then p else [text] end as l from ts0),
ts2 as (select doc_id, generate_subscripts(l, 1) as i, unnest(l) as s from ts1), ts3 as (select *, lead(s) over (partition by doc_id order by i) as nx from ts2),
ts4 as (select doc_id, sum({own} + case when nx is null then 0 else {cross} end) / count(*)::double as density from ts3 group by doc_id),
ts5 as (select doc_id, list_filter({counts}, lambda z: z > 0) as k from docs), ts6 as (select doc_id, case when len(k) = 0 then 0.0 else list_sum(list_transform(k, lambda z: -z / list_sum(k) * log2(z / list_sum(k)))) end as h from ts5),
ti as (select doc_id, {r('h * density')} as ties from ts4 join ts6 using (doc_id))"""


SQL["ties"] = narr("select doc_id, ties from ti", _ties())
_rum = "(" + " + ".join(f"{found('lower(text)', p)}::int" for p in fixed.RUMINATION_MARKERS) + ")"
SQL["rumination"] = narr(
    f"select doc_id, {r('hits / greatest(1, nt)::double * (1 + rep) * 1000', 3)} as ri, hits::int as hits, rep::int as repeats from y",
    f"x as (select doc_id, {_rum} as hits, len({toks('text')}) as nt, list_transform({paras('text')}, lambda z: {toks('z')}) as b from docs)",
    f"y as (select doc_id, hits, nt, ({' + '.join(f'(len(list_filter(b, lambda z: list_contains(z, {q(t)}))) > len(b) / 2.0)::int' for t in fixed.RUMINATION_THEMES)}) as rep from x)",
)
_name = lambda k: "".join(c if c.isascii() and c.isalnum() else "_" for c in k.lower())
_rasp = {k: r(f"least(1.0, {has('lower(text)', s)} / {len(s) * 0.4}::double)") for k, s in fixed.ARCHETYPES.items()}
SQL["archetypes"] = narr(f"select doc_id, {', '.join(_name(k) for k in _rasp)}, {first_max([(k, _name(k)) for k in _rasp])} as dominant from (select doc_id, {', '.join(f'{v} as {_name(k)}' for k, v in _rasp.items())} from docs)")
SQL["word_migration"] = narr(
    f"select doc_id, word, {r('m1')} as first_mean, {r('m2')} as second_mean, {r('m2 - m1')} as delta, c1, c2 from g where m1 is not null and m2 is not null",
    seg_sents(), scored(LEX), "hf as (select doc_id, ix, s, compound, ix < greatest(1, count(*) over (partition by doc_id) // 2) as early from sc)",
    f"g as (select doc_id, word, {avg4('compound', 'early')} as m1, {avg4('compound', 'not early')} as m2, count(*) filter (early) as c1, count(*) filter (not early) as c2 from hf join (select unnest({sql_list(fixed.KEY_RELATIONSHIP_WORDS)}) as word) on regexp_matches(s, '(?i)\\b' || word || '\\b') group by doc_id, word)",
)


def _proxy(m: str) -> str:
    p, n = fixed.CONSTRUCT_PROXIES[m]
    return r(f"({among('t', p)} - {among('t', n) if n else 0}) / greatest(1, len(t))::double", 6)


SQL["coherence_proxies"] = narr(
    f"select doc_id, coherence, {', '.join(f'{_proxy(m)} as proxy_{m}' for m in fixed.CONSTRUCT_PROXIES)} from tt left join co using (doc_id)", TT, seg_sents(), f"cs as (select doc_id, ix, list_distinct({content(toks('s'))}) as w from segs)",
    "cp as (select doc_id, w as a, lead(w) over (partition by doc_id order by ix) as b from cs)",
    f"co as (select doc_id, case when count(*) >= 3 then {r('avg(case when b is null then null when len(list_distinct(list_concat(a, b))) = 0 then 0.0 else len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))::double end)')} end as coherence from cp group by doc_id)",
)


def _wide(rel_ctes: list[str], lex, keep: str) -> str:
    styles = first_max(list(ATT("lower(text)").items()))
    emo = ", ".join(f"coalesce((select n from em where em.doc_id = d.doc_id and e = '{e}'), 0)::int as emo_{e}" for e in ("anger", "sadness", "fear", "joy", "trust", "disgust", "surprise", "anticipation"))
    hor = ", ".join(f"coalesce((select n from ho where ho.doc_id = d.doc_id and horse = '{h}'), 0)::int as {h}" for h in fixed.HORSEMAN_WEIGHTS)
    syl = f"greatest(1, coalesce(list_sum(list_transform(t, lambda w: {SYL})), 0))"
    fre = r(f"greatest(0.0, least(100.0, 206.835 - 1.015 * (greatest(1, len(t))::double / ns::double) - 84.6 * ({syl} / greatest(1, len(t))::double)))", 1)
    body = f"""select d.doc_id, {keep} greatest(1, len(t))::int as n_words, ns::int as n_sents, {fre} as flesch_re, ga.s as sentiment, gase, {PTI} as pti, teg, rci, {PAI} as pai, nava, {ARC} as nava_arc, lw.idx::int as lewi_idx, {r('pre - post')} as lewi_drop,
  {CD} as cd_index, {VADS} as vads, ties, {styles} as attachment, coalesce(hs.n, 0)::int as horsemen_total, {hor}, vader as vader_score, nrc as nrc_score, liwc as liwc_score, {emo}
from tt d join me using (doc_id) join ga using (doc_id) join tg using (doc_id) join rc using (doc_id) join nv using (doc_id) left join lw using (doc_id) join ti using (doc_id) left join hs using (doc_id) join vader using (doc_id) join nrc using (doc_id) join liwc using (doc_id)"""
    parts = [*rel_ctes, seg_sents(), scored(lex), EMO, HOR, ME, GASE, STEP, TEG, ARRAYS, NAVA, LEWI, _rci("docs", "doc_id"), _ties(), _vader("docs", "doc_id"), _wordy("docs", "doc_id"), TT]
    return "with " + ",\n".join(parts) + "\n" + body


SQL["doc_metrics"] = _wide([NARRATIVES], LEX, "dataset, gold,")
SQL["doc_metrics_corpus"] = _wide([f"docs as (select doc_id, {trim('text')} as text from documents where {trim('coalesce(text, chr(32))')} <> '')"], CORPUS, "")

# --- extractors ---
_att = ATT("lower(text)")
SQL["attachment"] = narr(f"select doc_id, {', '.join(f'{k}::int as {k}' for k in _att)}, {', '.join(r(f'{k} / greatest(1, {" + ".join(_att)})::double * 100', 1) + f' as pct_{k}' for k in _att)}, {first_max([(k, k) for k in _att])} as dominant from (select doc_id, {', '.join(f'{v} as {k}' for k, v in _att.items())} from docs)")
_hp = {h: " + ".join(hits("lower(text)", p) for p in ps) for h, ps in fixed.HORSEMAN_PATTERNS.items()}
SQL["gottman"] = narr(
    f"select doc_id, {', '.join(f'{h}::int as {h}' for h in _hp)}, {r('(' + ' + '.join(f'{fixed.HORSEMAN_WEIGHTS[h]} * {h}' for h in _hp) + ') / ns::double')} as load from gx",
    *SCORED, f"gx as (select doc_id, ns, {', '.join(f'(coalesce((select n from ho where ho.doc_id = d.doc_id and horse = {q(h)}), 0) + {v}) as {h}' for h, v in _hp.items())} from docs d join me using (doc_id))",
)


def _phases(markers) -> str:
    one = " union all ".join(f"select doc_id, {q(k)} as phase, i as para, {has('lower(g)', ms)} as n_markers from pp" for k, ms in markers.items())
    return narr("select doc_id, phase, para::int as para, n_markers::int as n_markers from ph where n_markers > 0", f"pp as (select doc_id, generate_subscripts(l, 1) as i, unnest(l) as g from (select doc_id, {paras('text')} as l from docs))", f"ph as ({one})")


SQL["phases"], SQL["trauma_themes"] = _phases(fixed.PHASE_MARKERS), _phases(fixed.TRAUMA_THEMES)
_rank = "case phase " + " ".join(f"when {q(k)} then {i}" for i, k in enumerate(fixed.PHASE_MARKERS)) + " end"
SQL["dissolution"] = "with ph as (" + SQL["phases"] + "),\n" + NARRATIVES + f""",
g as (select doc_id, arg_max(phase, {_rank}) as phase from ph group by doc_id)
select d.doc_id, coalesce(g.phase, 'unknown') as phase, coalesce((select max(para) from ph where ph.doc_id = d.doc_id and ph.phase = g.phase), 0)::int as para from docs d left join g using (doc_id)"""
_any = lambda ps: "|".join(f"(?:{p})" for p in ps)
_ev = lambda k: f"array_to_string(list_transform(list_slice(list(s order by ix) filter ({k}), 1, 5), lambda z: substr(z, 1, 80)), '|')"
SQL["blame"] = narr(
    f"select doc_id, o::int as own, t::int as other, {r('o / greatest(1, o + t)::double * 100', 1)} as own_pct, {r('t / greatest(1, o + t)::double * 100', 1)} as other_pct, coalesce(oe, '') as own_evidence, coalesce(te, '') as other_evidence, case when o + t = 0 then null when {r('o / (o + t)::double * 100', 1)} > 70 then 'self' when {r('t / (o + t)::double * 100', 1)} > 70 then 'other' else 'balanced' end as band from bg",
    seg_sents(), f"bf as (select doc_id, ix, s, {found('lower(s)', _any(fixed.SELF_BLAME_PATTERNS))} as a, {found('lower(s)', _any(fixed.OTHER_BLAME_PATTERNS))} as b from segs)", f"bg as (select doc_id, count(*) filter (a) as o, count(*) filter (b) as t, {_ev('a')} as oe, {_ev('b')} as te from bf group by doc_id)",
)
_ex = {k.lower().replace(" ", "_"): has("lower(text)", v) for k, v in fixed.EXIT_SIGNALS.items()}
SQL["exit_signals"] = narr(f"select *, {band('total', *M.BANDS['exit'])} as band from (select doc_id, {', '.join(f'{v}::int as {k}' for k, v in _ex.items())}, ({' + '.join(_ex.values())})::int as total from docs)")
_top = "array_to_string(list_slice(list_filter([" + ", ".join(f"case when {among('t', [w])} > 0 then '{w}=' || {among('t', [w])} end" for w in fixed.CONTROL_VERBS) + "], lambda z: z is not null), 1, 5), ',')"
SQL["power_dynamics"] = narr(f"select doc_id, {among('t', fixed.CONTROL_VERBS)}::int as control, {among('t', fixed.SACRIFICE_VERBS)}::int as sacrifice, {among('t', fixed.INITIATE_VERBS)}::int as initiation, {_apo}::int as apology, {among('t', ['i', 'me', 'my'])}::int as i, {among('t', ['you', 'your'])}::int as you, {among('t', ['we', 'us', 'our'])}::int as we, {_top} as control_top, case when i > 2 * you then 'self' when you > 2 * i then 'other' when we > i then 'partnership' else 'none' end as band from tt", TT)
SQL["entities"] = narr(
    f"select doc_id, array_to_string(list_slice(regexp_extract_all(text, {q(M.DATES.replace('(?:', '(?:'))}, 1), 1, 10), '|') as dates, {', '.join(f'{occ("lower(text)", x)}::int as role_{x}' for x in fixed.ROLES)}, coalesce(names, '') as names from docs left join nt using (doc_id)",
    "nm as (" + explode("docs", "regexp_extract_all(text, '\\b([A-Z][a-z]{2,})\\b', 1)", "ix", "name") + ")", f"nc as (select doc_id, name, count(*) as n, min(ix) as first from nm where not list_contains({sql_list(fixed.COMMON_CAPS)}, name) group by doc_id, name)",
    "nr as (select *, row_number() over (partition by doc_id order by n desc, first) as rn from nc)", "nt as (select doc_id, string_agg(name || '=' || n, ',' order by rn) filter (rn <= 10) as names from nr group by doc_id)",
)
_ten = {"past": fixed.PAST_MARKERS, "present": fixed.PRESENT_MARKERS, "future": fixed.FUTURE_MARKERS}
_share = lambda k: r(f"{k} / greatest(1, past + present + future)::double * 100", 1)
SQL["tense"] = narr(
    "select doc_id, past, present, future, case when past >= present and past >= future then 'past' when present >= future then 'present' else 'future' end as dominant from td",
    f"ta as (select doc_id, lower(g) as g from ({explode('docs', paras('text'), 'i', 'g')}))", f"tb as (select doc_id, {', '.join(f'{hits("g", p)} as {k}' for k, p in _ten.items())} from ta)", f"tc as (select doc_id, {', '.join(f'{_share(k)} as {k}' for k in _ten)} from tb)",
    f"td as (select doc_id, {', '.join(f'{r(avg4(k, places=1), 1)} as {k}' for k in _ten)} from tc group by doc_id)",
)
_fl = lambda k: k.lower().replace(" & ", "_").replace(" ", "_")
SQL["red_flags"] = narr(f"select doc_id, {', '.join(f'({" + ".join(hits("lower(text)", p) for p in ps)})::int as {_fl(k)}' for k, ps in fixed.RED_FLAGS.items())} from docs")
SQL["rules_fired"] = narr("select doc_id, array_to_string(list_filter([" + ", ".join(f"case when {found('lower(text)', p)} then '{k}' end" for k, p in enumerate(fixed.RULE_PATTERNS, 1)) + "], lambda z: z is not null), ',') as rules from docs")
_fm = {"short": "nw < 100", "low_coverage": "cov / nw::double < 0.08", "sarcasm": "n_sarcasm > 0", "negation_scope": r"regexp_matches(lower(text), '\b(no[nt]|never|nobody|nothing)\b.*\b(love|happy|good|trust)\b')", "few_paragraphs": "np < 3", "non_ascii": "regexp_matches(text, '[^\\x00-\\x7F]')"}
_sev = {"high": ("short", "low_coverage"), "medium": ("sarcasm", "negation_scope"), "low": ("few_paragraphs", "non_ascii")}
SQL["failure_modes"] = narr(
    "select doc_id, array_to_string(list_filter([" + ", ".join(f"case when {v} then '{k}' end" for k, v in _fm.items()) + "], lambda z: z is not null), ',') as modes, case " + " ".join(f"when {' or '.join(_fm[k] for k in ks)} then '{v}'" for v, ks in _sev.items()) + " else 'none' end as worst from fx",
    *SCORED, TT, f"fx as (select doc_id, text, greatest(1, len(t)) as nw, {among('t', [e.term for e in LEX.words])} as cov, n_sarcasm, len({paras('text')}) as np from tt join me using (doc_id))",
)
SQL["bands"] = "with v as (select o_orderkey, (o_orderkey * 37 % 2001) / 1000.0 - 1.0 as v from orders) select o_orderkey, " + ", ".join(f"{band('v', *b)} as {k}" for k, b in M.BANDS.items()) + " from v"

# --- frequency ---
_pool = lambda k: f"pool as (select * from (select *, row_number() over (partition by doc_id order by n desc, first) as r0 from cnt) where r0 <= {k})"
_ranked = "select doc_id, rank::int as rank, token, n from (select *, row_number() over (partition by doc_id order by n desc, first) as rank from pool where {}) where rank <= 20"
SQL["top_words"] = f"with {DOCS}, {TOK}, {COUNTS}, {_pool(40)} " + _ranked.format(f"not {STOP} and length(token) >= 2")
SQL["keywords"] = f"with {DOCS}, {TOK}, {COUNTS}, {_pool(60)} " + _ranked.format(f"not {STOP} and length(token) >= 3 and strpos(token, '''') = 0")


def _gram(n: int) -> str:
    return narr(
        "select doc_id, rank::int as rank, gram, n from (select *, row_number() over (partition by doc_id order by n desc, first) as rank from gc) where rank <= 15", f"gw as (select doc_id, {content(toks('text'))} as w from docs)",
        f"gg as (select doc_id, i, array_to_string(list_slice(w, i, i + {n - 1}), ' ') as gram from (select doc_id, w, unnest(range(1, greatest(len(w) - {n - 2}, 1))) as i from gw))", "gc as (select doc_id, gram, count(*) as n, min(i) as first from gg group by doc_id, gram)",
    )


SQL["top_bigrams"], SQL["top_trigrams"] = _gram(2), _gram(3)
SQL["pmi"] = f"""with {DOCS}, w as (select doc_id, {content(toks('text'), 1)} as w from docs), u as (select doc_id, generate_subscripts(w, 1) as i, unnest(w) as a, len(w)::double as t from w where len(w) >= 5),
c as (select doc_id, a, count(*) as k from u group by doc_id, a), p as (select doc_id, i, a, t, lead(a) over (partition by doc_id order by i) as b from u),
b as (select doc_id, a, b, any_value(t) as t, count(*) as n, min(i) as first from p where b is not null group by doc_id, a, b having count(*) >= 2),
x as (select b.doc_id, b.a || ' ' || b.b as pair, b.n, b.first, log2((b.n / t) / ((ca.k / t) * (cb.k / t))) as pmi from b join c ca on ca.doc_id = b.doc_id and ca.a = b.a join c cb on cb.doc_id = b.doc_id and cb.a = b.b)
select doc_id, rank::int as rank, pair, {r('pmi', 6)} as pmi, n from (select *, row_number() over (partition by doc_id order by {r('pmi', 9)} desc, first) as rank from x where pmi > 0) where rank <= 20"""
SQL["chi_square_words"] = narr(
    f"""select dataset, side, rank::int as rank, token, {r('chi2')} as chi2, a, b from (select *, row_number() over (partition by dataset, side order by {r('chi2', 6)} desc, token) as rank from cz where chi2 > 3.84) where rank <= 15""",
    seg_sents(), scored(LEX), f"ct as (select dataset, compound > 0 as pos, unnest({toks('s')}) as token from sc join docs using (doc_id) where abs(compound) > 0.05)",
    f"cn as (select dataset, token, count(*) filter (pos) as a, count(*) filter (not pos) as b from ct where not {STOP} and length(token) > 2 group by dataset, token)", "cm as (select *, sum(a) over (partition by dataset)::double as np, sum(b) over (partition by dataset)::double as nn from cn)",
    "cz as (select dataset, token, a, b, (np + nn) * pow(a * (nn - b) - b * (np - a), 2) / nullif((a + b) * (np - a + nn - b) * np * nn, 0) as chi2, case when b = 0 or (a / (np + 1)) / (b / (nn + 1)) > 1 then 'pos' else 'neg' end as side from cm where np > 0 and nn > 0)",
)
TFIDF = f"""tl as (select doc_id, count(*) over (partition by doc_id) as total, ix, {toks('s')} as w from segs), tx as (select doc_id, total, ix, greatest(1, len(w)) as len, unnest(w) as token from tl),
tf as (select doc_id, total, ix, len, token, count(*) as n from tx where not {STOP} and length(token) > 2 group by all), td as (select doc_id, total, token, count(*) as df from tf group by all),
ti0 as (select *, row_number() over (partition by doc_id order by df desc, token) as rn from td), tv as (select tf.doc_id, tf.ix, tf.token, tf.n / tf.len::double * ln(tf.total / ti0.df::double) as value from tf join ti0 on ti0.doc_id = tf.doc_id and ti0.token = tf.token where rn <= 500 and tf.total > df)"""
SQL["tf_idf"] = narr(f"select doc_id, ix::int as sent_ix, count(*) as n_terms, {r('sum(value)', 6)} as total, {r('max(value)', 6)} as top from tv group by doc_id, ix", seg_sents(), TFIDF)
SQL["sentence_similarity"] = narr(
    "select doc_id, count(*) as pairs, sum(round(cosine * 10000)::bigint)::bigint as total, max(cosine) as top from cs group by doc_id", seg_sents(), TFIDF, "nn as (select doc_id, ix, sqrt(sum(value * value)) as n from tv group by doc_id, ix)",
    f"cs as (select a.doc_id, a.ix as i, b.ix as j, {r('sum(a.value * b.value) / max(x.n * y.n)')} as cosine from tv a join tv b on a.doc_id = b.doc_id and a.token = b.token and a.ix < b.ix join nn x on x.doc_id = a.doc_id and x.ix = a.ix join nn y on y.doc_id = b.doc_id and y.ix = b.ix group by a.doc_id, a.ix, b.ix)",
)
SQL["extreme_pairs"] = narr(
    f"""select doc_id, n::int as n, {r('total / (n * (n - 1) // 2)::double / 10000')} as coherence, hi.v / 10000.0 as most, hi.i::int as most_i, hi.j::int as most_j, lo.v / 10000.0 as least, -lo.i::int as least_i, -lo.j::int as least_j
  from (select doc_id, any_value(n) as n, sum(c) as total, max({{'v': c, 'i': i, 'j': j}}) as hi, max({{'w': -c, 'i': -i, 'j': -j, 'v': c}}) as lo from pr group by doc_id)""",
    seg_sents(), TFIDF, "nn as (select doc_id, ix, sqrt(sum(value * value)) as n from tv group by doc_id, ix)", "ct as (select doc_id, count(*) as n from segs group by doc_id)",
    "cs as (select a.doc_id, a.ix as i, b.ix as j, floor(sum(a.value * b.value) / max(x.n * y.n) * 10000 + 0.5)::bigint as c from tv a join tv b on a.doc_id = b.doc_id and a.token = b.token and a.ix < b.ix join nn x on x.doc_id = a.doc_id and x.ix = a.ix join nn y on y.doc_id = b.doc_id and y.ix = b.ix group by a.doc_id, a.ix, b.ix)",
    "pr as (select s.doc_id, n, s.ix as i, t.ix as j, coalesce(c, 0) as c from segs s join segs t on t.doc_id = s.doc_id and s.ix < t.ix join ct on ct.doc_id = s.doc_id left join cs on cs.doc_id = s.doc_id and cs.i = s.ix and cs.j = t.ix)",
)
SQL["embedding_cosine"] = f"""with e as (select vec_id, list_transform(embedding, lambda x: x::double) as v from embeddings)
select a.vec_id, {r('list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v)))')} as cosine from e a join e b on b.vec_id = a.vec_id + 1"""
_vocab = lambda lang: f"select distinct unnest({content(toks('text'))}) as word from documents where lang = '{lang}'"
SQL["vocabulary_overlap"] = f"""with l as ({_vocab('en')}), r as ({_vocab('fr')}), b as (select coalesce(l.word, r.word) as word, case when l.word is not null and r.word is not null then 'shared' when l.word is not null then 'left' else 'right' end as side from l full join r on l.word = r.word)
select side, count(*) as n, min(word) as first_word from b group by side"""
SQL["corpus_union"] = """select origin, lang, role, count(*) as n, sum(length(text))::bigint as chars from (select 'documents' as origin, lang, null::varchar as role, text from documents union all select 'conversations', null, role, text from conversations) group by origin, lang, role"""
SQL["capped_rows"] = "select source, doc_id from (select source, doc_id, row_number() over (partition by source order by doc_id) as rn from documents) where rn <= 5"

# --- statistics ---
# the mean of the two middle values, as they stand
MEDIAN = "(list_sort(list(v))[(count(*) + 1) // 2] + list_sort(list(v))[count(*) // 2 + 1]) / 2.0"
ORD = f"""od as (select o_orderkey, o_custkey, o_orderpriority as dataset, o_totalprice as price, qty, n_lines, {r('disc', 2)} as disc from orders join (select l_orderkey as o_orderkey, sum(l_quantity) as qty, count(*) as n_lines, sum(l_discount) as disc from lineitem group by 1) using (o_orderkey))"""


_desc = " union all ".join(f"select dataset, '{m}' as metric, {m}::double as v from od" for m in ("price", "qty", "n_lines", "disc"))
SQL["describe"] = f"""with {ORD}, l as ({_desc}) select dataset, metric, {r(r('avg(v)'), 2)} as mean, {r(r('coalesce(stddev_samp(v), 0.0)'), 2)} as sd, {r(MEDIAN)} as median, min(v) as min, max(v) as max, count(*) as n from l where v is not null group by dataset, metric"""
SCO = f"""sd as (select d.doc_id, lang, case when toxic = 1 then 'neg' when quality = 1 and d.doc_id % 3 > 0 then 'pos' else 'neu' end as gold, {r('length(text) % 201 / 100.0 - 1.0', 2)} as s1, {r('(d.doc_id * 7919 + length(text) * 31) % 101 / 50.0 - 1.0', 2)} as s2 from labels join documents d using (doc_id))"""
PRED = f"pd as (select *, {LABEL('s1')} as pred, {LABEL('s2')} as pred2 from sd)"
SQL["confusion"] = f"with {SCO}, {PRED} select lang, gold, pred, count(*) as n from pd group by lang, gold, pred"
SQL["confusion_matrix"] = f"with {SCO}, {PRED} select gold, count(*) filter (pred = 'pos') as pred_pos, count(*) filter (pred = 'neg') as pred_neg, count(*) filter (pred = 'neu') as pred_neu from pd group by gold"


def _prf(rel: str, keys: str, only_macro: bool = False) -> str:
    cs = ("pos", "neg", "neu")
    cnt = ", ".join(f"count(*) filter (gold = '{c}' and pred = '{c}')::double as tp_{c}, count(*) filter (gold = '{c}') as g_{c}, count(*) filter (pred = '{c}') as q_{c}" for c in cs)
    z = lambda a, b: f"coalesce({a} / nullif({b}, 0), 0.0)"
    f1 = {c: z(f"2 * tp_{c}", f"g_{c} + q_{c}") for c in cs}
    each = ", ".join(f"{r(z(f'tp_{c}', f'q_{c}'), 3)} as p_{c}, {r(z(f'tp_{c}', f'g_{c}'), 3)} as r_{c}, {r(f1[c], 3)} as f1_{c}" for c in cs)
    return f"select {keys}, {'' if only_macro else 'n, ' + each + ', '}{r('(' + ' + '.join(f1.values()) + ') / 3', 3)} as macro_f1, {r('ok / n::double', 3)} as accuracy from (select {keys}, count(*) as n, count(*) filter (gold = pred) as ok, {cnt} from {rel} group by {keys})"


SQL["precision_recall"] = f"with {SCO}, {PRED} " + _prf("pd", "lang")
SQL["roc_curve"] = f"""with {SCO}, c as (select lang, s1 as v, count(*) filter (gold = 'pos') as p, count(*) filter (gold <> 'pos') as q from sd group by lang, s1)
select lang, v as threshold, {r('coalesce(sum(q) over (partition by lang order by v desc) / nullif(sum(q) over (partition by lang), 0)::double, 0.0)', 6)} as fpr, {r('coalesce(sum(p) over (partition by lang order by v desc) / nullif(sum(p) over (partition by lang), 0)::double, 0.0)', 6)} as tpr from c"""


def _auc(rel: str, keys: str, score: str, positive: str) -> str:
    """Area by comparing every positive with the counts of negatives below and level, from ranks of all rows."""
    rk = f"select {keys}, ({positive}) as pos, rank() over (partition by {keys} order by {score}) + (count(*) over (partition by {keys}, {score}) - 1) / 2.0 as rk from {rel}"
    return f"select {keys}, count(*) filter (pos) as n_pos, count(*) filter (not pos) as n_neg, {r('coalesce((sum(rk) filter (pos) - count(*) filter (pos) * (count(*) filter (pos) + 1) / 2.0) / nullif(count(*) filter (pos) * count(*) filter (not pos), 0)::double, 0.5)')} as auc from ({rk}) group by {keys}"


SQL["auc"] = f"with {SCO} " + _auc("sd", "lang", "s2", "gold = 'pos'")


def _multi(rel: str, keys: str, score: str) -> str:
    return f"""ml as (select {keys}, 'pos' as class, {score} + 0.0 as s, gold = 'pos' as hit from {rel} union all select {keys}, 'neg', -{score} + 0.0, gold = 'neg' from {rel} union all select {keys}, 'neu', -abs({score}) + 0.0, gold = 'neu' from {rel}),
ma as ({_auc('ml', keys + ', class', 's', 'hit')}), mm as (select {keys}, max(auc) filter (class = 'pos') as auc_pos, max(auc) filter (class = 'neg') as auc_neg, max(auc) filter (class = 'neu') as auc_neu, {r('avg(auc)')} as macro_auc from ma group by {keys})"""


SQL["multiclass_auc"] = f"with {SCO}, {_multi('sd', 'lang', 's1')} select * from mm"


def _pearson(rel: str, keys: str, x: str, y: str) -> str:
    """r, p, sig, n by two passes over centred values."""
    on = " and ".join(f"a.{k.strip()} = b.{k.strip()}" for k in keys.split(","))
    return f"""select {keys}, r, p, {stars('p')} as sig, n from (select *, (case when n < 3 or not ok then 1.0 else {p_of_t('r0 * sqrt(greatest(n - 2, 0)) / sqrt(greatest(1e-9, 1 - r0 * r0))', '(n - 2)')} end)::double as p, {r('r0')} as r from (
  select *, case when n < 3 or not ok then 0.0 else greatest(-1.0, least(1.0, sxy / (sqrt(sxx) * sqrt(syy)))) end as r0 from (select *, sqrt(sxx / n) * sqrt(syy / n) > 1e-15 as ok from (
  select {', '.join('a.' + k.strip() for k in keys.split(','))}, count(*) as n, sum((a.x - mx) * (a.y - my)) as sxy, sum(pow(a.x - mx, 2)) as sxx, sum(pow(a.y - my, 2)) as syy
  from (select {keys}, {x}::double as x, {y}::double as y from {rel} where {x} is not null and {y} is not null) a join (select {keys}, avg({x}) as mx, avg({y}) as my from {rel} where {x} is not null and {y} is not null group by {keys}) b on {on} group by {', '.join('a.' + k.strip() for k in keys.split(','))}))))"""


SQL["pearson"] = f"with {ORD} " + _pearson("od", "dataset", "price", "qty")


def _spear(rel: str, keys: str, x: str, y: str) -> str:
    rank = lambda c: f"rank() over (partition by {keys} order by {c}) + (count(*) over (partition by {keys}, {c}) - 1) / 2.0"
    return f"(select {keys}, {rank(x)} as rx, {rank(y)} as ry from {rel} where {x} is not null and {y} is not null)"


SQL["spearman"] = f"with {ORD}, rk as {_spear('od', 'dataset', 'disc', 'qty')}, o as ({_pearson('rk', 'dataset', 'rx', 'ry')}) select dataset, r as rho, p, sig, n from o"
SQL["effect_size"] = f"""with {ORD}, g as (select dataset, count(*) filter (n_lines > 3) as n1, count(*) filter (n_lines <= 3) as n2, avg(price) filter (n_lines > 3) as m1, avg(price) filter (n_lines <= 3) as m2, var_samp(price) filter (n_lines > 3) as v1, var_samp(price) filter (n_lines <= 3) as v2 from od group by dataset),
d as (select *, case when n1 < 2 or n2 < 2 then 0.0 else coalesce((m1 - m2) / nullif(sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)), 0), 0.0) end as d from g)
select dataset, n1, n2, {r('d')} as cohens_d, {r('d * (1 - 3 / (4 * (n1 + n2) - 9)::double)')} as hedges_g, case when abs(d) >= 0.8 then 'large' when abs(d) >= 0.5 then 'medium' when abs(d) >= 0.2 then 'small' else 'negligible' end as size from d"""
SQL["wilcoxon"] = f"""with {ORD}, d as (select dataset, qty - n_lines * 25.0 as d from od where qty <> n_lines * 25.0), k as (select dataset, d > 0 as up, rank() over (partition by dataset order by abs(d)) + (count(*) over (partition by dataset, abs(d)) - 1) / 2.0 as rk from d),
s as (select dataset, count(*)::double as n, coalesce(sum(rk) filter (up), 0.0) as plus from k group by dataset), w as (select *, least(plus, n * (n + 1) / 2 - plus) as w from s), z as (select *, abs(w - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24) as z from w)
select dataset, n::bigint as n, case when n >= 5 then {r('w', 2)} end as w, case when n >= 5 then {r('z')} end as z, case when n < 5 then 1.0::double else {p_of_t('z', '1000')} end as p from z"""
RAT = f"""rt as (select lang, doc_id, rater, value, {LABEL('value', 0.3)} as label from (select lang, doc_id, 'r1' as rater, s1 as value from sd union all select lang, doc_id, 'r2', s2 from sd union all select lang, doc_id, 'r3', {r('(s1 + s2) / 2', 2)} from sd))"""
SQL["icc"] = f"""with {SCO}, {RAT}, g as (select lang, avg(value) as gm, count(distinct doc_id)::double as n, count(distinct rater)::double as k from rt group by lang), i as (select lang, doc_id, avg(value) as rm from rt group by lang, doc_id), j as (select lang, rater, avg(value) as cm from rt group by lang, rater),
e as (select rt.lang, any_value(n) as n, any_value(k) as k, sum(pow(value - rm - cm + gm, 2)) as sse, sum(pow(rm - gm, 2)) as ssr, sum(pow(cm - gm, 2)) as ssc from rt join g using (lang) join i on i.lang = rt.lang and i.doc_id = rt.doc_id join j on j.lang = rt.lang and j.rater = rt.rater group by rt.lang),
m as (select lang, n, k, ssr / greatest(1, n - 1) as msr, ssc / greatest(1, k - 1) as msc, sse / greatest(1, (n - 1) * (k - 1)) as mse from e)
select lang, n::bigint as n, k::bigint as k, case when n < 2 or k < 2 then 0.0 else {r('greatest(-1.0, least(1.0, coalesce((msr - mse) / nullif(msr + (k - 1) * mse + k * (msc - mse) / n, 0), 0.0)))')} end as icc from m"""
SQL["cohen_kappa"] = f"""with {SCO}, x as (select lang, {LABEL('s1', 0.3)} as a, gold as b from sd), m as (select lang, sum(pa * pb) as pe from (select x.lang, c.l, avg((a = c.l)::int) as pa, avg((b = c.l)::int) as pb from x, (values ('pos'), ('neg'), ('neu')) c(l) group by x.lang, c.l) group by lang),
o as (select lang, count(*) as n, avg((a = b)::int) as po from x group by lang) select lang, n, {r('po')} as accuracy, {r('coalesce((po - pe) / nullif(1 - pe, 0), 0.0)')} as kappa from o join m using (lang)"""


SQL["krippendorff"] = f"""with {SCO}, x as (select lang, {LABEL('s1', 0.3)} as a, {LABEL('s2', 0.3)} as b from sd), u as (select lang, a as v from x union all select lang, b from x), c as (select lang, v, count(*)::double as c, row_number() over (partition by lang order by v) as i from u group by lang, v),
t as (select lang, sum(c) as t, count(*) as vals from c group by lang), e as (select p.lang, sum(p.c * q.c * (p.i <> q.i)::int) as en, sum(p.c * q.c * pow(p.i - q.i, 2)) as eo from c p join c q using (lang) group by p.lang),
o as (select x.lang, count(*) as n, avg((a <> b)::int) as dn, avg(pow(p.i - q.i, 2)) as dor from x join c p on p.lang = x.lang and p.v = a join c q on q.lang = x.lang and q.v = b group by x.lang)
select lang, n, case when n < 2 then null when vals < 2 or en = 0 then 1.0 else {r('1 - dn / (en / greatest(1, t * (t - 1)))')} end as nominal, case when n < 2 then null when vals < 2 or eo = 0 then 1.0 else {r('1 - dor / (eo / greatest(1, t * (t - 1)))')} end as ordinal from o join e using (lang) join t using (lang)"""
FLE = "pr as (select lang, doc_id, label, count(*) as r from rt group by lang, doc_id, label), it as (select lang, doc_id, sum(r)::double as n, sum(r * (r - 1)) as s from pr group by lang, doc_id)"
SQL["fleiss_kappa"] = f"""with {SCO}, {RAT}, {FLE}, b as (select lang, count(*) as items, avg(coalesce(s / nullif(n * (n - 1), 0), 0.0)) as pb, sum(n) as t from it group by lang), c as (select lang, sum(pow(c, 2)) as c2 from (select lang, label, count(*)::double as c from rt group by lang, label) group by lang)
select lang, items, {r('pb')} as p_bar, {r('c2 / (t * t)')} as p_e, {r('(pb - c2 / (t * t)) / greatest(1e-9, 1 - c2 / (t * t))')} as kappa from b join c using (lang)"""
SQL["fleiss_by_category"] = f"""with {SCO}, {RAT}, {FLE}, w as (select lang, count(*) as items, sum(n) as t from it group by lang), g as (select pr.lang, label, sum(r) as c, sum(case when n >= 2 then r / n * (r - 1) / (n - 1) else 0.0 end) as po from pr join it using (lang, doc_id) group by pr.lang, label),
x as (select lang, label as category, po / items as po, pow(c / t, 2) + pow(1 - c / t, 2) as pe from g join w using (lang)) select lang, category, {r('coalesce((po - pe) / nullif(1 - pe, 0), 0.0)')} as kappa from x"""
SQL["percent_agreement"] = f"with {SCO}, {RAT} select lang, count(*) as items, {r('avg((k = 1)::int)')} as agreement from (select lang, doc_id, count(distinct label) as k from rt group by lang, doc_id) group by lang"
SQL["mcnemar"] = f"""with {SCO}, {PRED}, m as (select lang, count(*) as n, count(*) filter (pred = gold and pred2 <> gold) as b, count(*) filter (pred <> gold and pred2 = gold) as c, {r('avg((pred = gold)::int)')} as acc_a, {r('avg((pred2 = gold)::int)')} as acc_b from pd group by lang),
k as (select *, case when n >= 30 then {r('coalesce(pow(abs(b - c) - 1, 2) / nullif(b + c, 0)::double, 0.0)', 3)} end as chi2 from m)
select *, (case when chi2 is null then null when chi2 > 10.83 then 0.001 when chi2 > 6.63 then 0.01 when chi2 > 3.84 then 0.05 when chi2 > 2.71 then 0.10 else 0.5 end)::double as p from k"""
SQL["label_distribution"] = f"with {SCO} select lang, gold as label, count(*) as n, {r('100 * count(*) / sum(count(*)) over (partition by lang)::double', 1)} as pct from sd group by lang, gold"

# --- baselines over the narratives ---
_sys = " union all ".join(f"select dataset, gold, '{s}' as system, {c} as score from bx" for s, c in (("main", "sentiment"), ("vader", "vader"), ("nrc", "nrc"), ("liwc", "liwc")))
SQL["baselines"] = narr(
    "select dataset, system, macro_f1, accuracy, r as pearson_r, p as pearson_p, auc_pos, auc_neg, auc_neu, macro_auc from bf join bp using (dataset, system) join mm using (dataset, system)",
    *SCORED, _vader("docs", "doc_id"), _wordy("docs", "doc_id"), f"bx as (select dataset, gold, {r('m')} as sentiment, vader, nrc, liwc from docs join me using (doc_id) join vader using (doc_id) join nrc using (doc_id) join liwc using (doc_id))",
    f"bl as (select *, {LABEL('score')} as pred, (case gold when 'pos' then 1 when 'neg' then -1 else 0 end)::double as num from ({_sys}))", f"bf as ({_prf('bl', 'dataset, system', True)})", f"bp as ({_pearson('bl', 'dataset, system', 'score', 'num')})", _multi("bl", "dataset, system", "score"),
)

_sa = " union all ".join(f"select lang, gold, '{s}' as system, {c} as score, s1 from sd" for s, c in (("main", "s1"), ("vader", "s2"), ("nrc", "-s1"), ("liwc", "0.0::double")))
SQL["system_agreement"] = f"""with {SCO}, sl as (select lang, gold, system, {LABEL('score')} as pred, {LABEL('s1')} as main from ({_sa})), sf as ({_prf('sl', 'lang, system', True)}),
sk as (select lang, system, count(*) as n, avg((pred = main)::int) as po, {' + '.join(f"pow((avg((pred = '{c}')::int) + avg((main = '{c}')::int)) / 2, 2)" for c in ('pos', 'neg', 'neu'))} as pe from sl group by lang, system)
select lang, system, n, macro_f1, accuracy, {r('coalesce((po - pe) / nullif(1 - pe, 0), 0.0)')} as kappa from sf join sk using (lang, system)"""
_o2 = ORD + ", oy as (select *, n_lines * 25.0::double as y from od)"
_part = lambda sql, t, cs: " union all ".join(f"select dataset, '{t}' as test, '{c}' as name, {c}::double as value from ({sql})" for c in cs)
SQL["statistical_report"] = f"""with {_o2}, pp as ({_pearson('oy', 'dataset', 'qty', 'y')}), rk as {_spear('oy', 'dataset', 'qty', 'y')}, ss as ({_pearson('rk', 'dataset', 'rx', 'ry')}), ww as ({SQL['wilcoxon']}),
ee as ({SQL['effect_size'].replace('price', 'qty').replace('o_totalqty as qty', 'o_totalprice as price')}) select * from ({_part('select * from pp', 'pearson', ('r', 'p', 'n'))} union all {_part('select dataset, r as rho, p from ss', 'spearman', ('rho', 'p'))}
  union all {_part('select * from ww', 'wilcoxon', ('w', 'z', 'p'))} union all {_part('select * from ee', 'effect', ('cohens_d', 'hedges_g'))}) where value is not null"""

# --- experiments ---
MET = f"mr as materialized (select * rename (gold as gold_sentiment) from ({SQL['doc_metrics']}))"
PAIRS = (
    ("sentiment", "gase", "positive"), ("sentiment", "cd_index", "negative"), ("sentiment", "vads", "positive"), ("pti", "cd_index", "positive"), ("pti", "pai", "positive"),
    ("gase", "lewi_drop", "negative"), ("teg", "ties", "positive"), ("vads", "gase", "positive"), ("nava", "lewi_drop", "positive"), ("cd_index", "ties", "positive"),
)
_mp = " union all ".join(f"select dataset, '{a}' as metric_1, '{b}' as metric_2, '{h}' as hypothesis, {a} as x, {b} as y from mr" for a, b, h in PAIRS)
_mk = "dataset, metric_1, metric_2, hypothesis"
# ranks among the rows where both are numbers
_PAIRED = f"""mlong as ({_mp}), mq as (select * from mlong where x is not null and y is not null), pe as ({_pearson('mlong', _mk, 'x', 'y')}), rk as {_spear('mq', _mk, 'x', 'y')}, sp as ({_pearson('rk', _mk, 'rx', 'ry')}),
mpairs as (select {_mk}, pe.r as pearson_r, pe.p as pearson_p, pe.sig as pearson_sig, pe.n, sp.r as spearman_rho, sp.p as spearman_p, sp.sig as spearman_sig, case when hypothesis = 'positive' then pe.r > 0 else pe.r < 0 end as direction_correct from pe join sp using ({_mk}) where pe.n >= 5)"""
SQL["metric_pairs"] = f"with {MET}, {_PAIRED} select * from mpairs"
SQL["ablation_table"] = f"""with {MET} select dataset, count(*) as n, {r(avg4('gase'))} as gase_mean, {r('coalesce(stddev_samp(gase), 0.0)')} as gase_sd, {r('coalesce(' + avg4('lewi_drop') + ', 0.0)')} as lewi_mean, {r('coalesce(stddev_samp(lewi_drop), 0.0)')} as lewi_sd, {r('100 * avg((abs(rci) > 0.001)::int)', 1)} as rci_nonzero_pct, count(nava) as nava_valid_n from mr group by dataset"""


def _trial(name: str, x: str, y: str, floor: float, where: str = "true") -> str:
    """CTEs that end in ``name``: one correlation experiment, from 10 rows on."""
    return f"""{name}_in as (select * from mr where {where}), {name}_p as ({_pearson(f'{name}_in', 'dataset', x, y)}), {name}_m as (select dataset, {r(avg4(x))} as {x}_mean from {name}_in where {y} is not null group by dataset),
{name} as (select dataset, {x}_mean, r, p, sig, n, r > {floor} and p < 0.05 as supported from {name}_p join {name}_m using (dataset) where n >= 10)"""


_H1 = f"""h1_p as ({_pearson('mr', 'dataset', 'nava', 'lewi_drop')}), h1_s as (select dataset, {r('coalesce(stddev_samp(lewi_drop), 0.0)')} as lewi_sd from mr group by dataset),
h1 as (select dataset, case when n >= 10 then r else 0.0 end as r, case when n >= 10 then p else 1.0 end as p, case when n >= 10 then sig else 'ns' end as sig, coalesce(n, 0) as n, coalesce(n >= 10 and r > 0.30 and p < 0.05, false) as supported, lewi_sd from h1_s left join h1_p using (dataset))"""
_H7 = f"""h7_in as (select dataset, gold_sentiment as gold, {LABEL('coalesce(sentiment, 0)')} as a, {LABEL('coalesce(vader_score, 0)')} as b from mr where gold_sentiment in ('pos', 'neg', 'neu')),
h7_c as (select dataset, count(*) as n, count(*) filter (a = gold and b <> gold) as b, count(*) filter (a <> gold and b = gold) as c, {r('avg((a = gold)::int)')} as acc_a, {r('avg((b = gold)::int)')} as acc_b from h7_in group by dataset having count(*) >= 30),
h7_k as (select *, case when b + c = 0 then 0.0 else {r('pow(abs(b - c) - 1, 2) / (b + c)::double', 3)} end as chi2 from h7_c),
h7_p as (select *, (case when b + c = 0 then 1.0 when chi2 > 10.83 then 0.001 when chi2 > 6.63 then 0.01 when chi2 > 3.84 then 0.05 when chi2 > 2.71 then 0.10 else 0.5 end)::double as p from h7_k),
h7 as (select *, {stars('p')} as sig, p < 0.05 as supported from h7_p)"""
SQL["lewi_nava_validation"] = f"with {MET}, {_H1} select * from h1"
SQL["dominance_experiment"] = f"with {MET}, {_trial('h2', 'pti', 'pai', 0.25)} select * from h2"
SQL["instability_experiment"] = f"with {MET}, {_trial('h3', 'teg', 'ties', 0.20, 'teg > 0')} select * from h3"
SQL["systems_differ"] = f"with {MET}, {_H7} select * from h7"
SQL["hypothesis_results"] = f"""with {MET}, {_H1}, {_trial('h2', 'pti', 'pai', 0.25)}, {_trial('h3', 'teg', 'ties', 0.20, 'teg > 0')}, {_H7}, h6 as ({_pearson('mr', 'dataset', 'cd_index', 'sentiment')})
select dataset, 'H1' as id, r as statistic, p, n, supported from h1 union all select dataset, 'H2', r, p, n, supported from h2 union all select dataset, 'H3', r, p, n, supported from h3
union all select dataset, 'H6', r, p, n, r < -0.15 and p < 0.05 from h6 where n >= 10 union all select dataset, 'H7', chi2, p, n, supported from h7"""
_DSUM = f"""{_PAIRED}, ds as (select dataset, gold_sentiment as gold, 'main' as system, sentiment as score from mr union all select dataset, gold_sentiment, 'vader', vader_score from mr),
dl as (select *, {LABEL('score')} as pred, (case gold when 'pos' then 1 when 'neg' then -1 else 0 end)::double as num from ds), df as ({_prf('dl', 'dataset, system', True)}), dp as ({_pearson('dl', 'dataset, system', 'score', 'num')}), {_multi('dl', 'dataset, system', 'score')},
dd as (select dataset, count(*) filter (direction_correct) as directions_right, count(*) as directions from mpairs group by dataset),
dg as (select dataset, count(*) filter (gold_sentiment = 'pos') as n1, count(*) filter (gold_sentiment = 'neg') as n2, avg(sentiment) filter (gold_sentiment = 'pos') - avg(sentiment) filter (gold_sentiment = 'neg') as gap,
  var_samp(sentiment) filter (gold_sentiment = 'pos') as v1, var_samp(sentiment) filter (gold_sentiment = 'neg') as v2 from mr group by dataset),
de as (select *, case when n1 < 2 or n2 < 2 then 0.0 else coalesce(gap / nullif(sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)), 0), 0.0) end as d from dg),
dsum as (select dataset, (select count(*) from mr where mr.dataset = m.dataset) as n, m.macro_f1 as main_f1, ma.macro_auc as main_auc, mp.r as main_r, v.macro_f1 as vader_f1, coalesce(directions_right, 0) as directions_right, coalesce(directions, 0) as directions,
  {r('d')} as cohens_d, {r('d * (1 - 3 / (4 * (n1 + n2) - 9)::double)')} as hedges_g, case when abs({r('d')}) >= 0.8 then 'Large' when abs({r('d')}) >= 0.5 then 'Medium' else 'Small' end as effect_size
  from df m join df v using (dataset) join mm ma using (dataset) join dp mp using (dataset) left join dd using (dataset) left join de using (dataset) where m.system = 'main' and v.system = 'vader' and ma.system = 'main' and mp.system = 'main')"""
SQL["dataset_summary"] = f"with {MET}, {_DSUM} select * from dsum"
SQL["dataset_rollup"] = f"with {MET}, {_DSUM} select dataset, {r('main_f1', 3)} as main_f1, {r('main_auc', 3)} as main_auc, {r('main_r', 3)} as main_r from dsum union all select 'mean', {r(avg4('main_f1'), 3)}, {r(avg4('main_auc'), 3)}, {r(avg4('main_r'), 3)} from dsum"
_ms = " union all ".join(f"select dataset, '{m}' as metric, {m}::double as v from mr" for m in ("sentiment", "gase", "pti", "teg", "rci", "pai", "nava", "lewi_drop", "cd_index", "vads", "ties", "vader_score", "nrc_score", "liwc_score", "n_words"))
SQL["metric_summary"] = f"with {MET}, l as ({_ms}) select dataset, metric, {r(avg4('v'))} as mean, {r('coalesce(stddev_samp(v), 0.0)')} as sd, {r(MEDIAN)} as median, min(v) as min, max(v) as max, count(*) as n from l where v is not null group by dataset, metric"
_dp = " union all ".join(f"select dataset, '{m}' as metric, {m} as v from c" for m in ("gase", "pti", "teg", "pai", "rci"))
SQL["domain_profile"] = f"with {MET}, c as (select * from (select *, row_number() over (partition by dataset order by doc_id) as rn from mr) where rn <= 30), l as ({_dp}) select dataset, metric, {r(avg4('v'))} as mean, {r('coalesce(stddev_samp(v), 0.0)')} as sd, min(v) as min, max(v) as max, count(*) as n from l group by dataset, metric"


def _corr(rel: str, key: str, ms) -> str:
    cells = " union all ".join(f"select {key}, '{a}' as row, '{b}' as col, {a}::double as x, {b}::double as y from {rel}" for a in ms for b in ms)
    return f"""cl as ({cells}), cm as (select {key}, row, col, avg(x) as mx, avg(y) as my from cl group by {key}, row, col),
cc as (select cl.{key}, cl.row, cl.col, sum((x - mx) * (y - my)) as c, sqrt(sum(pow(x - mx, 2))) * sqrt(sum(pow(y - my, 2))) as d, count(*) as n from cl join cm on cm.{key} = cl.{key} and cm.row = cl.row and cm.col = cl.col group by cl.{key}, cl.row, cl.col)"""


SQL["correlation_matrix"] = f"with {MET}, {_corr('mr', 'dataset', ['gase', 'pti', 'pai', 'ties', 'rci'])} select dataset, row, col, case when d / n > 1e-15 then {r('c / d', 3)} else 0.0 end as r from cc"


def _paragraphs() -> str:
    """Paragraphs stand for documents, with their number in the id, so that the CTEs of documents serve them."""
    six = ["sentiment", "pti", "teg", "cd_index", "vads", "ties"]
    whole = NARRATIVES.replace("docs as (select doc_id, text, c_mktsegment", "whole as (select doc_id, text, c_mktsegment")
    cut = f"select doc_id, list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda z: {trim('z')}), lambda z: length(z) > 30) as l from whole"
    parts = [
        whole, f"docs as (select doc_id * 100000 + generate_subscripts(l, 1) as doc_id, unnest(l) as text from ({cut}) where len(l) >= 3)", seg_sents(), scored(LEX), ME, STEP, TEG, _ties(), TT,
        f"pm as (select d.doc_id // 100000 as doc_id, {r('m')} as sentiment, {PTI} as pti, teg, {CD} as cd_index, {VADS} as vads, ties from tt d join me using (doc_id) join tg using (doc_id) join ti using (doc_id))", _corr("pm", "doc_id", six),
    ]
    return "with " + ",\n".join(parts) + f"\nselect doc_id, row, col, case when d / n > 1e-15 then {r('c / d', 3)} else 0.0 end as r from cc where row < col"


SQL["correlation_matrix"] = f"with {MET}, {_corr('mr', 'dataset', ['gase', 'pti', 'pai', 'ties', 'rci'])} select dataset, row, col, case when d / n > 1e-15 then {r('c / d', 3)} else 0.0 end as r from cc"
SQL["paragraph_correlation"] = _paragraphs()
_cmp = " union all ".join(f"select '{m}' as metric, max({m}) filter (doc_id = 1) as first, max({m}) filter (doc_id = 2) as second from mr" for m in ("gase", "pti", "pai", "ties"))
SQL["compare_documents"] = f"with {MET}, c as ({_cmp}) select metric, first, second, case when first > second then 'first' else 'second' end as winner from c where first is not null or second is not null"
SQL["ranking"] = f"with {MET} select doc_id, n_words, sentiment, gase, pti from mr order by gase desc, doc_id"
_CLAIMS = (
    ("Pure Positive Baseline: sentiment > 0", "sentiment > 0"), ("Pure Positive Baseline: GASE > 0", "gase > 0"), ("Pure Positive Baseline: PTI in [-0.5, 0.5]", "pti >= -0.5 and pti <= 0.5"),
    ("Pure Positive Baseline: NAVA near 0 (flat arc)", "abs(nava) < 0.5"), ("Pure Positive Baseline: CD-index < 0.3", "cd_index < 0.3"), ("Pure Negative Baseline: sentiment < 0", "sentiment < 0"), ("Pure Negative Baseline: GASE < 0", "gase < 0"),
    ("Pure Negative Baseline: CD-index > 0", "cd_index > 0"), ("Pure Negative Baseline: VADS > 0.2", "vads > 0.2"), ("Tragic Arc: NAVA > 0 (tragic)", "nava > 0"), ("Tragic Arc: LEWI drop < 0", "lewi_drop < 0"), ("Tragic Arc: TEG > 0.05", "teg > 0.05"),
    ("High PTI: PTI > 0.3 (I-dominant)", "pti > 0.3"), ("High Cognitive Distortion: CD-index > 0.4", "cd_index > 0.4"), ("High Cognitive Distortion: VADS > 0.3", "vads > 0.3"), ("High Contradiction: TIES > 0", "ties > 0"),
    ("Random Baseline: |sentiment| < 0.3", "abs(sentiment) < 0.3"), ("Random Baseline: GASE near 0", "abs(gase) < 0.5"), ("Random Baseline: CD-index < 0.2", "cd_index < 0.2"),
)
SQL["validation_suite"] = f"with {MET} " + " union all ".join(f"select '{name}' as name, count(*) as n, count(*) filter ({test}) as passed, {r(f'count(*) filter ({test}) / count(*)::double')} as rate from mr" for name, test in _CLAIMS)

# --- sources ---
SQL["session_transcript"] = "select 's' || conv_id as id, length(string_agg(text, ' ' order by turn, text))::int as chars, md5(string_agg(text, ' ' order by turn, text)) as text_md5 from conversations where role = 'user' group by conv_id"
SQL["session_runs"] = """with e as (select event_id % 50 as file, event_id, user_id, event_type from events where event_type <> 'click'), n as (select *, (coalesce(lag(user_id) over (partition by file order by event_id) <> user_id, true))::int as nw from e),
r as (select *, sum(nw) over (partition by file order by event_id rows unbounded preceding) as run from n) select file, 's' || user_id as id, run::bigint as run, string_agg(event_type, ' ' order by event_id) as text from r group by file, run, user_id"""
SQL["rater_matrix"] = f"""with {SCO} select doc_id::varchar as id, 'r1' as rater, {LABEL('s1', 0.3)} as label from sd union all select doc_id::varchar, 'r2', case when doc_id % 5 > 0 then {LABEL('s2', 0.3)} else 'neu' end from sd union all select doc_id::varchar, 'r3', case when doc_id % 2 = 0 then {LABEL('s1', 0.3)} else 'neu' end from sd"""

_isin = lambda x, ws: f"coalesce({x} in ({', '.join(map(q, ws))}), false)"
SQL["multi_label_emotions"] = f"""with x as (select 'a part named ' || p_name || ' ' || p_type as text, list_extract({sql_list(R.EMOTION_NAMES)}, (l_orderkey % 28 + 1)::int) as a, list_extract({sql_list(R.EMOTION_NAMES)}, (l_partkey % 31 + 1)::int) as b from lineitem join part on l_partkey = p_partkey),
k as (select * from x where len(list_filter(regexp_split_to_array(text, '\\s+'), lambda z: z <> '')) >= 4)
select sentiment, emotion, count(*) as n from (select case when {_isin('a', R.POSITIVE)} or {_isin('b', R.POSITIVE)} then 'pos' when {_isin('a', R.NEGATIVE)} or {_isin('b', R.NEGATIVE)} then 'neg' else 'neu' end as sentiment, coalesce(a, b, 'neutral') as emotion from k) group by sentiment, emotion"""
SQL["tweet_lines"] = """select o_orderkey::varchar as id, 'order of customer ' || o_custkey || '~' || o_orderpriority as text, list_extract(['pos', 'neg', 'neu', 'pos', 'neg'], (o_orderkey % 5 + 1)::int) as sentiment from orders"""
SQL["dialogue_turns"] = f"""with c as (select conv_id, turn % 7 as e, text from conversations where len(list_filter(regexp_split_to_array(text, '\\s+'), lambda z: z <> '')) >= 5), n as (select conv_id, list_extract({sql_list(R.DIALOGUE_EMOTIONS)}, (e + 1)::int) as emotion from c)
select conv_id, emotion, case when emotion = 'happiness' then 'pos' when emotion in ('anger', 'disgust', 'fear', 'sadness') then 'neg' else 'neu' end as sentiment, count(*) as n from n group by conv_id, emotion"""
SQL["api_pages"] = "select 't3' as after, p_partkey::varchar as id, p_name as title, p_type as selftext, p_size as score from part"
SQL["post_rows"] = "select p_partkey as id, p_name || '. ' || p_type as text from part where p_partkey % 4 <> 0 and p_partkey % 9 <> 0"
SQL["aliased_corpus"] = """select 'order placed by ' || o_custkey as text, list_extract(['pos', 'neg', 'pos', 'neg', 'neu'], (o_orderkey % 5 + 1)::int) as sentiment, list_extract(['joyful', 'afraid', '2', '0', 'else'], (o_orderkey % 5 + 1)::int) as emotion, count(*) as n from orders group by 1, 2, 3"""

# --- streaming ---
SQL["windowed_labels_batch"] = f"""with e as (select date_trunc('hour', ts) as start, event_id % 21 / 10.0 - 1.0 as s from events) select start, {LABEL('s')} as label, count(*) as n, {r('sum(s)', 2)} as total from e group by 1, 2"""


def _static(rows: list[tuple], cols: list[str]) -> str:
    lit = lambda v: "null" if v is None else q(v) if isinstance(v, str) else f"{v}::double"
    return f"select * from (values {', '.join('(' + ', '.join(map(lit, row)) + ')' for row in rows)}) t({', '.join(cols)})"



SQL["hypothesis_registry"] = _static(HYPOTHESES, ["id", "metric", "claim", "threshold"])
SQL["metric_catalog"] = _static(CATALOG, CATALOG_COLUMNS)


def _construct() -> str:
    def raw(m: str) -> str:
        p, n = fixed.CONSTRUCT_PROXIES[m]
        return f"({among('t', p)} - {among('t', n) if n else 0}) / greatest(1, len(t))::double"

    rows = " union all ".join(f"select '{m}' as metric, {'cd_index' if m == 'cds' else m}::double as x, y_{m} as y from m join px using (doc_id)" for m in fixed.CONSTRUCT_PROXIES)
    proxies = narr(f"select doc_id, {', '.join(f'{raw(m)} as y_{m}' for m in fixed.CONSTRUCT_PROXIES)} from tt", TT)
    return f"with m as ({SQL['doc_metrics']}), px as ({proxies}), cl as ({rows}), o as ({_pearson('cl', 'metric', 'x', 'y')}) select metric, r, p, sig, n, r > 0 as hit from o"


SQL["construct_validity"] = _construct()


def _extracts() -> str:
    """All extractors side by side, from the SQL of each."""
    parts = {"a": "attachment", "g": "gottman", "d": "dissolution", "b": "blame", "x": "exit_signals", "p": "power_dynamics", "e": "entities", "t": "tense", "f": "red_flags", "u": "rumination", "l": "rules_fired", "c": "coherence_proxies"}
    cols = [
        "a.doc_id", *(f"a.{k} as att_{k}" for k in fixed.ATTACHMENT), "a.pct_anxious as att_anxious_pct", "a.dominant as attachment", *(f"g.{h}" for h in fixed.HORSEMAN_WEIGHTS), "g.load as gottman_load", "d.phase", "d.para as phase_para",
        "b.own as blame_self", "b.other as blame_other", "b.own_pct as blame_self_pct", *(f"x.{k} as exit_{k}" for k in _ex), "x.total as exit_total", "p.control", "p.sacrifice", "p.initiation", "p.apology", *(f"e.role_{k}" for k in fixed.ROLES),
        "(case when e.dates = '' then 0 else len(string_split(e.dates, '|')) end)::int as n_dates", "t.past", "t.present", "t.future", "t.dominant as tense", *(f"f.{_fl(k)} as flag_{_fl(k)}" for k in fixed.RED_FLAGS), "u.ri", "u.hits as rumination", "u.repeats", "l.rules", "c.coherence",
    ]
    joins = " ".join(f"join ({SQL[v]}) {k} on {k}.doc_id = a.doc_id" for k, v in parts.items() if k != "a")
    return f"select {', '.join(cols)} from ({SQL['attachment']}) a {joins}"


SQL["extracts"] = _extracts()
