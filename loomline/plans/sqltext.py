"""Pieces of SQL for the oracle queries, written independently of the Column functions."""

from __future__ import annotations

from loomline.functions import fixed
from loomline.functions.lexicon import Lexicon
from loomline.plans.narratives import NARRATIVES, q, sql_list


def r(x: str, places: int = 4) -> str:
    k = 10**places
    return f"(floor(({x}) * {float(k)} + 0.5) / {float(k)} + 0.0)"


def trim(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def toks(x: str) -> str:
    """Tokens; letters beyond ASCII count as word characters, which the engine's own boundary does not know."""
    flat = rf"regexp_replace(regexp_replace(lower({x}), '[^\x00-\x7F\p{{L}}\p{{N}}]', ' ', 'g'), '[^\x00-\x7F]', '0', 'g')"
    return rf"regexp_extract_all({flat}, '\b[a-z'']+\b')"


def sents(x: str) -> str:
    cut = rf"regexp_replace(regexp_replace({trim(x)}, '([.!?])\s+([A-Z])', '\1' || chr(1) || '\2', 'g'), '([.!?])\s*\n', '\1' || chr(1), 'g')"
    kept = f"list_filter(list_transform(string_split({cut}, chr(1)), lambda z: {trim('z')}), lambda z: z <> '')"
    return f"(case when len({kept}) = 0 then [{trim(x)}] else {kept} end)"


def paras(x: str) -> str:
    return rf"list_filter(list_transform(string_split_regex({x}, '\n\s*\n'), lambda z: {trim('z')}), lambda z: z <> '')"


def among(t: str, words) -> str:
    return f"len(list_filter({t}, lambda z: list_contains({sql_list(words)}, z)))"


def content(t: str, least: int = 3) -> str:
    return f"list_filter({t}, lambda z: not list_contains({sql_list(fixed.STOP_WORDS)}, z) and length(z) >= {least} and strpos(z, '''') = 0)"


def occ(x: str, needle: str) -> str:
    return f"((length({x}) - length(replace({x}, {q(needle)}, ''))) // {len(needle)})"


def occs(x: str, needles) -> str:
    return "(" + " + ".join(occ(x, n) for n in needles) + ")"


def has(x: str, needles) -> str:
    return "(" + " + ".join(f"(strpos({x}, {q(n)}) > 0)::int" for n in needles) + ")"


def hits(x: str, pattern: str, fold: bool = False) -> str:
    return f"len(regexp_extract_all({x}, {q(('(?i)' if fold else '') + pattern)}))"


def found(x: str, pattern: str, fold: bool = False) -> str:
    return f"regexp_matches({x}, {q(('(?i)' if fold else '') + pattern)})"


def first_max(pairs) -> str:
    """Name of the first largest of (name, expression) pairs."""
    top = "greatest(" + ", ".join(e for _, e in pairs) + ")"
    return "case " + " ".join(f"when {e} = {top} then {q(n)}" for n, e in pairs) + " end"


def band(x: str, edges, rest: str) -> str:
    return "case " + " ".join(f"when {x} > {e} then {q(n)}" for e, n in edges) + f" else {q(rest)} end"


def mean(values: str) -> str:
    """Mean from left to right."""
    return f"(case when len({values}) = 0 then 0.0 else list_reduce(list_prepend(0.0::double, {values}), lambda a, b: a + b) / len({values}) end)"


def mean4(values: str, places: int = 4) -> str:
    """Mean of rounded numbers, as whole multiples of their last place."""
    k = float(10**places)
    return f"(case when len({values}) = 0 then 0.0 else list_sum(list_transform({values}, lambda z: round(z * {k})::bigint))::double / len({values}) / {k} end)"


def avg4(x: str, where: str = "", places: int = 4) -> str:
    """The same as an aggregate."""
    f = f" filter ({where})" if where else ""
    k = float(10**places)
    return f"((sum(round(({x}) * {k})::bigint){f})::double / nullif(count({x}){f}, 0) / {k})"


def explode(rel: str, lst: str, ix: str, name: str, keep: str = "doc_id") -> str:
    return f"select {keep}, generate_subscripts(l, 1) - 1 as {ix}, unnest(l) as {name} from (select {keep}, {lst} as l from {rel})"


def lex_rows(lex: Lexicon, phrases: bool) -> str:
    rows = [e for e in lex.entries if e.is_phrase == phrases]
    if not rows:
        return "(select null::varchar as term, null::double as w, null::varchar[] as emo, null::varchar as horse where false) lx"
    return "(values " + ", ".join(f"({q(e.term)}, ({e.s} * {e.i})::double, {sql_list(e.emotions)}::varchar[], {q(e.horseman) if e.horseman else 'null'})" for e in rows) + ") lx(term, w, emo, horse)"


def scored(lex: Lexicon, segs: str = "segs") -> str:
    """CTEs that end in ``sc(doc_id, ix, s, compound, sarcasm)`` and ``tags(doc_id, ix, emo, horse)`` from ``segs(doc_id, ix, s)``."""
    mods = lambda d: " , ".join(f"({q(w)}, {m}::double)" for w, m in d.items())
    up = f"coalesce((select max(m) from (values {mods(lex.intensifiers)}) u(w, m) where strpos(before, u.w) > 0), 1.0)"
    down = f"(select min(m) from (values {mods(lex.diminishers)}) u(w, m) where strpos(before, u.w) > 0)"
    irony = " or ".join(found("lower(s)", p) for p in lex.sarcasm if "(?=" not in p) or "false"
    return f"""tk as ({explode(segs, toks('s'), 'tix', 'tok', 'doc_id, ix')}),
tw as (select *, max(list_contains({sql_list(lex.negators)}, tok)::int) over (partition by doc_id, ix order by tix rows between 4 preceding and 1 preceding) as neg,
  concat_ws(' ', lag(tok, 2) over (partition by doc_id, ix order by tix), lag(tok, 1) over (partition by doc_id, ix order by tix)) as before from tk),
th as (select doc_id, ix, tok, neg, before, w, emo, horse from tw join {lex_rows(lex, False)} on lx.term = tok),
tm as (select distinct before, {up} as up, {down} as down from (select distinct before from th)),
ph as (select g.doc_id, g.ix, lx.w, lx.emo, lx.horse from {segs} g join {lex_rows(lex, True)} on strpos(lower(g.s), lx.term) > 0),
hit as (select doc_id, ix, w * least(up, coalesce(down, up)) * (case when neg = 1 then -0.7 else 1.0 end) as v, emo, horse from th join tm using (before)
  union all select doc_id, ix, w, emo, horse from ph),
tags as (select doc_id, ix, emo, horse from hit),
ir as (select doc_id, ix, s, ({irony}) as sarcasm from {segs}),
su as (select i.doc_id, i.ix, any_value(i.s) as s, any_value(sarcasm) as sarcasm, coalesce(sum(case when sarcasm and v > 0 then -v else v end), 0.0) as t
  from ir i left join hit h on h.doc_id = i.doc_id and h.ix = i.ix group by i.doc_id, i.ix),
sc as (select doc_id, ix, s, sarcasm, {r('t / sqrt(t * t + 15)')} as compound from su)"""


def narr(body: str, *ctes: str) -> str:
    return "with " + ",\n".join([NARRATIVES, *ctes]) + "\n" + body


def seg_sents(rel: str = "docs") -> str:
    return f"segs as ({explode(rel, sents('text'), 'ix', 's')})"


def p_of_t(t: str, df: str) -> str:
    return f"(case when {df} / ({df} + pow({t}, 2))::double >= 1 then 1.0 when abs({t}) > 4.417 then 0.0001 when abs({t}) > 3.291 then 0.001 when abs({t}) > 2.576 then 0.01 when abs({t}) > 1.960 then 0.05 when abs({t}) > 1.645 then 0.10 else 0.5 end)::double"


def stars(p: str) -> str:
    return f"(case when {p} <= 0.001 then '***' when {p} <= 0.01 then '**' when {p} <= 0.05 then '*' else 'ns' end)"
