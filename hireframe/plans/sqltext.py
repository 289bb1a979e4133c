"""ANSI/DuckDB SQL text for the oracle side of the query catalogue.

These strings are the independent reference implementation the Spark plans
are checked against; they run on DuckDB over the same parquet tables.
"""

from __future__ import annotations

from ..functions.text import DIGITS, PUNCTUATION
from ..operators.extraction import CUE_WORDS, DESC_TARGETS, OTHER_LABEL, candidate_labels
from ..sources.fixtures import LABEL_COMPANIES, LABEL_PATTERNS


def q(s: str) -> str:
    """A SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


FIXTURE_CTES = {
    "job_postings": """job_postings as (
  select concat('p',cast(d.doc_id as varchar(20))) as uniq_id, d.lang as text_language,
    concat(upper(substr(p_name,1,1)),substr(p_name,2),' is hiring. ',d.text,' Join ',p_name,' now!') as job_description,
    h.html as html_job_description,
    case when row_number() over (partition by d.text order by d.doc_id)=1 then 'yes' else 'no' end as unique_posting_text
  from documents d join part on p_partkey=d.doc_id left join pages h on h.page_id=d.doc_id)""",
    "position_characteristics": """position_characteristics as (
  select concat('p',cast(d.doc_id as varchar(20))) as uniq_id, p_name as company_name
  from documents d join part on p_partkey=d.doc_id )""",
    "label_companies": "label_companies as (select * from (values "
    + ", ".join(f"({q(a)},{b},{q(c)})" for a, b, c in LABEL_COMPANIES)
    + ") t(industry,industry_rank,company_name))",
    "label_patterns": "label_patterns as (select * from (values "
    + ", ".join(f"({q(a)},{b},{q(c)})" for a, b, c in LABEL_PATTERNS)
    + ") t(industry,industry_rank,pattern))",
    "unique_postings": """unique_postings as (
  select jp.uniq_id, jp.text_language, jp.job_description, pc.company_name
  from (select * from job_postings where unique_posting_text='yes') jp
  left join position_characteristics pc on jp.uniq_id=pc.uniq_id)""",
    "labelled": """labelled as (
  select u.uniq_id, u.text_language, u.job_description, u.company_name,
    (select arg_min(industry, industry_rank) from (
        select industry, industry_rank from label_companies c where c.company_name=u.company_name
        union all
        select industry, industry_rank from label_patterns p
        where u.company_name ilike concat('% ', p.pattern, '%') escape '@')) as industry
  from unique_postings u)""",
}
_DEPS = {"unique_postings": ["job_postings", "position_characteristics"],
         "labelled": ["unique_postings", "label_companies", "label_patterns"]}


def with_views(body: str, *views: str) -> str:
    """Prefix ``body`` with the fixture CTEs it needs (dependencies first)."""
    order: list[str] = []

    def add(v):
        for d in _DEPS.get(v, []):
            add(d)
        if v not in order:
            order.append(v)
    for v in views:
        add(v)
    return "with " + ",\n".join(FIXTURE_CTES[v] for v in order) + "\n" + body


def strip_ws(expr: str) -> str:
    return f"regexp_replace({expr}, '^[ \\t\\r\\n]+|[ \\t\\r\\n]+$', '', 'g')"


def sentences(expr: str) -> str:
    """F1 in DuckDB: list of trimmed, non-empty sentences."""
    marked = f"regexp_replace(coalesce({expr}, ''), '([.!?]+)[ \\t\\r\\n]+', '\\1' || chr(1), 'g')"
    return (f"list_filter(list_transform(string_split({marked}, chr(1)), lambda s: {strip_ws('s')}), "
            f"lambda s: s <> '')")


_BEFORE = r"""[(\[{"''\x{AB}\x{201E}\x{201C}\x{2018}]+"""
_BEHIND = r"""[)\]}"''\x{BB}\x{201C}\x{201D}\x{2019},;:!?]+"""


def abbreviations(src: str, text: str = "text", out: str = "abbr") -> str:
    """CTEs for the learned abbreviations of ``src`` (abbreviation, n_stop, n_plain, score)."""
    return f"""{out}_w as (select regexp_replace(regexp_replace(w, '^{_BEFORE}', ''), '{_BEHIND}$', '') as w
  from (select unnest(regexp_split_to_array(lower(coalesce({text}, '')), '[ \t\r\n]+')) as w from {src})),
{out}_c as (select regexp_replace(w, '\\.$', '') as abbreviation, count(*) filter (w like '%.') as n_stop,
  count(*) filter (w not like '%.') as n_plain from {out}_w where regexp_matches(w, '\\p{{L}}') group by 1),
{out}_t as (select cast(sum(n_stop + n_plain) as double) as n, cast(sum(n_stop) as double) as k from {out}_c),
{out}_s as (select abbreviation, n_stop, n_plain, cast(length(replace(abbreviation, '.', '')) as double) as letters,
  -2 * (n_stop * ln(k / n) + n_plain * ln(1 - k / n) - n_stop * ln(0.99) - n_plain * ln(0.01)) as ratio from {out}_c, {out}_t where n_stop > 0),
{out} as (select abbreviation, n_stop, n_plain, ratio * exp(-letters) * (length(abbreviation) - letters + 1) * pow(letters, -n_plain) as score
  from {out}_s where ratio * exp(-letters) * (length(abbreviation) - letters + 1) * pow(letters, -n_plain) >= 0.3)"""


def merged_sentences(pieces: str, known: str) -> str:
    """Sentences of a list, put together where one ends in a word of the list ``known``."""
    end = f"regexp_replace(regexp_extract(lower(s), '([^ \\t\\r\\n]+)\\.$', 1), '^{_BEFORE}', '')"
    marked = f"list_transform({pieces}, lambda s: s || case when list_contains({known}, {end}) then ' ' else chr(1) end)"
    return f"list_filter(string_split(rtrim(array_to_string({marked}, ''), ' '), chr(1)), lambda s: s <> '')"


UNICODE_SPACE = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def tokens(expr: str) -> str:
    """F4+F5 in DuckDB."""
    cleaned = f"lower(translate(coalesce({expr}, ''), {q(PUNCTUATION + DIGITS)}, ''))"
    return f"list_filter(regexp_split_to_array({cleaned}, '{UNICODE_SPACE}'), lambda t: t <> '')"


def cue_top_label(sent: str, var: str = "t", cues: dict | None = None) -> str:
    """Top label of a sentence under the cue table (DuckDB)."""
    cues = CUE_WORDS if cues is None else cues
    labels = candidate_labels()
    toks = tokens(sent)
    parts = []
    for i, label in enumerate(labels):
        words = cues.get(label, [])
        if words:
            lst = "[" + ", ".join(q(w) for w in words) + "]"
            score = f"len(list_filter({toks}, lambda {var}: list_contains({lst}, {var})))"
        else:
            score = "0"
        parts.append(f"({score})*100 - {i}")
    # pack (score, -i) into one number: score*100 - i; label index recovered below
    best = f"greatest({', '.join(parts)})"
    idx = f"(100 - (({best}) % 100 + 100) % 100) % 100"
    label_list = "[" + ", ".join(q(x) for x in labels) + "]"
    return (f"case when ({best}) > 0 then {label_list}[cast({idx} as integer) + 1] "
            f"else {q(OTHER_LABEL)} end")


def target_list() -> str:
    return "[" + ", ".join(q(x) for x in DESC_TARGETS) + "]"


def extraction(src: str, out: str, text: str = "job_description", name: str = "company_name",
               use_cues: bool = True) -> str:
    """CTEs turning ``src`` into ``out`` with d1 (name pass), d2 (cue pass),
    employer_description (NULL if empty) and retrieved_by (comma-joined)."""
    name_pass = (f"array_to_string(list_filter(_sents, lambda x: length({name}) > 0 "
                 f"and contains(lower(x), lower({name}))), ' ')")
    resid = (f"{sentences(f'array_to_string(list_filter(_sents, lambda x: not list_contains(_found, x)), chr(32))')}")
    cue = (f"array_to_string(list_filter(_resid, lambda x: list_contains({target_list()}, "
           f"{cue_top_label('x')})), ' ')") if use_cues else "''"
    return f"""{out}_a as (select *, {sentences(text)} as _sents from {src}),
{out}_b as (select *, {name_pass} as _d1 from {out}_a),
{out}_c as (select *, {sentences('_d1')} as _found from {out}_b),
{out}_d as (select *, {resid} as _resid from {out}_c),
{out}_e as (select *, {cue} as _d2 from {out}_d),
{out} as (select * exclude (_sents, _found, _resid, _d1, _d2),
  nullif(case when length(_d1) > 0 and length(_d2) > 0 then _d1 || ' ' || _d2
              when length(_d1) > 0 then _d1 else _d2 end, '') as employer_description,
  concat_ws(',', case when length(_d1) > 0 then 'name' end, case when length(_d2) > 0 then 'zsc' end) as retrieved_by
  from {out}_e)"""


def industry_train(out: str = "industry_train", cap: int = 500) -> str:
    """E1 as CTEs over the ``labelled`` view."""
    return f"""{out}_cap as (select * exclude (rn) from (
  select uniq_id, text_language, job_description, company_name, industry,
    row_number() over (partition by industry order by md5(concat('4082023:', uniq_id)), uniq_id) as rn
  from labelled where industry is not null and text_language is not null and job_description is not null
    and company_name is not null) x where rn <= {cap}),
{extraction(f'{out}_cap', f'{out}_x')},
{out} as (select uniq_id, employer_description, company_name, industry from {out}_x
  where employer_description is not null)"""


def blind(desc: str, name: str, rep: str = "this company") -> str:
    return f"case when {name} is null or {name} = '' then {desc} else replace({desc}, {name}, {q(rep)}) end"


def naive_bayes(prefix: str, train: str, label: str, toks: str, test: str, key: str, test_toks: str) -> str:
    """CTEs for multinomial NB (alpha 1): ``{prefix}_full(key, label, score)``
    and ``{prefix}_pred(key, prediction)``."""
    p = prefix
    return f"""{p}_tr as (select {label} as label, {toks} as toks from {train} where {label} is not null),
{p}_pairs as (select label, token, count(*) as c from (select label, unnest(toks) as token from {p}_tr) group by 1, 2),
{p}_docs as (select label, count(*) as d from {p}_tr group by 1),
{p}_ntok as (select label, sum(c) as n from {p}_pairs group by 1),
{p}_v as (select count(distinct token) as v from {p}_pairs),
{p}_cls as (select k.label, ln(k.d / (select sum(d) from {p}_docs)) as prior, coalesce(t.n, 0) as n,
   (select v from {p}_v) as v from {p}_docs k left join {p}_ntok t using (label)),
{p}_w as (select t.token, k.label, ln((coalesce(pr.c, 0) + 1.0) / (k.n + k.v)) as w
   from (select distinct token from {p}_pairs) t cross join {p}_cls k
   left join {p}_pairs pr on pr.token = t.token and pr.label = k.label),
{p}_te as (select {key} as _k, {test_toks} as toks from {test}),
{p}_tt as (select _k, unnest(toks) as token from {p}_te),
{p}_sum as (select tt._k, w.label, sum(w.w) as s from {p}_tt tt join {p}_w w using (token) group by 1, 2),
{p}_full as (select x._k, k.label, k.prior + coalesce(s.s, 0) as score
   from (select distinct _k from {p}_te) x cross join {p}_cls k
   left join {p}_sum s on s._k = x._k and s.label = k.label),
{p}_pred as (select _k, label as prediction from (
   select _k, label, row_number() over (partition by _k order by round(score, 6) desc, label) as rn
   from {p}_full) z where rn = 1),
{p}_prob as (select f._k, f.label, exp(f.score - m.mx) / sum(exp(f.score - m.mx)) over (partition by f._k) as prob,
   f.score from {p}_full f join (select _k, max(score) as mx from {p}_full group by 1) m using (_k))"""


def trunc_tokens(expr: str, n: int = 128) -> str:
    return f"list_slice({tokens(expr)}, 1, {n})"


def report(pairs: str, classes: str, out: str = "rep") -> str:
    """CTEs for the per-class report over ``pairs(t, p)`` and ``classes(class)``;
    final CTE ``{out}`` has class, precision, recall, f1, support."""
    o = out
    return f"""{o}_sup as (select t as class, count(*) as support from {pairs} group by 1),
{o}_prd as (select p as class, count(*) as predicted from {pairs} group by 1),
{o}_tp as (select t as class, count(*) as tp from {pairs} where t = p group by 1),
{o}_per as (select c.class, coalesce(support, 0) as support, coalesce(predicted, 0) as predicted, coalesce(tp, 0) as tp
  from {classes} c left join {o}_sup using (class) left join {o}_prd using (class) left join {o}_tp using (class)),
{o}_cls as (select class,
  case when predicted = 0 then 1.0 else tp / predicted end as precision,
  case when support = 0 then 1.0 else tp / support end as recall,
  case when 2 * tp + (predicted - tp) + (support - tp) = 0 then 1.0
       else 2 * tp / (2 * tp + (predicted - tp) + (support - tp)) end as f1, support from {o}_per),
{o}_obs as (select t as c from {pairs} where t is not null union select p from {pairs} where p is not null),
{o}_diff as (select (select count(*) from (select c from {o}_obs except select class from {classes}))
  + (select count(*) from (select class from {classes} except select c from {o}_obs)) as nd),
{o}_tot as (select count(*) as n, sum(case when t = p then 1 else 0 end) as hits from {pairs}),
{o}_all as (
  select class, precision, recall, f1, support from {o}_cls
  union all select case when (select nd from {o}_diff) = 0 then 'accuracy' else 'micro avg' end,
    hits / n, hits / n, hits / n, n from {o}_tot
  union all select 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) from {o}_cls
  union all select 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
    sum(f1 * support) / sum(support), sum(support) from {o}_cls),
{o} as (select class, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1,
  cast(support as bigint) as support from {o}_all)"""
