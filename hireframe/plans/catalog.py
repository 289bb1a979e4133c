"""The registered query catalogue: Spark plans and their DuckDB oracle SQL.

Each entry of :data:`QUERIES` takes ``(spark, sf_dir)`` and returns a lazy
DataFrame over the whole driver tables; :data:`ORACLE` holds the equivalent
SQL for DuckDB (same column names, doubles rounded to 6 decimals).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import labelling, sampling, voting
from ..operators.extraction import sentences_by_name
from ..functions.text import split_sentences
from ..sources import fixtures as fx
from ..sources import postings
from . import sqltext as S

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn
    return deco


# ---------------------------------------------------------------- shared inputs

def _jp(spark, d):
    return fx.job_postings(spark, d)


def _pc(spark, d):
    return fx.position_characteristics(spark, d)


def unique_postings(spark: SparkSession, d: str) -> DataFrame:
    """Unique postings with their employer (S1 with institution_name)."""
    return postings.get_postings(_jp(spark, d), _pc(spark, d), institution_name=True)


def labelled_postings(spark: SparkSession, d: str, compat: bool = False) -> DataFrame:
    """Unique postings labelled by both rules (rows without label kept, industry NULL)."""
    return labelling.label_employers(unique_postings(spark, d), fx.label_companies(spark),
                                     fx.label_patterns(spark), compat=compat)


# ---------------------------------------------------------------- S / P / J / L

@register("postings_scan", S.with_views("""
select jp.uniq_id, jp.text_language, jp.job_description, pc.company_name
from (select * from job_postings where unique_posting_text='yes' and text_language='en') jp
left join position_characteristics pc on jp.uniq_id=pc.uniq_id""", "job_postings", "position_characteristics"))
def q_postings_scan(spark, d):
    return postings.get_postings(_jp(spark, d), _pc(spark, d), institution_name=True, language="en")


@register("postings_limit_then_join", S.with_views("""
select jp.uniq_id, jp.text_language, jp.job_description, pc.company_name, jp.html_job_description
from (select * from job_postings where unique_posting_text='yes'
      order by md5(concat('4082023:', uniq_id)), uniq_id limit 100) jp
left join position_characteristics pc on jp.uniq_id=pc.uniq_id""", "job_postings", "position_characteristics"))
def q_postings_limit_then_join(spark, d):
    return postings.get_postings(_jp(spark, d), _pc(spark, d), institution_name=True, html=True,
                                 sample_size=100, seed=4082023)


COMPANY_SET = [["red widget", "blue bolt"], "hot gizmo", "new gear", ["old ring"]]


@register("company_postings", S.with_views("""
select jp.uniq_id, jp.text_language, jp.job_description, pc.company_name
from (select * from job_postings where unique_posting_text='yes'
      and uniq_id in (select uniq_id from position_characteristics
                      where company_name in ('hot gizmo','new gear','red widget','blue bolt','old ring'))) jp
left join position_characteristics pc on jp.uniq_id=pc.uniq_id""", "job_postings", "position_characteristics"))
def q_company_postings(spark, d):
    return postings.get_company_postings(_jp(spark, d), _pc(spark, d), COMPANY_SET, institution_name=True)


@register("pattern_employers", S.with_views("""
select distinct p.industry, c.company_name
from (select distinct company_name from position_characteristics where company_name is not null) c
join label_patterns p on c.company_name ilike concat('% ', p.pattern, '%') escape '@'""",
                                            "position_characteristics", "label_patterns"))
def q_pattern_employers(spark, d):
    return labelling.pattern_employers(_pc(spark, d), fx.label_patterns(spark))


@register("label_employers", S.with_views("""
select uniq_id, company_name, industry from labelled
where industry is not null and text_language is not null and job_description is not null""", "labelled"))
def q_label_employers(spark, d):
    return labelled_postings(spark, d).na.drop("any").select("uniq_id", "company_name", "industry")


@register("label_employers_compat", S.with_views("""
select uniq_id, company_name, industry from (
  select u.uniq_id, u.company_name, u.text_language, u.job_description,
    (select arg_min(industry, industry_rank) from (
        select industry, industry_rank from label_companies c where c.company_name=u.company_name
        union all
        select industry, industry_rank from label_patterns p
        where u.company_name ilike concat('% ', p.pattern, '%') escape '@'
          and p.industry not in (select industry from label_companies))) as industry
  from unique_postings u) x
where industry is not null and text_language is not null and job_description is not null""",
                                                 "unique_postings", "label_companies", "label_patterns"))
def q_label_employers_compat(spark, d):
    return labelled_postings(spark, d, compat=True).na.drop("any").select("uniq_id", "company_name", "industry")


@register("labelled_employers", S.with_views("""
select distinct industry, industry_rank, company_name, rule from (
  select industry, industry_rank, company_name, 'list' as rule from label_companies
  union all
  select distinct p.industry, p.industry_rank, c.company_name, 'pattern' as rule
  from (select distinct company_name from position_characteristics where company_name is not null) c
  join label_patterns p on c.company_name ilike concat('% ', p.pattern, '%') escape '@') x""",
                                             "position_characteristics", "label_companies", "label_patterns"))
def q_labelled_employers(spark, d):
    return labelling.labelled_employers(_pc(spark, d), fx.label_companies(spark), fx.label_patterns(spark))


@register("subsample_per_group", S.with_views("""
select uniq_id, company_name from (
  select uniq_id, company_name, row_number() over (partition by company_name
         order by md5(concat('4082023:', uniq_id)), uniq_id) as rn
  from unique_postings where company_name is not null) x where rn <= 3""", "unique_postings"))
def q_subsample_per_group(spark, d):
    return sampling.subsample(unique_postings(spark, d), "company_name", "uniq_id",
                              max_n_per_group=3).select("uniq_id", "company_name")


@register("subsample_overall", S.with_views("""
select uniq_id, industry from (
  select uniq_id, industry, row_number() over (partition by industry
         order by md5(concat('4082023:', uniq_id)), uniq_id) as rn
  from labelled where industry is not null) x where rn <= 100
order by md5(concat('4082023:overall:', uniq_id)), uniq_id limit 250""", "labelled"))
def q_subsample_overall(spark, d):
    return sampling.subsample(labelled_postings(spark, d), "industry", "uniq_id", max_n_per_group=100,
                              max_n_overall=250).select("uniq_id", "industry")


@register("group_sizes", S.with_views("""
select industry, cast(least(count(*), 100) as bigint) as n from labelled
where industry is not null group by industry""", "labelled"))
def q_group_sizes(spark, d):
    return sampling.group_sizes(labelled_postings(spark, d), "industry", 100)


# ---------------------------------------------------------------- text

@register("description_by_name", S.with_views(f"""
select uniq_id, array_to_string(list_filter({S.sentences('job_description')},
    lambda s: length(company_name) > 0 and contains(lower(s), lower(company_name))), ' ') as desc_name
from unique_postings""", "unique_postings"))
def q_description_by_name(spark, d):
    u = unique_postings(spark, d)
    return u.select("uniq_id", sentences_by_name(split_sentences(F.col("job_description")),
                                                 F.col("company_name")).alias("desc_name"))


# ---------------------------------------------------------------- votes

@register("majority_vote", S.with_views("""
select company_name, language from (
  select company_name, text_language as language, row_number() over (partition by company_name
         order by count(*) desc, text_language) as rn
  from unique_postings where company_name is not null and text_language is not null
  group by company_name, text_language) x where rn = 1""", "unique_postings"))
def q_majority_vote(spark, d):
    return voting.majority_vote(unique_postings(spark, d), "company_name", "text_language", out="language")


# ================================================================ part 2

from ..functions import predicates as P  # noqa: E402
from ..functions import text as T  # noqa: E402
from ..operators import classify, evaluate, splitting  # noqa: E402
from ..operators.extraction import (extract_employer_description, residual_sentences,  # noqa: E402
                                    sentences_by_cues)
from ..operators.vocabulary import build_vocabulary, encode_tokens, longest_sequence  # noqa: E402
from ..sources.labels import (MACRO_MAPPING, MESO_MAPPING, NAME_PATTERNS, PHARMA_MAPPING, level_mapping,  # noqa: E402
                              load_dictionary, write_dictionary)
from . import flows  # noqa: E402


def labelled_only(spark, d) -> DataFrame:
    return labelled_postings(spark, d).filter(F.col("industry").isNotNull())


def corpus(spark, d) -> DataFrame:
    return fx.language_corpus(spark, d)


# ---------------------------------------------------------------- text

@register("sentences", S.with_views(f"""
select uniq_id, cast(pos - 1 as bigint) as pos, sentence from (
  select uniq_id, unnest(ss) as sentence, generate_subscripts(ss, 1) as pos
  from (select uniq_id, {S.sentences("replace(job_description, chr(10), ' ')")} as ss from unique_postings))""",
                                    "unique_postings"))
def q_sentences(spark, d):
    u = unique_postings(spark, d)
    return u.select("uniq_id", F.posexplode(T.split_sentences(T.newline_to_space("job_description")))
                    .alias("pos", "sentence")).withColumn("pos", F.col("pos").cast("bigint"))


@register("conversation_sentences", f"""
select conv_id, turn, cast(pos - 1 as bigint) as pos, sentence from (
  select conv_id, turn, unnest(ss) as sentence, generate_subscripts(ss, 1) as pos
  from (select conv_id, turn, {S.sentences('text')} as ss from conversations))""")
def q_conversation_sentences(spark, d):
    c = fx.table(spark, d, "conversations")
    return c.select("conv_id", "turn", F.posexplode(T.split_sentences("text")).alias("pos", "sentence")) \
        .withColumn("pos", F.col("pos").cast("bigint"))


@register("residual_text", S.with_views(f"""
with_d1 as (select uniq_id, {S.sentences('job_description')} as _sents,
  array_to_string(list_filter({S.sentences('job_description')}, lambda x: length(company_name) > 0
     and contains(lower(x), lower(company_name))), ' ') as _d1 from unique_postings),
with_f as (select *, {S.sentences('_d1')} as _found from with_d1)
select uniq_id, array_to_string({S.sentences("array_to_string(list_filter(_sents, lambda x: not list_contains(_found, x)), chr(32))")}, ' ') as residual
from with_f""".replace("with_d1 as", ", with_d1 as", 1).replace("\nselect uniq_id, cast", "\nselect uniq_id, cast"),
                                        "unique_postings").replace(")\n, with_d1", "),\nwith_d1"))
def q_residual_text(spark, d):
    u = unique_postings(spark, d).withColumn("_s", T.split_sentences("job_description"))
    d1 = sentences_by_name(F.col("_s"), F.col("company_name"))
    return u.select("uniq_id", T.join_sentences(residual_sentences(F.col("_s"), d1)).alias("residual"))


@register("description_by_cues", S.with_views(f"""
select uniq_id, array_to_string(list_filter({S.sentences('job_description')},
   lambda x: list_contains({S.target_list()}, {S.cue_top_label('x')})), ' ') as desc_cues
from unique_postings""", "unique_postings"))
def q_description_by_cues(spark, d):
    u = unique_postings(spark, d)
    return u.select("uniq_id", sentences_by_cues(T.split_sentences("job_description")).alias("desc_cues"))


def _employer_description_sql() -> str:
    body = S.with_views("select 1", "unique_postings")[:-len("select 1")].rstrip()
    return (body + ",\n" + S.extraction("unique_postings", "ed") +
            "\nselect uniq_id, employer_description, retrieved_by from ed")


@register("employer_description", _employer_description_sql())
def q_employer_description(spark, d):
    out = extract_employer_description(unique_postings(spark, d))
    return out.select("uniq_id", "employer_description", F.array_join("retrieved_by", ",").alias("retrieved_by"))


@register("dropna_postings", S.with_views("""
select uniq_id, company_name from unique_postings
where uniq_id is not null and text_language is not null and job_description is not null
  and company_name is not null""", "unique_postings"))
def q_dropna_postings(spark, d):
    return unique_postings(spark, d).na.drop("any").select("uniq_id", "company_name")


@register("null_if_empty", S.with_views("""
select uniq_id, nullif(d, '') as description, coalesce(nullif(d, ''), 'no relevant information') as model_text
from (select uniq_id, array_to_string(list_filter({s}, lambda x: length(company_name) > 0
        and contains(lower(x), lower(company_name))), ' ') as d from unique_postings)"""
                                        .replace("{s}", S.sentences("job_description")), "unique_postings"))
def q_null_if_empty(spark, d):
    u = unique_postings(spark, d)
    desc = sentences_by_name(T.split_sentences("job_description"), F.col("company_name"))
    return u.select("uniq_id", P.null_if_empty(desc).alias("description"), P.default_text(desc).alias("model_text"))


@register("blind_names", S.with_views(f"""
select uniq_id, {S.blind('job_description', 'company_name')} as blinded from unique_postings""",
                                      "unique_postings"))
def q_blind_names(spark, d):
    u = unique_postings(spark, d)
    return u.select("uniq_id", T.blind_names("job_description", "company_name", "this company").alias("blinded"))


# ---------------------------------------------------------------- relabel

def _mapping_values() -> str:
    rows = [(lvl, k, v) for lvl, m in (("meso", MESO_MAPPING), ("macro", MACRO_MAPPING),
                                       ("pharma", PHARMA_MAPPING)) for k, v in m.items()]
    return ("(select * from (values " + ", ".join(f"({S.q(a)},{S.q(b)},{S.q(c)})" for a, b, c in rows)
            + ") t(level, industry, target))")


@register("relabel_level", S.with_views(f"""
select l.uniq_id, lv.level, coalesce(m.target, l.industry) as industry
from labelled l cross join (values ('meso'), ('macro'), ('pharma')) lv(level)
left join {_mapping_values()} m on m.level = lv.level and m.industry = l.industry
where l.industry is not null""", "labelled"))
def q_relabel_level(spark, d):
    base = labelled_only(spark, d).select("uniq_id", "industry")
    mp = level_mapping(spark)
    return labelling.relabel_levels(base, mp).select("uniq_id", "level", "industry")


# ---------------------------------------------------------------- splits

def _employer_split_sql(test_size: float, validation: bool, val_size: float = 0.25, seed: int = 8082023,
                        src: str = "labelled where industry is not null", cols: str = "uniq_id, company_name") -> str:
    second = (f"""case when p = 'rest' then (case when cs - base < t2 then 'validation'
          when cs - base > t2 then 'train' else 'dropped' end) else p end""" if validation
              else "case when p = 'rest' then 'train' else p end")
    return f""",
sp_base as (select {cols} from {src}),
sp_cc as (select company_name, count(*) as n from sp_base where company_name is not null group by 1),
sp_cs as (select company_name, n, sum(n) over (order by md5(concat('{seed}:', company_name)), company_name
          rows between unbounded preceding and current row) as cs from sp_cc),
sp_t as (select cast(floor((select count(*) from sp_base) * cast({test_size} as double)) as bigint) as t),
sp_p1 as (select company_name, n, cs, case when cs < t then 'test' when cs > t then 'rest' else 'dropped' end as p
          from sp_cs, sp_t),
sp_b as (select coalesce(sum(case when p <> 'rest' then n end), 0) as base, sum(n) as total from sp_p1),
sp_t2 as (select base, cast(floor((total - base) * cast({val_size} as double)) as bigint) as t2 from sp_b),
sp_part as (select company_name, {second} as partition from sp_p1, sp_t2),
split as (select b.*, coalesce(sp_part.partition, 'dropped') as partition
          from sp_base b left join sp_part on b.company_name = sp_part.company_name)"""


def _views_plus(extra: str, body: str, *views: str) -> str:
    head = S.with_views("select 1", *views)[:-len("select 1")].rstrip()
    return head + extra + "\n" + body


@register("split_by_employers", _views_plus(_employer_split_sql(0.15, True),
                                            "select uniq_id, company_name, partition from split", "labelled"))
def q_split_by_employers(spark, d):
    df = labelled_only(spark, d).select("uniq_id", "company_name")
    return splitting.split_by_employers(df, validation_set=True, test_size=0.15, val_size=0.25)


@register("split_by_employers_2way", _views_plus(_employer_split_sql(0.2, False),
                                                 "select uniq_id, company_name, partition from split", "labelled"))
def q_split_by_employers_2way(spark, d):
    df = labelled_only(spark, d).select("uniq_id", "company_name")
    return splitting.split_by_employers(df, validation_set=False, test_size=0.2)


@register("partition_leakage", _views_plus(_employer_split_sql(0.15, True), """
select company_name, count(distinct partition) as n_partitions from split
where partition <> 'dropped' and company_name is not null group by 1 having count(distinct partition) > 1""",
                                           "labelled"))
def q_partition_leakage(spark, d):
    return splitting.partition_leakage(q_split_by_employers(spark, d))


@register("partition_counts", _views_plus(_employer_split_sql(0.15, True),
                                          "select partition, count(*) as n from split group by 1", "labelled"))
def q_partition_counts(spark, d):
    return splitting.partition_counts(q_split_by_employers(spark, d))


def _quota_sql(name: str, counts: str, ncol: str, total: str, draw: str, out: str) -> str:
    return f"""{name} as (select * exclude (_b, _r, _rk, _short), _b + case when _rk <= _short then 1 else 0 end as {out}
  from (select *, row_number() over (order by _r desc, industry) as _rk,
               {draw} - sum(_b) over () as _short
        from (select *, ({ncol} * {draw}) // {total} as _b, ({ncol} * {draw}) % {total} as _r from {counts})))"""


@register("split_random_stratified", _views_plus(f""",
rs_base as (select uniq_id, industry from labelled where industry is not null),
rs_cnt as (select industry, count(*) as n from rs_base group by 1),
rs_n as (select sum(n) as n, cast(ceil(sum(n) * cast(0.15 as double)) as bigint) as nt from rs_cnt),
{_quota_sql('rs_q1', 'rs_cnt', 'n', '(select n from rs_n)', '(select nt from rs_n)', 'qt')},
rs_rest as (select *, n - qt as nr from rs_q1),
rs_nv as (select cast(ceil(((select n from rs_n) - (select nt from rs_n)) * cast(0.25 as double)) as bigint) as nv),
{_quota_sql('rs_q2', 'rs_rest', 'nr', '((select n from rs_n) - (select nt from rs_n))', '(select nv from rs_nv)', 'qv')},
rs_rank as (select b.*, row_number() over (partition by industry order by md5(concat('10082023:', uniq_id)), uniq_id) as r
            from rs_base b)""", """
select r.uniq_id, r.industry, case when r <= qt then 'test' when r <= qt + qv then 'validation' else 'train' end
  as partition from rs_rank r join rs_q2 q using (industry)""", "labelled"))
def q_split_random_stratified(spark, d):
    df = labelled_only(spark, d).select("uniq_id", "industry")
    return splitting.random_stratified_split(df, "industry", "uniq_id", True, 0.15, 0.25, seed=10082023)


@register("split_three_way", """
with b as (select doc_id from documents),
n as (select cast(round_even(count(*) * cast(0.15 as double), 0) as bigint) as nt from b),
r as (select doc_id, row_number() over (order by md5(concat('10032023:', cast(doc_id as varchar))),
      cast(doc_id as varchar)) as rk from b)
select doc_id, case when rk <= nt then 'test' when rk <= 2 * nt then 'validation' else 'train' end as partition
from r, n""")
def q_split_three_way(spark, d):
    df = fx.table(spark, d, "documents").select("doc_id")
    return splitting.three_way_split(df, "doc_id", 0.15, seed=10032023)


# ---------------------------------------------------------------- class-level aggregates

@register("label_index", S.with_views("""
select industry as label, cast(row_number() over (order by industry) - 1 as integer) as idx
from (select distinct industry from labelled where industry is not null)""", "labelled"))
def q_label_index(spark, d):
    return evaluate.label_index(labelled_only(spark, d))


@register("class_distribution", S.with_views("""
select industry, count(*) as n from labelled where industry is not null group by 1""", "labelled"))
def q_class_distribution(spark, d):
    return evaluate.class_distribution(labelled_only(spark, d))


@register("baseline_accuracy", S.with_views("""
select round(max(n) / sum(n), 6) as zero_r, round(sum(n * n) / (sum(n) * sum(n)), 6) as random_guess
from (select industry, count(*) as n from labelled where industry is not null group by 1)""", "labelled"))
def q_baseline_accuracy(spark, d):
    b = evaluate.baseline_accuracy(labelled_only(spark, d))
    return b.select(F.round("zero_r", 6).alias("zero_r"), F.round("random_guess", 6).alias("random_guess"))


@register("distinct_employers", S.with_views("""
select company_name, uniq_id from (
  select company_name, uniq_id, row_number() over (partition by company_name
         order by md5(concat('4082023:', uniq_id)), uniq_id) as rn
  from unique_postings where company_name is not null) x where rn = 1""", "unique_postings"))
def q_distinct_employers(spark, d):
    return voting.one_per_employer(unique_postings(spark, d), "uniq_id").select("company_name", "uniq_id")


@register("rows_and_employers", S.with_views("""
select count(*) as n_rows, count(distinct company_name) as n_employers from unique_postings""",
                                             "unique_postings"))
def q_rows_and_employers(spark, d):
    return voting.rows_and_employers(unique_postings(spark, d))


# ---------------------------------------------------------------- with-replacement draws

def _draw_sql(src: str, key: str, seed, n_expr: str, out: str) -> str:
    return f"""{out}_ix as (select *, row_number() over (order by md5(concat('{seed}:', cast({key} as varchar))),
      cast({key} as varchar)) as _idx from {src}),
{out}_n as (select count(*) as nn from {src}),
{out}_dr as (select (cast(('0x' || substr(md5(concat('{seed}:draw:', cast(i as varchar))), 1, 15)) as bigint)
      % (select nn from {out}_n)) + 1 as _idx from range(cast({n_expr} as bigint)) t(i)),
{out} as (select x.* exclude (_idx), cast(row_number() over (partition by x._idx) - 1 as integer) as copy
      from {out}_ix x join {out}_dr d on x._idx = d._idx)"""


@register("sample_with_replacement", _views_plus(",\n" + _draw_sql(
    "(select uniq_id, text_language from unique_postings)", "uniq_id", 1,
    "(select count(*) from unique_postings)", "boot"),
    "select uniq_id, text_language, copy from boot", "unique_postings"))
def q_sample_with_replacement(spark, d):
    u = unique_postings(spark, d).select("uniq_id", "text_language")
    n = u.count()
    return sampling.sample_with_replacement(u, n, "uniq_id", seed=1, copy_col="copy")


def _rebalance_sql(seed=10032023, share=0.25) -> str:
    return f"""rb_src as (select doc_id, text, lang as labels from documents),
rb_t as (select * from rb_src where labels = 'en'),
rb_o as (select * from rb_src where labels <> 'en' or labels is null),
rb_k as (select cast(round_even((1 - cast({share} as double)) * ((select count(*) from rb_t) / cast({share} as double)), 0)
         as bigint) as k),
{_draw_sql('rb_o', 'doc_id', seed, '(select k from rb_k)', 'rb_d')},
rebalanced as (select *, 0 as copy from rb_t union all select * from rb_d)"""


@register("rebalance_target_share", "with " + _rebalance_sql() + """
select doc_id, labels, cast(copy as integer) as copy from rebalanced""")
def q_rebalance_target_share(spark, d):
    out = sampling.rebalance(corpus(spark, d), "labels", "doc_id", "en", 0.25, 10032023, copy_col="copy")
    return out.select("doc_id", "labels", F.col("copy").cast("int").alias("copy"))


# ---------------------------------------------------------------- vocabulary and sequences

def _vocab_sql(max_tokens: int, out: str = "vocab", src: str = "documents") -> str:
    return f"""{out}_t as (select doc_id, unnest(tk) as token, generate_subscripts(tk, 1) as pos
   from (select doc_id, {S.tokens('text')} as tk from {src})),
{out}_a as (select token, count(*) as n from {out}_t group by 1),
{out}_f as (select token, doc_id as fd, pos as fp from (select token, doc_id, pos,
   row_number() over (partition by token order by doc_id, pos) as rn from {out}_t) z where rn = 1),
{out}_r as (select token, cast(row_number() over (order by n desc, fd, fp) + 1 as integer) as id
   from {out}_a join {out}_f using (token)),
{out} as (select token, id from {out}_r where id <= {max_tokens - 1}
   union all select '<pad>', 0 union all select '<unk>', 1)"""


@register("token_counts", f"""
select token, count(*) as n from (select unnest({S.tokens('text')}) as token from documents) group by 1""")
def q_token_counts(spark, d):
    from ..operators.vocabulary import token_counts
    return token_counts(fx.table(spark, d, "documents"), "doc_id", "text").select("token", "n")


@register("vocabulary", "with " + _vocab_sql(50000) + "\nselect token, id from vocab")
def q_vocabulary(spark, d):
    return build_vocabulary(fx.table(spark, d, "documents"), "doc_id", "text", 50000)


@register("vocabulary_top", "with " + _vocab_sql(500) + "\nselect token, id from vocab")
def q_vocabulary_top(spark, d):
    return build_vocabulary(fx.table(spark, d, "documents"), "doc_id", "text", 500)


def _encode_sql(src: str, key: str, vocab: str, seq: int | None, out: str) -> str:
    trunc = f"list_slice({S.tokens('text')}, 1, {seq})" if seq else S.tokens("text")
    ids = f"list(coalesce(v.id, 1) order by e.pos)"
    pad = (f"list_concat(list_slice(ids, 1, {seq}), list_resize([0], greatest({seq} - len(ids), 0), 0))"
           if seq else "ids")
    return f"""{out}_e as (select {key} as _k, unnest(tk) as token, generate_subscripts(tk, 1) as pos
   from (select {key}, {trunc} as tk from {src})),
{out}_g as (select s.{key} as _k, coalesce((select {ids} from {out}_e e left join {vocab} v on v.token = e.token
   where e._k = s.{key}), []) as ids from {src} s),
{out} as (select _k, {pad} as ids from {out}_g)"""


@register("encode_tokens", "with " + _vocab_sql(500) + ",\n" + _encode_sql("documents", "doc_id", "vocab", None, "enc")
          + "\nselect _k as doc_id, array_to_string(ids, ' ') as ids from enc")
def q_encode_tokens(spark, d):
    docs = fx.table(spark, d, "documents")
    vocab = build_vocabulary(docs, "doc_id", "text", 500)
    enc = encode_tokens(docs, "doc_id", "text", vocab)
    return enc.select("doc_id", F.array_join("ids", " ").alias("ids"))


@register("pad_sequences", "with " + _vocab_sql(500) + ",\n" + _encode_sql("documents", "doc_id", "vocab", 30, "enc")
          + "\nselect _k as doc_id, array_to_string(ids, ' ') as ids from enc")
def q_pad_sequences(spark, d):
    docs = fx.table(spark, d, "documents")
    vocab = build_vocabulary(docs, "doc_id", "text", 500)
    enc = encode_tokens(docs, "doc_id", "text", vocab, sequence_length=30)
    return enc.select("doc_id", F.array_join("ids", " ").alias("ids"))


@register("longest_sequence", f"""
select cast(max(len({S.tokens('text')})) as bigint) as max_len from documents""")
def q_longest_sequence(spark, d):
    docs = fx.table(spark, d, "documents").select("doc_id", T.word_tokens("text").alias("ids"))
    return docs.agg(F.max(F.size("ids")).cast("bigint").alias("max_len"))


# ---------------------------------------------------------------- models and flows

def industry_train(spark, d) -> DataFrame:
    """E1 over the fixtures."""
    return flows.build_training_data(_jp(spark, d), _pc(spark, d), fx.label_companies(spark),
                                     fx.label_patterns(spark))


def industry_model(spark, d) -> classify.NaiveBayesModel:
    """M4/M9: NB on all of E1 (names blinded, first 128 tokens)."""
    tr = flows.blinded(industry_train(spark, d)).withColumn("_toks", flows.model_tokens())
    return classify.train_naive_bayes(tr, "industry", tokens_col="_toks")


def _e1_sql_head(*views: str) -> str:
    head = S.with_views("select 1", "labelled", *views)[:-len("select 1")].rstrip()
    return head + ",\n" + S.industry_train()


_TRUNC_DESC = S.trunc_tokens("employer_description")
_MODEL_TRAIN = f""",
m_train as (select industry, {S.blind('employer_description', 'company_name')} as employer_description
  from industry_train)"""


@register("build_training_data", _e1_sql_head() + """
select uniq_id, employer_description, company_name, industry from industry_train""")
def q_build_training_data(spark, d):
    return industry_train(spark, d)


@register("train_industry_nb", _e1_sql_head() + _MODEL_TRAIN + ",\n" + S.naive_bayes(
    "nb", "m_train", "industry", S.trunc_tokens("employer_description"), "m_train", "industry",
    S.trunc_tokens("employer_description")) + """
select k.label, cast(d.d as bigint) as docs, cast(k.n as bigint) as n_tokens, round(k.prior, 6) as prior,
  cast(k.v as bigint) as vocab_size from nb_cls k join nb_docs d using (label)""")
def q_train_industry_nb(spark, d):
    m = industry_model(spark, d)
    return m.classes.select("label", "docs", "n_tokens", F.round("prior", 6).alias("prior"),
                            F.lit(m.vocab_size).cast("bigint").alias("vocab_size"))


def _predict_sql(select: str) -> str:
    head = _e1_sql_head("unique_postings") + _MODEL_TRAIN + ",\n" + S.extraction("unique_postings", "ed")
    test = f""",
p_in as (select uniq_id, list_slice({S.tokens("coalesce(nullif(employer_description, ''), 'no relevant information')")},
  1, 128) as toks from ed),
"""
    nb = S.naive_bayes("nb", "m_train", "industry", S.trunc_tokens("employer_description"), "p_in", "uniq_id", "toks")
    return head + test + nb + "\n" + select


@register("predict_industry", _predict_sql("select _k as uniq_id, prediction from nb_pred"))
def q_predict_industry(spark, d):
    out = flows.classify_postings(industry_model(spark, d), unique_postings(spark, d))
    return out.select("uniq_id", "prediction")


@register("predict_scores", _predict_sql("""
select p._k as uniq_id, p.prediction, round(s.score, 6) as score, round(s.raw_top, 4) as raw_top
from nb_pred p join (select _k, max(prob) as score, max(score) as raw_top from nb_prob group by 1) s using (_k)"""))
def q_predict_scores(spark, d):
    out = flows.classify_postings(industry_model(spark, d), unique_postings(spark, d), return_probas=True)
    return out.select("uniq_id", "prediction", F.round("score", 6).alias("score"),
                      F.round(F.array_max("raw_scores"), 4).alias("raw_top"))


@register("detect_language", "with " + S.naive_bayes(
    "nb", "documents", "lang", S.tokens("text"), "documents", "doc_id", S.tokens("text")) + """
select _k as doc_id, case when max(prob) > 0.75 then arg_max(label, prob) end as language
from nb_prob group by 1""")
def q_detect_language(spark, d):
    docs = fx.table(spark, d, "documents")
    model = classify.train_naive_bayes(docs, "lang", text_col="text")
    return classify.detect_language(model, docs, "doc_id", "text", 0.75).select("doc_id", "language")


def _e2_sql(level: str | None, select: str) -> str:
    if level in (None, "nace"):
        mapped = "industry"
        join = ""
    else:
        mapped = "coalesce(mp.target, it.industry)"
        join = f"left join {_mapping_values()} mp on mp.level = {S.q(level)} and mp.industry = it.industry"
    head = _e1_sql_head()
    body = f""",
e2_rl as (select it.uniq_id, it.employer_description, it.company_name, {mapped} as industry
  from industry_train it {join}),
e2_cap as (select * exclude (rn) from (select *, row_number() over (partition by industry
  order by md5(concat('4082023:', uniq_id)), uniq_id) as rn from e2_rl where industry is not null) z where rn <= 500),
e2_b as (select uniq_id, {S.blind('employer_description', 'company_name')} as employer_description, company_name,
  industry from e2_cap)"""
    split = _employer_split_sql(0.2, False, src="e2_b", cols="uniq_id, employer_description, company_name, industry")
    rest = f""",
e2_tr as (select * from split where partition = 'train'),
e2_te as (select * from split where partition = 'test'),
{S.naive_bayes('nb', 'e2_tr', 'industry', _TRUNC_DESC, 'e2_te', 'uniq_id', _TRUNC_DESC)},
pairs as (select te.industry as t, p.prediction as p from e2_te te left join nb_pred p on p._k = te.uniq_id),
classes as (select distinct industry as class from e2_b),
{S.report('pairs', 'classes')}
"""
    return head + body + split + rest + select


def _e2(spark, d, level):
    return flows.train_eval_level(industry_train(spark, d), level_mapping(spark), level)


@register("classification_report", _e2_sql("nace", "select * from rep"))
def q_classification_report(spark, d):
    return _e2(spark, d, "nace").report


@register("train_eval_macro", _e2_sql("macro", "select * from rep"))
def q_train_eval_macro(spark, d):
    return _e2(spark, d, "macro").report


@register("train_eval_pharma", _e2_sql("pharma", "select * from rep"))
def q_train_eval_pharma(spark, d):
    return _e2(spark, d, "pharma").report


def _e3_targets(spark, d) -> DataFrame:
    """Employers no rule labels: the ones a user would classify."""
    return (labelled_postings(spark, d).filter(F.col("industry").isNull() & F.col("company_name").isNotNull())
            .select("company_name").distinct())


_E3_SQL = (_e1_sql_head("job_postings", "position_characteristics") + _MODEL_TRAIN + """,
e3_targets as (select distinct company_name from labelled where industry is null and company_name is not null),
e3_posts as (select jp.uniq_id, jp.text_language, jp.job_description, pc.company_name
  from (select * from job_postings where unique_posting_text = 'yes' and uniq_id in (
    select uniq_id from position_characteristics where company_name in (select company_name from e3_targets))) jp
  left join position_characteristics pc on jp.uniq_id = pc.uniq_id),
e3_cap as (select * exclude (rn) from (select *, row_number() over (partition by company_name
  order by md5(concat('4082023:', uniq_id)), uniq_id) as rn from e3_posts where company_name is not null) z
  where rn <= 3),
""" + S.extraction("e3_cap", "e3_x") + f""",
e3_in as (select uniq_id, company_name, list_slice({S.tokens("coalesce(nullif(employer_description, ''), 'no relevant information')")},
  1, 128) as toks from e3_x),
""" + S.naive_bayes("nb", "m_train", "industry", _TRUNC_DESC, "e3_in", "uniq_id", "toks") + """
select company_name, industry from (
  select i.company_name, p.prediction as industry,
    row_number() over (partition by i.company_name order by count(*) desc, p.prediction) as rn
  from e3_in i join nb_pred p on p._k = i.uniq_id group by i.company_name, p.prediction) z where rn = 1""")


@register("classify_employers", _E3_SQL)
def q_classify_employers(spark, d):
    return flows.classify_employers(_jp(spark, d), _pc(spark, d), _e3_targets(spark, d), industry_model(spark, d))


# ---------------------------------------------------------------- English detector

def _e4_sql(select: str, first_token: bool = False) -> str:
    feats = "list_transform(list_filter(ids, lambda x: x <> 0), lambda x: cast(x as varchar))"
    if first_token:
        feats = f"list_slice({feats}, 1, 1)"
    return ("with " + _vocab_sql(50000) + ",\n" + _rebalance_sql() + f""",
e4_k as (select doc_id, text, labels, concat_ws(':', cast(doc_id as varchar), cast(copy as varchar)) as row_key
  from rebalanced),
e4_n as (select cast(round_even(count(*) * cast(0.15 as double), 0) as bigint) as nt from e4_k),
e4_s as (select e4_k.*, case when rk <= nt then 'test' when rk <= 2 * nt then 'validation' else 'train' end as partition
  from (select *, row_number() over (order by md5(concat('10032023:', row_key)), row_key) as rk from e4_k) e4_k, e4_n),
""" + _encode_sql("e4_s", "row_key", "vocab", 30, "enc").replace("{key}", "row_key") + f""",
e4_d as (select s.row_key, s.labels, s.partition, e.ids, case when s.labels = 'en' then 1 else 0 end as y,
  cast(case when s.labels = 'en' then 1 else 0 end as varchar) as ys, {feats} as f
  from e4_s s join enc e on e._k = s.row_key),
e4_tr as (select * from e4_d where partition = 'train'),
e4_te as (select * from e4_d where partition <> 'train'),
""" + S.naive_bayes("nb", "e4_tr", "ys", "f", "e4_te", "row_key", "f") + """,
e4_p as (select t.row_key, t.partition, t.y, coalesce(p.prob, 0.0) as p from e4_te t
  left join (select _k, prob from nb_prob where label = '1') p on p._k = t.row_key),
e4_l as (select *, -(y * (case when p <= 0 then -100 else greatest(ln(p), -100) end)
  + (1 - y) * (case when 1 - p <= 0 then -100 else greatest(ln(1 - p), -100) end)) as loss,
  case when (case when p >= 0.5 then 1 else 0 end) = y then 1.0 else 0.0 end as hit from e4_p)
""" + select)


def _e4(spark, d, features="all"):
    return flows.english_detection(corpus(spark, d), features=features)


@register("english_eval", _e4_sql("""
select partition, round(avg(loss), 3) as loss, round(avg(hit), 3) as accuracy, count(*) as n
from e4_l group by 1"""))
def q_english_eval(spark, d):
    return _e4(spark, d).evaluation


@register("english_eval_first_token", _e4_sql("""
select partition, round(avg(loss), 3) as loss, round(avg(hit), 3) as accuracy, count(*) as n
from e4_l group by 1""", first_token=True))
def q_english_eval_first_token(spark, d):
    return _e4(spark, d, "first_token").evaluation


@register("detect_english", _e4_sql("""
select row_key, partition, y, case when p >= 0.5 then 1 else 0 end as is_english from e4_l"""))
def q_detect_english(spark, d):
    sc = _e4(spark, d).scored
    return sc.select("row_key", "partition", "y", P.decide("p").alias("is_english"))


@register("labelled_features", _e4_sql("""
select row_key, y, array_to_string(ids, ' ') as ids from e4_d where partition = 'train'"""))
def q_labelled_features(spark, d):
    data = _e4(spark, d).data
    return data.filter(F.col("partition") == "train").select("row_key", "y", F.array_join("ids", " ").alias("ids"))


# ---------------------------------------------------------------- epochs of the English detector

EPOCHS, RATE = 4, 8.0


def _epochs_sql(select: str) -> str:
    """Gradient descent unrolled: logits, errors, gradient and next weights of each epoch."""
    steps = ["""
ep_e as (select row_key, partition, y, f from e4_d where partition in ('train', 'validation')),
ep_r as (select row_key, partition, y, feature, sum(x) as x from (
    select row_key, partition, y, unnest(f) as feature, 1.0::double / len(f) as x from ep_e where len(f) > 0
    union all select row_key, partition, y, '<bias>', 1.0::double from ep_e) group by all),
ep_n as (select greatest(count(*), 1) as n from ep_e where partition = 'train'),
ep_w0 as (select distinct feature, 0.0::double as w from ep_r)"""]
    for e in range(EPOCHS + 1):
        steps.append(f"""ep_p{e} as (select row_key, partition, y, 1.0::double / (1.0::double + exp(-sum(x * w))) as p
  from ep_r join ep_w{e} using (feature) group by all)""")
        if e < EPOCHS:
            steps.append(f"""ep_w{e + 1} as (select w.feature, w.w - {RATE}::double / ep_n.n * coalesce(g.g, 0) as w from ep_n, ep_w{e} w left join
  (select feature, sum(x * (p - r.y)) as g from ep_r r join ep_p{e} q on q.row_key = r.row_key and r.partition = 'train' group by feature) g using (feature))""")
        if e:
            steps.append(f"""ep_h{e} as (select {e} as epoch,
  avg(loss) filter (partition = 'train') as train_loss, avg(hit) filter (partition = 'train') as train_accuracy,
  avg(loss) filter (partition = 'validation') as validation_loss, avg(hit) filter (partition = 'validation') as validation_accuracy
  from (select partition, -(y * greatest(ln(p), -100) + (1 - y) * greatest(ln(1 - p), -100)) as loss,
        case when (p >= 0.5) = (y = 1) then 1.0::double else 0.0::double end as hit from ep_p{e}))""")
    return _e4_sql("").rstrip() + "," + ",\n".join(steps) + select


_HISTORY = " union all ".join(f"select cast(epoch as integer) as epoch, round(train_loss, 6) as train_loss, round(train_accuracy, 6) as train_accuracy, "
                              f"round(validation_loss, 6) as validation_loss, round(validation_accuracy, 6) as validation_accuracy from ep_h{e}"
                              for e in range(1, EPOCHS + 1))


def _trained_epochs(spark, d):
    from ..operators.epochs import train_epochs
    data = _e4(spark, d).data.withColumn("_feats", F.transform(F.filter(F.col("ids"), lambda x: x != 0), lambda x: x.cast("string")))
    return train_epochs(data, "row_key", "y", "partition", "_feats", EPOCHS, RATE), data


@register("english_epoch_history", _epochs_sql("\n" + _HISTORY))
def q_english_epoch_history(spark, d):
    """Loss and accuracy of training and validation rows after every epoch."""
    h = _trained_epochs(spark, d)[0].history
    return h.select("epoch", *[F.round(c, 6).alias(c) for c in h.columns[1:]])


@register("english_epoch_test", _epochs_sql(f"""
select e.row_key, e.y, round(1.0::double / (1.0::double + exp(-sum(r.x * coalesce(w.w, 0)))), 6) as p
from (select row_key, y, f from e4_d where partition = 'test') e
join (select row_key, feature, sum(x) as x from (
    select row_key, unnest(f) as feature, 1.0::double / len(f) as x from e4_d where partition = 'test' and len(f) > 0
    union all select row_key, '<bias>', 1.0::double from e4_d where partition = 'test') group by all) r on r.row_key = e.row_key
left join ep_w{EPOCHS} w on w.feature = r.feature group by e.row_key, e.y"""))
def q_english_epoch_test(spark, d):
    """Sigmoid scores of the test rows with the weights of the last epoch."""
    from ..operators.epochs import probabilities
    trained, data = _trained_epochs(spark, d)
    test = data.filter(F.col("partition") == "test")
    return test.select("row_key", "y").join(probabilities(trained.weights, test, "row_key", "_feats"), "row_key") \
        .select("row_key", "y", F.round("p", 6).alias("p"))


# ---------------------------------------------------------------- sources and sinks

from ..sources import files  # noqa: E402


@register("csv_roundtrip", ORACLE["build_training_data"])
def q_csv_roundtrip(spark, d):
    path = files.scratch_table_path(spark, "industry_train_csv")
    files.write_table(industry_train(spark, d), path, fmt="csv")
    return files.read_csv(spark, path, files.INDUSTRY_TRAIN_SCHEMA)


@register("model_roundtrip", ORACLE["predict_industry"])
def q_model_roundtrip(spark, d):
    path = files.scratch_table_path(spark, "nb_model")
    classify.save_model(industry_model(spark, d), path, level="nace")
    model = classify.load_model(spark, path, level="nace")
    return flows.classify_postings(model, unique_postings(spark, d)).select("uniq_id", "prediction")


@register("vocabulary_roundtrip", ORACLE["encode_tokens"])
def q_vocabulary_roundtrip(spark, d):
    docs = fx.table(spark, d, "documents")
    path = files.scratch_table_path(spark, "vocabulary")
    files.save_vocabulary(build_vocabulary(docs, "doc_id", "text", 500), path)
    enc = encode_tokens(docs, "doc_id", "text", files.load_vocabulary(spark, path))
    return enc.select("doc_id", F.array_join("ids", " ").alias("ids"))


@register("split_roundtrip", S.with_views("""
select uniq_id, industry from labelled where industry is not null""", "labelled"))
def q_split_roundtrip(spark, d):
    """Write each partition of a split to its own folder, read them back stacked."""
    parts = splitting.three_way_split(labelled_only(spark, d).select("uniq_id", "industry"), "uniq_id", 0.15)
    base = files.scratch_table_path(spark, "splits")
    parts.write.mode("overwrite").partitionBy("partition").parquet(base)
    paths = {p: f"{base}/partition={p}" for p in ("train", "validation", "test")}
    return files.read_splits(spark, paths, schema="uniq_id string, industry string").select("uniq_id", "industry")


# ---------------------------------------------------------------- Spark ML variant and scorer hook

@register("industry_logreg")
def q_industry_logreg(spark, d):
    """M4 alternative: HashingTF -> LogisticRegression on the employer split (rows only)."""
    from ..operators.mlmodels import fit_logreg, predict_logreg
    res = _e2_inputs(spark, d)
    model = fit_logreg(res.filter(F.col("partition") == "train"), "industry", "_toks")
    return predict_logreg(model, res.filter(F.col("partition") == "test"), "uniq_id", "_toks")


@register("logreg_history")
def q_logreg_history(spark, d):
    """Per-iteration objective of the logistic regression (rows only)."""
    from ..operators.mlmodels import fit_logreg, objective_history
    res = _e2_inputs(spark, d)
    return objective_history(spark, fit_logreg(res.filter(F.col("partition") == "train"), "industry", "_toks"))


def _e2_inputs(spark, d) -> DataFrame:
    from ..session import shared_dir
    shared_dir(spark)
    df = flows.blinded(industry_train(spark, d)).checkpoint(eager=True)
    parts = splitting.split_by_employers(df, validation_set=False, test_size=0.2)
    return parts.withColumn("_toks", flows.model_tokens())


@register("scorer_hook", _employer_description_sql())
def q_scorer_hook(spark, d):
    """The residual pass through an Arrow-batched Python scorer."""
    from ..operators.extraction import pandas_scorer, python_cue_predict
    out = extract_employer_description(unique_postings(spark, d), scorer=pandas_scorer(python_cue_predict))
    return out.select("uniq_id", "employer_description", F.array_join("retrieved_by", ",").alias("retrieved_by"))


_TWO_EMPLOYERS = S.with_views("select 1", "unique_postings")[:-len("select 1")].rstrip() + """,
second as (select concat('p', cast(d.doc_id as varchar(20))) as uniq_id, p_name as company_name from documents d join part on p_partkey = d.doc_id + 1),
two as (select jp.uniq_id, jp.text_language, jp.job_description, pc.company_name from (select * from job_postings where unique_posting_text = 'yes') jp
  left join (select * from position_characteristics union all select * from second) pc on jp.uniq_id = pc.uniq_id)"""


def two_employers(spark, d) -> DataFrame:
    """Unique postings whose employer table names a second employer for each of them (J1 as 1:n, Q8)."""
    docs = fx.table(spark, d, "documents").select("doc_id")
    part = fx.table(spark, d, "part").select((F.col("p_partkey") - 1).alias("doc_id"), F.col("p_name").alias("company_name"))
    second = docs.join(part, "doc_id").select(F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("uniq_id"), "company_name")
    return postings.get_postings(_jp(spark, d), _pc(spark, d).unionByName(second), institution_name=True)


@register("two_employers_scan", _TWO_EMPLOYERS + """
select uniq_id, company_name, length(job_description) as n_chars from two""")
def q_two_employers_scan(spark, d):
    return two_employers(spark, d).select("uniq_id", "company_name", F.length("job_description").cast("bigint").alias("n_chars"))


@register("two_employers_description", _TWO_EMPLOYERS + ",\n" + S.extraction("two", "ed") + """
select uniq_id, company_name, employer_description, retrieved_by from ed""")
def q_two_employers_description(spark, d):
    """X1 over postings with two employers: each row keeps its own employer's sentences."""
    from ..operators.extraction import pandas_scorer, python_cue_predict
    out = extract_employer_description(two_employers(spark, d), scorer=pandas_scorer(python_cue_predict))
    return out.select("uniq_id", "company_name", "employer_description", F.array_join("retrieved_by", ",").alias("retrieved_by"))


@register("pattern_index", S.with_views("""
select distinct p.industry, c.company_name, p.pattern
from (select distinct company_name from position_characteristics where company_name is not null) c
join (select industry, pattern from label_patterns union select p_brand, substr(split_part(p_name, ' ', 2), 1, 1 + p_size % 4) from part) p
on c.company_name ilike concat('% ', p.pattern, '%') escape '@'""", "position_characteristics", "label_patterns"))
def q_pattern_index(spark, d):
    """J4 by the index: a dictionary with the beginnings of the second words of each brand's part names."""
    word = F.get(F.split("p_name", " "), F.lit(1))
    brands = fx.table(spark, d, "part").select(F.col("p_brand").alias("industry"), F.lit(100).alias("industry_rank"),
                                               F.substr(word, F.lit(1), (F.col("p_size") % 4 + 1).cast("int")).alias("pattern"))
    table = fx.label_patterns(spark).unionByName(brands)
    return labelling.indexed_matches(_pc(spark, d), table).select("industry", "company_name", "pattern")


@register("retrain_full_report", _e2_sql("nace", "select * from rep").replace(
    "e2_tr as (select * from split where partition = 'train')", "e2_tr as (select * from split)"))
def q_retrain_full_report(spark, d):
    """M9: the model refit on every partition, reported on the test partition."""
    return flows.train_eval_level(industry_train(spark, d), level_mapping(spark), "nace", retrain_full=True).report


@register("peek_training_data", _e1_sql_head() + """
select uniq_id, employer_description, company_name, industry from industry_train order by uniq_id limit 5""")
def q_peek_training_data(spark, d):
    """The first rows of the training data (ordered, so the peek repeats)."""
    return files.peek(industry_train(spark, d).orderBy("uniq_id"), 5)


@register("train_eval_meso", _e2_sql("meso", "select * from rep"))
def q_train_eval_meso(spark, d):
    return _e2(spark, d, "meso").report


@register("default_text", S.with_views("""
select uniq_id, coalesce(nullif(d, ''), 'no relevant information') as model_text
from (select uniq_id, array_to_string(list_filter({s}, lambda x: length(company_name) > 0
        and contains(lower(x), lower(company_name))), ' ') as d from unique_postings)"""
                                       .replace("{s}", S.sentences("job_description")), "unique_postings"))
def q_default_text(spark, d):
    """P10: the model input text when no description was found."""
    u = unique_postings(spark, d)
    desc = sentences_by_name(T.split_sentences("job_description"), F.col("company_name"))
    return u.select("uniq_id", P.default_text(desc).alias("model_text"))


@register("baseline_accuracy_compat", S.with_views("""
select round(max(n) / sum(n), 6) as zero_r, round(sum(n) / (sum(n) * sum(n)), 6) as random_guess
from (select industry, count(*) as n from labelled where industry is not null group by 1)""", "labelled"))
def q_baseline_accuracy_compat(spark, d):
    """A7 as the original computes it (Q11): sum(n_k) / n^2 = 1/n."""
    b = evaluate.baseline_accuracy(labelled_only(spark, d), compat=True)
    return b.select(F.round("zero_r", 6).alias("zero_r"), F.round("random_guess", 6).alias("random_guess"))


# ---------------------------------------------------------------- all levels, JSON dictionaries, more dispatch

LEVELS = ("nace", "meso", "macro", "pharma")


def _level_train_sql(level: str) -> str:
    head = _e2_sql(level, "")
    return head[:head.index(",\nsp_base as")]


def _predict_level_sql(level: str) -> str:
    return (_level_train_sql(level) + ",\n" + S.extraction("unique_postings", "ed") + f""",
p_in as (select uniq_id, list_slice({S.tokens("coalesce(nullif(employer_description, ''), 'no relevant information')")},
  1, 128) as toks from ed),
""" + S.naive_bayes("nb", "e2_b", "industry", _TRUNC_DESC, "p_in", "uniq_id", "toks")
            + f"\nselect {S.q(level)} as level, _k as uniq_id, prediction from nb_pred")


@register("predict_all_levels", "\nunion all\n".join(f"select * from ({_predict_level_sql(x)}) q_{x}" for x in LEVELS))
def q_predict_all_levels(spark, d):
    """M9, S9, M5 at every level: fit, save under one path, reload each, classify all postings."""
    path = files.scratch_table_path(spark, "nb_levels")
    shared_dir(spark)
    train, mapping = industry_train(spark, d).checkpoint(eager=True), level_mapping(spark)     # read by every level
    for level in LEVELS:
        df = flows.blinded(sampling.subsample(labelling.relabel(train, mapping, level), "industry", "uniq_id"))
        model = classify.train_naive_bayes(df.withColumn("_toks", flows.model_tokens()), "industry", tokens_col="_toks")
        classify.save_model(model, path, level)
    models = {level: classify.load_model(spark, path, level) for level in LEVELS}
    return flows.classify_levels(models, unique_postings(spark, d)).select("level", "uniq_id", "prediction")


# Label files of the JSON query: the pattern file has its own industry order, and "rod" and "ring" match several.
JSON_COMPANIES = {"manufacturing": ["red widget", "blue bolt"], "pharmaceutical and life sciences": ["hot gizmo"],
                  "medtech": ["red widget", "new gear"], "financial and insurance": ["old ring"]}
JSON_PATTERNS = {"research and academia": ["rod", "gear", "ring"], "real estate": ["plate", "rod"], "financial and insurance": ["anvil", "bolt"]}
for _industry, _names in NAME_PATTERNS.items():      # and the shipped name patterns behind them
    JSON_PATTERNS[_industry] = JSON_PATTERNS.get(_industry, []) + _names
_JSON_RANKS = {x: i + 1 for i, x in enumerate([*JSON_COMPANIES, *(x for x in JSON_PATTERNS if x not in JSON_COMPANIES)])}


def _json_values(entries: dict, column: str) -> str:
    rows = ", ".join(f"({S.q(i)}, {_JSON_RANKS[i]}, {S.q(x)})" for i, xs in entries.items() for x in xs)
    return f"(select * from (values {rows}) t(industry, industry_rank, {column}))"


@register("json_dictionary_labels", S.with_views(f"""
select u.uniq_id, u.company_name, (select arg_min(industry, industry_rank) from (
    select industry, industry_rank from {_json_values(JSON_COMPANIES, 'company_name')} c where c.company_name = u.company_name
    union all select industry, industry_rank from {_json_values(JSON_PATTERNS, 'pattern')} p
    where u.company_name ilike concat('% ', p.pattern, '%') escape '@')) as industry
from unique_postings u""", "unique_postings"))
def q_json_dictionary_labels(spark, d):
    """S3: both label files written and read as JSON; industries in one merged order (pattern-only ones last)."""
    base = files.scratch_table_path(spark, "labels_json")
    write_dictionary(spark, JSON_COMPANIES, base, "companies")
    write_dictionary(spark, JSON_PATTERNS, base, "patterns")
    companies, patterns = load_dictionary(spark, base)
    return labelling.label_employers(unique_postings(spark, d), companies, patterns).select("uniq_id", "company_name", "industry")


@register("vocabulary_full", "with " + _vocab_sql(1 << 30) + "\nselect token, id from vocab")
def q_vocabulary_full(spark, d):
    """W3 without a cap: ids of every token by the distributed rank."""
    return build_vocabulary(fx.table(spark, d, "documents"), "doc_id", "text", None)


@register("partition_random", ORACLE["split_random_stratified"])
def q_partition_random(spark, d):
    """L10 with the random split."""
    df = labelled_only(spark, d).select("uniq_id", "industry")
    return splitting.partition_data(df, "industry", "uniq_id", "random", "company_name", True, 0.15, 0.25, seed=10082023)


@register("partition_leakage_random", S.with_views(
    "select 1", "labelled")[:-len("select 1")].rstrip() + ",\nrs as (" + ORACLE["split_random_stratified"] + """)
select l.company_name, count(distinct rs.partition) as n_partitions from rs join labelled l using (uniq_id)
where l.company_name is not null group by 1 having count(distinct rs.partition) > 1""")
def q_partition_leakage_random(spark, d):
    """U4 on a split that leaks: employers whose postings a random split scatters."""
    df = labelled_only(spark, d).select("uniq_id", "industry", "company_name")
    return splitting.partition_leakage(splitting.random_stratified_split(df, "industry", "uniq_id", True, 0.15, 0.25, seed=10082023))


@register("predict_english_new", _e4_sql(f"""
, cv as (select concat_ws(':', cast(conv_id as varchar), cast(turn as varchar)) as row_key, text from conversations),
{_encode_sql("cv", "row_key", "vocab", 30, "enc2")},
e4_nw as (select _k as row_key, list_transform(list_filter(ids, lambda x: x <> 0), lambda x: cast(x as varchar)) as f from enc2),
{S.naive_bayes("nw", "e4_tr", "ys", "f", "e4_nw", "row_key", "f")}
select row_key, case when coalesce(p.prob, 0.0) >= 0.5 then 1 else 0 end as is_english from e4_nw
left join (select _k, prob from nw_prob where label = '1') p on p._k = row_key"""))
def q_predict_english_new(spark, d):
    """M8 inference on texts the detector has not seen: every turn of the conversations."""
    conv = fx.table(spark, d, "conversations").select(
        F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("row_key"), "text")
    return flows.predict_english(_e4(spark, d), conv, "row_key").select("row_key", "is_english")


# ---------------------------------------------------------------- text files, level maps, abbreviations, learned sentences

from ..operators import abbreviations, sentence_model  # noqa: E402
from ..session import shared_dir  # noqa: E402
from ..sources import bucketed, labels  # noqa: E402

_FILE_TEXT = "replace(concat(job_description, chr(10)), chr(10), ' ')"      # a text file ends its last line


def posting_files(spark, d) -> DataFrame:
    """Every unique posting written to a text file of its own and read back (posting, job_description)."""
    path = files.scratch_table_path(spark, "posting_files")
    files.write_text_postings(postings.get_postings(_jp(spark, d)), path, "uniq_id", "job_description")
    return files.read_posting_folders(spark, path)


@register("text_file_scan", S.with_views(f"""
select uniq_id as posting, {_FILE_TEXT} as job_description from job_postings where unique_posting_text = 'yes'""", "job_postings"))
def q_text_file_scan(spark, d):
    """Postings as text files."""
    return posting_files(spark, d)


def _predict_files_sql() -> str:
    head = _e1_sql_head("unique_postings") + _MODEL_TRAIN + f""",
tf as (select uniq_id, {_FILE_TEXT} as job_description, cast(null as varchar) as company_name from job_postings where unique_posting_text = 'yes'),
""" + S.extraction("tf", "ed") + f""",
p_in as (select uniq_id, list_slice({S.tokens("coalesce(nullif(employer_description, ''), 'no relevant information')")},
  1, 128) as toks from ed),
"""
    return (head + S.naive_bayes("nb", "m_train", "industry", _TRUNC_DESC, "p_in", "uniq_id", "toks")
            + "\nselect _k as posting, prediction from nb_pred")


@register("predict_text_files", _predict_files_sql())
def q_predict_text_files(spark, d):
    """S7, M5 without employer names: text files classified by their sentences alone."""
    return flows.classify_postings(industry_model(spark, d), posting_files(spark, d), key_col="posting",
                                   name_col=None).select("posting", "prediction")


@register("relabel_json_maps", ORACLE["relabel_level"])
def q_relabel_json_maps(spark, d):
    """The level maps written and read as JSON, then used to relabel all labelled postings."""
    base = files.scratch_table_path(spark, "level_maps")
    maps = None
    for level, entries in (("meso", MESO_MAPPING), ("macro", MACRO_MAPPING), ("pharma", PHARMA_MAPPING)):
        labels.write_level_mapping(spark, entries, f"{base}/{level}")
        one = labels.load_level_mapping(spark, f"{base}/{level}", level)
        maps = one if maps is None else maps.unionByName(one)
    return labelling.relabel_levels(labelled_only(spark, d).select("uniq_id", "industry"), maps).select("uniq_id", "level", "industry")


@register("abbreviations", "with " + S.abbreviations("documents") + """
select abbreviation, cast(n_stop as bigint) as n_stop, cast(n_plain as bigint) as n_plain, round(score, 6) as score from abbr""")
def q_abbreviations(spark, d):
    """abbreviations learned from all documents."""
    rows = abbreviations.learn_abbreviations(fx.table(spark, d, "documents"))
    return rows.select("abbreviation", "n_stop", "n_plain", F.round("score", 6).alias("score"))


@register("sentences_abbreviations", "with " + S.abbreviations("documents") + f""",
known as (select coalesce(list(abbreviation), []) as known from abbr),
pieces as (select doc_id, {S.sentences('text')} as pieces from documents),
merged as (select doc_id, len(pieces) as n, {S.merged_sentences('pieces', 'known')} as ss from pieces, known)
select doc_id, cast(n as bigint) as n_pieces, cast(len(ss) as bigint) as n_sentences, md5(array_to_string(ss, chr(10))) as digest from merged""")
def q_sentences_abbreviations(spark, d):
    """F1 with learned abbreviations: sentences of all documents."""
    docs = fx.table(spark, d, "documents").select("doc_id", "text")
    rows = abbreviations.sentences_knowing(docs, abbreviations.learn_abbreviations(docs), "doc_id")
    return rows.select("doc_id", F.size(T.split_sentences("text")).cast("bigint").alias("n_pieces"),
                       F.size("sentences").cast("bigint").alias("n_sentences"), F.md5(F.array_join("sentences", "\n")).alias("digest"))


#: A cue table for the fixture's postings: their opening and closing sentences and the goods that employers are named after.
POSTING_CUES = {"who we are": ["join"], "who this is": ["hiring"],
                "industry or sector": ["widget", "bolt", "gizmo", "gear", "ring", "anvil", "plate", "rod"]}
_CUES = "[" + ", ".join(S.q(w) for ws in POSTING_CUES.values() for w in ws) + "]"
_PLAIN = f"list_filter({S.tokens('sentence')}, lambda t: not list_contains({_CUES}, t))"


@register("learned_sentences", S.with_views(f"""
select 1""", "unique_postings")[:-len("select 1")].rstrip() + f""",
ls_a as (select uniq_id, unnest(ss) as sentence, generate_subscripts(ss, 1) - 1 as pos
  from (select uniq_id, {S.sentences("replace(job_description, chr(10), ' ')")} as ss from unique_postings)),
ls as (select *, {S.cue_top_label('sentence', cues=POSTING_CUES)} as cue from ls_a),
ls_train as (select distinct sentence, cue from ls where cue <> 'other'),
ls_open as (select uniq_id || '#' || pos as k, sentence from ls where cue = 'other'),
""" + S.naive_bayes("sm", "ls_train", "cue", _PLAIN, "ls_open", "k", _PLAIN) + """,
sure as (select p._k, p.prediction from sm_pred p join (select _k, max(prob) as prob from sm_prob group by 1) m using (_k) where prob > 0.9)
select uniq_id, cast(pos as bigint) as pos, coalesce(prediction, cue) as label
from ls left join sure on cue = 'other' and _k = uniq_id || '#' || pos""")
def q_learned_sentences(spark, d):
    """M2: the label of every sentence by cue words and, without one, by the model trained on those that have one."""
    u = unique_postings(spark, d)
    long = u.select("uniq_id", F.posexplode(T.split_sentences(T.newline_to_space("job_description"))).alias("pos", "sentence"))
    shared_dir(spark)
    long = sentence_model.told(long, cues=POSTING_CUES).checkpoint(eager=True)      # read by the training, the scoring and the result
    model = sentence_model.train_sentence_model(long, cues=POSTING_CUES)
    score = sentence_model.learned_scorer(model, cues=POSTING_CUES, keys=("uniq_id", "pos"))
    return score(long).select("uniq_id", F.col("pos").cast("bigint").alias("pos"), F.col("top_label").alias("label"))


@register("bucketed_postings", S.with_views("""
select jp.uniq_id, jp.text_language, jp.job_description, pc.company_name
from (select * from job_postings where unique_posting_text='yes') jp
left join position_characteristics pc on jp.uniq_id=pc.uniq_id""", "job_postings", "position_characteristics"))
def q_bucketed_postings(spark, d):
    """Postings and employers written in buckets of the posting id and joined without an exchange."""
    jp = bucketed.write_bucketed(_jp(spark, d).drop("html_job_description"), "postings", "uniq_id")
    pc = bucketed.write_bucketed(_pc(spark, d), "employers", "uniq_id")
    return postings.get_postings(bucketed.read_bucketed(spark, jp), bucketed.read_bucketed(spark, pc), institution_name=True)


@register("predict_subwords")
def q_predict_subwords(spark, d, tokenizer_path: str | None = None):
    """Postings classified by what their first 128 subwords cover (no SQL: the tokenizer's ids)."""
    import public_tokenizers

    path = tokenizer_path or str(public_tokenizers.path("byte_bpe_50k.json"))
    return flows.classify_postings(industry_model(spark, d), unique_postings(spark, d), tokenizer_path=path).select(
        "uniq_id", "company_name", "prediction")
