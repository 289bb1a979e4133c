"""Weak-supervision labelling of employers (P6, J3, J4, U3) and level relabelling.

The company dictionary (D3) is joined by employer name.  A short list of name patterns (D4) becomes
one compiled ``ILIKE`` chain evaluated on each row.  A longer list is an inverted index: patterns are
found by their first characters, which must follow a space of the name, through an equi-join with
the distinct names; only the candidates are compared in full, and each distinct name is tested once,
however many postings it has.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import LIKE_ESCAPE, name_match
from ..functions.sizing import broadcast_if_small

# Patterns up to which the compiled chain is used; more go through the index.
CHAIN_PATTERNS = 64
# Longest prefix of a pattern that is indexed.
INDEXED_CHARS = 16


def _pattern_table(patterns: DataFrame, companies: DataFrame | None, compat: bool) -> DataFrame:
    rows = patterns.select("industry", "industry_rank", "pattern").where(F.col("pattern").isNotNull())
    if compat and companies is not None:
        # Q1: pattern matches of industries that also have a company list are lost.
        rows = rows.join(broadcast_if_small(companies.select("industry").distinct()), "industry", "left_anti")
    return rows


def _pattern_rows(patterns: DataFrame, companies: DataFrame | None, compat: bool) -> list | None:
    """The patterns in rank order, or None when there are too many for a chain."""
    rows = _pattern_table(patterns, companies, compat).limit(CHAIN_PATTERNS + 1).collect()
    return sorted(rows, key=lambda r: (r[1], r[0], r[2])) if len(rows) <= CHAIN_PATTERNS else None


def indexed_matches(names: DataFrame, patterns: DataFrame, anchor: str = "space") -> DataFrame:
    """(company_name, industry, industry_rank, pattern) of every match of the distinct non-null names.

    A name offers, after each space (with ``anchor='word'`` also at its start), the prefixes of the
    lengths that occur among the indexed patterns (at most ``INDEXED_CHARS``); an equi-join finds the patterns that
    begin so, and the comparison of the whole pattern decides.  Patterns that hold LIKE wildcards are indexed
    by the characters before the first of them.
    """
    if anchor not in ("space", "word"):
        raise ValueError("anchor must be 'space' or 'word'")
    wild = F.regexp_substr(F.lower("pattern"), F.lit("^[^%_@]*"))
    listed = (patterns.select("industry", "industry_rank", "pattern", F.substring(F.coalesce(wild, F.lit("")), 1, INDEXED_CHARS).alias("_key"))
              .distinct())
    sizes = sorted(r[0] for r in listed.select(F.length("_key")).distinct().collect())        # at most INDEXED_CHARS + 1
    low = F.lower("company_name")
    distinct = names.select("company_name").where(F.col("company_name").isNotNull()).distinct()
    spots = F.filter(F.sequence(F.lit(0), F.length(low)), lambda i: (F.substr(low, i, F.lit(1)) == F.lit(" ")) if anchor == "space"
                     else (i == 0) | (F.substr(low, i, F.lit(1)) == F.lit(" ")))
    keys = F.array_distinct(F.flatten(F.transform(spots, lambda i: F.filter(
        F.array(*[F.substr(low, i + 1, F.lit(n)) for n in sizes]), lambda k: k.isNotNull()))))
    offered = distinct.select("company_name", F.explode(keys).alias("_key"))
    hit = F.ilike(F.col("company_name"), F.concat(F.lit("% "), F.col("pattern"), F.lit("%")), F.lit(LIKE_ESCAPE))
    if anchor == "word":
        hit = hit | F.ilike(F.col("company_name"), F.concat(F.col("pattern"), F.lit("%")), F.lit(LIKE_ESCAPE))
    return (offered.join(broadcast_if_small(listed), "_key").where(hit)
            .select("company_name", "industry", "industry_rank", "pattern").distinct())


def pattern_match(company: Column, rows: list, anchor: str = "space") -> Column:
    """First (rank, industry) struct whose pattern matches ``company``, else NULL."""
    hits = [F.when(name_match(company, p, anchor=anchor),
                   F.struct(F.lit(rank).alias("industry_rank"), F.lit(ind).alias("industry")))
            for ind, rank, p in rows]
    if not hits:
        return F.lit(None).cast("struct<industry_rank:int,industry:string>")
    return hits[0] if len(hits) == 1 else F.least(*hits)


def pattern_industries(company: Column, rows: list, anchor: str = "space") -> Column:
    """ARRAY<STRING> of every industry whose patterns match ``company`` (rank order)."""
    by_ind: dict[tuple, list[str]] = {}
    for ind, rank, p in rows:
        by_ind.setdefault((rank, ind), []).append(p)
    hits = [F.when(reduce(lambda a, b: a | b,
                          [name_match(company, p, anchor=anchor) for p in ps]), F.lit(ind))
            for (rank, ind), ps in sorted(by_ind.items())]
    if not hits:
        return F.array().cast("array<string>")
    return F.array_compact(F.array(*hits))


def pattern_employers(position_characteristics: DataFrame, patterns: DataFrame,
                      anchor: str = "space") -> DataFrame:
    """Distinct (industry, company_name) pairs whose name matches an industry's patterns."""
    rows = _pattern_rows(patterns, None, False)
    if rows is None:
        return indexed_matches(position_characteristics, _pattern_table(patterns, None, False), anchor).select("industry", "company_name").distinct()
    names = position_characteristics.select("company_name").where(F.col("company_name").isNotNull()).distinct()
    return names.select(F.explode(pattern_industries(F.col("company_name"), rows, anchor)).alias("industry"),
                        "company_name")


def _first_listed(companies: DataFrame) -> DataFrame:
    """One row per listed company: its first industry by rank (Q18)."""
    return (companies.groupBy("company_name")
            .agg(F.min(F.struct("industry_rank", "industry")).alias("_listed")))


def label_employers(postings: DataFrame, companies: DataFrame, patterns: DataFrame,
                    company_col: str = "company_name", compat: bool = False,
                    anchor: str = "space") -> DataFrame:
    """Add ``industry`` = the first-ranked industry from the list or the patterns.

    Exact, case-sensitive equality for listed names (so 'abbott ' only matches
    itself); ``'% p%'`` ILIKE for patterns.  ``compat=True`` drops pattern
    labels of industries that also have a company list (Q1).  Beyond ``CHAIN_PATTERNS`` patterns the
    matches come from :func:`indexed_matches` over the distinct names.
    """
    rows = _pattern_rows(patterns, companies, compat)
    listed = broadcast_if_small(_first_listed(companies).withColumnRenamed("company_name", "_lname"))
    joined = postings.join(listed, F.col(company_col) == F.col("_lname"), "left")
    if rows is None:
        found = indexed_matches(postings.select(F.col(company_col).alias("company_name")), _pattern_table(patterns, companies, compat), anchor)
        first = found.groupBy(F.col("company_name").alias("_pname")).agg(F.min(F.struct("industry_rank", "industry")).alias("_matched"))
        joined = joined.join(broadcast_if_small(first), F.col(company_col) == F.col("_pname"), "left")
        match = F.col("_matched")
    else:
        match = pattern_match(F.col(company_col), rows, anchor)
    best = F.least(F.col("_listed"), match)
    keep = [c for c in joined.columns if c not in ("_lname", "_listed", "_pname", "_matched", "industry")]
    # emitted through a one-row inline (Generate): a later filter on the label
    # (dropping unlabelled postings) cannot be pushed below it and re-run the patterns
    return joined.select(*keep, F.inline(F.array(F.struct(best.getField("industry").alias("industry")))))


def labelled_employers(position_characteristics: DataFrame, companies: DataFrame,
                       patterns: DataFrame, compat: bool = False) -> DataFrame:
    """The employer dictionary after pattern expansion: (industry, industry_rank, company_name, rule)."""
    listed = companies.select("industry", "industry_rank", "company_name", F.lit("list").alias("rule"))
    table = _pattern_table(patterns, companies, compat)
    ranks = broadcast_if_small(table.groupBy("industry").agg(F.min("industry_rank").alias("industry_rank")))
    pat = (pattern_employers(position_characteristics, table).join(ranks, "industry")
           .select("industry", F.col("industry_rank").cast("int").alias("industry_rank"), "company_name", F.lit("pattern").alias("rule")))
    return listed.unionByName(pat).distinct()


def relabel_levels(df: DataFrame, mapping: DataFrame, label_col: str = "industry",
                   levels: tuple[str, ...] = ("meso", "macro", "pharma")) -> DataFrame:
    """J5/J6 at several levels at once: one row per input row and level, labels in one join."""
    m = mapping.select("level", F.col("industry").alias(label_col), F.col("target").alias("_to"))
    each = df.withColumn("level", F.explode(F.array(*[F.lit(x) for x in levels])))
    return (each.join(broadcast_if_small(m), ["level", label_col], "left")
            .withColumn(label_col, F.coalesce(F.col("_to"), F.col(label_col))).drop("_to"))


def relabel(df: DataFrame, mapping: DataFrame, level: str | None, label_col: str = "industry") -> DataFrame:
    """Map nace labels to a coarser level; unmapped labels are kept.

    ``level`` None or 'nace' returns ``df`` unchanged; pharma, macro and meso
    use ``mapping`` (level, industry, target); anything else raises ValueError.
    """
    if level is None or level == "nace":
        return df
    if level not in ("pharma", "macro", "meso"):
        raise ValueError("industry level must be one of 'pharma', 'macro', 'meso' or 'nace'")
    m = (mapping.filter(F.col("level") == F.lit(level))
         .select(F.col("industry").alias("_from"), F.col("target").alias("_to")))
    joined = df.join(broadcast_if_small(m), F.col(label_col) == F.col("_from"), "left")
    return joined.withColumn(label_col, F.coalesce(F.col("_to"), F.col(label_col))).drop("_from", "_to")
