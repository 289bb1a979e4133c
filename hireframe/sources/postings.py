"""Selecting unique postings, optionally with employer and html columns."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ordering import det, first_n
from ..functions.sizing import broadcast_if_small

BASE_COLUMNS = ["uniq_id", "text_language", "job_description"]


def flatten_companies(companies: Iterable) -> list[str]:
    """Strings first, then the elements of nested lists (one level)."""
    companies = list(companies)
    flat = [c for c in companies if isinstance(c, str)]
    for c in companies:
        if not isinstance(c, str):
            flat += list(c)
    return flat


def _unique(job_postings: DataFrame, language: str | None) -> DataFrame:
    jp = job_postings.filter(F.col("unique_posting_text") == F.lit("yes"))   # P2
    if language:
        jp = jp.filter(F.col("text_language") == F.lit(language))            # P3
    return jp


def _project(jp: DataFrame, position_characteristics: DataFrame | None,
             institution_name: bool, html: bool) -> DataFrame:
    cols = list(BASE_COLUMNS)                                                # P1
    if institution_name:
        if position_characteristics is None:
            raise ValueError("institution_name=True needs position_characteristics")
        pc = position_characteristics.select("uniq_id", "company_name")
        jp = jp.join(pc, "uniq_id", "left")                                  # J1
        cols.append("company_name")
    if html:
        cols.append("html_job_description")
    return jp.select(*cols)


def get_postings(job_postings: DataFrame, position_characteristics: DataFrame | None = None,
                 institution_name: bool = False, html: bool = False, sample_size=None,
                 language: str | None = None, seed: int = 4082023) -> DataFrame:
    """Unique postings, optional language filter, LIMIT before the join.

    The limit takes the first ``sample_size`` postings in the seeded order, so
    re-runs agree; a posting with several company rows then fans out (Q8).
    """
    jp = _unique(job_postings, language)
    if sample_size:
        if not isinstance(sample_size, int) or isinstance(sample_size, bool):
            raise TypeError("sample_size must be an int")
        jp = first_n(jp.withColumn("_o", det(seed, "uniq_id")), sample_size, "_o", "uniq_id").drop("_o")
    return _project(jp, position_characteristics, institution_name, html)


def companies_frame(spark: SparkSession, companies) -> DataFrame:
    """A one-column (company_name) DataFrame from a list (nested lists flattened) or a DataFrame."""
    if isinstance(companies, DataFrame):
        return companies.select("company_name")
    return spark.createDataFrame([(c,) for c in flatten_companies(companies)], "company_name string")


def get_company_postings(job_postings: DataFrame, position_characteristics: DataFrame, companies,
                         institution_name: bool = False, html: bool = False,
                         language: str | None = None) -> DataFrame:
    """Unique postings of a set of employers (two semi joins, J2)."""
    spark = job_postings.sparkSession
    wanted = broadcast_if_small(companies_frame(spark, companies).distinct())
    ids = position_characteristics.join(wanted, "company_name", "left_semi").select("uniq_id")
    jp = _unique(job_postings, language).join(ids, "uniq_id", "left_semi")
    return _project(jp, position_characteristics, institution_name, html)
