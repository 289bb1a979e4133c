"""Fixture views over the driver's read-only tables (see FIXTURES.md §2).

``job_postings`` and ``position_characteristics`` are formed from
``documents`` (texts), ``part`` (employer names) and ``pages`` (html); the two
label dimensions are small configuration tables.  The same definitions exist
as SQL text in :mod:`hireframe.plans.sqltext` for the DuckDB check.

Scale notes: every join here is on the document id, a unique key, so the three
inputs are each hash-partitioned once by that key and the joins line up
without further exchanges.  The unique-text flag never shuffles whole texts by
text: a partial ``min(doc_id)`` per text digest collapses hot texts map-side and
only (digest, doc_id) pairs move.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


# Row keys of the text tables (used to spread a scan that came out too coarse).
TEXT_KEYS = {"documents": "doc_id", "pages": "page_id", "conversations": "conv_id"}


def spread(df: DataFrame, key: str | None = None) -> DataFrame:
    """Give CPU-heavy text work enough tasks.

    A parquet row group cannot be split, so a table stored as a few large row
    groups scans into a few tasks.  If the scan has fewer partitions than the
    cluster's parallelism it is hash-partitioned by ``key`` into the shuffle
    partition count, capped at four tasks per core.  A large input already has
    many more splits than cores and is left untouched.
    """
    spark = df.sparkSession
    try:
        parallelism = spark.sparkContext.defaultParallelism
        parts = df.rdd.getNumPartitions()
    except Exception:       # no RDD view (e.g. a Connect session): leave the scan as it is
        return df
    if parts >= parallelism:
        return df
    # a few tasks per core (text lengths vary widely), never a flood of tiny tasks
    shuffle = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = min(max(shuffle, parallelism), 4 * parallelism)
    return df.repartition(n, key) if key else df.repartition(n)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return spread(df, TEXT_KEYS[name]) if name in TEXT_KEYS else df


def _uniq_id(doc_id_col: str = "doc_id"):
    return F.concat(F.lit("p"), F.col(doc_id_col).cast("string"))


def job_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """uniq_id, text_language, job_description, html_job_description, unique_posting_text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), "p_name")
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), "html")
    firsts = (docs.groupBy(F.sha2(F.col("text"), 256).alias("_h"))
              .agg(F.min("doc_id").alias("doc_id"))
              .select("doc_id", F.lit("yes").alias("_first")))
    name = F.col("p_name")
    desc = F.concat(F.upper(F.substring(name, 1, 1)), F.substr(name, F.lit(2)), F.lit(" is hiring. "),
                    F.col("text"), F.lit(" Join "), name, F.lit(" now!"))
    return (docs.join(part, "doc_id", "inner")
            .join(pages, "doc_id", "left")
            .join(firsts, "doc_id", "left")
            .select(_uniq_id().alias("uniq_id"),
                    F.col("lang").alias("text_language"),
                    desc.alias("job_description"),
                    F.col("html").alias("html_job_description"),
                    F.coalesce(F.col("_first"), F.lit("no")).alias("unique_posting_text")))


def position_characteristics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """uniq_id, company_name of every posting."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), "p_name")
    return (docs.join(part, "doc_id", "inner")
            .select(_uniq_id().alias("uniq_id"), F.col("p_name").alias("company_name")))


# Fixed values of the fixture label dimensions (FIXTURES.md §2).
LABEL_COMPANIES = [
    ("manufacturing", 1, "red widget"),
    ("manufacturing", 1, "blue bolt"),
    ("pharmaceutical and life sciences", 2, "hot gizmo"),
    ("medtech", 3, "red widget"),
    ("medtech", 3, "new gear"),
    ("financial and insurance", 4, "old ring"),
]
LABEL_PATTERNS = [
    ("financial and insurance", 4, "anvil"),
    ("real estate", 5, "plate"),
    ("real estate", 5, "rod"),
    ("research and academia", 6, "rod"),
    ("research and academia", 6, "gear"),
]


def label_companies(spark: SparkSession) -> DataFrame:
    """D3 fixture: industry, industry_rank, company_name."""
    return spark.createDataFrame(LABEL_COMPANIES,
                                 "industry string, industry_rank int, company_name string")


def label_patterns(spark: SparkSession) -> DataFrame:
    """D4 fixture: industry, industry_rank, pattern."""
    return spark.createDataFrame(LABEL_PATTERNS, "industry string, industry_rank int, pattern string")


def language_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D7 (endetect_train): doc_id, text, labels (language code)."""
    return table(spark, sf_dir, "documents").select("doc_id", "text", F.col("lang").alias("labels"))
