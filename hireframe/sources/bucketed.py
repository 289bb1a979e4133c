"""Bucketed tables (S6): written once by key, joined on it ever after without an exchange."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import shared_path


def write_bucketed(df: DataFrame, name: str, key: str, buckets: int | None = None) -> str:
    """Write ``df`` to the shared folder in ``buckets`` buckets of ``key`` (the shuffle partition count by
    default), each sorted by it, and return the name of the catalogue table.

    Rows are dealt by the key first, so a bucket is one file (plus what ``maxRecordsPerFile`` splits off).
    A null key is a bucket's key like any other; it joins with nothing.
    """
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"hireframe_{name}_{uuid.uuid4().hex}"
    (df.repartition(n, key).write.format("parquet").bucketBy(n, key).sortBy(key)
     .option("path", shared_path(spark, "buckets", table)).saveAsTable(table))
    return table


def read_bucketed(spark: SparkSession, table: str) -> DataFrame:
    """The table, planned as a sort-merge side: two tables of equally many buckets of the join key meet
    bucket by bucket, whatever their size."""
    return spark.table(table).hint("merge")
