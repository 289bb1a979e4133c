"""Shared building blocks: written intermediates, global order, connected components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import shared_path, ship_code  # noqa: F401

#: Java and Python form of "a word": a run without space, tab, newline, VT, FF, CR.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Deletes a query's shuffle files when the query ends (Spark 4.1; and its name in 4.0).
_CLEAN = ("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "spark.sql.shuffleDependency.fileCleanup.enabled")


@contextmanager
def no_shuffles_left(spark: SparkSession) -> Iterator[None]:
    """Queries that run inside leave no shuffle files.  Else these stay until the driver happens to
    collect its garbage, and the disks hold the shuffles of all steps since."""
    old = {k: spark.conf.get(k, None) for k in _CLEAN}
    for k in _CLEAN:
        spark.conf.set(k, "true")
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def saved(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut, lost executors
    cost a reread only, and the rows are fixed from here on.  ``release`` deletes the files."""
    spark = df.sparkSession
    path = shared_path(spark, f"llm-{tag}-{uuid.uuid4().hex}")
    with no_shuffles_left(spark):
        # the frame's own plan may have been made before, a write's is made here
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._llm_path = path
    return out


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or with underscores before it, so that it is no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def release(*frames: DataFrame) -> None:
    """Delete tables written by ``saved`` that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_llm_path", None)
        if path:
            jvm = df.sparkSession._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            conf = df.sparkSession._jsc.hadoopConfiguration()
            target.getFileSystem(conf).delete(target, True)


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ordered_running_totals(df: DataFrame, order: Sequence[Column | str], totals: Sequence[str], tag: str) -> DataFrame:
    """Add, for every numeric column c of ``totals``, ``c_before``: the sum of c over all rows
    that come earlier in the global order; and ``row_before``: the number of such rows.

    Rows are range-partitioned and sorted; every task writes running totals of its own range
    together with the range's number (columns _range and *_before of ``df`` are replaced), so each row is sorted and written once.  The totals of
    the ranges (one row per partition) then give the offsets.  No task sees more than its range.
    """
    spark = df.sparkSession
    df = df.drop("_range", "row_before", *[f"{c}_before" for c in totals])
    kinds = [f"{c}_before" for c in totals] + ["row_before"]
    schema = T.StructType([*df.schema.fields, T.StructField("_range", T.LongType()),
                           *[T.StructField(k, T.LongType()) for k in kinds]])

    def running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = dict.fromkeys(kinds, 0)
        for b in batches:
            cols = list(b.columns)
            for c, k in zip([*totals, None], kinds):
                v = (np.ones(b.num_rows, np.int64) if c is None
                     else b.column(b.schema.get_field_index(c)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
                ends = np.cumsum(v) + carry[k]
                cols.append(pa.array(ends - v))
                if len(ends):
                    carry[k] = int(ends[-1])
            yield pa.RecordBatch.from_arrays(cols, names=[*b.schema.names, *kinds])

    # rand() is the last key: rows equal in every other key are interchangeable, and a hot key still splits
    tie = fresh(df, "_tie")
    ranged = (df.withColumn(tie, F.rand(17)).repartitionByRange(parallelism(spark), *order, tie)
              .sortWithinPartitions(*order, tie).drop(tie)
              .withColumn("_range", F.spark_partition_id().cast("long")))
    rows = saved(ranged.mapInArrow(running, schema), tag)
    ends = rows.groupBy("_range").agg(
        *[(F.max(F.col(f"{c}_before") + F.coalesce(F.col(c), F.lit(0)))).cast("long").alias(f"_{c}_before") for c in totals],
        (F.max("row_before") + 1).alias("_row_before"))
    from pyspark.sql import Window
    w = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # one row per range partition: bounded by the number of shuffle partitions, so it may be broadcast
    offsets = ends.select("_range", *[F.coalesce(F.sum(f"_{k}").over(w), F.lit(0)).alias(f"_{k}") for k in kinds])
    out = rows.join(F.broadcast(offsets), "_range")
    out = out.select(*df.columns, *[(F.col(k) + F.col(f"_{k}")).alias(k) for k in kinds])
    out._llm_path = rows._llm_path
    return out


def connected_components(edges: DataFrame, tag: str, max_rounds: int = 60) -> DataFrame:
    """Smallest id reachable from every vertex of an undirected edge list (columns a, b: long).

    Alternating large-star and small-star rounds until the edges stop changing; every round is
    written to the shared folder.  The stars are two aggregations and joins on the vertex, so a
    hub's neighbours are pre-aggregated and its join rows can be split by AQE.
    Returns (id, component) for vertices with an edge to another vertex.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = saved(e, f"{tag}-edges")
    state = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (both.where("v > u").join(low, "u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(down, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(down.select("u", F.col("m").alias("v")))).distinct()
        nxt = saved(small, f"{tag}-edges")
        now = nxt.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        release(e)
        e = nxt
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    ids = e.select(F.col("u").alias("id"), F.col("v").alias("component"))
    roots = e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    out = ids.unionByName(roots)
    out._llm_path = e._llm_path
    return out
