"""Deterministic ordering and exact global ranks without single-task windows.

``det(seed, key)`` is the seeded shuffle order used everywhere a random order is
needed: ``md5('<seed>:' || key)`` with the key itself as tie-break.  It gives the
same order on every engine, every partitioning and every re-run, so sampling and
splits are reproducible and can be checked against SQL.

A window ``orderBy`` without ``partitionBy`` moves every row into one task.  The
helpers here compute the same global ``row_number`` in two levels: the first bits
of the md5 name a bucket; bucket totals get running offsets; each bucket then ranks
its own rows in parallel.  Because buckets are prefixes of the sort key, bucket
order is the global order, so ``offset + row_number within bucket`` is the exact
global rank.  Splits and limits need no ranks: see ``selection``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Fewest bits of the md5 that name a bucket: 4,096 buckets.
MIN_BUCKET_BITS = 12
# Rows of an offset table (groups x buckets) that may be broadcast; above, it is joined by shuffle.
MAX_BROADCAST_OFFSETS = 1 << 17


def bucket_bits(spark: SparkSession) -> int:
    """Bits that give at least four buckets per shuffle partition.  The partition count is sized
    from the input, so buckets stay as small as the partitions; ranks do not depend on the number."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(MIN_BUCKET_BITS, (4 * parts - 1).bit_length())


def _bucket(order: Column, bits: int) -> Column:
    """The first ``bits`` (up to 32) of an md5 hex string as a number."""
    return F.shiftright(F.conv(F.substring(order, 1, 8), 16, 10).cast("bigint"), 32 - bits)


def _offsets(sums: DataFrame, by: list[str], bits: int, total: str | None = None) -> DataFrame:
    """(by, _bkt, _off): the sum of ``_bs`` over earlier buckets.  The sums run over coarse buckets first
    and inside each of them then, so that no task sorts more than 2^(bits/2) rows of a group."""
    coarse = F.shiftright("_bkt", bits - bits // 2)
    fine = sums.withColumn("_c", coarse)
    w = Window.partitionBy(*by).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    extra = [F.sum("_cs").over(Window.partitionBy(*by)).alias(total)] if total else []
    before = (fine.groupBy(*by, "_c").agg(F.sum("_bs").alias("_cs"))
              .select(*by, "_c", F.coalesce(F.sum("_cs").over(w), F.lit(0)).alias("_before"), *extra))
    inner = Window.partitionBy(*by, "_c").orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    return (fine.withColumn("_in", F.coalesce(F.sum("_bs").over(inner), F.lit(0))).join(before, [*by, "_c"])
            .select(*by, "_bkt", (F.col("_before") + F.col("_in")).alias("_off"), *([total] if total else [])))


def det(seed: int | str, key: str | Column) -> Column:
    """Seeded pseudo-random order key: md5 of '<seed>:<key>' (hex string)."""
    k = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(f"{seed}:"), k.cast("string")))


def hashed_index(seed: int | str, key: str | Column, n: int | Column) -> Column:
    """Uniform draw in [0, n): first 60 bits of the md5 of '<seed>:<key>' mod n."""
    h = F.conv(F.substring(det(seed, key), 1, 15), 16, 10).cast("bigint")
    return F.pmod(h, n if isinstance(n, Column) else F.lit(n).cast("bigint"))


def _cols(cols: str | Sequence[str] | None) -> list[str]:
    if cols is None:
        return []
    if isinstance(cols, str):
        return [cols]
    return list(cols)


def rank_by_hash(df: DataFrame, order_col: str, tie_col: str, by=None,
                 out: str = "rank", bits: int | None = None,
                 broadcast_offsets: bool | None = None, total: str | None = None, at_most: int | None = None) -> DataFrame:
    """Exact ``row_number() over (partition by <by> order by <order_col>, <tie_col>)``.

    ``order_col`` must be an md5 hex string (see :func:`det`).  Rows of one
    ``by`` group are spread over ``2**bits`` buckets, so a group holding a
    third of all rows is ranked by thousands of tasks, not one.  Offsets are broadcast
    only without groups and up to ``MAX_BROADCAST_OFFSETS`` buckets.  ``total``
    names an optional column carrying the group's row count.  ``at_most`` keeps
    the ranks up to it; buckets that start later are dropped before the shuffle.
    """
    by = _cols(by)
    bits = bits or bucket_bits(df.sparkSession)
    if broadcast_offsets is None:
        broadcast_offsets = not by and 1 << bits <= MAX_BROADCAST_OFFSETS
    b = df.withColumn("_bkt", _bucket(F.col(order_col), bits))
    offsets = _offsets(b.groupBy(*by, "_bkt").agg(F.count(F.lit(1)).alias("_bs")), by, bits, total)
    if at_most is not None:
        offsets = offsets.filter(F.col("_off") < at_most)
    joined = b.join(F.broadcast(offsets) if broadcast_offsets else offsets.hint("merge"), [*by, "_bkt"], "inner")
    wb = Window.partitionBy(*by, "_bkt").orderBy(F.col(order_col), F.col(tie_col))
    ranked = joined.withColumn(out, F.row_number().over(wb) + F.col("_off")).drop("_bkt", "_off")
    return ranked if at_most is None else ranked.filter(F.col(out) <= at_most)


def running_total_by_hash(df: DataFrame, value_col: str, order_col: str, tie_col: str,
                          by=None, out: str = "cumsum",
                          bits: int | None = None) -> DataFrame:
    """Exact running ``sum(value_col)`` in (order_col, tie_col) order, per ``by`` group."""
    by = _cols(by)
    bits = bits or bucket_bits(df.sparkSession)
    b = df.withColumn("_bkt", _bucket(F.col(order_col), bits))
    offsets = _offsets(b.groupBy(*by, "_bkt").agg(F.sum(value_col).alias("_bs")), by, bits)
    small = not by and 1 << bits <= MAX_BROADCAST_OFFSETS
    joined = b.join(F.broadcast(offsets) if small else offsets.hint("merge"), [*by, "_bkt"], "inner")
    wb = (Window.partitionBy(*by, "_bkt").orderBy(F.col(order_col), F.col(tie_col))
          .rowsBetween(Window.unboundedPreceding, 0))
    return joined.withColumn(out, F.sum(value_col).over(wb) + F.col("_off")).drop("_bkt", "_off")


def first_n(df: DataFrame, n: int, order_col: str, tie_col: str) -> DataFrame:
    """The first ``n`` rows in (order_col, tie_col) order.

    Small ``n`` plans as TakeOrderedAndProject (a per-partition top-k whose
    merge is checked to stay small).  For large ``n`` the hash of the n-th row is
    found by radix selection and rows are compared with it; only where several rows
    share that hash and not all of them are wanted are rows ranked.
    """
    from .selection import Selector, within

    if not isinstance(n, int) or isinstance(n, bool):
        raise TypeError("n must be an int")
    if top_k_is_small(df, n):
        return df.orderBy(F.col(order_col), F.col(tie_col)).limit(n)
    cut = Selector(df, order_col).cuts([(0, n)])[0, n]
    if cut is None or cut.upto == n:
        return df.where(within(F.col(order_col), cut))
    return rank_by_hash(df, order_col, tie_col, out="_first_n_rank", at_most=n).drop("_first_n_rank")


# A top-k merges (partitions x k) rows in one task; above this we rank by sort.
TOP_K_MERGE_ROWS = 20_000_000


def top_k_is_small(df: DataFrame, k: int) -> bool:
    """Is a per-partition top-k of ``k`` rows cheap to merge in one task?"""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return k * max(parts, 1) <= TOP_K_MERGE_ROWS


def rank_by_sort(df: DataFrame, order: list, out: str = "rank", partitions: int | None = None) -> DataFrame:
    """Exact global ``row_number()`` for any sort order, without a single-task window.

    Rows are range-partitioned by the order (a distributed sort) and written to
    the shared folder with their partition number: range bounds are sampled, so
    sizes and ranks must come from one and the same partitioning.  The sizes
    (one small row each) give running offsets; each partition numbers its rows.
    """
    from ..session import shared_dir

    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    shared_dir(spark)
    ranged = df.repartitionByRange(n, *order).withColumn("_pid", F.spark_partition_id()).checkpoint(eager=True)
    sizes = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_pid", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    within = Window.partitionBy("_pid").orderBy(*order)
    return (ranged.join(F.broadcast(offsets), "_pid")
            .withColumn(out, F.row_number().over(within) + F.col("_off")).drop("_pid", "_off"))
