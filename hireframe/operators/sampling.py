"""Seeded sampling: per-group caps (W1, A1, L2), with-replacement draws (L5),
class rebalancing (L6) and the seeded shuffle order (L7).

All randomness is the md5 order of :func:`hireframe.functions.ordering.det`,
so results repeat across runs, partitionings and engines.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordering import det, first_n, hashed_index, rank_by_hash

#: Copies of one drawn row that leave in one piece.
COPIES_PER_PIECE = 1024


def subsample(df: DataFrame, group_col: str, key_col: str, seed: int = 4082023,
              max_n_per_group: int = 500, max_n_overall: int | None = None) -> DataFrame:
    """At most ``max_n_per_group`` rows per group, then an overall cap.

    Rows with a NULL group are dropped (a group-by drops them).  Within a group
    the first rows in the seeded order ``md5(seed:key)`` are kept; Catalyst
    turns ``row_number() <= n`` into a partial WindowGroupLimit before the
    shuffle, so a hot group sends at most n rows per map task.
    """
    o = det(seed, key_col)
    w = Window.partitionBy(group_col).orderBy(o, F.col(key_col))
    capped = (df.filter(F.col(group_col).isNotNull())
              .withColumn("_rn", F.row_number().over(w))
              .filter(F.col("_rn") <= max_n_per_group).drop("_rn"))
    if max_n_overall:
        capped = first_n(capped.withColumn("_o", det(f"{seed}:overall", key_col)),
                         max_n_overall, "_o", key_col).drop("_o")
    return capped


def group_sizes(df: DataFrame, group_col: str, max_n_per_group: int) -> DataFrame:
    """A1: min(count, cap) per non-null group."""
    return (df.filter(F.col(group_col).isNotNull()).groupBy(group_col)
            .agg(F.least(F.count(F.lit(1)), F.lit(max_n_per_group)).cast("bigint").alias("n")))


def shuffle_order(df: DataFrame, key_col: str, seed: int) -> DataFrame:
    """Add the seeded global position ``pos`` (1-based), computed in parallel."""
    return rank_by_hash(df.withColumn("_o", det(seed, key_col)), "_o", key_col, out="pos").drop("_o")


def sample_with_replacement(df: DataFrame, n: int, key_col: str, seed: int = 1,
                            copy_col: str | None = None) -> DataFrame:
    """Exactly ``n`` rows drawn uniformly with replacement.

    Rows get a global index 1..N in seeded order (two-level rank); draw i picks
    index ``md5('<seed>:draw:i') mod N + 1``.  Draws are counted per index
    first, so the join moves one row per distinct index, and a row drawn k
    times is repeated after the join, in pieces of at most ``COPIES_PER_PIECE``
    copies, so no array grows with k.
    """
    if not isinstance(n, int) or n < 0:
        raise ValueError("n must be a non-negative int")
    spark = df.sparkSession
    total = df.count()
    if total == 0 or n == 0:
        empty = df.limit(0)
        return empty.withColumn(copy_col, F.lit(0)) if copy_col else empty
    indexed = shuffle_order(df, key_col, seed).withColumnRenamed("pos", "_idx")
    draws = (spark.range(n)
             .select((hashed_index(f"{seed}:draw", F.col("id"), total) + 1).alias("_idx"))
             .groupBy("_idx").agg(F.count(F.lit(1)).alias("_k")))
    picked = indexed.join(draws, "_idx", "inner")
    piece = F.lit(COPIES_PER_PIECE).cast("bigint")
    pieces = picked.withColumn("_from", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_k") - 1, piece)))
    out = (pieces.withColumn("_copy", F.explode(F.sequence(F.col("_from"), F.least(F.col("_from") + piece, F.col("_k")) - 1)))
           .withColumn("_copy", F.col("_copy").cast("int")).drop("_idx", "_k", "_from"))
    if copy_col:
        return out.withColumnRenamed("_copy", copy_col)
    return out.drop("_copy")


def other_rows_needed(n_target: int, target_share: float) -> int:
    """round((1 - s) * n_target / s), half to even like Python's round."""
    return int(round((1 - target_share) * (n_target / target_share)))


def rebalance(df: DataFrame, label_col: str, key_col: str, target: str = "en",
              target_share: float = 0.25, seed: int = 10032023, copy_col: str | None = None) -> DataFrame:
    """Keep all target rows and draw others with replacement so that the
    target makes up ``target_share`` of the result."""
    if not 0 < target_share <= 1:
        raise ValueError("target_share must be in (0, 1]")
    is_target = F.col(label_col) == F.lit(target)
    targets = df.filter(is_target)
    others = df.filter(~is_target | F.col(label_col).isNull())
    n_other = other_rows_needed(targets.count(), target_share)
    drawn = sample_with_replacement(others, n_other, key_col, seed, copy_col)
    if copy_col:
        targets = targets.withColumn(copy_col, F.lit(0))
    return targets.unionByName(drawn)


def ceil_share(n: int, share: float) -> int:
    return int(math.ceil(n * share))
