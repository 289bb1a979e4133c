"""Per-employer summaries: majority vote (A3), counts (A11) and one posting per employer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import det


def majority_vote(df: DataFrame, group_col: str = "company_name", label_col: str = "industry",
                  out: str = "industry") -> DataFrame:
    """A3: the most frequent label per group; ties go to the lowest label (Q13).

    ``mode`` aggregates partially on the map side, so a group holding a third
    of all rows is reduced before the shuffle.
    """
    return (df.filter(F.col(group_col).isNotNull() & F.col(label_col).isNotNull())
            .groupBy(group_col).agg(F.mode(F.col(label_col), True).alias(out)))


def rows_and_employers(df: DataFrame, group_col: str = "company_name") -> DataFrame:
    """Number of rows and of distinct employers."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(group_col).alias("n_employers"))


def one_per_employer(df: DataFrame, key_col: str, group_col: str = "company_name",
                     seed: int = 4082023) -> DataFrame:
    """Keep one row per employer, the first in seeded order.

    ``min_by`` over a struct of the row is a partial aggregate, so a hot
    employer is reduced map-side (no window over the employer's rows).
    """
    cols = df.columns
    picked = (df.filter(F.col(group_col).isNotNull())
              .groupBy(group_col)
              .agg(F.min_by(F.struct(*cols), F.struct(det(seed, key_col), F.col(key_col))).alias("_r")))
    return picked.select("_r.*")
