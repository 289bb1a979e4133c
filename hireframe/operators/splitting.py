"""Leakage-safe and random data splits.

Every split returns the input rows with one extra column ``partition``
('train', 'validation', 'test' or 'dropped') instead of separate frames.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ordering import det, rank_by_hash
from ..functions.selection import Cut, Selector, within
from ..functions.sizing import broadcast_if_small
from ..session import shared_dir
from .sampling import ceil_share

# Class-level tables are broadcast only up to this many classes.
MAX_BROADCAST_CLASSES = 1000


def split_by_employers(df: DataFrame, company_col: str = "company_name", validation_set: bool = True,
                       test_size: float = 0.15, val_size: float = 0.25, seed: int = 8082023,
                       boundary: str = "dropped") -> DataFrame:
    """Whole employers go to one partition.

    Employers are put in seeded order; the running total of their postings
    decides: total < t -> test, total > t -> rest, total == t -> ``boundary``
    (observed behaviour: in no partition, labelled 'dropped'), with
    t = int(rows * test_size).  With ``validation_set`` the rest is cut again
    at int(rest rows * val_size).  Rows without employer are 'dropped'.
    The employers at which the totals reach their quotas are found by radix selection,
    weighted by postings, over the written employer counts; each row then compares its
    employer's hash with these cuts, so rows are neither joined nor moved.
    """
    shared_dir(df.sparkSession)
    counts = (df.groupBy(company_col).agg(F.count(F.lit(1)).alias("_n"))
              .select(det(seed, company_col).alias("_o"), "_n").checkpoint(eager=True))
    found = Selector(counts, "_o", weight_col="_n")
    t = int((found.total + found.nulls) * test_size)
    o = det(seed, company_col)

    def side(cut: Cut | None, quota: int, below: str, above) -> Column:
        """below / boundary / above, by the running total at the row's employer."""
        if cut is None:
            return F.lit(below)
        at = F.lit(boundary) if cut.upto == quota else above
        return F.when(o < F.lit(cut.order), F.lit(below)).when(o == F.lit(cut.order), at).otherwise(above)

    first, rest = found.cuts([(0, t)])[0, t], F.lit("train")
    if validation_set:
        base = found.total if first is None else first.upto if first.upto == t else first.before
        t2 = base + int((found.total - base) * val_size)
        rest = side(found.cuts([(0, t2)])[0, t2], t2, "validation", F.lit("train"))
    part = F.when(F.col(company_col).isNull(), F.lit("dropped")).otherwise(side(first, t, "test", rest))
    return df.withColumn("partition", part)


def _largest_remainder(counts: DataFrame, class_col: str, n_col: str, total: int, draw: int,
                       out: str) -> DataFrame:
    """Per-class quotas summing to ``draw``: floor shares plus one for the
    largest remainders (ties by class label).  Runs on the class-level table."""
    # rows x draw passes 2^63 from 3e9 rows on: exact in DECIMAL
    num = (F.col(n_col).cast("decimal(19,0)") * F.lit(draw).cast("decimal(19,0)")).cast("decimal(38,0)")
    rem = F.pmod(num, F.lit(total).cast("decimal(38,0)"))
    c = counts.withColumn("_rem", rem).withColumn("_base", ((num - rem) / F.lit(total).cast("decimal(19,0)")).cast("bigint"))
    short = F.lit(draw) - F.sum("_base").over(Window.partitionBy())
    rk = F.row_number().over(Window.orderBy(F.col("_rem").desc(), F.col(class_col)))
    return c.withColumn(out, F.col("_base") + F.when(rk <= short, 1).otherwise(0)) \
        .drop("_base", "_rem")


def random_stratified_split(df: DataFrame, y: str, key_col: str, validation_set: bool = True,
                            test_size: float = 0.15, val_size: float = 0.25,
                            seed: int = 10082023) -> DataFrame:
    """Stratified random split: ceil(n*test) test rows split across
    classes by largest remainder, then the same for validation on the rest.
    Within a class rows are taken in seeded order: the hash that cuts off each quota is
    found by radix selection, and rows are compared with it (a table of one row per class).
    Beyond ``MAX_BROADCAST_CLASSES`` classes, or where rows share a key across a cut, rows are ranked."""
    base = df.filter(F.col(y).isNotNull())
    shared_dir(df.sparkSession)
    counts = base.groupBy(y).agg(F.count(F.lit(1)).alias("_n")).checkpoint(eager=True)
    n, classes = counts.agg(F.sum("_n"), F.count(F.lit(1))).first()
    n = int(n or 0)
    n_test = ceil_share(n, test_size)
    quotas = _largest_remainder(counts, y, "_n", max(n, 1), n_test, "_qt")
    if validation_set:
        rest = quotas.withColumn("_nr", F.col("_n") - F.col("_qt"))
        n_rest = n - n_test
        n_val = ceil_share(n_rest, val_size)
        quotas = _largest_remainder(rest, y, "_nr", max(n_rest, 1), n_val, "_qv").drop("_nr")
    else:
        quotas = quotas.withColumn("_qv", F.lit(0).cast("bigint"))
    q = quotas.select(y, "_qt", (F.col("_qt") + F.col("_qv")).alias("_qv"))
    ordered = base.withColumn("_o", det(seed, key_col))
    cuts = _class_cuts(ordered, q, y) if classes <= MAX_BROADCAST_CLASSES else None
    if cuts is not None:
        out = ordered.join(F.broadcast(cuts), y, "inner")
        test, validation = F.col("_o") <= F.col("_qt"), F.col("_o") <= F.col("_qv")
    else:
        out = rank_by_hash(ordered, "_o", key_col, by=y, out="_r").join(broadcast_if_small(q), y, "inner")
        test, validation = F.col("_r") <= F.col("_qt"), F.col("_r") <= F.col("_qv")
    part = F.when(test, F.lit("test")).when(validation, F.lit("validation")).otherwise(F.lit("train"))
    return out.withColumn("partition", part).drop("_o", "_r", "_qt", "_qv")


def _class_cuts(ordered: DataFrame, quotas: DataFrame, y: str) -> DataFrame | None:
    """(class, _qt, _qv) with the hashes that cut off each class's quotas in place of the quotas, or None
    where rows that share a hash would have to be told apart."""
    rows = quotas.collect()                          # at most MAX_BROADCAST_CLASSES
    found = Selector(ordered, "_o", by=y, n_groups=max(len(rows), 1))
    cuts = found.cuts([(r[y], int(k)) for r in rows for k in (r["_qt"], r["_qv"])])
    if any(c is not None and c.upto != k for (_, k), c in cuts.items() if k >= 1):
        return None
    last = "g"                                       # after every hex string
    table = [(r[y], *[c.order if (c := cuts[r[y], int(r[k])]) else last for k in ("_qt", "_qv")]) for r in rows]
    kind = T.StructType([quotas.schema[y], T.StructField("_qt", T.StringType()), T.StructField("_qv", T.StringType())])
    return ordered.sparkSession.createDataFrame(table, kind)


def three_way_split(df: DataFrame, key_col: str, test_size=0.15, seed: int = 10032023) -> DataFrame:
    """Shuffle (seeded), then the first n rows are test, the next n
    validation, the rest train; a float ``test_size`` means round(N*share), half to even.
    Two cuts by radix selection; rows are ranked only where rows that share a key lie across a cut."""
    if isinstance(test_size, bool) or not isinstance(test_size, (int, float)):
        raise TypeError("test_size must be an int or a float")
    ordered = df.withColumn("_o", det(seed, key_col))
    found = Selector(ordered, "_o")
    n_test = round(found.total * test_size) if isinstance(test_size, float) else test_size
    cuts = found.cuts([(0, n_test), (0, 2 * n_test)])
    one, two = cuts[0, n_test], cuts[0, 2 * n_test]
    if all(c is None or k < 1 or c.upto == k for (_, k), c in cuts.items()):
        test, validation = within(F.col("_o"), one), within(F.col("_o"), two)
    else:
        ordered = rank_by_hash(ordered, "_o", key_col, out="_r")
        test, validation = F.col("_r") <= n_test, F.col("_r") <= 2 * n_test
    part = F.when(test, F.lit("test")).when(validation, F.lit("validation")).otherwise(F.lit("train"))
    return ordered.withColumn("partition", part).drop("_o", "_r")


def partition_data(df: DataFrame, y: str, key_col: str, split_by: str = "random",
                   company_col: str = "company_name", validation_set: bool = True,
                   test_size: float = 0.15, val_size: float = 0.25, seed: int = 8082023) -> DataFrame:
    """Dispatch to the random or the employer split."""
    if split_by == "random":
        return random_stratified_split(df, y, key_col, validation_set, test_size, val_size, seed)
    if split_by == "employers":
        return split_by_employers(df, company_col, validation_set, test_size, val_size, seed)
    raise ValueError(f"unknown split {split_by!r}: choose 'random' or 'employers'")


def partition_leakage(df: DataFrame, company_col: str = "company_name") -> DataFrame:
    """U4: employers that occur in more than one real partition (must be empty)."""
    real = df.filter((F.col("partition") != F.lit("dropped")) & F.col(company_col).isNotNull())
    return (real.groupBy(company_col)
            .agg(F.count_distinct("partition").alias("n_partitions"))
            .filter(F.col("n_partitions") > 1))


def partition_counts(df: DataFrame) -> DataFrame:
    """Rows per partition."""
    return df.groupBy("partition").agg(F.count(F.lit(1)).alias("n"))


def select_partition(df: DataFrame, partition: str, *cols: str) -> DataFrame:
    """The chosen columns of one partition."""
    out = df.filter(F.col("partition") == F.lit(partition))
    return out.select(*cols) if cols else out
