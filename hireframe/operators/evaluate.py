"""Evaluation: class distribution (A2), label index (A4, J11), baselines (A6,
A7), accuracy (A8), per-class report (A9, A10), cross-entropy (A14).

All of them aggregate first; only class-level tables (a few rows per class)
are ever combined, so nothing large meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sizing import broadcast_if_small


def class_distribution(df: DataFrame, label_col: str = "industry") -> DataFrame:
    """A2: rows per class, largest first (ties by label)."""
    return (df.filter(F.col(label_col).isNotNull()).groupBy(label_col)
            .agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), F.col(label_col)))


def label_index(df: DataFrame, label_col: str = "industry") -> DataFrame:
    """Distinct labels in sorted order -> 0-based index (label, idx)."""
    labels = df.select(label_col).where(F.col(label_col).isNotNull()).distinct()
    return labels.select(F.col(label_col).alias("label"),
                         (F.row_number().over(Window.orderBy(label_col)) - 1).cast("int").alias("idx"))


def encode_labels(df: DataFrame, index: DataFrame, label_col: str = "industry", out: str = "target") -> DataFrame:
    """A4: add the class index; an unseen label gets NULL (the caller may reject it)."""
    return df.join(broadcast_if_small(index.select(F.col("label").alias(label_col), F.col("idx").alias(out))),
                   label_col, "left")


def decode_labels(df: DataFrame, index: DataFrame, idx_col: str = "target", out: str = "label") -> DataFrame:
    """Class index -> label."""
    return df.join(broadcast_if_small(index.select(F.col("idx").alias(idx_col), F.col("label").alias(out))),
                   idx_col, "left")


def baseline_accuracy(df: DataFrame, label_col: str = "industry", compat: bool = False) -> DataFrame:
    """ZeroR = max share; random guessing = sum of squared shares
    (``compat`` = the original's operator-precedence result sum(n_k)/n^2 = 1/n)."""
    counts = df.filter(F.col(label_col).isNotNull()).groupBy(label_col).agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.withColumn("_n", F.col("_n").cast("decimal(19,0)"))   # squares pass 2^63 from 3e9 rows on
    n = F.sum("_n").cast("double")
    rnd = (n / (n * n)) if compat else F.sum(F.col("_n") * F.col("_n")).cast("double") / (n * n)
    return counts.agg((F.max("_n").cast("double") / n).alias("zero_r"), rnd.alias("random_guess"))


def accuracy(pred: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """Share of rows with y_pred == y_true (NULL prediction counts as wrong)."""
    hit = F.coalesce((F.col(y_true) == F.col(y_pred)).cast("double"), F.lit(0.0))
    return pred.agg(F.avg(hit).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def classification_report(pred: DataFrame, classes: DataFrame | list[str], y_true: str = "y_true",
                          y_pred: str = "y_pred", digits: int = 6) -> DataFrame:
    """Per-class precision, recall, F1, support with zero_division = 1,
    then 'accuracy' (or 'micro avg' when the class list differs from the
    observed classes), 'macro avg' and 'weighted avg' rows.

    precision = tp/(tp+fp) (1 if nothing predicted), recall = tp/(tp+fn)
    (1 if no support), F1 = 2tp/(2tp+fp+fn) (1 if all three are 0).
    """
    spark = pred.sparkSession
    if isinstance(classes, list):
        classes = spark.createDataFrame([(c,) for c in classes], "label string")
    cls = classes.select(F.col("label").alias("class")).distinct()
    p = pred.select(F.col(y_true).alias("t"), F.col(y_pred).alias("p"))
    conf = p.groupBy("t", "p").agg(F.count(F.lit(1)).alias("n")).cache()
    sup = conf.groupBy(F.col("t").alias("class")).agg(F.sum("n").alias("support"))
    prd = conf.groupBy(F.col("p").alias("class")).agg(F.sum("n").alias("predicted"))
    tp = conf.filter(F.col("t") == F.col("p")).groupBy(F.col("t").alias("class")).agg(F.sum("n").alias("tp"))
    per = (cls.join(sup, "class", "left").join(prd, "class", "left").join(tp, "class", "left")
           .fillna(0, ["support", "predicted", "tp"]))
    fp = F.col("predicted") - F.col("tp")
    fn = F.col("support") - F.col("tp")
    per = per.select(
        "class",
        F.when(F.col("predicted") == 0, F.lit(1.0)).otherwise(F.col("tp") / F.col("predicted")).alias("precision"),
        F.when(F.col("support") == 0, F.lit(1.0)).otherwise(F.col("tp") / F.col("support")).alias("recall"),
        F.when(2 * F.col("tp") + fp + fn == 0, F.lit(1.0))
        .otherwise(2 * F.col("tp") / (2 * F.col("tp") + fp + fn)).alias("f1"),
        F.col("support").cast("bigint").alias("support")).cache()
    observed = (conf.select(F.col("t").alias("c")).union(conf.select(F.col("p").alias("c")))
                .where(F.col("c").isNotNull()).distinct())
    listed = cls.select(F.col("class").alias("c"), F.lit(1).alias("_l"))
    # classes seen but not listed, or listed but not seen (one job on class-level tables)
    n_diff = (observed.withColumn("_o", F.lit(1)).join(listed, "c", "full_outer")
              .filter(F.col("_o").isNull() | F.col("_l").isNull()).count())
    total = p.agg(F.count(F.lit(1)).alias("n"),
                  F.sum(F.coalesce((F.col("t") == F.col("p")).cast("long"), F.lit(0))).alias("hits"))
    acc = total.select(
        F.lit("accuracy" if n_diff == 0 else "micro avg").alias("class"),
        *[(F.col("hits") / F.col("n")).alias(c) for c in ("precision", "recall", "f1")],
        F.col("n").cast("bigint").alias("support"))
    macro = per.agg(F.lit("macro avg").alias("class"), F.avg("precision").alias("precision"),
                    F.avg("recall").alias("recall"), F.avg("f1").alias("f1"),
                    F.sum("support").cast("bigint").alias("support"))
    s = F.sum("support")
    weighted = per.agg(F.lit("weighted avg").alias("class"),
                       (F.sum(F.col("precision") * F.col("support")) / s).alias("precision"),
                       (F.sum(F.col("recall") * F.col("support")) / s).alias("recall"),
                       (F.sum(F.col("f1") * F.col("support")) / s).alias("f1"),
                       s.cast("bigint").alias("support"))
    out = per.unionByName(acc).unionByName(macro).unionByName(weighted)
    return out.select("class", *[F.round(c, digits).alias(c) for c in ("precision", "recall", "f1")], "support")


def cross_entropy(df: DataFrame, y_col: str, p_col: str) -> Column:
    """A14 building block (use inside an aggregate): per-row binary cross-entropy,
    each log floored at -100."""
    y, p = F.col(y_col).cast("double"), F.col(p_col)
    lp = F.greatest(F.log(p), F.lit(-100.0))
    lq = F.greatest(F.log(F.lit(1.0) - p), F.lit(-100.0))
    return -(y * lp + (F.lit(1.0) - y) * lq)


def binary_eval(df: DataFrame, y_col: str, p_col: str, by: str | None = None,
                threshold: float = 0.5, digits: int = 3) -> DataFrame:
    """Mean loss and accuracy (rounded), optionally per group."""
    hit = ((F.col(p_col) >= F.lit(threshold)).cast("int") == F.col(y_col).cast("int")).cast("double")
    aggs = [F.round(F.avg(cross_entropy(df, y_col, p_col)), digits).alias("loss"),
            F.round(F.avg(hit), digits).alias("accuracy"), F.count(F.lit(1)).alias("n")]
    return df.groupBy(by).agg(*aggs) if by else df.agg(*aggs)

