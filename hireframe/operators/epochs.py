"""A logistic detector trained by full-batch gradient descent, with a history per epoch.

The model is a table (feature, weight) in the shared folder.  An epoch joins it to the examples'
features, sums each example's logit, turns the errors of the training rows into one gradient per
feature and writes the next table.  The examples' features are partitioned and sorted by example once
and kept, so the only rows that move in an epoch are partial gradients: at most one row per feature
and task.  A weight table of checked size is broadcast; a larger one is joined by shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import decide, sigmoid
from ..functions.sizing import broadcast_if_small
from ..session import shared_dir
from .evaluate import cross_entropy

#: The bias is the weight of a feature that every example has once.
BIAS = "<bias>"


@dataclass
class Training:
    weights: DataFrame      # feature, w
    history: DataFrame      # epoch, train_loss, train_accuracy, validation_loss, validation_accuracy


def example_features(examples: DataFrame, key_col: str, y_col: str, part_col: str, features_col: str) -> DataFrame:
    """(key, part, y, feature, x): the share of every feature among an example's features, and the bias.
    An example without features has the bias alone; null features are none of an example's features."""
    feats = F.array_compact(F.coalesce(F.col(features_col), F.array().cast("array<string>")))
    base = examples.select(F.col(key_col).alias("key"), F.col(part_col).alias("part"), F.col(y_col).cast("int").alias("y"), feats.alias("f"))
    one = base.select("key", "part", "y", F.explode(F.array_append("f", F.lit(BIAS))).alias("feature"),
                      F.size("f").alias("_n"))
    x = F.when(F.col("feature") == BIAS, F.lit(1.0)).otherwise(1.0 / F.col("_n"))
    return one.groupBy("key", "part", "y", "feature").agg(F.sum(x).alias("x"))


def train_epochs(examples: DataFrame, key_col: str, y_col: str, part_col: str, features_col: str,
                 epochs: int = 4, rate: float = 8.0) -> Training:
    """Train on the rows of partition 'train'; the history has mean loss and accuracy (P12 at 0.5) of
    the training and validation rows with the weights after each epoch.

    Rows with a null label, and rows of other partitions than train and validation, are left out.
    Keys must name rows.  Without training rows the weights stay 0; a partition without rows has
    null figures.
    """
    if epochs < 1:
        raise ValueError("epochs must be at least 1")
    spark = examples.sparkSession
    shared_dir(spark)
    used = examples.where(F.col(part_col).isin("train", "validation") & F.col(y_col).isNotNull())
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = (example_features(used, key_col, y_col, part_col, features_col).checkpoint(eager=True)
            .repartition(parts, "key").sortWithinPartitions("key").persist(StorageLevel.MEMORY_AND_DISK))
    n_train = max(used.where(F.col(part_col) == "train").count(), 1)
    weights = rows.select("feature").distinct().select("feature", F.lit(0.0).alias("w")).checkpoint(eager=True)
    history = []
    for epoch in range(epochs + 1):
        logits = (rows.join(broadcast_if_small(weights), "feature").groupBy("key", "part", "y")
                  .agg(F.sum(F.col("x") * F.col("w")).alias("z")).withColumn("p", sigmoid("z")))
        if epoch:
            history.append((epoch, *_figures(logits)))
        if epoch == epochs:
            break
        errors = logits.where("part = 'train'").select("key", (F.col("p") - F.col("y")).alias("e"))
        slope = rows.join(errors, "key").groupBy("feature").agg(F.sum(F.col("x") * F.col("e")).alias("g"))
        weights = (weights.join(slope, "feature", "left")
                   .select("feature", (F.col("w") - F.lit(rate / n_train) * F.coalesce("g", F.lit(0.0))).alias("w")).checkpoint(eager=True))
    rows.unpersist()
    schema = "epoch int, train_loss double, train_accuracy double, validation_loss double, validation_accuracy double"
    return Training(weights, spark.createDataFrame(history, schema))


def _figures(logits: DataFrame) -> list:
    hit = (decide("p") == F.col("y")).cast("double")
    got = {r["part"]: (r["loss"], r["accuracy"]) for r in logits.groupBy("part").agg(
        F.avg(cross_entropy(logits, "y", "p")).alias("loss"), F.avg(hit).alias("accuracy")).collect()}
    return [v for part in ("train", "validation") for v in got.get(part, (None, None))]


def probabilities(weights: DataFrame, examples: DataFrame, key_col: str, features_col: str) -> DataFrame:
    """(key, p) of new examples; unknown features weigh nothing."""
    rows = example_features(examples.withColumn("_part", F.lit("new")).withColumn("_y", F.lit(0)), key_col, "_y", "_part", features_col)
    z = rows.join(broadcast_if_small(weights), "feature", "left").groupBy("key").agg(F.sum(F.col("x") * F.coalesce("w", F.lit(0.0))).alias("z"))
    return z.select(F.col("key").alias(key_col), sigmoid("z").alias("p"))
