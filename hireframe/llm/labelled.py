"""Bounded labelled samples and score calibration for the trained filters."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved


def id_remainder(id_col: str | Column, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod`` (null for a null id)."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(c.cast("string").cast("binary")) % mod


def labelled_sample(labels: DataFrame, label_col: str, keep: Column, per_class: int, id_col: str = "doc_id", seed: int = 1) -> tuple[DataFrame, dict[int, int]]:
    """(id, y, part) of at most ``per_class`` rows of each class, and the class counts among all kept labels.

    Rows with a null id or label are ignored, as are ids labelled both ways.  The rows are the first
    by a seeded hash, so the choice does not depend on partitioning; part 0 fits, part 1 calibrates.
    """
    one = (labels.where(keep & F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id"))
           .agg(F.min(label_col).alias("y"), F.max(label_col).alias("_y")).where("y = _y").select("id", "y"))
    one = saved(one, "labels")
    counts = {int(r["y"]): int(r["n"]) for r in one.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    h = F.xxhash64("id", F.lit(seed))
    picked = [one.where(F.col("y") == y).orderBy(h, "id").limit(per_class) for y in (0, 1)]
    both = picked[0].unionByName(picked[1]).withColumn("part", F.pmod(F.xxhash64("id", F.lit(seed + 1)), F.lit(2)).cast("int"))
    return saved(both, "labels-sample"), counts


def calibrate(z: np.ndarray, y: np.ndarray, counts: dict[int, int], ridge: float = 1e-3) -> tuple[float, float, float]:
    """Logistic curve (slope, offset, scale): score = 1 / (1 + exp(-(slope * z / scale + offset))).

    Classes are weighted to their share among all labels, so the score estimates a probability.
    Without both classes the score is the constant share.
    """
    total = sum(counts.values())
    share = (counts.get(1, 0) + 1) / (total + 2)
    if len(np.unique(y)) < 2:
        return 0.0, float(np.log(share / (1 - share))), 1.0
    scale = float(np.std(z)) or 1.0
    x = np.c_[z / scale, np.ones(len(z))]
    w = np.where(y == 1, share / np.mean(y == 1), (1 - share) / np.mean(y == 0))
    beta = np.array([0.0, np.log(share / (1 - share))])

    def loss(b):
        m = x @ b
        return np.sum(w * (np.logaddexp(0, m) - y * m)) + ridge * len(y) * b[0] ** 2 / 2

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -35, 35)))
        g = x.T @ (w * (p - y)) + ridge * len(y) * beta * [1, 0]
        hess = (x * (w * p * (1 - p))[:, None]).T @ x + np.diag([ridge * len(y), 1e-9])
        step, t = np.linalg.solve(hess, g), 1.0
        while loss(beta - t * step) > loss(beta) and t > 1e-6:
            t /= 2
        beta = beta - t * step
        if np.abs(t * step).max() < 1e-9:
            break
    return float(beta[0]), float(beta[1]), scale


def probability(z: np.ndarray, curve: tuple[float, float, float]) -> np.ndarray:
    slope, offset, scale = curve
    return 1 / (1 + np.exp(-np.clip(slope * np.asarray(z, float) / scale + offset, -35, 35)))
