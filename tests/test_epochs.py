import math

import pytest
from pyspark.sql import functions as F

from hireframe.functions.predicates import sigmoid
from hireframe.operators import epochs


def reference(rows, n_epochs, rate):
    """Plain gradient descent over (key, part, y, features)."""
    data = []
    for _, part, y, feats in rows:
        if part in ("train", "validation") and y is not None:
            fs = [f for f in feats or [] if f is not None]
            x = {epochs.BIAS: 1.0}
            for f in fs:
                x[f] = x.get(f, 0) + 1 / len(fs)
            data.append((part, y, x))
    w, history = {f: 0.0 for _, _, x in data for f in x}, []
    n = max(sum(p == "train" for p, _, _ in data), 1)
    prob = lambda x: 1 / (1 + math.exp(-sum(v * w[f] for f, v in x.items())))
    for _ in range(n_epochs):
        g = dict.fromkeys(w, 0.0)
        for part, y, x in data:
            if part == "train":
                e = prob(x) - y
                for f, v in x.items():
                    g[f] += v * e
        w = {f: w[f] - rate / n * g[f] for f in w}
        row = []
        for part in ("train", "validation"):
            ps = [(y, prob(x)) for p, y, x in data if p == part]
            row += [sum(-math.log(p if y else 1 - p) for y, p in ps) / len(ps), sum((p >= 0.5) == (y == 1) for y, p in ps) / len(ps)] if ps else [None, None]
        history.append(row)
    return w, history


ROWS = [(i, ["train", "validation", "test"][i % 5 // 2], i % 2, [f"w{(i * 7 + j * (i % 2 + 1)) % 9}" for j in range(i % 6)]) for i in range(90)]
ROWS += [(90, "train", None, ["w1"]), (91, "train", 1, None), (92, "train", 0, [None, "w2", None]), (93, "train", 1, ["only"] * 400), (94, None, 1, ["w1"])]
SCHEMA = "k int, part string, y int, f array<string>"


@pytest.mark.parametrize("rows", [0, 2_000_000])
def test_history_against_plain_descent(spark, monkeypatch, rows):
    from hireframe.functions import sizing
    monkeypatch.setattr(sizing, "MAX_BROADCAST_ROWS", rows)          # 0: weights joined by shuffle
    df = spark.createDataFrame(ROWS, SCHEMA).withColumn("key", F.lit("clash")).withColumn("w", F.lit(9.0))
    got = epochs.train_epochs(df, "k", "y", "part", "f", epochs=3, rate=4.0)
    w, history = reference(ROWS, 3, 4.0)
    assert {r["feature"]: pytest.approx(r["w"], abs=1e-12) for r in got.weights.collect()} == w
    rows_ = got.history.orderBy("epoch").collect()
    assert [r["epoch"] for r in rows_] == [1, 2, 3]
    for r, want in zip(rows_, history):
        assert list(r)[1:] == pytest.approx(want, abs=1e-12)
    new = spark.createDataFrame([(1, ["w1", "unseen"]), (2, []), (3, None)], "k int, f array<string>")
    p = {r["k"]: r["p"] for r in epochs.probabilities(got.weights, new, "k", "f").collect()}
    assert p[1] == pytest.approx(1 / (1 + math.exp(-(w["w1"] / 2 + w[epochs.BIAS])))) and p[2] == p[3] == pytest.approx(1 / (1 + math.exp(-w[epochs.BIAS])))


def test_loss_falls_and_empty_tables(spark):
    df = spark.createDataFrame([(i, "train", i % 2, ["a" if i % 2 else "b", "c"]) for i in range(40)], SCHEMA)
    h = epochs.train_epochs(df, "k", "y", "part", "f", epochs=3).history.orderBy("epoch").collect()
    assert h[0]["train_loss"] > h[1]["train_loss"] > h[2]["train_loss"] and h[2]["train_accuracy"] == 1.0
    assert h[0]["validation_loss"] is None and h[0]["validation_accuracy"] is None
    none = epochs.train_epochs(df.limit(0), "k", "y", "part", "f", epochs=1)
    assert none.weights.count() == 0 and none.history.first()["train_loss"] is None
    with pytest.raises(ValueError):
        epochs.train_epochs(df, "k", "y", "part", "f", epochs=0)


def test_sigmoid(spark):
    r = spark.createDataFrame([(0.0, 800.0, -800.0, None)], "a double, b double, c double, d double").select(*[sigmoid(c).alias(c) for c in "abcd"]).first()
    assert list(r) == [0.5, 1.0, 0.0, None]
