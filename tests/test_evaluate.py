from pyspark.sql import functions as F

from hireframe.operators.evaluate import baseline_accuracy, classification_report, label_index
from hireframe.operators.voting import majority_vote, one_per_employer


def test_report_zero_division(spark):
    pred = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b")], "y_true string, y_pred string")
    rep = {r["class"]: r for r in classification_report(pred, ["a", "b", "c"]).collect()}
    assert (rep["c"].precision, rep["c"].recall, rep["c"].f1, rep["c"].support) == (1.0, 1.0, 1.0, 0)
    assert rep["a"].precision == 1.0 and rep["a"].recall == 0.5
    assert "micro avg" in rep and "accuracy" not in rep
    pred2 = spark.createDataFrame([("a", "c"), ("a", "a")], "y_true string, y_pred string")
    rep2 = {r["class"]: r for r in classification_report(pred2, ["a", "c"]).collect()}
    assert (rep2["c"].precision, rep2["c"].recall, rep2["c"].f1) == (0.0, 1.0, 0.0)
    assert "accuracy" in rep2 and rep2["accuracy"].f1 == 0.5


def test_vote_tie_lowest_label(spark):
    df = spark.createDataFrame([("x", "b"), ("x", "a"), ("y", "b"), ("y", "b"), ("y", "a")],
                               "company_name string, industry string")
    got = {r.company_name: r.industry for r in majority_vote(df).collect()}
    assert got == {"x": "a", "y": "b"}


def test_baselines_and_index(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), ("c",)], "industry string")
    r = baseline_accuracy(df).first()
    assert r.zero_r == 0.5 and abs(r.random_guess - (0.25 + 0.0625 + 0.0625)) < 1e-12
    assert baseline_accuracy(df, compat=True).first().random_guess == 0.25
    assert [(x.label, x.idx) for x in label_index(df).orderBy("idx").collect()] == [("a", 0), ("b", 1), ("c", 2)]


def test_one_per_employer(spark):
    df = spark.createDataFrame([("p1", "x"), ("p2", "x"), ("p3", "y")], "uniq_id string, company_name string")
    assert one_per_employer(df, "uniq_id").count() == 2


def test_baselines_of_ten_billion_rows(spark):
    """The aggregate of the baselines, on class counts whose squares pass 2^63."""
    n = F.col("n").cast("decimal(19,0)")
    rows = spark.createDataFrame([(9_000_000_000,), (1_000_000_000,)], "n long").select(n.alias("n"))
    t = F.sum("n").cast("double")
    r = rows.agg((F.sum(F.col("n") * F.col("n")).cast("double") / (t * t)).alias("x")).first()
    assert abs(r.x - 0.82) < 1e-12


def test_label_index_both_ways_at_any_size(spark, monkeypatch):
    from hireframe.functions import sizing
    from hireframe.operators.evaluate import decode_labels, encode_labels, label_index

    df = spark.createDataFrame([("b", 1), ("a", 2), ("c", 3), (None, 4)], "industry string, k int")
    index = label_index(df.where("k < 3"))
    for most in (10, 1):                          # 1: the index is too large to be broadcast
        monkeypatch.setattr(sizing, "MAX_BROADCAST_ROWS", most)
        coded = encode_labels(df, index)
        assert {r.k: r.target for r in coded.collect()} == {1: 1, 2: 0, 3: None, 4: None}
        assert {r.k: r.label for r in decode_labels(coded, index).collect()} == {1: "b", 2: "a", 3: None, 4: None}
