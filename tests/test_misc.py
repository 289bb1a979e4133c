"""Public helpers not exercised by a registered query."""

from pyspark.sql import functions as F

from hireframe.functions import ordering
from hireframe.functions.ordering import det, first_n
from hireframe.operators.evaluate import accuracy, decode_labels, encode_labels, label_index
from hireframe.operators.splitting import select_partition
from hireframe.operators.vocabulary import longest_sequence, pad_to_longest
from hireframe.sources.labels import load_level_mapping


def test_level_mapping_from_json(spark, tmp_path):
    p = tmp_path / "macro_mapping.json"
    p.write_text('{"medtech": "manufacturing", "real estate": "services"}', encoding="utf-8")
    rows = {(r.level, r.industry, r.target) for r in load_level_mapping(spark, str(p), "macro").collect()}
    assert rows == {("macro", "medtech", "manufacturing"), ("macro", "real estate", "services")}


def test_pad_to_longest(spark):
    df = spark.createDataFrame([(1, [3, 4]), (2, [5]), (3, [])], "k int, ids array<int>")
    assert longest_sequence(df) == 2
    got = {r.k: r.ids for r in pad_to_longest(df).collect()}
    assert got == {1: [3, 4], 2: [5, 0], 3: [0, 0]}
    assert {r.k: r.ids for r in pad_to_longest(df, max_len=1).collect()} == {1: [3], 2: [5], 3: [0]}


def test_label_encoding_roundtrip_and_accuracy(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("a",)], "industry string")
    idx = label_index(df)
    enc = encode_labels(df, idx)
    assert sorted((r.industry, r.target) for r in enc.collect()) == [("a", 0), ("a", 0), ("b", 1), ("c", 2)]
    dec = decode_labels(enc.select("target"), idx)
    assert sorted(r.label for r in dec.collect()) == ["a", "a", "b", "c"]
    pred = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", None), ("c", "c")], "y_true string, y_pred string")
    r = accuracy(pred).first()
    assert r.accuracy == 0.5 and r.n == 4


def test_first_n_large_path(spark, monkeypatch):
    df = spark.range(500).withColumn("k", F.col("id").cast("string")).withColumn("o", det(5, "k"))
    small = sorted(r.k for r in first_n(df, 37, "o", "k").collect())
    monkeypatch.setattr(ordering, "TOP_K_MERGE_ROWS", 0)
    large = sorted(r.k for r in first_n(df, 37, "o", "k").collect())
    assert small == large and len(small) == 37


def test_select_partition(spark):
    df = spark.createDataFrame([("x", "test"), ("y", "train")], "c string, partition string")
    assert [r.c for r in select_partition(df, "test", "c").collect()] == ["x"]


def test_cluster_conf_sizes_partitions():
    from hireframe.session import cluster_conf
    c = cluster_conf(100 * (1 << 40), executors=1000, cores_per_executor=8)
    assert int(c["spark.sql.shuffle.partitions"]) == 100 * 4 * 1024   # 100 TB / 256 MB
    assert cluster_conf(1 << 30, 10, 4)["spark.sql.shuffle.partitions"] == "120"   # 3 waves of 40 cores
