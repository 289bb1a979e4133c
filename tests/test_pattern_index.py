import random

import pytest
from pyspark.sql import functions as F

from hireframe.operators import labelling

NAMES = ["hot rod ag", "rod", " rod", "the RODeo  inc", "a b", "x 100% y", "x 100 y", "under_score co", "under score", "swiss bank of Zürich", "SWISS BANK", "bank", "",
         "two  spaces", "ends with ", None, "hot rod ag", "an @home co", "ÉCOLE École", "long " + "q" * 300 + " bank"]
PATTERNS = [("tools", 2, "rod"), ("bank", 1, "bank"), ("bank", 1, "swiss"), ("edge", 3, ""), ("pct", 4, "100%y"), ("pct", 4, "100@%"), ("us", 5, "und_r"), ("us", 5, "nothing here"),
            ("long", 6, "q" * 40), ("space", 7, " spaces"), ("fr", 8, "école"), ("tools", 2, "rod"), ("none", 9, None)]


def tables(spark):
    names = spark.createDataFrame([(f"u{i}", n) for i, n in enumerate(NAMES * 2)], "uniq_id string, company_name string")
    return names, spark.createDataFrame(PATTERNS, "industry string, industry_rank int, pattern string")


@pytest.mark.parametrize("anchor", ["space", "word"])
def test_index_equals_the_chain(spark, monkeypatch, anchor):
    names, patterns = tables(spark)
    chain = sorted(map(tuple, labelling.pattern_employers(names, patterns, anchor).collect()))
    monkeypatch.setattr(labelling, "CHAIN_PATTERNS", 0)
    assert sorted(map(tuple, labelling.pattern_employers(names, patterns, anchor).collect())) == chain and len(chain) > 8


@pytest.mark.parametrize("compat", [False, True])
def test_labels_equal_the_chain(spark, monkeypatch, compat):
    names, patterns = tables(spark)
    companies = spark.createDataFrame([("bank", 1, "a b"), ("us", 5, "rod")], "industry string, industry_rank int, company_name string")
    both = lambda: (sorted(map(repr, labelling.label_employers(names, companies, patterns, compat=compat).collect())),
                    sorted(map(repr, labelling.labelled_employers(names, companies, patterns, compat=compat).collect())))
    chain = both()
    monkeypatch.setattr(labelling, "CHAIN_PATTERNS", 0)
    assert both() == chain


def test_two_hundred_thousand_patterns(spark):
    rng = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = ["".join(rng.choices(letters, k=rng.randint(4, 12))) for _ in range(2000)]
    names = spark.createDataFrame([(f"{words[i % 2000]} {words[(i * 7 + 1) % 2000]}",) for i in range(3000)], "company_name string")
    patterns = spark.range(200_000).select(
        F.concat(F.lit("i"), (F.col("id") % 50).cast("string")).alias("industry"), (F.col("id") % 50).cast("int").alias("industry_rank"),
        F.concat(F.lit(words[5]), F.col("id").cast("string")).alias("pattern")).unionByName(
        spark.createDataFrame([("own", 60, w) for w in words[:100]], "industry string, industry_rank int, pattern string"))
    got = {(r.company_name, r.pattern) for r in labelling.indexed_matches(names, patterns).collect()}
    have = {r.company_name for r in names.collect()}
    assert got == {(n, w) for n in have for w in words[:100] if " " + w in n} and got


def test_a_plan_without_nested_loops(spark):
    names, patterns = tables(spark)
    plan = labelling.indexed_matches(names, patterns)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_empty_tables(spark):
    names, patterns = tables(spark)
    assert labelling.indexed_matches(names, patterns.limit(0)).collect() == [] and labelling.indexed_matches(names.limit(0), patterns).collect() == []
