import pytest
from pyspark.sql import functions as F

from hireframe.functions.predicates import (decide, default_text, label_above, like_any, null_if_empty,
                                            one_vs_rest, sql_pattern_formatting)


@pytest.mark.parametrize("bad", [7, None, ["gear", None], {"gear"}])
def test_patterns_must_be_text(bad):
    with pytest.raises(TypeError, match="strings"):
        sql_pattern_formatting(bad)


def test_each_pattern_becomes_one_literal():
    assert sql_pattern_formatting(("swiss hotel", "50@%")) == ["'% swiss hotel%'", "'% 50@%%'"]
    assert sql_pattern_formatting([]) == []


def test_bare_string_is_one_pattern():
    assert sql_pattern_formatting("gear") == ["'% gear%'"]


def test_leading_space_rule(spark):
    df = spark.createDataFrame([("basel university",), ("university of basel",), ("Basel UNIVERSITY x",)], "c string")
    got = {r.c for r in df.filter(like_any("c", ["university"])).collect()}
    assert got == {"basel university", "Basel UNIVERSITY x"}


def test_like_escape(spark):
    df = spark.createDataFrame([("a 50% off",), ("a 50x off",)], "c string")
    got = {r.c for r in df.filter(like_any("c", ["50@%"])).collect()}
    assert got == {"a 50% off"}


def test_single_pattern_compat_is_exact(spark):
    df = spark.createDataFrame([("gear",), ("big gear",)], "c string")
    assert {r.c for r in df.filter(like_any("c", ["gear"], compat=True)).collect()} == {"gear"}
    assert {r.c for r in df.filter(like_any("c", ["gear"])).collect()} == {"big gear"}


def test_row_rules(spark):
    df = spark.createDataFrame([("", 0.75, "en"), (None, 0.7501, "fr"), ("x", 0.5, None)],
                               "d string, s double, lab string")
    rows = df.select(null_if_empty("d").alias("a"), default_text("d").alias("b"),
                     label_above(F.lit("L"), "s").alias("c"), decide("s").alias("e"),
                     one_vs_rest("lab", "en").alias("f")).collect()
    assert [r.a for r in rows] == [None, None, "x"]
    assert [r.b for r in rows] == ["no relevant information", "no relevant information", "x"]
    assert [r.c for r in rows] == [None, "L", None]
    assert [r.e for r in rows] == [1, 1, 1]
    assert [r.f for r in rows] == [1, 0, 0]
