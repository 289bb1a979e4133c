"""Metamorphic check: results do not depend on the number of shuffle partitions."""

import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL
from tests.oracle_check import canon

NAMES = ["label_employers", "subsample_per_group", "split_random_stratified", "split_three_way",
         "vocabulary_top", "sample_with_replacement", "employer_description", "detect_language"]


@pytest.mark.parametrize("name", ["vocabulary", "vocabulary_full"])
def test_vocabulary_with_420_partitions(spark, name):
    q = E.queries()[name]
    spark.conf.set("spark.sql.shuffle.partitions", "420")
    try:
        many = canon(q(spark, SF_SMALL).toPandas())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert many == canon(q(spark, SF_SMALL).toPandas())


@pytest.mark.parametrize("name", NAMES)
def test_same_result_for_1_and_8_partitions(spark, name):
    q = E.queries()[name]
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        one = canon(q(spark, SF_SMALL).toPandas())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    eight = canon(q(spark, SF_SMALL).toPandas())
    assert one == eight
