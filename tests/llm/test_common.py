import time

from pyspark.sql import functions as F

from hireframe.llm.common import no_shuffles_left, saved


def _shuffles(spark):
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {f.getName() for f in (found.apply(i) for i in range(found.size())) if f.getName().startswith("shuffle_")}


def test_a_written_step_leaves_no_shuffle_files(spark):
    """Else the disks hold the shuffles of all steps until the driver collects its garbage."""
    before = _shuffles(spark)
    out = saved(spark.range(50_000).groupBy((F.col("id") % 1000).alias("k")).count().repartition(5), "t")
    until = time.time() + 20
    while _shuffles(spark) - before and time.time() < until:
        time.sleep(0.2)
    assert not _shuffles(spark) - before
    assert out.count() == 1000 and out.agg(F.sum("count")).first()[0] == 50_000


def test_a_frame_that_was_written_can_be_read_again(spark):
    df = spark.range(1000).repartition(4).groupBy((F.col("id") % 7).alias("k")).count()
    rows = sorted(map(tuple, df.collect()))
    assert sorted(map(tuple, saved(df, "t").collect())) == rows == sorted(map(tuple, df.collect()))


def test_the_setting_is_put_back(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    old = spark.conf.get(key, None)
    try:
        spark.conf.set(key, "false")
        try:
            with no_shuffles_left(spark):
                assert spark.conf.get(key) == "true"
                raise ValueError
        except ValueError:
            pass
        assert spark.conf.get(key) == "false"
    finally:
        spark.conf.unset(key) if old is None else spark.conf.set(key, old)
