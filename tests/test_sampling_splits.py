import pytest
import hashlib

from pyspark.sql import Window
from pyspark.sql import functions as F

from hireframe.functions.ordering import det, rank_by_hash, running_total_by_hash
from hireframe.operators.sampling import rebalance, sample_with_replacement, subsample
from hireframe.operators.splitting import (partition_leakage, random_stratified_split, split_by_employers,
                                           three_way_split)


def md5(s):
    return hashlib.md5(s.encode()).hexdigest()


def test_two_level_rank_equals_global_row_number(spark):
    df = spark.range(5000).withColumn("k", F.col("id").cast("string")).withColumn("o", det(7, "k"))
    mine = rank_by_hash(df, "o", "k", out="r").select("k", "r")
    ref = df.select("k", F.row_number().over(Window.orderBy("o", "k")).alias("r"))
    assert mine.exceptAll(ref).count() == 0 and mine.count() == 5000


def test_two_level_running_total(spark):
    df = spark.range(3000).withColumn("k", F.col("id").cast("string")).withColumn("o", det(3, "k")) \
        .withColumn("v", F.col("id") % 7)
    mine = running_total_by_hash(df, "v", "o", "k", out="cs").select("k", "cs")
    w = Window.orderBy("o", "k").rowsBetween(Window.unboundedPreceding, 0)
    ref = df.select("k", F.sum("v").over(w).alias("cs"))
    assert mine.exceptAll(ref).count() == 0


def test_subsample_caps_and_drops_null_groups(spark):
    rows = [(f"u{i}", "a" if i < 10 else ("b" if i < 13 else None)) for i in range(15)]
    df = spark.createDataFrame(rows, "uniq_id string, g string")
    out = subsample(df, "g", "uniq_id", max_n_per_group=4)
    counts = {r.g: r["count"] for r in out.groupBy("g").count().collect()}
    assert counts == {"a": 4, "b": 3}
    chosen = sorted(r.uniq_id for r in out.filter("g = 'a'").collect())
    expect = sorted(sorted((md5(f"4082023:u{i}"), f"u{i}") for i in range(10))[:4])
    assert chosen == sorted(k for _, k in expect)


def test_sample_with_replacement_exact_n(spark):
    df = spark.createDataFrame([(f"r{i}",) for i in range(7)], "k string")
    out = sample_with_replacement(df, 50, "k", seed=1)
    assert out.count() == 50
    assert set(r.k for r in out.collect()) <= {f"r{i}" for i in range(7)}


def test_rebalance_draws_others(spark):
    rows = [(f"t{i}", "en") for i in range(10)] + [(f"o{i}", "fr") for i in range(4)]
    df = spark.createDataFrame(rows, "k string, labels string")
    out = rebalance(df, "labels", "k", "en", 0.25)
    assert out.filter("labels = 'en'").count() == 10
    assert out.filter("labels <> 'en'").count() == 30


def test_employer_split_boundary_is_dropped(spark):
    names = ["e1", "e2", "e3"]
    first = min(names, key=lambda n: md5(f"8082023:{n}"))
    rest = [n for n in names if n != first]
    rows = [("p0", first), ("p1", rest[0]), ("p2", rest[1]), ("p3", rest[1])]
    df = spark.createDataFrame(rows, "uniq_id string, company_name string")
    out = split_by_employers(df, validation_set=False, test_size=0.25)
    got = {r.company_name: r.partition for r in out.collect()}
    assert got[first] == "dropped"
    assert got[rest[0]] == "train" and got[rest[1]] == "train"


def test_employer_split_properties(spark):
    rows = [(f"p{i}", f"c{i % 37}" if i % 41 else None) for i in range(2000)]
    df = spark.createDataFrame(rows, "uniq_id string, company_name string")
    out = split_by_employers(df).cache()
    assert out.count() == 2000
    assert partition_leakage(out).count() == 0
    assert out.filter("company_name is null and partition <> 'dropped'").count() == 0
    assert {r.partition for r in out.collect()} <= {"train", "validation", "test", "dropped"}


def test_split_same_for_one_and_eight_partitions(spark):
    rows = [(f"p{i}", f"c{i % 13}") for i in range(500)]
    df = spark.createDataFrame(rows, "uniq_id string, company_name string")
    a = split_by_employers(df.repartition(1)).collect()
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        b = split_by_employers(df.repartition(8)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_stratified_quotas(spark):
    rows = [(f"u{i}", "a" if i < 70 else ("b" if i < 95 else "c")) for i in range(100)]
    df = spark.createDataFrame(rows, "uniq_id string, y string")
    out = random_stratified_split(df, "y", "uniq_id", validation_set=True, test_size=0.15, val_size=0.25)
    counts = {(r.y, r.partition): r["count"] for r in out.groupBy("y", "partition").count().collect()}
    assert sum(v for (y, p), v in counts.items() if p == "test") == 15
    assert sum(v for (y, p), v in counts.items() if p == "validation") == 22   # ceil(85 * .25)
    assert counts[("a", "test")] == 10 and counts[("b", "test")] in (4, 5)


def test_three_way_sizes(spark):
    df = spark.range(101).withColumn("k", F.col("id").cast("string"))
    out = three_way_split(df, "k", 0.15)
    c = {r.partition: r["count"] for r in out.groupBy("partition").count().collect()}
    assert c == {"test": 15, "validation": 15, "train": 71}
    c2 = {r.partition: r["count"] for r in three_way_split(df, "k", 10).groupBy("partition").count().collect()}
    assert c2 == {"test": 10, "validation": 10, "train": 81}


def test_rank_by_sort_equals_row_number(spark):
    from hireframe.functions.ordering import rank_by_sort
    df = spark.range(3000).select((F.col("id") % 17).alias("a"), (F.col("id") * 7919 % 3001).alias("b"))
    mine = rank_by_sort(df, [F.col("a").desc(), F.col("b")], out="r", partitions=5)
    ref = df.select("a", "b", F.row_number().over(Window.orderBy(F.col("a").desc(), "b")).alias("r"))
    assert mine.select("a", "b", "r").exceptAll(ref).count() == 0


@pytest.mark.parametrize("parts", [8, 64, 420])
def test_rank_by_sort_on_many_rows(spark, parts):
    from hireframe.functions.ordering import rank_by_sort
    df = spark.range(300_000, numPartitions=8).select((F.col("id") % 101).alias("a"), (F.col("id") * 7919 % 300_007).alias("b"))
    ranks = rank_by_sort(df, [F.col("a").desc(), F.col("b")], out="r", partitions=parts)
    w = Window.partitionBy("a").orderBy("b")
    wrong = ranks.withColumn("want", F.row_number().over(w)).groupBy("a").agg(
        F.max(F.abs(F.col("r") - F.col("want") - (F.lit(0)))).alias("off"), F.min(F.col("r") - F.col("want")).alias("off2"), F.count("*").alias("n"))
    rows = wrong.orderBy(F.col("a").desc()).collect()
    before = 0
    for r in rows:                      # within a value of "a" ranks run on from the rows that sort before it
        assert r.off == r.off2 == before
        before += r.n
    assert before == 300_000 and ranks.select("r").distinct().count() == 300_000


def test_draws_reach_past_32_bits(spark):
    from hireframe.functions.ordering import hashed_index
    n = 10 ** 12
    top = spark.range(2000).select(hashed_index("s:draw", F.col("id"), n).alias("x")).agg(F.max("x"), F.min("x")).first()
    assert 0 <= top[1] and 0.99 * n < top[0] < n


def test_bucket_count_follows_the_partitions(spark):
    from hireframe.functions.ordering import bucket_bits, det, first_n, rank_by_hash
    df = spark.range(500).withColumn("o", det(1, "id"))
    ref = [r.id for r in df.orderBy("o", "id").collect()]
    spark.conf.set("spark.sql.shuffle.partitions", "2000")
    try:
        assert bucket_bits(spark) == 13
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    for bits in (4, 13, 21):
        assert [r.id for r in rank_by_hash(df, "o", "id", bits=bits).orderBy("rank").collect()] == ref
    from hireframe.functions import ordering
    assert {r.id for r in rank_by_hash(df, "o", "id", at_most=40).collect()} == set(ref[:40])
    assert ordering.MIN_BUCKET_BITS == 12 and {r.id for r in first_n(df, 40, "o", "id").collect()} == set(ref[:40])


def test_quotas_of_ten_billion_rows(spark):
    from hireframe.operators.splitting import _largest_remainder
    n = [6_000_000_001, 3_999_999_999, 7]
    counts = spark.createDataFrame(list(zip("abc", n)), "c string, n long")
    draw = 1_500_000_002
    got = {r.c: r.q for r in _largest_remainder(counts, "c", "n", sum(n), draw, "q").collect()}
    base = [x * draw // sum(n) for x in n]
    rest = sorted(range(3), key=lambda i: (-(n[i] * draw % sum(n)), i))[: draw - sum(base)]
    assert got == {c: base[i] + (i in rest) for i, c in enumerate("abc")} and sum(got.values()) == draw


def test_split_dispatch(spark):
    df = spark.createDataFrame([(f"p{i}", f"c{i % 7}", "ab"[i % 2]) for i in range(60)], "uniq_id string, company_name string, industry string")
    from hireframe.operators.splitting import partition_data, partition_leakage, random_stratified_split
    a = partition_data(df, "industry", "uniq_id", "random", seed=3).select("uniq_id", "partition")
    b = random_stratified_split(df, "industry", "uniq_id", seed=3).select("uniq_id", "partition")
    assert a.exceptAll(b).count() == 0
    assert partition_leakage(partition_data(df, "industry", "uniq_id", "random")).count() > 0
    assert partition_leakage(partition_data(df, "industry", "uniq_id", "employers")).count() == 0
    with pytest.raises(ValueError, match="by week"):
        partition_data(df, "industry", "uniq_id", "by week")


def test_employer_split_without_broadcast(spark, monkeypatch):
    from hireframe.functions import sizing
    rows = [(f"p{i}", f"c{i % 11}") for i in range(300)]
    df = spark.createDataFrame(rows, "uniq_id string, company_name string")
    a = sorted(map(tuple, split_by_employers(df).collect()))
    monkeypatch.setattr(sizing, "MAX_BROADCAST_ROWS", 0)
    b = sorted(map(tuple, split_by_employers(df).collect()))
    assert a == b


@pytest.fixture(params=[(16, 4), (1 << 16, 1 << 14)])
def radix(request, monkeypatch):
    """Small histograms and lists (many rounds), and the real ones."""
    from hireframe.functions import selection
    monkeypatch.setattr(selection, "BINS", request.param[0])
    monkeypatch.setattr(selection, "LISTED", request.param[1])


def test_cuts_against_a_sorted_list(spark, radix):
    from hireframe.functions.selection import Cut, Selector
    rows = [(f"k{i}", "ab"[i % 3 == 0], i % 5) for i in range(400)] + [("hot", "a", 1)] * 50 + [(None, "b", 2)]
    df = spark.createDataFrame(rows, "k string, g string, w int").withColumn("o", det(1, "k"))
    for weight, by in ((None, None), ("w", None), (None, "g"), ("w", "g")):
        found = Selector(df, "o", weight, by, 2)
        assert found.nulls == (2 if weight else 1)
        for g in ("ab" if by else [0]):
            sums = {}
            for k, grp, w in rows:
                if k is not None and (not by or grp == g):
                    sums[md5(f"1:{k}")] = sums.get(md5(f"1:{k}"), 0) + (w if weight else 1)
            total = sum(sums.values())
            assert found.totals[g] == total
            quotas = [-1, 0, 1, 2, total // 3, total // 2, total - 1, total, total + 1]
            got = found.cuts([(g, q) for q in quotas])
            for q in quotas:
                run, want = 0, None if q >= 1 else Cut("", 0, 0)
                for o in sorted(sums) if q >= 1 else []:
                    run += sums[o]
                    if run >= q:
                        want = Cut(o, run - sums[o], run)
                        break
                assert got[g, q] == want


def employer_reference(rows, test, val, boundary="dropped", seed=8082023):
    n = {}
    for _, c in rows:
        if c is not None:
            n[c] = n.get(c, 0) + 1
    order, cs, out = sorted(n, key=lambda c: md5(f"{seed}:{c}")), 0, {None: "dropped"}
    t, run = int(len(rows) * test), {}
    for c in order:
        cs += n[c]
        run[c] = cs
    base = sum(n[c] for c in order if run[c] <= t)
    t2 = int((cs - base) * val) if val is not None else None
    for c in order:
        if run[c] < t:
            out[c] = "test"
        elif run[c] == t:
            out[c] = boundary
        elif val is None:
            out[c] = "train"
        else:
            x = run[c] - base
            out[c] = "validation" if x < t2 else "train" if x > t2 else boundary
    return sorted((k, out[c]) for k, c in rows)


@pytest.mark.parametrize("test,val", [(0.15, 0.25), (0.2, None), (0.0, 0.0), (1.0, 1.0)])
def test_employer_split_against_running_totals(spark, monkeypatch, test, val):
    from hireframe.functions import selection
    monkeypatch.setattr(selection, "BINS", 16)
    monkeypatch.setattr(selection, "LISTED", 4)
    rows = [(f"p{i}", None if i % 19 == 0 else "hot" if i % 3 == 0 else f"c{i % 23}") for i in range(300)]
    df = spark.createDataFrame(rows, "uniq_id string, company_name string")
    for boundary in ("dropped", "train"):
        got = split_by_employers(df, validation_set=val is not None, test_size=test, val_size=val or 0.0, boundary=boundary)
        assert sorted((r.uniq_id, r.partition) for r in got.collect()) == employer_reference(rows, test, val, boundary)
    assert split_by_employers(df.limit(0)).collect() == []


def test_split_by_cut_equals_ranks(spark, radix):
    df = spark.createDataFrame([(f"p{i}", f"y{i % 4}" if i % 4 else "hot") for i in range(333)], "k string, y string")
    for size in (0.15, 0.0, 7, 400):
        got = {r.k: r.partition for r in three_way_split(df, "k", size, seed=5).collect()}
        order = sorted(got, key=lambda k: md5(f"5:{k}"))
        n = round(333 * size) if isinstance(size, float) else size
        assert got == {k: "test" if i < n else "validation" if i < 2 * n else "train" for i, k in enumerate(order)}
    by_cut = {r.k: r.partition for r in random_stratified_split(df, "y", "k", seed=9).collect()}
    from hireframe.operators import splitting
    with pytest.MonkeyPatch.context() as m:
        m.setattr(splitting, "MAX_BROADCAST_CLASSES", 1)
        assert {r.k: r.partition for r in random_stratified_split(df, "y", "k", seed=9).collect()} == by_cut


def test_rows_that_share_a_key_across_a_cut(spark):
    df = spark.createDataFrame([(f"p{i % 9}", "y", i) for i in range(90)], "k string, y string, i int")
    for size in (0.15, 0.3):
        got = {r.partition: r["count"] for r in three_way_split(df, "k", size).groupBy("partition").count().collect()}
        assert got["test"] == got["validation"] == round(90 * size)
    got = {r.partition: r["count"] for r in random_stratified_split(df, "y", "k").groupBy("partition").count().collect()}
    assert got["test"] == 14 and got["validation"] == 19


def test_plans_at_cluster_size(spark):
    """With the partitions of 100 TB: no rows ranked, moved or joined, and no broadcast of offsets."""
    df = spark.createDataFrame([(f"p{i}", f"c{i % 7}", "ab"[i % 2]) for i in range(60)], "uniq_id string, company_name string, industry string")

    def plan(frame):
        return frame._jdf.queryExecution().optimizedPlan().toString()

    spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", "8")
    three, employers = plan(three_way_split(df, "uniq_id", 0.2)), plan(split_by_employers(df))
    strat = plan(random_stratified_split(df, "industry", "uniq_id"))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.initialPartitionNum")
    for p in (three, employers):
        assert "Window" not in p and "Join" not in p and "Aggregate" not in p and "Sort" not in p
    assert "Window" not in strat and strat.count("Join") == 1
    from hireframe.functions.ordering import rank_by_hash
    spark.conf.set("spark.sql.shuffle.partitions", "409600")
    try:
        ranked = rank_by_hash(df.withColumn("o", det(1, "uniq_id")), "o", "uniq_id")
        p = plan(ranked)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert "broadcast" not in p.lower()
