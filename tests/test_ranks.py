"""Distributed ranks equal the single-task window forms."""

import random

import pytest
from pyspark.sql import functions as F

from pyspark.sql import Window

from curbscope.operators.ranks import average_pct_ranks, ordinal_rank


def ordinal_rank_window(df, order, out_col="rank"):
    return df.withColumn(out_col, F.row_number().over(Window.orderBy(*order)))


def average_pct_rank_window(df, src, out_col):
    """Single-task form, to compare with."""
    valid = F.col(src).isNotNull()
    w = Window.partitionBy(valid).orderBy(F.col(src))
    tie = Window.partitionBy(F.col(src))
    n = F.count(F.col(src)).over(Window.partitionBy(valid))
    avg_rank = F.rank().over(w) + (F.count(F.lit(1)).over(tie) - 1) / 2.0
    return df.withColumn(out_col, F.when(valid, avg_rank / n))


def test_rank_cases(spark):
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate([1, 2, 2, 4])], "i int, x double")
    got = {r.i: r.p for r in average_pct_ranks(df, {"p": "x"}, "i").collect()}
    assert got == {0: 0.25, 1: 0.625, 2: 0.625, 3: 1.0}
    same = spark.createDataFrame([(i, 5.0) for i in range(3)], "i int, x double")
    assert {r.p for r in average_pct_ranks(same, {"p": "x"}, "i").collect()} == {4 / 6}
    one = spark.createDataFrame([(0, 3.0)], "i int, x double")
    assert average_pct_ranks(one, {"p": "x"}, "i").first().p == 1.0


@pytest.mark.parametrize("partitions", [1, 3, 17])
def test_distributed_equals_window(spark, partitions):
    rnd = random.Random(partitions)
    data = [(i, float(rnd.randint(0, 60)), float(rnd.choice([0.0, 0.5, 1.0, rnd.random()])))
            for i in range(3000)]
    df = spark.createDataFrame(data, "i int, a double, b double")
    prev = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        dist = average_pct_ranks(df, {"pa": "a", "pb": "b"}, "i")
        win = average_pct_rank_window(average_pct_rank_window(df, "a", "pa"), "b", "pb")
        assert sorted(dist.select("i", "pa", "pb").collect()) == \
            sorted(win.select("i", "pa", "pb").collect())
        order = [F.col("a").desc(), F.col("i")]
        d2 = ordinal_rank(df, order, "r")
        w2 = ordinal_rank_window(df, order, "r")
        assert sorted(d2.select("i", "r").collect()) == sorted(w2.select("i", "r").collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", prev)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_a_hot_value_is_spread(spark):
    """90 % of the cells on one value: no partition of the sorted table, and
    so no join key, holds them all."""
    df = spark.range(20_000).select(F.col("id").alias("i"), F.when(F.col("id") % 10 == 0, F.rand(1)).otherwise(1.0).alias("x"))
    prev = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = average_pct_ranks(df, {"p": "x"}, "i")
        plan = out._jdf.queryExecution().executedPlan().toString()
        joins = [line for line in plan.splitlines() if "SortMergeJoin" in line]
        assert len(joins) == 2 and any("_pid" in line and "value" in line for line in joins)
        assert not any("value" in line and "_pid" not in line for line in joins)
        assert out.filter("x = 1.0").select("p").distinct().count() == 1
        win = average_pct_rank_window(df, "x", "p")
        assert sorted(out.select("i", "p").collect()) == sorted(win.select("i", "p").collect())
    finally:
        for k, v in prev.items():
            spark.conf.set(k, v)
