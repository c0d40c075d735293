from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from marquetry.operators.skew import hot_split_join
from marquetry.operators.tree_aggregate import rounds, tree_aggregate
from marquetry.plans.training import p1_found


def test_rounds_grow_with_the_logarithm():
    assert [rounds(n, 4) for n in (0, 1, 4, 5, 16, 17, 64)] == [1, 1, 1, 2, 2, 3, 3]


@pytest.mark.parametrize("fan_in", [2, 3, 64])
def test_equals_group_by_with_a_hot_key(spark, fan_in):
    df = spark.range(0, 3000, numPartitions=9).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 100 == 1, F.lit(None)).otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("key"), F.col("id").alias("x"), F.lit("extra").alias("n_extra"))
    got = tree_aggregate(df, ["key"], {"n": ("count", "*"), "s": ("sum", "x"), "lo": ("min", "x"), "hi": ("max", "x")}, fan_in=fan_in)
    want = df.groupBy("key").agg(F.count(F.lit(1)), F.sum("x"), F.min("x"), F.max("x"))
    assert sorted(tuple(map(str, r)) for r in got.collect()) == sorted(tuple(map(str, r)) for r in want.collect())


def test_empty_null_and_clashing_names(spark):
    empty = spark.createDataFrame([], "key string, __chunk int, n int")
    assert tree_aggregate(empty, ["key"], {"c": ("count", "*")}).count() == 0
    rows = spark.createDataFrame([(None, 1, 5), (None, 2, 6)], "key string, __chunk int, n int")
    assert tree_aggregate(rows, ["key"], {"n": ("sum", "n")}).collect()[0].asDict() == {"key": None, "n": 11}
    with pytest.raises(ValueError):
        tree_aggregate(rows, ["key"], {"key": ("count", "*")})
    with pytest.raises(ValueError):
        tree_aggregate(rows, ["key"], {"n": ("count", "*")}, fan_in=1)


def test_found_keys_are_as_written_and_not_empty(spark, tmp_path):
    spark.createDataFrame([(1,)] * 50 + [(None,)] * 40 + [(i,) for i in range(100, 210)], "person long").write.parquet(f"{tmp_path}/credit.parquet")
    spark.createDataFrame([(" A ",)] * 5 + [("",)] * 90 + [(None,)] * 9 + [("x" * 5000,)] * 6, "value string").write.parquet(f"{tmp_path}/ext_id.parquet")
    assert sorted(tuple(r) for r in p1_found(spark, str(tmp_path)).collect()) == [("credit.person", "1"), ("ext_id.value", " A "), ("ext_id.value", "x" * 5000)]


@pytest.mark.parametrize("how", ["inner", "left"])
def test_hot_split_join_equals_a_join(spark, how):
    many = spark.range(4000).select(F.when(F.col("id") % 2 == 0, F.lit(7)).when(F.col("id") % 11 == 0, F.lit(None)).otherwise(F.col("id")).cast("long").alias("k"), F.col("id").alias("x"))
    one = many.where("k is not null and k % 3 <> 0").groupBy("k").agg(F.count(F.lit(1)).alias("w"))
    got = hot_split_join(many, one, ["k"], "w", 4000, how)
    assert sorted(map(str, got.select("k", "x", "w").collect())) == sorted(map(str, many.join(one, "k", how).select("k", "x", "w").collect()))
