"""As-of joins against a plain search, with ties, nulls, hot moments, hot keys and more partitions than rows."""

import random

import pytest
from pyspark.sql import functions as F

from tarn.operators.asof import as_of_join


def plain(left, right, keys, strict):
    out = []
    for (k, t, i) in left:
        fits = [r for r in right if r[1] is not None and t is not None and (r[1] < t or (not strict and r[1] == t)) and (not keys or (k is not None and r[0] == k))]
        out.append((k, t, i, max(fits, key=lambda r: (r[1], r[2]))[2] if fits else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("keys", [(), ("k",)])
@pytest.mark.parametrize("strict", [True, False])
@pytest.mark.parametrize("partitions", [1, 5, 40])
def test_against_plain(spark, keys, strict, partitions):
    rng = random.Random(partitions)
    row = lambda i: (rng.choice([1, 1, 1, 2, 3, None]), rng.choice([None, 7, 7, 7, *range(20)]), i)
    left, right = [row(i) for i in range(150)], [row(1000 + i) for i in range(60)]
    frames = spark.createDataFrame(left, "k int, t int, i int").repartition(4), spark.createDataFrame(right, "k int, t int, e int").repartition(3)
    found = as_of_join(*frames, "t", "t", keys, values=("e",), order=("e",), strict=strict, partitions=partitions)
    if not keys:
        assert found.columns == ["k", "t", "i", "e"]
    taken = [r for r in right if not keys or r[0] is not None]
    assert sorted(map(tuple, found.collect()), key=str) == plain(left, taken, keys, strict)


def test_hot_moment_and_key_are_split(spark):
    left = spark.range(4000).select(F.lit(1).alias("k"), F.lit(5).alias("t"), F.col("id").alias("i"))
    right = spark.range(3).select(F.lit(1).alias("k"), F.col("id").cast("int").alias("t"), F.col("id").alias("e"))
    found = as_of_join(left, right, "t", "t", ("k",), values=("e",), partitions=8)
    assert {r.e for r in found.collect()} == {2} and found.count() == 4000
    path = found.inputFiles()
    sizes = [spark.read.parquet(p).where("what <> 'last'").count() for p in set(path)]
    assert max(sizes) < 1500  # the one key and moment of all rows lies in many partitions


def test_empty_sides_and_clashes(spark):
    left, none = spark.createDataFrame([(1, 2)], "k int, t int"), spark.createDataFrame([], "k int, s int, e string")
    assert [tuple(r) for r in as_of_join(left, none, "t", "s", ("k",)).collect()] == [(1, 2, None, None)]
    assert as_of_join(left.where("false"), none, "t", "s", ("k",)).collect() == []
    with pytest.raises(ValueError, match="columns of both sides"):
        as_of_join(left, none, "t", "s")
    plan = as_of_join(left, none, "t", "s", ("k",))._jdf.queryExecution().optimizedPlan().toString()
    assert "Cartesian" not in plan and "Cross" not in plan
