import random

import pytest
from pyspark.sql import functions as F

from rillmark.functions import monoids as M
from rillmark.operators.streams import Stream, merge

INTS = [None, *range(-9, 10), 2**31 - 1, -(2**31), 2**40]
CASES = {
    "sum": (M.Sum(), "x"),
    "sum8": (M.Sum(8, wrap=True), "x"),
    "sum32u": (M.Sum(32, wrap=True, signed=False), "x"),
    "count": (M.Count, "x"),
    "min": (M.Min, "x"),
    "max": (M.Max, "x"),
    "all": (M.All, "b"),
    "any": (M.Any, "b"),
    "mean": (M.Mean, "x"),
    "pairwise": (M.Pairwise("x", "y"), "s"),
    "tuple": (M.Tuple(x=M.Max, y=M.Sum(), b=M.Any), "s"),
}


@pytest.mark.parametrize("name", CASES)
def test_any_split_merges_to_the_whole(spark, name):
    rng = random.Random(name)
    rows = [(rng.randrange(5), rng.randrange(4), rng.choice(INTS), rng.randrange(100), rng.choice([True, False, None])) for _ in range(200)]
    df = spark.createDataFrame(rows, "k int, part int, x long, y long, b boolean").withColumn("s", F.struct("x", "y", "b"))
    monoid, value = CASES[name]
    whole = Stream(df).group_by(F.array("k")).aggregate(monoid, F.col(value))
    parts = df.groupBy(F.col("k").alias("key"), "part").agg(*monoid.lifted(F.col(value)))
    split = merge(parts, monoid)
    assert sorted(map(repr, whole.collect())) == sorted(map(repr, split.collect()))
    # Merging merged partials changes nothing: associativity.
    again = merge(parts.where("part < 2").groupBy("key").agg(*monoid.merged()).unionByName(parts.where("part >= 2").drop("part")), monoid)
    assert sorted(map(repr, whole.collect())) == sorted(map(repr, again.collect()))


@pytest.mark.parametrize(("bits", "signed"), [(8, True), (8, False), (16, True), (32, False), (64, True)])
def test_fixed_width_sums_wrap(spark, bits, signed):
    values = [2 ** (bits - 1) - 1, 5, 7, -3]
    got = Stream(spark.createDataFrame([(v,) for v in values], "x long")).group_by(F.array(F.lit(1))).aggregate(M.Sum(bits, True, signed), F.col("x")).first()["value"]
    want = sum(values) % 2**bits
    assert got == (want - 2**bits if signed and want >= 2 ** (bits - 1) else want)


def test_plain_sum_raises_on_overflow(spark):
    df = Stream(spark.createDataFrame([(2**63 - 1,), (1,)], "x long"))
    with pytest.raises(Exception, match="(?i)overflow"):
        df.group_by(F.array(F.lit(1))).aggregate(M.Sum(), F.col("x")).collect()


def test_product_and_nan_and_negative_zero(spark):
    df = spark.createDataFrame([(-2.0,), (0.5,), (4.0,)], "x double")
    assert Stream(df).group_by(F.array(F.lit(1))).aggregate(M.Product, F.col("x")).first()["value"] == -4.0
    df = spark.createDataFrame([(float("nan"),), (1.0,), (-0.0,), (0.0,)], "x double")
    low, high = (Stream(df).group_by(F.array(F.lit(1))).aggregate(m, F.col("x")).first()["value"] for m in (M.Min, M.Max))
    assert low == 0.0 and high != high  # NaN is the greatest


def test_repeated_keys_count_and_empty_lists_drop(spark):
    df = spark.createDataFrame([(1, ["a", "a", "b"]), (2, []), (3, None)], "id int, ks array<string>")
    got = Stream(df).group_by(F.col("ks")).aggregate(M.Count, F.lit(1))
    assert {r["key"]: r["value"] for r in got.collect()} == {"a": 2, "b": 1}
