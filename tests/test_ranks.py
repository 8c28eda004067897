"""Exact quantiles against NumPy: skew, ties, nulls, small groups, and windows far narrower than a group."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.operators import ranks, summary

POINTS = (0.0, 0.05, 0.25, 0.3, 0.5, 0.75, 0.95, 0.999, 1.0)


def grouped(n, r):
    """A group with most rows, one of ties, small ones, one of nulls only, and the group without a name."""
    hot = [("hot", float(x)) for x in np.exp(r.normal(0, 8, n))]
    ties = [("ties", 7.0)] * (n // 2) + [("ties", float(x)) for x in r.integers(0, 20, n // 4)]
    small = [(f"s{i}", float(x)) for i in range(1, 9) for x in r.normal(0, 1e6, i)]
    return hot + ties + small + [("none", None), ("none", None), (None, 3.0), (None, -0.0), (None, None), (None, 0.0)]


@pytest.mark.parametrize("accuracy", [20, 300, ranks.ACCURACY])
def test_equal_to_numpy_by_group(spark, accuracy):
    data = grouped(3000, np.random.default_rng(4))
    df = spark.createDataFrame(data, "g string, v double").repartition(7)
    got = {x["g"]: (x["n_"], x["q_"], x["top"]) for x in ranks.linear_quantiles(df, F.col("v"), POINTS, ["g"], [F.max("x_").alias("top")], accuracy).collect()}
    for g in {k for k, _ in data}:
        v = [x for k, x in data if k == g and x is not None]
        assert got[g][0] == len(v) and got[g][2] == max(v, default=None)
        assert got[g][1] is None if not v else np.allclose(got[g][1], np.quantile(v, POINTS), rtol=1e-12, atol=0)


@pytest.mark.parametrize("most", [0, 100])
def test_large_groups_are_no_task_of_their_own(spark, monkeypatch, most):
    """Rows are not dealt by group: they meet its windows where they are, or (many groups) counted and salted; the same values."""
    monkeypatch.setattr(ranks, "BROADCAST_ROWS", most, raising=False)
    data = grouped(3000, np.random.default_rng(6))
    out = ranks.linear_quantiles(spark.createDataFrame(data, "g string, v double").repartition(7), F.col("v"), POINTS, ["g"], accuracy=300)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joins = [x for x in out._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in x and "Inner" in x]
        got = {x["g"]: (x["n_"], x["q_"]) for x in out.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert len(joins) == 1 and ("BroadcastHashJoin" if most else "SortMergeJoin") in joins[0] and ("salt_" in joins[0]) == (not most)
    for g in {k for k, _ in data}:
        v = [x for k, x in data if k == g and x is not None]
        assert got[g][0] == len(v)
        assert got[g][1] is None if not v else np.allclose(got[g][1], np.quantile(v, POINTS), rtol=1e-12, atol=0)


def test_windows_are_narrow(spark):
    """Of 200,000 rows the second pass sorts a few for each point, and the values are exact."""
    n = 200_000
    df = spark.range(n).select((F.xxhash64("id") % 1_000_003).cast("double").alias("v"))
    v = np.sort(np.array([x.v for x in df.collect()]))
    got = ranks.linear_quantiles(df, F.col("v"), POINTS, accuracy=1000).first()
    assert got["n_"] == n and np.allclose(got["q_"], np.quantile(v, POINTS), rtol=1e-12)


def test_empty_nan_and_infinite(spark):
    empty = spark.createDataFrame([], "g string, v double")
    one = summary.column_stats(empty, "v").collect()
    assert len(one) == 1 and one[0]["count"] == 0 and one[0]["median"] is None
    assert summary.column_stats(empty, "v", ["g"]).count() == 0
    assert summary.quantiles(empty, "v").where("value is not null").count() == 0
    df = spark.createDataFrame([(1.0, 5), (float("nan"), 6), (float("inf"), None), (None, 8), (2.00004, 9)], "`a.b` double, w int")
    assert summary.column_stats(df, "a.b").first()["count"] == 3
    assert {x["attribute"]: tuple(x)[1:] for x in summary.attribute_stats(df, ["a.b", "w"]).collect()} == {"a.b": (2, 1.0, 1.5, 2.0), "w": (4, 5.0, 7.0, 9.0)}
