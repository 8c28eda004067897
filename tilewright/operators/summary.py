"""Statistics, funnels, histograms and checks of result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ranks

def _finite(c: str) -> Column:
    x = F.col(f"`{c}`").cast("double")
    return F.when(~F.isnan(x), x)


def column_stats(df: DataFrame, column: str, by: list[str] = ()) -> DataFrame:
    """count, mean, std (n - 1), min, max, median, q25, q75 (linear, exact) and range; NaN and null left out."""
    x = F.col("x_")
    beside = [F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max")]
    out = ranks.linear_quantiles(df, _finite(column), (0.25, 0.5, 0.75), by, beside)
    return out.select(*by, F.col("n_").alias("count"), "mean", "std", "min", "max", F.col("q_")[1].alias("median"), F.col("q_")[0].alias("q25"), F.col("q_")[2].alias("q75"), (F.col("max") - F.col("min")).alias("range"))


def quantiles(df: DataFrame, column: str, points: tuple[float, ...] = (0, 0.05, 0.25, 0.5, 0.75, 0.95, 1)) -> DataFrame:
    """(point, value) of exact linear quantiles; null where there is no value."""
    row = ranks.linear_quantiles(df, _finite(column), points)
    return row.select(F.explode(F.arrays_zip(F.array(*map(F.lit, map(float, points))).alias("point"), F.coalesce("q_", F.array().cast("array<double>")).alias("value"))).alias("x")).select("x.point", "x.value")


def attribute_stats(df: DataFrame, columns: list[str], by: list[str] = ()) -> DataFrame:
    """(by, attribute, count, min, median, max) of the final attributes: infinities, NaN and null left out, four decimals."""
    known = F.array(*[F.struct(F.lit(c).alias("attribute"), F.col(f"`{c}`").cast("double").alias("v")) for c in columns])
    long = df.select(*by, F.explode(known).alias("x")).select(*by, "x.attribute", F.when(F.abs("x.v") < float("inf"), F.col("x.v")).alias("v"))
    out = ranks.linear_quantiles(long, F.col("v"), (0.0, 0.5, 1.0), [*by, "attribute"])
    return out.select(*by, "attribute", F.col("n_").alias("count"), *[F.round(F.col("q_")[i], 4).alias(n) for i, n in enumerate(("min", "median", "max"))])


def histogram(df: DataFrame, column: str, bins: int = 12) -> DataFrame:
    """(bin, low, high, n): equal right-closed bins from 1, the smallest value in the first; empty ones are left out."""
    x = _finite(column)
    ends = df.agg(F.min(x).alias("lo_"), F.max(x).alias("hi_"))
    rows = df.select(x.alias("x")).where("x is not null").crossJoin(F.broadcast(ends))  # one row
    width = (F.col("hi_") - F.col("lo_")) / bins
    rows = rows.withColumn("bin", F.when(width == 0, 1).otherwise(F.least(F.greatest(F.ceil((F.col("x") - F.col("lo_")) / width), F.lit(1)), F.lit(bins))).cast("int"))
    return rows.groupBy("bin").agg(F.min(F.col("lo_") + width * (F.col("bin") - 1)).alias("low"), F.min(F.col("lo_") + width * F.col("bin")).alias("high"), F.count("*").alias("n"))


def value_counts(df: DataFrame, column: str, most: int | None = None) -> DataFrame:
    """(value, n), the most frequent first, ties by value."""
    out = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value")
    return out if most is None else out.limit(most)


def stage_of(df: DataFrame, stages: list[tuple[str, Column]]) -> DataFrame:
    """``df`` with dropped_at: the first stage whose test a row fails; null if it passes all. One pass, no recounts."""
    c = F.lit(None).cast("string")
    for name, test in reversed(stages):
        c = F.when(~F.coalesce(test, F.lit(False)), name).otherwise(c)
    return df.withColumn("dropped_at", c)


def funnel(df: DataFrame, stages: list[str], by: list[str] = ()) -> DataFrame:
    """(by, stage, before, after, removed) from ``stage_of``'s column."""
    place = {s: i for i, s in enumerate(stages)}
    at = F.element_at(F.create_map(*[F.lit(x) for kv in place.items() for x in kv]), F.col("dropped_at"))
    counts = df.withColumn("at_", F.coalesce(at, F.lit(len(stages)))).groupBy(*by).agg(*[F.count_if(F.col("at_") >= i).alias(f"b{i}") for i in range(len(stages) + 1)])
    rows = [F.struct(F.lit(s).alias("stage"), F.col(f"b{i}").alias("before"), F.col(f"b{i + 1}").alias("after"), (F.col(f"b{i}") - F.col(f"b{i + 1}")).alias("removed")) for i, s in enumerate(stages)]
    return counts.select(*by, F.explode(F.array(*rows)).alias("x")).select(*by, "x.*")


def run_summary(df: DataFrame, stages: list[str], group: str) -> DataFrame:
    """Per group: candidates, final, the stage that removed most (the first of equals) and a status."""
    f = funnel(df, stages, [group])
    top = F.max_by("stage", F.struct("removed", -F.element_at(F.create_map(*[F.lit(x) for i, s in enumerate(stages) for x in (s, i)]), F.col("stage"))))
    out = f.groupBy(group).agg(F.max("before").alias("candidates"), F.min("after").alias("final"), top.alias("top_removal"))
    return out.withColumn("status", F.when(F.col("final") == 0, "none").when(F.col("final") < 3, "few").otherwise("ok")).withColumn("top_removal", F.when(F.col("candidates") > F.col("final"), F.col("top_removal")))


def overview(df: DataFrame, group: str) -> DataFrame:
    """One row: rows, distinct groups, and the rows of the largest and the smallest group."""
    g = df.groupBy(group).agg(F.count("*").alias("n"))
    return g.agg(F.sum("n").alias("total"), F.count("*").alias("groups"), F.max("n").alias("most"), F.min("n").alias("least"))


def neighbour_gaps(df: DataFrame, group: str, start: str, end: str) -> DataFrame:
    """``df`` with gap: bases between a row and the one before it by start and end."""
    w = Window.partitionBy(group).orderBy(start, end, "row_id")
    return df.withColumn("gap", F.col(start) - F.lag(end).over(w) - 1)


def result_check(df: DataFrame, group: str, start: str, end: str, oligo: str, ranges: dict[str, tuple[float, float]], tasks: int | None = None) -> DataFrame:
    """Per group: rows, distinct oligos, least gap, span, and rows outside each column's range.

    A task sorts its groups' rows and holds their distinct oligos; ``tasks`` is how many the groups are dealt over, if not
    as the session does.
    """
    df = df.repartition(tasks, group) if tasks else df
    g = neighbour_gaps(df, group, start, end)
    bad = [F.count_if(~F.coalesce(F.col(c).between(*r), F.lit(False))).alias(f"{c}_outside") for c, r in ranges.items()]
    return g.groupBy(group).agg(F.count("*").alias("n"), F.countDistinct(oligo).alias("distinct_oligos"), F.min("gap").alias("min_gap"), (F.max(end) - F.min(start) + 1).alias("span"), *bad)


def examples(df: DataFrame, order: list, most: int) -> DataFrame:
    """The first ``most`` rows of a total order, as a report shows them."""
    return df.orderBy(*order).limit(most)
