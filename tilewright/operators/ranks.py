"""Exact quantiles by rank selection: sketches give narrow windows of values, and only the rows in them are counted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import kept

#: One in so many ranks is how far a sketch may be off; a window then holds a few of so many rows.
ACCURACY = 100_000
#: Groups, of some hundred bytes each, whose windows every task gets; with more of them the rows are dealt by group and salt.
BROADCAST_ROWS, SALTS = 100_000, 32


def linear_quantiles(df: DataFrame, value: Column, points: tuple[float, ...], by: list[str] = (), beside: list[Column] = (), accuracy: int = ACCURACY) -> DataFrame:
    """(by, beside, n_, q_): per group the exact linear quantiles of ``value`` at ``points``, as an array in their order.

    First pass: a sketch per group gives for each point two values between which the wanted ranks lie for sure (a group of
    no more than ``accuracy`` rows: its ends); ``beside`` holds further aggregates of x_, the value, in the same pass. Second pass: rows below a
    window are counted, rows within it counted by value, both before the shuffle; running sums then find the ranks. So no
    state grows with the distinct values: the sketch is bounded, and a window sorts at most six in ``accuracy`` of a group's
    rows, as a stream. Groups are computed and counted first: rows stay where they are and get the windows of few groups;
    with many groups equal values are counted and dealt over salts, so that no large group is one task's. Null values are
    left out; a group of nulls has a null q_, and NaN counts as the largest value.
    """
    by = list(by)
    x = df.select(*[F.col(c) for c in by], value.cast("double").alias("x_"))
    near = 3.0 / accuracy
    edges = [min(max(p + d, 0.0), 1.0) for p in points for d in (-near, near)]
    sketch = F.percentile_approx("x_", F.array(*map(F.lit, edges)), F.lit(accuracy))
    first = x.groupBy(*by).agg(F.count("x_").alias("n_"), F.min("x_").alias("low_"), F.max("x_").alias("high_"), sketch.alias("s_"), *beside)
    whole = F.col("n_") <= accuracy

    def window(i: int, p: float) -> Column:
        rank = F.lit(float(p)) * (F.col("n_") - 1)
        low = F.when(whole | F.lit(edges[2 * i] <= 0), F.col("low_")).otherwise(F.col("s_")[2 * i])
        high = F.when(whole | F.lit(edges[2 * i + 1] >= 1), F.col("high_")).otherwise(F.col("s_")[2 * i + 1])
        return F.struct(F.lit(i).alias("i"), rank.alias("rank"), low.alias("low"), high.alias("high"))

    first = first.withColumn("w_", F.array(*[window(i, p) for i, p in enumerate(points)])).drop("s_", "low_", "high_")
    if by:
        first = kept(first)
    few = not by or first.count() <= BROADCAST_ROWS
    keys = [f"g{i}_" for i in range(len(by))]
    marks = first.select(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)], "w_")
    rows = x.where("x_ is not null").select(*by, "x_", F.lit(1).alias("k_"))
    same = F.lit(True)
    if not few:
        rows = rows.groupBy(*by, "x_").agg(F.sum("k_").alias("k_")).withColumn("salt_", F.pmod(F.xxhash64("x_"), F.lit(SALTS)).cast("int"))
        marks = marks.withColumn("salt_", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        same = rows["salt_"] == marks["salt_"]
    for c, k in zip(by, keys, strict=True):
        same = same & rows[c].eqNullSafe(marks[k])
    met = rows.join(F.broadcast(marks) if few else marks, same) if by else rows.crossJoin(F.broadcast(marks))  # without groups: one row
    met = met.select(*[F.col(k) for k in keys], "x_", "k_", F.explode(F.filter("w_", lambda w: F.col("x_") <= w["high"])).alias("w"))
    inside = F.when(F.col("x_") >= F.col("w.low"), F.col("x_"))
    counts = met.groupBy(*keys, F.col("w.i").alias("i"), F.col("w.rank").alias("rank"), inside.alias("v")).agg(F.sum("k_").alias("c"))
    upto = F.sum("c").over(Window.partitionBy(*keys, "i").orderBy(F.col("v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = counts.withColumn("upto", upto).where("v is not null")
    below, above = F.floor("rank"), F.ceil("rank")

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("upto") - F.col("c") <= rank) & (rank < F.col("upto")), F.col("v")))

    found = ranked.groupBy(*keys, "i").agg(at(below).alias("a"), at(above).alias("z"), F.first(F.col("rank") - below).alias("part"))
    # a rank outside its window would break the sketch's promise: an error, never a wrong value
    sure = F.when(F.col("a").isNull() | F.col("z").isNull(), F.raise_error(F.lit("a quantile's rank lies outside its window"))).otherwise(F.when(F.col("a") == F.col("z"), F.col("a")).otherwise(F.col("a") + (F.col("z") - F.col("a")) * F.col("part")))
    lists = found.select(*keys, F.struct("i", sure.cast("double").alias("q")).alias("x")).groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list("x")), lambda y: y["q"]).alias("l_"))  # as many as points
    lists = lists.select(*keys, F.when(F.size("l_") > 0, F.col("l_")).alias("q_"))
    on = F.lit(True)
    for c, k in zip(by, keys, strict=True):
        on = on & first[c].eqNullSafe(lists[k])
    return first.drop("w_").join(lists if by else F.broadcast(lists), on, "left").drop(*keys)
