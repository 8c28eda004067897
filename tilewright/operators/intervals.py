"""Interval joins by bins: an equi-join that Spark can shuffle, then the exact test."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def overlap_join(left: DataFrame, right: DataFrame, on: list[str], l_start: str, l_end: str, r_start: str, r_end: str, bin_size: int) -> DataFrame:
    """Pairs of half-open intervals that overlap, with equal ``on``. Column names beyond ``on`` must differ.

    Both sides are dealt to the bins they touch; a pair is taken in the bin where its overlap begins, so once. A bin
    size near the usual length keeps both the copies of a row and the rows of a bin few.
    """

    def bins(df: DataFrame, a: str, b: str) -> DataFrame:
        first, last = F.floor(F.col(a) / bin_size), F.floor((F.col(b) - 1) / bin_size)
        return df.where(F.col(a) < F.col(b)).withColumn("bin_", F.explode(F.sequence(first, last)))

    both = bins(left, l_start, l_end).join(bins(right, r_start, r_end), [*on, "bin_"])
    begin = F.greatest(F.col(l_start), F.col(r_start))
    return both.where((begin < F.least(F.col(l_end), F.col(r_end))) & (F.floor(begin / bin_size) == F.col("bin_"))).drop("bin_")


def within_join(left: DataFrame, right: DataFrame, on: list[str], l_start: str, l_end: str, r_start: str, r_end: str, bin_size: int) -> DataFrame:
    """Pairs where the right interval lies within the left one."""
    return overlap_join(left, right, on, l_start, l_end, r_start, r_end, bin_size).where((F.col(r_start) >= F.col(l_start)) & (F.col(r_end) <= F.col(l_end)))


def without_overlap(left: DataFrame, mask: DataFrame, on: list[str], l_start: str, l_end: str, r_start: str, r_end: str, bin_size: int, key: list[str]) -> DataFrame:
    """Rows of ``left`` (told apart by ``key``) that no mask interval touches."""
    hit = overlap_join(left.select(*dict.fromkeys([*key, *on, l_start, l_end])), mask, on, l_start, l_end, r_start, r_end, bin_size).select(*key).distinct()
    return left.join(hit, key, "left_anti")
