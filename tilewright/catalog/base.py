"""The register of queries, and the adapter that turns table keys into sequences."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sequence import digest_bases
from ..session import spread, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


class Tables:
    """``t.part`` reads the table of that name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)


def query(name: str, sql: str | None = None) -> Callable:
    """Register ``f(tables)`` under a name, with its SQL if there is one."""

    def register(f: Callable[[Tables], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            SQL[name] = sql
        return f

    return register


def bases_sql(key: str) -> str:
    """As ``digest_bases``."""
    return f"translate(md5(CAST({key} AS VARCHAR)), '0123456789abcdef', 'ACGTACGTACGTACGT')"


def rc_sql(s: str) -> str:
    return f"reverse(translate({s}, 'ACGT', 'TGCA'))"


def long(c: Column | str, name: str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("long").alias(name)


def six(c: Column | str, name: str) -> Column:
    return F.round((F.col(c) if isinstance(c, str) else c).cast("double"), 6).alias(name)


def parts(t: Tables) -> DataFrame:
    """(p_partkey, p_brand, seq): 32 bases a part."""
    return t.part.select("p_partkey", "p_brand", "p_type", digest_bases("p_partkey").alias("seq"))


def dealt_parts(t: Tables) -> DataFrame:
    """As ``parts``, over many tasks: for queries whose rows are long work, while the table's file is one task's bytes."""
    return spread(parts(t).select("p_partkey", "p_brand", "p_type"), "p_partkey").withColumn("seq", digest_bases("p_partkey"))


PARTS = f"(SELECT p_partkey, p_brand, p_type, {bases_sql('p_partkey')} AS seq FROM part)"
