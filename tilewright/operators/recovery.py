"""Recovery of a published set of sequences by a generated one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bare_sequence(raw: Column) -> Column:
    """Upper-case bases without white space and ``/modification/`` tokens; null if a token is DNA itself or other letters remain."""
    s = F.upper(F.regexp_replace(F.coalesce(raw, F.lit("")), r"\s+", ""))
    dna = F.regexp_replace(s, "/[^/]+/", "")
    return F.when(~s.rlike("/[ACGT]+/") & dna.rlike("^[ACGT]+$"), dna)


def canonical_rows(df: DataFrame, gene: str, role: str, seq: str, order: str) -> DataFrame:
    """Adds gene_key, role_key, dna, and reason: why a row is left out (invalid or a duplicate of an earlier one), else null."""
    out = df.withColumns({"gene_key": F.lower(F.trim(gene)), "role_key": F.lower(F.trim(role)), "dna": bare_sequence(F.col(seq))})
    first = F.row_number().over(Window.partitionBy("gene_key", "role_key", "dna").orderBy(order))
    return out.withColumn("reason", F.when(F.col("dna").isNull(), "invalid").when(first > 1, "duplicate"))


def matches(reference: DataFrame, generated: DataFrame, id_: str) -> DataFrame:
    """Each reference row with matched, n_generated and the generated ids, sorted and joined by ``;``."""
    keys = ["gene_key", "role_key", "dna"]
    g = generated.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set(F.col(id_).cast("string"))), ";").alias("generated_ids"), F.count("*").alias("n_generated"))
    return reference.join(g, keys, "left").withColumns({"matched": F.col("n_generated").isNotNull(), "n_generated": F.coalesce("n_generated", F.lit(0))})


def set_recovery(reference: DataFrame, generated: DataFrame, ref_set: str, gen_set: str) -> DataFrame:
    """(ref_set, matched): whether one generated set of the gene holds every member of a reference set."""
    keys = ["gene_key", "role_key", "dna"]
    need = reference.groupBy(ref_set).agg(F.countDistinct("role_key", "dna").alias("need"))
    have = reference.select(*keys, ref_set).distinct().join(generated.select(*keys, gen_set).distinct(), keys).groupBy(ref_set, gen_set).agg(F.countDistinct("role_key", "dna").alias("have"))
    best = have.groupBy(ref_set).agg(F.max("have").alias("have"))
    return need.join(best, ref_set, "left").select(ref_set, (F.coalesce("have", F.lit(0)) == F.col("need")).alias("matched"))


def rates(matched: DataFrame) -> DataFrame:
    """Per role and for all roles: references, matched, SRR (share matched), TRR (genes with any) and MTR (mean of genes' shares), in percent."""
    gene = matched.groupBy("role_key", "gene_key").agg(F.count("*").alias("n"), F.count_if("matched").alias("m"))
    every = gene.groupBy("gene_key").agg(F.sum("n").alias("n"), F.sum("m").alias("m")).select(F.lit("all").alias("role_key"), "gene_key", "n", "m")
    both = gene.unionByName(every)
    return both.groupBy("role_key").agg(
        F.sum("n").alias("references"), F.sum("m").alias("matched"), (100 * F.sum("m") / F.sum("n")).alias("srr"),
        (100 * F.avg((F.col("m") > 0).cast("double"))).alias("trr"), (100 * F.avg(F.col("m") / F.col("n"))).alias("mtr"),
    )


def same_pairs(wide: DataFrame, long: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that only one of two tables has, and which: the tables agree if there are none."""
    a, b = wide.select(*keys).distinct().withColumn("w_", F.lit(1)), long.select(*keys).distinct().withColumn("l_", F.lit(1))
    return a.join(b, keys, "full").where("w_ is null or l_ is null").select(*keys, F.when(F.col("w_").isNull(), "long").otherwise("wide").alias("only_in"))


def lost(before: DataFrame, after: DataFrame, key: str, reason: Column) -> DataFrame:
    """(reason, n) of rows of one stage that the next lacks."""
    return before.join(after.select(key), key, "left_anti").groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


def first_with_sites(df: DataFrame, key: str, order: str, site: list[str]) -> DataFrame:
    """One row a key: the first by order, with all its sites as JSON."""
    return df.groupBy(key).agg(F.min(order).alias(order), F.to_json(F.array_sort(F.collect_set(F.struct(*site)))).alias("sites"))


def misses(reference: DataFrame, generated: DataFrame) -> DataFrame:
    """Why references are not matched: gene_absent, role_absent, length_differs or sequence_differs, counted."""
    keys = ["gene_key", "role_key"]
    missed = reference.join(generated.select(*keys, "dna").distinct(), [*keys, "dna"], "left_anti")
    g = generated.select("gene_key").distinct().withColumn("g_", F.lit(1))
    r = generated.select(*keys).distinct().withColumn("r_", F.lit(1))
    n = generated.select(*keys, F.length("dna").alias("n_")).distinct().withColumn("k_", F.lit(1))
    out = missed.withColumn("n_", F.length("dna")).join(g, "gene_key", "left").join(r, keys, "left").join(n, [*keys, "n_"], "left")
    why = F.when(F.col("g_").isNull(), "gene_absent").when(F.col("r_").isNull(), "role_absent").when(F.col("k_").isNull(), "length_differs").otherwise("sequence_differs")
    return out.groupBy(why.alias("reason")).agg(F.count("*").alias("n"))
