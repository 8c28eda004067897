"""Interval and transcript algebra over annotation tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def select_segments(df: DataFrame, gene: str, kind: str, source: str) -> DataFrame:
    """mRNA: exons; UTR: the untranslated types; CDS or exon: coding segments, or the exons of a gene without any."""
    if source == "mRNA":
        return df.where(F.col(kind) == "exon")
    if source == "UTR":
        return df.where(F.col(kind).isin("UTR", "five_prime_utr", "three_prime_utr"))
    coding = F.max((F.col(kind) == "CDS").cast("int")).over(Window.partitionBy(gene))
    return df.withColumn("coding_", coding).where(F.when(F.col("coding_") == 1, F.col(kind) == "CDS").otherwise(F.col(kind) == "exon")).drop("coding_")


def choose_transcript(df: DataFrame, gene: str, transcript: str, tags: str, rule: str) -> DataFrame:
    """(gene, transcript) by rule: all; canonical; or mane, which falls back to canonical. Of several the first by name."""
    rank = F.when(F.array_contains(tags, "MANE_Select") & F.lit(rule == "mane"), 0).when(F.array_contains(tags, "Ensembl_canonical"), 1)
    if rule == "all":
        return df.select(gene, transcript).distinct()
    return df.withColumn("r_", rank).where("r_ is not null").groupBy(gene).agg(F.min(F.struct("r_", transcript)).alias("m_")).select(gene, F.col(f"m_.{transcript}").alias(transcript))


def listed_transcripts(known: DataFrame, wanted: DataFrame, gene: str, transcript: str) -> DataFrame:
    """(gene, transcript): the known transcripts that a list names (column ``wanted``), exactly or as the only one of an unversioned name."""
    names = match_ids(wanted, known.select(transcript).distinct(), "wanted", transcript)
    return known.join(names.select(transcript).distinct(), transcript, "left_semi").select(gene, transcript).distinct()


def without_transcript(targets: DataFrame, chosen: DataFrame, gene: str) -> DataFrame:
    """(gene, problem) of all targets that a rule or list finds no transcript for; none may be left out in silence."""
    return targets.select(gene).distinct().join(chosen.select(gene), gene, "left_anti").withColumn("problem", F.concat(F.lit("no transcript of target "), F.col(gene).cast("string")))


def match_ids(wanted: DataFrame, known: DataFrame, left: str, right: str, base: str = r"\.\d+$") -> DataFrame:
    """(left, right): the exact id, else the only known id of the same unversioned name; wanted ids without either are left out."""
    exact = wanted.join(known, wanted[left] == known[right]).select(left, right)
    bare = known.withColumn("b_", F.regexp_replace(right, base, "")).groupBy("b_").agg(F.min(right).alias(right), F.countDistinct(right).alias("n_")).where("n_ = 1")
    rest = wanted.join(exact.select(left), left, "left_anti").withColumn("b_", F.regexp_replace(left, base, ""))
    return exact.unionByName(rest.join(bare, "b_").select(left, right))


def restrict_to(df: DataFrame, pairs: DataFrame, gene: str, transcript: str) -> DataFrame:
    """Rows of the given (gene, transcript) pairs; genes without a pair pass untouched."""
    return df.join(pairs, [gene, transcript], "left_semi").unionByName(df.join(pairs.select(gene).distinct(), gene, "left_anti"))


def merge_segments(df: DataFrame, keys: list[str], transcript: str) -> DataFrame:
    """Equal segments once, with the number of their transcripts' rows and the sorted transcript names."""
    return df.groupBy(*keys).agg(F.count("*").alias("n_trans"), F.array_sort(F.collect_set(transcript)).alias("transcript_names"))


def merged_offsets(df: DataFrame, groups: list[str], start: str, end: str, strand: Column | None = None) -> DataFrame:
    """Overlapping or touching intervals of a group as blocks, and each interval's offset along the joined blocks.

    Adds block_start, block_end, block_offset (bases of earlier blocks) and offset (of the interval's own 5' end); on
    strand ``-`` blocks and offsets run from the right.
    """
    minus = F.lit(False) if strand is None else strand == "-"
    order = Window.partitionBy(*groups).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.withColumn("new_", F.coalesce((F.col(start) > reach).cast("int"), F.lit(1)))
    marked = marked.withColumn("block_", F.sum("new_").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy(*groups, "block_")
    marked = marked.withColumns({"block_start": F.min(start).over(inside), "block_end": F.max(end).over(inside), "minus_": minus})
    first = (F.row_number().over(inside.orderBy(start, end)) == 1).cast("long") * (F.col("block_end") - F.col("block_start") + 1)
    marked = marked.withColumn("first_", first)
    whole = Window.partitionBy(*groups)
    upto = F.sum("first_").over(whole.orderBy("block_").rangeBetween(Window.unboundedPreceding, 0))
    marked = marked.withColumns({"upto_": upto, "all_": F.sum("first_").over(whole)})
    size = F.col("block_end") - F.col("block_start") + 1
    block = F.when(F.col("minus_"), F.col("all_") - F.col("upto_")).otherwise(F.col("upto_") - size)
    own = F.when(F.col("minus_"), F.col("block_end") - F.col(end)).otherwise(F.col(start) - F.col("block_start"))
    out = marked.withColumn("block_offset", block).withColumn("offset", F.col("block_offset") + own)
    return out.drop("new_", "block_", "first_", "upto_", "all_", "minus_")


def splice(df: DataFrame, keys: list[str], order: str, seq: str, strand: str | None = None) -> DataFrame:
    """The pieces of each key joined in order; on strand ``-`` the whole reverse-complemented."""
    joined = df.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, seq))), lambda x: x[seq]), "").alias("seq"), *([F.min(strand).alias("strand_")] if strand else []))
    if not strand:
        return joined
    return joined.withColumn("seq", F.when(F.col("strand_") == "-", F.reverse(F.translate("seq", "ACGTacgt", "TGCAtgca"))).otherwise(F.col("seq"))).drop("strand_")


def validate(wanted: DataFrame, known: DataFrame, name: str) -> DataFrame:
    """(name, valid) of each wanted name."""
    return wanted.join(known.select(name).distinct().withColumn("there_", F.lit(True)), name, "left").select(name, F.coalesce("there_", F.lit(False)).alias("valid"))


def utr_side(df: DataFrame, gene: str, strand: str, start: str, cds_start: str) -> DataFrame:
    """``utr_side``: 5 before the coding start along the strand, else 3. (By position, not by row order.)"""
    before = F.col(start) < F.col(cds_start)
    return df.withColumn("utr_side", F.when(before == (F.col(strand) != "-"), 5).otherwise(3))
