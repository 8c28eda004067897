"""Readers: annotation, sequences, masks, expression tables, transcript tables, protocols."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sequence import quoted_attribute, strip_version

GTF_SCHEMA = "chr string, source string, type string, start long, end long, score string, strand string, frame string, info string"


def _attribute_chain(info: Column) -> dict[str, Column]:
    """Gene names and ids with their fallbacks where blank."""
    name = F.coalesce(quoted_attribute(info, "gene_name"), quoted_attribute(info, "gene"))
    cross = F.regexp_extract(info, r"GeneID:(\d+)", 1)
    key = F.coalesce(quoted_attribute(info, "gene_id"), F.when(cross != "", F.concat(F.lit("GeneID:"), cross)), name)
    return {"gene_name": name, "gene_id": key, "transcript_id": quoted_attribute(info, "transcript_id"), "gene_biotype": F.coalesce(quoted_attribute(info, "gene_biotype"), quoted_attribute(info, "gene_type")), "tags": F.regexp_extract_all(info, F.lit(r'tag "([^"]*)"'), F.lit(1))}


def parse_gtf(rows: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """Attributes and length of annotation rows; a ``chr`` in front of names is dropped."""
    out = rows if kinds is None else rows.where(F.col("type").isin(*kinds))
    return out.withColumn("chr", F.regexp_replace("chr", "^chr", "")).withColumns(_attribute_chain(F.col("info"))).withColumn("length", F.col("end") - F.col("start") + 1)


def read_gtf(spark: SparkSession, path: str, kinds: list[str] | None = None) -> DataFrame:
    return parse_gtf(spark.read.csv(path, sep="\t", comment="#", schema=GTF_SCHEMA, quote=""), kinds)


def gene_table(gtf: DataFrame) -> DataFrame:
    """(gene_id, gene_name, biotype, transcripts): of several names and biotypes the first by start."""
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("start")))
    return gtf.groupBy("gene_id").agg(first("gene_name").alias("gene_name"), first("gene_biotype").alias("biotype"), F.array_sort(F.collect_set("transcript_id")).alias("transcripts"))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(name, seq): the header up to white space, the body's lines joined. Records may span any number of lines."""
    r = spark.read.text(path, lineSep="\n>").where(F.length(F.trim("value")) > 0).select(F.regexp_replace("value", "^>", "").alias("value"))
    head = F.substring_index("value", "\n", 1)
    return r.select(F.regexp_extract(head, r"^(\S*)", 1).alias("name"), F.regexp_replace(F.substring(F.col("value"), F.length(head) + 1, F.length("value")), r"\s+", "").alias("seq"))


def contig_lengths(fasta: DataFrame) -> DataFrame:
    return fasta.select("name", F.length("seq").cast("long").alias("length"))


#: Bases of a chunk of a contig.
CHUNK = 1 << 16


def contig_chunks(fasta: DataFrame, size: int = CHUNK) -> DataFrame:
    """(name, chunk, piece): the contigs in pieces of ``size`` bases, numbered from 0."""
    starts = F.sequence(F.lit(0), F.greatest(F.length("seq") - 1, F.lit(0)), F.lit(size))
    pieces = F.transform(starts, lambda a: F.struct((a / size).cast("long").alias("chunk"), F.substring(F.col("seq"), a + 1, F.lit(size)).alias("piece")))
    return fasta.select("name", F.explode(pieces).alias("x")).select("name", "x.*")


def region_sequence(regions: DataFrame, fasta: DataFrame, name: str, start: str, end: str, strand: str | None = None, upper: bool = True, size: int = CHUNK) -> DataFrame:
    """``regions`` with seq: 1-based inclusive bases, upper case, read on the strand; names match with or without ``chr``.

    Regions are joined with the chunks of contigs that they touch, and each takes only its own bases of them. Null where
    no contig has the name or the region lies beyond it.
    """
    bare = lambda c: F.regexp_replace(c, "^chr", "")
    wanted = regions.select(bare(name).alias("r_"), F.col(start).cast("long").alias("a_"), F.col(end).cast("long").alias("b_")).where("a_ > 0 and b_ >= a_").distinct()
    wanted = wanted.withColumn("chunk", F.explode(F.sequence(F.floor((F.col("a_") - 1) / size), F.floor((F.col("b_") - 1) / size))))
    both = wanted.join(contig_chunks(fasta, size).withColumn("r_", bare("name")), ["r_", "chunk"])
    first, last = F.greatest(F.col("a_") - 1 - F.col("chunk") * size, F.lit(0)), F.least(F.col("b_") - F.col("chunk") * size, F.lit(size))
    both = both.select("r_", "a_", "b_", "chunk", F.substring(F.col("piece"), (first + 1).cast("int"), (last - first).cast("int")).alias("piece"))
    pieces = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "piece"))), lambda x: x["piece"]), "")
    found = both.groupBy("r_", "a_", "b_").agg((F.upper(pieces) if upper else pieces).alias("seq")).where(F.length("seq") > 0)
    out = regions.join(found, (bare(name) == F.col("r_")) & (F.col(start) == F.col("a_")) & (F.col(end) == F.col("b_")), "left").drop("r_", "a_", "b_")
    if strand:
        out = out.withColumn("seq", F.when(F.col(strand) == "-", F.reverse(F.translate("seq", "ACGTacgt", "TGCAtgca"))).otherwise(F.col("seq")))
    return out


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, start0, end0), half-open; comment, track and browser lines are skipped. Plain or compressed."""
    r = spark.read.text(path).where(~F.col("value").rlike(r"^(#|track|browser|\s*$)")).select(F.split("value", r"\s+").alias("f"))
    return r.select(F.col("f")[0].alias("chrom"), F.col("f")[1].cast("long").alias("start0"), F.col("f")[2].cast("long").alias("end0"))


def soft_mask(fasta: DataFrame) -> DataFrame:
    """(name, start0, end0) of runs of lower-case bases or N."""
    runs = F.regexp_extract_all("seq", F.lit("[a-zN]+|[^a-zN]+"), F.lit(0))
    at = F.aggregate(runs, F.struct(F.lit(0).alias("n"), F.array().cast("array<struct<a:int,b:int>>").alias("x")), lambda a, r: F.struct((a["n"] + F.length(r)).alias("n"), F.when(r.rlike("^[a-zN]"), F.array_append(a["x"], F.struct(a["n"].alias("a"), (a["n"] + F.length(r)).alias("b")))).otherwise(a["x"]).alias("x")))["x"]
    return fasta.select("name", F.explode(at).alias("r")).select("name", F.col("r.a").cast("long").alias("start0"), F.col("r.b").cast("long").alias("end0"))


def read_expression(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text; ``#`` lines are skipped, as are the two lines before a GCT table's header."""
    first = [r.value for r in spark.read.text(path).limit(3).collect()]
    gct = bool(first) and first[0].startswith("#1.")
    header = first[2] if gct and len(first) > 2 else spark.read.text(path).where(~F.col("value").startswith("#")).limit(1).collect()
    if not isinstance(header, str):
        header = header[0].value if header else ""
    sep = "," if ".csv" in Path(path).name.lower() else "\t"
    names = [x.strip('"') for x in header.rstrip("\r").split(sep)]
    schema = ", ".join(f"`{x}` string" for x in names)
    lines = spark.read.text(path).where(F.col("value") != header)
    if gct:
        lines = lines.where(~F.col("value").isin(*first[:2]))
    elif header:
        lines = lines.where(~F.col("value").rlike("^#") | F.lit(header.startswith("#")))
    return lines.where(F.length("value") > 0).select(F.from_csv("value", schema, {"sep": sep}).alias("x")).select("x.*")


def value_column(df: DataFrame, ids: list[str], name: str | None = None) -> str:
    """The named column, if numeric, else the only numeric one besides the ids; ValueError if there is none or several."""
    others = [c for c in df.columns if c not in ids] if name is None else [name]
    if any(c not in df.columns for c in others):
        raise ValueError(f"no column {name}")
    row = df.agg(*[F.coalesce(F.bool_and(F.col(f"`{c}`").try_cast("double").isNotNull() | F.col(f"`{c}`").isNull()) & (F.count(f"`{c}`") > 0), F.lit(False)).alias(f"c{i}") for i, c in enumerate(others)]).first()
    numeric = [c for i, c in enumerate(others) if row[f"c{i}"]]
    if len(numeric) != 1:
        raise ValueError(f"numeric columns: {', '.join(numeric) or 'none'}")
    return numeric[0]


def identifier_kind(df: DataFrame, column: str, kinds: dict[str, str], share: float = 0.9, first: int = 2000) -> str | None:
    """The kind whose pattern fits at least ``share`` of ``first`` ids, in order of name; None if none does."""
    some = df.select(F.col(column).alias("x")).where("x is not null").limit(first)
    row = some.agg(*[F.avg(F.col("x").rlike(p).cast("int")).alias(k) for k, p in kinds.items()]).first()
    return next((k for k in sorted(kinds) if (row[k] or 0) >= share), None)


#: Names that columns of transcript tables go by.
TRANSCRIPT_ALIASES = {"transcript": ["transcript", "transcript_id", "tx", "tx_id", "name"], "gene": ["gene", "gene_id"], "gene_name": ["gene_name", "symbol"], "seq": ["sequence", "seq"], "tags": ["tags", "tag"]}


def transcript_records(df: DataFrame) -> DataFrame:
    """(transcript, tags, n): columns found by alias, duplicates' tags merged."""
    lower = {c.lower(): c for c in df.columns}
    col = {k: next((lower[a] for a in names if a in lower), None) for k, names in TRANSCRIPT_ALIASES.items()}
    if col["transcript"] is None:
        raise ValueError("no transcript column")
    tags = F.split(F.coalesce(F.col(col["tags"]), F.lit("")), r"[,;]") if col["tags"] else F.array().cast("array<string>")
    out = df.select(F.trim(F.col(col["transcript"])).alias("transcript"), F.filter(F.transform(tags, lambda x: F.trim(x)), lambda t: t != "").alias("tags"))
    return out.groupBy("transcript").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("tags")))).alias("tags"), F.count("*").alias("n"))


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """(query, strand, ref, start0, end0) of mapped rows of an alignment file."""
    r = spark.read.text(path).where(~F.col("value").startswith("@")).select(F.split("value", "\t").alias("f"))
    flag, span = F.col("f")[1].cast("int"), F.regexp_extract_all(F.col("f")[5], F.lit(r"(\d+)[MDN=X]"), F.lit(1))
    r = r.where((flag.bitwiseAND(4)) == 0)
    length = F.aggregate(span, F.lit(0).cast("long"), lambda n, x: n + x.cast("long"))
    start = F.col("f")[3].cast("long") - 1
    return r.select(F.col("f")[0].alias("query"), F.when(flag.bitwiseAND(16) == 16, "-").otherwise("+").alias("strand"), F.col("f")[2].alias("ref"), start.alias("start0"), (start + length).alias("end0"))


def inline_targets(spark: SparkSession, targets: list) -> DataFrame:
    """(ordinal, target, seq) of names and ``{name: sequence}`` entries, the first of each name."""
    rows: dict[str, str | None] = {}
    for t in targets:
        for name, seq in t.items() if isinstance(t, dict) else [(t, None)]:
            rows.setdefault(str(name).strip(), seq)
    return spark.createDataFrame([(i, n, s) for i, (n, s) in enumerate(rows.items())], "ordinal int, target string, seq string")


def result_table(spark: SparkSession, path: str) -> DataFrame:
    """A result table written by ``write_tsv``: tabs, a header, no quotes."""
    return spark.read.csv(path, sep="\t", header=True, quote="")


def without_version(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, strip_version(column))


def read_step(spark: SparkSession, path: str) -> DataFrame:
    """A step's saved table: Parquet, or CSV with a header by the file's name."""
    return read_rows(spark, path) if ".csv" in Path(path).name.lower() else spark.read.parquet(path)


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    """A CSV table, plain or compressed, all columns as text; a byte order mark before the header is no part of it."""
    df = spark.read.csv(path, header=True, escape='"', multiLine=True)
    return df.toDF(*[c.removeprefix("\ufeff").strip('"') for c in df.columns])


def barcode_table(spark: SparkSession, path: str) -> DataFrame:
    """(barcode, sequence) of the rows of exactly two fields, without a header; of rows of one name the last stays.

    An empty second field counts as a missing one.
    """
    rows = spark.read.csv(path, schema="barcode string, sequence string, more_ string").where("barcode is not null and sequence is not null and more_ is null")
    return rows.withColumn("at_", F.monotonically_increasing_id()).groupBy("barcode").agg(F.max_by("sequence", "at_").alias("sequence"))
