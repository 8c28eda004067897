"""Sinks: TSV, FASTA, FASTQ, annotation rows, summaries. All write folders of part files through Spark."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def flat_cells(df: DataFrame) -> DataFrame:
    """Nested cells as JSON, tabs and line ends in text as blanks."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)):
            c = F.to_json(c)
        elif isinstance(f.dataType, T.StringType):
            c = F.regexp_replace(c, r"[\t\r\n]", " ")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def write_tsv(df: DataFrame, path: str) -> None:
    flat_cells(df).write.csv(path, sep="\t", header=True, quote="", escapeQuotes=False, mode="overwrite")


def fasta_lines(df: DataFrame, name: str, seq: str) -> DataFrame:
    return df.select(F.concat(F.lit(">"), F.col(name), F.lit("\n"), F.col(seq)).alias("value"))


def write_fasta(df: DataFrame, path: str, name: str, seq: str) -> None:
    fasta_lines(df, name, seq).write.text(path, compression="none")


def write_fastq(df: DataFrame, path: str, name: str, seq: str, quality: str = "I") -> None:
    q = F.repeat(F.lit(quality), F.length(seq))
    df.select(F.concat(F.lit("@"), F.col(name), F.lit("\n"), F.col(seq), F.lit("\n+\n"), q).alias("value")).write.text(path)


def gtf_lines(transcripts: DataFrame) -> DataFrame:
    """Annotation rows of a table (gene, transcript, seq): each transcript a contig with one gene, transcript and exon."""
    info = F.concat(F.lit('gene_id "'), F.col("gene"), F.lit('"; transcript_id "'), F.col("transcript"), F.lit('";'))
    kind = F.explode(F.array(F.lit("gene"), F.lit("transcript"), F.lit("exon")))
    return transcripts.select(F.col("transcript").alias("c"), F.length("seq").alias("n"), info.alias("i"), kind.alias("k")).select(F.concat_ws("\t", "c", F.lit("table"), "k", F.lit("1"), "n", F.lit("."), F.lit("+"), F.lit("."), "i").alias("value"))


def transcript_fasta(transcripts: DataFrame) -> DataFrame:
    return transcripts.select(F.concat(F.lit(">"), F.col("gene"), F.lit("_"), F.col("transcript"), F.lit("\n"), F.col("seq")).alias("value"))


def write_summary(summary: dict, path: str) -> None:
    """A small summary as JSON, put in place whole."""
    p = Path(path)
    part = p.with_suffix(".part")
    part.write_text(json.dumps({"schema_version": 1} | summary, indent=1, default=str))
    part.replace(p)


def write_step(df: DataFrame, folder: str, name: str) -> DataFrame:
    """A step's table as Parquet, read back: the next step starts from the files, not from the plan before."""
    path = f"{folder.rstrip('/')}/{name}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def write_barcodes(df: DataFrame, folder: str, name: str, seq: str = "sequence") -> None:
    """Barcodes as ``name.csv`` (a header and one column) and ``name.txt`` (one a line)."""
    one = df.select(F.col(seq).alias("sequence"))
    one.write.csv(f"{folder.rstrip('/')}/{name}.csv", header=True, mode="overwrite")
    one.write.mode("overwrite").text(f"{folder.rstrip('/')}/{name}.txt")
