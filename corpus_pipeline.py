"""A pipeline over documents: language, near duplicates, benchmark passages, personal data, packing.

Each stage takes what the one before kept, with whatever columns it has, and returns the same columns; the last
returns the packed pieces. Null texts, repeated rows, empty tables and further columns are handled as the operators
define it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm import decontaminate, jaccard_join, language, packing, pii
from tilewright.llm.session import cut, free_name, ship, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model accepts; it learns from all that have one. Those without a letter go."""
    ship(spark)
    model = language.fit(docs)
    (prefix,) = free_name(docs, "identified_")
    return language.identify(docs, model, prefix=prefix).where(~F.col(prefix + "rejected")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id."""
    ship(spark)
    return jaccard_join.one_of_each(docs).select(*docs.columns)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark of the folder."""
    judged = cut(decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")))
    (hash_,) = free_name(docs, "hash_")
    marked = docs.withColumn(hash_, F.xxhash64("text"))
    return jaccard_join.without(marked, judged.where("contaminated").select("doc_id", "hash").distinct(), "doc_id", hash_).select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind; n_chars follows the text."""
    ship(spark)
    out = pii.redact(docs, pii.fit(docs))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces with their places in training sequences."""
    ship(spark)
    return packing.pack(packing.pieces(docs))


STAGES = [
    ("language ID", language_id),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_passages),
    ("PII", personal_data),
    ("best-fit packing", packed),
]

#: The language model and the field are trained, so SQL cannot give these rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over the documents of a folder."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
