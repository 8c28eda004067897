"""The operators applied with production parameters to their whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, filter_audit, fingerprint, html_text, jaccard_join, language, licenses, packing, periodic, pii, quality, substrings, urls
from .session import ship, table


def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return fingerprint.neighbour_fingerprints(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", language.held_out())
    model = language.fit(docs.where(~F.col("held_out")))
    out = language.identify(docs.select("doc_id", "held_out", "text"), model)
    return out.select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"), F.col("lang_distance").alias("distance"), F.col("lang_rejected").alias("rejected"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return html_text.extract(table(spark, sf_dir, "pages"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return packing.pack(packing.pieces(table(spark, sf_dir, "documents")))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents")).drop("hash", "stands")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.find_pii(docs, pii.fit(docs))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("hash")


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return urls.judge(table(spark, sf_dir, "pages").select("page_id", "url")).drop("url")


def op10_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return periodic.run_digests(table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    out = substrings.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_document_fingerprints": op1_document_fingerprints,
    "op2_language_id": op2_language_id,
    "op3_html_extraction": op3_html_extraction,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_ngram_jaccard_join": op6_ngram_jaccard_join,
    "op7_pii": op7_pii,
    "op8_benchmark_decontamination": op8_benchmark_decontamination,
    "op9_url_filters": op9_url_filters,
    "op10_license_scans": op10_license_scans,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_filter_audit": op12_filter_audit,
    "op13_substring_dedup": op13_substring_dedup,
}

ORACLE: dict[str, str] = {
    "op6_ngram_jaccard_join": jaccard_join.ORACLE_SQL,
    "op8_benchmark_decontamination": decontaminate.ORACLE_SQL,
    "op12_filter_audit": filter_audit.ORACLE_SQL,
    "op13_substring_dedup": substrings.ORACLE_SQL,
}
