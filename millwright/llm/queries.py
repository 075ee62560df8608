"""The registered queries of this folder: (spark, folder of the test tables) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millwright.llm import (
    collocations, compression_quality, decontamination, importance_resampling, license_scan, line_dedup, ngram_join, packing,
    search, source_mixing, substring_dedup, url_reputation, warc,
)
from millwright.llm.common import folder as new_folder


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op3_url_reputation(spark: SparkSession, folder: str) -> DataFrame:
    return url_reputation.report(table(spark, folder, "pages"), table(spark, folder, "labels"))


def op7_search(spark: SparkSession, folder: str) -> DataFrame:
    return search.report(table(spark, folder, "documents"))


def op8_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.report(table(spark, folder, "pages"), new_folder(spark, "archive"))


def op10_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substring_dedup.report(table(spark, folder, "documents"))


def held_out() -> F.Column:
    """Rows whose labels the quality classifier never sees: crc32 of the id as text leaves 1 when divided by 3."""
    return F.crc32(F.col("doc_id").cast("string")) % 3 == 1


def op4_compression_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = quality_model(docs, table(spark, folder, "labels"))
    scored = compression_quality.score(docs, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def quality_model(docs: DataFrame, labels: DataFrame) -> compression_quality.Model:
    """Fitted to the labelled documents that are not held out."""
    seen = labels.where(~held_out()).select("doc_id", F.col("quality").alias("label"))
    return compression_quality.fit(docs, seen)


def op5_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan.report(table(spark, folder, "documents"))


def op6_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.report(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op1_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.join(table(spark, folder, "documents"))


def op2_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    return packing.pack_documents(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.report(table(spark, folder, "documents"))


def op11_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return source_mixing.shares(source_mixing.mix(table(spark, folder, "documents")))


def op12_importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    return importance_resampling.scores(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op13_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(table(spark, folder, "documents"))


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {
        "op3_url_reputation": url_reputation.ORACLE_SQL,
        "op5_license_scan": license_scan.ORACLE_SQL,
        "op6_decontamination": decontamination.ORACLE_SQL,
        "op10_substring_dedup": substring_dedup.ORACLE_SQL,
        "op7_search": search.ORACLE_SQL,
        "op8_warc": warc.ORACLE_SQL,
        "op12_importance_resampling": importance_resampling.ORACLE_SQL,
        "op13_collocations": collocations.ORACLE_SQL,
    }
