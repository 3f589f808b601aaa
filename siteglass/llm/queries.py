"""The registered queries of this subpackage and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteglass.llm import decontamination, jaccard, licenses, packing, quality, quotations, records, token_counts, toxicity, url_filters


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.token_counts(docs, limit=1024).select("doc_id", "n_bytes", "n_tokens", "over_limit", "fit_chars")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = quality.learn(docs, _table(spark, sf_dir, "labels"))
    return quality.judge(docs, rules).select("doc_id", *quality.STATISTICS, "base_failed", "rule", "kept")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), end_id=0, capacity=1024)


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(_table(spark, sf_dir, "documents"), n=3, num=90, den=100)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = toxicity.held_out(F.col("doc_id"))
    model = toxicity.learn(docs, _table(spark, sf_dir, "labels").select("doc_id", "toxic"), usable=~out)
    return toxicity.score(docs, model).select("doc_id", out.alias("held_out"), "score", "predicted")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op8_chat_quotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotations.conversations(_table(spark, sf_dir, "conversations"))


def op9_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.token_records(_table(spark, sf_dir, "documents"), end_id=2).select("doc_id", "start", "n_tokens", "ids_crc32")


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(_table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", *url_filters.RESULT)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_counts": op1_token_counts,
        "op2_quality_rules": op2_quality_rules,
        "op3_decontamination": op3_decontamination,
        "op4_packing": op4_packing,
        "op5_jaccard_join": op5_jaccard_join,
        "op6_toxicity": op6_toxicity,
        "op7_license_scan": op7_license_scan,
        "op8_chat_quotations": op8_chat_quotations,
        "op9_token_records": op9_token_records,
        "op10_url_filters": op10_url_filters,
    }


def oracle_sql() -> dict[str, str]:
    return {"op7_license_scan": licenses.sql(), "op10_url_filters": url_filters.sql()}
