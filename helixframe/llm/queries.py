"""One query per operator, over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, chat, decontaminate, fill_middle, fingerprints, line_dedup, packing, quality, simhash, suffix_dedup, token_files, url_filter, vector_codes


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_pack(_table(spark, sf_dir, "documents"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_files.write_token_files(_table(spark, sf_dir, "documents"))
    return token_files.read_token_files(manifest)


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest_neighbours(_table(spark, sf_dir, "embeddings"))


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digest(chat.formatted(chat.with_probe(_table(spark, sf_dir, "conversations"))))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return url_filter.judge(pages, labelled=url_filter.taught_labels(pages, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.drop_recurring(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", "text")


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(simhash.near_duplicates(_table(spark, sf_dir, "documents")))


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents")))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digest(fill_middle.fill_in_middle(_table(spark, sf_dir, "documents")))


def op12_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.digest(fingerprints.fingerprinted(_table(spark, sf_dir, "documents")))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.digest(*vector_codes.compress(_table(spark, sf_dir, "embeddings")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_best_fit_packing": op1_best_fit_packing,
        "op2_token_files": op2_token_files,
        "op3_benchmark_decontamination": op3_benchmark_decontamination,
        "op4_nearest_neighbours": op4_nearest_neighbours,
        "op5_chat_formatting": op5_chat_formatting,
        "op6_url_filters": op6_url_filters,
        "op7_quality_classifier": op7_quality_classifier,
        "op8_line_dedup": op8_line_dedup,
        "op9_simhash_near_dedup": op9_simhash_near_dedup,
        "op10_suffix_array_dedup": op10_suffix_array_dedup,
        "op11_fill_in_middle": op11_fill_in_middle,
        "op12_document_fingerprints": op12_document_fingerprints,
        "op13_vector_codes": op13_vector_codes,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_benchmark_decontamination": decontaminate.ORACLE, "op5_chat_formatting": chat.ORACLE, "op11_fill_in_middle": fill_middle.ORACLE, "op13_vector_codes": vector_codes.ORACLE}
