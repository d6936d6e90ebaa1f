"""A training-corpus pipeline: each stage is written as Parquet and read again as the next stage's documents.

Edge cases: without labels of both classes the classifier keeps all documents; null texts stay null through line dedup, are near copies of each other
(and of texts without words), hold no passage of the benchmark and are packed as empty texts; rows that repeat an id with another text
are documents of their own; an empty table gives no pieces; extra columns of documents are kept up to the last stage, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm import decontaminate, line_dedup, packing, quality, simhash
from helixframe.llm.common import free_name, stored

#: Documents with a lower score go. The labels' own balance is the classifier's business; 0.3 favours keeping.
THRESHOLD = 0.3


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones, does not reject."""
    machine = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = free_name("score", docs.columns)
    return quality.score(docs, machine, docs.columns, score).where(F.col(score) >= THRESHOLD).select(*docs.columns)


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines whose template recurs; n_chars follows the text."""
    kept = line_dedup.drop_recurring(docs, counts=False)
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window with a benchmark item."""
    found = decontaminate.contaminated_keys(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return decontaminate.without(docs, found).select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the kept documents with their place in the packed sequences."""
    return packing.best_fit_pack(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_deduplication),
    ("simhash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("best-fit packing", best_fit_packing),
]

#: No SQL: the classifier is trained and the tokenizer is a library.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
