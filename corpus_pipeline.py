"""The corpus pipeline: quality rules, line dedup, near-dedup, decontamination, tokenisation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronopanel.llm import bpe, decontaminate, line_dedup, near_dedup, quality
from chronopanel.llm.common import stored, table
from chronopanel.llm.queries import trusted, vocabulary
from chronopanel.shared import mark, release


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules (operator 9). Null and empty texts have no words and go; repeated rows and ids,
    null ids among them, are judged each by its text; a table without rows stays empty; all columns stay as they are."""
    return quality.quality_rules(docs, trusted(spark, sf_dir)).where("kept").select(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that repeat across documents (operator 3). n_chars follows the text (null: 0). Null and
    empty texts stay; repeated rows each stay, and count as one document; rows with a null id lose every common line."""
    return line_dedup.drop_repeated_lines(docs).withColumn("n_chars", F.length(F.coalesce("text", F.lit(""))).cast("long")).select(*docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: that with the smallest id (operator 1). Rows with a null id stay, as do
    null and empty texts, which are like no other; rows that share an id stay or go together. No rows give none."""
    classes = near_dedup.near_duplicates(docs.select("doc_id", "text"))
    gone = stored(classes.where("doc_id != class_id").select("doc_id").distinct(), "gone")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a leaked benchmark item (operator 7). Null and empty texts stay; repeated rows stay or go together;
    without items all stay."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the ids of every text left, and of the decoded text (operator 5), instead of the text. Null and empty texts
    have no ids; repeated rows each give a row; no rows give none."""
    return bpe.encode_digests(docs, vocabulary()).drop("text")


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_stage),
    ("decontamination", benchmark_stage),
    ("bpe_encoding", token_stage),
]

#: Near-duplicate classes and the vocabulary's merges are not expressible in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, each stage's rows written as Parquet and read back. Once a stage is written, its own
    intermediate tables and the rows of the stage before are removed."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        since = mark() - (k > 0)
        docs = stored(stage(spark, docs, sf_dir), name)
        release(spark, since, 1)
    return docs
