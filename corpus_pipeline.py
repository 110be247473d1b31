"""The corpus pipeline: each stage takes the documents that the one before kept.

ORACLE_SQL is None: scores of boosted trees and MinHash candidates aren't SQL; tests/llm holds the
stages against brute-force versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatewright.llm import decontaminate, minhash, mixing, secret_scan, toxicity
from gatewright.llm.storage import written

#: A row's key inside a stage.
ROW = "__gatewright_row"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier of labels.toxic doesn't reject."""
    return toxicity.without_toxic(docs, _table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates on five-word shingles one row, that with the smallest id (rows without an id come
    last; among rows of one id the first stays). Decided row by row: ids may be null or shared."""
    keyed = written(docs.withColumn(ROW, F.monotonically_increasing_id()), "keyed")
    found = minhash.near_duplicates(keyed, id_col=ROW).select(F.col("doc_id").alias(ROW), "component_id")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", ROW)).alias("first")
    kept = keyed.select(ROW, "doc_id").join(found, ROW).groupBy("component_id").agg(first).select(F.col(f"first.{ROW}").alias(ROW))
    return keyed.join(kept, ROW, "left_semi").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item stands, row by row: ids may be null or shared."""
    keyed = written(docs.withColumn(ROW, F.monotonically_increasing_id()), "keyed")
    found = decontaminate.contamination(keyed, _table(spark, sf_dir, "benchmark"), id_col=ROW)
    gone = found.where("contaminated").select(F.col("doc_id").alias(ROW))
    return keyed.join(gone, ROW, "left_anti").select(*docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced in the text and n_chars counted anew."""
    clean = secret_scan.masked(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document."""
    return mixing.mix(docs)[0]


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secret_scan", mask_secrets),
    ("source_mixing", mix_sources),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written as Parquet and read again by the next."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
