"""A training-data pipeline over `documents`: toxicity, near-duplicates, benchmark leaks, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns what the next one reads, written as Parquet in between; all but the last
return the columns of `documents`. Rows that a stage has no reason to reject stay, those with a null doc_id or text too.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import decontam, neardup, packing, pii, toxicity
from marlstone.llm.common import checkpointed, fold, shared_folder, small_batches, table, without_few


def bare(docs: DataFrame) -> DataFrame:
    """doc_id and text for an operator, and the whole row as `row`, so that no column of the caller's meets one of the operator's."""
    return docs.select("doc_id", "text", F.struct(*docs.columns).alias("row"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose calibrated toxicity is at least toxicity.REJECT go."""
    small_batches(spark)
    labels = table(spark, sf_dir, "labels").where(fold(F.col("doc_id"), 3) != 1)
    return toxicity.score_documents(bare(docs), toxicity.learn(docs.select("doc_id", "text"), labels)).where("predicted = 0").select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest doc_id stays."""
    small_batches(spark)
    gone = checkpointed(neardup.near_duplicates(docs.select("doc_id", "text")).where("not kept").select(F.col("doc_id").alias("__id")).distinct())
    return without_few(docs.withColumn("__id", F.col("doc_id").cast("long")), gone, ["__id"]).select(*docs.columns)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, as it is or re-parameterised, go."""
    small_batches(spark)
    return decontam.contamination(bare(docs), table(spark, sf_dir, "benchmark")).where("not contaminated").select("row.*")


def sanitise_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data are replaced by their kind, and terms that give them away are generalised or removed; n_chars follows the text."""
    small_batches(spark)
    clean = pii.sanitise_documents(bare(docs))
    new = {"text": F.col("clean_text"), "n_chars": F.length("clean_text").cast("long")}
    return clean.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: one row for each piece of a document."""
    small_batches(spark)
    return packing.pack_documents(docs.select("doc_id", "text"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("pii", sanitise_personal_data),
    ("packing", pack),
]

#: The stages need models, hashing and tokenizers, which SQL can't express; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what lies between two of them is written to the shared folder, and goes when the next one is written."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
            if k:
                old = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{k - 1}")
                old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
    return docs
