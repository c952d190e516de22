"""The corpus pipeline: toxic documents go, repeated passages go, one document of each group of
near copies stays, the sources are mixed to their target weights, the rest is packed.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of ``docs``.  ``run`` writes each stage's rows as Parquet into the shared checkpoint
folder and reads them again as the next stage's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from solera.llm import line_dedup, mixing, packing, simhash, toxicity
from solera.llm.common import table, text_of, written


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator scores below its threshold."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = toxicity.train(docs, labels)
    return docs.filter(toxicity.score_column(spark, F.col("text"), model) < toxicity.THRESHOLD)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the runs of lines that occurred earlier; a document that consists of them goes."""
    left = line_dedup.dedup_lines(docs).filter("n_removed = 0 or n_removed < n_lines")
    return left.withColumn("n_chars", F.length(text_of(F.col("text"))).cast("long")).select(*docs.columns)


def dedup_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints, the one with the smallest id."""
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return mixing.take(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in training sequences."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", dedup_lines),
    ("simhash_near_dedup", dedup_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Learning and fingerprint hashes can't be stated in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
