"""The corpus pipeline: from raw documents to sharded training data.

Each stage is (name, function of (spark, docs, sf_dir)); what it returns is written as Parquet and read again as the
next one's docs. All stages but the last return the columns of their docs.

1. toxicity: documents that the sentence model rejects go (models learn from the docs that came in).
2. near_dedup: of each group of near duplicates (fingerprints within 2 bits, as op9; then five-word shingles with a similarity
   of 0.8 or more) the document with the smallest doc_id stays.
3. decontamination: documents that hold a window (ten words) of a benchmark item go; shorter items condemn nothing.
4. mixing: documents are cut into the pieces whose blocks the mix of sources draws, each as often as it is drawn. As a stage returns the
   columns of its docs, the shard and slot that were drawn don't travel along (`Mix.blocks` has them).
5. sharding: each row gets its shard by doc_id, so the pieces of a document go together.

Null and empty texts pass toxicity and decontamination and are near duplicates of each other; repeated rows are
near duplicates; an empty table stays empty; extra columns travel along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabloom.llm import decontamination, mixing, near_copies, sharding, toxicity
from tabloom.llm.common import table
from tabloom.sources.shared import new_path, remove


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.without_hits(docs, table(spark, sf_dir, "benchmark"), decontamination.WINDOW)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.Mix(docs).documents()


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("mixing", mix),
    ("sharding", shard),
]

#: The fingerprints, their components and the trained model are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; the result of each is written to the shared folder before the next, and removed once the next is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = new_path(spark, f"pipeline-{name}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
            if before:
                remove(spark, before)
            before = path
    return docs
