"""The corpus pipeline: stages over documents, each written and read by the next.

Toxic documents go, one document of each group of near copies stays, documents that
hold benchmark passages go, sources are mixed to their target weights (a document may
be taken twice), and what is left is dealt into shards.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from pricelode.llm.common import ready_checkpoints, remove
from pricelode.llm.decontamination import decontaminate
from pricelode.llm.minhash import drop_near_duplicates
from pricelode.llm.mixing import mix_documents
from pricelode.llm.sharding import shard_digest
from pricelode.llm.toxicity import fit, keep_clean


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return keep_clean(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five words, similarity 0.8."""
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mix_documents(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of each row."""
    return shard_digest(docs)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: SQL can't express the trained classifier of the first stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what one returns is written to the checkpoint folder for the next, and
    removed once that one's rows are written. The last table stays, for the result is read from it; if a
    stage fails, none does."""
    ready_checkpoints(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = None
    try:
        for k, (name, stage) in enumerate(STAGES):
            docs = stage(spark, docs, sf_dir)
            if k < len(STAGES) - 1:
                before, path = path, f"{folder}/{k}-{name}"
                docs.write.parquet(path)
                if before:
                    remove(spark, before)
                docs = spark.read.parquet(path)
    except BaseException:
        remove(spark, folder)
        raise
    return docs
