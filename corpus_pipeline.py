"""A corpus pipeline: drop toxic documents, near copies and secrets, mix sources, pack sequences."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from fieldglass.llm import mixing, packing, secret_scan, shingle_copies, toxicity
from fieldglass.llm.common import shared_folder, table
from fieldglass.llm.packing import tokenizer_path


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8) stays, that of the smallest id."""
    return shingle_copies.keep_one(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the text by a mark."""
    return secret_scan.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are taken at their target weights; a document may come twice or in part."""
    return mixing.mixed_documents(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's token pieces, placed in sequences."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [("toxicity", toxic), ("simhash_near_dedup", near_copies), ("secret_scan", secrets), ("mixing", mixture), ("best_fit_packing", sequences)]
# Trained scores, MinHashes and tokenizer ids have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    place = f"{shared_folder(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{place}/{name}")
        docs = spark.read.parquet(f"{place}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
