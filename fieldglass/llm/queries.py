"""The registered queries of the training-data operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from fieldglass.llm import (
    divergence, html_lstm, interleave, mixing, multi_index, packing, prefix_trie, quality_votes, secret_scan, simhash_trie, spot_signatures, toxicity,
    whitening,
)
from fieldglass.llm.common import reach_workers, table
from fieldglass.llm.packing import tokenizer_path


def op1_quality_votes(spark: SparkSession, folder: str) -> DataFrame:
    return quality_votes.score(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op2_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents"))


def op3_multi_index(spark: SparkSession, folder: str) -> DataFrame:
    return multi_index.search(table(spark, folder, "embeddings"))


def op4_simhash_trie(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash_trie.near_duplicates(table(spark, folder, "documents"))
    return found.selectExpr("doc_id", "lower(lpad(hex(fp), 16, '0')) AS fingerprint", "component_id", "group_docs")


def op5_interleaved_shards(spark: SparkSession, folder: str) -> DataFrame:
    return interleave.shard(table(spark, folder, "documents"))


def op6_grouping_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"), tokenizer_path())


def op7_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secret_scan.scan(table(spark, folder, "documents"))


def op8_html_lstm(spark: SparkSession, folder: str) -> DataFrame:
    return html_lstm.extract(table(spark, folder, "pages"))


def op9_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.judge(table(spark, folder, "documents"))


def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.score(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op11_prefix_bitmaps(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.trie(table(spark, folder, "conversations"))


def op12_spot_signatures(spark: SparkSession, folder: str) -> DataFrame:
    return spot_signatures.fingerprint(table(spark, folder, "documents"))


def op13_qdwh_whitening(spark: SparkSession, folder: str) -> DataFrame:
    found = whitening.whiten(table(spark, folder, "embeddings"))
    # Beyond some hundred million vectors of the given spread a deviation may exceed a long; it is null then.
    return found.withColumn("deviation", F.col("deviation").try_cast("long"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [
        op1_quality_votes, op2_mixing, op3_multi_index, op4_simhash_trie, op5_interleaved_shards, op6_grouping_packing, op7_secret_scan,
        op8_html_lstm, op9_divergence, op10_toxicity, op11_prefix_bitmaps, op12_spot_signatures, op13_qdwh_whitening,
    ]
    return {name: _reaching(f) for name, f in ({f.__name__: f for f in own} | {"pipeline": corpus_pipeline.run}).items()}


def _reaching(function):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        reach_workers(spark)
        return function(spark, folder)

    return run


def oracle_sql() -> dict[str, str]:
    return {"op11_prefix_bitmaps": prefix_trie.ORACLE_SQL, "op12_spot_signatures": spot_signatures.oracle_sql()}
