"""Landed files: partition reads by name, ledgers of proven partitions, CSV landings and seeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_partitions(spark: SparkSession, paths: list[str], schema: str | None = None) -> DataFrame:
    """Multi-file parquet scan by column name; a stated schema avoids reading every footer."""
    reader = spark.read.schema(schema) if schema else spark.read.option("mergeSchema", "true")
    return reader.parquet(*paths)


def union_by_name(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)


def manifest_differences(landed: DataFrame, manifest: DataFrame, key: str) -> DataFrame:
    """Files whose landed row count differs from the manifest's."""
    counted = landed.groupBy(key).agg(F.count("*").alias("landed_rows"))
    joined = manifest.join(counted, key, "full").na.fill(0, ["landed_rows", "row_count"])
    return joined.filter(F.col("landed_rows") != F.col("row_count"))


def partition_ledger(rows: DataFrame, source: str, day: str) -> DataFrame:
    return rows.groupBy(F.lit(source).alias("source"), F.col(day).alias("partition_date")).agg(F.count("*").alias("row_count"))


def with_proven_empty(ledger: DataFrame, empty_days: DataFrame, source: str) -> DataFrame:
    """Add zero-row entries for days proven to have no data."""
    zero = empty_days.select(F.lit(source).alias("source"), F.col("partition_date"), F.lit(0).cast("bigint").alias("row_count"))
    return ledger.unionByName(zero.join(ledger.select("source", "partition_date"), ["source", "partition_date"], "left_anti"))


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    frame = spark.read.parquet(path)
    return frame.withColumn("game_date", F.to_date("game_date"))
