"""Helpers shared by the training-data operators: shared storage, row keys, components."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Words are runs of anything but these six ASCII white-space characters.
WORD = "[^\\x20\\x09-\\x0D]+"
SPACE = "[\\x20\\x09-\\x0D]+"
ONE_TASK = 500_000  # edges that a task may hold, 8 MB
_LOCAL: dict[str, str] = {}
_REACHED: set[str] = set()


def reach_workers(spark: SparkSession) -> None:
    """In a local session started elsewhere, give this package to the Python workers.

    On a cluster the package is installed or sent with --py-files, as for any job.
    """
    context, root = spark.sparkContext, Path(__file__).resolve().parents[2]
    known = [*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd()]
    if not context.master.startswith("local") or str(root) in known or context.applicationId in _REACHED:
        return
    archive = Path(tempfile.mkdtemp(prefix="package-")) / "fieldglass-package.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted((root / "fieldglass").rglob("*.py")):
            out.write(file, file.relative_to(root))
    context.addPyFile(str(archive))
    _REACHED.add(context.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """The folder of `spark.checkpoint.dir`; only a local[*] session without one gets its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _LOCAL.setdefault(context.applicationId, tempfile.mkdtemp(prefix="llm-shared-"))


def store(df: DataFrame) -> DataFrame:
    """Write a reused frame to the shared folder, so that it survives lost executors."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


def returning_memory(run):
    """`run` for mapInArrow: what its batches took in Arrow's pool and is free again goes back to the system.

    Python workers are reused, and would hold it beside the JVM through all later tasks.
    """

    def steps(batches):
        import pyarrow as pa

        for batch in run(batches):
            yield batch
            del batch
            pa.default_memory_pool().release_unused()
        pa.default_memory_pool().release_unused()

    return steps


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def null_last_key(name: str) -> Column:
    """A never-null text that sorts as the column by code point, nulls last."""
    return F.when(F.col(name).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(name).cast("string")))


def id_remainder(name: str, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo; null ids have none."""
    return F.crc32(F.col(name).cast("string").cast("binary")) % modulus


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def _star(edges: DataFrame, large: bool) -> DataFrame:
    if large:
        near = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        near = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = near.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    joined = near.join(least, "a")
    moved = joined.where(F.col("b") > F.col("a")) if large else joined
    moved = moved.select(F.col("b").alias("a"), F.col("m").alias("b"))
    if not large:
        moved = moved.unionByName(least.select("a", F.col("m").alias("b")))
    return moved.where(F.col("a") != F.col("b")).distinct()


def _least_reached(batches):
    """(a, b) of each node of the batches' edges and the least node it is connected with, itself left out."""
    import numpy as np
    import pyarrow as pa

    parts = [np.stack([batch.column(i).to_numpy() for i in (0, 1)]) for batch in batches]
    nodes, place = np.unique(np.concatenate(parts, axis=1) if parts else np.zeros((2, 0), dtype=np.int64), return_inverse=True)
    left, right = place.reshape(2, -1)
    label = np.arange(len(nodes))
    while (label[left] != label[right]).any():
        a, b = label[left], label[right]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label = label[label]
    other = label != np.arange(len(nodes))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[other]), pa.array(nodes[label[other]])], ["a", "b"])


def components(edges: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """Connected components of long pairs (a, b): rows (a, b) with b the least node that a reaches.

    Large-star and small-star rounds in turn: every round keeps connectivity, needs at most one
    row per edge and halves distances, so rounds grow with the logarithm of the node count.  The
    least nodes themselves have no row.  Rounds are written to the shared folder.  Once at most
    `one_task` edges are left a single task finishes them.
    """
    edges = store(edges.select("a", "b").where(F.col("a") != F.col("b")).distinct())
    seen = _digest(edges)
    while seen[0]:
        if seen[0] <= one_task:
            return store(edges.coalesce(1).mapInArrow(_least_reached, "a long, b long"))
        edges = store(_star(_star(edges, True), False))
        now = _digest(edges)
        if now == seen:
            break
        seen = now
    return edges
