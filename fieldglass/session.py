"""Session settings the library is tuned for; every operator also works without them."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

# AQE coalesces small shuffles and splits skewed joins.  Joins on (game, x) may reuse
# an existing partitioning on `game` alone once full co-partitioning is not demanded.
CLUSTER_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.parquet.filterPushdown": "true",
    # The JVM never compiles methods beyond 8000 bytes of bytecode; wide projections of the
    # pitch schema exceed that when fused, so they run as separately compiled pieces.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, **extra: str) -> SparkSession:
    """A local session for tests and benchmarks."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("fieldglass")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "12g")
    )
    for key, value in {**CLUSTER_SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def literal_table(spark: SparkSession, rows: list[tuple], columns: str):
    """A small constant table the optimizer knows the size of (a local relation).

    `columns` is a DDL list; values are strings, numbers, booleans or None.
    """
    fields = [part.strip().split(" ") for part in columns.split(",")]

    def text(value):
        if value is None:
            return "NULL"
        return "'" + value.replace("'", "\\'") + "'" if isinstance(value, str) else str(value)

    values = ", ".join("(" + ", ".join(text(v) for v in row) + ")" for row in rows)
    names = ", ".join(name for name, _ in fields)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({names})").selectExpr(*[f"cast({n} AS {t}) AS {n}" for n, t in fields])


_OWN_FOLDER: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that `spark.checkpoint.dir` names, shared by driver and executors.

    Only a session whose driver is its one executor (local[*]) may go without that setting; it then
    gets a folder of its own.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None and re.fullmatch(r"local(\[.*\])?", context.master):
        if context.applicationId not in _OWN_FOLDER:
            _OWN_FOLDER[context.applicationId] = tempfile.mkdtemp(prefix="shared-")
        folder = _OWN_FOLDER[context.applicationId]
    if folder is None:
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return folder


def cut_lineage(df):
    """Materialise a reused frame in the shared folder."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def written_table(df):
    """Materialise a wide reused frame as a table in the shared folder: each reader takes only the columns it needs."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
