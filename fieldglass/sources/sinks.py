"""Table, CSV and JSON sinks, run log, and content signatures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


ROWS_PER_FILE = 4_000_000


def spread(df: DataFrame, part: str, by: list[str], rows_per_file: int = ROWS_PER_FILE) -> DataFrame:
    """Shuffle rows so that each part (a day, a week) gets as many tasks as its rows need.

    Rows with equal values of `by` stay together.  The counts have one row per calendar day or week.
    """
    files = df.groupBy(F.col(part).alias("__part")).agg(F.ceil(F.count("*") / F.lit(rows_per_file)).alias("__files"))
    sized = df.join(F.broadcast(files), F.col(part).eqNullSafe(F.col("__part")))
    return sized.repartition(part, F.pmod(F.xxhash64(*by), F.col("__files"))).drop("__part", "__files")


def write_landing(df: DataFrame, path: str, start: str, end: str, day: str = "game_date") -> None:
    """Lineage columns, a day partition per folder, rows in event order inside each file."""
    stamped = df.withColumns({"source_start_date": F.lit(start), "source_end_date": F.lit(end), "loaded_at_utc": F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")})
    spread(stamped, day, ["game_pk", "at_bat_number", "pitch_number"]).sortWithinPartitions(day, "game_pk", "at_bat_number", "pitch_number").write.mode("overwrite").partitionBy(day).parquet(path)


def write_clustered(df: DataFrame, path: str, day: str = "game_date", cluster: tuple[str, ...] = ("pitcher_id", "pitch_type"), rows_per_file: int = ROWS_PER_FILE) -> None:
    """Day partitions clustered inside; a large day is spread over files by its cluster columns."""
    spread(df, day, list(cluster), rows_per_file).sortWithinPartitions(day, *cluster).write.mode("overwrite").partitionBy(day).parquet(path)


def write_csv(df: DataFrame, path: str, order: list | None = None) -> None:
    """Header CSV; an ordered export is range-sorted in parallel, files in order."""
    (df.orderBy(*order) if order else df).write.mode("overwrite").option("header", True).csv(path)


def json_rows(df: DataFrame) -> DataFrame:
    """NaN and infinities to NULL, dates and instants to ISO text."""
    out = []
    for field in df.schema.fields:
        kind, column = field.dataType.typeName(), F.col(field.name)
        if kind in ("double", "float"):
            column = F.when(~F.isnan(column) & (F.abs(column) != float("inf")), column)
        elif kind == "date":
            column = F.date_format(column, "yyyy-MM-dd")
        elif kind in ("timestamp", "timestamp_ntz"):
            column = F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss")
        out.append(column.alias(field.name))
    return df.select(*out)


def write_json(df: DataFrame, path: str) -> None:
    json_rows(df).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def run_log_row(df: DataFrame, run_id: str, mode: str, day: str = "game_date") -> DataFrame:
    return df.agg(F.count("*").alias("rows"), F.max(day).alias("data_through")).select(F.lit(run_id).alias("run_id"), F.lit(mode).alias("mode"), "rows", "data_through")


def append_run_log(row: DataFrame, path: str) -> None:
    row.write.mode("append").parquet(path)


def publish_view(df: DataFrame, name: str) -> None:
    """A view for SQL, nothing written; over `versions.read` it stays at the version that was read."""
    df.createOrReplaceTempView(name)


def content_signature(df: DataFrame) -> DataFrame:
    """Row count and an order-free digest: equal for equal row multisets, however partitioned."""
    columns = sorted(df.columns)
    text = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    hashed = df.select(F.sha2(text, 256).alias("h"))
    piece = lambda i: F.sum(F.conv(F.substring("h", 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)")).cast("string")
    return hashed.agg(F.count("*").alias("rows"), F.sha2(F.concat_ws("|", *[F.coalesce(piece(i), F.lit("0")) for i in range(5)]), 256).alias("signature"))
