"""Day tables whose content is switched by one commit: data folders plus a manifest per version.

A version is a file `_versions/<n>.json` that names the schema and, per day or Monday week, the folder with
its rows.  Writers put rows in a folder of their own, which no version names yet, and then create the next
manifest; whoever comes second finds it taken and writes nothing visible.  A reader takes the manifest once
and keeps its folders, so it sees one version whatever happens meanwhile, and a writer that dies leaves the
table as it was.  The manifest has one entry per day or week, so it is calendar-sized.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fieldglass.operators.ordered import latest_per_key
from fieldglass.session import cut_lineage
from fieldglass.sources.sinks import ROWS_PER_FILE, spread

_NO_DAY = "0001-01-01"  # the span of rows without a day


class CommitConflict(RuntimeError):
    """Another writer has made the version that this one was about to make."""


@dataclass(frozen=True)
class Entry:
    """The folder `commit` holds the rows of the days from `span` on, `days` of them (1 or 7)."""

    span: str
    days: int
    commit: str


def _system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path
    return place(path).getFileSystem(spark._jsc.hadoopConfiguration()), place


def versions(spark: SparkSession, path: str) -> list[int]:
    """Committed versions, oldest first."""
    system, place = _system(spark, path)
    folder = place(f"{path}/_versions")
    names = [f.getPath().getName() for f in system.listStatus(folder)] if system.exists(folder) else []
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))


def manifest(spark: SparkSession, path: str, version: int | None = None) -> tuple[int, list[Entry], StructType | None]:
    """(version, entries, schema) of one version, the newest unless stated; version 0 is the table that does not exist."""
    known = versions(spark, path)
    version = (known[-1] if known else 0) if version is None else version
    if version == 0 and not known:
        return 0, [], None
    if version not in known:
        raise ValueError(f"no version {version} of {path}; there are {known}")
    system, place = _system(spark, path)
    stream = system.open(place(f"{path}/_versions/{version:08d}.json"))
    try:
        stated = json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()
    return version, [Entry(**e) for e in stated["entries"]], StructType.fromJson(stated["schema"])


def _commit(spark: SparkSession, path: str, version: int, entries: list[Entry], schema: StructType) -> None:
    """Make `version` visible by one rename that fails if it is there already."""
    system, place = _system(spark, path)
    target, draft = place(f"{path}/_versions/{version:08d}.json"), place(f"{path}/_versions/.{uuid.uuid4().hex}.draft")
    stream = system.create(draft, False)
    try:
        ordered = sorted(entries, key=lambda e: e.span)
        stream.write(json.dumps({"schema": schema.jsonValue(), "entries": [asdict(e) for e in ordered]}).encode())
    finally:
        stream.close()
    # The checksum files of a local folder are moved along by its own rename.
    if system.exists(target) or not system.rename(draft, target):
        system.delete(draft, False)
        raise CommitConflict(f"version {version} of {path} was written by someone else; run the change again")


def _read(spark: SparkSession, path: str, entries: list[Entry], schema: StructType) -> DataFrame:
    if not entries:
        return spark.createDataFrame([], schema)
    folders = [f"{path}/table_commit={e.commit}/table_span={e.span}" for e in entries]
    return spark.read.schema(schema).option("basePath", path).parquet(*folders).drop("table_commit", "table_span")


def read(spark: SparkSession, path: str, version: int | None = None, first: str | None = None, last: str | None = None) -> DataFrame:
    """The rows of one version; with day bounds only the folders that may hold such days are listed and read."""
    _, entries, schema = manifest(spark, path, version)
    if schema is None:
        raise ValueError(f"no table at {path}")
    end = lambda e: (dt.date.fromisoformat(e.span) + dt.timedelta(days=e.days - 1)).isoformat()
    kept = [e for e in entries if (first is None or end(e) >= first) and (last is None or e.span <= last)]
    return _read(spark, path, kept, schema)


def _span(day: str, weeks: list[str]) -> Column:
    """The start of the week for days of the listed weeks, else the day."""
    own = F.coalesce(F.col(day).cast("date"), F.lit(_NO_DAY).cast("date"))
    monday = F.trunc(own, "week")
    span = F.when(monday.cast("string").isin(*weeks), monday).otherwise(own) if weeks else own
    return span.cast("string")


def _write(df: DataFrame, path: str, day: str, by: list[str], weeks: list[str], rows_per_file: int) -> list[Entry]:
    """Write rows to a folder of their own; the entries that name it."""
    spark, commit = df.sparkSession, uuid.uuid4().hex
    rows = spread(df.withColumn("table_span", _span(day, weeks)), "table_span", by, rows_per_file)
    rows.sortWithinPartitions("table_span", day, *by).write.partitionBy("table_span").parquet(f"{path}/table_commit={commit}")
    system, place = _system(spark, path)
    folders = [f.getPath().getName() for f in system.listStatus(place(f"{path}/table_commit={commit}"))]
    spans = [n.removeprefix("table_span=") for n in folders if n.startswith("table_span=")]
    return [Entry(s, 7 if s in weeks else 1, commit) for s in spans]


def replace(df: DataFrame, path: str, day: str, rows_per_file: int = ROWS_PER_FILE) -> int:
    """Create the table or replace all its rows; the new version."""
    before, _, _ = manifest(df.sparkSession, path)
    _commit(df.sparkSession, path, before + 1, _write(df, path, day, df.columns[:1], [], rows_per_file), df.schema)
    return before + 1


def upsert(fresh: DataFrame, path: str, keys: list[str], day: str, order: list[Column], rows_per_file: int = ROWS_PER_FILE) -> int:
    """Rows of the batch replace rows of the same keys, wherever those are; the version that holds the result.

    Of the batch's rows of one key the last by `order` counts.  Days that the batch touches, and days that
    rows left, are written anew (with their week, if it was compacted); all others keep their folders.
    Columns that either side lacks are null.  An empty batch makes no version, and applying a batch again
    gives the same rows.
    """
    spark = fresh.sparkSession
    fresh = cut_lineage(latest_per_key(fresh, keys, order))
    version, entries, schema = manifest(spark, path)
    days = fresh.select(_span(day, []).alias("span"))
    if schema is not None:
        # A corrected row may have moved to another day: its old day is written anew too.
        current = _read(spark, path, entries, schema)
        days = days.unionByName(current.join(fresh.select(*keys), keys, "left_semi").select(_span(day, []).alias("span")))
    touched = {r["span"] for r in days.distinct().collect()}  # calendar-sized
    if not touched and schema is not None:
        return version

    def covers(e: Entry) -> bool:
        start = dt.date.fromisoformat(e.span)
        return any((start + dt.timedelta(days=i)).isoformat() in touched for i in range(e.days))

    old = [e for e in entries if covers(e)]
    merged = fresh
    if schema is not None:
        base = _read(spark, path, old, schema)
        merged = base.join(fresh.select(*keys), keys, "left_anti").unionByName(fresh, allowMissingColumns=True)
    written = _write(merged, path, day, keys, [e.span for e in old if e.days == 7], rows_per_file)
    _commit(spark, path, version + 1, [e for e in entries if e not in old] + written, merged.schema)
    return version + 1


def compact_weeks(spark: SparkSession, path: str, day: str, by: list[str], rows_per_file: int = ROWS_PER_FILE) -> int:
    """Merge the seven days of every Monday week that has them all; the version that holds the result.

    Rows stay the same; running it again with nothing to merge makes no version.
    """
    version, entries, schema = manifest(spark, path)
    weeks: dict[str, list[Entry]] = {}
    for e in entries:
        start = dt.date.fromisoformat(e.span)
        if e.days == 1 and e.span != _NO_DAY:
            weeks.setdefault((start - dt.timedelta(days=start.weekday())).isoformat(), []).append(e)
    whole = {monday: parts for monday, parts in weeks.items() if len(parts) == 7}
    if not whole:
        return version
    old = [e for parts in whole.values() for e in parts]
    written = _write(_read(spark, path, old, schema), path, day, by, list(whole), rows_per_file)
    _commit(spark, path, version + 1, [e for e in entries if e not in old] + written, schema)
    return version + 1


def expire(spark: SparkSession, path: str, keep: int) -> None:
    """Forget all but the newest `keep` versions and delete the folders that none of those names.

    Folders of a writer at work are named by no version yet, so run it while nobody writes.
    """
    known = versions(spark, path)
    kept = known[-max(keep, 1):]
    named = {e.commit for v in kept for e in manifest(spark, path, v)[1]}
    system, place = _system(spark, path)
    for v in known[:-len(kept)]:
        system.delete(place(f"{path}/_versions/{v:08d}.json"), False)
    for folder in system.listStatus(place(path)):
        name = folder.getPath().getName()
        if name.startswith("table_commit=") and name.removeprefix("table_commit=") not in named:
            system.delete(folder.getPath(), True)


def entry_table(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """(span, days) of one version's entries."""
    return spark.createDataFrame([(e.span, e.days) for e in manifest(spark, path, version)[1]], "span string, days int")
