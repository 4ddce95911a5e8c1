"""Sharding by proportional stratified interleaving, in DataFrame operations only.

Rows of each source are put in a seeded pseudorandom order.  A row's fractional rank is its place in
that order over the number of rows of its source, shifted by a constant of the source.  Sorted by
fractional rank, any stretch of rows has the mixture of the whole, so the sorted rows are cut into
shards of equal row counts.  Both ranks are taken inside hash buckets with carried counts: no source
and no stretch is one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldglass.llm.common import null_last_key, store

_PARTS = 1024  # of a source's pseudorandom order, by the top ten bits of the hash
_STRETCHES = 4096  # of the interval of fractional ranks


def _carry(rows: DataFrame, keys: list[str], bucket: str) -> DataFrame:
    """Per bucket the rows in earlier buckets of its key, and the rows of the key."""
    counts = rows.groupBy(*keys, bucket).agg(F.count(F.lit(1)).alias("n"))
    line = Window.partitionBy(*keys).orderBy(bucket)
    before = F.coalesce(F.sum("n").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    return counts.select(*keys, bucket, before.alias("before"), F.sum("n").over(Window.partitionBy(*keys)).alias("total"))


def shard(docs: DataFrame, shards: int = 16, seed: int = 5) -> DataFrame:
    """Per row: doc_id, size, text_crc32, law ('rows'), shard, slot, grown_shard (null), source_rank.

    Row counts of shards differ by one at most.  A null text counts as empty (size 1); a null source is
    a source of its own.  Equal rows are interchangeable and land in any of their places.  Equal texts
    are not kept together, as equal row counts forbid it for large groups.  An empty table gives no
    rows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text).alias("text_crc32"), null_last_key("source").alias("src"),
    )
    rows = rows.withColumn("h", F.xxhash64("doc_id", "text_crc32", "size", F.lit(seed)))
    rows = store(rows.withColumn("part", F.shiftrightunsigned("h", 54).cast("int")))
    inside = Window.partitionBy("src", "part").orderBy("h", "doc_id", "text_crc32", "size")
    ranked = rows.join(_carry(rows, ["src"], "part"), ["src", "part"])
    ranked = ranked.withColumn("source_rank", F.col("before") + F.row_number().over(inside) - 1)
    shift = F.shiftrightunsigned(F.xxhash64("src", F.lit(seed)), 11) / F.lit(float(1 << 53))
    ranked = ranked.withColumn("fraction", (F.col("source_rank") + shift) / F.col("total")).drop("before", "total", "part", "h")
    ranked = store(ranked.withColumn("stretch", F.floor(F.col("fraction") * _STRETCHES).cast("int")))
    along = Window.partitionBy("stretch").orderBy("fraction", "src", "source_rank")
    placed = ranked.join(_carry(ranked, [], "stretch"), "stretch")
    placed = placed.withColumn("place", F.col("before") + F.row_number().over(along) - 1)
    number = F.expr(f"(place * {shards}) div total")
    placed = placed.withColumn("shard", number.cast("int"))
    begin = F.expr(f"(shard * total + {shards - 1}) div {shards}")
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("place") - begin).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "source_rank",
    )
