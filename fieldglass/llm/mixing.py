"""Mixing sources to target weights, in DataFrame operations only.

The words of a source, laid end to end, are packed into blocks of fixed length.  Every output shard
draws a multinomial number of blocks per source; a source's draws are slots, numbered through all
shards and mapped to block indexes by a pseudorandom permutation of the source (swap-or-not rounds,
which permute any range without a table).  A source with more slots than blocks starts over, so no
block is taken more often than the rounded-up ratio of target to size.  Slots and blocks join by index.

The last shard settles: draws beyond a source's quota are not filled, and what a source lacks after
the other shards goes there.  Taken words so differ from the target by half a block at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldglass.llm.common import WORD, null_last_key, store

BUCKETS = 1024  # hash parts of a source whose totals are carried on, so that no source is one task
CELLS = 1024  # parts of the unit interval by which draws find their source
ROUNDS = 16
_CHUNK = 4096


def word_count(name: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(name), F.lit(WORD)), F.lit(0)).cast("long")


def with_targets(sizes: DataFrame, weights: tuple = (5, 2, 1), share: float = 1.5, ceiling: float = 2.0) -> DataFrame:
    """Add weight and target to (src, source_size): water-filled to `share` of all sizes.

    Weights repeat over sources in code-point order.  A target stops at `ceiling` times its source's
    size; the level at which the others share the rest is found from sources sorted by size per weight.
    One row per source is ordered here.
    """
    everything = Window.partitionBy()
    by_name = Window.partitionBy().orderBy("src")
    kinds = F.array(*[F.lit(float(w)) for w in weights])
    rows = sizes.withColumn("weight", F.get(kinds, (F.row_number().over(by_name) - 1) % len(weights)))
    rows = rows.withColumn("limit", F.col("source_size") * F.lit(ceiling)).withColumn("level", F.col("limit") / F.col("weight"))
    before = Window.partitionBy().orderBy("level", "src").rowsBetween(Window.unboundedPreceding, -1)
    full = F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    open_weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    rows = rows.withColumn("lam", (F.sum("source_size").over(everything) * F.lit(share) - full) / open_weight)
    fits = F.when(F.col("lam") <= F.col("level"), F.struct("level", "src", "lam"))
    rows = rows.withColumn("lam", F.min(fits).over(everything)["lam"])
    return rows.withColumn("target", F.least("limit", F.col("lam") * F.col("weight"))).drop("limit", "level", "lam")


def permuted(index: Column, size: Column, key: Column, rounds: int = ROUNDS) -> Column:
    """A pseudorandom permutation of 0..size-1: each round swaps x with key-x, or not, by a hash bit."""

    def turn(x, r):
        partner = F.pmod(F.pmod(F.xxhash64(key, r), size) - x, size)
        swap = F.xxhash64(key, r, F.greatest(x, partner), F.lit(1)).bitwiseAND(F.lit(1)) == 1
        return F.when(swap, partner).otherwise(x)

    return F.aggregate(F.array(*[F.lit(r) for r in range(rounds)]), index.cast("long"), turn)


def _keyed(docs: DataFrame) -> DataFrame:
    """Documents with __src, __size, __hash and __bucket."""
    text = F.col("text").cast("string")
    rows = docs.withColumn("__src", null_last_key("source")).withColumn("__size", word_count()).withColumn("__hash", F.xxhash64(text))
    return rows.withColumn("__bucket", F.pmod(F.xxhash64(F.col("doc_id").cast("long"), "__hash", F.lit(3)), F.lit(BUCKETS)).cast("int"))


def _numbered(rows: DataFrame, carry: DataFrame) -> DataFrame:
    """Add __start: where the document's words begin in its source."""
    order = Window.partitionBy("__src", "__bucket").orderBy("doc_id", "__hash", "__size").rowsBetween(Window.unboundedPreceding, 0)
    joined = rows.join(carry, ["__src", "__bucket"])
    return joined.withColumn("__start", F.col("__before") + F.sum("__size").over(order) - F.col("__size"))


def _carried(rows: DataFrame, block: int, **settings) -> tuple[DataFrame, DataFrame]:
    """Per (source, bucket) what comes before it, with the source's totals; and the sources."""
    sums = store(rows.groupBy("__src", "__bucket").agg(F.sum("__size").alias("__sum")))
    sources = sums.groupBy(F.col("__src").alias("src")).agg(F.sum("__sum").alias("source_size"))
    sources = with_targets(sources, **settings)
    blocks = F.ceil(F.col("source_size") / F.lit(block)).cast("long")
    wanted = F.round(F.col("target") / F.col("source_size") * blocks).cast("long")
    quota = F.when(F.col("source_size") > 0, F.least(2 * blocks, wanted)).otherwise(F.lit(0)).cast("long")
    sources = store(sources.withColumn("blocks", blocks).withColumn("quota", quota))
    before = Window.partitionBy("__src").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    carry = sums.withColumn("__before", F.coalesce(F.sum("__sum").over(before), F.lit(0)).cast("long")).drop("__sum")
    carry = carry.join(sources.select(F.col("src").alias("__src"), F.col("source_size").alias("__total"), F.col("target").alias("__target")), "__src")
    return store(carry), sources


def draw_slots(sources: DataFrame, shards: int = 64, seed: int = 17) -> DataFrame:
    """Slots (shard, src, slot, block): multinomial draws per shard, mapped to permuted block indexes."""
    spark = sources.sparkSession
    total = sources.agg(F.coalesce(F.sum("quota"), F.lit(0))).first()[0]
    each = total // shards
    line = Window.partitionBy().orderBy("src").rowsBetween(Window.unboundedPreceding, 0)
    high = F.sum("quota").over(line) / F.lit(float(max(total, 1)))
    spans = sources.where("quota > 0").withColumn("hi", high).withColumn("lo", F.coalesce(F.lag("hi").over(Window.partitionBy().orderBy("src")), F.lit(0.0)))
    cells = F.sequence(F.floor(F.col("lo") * CELLS), F.least(F.floor(F.col("hi") * CELLS), F.lit(CELLS - 1)))
    spans = spans.select("src", "lo", "hi", F.explode(cells).alias("cell"))
    draws = spark.range(each * (shards - 1)).select(
        F.floor(F.col("id") / F.lit(max(each, 1))).cast("int").alias("shard"),
        (F.shiftrightunsigned(F.xxhash64("id", F.lit(seed)), 11) / F.lit(float(1 << 53))).alias("u"),
    )
    draws = draws.withColumn("cell", F.floor(F.col("u") * CELLS))
    drawn = draws.join(spans, (draws["cell"] == spans["cell"]) & (F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi")))
    counts = drawn.groupBy("src", "shard").agg(F.count(F.lit(1)).alias("n"))
    last = sources.where("quota > 0").select("src", F.lit(shards - 1).alias("shard"), F.col("quota").alias("n"))
    before = Window.partitionBy("src").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    runs = counts.unionByName(last).join(sources.select("src", "quota", "blocks"), "src")
    begin = F.least(F.coalesce(F.sum("n").over(before), F.lit(0)), F.col("quota"))
    runs = runs.withColumn("begin", begin).withColumn("end", F.least(F.col("begin") + F.col("n"), F.col("quota"))).where("end > begin")
    chunk = F.explode(F.sequence(F.col("begin"), F.col("end") - 1, F.lit(_CHUNK).cast("long")))
    # Few and small rows that become many: a stated width keeps them from being put together again.
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    runs = runs.withColumn("from", chunk).repartition(width, "src", "from")
    slot = F.explode(F.sequence(F.col("from"), F.least(F.col("from") + (_CHUNK - 1), F.col("end") - 1)))
    slots = runs.select("shard", "src", "blocks", slot.alias("slot"))
    return slots.select("shard", "src", "slot", permuted(F.col("slot") % F.col("blocks"), F.col("blocks"), F.xxhash64("src", F.lit(seed))).alias("block"))


def _takes(numbered: DataFrame, sources: DataFrame, block: int, shards: int, seed: int) -> DataFrame:
    """Per document part and block: (__src, __start, block, overlap, times)."""
    times = draw_slots(sources, shards, seed).groupBy("src", "block").agg(F.count(F.lit(1)).alias("times"))
    size = F.lit(block).cast("long")
    end = F.col("__start") + F.col("__size")
    first, last = F.expr(f"__start div {block}"), F.expr(f"(__start + __size - 1) div {block}")
    parts = numbered.where("__size > 0").select("__src", "__start", end.alias("end"), F.explode(F.sequence(first, last)).alias("block"))
    low, high = F.greatest("__start", F.col("block") * size), F.least("end", (F.col("block") + 1) * size)
    parts = parts.select("__src", "__start", "block", (high - low).alias("overlap"))
    joined = parts.join(times.withColumnRenamed("src", "__src"), ["__src", "block"], "left")
    return joined.withColumn("times", F.coalesce("times", F.lit(0)))


def mix(docs: DataFrame, block: int = 64, shards: int = 64, seed: int = 17, **settings) -> DataFrame:
    """Per row: doc_id, size, source_size, target, taken (words that the mix takes, repeats counted).

    A null text has no words; a null source is a source of its own, last in order.  Documents without
    words are taken zero times.  Repeated rows take part one by one.  An empty table gives no rows.
    Hashes of ids and texts decide everything, so reruns agree.
    """
    rows = store(_keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "source")).drop("text", "source"))
    carry, sources = _carried(rows, block, **settings)
    numbered = store(_numbered(rows, carry))
    takes = _takes(numbered, sources, block, shards, seed)
    taken = takes.where("times > 0").groupBy("__src", "__start").agg(F.sum(F.col("overlap") * F.col("times")).alias("taken"))
    joined = numbered.join(taken, ["__src", "__start"], "left")
    return joined.select(
        "doc_id", F.col("__size").alias("size"), F.col("__total").alias("source_size"), F.col("__target").alias("target"),
        F.when(F.col("__size") > 0, F.coalesce("taken", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("taken"),
    )


def mixed_documents(docs: DataFrame, block: int = 64, shards: int = 64, seed: int = 17, **settings) -> DataFrame:
    """The mixture as documents: one row per document and time that words of it are taken.

    A copy whose words are all taken keeps its text; of others the taken words remain, joined by one
    space (`n_chars`, if there, counted anew).  All columns stay.
    """
    names = docs.columns
    keyed = _keyed(docs)
    rows = store(keyed.select(F.col("doc_id"), "__src", "__size", "__hash", "__bucket"))
    carry, sources = _carried(rows, block, **settings)
    takes = _takes(_numbered(rows, carry), sources, block, shards, seed)
    lists = takes.groupBy("__src", "__start").agg(F.sort_array(F.collect_list(F.struct("block", "times")))["times"].alias("__times"))
    texts = _numbered(keyed, carry).where("__size > 0").join(lists, ["__src", "__start"])
    copies = texts.withColumn("__copy", F.explode(F.expr("filter(sequence(1, 2), c -> c <= array_max(__times))")))
    words = F.regexp_extract_all(F.col("text"), F.lit(WORD), F.lit(0))
    first = F.expr(f"__start div {block}")

    def stays(_, i):
        return F.element_at("__times", (F.floor((F.col("__start") + i) / F.lit(block)) - first + 1).cast("int")) >= F.col("__copy")

    whole = F.array_min("__times") >= F.col("__copy")
    copies = copies.withColumn("__text", F.when(whole, F.col("text")).otherwise(F.array_join(F.filter(words, stays), " ")))
    out = []
    for n in names:
        if n == "text":
            out.append(F.col("__text").alias("text"))
        elif n == "n_chars":
            out.append(F.when(F.col("__text") == F.col("text"), F.col("n_chars")).otherwise(F.length("__text")).cast(docs.schema["n_chars"].dataType).alias("n_chars"))
        else:
            out.append(F.col(f"`{n}`"))
    return copies.select(*out)
