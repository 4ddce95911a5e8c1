"""SimHash near-duplicates by a binary trie joined with itself.

Fingerprints are 64-bit SimHashes of word shingles.  Two of them link when they differ in at most
`budget` bits.  Distinct fingerprints are dealt out by 16-bit blocks: a pair within three bits has at
least one of four blocks in common, so each fingerprint goes to four buckets (pigeonhole, no loss).
Inside a bucket the trie is traversed as pairs of nodes that start from (root, root); the bits in
which the two paths differ are accumulated and a pair of nodes is dropped as soon as they exceed the
budget.  A bucket emits a star per connected group, never all its pairs.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldglass.llm.common import components, returning_memory, store

_LEAF = 64  # pairs of rows that a pair of nodes may hold to be compared at once
_CHUNK = 32_768  # pairs of nodes handled together; bounds memory
_HASH_SLICE = 65_536


def fingerprint(text: bytes | None, shingle: int = 3, seed: int = 42) -> int:
    """SimHash of one text: a bit is set if it is set in over half of the shingles' XXH64."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(seed)), dtype=np.uint64)
    ones = np.zeros(64, dtype=np.int64)
    for start in range(0, len(hashes), _HASH_SLICE):
        part = hashes[start:start + _HASH_SLICE].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, text_hash, fp) per row; fp is the fingerprint as a signed long."""

    def run(batches):
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            prints = np.fromiter((fingerprint(t.as_py(), shingle, seed) for t in texts), dtype=np.int64, count=len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(prints)], ["doc_id", "text_hash", "fp"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"))
    return rows.mapInArrow(returning_memory(run), "doc_id long, text_hash long, fp long")


def _join_leaves(label, prints, left, right, budget):
    """Compare all rows under pairs of small nodes; hook the labels of rows that link."""
    wide = right[1] - right[0]
    count = (left[1] - left[0]) * wide
    pair = np.repeat(np.arange(len(count)), count)
    step = np.arange(len(pair)) - np.repeat(np.cumsum(count) - count, count)
    i, j = left[0][pair] + step // wide[pair], right[0][pair] + step % wide[pair]
    near = (i < j) & (np.bitwise_count(prints[i] ^ prints[j]) <= budget)
    i, j = i[near], j[near]
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


def linked_groups(bucket: np.ndarray, prints: np.ndarray, budget: int = 3) -> np.ndarray:
    """Index of the first row of each row's connected group.  Rows are sorted by (bucket, print)."""
    n = len(prints)
    label = np.arange(n)
    edge = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    low, high = edge, np.r_[edge[1:], n]
    many = high - low > 1
    low, high = low[many], high[many]
    ones: dict[int, np.ndarray] = {}
    stack = [(0, low, high, low, high, np.zeros(len(low), dtype=np.int8))] if len(low) else []
    while stack:
        depth, alo, ahi, blo, bhi, spent = stack.pop()
        if len(alo) > _CHUNK:
            half = len(alo) // 2
            for cut in (slice(half, None), slice(0, half)):
                stack.append((depth, alo[cut], ahi[cut], blo[cut], bhi[cut], spent[cut]))
            continue
        small = (ahi - alo) * (bhi - blo) <= _LEAF
        if small.any():
            _join_leaves(label, prints, (alo[small], ahi[small]), (blo[small], bhi[small]), budget)
        rest = ~small
        if not rest.any():
            continue
        alo, ahi, blo, bhi, spent = alo[rest], ahi[rest], blo[rest], bhi[rest], spent[rest]
        if depth not in ones:
            bit = (prints >> np.uint64(63 - depth)) & np.uint64(1)
            ones[depth] = np.r_[0, np.cumsum(bit, dtype=np.int64)]
        total = ones[depth]
        amid, bmid = ahi - (total[ahi] - total[alo]), bhi - (total[bhi] - total[blo])
        same = (alo == blo) & (ahi == bhi)
        zero, one = (alo, amid), (amid, ahi)
        bzero, bone = (blo, bmid), (bmid, bhi)
        grown = []
        for (x, y), extra, keep in (((zero, bzero), 0, None), ((one, bone), 0, None), ((zero, bone), 1, None), ((one, bzero), 1, ~same)):
            cost = spent + extra
            alive = (x[1] > x[0]) & (y[1] > y[0]) & (cost <= budget)
            if keep is not None:
                alive &= keep
            grown.append((x[0][alive], x[1][alive], y[0][alive], y[1][alive], cost[alive]))
        stack.append((depth + 1, *(np.concatenate(parts) for parts in zip(*grown))))
    return label


def _block_stars(frames, budget):
    """Stars of linked groups, bucket by bucket; only unfinished buckets wait in memory."""

    def stars(rows):
        unsigned = rows["fp"].to_numpy(dtype=np.int64).view(np.uint64)
        bucket = rows["bucket"].to_numpy(dtype=np.int64)
        order = np.lexsort((unsigned, bucket))
        bucket, unsigned = bucket[order], unsigned[order]
        label = linked_groups(bucket, unsigned, budget)
        other = label != np.arange(len(label))
        return pd.DataFrame({"a": unsigned[other].view(np.int64), "b": unsigned[label[other]].view(np.int64)})

    waiting: list[pd.DataFrame] = []
    held = 0
    for frame in frames:
        waiting.append(frame)
        held += len(frame)
        if held < 100_000:
            continue
        rows = pd.concat(waiting, ignore_index=True)
        done = rows["bucket"] != rows["bucket"].iloc[-1]
        if done.any():
            yield stars(rows[done])
        waiting = [rows[~done]]
        held = len(waiting[0])
    if held:
        yield stars(pd.concat(waiting, ignore_index=True))


def near_components(prints: DataFrame, budget: int = 3, bucket_limit: int = 262_144) -> DataFrame:
    """(fp, root) for each distinct fingerprint that links to a smaller one of its component.

    `bucket_limit`: a block value shared by more distinct fingerprints is dealt out once more by four
    12-bit pieces of its other 48 bits, of which a pair within three bits shares one as well.
    """
    if not 0 <= budget <= 3:
        raise ValueError("four blocks find pairs of up to three differing bits")
    distinct = prints.select("fp").distinct()
    block = F.explode(F.array(*[F.lit(i) for i in range(4)])).alias("block")
    dealt = distinct.select("fp", block).select(
        "fp", "block", F.expr("shiftrightunsigned(fp, 16 * block) & 65535").alias("value")
    )
    hot = dealt.groupBy("block", "value").count().where(F.col("count") > bucket_limit).select("block", "value", F.lit(True).alias("hot"))
    # The other 48 bits in one number: those above the block move down by its width.
    rest = F.expr("(shiftrightunsigned(fp, 16 * block + 16) << (16 * block)) | (fp & ((1L << (16 * block)) - 1))")
    rest = F.when(F.col("block") == 3, F.expr("fp & ((1L << 48) - 1)")).otherwise(rest)
    pieces = F.when(F.col("hot"), F.expr("transform(sequence(0, 3), i -> (i + 1L) * 4096 + (shiftrightunsigned(rest, 12 * i) & 4095))")).otherwise(F.array(F.lit(0).cast("long")))
    keyed = dealt.join(hot, ["block", "value"], "left").withColumn("rest", rest)
    keyed = keyed.select("fp", ((F.col("block") * 65536 + F.col("value")) * 32768).cast("long").alias("base"), F.explode(pieces).alias("piece"))
    keyed = keyed.select("fp", (F.col("base") + F.col("piece")).alias("bucket"))
    keyed = keyed.repartition("bucket").sortWithinPartitions("bucket")
    edges = keyed.mapInPandas(lambda frames: _block_stars(frames, budget), "a long, b long")
    return components(edges).select(F.col("a").alias("fp"), F.col("b").alias("root"))


def _decided(rows: DataFrame, budget: int) -> DataFrame:
    """Per distinct fingerprint: fp, first (absent, doc_id, text_hash) of its component, group_docs."""
    # Structs order nulls first, so the null flag leads.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "text_hash"))
    own = store(rows.groupBy("fp").agg(first.alias("first"), F.count(F.lit(1)).alias("n")))
    members = near_components(own, budget)
    members = members.unionByName(members.select(F.col("root").alias("fp"), "root").distinct())
    groups = own.join(members, "fp").groupBy("root").agg(F.min("first").alias("group_first"), F.sum("n").alias("group_n"))
    return own.join(members.join(groups, "root").drop("root"), "fp", "left").select(
        "fp", F.coalesce("group_first", "first").alias("first"), F.coalesce("group_n", "n").alias("group_docs")
    )


def near_duplicates(docs: DataFrame, shingle: int = 3, budget: int = 3) -> DataFrame:
    """One row per input row: doc_id, text_hash, fp, component_id, keeper_hash, group_docs.

    component_id is the smallest doc_id that the row's fingerprint reaches, itself included; keeper_hash
    is the text hash of that document.  A null text counts as empty, an empty text has fingerprint zero
    and links like any other.  Rows with a null doc_id take part; they become component_id only if
    their whole component has no id (then null).  Repeated rows share their component.  Extra columns
    are ignored.  An empty table gives an empty result.
    """
    rows = store(fingerprints(docs, shingle))
    return rows.join(_decided(rows, budget), "fp").select(
        "doc_id", "text_hash", "fp", F.col("first.doc_id").alias("component_id"), F.col("first.text_hash").alias("keeper_hash"), "group_docs"
    )


def keep_one(docs: DataFrame, shingle: int = 3, budget: int = 3) -> DataFrame:
    """The documents of which one per near-duplicate component stays: the one of smallest doc_id.

    All columns are kept.  Of rows that repeat the kept doc_id and text one stays.
    """
    first = _decided(store(fingerprints(docs, shingle)), budget).select("first.absent", "first.doc_id", "first.text_hash").distinct()
    return only(docs, first)


def only(docs: DataFrame, first: DataFrame) -> DataFrame:
    """The documents named in `first` (absent, doc_id, text_hash); of rows that repeat id and text one stays."""
    names = docs.columns
    # Never-null keys, so that dropping repeats can use the partitioning of the join.
    absent, present = F.col("doc_id").isNull(), F.coalesce(F.col("doc_id").cast("long"), F.lit(0))
    keepers = first.select(present.alias("__id"), F.col("absent").alias("__absent"), F.col("text_hash").alias("__hash"))
    keys = ["__id", "__absent", "__hash"]
    marked = docs.withColumns({"__id": present, "__absent": absent, "__hash": F.xxhash64(F.col("text").cast("string"))})
    return marked.join(keepers, keys, "left_semi").dropDuplicates(keys).select(*[f"`{n}`" for n in names])
