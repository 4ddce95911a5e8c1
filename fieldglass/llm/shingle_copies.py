"""Near copies of the corpus pipeline: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Candidates come from buckets of two kinds.  SimHashes of the five-word shingles are joined by the binary
trie of `simhash_trie`; texts of one of its components share a bucket.  At similarity 0.8 SimHashes
often differ in more bits than the trie allows, so a text's 100 MinHash values are dealt out as 20 bands
of five as well: a pair of similarity 0.8 shares none of them with probability (1 - 0.8^5)^20 = 0.04 %
(0.0008 % at 0.85).  A candidate's similarity is computed from the texts before it may link them.

First every text is compared with one hub, the least text of its buckets; hubs travel once per slice of
their members.  That settles large groups of copies with one comparison a member.  Buckets that are then
in several components are joined to clusters, each text goes to the task of its cluster, and an exact
similarity join runs there: shingles in rare-first order, only texts that share one of their rarest
shingles are compared, pruned by size, and texts that are connected already are not compared at all.
A task emits the edges of a forest, so at most one row per text.  Large clusters are dealt as pairs of
blocks, so that no task holds more than two blocks and no pair is left out.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldglass.llm.common import components, returning_memory, store
from fieldglass.llm.simhash_trie import fingerprints, near_components, only

SHINGLE, SIMILARITY = 5, 0.8
ROWS, BANDS = 5, 20
SLICES = 64  # parts of a hub's members
BLOCK_TEXTS, BLOCK_CHARS = 1_024, 16_000_000  # of a cluster that one block holds on average
_FACTORS = np.random.default_rng(20).integers(1 << 62, size=ROWS * BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SLICE = 4_096  # shingles hashed together; bounds memory


def shingles(text: bytes | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted 64-bit hashes of the runs of `size` lower-cased words; a shorter text is one run, a text without words has none."""
    words = (text or b"").lower().split()
    if len(words) <= size:
        runs = [b" ".join(words)] if words else []
    else:
        runs = map(b" ".join, zip(*(words[i:] for i in range(size))))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, runs), dtype=np.uint64))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of sorted sets, 0 if their sizes rule SIMILARITY out; two empty sets are equal."""
    small, large = sorted((len(a), len(b)))
    if small < SIMILARITY * large:
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (small + large - both) if large else 1.0


def bands(text: bytes | None) -> np.ndarray:
    """A hash of each band of minima over the text's shingles."""
    hashes = shingles(text)
    least = np.full(len(_FACTORS), np.iinfo(np.uint64).max)
    for start in range(0, len(hashes), _SLICE):
        least = np.minimum(least, (hashes[start:start + _SLICE, None] * _FACTORS).min(axis=0))
    dealt = [xxhash.xxh64_intdigest(least[i * ROWS:(i + 1) * ROWS].tobytes(), i) for i in range(BANDS)]
    return np.array(dealt, dtype=np.uint64).view(np.int64)


def _banded(texts: DataFrame) -> DataFrame:
    """(node, bucket) of each band of each text."""

    def run(batches):
        for batch in batches:
            dealt = [bands(t.as_py()) for t in batch.column(1).cast(pa.large_binary())]
            node = np.repeat(batch.column(0).to_numpy(), BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(np.concatenate(dealt) if dealt else node)], ["node", "bucket"])

    return texts.select("node", "text").mapInArrow(returning_memory(run), "node long, bucket long")


def _shared(dealt: DataFrame) -> DataFrame:
    """(bucket, node, least): the members of buckets with more than one text."""
    many = dealt.groupBy("bucket").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least < most").drop("most")
    return dealt.join(many, "bucket")


def _hub_links(members: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b) of the texts that are near copies of their hub, the least text of all their buckets."""
    hubs = members.groupBy("node").agg(F.min("least").alias("hub")).where("hub < node").withColumn("part", F.pmod("node", F.lit(SLICES)))
    rows = hubs.join(texts, "node").select("hub", "part", "node", "text")
    copies = hubs.select("hub", "part").distinct().join(texts.select(F.col("node").alias("hub"), "text"), "hub")
    rows = rows.unionByName(copies.select("hub", "part", F.col("hub").alias("node"), "text"))

    def run(batches):
        known, own = None, None
        for batch in batches:
            a, b = [], []
            keys, nodes = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())), batch.column(2).to_pylist()
            texts = batch.column(3).cast(pa.large_binary())
            for key, node, text in zip(keys, nodes, texts):
                found = shingles(text.as_py())
                if key != known:  # the hub has the least node of its rows
                    known, own = key, found
                elif similarity(own, found) >= SIMILARITY:
                    a.append(node)
                    b.append(key[0])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    dealt = rows.repartition("hub", "part").sortWithinPartitions("hub", "part", "node")
    return dealt.mapInArrow(returning_memory(run), "a long, b long")


def forest(sets: list[np.ndarray], roots: list[int], blocks: list[int] | None = None) -> list[tuple[int, int]]:
    """Index pairs of near copies that join different roots: enough of them to connect all that are connected.

    An exact join: a set's shingles are ordered from rare to frequent; sets at SIMILARITY share one of the
    first n - ceil(SIMILARITY n) + 1.  With `blocks` only pairs between different blocks are compared
    (all pairs, if there is only one).  Empty sets are copies of each other.
    """
    parent = {r: r for r in roots}

    def find(r):
        while parent[r] != r:
            parent[r] = parent[parent[r]]
            r = parent[r]
        return r

    between = blocks is not None and len(set(blocks)) > 1
    edges = []

    def link(i, j):
        edges.append((i, j))
        parent[find(roots[i])] = find(roots[j])

    empty = [i for i, s in enumerate(sets) if not len(s)]
    for i in empty[1:]:
        if find(roots[i]) != find(roots[empty[0]]):
            link(i, empty[0])
    sizes = np.array([len(s) for s in sets])
    if not sizes.any():
        return edges
    _, place, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.lexsort((place, seen[place], owner))
    place, owner = place[order], owner[order]
    rank = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    keep = sizes - np.ceil(SIMILARITY * sizes - 1e-9).astype(int) + 1
    first = (rank < keep[owner]) & (seen[place] > 1)
    place, owner = place[first], owner[first]
    order = np.lexsort((owner, place))
    place, owner = place[order], owner[order]
    edge = np.flatnonzero(np.r_[True, place[1:] != place[:-1]]) if len(place) else []
    tried = set()
    for low, high in zip(edge, [*edge[1:], len(place)]):
        groups: dict[int, list[int]] = {}
        for i in owner[low:high].tolist():
            groups.setdefault(find(roots[i]), []).append(i)
        if len(groups) < 2:
            continue
        # Each group meets the members of the groups before it.
        earlier: list[int] = []
        for group in groups.values():
            for i in group:
                for j in earlier:
                    pair = (i, j) if i < j else (j, i)
                    if pair in tried or between and blocks[i] == blocks[j] or find(roots[i]) == find(roots[j]):
                        continue
                    tried.add(pair)
                    if similarity(sets[i], sets[j]) >= SIMILARITY:
                        link(i, j)
            earlier += group
    return edges


def _cluster_links(rows: DataFrame) -> DataFrame:
    """(a, b): forests of the tasks of (cluster, low, high, node, root, block, text)."""

    def found(waiting):
        sets = [shingles(w[3]) for w in waiting]
        return [(waiting[i][0], waiting[j][0]) for i, j in forest(sets, [w[1] for w in waiting], [w[2] for w in waiting])]

    def run(batches):
        known, waiting = None, []
        for batch in batches:
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(3))))
            values = zip(*(batch.column(i).to_pylist() for i in range(3, 6)), batch.column(6).cast(pa.large_binary()))
            edges = []
            for key, (node, root, block, text) in zip(keys, values):
                if key != known:
                    edges += found(waiting)
                    known, waiting = key, []
                waiting.append((node, root, block, text.as_py()))
            yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], pa.int64()) for k in (0, 1)], ["a", "b"])
        edges = found(waiting)
        yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], pa.int64()) for k in (0, 1)], ["a", "b"])

    keys = ["cluster", "low", "high"]
    dealt = rows.select(*keys, "node", "root", "block", "text").repartition(*keys).sortWithinPartitions(*keys, "node")
    return dealt.mapInArrow(returning_memory(run), "a long, b long")


def _with_roots(links: DataFrame, members: DataFrame) -> DataFrame:
    """`members` with the root of each node's component."""
    roots = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def copy_components(texts: DataFrame, buckets: DataFrame, block_texts: int = BLOCK_TEXTS) -> DataFrame:
    """(a, b) with b the least text that a is connected with; `texts` has (node, text), each once, `buckets` (node, bucket)."""
    members = store(_shared(buckets))
    needed = members.select("node").distinct()
    texts = store(texts.join(needed, "node"))
    linked = components(_hub_links(members, texts))
    placed = _with_roots(linked, members.select("bucket", "node"))
    apart = placed.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
    open_ = store(placed.join(apart.select("bucket"), "bucket", "left_semi"))
    least = open_.groupBy("bucket").agg(F.min("node").alias("b"))
    clusters = components(open_.join(least, "bucket").select(F.col("node").alias("a"), "b"))
    waiting = open_.select("node", "root").distinct().join(clusters.select(F.col("a").alias("node"), F.col("b").alias("cluster")), "node", "left")
    waiting = waiting.withColumn("cluster", F.coalesce("cluster", "node")).join(texts, "node")
    waiting = store(waiting)
    sizes = waiting.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text").cast("long")).alias("chars"))
    parts = F.greatest(F.ceil(F.col("n") / block_texts), F.ceil(F.col("chars") / BLOCK_CHARS), F.lit(1)).cast("int")
    dealt = waiting.join(sizes.select("cluster", parts.alias("parts")), "cluster").withColumn("block", F.pmod(F.xxhash64("node"), "parts").cast("int"))
    # One block alone is compared within itself by the task (block, block); two blocks by (lesser, greater).
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})
    more = _cluster_links(dealt)
    return components(linked.unionByName(more))


def keep_one(docs: DataFrame, block_texts: int = BLOCK_TEXTS) -> DataFrame:
    """The documents of which one per group of near copies stays: the one of smallest doc_id.

    Groups are the components of links between texts of similarity 0.8 or more.  All columns are kept.
    A null text counts as empty; texts without words are copies of each other.  Of rows that repeat
    the kept doc_id and text one stays; null ids come last.  An empty table stays empty.
    """
    text = F.col("text").cast("string")
    rows = docs.select(F.xxhash64(text).alias("node"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id"))
    own = store(rows.groupBy("node").agg(first.alias("first")))
    # Equal texts are handled once: of each, the row of the kept id.
    named = own.select("first.absent", "first.doc_id", F.col("node").alias("text_hash"))
    texts = store(only(docs.select("doc_id", text.alias("text")), named).select(F.xxhash64("text").alias("node"), "text"))
    prints = store(fingerprints(texts.select(F.col("node").alias("doc_id"), "text"), SHINGLE).select(F.col("doc_id").alias("node"), "fp"))
    tried = near_components(prints)
    tried = tried.unionByName(tried.select(F.col("root").alias("fp"), "root").distinct())
    # Texts of one fingerprint share a bucket as well, whether or not it links to others.
    by_print = prints.join(tried, "fp", "left").select("node", F.xxhash64(F.lit("trie"), F.coalesce("root", "fp")).alias("bucket"))
    linked = copy_components(texts, _banded(texts).unionByName(by_print), block_texts)
    placed = _with_roots(linked, own)
    best = placed.groupBy("root").agg(F.min(F.struct("first.absent", "first.doc_id", F.col("node").alias("text_hash"))).alias("first"))
    return only(docs, best.select("first.absent", "first.doc_id", "first.text_hash"))
