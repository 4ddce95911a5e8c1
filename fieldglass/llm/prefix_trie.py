"""A trie of conversation prefixes by vertical bitmaps.

Conversations are dealt out in shards of 256 consecutive ids and stretches of 64 depths.  A shard keeps
one bitset of its conversations per (position, turn).  The traversal goes down depth first: a node's
bitset and the posting of a turn one position further give a child's members, its count, and the list
of those that end there.  Nodes are known across shards and stretches by the exclusive or of the 64-bit
hashes of (depth, turn) along their path, taken twice, so no task walks a whole conversation.

Counts of leaves, children and saved tokens below a node are sums over its members.  The least member of
a node owns it; a conversation owns the nodes from some depth on down to its end.  Once owners are known
from all shards, each shard adds up what its members own below each of its nodes, and one aggregation
adds the shards.  No step follows the depth of the trie.
"""

from __future__ import annotations

import hashlib
from itertools import accumulate
from operator import or_

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldglass.llm.common import WORD, store
from fieldglass.operators.ordered import running_sums

BITS, STRETCH = 8, 64  # conversations of a shard: 2^BITS consecutive ids
FAMILY, HEADS = 20, 4
_CHUNK = 4096  # turns of a conversation that are joined to its row together
_NODE = "k1 long, k2 long, p1 long, p2 long, depth int, before long, own long, least long, members binary, ends binary, n long, n_ends long"
_SUMS = "k1 long, k2 long, depth int, conv_id long, parent long, n_convs long, n_children long, n_leaves long, saved long"


def numbered_turns(turns: DataFrame) -> DataFrame:
    """(conv, p, t1, t2, words) per turn: its place from 1, two hashes of (role, text), words of the text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = turns.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), F.xxhash64(role, text).alias("t1"),
        F.xxhash64(F.lit(11), text, role).alias("t2"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
    )
    rows = store(rows)
    # Nulls come first and must be split like any other repeated value.
    axis = F.coalesce(F.col("turn").cast("double"), F.lit(-1e19))
    order = [F.col("turn").asc_nulls_first(), F.col("t1"), F.col("t2")]
    return running_sums(rows, ["conv"], axis, order, {"p": F.lit(1).cast("long")}, F.col("t1").cast("double"))


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rebuilt conversations: (conv, length) and their turns (conv, length, d, t1, t2, words), depth 0 included."""
    rows = store(numbered_turns(turns))
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % HEADS).cast("int")
    base = F.col("conv") - F.col("conv") % FAMILY
    # A head has at most HEADS - 1 turns and is shared by the conversations of one family.
    heads = rows.where((F.col("conv") % FAMILY == 0) & (F.col("p") < HEADS))
    heads = heads.groupBy(F.col("conv").alias("base")).agg(F.sort_array(F.collect_list(F.struct("p", "t1", "t2", "words"))).alias("head"))
    convs = rows.groupBy("conv").agg(F.count(F.lit(1)).alias("n")).withColumn("h", h).withColumn("base", base).join(heads, "base", "left")
    convs = convs.withColumn("lead", F.least("h", F.coalesce(F.size("head"), F.lit(0))))
    convs = store(convs.select("conv", "n", "h", "lead", "head", (F.col("lead") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).cast("int").alias("length")))
    first = convs.select("conv", "length", F.explode(F.slice("head", F.lit(1), F.col("lead"))).alias("t"))
    first = first.select("conv", "length", F.col("t.p").cast("int").alias("d"), "t.t1", "t.t2", "t.words")
    top = convs.select("conv", "length", F.lit(0).alias("d"), F.lit(0).cast("long").alias("t1"), F.lit(0).cast("long").alias("t2"), F.lit(0).cast("long").alias("words"))
    # A long conversation's turns meet copies of its row chunk by chunk.
    lengths = convs.select("conv", "length", "h", "lead", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"n div {_CHUNK}"))).alias("chunk"))
    own = rows.where(F.col("p") > h).withColumn("chunk", F.expr(f"p div {_CHUNK}")).join(lengths, ["conv", "chunk"])
    own = own.select("conv", "length", (F.col("p") + F.col("lead") - F.col("h")).cast("int").alias("d"), "t1", "t2", "words")
    return convs.select("conv", "length"), top.unionByName(first).unionByName(own)


def _bytes(bits: int) -> bytes:
    return bits.to_bytes((bits.bit_length() + 7) // 8, "little")


def _members(bits: int):
    while bits:
        low = bits & -bits
        yield low.bit_length() - 1
        bits ^= low


def trie_nodes(conv: list, d: list, z: list, words: list, length: list, start: list, origin: int) -> list[tuple]:
    """Nodes of one shard and stretch, as in _NODE, by depth-first intersection of vertical bitmaps.

    The lists hold one row per conversation and depth: its hashes of (depth, turn), the words of the
    turn, the conversation's length, and the key and words of its path before the stretch.
    """
    postings: dict[int, dict[tuple, int]] = {}
    turn_of: dict[int, dict[int, tuple]] = {}
    there: dict[int, int] = {}
    last: dict[int, int] = {}
    own_words: dict[tuple, int] = {}
    roots: dict[tuple, int] = {}
    begin = min(d)
    for c, at, turn, w, n, path in zip(conv, d, z, words, length, start):
        bit = 1 << (c - origin)
        level = postings.setdefault(at, {})
        level[turn] = level.get(turn, 0) | bit
        turn_of.setdefault(at, {})[c - origin] = turn
        there[at] = there.get(at, 0) | bit
        own_words[at, turn] = w
        if n == at:
            last[at] = last.get(at, 0) | bit
        if at == begin:
            roots[path] = roots.get(path, 0) | bit
    out = []
    stack = [(begin, bits, k1, k2, before) for (k1, k2, before), bits in roots.items()]
    while stack:
        at, bits, k1, k2, before = stack.pop()
        left = bits & there.get(at, 0)
        while left:
            lowest = (left & -left).bit_length() - 1
            turn = turn_of[at][lowest]
            child = bits & postings[at][turn]
            left &= ~child
            w, ends = own_words[at, turn], child & last.get(at, 0)
            node = (k1 ^ turn[0], k2 ^ turn[1])
            out.append((*node, k1, k2, at, before, w, origin + lowest, _bytes(child), _bytes(ends), child.bit_count(), ends.bit_count()))
            if child != ends:
                stack.append((at + 1, child, *node, before + w))
    return out


def member_sums(nodes: list[tuple], owners: list[tuple], origin: int) -> list[tuple]:
    """What the members of one shard add to each of its nodes, as in _SUMS.

    `nodes` are (k1, k2, depth, before, members, ends); `owners` (conv, from, shared, leaf, parent) tell
    from which depth a conversation owns its nodes, the words of its path above that depth, if its end is
    a leaf, and the owner of the node above its topmost own one.
    """
    by_bit = {conv - origin: (start, shared, parent) for conv, start, shared, _, parent in owners}
    leaves = sum(1 << (conv - origin) for conv, _, _, leaf, _ in owners if leaf)
    begin = min((n[2] for n in nodes), default=0)
    starts = [0] * (STRETCH + 2)  # bits of the conversations that begin to own at each depth of the stretch
    for bit, (start, _, _) in by_bit.items():
        starts[min(max(start - begin, 0), STRETCH + 1)] |= 1 << bit
    owned = list(accumulate(starts[:-1], or_))
    out = []
    for k1, k2, depth, before, members, ends in nodes:
        members, ends = int.from_bytes(members, "little"), int.from_bytes(ends, "little")
        mine = members & owned[depth - begin]
        conv = parent = None
        if mine:
            bit = mine.bit_length() - 1
            start, _, above = by_bit[bit]
            conv, parent = origin + bit, above if start == depth else origin + bit
        shared = members & ~mine
        saved = sum(by_bit[bit][1] for bit in _members(shared)) - shared.bit_count() * before
        children = (members & ~ends & owned[depth - begin + 1]).bit_count()
        out.append((k1, k2, depth, conv, parent if depth else None, members.bit_count(), children, (members & leaves).bit_count(), saved))
    return out


def _table(rows: list[tuple], ddl: str) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [part.split() for part in ddl.split(", ")]
    columns = zip(*rows) if rows else [[] for _ in fields]
    return pa.table([pa.array(list(c), kinds[kind]) for c, (_, kind) in zip(columns, fields)], [name for name, _ in fields])


def _shard_nodes(part: pa.Table) -> pa.Table:
    cols = part.to_pydict()
    origin = cols["shard"][0] << BITS
    z = list(zip(cols["z1"], cols["z2"]))
    start = list(zip(cols["s1"], cols["s2"], cols["w0"]))
    found = _table(trie_nodes(cols["conv"], cols["d"], z, cols["words"], cols["length"], start, origin), _NODE)
    for name in ("stretch", "shard"):
        found = found.add_column(0, name, pa.array([cols[name][0]] * len(found), pa.int64()))
    return found


def _shard_sums(nodes: pa.Table, owners: pa.Table) -> pa.Table:
    if not len(nodes):
        return _table([], _SUMS)
    left = list(zip(*(nodes.column(c).to_pylist() for c in ("k1", "k2", "depth", "before", "members", "ends"))))
    right = list(zip(*(owners.column(c).to_pylist() for c in ("conv", "from", "shared", "leaf", "parent"))))
    return _table(member_sums(left, right, nodes.column("shard")[0].as_py() << BITS), _SUMS)


def _end_digests(batches):
    """SHA-256 of each node's decimal ids; rows come sorted by node and shard, the digest runs on over shards."""
    known, digest = None, None

    def row(key, digest):
        return pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]]), pa.array([digest.hexdigest()])], ["k1", "k2", "ends_sha256"])

    for batch in batches:
        done = []
        for k1, k2, shard, ends in zip(*(batch.column(i).to_pylist() for i in range(4))):
            ids = ",".join(str((shard << BITS) + bit) for bit in _members(int.from_bytes(ends, "little")))
            if (k1, k2) == known:
                digest.update(b"," + ids.encode())
                continue
            if known is not None:
                done.append((*known, digest.hexdigest()))
            known, digest = (k1, k2), hashlib.sha256(ids.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*done)], ["k1", "k2", "ends_sha256"])
    if known is not None:
        yield row(known, digest)


def trie(turns: DataFrame) -> DataFrame:
    """Per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns are ordered by turn, nulls first, equal turns by the hash of (role, text); null roles and texts
    are empty.  Rows with a null conv_id belong to no conversation.  Repeated rows are turns of their
    own.  Other columns are ignored.  A table without conversations gives no rows, not even a root.
    Prefixes are told apart by 128 bits of hashes.
    """
    convs, rows = rebuilt(turns)
    z1 = F.when(F.col("d") > 0, F.xxhash64("d", "t1", "t2")).otherwise(F.lit(0)).alias("z1")
    z2 = F.when(F.col("d") > 0, F.xxhash64(F.lit(12), "t2", "d", "t1")).otherwise(F.lit(0)).alias("z2")
    shard = F.shiftright("conv", BITS).alias("shard")
    rows = store(rows.select("conv", "length", "d", z1, z2, "words", shard, F.expr(f"cast(d div {STRETCH} AS long)").alias("stretch")))
    spans = rows.groupBy("conv", "stretch").agg(F.bit_xor("z1").alias("s1"), F.bit_xor("z2").alias("s2"), F.sum("words").alias("w"))
    spans = store(spans)
    earlier = Window.partitionBy("conv").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    carried = spans.select("conv", "stretch", *[f(c).over(earlier).alias(n) for f, c, n in ((F.bit_xor, "s1", "s1"), (F.bit_xor, "s2", "s2"), (F.sum, "w", "w0"))])
    long = rows.where(F.col("stretch") > 0).join(carried.where(F.col("stretch") > 0), ["conv", "stretch"])
    short = rows.where(F.col("stretch") == 0).select("*", *[F.lit(0).cast("long").alias(n) for n in ("s1", "s2", "w0")])
    nodes = short.unionByName(long).groupBy("shard", "stretch").applyInArrow(_shard_nodes, f"shard long, stretch long, {_NODE}")
    nodes = store(nodes)

    merged = nodes.groupBy("k1", "k2").agg(
        F.min("least").alias("owner"), F.first("depth").alias("depth"), F.first("before").alias("before"), F.first("p1").alias("p1"),
        F.first("p2").alias("p2"), (F.sum("n") == F.sum("n_ends")).alias("leaf"),
    )
    merged = store(merged)
    least = lambda c: F.min_by(c, "depth").alias(c)
    owners = merged.groupBy("owner").agg(F.min("depth").alias("from"), least("before"), least("p1"), least("p2"), F.max("leaf").alias("leaf"))
    above = merged.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("owner").alias("parent"))
    owners = owners.join(above, ["p1", "p2"], "left").select(F.col("owner").alias("conv"), "from", F.col("before").alias("shared"), "leaf", "parent")
    totals = spans.groupBy("conv").agg(F.sum("w").alias("total"))
    owners = convs.join(totals, "conv").join(owners, "conv", "left").select(
        "conv", F.coalesce("from", F.col("length") + 1).alias("from"), F.coalesce("shared", "total").alias("shared"),
        F.coalesce("leaf", F.lit(False)).alias("leaf"), "parent", shard,
        F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"length div {STRETCH}"))).alias("stretch"),
    )
    keys = ["shard", "stretch"]
    sums = nodes.groupBy(*keys).cogroup(owners.groupBy(*keys)).applyInArrow(_shard_sums, _SUMS)
    total = lambda c, name=None: F.sum(c).alias(name or c)
    result = sums.groupBy("k1", "k2").agg(
        F.max("conv_id").alias("conv_id"), F.max("depth").cast("long").alias("depth"), F.max("parent").alias("parent_conv_id"), total("n_convs"),
        total("n_children"), total("n_leaves"), total("saved", "saved_tokens"),
    )
    ends = nodes.where(F.col("n_ends") > 0).select("k1", "k2", "shard", "ends").repartition("k1", "k2").sortWithinPartitions("k1", "k2", "shard")
    ends = ends.mapInArrow(_end_digests, "k1 long, k2 long, ends_sha256 string")
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return result.join(ends, ["k1", "k2"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", none)).drop("k1", "k2")


# The query's rows in DuckDB; CRC-32 is spelled out bit by bit.
ORACLE_SQL = """
WITH t AS (
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS p,
           coalesce(role, '') AS role, coalesce(text, '') AS text
    FROM conversations WHERE conv_id IS NOT NULL
),
c AS (
    SELECT conv_id, count(*) AS n, conv_id - conv_id % 20 AS base, xor(list_reduce(
        list_transform(range(1, length(conv_id::VARCHAR) + 1), lambda i: ascii(substr(conv_id::VARCHAR, i, 1))::BIGINT),
        lambda a, b: list_reduce(range(8), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)), xor(a, b)),
        4294967295::BIGINT), 4294967295::BIGINT) % 4 AS h
    FROM t GROUP BY conv_id
),
turns AS (
    SELECT c.conv_id, t.p AS d, t.role, t.text FROM c JOIN t ON t.conv_id = c.base AND t.p <= c.h
    UNION ALL
    SELECT c.conv_id, least(c.h, coalesce(b.n, 0)) + t.p - c.h, t.role, t.text
    FROM c JOIN t ON t.conv_id = c.conv_id AND t.p > c.h LEFT JOIN c b ON b.conv_id = c.base
),
paths AS (
    SELECT conv_id, d, string_agg(md5(role) || md5(text), '') OVER (PARTITION BY conv_id ORDER BY d) AS path,
           len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS words, max(d) OVER (PARTITION BY conv_id) = d AS ends
    FROM turns
    UNION ALL
    SELECT conv_id, 0, '', 0, conv_id NOT IN (SELECT conv_id FROM turns) FROM c
),
nodes AS (
    SELECT path, min(conv_id) AS conv_id, min(d) AS depth, count(*) AS n_convs, (count(*) - 1) * max(words) AS saved,
           sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
    FROM paths GROUP BY path
),
links AS (SELECT path[:length(path) - 64] AS above, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
below AS (
    SELECT above, sum(saved) AS saved_tokens, sum(leaf) AS n_leaves FROM (
        SELECT unnest(list_transform(range(depth + 1), lambda j: left(nodes.path, (64 * j)::BIGINT))) AS above, saved, (links.n IS NULL)::INT AS leaf
        FROM nodes LEFT JOIN links ON links.above = nodes.path
    ) GROUP BY above
)
SELECT nodes.conv_id, nodes.depth::BIGINT AS depth, up.conv_id AS parent_conv_id, nodes.n_convs, coalesce(links.n, 0)::BIGINT AS n_children,
       below.n_leaves::BIGINT AS n_leaves, below.saved_tokens::BIGINT AS saved_tokens, nodes.ends_sha256
FROM nodes JOIN below ON below.above = nodes.path LEFT JOIN links ON links.above = nodes.path
LEFT JOIN nodes up ON nodes.depth > 0 AND up.path = nodes.path[:length(nodes.path) - 64]
"""
