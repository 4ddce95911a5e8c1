"""Approximate nearest neighbours by an inverted multi-index.

Vectors are cut into two halves that are quantised separately; an entry lives in the cell of its two
nearest half-centroids.  A query walks centroid pairs in order of summed distance with a heap until
the cells passed hold enough entries, and these are reranked by exact inner products.  Largest inner
product is nearest neighbour once a component makes all entries equally long (it joins the second
half; queries have zero there).

How many entries are enough is measured: for a bounded sample of queries the true neighbours are
found by brute force and the walk is made long enough to reach `recall` of them.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldglass.llm.common import store

FIT_ROWS = 16_384  # vectors that centroids are fitted on, at most
PROBE_QUERIES = 64  # queries that the length of the walk is measured on, at most
BLOCK = 8192  # entries, and queries, that one task compares at most (twice as many entries of one salt)
SPREAD = 24  # groups of entries that small inputs are dealt into


def usable(vectors: DataFrame, name: str = "embedding") -> DataFrame:
    """(vec_id, v): vectors with finite components, not all zero, of the commonest length."""
    v = F.col(name).cast("array<double>")
    whole = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & whole & F.exists(v, lambda x: x != 0))
    rows = store(rows)
    common = rows.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), "size").first()
    return rows.where(F.size("v") == (common["size"] if common else 0))


def _matrix(column) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.zeros((0, 1))


def _halves(rows: np.ndarray, top: float, query: bool = False) -> tuple[np.ndarray, np.ndarray]:
    cut = rows.shape[1] // 2
    extra = np.zeros(len(rows)) if query else np.sqrt(np.maximum(top - (rows ** 2).sum(axis=1), 0))
    return rows[:, :cut], np.c_[rows[:, cut:], extra]


def _distances(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((rows ** 2).sum(axis=1)[:, None] - 2 * rows @ centres.T + (centres ** 2).sum(axis=1), 0)


def centroids(rows: np.ndarray, count: int, seed: int, rounds: int = 8) -> np.ndarray:
    random = np.random.default_rng(seed)
    unique = np.unique(rows, axis=0)
    centres = unique[random.permutation(len(unique))[:count]].copy()
    for _ in range(rounds):
        near = _distances(rows, centres).argmin(axis=1)
        size = np.bincount(near, minlength=len(centres))
        for c in np.flatnonzero(size):
            centres[c] = rows[near == c].mean(axis=0)
    return centres


class Index:
    """Centroids of both halves and the number of entries per cell: bounded by `most`**2 numbers."""

    def __init__(self, left, right, top):
        self.left, self.right, self.top = left, right, top
        self.counts = np.zeros((len(left), len(right)), dtype=np.int64)

    def cell(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = _halves(rows, self.top)
        return _distances(a, self.left).argmin(axis=1), _distances(b, self.right).argmin(axis=1)

    def walk(self, query: np.ndarray):
        """Cells (first, second) in order of summed distance, with the entries up to and with each."""
        a, b = _halves(query[None, :], self.top, query=True)
        da, db = _distances(a, self.left)[0], _distances(b, self.right)[0]
        oa, ob = np.argsort(da, kind="stable"), np.argsort(db, kind="stable")
        sa, sb, la, lb = da[oa].tolist(), db[ob].tolist(), oa.tolist(), ob.tolist()
        # One candidate per row of the grid: (i, next j).  Row i+1 opens when row i is first taken.
        heap, total = [(sa[0] + sb[0], 0, 0)], 0
        while heap:
            _, i, j = heapq.heappop(heap)
            total += int(self.counts[la[i], lb[j]])
            yield la[i], lb[j], total
            if j == 0 and i + 1 < len(sa):
                heapq.heappush(heap, (sa[i + 1] + sb[0], i + 1, 0))
            if j + 1 < len(sb):
                heapq.heappush(heap, (sa[i] + sb[j + 1], i, j + 1))


def _top(queries: np.ndarray, ids: np.ndarray, entries: np.ndarray, entry_ids: np.ndarray, allowed, k: int) -> pd.DataFrame:
    """Each query's k best of the allowed entries, by exact product, ties to the smaller id."""
    out = []
    for start in range(0, len(queries), 512):
        part = slice(start, start + 512)
        near = queries[part] @ entries.T
        if allowed is not None:
            near[~allowed[part]] = -np.inf
        near[ids[part][:, None] == entry_ids[None, :]] = -np.inf
        take = min(k, near.shape[1])
        least = -np.partition(-near, take - 1, axis=1)[:, take - 1]
        for row, bound in enumerate(least):
            slack = 1e-9 * (1 + abs(bound)) if np.isfinite(bound) else 0
            found = np.flatnonzero((near[row] >= bound - slack) & np.isfinite(near[row]))
            score = (queries[start + row] * entries[found]).sum(axis=1)
            best = np.lexsort((entry_ids[found], -score))[:k]
            out.append(pd.DataFrame({"query_id": ids[start + row], "vec_id": entry_ids[found[best]], "score": score[best]}))
    return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})


_PAIRS = "query_id long, vec_id long, score double"


def _ranked(pairs: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def exact(queries_frame: pd.DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """The true neighbours of a bounded set of queries (vec_id, v), by brute force over all rows."""
    queries, ids = _matrix(queries_frame["v"]), queries_frame["vec_id"].to_numpy(dtype=np.int64)

    def run(frames):
        for frame in frames:
            if len(frame):
                yield _top(queries, ids, _matrix(frame["v"]), frame["vec_id"].to_numpy(dtype=np.int64), None, k)

    return _ranked(rows.mapInPandas(run, _PAIRS), k)


def build(rows: DataFrame, count: int, most: int = 1024, seed: int = 3) -> Index:
    """Centroids from at most FIT_ROWS vectors, then the entries of every cell counted over all rows."""
    sample = rows.orderBy(F.xxhash64("vec_id", F.lit(seed)), "vec_id").limit(FIT_ROWS).toPandas()
    data = _matrix(sample["v"])
    length = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    top = rows.agg(F.max(length)).first()[0]
    per_half = int(min(most, max(1, math.sqrt(count) / 4), len(data)))
    a, b = _halves(data, top)
    return Index(centroids(a, per_half, seed), centroids(b, per_half, seed + 1), top)


def search(vectors: DataFrame, k: int = 20, every: int = 20, name: str = "embedding", recall: float = 0.97, seed: int = 3) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row whose vec_id is divisible by `every`.

    Null, zero, null-holding and non-finite vectors take no part, nor do vectors of another length than
    the commonest; null ids neither.  A query never finds its own id.  Equal scores go to the smaller
    vec_id.  With fewer candidates than k all are returned.  No usable vectors give no rows.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, name)
    count = rows.count()
    if not count:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    index = build(rows, count, seed=seed)
    frozen = spark.sparkContext.broadcast(index)

    def assign(frames):
        for frame in frames:
            if len(frame):
                a, b = frozen.value.cell(_matrix(frame["v"]))
                yield pd.DataFrame({"vec_id": frame["vec_id"], "v": frame["v"], "a": a, "b": b})

    entries = store(rows.mapInPandas(assign, "vec_id long, v array<double>, a int, b int"))
    for a, b, n in entries.groupBy("a", "b").count().toPandas().itertuples(index=False):
        index.counts[a, b] = n
    queries = rows.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id"])
    probe = queries.orderBy(F.xxhash64("vec_id", F.lit(seed + 1)), "vec_id").limit(PROBE_QUERIES).toPandas()
    enough = _enough(index, probe, exact(probe, entries.select("vec_id", "v"), k), entries, recall) if len(probe) else 0
    # Rows of the cell grid, taken together until they hold a block of entries; larger ones are salted.
    by_row = index.counts.sum(axis=1)
    block = int(min(BLOCK, max(512, count // SPREAD)))
    group_of = (np.cumsum(by_row) - by_row) // block
    group_of = np.unique(group_of, return_inverse=True)[1]
    salts = np.maximum(1, -(-np.bincount(group_of, weights=by_row).astype(np.int64) // (2 * block)))
    query_blocks = max(1, math.ceil(queries.count() / BLOCK))
    shared = spark.sparkContext.broadcast((index, group_of, salts, enough))

    def walked(frames):
        index, group_of, salts, enough = shared.value
        members = [np.flatnonzero(group_of == g) for g in range(len(salts))]
        for frame in frames:
            for start in range(0, len(frame), 256):
                out = []
                for vec_id, v in frame.iloc[start:start + 256][["vec_id", "v"]].itertuples(index=False):
                    passed = np.zeros(index.counts.shape, dtype=bool)
                    for a, b, total in index.walk(np.asarray(v, dtype=np.float64)):
                        passed[a, b] = True
                        if total >= enough:
                            break
                    for g, rows_of in enumerate(members):
                        part = passed[rows_of]
                        if part.any():
                            mask = np.packbits(part).tobytes()
                            out += [(vec_id, v, g, s, mask) for s in range(salts[g])]
                if out:
                    yield pd.DataFrame(out, columns=["vec_id", "v", "grp", "salt", "mask"])

    asked = queries.repartition(spark.sparkContext.defaultParallelism).mapInPandas(walked, "vec_id long, v array<double>, grp int, salt int, mask binary")
    asked = asked.withColumn("part", F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(query_blocks)).cast("int"))
    groups = F.array(*[F.lit(int(g)) for g in group_of])
    widths = F.array(*[F.lit(int(s)) for s in salts])
    dealt = entries.withColumn("grp", F.get(groups, F.col("a")))
    dealt = dealt.withColumn("salt", F.pmod(F.xxhash64("vec_id", F.lit(seed + 2)), F.get(widths, F.col("grp"))).cast("int"))
    dealt = dealt.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))

    def rerank(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        index, group_of, _, _ = shared.value
        rows_of = np.flatnonzero(group_of == left["grp"].iloc[0])
        wide = index.counts.shape[1]
        place = np.searchsorted(rows_of, right["a"].to_numpy()) * wide + right["b"].to_numpy()
        masks = np.frombuffer(b"".join(left["mask"]), dtype=np.uint8).reshape(len(left), -1)
        allowed = ((masks[:, place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1).astype(bool)
        return _top(_matrix(left["v"]), left["vec_id"].to_numpy(dtype=np.int64), _matrix(right["v"]), right["vec_id"].to_numpy(dtype=np.int64), allowed, k)

    keys = ["grp", "salt", "part"]
    found = asked.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInPandas(rerank, _PAIRS)
    return _ranked(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _enough(index: Index, probe: pd.DataFrame, truth: DataFrame, entries: DataFrame, recall: float) -> int:
    """Entries that a walk must pass to reach `recall` of the true neighbours of the probe queries."""
    cells = truth.join(entries.select("vec_id", "a", "b"), "vec_id").select("query_id", "a", "b").toPandas()
    depth = []
    for vec_id, v in probe[["vec_id", "v"]].itertuples(index=False):
        wanted = cells[cells["query_id"] == vec_id]
        left = {}
        for a, b in zip(wanted["a"], wanted["b"]):
            left[a, b] = left.get((a, b), 0) + 1
        for a, b, total in index.walk(np.asarray(v, dtype=np.float64)):
            depth += [total] * left.pop((a, b), 0)
            if not left:
                break
    return int(np.quantile(depth, recall, method="higher")) if depth else 0
