"""Quality by nearest-neighbour voting in a latent-semantic space.

Texts become weighted counts of hashed character trigrams, beside a profile of how soon their words
come back (damped trigram counts hardly tell a repeated word from a frequent one); the leading
singular directions of a bounded labelled sample map both to short vectors.  The labelled vectors are broadcast; every
document is compared with all of them by blocked cosine products, and its nearest ones vote with
their similarities.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from fieldglass.llm.common import id_remainder, store

TERMS = 2048  # hashed trigrams
GAPS = 8  # kinds of terms for the distance to a word's last occurrence: first, 1, 2, up to 4, 8, 16, 32, more
RANK = 48  # latent dimensions
NEIGHBOURS = 15
SAMPLE_PER_CLASS = 2048  # labelled rows of each class that are learned from, at most
_BLOCK = 256  # documents per product
_PIECE = 1 << 20  # bytes of a text hashed together


def term_counts(text: bytes | None) -> np.ndarray:
    """Damped counts of a text's hashed byte trigrams, all of the text."""
    total = np.zeros(TERMS)
    data = np.frombuffer(text or b"", dtype=np.uint8)
    for start in range(0, max(len(data) - 2, 0), _PIECE):
        part = data[start:start + _PIECE + 2].astype(np.uint32)
        mixed = (part[:-2] * np.uint32(65599) + part[1:-1] * np.uint32(257) + part[2:]) * np.uint32(2654435761)
        total += np.bincount(mixed >> np.uint32(21), minlength=TERMS)
    return np.log1p(total).astype(np.float32)


def recurrence(text: bytes | None) -> np.ndarray:
    """Roots of the shares of a text's words by the distance to the same word before: a unit vector."""
    seen: dict[bytes, int] = {}
    word = np.fromiter((seen.setdefault(w, len(seen)) for w in (text or b"").split()), dtype=np.int64)
    if not len(word):
        return np.zeros(GAPS, dtype=np.float32)
    order = np.argsort(word, kind="stable")
    again = word[order][1:] == word[order][:-1]
    gaps = np.diff(order)[again]
    kinds = np.minimum(1 + np.ceil(np.log2(gaps)).astype(np.int64), GAPS - 1)
    counts = np.bincount(kinds, minlength=GAPS)
    counts[0] = len(seen)
    return np.sqrt(counts / len(word)).astype(np.float32)


def terms(text: bytes | None) -> np.ndarray:
    """Trigram terms, then recurrence terms; all zero for texts without a trigram."""
    counts = term_counts(text)
    return np.concatenate([counts, recurrence(text) if counts.any() else np.zeros(GAPS, dtype=np.float32)])


def _unit(rows: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norms > 0, norms, 1)


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Rows of terms with both parts at unit length."""
    return np.hstack([_unit(counts[:, :TERMS] * idf), counts[:, TERMS:]])


@dataclass
class Voters:
    """A fitted space with its labelled vectors; at most 2 * SAMPLE_PER_CLASS rows of RANK numbers."""

    idf: np.ndarray
    axes: np.ndarray  # (TERMS + GAPS, RANK)
    vectors: np.ndarray
    votes: np.ndarray  # label of each vector
    weight: np.ndarray  # rows of the corpus that each vector stands for
    prior: float

    def embed(self, counts: np.ndarray) -> np.ndarray:
        return _unit(weighted(counts, self.idf) @ self.axes)

    def scores(self, counts: np.ndarray) -> np.ndarray:
        if not len(self.vectors):
            return np.full(len(counts), self.prior)
        near = self.embed(counts) @ self.vectors.T
        take = min(NEIGHBOURS, near.shape[1])
        best = np.argpartition(-near, take - 1, axis=1)[:, :take]
        weight = np.maximum(np.take_along_axis(near, best, axis=1), 0) ** 4 * self.weight[best]
        total = weight.sum(axis=1)
        voted = (weight * self.votes[best]).sum(axis=1) / np.where(total > 0, total, 1)
        return np.where(total > 0, voted, self.prior)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", trains: Column | None = None, seed: int = 23) -> Voters:
    """Learn from at most SAMPLE_PER_CLASS labelled rows of each class, the first by hash of the id."""
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
    known = known.where(trains) if trains is not None else known
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("cls"))
    known = known.withColumn("order", F.xxhash64("doc_id", F.lit(seed)))
    totals = {row["cls"]: row["count"] for row in known.groupBy("cls").count().collect()}
    picks = [known.where(F.col("cls") == c).orderBy("order", "doc_id").limit(SAMPLE_PER_CLASS).select("doc_id", "cls") for c in (0, 1)]
    chosen = store(picks[0].unionByName(picks[1]))

    def count(batches):
        for batch in batches:
            rows = [terms(t.as_py()).tobytes() for t in batch.column(1).cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], ["cls", "counts"])

    # The ids are at most 2 * SAMPLE_PER_CLASS rows; a repeated id gives at most its first row.
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    first = texts.groupBy("doc_id", "cls").agg(F.min("text").alias("text"))
    got = first.select("cls", "text").mapInArrow(count, "cls int, counts binary").toArrow()
    x = np.array([np.frombuffer(b.as_py(), dtype=np.float32) for b in got.column("counts")], dtype=np.float32).reshape(-1, TERMS + GAPS)
    y = np.array(got.column("cls").to_pylist(), dtype=np.float64)
    used = x.any(axis=1)
    x, y = x[used], y[used]
    prior = totals.get(1, 0) / max(1, sum(totals.values()))
    if not len(x):
        return Voters(np.ones(TERMS, np.float32), np.zeros((TERMS + GAPS, 1), np.float32), np.zeros((0, 1), np.float32), y, y, prior)
    idf = (np.log((1 + len(x)) / (1 + (x[:, :TERMS] > 0).sum(axis=0))) + 1).astype(np.float32)
    rows = weighted(x, idf)
    # Leading right singular vectors by subspace iteration.
    rank = min(RANK, len(x))
    axes = np.random.default_rng(seed).standard_normal((TERMS + GAPS, rank)).astype(np.float32)
    for _ in range(8):
        axes = np.linalg.qr(rows.T @ (rows @ axes))[0]
    stands = np.array([totals.get(int(c), 1) / max(1, (y == c).sum()) for c in (0, 1)])
    return Voters(idf, axes.astype(np.float32), _unit(rows @ axes).astype(np.float32), y, stands[y.astype(int)], prior)


def add_score(docs: DataFrame, voters: Voters, name: str = "score") -> DataFrame:
    shared, at = docs.sparkSession.sparkContext.broadcast(voters), docs.columns.index("text")

    def run(batches):
        for batch in batches:
            texts = batch.column(at).cast(pa.large_binary())
            out = np.zeros(len(texts))
            for start in range(0, len(texts), _BLOCK):
                counts = np.stack([terms(t.as_py()) for t in texts[start:start + _BLOCK]])
                out[start:start + len(counts)] = shared.value.scores(counts)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.clip(out, 0, 1))], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def score(docs: DataFrame, labels: DataFrame, modulus: int = 3, held: int = 1) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted.

    Only text is read for the score.  Null, empty and very short texts have no trigrams and get the
    share of label 1 in the training labels, as do all documents when no labelled text is found (0
    without labels).  Repeated rows score alike; an empty table gives no rows; rows without id are
    never held out.
    """
    voters = fit(docs, labels, trains=id_remainder("doc_id", modulus) != held)
    rows = add_score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), voters)
    return rows.select(
        "doc_id", F.coalesce(id_remainder("doc_id", modulus) == held, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
