"""Toxicity by two class-conditional Kneser-Ney models of the characters of words.

A toxic and an ordinary model are counted on labelled rows, each over the characters of words with
the four and the two characters before as contexts.  Both back off to one continuation distribution
that they share (in how many distinct long contexts a short one goes on with a character), so an
expression that neither class shows often gets nearly the same probability from both.  Characters
rather than words, because offensive stems come with many endings.  A text's log-likelihood ratio is
length-normalised and calibrated on training rows kept out of the counts.

Counting is a distributed aggregation over all chosen rows.  The model that scores holds the sums by
the full 64-bit hash of their gram, so no two grams share a count and a foreign gram reads as unseen.
A gram that no class shows twice is wholly discounted, and a context of only such grams gives exactly
its backoff; they are left out, so strings that occur once (ids, encodings) take no room.  What is
broadcast grows with the grams seen repeatedly.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from fieldglass.llm.common import id_remainder, returning_memory, store

ID_BITS = 22
LONG, SHORT = 4, 2  # characters of context
ALPHABET = 64  # of the uniform distribution below everything
_WORDS = re.compile(r"\w+")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_CACHE_LIMIT = 400_000
# Discounts of counts 1, 2 and 3 or more: a single sighting is wholly left to the backoff.
DISCOUNTS = (1.0, 1.5, 2.0)
# A word's log ratio beyond this is strong evidence by itself.
STRONG = 3.0
FEATURES = 4
# Labelled documents that the calibration learns from, at most; the counts use all the others.
CALIBRATION = 20_000


def words_of(text: str | None) -> list[str]:
    return _WORDS.findall((text or "").lower())


def grams(words: list[str]) -> dict[str, np.ndarray]:
    """Hashes at every character (and the end) of words: long and short contexts, with and without it.

    `word` is the index of the word that a position belongs to.
    """
    pad = "\x02" * LONG
    codes = np.frombuffer("".join(f"{pad}{w}\x03" for w in words).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
    starts = np.cumsum(sizes + LONG) - sizes
    word = np.repeat(np.arange(len(words)), sizes)
    at = np.arange(len(word)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts, sizes)

    def hashed(size, last):
        total = np.full(len(at), size * 2 + last, dtype=np.uint64)
        for back in range(size, 0 if not last else -1, -1):
            total = (total ^ codes[at - back]) * _MIX
            total ^= total >> np.uint64(31)
        return total

    return {"word": word, "long": hashed(LONG, True), "long_context": hashed(LONG, False), "short": hashed(SHORT, True), "short_context": hashed(SHORT, False)}


@dataclass
class Table:
    """Values by 64-bit key; absent keys have zeros."""

    keys: np.ndarray  # (n,) sorted
    values: np.ndarray  # (columns, n)

    def at(self, keys: np.ndarray) -> np.ndarray:
        """(columns, len(keys)) values."""
        if not len(self.keys):
            return np.zeros((len(self.values), len(keys)))
        place = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return self.values[:, place] * (self.keys[place] == keys)


@dataclass
class Level:
    """Counts by class of one context length; class 1 is the toxic one."""

    kept: Table  # by context and character: discounted counts of classes 0 and 1
    context: Table  # counts of both classes, then what their characters were discounted by

    def probabilities(self, gram, context, lower):
        """(2, positions), given those of the level below."""
        kept, found = self.kept.at(gram), self.context.at(context)
        seen, spare = found[:2], found[2:]
        return np.where(seen > 0, (kept + spare * lower) / np.maximum(seen, 1), lower)


@dataclass
class Model:
    long: Level
    short: Level
    goes_on: Table  # distinct long contexts in which a short one goes on with a character
    goes_on_total: Table  # the same by short context

    def ratios(self, words: list[str]) -> np.ndarray:
        """log P(word | toxic) - log P(word | ordinary) of each word."""
        if not words:
            return np.zeros(0)
        at = grams(words)
        shared = (self.goes_on.at(at["short"])[0] + 0.5) / (self.goes_on_total.at(at["short_context"])[0] + 0.5 * ALPHABET)
        low = self.short.probabilities(at["short"], at["short_context"], shared)
        logs = np.log(self.long.probabilities(at["long"], at["long_context"], low))
        return np.bincount(at["word"], weights=logs[1] - logs[0], minlength=len(words))


def training_rows(docs: DataFrame, labels: DataFrame, label: str = "toxic", trains: Column | None = None, seed: int = 11) -> DataFrame:
    """Texts of all labelled rows where `trains` holds: (cls, fold, text).

    A bit set of fixed size drops nearly all other documents before the join, so only labelled texts
    are shuffled, and of the folds that are counted (all but 0) only each text's distinct words.  Of
    fold 0, which calibrates, at most `CALIBRATION` documents stay, those of the least draws: a hash of
    the id, so reruns choose the same ones.  The others of it are counted as fold 1.  The join is a merge join at every size.  A
    document labelled both ways counts as labelled 1.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
    known = known.where(trains) if trains is not None else known
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("cls"))
    fold = F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.lit(seed)), F.lit(4)).cast("int").alias("fold")
    draw = F.xxhash64(F.lit(seed), F.col("doc_id").cast("long"))
    last = known.where(fold == 0).select(draw.alias("draw")).orderBy("draw").limit(CALIBRATION).agg(F.max("draw")).first()[0]
    spread = F.when((fold == 0) & (draw > F.lit(last)), 1).otherwise(fold)
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << ID_BITS))
    spark = docs.sparkSession
    bits = np.zeros(1 << ID_BITS, dtype=bool)
    bits[known.select(place.cast("int").alias("place")).distinct().toPandas()["place"].to_numpy(dtype=np.int64)] = True
    shared = spark.sparkContext.broadcast(np.packbits(bits))

    def sift(batches):
        marks = shared.value
        for batch in batches:
            at = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            keep = (marks[at >> 3] >> (7 - (at & 7))) & 1
            near = batch.filter(pa.array(keep.astype(bool)))
            texts = [t if fold == 0 else " ".join(sorted(set(words_of(t)))) for fold, t in zip(near.column(2).to_pylist(), near.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([near.column(1), near.column(2), pa.array(texts, pa.string())], ["doc_id", "fold", "text"])

    rows = docs.select(place.cast("int").alias("place"), F.col("doc_id").cast("long"), spread.alias("fold"), F.col("text").cast("string"))
    near = rows.where(F.col("doc_id").isNotNull()).mapInArrow(returning_memory(sift), "doc_id long, fold int, text string")
    return store(near.join(known.hint("merge"), "doc_id").select("cls", "fold", "text"))


def _count_words(batches):
    """(word, c0, c1): in how many texts of each class a word occurs."""
    for batch in batches:
        counts = (Counter(), Counter())
        for cls, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            counts[cls].update(set(words_of(text.as_py())))
        words = [*dict.fromkeys([*counts[0], *counts[1]])]
        columns = [pa.array(words, pa.string()), *(pa.array([c[w] for w in words], pa.int64()) for c in counts)]
        yield pa.RecordBatch.from_arrays(columns, ["word", "c0", "c1"])


_GRAM_COLUMNS = ["gram", "context", "short", "short_context", "c0", "c1"]


def _count_grams(batches):
    """Long grams of words, weighted by the texts that hold them, with their contexts and short grams."""
    for batch in batches:
        words = batch.column(0).to_pylist()
        counts = np.stack([batch.column(1).to_numpy(), batch.column(2).to_numpy()])
        for start in range(0, len(words), 50_000):
            part = words[start:start + 50_000]
            found = grams(part)
            keys, first, inverse = np.unique(found["long"], return_index=True, return_inverse=True)
            weight = [np.bincount(inverse, weights=counts[k, start + found["word"]], minlength=len(keys)).astype(np.int64) for k in (0, 1)]
            columns = [keys.view(np.int64), *(found[n][first].view(np.int64) for n in ("long_context", "short", "short_context")), *weight]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], _GRAM_COLUMNS)


def fit(rows: DataFrame) -> Model:
    """Count both models on rows (cls, text); every word of every chosen row is counted."""
    counted = rows.select(F.col("cls").cast("int"), "text").mapInArrow(returning_memory(_count_words), "word string, c0 long, c1 long")
    words = counted.groupBy("word").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))
    long = words.mapInArrow(returning_memory(_count_grams), ", ".join(f"{n} long" for n in _GRAM_COLUMNS))
    long = store(long.groupBy(*_GRAM_COLUMNS[:4]).agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1")))
    short = store(long.groupBy("short", "short_context").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"), F.count(F.lit(1)).alias("n")))

    def cut(name):
        c = F.col(name)
        return F.when(c >= 3, DISCOUNTS[2]).when(c >= 2, DISCOUNTS[1]).when(c >= 1, DISCOUNTS[0]).otherwise(0.0)

    def collected(frame, key, *values):
        """Sums of values by key."""
        got = frame.groupBy(F.col(key).alias("key")).agg(*[F.sum(v).cast("double").alias(f"v{i}") for i, v in enumerate(values)]).toPandas()
        keys = got["key"].to_numpy(dtype=np.int64).view(np.uint64)
        order = np.argsort(keys)
        return Table(keys[order], got.drop(columns="key").to_numpy(dtype=np.float64)[order].T.copy())

    def level(frame, gram, context):
        """Without grams that both classes discount wholly, and contexts that hold no others: both give the backoff."""
        twice = F.greatest("c0", "c1") >= 2
        useful = frame.where(twice).select(context).distinct()
        kept = collected(frame.where(twice), gram, F.col("c0") - cut("c0"), F.col("c1") - cut("c1"))
        return Level(kept, collected(frame.join(useful, context, "left_semi"), context, "c0", "c1", cut("c0"), cut("c1")))

    return Model(level(long, "gram", "context"), level(short, "short", "short_context"), collected(short, "short", "n"), collected(short, "short_context", "n"))


class WordScores(dict):
    """Log ratios of words met so far under one model; emptied when it grows too large."""

    def learn(self, model: Model, words) -> None:
        new = [w for w in set(words) if w not in self]
        if len(self) + len(new) > _CACHE_LIMIT:
            self.clear()
            new = list(set(words))
        for start in range(0, len(new), 20_000):
            part = new[start:start + 20_000]
            self.update(zip(part, model.ratios(part).tolist()))


def features(model: Model, texts, known: WordScores) -> np.ndarray:
    """(rows, FEATURES): mean log ratio, sum over root of length, log of the strong evidence, log length.

    All zero for texts without words.
    """
    out = np.zeros((len(texts), FEATURES))
    for start in range(0, len(texts), 256):
        lists = [words_of(t.as_py()) for t in texts[start:start + 256]]
        known.learn(model, [w for words in lists for w in set(words)])
        for row, words in enumerate(lists, start):
            if words:
                ratio = np.fromiter(map(known.__getitem__, words), dtype=np.float64, count=len(words))
                total, size = ratio.sum(), len(words)
                out[row] = total / size, total / np.sqrt(size), np.log1p(np.maximum(ratio - STRONG, 0).sum()), np.log1p(size)
    return out


def calibrate(x: np.ndarray, y: np.ndarray, ridge: float = 0.5) -> np.ndarray:
    """Logistic weights (intercept last) by Newton steps."""
    scale = np.array([4.0, 0.3, 1.0, 0.1])
    z = np.c_[x * scale, np.ones(len(x))]
    weights = np.zeros(FEATURES + 1)
    penalty = ridge * np.array([0.1, 0.1, 0.1, 1.0, 0.02])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ weights, -30, 30)))
        slope = z.T @ (p - y) + penalty * weights
        curve = (z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty)
        weights -= np.linalg.solve(curve, slope)
    weights[:-1] *= scale
    return weights


def _score(model_weights, texts, known) -> np.ndarray:
    model, weights = model_weights
    x = features(model, texts, known)
    return 1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -30, 30)))


@dataclass
class Scorer:
    """A fitted model, broadcast; adds `score` (probability of the toxic class) to documents."""

    broadcast: object

    def add_score(self, docs: DataFrame, name: str = "score") -> DataFrame:
        at, shared = docs.columns.index("text"), self.broadcast

        def run(batches):
            known = WordScores()
            for batch in batches:
                values = pa.array(_score(shared.value, batch.column(at), known), pa.float64())
                yield pa.RecordBatch.from_arrays([*batch.columns, values], names=[*batch.schema.names, name])

        return docs.mapInArrow(returning_memory(run), StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def fit_scorer(docs: DataFrame, labels: DataFrame, label: str = "toxic", trains: Column | None = None) -> Scorer:
    """Fit on labelled rows (those where `trains` holds); three quarters are counted, a quarter calibrates.

    Without labelled rows of both classes every score is the share of the class seen (0 if none).
    Null texts count as empty; texts without words get the score of no evidence at length zero.
    """
    rows = training_rows(docs, labels, label, trains)
    model = fit(rows.where("fold > 0"))
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def held(batches):
        known = WordScores()
        for batch in batches:
            x = features(shared.value, batch.column(1), known)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x[:, i]) for i in range(FEATURES))], ["cls", *(f"x{i}" for i in range(FEATURES))])

    # At most `CALIBRATION` documents have fold 0 (repeated rows of them count); four numbers each.
    kept = rows.where("fold = 0").select(F.col("cls").cast("int"), "text").mapInArrow(returning_memory(held), "cls int, " + ", ".join(f"x{i} double" for i in range(FEATURES)))
    sample = kept.toPandas().to_numpy(dtype=np.float64)
    y = sample[:, 0]
    if len(set(y)) == 2:
        weights = calibrate(sample[:, 1:], y)
    else:
        weights = np.r_[np.zeros(FEATURES), 30.0 if len(y) and y[0] == 1 else -30.0]
    return Scorer(spark.sparkContext.broadcast((model, weights)))


def score(docs: DataFrame, labels: DataFrame, modulus: int = 4, held: int = 2, threshold: float = 0.3) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted.  Rows of remainder `held` are never learned from."""
    scorer = fit_scorer(docs, labels, trains=id_remainder("doc_id", modulus) != held)
    rows = scorer.add_score(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))).select("doc_id", "score")
    return rows.select(
        "doc_id", F.coalesce(id_remainder("doc_id", modulus) == held, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, modulus: int = 4, held: int = 2, threshold: float = 0.3) -> DataFrame:
    """The documents whose score stays below the threshold, with all their columns."""
    scorer = fit_scorer(docs, labels, trains=id_remainder("doc_id", modulus) != held)
    return scorer.add_score(docs, "__toxic_score").where(F.col("__toxic_score") < threshold).drop("__toxic_score")
