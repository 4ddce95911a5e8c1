"""Best-fit packing of token pieces into fixed-length sequences by a grouping genetic algorithm.

Tokenised documents are cut into pieces; whole-length pieces are sequences already.  The others are
dealt by hash into batches of about `batch_items`.  Several islands evolve packings of a batch:
crossover injects whole well-filled bins of one parent into the other, bins that hold the same pieces
are dissolved, and the displaced pieces are placed by best fit, longest first.  After each epoch an
island's best packing migrates to the next island; at the end the batch keeps the best of all.
"""

from __future__ import annotations

import json
import math
import os
import zlib
from functools import cached_property, lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldglass.llm.common import returning_memory, store

_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# White space other than single spaces and newlines between characters that are none.
_MIXED = (
    r"\A[ \n]|[ \n]\z|[ \n]{2}"
    r"|[\t\v\f\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
_TOGETHER = 2_000_000  # bytes of the texts encoded together; bounds memory


class TextEncoder:
    """Ids of a byte-level BPE tokenizer file, as little-endian 32-bit numbers.

    Merges of this kind of file are in id order, so a rank-based encoder gives the same ids faster.
    A space between two characters that are not white space always begins a pre-token, and a newline
    there is one; texts are cut there, and the different chunks of all texts at hand are encoded once,
    in one call.  Texts with other white space are encoded whole, those with a special token's string
    go to the tokenizer itself.
    """

    def __init__(self, path: str):
        import tiktoken

        self.path = path
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.special = [t["content"] for t in spec["added_tokens"]]
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(printable)]
        to_byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(hidden)}
        vocabulary = {bytes(to_byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in self.special}
        self.whole = tiktoken.Encoding("pieces", pat_str=_PATTERN, mergeable_ranks=vocabulary, special_tokens={}).encode_ordinary
        self.newline = vocabulary[b"\n"]

    @cached_property
    def tokenizer(self):
        """Read when the first text needs it: it takes as much memory as all the rest here."""
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        return Tokenizer.from_file(self.path)

    def encode(self, text: str) -> bytes:
        return next(self.encode_all(pa.array([text], pa.string())))

    def encode_all(self, texts: pa.StringArray):
        """The ids of each text (none null), one after the other."""
        whole = pc.or_(pc.equal(texts, ""), pc.match_substring_regex(texts, _MIXED))
        for token in self.special:
            whole = pc.or_(whole, pc.match_substring(texts, token))
        # Every text is cut as if it followed a newline; chunks after a newline begin with it.
        cut = pc.replace_substring(texts.filter(pc.invert(whole)), "\n", " \n")
        cut = pc.split_pattern(pc.binary_join_element_wise("\n", cut, ""), " ")
        chunks = cut.flatten().dictionary_encode()
        ids, first, count = self._chunk_ids(chunks.dictionary)
        places, ends = chunks.indices.to_numpy(), iter(cut.offsets.to_numpy()[1:].tolist())
        start = 0
        for number, alone in enumerate(whole.to_pylist()):
            if alone:
                yield self._alone(texts[number].as_py())
                continue
            end = next(ends)
            own = places[start:end]
            start = end
            reached = np.cumsum(count[own])
            at = np.repeat(first[own] - reached + count[own], count[own]) + np.arange(reached[-1])
            yield ids[at[1:]].tobytes()

    def _chunk_ids(self, chunks: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all chunks, and the first place and count of each chunk's: all are one text, a newline before each."""
        lines = pc.starts_with(chunks, "\n")
        marked = pc.if_else(lines, chunks, pc.binary_join_element_wise("\n ", chunks, ""))
        joined = pc.binary_join(pa.ListArray.from_arrays([0, len(marked)], marked), "")[0].as_py()
        ids = np.array(self.whole(joined), dtype="<u4")
        starts = np.flatnonzero(ids == self.newline)
        first = starts + pc.invert(lines).to_numpy(zero_copy_only=False)
        return ids, first, np.append(starts[1:], len(ids))[:len(starts)] - first

    def _alone(self, text: str) -> bytes:
        special = any(s in text for s in self.special)
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids if special else self.whole(text)
        return np.array(ids, dtype="<u4").tobytes()


def tokenizer_path() -> str:
    """The tokenizer file of the registered queries."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=2)
def encoder(path: str) -> TextEncoder:
    return TextEncoder(path)


def _portions(batches):
    """(ids, texts) of consecutive rows of all batches: `_TOGETHER` bytes and one text at most; null texts are empty."""
    held, size = [], 0
    for batch in batches:
        texts = pc.fill_null(batch.column(1).cast(pa.string()), "")
        # 64 more for a row, so that empty texts count.
        reached = size + np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64) + 64)
        cuts = np.flatnonzero(np.diff(reached // _TOGETHER, prepend=size // _TOGETHER)) + 1
        start = 0
        for end in cuts.tolist():
            held.append((batch.column(0)[start:end], texts[start:end]))
            yield tuple(map(pa.concat_arrays, zip(*held)))
            held, start = [], end
        if start < len(texts):
            held.append((batch.column(0)[start:], texts[start:]))
        size = int(reached[-1]) if len(texts) else size
    if held:
        yield tuple(map(pa.concat_arrays, zip(*held)))


def pieces(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, uid: every document cut into pieces of at most `capacity`.

    Only the first piece of a longer document may be shorter.  A null text counts as empty (its one
    piece is the end id).  `uid` numbers the pieces; repeated rows get pieces of their own.
    """
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches):
        encode = encoder(path).encode_all
        serial = TaskContext.get().partitionId() << 33
        for doc_ids, texts in _portions(batches):
            rows: list[tuple] = []
            for doc, found in zip(doc_ids.to_pylist(), encode(texts)):
                ids = memoryview(found + end)
                total, start, number = len(ids) // 4, 0, 0
                size = total % capacity or capacity
                while start < total:
                    rows.append((doc, number, start, size, zlib.crc32(ids[4 * start:4 * (start + size)]), serial))
                    start, size, number, serial = start + size, capacity, number + 1, serial + 1
            columns = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "piece", "start", "length", "ids_crc32", "uid"])

    schema = "doc_id long, piece long, start long, length long, ids_crc32 long, uid long"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(returning_memory(run), schema)


def best_fit(sizes, order, residuals, capacity, bin_of, next_bin):
    """Place items in `order`, each into the open bin that it fills best; `residuals` are (bin, space) pairs."""
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for number, space in residuals:
        if space:
            stacks[space].append(number)
            mask |= 1 << space
    for item in order:
        size = sizes[item]
        fits = mask >> size
        if fits:
            space = size + (fits & -fits).bit_length() - 1
            stack = stacks[space]
            number = stack.pop()
            if not stack:
                mask ^= 1 << space
        else:
            number, space, next_bin = next_bin, capacity, next_bin + 1
        bin_of[item] = number
        left = space - size
        if left:
            stacks[left].append(number)
            mask |= 1 << left
    return bin_of


def _tidy(bin_of: np.ndarray) -> np.ndarray:
    return np.unique(bin_of, return_inverse=True)[1]


def _fitness(bin_of, sizes, capacity) -> tuple[int, float]:
    fill = np.bincount(bin_of, weights=sizes)
    return -len(fill), float(np.mean((fill / capacity) ** 2))


def _breed(taker, giver, sizes, capacity, random) -> np.ndarray:
    """Inject well-filled bins of `giver` into `taker`, dissolve clashing bins, best-fit what is displaced."""
    fill = np.bincount(giver, weights=sizes)
    good = np.flatnonzero(fill >= np.quantile(fill, 0.5))
    chosen = np.zeros(len(fill), dtype=bool)
    chosen[random.choice(good, max(1, len(good) // 3), replace=False)] = True
    injected = chosen[giver]
    clash = np.zeros(taker.max() + 1, dtype=bool)
    clash[taker[injected]] = True
    # The least filled bins of the taker are dissolved as well, so that their pieces move.
    taker_fill = np.bincount(taker, weights=sizes)
    clash[np.argsort(taker_fill, kind="stable")[:2]] = True
    displaced = np.flatnonzero(clash[taker] & ~injected)
    child = taker.copy()
    child[injected] = len(clash) + giver[injected]
    kept = np.flatnonzero(~clash & (taker_fill > 0))
    spaces = list(zip(kept.tolist(), (capacity - taker_fill[kept]).astype(int).tolist()))
    given = np.flatnonzero(chosen)
    spaces += list(zip((len(clash) + given).tolist(), (capacity - fill[given]).astype(int).tolist()))
    order = displaced[np.argsort(-sizes[displaced], kind="stable")]
    return _tidy(best_fit(sizes.tolist(), order.tolist(), spaces, capacity, child, len(clash) + len(chosen)))


def evolve(sizes: np.ndarray, elites: list[np.ndarray], capacity: int, seed: int, population: int = 4, children: int = 16) -> np.ndarray:
    """One epoch of an island: the best packing (item -> bin) found from the elites that came in."""
    random = np.random.default_rng(seed)
    bound = math.ceil(sizes.sum() / capacity)
    plain = sizes.tolist()
    people = list(elites)
    for number in range(population):
        if len(people) >= population or (people and -_fitness(people[-1], sizes, capacity)[0] <= bound):
            break
        noise = random.uniform(0, 0.02 * capacity * (number > 0 or bool(elites)), len(sizes))
        order = np.argsort(-(sizes + noise), kind="stable")
        people.append(_tidy(best_fit(plain, order.tolist(), [], capacity, np.zeros(len(sizes), dtype=np.int64), 0)))
    scored = sorted(((_fitness(p, sizes, capacity), -i, p) for i, p in enumerate(people)), key=lambda s: s[:2], reverse=True)
    for number in range(children):
        if -scored[0][0][0] <= bound or len(scored) < 2:
            break
        a, b = random.choice(len(scored), 2, replace=False)
        child = _breed(scored[a][2], scored[b][2], sizes, capacity, random)
        score = (_fitness(child, sizes, capacity), -len(people) - number, child)
        if score[0] > scored[-1][0]:
            scored[-1] = score
            scored.sort(key=lambda s: s[:2], reverse=True)
    return scored[0][2]


def _island(capacity: int, seed: int):
    def run(key, frame: pd.DataFrame) -> pd.DataFrame:
        batch, island = int(key[0]), int(key[1])
        frame = frame.sort_values(["role", "length", "uid"], ascending=[True, False, True], kind="stable")
        first = frame[frame["role"] == frame["role"].iloc[0]]
        sizes = first["length"].to_numpy(dtype=np.int64)
        elites = [p["bin"].to_numpy(dtype=np.int64) for _, p in frame.groupby("role") if p["bin"].iloc[0] >= 0]
        best = evolve(sizes, elites, capacity, seed + 1_000_003 * batch + island + 31 * len(elites))
        return pd.DataFrame({"batch": batch, "island": island, "uid": first["uid"].to_numpy(), "length": sizes, "bin": best})

    return run


def _settle(capacity: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["island", "length", "uid"], ascending=[True, False, True], kind="stable")
        best = min((p for _, p in frame.groupby("island")), key=lambda p: p["bin"].nunique())
        rows = best.sort_values(["bin", "length", "uid"], ascending=[True, False, True], kind="stable")
        by = rows.groupby("bin")
        return pd.DataFrame({"uid": rows["uid"], "sequence_id": by["uid"].transform("min"), "offset": by["length"].cumsum() - rows["length"]})

    return run


def pack(parts: DataFrame, capacity: int = 1024, batch_items: int = 4096, islands: int = 2, epochs: int = 2, seed: int = 7) -> DataFrame:
    """(uid, sequence_id, offset) for pieces (uid, length) of at most `capacity`.

    Sequences are named after their smallest uid.  Batches are dealt by hash of the uid and so hold
    about `batch_items` pieces however the data is distributed.  No pieces give no rows.
    """
    partial = parts.where(F.col("length") < capacity).select("uid", "length")
    full = parts.where(F.col("length") >= capacity).select("uid", F.col("uid").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    batches = max(1, math.ceil(partial.count() / batch_items))
    state = partial.withColumn("batch", F.pmod(F.xxhash64("uid", F.lit(seed)), F.lit(batches)))
    state = state.select("batch", F.explode(F.expr(f"sequence(0L, {islands - 1}L)")).alias("island"), "uid", "length", F.lit(-1).cast("long").alias("bin"), F.lit(0).alias("role"))
    schema = "batch long, island long, uid long, length long, bin long"
    for epoch in range(epochs):
        state = state.groupBy("batch", "island").applyInPandas(_island(capacity, seed + 7919 * epoch), schema)
        if epoch < epochs - 1:
            state = store(state)
            guests = state.withColumn("island", F.pmod(F.col("island") + 1, F.lit(islands)))
            state = state.withColumn("role", F.lit(0))
            state = state.unionByName(guests.withColumn("role", F.lit(1))) if islands > 1 else state
    packed = state.groupBy("batch").applyInPandas(_settle(capacity), "uid long, sequence_id long, offset long")
    return full.unionByName(packed)


def pack_documents(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2, **settings) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts give one piece (the end id).  Texts of any length are cut, never dropped.
    Repeated rows are packed once each.  Extra columns are ignored; an empty table gives no rows.
    """
    parts = store(pieces(docs, path, capacity, end_id))
    placed = pack(parts.select("uid", "length"), capacity, **settings)
    return parts.join(placed, "uid").select(
        "doc_id", F.col("piece").cast("int").alias("piece"), "start", "length", "ids_crc32", "sequence_id", "offset"
    )
