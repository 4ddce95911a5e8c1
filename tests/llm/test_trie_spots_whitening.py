"""Prefix trie, spot signatures and whitening against brute force, with nulls, ties, repeats and empty tables."""

import hashlib
import re
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldglass.llm import prefix_trie, queries, spot_signatures, whitening

SF = "/root/testdata/sf0.01"
TURNS = "conv_id long, turn long, role string, text string, d int, z1 long, shard long"


def brute_trie(rows):
    """Nodes by walking every rebuilt conversation's prefixes."""
    turns = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            turns.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(v)] for c, v in turns.items()}
    whole = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(np.fmod(c, 20))
        whole[c] = tuple(turns.get(base, [])[:h] + own[h:])
    members, nodes = {}, []
    for c in sorted(whole):
        for d in range(len(whole[c]) + 1):
            members.setdefault(whole[c][:d], []).append(c)
    children = {}
    for path in members:
        if path:
            children.setdefault(path[:-1], []).append(path)
    leaves, saved = {}, {}
    for path in sorted(members, key=len, reverse=True):
        below = children.get(path, [])
        leaves[path] = sum(leaves[p] for p in below) or 1
        spoken = len(re.findall(r"[^\x20\x09-\x0D]+", path[-1][1])) if path else 0
        saved[path] = (len(members[path]) - 1) * spoken + sum(saved[p] for p in below)
    for path, convs in members.items():
        ends = ",".join(str(c) for c in convs if len(whole[c]) == len(path))
        up = members[path[:-1]][0] if path else None
        nodes.append((convs[0], len(path), up, len(convs), len(children.get(path, [])), leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(nodes, key=str)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie_rows(frame):
    return sorted((tuple(r) for r in prefix_trie.trie(frame).select(*COLUMNS).collect()), key=str)


def test_trie_equals_walked_prefixes(spark):
    random = np.random.default_rng(3)
    rows = []
    for c in [*range(-45, 90), *range(1_000, 1_900, 7)]:
        # Few distinct turns, so that prefixes are shared at every depth and across families.
        for t in range(int(random.integers(1, 7))):
            rows.append((c, None if t == 0 and c % 3 == 0 else t, [None, "user", "bot"][t % 3], [None, "", "a  b", "c d e"][int(random.integers(0, 4))]))
    assert trie_rows(spark.createDataFrame([(*r, 1, 2, 3) for r in rows], TURNS)) == brute_trie(rows)


def test_trie_of_long_conversations_crosses_stretches(spark):
    rows = []
    for c, n, change in [(0, 300, None), (20, 300, None), (23, 300, 64), (300, 300, 128), (301, 130, None), (302, 65, 63), (7, 64, None), (9, 63, None), (600, 64, None)]:
        rows += [(c, t, "user", f"turn {t}" if t != change else f"other {c}") for t in range(n)]
    assert trie_rows(spark.createDataFrame([(*r, 1, 2, 3) for r in rows], TURNS)) == brute_trie(rows)


def test_trie_of_repeated_rows_and_turnless_conversations(spark):
    # 21 has one turn and its base none, so it is turnless if its head is longer; repeats are turns of their own.
    rows = [(c, 0, "u", "x y") for c in range(21, 40)] + [(41, 5, "u", "same")] * 30 + [(42, None, "u", "same")] * 3 + [(None, 0, "u", "nobody")]
    got = trie_rows(spark.createDataFrame([(*r, 1, 2, 3) for r in rows], TURNS))
    assert got == brute_trie(rows)
    assert any(r[1] == 0 and r[7] != hashlib.sha256(b"").hexdigest() for r in got)


def test_trie_of_an_empty_table(spark):
    empty = spark.createDataFrame([], TURNS)
    assert prefix_trie.trie(empty).count() == 0 and set(prefix_trie.trie(empty).columns) == set(COLUMNS)


def test_trie_splits_a_conversation_with_most_rows(spark):
    rows = [(5, t // 3 if t % 2 else None, "u", f"w{t % 50}") for t in range(1_500)] + [(c, 0, "u", "w0") for c in range(100, 160)]
    frame = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], TURNS)
    placed = prefix_trie.numbered_turns(frame).where("conv = 5").collect()
    assert sorted(r.p for r in placed) == list(range(1, 1_501))
    by_place = [r.turn for r in sorted(placed, key=lambda r: r.p)]
    assert by_place == sorted(by_place, key=lambda t: -1 if t is None else t)
    nodes = prefix_trie.trie(frame)
    assert nodes.where("conv_id = 5").agg(F.max("depth")).first()[0] >= 1_497


def brute_spots(text):
    w = re.split(spot_signatures.SEPARATORS, " " + (text or "").lower())
    content = [(i, x) for i, x in enumerate(w) if i and x and x not in spot_signatures.ANCHORS]
    found, ahead = set(), 0
    for i, x in enumerate(w):
        if i == 0 or x in spot_signatures.ANCHORS:
            while ahead < len(content) and content[ahead][0] < i:
                ahead += 1
            after = [y for _, y in content[ahead:ahead + spot_signatures.CHAIN]]
            after += [""] * (spot_signatures.CHAIN - len(after))
            found.add(hashlib.md5(" ".join([x, *after]).encode()).hexdigest()[:16])
    return sorted(found)


def jaccard(a, b):
    return len(set(a) & set(b)) / len(set(a) | set(b))


DOCS = "doc_id long, text string, spots string, next string, part int, stretch int"


def test_spot_fingerprints_of_messy_texts(spark):
    long = " ".join(f"word{i % 977} the" for i in range(20_000))
    texts = [None, "", " \n ", "the of and", "plain words only", "The cat (sat) on the mat.", "The cat (sat) on the mat.", long, "x" * 40_000, "é ü der Hund, für die Katze!", "the."]
    rows = [(i * 3, t, "a", "b", 1, 2) for i, t in enumerate(texts)] + [(5, "same id", None, None, 0, 0)] * 2 + [(None, "no id", None, None, None, None)]
    frame = spark.createDataFrame(rows, DOCS)
    got = spot_signatures.fingerprint(frame).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got if r.doc_id != 5}
    order = sorted((r for r in rows if r[0] is not None), key=lambda r: -r[0]) + [rows[-1]]
    for k, row in enumerate(order):
        if row[0] == 5:
            continue
        text, after = row[1] or "", order[(k + 1) % len(order)][1] or ""
        cut = len(text) // 3
        edited = text[:len(text) - cut] + after[:cut]
        r = by[row[0]]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert r.fingerprint == "".join(brute_spots(text)) and r.edited_fingerprint == "".join(brute_spots(edited))
        assert r.near_edited == pytest.approx(jaccard(brute_spots(text), brute_spots(edited)))
        assert r.near_next == pytest.approx(jaccard(brute_spots(text), brute_spots(after)))
    assert by[15].fingerprint == by[18].fingerprint and len(by[0].fingerprint) == 16
    one = spot_signatures.fingerprint(frame.where("doc_id = 15")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert spot_signatures.fingerprint(frame.limit(0)).count() == 0


def test_next_rows_over_many_stretches(spark):
    random = np.random.default_rng(8)
    ids = [int(i) for i in random.choice(10 ** 6, 5_000, replace=False)] + [10 ** 15, -(10 ** 12)]
    frame = spark.createDataFrame([(i, i, i) for i in ids], "doc_id long, text_hash long, v long")
    for rows in (1, 10 ** 6):
        spot_signatures._ROWS, before = rows, spot_signatures._ROWS
        try:
            got = {r.doc_id: r.next.v for r in spot_signatures.with_next(frame, ["v"]).collect()}
        finally:
            spot_signatures._ROWS = before
        falling = sorted(ids, reverse=True)
        assert got == dict(zip(falling, falling[1:] + falling[:1]))


def test_matches_lose_nothing(spark):
    random = np.random.default_rng(6)
    vocabulary = [f"v{i}" for i in range(60)] + spot_signatures.ANCHORS[:20] * 3
    base = [[str(random.choice(vocabulary)) for _ in range(int(n))] for n in random.integers(3, 120, 12)]
    texts = []
    for words in base:
        for _ in range(8):
            copy = [w if random.random() > 0.03 else "changed" for w in words]
            texts.append(" ".join(copy[:len(copy) - int(random.integers(0, 4))]))
    texts += ["", None, "the of", texts[0]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [brute_spots(t) for t in texts]
    for threshold in (0.5, 0.8, 1.0 - 1e-9):
        want = {(q, d) for q in range(0, len(texts), 5) for d in range(len(texts)) if jaccard(sets[q], sets[d]) >= threshold}
        got = spot_signatures.matches(docs, docs.where("doc_id % 5 = 0"), threshold).collect()
        assert {(r.query_id, r.doc_id) for r in got} == want and len(got) == len(want)
        assert all(r.similarity == pytest.approx(jaccard(sets[r.query_id], sets[r.doc_id])) for r in got)


def test_edited_texts_are_nearer_than_next_ones(spark):
    got = spot_signatures.fingerprint(spark.read.parquet(f"{SF}/documents.parquet")).toPandas()
    enough = got[got.n_signatures >= 20]
    assert (enough.near_edited > 0.2).mean() > 0.99 and (enough.near_next < 0.1).mean() > 0.99


def test_registered_sql_of_trie_and_spots(spark):
    con = duckdb.connect()
    for name in ("documents", "conversations"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '/root/testdata/sf0.001/{name}.parquet'")
    for key, sql in queries.oracle_sql().items():
        got = queries.queries()[key](spark, "/root/testdata/sf0.001")
        columns = sorted(got.columns)
        want = con.sql(sql)
        assert sorted(want.columns) == columns
        plain = lambda rows: sorted([tuple(f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in rows])
        assert plain(got.select(*columns).collect()) == plain(want.select(*columns).fetchall()), key


def test_qdwh_finds_invariant_subspaces():
    random = np.random.default_rng(0)
    square = random.standard_normal((40, 40))
    u = whitening.polar_factor(square)
    h = u.T @ square
    assert np.allclose(u.T @ u, np.eye(40), atol=1e-12) and np.allclose(h, h.T, atol=1e-11) and np.linalg.eigvalsh((h + h.T) / 2).min() > 0
    shapes = [np.eye(5) * 3, np.diag([1.0, 1, 1, 2, 2]), np.zeros((4, 4)), np.array([[0, 1.0], [1, 0]]), np.ones((6, 6)), np.diag([1e8, 1.0, 1e-8])]
    for matrix in [*shapes, *(m @ m.T for m in (random.standard_normal((n, n + 3)) for n in (1, 2, 7, 64, 130)))]:
        values, vectors = whitening.principal(matrix)
        size = max(1.0, np.abs(matrix).max())
        assert np.allclose(values, np.linalg.eigvalsh(matrix)[::-1], atol=1e-12 * size * len(matrix))
        assert np.allclose(vectors.T @ vectors, np.eye(len(matrix)), atol=1e-12)
        assert np.allclose(matrix @ vectors, vectors * values, atol=1e-12 * size * len(matrix))


def test_whitened_components(spark):
    frame = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", F.lit(1).alias("id"), F.lit("x").alias("v"))
    bad = [(-1, None), (-2, []), (-3, [None] + [1.0] * 63), (-4, [float("nan")] + [0.0] * 63), (-5, [float("inf")] + [0.0] * 63), (-6, [1.0, 2.0]), (-7, [3e38] + [0.0] * 63)]
    bad = spark.createDataFrame([(*r, 1, "x") for r in bad], "vec_id long, embedding array<float>, id int, v string")
    got = whitening.whiten(frame.unionByName(bad).repartition(5)).toPandas()
    rows = frame.toPandas()
    x = np.floor(64 * np.stack(rows.embedding).astype(float)).astype(np.int64) + 1_000_000
    n, sums = len(x), x.sum(axis=0)
    values, vectors = np.linalg.eigh(np.cov(x.T, bias=True))
    values, vectors = values[::-1], vectors[:, ::-1]
    assert len(got) == 32 * n and set(got.n) == {n}
    table = got.set_index(["vec_id", "component"]).sort_index()
    white = table.whitened.unstack().loc[rows.vec_id].to_numpy()
    want = (x - sums / n) @ vectors[:, :32] / np.sqrt(values[:32])
    assert np.allclose(white, want * np.sign((white * want).sum(axis=0)), atol=1e-8)
    assert np.allclose(table.explained.unstack().iloc[0], values[:32] / values.sum(), rtol=1e-10)
    error = np.abs(np.cov(white.T, bias=True) - np.eye(32)).max()
    assert got.identity_error.nunique() == 1 and abs(got.identity_error[0] - error) < 1e-10 and error < 1e-10
    exact = {int(i): int(sum((n * int(a) - int(s)) ** 2 for a, s in zip(r, sums))) for i, r in zip(rows.vec_id, x)}
    assert all(int(d) == exact[i] for i, d in zip(got.vec_id, got.deviation))


def test_whitening_of_degenerate_tables(spark):
    schema = "vec_id long, embedding array<double>"
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(i, [1.0, 2.0]) for i in range(4)]):
        assert whitening.whiten(spark.createDataFrame(rows, schema)).count() == 0
    # Two distinct vectors and a null id, repeated: one component.
    rows = [(1, [0.0, 0.0]), (1, [0.0, 0.0]), (None, [1.0, 1.0]), (3, [1.0, 1.0])]
    got = whitening.whiten(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == 4 and {r.component for r in got} == {1} and all(abs(abs(r.whitened) - 1) < 1e-12 for r in got)
    # Entries far apart: deviations beyond 64 bits stay exact.
    big = float(1 << 39)
    got = whitening.whiten(spark.createDataFrame([(i, [big * (i % 2), float(i)]) for i in range(50)], schema)).collect()
    x = [[int(64 * v) + 1_000_000 for v in (big * (i % 2), float(i))] for i in range(50)]
    sums = [sum(c) for c in zip(*x)]
    assert {r.vec_id: int(r.deviation) for r in got} == {i: sum((50 * a - s) ** 2 for a, s in zip(r, sums)) for i, r in enumerate(x)}
    assert Fraction(sums[0], 50) == Fraction(64 * (1 << 39), 2) + 1_000_000
