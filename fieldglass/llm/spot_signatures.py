"""Document fingerprints by spot signatures, in DataFrame operations only.

An anchor is a common word; its signature is the anchor with the next content words, that is words which
are no anchors, wherever further anchors stand between them.  The start of a text is an anchor too, so
that every text has a signature.  Frames, tables and lists hold few common words, so signatures sit in
running prose.  A fingerprint is the sorted set of a text's signatures.  Sets are compared by Jaccard
similarity; sets of too different sizes cannot reach a threshold, so `matches` deals them out by size
and compares within neighbouring sizes only those that share one of their rarest signatures.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Common words of four languages (fixed values).
ANCHORS = [
    "the", "of", "and", "to", "a", "in", "is", "that", "it", "for", "was", "on", "with", "as", "be", "by", "this", "are", "at", "from",
    "der", "die", "und", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "im", "nicht", "dem", "ein", "eine", "als",
    "de", "la", "que", "el", "en", "y", "los", "se", "del", "las", "un", "con", "por", "no", "su", "una", "para", "es", "al", "lo",
    "le", "et", "les", "du", "une", "pour", "est", "par", "qui", "dans", "avec", "sur", "pas", "au", "ou", "ce", "il", "ne",
]
CHAIN = 2  # content words of a signature
SEPARATORS = "[\\x20\\x09-\\x0D.,;:!?\"()\\[\\]{}|]+"
_HEX = 16  # digits kept of a signature's digest
_LIMITS, _ROWS = 4096, 4096  # most stretches of the id axis; rows that a stretch should hold


def _let(value: Column, use) -> Column:
    """use(value), with the value computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def signatures(text: Column, chain: int = CHAIN) -> Column:
    """The sorted set of a text's signatures, as hexadecimal texts; null counts as empty, a wordless text has one."""
    words = F.split(F.concat(F.lit(" "), F.lower(F.coalesce(text.cast("string"), F.lit("")))), SEPARATORS, -1)

    def of(words: Column) -> Column:
        # Only the first and the last word may be empty.
        places = F.filter(F.transform(words, lambda w, i: F.when((i == 0) | w.isin(*ANCHORS), i).otherwise(-1)), lambda p: p >= 0)
        content = F.filter(words, lambda w, i: (i > 0) & (w != "") & ~w.isin(*ANCHORS))

        def signed(content: Column) -> Column:
            def one(place: Column, before: Column) -> Column:
                # Of the words before an anchor `before` are anchors, so that many fewer are content words.
                follow = [F.coalesce(F.get(content, place - before + step), F.lit("")) for step in range(chain)]
                return F.substring(F.md5(F.concat_ws(" ", F.get(words, place), *follow).cast("binary")), 1, _HEX)

            return F.transform(places, one)

        return _let(content, signed)

    return F.sort_array(F.array_distinct(_let(words, of)))


def likeness(left: Column, right: Column, threshold: float = 0.0) -> Column:
    """Jaccard similarity of two signature sets; 0 without a comparison if their sizes rule the threshold out."""
    small, large = F.least(F.size(left), F.size(right)), F.greatest(F.size(left), F.size(right))
    both = F.size(F.array_intersect(left, right))
    exact = F.when(left == right, F.lit(1.0)).otherwise(both / (small + large - both))
    return F.when((large > 0) & (small < threshold * large), F.lit(0.0)).otherwise(exact) if threshold else exact


def with_next(rows: DataFrame, values: list[str]) -> DataFrame:
    """Each row with `next`, a struct of `values` of the following row: doc_id falling, nulls last, equal ids by text hash; the first after the last.

    The id axis is cut at approximate quantiles into stretches, each ordered in a task of its own; the
    first row of a stretch is copied to the end of the stretch before.  Rows that share one doc_id are in
    one stretch.
    """
    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    cuts = min(_LIMITS, 2 * width)
    found = rows.agg(F.percentile_approx("doc_id", [i / cuts for i in range(1, cuts)], 20 * cuts), F.count("doc_id"), F.min("doc_id"), F.max("doc_id")).head()
    limits, parts = sorted({*(found[0] or []), *(v for v in found[2:] if v is not None)}), max(1, min(64, math.ceil(found[1] / cuts / _ROWS)))
    side = max(1, math.isqrt(len(limits)))
    every, coarse = F.array(*[F.lit(v) for v in limits]), F.array(*[F.lit(v) for v in limits[side - 1::side]])

    def below(part: Column) -> Column:
        return F.size(F.filter(part, lambda limit: limit < F.col("doc_id")))

    if limits:
        jump = below(coarse) * side
        stretch = jump + below(F.slice(every, jump + 1, side))
        low, high = F.get(every, F.col("stretch") - 1), F.get(every, F.col("stretch"))
        inner = F.coalesce(F.least(F.lit(parts - 1), F.floor((high.cast("double") - F.col("doc_id")) * parts / (high.cast("double") - low))), F.lit(0)).cast("int")
    else:
        stretch, inner = F.lit(-1), F.lit(0)
    placed = rows.withColumn("stretch", F.when(F.col("doc_id").isNull(), -1).otherwise(stretch)).withColumn("inner", inner)
    line = Window.orderBy(F.desc("stretch"), "inner")
    tops = placed.groupBy("stretch", "inner").agg(F.max("doc_id").alias("top"))
    # At most 64 x 4098 stretches, so this window and the broadcast below are bounded.
    numbered = tops.withColumn("part", F.row_number().over(line))
    last = F.max("part").over(Window.partitionBy())
    numbered = numbered.withColumn("before", F.when(F.col("part") == 1, last).otherwise(F.col("part") - 1))
    placed = placed.join(F.broadcast(numbered.select("stretch", "inner", "top", "part", "before")), ["stretch", "inner"])
    copies = F.when(F.col("doc_id").eqNullSafe(F.col("top")), F.array(F.col("part"), -F.col("before"))).otherwise(F.array(F.col("part")))
    placed = placed.select("doc_id", "text_hash", *values, F.explode(copies).alias("at"))
    order = Window.partitionBy("part").orderBy("copy", F.desc_nulls_last("doc_id"), "text_hash")
    placed = placed.select("*", F.abs("at").alias("part"), (F.col("at") < 0).alias("copy"))
    return placed.withColumn("next", F.lead(F.struct(*values)).over(order)).where(~F.col("copy")).drop("at", "part", "copy")


def fingerprint(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_signatures.

    The edited text is the text with its last floor(n_chars / 3) code points replaced by the first as
    many of the next document's (all, if fewer); see `with_next` for the order.  A null text counts as
    empty.  Texts without words share a fingerprint of one signature.  Repeated rows follow each other
    and are kept; a single row is its own next; other columns are ignored; an empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # Only texts travel: signatures are digests, which do not compress, and are cheap to make again.
    rows = with_next(rows.select("doc_id", "text", F.xxhash64("text").alias("text_hash")), ["text"])
    rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    cut = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - cut), F.substring(F.col("next.text"), F.lit(1), cut))
    rows = rows.withColumn("edited", edited)
    rows = rows.withColumns({"spots": signatures(F.col("text")), "edited_spots": signatures(F.col("edited")), "next_spots": signatures(F.col("next.text"))})
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), F.array_join("spots", "").alias("fingerprint"),
        F.array_join("edited_spots", "").alias("edited_fingerprint"), likeness(F.col("spots"), F.col("edited_spots")).alias("near_edited"),
        likeness(F.col("spots"), F.col("next_spots")).alias("near_next"), F.size("spots").cast("long").alias("n_signatures"),
    )


def _rarest(sets: DataFrame, counts: DataFrame, threshold: float) -> DataFrame:
    """(id, band, spot): the rarest signatures of each set, so many that sets at the threshold share one."""
    spots = sets.select("id", F.explode("spots").alias("spot")).join(counts, "spot", "left")
    ordered = spots.groupBy("id").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "spot"))).alias("o"))
    keep = F.size("o") - F.ceil(F.size("o") * F.lit(threshold) - 1e-9).cast("int") + 1
    band = F.floor(F.log(F.size("o").cast("double")) / F.lit(-math.log(threshold)) + 1e-9).cast("long")
    return ordered.select("id", band.alias("band"), F.explode(F.slice("o", F.lit(1), keep)).alias("o")).select("id", "band", F.col("o.spot").alias("spot"))


def matches(docs: DataFrame, queries: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(query_id, doc_id, similarity) of all rows of `docs` whose signature sets are at least so similar to a query's.

    Both tables have doc_id and text; ids are unique in each and rows with a null id take no part.  Equal
    fingerprints are compared once and then given to each of their documents.  A set of n signatures lies
    in band floor(log n / log(1 / threshold)); sets that reach the threshold lie in neighbouring bands and
    share one of their rarest signatures, so no match is lost.  A query's own row counts like any other.
    """
    def sets(rows: DataFrame) -> DataFrame:
        rows = rows.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), signatures(F.col("text")).alias("spots"))
        return rows.withColumn("id", F.sha2(F.array_join("spots", ""), 256))

    left, right = sets(queries), sets(docs)
    asked, held = (s.groupBy("id").agg(F.first("spots").alias("spots")) for s in (left, right))
    counts = held.select(F.explode("spots").alias("spot")).groupBy("spot").agg(F.count(F.lit(1)).alias("n"))
    index = _rarest(held, counts, threshold).select(F.col("id").alias("held"), "band", "spot")
    probes = _rarest(asked, counts, threshold).select(F.col("id").alias("asked"), F.explode(F.array(*[F.col("band") + i for i in (-1, 0, 1)])).alias("band"), "spot")
    pairs = probes.join(index, ["band", "spot"]).select("asked", "held").distinct()
    pairs = pairs.join(asked.select(F.col("id").alias("asked"), F.col("spots").alias("a")), "asked")
    pairs = pairs.join(held.select(F.col("id").alias("held"), F.col("spots").alias("b")), "held")
    pairs = pairs.select("asked", "held", likeness(F.col("a"), F.col("b"), threshold).alias("similarity")).where(F.col("similarity") >= threshold)
    found = left.select(F.col("id").alias("asked"), F.col("doc_id").alias("query_id")).join(pairs, "asked")
    return found.join(right.select(F.col("id").alias("held"), "doc_id"), "held").select("query_id", "doc_id", "similarity")


# The query's rows in DuckDB.  Equal ids are ordered by text there, which the given tables do not have.
ORACLE_SQL = """
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
following AS (
    SELECT doc_id, text, coalesce(lead(text) OVER (ORDER BY doc_id DESC NULLS LAST, text), first_value(text) OVER (ORDER BY doc_id DESC NULLS LAST, text)) AS follow
    FROM texts
),
changed AS (
    SELECT *, left(text, (length(text) - length(text) // 3)::BIGINT) || left(follow, (length(text) // 3)::BIGINT) AS edited FROM following
),
spots AS (
    SELECT doc_id, text, edited, {own} AS spots, {edit} AS edited_spots, {follow} AS next_spots FROM changed
)
SELECT doc_id, length(text) AS n_chars, sha256(edited) AS edited_sha256, array_to_string(spots, '') AS fingerprint,
       array_to_string(edited_spots, '') AS edited_fingerprint, {near_edited} AS near_edited, {near_next} AS near_next, len(spots) AS n_signatures
FROM spots
"""


def oracle_sql() -> str:
    common = ", ".join(f"'{w}'" for w in ANCHORS)

    def spots(text: str) -> str:
        words = f"regexp_split_to_array(' ' || lower({text}), '{SEPARATORS}')"
        places = f"list_filter(list_transform(w, lambda x, i: CASE WHEN i = 1 OR x IN ({common}) THEN i ELSE 0 END), lambda p: p > 0)"
        content = f"list_filter(w, lambda x, i: i > 1 AND x <> '' AND x NOT IN ({common}))"
        follow = " || ' ' || ".join(f"coalesce(c[p - j + {1 + step}], '')" for step in range(CHAIN))
        one = f"md5(w[p] || ' ' || {follow})[1:{_HEX}]"
        return f"(SELECT list_sort(list_distinct(list_transform(s, lambda p, j: {one}))) FROM (SELECT w, {places} AS s, {content} AS c FROM (SELECT {words} AS w)))"

    def near(a: str, b: str) -> str:
        both = f"len(list_intersect({a}, {b}))"
        return f"{both} / (len({a}) + len({b}) - {both})::DOUBLE"

    return ORACLE_SQL.format(
        own=spots("text"), edit=spots("edited"), follow=spots("follow"), near_edited=near("spots", "edited_spots"), near_next=near("spots", "next_spots")
    )
