"""Quality rules by distribution divergence, in DataFrame operations only.

A document's histograms of character classes and of its language's common words are compared with
references summed over all documents of the language, by Jensen-Shannon distance.  Documents below a
minimum length are too short for a stable histogram and are not judged by it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldglass.llm.common import store

# Frequent words of four languages (fixed values); other languages share one reference of all.
COMMON = {
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich"],
    "en": ["the", "of", "and", "to", "a", "in", "is", "that", "for", "it"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "se", "del"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une"],
}
WORDS = sorted({w for words in COMMON.values() for w in words})
WINDOW = 8
# First go lower-case letters and white space, then all that is none of a class; the rest is counted.
PLAIN = "[\\p{Ll}\\x20\\x09-\\x0D]+"
CLASSES = ["[^\\p{Lu}]+", "[^\\p{N}]+", "[^.,;:!?'\"()\\-]+", "[^#*$%&|<>@/\\\\^~_=+{}\\[\\]]+"]


def _words(name: str = "text") -> Column:
    text = F.coalesce(F.col(name).cast("string"), F.lit(""))
    for other in "\t\n\x0b\x0c\r":
        text = F.replace(text, F.lit(other), F.lit(" "))
    return F.filter(F.split(text, " "), lambda w: w != "")


def _repeat_words(words: Column) -> Column:
    """Words inside windows that occur more than once.

    A window's hash is made of the hashes of its halves, so three passes hash them all.  The windows
    that the last words begin are shorter; their hashes are made of fewer parts and equal no other.
    """
    def let(value: Column, use) -> Column:  # binds a value, so that it is computed once
        return F.get(F.transform(F.array(value), use), 0)

    def places(ordered: Column) -> Column:
        def twice(s, i):
            return (F.get(ordered, i - 1)["h"] == s["h"]) | (F.get(ordered, i + 1)["h"] == s["h"])

        return F.array_sort(F.transform(F.filter(ordered, lambda s, i: F.coalesce(twice(s, i), F.lit(False))), lambda s: s["p"]))

    def covered(at: Column) -> Column:
        gaps = F.transform(at, lambda p, i: F.least(F.lit(WINDOW), p - F.coalesce(F.get(at, i - 1), F.lit(-WINDOW))))
        return F.aggregate(gaps, F.lit(0), lambda a, g: a + g)

    def counted(found: Column) -> Column:
        pairs = F.array_sort(F.transform(found, lambda h, p: F.struct(h.alias("h"), p.alias("p"))))
        long_way = let(pairs, lambda ordered: let(places(ordered), covered))
        return F.when(F.size(F.array_distinct(found)) == F.size(found), F.lit(0)).otherwise(long_way)

    def doubled(step):
        return lambda found: F.transform(found, lambda h, i: F.xxhash64(h, F.get(found, i + step)))

    windows = let(let(let(words, doubled(1)), doubled(2)), doubled(4))
    return F.when(F.size(words) > WINDOW, let(windows, counted)).otherwise(F.lit(0)).cast("long")


def measures(docs: DataFrame, *keep: str) -> DataFrame:
    """The base counts and histograms of each row; columns in `keep` stay."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(*keep, text.alias("text")).withColumn("words", _words())
    lines = F.filter(F.split("text", "\n"), lambda line: line.rlike("[^\\x20\\x09-\\x0D]"))
    spellings = [*WORDS, *(w.capitalize() for w in WORDS)]
    common = F.filter("words", lambda w: w.isin(*spellings))
    rows = rows.select(
        *keep, F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"), F.regexp_replace("text", PLAIN, "").alias("rest"),
        lines.alias("lines"), "words",
        # Every word has spaces of its own on both sides, so that each occurrence is found.
        F.concat(F.lit(" "), F.lower(F.array_join(common, "  ")), F.lit(" ")).alias("common"),
        F.size(common).cast("double").alias("n_common"),
    )
    marks = [F.length(F.regexp_replace("rest", c, "")).cast("double") for c in CLASSES]
    chars = F.array(*marks, (F.col("word_chars") - reduce(lambda a, b: a + b, marks)))
    hits = [((F.length("common") - F.length(F.replace(F.col("common"), F.lit(f" {w} "), F.lit("")))) / F.lit(len(w) + 2)).cast("double") for w in WORDS]
    return rows.select(
        *keep, "n_words", "word_chars", (F.length("rest") - F.length(F.translate("rest", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("words")).alias("n_repeat_words"), chars.alias("chars"),
        F.array(*hits, F.col("n_words") - F.col("n_common")).alias("heads"),
    )


def _shares(counts: Column) -> Column:
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    return F.transform(counts, lambda x: F.when(total > 0, x / total).otherwise(F.lit(0.0)))


def js_distance(left: Column, right: Column) -> Column:
    """Jensen-Shannon distance (base 2, 0 to 1) of two arrays of shares."""

    def part(p, m):
        return F.when(p > 0, p * F.log2(p / m)).otherwise(F.lit(0.0))

    terms = F.zip_with(left, right, lambda p, q: part(p, (p + q) / 2) + part(q, (p + q) / 2))
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) / 2, F.lit(0.0)))


def _reference(rows: DataFrame) -> DataFrame:
    """One row per known language and one ('') for all documents: summed histograms."""
    known = F.when(F.col("lang").isin(*COMMON), F.col("lang")).otherwise(F.lit("other"))
    n, m = len(CLASSES) + 1, len(WORDS) + 1
    sums = [F.sum(F.col("chars")[i]).alias(f"c{i}") for i in range(n)] + [F.sum(F.col("heads")[i]).alias(f"w{i}") for i in range(m)]
    by = rows.groupBy(known.alias("ref")).agg(*sums)
    whole = by.agg(*[F.sum(c).alias(c) for c in by.columns[1:]]).select(F.lit("").alias("ref"), "*")
    by = by.where(F.col("ref") != "other").unionByName(whole)
    return by.select("ref", F.array(*[f"c{i}" for i in range(n)]).alias("ref_chars"), F.array(*[f"w{i}" for i in range(m)]).alias("ref_heads"))


def judge(
    docs: DataFrame, char_limit: float = 0.28, word_limit: float = 0.27, min_chars: int = 300, min_words: int = 80
) -> DataFrame:
    """Per row: doc_id, n_words, the four base counts, base_failed, kept, char_distance, word_distance.

    A null text has no words and fails the base rules.  A document is kept unless it fails them or a
    histogram of sufficient mass (`min_chars`, `min_words`) is farther from its language's reference
    than the limit; a null or unknown language is compared with all documents.  Repeated rows are
    judged alike; extra columns are ignored; an empty table gives no rows.
    """
    rows = store(measures(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang")), "doc_id", "lang"))
    # At most five rows, whatever the data: one per language of COMMON and one for all.
    references = F.broadcast(store(_reference(rows)))
    rows = rows.withColumn("ref", F.when(F.col("lang").isin(*COMMON), F.col("lang")).otherwise(F.lit("")))
    rows = rows.join(references, "ref")
    rows = rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        js_distance(_shares(F.col("chars")), _shares(F.col("ref_chars"))).alias("char_distance"),
        js_distance(_shares(F.col("heads")), _shares(F.col("ref_heads"))).alias("word_distance"),
        ((F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))).alias("base_failed"),
    )
    far = ((F.col("word_chars") >= min_chars) & (F.col("char_distance") > char_limit)) | (
        (F.col("n_words") >= min_words) & (F.col("word_distance") > word_limit)
    )
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~far).alias("kept"), "char_distance", "word_distance",
    )
