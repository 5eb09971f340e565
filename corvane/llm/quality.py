"""Quality rules in DataFrame functions only: repetition and length, then divergence from the language's references.

Each document has a histogram over character classes and one over common words, with a bin for all other words. The reference of a language is the
sum of the histograms of its documents that pass the base rules; a document goes if its Jensen-Shannon distance from
its language's reference is over a limit, and the text is long enough for the distance to mean anything.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import table

# Frequent words of four languages, and the character classes.
COMMON = (
    "the", "of", "and", "to", "in", "is", "that", "it", "for", "was", "with", "on",
    "der", "die", "und", "den", "von", "zu", "das", "mit", "sich", "des", "auf",
    "de", "la", "le", "et", "les", "en", "un", "du", "une", "que", "pour",
    "el", "los", "se", "del", "las", "por", "con", "no",
)
CLASSES = {"vowels": "aeiou", "consonants": "b-df-hj-np-tv-z", "capitals": "A-Z", "digits": "0-9", "points": ".,;:!?'\"()-", "symbols": "#*$%&|<>"}

LEAST_CHARS = 300
LEAST_WORDS = 100
MOST_CLASS_DISTANCE = 0.3
MOST_WORD_DISTANCE = 0.25  # a text without common words has about 0.3 if a sixth of its language's words are common

_SPACE = "[ \\t\\n\\x0B\\f\\r]"


def _kinds(text: Column) -> Column:
    """The text with every character of a class as that class's letter, and white space as a letter of its own.

    Letters themselves are all in a class, so a class's letter stands for nothing else: one pass over the text for all classes.
    """
    members = [*map(_members, CLASSES.values()), " \t\n\x0b\f\r"]
    return F.translate(text, "".join(members), "".join(chr(97 + i) * len(m) for i, m in enumerate(members)))


def _members(kind: str) -> str:
    """The characters of a class written with ranges, as in a pattern."""
    return "".join(c for c in map(chr, range(33, 127)) if re.fullmatch(f"[{kind}]", c))


def _count(kinds: Column, i: int) -> Column:
    return F.length(kinds) - F.length(F.replace(kinds, F.lit(chr(97 + i)), F.lit("")))


def _repeat_words(words: Column, n: int) -> Column:
    """Words inside windows of n words that occur more than once."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(h) - n + 1), lambda i: F.xxhash64(*[F.element_at(h, i + k) for k in range(n)]))

    def covered(w: Column) -> Column:
        ordered = F.array_sort(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = _fold_over(ordered, lambda o: F.filter(F.transform(o, lambda s, k: F.when((s["h"] == F.get(o, k + 1)["h"]) | (s["h"] == F.get(o, k - 1)["h"]), s["i"]).otherwise(F.lit(-1))), lambda p: p >= 0))
        gaps = _fold_over(F.array_sort(twice), lambda at: F.transform(at, lambda p, k: F.least(F.lit(n), F.coalesce(F.get(at, k + 1) - p, F.lit(n)))))
        return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)

    return _fold_over(hashes, lambda h: F.when(F.size(h) < n, F.lit(0)).otherwise(_fold_over(windows(h), lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(covered(w)))))


def _fold_over(value: Column, body) -> Column:
    """body(value) with value computed once: a lambda over an array of that one value."""
    return F.element_at(F.transform(F.array(value), body), 1)


def features(docs: DataFrame) -> DataFrame:
    """One pass over the texts: base measures and both histograms of every row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), text.alias("text"))
    rows = rows.select("*", F.array_remove(F.split("text", f"{_SPACE}+"), "").alias("words"), _kinds(F.col("text")).alias("kinds"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(f"[^{_SPACE[1:-1]}]"))
    common = F.filter(F.col("words"), lambda w: w.isin(*COMMON))
    counts = [_count(F.col("kinds"), i).cast("double") for i in range(len(CLASSES))]
    word_chars = F.length("text") - _count(F.col("kinds"), len(CLASSES))
    rows = rows.select(
        "doc_id", "lang", F.size("words").cast("long").alias("n_words"), word_chars.cast("long").alias("word_chars"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("words"), 5).cast("long").alias("n_repeat_words"),
        F.length("text").cast("double").alias("n_chars"), F.array(*counts).alias("classes"),
        F.transform(common, lambda w: F.array_position(F.array(*map(F.lit, COMMON)), w).cast("int")).alias("common"),
    )
    rest = F.col("n_chars") - _sum(F.col("classes"))
    counts = F.array(*[(F.size("common") - F.size(F.array_remove("common", F.lit(k + 1)))).cast("double") for k in range(len(COMMON))])
    return rows.select(
        "doc_id", "lang", "n_words", "word_chars", F.get("classes", list(CLASSES).index("symbols")).cast("long").alias("n_symbols"), "n_dup_lines", "n_repeat_words",
        ((F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))).alias("base_failed"),
        F.concat("classes", F.array(rest)).alias("class_counts"),
        F.concat(counts, F.array((F.col("n_words") - F.size("common")).cast("double"))).alias("word_counts"),
    )


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def divergence(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance in [0, 1], the square root of the divergence in bits, of two arrays of counts."""

    def part(x: Column, m: Column) -> Column:
        return F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))

    def pair(total: Column) -> Column:
        parts = F.zip_with(p, q, lambda a, b: F.struct((a / total["p"]).alias("a"), (b / total["q"]).alias("b")))
        return _sum(F.transform(parts, lambda s: (part(s["a"], (s["a"] + s["b"]) / 2) + part(s["b"], (s["a"] + s["b"]) / 2)) / 2))

    value = _fold_over(F.struct(_sum(p).alias("p"), _sum(q).alias("q")), lambda t: F.when((t["p"] > 0) & (t["q"] > 0), pair(t)))
    return F.sqrt(F.greatest(value, F.lit(0.0)))


def references(measured: DataFrame) -> DataFrame:
    """(lang, ref_classes, ref_words): sums over the documents of a language that pass the base rules."""
    sums = [F.array(*[F.sum(F.get(c, k)) for k in range(n)]).alias(a) for c, a, n in (("class_counts", "ref_classes", len(CLASSES) + 1), ("word_counts", "ref_words", len(COMMON) + 1))]
    return measured.where(~F.col("base_failed") & F.col("lang").isNotNull()).groupBy("lang").agg(*sums)


def judge(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, class_distance, word_distance).

    docs: doc_id, text, lang; other columns are ignored. A null text counts as empty and fails the base rules. Distances
    are null where the language is null, has no reference, or the counts are all zero; a null distance, or a text
    of fewer than LEAST_CHARS characters (LEAST_WORDS words for the word histogram), never rejects. Every row is judged,
    repeated ones alike; an empty table gives an empty one.
    """
    measured = table(features(docs))
    joined = measured.join(references(measured), "lang", "left")
    judged = joined.select("*", divergence(F.col("class_counts"), F.col("ref_classes")).alias("class_distance"), divergence(F.col("word_counts"), F.col("ref_words")).alias("word_distance"))
    far = lambda d, over, n, at: F.coalesce((F.col(d) > over) & (_sum(F.col(n)) >= at), F.lit(False))
    kept = ~F.col("base_failed") & ~far("class_distance", MOST_CLASS_DISTANCE, "class_counts", LEAST_CHARS) & ~far("word_distance", MOST_WORD_DISTANCE, "word_counts", LEAST_WORDS)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "class_distance", "word_distance")
