"""Column functions for tokens, normal forms and link targets. All are built-in expressions; none is a Python UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CJK = "[\\u4e00-\\u9fff]"
EMPTY = "cast(array() as array<string>)"


def ngrams(run: Column, n: int) -> Column:
    """All substrings of n characters; none if the text is shorter. One scan: cutting by position would walk the text for each."""
    return F.regexp_extract_all(run, F.lit(f"(?s)(?=(.{{{n}}}))"), 1)


def index_tokens(text: Column) -> Column:
    """Index tokens, repeated ones kept: ASCII words with their parts, and CJK runs with halves or bigrams and single characters."""
    low = F.lower(F.coalesce(text, F.lit("")))
    words = F.regexp_extract_all(low, F.lit("([a-z0-9_.\\-]+)"), 1)
    runs = F.regexp_extract_all(low, F.lit(f"({CJK}+)"), 1)

    def word(w: Column) -> Column:
        parts = F.filter(F.split(w, "[._\\-]+"), lambda p: (F.length(p) > 1) & (p != w))
        return F.when(w.rlike("[._\\-]"), F.concat(F.array(w), parts)).otherwise(F.array(w))  # splitting is dear, and few words have parts

    def run(r: Column) -> Column:
        halves = F.array(F.substring(r, 1, 2), F.substring(r, 3, 2))
        middle = F.when(F.length(r) == 4, halves).when(F.length(r) > 2, ngrams(r, 2)).otherwise(F.expr(EMPTY))
        return F.concat(F.array(r), middle, ngrams(r, 1))

    return F.concat(F.flatten(F.transform(words, word)), F.when(low.rlike(CJK), F.flatten(F.transform(runs, run))).otherwise(F.expr(EMPTY)))


def _bags(words: Column, low: Column) -> Column:
    """STRUCT<words, parts> of the ASCII words of a lower-case text: parts are those of words with separators, and its CJK tokens."""
    of_words = F.filter(F.split(F.array_join(F.filter(words, lambda w: F.contains(w, F.lit(".")) | F.contains(w, F.lit("-")) | F.contains(w, F.lit("_"))), " "), "[^a-z0-9]+"), lambda p: F.length(p) > 1)
    cjk = F.when(low.rlike(CJK), index_tokens(F.regexp_replace(low, "[a-z0-9_.\\-]+", " "))).otherwise(F.expr(EMPTY))
    return F.struct(words.alias("words"), F.concat(of_words, cjk).alias("parts"))


def token_bags(text: Column, distinct: bool = False) -> Column:
    """STRUCT<words, parts>: the index tokens in two arrays and in no order, repeated ones kept; distinct: words only once.

    Cheaper than index_tokens where order does not matter: only words with separators are taken apart, in one piece.
    """
    low = F.lower(F.coalesce(text, F.lit("")))
    words = F.regexp_extract_all(low, F.lit("([a-z0-9_.\\-]+)"), 1)
    words = F.array_distinct(words) if distinct else words
    return F.element_at(F.transform(F.array(words), lambda w: _bags(w, low)), 1)  # words are computed once


def index_terms(text: Column) -> Column:
    """The distinct index tokens."""
    return F.element_at(F.transform(F.array(token_bags(text, distinct=True)), lambda b: F.array_distinct(F.concat(b["words"], b["parts"]))), 1)


def token_count(bags: Column) -> Column:
    """How many tokens the bags of a text hold."""
    return F.size(bags["words"]) + F.size(bags["parts"])


def term_count(bags: Column, term: str) -> Column:
    """How often the bags of a text hold a token."""
    return count_of(bags["words"], term) + count_of(bags["parts"], term)


def count_of(items: Column, item: str | Column) -> Column:
    """How often an array holds an item."""
    return F.size(items) - F.size(F.array_remove(items, item))


def normal_text(text: Column) -> Column:
    """Text for similarity: without frontmatter, fences and Markdown marks, links by their alias, blanks squeezed, lower case."""
    t = F.regexp_replace(text, "(?s)\\A---.*?\\n---\\s*", "")
    t = F.regexp_replace(t, "(?s)```.*?```", "")
    t = F.regexp_replace(t, "\\[\\[(?:[^\\]|]*\\|)?([^\\]|]*)\\]\\]", "$1")
    t = F.regexp_replace(t, "[#*_`>|\\-]", " ")
    return F.lower(F.regexp_replace(F.regexp_replace(t, "\\s+", " "), "^ | $", ""))


def upper_slug(text: Column) -> Column:
    """SCREAMING-KEBAB: runs other than ASCII alphanumerics and CJK become one hyphen."""
    t = F.regexp_replace(text, "[^A-Za-z0-9\\u4e00-\\u9fff]+", "-")
    return F.upper(F.regexp_replace(t, "^-+|-+$", ""))


def node_id(path: Column) -> Column:
    """A stable id of at most 40 characters that ends in six digits of the path's md5."""
    clean = F.regexp_replace(F.lower(F.regexp_replace(path, "[^a-zA-Z0-9_]", "_")), "^_+|_+$", "")
    return F.concat(F.lit("node_"), F.substring(clean, 1, 28), F.lit("_"), F.substring(F.md5(path), 1, 6))


def link_target(raw: Column) -> Column:
    """A link's target: up to an escaped or plain pipe, then up to the anchor, without trailing backslashes and slashes."""
    t = F.substring_index(F.substring_index(raw, "\\|", 1), "|", 1)
    return F.regexp_replace(F.trim(F.substring_index(t, "#", 1)), "[\\\\/]+$", "")


def is_placeholder(target: Column) -> Column:
    """Targets that stand for something to be filled in."""
    return target.isin("...", "..", "") | target.contains("{{") | target.rlike("<[^<>]*>") | (target.contains("〔") & target.contains("〕")) | target.rlike("(^|[^A-Za-z0-9_])YYYY-MM(-DD)?([^A-Za-z0-9_]|$)")


def entropy(text: Column) -> Column:
    """Shannon entropy of a text's characters in bits; null for an empty text."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    parts = F.transform(F.array_distinct(chars), lambda c: count_of(chars, c) / F.size(chars))
    return F.when(F.length(text) > 0, -F.aggregate(parts, F.lit(0.0), lambda a, p: a + p * F.log2(p)))


def redact_urls(text: Column, mark: str = "[link]") -> Column:
    return F.regexp_replace(text, "https?://\\S+", mark)


def first_date(*texts: Column) -> Column:
    """The first YYYY-MM-DD in the first text that has one."""
    return F.coalesce(*[F.nullif(F.regexp_extract(t, "(\\d{4}-\\d{2}-\\d{2})", 1), F.lit("")) for t in texts])


def conflict_tokens(text: Column, english_stops: list[str], cjk_stops: list[str]) -> Column:
    """Distinct content tokens: ASCII words without stop words, and CJK 2- to 4-grams without stop grams."""
    words = F.transform(F.regexp_extract_all(text, F.lit("([A-Za-z][A-Za-z0-9_\\-]+)"), 1), F.lower)
    runs = F.regexp_extract_all(text, F.lit(f"({CJK}+)"), 1)
    grams = F.flatten(F.transform(runs, lambda r: F.concat(*[ngrams(r, n) for n in (2, 3, 4)])))
    return F.array_union(F.array_except(words, F.array(*map(F.lit, english_stops))), F.array_except(grams, F.array(*map(F.lit, cjk_stops))))


def deidentify(text: Column, replacements: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The text after ordered literal replacements, and how many were made."""
    total = F.lit(0)
    for find, put in replacements:
        total = total + (F.length(text) - F.length(F.replace(text, F.lit(find), F.lit("")))) / len(find)
        text = F.replace(text, F.lit(find), F.lit(put))
    return text, total.cast("long")
