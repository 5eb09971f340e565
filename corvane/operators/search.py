"""Ranked search: BM25 over sections with heading, title, tag, phrase, coverage and language boosts.

A query has a handful of terms, so document frequencies come from one aggregation with a column for each
term, and scoring is one pass over the notes; nothing is exploded and only the top-k rows are sorted.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import text as T

K1, B = 1.5, 0.75


@dataclass(frozen=True)
class Term:
    text: str
    weight: float = 1.0
    core: bool = True


def expand(query: str, terms: list[Term], clusters: list[tuple[list[str], list[str]]]) -> list[Term]:
    """Terms with the expansions, at 0.9, of every cluster (triggers, expansions) that the query or a term sets off."""
    out, seen = list(terms), {t.text for t in terms}
    for triggers, words in clusters:
        if any(x in query or any(x in t.text for t in terms) for x in triggers):
            for w in words:
                if w not in seen:
                    seen.add(w)
                    out.append(Term(w, 0.9, False))
    return out


def statistics(notes: DataFrame, terms: list[Term]) -> dict:
    """N, the mean number of tokens, and the document frequency of each term: one row."""
    bags = notes.select(T.token_bags(F.col("content")).alias("b"))
    columns = [F.sum((F.array_contains("b.words", t.text) | F.array_contains("b.parts", t.text)).cast("long")).alias(f"df{i}") for i, t in enumerate(terms)]
    return bags.agg(F.count("*").alias("n"), F.avg(T.token_count(F.col("b"))).alias("mean"), *columns).first().asDict()


def term_statistics(notes: DataFrame) -> DataFrame:
    """(term, df, idf) of all index tokens of notes (content): idf = ln(1 + (N - df + 0.5) / (df + 0.5))."""
    n = notes.agg(F.count("*").alias("n")).first()["n"]
    counts = notes.select(F.explode(T.index_terms(F.col("content"))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return counts.select("term", "df", F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))


def _idf(stats: dict, i: int) -> float:
    import math

    df = stats[f"df{i}"] or 0
    return math.log(1 + (stats["n"] - df + 0.5) / (df + 0.5)) if df else 1.0


def search(notes: DataFrame, query: str, terms: list[Term], language: str | None = None, tag: str | None = None, top: int | None = 3) -> DataFrame:
    """(rel, title, section, score, rank) of the best notes, by score and then rel.

    notes: rel, title, tags ARRAY<STRING>, kind, content, and sections ARRAY<STRUCT<heading, body>>; a missing list
    counts as empty. tag keeps notes that have a tag containing it. top None returns all that score over 0.5.
    """
    q = query.lower().strip()
    stats = statistics(notes, terms)
    idf = [_idf(stats, i) for i in range(len(terms))]
    mean = float(stats["mean"] or 1.0) or 1.0
    zero = F.lit(0.0)
    has = lambda c, s: F.contains(c, F.lit(s))
    plus = lambda test, x: F.when(test, F.lit(float(x))).otherwise(zero)

    def section_score(s: Column) -> Column:
        head, body = F.lower(F.coalesce(s["heading"], F.lit(""))), F.lower(F.coalesce(s["body"], F.lit("")))
        total = zero
        for t, w in zip(terms, idf):
            tf = F.get(s["tf"], F.lit(terms.index(t))).cast("double")
            total = total + F.when(tf > 0, F.lit(t.weight * w) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * s["n"] / F.lit(mean)))).otherwise(zero)
            total = total + plus(has(head, t.text), w * t.weight * 3.0)
        if len(q) > 1:
            total = total + plus(has(head, q), 15) + plus(has(body, q), 8)
        code = F.lit(False)
        for t in terms:
            if len(t.text) > 2:
                code = code | has(body, t.text)
        return total + plus(has(body, "```") & code, 2)

    kept = notes if tag is None else notes.where(F.exists("tags", lambda x: has(x, tag.lower())))
    tags = F.coalesce(F.col("tags"), F.expr(T.EMPTY))
    raw = F.lower(F.concat_ws(" ", "title", F.array_join(tags, " "), "content"))
    rows = kept.select("rel", "title", "kind", F.lower(F.coalesce("title", F.lit(""))).alias("low"), tags.alias("tags"), raw.alias("raw"), "sections")
    whole = lambda s: F.concat_ws("\n", s["heading"], s["body"])
    bagged = F.transform("sections", lambda s: F.struct(s["heading"].alias("heading"), s["body"].alias("body"), T.token_bags(whole(s)).alias("b")))
    counted = F.transform(bagged, lambda s: F.struct(s["heading"].alias("heading"), s["body"].alias("body"), T.token_count(s["b"]).alias("n"), F.array(*[T.term_count(s["b"], t.text) for t in terms]).alias("tf")))
    rows = rows.withColumn("sections", counted)
    scored = rows.withColumn("scores", F.transform("sections", lambda s: section_score(s)))
    best = F.greatest(F.coalesce(F.array_max("scores"), zero), zero)
    place = F.when(best > 0, F.array_position("scores", F.array_max("scores"))).otherwise(F.lit(1)) - 1  # the first of equally good sections
    boost = plus(has(F.col("low"), q), 20) if q else zero
    for t, w in zip(terms, idf):
        boost = boost + plus(has(F.col("low"), t.text), w * t.weight * 3.5) + plus(F.exists("tags", lambda x: has(x, t.text)), w * t.weight * 4.0)
    core = [t for t in terms if t.core]
    covered = sum((has(F.col("raw"), t.text).cast("int") for t in core), F.lit(0)) / float(len(core)) if core else F.lit(1.0)
    doc = best + boost
    factor = F.lit(1.0)
    if language:
        own = F.array_contains("tags", language)
        other = F.exists("tags", lambda x: x.startswith("lang/"))
        doc = doc + plus(own & F.col("kind").isin("standards", "cheatsheet"), 8)
        factor = F.when(own, 2.5).when(other, 0.2).otherwise(0.6)
    score = doc * F.pow(covered, F.lit(1.5)) * factor + plus(covered >= 0.99, 5)
    found = scored.select("rel", "title", place.cast("int").alias("section"), score.alias("score")).where("score > 0.5")
    if top is None:
        return found
    best_rows = found.orderBy(F.desc("score"), "rel").limit(top)
    return best_rows.select("*", F.row_number().over(_rank()).alias("rank"))


def _rank():
    from pyspark.sql import Window

    return Window.orderBy(F.desc("score"), "rel")  # over the top-k rows only


def snippet_line(body: Column, query: str, terms: list[str]) -> Column:
    """(line, score): the earliest best line, +10 for the query, +2.5 (0.5 if one character) for each term, -1 if blank or a rule."""
    low = lambda x: F.lower(x)

    def one(x: Column) -> Column:
        total = F.when(F.contains(low(x), F.lit(query.lower())), 10.0).otherwise(0.0)
        for t in terms:
            total = total + F.when(F.contains(low(x), F.lit(t)), 2.5 if len(t) > 1 else 0.5).otherwise(0.0)
        return total - F.when(x.rlike("^\\s*(-{3,})?\\s*$"), 1.0).otherwise(0.0)

    scored = F.transform(F.split(body, "\n"), lambda x, i: F.struct(one(x).alias("score"), (-i).alias("order"), x.alias("line")))
    return F.array_max(scored)


# Words of a query that name a language, in order.
LANGUAGES = {
    "go": "lang/go", "cpp": "lang/cpp", "c++": "lang/cpp", "c": "lang/c", "golang": "lang/go", "python": "lang/python", "py": "lang/python",
    "rust": "lang/rust", "rs": "lang/rust", "typescript": "lang/typescript", "ts": "lang/typescript", "bash": "lang/bash", "sh": "lang/bash", "shell": "lang/bash",
}


def query_terms(query: str) -> list[Term]:
    """The weighted terms of a query, first seen first: words 1.5 and their parts 1.0; CJK runs 1.8, halves of four 1.3, pairs 1.2, characters 0.3."""
    import re

    low, found = query.lower().strip(), {}
    for word in re.findall(r"[a-z0-9_.\-]+", low):
        found.setdefault(word, Term(word, 1.5))
        for part in re.split(r"[._\-]+", word):
            if len(part) > 1:
                found.setdefault(part, Term(part, 1.0, False))
    for run in re.findall("[一-鿿]+", low):
        found.setdefault(run, Term(run, 1.8))
        pairs, weight = ((run[:2], run[2:]), 1.3) if len(run) == 4 else ([run[i : i + 2] for i in range(len(run) - 1)] if len(run) > 2 else (), 1.2)
        for pair in pairs:
            found.setdefault(pair, Term(pair, weight))
        for character in run:
            found.setdefault(character, Term(character, 0.3, False))
    return list(found.values())


def query_language(query: str) -> str | None:
    """The tag of the first language, in the table's order, that the query names as a word."""
    import re

    low = query.lower().strip()
    return next((tag for word, tag in LANGUAGES.items() if word in low.split() or re.search(rf"\b{re.escape(word)}\b", low)), None)


# --- the same for a column of queries: built-in expressions ------------------------------------------------------

WORD = "[\\p{L}\\p{N}_]"
TERM = "array<struct<term: string, weight: double, core: boolean>>"


def _term(text: Column, weight: float, core: bool = True) -> Column:
    return F.struct(text.alias("term"), F.lit(weight).alias("weight"), F.lit(core).alias("core"))


def _first_seen(terms: Column) -> Column:
    """Of terms with the same text the first one."""
    texts = F.transform(terms, lambda t: t["term"])
    return F.filter(terms, lambda t, i: F.array_position(texts, t["term"]) == i + 1)


def terms_of(query: Column) -> Column:
    """ARRAY<STRUCT<term, weight, core>>: query_terms of each query; a null one has none."""
    low, none = F.lower(F.coalesce(query, F.lit(""))), F.expr(f"cast(array() as {TERM})")

    def word(w: Column) -> Column:
        parts = F.filter(F.split(w, "[._\\-]+"), lambda p: F.length(p) > 1)
        return F.concat(F.array(_term(w, 1.5)), F.transform(parts, lambda p: _term(p, 1.0, False)))

    def run(r: Column) -> Column:
        halves = F.array(_term(F.substring(r, 1, 2), 1.3), _term(F.substring(r, 3, 2), 1.3))
        pairs = F.when(F.length(r) == 4, halves).when(F.length(r) > 2, F.transform(T.ngrams(r, 2), lambda p: _term(p, 1.2))).otherwise(none)
        return F.concat(F.array(_term(r, 1.8)), pairs, F.transform(T.ngrams(r, 1), lambda c: _term(c, 0.3, False)))

    words = F.transform(F.regexp_extract_all(low, F.lit("([a-z0-9_.\\-]+)"), 1), word)
    runs = F.transform(F.regexp_extract_all(low, F.lit(f"({T.CJK}+)"), 1), run)
    return _first_seen(F.concat(F.flatten(words), F.flatten(runs)))


def language_of(query: Column) -> Column:
    """query_language of each query: null where it names none."""
    import re

    low = F.lower(F.trim(query))
    words = F.split(low, "\\s+")
    found = None
    for word, tag in LANGUAGES.items():
        # word boundaries as letters and digits of any script make them; behind a mark there is one only before a letter
        end = f"(?!{WORD})" if word[-1].isalnum() else f"(?={WORD})"
        named = F.array_contains(words, word) | low.rlike(f"(?<!{WORD}){re.escape(word)}{end}")
        found = F.when(named, tag) if found is None else found.when(named, tag)
    return found


def _holds(part: str):
    return lambda t: F.contains(t["term"], F.lit(part))


def expanded(query: Column, terms: Column, clusters: list[tuple[list[str], list[str]]]) -> Column:
    """expand for each query and its terms: the terms, then at 0.9 the expansions of every cluster that the query or a term sets off."""
    more = []
    for triggers, words in clusters:
        hit = F.lit(False)
        for x in triggers:
            hit = hit | F.contains(F.coalesce(query, F.lit("")), F.lit(x)) | F.exists(terms, _holds(x))
        more.append(F.when(hit, F.array(*[_term(F.lit(w), 0.9, False) for w in words])).otherwise(F.expr(f"cast(array() as {TERM})")))
    return _first_seen(F.concat(terms, *more))
