"""The dictionary linker: a dictionary of note names, and first mentions of them in notes that do not link them yet.

All terms are found in one pass over a note by an Aho-Corasick automaton, which is compiled on the driver and broadcast. The size of the dictionary is
checked first: one of more than ``DICTIONARY_BYTES`` is dealt into as many automata as stay within it, and the notes are
read once for each, so what a task holds is bounded and nothing is joined. What is left to do for one note, in order, is a function of that note and its own terms.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.runtime import ship

DICTIONARY_BYTES = 64 << 20

# Words that are too general to be linked.
IGNORED = [
    "the", "and", "for", "with", "from", "that", "this", "rule", "rules", "guide", "notes", "note", "code", "file", "path", "test", "tests",
    "tool", "tools", "lang", "topic", "category", "status", "draft", "stable", "archived", "audience", "both", "agent", "human", "true",
    "false", "null", "none", "date", "name", "go", "py", "rs", "ts", "js", "sh", "c", "cpp", "md", "src", "bin", "lib", "git", "bash", "rust",
    "python", "typescript", "golang", "skill", "home", "agents", "review-log", "log", "logs", "readme",
]

_LINK = re.compile(r"!?\[\[([^\]|#]+)[^\]]*\]\]")
_KEPT = re.compile(r"(\[\[[^\]]+\]\]|!?\[[^\]]*\]\([^)]+\)|`[^`]+`|<[^>]+>|https?://[^\s)\]]+)")
_PLAIN_TERM = re.compile(r"[A-Za-z0-9_\-]+")


def dictionary(notes: DataFrame) -> DataFrame:
    """(term, target, source) of notes (rel, title, tags): stems of 4 or more characters, titles of 4 to 40, and hyphenated
    tag tails of 5 or more. A term that several notes offer goes to the first by path, then stem, title, tag order."""
    path = F.regexp_replace("rel", "\\.md$", "")
    stem, title = F.trim(F.substring_index(path, "/", -1)), F.regexp_replace(F.trim("title"), "^['\"]+|['\"]+$", "")
    entry = lambda i, term, target: F.struct(F.lit(i).alias("i"), term.alias("term"), target.alias("target"))
    named = F.when(F.length(title) <= 40, F.array(entry(1, title, F.concat(path, F.lit("|"), title))))
    tails = F.transform(F.filter(F.coalesce("tags", F.expr(T.EMPTY)), lambda t: t.contains("/")), lambda t: F.substring_index(F.trim(t), "/", -1))
    tails = F.transform(F.filter(tails, lambda t: (F.length(t) >= 5) & t.contains("-")), lambda t, i: entry(2, t, path).withField("i", i + 2))
    none = F.slice(F.array(entry(0, stem, path)), 2, 1)
    offers = F.concat(F.array(entry(0, stem, path)), F.coalesce(named, none), F.coalesce(tails, none))
    rows = notes.select("rel", F.explode(offers).alias("o")).select("rel", "o.*").where((F.length("term") >= 4) & ~F.lower("term").isin(IGNORED))
    return rows.groupBy("term").agg(F.min(F.struct("rel", "i", "target")).alias("f")).select("term", F.col("f.target").alias("target"), F.col("f.rel").alias("source"))


def _automata(words: DataFrame) -> list[Broadcast]:
    """Compiled automata over the terms of a dictionary (term, target, source), each from at most DICTIONARY_BYTES of it; empty and null terms are left out."""
    import ahocorasick

    kept = words.select("term", "target", "source").where("term <> ''")
    size = kept.agg(F.sum(F.octet_length("term") + F.octet_length("target") + F.octet_length("source") + 64)).first()[0] or 0
    shards, out = max(1, -(-size // DICTIONARY_BYTES)), []
    for i in range(shards):
        automaton = ahocorasick.Automaton()
        for r in kept.where(F.pmod(F.xxhash64("term"), F.lit(shards)) == i).toLocalIterator():
            automaton.add_word(r.term, (r.term, r.target, r.source))
        if len(automaton):
            automaton.make_automaton()
            out.append(words.sparkSession.sparkContext.broadcast(automaton))
    return out


def _found(automaton, text: str) -> dict[tuple[str, str, str], list[int]]:
    """Of each (term, target, source) that a text has its places in it, overlapping ones too."""
    out: dict[tuple[str, str, str], list[int]] = {}
    for end, word in automaton.iter(text):
        out.setdefault(word, []).append(end - len(word[0]) + 1)
    return out


def _apart(places: list[int], length: int) -> int:
    """How many of the ascending places of a term are left when, from the left, each takes its characters away."""
    n, free = 0, 0
    for at in places:
        if at >= free:
            n, free = n + 1, at + length
    return n


def mentions(notes: DataFrame, words: DataFrame, overlapping: bool = True) -> DataFrame:
    """(rel, term, target, source, n, first): terms whose characters a note has somewhere, how often and where first (from 0); its own are left out.

    overlapping: whether places of a term that overlap each other all count; else those count that replacing the term from the left would meet.
    Null contents have none, repeated notes are reported each time; a note without a rel is left out, as is a dictionary's empty term.
    """
    ship(notes.sparkSession)
    rows = notes.select("rel", "content").where("rel IS NOT NULL AND content IS NOT NULL")
    kind = notes.schema["rel"].dataType

    def scan(known: Broadcast):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at, out = [], []
                for i, text in enumerate(batch.column(1).to_pylist()):
                    for (term, target, source), places in _found(known.value, text).items():
                        at.append(i)
                        out.append((term, target, source, len(places) if overlapping else _apart(places, len(term)), places[0]))
                columns = [pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * 5, (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()))]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *columns], names=["rel", "term", "target", "source", "n", "first"])

        return rows.mapInArrow(run, f"rel {kind.simpleString()}, term string, target string, source string, n long, first long")

    none = notes.sparkSession.createDataFrame([], f"rel {kind.simpleString()}, term string, target string, source string, n long, first long")
    return reduce(DataFrame.unionByName, map(scan, _automata(words)), none).where(F.col("source") != F.col("rel"))


def _plain_lines(text: str) -> Iterator[tuple[int, str, bool]]:
    """(number, line with its end, may be linked): not in fields, fences, headings and comments."""
    fields = fence = False
    for number, line in enumerate(text.splitlines(keepends=True), 1):
        bare = line.strip()
        if fields or (number == 1 and bare == "---"):
            fields = number == 1 or bare != "---"
            yield number, line, False
        elif bare[:3] in ("```", "~~~"):
            fence = not fence
            yield number, line, False
        else:
            yield number, line, not (fence or bare[:1] == "#" or (bare[:4] == "<!--" and bare[-3:] == "-->"))


def _pattern(term: str) -> re.Pattern:
    """ASCII terms stand between word boundaries, others only outside brackets and code marks."""
    if _PLAIN_TERM.fullmatch(term):
        return re.compile(rf"(?<![\[`\w\-/]){re.escape(term)}(?![\]`\w\-.])")
    return re.compile(rf"(?<![\[`]){re.escape(term)}(?![\]`])")


def link_text(text: str, terms: list[tuple[str, str]]) -> tuple[str, list[tuple[int, str, str]]]:
    """The text with a link at the first mention of each (term, target), longest term first, and the links made."""
    linked = {t for whole in _LINK.findall(text) for t in (whole.strip(), whole.strip().rsplit("/", 1)[-1])}
    left = [(term, target, _pattern(term)) for term, target in sorted(terms, key=lambda x: (-len(x[0]), x[0])) if target not in linked and target.rsplit("/", 1)[-1] not in linked]
    out, made = [], []
    for number, line, open_ in _plain_lines(text):
        parts = _KEPT.split(line) if open_ and left else [line]
        for i in range(0, len(parts), 2) if open_ and left else ():
            rest = []
            for term, target, pattern in left:
                new, n = pattern.subn(lambda m, target=target: f"[[{target}]]", parts[i], count=1)
                if n:
                    parts[i] = new
                    made.append((number, term, f"[[{target}]]"))
                else:
                    rest.append((term, target, pattern))
            left = rest
        out.append("".join(parts))
    return "".join(out), made


def link(notes: DataFrame, words: DataFrame) -> DataFrame:
    """(rel, content, links ARRAY<STRUCT<line, term, link>>) of notes (rel, content) that get a link.

    A dictionary of one automaton is used where the notes are read, without a shuffle; terms of a larger one come together by note first.
    """
    spark = notes.sparkSession
    ship(spark)
    kind = notes.schema["rel"].dataType.simpleString()
    schema = f"rel {kind}, content string, links array<struct<line:int,term:string,link:string>>"
    automata = _automata(words)
    rows = notes.select("rel", "content").where("rel IS NOT NULL AND content IS NOT NULL")
    if len(automata) > 1:
        per_note = mentions(notes, words).groupBy("rel").agg(F.collect_set(F.struct("term", "target")).alias("terms"))  # distinct names: bounded by the note's text
        rows = rows.join(per_note, "rel")
    known = automata[0] if len(automata) == 1 else None

    def terms_of(rel, text: str) -> list[tuple[str, str]]:
        return [(term, target) for term, target, source in _found(known.value, text) if source != str(rel)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            terms = map(terms_of, b["rel"], b["content"]) if known else ([(t["term"], t["target"]) for t in ts] for ts in b["terms"])
            done = [link_text(c, ts) for c, ts in zip(b["content"], terms)]
            links = [[{"line": n, "term": t, "link": w} for n, t, w in made] for _, made in done]
            yield pd.DataFrame({"rel": b["rel"], "content": [c for c, _ in done], "links": links})[[bool(m) for m in links]]

    return rows.mapInPandas(run, schema) if automata else spark.createDataFrame([], schema)
