"""URL filters: host and path rules, then a weighted vocabulary counted by an Aho-Corasick automaton."""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk

# The default vocabulary.
STRICT = ("porn", "porno", "xxx", "hentai", "milf", "blowjob", "camgirl", "gangbang", "bdsm", "onlyfans-leak")
SOFT = ("adult", "sex", "sexy", "nude", "naked", "escort", "casino", "poker", "betting", "jackpot", "viagra", "cialis", "hot", "girls", "dating", "hookup", "fetish", "erotic", "torrent", "warez", "crack", "keygen", "payday", "replica")

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@dataclass(frozen=True)
class Rule:
    """verdict "allow" or "block" for a host, its subdomains, and paths that start with this path."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path); both empty without "://"."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest, n = url[at + 3 :], len(url) - at - 3
    end = min((i for c in "?#" if (i := rest.find(c)) >= 0), default=n)
    slash = rest.find("/", 0, end)
    host_end = end if slash < 0 else slash
    return rest[:host_end].translate(_LOWER), rest[host_end:end]


def matching_rule(host: str, path: str, rules: tuple[Rule, ...]) -> Rule | None:
    """The longest rule that fits; of equally long ones the first in the list."""
    fits = (r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path))
    return max(fits, key=lambda r: len(r.text), default=None)


class Vocabulary:
    """Counts the distinct strict and soft terms of a lower-cased URL that stand between non-alphanumerics."""

    def __init__(self, strict=STRICT, soft=SOFT):
        import ahocorasick

        self.machine = ahocorasick.Automaton()
        for kind, terms in ((0, soft), (1, strict)):  # a term in both lists is strict
            for term in terms:
                self.machine.add_word(term, (kind, term))
        if len(self.machine):
            self.machine.make_automaton()

    def count(self, url: str) -> tuple[int, int]:
        found = set()
        if len(self.machine):
            for end, (kind, term) in self.machine.iter(url):
                start = end - len(term)
                if not (start >= 0 and _joins(url[start])) and not (end + 1 < len(url) and _joins(url[end + 1])):
                    found.add((kind, term))
        strict = sum(kind for kind, _ in found)
        return strict, len(found) - strict


def _joins(c: str) -> bool:
    return "a" <= c <= "z" or "0" <= c <= "9"


def judge_urls(pages: DataFrame, rules: tuple[Rule, ...], strict=STRICT, soft=SOFT, least_soft: int = 2) -> DataFrame:
    """(page_id, host, path, rule, verdict, n_strict, n_soft) for every row of pages.

    pages: page_id long, url string; other columns are ignored. A fitting rule decides; else one strict term
    or ``least_soft`` distinct soft ones anywhere in the URL block it. A null or empty URL, or one without "://", has
    an empty host and path and no rule; repeated rows are judged alike; equally long rules: the first.
    """
    tk.ship(pages.sparkSession)
    schema = pa.schema([("page_id", pa.int64()), *((c, pa.string()) for c in ("host", "path", "rule", "verdict")), ("n_strict", pa.int64()), ("n_soft", pa.int64())])
    strict, soft = tuple(strict), tuple(soft)

    def run(batches):
        words = Vocabulary(strict, soft)
        for batch in batches:
            out = []
            for url in batch.column("url").to_pylist():
                host, path = split_url(url)
                rule = matching_rule(host, path, rules)
                hard, light = words.count((url or "").translate(_LOWER))
                verdict = rule.verdict if rule else "block" if hard or light >= least_soft else "allow"
                out.append((host, path, rule.text if rule else None, verdict, hard, light))
            cols = list(zip(*out)) or [()] * 6
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), *(pa.array(c, f.type) for c, f in zip(cols, list(schema)[1:]))], schema=schema)

    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    return pages.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string, n_strict long, n_soft long")
