"""Language-model scoring: stupid backoff (Brants et al. 2007) over the corpus's own n-gram counts.

Counts of all n-grams up to the order are kept in tables partitioned by hash; the n-grams of each document
are joined to them through key exchanges (exchange.py) and the scores summed by document. An n-gram counts as seen
from ``least`` occurrences on, single words always. Counts of one and two words are exchanged first; longer n-grams
only where both of their parts were seen, since an n-gram is no more frequent than its parts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as ex
from . import textkit as tk

BACKOFF = 0.4
PART_BYTES = 4 << 20
GROUP_BYTES = 8 << 20  # larger groups combine more equal n-grams before anything moves
LEAST_GROUPS = 64


class _Grams:
    """The n-grams of a group of documents, each order's by the word where it ends."""

    def __init__(self, table: pa.Table, order: int):
        found, counts, self.valid = [[] for _ in range(order)], [], [[] for _ in range(order)]
        for _, data, off in tk.blocks(table["text"]):
            data = tk.lower(data)
            words = tk.find_words(data, off, tk.SPACE_WORDS)
            hashes = tk.span_hashes(data, words.start, words.end)
            counts.append(words.counts)
            for n in range(1, order + 1):
                short = np.zeros(min(n - 1, len(hashes)), np.uint64)
                grams = tk.ngram_hashes(hashes, n)
                found[n - 1] += [short, grams]
                self.valid[n - 1] += [short > 0, tk.within(words.doc_off, n)[: len(grams)]]
        join = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
        self.counts = join(counts, np.int64)
        self.hashes = [join(x, np.uint64) for x in found]
        self.valid = [join(x, bool) for x in self.valid]
        self.seen = [np.zeros(len(self.hashes[0])) for _ in range(order)]

    def round(self, first: int, last: int, least: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Keys of the orders first..last, how often each occurs here, and the words where n-grams are asked.

        From the third order on only n-grams of which both parts were seen are asked: no other can be.
        """
        asked = []
        for n in range(first, last + 1):
            ok = self.valid[n - 1]
            if n > 2:
                part = self.seen[n - 2] >= least
                ok = ok & part & np.append(False, part[:-1])
            asked.append(np.flatnonzero(ok))
        keys, self.index, times = np.unique(np.concatenate([self.hashes[first - 1 + i][at] for i, at in enumerate(asked)]), return_inverse=True, return_counts=True)
        return keys, times, asked

    def answer(self, first: int, asked: list[np.ndarray], counts: np.ndarray) -> None:
        at = 0
        for i, words in enumerate(asked):
            self.seen[first - 1 + i][words] = counts[self.index[at : at + len(words)]]
            at += len(words)


def _rounds(order: int) -> list[tuple[int, int]]:
    return [(1, min(2, order)), *((n, n) for n in range(3, order + 1))]


def _answered(table: pa.Table, replies: pa.Table | None, order: int, done: int, least: int) -> _Grams:
    """The n-grams with the counts of the rounds so far."""
    grams = _Grams(table, order)
    for r, (first, last) in enumerate(_rounds(order)[:done]):
        _, _, asked = grams.round(first, last, least)
        grams.answer(first, asked, ex.answers(replies.filter(pa.array(replies["round"].to_numpy() == r)), np.uint64))
    return grams


def _ask(order: int, done: int, least: int, parts: int):
    def run(key: tuple, table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            return ex._ASK.empty_table()
        first, last = _rounds(order)[done]
        keys, times, _ = _answered(table, replies, order, done, least).round(first, last, least)
        return ex.ask_table(key[0].as_py(), keys, times.astype(np.uint32), parts)

    return run


def _total(index: np.ndarray, pay: np.ndarray, sender: np.ndarray) -> np.ndarray:
    return np.bincount(index, weights=pay).astype(np.uint64)[index]


def _score(order: int, least: int, n_words: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_backoff", pa.int64()), ("log_score", pa.float64())])

    def run(key: tuple, table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            return schema.empty_table()
        grams = _answered(table, replies, order, len(_rounds(order)), least)
        count = grams.seen
        score = np.log(np.maximum(count[0], 1) / max(1, n_words))
        depth = np.ones(len(score), np.int64)  # the order that each word is scored at
        for n in range(2, order + 1):
            context = np.append(0.0, count[n - 2][:-1])
            seen = count[n - 1] >= least
            score[seen] = np.log(count[n - 1][seen] / context[seen])
            depth[seen] = n
        top = np.minimum(order, 1 + np.arange(len(score)) - np.repeat(np.cumsum(grams.counts) - grams.counts, grams.counts))
        back = top - depth
        score += back * np.log(BACKOFF)
        doc = np.repeat(np.arange(len(grams.counts)), grams.counts)
        steps = np.concatenate(([0], np.cumsum(back)))
        at = np.concatenate(([0], np.cumsum(grams.counts)))
        return pa.Table.from_arrays([table["doc_id"].combine_chunks(), pa.array(grams.counts, pa.int64()), pa.array(np.diff(steps[at]), pa.int64()), pa.array(np.bincount(doc, weights=score, minlength=len(grams.counts)))], schema=schema)

    return run


def backoff_scores(docs: DataFrame, order: int = 3, least: int = 2) -> DataFrame:
    """(doc_id, n_words, n_backoff, log_score) for every row of documents.

    docs: doc_id long, text string; other columns are ignored. Words are runs of bytes other than ASCII white space,
    with A-Z in lower case; n-grams stay inside a document. A word's score is count(n-gram) / count(context) at the
    longest n-gram seen, times 0.4 for each order that it had to back off; log_score is the sum of their
    natural logarithms and n_backoff the number of steps. Null and empty texts have no words and score 0. All rows
    count, repeated ones each time; an empty table gives an empty one.
    """
    tk.ship(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    grouped, parts, _ = ex.grouped(docs, "doc_id", "text", part_bytes=PART_BYTES, group_bytes=GROUP_BYTES, least=LEAST_GROUPS)
    n_words = docs.agg(F.sum(n_words_of("text")).alias("n")).first()["n"] or 0
    replies = docs.sparkSession.createDataFrame([], "g int, p int, n int, data binary, round int")
    for done in range(len(_rounds(order))):
        asks = grouped.groupBy("g").cogroup(replies.groupBy("g")).applyInArrow(tk.tidy(_ask(order, done, least, parts)), ex.ASK)
        replies = replies.unionByName(ex.merge(asks, _total, np.uint32).withColumn("round", F.lit(done)))
    return grouped.groupBy("g").cogroup(replies.groupBy("g")).applyInArrow(tk.tidy(_score(order, least, int(n_words))), "doc_id long, n_words long, n_backoff long, log_score double")


def n_words_of(column: str) -> F.Column:
    """Words of a text: white space runs after a word, plus a last word."""
    plain = F.translate(F.col(column), "\t\n\x0b\x0c\r", "     ")
    return F.when(F.col(column).isNull(), F.lit(0)).otherwise(F.size(F.array_remove(F.split(plain, " "), "")))
