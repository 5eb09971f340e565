"""Substring dedup over sliding sentence spans.

Every run of ``size`` consecutive sentences is hashed, runs are joined over the corpus through a key exchange
(exchange.py), and sentences covered by a repeated run other than its first occurrence go. With ``words`` every run of that many words is hashed too,
wherever its sentences begin and end, and the words of repeated ones go.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as ex
from . import textkit as tk

_WORDS = tk.SPACE_WORDS.copy()
_WORDS[[33, 46, 63]] = False
_BREAK = np.zeros(256, np.int32)
_BREAK[[10, 33, 46, 63]] = 1
_LAST = np.iinfo(np.int64).max


class _Sentences:
    """Sentences of a group: bytes where each begins, its document, and hashes of the spans."""

    def __init__(self, table: pa.Table, size: int, n: int = 0):
        self.ids = table["doc_id"].combine_chunks().fill_null(_LAST).to_numpy()
        starts, docs, hashes = [], [], []
        word_start, word_end, word_doc, word_sentence, run_at, run_index, runs = ([] for _ in range(7))
        n_words = n_sentences = 0
        offsets = tk.utf8(table["text"])[1]
        for first, data, off in tk.blocks(table["text"]):
            data = tk.lower(data)
            words = tk.find_words(data, off, _WORDS)
            if not len(words.start):
                continue
            doc = np.repeat(np.arange(len(off) - 1), words.counts)
            piece = np.cumsum(_BREAK[data])[words.start]
            new = np.ones(len(piece), bool)
            new[1:] = (piece[1:] != piece[:-1]) | (doc[1:] != doc[:-1])
            at = np.flatnonzero(new)
            own = tk.span_hashes(data, words.start, words.end)
            size_of = np.diff(np.append(at, len(piece)))
            starts.append(words.start[at] + offsets[first])
            docs.append(doc[at] + first)
            hashes.append(tk.mix(tk.fold(own, size_of) + size_of.astype(np.uint64)))
            if n:
                found = tk.ngram_hashes(own, n)
                place = np.flatnonzero(tk.within(words.doc_off, n)[: len(found)])
                run_at.append(place + n_words)
                run_index.append(place - words.doc_off[doc[place]])
                runs.append(found[place])
            word_start.append(words.start + offsets[first])
            word_end.append(words.end + offsets[first])
            word_doc.append(doc + first)
            word_sentence.append(np.cumsum(new) - 1 + n_sentences)
            n_words += len(piece)
            n_sentences += len(at)
        join = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
        self.start, self.doc = join(starts, np.int64), join(docs, np.int64)
        self.doc_off = np.searchsorted(self.doc, np.arange(len(self.ids) + 1))
        grams = tk.ngram_hashes(join(hashes, np.uint64), size)
        self.at = np.flatnonzero(tk.within(self.doc_off, size)[: len(grams)])
        self.index = self.at - self.doc_off[self.doc[self.at]]
        self.word_start, self.word_end, self.word_doc, self.word_sentence, self.run_at = (join(x, np.int64) for x in (word_start, word_end, word_doc, word_sentence, run_at))
        self.index = np.concatenate((self.index, join(run_index, np.int64)))
        self.keys, self.key = np.unique(np.concatenate((grams[self.at], join(runs, np.uint64))), return_inverse=True)
        owner = self.ids[np.concatenate((self.doc[self.at], self.word_doc[self.run_at]))]
        order = np.lexsort((np.arange(len(owner)), self.index, owner, self.key))
        first = np.searchsorted(self.key[order], np.arange(len(self.keys)))
        self.first = order[first] if len(order) else order
        self.owner = owner


_FIRST = np.dtype([("doc", "<i8"), ("index", "<i8"), ("many", "<i8")])


def _ask(size: int, n: int, parts: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        s = _Sentences(table, size, n)
        pay = np.zeros(len(s.keys), _FIRST)
        pay["doc"], pay["index"] = s.owner[s.first], s.index[s.first]
        pay["many"] = np.bincount(s.key, minlength=len(s.keys)) > 1
        return ex.ask_table(key[0].as_py(), s.keys, pay, parts)

    return run


def _repeated(index: np.ndarray, pay: np.ndarray, sender: np.ndarray) -> np.ndarray:
    """0: the only occurrence; 1: repeated, the first is elsewhere; 2: repeated, the first is this group's."""
    many = (np.bincount(index) > 1) | (np.bincount(index, weights=pay["many"]) > 0)
    order = np.lexsort((sender, pay["index"], pay["doc"], index))
    lead = np.zeros(len(index), bool)
    lead[order[np.flatnonzero(np.diff(index[order], prepend=-1))]] = True
    return np.where(many[index], 1 + lead, 0).astype(np.uint8)


def _apply(size: int, n: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_sentences", pa.int64()), ("removed", pa.list_(pa.int64())), ("n_words_removed", pa.int64()), ("kept", pa.string())])

    def run(key: tuple, table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            return schema.empty_table()
        s = _Sentences(table, size, n)
        code = ex.answers(replies, np.uint8)
        gone = code[s.key] > 0 if len(s.key) else np.zeros(0, bool)
        gone[s.first[code == 2]] = False
        first_at = s.at[gone[: len(s.at)]]
        sentence = np.zeros(len(s.start), bool)
        sentence[tk.ranges(first_at, np.full(len(first_at), size))] = True
        lost = sentence[s.word_sentence]
        if n:
            run_at = s.run_at[gone[len(s.at) :]]
            edge = np.bincount(run_at, minlength=len(lost) + 1) - np.bincount(run_at + n, minlength=len(lost) + 1)
            lost |= edge.cumsum()[: len(lost)] > 0
        n_lost = np.bincount(s.word_sentence, weights=lost, minlength=len(s.start))
        whole = n_lost == np.bincount(s.word_sentence, minlength=len(s.start))
        # bytes that go: whole sentences up to the next one, and runs of words up to the last of them
        data, off = tk.utf8(table["text"])
        word = lost & ~whole[s.word_sentence]
        word_end, on = s.word_end.copy(), np.flatnonzero(word[:-1] & word[1:] & (s.word_doc[:-1] == s.word_doc[1:]))
        word_end[on] = s.word_start[on + 1]
        end = np.append(s.start[1:], 0)
        last = s.doc_off[1:][np.diff(s.doc_off) > 0] - 1
        end[last] = off[1:][np.diff(s.doc_off) > 0]
        cut = np.zeros(len(data) + 1, np.int64)
        for at, by in ((s.start[whole], 1), (end[whole], -1), (s.word_start[word], 1), (word_end[word], -1)):
            np.add.at(cut, at, by)
        stays = cut.cumsum()[:-1] == 0
        kept_at = np.concatenate(([0], np.cumsum(stays)))[off]
        kept = data[stays].tobytes()
        valid = table["text"].is_valid().to_pylist()
        texts = [kept[kept_at[d] : kept_at[d + 1]] if valid[d] else None for d in range(len(valid))]
        removed = [np.flatnonzero(n_lost[a:b]) for a, b in zip(s.doc_off[:-1], s.doc_off[1:])]
        words = np.bincount(s.word_doc, weights=lost, minlength=len(valid)).astype(np.int64)
        return pa.Table.from_arrays([table["doc_id"].combine_chunks(), pa.array(np.diff(s.doc_off)), pa.array(removed, pa.list_(pa.int64())), pa.array(words), tk.to_strings(texts)], schema=schema)

    return run


def remove_repeated_spans(docs: DataFrame, size: int = 3, words: int = 0) -> DataFrame:
    """(doc_id, n_sentences, removed, n_words_removed, kept) for every row of documents.

    docs: doc_id long, text string; other columns are ignored. A sentence is what stands between [.!?] and line feeds
    and has a word; sentences are equal if their words are, with A-Z in lower case. Of the runs of ``size`` sentences
    that are equal the first is the one with the smallest (doc_id, position); the sentences of any other go. removed has the
    positions of sentences that lose words, n_words_removed counts these, kept is the text without them. Null and empty texts, and those of fewer sentences, stay as they are; a null
    doc_id counts as the largest; rows that repeat a doc_id are ordered by position, ties in any fixed order.
    With words, the words of every run of so many equal ones but the first go too, and what is left of their sentences stays.
    What repeats itself without a break keeps one period.
    """
    tk.ship(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    grouped, parts, _ = ex.grouped(docs, "doc_id", "text")
    replies = ex.merge(grouped.groupBy("g").applyInArrow(tk.tidy(_ask(size, words, parts)), ex.ASK), _repeated, _FIRST)
    return grouped.groupBy("g").cogroup(replies.groupBy("g")).applyInArrow(tk.tidy(_apply(size, words)), "doc_id long, n_sentences long, removed array<long>, n_words_removed long, kept string")
