"""Suffix-array dedup by two-stage sorting: removing long byte strings that an earlier document has.

A string of ``length`` bytes is keyed by its smallest k-byte hash (minimiser), so equal strings meet under one key
wherever they stand, and consecutive strings mostly share one. Documents exchange keys first (exchange.py) and only
text under keys that two documents have goes on, each distinct segment once from each group of documents. A part of the
key space then sorts the suffixes of its segments in two stages: only suffixes smaller than their successors are
compared, the others are induced by scanning buckets; adjacent common prefixes give the runs of equal strings and the
smallest document of each. Parts follow the size of the input, not a key's frequency; a passage that a third
of all documents share costs each group of documents one copy.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as ex
from . import textkit as tk

K = 16
SORT_BYTES = 2 << 20  # of text for each part that is sorted; key parts are larger
_LAST = np.iinfo(np.int64).max
_SEGMENTS = pa.schema([("g", pa.int32()), ("p", pa.int32()), ("n", pa.int32()), ("lengths", pa.binary()), ("docs", pa.binary()), ("bytes", pa.binary())])


def _words8(data: np.ndarray, count: int) -> np.ndarray:
    """The 8 bytes at each of the first ``count`` positions, as integers in byte order; data is padded by the caller."""
    return np.ndarray((count,), dtype="<u8", buffer=data.data, strides=(1,))


# --- suffix array ------------------------------------------------------------------------------------------------


def _sort_directly(text: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in order of their first ``depth`` bytes, by 8 bytes at a time; only ties go on."""
    padded = np.concatenate((text, np.zeros(depth + 16, np.uint8)))
    order = at.copy()
    tied = np.arange(len(at), dtype=at.dtype)
    group = np.zeros(len(at), at.dtype)
    for step in range(0, depth, 8):
        if not len(tied):
            break
        key = np.ndarray((len(text) + 1,), dtype=">u8", buffer=padded.data, offset=step, strides=(1,))[order[tied]].astype(np.uint64)
        o = np.lexsort((key, group)) if step else np.argsort(key, kind="stable")
        order[tied] = order[tied][o]
        key, group = key[o], group[o]
        new = np.ones(len(tied), bool)
        new[1:] = (key[1:] != key[:-1]) | (group[1:] != group[:-1])
        group = np.cumsum(new, dtype=at.dtype)
        alone = new & np.append(new[1:], True)
        tied, group = tied[~alone], group[~alone]
    return order


def two_stage_suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of a uint8 text in order of at least their first ``depth`` bytes (ties beyond in any order).

    Stage one sorts the suffixes that are smaller than their successors. Stage two scans the buckets of first bytes in
    order: the predecessor of a scanned suffix, where it is larger than its successor, takes the next free place at the front of its bucket.
    """
    n = len(text)
    place = np.int32 if n < 1 << 31 else np.int64
    if not n:
        return np.zeros(0, place)
    change = np.append(np.flatnonzero(text[1:] != text[:-1]), n - 1)  # the empty suffix is smaller than any
    rises = np.append(text[change[:-1] + 1] > text[change[:-1]], False)
    rising = np.repeat(rises, np.diff(change, prepend=-1))
    counts = np.bincount(text, minlength=256)
    start = np.concatenate(([0], np.cumsum(counts)))
    falling = np.bincount(text[~rising], minlength=256)
    order = np.empty(n, place)
    direct = _sort_directly(text, np.flatnonzero(rising).astype(place), depth)
    at = np.concatenate(([0], np.cumsum(counts - falling)))
    free = start[:-1].copy()
    order[free[text[-1]]] = n - 1
    free[text[-1]] += 1
    for c in np.flatnonzero(counts):
        low = level = start[c]
        while level < free[c]:  # what the bucket induces in itself: runs of its own byte
            now, level = order[level : free[c]], free[c]
            before = now[now > 0] - 1
            before = before[text[before] == c]
            order[free[c] : free[c] + len(before)] = before
            free[c] += len(before)
        order[free[c] : start[c + 1]] = direct[at[c] : at[c + 1]]
        bucket = order[low : start[c + 1]]
        before = bucket[bucket > 0] - 1
        before = before[(text[before] > c) & ~rising[before]]
        byte = text[before]
        o = np.argsort(byte, kind="stable")
        byte, before = byte[o], before[o]
        many = np.bincount(byte, minlength=256)
        first = np.concatenate(([0], np.cumsum(many)[:-1]))
        order[free[byte] + np.arange(len(byte)) - first[byte]] = before
        free += many
    return order


def common_prefixes(text: np.ndarray, order: np.ndarray, cap: int) -> np.ndarray:
    """Of each suffix and the one before it, the length of their common prefix, up to cap; 0 for the first."""
    padded = np.concatenate((text, np.zeros(cap + 16, np.uint8)))
    size = np.zeros(len(order), np.int64)
    open_ = np.arange(1, len(order))
    for step in range(0, cap, 8):
        words = np.ndarray((len(text) + 1,), dtype="<u8", buffer=padded.data, offset=step, strides=(1,))
        differ = words[order[open_]] ^ words[order[open_ - 1]]
        low = differ & (~differ + tk.U(1))  # the lowest bit that differs is in the first byte that does
        size[open_] += np.where(differ == 0, 8, np.floor(np.log2(np.maximum(low, tk.U(1)).astype(np.float64))).astype(np.int64) // 8)
        open_ = open_[differ == 0]
    return np.minimum(size, cap)


def smallest_owner(segments: list[bytes], owners: np.ndarray, length: int) -> list[np.ndarray]:
    """For each segment, of each of its strings of ``length`` bytes the smallest owner of a segment that has it too."""
    sizes = np.array([len(s) for s in segments], np.int64)
    text = np.frombuffer(b"\xff".join(segments) + b"\xff", np.uint8) + np.uint8(1)  # UTF-8 has no 0xFF: it becomes 0
    at = np.concatenate(([0], np.cumsum(sizes + 1)))[:-1]
    windows = np.maximum(0, sizes - length + 1)
    owner = np.full(len(text), -1, np.int32)
    owner[tk.ranges(at, windows)] = np.repeat(np.arange(len(segments)), windows)
    order = two_stage_suffix_array(text, length)
    order = order[owner[order] >= 0]
    best = np.full(len(text), _LAST)
    if len(order):
        first = np.flatnonzero(common_prefixes(text, order, length) < length)
        low = np.minimum.reduceat(owners[owner[order]], first)
        best[order] = np.repeat(low, np.diff(np.append(first, len(order))))
    return [best[a : a + w] for a, w in zip(at, windows)]


# --- documents ---------------------------------------------------------------------------------------------------


class _Runs:
    """Of a group of documents: the runs of consecutive strings that share a minimiser."""

    def __init__(self, table: pa.Table, length: int):
        self.data, self.off = tk.utf8(table["text"])
        ids = table["doc_id"].combine_chunks().fill_null(_LAST)
        self.ids = ids.to_numpy()
        starts, counts, keys, hashes, docs = [], [], [], [], []
        for first, data, off in tk.blocks(pa.LargeStringArray.from_buffers(len(self.off) - 1, pa.py_buffer(self.off), pa.py_buffer(self.data))):
            n = len(data) - length + 1
            if n <= 0:
                continue
            padded = np.concatenate((data, np.zeros(16, np.uint8)))
            w = _words8(padded, len(data) + 8)
            h = tk.mix(w[: len(data) - K + 1] * tk.U(0x9E3779B97F4A7C15) + tk.mix(w[8 : len(data) - K + 9]))
            span, low = 1, h
            while span * 2 <= length - K + 1:
                low = np.minimum(low[:-span], low[span:])
                span *= 2
            low = np.minimum(low[:n], low[length - K + 1 - span :][:n])
            ok = tk.within(off, length)
            new = np.ones(n, bool)
            new[1:] = (low[1:] != low[:-1]) | (ok[1:] != ok[:-1])
            at = np.flatnonzero(new)
            size = np.diff(np.append(at, n))
            at, size = at[ok[at]], size[ok[at]]
            starts.append(at + self.off[first])
            counts.append(size)
            keys.append(tk.mix(low[at]))  # minima crowd at the small end of the hash space: spread them over the parts again
            hashes.append(tk.span_hashes(data, at, at + size + length - 1))
            docs.append(first + np.searchsorted(off, at, side="right") - 1)
        join = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
        self.start, self.count, self.key, self.hash, self.doc = join(starts, np.int64), join(counts, np.int64), join(keys, np.uint64), join(hashes, np.uint64), join(docs, np.int64)

    def asked(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct keys, and whether two documents of the group have each."""
        keys, index = np.unique(self.key, return_inverse=True)
        low, high = np.full(len(keys), _LAST), np.full(len(keys), -1)
        np.minimum.at(low, index, self.doc)
        np.maximum.at(high, index, self.doc)
        return keys, (low != high).astype(np.uint8)

    def keep(self, shared: np.ndarray) -> None:
        """Go on with the runs whose key is shared, and number their distinct texts in order of key and hash."""
        keep = shared[np.searchsorted(np.unique(self.key), self.key)] > 0 if len(self.key) else np.zeros(0, bool)
        for name in ("start", "count", "key", "hash", "doc"):
            setattr(self, name, getattr(self, name)[keep])
        order = np.lexsort((self.count, self.hash, self.key))
        new = np.ones(len(order), bool)
        k, h, c = self.key[order], self.hash[order], self.count[order]
        new[1:] = (k[1:] != k[:-1]) | (h[1:] != h[:-1]) | (c[1:] != c[:-1])
        self.number = np.empty(len(order), np.int64)
        self.number[order] = np.cumsum(new) - 1
        self.first = order[new]


def _ask(length: int, parts: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        keys, several = _Runs(table, length).asked()
        return ex.ask_table(key[0].as_py(), keys, several, parts)

    return run


def _shared(index: np.ndarray, several: np.ndarray, sender: np.ndarray) -> np.ndarray:
    return ((np.bincount(index) > 1) | (np.bincount(index, weights=several) > 0)).astype(np.uint8)[index]


def _segments(length: int, parts: int):
    def run(key: tuple, table: pa.Table, replies: pa.Table) -> pa.Table:
        g, out = key[0].as_py(), []
        if table.num_rows:
            runs = _Runs(table, length)
            runs.keep(ex.answers(replies, np.uint8))
            low = np.full(len(runs.first), _LAST)
            np.minimum.at(low, runs.number, runs.ids[runs.doc])
            start, size = runs.start[runs.first], runs.count[runs.first] + length - 1
            at = np.concatenate(([0], ex.cuts(runs.key[runs.first], parts), [len(start)]))
            for p in np.flatnonzero(np.diff(at)):
                s = slice(at[p], at[p + 1])
                out.append((g, int(p), int(at[p + 1] - at[p]), tk.pack(size[s]), tk.pack(low[s]), tk.pack(runs.data[tk.ranges(start[s], size[s])])))
        cols = list(zip(*out)) or [()] * 6
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _SEGMENTS)], schema=_SEGMENTS)

    return run


def _sort_part(length: int):
    def run(table: pa.Table) -> pa.Table:
        number, owners, sent = {}, [], []
        for sizes, docs, raw in zip(*(table[c].to_pylist() for c in ("lengths", "docs", "bytes"))):
            text, at, own = tk.unpack(raw, np.uint8).tobytes(), 0, []
            for size, doc in zip(tk.unpack(sizes, np.int64).tolist(), tk.unpack(docs, np.int64).tolist()):
                i = number.setdefault(text[at : at + size], len(number))
                at += size
                if i == len(owners):
                    owners.append(doc)
                elif doc < owners[i]:
                    owners[i] = doc
                own.append(i)
            sent.append(own)
        best = smallest_owner(list(number), np.array(owners, np.int64), length)
        data = [tk.pack(np.concatenate([best[i] for i in own]), delta=True) for own in sent]
        return pa.Table.from_arrays([table["g"].combine_chunks(), table["p"].combine_chunks(), table["n"].combine_chunks(), pa.array(data, pa.binary())], schema=ex._REPLY)

    return run


def _apply(length: int, texts: bool, keep: tuple[str, ...]):
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", *keep]

    def run(key: tuple, table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.Table.from_arrays([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string() if texts else pa.binary())] + [table[c].combine_chunks() for c in keep], names=names)
        runs = _Runs(table, length)
        kind = replies["kind"].to_numpy()
        runs.keep(ex.answers(replies.filter(pa.array(kind == 0)), np.uint8))
        found = replies.filter(pa.array(kind == 1))
        order = np.argsort(found["p"].to_numpy())
        blobs = found["data"].to_pylist()
        low = np.concatenate([tk.unpack(blobs[i], np.int64, delta=True) for i in order]) if len(order) else np.zeros(0, np.int64)
        at = np.concatenate(([0], np.cumsum(runs.count[runs.first])))
        window = tk.ranges(runs.start, runs.count)
        low = low[tk.ranges(at[runs.number], runs.count)]
        gone = window[low < np.repeat(runs.ids[runs.doc], runs.count)]
        cover = np.zeros(len(runs.data) + length + 1, np.int32)
        cover[gone] += 1  # windows are distinct positions, those of different runs too
        edge = cover.copy()
        edge[length:] -= cover[:-length]
        removed = np.cumsum(edge)[: len(runs.data)] > 0
        if texts:
            removed = whole_characters(runs.data, removed)
        total = np.concatenate(([0], np.cumsum(removed)))
        begin = removed.copy()
        begin[1:] &= ~removed[:-1]
        inner = runs.off[:-1][runs.off[:-1] < len(removed)]
        begin[inner] |= removed[inner]
        spans = np.concatenate(([0], np.cumsum(begin)))
        kept_at = runs.off - total[runs.off]
        kept = runs.data[~removed].tobytes()
        parts = [kept[a:b] for a, b in zip(kept_at[:-1], kept_at[1:])]
        out = pa.array([p if v else None for p, v in zip(parts, table["text"].is_valid().to_pylist())], pa.binary()).cast(pa.string()) if texts else pa.array([hashlib.sha256(p).digest() for p in parts], pa.binary())
        return pa.Table.from_arrays([table["doc_id"].combine_chunks(), pa.array(np.diff(runs.off)), pa.array(np.diff(total[runs.off]), pa.int64()), pa.array(np.diff(spans[runs.off]), pa.int64()), out, *(table[c].combine_chunks() for c in keep)], names=names)

    return run


def whole_characters(data: np.ndarray, removed: np.ndarray) -> np.ndarray:
    """Of the removed bytes those of characters that go wholly, so that what is left is valid UTF-8."""
    lead = (data & 0xC0) != 0x80
    number = np.cumsum(lead) - 1
    kept = np.zeros(int(number[-1]) + 1 if len(number) else 0, bool)
    kept[number[~removed]] = True
    return ~kept[number] if len(number) else removed


def remove_repeats(docs: DataFrame, length: int = 50, texts: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) for every row of documents.

    docs: doc_id long, text string; of other columns those named by keep are carried along (as ``name_in`` where the result has that name). Each byte goes that is covered by a string of ``length``
    bytes which also starts in a document of a smaller doc_id, judged on the input; matches never cross documents.
    texts: kept is the text without them, where a character goes only if all its bytes do; else kept is the SHA-256 of
    the bytes left, and any byte can go. A null text is empty (kept null if texts); a null doc_id counts as larger than
    any other; rows that repeat a doc_id do not count against each other. length must be at least 24.
    """
    if length < K + 8:
        raise ValueError(f"length must be at least {K + 8}")
    tk.ship(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *[F.col(c).alias(f"__{i}") for i, c in enumerate(keep)])
    carried = tuple(docs.columns[2:])
    grouped, parts, _ = ex.grouped(docs, "doc_id", "text")
    whole = ex.grouped(docs, *docs.columns)[0] if keep else grouped
    kept = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields[2:])
    sorts = parts * (ex.PART_BYTES // SORT_BYTES)
    shared = ex.merge(grouped.groupBy("g").applyInArrow(tk.tidy(_ask(length, parts)), ex.ASK), _shared, np.uint8)
    segments = grouped.groupBy("g").cogroup(shared.groupBy("g")).applyInArrow(tk.tidy(_segments(length, sorts)), "g int, p int, n int, lengths binary, docs binary, bytes binary")
    found = segments.groupBy("p").applyInArrow(tk.tidy(_sort_part(length)), ex.REPLY)
    replies = shared.withColumn("kind", F.lit(0)).unionByName(found.withColumn("kind", F.lit(1)))
    found = whole.groupBy("g").cogroup(replies.groupBy("g")).applyInArrow(tk.tidy(_apply(length, texts, carried)), f"doc_id long, n_bytes long, n_removed long, n_spans long, kept {'string' if texts else 'binary'}{kept}")
    made = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept")
    return found.toDF(*made, *tk.kept_names(keep, made))
