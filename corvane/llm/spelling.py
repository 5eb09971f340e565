"""Spelling variant grouping: words that differ by one character, found by Aho-Corasick automata over the halves of words.

Of two words at distance one, a half of either occurs unchanged in the other: its first half at the beginning, or its second half at the
end. Halves are dealt into shards by a hash; a shard holds an automaton of its halves and scans the words that
can have one of them in the right place, which are the four beginnings and ends of each word whose lengths fit. A find counts if it stands at the
beginning or the end and the lengths differ by one at most. The words of one half are then compared by what is left of them: both
lose each character in turn, equal remainders are brought together by sorting, and every pair so found is verified character by character. That is
linear in the words of a half, not quadratic, and each pair is counted once, in one shard.

A half that more than ``HOT`` words share is dealt once more, by the remainders themselves, so no task depends on how many words
share it. Words and counts are combined before the first shuffle, so frequent words cost a row for each task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .storage import drop, table

WORD = "[A-Za-zÀ-ÿ]"
LEAST_LENGTH = 7
LEAST_COUNT = 2
TIMES = 10
SHARD_CHARS = 1 << 20
HOT = 20_000

_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BASE = tk.U(0x9E3779B97F4A7C15)
_INVERSE = tk.U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_WIDE = 64


def vocabulary(docs: DataFrame, every: int = 31) -> DataFrame:
    """(word, n): runs of letters of whole texts, lower-cased A-Z, of LEAST_LENGTH code points and LEAST_COUNT occurrences at least.

    Where ``every`` divides the crc32 of "doc_id:word", the occurrence loses its code point at that number modulo its length. A null doc_id
    counts as an empty one there; null texts have no words; repeated rows count each time.
    """
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("d"), F.explode(F.regexp_extract_all(F.col("text").cast("string"), F.lit(f"({WORD}{{{LEAST_LENGTH},}})"))).alias("w"))
    runs = runs.select("d", F.translate("w", _CAPITALS, _SMALL).alias("w")).withColumn("h", F.crc32(F.concat_ws(":", "d", "w").cast("binary")))
    at = (F.col("h") % F.length("w")).cast("int")
    cut = F.concat(F.substring(F.col("w"), F.lit(1), at), F.substring(F.col("w"), at + 2, F.length("w")))
    words = runs.select(F.when(F.col("h") % every == 0, cut).otherwise(F.col("w")).alias("word"))
    return words.where(F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_COUNT)


def _routes(words: DataFrame) -> DataFrame:
    """(kind, half, size, own, word, n): the beginnings (kind 0) and ends (kind 1) that a near word can have as its half; own: it is the word's own."""
    n = F.length("word")
    first, second = (n / 2).cast("int"), n - (n / 2).cast("int")
    odd = n % 2
    ends = [(0, first, True), (0, first + F.when(odd == 1, 1).otherwise(-1), False), (1, second, True), (1, second + F.when(odd == 1, -1).otherwise(1), False)]
    part = lambda kind, size: F.substring("word", F.lit(1), size) if kind == 0 else F.substring(F.col("word"), n - size + 1, size)
    made = F.array(*(F.struct(F.lit(k).alias("kind"), part(k, s).alias("half"), s.alias("size"), F.lit(o).alias("own")) for k, s, o in ends))
    return words.select(F.explode(made).alias("r"), "word", "n").select("r.*", "word", "n")


def _hot_routes(routes: DataFrame) -> DataFrame:
    """The same rows once for each remainder: ``skip`` is the place of the character left out, -1 for none; the last of a run of equal ones stands for it."""
    rest = F.when(F.col("kind") == 0, F.expr("substring(word, size + 1)")).otherwise(F.expr("substring(word, 1, length(word) - size)"))
    begin = F.when(F.col("kind") == 0, F.col("size")).otherwise(F.lit(0))
    rows = routes.withColumn("rest", rest).withColumn("begin", begin).withColumn("i", F.explode(F.sequence(F.lit(-1), F.length("rest") - 1)))
    rows = rows.where("i < 0 OR i = length(rest) - 1 OR substring(rest, i + 1, 1) <> substring(rest, i + 2, 1)")
    left = F.expr("CASE WHEN i < 0 THEN rest ELSE concat(substring(rest, 1, i), substring(rest, i + 2)) END")
    return rows.select("kind", "half", "size", "own", "word", "n", F.when(F.col("i") < 0, -1).otherwise(F.col("i") + F.col("begin")).cast("int").alias("skip"), left.alias("left"))


def _latin(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Words of code points up to U+00FF as one byte a code point, and their offsets."""
    data, off = tk.utf8(column)
    lead = data == 0xC3
    after = np.concatenate(([False], lead[:-1])) if len(data) else lead
    kept = np.cumsum(np.concatenate(([0], ~lead)))
    return np.where(after, data + np.uint8(0x40), data)[~lead], kept[off]


class _Words:
    """Distinct words of a shard, with hashes of their stretches and matrices to compare them by."""

    def __init__(self, column: pa.ChunkedArray):
        self.bytes, self.off = _latin(column)
        self.size = np.diff(self.off)
        n = len(self.bytes)
        code = tk.mix(self.bytes.astype(np.uint64) + tk.U(1)) | tk.U(1)
        ones = np.ones(n + 1, np.uint64)
        ones[1:] = _BASE
        self.up = np.cumprod(ones, dtype=np.uint64)
        ones[1:] = _INVERSE
        self.down = np.cumprod(ones, dtype=np.uint64)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(code * self.up[:n], dtype=np.uint64)))
        ends = np.ones(n, bool)  # the last of a run of equal characters of one word
        if n:
            ends[:-1] = self.bytes[1:] != self.bytes[:-1]
            ends[self.off[1:] - 1] = True
        self.run_end = np.flatnonzero(ends)[np.cumsum(np.concatenate(([0], ends[:-1])))] if n else np.zeros(0, np.int64)
        wide = min(_WIDE, int(self.size.max(initial=1)))
        self.short = np.flatnonzero(self.size <= wide)
        self.row = np.full(len(self.size), -1)
        self.row[self.short] = np.arange(len(self.short))
        self.left, self.right = (np.zeros((len(self.short), wide), np.uint8) for _ in range(2))
        at = np.arange(wide)
        for matrix, start in ((self.left, np.zeros(len(self.short), np.int64)), (self.right, wide - self.size[self.short])):
            inside = (at >= start[:, None]) & (at < (start + self.size[self.short])[:, None])
            matrix[inside] = self.bytes[tk.ranges(self.off[self.short], self.size[self.short])]

    def hash(self, a: np.ndarray, b: np.ndarray, skip: np.ndarray) -> np.ndarray:
        """Of the stretches [a, b) of the buffer without the byte at skip (-1: with all)."""
        gap = np.where(skip < 0, b, skip)
        beyond = np.minimum(gap + 1, b)
        return (self.sums[gap] - self.sums[a]) * self.down[a] + np.where(skip < 0, tk.U(0), (self.sums[b] - self.sums[beyond]) * self.down[a] * _INVERSE)

    def ends(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lengths of the common beginning and the common end of the words x and y of each pair, which are different words."""
        first, last = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
        long = (self.row[x] < 0) | (self.row[y] < 0)
        for at in np.array_split(np.flatnonzero(~long), max(1, len(x) >> 17)):
            i, j = self.row[x[at]], self.row[y[at]]
            first[at] = (self.left[i] != self.left[j]).argmax(axis=1)
            last[at] = (self.right[i] != self.right[j])[:, ::-1].argmax(axis=1)
        for k in np.flatnonzero(long):
            a, b = (self.bytes[self.off[w] : self.off[w + 1]] for w in (x[k], y[k]))
            m = min(len(a), len(b))
            same, back = a[:m] == b[:m], a[len(a) - m :][::-1] == b[len(b) - m :][::-1]
            first[k], last[k] = (m if q.all() else int(q.argmin()) for q in (same, back))
        return first, last


def _scan(words: list[str], halves: dict[tuple[int, str], int]) -> tuple[np.ndarray, np.ndarray]:
    """(word, half) of every half that stands in its place in a word, by an automaton over all halves."""
    import ahocorasick

    automaton, numbers = ahocorasick.Automaton(), {}
    for (kind, half), k in halves.items():
        numbers.setdefault(half, [-1, -1, len(half)])[kind] = k
    for half, value in numbers.items():
        automaton.add_word(half, value)
    automaton.make_automaton()
    found = []
    for i, word in enumerate(words if numbers else []):
        last = len(word) - 1
        for end, (begins, ends, size) in automaton.iter(word):
            if begins >= 0 and end == size - 1:
                found.append((i, begins))
            if ends >= 0 and end == last:
                found.append((i, ends))
    pairs = np.array(found, np.int64).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


def _near(shard: pa.Table) -> pa.Table:
    """(word, n_near, best_n, best) of the words of a shard that have near words in it."""
    column = shard["word"].combine_chunks().dictionary_encode()
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    index, names = column.indices.to_numpy().astype(np.int64), column.dictionary
    words, texts = _Words(names), names.to_pylist()
    n = np.zeros(len(texts), np.int64)
    n[index] = shard["n"].to_numpy()
    kind, size, own, skip = (shard[c].to_numpy() for c in ("kind", "size", "own", "skip"))
    halves: dict[tuple[int, str], int] = {}
    half = np.array([halves.setdefault(x, len(halves)) for x in zip(kind.tolist(), shard["half"].to_pylist())], np.int64)
    in_shard = half[own]
    owned = np.zeros(len(halves), bool)
    owned[in_shard] = True
    kind_of, size_of = np.zeros(len(halves), np.int64), np.zeros(len(halves), np.int64)
    kind_of[half], size_of[half] = kind, size
    x, h = _scan(texts, {k: v for k, v in halves.items() if owned[v]})
    fits = np.abs(words.size[x] - 2 * size_of[h] - np.where(kind_of[h] == 0, 0.5, -0.5)) <= 1.5  # words of this half have 2 * size, or one more or less
    x, h = x[fits], h[fits]
    # of a hot half only the remainders that were dealt to this shard, of others all of them
    hot = np.zeros(len(halves), bool)
    hot[half[skip > -2]] = True
    x, h = x[~hot[h]], h[~hot[h]]
    listed = np.flatnonzero(skip > -2)
    pattern = np.zeros(len(x), bool)
    code = np.unique(index[own & (skip == -2)] * len(halves) + half[own & (skip == -2)])
    at = np.searchsorted(code, x * len(halves) + h)
    pattern[at < len(code)] = code[at[at < len(code)]] == (x * len(halves) + h)[at < len(code)]

    def stretch(w, g):
        a = words.off[w] + np.where(kind_of[g] == 0, size_of[g], 0)
        return a, words.off[w + 1] - np.where(kind_of[g] == 0, 0, size_of[g])

    a, b = stretch(x, h)
    count = b - a
    who = np.concatenate((np.arange(len(x)), np.repeat(np.arange(len(x)), count)))
    lost = np.concatenate((np.full(len(x), -1), tk.ranges(a, count)))
    alone = (lost < 0) | (lost == np.minimum(words.run_end[np.maximum(lost, 0)], b[who] - 1))
    who, lost = who[alone], lost[alone]
    word = np.concatenate((x[who], index[listed]))
    group = np.concatenate((h[who], half[listed]))
    mine = np.concatenate((pattern[who], own[listed]))
    lost = np.concatenate((lost, np.where(skip[listed] < 0, -1, words.off[index[listed]] + skip[listed])))
    a, b = stretch(word, group)
    key = tk.mix(words.hash(a, b, lost) + group.astype(np.uint64) * tk.U(0xC2B2AE3D27D4EB4F))
    # every entry of a word beside every entry of the words of the half with the same remainder
    order = np.argsort(key[mine], kind="stable")
    patterns = np.flatnonzero(mine)[order]
    low, high = (np.searchsorted(key[patterns], key, side=s) for s in ("left", "right"))
    totals: list[np.ndarray] = []
    for part in np.array_split(np.flatnonzero(high > low), max(1, int((high - low).sum()) >> 21)):
        e = np.repeat(part, (high - low)[part])
        p = patterns[tk.ranges(low[part], (high - low)[part])]
        ok = (word[e] != word[p]) & (group[e] == group[p])
        e, p = e[ok], p[ok]
        s, t = words.size[word[e]], words.size[word[p]]
        first, last = words.ends(word[e], word[p])
        near = (np.abs(s - t) <= 1) & (first + last >= np.maximum(s, t) - 1)
        # one entry stands for a pair, and beginnings come before ends
        place = words.run_end[np.minimum(words.off[word[e]] + first, words.off[word[e] + 1] - 1)]
        near &= lost[e] == np.where(s < t, -1, np.minimum(place, b[e] - 1))
        near &= (kind_of[group[e]] == 0) | (first < t // 2)
        totals.append(np.stack((word[e], word[p]))[:, near])
    x, y = np.concatenate(totals, axis=1) if totals else np.zeros((2, 0), np.int64)
    rank = np.empty(len(texts), np.int64)
    rank[np.array(sorted(range(len(texts)), key=texts.__getitem__), np.int64)] = np.arange(len(texts))
    order = np.lexsort((rank[y], -n[y], x))
    x, y = x[order], y[order]
    who, begin, count = np.unique(x, return_index=True, return_counts=True)
    best = y[begin]
    return pa.table({"word": names.take(pa.array(who)).cast(pa.string()), "n_near": pa.array(count, pa.int64()), "best_n": pa.array(n[best], pa.int64()), "best": names.take(pa.array(best)).cast(pa.string())})


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best, best_n): for every word with near words their number and the most frequent of them, of equal ones the first in code-point order.

    words: distinct (word, n), of at least four code points up to U+00FF.
    """
    spark = words.sparkSession
    tk.ship(spark)
    routes = _routes(words)
    hot = routes.where("own").groupBy("kind", "half").count().where(F.col("count") > HOT).select("kind", "half")
    shards = max(8, int((words.agg(F.sum(F.length("word"))).first()[0] or 0) / SHARD_CHARS * 4))
    plain = routes.withColumns({"skip": F.lit(-2), "left": F.lit(None).cast("string")})
    if not hot.isEmpty():
        hot = table(hot)
        plain = plain.join(hot, ["kind", "half"], "left_anti").unionByName(_hot_routes(routes.join(hot, ["kind", "half"], "left_semi")))
    rows = plain.select(F.pmod(F.xxhash64("kind", "half", "left"), F.lit(shards)).cast("int").alias("shard"), "kind", "half", "size", "own", "word", "n", "skip")
    found = rows.groupBy("shard").applyInArrow(tk.tidy(_near), "word string, n_near long, best_n long, best string")
    first = F.min(F.struct((-F.col("best_n")).alias("m"), "best")).alias("b")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), first).select("word", "n_near", F.col("b.best").alias("best"), (-F.col("b.m")).alias("best_n"))


def spelling_variants(docs: DataFrame, every: int = 31) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of the vocabulary.

    form: the near word with the most occurrences, if TIMES as many as the word's at least; null otherwise. root: where forms lead to in the
    end, the word itself without one. docs: doc_id, text; other columns are ignored, null and empty texts have no words,
    repeated rows count each time, and an empty table has no rows.
    """
    words = table(vocabulary(docs, every))
    near = near_words(words)
    found = table(words.join(near, "word", "left").withColumn("form", F.when(F.col("best_n") >= TIMES * F.col("n"), F.col("best"))))
    # a form has TIMES the occurrences of what leads to it, so chains are short and each round doubles what is followed
    steps = table(found.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    while True:
        then = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        more = table(steps.join(then, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        drop(steps)
        steps = more.select("word", "root")
        if more.where("moved").isEmpty():
            break
    roots = steps
    out = found.join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("form").isNotNull(), F.col("best_n")).alias("form_n"))
