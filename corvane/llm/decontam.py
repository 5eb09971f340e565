"""Benchmark decontamination with a broadcast hash set of normalised test n-grams.

The benchmark is read in blocks of about ``BLOCK_BYTES`` of text (a longer item is a block of its own), and what is
broadcast is some six times its block. Where there are several, each scans all documents, and what it found is written
to the shared folder before the next one, so a task and the cluster never hold more than one. Windows whose hash is in the set are verified against
the benchmark's words before they count.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .storage import drop, table

BLOCK_BYTES = 16 << 20
_FILTER_BITS = 20

STATE = "doc_id long, text string, n_words long, hits binary, items array<string>"


class WindowSet:
    """Windows of a block of benchmark items, by their length: sorted hashes, and where each stands in the items' words.

    About 28 bytes for each word and the words themselves once.
    """

    def __init__(self, items: list[tuple[str, str]], n: int):
        self.names = [i for i, _ in items]
        data, off = tk.utf8(pa.array([t for _, t in items], pa.large_string()))
        data = tk.lower(data)
        words = tk.find_words(data, off, tk.ALNUM_WORDS)
        hashes, size = tk.span_hashes(data, words.start, words.end), words.end - words.start
        start = np.cumsum(size + 1) - size - 1
        text = np.full(int((size + 1).sum()), 32, np.uint8)
        text[tk.ranges(start, size)] = data[tk.ranges(words.start, size)]
        self.text = text.tobytes()
        counts = words.counts
        self.by_size = {}
        for k in sorted(set(np.minimum(counts[counts > 0], n).tolist())):
            rows = np.flatnonzero(counts >= n if k == n else counts == k)
            at = tk.ranges(words.doc_off[rows], counts[rows] - k + 1)
            grams = tk.ngram_hashes(hashes, k)[at]
            order = np.argsort(grams, kind="stable")
            at, owner = at[order], np.repeat(rows, counts[rows] - k + 1)[order]
            member = np.zeros(1 << _FILTER_BITS, bool)
            member[grams >> tk.U(64 - _FILTER_BITS)] = True
            self.by_size[k] = (grams[order], member, start[at], start[at + k - 1] + size[at + k - 1], owner.astype(np.int32))

    def scan(self, data: np.ndarray, words: tk.Words):
        """(first word, size, items) of each verified window of a lower-cased block."""
        hashes = tk.span_hashes(data, words.start, words.end)
        raw = data.tobytes()
        for size, (known, member, begin, end, owner) in self.by_size.items():
            grams = tk.ngram_hashes(hashes, size)
            at = np.flatnonzero(member[grams >> tk.U(64 - _FILTER_BITS)] & tk.within(words.doc_off, size)[: len(grams)]) if len(grams) else []
            if not len(at):
                continue
            low, high = np.searchsorted(known, grams[at]), np.searchsorted(known, grams[at], side="right")
            for j in np.flatnonzero(low < high).tolist():
                i = int(at[j])
                window = b" ".join(raw[words.start[i + k] : words.end[i + k]] for k in range(size))
                items = {self.names[owner[x]] for x in range(low[j], high[j]) if self.text[begin[x] : end[x]] == window}
                if items:
                    yield i, size, items


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[str, str]]]:
    block, size = [], 0
    for row in benchmark.select(F.col("item_id").cast("string").alias("i"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t")).toLocalIterator():
        more = len(row["t"].encode())
        if block and size + more > BLOCK_BYTES:
            yield block
            block, size = [], 0
        block.append((row["i"] or "", row["t"]))
        size += more
    if block:
        yield block


def find_leaks(docs: DataFrame, benchmark: DataFrame, n: int = 10, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, text, n_words, hits, items) for every row of documents.

    docs: doc_id long, text string, and the columns named by keep, which are carried along as __0, __1 and so on; benchmark: item_id, text. Words are runs of digits, a-z
    and non-ASCII characters of the lower-cased text; a window is n consecutive words of an item, or all of a shorter
    one. hits: packed bits, one for each word inside an occurring window (null: none); items: the item_ids with
    occurring windows, sorted as strings. Null and empty texts have no words and no hits. Repeated rows are judged
    each on its own; an empty benchmark hits nothing.
    """
    spark = docs.sparkSession
    tk.ship(spark)
    state = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.lit(None).cast("long").alias("n_words"), F.lit(None).cast("binary").alias("hits"), F.expr("cast(array() as array<string>)").alias("items"), *[F.col(c).alias(f"__{i}") for i, c in enumerate(keep)])
    ddl = STATE + "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in state.schema.fields[5:])
    last = None
    for block in itertools.chain(_blocks(benchmark), [[]] if benchmark.isEmpty() else []):
        if last is not None:  # another block follows: what the last one found is written before this one is sent out
            written = table(state)
            last.destroy()
            drop(before)
            state = written
        before, last = state, spark.sparkContext.broadcast(WindowSet(block, n))

        def run(batches, known=last):
            for batch in batches:
                yield _scan(batch, known.value)

        state = state.mapInArrow(tk.tidy_map(run), ddl)
    return state


def _scan(batch: pa.RecordBatch, known: WindowSet) -> pa.RecordBatch:
    counts, hits, items = [], batch.column("hits").to_pylist(), batch.column("items").to_pylist()
    for first, data, off in tk.blocks(batch.column("text")):
        data = tk.lower(data)
        words = tk.find_words(data, off, tk.ALNUM_WORDS)
        counts.append(words.counts)
        hit, by_doc = np.zeros(len(words.start), bool), defaultdict(set)
        for i, size, found in known.scan(data, words):
            hit[i : i + size] = True
            by_doc[int(np.searchsorted(words.doc_off, i, side="right")) - 1].update(found)
        for d, found in by_doc.items():
            bits = hit[words.doc_off[d] : words.doc_off[d + 1]]
            if (old := hits[first + d]) is not None:
                bits = bits | np.unpackbits(np.frombuffer(old, np.uint8), count=len(bits)).astype(bool)
            hits[first + d] = np.packbits(bits).tobytes()
            items[first + d] = sorted({*items[first + d], *found})
    n = pa.array(np.concatenate(counts) if counts else [], pa.int64())
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), n, pa.array(hits, pa.binary()), pa.array(items, pa.list_(pa.string())), *batch.columns[5:]], names=batch.schema.names)


def leak_report(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """(doc_id, n_words, n_hit, items) of every row of documents; see find_leaks."""
    found = find_leaks(docs, benchmark, n)
    # a packed byte's set bits, summed over the bytes of the bitmap
    bits = F.expr("coalesce(aggregate(sequence(1, octet_length(hits)), 0L, (a, i) -> a + bit_count(cast(conv(hex(substring(hits, i, 1)), 16, 10) as int))), 0L)")
    return found.select("doc_id", "n_words", F.when(F.col("hits").isNull(), F.lit(0).cast("long")).otherwise(bits).alias("n_hit"), "items")


def remove_leaks(docs: DataFrame, benchmark: DataFrame, n: int = 10, drop: str = "spans", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, text, kept columns): the documents that hit nothing as they are, and of the others what is left.

    drop: "spans" cuts each run of hit words from its first to its last byte; "documents" leaves the document out. A null
    text stays null, an empty one empty; each repeated row is treated alike; kept columns may have any names.
    """
    found = find_leaks(docs, benchmark, n, keep)
    if drop == "documents":
        return found.where("hits is null").select("doc_id", "text", *found.columns[5:]).toDF("doc_id", "text", *keep)

    def run(batches):
        for batch in batches:
            text, hits = batch.column("text").to_pylist(), batch.column("hits").to_pylist()
            for d, bits in enumerate(hits):
                if bits is None:
                    continue
                raw = text[d].encode()
                data, off = tk.utf8(pa.array([text[d]]))
                words = tk.find_words(tk.lower(data), off, tk.ALNUM_WORDS)
                hit = np.concatenate(([0], np.unpackbits(np.frombuffer(bits, np.uint8), count=len(words.start)), [0])).astype(np.int8)
                edge = np.diff(hit)
                at, out = 0, []
                for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)):
                    out.append(raw[at : words.start[a]])
                    at = words.end[b - 1]
                text[d] = b"".join([*out, raw[at:]]).decode()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(text, pa.string()), *batch.columns[5:]], names=["doc_id", "text", *batch.schema.names[5:]])

    return found.mapInArrow(tk.tidy_map(run), "doc_id long, text string" + "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in found.schema.fields[5:])).toDF("doc_id", "text", *keep)
