"""Key exchange between groups of documents and parts of a hash space.

Several operators ask one question of every key in the corpus (how often does it occur, who has it first) and use
the answers in document order. Doing that with one row per key moves a wide row twice for every shingle or byte
position. Here documents are dealt into groups of a few MB; a group sends, for each part of the hash space, its sorted
distinct keys as one compressed row; the part merges the rows of all groups and answers each of them with values in
the order of its keys. The group then derives the same keys again and lines the answers up, so keys never travel back.

* Counting is combined inside a group before anything moves, so a key with a third of all occurrences costs one entry
  for each group.
* A part holds the distinct keys of a range of the hash space; the number of parts follows the input, and no part
  depends on how often a key occurs.
* Groups and parts are pure functions of the row and the key: a lost task is simply run again.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk

ASK = "g int, p int, n int, keys binary, pay binary"
REPLY = "g int, p int, n int, data binary"
_REPLY = pa.schema([("g", pa.int32()), ("p", pa.int32()), ("n", pa.int32()), ("data", pa.binary())])
_ASK = pa.schema([("g", pa.int32()), ("p", pa.int32()), ("n", pa.int32()), ("keys", pa.binary()), ("pay", pa.binary())])

GROUP_BYTES = 4 << 20
PART_BYTES = 16 << 20
LEAST = 256
SCALE_FROM = 1 << 40  # bytes of text from which groups and parts grow, with the square root of the input,
MOST_SCALE = 4  # up to so many times these sizes: what a kernel holds at a time is a multiple of its group


def grouped(docs: DataFrame, *columns: str, part_bytes: int = PART_BYTES, group_bytes: int = GROUP_BYTES, least: int = LEAST) -> tuple[DataFrame, int, int]:
    """(g, columns...), and the numbers of hash parts and of groups for this many bytes of text. Reads the text column once."""
    total = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    scale = min(MOST_SCALE, max(1.0, (total / SCALE_FROM) ** 0.5))
    groups = max(least, int(total / (group_bytes * scale)))
    parts = max(8, int(total / (part_bytes * scale)))
    return docs.select(group_of(groups), *columns), parts, groups


def group_of(groups: int) -> F.Column:
    """The group of a row, by doc_id and text, so that rows without a doc_id or under one doc_id are spread too."""
    return F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups)).cast("int").alias("g")


def cuts(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where each part begins in sorted keys."""
    step = (1 << 64) // parts + 1
    return np.searchsorted(keys, np.array([i * step for i in range(1, parts)], np.uint64)) if parts > 1 else np.zeros(0, np.int64)


def ask_table(g: int, keys: np.ndarray, pay: np.ndarray | None, parts: int) -> pa.Table:
    """Rows for the parts that have keys of this group. keys: sorted and distinct; pay: one value for each."""
    at = np.concatenate(([0], cuts(keys, parts), [len(keys)]))
    rows = [p for p in range(parts) if at[p] < at[p + 1]]
    return pa.Table.from_arrays(
        [
            pa.array([g] * len(rows), pa.int32()),
            pa.array(rows, pa.int32()),
            pa.array([int(at[p + 1] - at[p]) for p in rows], pa.int32()),
            pa.array([tk.pack(keys[at[p] : at[p + 1]], delta=True) for p in rows], pa.binary()),
            pa.array([None if pay is None else tk.pack(pay[at[p] : at[p + 1]]) for p in rows], pa.binary()),
        ],
        schema=_ASK,
    )


def reply_table(part: pa.Table, answers: list[np.ndarray]) -> pa.Table:
    return pa.Table.from_arrays([part["g"].combine_chunks(), part["p"].combine_chunks(), part["n"].combine_chunks(), pa.array([tk.pack(a) for a in answers], pa.binary())], schema=_REPLY)


def merge(asks: DataFrame, combine: Callable[[np.ndarray, np.ndarray | None, np.ndarray], np.ndarray], pay_type=None) -> DataFrame:
    """Answers for all asks of a part.

    ``combine(key_index, pay, sender)`` gets, for every entry of the part, the index of its distinct key, its payload
    and the group that sent it, and returns the entry's answer.
    """

    def part(table: pa.Table) -> pa.Table:
        keys = [tk.unpack(x, np.uint64, delta=True) for x in table["keys"].to_pylist()]
        sizes = np.array([len(x) for x in keys])
        pay = None if pay_type is None else np.concatenate([tk.unpack(x, pay_type) for x in table["pay"].to_pylist()])
        _, index = np.unique(np.concatenate(keys), return_inverse=True)
        del keys
        answer = combine(index, pay, np.repeat(table["g"].to_numpy(), sizes))
        at = np.concatenate(([0], np.cumsum(sizes)))
        return reply_table(table, [answer[at[i] : at[i + 1]] for i in range(len(sizes))])

    return asks.groupBy("p").applyInArrow(tk.tidy(part), REPLY)


def answers(replies: pa.Table, dtype) -> np.ndarray:
    """The answers to a group, in the order of its sorted keys."""
    if not replies.num_rows:
        return np.zeros(0, dtype)
    order = np.argsort(replies["p"].to_numpy())
    data = replies["data"].to_pylist()
    return np.concatenate([tk.unpack(data[i], dtype) for i in order])
