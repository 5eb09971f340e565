"""Vectorised byte-level text kernels shared by the document operators.

Everything works on the UTF-8 buffer of an Arrow string column, so a block of documents costs a few numpy passes
rather than a Python loop over words. Blocks are cut at ``BLOCK`` bytes (a longer document is a block of its own),
which bounds the temporary arrays whatever the batch Spark hands over.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from corvane.runtime import ship  # noqa: F401

BLOCK = 1 << 20
U = np.uint64

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Words [^\x20\x09-\x0D]+
SPACE_WORDS = np.ones(256, dtype=bool)
SPACE_WORDS[[32, 9, 10, 11, 12, 13]] = False

#: Words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of lower-cased text: digits, a-z and every byte of a non-ASCII character.
ALNUM_WORDS = np.zeros(256, dtype=bool)
ALNUM_WORDS[48:58] = ALNUM_WORDS[97:123] = ALNUM_WORDS[128:] = True


def release() -> None:
    """Give freed memory back to the system; a no-op where the C library has no such call."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


#: What a kernel keeps in its worker between groups; a kernel that does not ask for it drops it.
RESIDENT: dict[str, object] = {}


def tidy(run: Callable, keeps: bool = False) -> Callable:
    """The same function of a group, or of two cogrouped ones, that releases memory when it is done.

    Spark's Python workers live on between stages, and what numpy has freed stays with them otherwise, so a job of
    several stages would need the sum of their peaks. keeps: what earlier kernels left in RESIDENT stays.
    """

    def done(*args):
        if not keeps:
            RESIDENT.clear()
        try:
            return run(*args)
        finally:
            release()

    by_count = {1: lambda a: done(a), 2: lambda a, b: done(a, b), 3: lambda a, b, c: done(a, b, c)}
    return by_count[run.__code__.co_argcount]


def tidy_map(run: Callable) -> Callable:
    """The same function of an iterator of batches that releases memory after each and when it is done."""

    def done(batches):
        RESIDENT.clear()
        try:
            for out in run(batches):
                yield out
                del out
                release()
        finally:
            release()

    return done


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (multiply-xorshift), so that hash order is close to random."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and its n+1 offsets; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def blocks(column: pa.Array | pa.ChunkedArray, size: int = BLOCK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) for runs of rows of about ``size`` bytes."""
    data, off = utf8(column)
    n, i = len(off) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + size, side="right")) - 1)
        j = min(j, n)
        yield i, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def lower(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


@dataclass
class Words:
    """The words of a block: byte ranges, and the range of words of each document."""

    start: np.ndarray
    end: np.ndarray
    doc_off: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.doc_off)


def find_words(data: np.ndarray, off: np.ndarray, kind: np.ndarray) -> Words:
    """Maximal runs of bytes of a kind; a document's end always ends a word."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return Words(z, z, np.zeros(len(off), np.int64))
    inside = kind[data]
    first = np.zeros(n + 1, bool)
    first[off] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | first[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | first[1:])) + 1
    return Words(start, end, np.searchsorted(start, off, side="left"))


_KEYS = mix(np.arange(101, 165, dtype=np.uint64) * U(0xC2B2AE3D27D4EB4F)) | U(1)
_FANOUT = len(_KEYS)
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
_NEAR = 64  # bytes of a span that are hashed one after the other


def fold(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A hash of each of the consecutive runs of ``counts`` values, none of them empty.

    A tree: values are mixed with the key of their place among 64, summed, and the sums are folded again. The mixing is
    not linear, so no pattern of the input cancels out, as it does in polynomials modulo a power of two.
    """
    out, rows = np.zeros(len(counts), np.uint64), np.arange(len(counts))
    while len(rows):
        at = np.cumsum(counts) - counts
        place = np.arange(len(values)) - np.repeat(at, counts)
        values = mix((values ^ _KEYS[place % _FANOUT]) * U(0x9E3779B97F4A7C15))
        values = mix(np.add.reduceat(values, np.flatnonzero(place % _FANOUT == 0)))
        counts = -(-counts // _FANOUT)
        done = counts == 1  # a run's levels depend on its own length alone
        out[rows[done]] = values[(np.cumsum(counts) - counts)[done]]
        values, rows, counts = values[np.repeat(~done, counts)], rows[~done], counts[~done]
    return out


def words8(data: np.ndarray) -> np.ndarray:
    """The 8 bytes at each position as a little-endian integer, with zeros behind the end."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    return np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded.data, strides=(1,))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0xD6E8FEB86659FD93) -> np.ndarray:
    """A 64-bit hash of each byte range: 8 bytes at a time, and what is beyond 64 bytes by a tree. Another seed gives an independent one."""
    loads, size = words8(data), (end - start).astype(np.int64)
    total = mix((loads[start] & _MASK[np.minimum(size, 8)]) * U(0x9E3779B97F4A7C15) + (size.astype(np.uint64) + U(1)) * U(seed))
    rest = np.flatnonzero(size > 8)
    for j in range(8, _NEAR, 8):
        if not len(rest):
            return total
        left = size[rest] - j
        total[rest] = mix(total[rest] * U(seed) + (loads[start[rest] + j] & _MASK[np.minimum(left, 8)]))
        rest = rest[left > 8]
    if len(rest):
        counts = -(-(size[rest] - _NEAR) // 8)
        values = loads[ranges(start[rest] + _NEAR, counts, 8)]
        last = np.cumsum(counts) - 1
        values[last] &= _MASK[size[rest] - _NEAR - 8 * (counts - 1)]
        total[rest] = mix(total[rest] * U(seed) + fold(mix(values + U(seed)), counts))
    return total


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n consecutive word hashes, len(words)-n+1 of them."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    total = words[:m] * _KEYS[0]
    for j in range(1, n):
        total = (total ^ (total >> U(32))) * _KEYS[j] + words[j : j + m]
    return mix(total + U(n))


def within(doc_off: np.ndarray, n: int) -> np.ndarray:
    """Of the windows of n over all items of a block, True for those inside one document."""
    total = int(doc_off[-1])
    ok = np.ones(max(0, total - n + 1), bool)
    if n > 1 and len(ok):
        ends = doc_off[1:]
        for j in range(1, n):
            p = ends - j
            p = p[(p >= 0) & (p < len(ok))]
            ok[p] = False
    return ok


def shingle_sets(data: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-word shingle hashes of each document of a lower-cased block, concatenated, and their offsets.

    A document of fewer than n words, but not none, has the whole sequence as its one shingle.
    """
    words = find_words(data, off, SPACE_WORDS)
    hashes = span_hashes(data, words.start, words.end)
    counts = words.counts
    doc = np.repeat(np.arange(len(counts)), counts)
    ok = within(words.doc_off, n)
    values, owner = ngram_hashes(hashes, n)[ok], doc[: len(ok)][ok]
    for d in np.flatnonzero((counts > 0) & (counts < n)):
        own = hashes[words.doc_off[d] : words.doc_off[d + 1]]
        values = np.append(values, ngram_hashes(own, len(own)))
        owner = np.append(owner, d)
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    keep = np.ones(len(values), bool)
    keep[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    values, owner = values[keep], owner[keep]
    return values, np.searchsorted(owner, np.arange(len(counts) + 1))


def pack(values: np.ndarray, delta: bool = False) -> bytes:
    """Integers as compressed byte planes; ``delta`` for sorted ones."""
    import zstandard

    values = np.ascontiguousarray(values)
    if delta and len(values):
        values = np.concatenate((values[:1], np.diff(values)))
    planes = values.view(np.uint8).reshape(len(values), values.itemsize).T
    return zstandard.compress(np.ascontiguousarray(planes).tobytes(), 1)


def unpack(blob: bytes, dtype, delta: bool = False) -> np.ndarray:
    import zstandard

    raw = np.frombuffer(zstandard.decompress(blob), np.uint8)
    size = np.dtype(dtype).itemsize
    values = np.ascontiguousarray(raw.reshape(size, len(raw) // size).T).view(dtype).reshape(-1)
    return values.cumsum(dtype=dtype) if delta else values


def ranges(start: np.ndarray, length: np.ndarray, step: int = 1) -> np.ndarray:
    """The concatenated indices start[i], start[i]+step .. start[i]+step*(length[i]-1)."""
    total = int(length.sum())
    out = np.full(total, step, np.int64)
    if not total:
        return out
    keep = length > 0
    start, length = start[keep], length[keep]
    at = np.concatenate(([0], np.cumsum(length)[:-1]))
    out[at] = start
    out[at[1:]] -= start[:-1] + step * (length[:-1] - 1)
    return out.cumsum()


def kept_names(keep, made) -> list[str]:
    """Names for the columns that an operator carries along; one that the operator makes a column of itself gets ``_in`` behind it."""
    return [f"{c}_in" if c in made else c for c in keep]


def to_strings(parts: list[bytes | None]) -> pa.Array:
    return pa.array(parts, pa.binary()).cast(pa.string())
