"""BPE encoding and decoding with content-defined chunk reuse.

Texts are cut where a rolling hash of the last bytes says so, always after a blank, so equal passages fall into equal
chunks wherever they stand. A key exchange (exchange.py) finds the chunks that several groups of documents have; one
group encodes each of them and the others receive its ids. Chunks count as equal by 128 bits of two hashes across groups.
Inside a group a chunk is encoded word by word, each distinct word once, and words are compared as bytes. Where two chunks
meet, the words at the join are encoded again together; while that disagrees with the ids on both sides, the stretch
grows by a word on each side.
"""

from __future__ import annotations

import hashlib
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as ex
from . import textkit as tk

ROLL = 16
MEAN_CHUNK = 2048
KNOWN_WORDS = 300_000  # of either generation of the memory

_IDS = pa.schema([("g", pa.int32()), ("p", pa.int32()), ("n", pa.int32()), ("keys", pa.binary()), ("pay", pa.binary()), ("data", pa.binary()), ("counts", pa.binary())])
_IDS_DDL = "g int, p int, n int, keys binary, pay binary, data binary, counts binary"
_SECOND = 0x94D049BB133111EB  # seed of the second hash of a chunk


class Codec:
    """A tokenizer file, a bounded memory of the words that it has encoded (as packed ids), and its pieces."""

    @classmethod
    def load(cls, path: str, content: bytes) -> Codec:
        known = tk.RESIDENT.get("codec")
        if known is None or known[0] != path:
            tk.RESIDENT["codec"] = known = path, cls(content)
        return known[1]

    def __init__(self, content: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_buffer(content)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.pieces = [(self.tokenizer.id_to_token(i) or "").encode() for i in range(size)]
        self.numbers = [b"%d" % i for i in range(size)]
        self.plain = self.tokenizer.decoder is None
        self.kind = np.dtype(np.uint16 if size < 1 << 16 else np.uint32)
        self.suffix = (getattr(self.tokenizer.model, "end_of_word_suffix", None) or "").encode()
        self.ends = np.array([bool(self.suffix) and p.endswith(self.suffix) for p in self.pieces])
        self.marks = {m[0]: self._split_off(m) for m in (b".", b",", b";", b":", b"!", b"?")}
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def separates(self) -> bool:
        """Whether ASCII white space always separates words for this tokenizer and leaves no ids of its own."""
        words = ["ab", "cd.", "3", "Ef", "g,h", "zz", "i"]
        probe = "".join(w + b for w, b in zip(words, ("  ", "\t", " \n", "\x0b", "\r\n", "\x0c ", "")))
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        own = [i for w in words for i in self.encode(w)]
        return self.encode(probe) == own and self.encode(f"\n {probe} ") == own and not any(b in t for t in added for b in _BLANK.decode())

    def encode(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def pack(self, ids: list[int]) -> bytes:
        return np.array(ids, self.kind).tobytes()

    def _split_off(self, mark: bytes) -> bytes | None:
        """The ids of a mark if the tokenizer always takes it for a word of its own after a letter, else None."""
        split = self.tokenizer.pre_tokenizer and self.tokenizer.pre_tokenizer.pre_tokenize_str(f"ab{mark.decode()}")
        return self.pack(self.encode(mark.decode())) if split and [p for p, _ in split] == ["ab", mark.decode()] else None

    def _learn_all(self, words: list[bytes]) -> None:
        """Learn new words; one that ends in a mark after a letter is put together from the word without it."""
        young, marks, alone, marked = self.young, self.marks, [], []
        for w in words:
            if len(w) > 1 and marks.get(w[-1]) is not None and (97 <= w[-2] <= 122 or 65 <= w[-2] <= 90):
                marked.append(w)
                if (stem := w[:-1]) not in young:
                    if stem in self.old:
                        young[stem] = self.old[stem]
                    else:
                        alone.append(stem)
            else:
                alone.append(w)
        self._learn(list(dict.fromkeys(alone)))
        for w in marked:
            young[w] = young[w[:-1]] + marks[w[-1]]

    def _learn(self, words: list[bytes]) -> None:
        """Encode new words. Those of letters only go together: if their text has as many word ends as words, each has one."""
        single, letters, width = [], [], self.kind.itemsize
        for w in words:
            (letters if self.suffix and w.decode().isalpha() else single).append(w)
        for i in range(0, len(letters), 256):
            part = letters[i : i + 256]
            ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(part).decode()], add_special_tokens=False)[0].ids, self.kind)
            at = (np.flatnonzero(self.ends[ids]) + 1) * width
            raw = ids.tobytes()
            if len(at) == len(part) and at[-1] == len(raw):
                start = 0
                for w, end in zip(part, at.tolist()):
                    self.young[w] = raw[start:end]
                    start = end
            else:
                single += part
        for i in range(0, len(single), 4096):
            part = single[i : i + 4096]
            for word, e in zip(part, self.tokenizer.encode_batch_fast([w.decode() for w in part], add_special_tokens=False)):
                self.young[word] = self.pack(e.ids)

    def words(self, words: list[bytes]) -> list[bytes]:
        """The packed ids of distinct words without white space; what is new is encoded once."""
        young, old = self.young, self.old
        found = [young.get(w) for w in words]
        if None in found:
            new = []
            for w, x in zip(words, found):
                if x is None:
                    if w in old:
                        young[w] = old[w]
                    else:
                        new.append(w)
            if new:
                self._learn_all(new)
            found = [young[w] if x is None else x for w, x in zip(words, found)]
        if len(young) > KNOWN_WORDS:
            self.old, self.young = young, {}
        return found

    def chunk(self, raw: bytes) -> list[int]:
        """The ids of a chunk. ASCII white space always separates words for the tokenizer."""
        words = raw.split()
        distinct = list(dict.fromkeys(words))
        ids = dict(zip(distinct, self.words(distinct)))
        return np.frombuffer(b"".join([ids[w] for w in words]), self.kind).tolist()

    def join(self, left: bytes, right: bytes, left_ids: list[int], right_ids: list[int]) -> tuple[int, list[int], int]:
        """(n, ids, m): at the join the last n ids of the left and the first m of the right give way to ids.

        The stretch begins with one word on each side and grows until encoding it agrees with its parts, or holds
        both texts whole.
        """
        a, b = len(left), 0
        while True:
            a = max(_word_before(left, a), 0)
            b = min(_word_after(right, b), len(right))
            before, after = self.chunk(left[a:]), self.chunk(right[:b])
            both = self.encode((left[a:] + right[:b]).decode())
            if both == before + after and left_ids[len(left_ids) - len(before) :] == before and right_ids[: len(after)] == after:
                return 0, [], 0
            if a == 0 and b == len(right):
                return len(left_ids), self.encode((left + right).decode()), len(right_ids)

    def decode(self, ids: list[int]) -> bytes:
        if self.plain:  # without a decoder the library puts a blank between pieces
            return b" ".join(map(self.pieces.__getitem__, ids))
        return self.tokenizer.decode(ids, skip_special_tokens=False).encode()


_BLANK = b" \t\n\x0b\x0c\r"


def _word_before(text: bytes, at: int) -> int:
    body = text[:at].rstrip(_BLANK)
    return max(body.rfind(c) for c in (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")) + 1


def _word_after(text: bytes, at: int) -> int:
    while at < len(text) and text[at] in _BLANK:
        at += 1
    while at < len(text) and text[at] not in _BLANK:
        at += 1
    return at


class _Chunks:
    """Of a group of documents: where chunks begin, their documents, and the distinct ones by a key and a second hash."""

    def __init__(self, table: pa.Table):
        self.data, self.off = tk.utf8(table["text"])
        starts, ends, keys, checks = [], [], [], []
        for first, data, off in tk.blocks(table["text"]):
            n, base = len(data), self.off[first]
            if not n:
                continue
            cut = np.zeros(n + 1, bool)
            at = np.flatnonzero((data[:-1] == 32) | (data[:-1] == 10)) + 1
            # the hashed bytes are the document's own, or cuts would depend on what stands before it in the block
            at = at[at - off[np.searchsorted(off, at, side="right") - 1] >= ROLL]
            at = at[tk.SPACE_WORDS[data[at]]]
            # one candidate in so many, so that chunks have about MEAN_CHUNK bytes; words have about six
            cut[at[tk.span_hashes(data, at - ROLL, at) % tk.U(MEAN_CHUNK // 6) == 0]] = True
            cut[off] = True
            start = np.flatnonzero(cut[:n])
            end = np.append(start[1:], n)
            starts.append(start + base)
            ends.append(end + base)
            keys.append(tk.span_hashes(data, start, end))
            checks.append(tk.span_hashes(data, start, end, _SECOND))
        join = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
        self.start, self.end = join(starts, np.int64), join(ends, np.int64)
        self.doc_off = np.searchsorted(self.start, self.off)
        self.key, self.first = _distinct(join(keys, np.uint64), join(checks, np.uint64))
        self.keys, self.checks = join(keys, np.uint64)[self.first], join(checks, np.uint64)[self.first]
        self.raw = self.data.tobytes()

    def text(self, i: int) -> bytes:
        return self.raw[self.start[i] : self.end[i]]

    def encode(self, codec: Codec, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many of each) of these distinct chunks, every distinct word encoded once."""
        words = tk.find_words(self.data, self.off, tk.SPACE_WORDS)
        low, high = (np.searchsorted(words.start, x[self.first[which]]) for x in (self.start, self.end))
        at = tk.ranges(low, high - low)
        start, end = words.start[at], words.end[at]
        number, first = _distinct(tk.span_hashes(self.data, start, end))
        odd = np.flatnonzero(~_same(self.data, self.raw, start, end, start[first][number], end[first][number]))
        number[odd], first = len(first) + np.arange(len(odd)), np.concatenate((first, odd))  # a hash that two words have
        packed = codec.words([self.raw[a:b] for a, b in zip(start[first].tolist(), end[first].tolist())])
        flat = np.frombuffer(b"".join(packed), codec.kind)
        size = np.fromiter(map(len, packed), np.int64, len(packed)) // codec.kind.itemsize
        begin = np.cumsum(size) - size
        total = np.concatenate(([0], np.cumsum(size[number])))
        edge = np.concatenate(([0], np.cumsum(high - low)))
        return flat[tk.ranges(begin[number], size[number])], np.diff(total[edge])


def _distinct(*hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of each item, an item of each number): equal items are those of equal hashes; numbers in order of the hashes."""
    order = np.lexsort(hashes[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for h in hashes:
        new[1:] |= h[order[1:]] != h[order[:-1]]
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    return number, order[new]


def _same(data: np.ndarray, raw: bytes, start, end, other_start, other_end) -> np.ndarray:
    """Whether two ranges have the same bytes, pair by pair."""
    same = end - start == other_end - other_start
    loads = tk.words8(data)
    left = np.flatnonzero(same)
    for j in range(0, 64, 8):
        a, b = loads[start[left] + j], loads[other_start[left] + j]
        size = np.minimum(end[left] - start[left] - j, 8)
        same[left] &= (a ^ b) & tk._MASK[size] == 0
        left = left[(end[left] - start[left] > j + 8) & same[left]]
        if not len(left):
            return same
    for i in left.tolist():
        same[i] = start[i] == other_start[i] or raw[start[i] : end[i]] == raw[other_start[i] : other_end[i]]
    return same


def _ask(parts: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        chunks = _Chunks(table)
        return ex.ask_table(key[0].as_py(), chunks.keys, chunks.checks, parts)

    return run


def _owner(index: np.ndarray, check: np.ndarray, sender: np.ndarray) -> np.ndarray:
    """0: no other group has the chunk; 1: this group encodes it for others; 2: another does."""
    index, _ = _distinct(index, check)
    many = np.bincount(index) > 1
    order = np.lexsort((sender, index))
    lead = np.zeros(len(index), bool)
    lead[order[np.flatnonzero(np.diff(index[order], prepend=-1))]] = True
    return np.where(many[index], np.where(lead, 1, 2), 0).astype(np.uint8)


def _encode_owned(parts: int, path: str, content):
    def run(key: tuple, table: pa.Table, replies: pa.Table) -> pa.Table:
        out = []
        if table.num_rows:
            codec, chunks = Codec.load(path, content.value), _Chunks(table)
            owned = np.flatnonzero(ex.answers(replies, np.uint8) == 1)
            ids, counts = chunks.encode(codec, owned)
            ids_at = np.concatenate(([0], np.cumsum(counts)))
            at = np.concatenate(([0], ex.cuts(chunks.keys[owned], parts), [len(owned)]))
            for p in np.flatnonzero(np.diff(at)):
                s = slice(at[p], at[p + 1])
                out.append((key[0].as_py(), int(p), s.stop - s.start, tk.pack(chunks.keys[owned[s]], delta=True), tk.pack(chunks.checks[owned[s]]), tk.pack(ids[ids_at[s.start] : ids_at[s.stop]].astype(np.uint32)), tk.pack(counts[s].astype(np.uint32))))
        cols = list(zip(*out)) or [()] * len(_IDS)
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _IDS)], schema=_IDS)

    return run


def _deliver(key: tuple, asks: pa.Table, encoded: pa.Table) -> pa.Table:
    """Of a part: to each group that asked the ids of the shared chunks that another group has encoded."""
    if not encoded.num_rows:
        return _IDS.empty_table()
    rows = lambda table, name, kind, delta=False: [tk.unpack(x, kind, delta=delta) for x in table[name].to_pylist()]
    keys, ids, counts = rows(encoded, "keys", np.uint64, True), np.concatenate(rows(encoded, "data", np.uint32)), np.concatenate(rows(encoded, "counts", np.uint32)).astype(np.int64)
    owner = np.repeat(encoded["g"].to_numpy(), [len(k) for k in keys])
    asked = rows(asks, "keys", np.uint64, True)
    number, _ = _distinct(np.concatenate(keys + asked), np.concatenate(rows(encoded, "pay", np.uint64) + rows(asks, "pay", np.uint64)))
    at = np.cumsum(counts) - counts
    place_of = np.full(len(number), -1)
    place_of[number[: len(owner)]] = np.arange(len(owner))
    out, done = [], len(owner)
    for g, p, own in zip(asks["g"].to_pylist(), asks["p"].to_pylist(), asked):
        place = place_of[number[done : done + len(own)]]
        done += len(own)
        place = place[(place >= 0) & (owner[place] != g)]
        if len(place):
            out.append((g, p, len(place), None, None, tk.pack(ids[tk.ranges(at[place], counts[place])]), tk.pack(counts[place].astype(np.uint32))))
    cols = list(zip(*out)) or [()] * len(_IDS)
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _IDS)], schema=_IDS)


def _disagree(codec: Codec, chunks: _Chunks, ids: np.ndarray, at: np.ndarray) -> set[int]:
    """Documents with a join at which encoding the two words around it together does not give the ids on both sides."""
    inner = np.ones(len(chunks.start), bool)
    inner[chunks.doc_off[:-1][chunks.doc_off[:-1] < len(inner)]] = False
    joins = np.flatnonzero(inner)
    raw, edges, words = chunks.raw, [], {}
    for i in joins.tolist():
        left, right = raw[chunks.start[i - 1] : chunks.end[i - 1]], raw[chunks.start[i] : chunks.end[i]]
        edges.append((left[max(_word_before(left, len(left)), 0) :], right[: _word_after(right, 0)]))
        words |= dict.fromkeys(w for e in edges[-1] for w in e.split())
    packed = dict(zip(words, codec.words(list(words))))
    texts = list(dict.fromkeys(a + b for a, b in edges))
    both = {t: e.ids for t, e in zip(texts, codec.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False))}
    out = set()
    for i, (a, b) in zip(joins.tolist(), edges):
        before, after = (np.frombuffer(b"".join([packed[w] for w in x.split()]), codec.kind).tolist() for x in (a, b))
        left, right = at[chunks.key[i - 1] + 1], at[chunks.key[i]]
        if both[a + b] != before + after or ids[left - len(before) : left].tolist() != before or ids[right : right + len(after)].tolist() != after:
            out.add(int(np.searchsorted(chunks.doc_off, i, side="right")) - 1)
    return out


def _repaired(codec: Codec, chunks: _Chunks, d: int, ids: np.ndarray, at: np.ndarray) -> list[int]:
    """The ids of a document with joins that disagree: chunks at such a join count as one from there on."""
    whole, before = [], None
    for i in range(chunks.doc_off[d], chunks.doc_off[d + 1]):
        k, text = chunks.key[i], chunks.text(i)
        new = ids[at[k] : at[k + 1]].tolist()
        if before is not None:
            n, again, m = codec.join(before[0], text, before[1], new)
            if n or m:
                whole = whole[: len(whole) - n]
                text, new = before[0] + text, again
        whole += new
        before = text, new
    return whole


def _assemble(path: str, content, digests: bool, decoded: bool):
    kinds = [("ids_sha256", pa.string()), ("decoded_sha256", pa.string())] if digests else [("ids", pa.list_(pa.int32()))] + [("decoded", pa.string())] * decoded
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), *kinds])

    def run(key: tuple, table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            return schema.empty_table()
        codec, chunks = Codec.load(path, content.value), _Chunks(table)
        kind = replies["kind"].to_numpy()
        code = ex.answers(replies.filter(pa.array(kind == 0)), np.uint8)
        found = replies.filter(pa.array(kind == 1))
        order = np.argsort(found["p"].to_numpy()).tolist()
        sent, sizes = ([tk.unpack(found[c][i].as_py(), np.uint32) for i in order] for c in ("data", "counts"))
        own = np.flatnonzero(code != 2)
        ids, counts = chunks.encode(codec, own)
        # ids of all distinct chunks, the own ones and then those received
        place, size = np.empty(len(code), np.int64), np.zeros(len(code), np.int64)
        place[own], place[code == 2] = np.arange(len(own)), len(own) + np.arange(len(code) - len(own))
        size = np.concatenate((counts, *sizes)).astype(np.int64)
        ids = np.concatenate((ids, *[x.astype(codec.kind) for x in sent]))
        begin = (np.cumsum(size) - size)[place]
        size = size[place]
        ids = ids[tk.ranges(begin, size)]
        at = np.concatenate(([0], np.cumsum(size)))
        broken = _disagree(codec, chunks, ids, at)
        flat = ids[tk.ranges(at[chunks.key], size[chunks.key])]
        edge = np.concatenate(([0], np.cumsum(size[chunks.key])))[chunks.doc_off]
        rows = [flat[edge[d] : edge[d + 1]] if d not in broken else np.array(_repaired(codec, chunks, d, ids, at), codec.kind) for d in range(table.num_rows)]
        out = [table["doc_id"].combine_chunks(), pa.array([len(r) for r in rows], pa.int64())]
        if digests:
            lists = [r.tolist() for r in rows]
            out.append(pa.array([hashlib.sha256(b" ".join(map(codec.numbers.__getitem__, x))).hexdigest() for x in lists], pa.string()))
            out.append(pa.array([hashlib.sha256(codec.decode(x)).hexdigest() for x in lists], pa.string()))
        else:
            offsets = np.concatenate(([0], np.cumsum([len(r) for r in rows])))
            out.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(rows).astype(np.int32))))
            if decoded:
                out.append(pa.array([codec.decode(r.tolist()).decode() for r in rows], pa.string()))
        return pa.Table.from_arrays(out, schema=schema)

    return run


def encode_documents(docs: DataFrame, path: str, digests: bool = False, decoded: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) for every row of documents; with digests (ids_sha256, decoded_sha256) for the two.

    docs: doc_id long, text string; other columns are ignored. path: a tokenizers file, read on the driver; one for which
    white space does not separate words raises ValueError. ids are those of the library's encode without special tokens,
    truncation and padding, decoded what its decode gives with special tokens kept (left out with decoded=False). A null
    text counts as empty and has no ids; repeated rows are encoded each; a text without blanks is one chunk. An empty table
    gives an empty one.
    """
    spark = docs.sparkSession
    tk.ship(spark)
    with open(path, "rb") as f:
        raw = f.read()
    if not Codec(raw).separates():
        raise ValueError(f"{path}: white space does not separate words for this tokenizer")
    content = spark.sparkContext.broadcast(raw)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    grouped, parts, _ = ex.grouped(docs, "doc_id", "text")
    asks = grouped.groupBy("g").applyInArrow(tk.tidy(_ask(parts)), ex.ASK)
    codes = ex.merge(asks, _owner, np.uint64)
    encoded = grouped.groupBy("g").cogroup(codes.groupBy("g")).applyInArrow(tk.tidy(_encode_owned(parts, path, content), keeps=True), _IDS_DDL)
    sent = asks.groupBy("p").cogroup(encoded.groupBy("p")).applyInArrow(tk.tidy(_deliver, keeps=True), _IDS_DDL)
    replies = codes.select("g", "p", "data", F.lit(None).cast("binary").alias("counts"), F.lit(0).alias("kind")).unionByName(sent.select("g", "p", "data", "counts", F.lit(1).alias("kind")))
    ddl = "doc_id long, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>" + ", decoded string" * decoded)
    return grouped.groupBy("g").cogroup(replies.groupBy("g")).applyInArrow(tk.tidy(_assemble(path, content, digests, decoded), keeps=True), ddl)
