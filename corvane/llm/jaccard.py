"""N-gram Jaccard join, size-aware: fixed-size subsets for small sets, inverted lists for large ones.

Sets are the distinct word shingles of each document. Documents with equal sets form a class, and only the smallest
doc_id of each takes part further. Elements are ordered by their number of classes, rarest first, so two sets
of similarity t share the first c of their common elements within the first n - ceil(t n) + c elements of each
(prefix filter, c = 1 or 2), and an element that only one class has can be left out:

* small sets (up to the boundary) put out every 2-element subset of that prefix (c = 2);
* large sets are posted to the inverted lists of their prefix elements (c = 1), and so are small sets that are
  large enough to be similar to a large one.

The boundary minimises the subsets that small sets put out plus the list entries that large sets scan; both are summed
by size, in geometric steps of size, over all sets.

Sets that share a subset or list meet at the list's smallest document, the hub. Its members are dealt into blocks of
about ``BLOCK_ROWS`` rows. First each block is a task of its own, with the hub added: exact overlaps are counted, pairs
that are already connected are left out, and what is returned is a spanning forest. Members connected to the hub are
one component from then on, so a family of near copies is done after work in proportion to its size. Only the others
are compared across blocks, with each other and with the hub's component, a pair of blocks at a time. Nothing is capped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as ex
from . import textkit as tk
from .graph import components
from .storage import drop, table

BLOCK_ROWS = 128
LEAST_FILES = 24  # of an intermediate table; larger inputs have one for 8 groups of documents
STEP = 1.05  # of the size histogram
SIGNATURES = 1 << 16  # that a batch has, about
GROUP_SIGNATURES, PART_SIGNATURES = 1 << 19, 1 << 20  # of a group of sets, and of a part of the hash space, about
PIECE = 1 << 18  # signatures of one set that a group gets

_FP = "g int, doc_id long, n_shingles long, f1 long, f2 long"
_PRINT = ["n_shingles", "f1", "f2"]
HOT_SHARE = 1000  # a class with one row in so many is hot; there are at most so many of them
_SETS = "doc_id long, n long, elements array<long>, n_first int, scan double, blob binary"


def _sets_of(table_: pa.Table, n: int, rows: np.ndarray | None = None):
    """(row numbers, values, offsets) by block, of all rows or some."""
    text = table_["text"].combine_chunks()
    if rows is not None:
        text = text.take(pa.array(rows))
    for first, data, off in tk.blocks(text):
        values, at = tk.shingle_sets(tk.lower(data), off, n)
        yield first, values, at


def fingerprints(docs: DataFrame, n: int) -> DataFrame:
    """(g, doc_id, n_shingles, f1, f2) of (g, doc_id, text): the size and a 128-bit fingerprint of every shingle set."""

    def run(batches):
        for batch in batches:
            size, f1, f2 = [], [], []
            for _, values, at in _sets_of(pa.Table.from_batches([batch]), n):
                size.append(np.diff(at))
                for to, key in ((f1, 0x9E3779B97F4A7C15), (f2, 0xD1B54A32D192ED03)):
                    total = np.concatenate((np.zeros(1, np.uint64), tk.mix(values ^ tk.U(key)).cumsum(dtype=np.uint64)))
                    to.append(total[at[1:]] - total[at[:-1]])
            if size:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.concatenate(size), pa.int64()), *(pa.array(np.concatenate(x).view(np.int64)) for x in (f1, f2))], names=["g", "doc_id", "n_shingles", "f1", "f2"])

    return docs.mapInArrow(tk.tidy_map(run), _FP)


def _element_counts(docs: DataFrame, reps: DataFrame, n: int, parts: int) -> DataFrame:
    """Replies to each group: in how many classes each of its shingles occurs."""

    def ask(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        g = key[0].as_py()
        rows = np.flatnonzero(np.isin(left["doc_id"].to_numpy(), right["doc_id"].to_numpy())) if left.num_rows and right.num_rows else np.zeros(0, int)
        found = [v for _, v, _ in _sets_of(left, n, rows)] if len(rows) else []
        keys, counts = np.unique(np.concatenate(found) if found else np.zeros(0, np.uint64), return_counts=True)
        return ex.ask_table(g, keys, counts.astype(np.uint32), parts)

    asks = docs.groupBy("g").cogroup(reps.groupBy("g")).applyInArrow(tk.tidy(ask), ex.ASK)

    def count(index, pay, _):
        return np.bincount(index, weights=pay).astype(np.uint32)[index]

    return ex.merge(asks, count, np.uint32)


def _candidates(docs: DataFrame, reps: DataFrame, replies: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """One row for each class that shares a prefix element: its prefix without unique elements, and its set."""

    def collect(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            is_rep = right["p"].to_numpy() < 0
            ids = left["doc_id"].to_numpy()
            rows = np.flatnonzero(np.isin(ids, right["doc_id"].filter(pa.array(is_rep)).to_numpy()))
            sets = list(_sets_of(left, n, rows))
            keys = np.unique(np.concatenate([v for _, v, _ in sets]) if sets else np.zeros(0, np.uint64))
            counts = ex.answers(right.filter(pa.array(~is_rep)), np.uint32)
            for first, values, at in sets:
                size = np.diff(at)
                df = counts[np.searchsorted(keys, values)]
                owner = np.repeat(np.arange(len(size)), size)
                order = np.lexsort((values, df, owner))
                rank = np.arange(len(values)) - at[owner]
                need = (num * size + den - 1) // den
                shared = df[order] > 1
                in_one, in_two = (rank < (size - need + c)[owner] for c in (1, 2))
                for d in np.unique(owner[in_one & shared]):
                    s = slice(at[d], at[d + 1])
                    two, one = in_two[s] & shared[s], in_one[s] & shared[s]
                    elements = values[order[s][two]].view(np.int64)
                    out.append((int(ids[rows[first + d]]), int(size[d]), elements, int(one.sum()), float((df[order[s]][one] - 1).sum()), tk.pack(values[s], delta=True)))
        cols = list(zip(*out)) or [()] * 6
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.float64(), pa.binary())
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "n", "elements", "n_first", "scan", "blob"])

    right = reps.select("g", F.lit(-1).alias("p"), F.lit(0).alias("n"), F.lit(None).cast("binary").alias("data"), "doc_id").unionByName(replies.withColumn("doc_id", F.lit(None).cast("long")))
    return docs.groupBy("g").cogroup(right.groupBy("g")).applyInArrow(tk.tidy(collect), _SETS)


def boundary(sets: DataFrame) -> int:
    """The last step of the size histogram that counts as small. Reads one row for each geometric step of size."""
    steps = sorted(
        sets.groupBy(_step("n").alias("step")).agg(F.sum(F.size("elements").cast("double") * (F.size("elements") - 1) / 2).alias("subsets"), F.sum("scan").alias("scan")).collect(),
        key=lambda r: r["step"],
    )
    cost, best, at = sum(r["scan"] for r in steps), None, -1
    best = cost
    for r in steps:
        cost += r["subsets"] - r["scan"]
        if cost < best:
            best, at = cost, r["step"]
    return at


def _step(n) -> F.Column:
    return F.floor(F.log(F.col(n).cast("double")) / F.lit(float(np.log(STEP)))).cast("int")


def _asking(sets: DataFrame, last_small: int, num: int, den: int) -> DataFrame:
    """(doc_id, small, lists, elements, n_first, m): which sets put out subsets, which are in lists, and how many signatures that makes."""
    small = _step("n") <= last_small
    lists = ~small | (F.col("n") * den >= F.lit(num * float(STEP ** (last_small + 1)) - den))
    subsets = (F.size("elements").cast("long") * (F.size("elements") - 1) / 2).cast("long")
    m = F.when(F.col("lists"), F.col("n_first").cast("long")).otherwise(0) + F.when(F.col("small"), subsets).otherwise(0)
    return sets.select("doc_id", small.alias("small"), lists.alias("lists"), "elements", "n_first").withColumn("m", m)


def _signed(e: np.ndarray, n_first: int, small: bool, lists: bool, piece: int = 0, pieces: int = 1) -> np.ndarray:
    """The signatures of a set, or one of several pieces of them."""
    i = np.arange(piece, len(e) - 1 if small else 0, pieces)
    size = len(e) - 1 - i
    subsets = tk.mix(np.repeat(tk.mix(e[i] ^ tk.U(0x9E3779B97F4A7C15)), size) + e[tk.ranges(i + 1, size)])
    return np.concatenate((tk.mix(e[:n_first][piece::pieces] ^ tk.U(0xD1B54A32D192ED03)), subsets)) if lists else subsets


def _rows_of(rows: pa.Table | pa.RecordBatch, *names: str):
    """The named columns as numpy values, row by row, behind the elements of each."""
    elements = (e.values.to_numpy().view(np.uint64) for e in rows["elements"])
    return zip(elements, *(rows[c].to_numpy(zero_copy_only=False) if isinstance(rows, pa.RecordBatch) else rows[c].to_numpy() for c in names))


def _signatures(sets: DataFrame, last_small: int, num: int, den: int) -> DataFrame:
    """(doc_id, sig): the subsets of small sets and the list entries of large ones, in one pass over the sets and in pieces of about SIGNATURES.

    The plain form of what _members sends packed."""

    def run(batches):
        for batch in batches:
            ids, size, out = [], 0, []
            for e, doc_id, n_first, small, lists, m in _rows_of(batch, "doc_id", "n_first", "small", "lists", "m"):
                pieces = max(1, int(m) // SIGNATURES)
                for piece in range(pieces):
                    out.append(_signed(e, n_first, small, lists, piece, pieces))
                    ids.append(np.full(len(out[-1]), doc_id))
                    size += len(out[-1])
                    if size >= SIGNATURES:
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids), pa.int64()), pa.array(np.concatenate(out).view(np.int64))], names=["doc_id", "sig"])
                        ids, size, out = [], 0, []
            if size:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids), pa.int64()), pa.array(np.concatenate(out).view(np.int64))], names=["doc_id", "sig"])

    return _asking(sets, last_small, num, den).mapInArrow(tk.tidy_map(run), "doc_id long, sig long")


def _members(sets: DataFrame, last_small: int, num: int, den: int) -> DataFrame:
    """(hub, doc_id): the sets that share a signature with another, with the smallest doc_id of those that share it; the hub has no row of its own.

    Sets are dealt into groups of about GROUP_SIGNATURES. A group sends its distinct signatures, each with the smallest doc_id that it has there, and hears the smallest of all:
    a signature of very many documents costs one entry for each group. A set with more signatures than PIECE is dealt into several groups.
    """
    rows = _asking(sets, last_small, num, den).where("m > 0")
    total = rows.agg(F.sum("m")).first()[0] or 0
    groups, parts = max(ex.LEAST, total // GROUP_SIGNATURES), max(8, total // PART_SIGNATURES)
    pieces = F.ceil(F.col("m") / PIECE).cast("int")
    rows = rows.withColumn("pieces", pieces).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).drop("m")
    rows = rows.withColumn("g", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(groups)).cast("int"))

    def signed(table_: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        found = [_signed(e, *how) for e, *how in _rows_of(table_, "n_first", "small", "lists", "piece", "pieces")]
        return np.concatenate(found), np.repeat(table_["doc_id"].to_numpy(), [len(x) for x in found])

    def ask(key: tuple, own: pa.Table) -> pa.Table:
        sigs, ids = signed(own)
        order = np.lexsort((ids, sigs))
        keys, at = np.unique(sigs[order], return_index=True)
        return ex.ask_table(key[0].as_py(), keys, ids[order][at], parts)

    def smallest(index, pay, _):
        low = np.full(int(index.max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(low, index, pay)
        return low[index]

    def meet(key: tuple, own: pa.Table, replies: pa.Table) -> pa.Table:
        sigs, ids = signed(own)
        hubs = ex.answers(replies, np.int64)[np.unique(sigs, return_inverse=True)[1]]
        hubs, ids = hubs[hubs != ids], ids[hubs != ids]
        order = np.lexsort((ids, hubs))
        hubs, ids = hubs[order], ids[order]
        new = np.ones(len(ids), bool)
        new[1:] = (hubs[1:] != hubs[:-1]) | (ids[1:] != ids[:-1])
        return pa.table({"hub": pa.array(hubs[new], pa.int64()), "doc_id": pa.array(ids[new], pa.int64())})

    replies = ex.merge(rows.groupBy("g").applyInArrow(tk.tidy(ask), ex.ASK), smallest, np.int64)
    return rows.groupBy("g").cogroup(replies.groupBy("g")).applyInArrow(tk.tidy(meet), "hub long, doc_id long").distinct()


def _connect(members: pa.Table, comp: np.ndarray, num: int, den: int, across: np.ndarray | None = None) -> np.ndarray:
    """The components of the members after all links between them, beginning with comp; across: only pairs that differ in it."""
    sets = [tk.unpack(x, np.uint64, delta=True) for x in members["blob"].to_pylist()]
    size = np.array([len(s) for s in sets])
    at = np.concatenate(([0], np.cumsum(size)))
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    mark = np.zeros(int(flat.max()) + 1, bool)
    for i in range(len(sets)):
        other = (comp != comp[i]) & (size * den >= num * size[i]) & (size[i] * den >= num * size)
        if across is not None:
            other &= across != across[i]
        todo = np.flatnonzero(other)
        if not len(todo):
            continue
        own = flat[at[i] : at[i + 1]]
        mark[own] = True
        hit = mark[flat[tk.ranges(at[todo], size[todo])]]
        mark[own] = False
        overlap = np.add.reduceat(hit, np.concatenate(([0], np.cumsum(size[todo])[:-1])), dtype=np.int64)
        linked = todo[overlap * den >= num * (size[todo] + size[i] - overlap)]
        if len(linked):
            comp[np.isin(comp, comp[linked])] = comp[i]
    return comp


def _roots(ids: np.ndarray, comp: np.ndarray) -> np.ndarray:
    """Of each member the smallest doc_id of its component."""
    _, comp = np.unique(comp, return_inverse=True)
    root = np.full(len(ids), np.iinfo(np.int64).max)
    np.minimum.at(root, comp, ids)
    return root[comp]


def _within_block(num: int, den: int):
    def run(key: tuple, members: pa.Table) -> pa.Table:
        ids = members["doc_id"].to_numpy()
        root = _roots(ids, _connect(members, np.unique(ids, return_inverse=True)[1], num, den))  # sets of one doc_id belong together
        return pa.table({"hub": members["hub"].combine_chunks(), "doc_id": pa.array(ids, pa.int64()), "root": pa.array(root, pa.int64())})

    return run


def _across_blocks(num: int, den: int):
    def run(key: tuple, members: pa.Table) -> pa.Table:
        ids, root = members["doc_id"].to_numpy(), members["root"].to_numpy()
        across = None if key[1].as_py() == key[2].as_py() else members["block"].to_numpy()
        found = _roots(ids, _connect(members, np.unique(root, return_inverse=True)[1], num, den, across))
        keep = found != ids
        return pa.table({"a": pa.array(ids[keep], pa.int64()), "b": pa.array(found[keep], pa.int64())})

    return run


def links(docs: DataFrame, parts: int, files: int, reps: DataFrame, n: int, num: int, den: int) -> tuple[DataFrame, list[DataFrame]]:
    """A spanning forest (a, b) of the links between class representatives, and the tables that it is read from. docs: (g, doc_id, text); reps: (g, doc_id)."""
    replies = _element_counts(docs, reps, n, parts)
    sets = table(_candidates(docs, reps, replies, n, num, den), files)
    members = table(_members(sets, boundary(sets), num, den), files)
    count_blocks = F.ceil(F.count("*") / BLOCK_ROWS).cast("int")
    dealt = F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int").alias("block")
    # few hubs have more members than a block: their sizes are a small table, so that Spark need not bring a hub's members together
    large = table(members.groupBy("hub").agg(count_blocks.alias("blocks")).where("blocks > 1"), files)
    own = members.join(large, "hub", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).select("hub", dealt, "doc_id")
    with_hub = own.select("hub", "block").distinct().select("hub", "block", F.col("hub").alias("doc_id"))
    blobs = sets.select("doc_id", "blob")
    local = table(own.unionByName(with_hub).join(blobs, "doc_id").groupBy("hub", "block").applyInArrow(tk.tidy(_within_block(num, den)), "hub long, doc_id long, root long"), files)
    edges = local.where("root <> doc_id").select(F.col("doc_id").alias("a"), F.col("root").alias("b"))

    # what is not connected to its hub yet, against itself and against what is
    left = table(local.join(large.select("hub"), "hub", "left_semi").where("doc_id <> hub"), files)
    alone, joined = left.where("root <> hub"), left.where("root = hub")
    sizes = alone.groupBy("hub").agg(count_blocks.alias("blocks"))
    dealt_to = lambda rows, sizes: rows.join(sizes, "hub").select("hub", "doc_id", "root", dealt)
    one = dealt_to(alone, sizes)
    other = dealt_to(joined.join(sizes.select("hub"), "hub", "left_semi"), joined.groupBy("hub").agg(count_blocks.alias("blocks"))).withColumn("block", -1 - F.col("block"))
    many = sizes.select("hub", F.col("blocks").alias("n_alone")).join(joined.groupBy("hub").agg(count_blocks.alias("n_joined")), "hub", "left")
    everyone = one.unionByName(other).join(many, "hub")
    partners = F.when(F.col("block") < 0, F.sequence(F.lit(0), F.col("n_alone") - 1)).otherwise(F.sequence(-F.coalesce("n_joined", F.lit(0)), F.col("n_alone") - 1))
    pairs = everyone.select("hub", "doc_id", "root", "block", F.explode(partners).alias("other")).select("hub", "doc_id", "root", "block", F.least("block", "other").alias("lower"), F.greatest("block", "other").alias("upper"))
    return edges.unionByName(pairs.join(blobs, "doc_id").groupBy("hub", "lower", "upper").applyInArrow(tk.tidy(_across_blocks(num, den)), "a long, b long")), [sets, members, large, local, left]


def jaccard_components(docs: DataFrame, n: int = 3, num: int = 9, den: int = 10) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of documents.

    docs: doc_id long, text string; other columns are ignored. Two documents link when den * intersection >= num * union
    of their distinct n-word shingles; component_id is the smallest doc_id reachable by links. Nulls and texts without
    words have n_shingles 0 and link with nothing. Rows with words that repeat a doc_id share its component; a null doc_id gets a
    null component unless its text equals another's, whose component it then shares. An empty table gives an empty one.
    """
    tk.ship(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    grouped, parts, groups = ex.grouped(docs, "doc_id", "text")
    files = max(LEAST_FILES, groups // 8)
    prints = table(fingerprints(grouped, n), files)
    worded, total = prints.where("n_shingles > 0"), prints.count()
    known = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "g"))
    classes = table(worded.groupBy(*_PRINT).agg(F.min(known).alias("rep"), F.count("*").alias("m")).select(*_PRINT, "m", F.col("rep.doc_id").alias("rep"), F.col("rep.g").alias("g")), files)
    reps = classes.where(F.col("rep").isNotNull() & (F.col("n_shingles") * (den - num) >= num)).select("g", F.col("rep").alias("doc_id"))
    # rows that repeat a doc_id are one node: classes that share one are linked
    own_print = F.struct(*_PRINT)
    several = worded.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(own_print).alias("low"), F.max(own_print).alias("high")).where("low <> high").select("doc_id")
    own = worded.join(several, "doc_id").join(classes, _PRINT).select("doc_id", "rep").distinct()
    own = table(own, files)
    same = own.join(own.groupBy("doc_id").agg(F.min("rep").alias("low")), "doc_id").select(F.col("rep").alias("a"), F.col("low").alias("b"))
    linked, used = links(grouped, parts, files, reps, n, num, den)
    found = components(linked.unionByName(same), files)
    drop(own, *used)
    classes = classes.join(found, F.col("rep") == F.col("node"), "left").select(*_PRINT, "m", F.coalesce("root", "rep").alias("component_id"))
    # a class with very many rows is sent to them: at most HOT_SHARE classes are that large
    is_hot = F.col("m") * HOT_SHARE >= F.lit(total)
    hot, rare = F.broadcast(classes.where(is_hot).drop("m")), classes.where(~is_hot).drop("m")
    rows = [worded.join(hot, _PRINT), worded.join(hot.drop("component_id"), _PRINT, "left_anti").join(rare, _PRINT), prints.where("n_shingles = 0").withColumn("component_id", F.lit(None).cast("long"))]
    out = [r.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")) for r in rows]
    return out[0].unionByName(out[1]).unionByName(out[2])
