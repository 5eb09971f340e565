"""Centroid clustering by dual-tree Lloyd: a cover tree over vectors, one over centroids, node pairs pruned by distance bounds.

Vectors become integers and are kept in blocks of ``BLOCK`` rows, each with a cover tree that is built once and written to the shared folder.
A round broadcasts the centroids, whose number is a parameter, with a cover tree of their own. Each block walks both trees at once, a level of pairs at a time:
a pair of nodes goes if even its nearest vector and centroid are further apart than what another pair guarantees to all vectors of the node. A node of
vectors with one centroid left belongs to it as a whole, and its vectors are summed without being looked at; leaves with several centroids left
are compared vector by vector in exact integers. Bounds are widened by what doubles can lose, so ties are never pruned and the
smallest number wins them. Per block only sums and counts for each centroid move.

No result depends on how vectors are dealt into blocks, so lost tasks are just run again.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .storage import drop, table

BLOCK = 2048
LEAF = 16
MOST = 1 << 27  # components from here on have squared distances beyond a long
_EXACT = 1 << 22  # up to here sums of 64 products are exact in doubles


@dataclass
class CoverTree:
    """Nodes, parents before children; ``order`` lists the points so that each node has a stretch of them."""

    order: np.ndarray
    center: np.ndarray  # the point in the middle of each node
    radius: np.ndarray  # what no point of the node exceeds in distance to it
    begin: np.ndarray
    end: np.ndarray
    child: np.ndarray  # the first child of each node and the one after its last; equal for leaves
    after: np.ndarray

    def arrays(self) -> list[np.ndarray]:
        return [self.order, self.center, self.radius, self.begin, self.end, self.child, self.after]


def cover_tree(points: np.ndarray, leaf: int = LEAF) -> CoverTree:
    """A cover tree over the rows of a matrix: a node of level i covers what is within 2**i of its middle, and the middles of its
    children are further apart than 2**(i-1). Levels on which nothing splits are left out, as are splits of ``leaf`` points and fewer and of equal points."""
    n = len(points)
    x = points.astype(np.float64)
    far = (x * x).sum(axis=1)
    far = np.sqrt(np.maximum(far[:, None] + far - 2 * (x @ x.T), 0))
    far[np.diag_indices(n)] = 0
    wide = 1e-7 * (1 + np.abs(x).max(initial=0) * x.shape[1])  # what rounding can hide
    order = np.arange(n)
    rows = [[0, float(far[0].max()), 0, n, 0, 0]]
    k = 0
    while k < len(rows):
        middle, radius, a, b, _, _ = rows[k]
        rows[k][4] = rows[k][5] = len(rows)
        if b - a > leaf and radius > 0:
            limit = 2.0 ** (np.ceil(np.log2(radius)) - 1)
            left, parts, pick = order[a:b], [], middle
            while len(left):
                near = far[pick, left] <= limit
                near |= left == pick
                parts.append((pick, left[near]))
                left = left[~near]
                pick = left[0] if len(left) else -1
            at = a
            for pick, part in parts:
                order[at : at + len(part)] = part
                rows.append([pick, float(far[pick, part].max()), at, at + len(part), 0, 0])
                at += len(part)
            rows[k][5] = len(rows)
        k += 1
    center, radius, begin, end, child, after = zip(*rows)
    ints = [np.array(v, np.int64) for v in (center, begin, end, child, after)]
    return CoverTree(order, ints[0], np.array(radius) + wide, *ints[1:])


def squared_distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of two integer matrices that belong together."""
    d = x.astype(np.int64) - y
    return (d * d).sum(axis=1)


def exact_nearest(points: np.ndarray, centroids: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each point the nearest of the numbered centroids, of equally near ones the smallest number, and the squared distance, in integers."""
    some = centroids[numbers]
    if len(points) and max(np.abs(points).max(), np.abs(some).max()) < _EXACT:
        p, c = points.astype(np.float64), some.astype(np.float64)
        d = ((p * p).sum(axis=1)[:, None] + (c * c).sum(axis=1) - 2 * (p @ c.T)).astype(np.int64)
    else:
        d = np.stack([squared_distances(points, c) for c in some], axis=1) if len(points) else np.zeros((0, len(some)), np.int64)
    best = d.argmin(axis=1)
    return numbers[best], d[np.arange(len(points)), best]


def assign(points: np.ndarray, tree: CoverTree, centroids: np.ndarray, over: CoverTree) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, np.ndarray]]]:
    """How a block's points are assigned: (begin, end, centroid) stretches that belong to one centroid as a whole, and
    (begin, end, centroids) stretches of leaves for which several are left. Stretches are of tree.order."""
    x, c = points.astype(np.float64), centroids.astype(np.float64)
    v, w = np.zeros(1, np.int64), np.zeros(1, np.int64)
    whole, open_ = [], []
    while len(v):
        gap = np.sqrt(((x[tree.center[v]] - c[over.center[w]]) ** 2).sum(axis=1))
        nodes, at = np.unique(v, return_inverse=True)
        bound = np.full(len(nodes), np.inf)
        np.minimum.at(bound, at, gap + tree.radius[v])  # the middle of w is a centroid, so no point of v has its nearest one further away
        keep = gap - tree.radius[v] - over.radius[w] <= bound[at] * (1 + 1e-9) + 1e-6
        v, w, at = v[keep], w[keep], at[keep]
        inner = over.after[w] > over.child[w]
        if inner.any():  # first down the tree of centroids
            many = np.where(inner, over.after[w] - over.child[w], 1)
            w, v = tk.ranges(np.where(inner, over.child[w], w), many), np.repeat(v, many)
            continue
        count = np.bincount(at, over.end[w] - over.begin[w], minlength=len(nodes)).astype(np.int64)
        order = np.argsort(at, kind="stable")
        v, w, at = v[order], w[order], at[order]
        first = np.searchsorted(at, np.arange(len(nodes)))
        last = np.append(first[1:], len(at))
        down = (count > 1) & (tree.after[nodes] > tree.child[nodes])
        for k in np.flatnonzero(~down):
            numbers = np.concatenate([over.order[over.begin[q] : over.end[q]] for q in w[first[k] : last[k]]])
            a, b = int(tree.begin[nodes[k]]), int(tree.end[nodes[k]])
            if len(numbers) == 1:
                whole.append((a, b, int(numbers[0])))
            else:
                open_.append((a, b, np.sort(numbers)))
        on = down[at]
        v, w = v[on], w[on]
        many = tree.after[v] - tree.child[v]
        w, v = np.repeat(w, many), tk.ranges(tree.child[v], many)
    return whole, open_


def assign_sums(points: np.ndarray, tree: CoverTree, centroids: np.ndarray, over: CoverTree) -> tuple[np.ndarray, np.ndarray]:
    """Counts and sums of a block's points for each centroid."""
    count, total = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
    sums = np.concatenate((np.zeros((1, points.shape[1]), np.int64), np.cumsum(points[tree.order], axis=0, dtype=np.int64)))
    whole, open_ = assign(points, tree, centroids, over)
    for a, b, k in whole:
        count[k] += b - a
        total[k] += sums[b] - sums[a]
    for a, b, numbers in open_:
        own = points[tree.order[a:b]]
        number, _ = exact_nearest(own, centroids, numbers)
        np.add.at(count, number, 1)
        np.add.at(total, number, own)
    return count, total


def assign_points(points: np.ndarray, tree: CoverTree, centroids: np.ndarray, over: CoverTree) -> tuple[np.ndarray, np.ndarray]:
    """The centroid of each of a block's points, and its squared distance."""
    number, far = np.zeros(len(points), np.int64), np.zeros(len(points), np.int64)
    whole, open_ = assign(points, tree, centroids, over)
    for a, b, k in whole:
        own = tree.order[a:b]
        number[own], far[own] = k, squared_distances(points[own], centroids[k])
    for a, b, numbers in open_:
        own = tree.order[a:b]
        number[own], far[own] = exact_nearest(points[own], centroids, numbers)
    return number, far


def integer_vectors(rows: DataFrame, size: int = 64, scale: int = 256) -> DataFrame:
    """(vec_id, v): floor(scale * x) of every component, of the vectors with exactly ``size`` components, none null or not finite. A component that makes a number of
    2**27 or more is an error, as squared distances would not fit a long."""
    x = F.col("embedding").cast("array<double>")
    fits = (F.size(x) == size) & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf")))
    kept = rows.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).where(F.coalesce(fits, F.lit(False)))
    whole = F.transform("x", lambda e: F.when(F.abs(scale * e) < MOST, F.floor(scale * e).cast("int")).otherwise(F.raise_error(F.lit("component too large")).cast("int")))
    return kept.select("vec_id", whole.alias("v"))


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """(ids, points, order, center, radius, begin, end, child, after): blocks of vectors with their trees, as bytes."""
    names = ("order", "center", "radius", "begin", "end", "child", "after")
    schema = pa.schema([("ids", pa.list_(pa.int64())), ("points", pa.binary()), *((n, pa.binary()) for n in names)])

    def block(ids, points):
        blobs = [a.tobytes() for a in cover_tree(points).arrays()]
        return pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(pa.int64())), pa.array([points.tobytes()], pa.binary()), *(pa.array([x], pa.binary()) for x in blobs)], schema=schema)

    def run(batches):
        ids, parts, held = [], [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                piece = batch.slice(at, BLOCK)
                ids += piece.column(0).to_pylist()
                parts.append(piece.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int32).reshape(-1, size))
                held += piece.num_rows
                if held >= BLOCK:
                    points = np.concatenate(parts)
                    yield block(ids[:BLOCK], points[:BLOCK])
                    ids, parts, held = ids[BLOCK:], [points[BLOCK:]], held - BLOCK
        if held:
            yield block(ids, np.concatenate(parts))

    return rows.mapInArrow(tk.tidy_map(run), "ids array<long>, points binary, `order` binary, center binary, radius binary, begin binary, `end` binary, child binary, after binary")


def _loaded(batch: pa.RecordBatch, size: int):
    for i in range(batch.num_rows):
        ids, points, *blobs = (batch.column(j)[i] for j in range(batch.num_columns))
        kinds = (np.int64, np.int64, np.float64, np.int64, np.int64, np.int64, np.int64)
        yield ids.as_py(), np.frombuffer(points.as_py(), np.int32).reshape(-1, size), CoverTree(*(np.frombuffer(b.as_py(), k) for b, k in zip(blobs, kinds)))


def first_centroids(vectors: DataFrame, k: int, salt: str = "2") -> np.ndarray:
    """The k vectors with the smallest hexadecimal sha256 of ``salt:vec_id``, in this order; equal ones by their components, and vectors without an id last."""
    found = vectors.orderBy(F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256).asc_nulls_last(), "v").limit(k).collect()
    return np.array([r.v for r in found], np.int64)


def cluster(rows: DataFrame, k: int = 40, rounds: int = 5, size: int = 64, scale: int = 256) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) for every vector that integer_vectors keeps.

    Centroids start as first_centroids; each round assigns every vector to the nearest one (ties: the smaller number) and moves each to the floor of its vectors' mean; those
    without vectors stay; then vectors are assigned once more. rows: vec_id, embedding; other columns are ignored. Repeated rows and equal vectors count each time,
    a null vec_id is kept, fewer vectors than k are as many centroids, and without vectors there are no rows.
    """
    spark = rows.sparkSession
    tk.ship(spark)
    vectors = integer_vectors(rows, size, scale)
    centroids = first_centroids(vectors, k)
    if not len(centroids):
        none = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
        return spark.createDataFrame([], none)
    blocks = table(_blocks(vectors, size))
    for _ in range(rounds):
        count, total = _round(blocks, centroids, size)
        for i in np.flatnonzero(count):
            centroids[i] = [int(s) // int(count[i]) for s in total[i]]
    known = spark.sparkContext.broadcast((centroids, cover_tree(centroids, 1)))

    def last(batches):
        for batch in batches:
            for ids, points, tree in _loaded(batch, size):
                number, far = assign_points(points, tree, *known.value)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(number, pa.int32()), pa.array(far, pa.int64())], names=["vec_id", "cluster", "distance"])

    assigned = table(blocks.mapInArrow(tk.tidy_map(last), "vec_id long, cluster int, distance long"))
    drop(blocks)
    sums = {r.cluster: r.s for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # at most k
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    each = spark.createDataFrame([(i, s, sum(sums.values()), digests[i]) for i, s in sums.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(each), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _round(blocks: DataFrame, centroids: np.ndarray, size: int) -> tuple[np.ndarray, list[list[int]]]:
    """Counts and sums of the vectors of each centroid: k rows reach the driver."""
    known = blocks.sparkSession.sparkContext.broadcast((centroids, cover_tree(centroids, 1)))

    def run(batches):
        count, total = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for batch in batches:
            for _, points, tree in _loaded(batch, size):
                c, t = assign_sums(points, tree, *known.value)
                count += c
                total += t
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(count[at], pa.int64()), pa.array(total[at].tolist(), pa.list_(pa.int64()))], names=["cluster", "n", "total"])

    parts = blocks.mapInArrow(tk.tidy_map(run), "cluster int, n long, total array<long>")
    sums = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("total")[i]) for i in range(size))).alias("total")).collect()
    count, total = np.zeros(len(centroids), np.int64), [[0] * size for _ in centroids]
    for r in sums:
        count[r.cluster], total[r.cluster] = r.n, r.total
    known.unpersist()
    return count, total
