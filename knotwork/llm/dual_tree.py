"""Lloyd's algorithm on whole-number vectors with a cover tree over vectors and one over centroids.

Each task packs its vectors into shards of bounded size and builds a cover tree over the
different vectors of each: the children of a node are balls of a smaller radius whose
centres are farther apart than it and which cover the node's points. The trees are
written once. A round broadcasts the centroids, whose own tree every task builds, and
walks both trees: a pair of nodes is pruned where the distance of the centres less both
radii exceeds the smallest distance of a centre to a centroid plus the vector node's
radius. A vector node left with one centroid is assigned whole, from prefix sums; at
leaves the pairs that are left are compared in exact integers. Bounds are compared with
a margin for rounding, so ties always come to the exact comparison.

Only sums by centroid and component are shuffled, added up in each task first. The driver
holds the centroids. A vector that occurs often is one point of each tree.

Defined results: vectors that are null, hold null or non-finite components or have
another length take no part, and neither do vectors with a component whose product with
256 is beyond the doubles; repeated rows and ids are vectors of their own; equal hashes
of first centroids are ordered by the vectors; a null vec_id is hashed as an empty one;
with fewer vectors than centroids each is one; an empty table gives no rows; components
of any size are computed exactly, and distances and sums above the largest long are given
as that.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import products, saved

#: Vectors in a tree, points in a leaf, and the ratio of a node's radius to its children's.
SHARD, LEAF, RATIO = 2048, 16, 1.5
#: Relative margin of bounds, and the largest component for which they are used.
MARGIN, PLAIN = 1e-9, 2.0**26
#: Bits in each part of a sum that is shuffled.
LIMB = 48
LARGEST = 2**63 - 1


def whole_vectors(vectors: DataFrame, size: int, scale: float) -> DataFrame:
    """``vec_id, vector`` of the vectors that take part, as whole numbers in doubles."""
    at = F.transform("embedding", lambda x: x.cast("double") * scale)
    bad = F.exists(at, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = vectors.where(F.col("embedding").isNotNull() & (F.size("embedding") == size)).where(~bad).select("vec_id", at.alias("vector"))

    def run(it):
        for batch in it:
            flat = np.floor(batch.column("vector").flatten().to_numpy(zero_copy_only=False))
            offsets = pa.array(np.arange(0, len(flat) + 1, size), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.ListArray.from_arrays(offsets, pa.array(flat))], names=["vec_id", "vector"])

    return kept.mapInArrow(run, f"vec_id {dict(vectors.dtypes)['vec_id']}, vector array<double>")


def cover_tree(points: np.ndarray, leaf: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of the points and the nodes (centre, radius, low, high, first child, children), the root first; a
    node holds the points low to high of the order, and its children stand side by side. Points too far apart to be
    grouped stay a leaf, unless leaves are to have one."""
    order, nodes, stack = np.arange(len(points)), [[0, 0.0, 0, len(points), 0, 0]], [0]
    while stack:
        n = stack.pop()
        low, high = nodes[n][2:4]
        rows = order[low:high]
        away = np.sqrt(((points[rows] - points[nodes[n][0]]) ** 2).sum(axis=1))
        nodes[n][1] = radius = float(away.max(initial=0.0))
        if high - low <= leaf or radius == 0:
            continue
        left, groups = rows[np.argsort(away, kind="stable")], []
        most = (high - low) // 2 if leaf > 1 else high - low
        while len(left) and len(groups) <= most:
            near = ((points[left] - points[left[0]]) ** 2).sum(axis=1) <= (radius / RATIO) ** 2
            groups.append(left[near])
            left = left[~near]
        if len(left):
            continue
        order[low:high] = np.concatenate(groups)
        nodes[n][4:] = [len(nodes), len(groups)]
        for group in groups:
            stack.append(len(nodes))
            nodes.append([int(group[0]), 0.0, low, low + len(group), 0, 0])
            low += len(group)
    place = np.empty(len(order))
    place[order] = np.arange(len(order))
    flat = np.array(nodes, float)
    flat[:, 0] = place[flat[:, 0].astype(int)]  # centres by their places in the order
    return order, flat


def plant(vectors: DataFrame) -> DataFrame:
    """Cover trees over ``vectors(vec_id, vector)``, a row each, written to the shared folder."""

    def planted(ids, rows):
        points, which, counts = np.unique(np.stack(rows), axis=0, return_inverse=True, return_counts=True)
        order, nodes = cover_tree(points, LEAF) if np.abs(points).max() <= PLAIN else (np.arange(len(points)), np.array([[0, 0.0, 0, len(points), 0, 0]]))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return {"ids": ids, "point": place[which.reshape(-1)].tolist(), "points": points[order].tobytes(), "nodes": nodes.tobytes(), "counts": counts[order].tolist()}

    kind = dict(vectors.dtypes)["vec_id"]
    types = pa.schema([("ids", pa.list_(pa.int64() if kind == "bigint" else pa.int32())), ("point", pa.list_(pa.int64())), ("points", pa.binary()), ("nodes", pa.binary()), ("counts", pa.list_(pa.int64()))])

    def run(it):
        ids, rows = [], []
        for batch in it:
            size = len(batch.column("vector")[0]) if len(batch) else 0
            matrix = batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(len(batch), size)
            for vec_id, row in zip(batch.column("vec_id").to_pylist(), matrix):
                ids.append(vec_id)
                rows.append(row)
                if len(ids) == SHARD:
                    yield pa.RecordBatch.from_pylist([planted(ids, rows)], schema=types)
                    ids, rows = [], []
        if ids:
            yield pa.RecordBatch.from_pylist([planted(ids, rows)], schema=types)

    return saved(vectors.mapInArrow(run, f"ids array<{kind}>, point array<bigint>, points binary, nodes binary, counts array<bigint>"))


def whole(x: np.ndarray, most: float) -> np.ndarray:
    """Whole numbers in doubles, in a type that holds sums of squares of differences of numbers up to ``most``."""
    if 8 * x.shape[-1] * most * most < 2.0**53:
        return x
    return x.astype(np.int64) if most <= PLAIN else np.array([[int(v) for v in row] for row in x], object).reshape(x.shape)


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of x and c."""
    most = max(np.abs(x).max(initial=0), np.abs(c).max(initial=0))
    x, c = whole(x, most), whole(c, most)
    if x.dtype == object:
        return np.array([[sum((a - b) ** 2 for a, b in zip(p, q)) for q in c] for p in x], object).reshape(len(x), len(c))
    return ((x * x).sum(axis=1)[:, None] - 2 * products(x, c) + (c * c).sum(axis=1)[None, :]).astype(np.int64)


class Centroids:
    """Centroids as whole numbers and their tree; of equal ones only the smallest number takes part."""

    def __init__(self, rows: list[list[int]]):
        self.rows = rows
        matrix = np.array([[float(v) for v in row] for row in rows])
        first = np.sort(np.unique(matrix, axis=0, return_index=True)[1])
        self.plain = np.abs(matrix).max() <= PLAIN
        order, self.nodes = cover_tree(matrix[first], 1) if self.plain else (np.arange(len(first)), None)
        self.numbers, self.points = first[order], matrix[first[order]]

    def nearest(self, x: np.ndarray, among: np.ndarray) -> np.ndarray:
        """The nearest number of each row of x, from places ``among``; ties go to the smaller number."""
        among = among[np.argsort(self.numbers[among])]
        return self.numbers[among][np.argmin(squares(x, self.points[among]), axis=1)]

    def ranges(self, points: np.ndarray, nodes: np.ndarray):
        """(low, high, numbers) that cover a tree's points: one number for a range assigned whole, else one a point;
        and how many pairs of a point and a centroid were compared exactly."""
        if not self.plain or np.abs(points).max() > PLAIN:
            yield 0, len(points), self.nearest(points, np.arange(len(self.numbers))), len(points) * len(self.numbers)
            return
        own, radii = self.nodes[:, 0].astype(int), self.nodes[:, 1]
        starts, sizes = self.nodes[:, 4].astype(int), self.nodes[:, 5].astype(int)
        stack = [(0, np.array([0]))]
        while stack:
            n, q = stack.pop()
            centre, radius, low, high, first, children = nodes[n]
            low, high, children = int(low), int(high), int(children)
            while True:
                away = np.sqrt(((self.points[own[q]] - points[int(centre)]) ** 2).sum(axis=1))
                bound = (away.min() + radius) * (1 + MARGIN) + MARGIN
                keep = (away - radius - radii[q]) * (1 - MARGIN) <= bound
                q = q[keep]
                wide = (sizes[q] > 0) & ((radii[q] >= radius) | (children == 0))
                if not wide.any():
                    break
                q = np.concatenate([q[~wide], *(np.arange(starts[k], starts[k] + sizes[k]) for k in q[wide])])
            if len(q) == 1 and not sizes[q[0]]:
                yield low, high, self.numbers[own[q[0]]], 0
            elif children:
                stack += [(int(first) + k, q) for k in range(children)]
            else:
                yield low, high, self.nearest(points[low:high], own[q]), (high - low) * len(q)


def _trees(batch, size: int):
    for row in batch.to_pylist():
        yield row, np.frombuffer(row["points"]).reshape(-1, size), np.frombuffer(row["nodes"]).reshape(-1, 6)


def _limbs(value: int):
    """(place, part) of a whole number; all but the last part are in [0, 2 ** LIMB)."""
    place = 0
    while not -(2**LIMB) < value < 2**LIMB:
        value, part = value >> LIMB, value & (2**LIMB - 1)
        if part:
            yield place, part
        place += 1
    if value:
        yield place, value


def moved(trees: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """The centroids after a round: exact floors of their vectors' means."""
    size = len(centroids[0])
    held = trees.sparkSession.sparkContext.broadcast(centroids)

    def run(it):
        now = Centroids(held.value)
        sums: dict[int, list[int]] = {}  # of each number: components and, last, the count
        for batch in it:
            for row, points, nodes in _trees(batch, size):
                counts = np.array(row["counts"], np.int64)
                most = np.abs(points).max()
                weighted = whole(points, most) * counts[:, None]
                if weighted.dtype != object and most * counts.sum() >= 2.0**53:
                    weighted = np.array([[int(v) * int(c) for v in p] for p, c in zip(points, counts)], object)
                prefix = np.concatenate([np.zeros((1, size), weighted.dtype), weighted.cumsum(axis=0)])
                counted = np.concatenate([[0], counts.cumsum()])
                for low, high, numbers, _ in now.ranges(points, nodes):
                    single = np.ndim(numbers) == 0
                    for number in [numbers] if single else np.unique(numbers):
                        mine = None if single else low + np.flatnonzero(numbers == number)
                        total = prefix[high] - prefix[low] if single else weighted[mine].sum(axis=0)
                        n = counted[high] - counted[low] if single else counts[mine].sum()
                        into = sums.setdefault(int(number), [0] * (size + 1))
                        for k, v in enumerate([*total.tolist(), int(n)]):
                            into[k] += int(v)
        out = [(number, k, place, part) for number, values in sums.items() for k, v in enumerate(values) for place, part in _limbs(v)]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.int32(), pa.int64()))], names=["number", "k", "place", "part"])

    parts = trees.mapInArrow(run, "number int, k int, place int, part long")
    totals = parts.groupBy("number", "k", "place").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("part")).collect()  # centroids * (size + 1) sums
    found: dict[tuple[int, int], int] = {}
    for number, k, place, part in totals:
        found[number, k] = found.get((number, k), 0) + (int(part) << (LIMB * place))
    return [[found.get((i, k), 0) // found[i, size] for k in range(size)] if (i, size) in found else row for i, row in enumerate(centroids)]


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, size: int = 64, scale: float = 256.0, seed: str = "2:") -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of ``vectors(vec_id, embedding)``."""
    kept = whole_vectors(vectors, size, scale)
    hashed = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = kept.select(hashed.alias("hash"), "vector").orderBy("hash", "vector").limit(k).collect()
    centroids = [[int(v) for v in row["vector"]] for row in first]
    kind = dict(vectors.dtypes)["vec_id"]
    columns = f"vec_id {kind}, cluster int, distance long, centroid_sha256 string"
    if not centroids:
        none = vectors.sparkSession.createDataFrame([], columns)
        return none.select("vec_id", "cluster", "distance", F.lit(0).cast("long").alias("cluster_inertia"), F.lit(0).cast("long").alias("inertia"), "centroid_sha256")
    trees = plant(kept)
    for _ in range(rounds):
        centroids = moved(trees, centroids)
    held = vectors.sparkSession.sparkContext.broadcast(centroids)

    def run(it):
        now = Centroids(held.value)
        digests = [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in held.value]
        matrix = np.array([[float(v) for v in row] for row in held.value])
        for batch in it:
            for row, points, nodes in _trees(batch, size):
                numbers, distances = np.zeros(len(points), np.int64), [0] * len(points)
                for low, high, found, _ in now.ranges(points, nodes):
                    numbers[low:high] = found
                for number in np.unique(numbers):
                    mine = np.flatnonzero(numbers == number)
                    for at, d in zip(mine, squares(points[mine], matrix[number : number + 1])[:, 0]):
                        distances[at] = min(int(d), LARGEST)
                which = row["point"]
                arrays = [pa.array(row["ids"], batch.schema.field("ids").type.value_type), pa.array(numbers[which], pa.int32()), pa.array([distances[p] for p in which], pa.int64())]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array([digests[numbers[p]] for p in which], pa.string())], names=["vec_id", "cluster", "distance", "centroid_sha256"])

    out = saved(trees.mapInArrow(run, columns))
    bounded = lambda total: F.least(total, F.lit(LARGEST).cast("decimal(38,0)")).cast("long")
    by_cluster = out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total"))  # a row a centroid
    everything = by_cluster.agg(bounded(F.sum("total")).alias("inertia"))
    joined = out.join(F.broadcast(by_cluster.select("cluster", bounded(F.col("total")).alias("cluster_inertia"))), "cluster").crossJoin(F.broadcast(everything))  # one row
    return joined.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
