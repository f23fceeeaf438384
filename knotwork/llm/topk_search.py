"""Exact top-k inner products by distributed histogram selection.

Scores are integers. A block of queries is matched with every vector; each task keeps
a histogram of each query's scores and passes on the highest bins that hold its k best
(a lower bin can't hold the k-th value of all). The summed histogram shows the bin of
the k-th value, the next pass divides that bin, and so on until it holds one score or
few rows. Then only rows at or above it are passed on, at most k a query and task, and
ties go to the smaller id. Queries come in blocks of bounded size, ``WAVE`` of them in one
job, so nothing that is broadcast or gathered at a time grows with the data.

Defined results: vectors that are null or hold a null or non-finite component take no
part, nor does an empty vector; a query meets only vectors of its own length and none
of its own id; repeated query rows are answered once, repeated candidate rows each
count; with fewer than k candidates all are returned.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

#: Queries that are matched at a time (a broadcast), blocks in a job, and bins of a histogram.
QUERY_BLOCK, WAVE, BINS = 2048, 8, 64


def integer_vectors(vectors: DataFrame, scale: float = 256.0) -> DataFrame:
    """(vec_id, vector of whole numbers as doubles) of the vectors that take part."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("double"))
    return vectors.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0)).where(~bad).select("vec_id", whole.alias("vector"))


def _matrices(batch) -> list[tuple[np.ndarray, np.ndarray]]:
    """Ids and matrix of the rows of each vector length."""
    ids, column = batch.column("vec_id").to_numpy(zero_copy_only=False), batch.column("vector")
    offsets = column.offsets.to_numpy()
    flat, sizes = column.values.to_numpy(zero_copy_only=False), np.diff(offsets)
    out = []
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        out.append((ids[rows], flat[(offsets[rows][:, None] + np.arange(size)[None, :])]))
    return out


def _scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer products: in doubles where they hold the sums, else in 64-bit integers."""
    if np.abs(q).max(initial=0) * np.abs(c).max(initial=0) * q.shape[1] < 2**53:
        return (q @ c.T).astype(np.int64)
    return q.astype(np.int64) @ c.astype(np.int64).T


class _Block:
    """A block of queries with each one's score range [low, low + width * BINS) in question."""

    def __init__(self, ids: np.ndarray, vectors: list[np.ndarray], k: int):
        self.ids, self.k = ids, k
        sizes = np.array([len(v) for v in vectors])
        self.by_size = {int(s): (np.flatnonzero(sizes == s), np.stack([vectors[i] for i in np.flatnonzero(sizes == s)])) for s in np.unique(sizes)}
        self.low = np.zeros(len(ids), np.int64)
        self.width = np.ones(len(ids), np.int64)
        self.above = np.zeros(len(ids), np.int64)
        self.open = np.ones(len(ids), bool)

    def matched(self, batch):
        """Query rows, candidate ids and scores, without a query's own id."""
        for ids, c in _matrices(batch):
            if c.shape[1] in self.by_size:
                rows, q = self.by_size[c.shape[1]]
                s = _scores(q, c)
                yield rows, ids, s, self.ids[rows][:, None] != ids[None, :]


def _histograms(blocks: list[_Block], vectors: DataFrame) -> list[np.ndarray]:
    """Counts of each block's scores in its queries' bins, all in one job."""

    def part(number: int) -> DataFrame:
        held = vectors.sparkSession.sparkContext.broadcast(blocks[number])

        def run(it):
            b = held.value
            counts = np.zeros((len(b.ids), BINS), np.int64)
            for batch in it:
                for rows, _, s, other in b.matched(batch):
                    at = (s - b.low[rows][:, None]) // b.width[rows][:, None]
                    fit = other & (at >= 0) & (at < BINS) & b.open[rows][:, None]
                    counts += np.bincount((rows[:, None] * BINS + at)[fit], minlength=counts.size).reshape(counts.shape)
            higher = counts[:, ::-1].cumsum(axis=1)[:, ::-1] - counts
            q, bin_ = np.nonzero((counts > 0) & (higher < b.k))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(q), number)), pa.array(q), pa.array(bin_), pa.array(counts[q, bin_])], names=["block", "q", "bin", "n"])

        return vectors.mapInArrow(run, "block long, q long, bin long, n long")

    parts = reduce(DataFrame.unionByName, map(part, range(len(blocks))))
    found = parts.groupBy("block", "q", "bin").agg(F.sum("n").alias("n")).toArrow()  # WAVE * QUERY_BLOCK * BINS counts at most
    of, q, bin_, n = (found[c].to_numpy() for c in ("block", "q", "bin", "n"))
    out = []
    for number, block in enumerate(blocks):
        mine = of == number
        counts = np.zeros((len(block.ids), BINS), np.int64)
        counts[q[mine], bin_[mine]] = n[mine]
        out.append(counts)
    return out


def _refine(block: _Block, counts: np.ndarray) -> None:
    """Narrows each open range to the bin of the k-th value; closes it where few rows or one score are left."""
    reached = counts[:, ::-1].cumsum(axis=1)[:, ::-1] + block.above[:, None]
    for q in np.flatnonzero(block.open):
        enough = np.flatnonzero(reached[q] >= block.k)
        if not len(enough):  # fewer than k in all: everything from the lowest bound up
            block.open[q] = False
            continue
        bin_ = int(enough[-1])
        block.above[q] = reached[q, bin_] - counts[q, bin_]
        block.low[q] += bin_ * block.width[q]
        if block.width[q] == 1 or reached[q, bin_] <= 8 * block.k:
            block.open[q] = False
        block.width[q] = max(1, -(-int(block.width[q]) // BINS))


def _selected(block: _Block, vectors: DataFrame) -> DataFrame:
    held = vectors.sparkSession.sparkContext.broadcast(block)

    def best(q, ids, s, k):
        order = np.lexsort((ids, -s, q))
        q, ids, s = q[order], ids[order], s[order]
        first = np.searchsorted(q, q, side="left")
        keep = np.arange(len(q)) - first < k
        return q[keep], ids[keep], s[keep]

    def run(it):
        b = held.value
        kept = tuple(np.zeros(0, np.int64) for _ in range(3))
        for batch in it:
            for rows, ids, s, other in b.matched(batch):
                i, j = np.nonzero(other & (s >= b.low[rows][:, None]))
                kept = best(*(np.concatenate([old, new]) for old, new in zip(kept, (rows[i], ids[j], s[i, j]))), b.k)
        yield pa.RecordBatch.from_arrays([pa.array(b.ids[kept[0]]), pa.array(kept[1]), pa.array(kept[2])], names=["query_id", "vec_id", "score"])

    rows = vectors.mapInArrow(run, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))  # k rows a task at most
    return rows.withColumn("rank", rank).where(F.col("rank") <= block.k).select("query_id", "rank", "vec_id", "score")


def search(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` best of ``vectors(vec_id, vector)`` for each of ``queries(vec_id, vector)``."""
    spark = vectors.sparkSession
    queries = queries.where("vec_id is not null").dropDuplicates(["vec_id"])
    vectors = saved(vectors.where("vec_id is not null"))
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
    count = queries.count()
    longest = vectors.agg(F.max(norm)).first()[0] or 0.0
    parts = max(1, -(-count // (QUERY_BLOCK * 9 // 10)))
    place = F.pmod(F.xxhash64("vec_id"), F.lit(parts))
    out = None
    for first in range(0, parts if count else 0, WAVE):
        rows = queries.where(place.between(first, first + WAVE - 1)).select(place.alias("place"), "vec_id", "vector").orderBy("place", "vec_id").toArrow()
        of, blocks = rows["place"].to_numpy(), []
        for number in np.unique(of):
            mine = rows.filter(pa.array(of == number))
            q = [np.array(v) for v in mine["vector"].to_pylist()]
            block = _Block(mine["vec_id"].to_numpy(), q, k)
            bound = np.ceil(np.array([np.linalg.norm(v) for v in q]) * longest) + 1
            block.low = -bound.astype(np.int64)
            block.width = -(-2 * bound.astype(np.int64) // BINS) + 1
            blocks.append(block)
        while waiting := [b for b in blocks if b.open.any()]:
            for block, counts in zip(waiting, _histograms(waiting, vectors)):
                _refine(block, counts)
        for block in blocks:
            part = _selected(block, vectors)
            out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
