"""Vectors: hash embeddings as arrays, near-duplicate bands, nearest neighbours, suggested edges."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from knotwork.sources.cut import cut

#: Vectors of a block, and rows of a tile: a task compares two blocks tile by tile, so what it holds is bounded.
BLOCK, TILE = 32768, 512
#: Bands of similarity and the edge kind each suggests.
SIMILAR, EXTENDS, AUTO_ACCEPT = 0.75, 0.45, 0.95


def dense(embeds: DataFrame, key: str = "id", dims: int = 64) -> DataFrame:
    """(key, vec) from sparse (key, dim, w)."""
    held = F.map_from_entries(F.collect_list(F.struct("dim", "w")))
    vec = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.coalesce(F.element_at("held", i), F.lit(0)).cast("double"))
    return embeds.groupBy(key).agg(held.alias("held")).select(key, vec.alias("vec"))


def dominant_dimension(vectors: DataFrame) -> DataFrame:
    """Rows of the most frequent vector length (the smaller one of equals)."""
    top = vectors.groupBy(F.size("vec").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "size").limit(1)
    return vectors.join(F.broadcast(top.select("size")), F.size("vec") == F.col("size"), "left_semi")  # one row


def _blocks(vectors: DataFrame) -> int:
    size = vectors.count()
    return max(1, -(-size // BLOCK), min(16, -(-size // 2048)))


def _packed(vectors: DataFrame, n: int | None = None) -> DataFrame:
    """(block, ids, data): the vectors in blocks of about ``BLOCK``, or ``n`` blocks, a row a block: ids in order, unit
    vectors as doubles. An id's block depends on the id and ``n`` alone."""
    if n is None:
        vectors = cut(vectors)
        n = _blocks(vectors)

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("id", ignore_index=True)
        v = np.stack(frame["vec"].to_numpy()).astype(np.float64)
        norms = np.sqrt((v * v).sum(axis=1))
        norms[norms == 0] = np.inf
        return pd.DataFrame({"block": [frame["block"].iloc[0]], "ids": [frame["id"].to_numpy()], "data": [(v / norms[:, None]).tobytes()]})

    dealt = vectors.select("id", "vec", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias("block")).repartitionByRange(n, "block")
    return cut(dealt.groupBy("block").applyInPandas(pack, "block int, ids array<string>, data binary"))


def _crossed(blocks: DataFrame, ordered: bool, asked: DataFrame | None = None) -> DataFrame:
    """Every block, or those of ``asked``, beside every other one and itself (once, i <= j, if ``ordered``). Tasks read the blocks where they are
    stored, so nothing is shuffled or broadcast."""
    side = lambda blocks, i, ids, data: blocks.select(F.col("block").alias(i), F.col("ids").alias(ids), F.col("data").alias(data))
    both = side(blocks if asked is None else asked, "i", "a", "x").hint("shuffle_replicate_nl").crossJoin(side(blocks, "j", "b", "y"))  # the join of blocks is what is asked for
    return both.where("i <= j") if ordered else both


def _cells(it):
    """(i, j, a, b, x, y) of each pair of blocks."""
    for batch in it:
        for n in range(batch.num_rows):
            i, j = batch.column("i")[n].as_py(), batch.column("j")[n].as_py()
            a, b = batch.column("a")[n].values, batch.column("b")[n].values
            matrix = lambda c, ids: np.frombuffer(batch.column(c)[n].as_buffer(), np.float64).reshape(len(ids), -1)  # noqa: E731, B023
            yield i, j, a, b, matrix("x", a), matrix("y", b)


def _tiles(x: np.ndarray, y: np.ndarray, same: bool):
    """(row, column, cosines) of tiles; within one block, pairs not above the diagonal have -inf."""
    turned = np.ascontiguousarray(y.T)
    for r in range(0, len(x), TILE):
        for c in range(r if same else 0, len(y), 8 * TILE):
            cos = x[r : r + TILE] @ turned[:, c : c + 8 * TILE]
            if same:
                cos[np.arange(r, r + cos.shape[0])[:, None] >= np.arange(c, c + cos.shape[1])[None, :]] = -np.inf
            yield r, c, cos


def near_duplicates(vectors: DataFrame, low: float = 0.78, high: float = 0.92) -> DataFrame:
    """Pairs (a, b, score), a < b, with low <= cosine < high + 1e-6."""

    def match(it):
        for i, j, a, b, x, y in _cells(it):
            behind = np.searchsorted(b.to_numpy(zero_copy_only=False), a.to_numpy(zero_copy_only=False), side="right")  # the first of b above each of a
            both = pa.concat_arrays([a, b])
            for row, column, cos in _tiles(x, y, i == j):
                at = np.flatnonzero((cos >= low) & (cos < high + 1e-6))
                r, c = np.divmod(at, cos.shape[1])
                score, r, c = cos.ravel()[at], r + row, c + column
                first = c >= behind[r]
                one, other = np.where(first, r, len(a) + c), np.where(first, len(a) + c, r)
                yield pa.RecordBatch.from_arrays([both.take(pa.array(one)), both.take(pa.array(other)), pa.array(score)], names=["a", "b", "score"])

    return _crossed(_packed(vectors), True).mapInArrow(match, "a string, b string, score double")


def near_counts(vectors: DataFrame, low: float = 0.78, high: float = 0.92) -> DataFrame:
    """Rows (pairs): how many ``near_duplicates`` there are, counted where they are found; their sum is the number of all."""

    def count(it):
        for i, j, _, _, x, y in _cells(it):
            found = sum(np.count_nonzero(cos >= low) - np.count_nonzero(cos >= high + 1e-6) for _, _, cos in _tiles(x, y, i == j))
            yield pa.RecordBatch.from_arrays([pa.array([found], pa.int64())], names=["pairs"])

    return _crossed(_packed(vectors), True).mapInArrow(count, "pairs long")


class _Nearest:
    """The k best of each vector of a block (ids ``a``, unit vectors ``x``) so far, and the pairs that may be among them.

    Products of single precision leave out what is surely below the k-th best; the others' are made again in double."""

    def __init__(self, a: pa.Array, x: np.ndarray, k: int, low: float):
        self.a, self.x, self.k, self.low, self.kept = a, x, k, low, []
        self.single, self.margin = x.astype(np.float32), 1e-9 + 1.3e-7 * (x.shape[1] + 4)
        self.best = np.full((len(x), k), -np.inf)  # a row's scores ascend

    def least(self, rows) -> np.ndarray:
        return np.maximum(self.best[rows, 0], self.low)

    def meet(self, b: pa.Array, y: np.ndarray, same: bool) -> None:
        turned, k, rows, columns, scores = np.ascontiguousarray(y.T.astype(np.float32)), self.k, [], [], []
        if same:  # a block of a's ids and maybe more: where each of a is
            own = np.searchsorted(b.to_numpy(zero_copy_only=False), self.a.to_numpy(zero_copy_only=False))
        for row in range(0, len(self.x), TILE):
            part = slice(row, row + TILE)
            for column in range(0, len(y), 8 * TILE):
                cos = self.single[part] @ turned[:, column : column + 8 * TILE]
                least = (self.least(part) - self.margin).astype(np.float32)
                at = np.flatnonzero(cos >= least[:, None])
                if len(at) > 16 * k * len(cos) and cos.shape[1] > k:  # the k + 1 best, since one may be the vector itself
                    least = np.maximum(least, np.partition(cos, cos.shape[1] - k - 1, axis=1)[:, -k - 1] - np.float32(2 * self.margin))
                    at = np.flatnonzero(cos >= least[:, None])
                r, c = np.divmod(at, cos.shape[1])
                c += column
                if same:
                    other = own[r + row] != c
                    r, c = r[other], c[other]
                score = np.round(np.einsum("ij,ij->i", self.x[r + row], y[c]), 9)
                order = np.lexsort((c, -score, r))
                r, c, score = r[order], c[order], score[order]
                place = np.arange(len(r)) - np.searchsorted(r, r, side="left")
                few = (place < k) & (score >= self.low)
                r, c, score, place = r[few], c[few], score[few], place[few]
                new = np.full((cos.shape[0], k), -np.inf)
                new[r, place] = score
                self.best[part] = np.sort(np.concatenate([self.best[part], new], axis=1), axis=1)[:, k:]
                rows.append(r + row)
                columns.append(c)
                scores.append(score)
        r, c, score = np.concatenate(rows), np.concatenate(columns), np.concatenate(scores)
        good = score >= self.least(r)
        self.kept.append((r[good], b.take(pa.array(c[good])), score[good]))

    def rows(self):
        for r, targets, score in self.kept:
            good = np.flatnonzero(score >= self.least(r))
            yield pa.RecordBatch.from_arrays([self.a.take(pa.array(r[good])), targets.take(pa.array(good)), pa.array(score[good])], names=["source", "target", "score"])


def nearest(vectors: DataFrame, k: int = 3, low: float = -np.inf, sources: DataFrame | None = None) -> DataFrame:
    """The k nearest others of each vector, or of those of ``sources(id)``, without those of a cosine under ``low``:
    (source, target, score, rank); no row for k <= 0. A task hands on about k rows a vector, however many blocks it compares it with."""
    schema = "source string, target string, score double"

    def match(it):
        now, held = None, None
        for i, j, a, b, x, y in _cells(it):
            if now != i:
                if held is not None:
                    yield from held.rows()
                now, held = i, _Nearest(a, x, k, low)
            held.meet(b, y, i == j)
        if held is not None:
            yield from held.rows()

    if k <= 0:
        return vectors.sparkSession.createDataFrame([], f"{schema}, rank int")
    vectors = cut(vectors)
    n = _blocks(vectors)
    asked = None if sources is None else _packed(vectors.join(sources.select("id"), "id", "left_semi"), n)
    found = _crossed(_packed(vectors, n), False, asked).mapInArrow(match, schema)
    rank = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("score"), "target"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def suggest(vectors: DataFrame, floor: float = 0.0) -> DataFrame:
    """Edges that the three nearest neighbours suggest, by band; the floor applies after the three are chosen."""
    kind = F.when(F.col("score") >= SIMILAR, "similar").when(F.col("score") >= EXTENDS, "extends")
    found = nearest(vectors, 3, EXTENDS).withColumn("kind", kind).where(F.col("kind").isNotNull() & (F.col("score") >= floor))
    return found.select("source", "target", "kind", "score", (F.col("score") < AUTO_ACCEPT).alias("pending"))
