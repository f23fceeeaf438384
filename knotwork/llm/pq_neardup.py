"""Near-duplicate vectors by product quantisation, with exact cosine rerank.

Equal vectors of one label are one class from the start. A class lies in the inverted
list of its nearest coarse centroid and keeps a code of its residual: the nearest
entry of a small codebook in each subspace. A query scans every list that can hold a
vector within the link distance: y is nearer to its own centroid than to any other, so
x can only be within r of it if x is within r of the plane between the two centroids.
That holds for both, so x probes the lists from its own on, and a link counts for either.
In a list, distances to the codes come from one table a query and subspace, and y is
kept when that distance exceeds r by no more than y's own quantisation error. Both
tests lose nothing (they are triangle inequalities); the exact cosine then decides.

Centroids and codebooks are fitted on at most ``SAMPLE`` classes; all are indexed.
Long lists are cut into blocks, and a task matches one block of queries with one of the
list. It passes on counts and a spanning forest of its links, never the pairs.

Defined results: vectors that are null, empty, zero or hold a null or non-finite
component, and those with a null label, link with nothing; vectors of different length
don't link; repeated rows are vectors of their own, and so are different vectors of one
vec_id; magnitudes don't matter; a null vec_id has a null component.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, products, saved

SAMPLE, LISTS, SUBSPACES, ENTRIES = 8192, 64, 8, 16
BLOCK = 1024  # classes of a list, and queries, that a task matches at a time


@dataclass
class Index:
    centroids: np.ndarray
    books: list[np.ndarray]
    cuts: np.ndarray

    def place(self, x: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
        """Cell, code and quantisation error of unit vectors, and the cells from its own on that each must probe."""
        c = self.centroids
        d2 = np.maximum(((x * x).sum(1)[:, None] + (c * c).sum(1)[None, :]) - 2 * products(x, c), 0)
        cell = d2.argmin(axis=1)
        rest = x - c[cell]
        codes = np.stack([_nearest(rest[:, a:b], book) for a, b, book in self.parts()], axis=1).astype(np.uint8)
        error = np.linalg.norm(rest - self.decoded(codes), axis=1)
        apart = np.sqrt(np.maximum(((c[cell][:, None, :] - c[None, :, :]) ** 2).sum(-1), 1e-300))
        margin = (d2 - d2[np.arange(len(x)), cell][:, None]) / (2 * apart)
        near = margin <= radius + 1e-9
        near[np.arange(len(x)), cell] = True
        near &= np.arange(len(c))[None, :] >= cell[:, None]  # of two cells the lower one's vectors probe the other
        return cell, codes, error, [np.flatnonzero(row) for row in near]

    def parts(self):
        return [(int(a), int(b), book) for a, b, book in zip(self.cuts, self.cuts[1:], self.books)]

    def decoded(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([book[codes[:, m]] for m, book in enumerate(self.books)], axis=1)

    def distances(self, queries: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Asymmetric distances of queries to the codes of a list, by table lookup."""
        rest, total = queries - self.centroids[cell], np.zeros((len(queries), len(codes)))
        for m, (a, b, book) in enumerate(self.parts()):
            lookup = ((rest[:, a:b][:, None, :] - book[None, :, :]) ** 2).sum(-1)
            total += lookup[:, codes[:, m]]
        return np.sqrt(total)


def _nearest(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    return ((book * book).sum(1)[None, :] - 2 * products(x, book)).argmin(axis=1)


def _kmeans(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Lloyd's rounds from rows at even distances; the same rows give the same centroids."""
    centers = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
    for _ in range(rounds):
        of = _nearest(x, centers)
        sums = np.zeros_like(centers)
        np.add.at(sums, of, x)
        n = np.bincount(of, minlength=len(centers))[:, None]
        centers = np.where(n > 0, sums / np.maximum(n, 1), centers)
    return centers


def fit(sample: np.ndarray) -> Index:
    size = sample.shape[1]
    cuts = np.unique(np.linspace(0, size, min(SUBSPACES, size) + 1).astype(int))
    centroids = _kmeans(sample, LISTS) if len(sample) else np.zeros((1, size))
    rest = sample - centroids[_nearest(sample, centroids)] if len(sample) else np.zeros((1, size))
    return Index(centroids, [_kmeans(rest[:, a:b], ENTRIES, 5) for a, b in zip(cuts, cuts[1:])], cuts)


def _scaled(column) -> np.ndarray:
    """Vectors times the power of two that brings their largest component near 1: the same cosines, without
    squares that overflow or vanish."""
    x = np.stack([np.asarray(v, dtype=np.float64) for v in column])
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


def _unit(column) -> np.ndarray:
    x = _scaled(column)
    return x / np.linalg.norm(x, axis=1)[:, None]


def links(classes: DataFrame, threshold: float) -> DataFrame:
    """(cid, n, root): linked vectors that a task found, and a smaller class in reach, for ``classes(cid, label, vec, mult)``."""
    spark, radius = classes.sparkSession, float(np.sqrt(max(0.0, 2 - 2 * threshold)))
    sample = classes.orderBy(F.xxhash64("label", "vec"), "label", "vec").select("vec").limit(SAMPLE).toArrow()["vec"].to_pylist()
    by_size: dict[int, list] = {}
    for v in sample:
        by_size.setdefault(len(v), []).append(v)
    held = spark.sparkContext.broadcast({size: fit(_unit(rows)) for size, rows in by_size.items()})

    def index_of(size: int) -> Index:
        return held.value.get(size) or fit(np.zeros((0, size)))

    def place(frames):
        for frame in frames:
            for size, rows in frame.groupby(frame["vec"].map(len)):
                cell, codes, error, probes = index_of(size).place(_unit(rows["vec"]), radius)
                yield pd.DataFrame({"cid": rows["cid"], "label": rows["label"], "size": size, "vec": rows["vec"], "mult": rows["mult"], "cell": cell, "code": [c.tobytes() for c in codes], "error": error, "probes": probes})

    placed = saved(classes.mapInPandas(place, "cid long, label int, size int, vec array<double>, mult long, cell int, code binary, error double, probes array<int>"))
    key = ["label", "size", "cell"]
    probing = placed.select("cid", "label", "size", "vec", "mult", F.col("cell").alias("own"), F.explode("probes").alias("cell"))
    n_list = placed.groupBy(key).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("list_blocks"))
    n_probe = probing.groupBy(key).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("query_blocks"))
    blocks = n_list.join(n_probe, key)
    own = lambda n: F.pmod(F.xxhash64("cid"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    fresh = placed.select(*(F.col(c).alias(c) for c in placed.columns))  # its own column ids, for the cogroup
    lists = fresh.join(blocks, key).select(*key, "cid", "vec", "mult", "code", "error", own("list_blocks").alias("lb"), every("query_blocks").alias("qb"))
    queries = probing.join(blocks, key).select(*(F.col(c).alias(c) for c in key), "cid", "vec", "mult", "own", own("query_blocks").alias("qb"), every("list_blocks").alias("lb"))

    def match(q: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(y):
            return pd.DataFrame({"cid": [], "n": [], "root": []}).astype("int64")
        index, cell = index_of(int(q["size"].iloc[0])), int(q["cell"].iloc[0])
        qv, yv = _scaled(q["vec"]), _scaled(y["vec"])
        qn, yn = np.linalg.norm(qv, axis=1), np.linalg.norm(yv, axis=1)
        codes = np.frombuffer(b"".join(y["code"]), np.uint8).reshape(len(y), -1)
        near = index.distances(qv / qn[:, None], cell, codes) <= radius + y["error"].to_numpy()[None, :] + 1e-9
        i, j = np.nonzero(near)
        exact = np.concatenate([np.einsum("ij,ij->i", qv[i[a : a + 65536]], yv[j[a : a + 65536]]) for a in range(0, len(i), 65536)]) if len(i) else np.zeros(0)
        qid, yid = q["cid"].to_numpy(), y["cid"].to_numpy()
        good = (exact / (qn[i] * yn[j]) >= threshold) & (qid[i] != yid[j])
        i, j = i[good], j[good]
        n = np.bincount(i, y["mult"].to_numpy()[j], minlength=len(q)).astype(np.int64)
        away = (q["own"].to_numpy() != cell)[i]  # y does not probe that query's list
        m = np.bincount(j[away], q["mult"].to_numpy()[i[away]], minlength=len(y)).astype(np.int64)
        ql, yl = qid.copy(), yid.copy()
        while True:
            before = ql.sum() + yl.sum()
            np.minimum.at(ql, i, yl[j])
            np.minimum.at(yl, j, ql[i])
            if ql.sum() + yl.sum() == before:
                break
        hit, found = n > 0, (yl < yid) | (m > 0)
        return pd.DataFrame({"cid": np.concatenate([qid[hit], yid[found]]), "n": np.concatenate([n[hit], m[found]]), "root": np.concatenate([ql[hit], yl[found]])})

    group = [*key, "lb", "qb"]
    return saved(queries.groupBy(group).cogroup(lists.groupBy(group)).applyInPandas(match, "cid long, n long, root long"))


def near_duplicates(vectors: DataFrame, threshold: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of ``vectors(vec_id, embedding, label)``."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    live = F.col("embedding").isNotNull() & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    live = live & ~F.coalesce(bad, F.lit(True)) & F.coalesce(F.exists("embedding", lambda x: x != 0), F.lit(False))
    rows = saved(vectors.select("vec_id", F.col("label").cast("int").alias("label"), F.when(live, F.col("embedding").cast("array<double>")).alias("vec")))
    # A class has a number of its own, since an id may stand in several; the table that is written fixes it.
    classes = rows.where("vec is not null").groupBy("label", "vec").agg(F.min("vec_id").alias("low"), F.count("*").alias("mult"))
    classes = saved(classes.withColumn("cid", F.monotonically_increasing_id()))
    found = links(classes, threshold)
    counts = found.groupBy("cid").agg(F.sum("n").alias("n"))
    members = components(found.select(F.col("cid").alias("a"), F.col("root").alias("b")).distinct())
    members = saved(members.union(members.select("component_id", "component_id").distinct()).join(classes.select(F.col("cid").alias("id"), "low"), "id"))
    lows = members.groupBy("component_id").agg(F.min("low").alias("first"))
    roots = members.join(lows, "component_id").select(F.col("id").alias("cid"), "first")
    known = classes.join(counts, "cid", "left").join(roots, "cid", "left")
    known = known.select("label", "vec", (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("first", "low").alias("component_id"))
    out = rows.join(known, ["label", "vec"], "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
