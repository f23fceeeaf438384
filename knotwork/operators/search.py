"""Search: BM25, dense similarity, and both fused by reciprocal rank.

Queries come in blocks of at most ``BLOCK``, and a block is matched with every live node where the
node is: tasks keep each query's best rows only, so what is shuffled doesn't grow with queries times
nodes. Words, their frequencies and weights of one block are broadcast, and nothing else.

``hybrid`` is exact without whole rankings. A node outside both lists' first 60 + 2k has a fused score
under 1 / (60 + k), which the first k of either list reach; so the candidates are these rows, and their
ranks in the other list are counted in a second pass.

Scores are rounded (9 digits inside, then as reported), so that equal scores tie in every engine; ties go
to the smaller id. A null text counts as empty; a query without words finds nothing.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from knotwork.functions.embedding import Embedder, HashEmbedder, normal_text, slices, vectors_of, with_vectors
from knotwork.sources.cut import cut

BLOCK = 1024
#: Fixed values of BM25 and of reciprocal rank fusion.
K1, B, RRF = 1.2, 0.75, 60
_HELD = 4096  # nodes scored between two cuts to the best rows


class _Queries:
    """A block of queries with what scoring a node takes."""

    def __init__(self, qids: list, texts: list[str], embedder: Embedder):
        self.qids, self.embedder = qids, embedder
        self.words = [Counter((t or "").lower().split()) for t in texts]
        self.vocabulary = {w: i for i, w in enumerate(sorted(set().union(*self.words)))}
        self.vectors = embedder.embed([normal_text(t) for t in texts])
        self.weights, self.mean, self.nodes = np.zeros((len(self.vocabulary), len(qids))), 1.0, 0

    def learn(self, df: dict[str, int], nodes: int, words: int) -> None:
        self.nodes, self.mean = nodes, (words / nodes if nodes else 0.0) or 1.0
        for q, counts in enumerate(self.words):
            for word, n in counts.items():
                found = df.get(word, 0)
                self.weights[self.vocabulary[word], q] = n * math.log(1 + (nodes - found + 0.5) / (found + 0.5))

    def counts(self, text: str | None) -> tuple[np.ndarray, np.ndarray, int]:
        """Places in the vocabulary, how often each word occurs, and the number of all words."""
        words = (text or "").lower().split()
        at = np.array([i for i in map(self.vocabulary.get, words) if i is not None], np.int64)
        places, n = np.unique(at, return_counts=True)
        return places, n, len(words)

    def bm25(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros((len(texts), len(self.qids)))
        for row, text in zip(out, texts):
            places, n, size = self.counts(text)
            if len(places):
                row[:] = (n * (K1 + 1) / (n + K1 * (1 - B + B * size / self.mean))) @ self.weights[places]
        return np.round(out, 9)

    def dense(self, texts: list[str | None], stored: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
        """``stored``: the texts' vectors and which of them are there; the others are embedded."""
        if stored is None:
            found = self.embedder.embed([normal_text(t) for t in texts])
        else:
            found, there = stored
            if not there.all():
                found = found.copy()
                fresh = self.embedder.embed([normal_text(t) for t, known in zip(texts, there) if not known])
                found[~there] = fresh if fresh.shape[1] == found.shape[1] else 0.0
        if found.shape[1] != self.vectors.shape[1]:  # another embedder's vectors are not comparable
            return np.zeros((len(texts), len(self.qids)))
        return np.round(found @ self.vectors.T, 9)


def _live(nodes: DataFrame, vectors: DataFrame | None = None, embedder: Embedder | None = None) -> DataFrame:
    """(id, text) of nodes that aren't tombstones, and vec where stored ``vectors`` are given."""
    rows = (nodes.where("status <> 'tombstone'") if "status" in nodes.columns else nodes).select("id", "text")
    return rows if vectors is None else with_vectors(rows, vectors, embedder)


def _stored(batch: pa.RecordBatch, dims: int) -> tuple[np.ndarray, np.ndarray] | None:
    """A batch's stored vectors and which rows have one of that many components."""
    if "vec" not in batch.schema.names:
        return None
    column = batch.column("vec")
    there = pc.fill_null(pc.equal(pc.list_value_length(column), dims), False)
    flat = column.filter(there).flatten().to_numpy(zero_copy_only=False)
    mask = there.to_numpy(zero_copy_only=False).astype(bool)
    matrix = np.zeros((len(mask), dims))
    matrix[mask] = flat.reshape(-1, dims)
    return matrix, mask


def _statistics(live: DataFrame, block: _Queries) -> None:
    """One pass over the nodes: how many have each word of the block, all of them, and all words."""
    held = live.sparkSession.sparkContext.broadcast(block)

    def run(it):
        b, df, nodes, words = held.value, np.zeros(len(held.value.vocabulary), np.int64), 0, 0
        for batch in slices(it):
            for text in batch.column("text").to_pylist():
                places, _, size = b.counts(text)
                df[places] += 1
                nodes, words = nodes + 1, words + size
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([some, [-1, -2]])), pa.array(np.concatenate([df[some], [nodes, words]]))], names=["at", "n"])

    found = live.mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow().to_pydict()  # a row a word of the block
    n = dict(zip(found["at"], found["n"]))
    names = list(block.vocabulary)
    block.learn({names[at]: count for at, count in n.items() if at >= 0}, n.get(-1, 0), n.get(-2, 0))


def _blocks(nodes: DataFrame, queries: DataFrame, embedder: Embedder, statistics: bool) -> list[_Queries]:
    """The stated queries ``(qid, text)`` in blocks; a qid's texts, if repeated, are searched once each."""
    rows, out, held = queries.select("qid", "text").orderBy("qid"), [], []
    for row in rows.toLocalIterator():
        held.append(row)
        if len(held) == BLOCK:
            out.append(held)
            held = []
    blocks = [_Queries([r.qid for r in part], [r.text for r in part], embedder) for part in [*out, *([held] if held else [])]]
    if statistics:
        for block in blocks:
            _statistics(nodes, block)
    return blocks


def _first(ids: np.ndarray, scores: np.ndarray, mask: np.ndarray, m: int):
    """(query, node) of each query's ``m`` best nodes where ``mask`` holds; ``ids`` ascend."""
    for q in range(scores.shape[1]):
        rows = np.flatnonzero(mask[:, q])
        if len(rows) > m:
            value = scores[rows, q]
            least = np.partition(value, len(rows) - m)[len(rows) - m]
            rows = rows[value >= least]
        rows = rows[np.argsort(-scores[rows, q], kind="stable")][:m]
        yield q, rows


_SCHEMA = "q int, list int, id string, score double"


def _best(live: DataFrame, block: _Queries, lists: tuple[str, ...], m: int) -> DataFrame:
    """(q, list, id, score): the ``m`` best nodes of each query in each list (0: BM25, 1: dense)."""
    held = live.sparkSession.sparkContext.broadcast(block)

    def run(it):
        b = held.value
        kept: dict[int, tuple[np.ndarray, ...]] = {}

        def cut(texts, ids, stored):
            order = np.argsort(ids, kind="stable")
            texts, ids = [texts[i] for i in order], ids[order]
            known = tuple(np.concatenate(x)[order] for x in zip(*stored)) if stored else None
            scores = {n: b.bm25(texts) if n == "bm25" else b.dense(texts, known) for n in lists}
            overlap = reduce(np.logical_or, [s > 0 for s in scores.values()])
            for number, name in enumerate(lists):
                for q, rows in _first(ids, scores[name], (scores[name] > 0) if name == "bm25" else overlap, m):
                    old = kept.get((number, q), (ids[:0], np.zeros(0)))
                    both = np.concatenate([old[0], ids[rows]]), np.concatenate([old[1], scores[name][rows, q]])
                    best = np.lexsort((both[0], -both[1]))[:m]
                    kept[number, q] = both[0][best], both[1][best]

        texts, ids, stored = [], [], []
        for batch in slices(it):
            texts.extend(batch.column("text").to_pylist())
            ids.extend(batch.column("id").to_pylist())
            if (found := _stored(batch, b.vectors.shape[1])) is not None:
                stored.append(found)
            if len(ids) >= _HELD:
                cut(texts, np.array(ids, dtype=object), stored)
                texts, ids, stored = [], [], []
        if ids:
            cut(texts, np.array(ids, dtype=object), stored)
        for (number, q), (found, score) in kept.items():
            n = len(found)
            yield pa.RecordBatch.from_arrays([pa.array([q] * n, pa.int32()), pa.array([number] * n, pa.int32()), pa.array(found, pa.string()), pa.array(score)], names=["q", "list", "id", "score"])

    rank = F.row_number().over(Window.partitionBy("q", "list").orderBy(F.desc("score"), "id"))  # m rows a task at most
    return live.mapInArrow(run, _SCHEMA).withColumn("rank", rank).where(F.col("rank") <= m)


def _names(spark: SparkSession, block: _Queries, queries: DataFrame) -> DataFrame:
    return F.broadcast(spark.createDataFrame(list(enumerate(block.qids)), f"q int, qid {queries.schema['qid'].dataType.simpleString()}"))  # a block


def _single(nodes: DataFrame, queries: DataFrame, k: int, name: str, embedder: Embedder | None, vectors: DataFrame | None = None) -> DataFrame:
    spark, embedder = nodes.sparkSession, embedder or HashEmbedder()
    live = _live(nodes, vectors, embedder)
    parts = []
    for block in _blocks(live, queries, embedder, name == "bm25") if k > 0 else []:
        best = _best(live, block, (name,), k).join(_names(spark, block, queries), "q")
        parts.append(best.where("score > 0").select("qid", F.col("rank").cast("long").alias("rank"), "id", "score"))
    return _union(spark, parts, queries, "score")


def _union(spark: SparkSession, parts: list[DataFrame], queries: DataFrame, score: str) -> DataFrame:
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], f"qid {queries.schema['qid'].dataType.simpleString()}, rank long, id string, {score} double")


def bm25(nodes: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(qid, rank, id, score): the k nodes of each of ``queries(qid, text)`` with the highest BM25 above 0."""
    return _single(nodes, queries, k, "bm25", None)


def dense(nodes: DataFrame, queries: DataFrame, k: int = 10, embedder: Embedder | None = None, vectors: DataFrame | None = None) -> DataFrame:
    """(qid, rank, id, score): the k nodes of the highest cosine above 0; ``vectors`` are the nodes' stored ones."""
    return _single(nodes, queries, k, "dense", embedder, vectors)


def hybrid(nodes: DataFrame, queries: DataFrame, k: int = 10, embedder: Embedder | None = None, vectors: DataFrame | None = None) -> DataFrame:
    """(qid, rank, id, rrf): the k nodes of the highest sum of 1 / (60 + rank) over both rankings. A node stands in
    the dense ranking if its cosine or its BM25 is above 0, in the other if its BM25 is. All passes read the stored
    ``vectors``; without any, each text is embedded once, into a table that they read."""
    spark, embedder, m = nodes.sparkSession, embedder or HashEmbedder(), RRF + 2 * max(k, 0)
    live, parts = _live(nodes, vectors, embedder), []
    if k > 0:
        live = cut(live if vectors is not None else vectors_of(live, embedder, with_text=True))
    for block in _blocks(live, queries, embedder, True) if k > 0 else []:
        candidates = _best(live, block, ("bm25", "dense"), m).select("q", "id").distinct()
        fused = _ranked(live, block, candidates.toArrow().to_pydict())  # at most 2 m rows a query of the block
        rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("rrf"), "id"))
        parts.append(fused.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k).join(_names(spark, block, queries), "q").select("qid", "rank", "id", "rrf"))
    return _union(spark, parts, queries, "rrf")


def _ranked(live: DataFrame, block: _Queries, candidates: dict[str, list]) -> DataFrame:
    """(q, id, rrf) of the candidates, from ranks counted over all nodes."""
    spark = live.sparkSession
    wanted: dict[str, list[int]] = {}
    for q, i in zip(candidates["q"], candidates["id"]):
        wanted.setdefault(i, []).append(q)
    held = spark.sparkContext.broadcast((block, wanted))

    def score(it):
        b, wanted = held.value
        for batch in slices(it):
            at = [n for n, i in enumerate(batch.column("id").to_pylist()) if i in wanted]
            if at:
                batch = batch.take(pa.array(at))
                texts, rows = batch.column("text").to_pylist(), [(i,) for i in batch.column("id").to_pylist()]
                x, y = b.bm25(texts), b.dense(texts, _stored(batch, b.vectors.shape[1]))
                q, i, r = zip(*((q, i, r) for r, (i,) in enumerate(rows) for q in wanted[i]))
                yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(i, pa.string()), pa.array(x[list(r), list(q)]), pa.array(y[list(r), list(q)])], names=["q", "id", "bm25", "dense"])

    found = live.mapInArrow(score, "q int, id string, bm25 double, dense double").groupBy("q", "id").agg(F.max("bm25").alias("bm25"), F.max("dense").alias("dense")).orderBy("q", "id").toArrow().to_pydict()
    marks: dict[int, list[tuple]] = {}
    for q, i, x, y in zip(found["q"], found["id"], found["bm25"], found["dense"]):
        marks.setdefault(q, []).append((i, x, y))
    marked = spark.sparkContext.broadcast((block, marks))

    def count(it):
        b, marks = marked.value
        better = {q: np.zeros((2, len(rows)), np.int64) for q, rows in marks.items()}
        for batch in slices(it):
            ids, texts = np.array(batch.column("id").to_pylist(), dtype=object), batch.column("text").to_pylist()
            x, y = b.bm25(texts), b.dense(texts, _stored(batch, b.vectors.shape[1]))
            for q, rows in marks.items():
                overlap = (x[:, q] > 0) | (y[:, q] > 0)
                for number, scores in enumerate((np.where(x[:, q] > 0, x[:, q], -np.inf), np.where(overlap, y[:, q], -np.inf))):
                    value = np.array([r[1 + number] for r in rows])
                    ascending = np.sort(scores)
                    better[q][number] += len(scores) - np.searchsorted(ascending, value, side="right")
                    for r in np.flatnonzero(np.searchsorted(ascending, value, side="right") > np.searchsorted(ascending, value, side="left")):
                        better[q][number][r] += int((ids[scores == value[r]] < rows[r][0]).sum())  # ties: smaller ids come first
        for q, n in better.items():
            size = n.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array([q] * size, pa.int32()), pa.array(np.arange(size, dtype=np.int32)), pa.array(n[0]), pa.array(n[1])], names=["q", "r", "b", "d"])

    ranks = live.mapInArrow(count, "q int, r int, b long, d long").groupBy("q", "r").agg(F.sum("b").alias("b"), F.sum("d").alias("d"))
    rows = [(q, r, i, x > 0) for q, given in marks.items() for r, (i, x, _) in enumerate(given)]
    known = F.broadcast(spark.createDataFrame(rows, "q int, r int, id string, lexical boolean"))  # the candidates
    fused = F.when(F.col("lexical"), 1.0 / (RRF + 1 + F.col("b"))).otherwise(0.0) + 1.0 / (RRF + 1 + F.col("d"))
    return ranks.join(known, ["q", "r"]).select("q", "id", F.round(fused, 9).alias("rrf"))


#: A reranker takes (query, texts) and gives a score a text; the highest comes first.
Reranker = Callable[[str, list[str]], list[float]]


def rerank(candidates: DataFrame, nodes: DataFrame, queries: DataFrame, reranker: Reranker, k: int = 5) -> DataFrame:
    """The k best of ``candidates(qid, rank, id, rrf)`` by ``reranker``, with rank anew and its score; equal scores
    keep the order they had. Candidates are few a query, so a query is one group."""
    rows = candidates.join(nodes.select("id", "text"), "id").join(queries.select("qid", F.col("text").alias("query")), "qid")
    schema = candidates.select("qid", "rank", "id", "rrf").schema

    def run(frame):
        frame = frame.sort_values("rank", ignore_index=True)
        score = np.asarray(reranker(frame["query"].iloc[0] or "", [t or "" for t in frame["text"]]), dtype=float)
        out = frame.iloc[np.argsort(-score, kind="stable")[:k]][["qid", "rank", "id", "rrf"]].copy()
        out["rank"] = np.arange(1, len(out) + 1)
        return out

    return rows.groupBy("qid").applyInPandas(run, schema)


def retrieve(nodes: DataFrame, queries: DataFrame, k: int = 5, rerank_k: int = 30, embedder: Embedder | None = None, reranker: Reranker | None = None, vectors: DataFrame | None = None) -> DataFrame:
    """(qid, rank, id, rrf): the first k of ``rerank_k`` hybrid candidates, after ``reranker`` where one is given."""
    if k <= 0:
        return hybrid(nodes, queries, 0, embedder)
    if reranker is None:
        return hybrid(nodes, queries, min(k, rerank_k), embedder, vectors)
    return rerank(hybrid(nodes, queries, rerank_k, embedder, vectors), nodes, queries, reranker, k)


def reverse_order(query: str, texts: list[str]) -> list[float]:
    """A reranker that turns the order round."""
    return list(range(len(texts)))


def find_by_text(nodes: DataFrame, refs: DataFrame) -> DataFrame:
    """(qid, id, exact): the node whose normal text is that of ``refs(qid, text)``, or begins with it: the exact one first,
    then the shortest, then the smallest id. Beginnings of 1, 2, 4, ... characters say which lengths of refs a text may
    begin with; each text then names its beginnings of these lengths, whose best node is found before refs meet it. So a
    text is shuffled once, and what many refs and texts have in common is never paired."""
    from knotwork.functions.text import normalized

    body = nodes.select("id", normalized(F.coalesce("text", F.lit(""))).alias("body")).where("body <> ''")
    power = lambda c: F.floor(F.log2(F.length(c))).cast("int")
    start = lambda c, n: F.xxhash64(F.substring(c, F.lit(1), F.pow(F.lit(2), n).cast("int")))
    wanted = refs.select("qid", normalized(F.coalesce("text", F.lit(""))).alias("ref")).where("ref <> ''").withColumn("n", power("ref"))
    wanted = cut(wanted.select("qid", "n", start("ref", F.col("n")).alias("key"), F.length("ref").alias("size"), F.sha2("ref", 256).alias("digest")))
    starts = body.withColumn("n", F.explode(F.sequence(F.lit(0), power("body")))).select("id", F.length("body").alias("whole"), "n", start("body", F.col("n")).alias("key"))
    sizes = starts.join(wanted.select("n", "key", "size").distinct(), ["n", "key"]).where("size <= whole").select("id", "size")
    heads = sizes.join(body, "id").select("size", F.sha2(F.substring("body", F.lit(1), F.col("size")), 256).alias("digest"), F.struct((F.length("body") != F.col("size")).alias("longer"), F.length("body").alias("whole"), "id").alias("node"))
    best = heads.groupBy("size", "digest").agg(F.min("node").alias("node"))
    found = wanted.join(best, ["size", "digest"]).groupBy("qid").agg(F.min("node").alias("node"))
    return found.select("qid", "node.id", (~F.col("node.longer")).alias("exact"))


def usage(results: DataFrame, queries: DataFrame, ts: str) -> DataFrame:
    """Rows (ts, q, ids) of the ledger, one a query that found something: its fingerprint and what it found, in order."""
    from knotwork.functions.text import fingerprint

    found = results.groupBy("qid").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias("ids"))  # k rows
    return found.join(queries.select("qid", fingerprint(F.col("text")).alias("q")), "qid").select(F.lit(ts).alias("ts"), "q", "ids")
