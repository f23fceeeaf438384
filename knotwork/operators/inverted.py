"""A stored BM25 index: posting lists cut into ranges of nodes, with bounds by which a search skips ranges.

The index is a folder of generations. ``docs`` keeps each node's words and counts, ``postings`` a row a word
and range of nodes (with the greatest count and the shortest node in it, which bound every score there), and
``gone`` the nodes of older generations that a generation replaces or removes. A generation also holds negative
counts for their words, so how many nodes have a word, how many there are and their mean length are sums over
generations. A small file in ``LOG``, created only where there is none, makes a generation visible at once.

A range holds about ``RANGE`` nodes of like length (fewer of long ones), so no list is in one group, however common its
word, and bounds are near the scores. Lists are made and scored range by range: a generation shuffles its nodes once, and
a search the lists of its words once, however many queries ask for them. A search reads the bounds of its words, scores each query's k most promising ranges,
takes the k-th score found there as a floor, and then only the ranges whose bound reaches it. Results are exact and
equal ``search.bm25``. Lists of other words are not read: files are parted by a hash of the word and sorted by
word. A skipped range is neither unpacked, shuffled nor scored.

Rows without an id are left out; of several rows of an id in one call the live one with the greatest text
counts; a null text is an empty one; tombstones are removed.
"""

from __future__ import annotations

import json
import math
import uuid
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from knotwork.operators.search import BLOCK, K1, B
from knotwork.sources.cut import cut
from knotwork.sources.state import Conflict, create_text

#: Nodes of a range, folders that words are hashed to, and words of a range's nodes.
RANGE, BUCKETS, HELD = 1024, 16, 1 << 20
_SLACK = 1e-6  # more than what rounding can move a score
_DOCS = "id string, size long, words array<string>, counts array<int>"
_POSTINGS = "word string, range long, n long, top int, shortest long, list array<struct<id:string,count:int,size:long>>, gen string, bucket int"
_GONE = "id string, of string, gen string"


def _read_words(batches):
    for batch in batches:
        found = [Counter((t or "").lower().split()) for t in batch.column("text").to_pylist()]
        words = [sorted(c) for c in found]
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array([c.total() for c in found], pa.int64()), pa.array(words, pa.list_(pa.string())), pa.array([[c[w] for w in ws] for c, ws in zip(found, words)], pa.list_(pa.int32()))],
            names=["id", "size", "words", "counts"],
        )


class Index:
    """A folder; ``add`` takes nodes in, ``search`` finds the best, ``compact`` makes one generation of all."""

    def __init__(self, spark: SparkSession, path: str, range_size: int = RANGE):
        self.spark, self.path, self.range_size = spark, path.rstrip("/"), range_size

    def generations(self) -> list[dict]:
        """The generations in force, oldest first: number, gen, docs and words (both as differences)."""
        jvm = self.spark.sparkContext._jvm
        log = jvm.org.apache.hadoop.fs.Path(f"{self.path}/LOG")
        if not log.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(log):
            return []
        rows = self.spark.read.schema("number long, gen string, docs long, words long, base boolean").json(f"{self.path}/LOG")
        past = [r.asDict() for r in rows.where("number is not null").orderBy("number").collect()]  # a line a generation
        return past[max((i for i, g in enumerate(past) if g["base"]), default=0) :]

    def _table(self, name: str, schema: str, past: list[dict]) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}").where(F.col("gen").isin([g["gen"] for g in past]))

    def _live(self, past: list[dict]) -> DataFrame:
        """(id, size, words, counts, gen) of the nodes in force."""
        if not past:
            return self.spark.createDataFrame([], f"{_DOCS}, gen string")
        gone = self._table("gone", _GONE, past).select("id", F.col("of").alias("gen"))
        return self._table("docs", f"{_DOCS}, gen string", past).join(gone, ["id", "gen"], "left_anti")

    def add(self, nodes: DataFrame) -> int:
        """Takes ``nodes(id, text)`` in; rows of an id already there replace it, and with ``status`` tombstones remove it.
        Work grows with the rows given and the nodes' words, not with the posting lists. Gives the generation's number."""
        past = self.generations()
        alive = F.coalesce(F.col("status") != "tombstone", F.lit(True)) if "status" in nodes.columns else F.lit(True)
        rows = nodes.where("id is not null").groupBy(F.col("id").cast("string").alias("id")).agg(F.max(F.struct(alive.alias("alive"), F.coalesce("text", F.lit("")).alias("text"))).alias("row"))
        rows = cut(rows.select("id", "row.alive", "row.text"))
        fresh = rows.where("alive").select("id", "text").mapInArrow(_read_words, _DOCS)
        old = cut(self._live(past).join(rows.select("id"), "id", "left_semi")) if past else None
        return self._write(fresh, old, past, base=not past)

    def compact(self) -> int:
        """All nodes in force as one generation, from their stored words; older generations are no longer read."""
        past = self.generations()
        return self._write(self._live(past).drop("gen"), None, past, base=True)

    def _write(self, fresh: DataFrame, old: DataFrame | None, past: list[dict], base: bool) -> int:
        number = past[-1]["number"] + 1 if past else 1
        gen = f"g{number}-{uuid.uuid4().hex}"
        at = lambda name: f"{self.path}/{name}/gen={gen}"
        fresh.write.parquet(at("docs"))
        docs = self.spark.read.schema(_DOCS).parquet(at("docs"))
        old = self.spark.createDataFrame([], f"{_DOCS}, gen string") if old is None else old
        old.select("id", F.col("gen").alias("of")).write.parquet(at("gone"))

        length = F.floor(4 * F.log2(F.col("size") + 1))
        # A row a class of lengths; ranges of long nodes have fewer of them, so that about ``HELD`` words are in one.
        parts = docs.groupBy(length.alias("length")).agg(F.ceil(F.greatest(F.count("*") / self.range_size, F.sum(F.size("words")) / HELD)).alias("parts"))
        ranged = docs.withColumn("length", length).join(F.broadcast(parts), "length")
        ranged = ranged.select("id", "size", "words", "counts", (F.col("length") * (1 << 40) + F.pmod(F.xxhash64("id"), "parts")).alias("range"))
        # Nodes are shuffled whole, by range; the lists of a range are then made where its nodes are.
        ranged = ranged.repartition("range").select("id", "size", "range", F.explode(F.arrays_zip("words", "counts")).alias("w"))
        entry = F.struct("id", F.col("w.counts").alias("count"), "size")
        lists = ranged.groupBy(F.col("w.words").alias("word"), "range").agg(
            F.count("*").alias("n"), F.max("w.counts").alias("top"), F.min("size").alias("shortest"), F.sort_array(F.collect_list(entry)).alias("list")
        )  # about RANGE entries
        less = old.select(F.explode("words").alias("word")).groupBy("word").agg((-F.count("*")).alias("n"))
        rows = lists.unionByName(less, allowMissingColumns=True).withColumn("bucket", F.pmod(F.xxhash64("word"), F.lit(BUCKETS)).cast("int"))
        rows.sortWithinPartitions("bucket", "word", "range").write.partitionBy("bucket").parquet(at("postings"))

        total = lambda d: d.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("w")).first()
        new, lost = total(docs), total(old)
        line = {"number": number, "gen": gen, "docs": new.n - lost.n, "words": new.w - lost.w, "base": base}
        if not create_text(self.spark, f"{self.path}/LOG/{number:08d}.json", json.dumps(line) + "\n"):
            raise Conflict(f"generation {number} was added by another writer meanwhile")
        return number

    def search(self, queries: DataFrame, k: int = 10) -> DataFrame:
        """(qid, rank, id, score): the k nodes of each of ``queries(qid, text)`` with the highest BM25 above 0."""
        out = self.spark.createDataFrame([], f"qid {queries.schema['qid'].dataType.simpleString()}, rank long, id string, score double")
        past, held = self.generations(), []
        for row in queries.select("qid", "text").orderBy("qid").toLocalIterator() if past and k > 0 else []:
            held.append(row)
            if len(held) == BLOCK:
                out, held = out.unionByName(self._block(held, past, k, out)), []
        return out.unionByName(self._block(held, past, k, out)) if held else out

    def _block(self, rows: list, past: list[dict], k: int, like: DataFrame) -> DataFrame:
        block = _Block(self, past, [r.text for r in rows])
        names = self.spark.createDataFrame([(q, r.qid) for q, r in enumerate(rows)], f"q int, qid {like.schema['qid'].dataType.simpleString()}")
        return block.best(k).join(F.broadcast(names), "q").select("qid", F.col("rank").cast("long").alias("rank"), "id", "score")  # a block's names


class _Block:
    """At most ``BLOCK`` stated queries, whose words and weights are broadcast."""

    def __init__(self, index: Index, past: list[dict], texts: list[str | None]):
        spark = index.spark
        asked = [Counter((t or "").lower().split()) for t in texts]
        words = sorted(set().union(*asked)) or [""]
        sought = spark.createDataFrame([(w,) for w in words], "word string").withColumn("bucket", F.pmod(F.xxhash64("word"), F.lit(BUCKETS)).cast("int"))
        buckets = [r.bucket for r in sought.select("bucket").distinct().collect()]
        lists = index._table("postings", _POSTINGS, past).where(F.col("bucket").isin(buckets) & F.col("word").isin(words))
        having = {r.word: r.n for r in lists.groupBy("word").agg(F.sum("n").alias("n")).collect()}  # a row a word of the block
        nodes, size = sum(g["docs"] for g in past), sum(g["words"] for g in past)
        mean = (size / nodes if nodes else 0.0) or 1.0
        weigh = lambda word, n: n * math.log(1 + (nodes - having[word] + 0.5) / (having[word] + 0.5))
        weights = [(q, w, weigh(w, n)) for q, c in enumerate(asked) for w, n in c.items() if having.get(w, 0) > 0]
        self.gone = index._table("gone", _GONE, past).select("id", F.col("of").alias("gen"))
        self.part = lambda n, length: n * (K1 + 1) / (n + K1 * (1 - B + B * length / mean))
        weighed = F.broadcast(spark.createDataFrame(weights, "q int, word string, weight double"))  # the block's words
        self.found = lists.where("range is not null")
        self.lists = self.found.join(weighed, "word")
        asking: dict[str, list] = {}
        for q, word, weight in weights:
            asking.setdefault(word, []).append((q, weight))
        self.asking = spark.sparkContext.broadcast(asking)  # the same, by word

    def bounds(self) -> DataFrame:
        """(q, gen, range, bound): no node of the range scores more; read without the lists themselves."""
        return self.lists.groupBy("q", "gen", "range").agg(F.sum(F.col("weight") * self.part(F.col("top"), F.col("shortest"))).alias("bound"))

    def scores(self, picked: DataFrame, k: int) -> DataFrame:
        """(q, id, score) of the nodes in force in ``picked(q, gen, range)``, summed in order of words; of each range those that
        may be among a query's k best. Lists are shuffled once, by range, however many queries ask for their words."""
        part, asking = self.part, self.asking
        picked = picked.select("q", F.col("gen").alias("of"), F.col("range").alias("among"))
        some = self.found.select("gen", "range", "word", "list").join(picked, (F.col("gen") == F.col("of")) & (F.col("range") == F.col("among")), "left_semi")
        held = some.select("gen", "range", "word", F.inline("list")).join(self.gone, ["id", "gen"], "left_anti")

        def score(entries: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
            ids, at = np.unique(entries["id"].to_numpy(str), return_inverse=True)
            queries = np.unique(wanted["q"].to_numpy())
            place = {q: i for i, q in enumerate(queries.tolist())}
            total = np.zeros((len(queries), len(ids)))
            x = part(entries["count"].to_numpy(np.float64), entries["size"].to_numpy(np.float64))
            for word, rows in sorted(entries.groupby("word").indices.items()):
                for q, weight in asking.value[word]:
                    if q in place:
                        total[place[q], at[rows]] += weight * x[rows]
            out = []
            for q, line in zip(queries, total):
                least = np.partition(line, len(line) - k)[len(line) - k] if len(line) > k else 0.0
                best = np.flatnonzero((line > 0) & (line >= least - _SLACK))
                out.append(pd.DataFrame({"q": q, "id": ids[best], "score": line[best]}))
            return pd.concat(out) if out else pd.DataFrame({"q": [], "id": [], "score": []})

        hits = held.groupBy("gen", "range").cogroup(picked.groupBy("of", "among")).applyInPandas(score, "q int, id string, score double")
        return hits.select("q", "id", F.round("score", 9).alias("score")).where("score > 0")

    def ranges(self, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
        """The scores of each query's first k ranges (its k best may lie in as many), all ranges by bound, and those
        still to be scored."""
        order = Window.partitionBy("q").orderBy(F.desc("bound"), "gen", "range")
        every = cut(self.bounds().withColumn("place", F.row_number().over(order)))
        early = cut(_ranked(self.scores(every.where(F.col("place") <= k), k), k))
        floor = early.where(F.col("rank") == k).select("q", F.col("score").alias("floor"))
        later = every.where(F.col("place") > k).join(F.broadcast(floor), "q", "left").where(F.col("bound") + _SLACK >= F.coalesce("floor", F.lit(0.0)))  # a row a query
        return early, every, later

    def best(self, k: int) -> DataFrame:
        early, _, later = self.ranges(k)
        return _ranked(early.drop("rank").unionByName(self.scores(later, k)), k)


def _ranked(scores: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))
    return scores.withColumn("rank", rank).where(F.col("rank") <= k)
