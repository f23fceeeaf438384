"""What the training-data operators share: saved tables, words, tokens, components."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Entries of a worker's word cache, in each of two generations.
CACHE_WORDS = 200_000
#: Longer words (lines of a script without spaces, encoded data) are not kept, which bounds the bytes that entries take.
LONGEST_KEPT = 64
#: Characters of words in each generation of a word table.
TABLE_CHARS = 1 << 24


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below ``spark.checkpoint.dir``; a temporary one where that is unset and everything runs
    on this machine (tests). A cluster has to name a shared folder."""
    conf = spark.sparkContext.getConf()
    base = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="knotwork-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/knotwork-{uuid.uuid4().hex}"


def saved(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: lineage ends here."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tuned(spark: SparkSession, rows: int = 500) -> None:
    """Arrow batches that hold whole long texts in bounded memory; shuffle files go once a table is saved."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class WordCache(dict):
    """``cache[word]`` computes a missing entry once, that of a long word each time. A full cache becomes the older generation, from
    which words in use come back, so memory stays bounded and frequent words stay."""

    def __init__(self, make: Callable, limit: int = CACHE_WORDS):
        super().__init__()
        self.make, self.limit, self.older = make, limit, {}

    def __missing__(self, word):
        if len(word) > LONGEST_KEPT:
            return self.make(word)
        value = self[word] = self.older[word] if word in self.older else self.make(word)
        return value

    def trim(self) -> None:
        if len(self) > self.limit:
            self.older = dict(self)
            self.clear()


class WordTable(dict):
    """As WordCache, for row numbers of words in a growing matrix; row 0 holds zeros and stands for words
    without a row. ``make`` gives, for a list of words, which have a row, and these rows."""

    def __init__(self, make: Callable, width: int, limit: int = CACHE_WORDS):
        super().__init__()
        self.make, self.limit, self.used, self.chars = make, limit, 1, 0
        self.matrix = np.zeros((1024, width), np.float32)
        self.older, self.older_matrix = {}, self.matrix

    def places(self, words: list[str]) -> np.ndarray:
        """Row numbers of ``words`` in ``matrix``, until the next call."""
        if len(self) > self.limit or self.chars > TABLE_CHARS:
            self.older, self.older_matrix, self.used, self.chars = dict(self), self.matrix[: self.used].copy(), 1, 0
            self.clear()
        found = list(map(self.get, words))
        if None in found:
            new = dict.fromkeys([w for w, at in zip(words, found) if at is None])
            if self.older and (back := [w for w in new if w in self.older]):
                at = np.fromiter(map(self.older.__getitem__, back), np.int64, len(back))
                self._add(back, at > 0, self.older_matrix[at[at > 0]])
            if fresh := [w for w in new if w not in self]:
                self._add(fresh, *self.make(fresh))
            found = list(map(self.__getitem__, words))
        return np.array(found, np.int64)

    def _add(self, words: list[str], live: np.ndarray, rows: np.ndarray) -> None:
        end = self.used + len(rows)
        while end > len(self.matrix):
            self.matrix = np.concatenate([self.matrix, np.zeros_like(self.matrix)])
        self.matrix[self.used : end] = rows
        self.chars += sum(map(len, words))
        places = np.zeros(len(words), np.int64)
        places[live] = np.arange(self.used, end)
        self.used = end
        self.update(zip(words, places.tolist()))


def batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 8192) -> Iterator[pa.RecordBatch]:
    """Row tuples as Arrow batches of at most ``size`` rows."""
    block: list[tuple] = []
    for row in rows:
        block.append(row)
        if len(block) >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*block), schema.types)], schema=schema)
            block = []
    if block:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*block), schema.types)], schema=schema)


def crc_of(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4"))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (public splitmix64 constants)."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """All inner products of the rows of two matrices, without threads of linear algebra beside Spark's."""
    return np.einsum("ik,jk->ij", x, y)


def components(edges: DataFrame) -> DataFrame:
    """Smallest reachable id of each endpoint that isn't itself it: ``(id, component_id)`` from edges ``(a, b)``.

    Alternating large-star and small-star steps, written to the shared folder, until a round leaves the set
    of edges as it was, however many rounds that takes. The rows of hubs stay where they are and get their
    hub's smallest neighbour by broadcast; there are fewer than 2 * HUBS of these.
    """
    work = saved(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    n = work.count()
    while n:
        both = work.union(work.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Large star: neighbours above u attach to the smallest id around u, or u itself.
        large = _with_least(both, n).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).where("u <> v").distinct()
        # Small star: u and its smaller neighbours attach to the smallest of them.
        to_least = F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v"))))
        new = saved(_with_least(large, n).select(to_least.alias("e")).select("e.u", "e.v").where("u <> v").distinct())
        size = new.count()
        if size == n and new.join(work, ["u", "v"], "left_anti").isEmpty():  # both are sets: the same edges
            break
        work, n = new, size
    return work.groupBy("u").agg(F.min("v").alias("component_id")).withColumnRenamed("u", "id")


#: A u of more than a HUBS-th of all edges (and more than HUB) is a hub.
HUB, HUBS = 4096, 1 << 16


def _with_least(rows: DataFrame, edges: int) -> DataFrame:
    """``rows(u, v)`` with m, the smallest v of u; ``rows`` are at most ``2 * edges``."""
    low = rows.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    hub = F.col("n") > max(HUB, edges // HUBS)
    if edges <= HUB:
        return rows.join(low.select("u", "m"), "u")
    tagged = rows.join(F.broadcast(low.where(hub).select("u", F.col("m").alias("hub_m"))), "u", "left")  # fewer than 2 * HUBS rows
    cold = tagged.where("hub_m is null").select("u", "v").join(low.where(~hub).select("u", "m"), "u")
    return cold.unionByName(tagged.where("hub_m is not null").select("u", "v", F.col("hub_m").alias("m")))
