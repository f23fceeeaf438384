"""Exact n-gram Jaccard join with skipping by set relations, as connected components.

A text's set holds its distinct word n-grams. Equal sets are one class. Sets that reach
the threshold share a token among the first few of each in any common order of tokens;
here frequent tokens come last, so that a passage which many texts share does not bring
them together. The index has a list of sets for each such token.

* Position and size skip parts of a list: entries are cut into bands of size, only equal
  or neighbouring bands meet, and two entries whose positions leave too few tokens for
  the needed overlap are passed over.
* A list too long for that is answered by set relations. Every set meets the list's
  first set; sets found similar to one another (one component) then share their
  answers, and only pairs of different components are looked at again, in blocks.
* Before sets are read, a bitmap of token parities bounds the overlap of a pair from
  above: two bitmaps differ in at most as many bits as the sets in tokens. What
  remains is counted exactly.

Defined results: words are runs of bytes other than space and \\x09-\\x0D, A-Z in lower
case; a text of fewer than n words has one n-gram, the whole sequence; null and blank
texts have the empty set and link with nothing; rows with a null id get a null
component; repeated rows are documents of their own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordCache, components, mix64, saved

#: Longest list whose pairs are formed one by one, entries of a block of a longer one, and rows of a block
#: that are compared at a time.
SHORT_LIST, BLOCK, STRIP = 64, 4096, 256
#: A token is frequent if more sets have it in front than this, or than a 2**20th of all entries;
#: so at most 2**20 tokens are broadcast.
FREQUENT, MOST_FREQUENT = 32, 1 << 20
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)]


class Shingler:
    """Sorted distinct 64-bit hashes of a text's word n-grams."""

    def __init__(self, n: int):
        self.n = n
        self.cache = WordCache(xxhash.xxh3_64_intdigest)

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        h = np.fromiter(map(self.cache.__getitem__, words), np.uint64, len(words))
        self.cache.trim()
        k = min(self.n, len(h))
        with np.errstate(over="ignore"):
            total = np.full(len(h) - k + 1, k, np.uint64)
            for j in range(k):
                total += mix64(h[j : len(h) - k + 1 + j] ^ _ODD[j % 8]) * _ODD[(j + j // 8) % 8]
        return np.unique(mix64(total))


def needed(x: int | np.ndarray, y: int | np.ndarray, percent: int):
    """Least overlap of sets of these sizes: the smallest o with 100 o >= percent * (x + y - o)."""
    return -(-percent * (x + y) // (100 + percent))


def prefix_size(n: int, percent: int) -> int:
    """So many first tokens hold one that any similar set has among its own first."""
    return n - -(-percent * n // 100) + 1


def bitmap(tokens: np.ndarray) -> bytes:
    """Parities of the tokens by their low bits, about two bits a token."""
    bits = max(64, 1 << int(2 * len(tokens) - 1).bit_length())
    return np.packbits((np.bincount((tokens & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def fold(bits: np.ndarray, size: int) -> np.ndarray:
    """A bitmap (rows of bytes) at a smaller size: parities of bits that fall together add up."""
    while bits.shape[-1] > size:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] ^ bits[..., half:]
    return bits


def _bound_holds(x: bytes, y: bytes, nx: int, ny: int, percent: int) -> bool:
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    size = min(len(a), len(b))
    apart = int(np.bitwise_count(fold(a, size) ^ fold(b, size)).sum())
    return (nx + ny - apart) // 2 >= needed(nx, ny, percent)


def _map_sets(docs: DataFrame, make, schema: str, n: int) -> DataFrame:
    """``make(doc ids, sets)`` gives a batch's columns, for documents in small batches."""

    def run(it):
        shingler = Shingler(n)
        for batch in it:
            yield make(batch.column("doc_id"), [shingler(t) for t in batch.column("text").to_pylist()])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def index(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, two halves of the set's signature, first tokens and bitmap of each text."""

    def front(ids, sets):
        tokens = [s[: prefix_size(len(s), percent)] for s in sets if len(s)]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64) if tokens else np.zeros(0, np.int64))], names=["token"])

    fronts = saved(_map_sets(docs, front, "token long", n).groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") > FREQUENT))
    # Entries of frequent tokens only: with a limit from their sum, no more than MOST_FREQUENT tokens pass.
    total = fronts.agg(F.sum("n")).first()[0] or 0
    hot = np.sort(fronts.where(F.col("n") > max(FREQUENT, total // MOST_FREQUENT)).select("token").toArrow()["token"].to_numpy().view(np.uint64))
    held = docs.sparkSession.sparkContext.broadcast(hot)

    def rows(ids, sets):
        hot, firsts = held.value, []
        for s in sets:
            late = np.zeros(len(s), bool)
            if len(hot):
                late = hot[np.minimum(np.searchsorted(hot, s), len(hot) - 1)] == s
            firsts.append(np.concatenate([s[~late], s[late]])[: prefix_size(len(s), percent)].view(np.int64) if len(s) else np.zeros(0, np.int64))
        ends = np.concatenate([[0], np.cumsum([len(f) for f in firsts])]).astype(np.int32)
        digest = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
        return pa.RecordBatch.from_arrays(
            [
                ids,
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([int.from_bytes(d[:8], "big", signed=True) for d in digest], pa.int64()),
                pa.array([int.from_bytes(d[8:], "big", signed=True) for d in digest], pa.int64()),
                pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *firsts]))),
                pa.array([bitmap(s) if len(s) else b"" for s in sets], pa.binary()),
            ],
            names=["doc_id", "n_shingles", "sig1", "sig2", "front", "bits"],
        )

    return saved(_map_sets(docs, rows, "doc_id long, n_shingles long, sig1 long, sig2 long, front array<long>, bits binary", n))


def _verified(pairs: DataFrame, sets: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """Those of ``pairs(a, b)`` that link, as a saved table; reads the texts of their documents only."""
    sized = sets.select("doc_id", "n_shingles", "bits")
    side = lambda c: sized.select(F.col("doc_id").alias(c), F.col("n_shingles").alias(f"n{c}"), F.col("bits").alias(f"bits{c}"))

    def bound(it):
        for batch in it:
            p = batch.to_pydict()
            keep = [_bound_holds(*row, percent) for row in zip(p["bitsa"], p["bitsb"], p["na"], p["nb"])]
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    close = saved(pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "bitsa", "bitsb").mapInArrow(bound, "a long, b long").distinct())
    wanted = close.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()

    def whole(ids, sets):
        return pa.RecordBatch.from_arrays([ids, pa.array([s.tobytes() for s in sets], pa.binary())], names=["doc_id", "tokens"])

    texts = saved(_map_sets(docs.select("doc_id", "text").join(wanted, "doc_id", "left_semi"), whole, "doc_id long, tokens binary", n))

    def count(it):
        for batch in it:
            keep = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                same = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * same >= percent * (len(x) + len(y) - same))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    x = texts.select(F.col("doc_id").alias("a"), F.col("tokens").alias("x"))
    y = texts.select(F.col("doc_id").alias("b"), F.col("tokens").alias("y"))
    return saved(close.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(count, "a long, b long"))


def _long_list_pairs(entries: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components in long lists that the bitmaps allow, from blocks of each list's bands."""
    group = ["token", "pair_band"]
    both = entries.withColumn("pair_band", F.explode(F.array("band", F.col("band") + 1)))  # meets its own band and the next
    sizes = both.groupBy(group).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    placed = both.join(sizes, group).withColumn("own", F.pmod(F.xxhash64("doc_id", "token"), "blocks").cast("int"))
    # Block i meets each block j >= i: it is sent once to every pair of blocks that holds it.
    paired = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        *group, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "doc_id", "component_id", "n_shingles", "position", "bits"
    )

    def match(frame):
        import pandas as pd

        d = frame.reset_index(drop=True)
        n, pos, comp = (d[c].to_numpy(np.int64) for c in ("n_shingles", "position", "component_id"))
        size = min(map(len, d["bits"]))
        bits = np.unpackbits(np.stack([fold(np.frombuffer(b, np.uint8), size) for b in d["bits"]]), axis=1).astype(np.float32)
        ones, ids, out = bits.sum(axis=1), d["doc_id"].to_numpy(), []
        for at in range(0, len(d), STRIP):
            x = slice(at, at + STRIP)
            apart = ones[x, None] + ones[None, :] - 2 * bits[x] @ bits.T
            least = needed(n[x, None], n[None, :], percent)
            room = np.minimum(pos[x, None], pos[None, :]) + np.minimum((n - pos)[x, None], (n - pos)[None, :])
            i, j = np.nonzero((comp[x, None] < comp[None, :]) & ((n[x, None] + n[None, :] - apart) // 2 >= least) & (room >= least))
            out.append(np.stack([np.minimum(ids[at + i], ids[j]), np.maximum(ids[at + i], ids[j])]))
        a, b = np.concatenate(out, axis=1)
        return pd.DataFrame({"a": a, "b": b})

    return paired.groupBy(*group, "i", "j").applyInPandas(match, "a long, b long").distinct()


def join(docs: DataFrame, n: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs(doc_id, text)``."""
    sets = index(docs, n, percent)
    signature = ["sig1", "sig2", "n_shingles"]
    classes = saved(sets.where("n_shingles > 0 and doc_id is not null").groupBy(signature).agg(F.min("doc_id").alias("class_id")))
    firsts = sets.join(classes, signature).where("doc_id = class_id").select("doc_id", "n_shingles", "bits", "front").dropDuplicates(["doc_id", "n_shingles", "bits"])
    entries = firsts.select("doc_id", "n_shingles", F.posexplode("front").alias("position", "token"))
    ratio = float(np.log(100 / percent)) * 1.0001  # sizes a factor of 100 / percent apart are in neighbouring bands
    entries = entries.withColumn("band", F.floor(F.log(F.col("n_shingles")) / ratio).cast("int"))
    counts = saved(entries.groupBy("token").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).where("n > 1"))
    lists = saved(entries.join(counts, "token"))

    left = lists.where(F.col("n") <= SHORT_LIST).select("token", F.col("doc_id").alias("a"), F.col("n_shingles").alias("na"), F.col("position").alias("pa"), F.col("band").alias("ba"))
    right = lists.where(F.col("n") <= SHORT_LIST).select("token", F.col("doc_id").alias("b"), F.col("n_shingles").alias("nb"), F.col("position").alias("pb"), F.col("band").alias("bb"))
    least = F.ceil((F.col("na") + F.col("nb")) * F.lit(percent) / F.lit(100.0 + percent) - 1e-9)
    room = F.least("pa", "pb") + F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))
    short = left.join(right, "token").where((F.col("a") < F.col("b")) & (F.abs(F.col("ba") - F.col("bb")) <= 1) & (room >= least)).select("a", "b")
    leaders = lists.where((F.col("n") > SHORT_LIST) & (F.col("doc_id") > F.col("first"))).select(F.col("first").alias("a"), F.col("doc_id").alias("b"))
    links = _verified(saved(short.union(leaders).distinct()), sets, docs, n, percent)
    found = components(links)

    long = lists.where(F.col("n") > SHORT_LIST)
    known = long.join(found.withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    mixed = known.groupBy("token").agg(F.min("component_id").alias("low"), F.max("component_id").alias("high")).where("low < high").select("token")
    open_ = saved(known.join(mixed, "token", "left_semi").join(sets.select("doc_id", "bits").dropDuplicates(["doc_id"]), "doc_id"))
    if not open_.isEmpty():
        more = _verified(saved(_long_list_pairs(open_, percent)), sets, docs, n, percent)
        found = components(links.union(more))

    by_class = classes.join(found.withColumnRenamed("id", "class_id"), "class_id", "left").select(*signature, F.coalesce("component_id", "class_id").alias("component_id"))
    out = sets.select("doc_id", *signature).join(by_class, signature, "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"))
