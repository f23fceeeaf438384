"""Embedders: objects whose ``embed(texts)`` gives a matrix with a row of doubles a text.

``HashEmbedder`` needs no model. Any other object with that method can stand in its place;
it is shipped to the workers, so it has to pickle and should load its model on first use.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_CACHED = 200_000  # words a worker remembers


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> np.ndarray: ...


class HashEmbedder:
    """Each word adds 1 or -1 to one of ``dims`` places, by its sha256; rows have length 1, or 0 without words."""

    def __init__(self, dims: int = 64):
        self.dims, self.cache = dims, {}

    @property
    def name(self) -> str:
        return f"hash-{self.dims}"

    def __getstate__(self):
        return {"dims": self.dims, "cache": {}}

    def _place(self, word: str) -> int:
        """Twice the place, and one more for a positive sign."""
        found = self.cache.get(word)
        if found is None:
            if len(self.cache) >= _CACHED:
                self.cache.clear()
            h = int(hashlib.sha256(word.encode("utf-8", "surrogatepass")).hexdigest(), 16)
            found = self.cache[word] = 2 * (h % self.dims) + (h >> 8 & 1)
        return found

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dims))
        for row, text in zip(out, texts):
            at = np.array([self._place(w) for w in text.lower().split()], np.int64)
            n = np.bincount(at, minlength=2 * self.dims)
            row[:] = n[1::2] - n[::2]
        norms = np.sqrt((out * out).sum(axis=1))
        norms[norms == 0] = 1
        return out / norms[:, None]


def slices(batches: Iterable[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most ``rows`` rows, so that what Python makes of one doesn't grow with Spark's batches."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def normal_text(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def vectors_of(nodes: DataFrame, embedder: Embedder | None = None, with_text: bool = False) -> DataFrame:
    """(id, vec) of ``nodes(id, text)``, or (id, text, vec): embeddings of the texts in their normal form, no shuffle."""
    embedder = embedder or HashEmbedder()
    kept = ["id", "text"] if with_text else ["id"]

    def run(it):
        for batch in slices(it):
            found = np.ascontiguousarray(embedder.embed([normal_text(t) for t in batch.column("text").to_pylist()]), np.float64)
            ends = pa.array(np.arange(len(found) + 1, dtype=np.int32) * found.shape[1] if len(found) else np.zeros(1, np.int32))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.ListArray.from_arrays(ends, pa.array(found.ravel()))], names=[*kept, "vec"])

    return nodes.select("id", "text").mapInArrow(run, f"{', '.join(f'{c} string' for c in kept)}, vec array<double>")


def text_key(text: Column | str) -> Column:
    """A digest of what an embedder sees of a text, except for its case: stored vectors are of a node's text while it holds."""
    return F.sha2(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[ \t\n\x0B\f\r]+", " ")), 256)


def model_of(embedder: Embedder) -> str:
    """The name under which an embedder's vectors are stored: its ``name``, else that of its class."""
    return getattr(embedder, "name", type(embedder).__qualname__)


def stored(nodes: DataFrame, table: DataFrame | None = None, embedder: Embedder | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows (id, key, model, vec) for all ``nodes(id, text)``, and those of them that ``table`` has not: texts that are
    new or have changed, which alone are embedded. A table of other embedders' rows as well may be handed in."""
    embedder = embedder or HashEmbedder()
    model = model_of(embedder)
    wanted = nodes.select("id", "text", text_key("text").alias("key"))
    named = lambda rows: rows.select("id", text_key("text").alias("key"), F.lit(model).alias("model"), "vec")
    if table is None:
        every = named(vectors_of(wanted, embedder, with_text=True))
        return every, every
    rows = table.where((F.col("model") == model) & F.col("vec").isNotNull()).select("id", "key", "model", "vec")
    known = rows.join(wanted.select("id", "key"), ["id", "key"], "left_semi").dropDuplicates(["id", "key"])
    fresh = named(vectors_of(wanted.join(known.select("id", "key"), ["id", "key"], "left_anti"), embedder, with_text=True))
    return known.select("id", "key", "model", "vec").unionByName(fresh), fresh


def with_vectors(nodes: DataFrame, vectors: DataFrame, embedder: Embedder | None = None) -> DataFrame:
    """``nodes(id, text)`` with vec, null where ``vectors`` has none: rows (id, vec) stand for the node's text as it is,
    rows (id, key, model, vec) for a text of that key only."""
    if "key" not in vectors.columns:
        rows = vectors.where("vec is not null").groupBy("id").agg(F.first("vec").alias("vec"))
        return nodes.select("id", "text").join(rows, "id", "left")
    rows = vectors if embedder is None else vectors.where(F.col("model") == model_of(embedder))
    rows = rows.where("vec is not null").groupBy("id", "key").agg(F.first("vec").alias("vec"))
    return nodes.select("id", "text", text_key("text").alias("key")).join(rows, ["id", "key"], "left").select("id", "text", "vec")


def vectors_for(nodes: DataFrame, cached: DataFrame, embedder: Embedder | None = None) -> tuple[DataFrame, DataFrame]:
    """Vectors of all ``nodes``, those in ``cached(id, vec)`` read through, and the new ones alone, to be kept."""
    known = cached.join(nodes.select("id"), "id", "left_semi").select("id", "vec")
    fresh = vectors_of(nodes.join(cached.select("id"), "id", "left_anti"), embedder)
    return known.unionByName(fresh), fresh


def dominant(vectors: DataFrame) -> DataFrame:
    """Unit vectors of the most frequent length among all rows (the first of equals in id order), where the
    last row of an id holds by ``seq`` if there is one."""
    rows = vectors.where("vec is not null").withColumn("size", F.size("vec"))
    top = rows.groupBy("size").agg(F.count("*").alias("n"), F.min("id").alias("first")).orderBy(F.desc("n"), "first").limit(1)
    kept = rows.join(F.broadcast(top.select("size")), "size")  # one row
    if "seq" in vectors.columns:
        kept = kept.groupBy("id").agg(F.max_by("vec", "seq").alias("vec"))
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)) + 1e-12
    return kept.select("id", norm.alias("norm"), "vec").select("id", F.transform("vec", lambda x: x / F.col("norm")).alias("vec"))
