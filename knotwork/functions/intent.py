"""What a text says about another: supersedes, contradicts or continues, by marker phrases.

A text is read once (``profiles``): its content words, and for each marker in one of its clauses
the clause's content words and, after a marker that needs an object, the two words that follow it.
Two texts then meet in set operations only (``kind``): a marker counts if its clause, and its
object where it needs one, holds a content word that both texts have. The first kind in order of
``PRIORITY`` holds. A null text counts as empty; a text without markers can still be told off by the
other's.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.functions.embedding import slices
from knotwork.functions.text import OBJECT_MARKERS, PRIORITY, STOP_WORDS

_WORD = re.compile("[a-zäöüß0-9]+")
_CLAUSE = re.compile(r"[.!?;,:()\[\]\"']|\n+")
_STOP = frozenset(STOP_WORDS)
_MARKERS = [(order, tuple(marker.split())) for order, kind in enumerate(PRIORITY) for marker in PRIORITY[kind]]
_HIT = pa.struct([("kind", pa.int32()), ("clause", pa.list_(pa.string())), ("object", pa.list_(pa.string()))])
_PROFILE = "struct<content:array<string>,hits:array<struct<kind:int,clause:array<string>,object:array<string>>>>"


def content_words(words: list[str]) -> set[str]:
    return {w for w in words if len(w) >= 3 and w not in _STOP}


def profile(text: str | None) -> tuple[list[str], list[dict]]:
    """Content words and marker hits of a text; a hit's object is None where none is needed."""
    lower, hits = (text or "").lower(), []
    for part in _CLAUSE.split(lower):
        words = _WORD.findall(part)
        spaced = f" {' '.join(words)} "
        for order, marker in _MARKERS:
            if f" {' '.join(marker)} " not in spaced:
                continue
            after = None
            if marker[0] in OBJECT_MARKERS:
                size = len(marker)
                ends = [i + size for i in range(len(words) - size + 1) if tuple(words[i : i + size]) == marker]
                after = sorted({w for end in ends for w in words[end : end + 2]})
            hits.append({"kind": order, "clause": sorted(content_words(words)), "object": after})
    return sorted(content_words(_WORD.findall(lower))), hits


def profiles(rows: DataFrame, text: str = "text", name: str = "profile") -> DataFrame:
    """``rows`` with the profile of a text column instead of that column."""
    keep = [c for c in rows.columns if c != text]

    def run(it):
        for batch in slices(it):
            found = [profile(t) for t in batch.column(text).to_pylist()]
            both = pa.StructArray.from_arrays([pa.array([c for c, _ in found], pa.list_(pa.string())), pa.array([h for _, h in found], pa.list_(_HIT))], names=["content", "hits"])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), both], names=[*keep, name])

    schema = rows.select(*keep).withColumn(name, F.lit(None).cast(_PROFILE)).schema
    return rows.select(*keep, text).mapInArrow(run, schema)


def with_kind(pairs: DataFrame, new: str, old: str, name: str = "intent") -> DataFrame:
    """``pairs`` with the kind (or null) between two profile columns, in place of these."""
    rest = [c for c in pairs.columns if c not in (new, old)]
    shared = pairs.select(*rest, F.array_intersect(f"{new}.content", f"{old}.content").alias("_shared"), F.concat(f"{new}.hits", f"{old}.hits").alias("_hits"))
    says = F.filter("_hits", lambda h: F.arrays_overlap(h["clause"], F.col("_shared")) & (h["object"].isNull() | F.arrays_overlap(h["object"], F.col("_shared"))))
    first = F.array_min(F.transform(says, lambda h: h["kind"]))
    kinds = F.array(*map(F.lit, PRIORITY))
    return shared.select(*rest, F.when(first.isNotNull(), F.element_at(kinds, first + 1)).alias(name))


def kind_of(new: str | None, old: str | None) -> str | None:
    """The same for two texts on the driver."""
    (a, new_hits), (b, old_hits) = profile(new), profile(old)
    shared = set(a) & set(b)
    found = [h["kind"] for h in (*new_hits, *old_hits) if shared & set(h["clause"]) and (h["object"] is None or shared & set(h["object"]))]
    return list(PRIORITY)[min(found)] if found else None

