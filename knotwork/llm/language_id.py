"""Language identification by known words, backing off to character n-grams.

A word seen in training is scored by its log frequency in each language. An unseen
word is covered, at each of its positions, by the longest known character n-gram
that starts there (five characters down to one), and the mean of these n-gram log
frequencies stands in for the word; n-grams are learned from every word, whole. A text's score per language is the sum over all
of its words; the prediction is the largest, ties going to the alphabetically first.

Defined results: a null text, or one without a letter, is ``und`` with score 0. With
no usable training row every text is ``und``. Extra columns of the input are ignored,
repeated rows are scored each for itself, and null languages are never learned.
"""

from __future__ import annotations

import re
from collections import Counter
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordCache, WordTable, batches, saved

#: A kept word or n-gram has at least this share of the total of some language, which bounds
#: the model by 1 / share entries a language (and order) however large the corpus is.
WORD_SHARE, GRAM_SHARE = 5e-6, 1e-5
ORDERS = (5, 4, 3, 2, 1)
#: The score is the posterior on the evidence of at most so many words.
EVIDENCE_WORDS = 24
_EDGE = re.compile(r"^[\W\d_]+|[\W\d_]+$")
_HELD = 400_000  # distinct words or n-grams that a counting task holds before it passes them on
_PIECE = 50_000  # characters counted between two looks at what is held


def clean_word(token: str) -> str:
    """Lower case, without what isn't a letter at either end; empty if no letter is left."""
    return token.lower() if token.isalpha() else _EDGE.sub("", token).lower()


_COUNTS = "lang string, kind int, item string, n long"
_COUNTS_PA = pa.schema([("lang", pa.string()), ("kind", pa.int32()), ("item", pa.string()), ("n", pa.int64())])


def _count_words(it):
    def rows():
        held: dict[str, Counter] = {}
        for batch in it:
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
                held.setdefault(lang, Counter()).update(text.split())
                if sum(map(len, held.values())) > _HELD:
                    yield from drain(held)
                    held = {}
        yield from drain(held)

    def drain(held):
        clean = WordCache(clean_word)
        for lang, counts in held.items():
            out: Counter = Counter()
            for token, n in counts.items():
                if word := clean[token]:
                    out[word] += n
            for word, n in out.items():
                yield lang, 0, word, n

    return batches(rows(), _COUNTS_PA)


def _count_grams(it):
    """Counts what stands at each position, up to five characters; the shorter n-grams begin these."""

    def rows():
        held: dict[tuple[str, int], Counter] = {}  # first: at a word's start, which is no character of its own
        fed = 0
        for batch in it:
            for lang, word, n in zip(*(batch.column(c).to_pylist() for c in ("lang", "item", "n"))):
                # A word may be a whole text without spaces, so it is counted piece by piece.
                padded, longest = f"^{word}$", ORDERS[0]
                held.setdefault((lang, True), Counter())[padded[:longest]] += n
                for at in range(1, len(padded) - 1, _PIECE):
                    counts = held.setdefault((lang, False), Counter())
                    found = [padded[i : i + longest] for i in range(at, min(at + _PIECE, len(padded) - 1))]
                    if n == 1:
                        counts.update(found)
                    else:
                        for gram in found:
                            counts[gram] += n
                    fed += min(len(word), _PIECE)
                    if fed >= _PIECE:
                        fed = 0
                        if sum(map(len, held.values())) > _HELD:
                            yield from drain(held)
                            held = {}
        yield from drain(held)

    def drain(held):
        for lang in sorted({lang for lang, _ in held}):
            for order in ORDERS:
                out: Counter = Counter()
                for first in (True, False):
                    if order > 1 or not first:
                        for found, n in held.get((lang, first), {}).items():
                            if len(found) >= order:
                                out[found[:order]] += n
                for gram, n in out.items():
                    yield lang, order, gram, n

    return batches(rows(), _COUNTS_PA)


class Model:
    """Log frequencies of words (kind 0) and n-grams (kind: the order), a value a language each."""

    def __init__(self, counts: pd.DataFrame, totals: dict[tuple[str, int], int]):
        self.langs = sorted({lang for lang, _ in totals})
        self.rows: list[dict[str, int]] = [{} for _ in range(max(ORDERS) + 1)]
        codes, unique = pd.factorize(pd.MultiIndex.from_frame(counts[["kind", "item"]])) if len(counts) else (np.zeros(0, int), [])
        n = np.zeros((len(unique), len(self.langs)))
        np.add.at(n, (codes, np.searchsorted(self.langs, counts["lang"].to_numpy(dtype=str)) if len(counts) else codes), counts["n"].to_numpy(dtype=float))
        kinds = np.array([k for k, _ in unique], dtype=np.int64)
        total = np.array([[totals.get((lang, kind), 0) for lang in self.langs] for kind in range(len(self.rows))], dtype=float).reshape(len(self.rows), len(self.langs))
        self.logs = np.log((n + 0.5) / (total[kinds] + 1000.0)).astype(np.float32)
        for at, (kind, item) in enumerate(unique):
            self.rows[kind][item] = at

    def _longest(self, ahead: str) -> int:
        """The row of the longest known n-gram that begins ``ahead``; -1 without one."""
        for order in ORDERS:
            if len(ahead) >= order and (row := self.rows[order].get(ahead[:order])) is not None:
                return row
        return -1

    def rows_of(self, word: str, longest: WordCache) -> list[int]:
        """Rows whose mean stands for a cleaned word: its own, or one of each position's n-gram."""
        if (known := self.rows[0].get(word)) is not None:
            return [known]
        padded, size = f"^{word}$", ORDERS[0]
        return [row for row in map(longest.__getitem__, [padded[i : i + size] for i in range(len(padded) - 1)]) if row >= 0]

    def word(self, token: str) -> np.ndarray | None:
        """Log frequencies of a word in each language; None without a letter."""
        live, rows = self._vectors([token], WordCache(self._longest))
        return rows[0] if live[0] else None

    def scorer(self):
        """A function from a text to (language, score)."""
        longest = WordCache(self._longest)
        table = WordTable(lambda words: self._vectors(words, longest), len(self.langs))

        def score(text: str | None) -> tuple[str, float]:
            total, n, words = np.zeros(len(self.langs)), 0, (text or "").split()
            for at in range(0, len(words), 50_000):
                ids = table.places(words[at : at + 50_000])
                total += table.matrix[ids].sum(axis=0, dtype=np.float64)
                n += int(np.count_nonzero(ids))
            longest.trim()
            if not n or not self.langs:
                return "und", 0.0
            best = int(np.argmax(total))
            odds = (total - total[best]) * (min(n, EVIDENCE_WORDS) / n)
            return self.langs[best], float(1.0 / np.exp(odds).sum())

        return score

    def _vectors(self, words: list[str], longest: WordCache) -> tuple[np.ndarray, np.ndarray]:
        """Which of ``words`` have a letter, and a row of log frequencies for each of these."""
        clean = list(map(clean_word, words))
        live = np.array([bool(w) for w in clean], bool)
        found = [self.rows_of(w, longest) for w in clean if w]
        sizes = np.array([len(f) for f in found], np.int64)
        out = np.zeros((len(found), len(self.langs)), np.float32)
        some = np.flatnonzero(sizes)
        if len(some):
            flat = np.fromiter(chain.from_iterable(found), np.int64, int(sizes.sum()))
            starts = (np.cumsum(sizes) - sizes)[some]
            out[some] = np.add.reduceat(self.logs.take(flat, axis=0), starts, axis=0) / sizes[some, None]
        return live, out


def train(rows: DataFrame) -> Model:
    """A model from ``(text, lang)`` rows; counts cover every row with neither null."""
    rows = rows.select("text", "lang").where("text is not null and lang is not null")
    words = saved(rows.mapInArrow(_count_words, _COUNTS).groupBy("lang", "kind", "item").agg(F.sum("n").alias("n")))
    grams = words.select("lang", "item", "n").mapInArrow(_count_grams, _COUNTS).groupBy("lang", "kind", "item").agg(F.sum("n").alias("n"))
    both = words.unionByName(saved(grams))
    totals = both.groupBy("lang", "kind").agg(F.sum("n").alias("total"))
    share = F.when(F.col("kind") == 0, WORD_SHARE).otherwise(GRAM_SHARE)
    # A row a language and order, at most a few hundred, so totals may be broadcast.
    shared = both.join(F.broadcast(totals), ["lang", "kind"]).where(F.col("n") >= share * F.col("total")).select("kind", "item").distinct()
    # An item that any language keeps keeps its counts in all of them.
    kept = both.join(shared, ["kind", "item"], "left_semi")
    sums = {(r.lang, r.kind): r.total for r in totals.collect()}
    return Model(kept.select("lang", "kind", "item", "n").toArrow().to_pandas(), sums)


def predict(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """``keep`` columns of each row with lang_pred and score; reads only those and the text."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in keep if c not in ("lang_pred", "score")]  # a result replaces a column of its name
    of = "text" if "text" in keep else "__text"
    source = docs.select(*keep, *([] if of == "text" else [F.col("text").alias(of)]))
    schema = docs.select(*keep).withColumn("lang_pred", F.lit("")).withColumn("score", F.lit(0.0)).schema

    def run(it):
        score = held.value.scorer()
        for batch in it:
            found = [score(t) for t in batch.column(of).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                names=[*keep, "lang_pred", "score"],
            )

    return source.mapInArrow(run, schema)
