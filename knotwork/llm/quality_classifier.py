"""Quality from graded ratings by an ordinal cumulative-link model.

A text's words and its shape (share of capitals, digits, symbols, repeated words,
length) are hashed into one weight table that all grades share; each feature has two
hash buckets and its weight is their sum, so that a rare word that falls on a telling
word's bucket brings half of its weight at most. The latent score s is the sum over
the distinct features, and ordered thresholds t_0 < t_1 < ... give
P(grade <= k) = sigmoid(t_k - s). The expected grade ranks texts, and the tail
probability P(grade >= g) selects them.

The model is fitted on at most ``max_train`` labelled texts, those with the smallest
hash of their id; every text is scored whole. Defined results: a null text counts as
empty; labels whose id or grade is null are not used, and of several labels of one id
the lowest grade holds, of several texts of one id that whose features' hash is smallest. With fewer than two grades to learn from, every text gets the
only grade (or 0) as its expectation and tail probability 1.
"""

from __future__ import annotations

import operator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordCache
from .language_id import clean_word

BUCKETS = 1 << 20
#: Bound on the labelled rows that are gathered for fitting.
MAX_TRAIN = 12_000
#: A bucket that fewer training texts have gets no weight.
MIN_TEXTS = 5
_UPPER = bytes(range(65, 91))
_DIGIT = bytes(range(48, 58))
_SYMBOL = b"!#$%&*+/<=>@[\\]^_`{|}~"
_LEVELS = (0.0, 0.002, 0.01, 0.03, 0.06, 0.12, 0.25, 0.5, 0.8)


def _level(share: float) -> int:
    return sum(share > x for x in _LEVELS)


def features(text: str | None) -> set[str]:
    """The distinct words of a text and, marked by a leading tab, its shape."""
    text = text or ""
    words, raw = text.split(), text.encode("utf-8", "surrogatepass")
    found, size = set(words), max(1, len(raw))
    same = sum(map(operator.eq, words, words[1:])) / max(1, len(words))
    for name, share in (
        ("upper", (len(raw) - len(raw.translate(None, _UPPER))) / size),
        ("digit", (len(raw) - len(raw.translate(None, _DIGIT))) / size),
        ("symbol", (len(raw) - len(raw.translate(None, _SYMBOL))) / size),
        ("same", same),
        ("distinct", len(found) / max(1, len(words))),
    ):
        found.add(f"\t{name}{_level(share)}")
    found.add(f"\tlength{len(words).bit_length()}")
    return found


def buckets(feature: str) -> tuple[int, int]:
    """The two places of a feature; words are taken in lower case, without punctuation around them."""
    name = feature if feature[0] == "\t" else clean_word(feature) or feature
    h = xxhash.xxh3_64_intdigest(name.encode("utf-8", "surrogatepass"))
    return h % BUCKETS, (h >> 32) % BUCKETS


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray
    lowest: float = 0.0  # the only grade, where there are no thresholds

    def latent(self, text: str | None, cache: dict) -> float:
        return sum(map(cache.__getitem__, features(text)))

    def cache(self) -> WordCache:
        weights = self.weights

        def weight(feature: str) -> float:
            a, b = buckets(feature)
            return float(weights[a] + weights[b])

        return WordCache(weight)

    def grades(self, s: np.ndarray, tail: int) -> tuple[np.ndarray, np.ndarray]:
        """Expected grade and P(grade >= tail) of latent scores."""
        if not len(self.thresholds):
            return np.full(len(s), self.lowest), np.ones(len(s))
        above = 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - s[:, None], -500, 500)))
        return self.lowest + above.sum(axis=1), above[:, min(max(tail, 1), above.shape[1]) - 1] if tail > 0 else np.ones(len(s))


def fit(rows: list[np.ndarray], grades: np.ndarray, epochs: int = 120, l2: float = 2e-4) -> Model:
    """Adam on the weighted likelihood; grades are 0, 1, ... without gaps. Same rows, same order: same model."""
    kinds = int(grades.max()) + 1 if len(grades) else 0
    if kinds < 2:
        return Model(np.zeros(BUCKETS, np.float32), np.zeros(0))
    sizes = np.array([len(r) for r in rows])
    flat = np.concatenate(rows).astype(np.int64)
    texts = np.bincount(flat, minlength=BUCKETS)
    live = np.flatnonzero(texts >= min(MIN_TEXTS, max(1, len(rows) // 20)))
    place = np.zeros(BUCKETS, np.int64)
    place[live] = np.arange(1, len(live) + 1)
    flat, row_of = place[flat], np.repeat(np.arange(len(rows)), sizes)
    flat, row_of = flat[flat > 0] - 1, row_of[flat > 0]
    n, share = len(rows), np.bincount(grades, minlength=kinds) / len(rows)
    weight = (1 / np.sqrt(np.maximum(share, 1e-9)))[grades]
    weight /= weight.sum()
    edges = np.log(np.cumsum(share)[:-1] / (1 - np.cumsum(share)[:-1]))
    w, first, gaps = np.zeros(len(live)), edges[0], np.log(np.maximum(np.diff(edges), 1e-2))
    size = len(live) + kinds - 1
    m, v = np.zeros(size), np.zeros(size)
    for step in range(1, epochs + 1):
        t = first + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])
        s = np.bincount(row_of, w[flat], minlength=n)
        padded = np.concatenate([[-np.inf], t, [np.inf]])
        hi = 1 / (1 + np.exp(-np.clip(padded[grades + 1] - s, -50, 50)))
        lo = 1 / (1 + np.exp(-np.clip(padded[grades] - s, -50, 50)))
        hi, lo = np.where(grades == kinds - 1, 1.0, hi), np.where(grades == 0, 0.0, lo)
        p = np.maximum(hi - lo, 1e-12)
        dhi, dlo = hi * (1 - hi) / p * weight, lo * (1 - lo) / p * weight
        by_s = dhi - dlo  # of the negative log likelihood by s
        by_t = np.bincount(grades, -dhi, minlength=kinds)[:-1] + np.bincount(grades, dlo, minlength=kinds)[1:]
        after = np.cumsum(by_t[::-1])[::-1]
        grad = np.concatenate([np.bincount(flat, by_s[row_of], minlength=len(live)) + l2 * w, after[:1], after[1:] * np.exp(gaps)])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-10)
        w -= move[: len(live)]
        first -= move[len(live)]
        gaps -= move[len(live) + 1 :]
    out = np.zeros(BUCKETS, np.float32)
    out[live] = w
    return Model(out, first + np.concatenate([[0.0], np.cumsum(np.exp(gaps))]))


def train(docs: DataFrame, graded: DataFrame, max_train: int = MAX_TRAIN) -> Model:
    """A model from ``docs(doc_id, text)`` and ``graded(doc_id, grade)``; gathers at most ``max_train`` rows."""
    chosen = (
        graded.where("doc_id is not null and grade is not null")
        .groupBy("doc_id")
        .agg(F.min("grade").cast("int").alias("grade"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_train)  # the documented bound; it also bounds the broadcast
    )

    def run(it):
        cache = WordCache(buckets)
        for batch in it:
            cache.trim()
            found = [np.array([b for f in features(t) for b in cache[f]], "<i4").tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("grade"), pa.array(found, pa.binary())], names=["doc_id", "grade", "found"])

    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "grade", "text")
    # One text an id, that of the smallest hash, so that repeated ids bring no more rows.
    found = rows.mapInArrow(run, "doc_id long, grade int, found binary").groupBy("doc_id", "grade").agg(F.min_by("found", F.xxhash64("found")).alias("found"))
    got = found.orderBy("doc_id").toArrow().to_pandas()
    seen = np.unique(got["grade"].to_numpy(dtype=np.int64)) if len(got) else np.zeros(0, np.int64)
    grades = np.searchsorted(seen, got["grade"].to_numpy(dtype=np.int64)) if len(got) else seen
    model = fit([np.frombuffer(b, "<i4") for b in got["found"]], grades)
    model.lowest = float(seen[0]) if len(seen) else 0.0
    return model


def score(docs: DataFrame, model: Model, keep: list[str], tail: int) -> DataFrame:
    """``keep`` columns of every row with latent, expected_grade and p_tail = P(grade >= ``tail``)."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    names = ["latent", "expected_grade", "p_tail"]
    keep = [c for c in keep if c not in names]  # a result replaces a column of its name
    of = "text" if "text" in keep else "__text"
    source = docs.select(*keep, *([] if of == "text" else [F.col("text").alias(of)]))
    schema = reduce(lambda d, c: d.withColumn(c, F.lit(0.0)), names, docs.select(*keep)).schema

    def run(it):
        model, cache = held.value, held.value.cache()
        for batch in it:
            s = []
            for text in batch.column(of).to_pylist():
                s.append(model.latent(text, cache))
                cache.trim()
            s = np.array(s, dtype=np.float64)
            expected, tails = model.grades(s, tail)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(s), pa.array(expected), pa.array(tails)], names=[*keep, *names])

    return source.mapInArrow(run, schema)
