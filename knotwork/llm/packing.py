"""Packing of documents into sequences of fixed length as a cutting-stock problem.

A document's ids are cut into whole sequences and one remainder. The histogram of
remainder lengths, in bins of ``BIN`` ids (so at most ``capacity / BIN`` bins, whatever
the corpus), is the demand of a cutting-stock program: a pattern is a multiset of lengths that fits a sequence, and
the linear program chooses how often to use each pattern. Columns are generated: dual
prices of the lengths come from the current basis, a knapsack dynamic program finds
the pattern of most worth, and the loop ends when no pattern is worth more than one
sequence, within ``GAP``. Rounded patterns then become slots, and the r-th document
that has a remainder in some bin takes that bin's r-th slot. Only the program rounds
lengths up to their bin; within a sequence the pieces stand without gaps.

Defined results: a null text counts as empty and still gets its end id; repeated rows
are separate documents; an empty table gives no piece. All but a few sequences of the
rounding's rest are full or nearly so.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batches, crc_of, saved
from .tokens import Encoder

CAPACITY = 1024
#: Ids a bin is wide; the program stops within this share of its lower bound, or after so many columns.
BIN, GAP, MAX_COLUMNS = 4, 2e-3, 1500

_PIECES = pa.schema(
    [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("part", pa.int32()), ("bin", pa.int32()), ("rank", pa.int64())]
)


def knapsack(worth: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The multiset of ``lengths`` (ascending) of most ``worth`` that fits ``capacity``, by dynamic programming."""
    best, chosen = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fits = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        if n := fits[c]:
            value = best[c - lengths[:n]] + worth[:n]
            top = int(value.argmax())
            if value[top] > best[c - 1] + 1e-15:
                best[c], chosen[c] = value[top], top
                continue
        best[c] = best[c - 1]
    copies, c = np.zeros(len(lengths)), capacity
    while c > 0:
        if chosen[c] < 0:
            c -= 1
        else:
            copies[chosen[c]] += 1
            c -= lengths[chosen[c]]
    return float(best[capacity]), copies


def solve(lengths: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, float]]:
    """Patterns and how often the linear program uses each (a fraction)."""
    m = len(lengths)
    basis, x = _start(lengths, demand, capacity)
    inverse = _inverse(basis.T)
    for _ in range(MAX_COLUMNS):
        prices = np.maximum(inverse.sum(axis=0), 0)
        value, column = knapsack(prices, lengths, capacity)
        if value <= 1 + 1e-9 or x.sum() <= (demand @ prices) / value * (1 + GAP):
            break
        u = np.einsum("ij,j->i", inverse, column)  # no threads of linear algebra beside Spark's
        rise = u > 1e-9
        if not rise.any():
            break
        ratio = np.full(m, np.inf)
        ratio[rise] = x[rise] / u[rise]
        out = int(ratio.argmin())
        step = ratio[out]
        x -= step * u
        x[out] = step
        np.maximum(x, 0, out=x)
        basis[out] = column
        row = inverse[out] / u[out]
        inverse -= np.outer(u, row)
        inverse[out] = row
    return [(p, float(v)) for p, v in zip(basis, x) if v > 1e-9]


def _inverse(upper: np.ndarray) -> np.ndarray:
    """Of an upper triangular matrix, from its last row up."""
    out = np.zeros_like(upper)
    for i in reversed(range(len(upper))):
        out[i] = -np.einsum("j,jk->k", upper[i, i + 1 :], out[i + 1 :])
        out[i, i] += 1
        out[i] /= upper[i, i]
    return out


def _start(lengths: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """A first basis (a pattern a row) and its use: longest first, the room filled by shorter lengths in demand.

    Pattern i holds length i and shorter ones only, so the matrix is triangular and has an inverse."""
    m, left = len(lengths), demand.astype(float).copy()
    basis, x = np.zeros((m, m)), np.zeros(m)
    for i in reversed(range(m)):
        copies = capacity // int(lengths[i])
        basis[i, i], room = copies, capacity - copies * int(lengths[i])
        x[i] = left[i] / copies
        left[i] = 0
        for j in reversed(range(int(np.searchsorted(lengths[:i], room, side="right")))) if x[i] > 0 else ():
            if (fit := min(room // int(lengths[j]), int(left[j] / x[i]))) > 0:
                basis[i, j], room = fit, room - fit * int(lengths[j])
                left[j] -= fit * x[i]
                if room < lengths[0]:
                    break
    return basis, x


def plan(lengths: np.ndarray, demand: np.ndarray, capacity: int = CAPACITY) -> list[tuple[np.ndarray, int]]:
    """Whole patterns (copies of each length, times used) that meet the demand exactly."""
    left, out = demand.astype(np.int64).copy(), []

    def use(pattern: np.ndarray, times: int) -> None:
        nonlocal left
        need = pattern > 0
        times = min(times, int((left[need] // pattern[need]).min()) if need.any() else 0)
        if times > 0:
            out.append((pattern, times))
            left = left - times * pattern

    found = [(p.astype(np.int64), x) for p, x in solve(lengths, demand.astype(float), capacity)] if len(lengths) else []
    for pattern, x in found:
        use(pattern, int(x + 1e-9))
    for pattern, _ in sorted(found, key=lambda f: -(f[1] % 1)):
        use(pattern, 1)
    while left.any():  # the rounding's rest: at most a few items of each length
        pattern, room = np.zeros(len(lengths), np.int64), capacity
        first = int(np.flatnonzero(left)[-1])
        pattern[first], room = 1, room - int(lengths[first])
        _fill(pattern, left, lengths, room)
        use(pattern, int(left.max()))
    return out


def _fill(pattern: np.ndarray, left: np.ndarray, lengths: np.ndarray, room: int) -> None:
    """Adds the items left that fill ``room`` best: bounded subset sums as bits of an integer."""
    reach, steps = 1, []
    for i in np.flatnonzero(left):
        size, copies = int(lengths[i]), min(int(left[i] - pattern[i]), room // int(lengths[i]), 3)
        for _ in range(copies):
            grown = (reach | reach << size) & ((1 << (room + 1)) - 1)
            if grown == reach:
                break
            steps.append((i, size, reach))
            reach = grown
        if reach >> room & 1:
            break
    at = reach.bit_length() - 1
    for i, size, before in reversed(steps):
        if not before >> at & 1:
            pattern[i] += 1
            at -= size


def cut(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of every document with their crc32, and ranks within the task: of whole pieces, and of
    remainders among those of their bin. The ids themselves are not kept."""

    def run(it):
        encoder, part = Encoder(tokenizer), TaskContext.get().partitionId()
        ranks, end = [0] * (capacity + 1), np.array([end_id], "<u4")

        def rows():
            for batch in it:
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                    ids = np.concatenate([encoder.ids(text), end])
                    for at in range(0, len(ids), capacity):
                        piece = ids[at : at + capacity]
                        kind = -(-len(piece) // BIN) if len(piece) < capacity else 0  # 0: whole pieces
                        yield doc_id, at, len(piece), crc_of(piece), len(ids), part, kind, ranks[kind]
                        ranks[kind] += 1

        return batches(rows(), _PIECES)

    return saved(docs.select("doc_id", "text").mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, bin int, rank long"))


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Gives every piece of ``cut`` its sequence_id and offset."""
    counts = pieces.groupBy("part", "bin").agg(F.count("*").alias("n"))
    # Rows of counts: tasks times bins; each window below holds a row a task.
    earlier = Window.partitionBy("bin").orderBy("part")
    offsets = counts.select("part", "bin", (F.sum("n").over(earlier) - F.col("n")).alias("earlier"))
    histogram = counts.groupBy("bin").agg(F.sum("n").alias("n")).toArrow().to_pandas().sort_values("bin")  # a row a bin
    rest = histogram[histogram["bin"] > 0]
    bins = rest["bin"].to_numpy(np.int64)
    slots, first, rank = [], 0, dict.fromkeys(bins.tolist(), 0)
    for pattern, times in plan(bins, rest["n"].to_numpy(np.int64), capacity // BIN):
        place = 0
        for i in np.flatnonzero(pattern).tolist():
            size, copies = int(bins[i]), int(pattern[i])
            slots.append((size, rank[size], copies, first, place))
            rank[size] += copies * times
            place += copies
        first += times
    slots.append((0, 0, 1, first, 0))  # whole pieces follow, each a sequence of its own
    slots = pd.DataFrame(slots, columns=["bin", "rank", "copies", "first", "place"]).sort_values(["bin", "rank"])
    held = pieces.sparkSession.sparkContext.broadcast({c: slots[c].to_numpy(np.int64) for c in slots})

    def run(it):
        s = held.value
        keys = s["bin"] << 48 | s["rank"]
        for batch in it:
            kind, rank = batch.column("bin").to_numpy().astype(np.int64), batch.column("global_rank").to_numpy()
            at = np.searchsorted(keys, kind << 48 | rank, side="right") - 1
            inside = rank - s["rank"][at]
            sequence, place = s["first"][at] + inside // s["copies"][at], s["place"][at] + inside % s["copies"][at]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(place)], names=[*names, "sequence_id", "place"])

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    ranked = pieces.join(offsets, ["part", "bin"]).select(*names, "bin", (F.col("rank") + F.col("earlier")).alias("global_rank"))
    placed = ranked.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, place long")
    # A sequence holds capacity pieces at most, so these windows are bounded.
    before = Window.partitionBy("sequence_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select(*names, "sequence_id", F.coalesce(F.sum("length").over(before), F.lit(0)).alias("offset"))
