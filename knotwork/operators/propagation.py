"""Label propagation over numbered nodes, in id order, in packed parts.

A part is a range of consecutive nodes with their arcs, about ``ARCS`` of them as far as degrees are even. The state is each
node's label before the sweep and now, packed ``STATE`` nodes a row. A step sets every part beside the state, both read
where they are stored; a task looks up the labels that its arcs lead to and settles its nodes until they agree with each
other, so what is shuffled is a label a node. A sweep ends when a step changes nothing. A node with more than ``hub``
neighbours is a part of its own, whose arcs are counted in pieces. A graph of one part is swept to the end in one task.
"""

from __future__ import annotations

from functools import reduce
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.operators.paths import _batch, _rows
from knotwork.sources.cut import cut

#: Arcs of a part or piece, neighbours of a node that is no hub, nodes of a row of the state.
ARCS, HUB, STATE = 1 << 21, 1 << 18, 1 << 22
_FOUND = "chunk long, way int, at long, piece long, labels binary, counts binary"
_LABELS = "place long, label long"


def _best(key: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, labels): the most frequent label of each node, the smallest of equals, from node * size + label of each arc."""
    key = np.sort(key)
    first = np.flatnonzero(np.diff(key, prepend=-1))
    n = np.diff(first, append=len(key))
    node, label = np.divmod(key[first], size)
    heads = np.flatnonzero(np.diff(node, prepend=-1))
    if not len(heads):
        return node, label
    most = np.maximum.reduceat((n << 32) - np.arange(len(n)), heads)
    return node[heads], label[-most % (1 << 32)]


class _Part:
    """The nodes from ``first`` on with their arcs, in order."""

    def __init__(self, first: int, counts: np.ndarray, near: np.ndarray, size: int):
        self.first, self.size, self.near, self.counts = first, size, near, counts.astype(np.int64)
        self.starts = np.cumsum(self.counts) - self.counts
        self.node = np.repeat(np.arange(len(counts)), self.counts)
        self.before = near < first + self.node  # neighbours whose new label is seen
        self.seen, self.label = np.empty(len(near), np.int64), np.empty(len(counts), np.int64)

    def meet(self, start: int, old: np.ndarray, new: np.ndarray) -> None:
        """Takes in the labels of the nodes from ``start`` on."""
        at = np.flatnonzero((self.near >= start) & (self.near < start + len(new)))
        to = self.near[at] - start
        self.seen[at] = np.where(self.before[at], new[to], old[to])
        low, high = max(start, self.first), min(start + len(new), self.first + len(self.label))
        if low < high:
            self.label[low - self.first : high - self.first] = new[low - start : high - start]

    def _arcs(self, nodes: np.ndarray) -> np.ndarray:
        n = self.counts[nodes]
        return np.arange(n.sum()) + np.repeat(self.starts[nodes] - (np.cumsum(n) - n), n)

    def solved(self) -> np.ndarray:
        """The labels that agree with each other and with those outside."""
        nodes, found = _best(self.node * self.size + self.seen, self.size)
        while True:
            new = self.label[nodes] != found
            nodes, found = nodes[new], found[new]
            if not len(nodes):
                return self.label
            self.label[nodes] = found
            at = self._arcs(nodes)
            later = self.near[at] - self.first
            later = np.unique(later[(later > self.node[at]) & (later < len(self.label))])  # they see what has changed
            at = self._arcs(later)
            inside = at[self.before[at] & (self.near[at] >= self.first)]
            self.seen[inside] = self.label[self.near[inside] - self.first]
            nodes, found = _best(self.node[at] * self.size + self.seen[at], self.size)


def _tables(places: np.ndarray, labels: np.ndarray):
    for at in range(0, len(places), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(places[at : at + (1 << 16)], pa.int64()), pa.array(labels[at : at + (1 << 16)], pa.int64())], names=["place", "label"])


def propagated(edges: DataFrame, size: int, rounds: int, part: int | None = None, hub: int = HUB) -> DataFrame:
    """(place, label) of the nodes 0 to ``size`` - 1 of ``edges(v, w)``; a label is a place. A part has ``part`` nodes."""
    both = edges.select(F.col("v").alias("u"), F.col("w").alias("v")).union(edges.select("w", "v"))
    count, kind = 2 * edges.count(), "i4" if size < 1 << 31 else "i8"
    width = max(1, min(size, part or ARCS * size // max(count, 1)))
    hubs = cut(both.groupBy("u").agg(F.count("*").alias("n")).where(F.col("n") > hub).select("u", F.lit(True).alias("hub")))
    split, chunk = not hubs.isEmpty(), STATE
    both = both.join(F.broadcast(hubs), "u", "left") if split else both.withColumn("hub", F.lit(None).cast("boolean"))  # fewer than arcs / hub rows
    own = F.coalesce("hub", F.lit(False))
    dealt = both.select("u", "v", F.when(own, -1 - F.col("u")).otherwise(F.floor(F.col("u") / width)).alias("part"), F.when(own, F.floor(F.col("v") / ARCS)).otherwise(0).alias("piece"))

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        number, piece = (int(frame[c].iloc[0]) for c in ("part", "piece"))
        first, n = (number * width, min(width, size - number * width)) if number >= 0 else (-1 - number, 1)
        node, near = np.divmod(np.unique((frame["u"].to_numpy() - first) * size + frame["v"].to_numpy()), size)
        return pd.DataFrame({"part": [number], "piece": [piece], "first": [first], "counts": [np.bincount(node, minlength=n).astype("i4").tobytes()], "near": [near.astype(kind).tobytes()]})

    cells = cut(dealt.groupBy("part", "piece").applyInPandas(pack, "part long, piece long, first long, counts binary, near binary"))
    read = lambda row: _Part(row.first, np.frombuffer(row.counts, "i4"), np.frombuffer(row.near, kind).astype(np.int64), size)

    def alone(it):
        for row in _rows(it):
            whole, old = read(row), np.arange(size)
            for _ in range(rounds):
                whole.meet(0, old, old)
                new = whole.solved().copy()
                if (new == old).all():
                    break
                old = new
            yield from _tables(np.arange(size), old)

    if size <= width and not split:
        return cut(cells.mapInArrow(alone, _LABELS))

    def solve(it):
        def settled(cell, number, piece):
            if number < 0:
                labels, n = np.unique(cell.seen, return_counts=True)
                return [(cell.first // chunk, 2, cell.first % chunk, piece, labels.astype(kind).tobytes(), n.astype("i8").tobytes())]
            labels, end = cell.solved().astype(kind), cell.first + len(cell.label)
            cuts = [cell.first, *range((cell.first // chunk + 1) * chunk, end, chunk), end]
            return [(a // chunk, 1, a % chunk, piece, labels[a - cell.first : b - cell.first].tobytes(), None) for a, b in zip(cuts, cuts[1:])]

        now, cell = None, None
        for row in _rows(it):
            if now != (row.part, row.piece):
                if now is not None:
                    yield _batch(settled(cell, *now), _FOUND)
                now, cell = (row.part, row.piece), read(row)
            cell.meet(row.chunk * chunk, np.frombuffer(row.old, kind), np.frombuffer(row.new, kind))
        if now is not None:
            yield _batch(settled(cell, *now), _FOUND)

    def merge(it):
        for number, rows in groupby(_rows(it), lambda row: row.chunk):
            for (way, at), some in groupby(rows, lambda row: (row.way, row.at)):
                if way == 0:
                    row = next(some)
                    old, new = np.frombuffer(row.labels, kind), np.frombuffer(row.counts, kind)
                    found = new.copy()
                elif way == 1:
                    for row in some:
                        labels = np.frombuffer(row.labels, kind)
                        found[at : at + len(labels)] = labels
                else:  # a hub's pieces
                    total: dict[str, np.ndarray] = {}
                    for row in some:
                        labels, n = np.frombuffer(row.labels, kind), np.frombuffer(row.counts, "i8")
                        if total:
                            labels, inverse = np.unique(np.concatenate([total["labels"], labels]), return_inverse=True)
                            n = np.bincount(inverse, np.concatenate([total["n"], n])).astype("i8")
                        total = {"labels": labels, "n": n}
                    found[at] = total["labels"][np.argmax(total["n"])]  # the smallest of equals
            yield _batch([(number, old.tobytes(), found.tobytes(), int((found != new).sum()), int((found != old).sum()))], "chunk long, old binary, new binary, changed long, moved long")

    def begin(it):
        for batch in it:
            for number in batch.column(0).to_pylist():
                places = np.arange(number * chunk, min(size, (number + 1) * chunk), dtype=kind).tobytes()
                yield _batch([(number, places, places)], "chunk long, old binary, new binary")

    def step(state: DataFrame) -> DataFrame:
        found = cells.hint("shuffle_replicate_nl").crossJoin(state.coalesce(1)).mapInArrow(solve, _FOUND)  # parts beside the state's few rows
        known = state.select("chunk", F.lit(0).alias("way"), F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("piece"), F.col("old").alias("labels"), F.col("new").alias("counts"))
        rows = reduce(DataFrame.unionByName, [known, found]).repartition("chunk").sortWithinPartitions("chunk", "way", "at", "piece")
        return cut(rows.mapInArrow(merge, "chunk long, old binary, new binary, changed long, moved long"))

    state = cut(edges.sparkSession.range(-(-size // chunk)).mapInArrow(begin, "chunk long, old binary, new binary"))
    for _ in range(rounds):
        state = state.select("chunk", F.col("new").alias("old"), "new")
        while True:
            after = step(state)
            state = after.select("chunk", "old", "new")
            changed, moved = after.agg(F.sum("changed"), F.sum("moved")).first()
            if not changed:
                break
        if not moved:
            break

    def rows(it):
        for row in _rows(it):
            new = np.frombuffer(row.new, kind)
            yield from _tables(np.arange(len(new)) + row.chunk * chunk, new)

    return state.select("chunk", "new").mapInArrow(rows, _LABELS)
