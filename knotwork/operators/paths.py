"""Shortest paths from many pivots at once: Brandes' dependencies, a level at a time, in packed blocks.

Nodes are numbered and cut into parts of ``PART``, pivots into groups of ``GROUP``. A level is a table of cells: what the
nodes of a part hold for the pivots of a group, as a packed matrix of those that are not 0. Arcs are packed too, by the
part that they leave and the block of nodes that they enter. A step sets each cell beside the arcs that leave its part,
both read where they are stored; a task adds its cell up along its arcs and hands on one matrix, so what is shuffled
grows with parts, nodes and pivots and not with arcs. A task holds some matrices of ``PART`` x ``GROUP`` doubles and
about ``ARCS`` arcs, whatever the graph. Sums are made in a fixed order.

Where a graph is one part and has up to ``WHOLE`` arcs, a task holds them all and follows its own pivots to the end, so
nothing but the sums is shuffled (``Blocks.whole``).
"""

from __future__ import annotations

from functools import reduce
from itertools import groupby
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.sources.cut import cut

#: Nodes of a part, pivots of a group, and arcs of a block as far as degrees are even.
PART, GROUP, ARCS = 1 << 20, 8, 1 << 21
_STEP = 1 << 14  # arcs summed at once
#: Arcs that a task may hold, pivots it follows at once, and pivots of a task.
WHOLE, ABREAST, MOST = 1 << 25, 16, 1024
_SLOTS = 256  # neighbours of a node that are added slot by slot
_PACKED = ["bits", "at", "code", "held"]
_KNOWN, _SENT = 0, 1
_CELL = "part int, grp int, way int, origin long, first long, bits boolean, at binary, code string, held binary"


def _pack(matrix: np.ndarray) -> tuple[bool, bytes, str, bytes]:
    """Where a matrix is not 0, as bits or as places, and what stands there, in the smallest type that holds it."""
    flat = matrix.ravel()
    where = np.flatnonzero(flat)
    values = flat[where]
    code = "f8"
    if len(values) and values.max() < 1 << 32 and (values == np.floor(values)).all():
        code = next(c for c in ("u1", "u2", "u4") if values.max() <= np.iinfo(c).max)
    bits = 32 * len(where) > len(flat)
    return bits, (np.packbits(flat != 0) if bits else where.astype("u4")).tobytes(), code, values.astype(code).tobytes()


def _unpack(row) -> tuple[np.ndarray, np.ndarray]:
    """(places, values) of a packed matrix."""
    at = np.frombuffer(row.at, "u1" if row.bits else "u4")
    return (np.flatnonzero(np.unpackbits(at)) if row.bits else at.astype(np.int64)), np.frombuffer(row.held, row.code).astype(np.float64)


def _rows(it):
    for batch in it:
        for n in range(batch.num_rows):
            yield SimpleNamespace(**{c: v[n].as_buffer() if pa.types.is_binary(v.type) and v[n].is_valid else v[n].as_py() for c, v in zip(batch.schema.names, batch.columns)})


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary(), "string": pa.string()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[kind]) for c, (_, kind) in zip(zip(*rows), fields)], names=[name for name, _ in fields])


class _Sums:
    """Sums over neighbours. Nodes are put in order of degree, the highest first, so the k-th neighbours of all that have
    so many are added at once; what a node has beyond ``_SLOTS`` is added node by node."""

    def __init__(self, v: np.ndarray, w: np.ndarray, size: int):
        """Arcs from ``v`` to ``w``, in both directions and in order of w."""
        self.size, degree = size, np.bincount(w, minlength=size)
        self.order = np.argsort(-degree, kind="stable")
        self.rank = np.empty(size, np.int64)
        self.rank[self.order] = np.arange(size)
        self.starts, self.degree = (np.cumsum(degree) - degree)[self.order], degree[self.order]
        self.near = self.rank[v].astype(np.int32)
        least = -self.degree  # ascends
        self.slots = [self.near[self.starts[: np.searchsorted(least, -k, side="left")] + k] for k in range(min(_SLOTS, int(self.degree.max(initial=0))))]
        self.more = np.arange(np.searchsorted(least, -_SLOTS, side="left"))

    def of(self, x: np.ndarray) -> np.ndarray:
        some = np.flatnonzero(x.any(axis=1))
        count = int(self.degree[some].sum())
        out = np.zeros_like(x)
        if 16 * count < len(self.near):  # few nodes send
            ends = np.cumsum(self.degree[some])
            at = np.arange(count) + np.repeat(self.starts[some] - (ends - self.degree[some]), self.degree[some])
            to, rows = self.near[at], np.repeat(some, self.degree[some])
            turn = np.argsort(to, kind="stable")
            to, rows = to[turn], rows[turn]
            for at in range(0, count, _STEP):
                end = to[at : at + _STEP]
                first = np.flatnonzero(np.diff(end, prepend=-1))
                out[end[first]] += np.add.reduceat(x[rows[at : at + _STEP]], first, axis=0)
            return out
        for near in self.slots:
            for at in range(0, len(near), _STEP):
                out[at : min(at + _STEP, len(near))] += x[near[at : at + _STEP]]
        for node in self.more:
            for at in range(self.starts[node] + _SLOTS, self.starts[node] + self.degree[node], _STEP):
                out[node] += x[self.near[at : min(at + _STEP, self.starts[node] + self.degree[node])]].sum(axis=0)
        return out

    def dependencies(self, pivots: np.ndarray) -> np.ndarray:
        """Each node's dependencies summed over ``pivots``, without its own."""
        g = np.arange(len(pivots))
        now = np.zeros((self.size, len(pivots)))
        now[self.rank[pivots], g] = 1.0
        depth, paths, d = np.where(now > 0, 0, -1).astype(np.int32), now.copy(), 0
        while (depth < 0).any():
            now = self.of(now)
            now[depth >= 0] = 0.0
            if not now.any():
                break
            d += 1
            depth[now > 0] = d
            paths += now
        total = np.zeros_like(paths)
        for level in range(d, 1, -1):
            share = self.of(np.divide(1.0 + total, paths, out=np.zeros_like(paths), where=depth == level))
            np.multiply(paths, share, out=total, where=depth == level - 1)
        return total.sum(axis=1)[self.rank]


class Blocks:
    """The arcs of ``both(v, w)``, places of nodes from 0 to ``size`` - 1, every edge in both directions."""

    def __init__(self, both: DataFrame, size: int, part: int = PART, arcs: int = ARCS):
        self.part = min(part, max(size, 1))
        self.parts = -(-size // self.part)
        count, width = both.count(), self.part
        while width > 1 and count * width > arcs * size * self.parts:
            width = -(-width // 2)
        self.per = -(-self.part // width)  # blocks of a part; the last may be shorter
        self.width = width
        self.fits = self.parts == 1 and count <= WHOLE
        inside = F.pmod("w", F.lit(self.part))
        dealt = both.select(
            F.floor(F.col("v") / self.part).cast("int").alias("part"), (F.floor(F.col("w") / self.part) * self.per + F.floor(inside / width)).cast("long").alias("block"),
            F.pmod("v", F.lit(self.part)).cast("int").alias("v"), F.pmod(inside, F.lit(width)).cast("int").alias("w"),
        )

        def pack(frame: pd.DataFrame) -> pd.DataFrame:
            frame = frame.sort_values(["w", "v"])
            return pd.DataFrame({"part": frame["part"].iloc[:1], "block": frame["block"].iloc[:1], "begins": [frame["v"].to_numpy(np.int32).tobytes()], "ends": [frame["w"].to_numpy(np.int32).tobytes()]})

        packed = cut(dealt.groupBy("part", "block").applyInPandas(pack, "part int, block long, begins binary, ends binary"))
        self.arcs = [packed.where(F.col("part") == p).drop("part") for p in range(self.parts)]

    def sent(self, cells: DataFrame) -> DataFrame:
        """What each node gets from its neighbours' ``cells``: a row a cell and block of arcs."""
        part, per, width = self.part, self.per, self.width

        def push(it):
            now = None
            for row in _rows(it):
                if now != (row.part, row.grp):
                    now, matrix = (row.part, row.grp), np.zeros((part, GROUP))
                    where, values = _unpack(row)
                    matrix.ravel()[where] = values
                    active = np.zeros(part, bool)
                    active[where // GROUP] = True
                v, w = np.frombuffer(row.begins, np.int32), np.frombuffer(row.ends, np.int32)
                some = active[v]
                v, w = v[some], w[some]
                if len(v):
                    total = np.zeros((width, GROUP))
                    for at in range(0, len(v), _STEP):
                        end = w[at : at + _STEP]
                        starts = np.flatnonzero(np.diff(end, prepend=-1))
                        total[end[starts]] += np.add.reduceat(matrix[v[at : at + _STEP]], starts, axis=0)
                    yield _batch([(row.block // per, row.grp, _SENT, row.part, row.block % per * width, *_pack(total))], _CELL)

        rows = cells.select("part", "grp", *_PACKED)
        beside = [rows.where(F.col("part") == p).hint("shuffle_replicate_nl").crossJoin(arcs) for p, arcs in enumerate(self.arcs)]
        return reduce(DataFrame.unionByName, [b.mapInArrow(push, _CELL) for b in beside])

    def _merged(self, rows: DataFrame, merge, schema: str) -> DataFrame:
        """``merge(known, total)`` of each cell: the places and values of its known rows, and the sum of those sent."""
        part = self.part

        def run(it):
            for (p, g), cell in groupby(_rows(it), lambda row: (row.part, row.grp)):
                known, total = [], np.zeros((part, GROUP))
                for row in cell:
                    where, values = _unpack(row)
                    if row.way == _KNOWN:
                        known.append((where, values))
                    else:
                        total.ravel()[row.first * GROUP + where] += values
                found = merge(known, total)
                if found is not None:
                    yield _batch([(p, g, _KNOWN, None, None, *found)], schema)

        return cut(rows.repartition("part", "grp").sortWithinPartitions("part", "grp", "way", "origin", "first").mapInArrow(run, schema))

    def start(self, pivots: DataFrame) -> DataFrame:
        """Level 0 of ``pivots(place, number)``: one path from each to itself."""
        part = self.part

        def pack(frame: pd.DataFrame) -> pd.DataFrame:
            matrix = np.zeros((part, GROUP))
            matrix[frame["place"] % part, frame["number"] % GROUP] = 1.0
            p, g = frame[["part", "grp"]].iloc[0]
            return pd.DataFrame([(p, g, _KNOWN, None, None, *_pack(matrix))], columns=[f.split()[0] for f in _CELL.split(", ")])

        rows = pivots.select("place", "number", F.floor(F.col("place") / part).cast("int").alias("part"), F.floor(F.col("number") / GROUP).cast("int").alias("grp"))
        return cut(rows.groupBy("part", "grp").applyInPandas(pack, _CELL))

    def grown(self, levels: list[DataFrame]) -> DataFrame:
        """The next level: how many shortest paths lead to nodes that no level has yet."""

        def merge(known, total):
            for where, _ in known:
                total.ravel()[where] = 0.0
            return _pack(total) if total.any() else None

        # Neighbours of a level lie in it, or in the one before or after it.
        return self._merged(reduce(DataFrame.unionByName, [self.sent(levels[-1]), *levels[-2:]]), merge, _CELL)

    def settled(self, level: DataFrame, below: DataFrame | None) -> DataFrame:
        """A level's cells with (1 + dependency) / paths, and the dependencies summed over each group's pivots."""

        def merge(known, total):
            if not known:
                return None
            (where, paths), dep = known[0], np.zeros_like(total)
            dep.ravel()[where] = paths * total.ravel()[where]
            total[:] = 0.0
            total.ravel()[where] = (1 + dep.ravel()[where]) / paths
            return *_pack(total), *_pack(dep.sum(axis=1))

        rows = level if below is None else level.unionByName(self.sent(below))
        return self._merged(rows, merge, f"{_CELL}, dep_bits boolean, dep_at binary, dep_code string, dep_held binary")

    def whole(self, pivots: DataFrame) -> DataFrame:
        """``dependencies`` of a graph that fits a task, for any ``pivots(place, number)`` in one job."""
        width, size, count = self.width, self.part, pivots.count()
        each = min(max(-(-count // 64), ABREAST), MOST)
        tasks, piece = max(1, -(-count // each)), 1 << 16
        dealt = pivots.groupBy(F.pmod("number", F.lit(tasks)).cast("int").alias("slice")).agg(F.sort_array(F.collect_list("place")).alias("places"))  # about MOST

        def follow(it):
            now, places, arcs = None, None, {}

            def sums():
                found = [arcs[b] for b in sorted(arcs)]
                graph, total = _Sums(np.concatenate([v for v, _ in found]), np.concatenate([w for _, w in found]), size), np.zeros(size)
                for at in range(0, len(places), ABREAST):
                    total += graph.dependencies(places[at : at + ABREAST])
                for at in range(0, size, piece):
                    yield _batch([(now, at, total[at : at + piece].tobytes())], "slice int, first long, held binary")

            for row in _rows(it):
                if now != row.slice:
                    if now is not None:
                        yield from sums()
                    now, places, arcs = row.slice, np.array(row.places, np.int64), {}
                arcs[row.block] = np.frombuffer(row.begins, np.int32).copy(), np.frombuffer(row.ends, np.int32).astype(np.int64) + row.block * width
            if now is not None:
                yield from sums()

        def add(it):
            for first, rows in groupby(_rows(it), lambda row: row.first):
                total = reduce(np.add, (np.frombuffer(row.held) for row in rows))
                some = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(some + first), pa.array(total[some])], names=["place", "part"])

        both = dealt.repartitionByRange(tasks, "slice").hint("shuffle_replicate_nl").crossJoin(self.arcs[0].coalesce(1))  # a row a task beside all arcs
        found = both.mapInArrow(follow, "slice int, first long, held binary")
        return cut(found.repartition("first").sortWithinPartitions("first", "slice").mapInArrow(add, "place long, part double"))

    def dependencies(self, pivots: DataFrame) -> DataFrame:
        """(place, part): each node's dependencies summed over ``pivots(place, number)``, without its own."""
        part, levels = self.part, [self.start(pivots)]
        while not levels[-1].isEmpty():
            levels.append(self.grown(levels))
        done: list[DataFrame] = []
        for level in reversed(levels[1:-1]):
            done.append(self.settled(level, done[-1] if done else None))
        if not done:
            return pivots.select("place", F.lit(0.0).alias("part")).limit(0)

        def add(it):
            for p, rows in groupby(_rows(it), lambda row: row.part):
                total = np.zeros(part)
                for row in rows:
                    where, values = _unpack(row)
                    total[where] += values
                where = np.flatnonzero(total)
                for at in range(0, len(where), 1 << 16):
                    some = where[at : at + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(some + p * part), pa.array(total[some])], names=["place", "part"])

        sums = [d.select("part", "grp", F.lit(i).alias("level"), *[F.col(f"dep_{c}").alias(c) for c in _PACKED]) for i, d in enumerate(done)]
        rows = reduce(DataFrame.unionByName, sums).repartition("part").sortWithinPartitions("part", "level", "grp")
        return cut(rows.mapInArrow(add, "place long, part double"))
