"""Removal of every byte in a passage of ``length`` bytes that starts anywhere else too.

Suffixes are sampled by content: of any ``window`` neighbouring starts the one whose
next ``core`` bytes hash lowest is an anchor, so equal passages have an anchor at the
same place. Anchors with equal cores form a bucket, and in it the suffixes from the
anchor on, and the reversed prefixes up to it, are put in order by deep-shallow
sorting: multikey quicksort on eight-byte characters down to ``SHALLOW`` bytes, then a
blind trie for groups that agree so far. Common lengths of neighbours in the two orders
give, for each anchor, the longest extents l and r to its left and right that it shares
with a partner, l + r being the passage's length or more. All these stretches hold the
anchor, so their union is one stretch of bytes to remove.

Texts that are equal as a whole are one class, compared once. A bucket of more than
``GIANT`` anchors is not brought together: its extents are found by counting digests of
what surrounds the anchors (``_giants``), by aggregates that combine before the shuffle, and
rows of a large group are joined where they are.

Defined results: a null text counts as empty; texts of fewer than ``length`` bytes stay as
they are; of texts that several rows share, if long enough, nothing stays; rows are
answered each for itself, whatever their ids.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, saved

@dataclass(frozen=True)
class Reach:
    """Lengths in bytes: of a passage that may not occur twice, and of an anchor's core."""

    length: int = 400
    core: int = 200

    @property
    def window(self) -> int:
        return self.length - self.core + 1


#: Depth of quicksort; anchors of a bucket that one task takes (about 700 bytes each); anchors that are compared
#: by pairs rather than by the length to their left.
SHALLOW, GIANT, MATRIX = 64, 16_384, 256
#: Larger groups are broadcast to their rows: at most a HEAVY-th of these.
HEAVY = 4096
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64))


class Roller:
    """Hashes of all ``width``-byte strings of a text, by differences of running sums."""

    def __init__(self):
        self.powers = self.inverses = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        with np.errstate(over="ignore"):
            while len(self.powers) < n:
                for name, base in (("powers", _BASE), ("inverses", pow(_BASE, -1, 1 << 64))):
                    have = getattr(self, name)
                    setattr(self, name, np.concatenate([have, have * np.uint64(pow(base, len(have), 1 << 64))]))

    def __call__(self, raw: bytes, width: int) -> np.ndarray:
        n = len(raw)
        if n < width:
            return np.zeros(0, np.uint64)
        self._grow(n)
        with np.errstate(over="ignore"):
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(_BYTE[np.frombuffer(raw, np.uint8)] * self.powers[:n], out=sums[1:])
            return mix64((sums[width:] - sums[: n - width + 1]) * self.inverses[: n - width + 1])


def anchors(raw: bytes, roll: Roller, reach: Reach = Reach()) -> tuple[np.ndarray, np.ndarray]:
    """Positions and core hashes of the anchors: the leftmost lowest hash of every window."""
    window = reach.window
    h = roll(raw, reach.core)
    n = len(h) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64), h[:0]
    key = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    rows = -(-len(key) // window)
    grid = np.full(rows * window, np.uint64(0xFFFFFFFFFFFFFFFF))
    grid[: len(key)] = key
    grid = grid.reshape(rows, window)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    lowest = np.minimum(behind[:n], ahead[window - 1 : window - 1 + n])
    at = (lowest & np.uint64(0xFFFFFFFF)).astype(np.int64)
    at = at[np.concatenate([[True], at[1:] != at[:-1]])]
    return at, h[at]


def common_length(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    apart = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (apart.bit_length() + 7) // 8


class BlindTrie:
    """Orders strings by a trie that keeps branching bytes only; a string is compared in full with one other."""

    def __init__(self, texts: list[bytes]):
        self.texts, self.root = texts, None

    def add(self, i: int) -> None:
        """A node is [depth, {byte: child}, members]; a leaf has no children. Byte -1: the string ends there."""
        text = self.texts[i]
        if self.root is None:
            self.root = [len(text), {}, [i]]
            return
        node = self.root
        while node[1]:
            at = node[0]
            child = node[1].get(text[at] if at < len(text) else -1)
            node = child if child is not None else next(iter(node[1].values()))
        other = self.texts[node[2][0]]
        depth = common_length(text, other)
        if depth == len(text) == len(other):
            node[2].append(i)
            return
        parent, edge, node = None, None, self.root
        while node[1] and node[0] < depth:
            parent, edge = node, text[node[0]] if node[0] < len(text) else -1
            node = node[1][edge]
        leaf, byte = [len(text), {}, [i]], text[depth] if depth < len(text) else -1
        if node[1] and node[0] == depth:
            node[1][byte] = leaf
            return
        branch = [depth, {other[depth] if depth < len(other) else -1: node, byte: leaf}, []]
        if parent is None:
            self.root = branch
        else:
            parent[1][edge] = branch

    def order(self) -> list[int]:
        out, stack = [], [self.root] if self.root else []
        while stack:
            node = stack.pop()
            out.extend(node[2])
            stack.extend(node[1][b] for b in sorted(node[1], reverse=True))
        return out


def deep_shallow_sort(texts: list[bytes], start: int = 0) -> list[int]:
    """Positions of ``texts`` in ascending order; all agree on their first ``start`` bytes."""
    out, stack = [], [(list(range(len(texts))), start)]
    while stack:
        group, depth = stack.pop()
        if len(group) < 2:
            out.extend(group)
        elif depth >= start + SHALLOW:
            trie = BlindTrie(texts)
            for i in group:
                trie.add(i)
            out.extend(trie.order())
        else:
            key = {i: texts[i][depth : depth + 8] for i in group}
            pivot = key[group[len(group) // 2]]
            less, same, more = [], [], []
            for i in group:
                (same if key[i] == pivot else less if key[i] < pivot else more).append(i)
            stack.append((more, depth))
            if len(pivot) < 8:  # these end here, and so are equal
                stack.append((same[:1], depth))
                stack.extend(([i], depth) for i in same[1:])
            else:
                stack.append((same, depth + 8))
            stack.append((less, depth))
    return out


def extents(lefts: list[bytes], rights: list[bytes], reach: Reach = Reach()) -> list[tuple[int, int]]:
    """(l, r) of each anchor of a bucket; (0, 0) where no passage of the full length is shared.

    ``lefts`` are reversed; both sides may be cut at the reach of a passage that holds the core."""
    m = len(lefts)
    if m == 2:
        l, r = common_length(*lefts), common_length(*rights)
        return [(l, r) if l + r >= reach.length else (0, 0)] * 2
    orders = deep_shallow_sort(lefts), deep_shallow_sort(rights, reach.core)
    ranks, commons = [], []
    for texts, order in zip((lefts, rights), orders):
        rank = np.empty(m, np.int64)
        rank[order] = np.arange(m)
        ranks.append(rank)
        commons.append(np.array([common_length(texts[a], texts[b]) for a, b in zip(order, order[1:])], np.int64))
    if m <= MATRIX:
        shared = []
        for rank, common in zip(ranks, commons):
            grid = np.zeros((m, m), np.int64)
            for i in range(m - 1):
                grid[i, i + 1 :] = np.minimum.accumulate(common[i:])
            grid += grid.T
            shared.append(grid[rank][:, rank])
        good = shared[0] + shared[1] >= reach.length
        np.fill_diagonal(good, False)
        return list(zip(*((s * good).max(axis=1).tolist() for s in shared)))
    best = np.zeros((2, m), np.int64)
    # By the length o left of the anchor: anchors with equal o bytes before and reach.length - o after share a passage.
    for o in range(reach.window):
        left = np.concatenate([[0], np.cumsum(commons[0] < o)])[ranks[0]]
        right = np.concatenate([[0], np.cumsum(commons[1] < reach.length - o)])[ranks[1]]
        _, of, n = np.unique(left * m + right, return_inverse=True, return_counts=True)
        shared = n[of] > 1
        best[0][shared] = np.maximum(best[0][shared], o)
        best[1][shared] = np.maximum(best[1][shared], reach.length - o)
    return list(zip(*best.tolist()))


def _met(rows: DataFrame, groups: DataFrame, on: str, how: str = "inner", n: str = "n") -> DataFrame:
    """``rows`` joined with saved ``groups(on, n, ...)``, a row for the n rows of each group; rows of large groups are not shuffled."""
    heavy = F.col(n) > HEAVY
    if groups.where(heavy).isEmpty():
        return rows.join(groups, on, how)
    hot = F.broadcast(groups.where(heavy))
    cold = rows.join(F.broadcast(groups.where(heavy).select(on)), on, "left_anti")
    return rows.join(hot, on).unionByName(cold.join(groups.where(~heavy), on, how))


def _giants(contexts: DataFrame, reach: Reach) -> DataFrame:
    """Stretches (key, start, end) of ``contexts(key, at, left, right)``, however many of them share a core.

    Of the passages around an anchor that stand anywhere else, only the least and the most bytes left of it
    matter, since all of them hold it. Anchors with equal contexts are of one kind and share all they have. For the
    other kinds these numbers are sought in about sqrt(window) ranges: whoever shares the bytes of all
    passages of a range shares each; where only the bytes common to a range's passages are shared, and
    the range may tell some kind more than it knows, its passages are counted one by one."""
    step = math.isqrt(reach.window - 1) + 1
    size = lambda side: F.lpad(F.length(side).cast("string"), 4, "0").cast("binary")
    held = saved(contexts.select("key", "at", "left", "right", F.unhex(F.md5(F.concat(size("left"), "left", "right"))).alias("kind")))

    def digest(before, after):
        """Of the bytes around an anchor; null where there are fewer."""
        near = F.concat(F.lpad(before.cast("string"), 4, "0").cast("binary"), F.substring("left", F.lit(1), before), F.substring("right", F.lit(1), after))
        return F.when((before <= F.length("left")) & (after <= F.length("right")), F.unhex(F.md5(near)))

    sides = held.groupBy("kind").agg(F.count("*").alias("n"), F.any_value("left").alias("left"), F.any_value("right").alias("right"))
    least = F.greatest(F.lit(0), reach.length - F.length("right"))
    kinds = saved(sides.withColumn("low", F.when(F.col("n") > 1, least)).withColumn("high", F.when(F.col("n") > 1, F.length("left"))).where(least <= F.length("left")))
    lo, hi = F.col("lo"), F.col("hi")
    wide = kinds.select("kind", "left", "right", F.explode(F.sequence(F.lit(0), F.lit(reach.window - 1), F.lit(step))).alias("lo")).withColumn("hi", F.least(lo + step - 1, F.lit(reach.window - 1)))
    ranges = saved(wide.select("kind", "lo", "hi", digest(lo, reach.length - hi).alias("some"), digest(hi, reach.length - lo).alias("whole")).where("some is not null"))
    whole = ranges.where("whole is not null").groupBy("whole").agg(F.count("*").alias("n")).where("n > 1")
    sure = _met(ranges.select("kind", "lo", "hi", "whole"), saved(whole), "whole").groupBy("kind").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    known = saved(kinds.join(sure, "kind", "left").select("kind", "n", F.least("low", "lo").alias("low"), F.greatest("high", "hi").alias("high")))
    open_ = F.col("low").isNull() | (lo < F.col("low")) | (hi > F.col("high"))
    asked = saved(ranges.join(known.select("kind", "low", "high"), "kind").select("kind", "lo", "hi", "some", open_.alias("open")))
    some = asked.groupBy("some").agg(F.count("*").alias("n"), F.max("open").alias("more")).where("n > 1 and more").select("some", "n")
    left = _met(asked.select("kind", "lo", "hi", "some"), saved(some), "some").select("kind", "lo", "hi").join(kinds.select("kind", "left", "right"), "kind")
    o = F.col("o")
    singles = left.select("kind", "left", "right", F.explode(F.sequence("lo", "hi")).alias("o")).select("kind", "o", digest(o, reach.length - o).alias("passage"))
    singles = saved(singles.where("passage is not null"))
    many = saved(singles.groupBy("passage").agg(F.count("*").alias("n")).where("n > 1"))
    found = _met(singles, many, "passage").groupBy("kind").agg(F.min("o").alias("lo"), F.max("o").alias("hi"))
    ends = known.join(found, "kind", "left").select("kind", "n", F.least("low", "lo").alias("low"), F.greatest("high", "hi").alias("high")).where("low is not null")
    return _met(held.select("key", "at", "kind"), saved(ends), "kind").select("key", (F.col("at") - F.col("high")).alias("start"), (F.col("at") - F.col("low") + reach.length).alias("end"))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("raw", F.coalesce(F.col("text"), F.lit("")).cast("binary")).withColumn("key", F.unhex(F.md5("raw")))


def repeated(rows: DataFrame, reach: Reach = Reach()) -> tuple[DataFrame, DataFrame]:
    """Stretches (key, start, end) to remove from texts, and the texts (key, raw) that have any,
    for ``rows(doc_id, key, raw)``; texts that occur as a whole more than once are not told apart."""

    def find(it):
        roll, seen = Roller(), set()  # a copy in the same task adds nothing
        for batch in it:
            keys, firsts, at, cores = [], [], [], []
            for key, raw in zip(batch.column("key").to_pylist(), batch.column("raw").to_pylist()):
                if key in seen:
                    continue
                seen.add(key)
                places, hashes = anchors(raw, roll, reach)
                keys.extend([key] * len(places))
                firsts.append(np.full(len(places), int.from_bytes(key[:8], "little"), np.uint64))
                at.append(places)
                cores.append(hashes)
            at = np.concatenate([np.zeros(0, np.int64), *at])
            mark = mix64(np.concatenate([np.zeros(0, np.uint64), *firsts]) ^ mix64(at.astype(np.uint64)))
            core = np.concatenate([np.zeros(0, np.uint64), *cores])
            yield pa.RecordBatch.from_arrays(
                [pa.array(core.view(np.int64)), pa.array(mark.view(np.int64)), pa.array(keys, pa.binary()), pa.array(at)], names=["core", "mark", "key", "at"]
            )

    long = rows.where(F.length("raw") >= reach.length).select("key", F.coalesce("doc_id", F.lit(-1)).alias("of"), "raw")
    all_ = saved(long.select("key", "raw").mapInArrow(find, "core long, mark long, key binary, at long"))
    # One place of one text has one mark, however many rows hold the text.
    shared = saved(all_.groupBy("core").agg(F.min("mark").alias("low"), F.max("mark").alias("high"), F.count("*").alias("n")).where("low <> high").select("core", "n"))
    places = _met(all_.select("core", "key", "at"), shared, "core").groupBy("key").agg(F.collect_set(F.struct("at", "core", "n")).alias("places"))
    # One row of each text: by key and id, so that the copies of a text don't meet in one task.
    firsts = long.groupBy("key").agg(F.min("of").alias("of"))
    texts = saved(long.join(places.join(firsts, "key"), ["key", "of"]).dropDuplicates(["key"]).select("key", "raw", "places"))

    def cut(it):
        for batch in it:
            out = []
            for key, raw, found in zip(*(batch.column(c).to_pylist() for c in ("key", "raw", "places"))):
                for p in found:
                    at = p["at"]
                    out.append((p["core"], p["n"], key, at, raw[max(0, at - reach.length + reach.core) : at][::-1], raw[at : at + reach.length]))
                    if len(out) >= 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
                        out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    names, types = ["core", "n", "key", "at", "left", "right"], [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.binary()]
    contexts = texts.mapInArrow(cut, "core long, n long, key binary, at long, left binary, right binary")

    def match(it):
        out: list = []

        def bucket():
            for (key, at, *_), (l, r) in zip(held, extents([h[2] for h in held], [h[3] for h in held], reach)):
                if r:
                    out.append((key, at - l, at + r))

        held, of = [], None
        for batch in it:
            for core, *row in zip(*(batch.column(c).to_pylist() for c in ("core", "key", "at", "left", "right"))):
                if core != of:
                    if len(held) > 1:
                        bucket()
                    held, of = [], core
                held.append(row)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.binary(), pa.int64(), pa.int64()))], names=["key", "start", "end"])
                out.clear()
        if len(held) > 1:
            bucket()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.binary(), pa.int64(), pa.int64()))], names=["key", "start", "end"])

    spans = saved(contexts.where(F.col("n") <= GIANT).repartition("core").sortWithinPartitions("core").mapInArrow(match, "key binary, start long, end long"))
    if not shared.where(F.col("n") > GIANT).isEmpty():
        spans = spans.unionByName(saved(_giants(contexts.where(F.col("n") > GIANT), reach)))
    return spans, texts.select("key", "raw")


def _rest(raw: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """What is left of a text, the bytes removed, and the number of maximal removed runs."""
    kept, at, runs = [], 0, 0
    end = None
    for a, b in sorted(spans):
        if end is None or a > end:
            if end is not None:
                at = end
            kept.append(raw[at:a])
            runs += 1
            end = b
        else:
            end = max(end, b)
    if end is not None:
        kept.append(raw[end:])
    rest = b"".join(kept) if runs else raw
    return rest, len(raw) - len(rest), runs


def dedup(docs: DataFrame, reach: Reach = Reach()) -> tuple[DataFrame, DataFrame]:
    """``docs(doc_id, text)`` with raw and key; and (key, rest, n_removed, n_spans, n) of each text that loses
    something and n rows hold, where a null n_removed stands for all of it."""
    rows = _keyed(docs)
    spans, texts = repeated(rows, reach)
    by_text = spans.groupBy("key").agg(F.collect_set(F.struct("start", "end")).alias("spans"))

    def remove(it):
        for batch in it:
            out = [(key, *_rest(raw, [(s["start"], s["end"]) for s in found])) for key, raw, found in zip(*(batch.column(c).to_pylist() for c in ("key", "raw", "spans")))]
            if out:
                types = (pa.binary(), pa.binary(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["key", "rest", "n_removed", "n_spans"])

    rests = saved(texts.join(by_text, "key").mapInArrow(remove, "key binary, rest binary, n_removed long, n_spans long"))
    whole = rows.where(F.length("raw") >= reach.length).groupBy("key").agg(F.count("*").alias("times")).where("times > 1")
    changes = rests.join(whole, "key", "full").select(
        "key",
        F.when(F.col("times").isNull(), F.col("rest")).otherwise(F.lit(b"")).alias("rest"),
        F.when(F.col("times").isNull(), F.col("n_removed")).alias("n_removed"),  # null: all of it
        F.when(F.col("times").isNull(), F.col("n_spans")).otherwise(1).alias("n_spans"),
        F.coalesce("times", F.lit(1)).alias("n"),
    )
    return rows, saved(changes)


def digests(docs: DataFrame, reach: Reach = Reach()) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row of ``docs(doc_id, text)``."""
    rows, changes = dedup(docs.select("doc_id", "text"), reach)
    sizes = rows.select("doc_id", "key", F.length("raw").cast("long").alias("n_bytes"), F.sha2("raw", 256).alias("own"))
    change = changes.select("key", "n", "n_removed", "n_spans", F.sha2("rest", 256).alias("kept"))
    out = _met(sizes, change, "key", "left")
    return out.select(
        "doc_id",
        "n_bytes",
        F.when(F.col("kept").isNull(), 0).otherwise(F.coalesce("n_removed", "n_bytes")).cast("long").alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce("kept", "own").alias("kept_sha256"),
    )


def kept_texts(docs: DataFrame, reach: Reach = Reach()) -> DataFrame:
    """``docs`` with each text cut to what is left; bytes of characters that a cut splits go too. Other
    columns, whatever their names, stay as they are; a null text stays null."""
    of, times = "__knotwork_key", "__knotwork_n"
    rows = docs.withColumn(of, F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))))
    changes = dedup(docs.select("doc_id", "text"), reach)[1]

    def clean(it):
        for batch in it:
            texts = [rest.decode("utf-8", "ignore") for rest in batch.column("rest").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("n"), pa.array(texts, pa.string())], names=[of, times, "__knotwork_rest"])

    rests = saved(changes.select("key", "n", "rest").mapInArrow(clean, f"{of} binary, {times} long, __knotwork_rest string"))
    text = F.when(F.col("text").isNotNull(), F.coalesce("__knotwork_rest", "text")).alias("text")
    return _met(rows, rests, of, "left", times).select(*(text if c == "text" else F.col(f"`{c}`") for c in docs.columns))
