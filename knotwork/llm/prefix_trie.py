"""The prefix trie of conversations, from polynomial prefix fingerprints.

Turns are sorted by range of (conv_id, turn), so a conversation of any length spreads
over tasks. Each task scans its part with numpy: positions, and for each prefix the sum
of hash(turn i) * base^i modulo two primes. A part that begins inside a conversation is
corrected by what the parts before it hold of it, a row a part. Prefixes of equal depth
and fingerprint are candidates for one node. Equal last turns of a group are counted as
one content, and every content is compared with that of the group's representative,
its smallest conversation. Where all groups agree at every depth, so do their whole
prefixes: equal fingerprints with equal last turns have equal fingerprints one turn
before. Where a group's contents differ, they are numbered, and a conversation's
numbers other than the representative's become part of its later nodes' keys.

Nodes are rolled up to all ancestors by doubling: after round k a node holds the sums of
its descendants less than 2^k below, and knows its ancestor 2^k above. Only nodes of two
or more conversations take part; what hangs below them is a leaf each.

Defined results: rows with a null conv_id belong to no conversation; turns are ordered by
turn (null first), then role, then text; null roles and texts are empty; repeated rows
are turns of their own; no conversation gives no node; a conversation without turns
ends at the root; other columns are not looked at. The rows of one (conv_id, turn)
stay in one task, and a node's digest is sequential: one task hashes it, from rows of
CHUNK ids each.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

#: Primes below 2^31 and bases of the two fingerprints.
PRIMES, BASES = (2147483647, 2147483629), (911382323, 972663749)
#: Conversation ids in a row that a digest is made from.
CHUNK = 8192
WORDS = r"size(filter(split(text, '[\\x20\\x09-\\x0D]+'), x -> x <> ''))"


def scanned(turns: DataFrame, primes: tuple[int, int] = PRIMES) -> DataFrame:
    """``conv_id, depth, fp, parent_fp, role, text`` of ``turns(conv_id, turn, role, text)``: each turn's position from 1
    on, and the fingerprints of the prefix that ends with it and of the one before. Written to the shared folder."""
    rows = turns.where("conv_id is not null").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    hashed = rows.withColumn("h", F.xxhash64("role", "text"))
    ordered = hashed.repartitionByRange("conv_id", "turn").sortWithinPartitions("conv_id", "turn", "role", "text")
    numbers = ["r", *(f"{name}{i}" for name in "fg" for i in (0, 1))]

    def run(it):
        part, last, count, sums = TaskContext.get().partitionId(), None, 0, [0, 0]
        powers = [np.ones(1, np.uint64) for _ in primes]
        for batch in it:
            n = batch.num_rows
            if not n:
                continue
            conv = batch.column("conv_id").to_numpy()
            h = batch.column("h").to_numpy().view(np.uint64)
            starts = np.flatnonzero(np.concatenate([[True], conv[1:] != conv[:-1]]))
            lengths = np.diff(np.append(starts, n))
            goes_on = last is not None and conv[0] == last
            r = np.arange(n) - np.repeat(starts, lengths) + np.repeat(np.where(np.arange(len(starts)) == 0, count if goes_on else 0, 0), lengths)  # from 0 on
            columns = [r + 1]
            ends = []
            for i, p in enumerate(primes):
                while len(powers[i]) <= r.max():
                    factor = powers[i][-1] * np.uint64(BASES[i] % p) % np.uint64(p)
                    powers[i] = np.concatenate([powers[i], powers[i] * factor % np.uint64(p)])
                each = (h >> np.uint64(32 * i) & np.uint64(0xFFFFFFFF)) % np.uint64(p) * powers[i][r] % np.uint64(p)
                total = np.cumsum(each)
                before = np.repeat(np.where(starts > 0, total[starts - 1], 0).astype(np.uint64), lengths)
                held = np.repeat(np.where(np.arange(len(starts)) == 0, sums[i] if goes_on else 0, 0).astype(np.uint64), lengths)
                after = (total - before + held) % np.uint64(p)
                prior = (total - each - before + held) % np.uint64(p)
                columns += [after, prior]
                ends.append(int(after[-1]))
            last, count, sums = conv[-1], int(r[-1]) + 1, ends
            arrays = [pa.array(c.astype(np.int64)) for c in (columns[0], columns[1], columns[3], columns[2], columns[4])]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("role"), batch.column("text"), pa.array(np.full(n, part, np.int32)), *arrays], names=["conv_id", "role", "text", "part", *numbers])

    kind = dict(rows.dtypes)["conv_id"]
    local = saved(ordered.mapInArrow(run, f"conv_id {kind}, role string, text string, part int, {', '.join(f'{c} long' for c in numbers)}"))
    last = F.struct("conv_id", "r")
    parts = local.groupBy("part").agg(F.min("conv_id").alias("first"), F.max("conv_id").alias("last"), *(F.max_by(c, last).alias(c) for c in ("r", "f0", "f1"))).orderBy("part").collect()  # a row a part
    carried, state = [], (None, 0, [0, 0])
    for row in parts:
        conv, n, sums = state
        factors = [1, 1]
        if conv is not None and row["first"] == conv:
            factors = [pow(b, n, p) for b, p in zip(BASES, primes)]
            carried.append((row["part"], conv, n, *factors, *sums))
        if row["last"] != conv:
            state = (row["last"], row["r"], [row["f0"], row["f1"]])
        else:
            state = (conv, n + row["r"], [(s + m * row[f]) % p for s, m, f, p in zip(sums, factors, ("f0", "f1"), primes)])
    carry = turns.sparkSession.createDataFrame(carried, f"part int, conv_id {kind}, n long, m0 long, m1 long, c0 long, c1 long")
    out = local.join(F.broadcast(carry), ["part", "conv_id"], "left")  # a row a part at most

    def packed(name: str):
        return F.expr(
            f"shiftleft((coalesce(c0, 0) + coalesce(m0, 1) * {name}0) % {primes[0]}, 31) + (coalesce(c1, 0) + coalesce(m1, 1) * {name}1) % {primes[1]}"
        )

    return out.select("conv_id", F.expr("r + coalesce(n, 0)").alias("depth"), packed("f").alias("fp"), packed("g").alias("parent_fp"), "role", "text")


def _split(turns: DataFrame, groups: DataFrame) -> DataFrame:
    """``turns`` with the paths that tell prefixes of the colliding ``groups(depth, fp)`` apart."""
    rows = turns.join(groups, ["depth", "fp"])
    contents = rows.groupBy("depth", "fp", "role", "text").agg(F.min("conv_id").alias("least"))
    number = F.row_number().over(Window.partitionBy("depth", "fp").orderBy("least", "role", "text")) - 1  # 0: as the representative's
    marks = saved(rows.join(contents.withColumn("s", number), ["depth", "fp", "role", "text"]).where("s > 0").select("conv_id", "depth", "s"))
    mine = turns.select("conv_id", "depth").join(marks.select("conv_id").distinct(), "conv_id", "left_semi").join(marks, ["conv_id", "depth"], "left")
    window = Window.partitionBy("conv_id").orderBy("depth")  # conversations with a collision only
    mark = F.when(F.col("s").isNotNull(), F.concat_ws(":", F.col("depth").cast("string"), F.col("s").cast("string")))
    paths = mine.withColumn("path", F.concat_ws(",", F.collect_list(mark).over(window)))
    paths = paths.select("conv_id", "depth", "path", F.lag("path", 1, "").over(window).alias("parent_path"))
    found = turns.drop("path", "parent_path").join(paths, ["conv_id", "depth"], "left")
    return saved(found.withColumns({c: F.coalesce(c, F.lit("")) for c in ("path", "parent_path")}))


def _nodes(turns: DataFrame) -> DataFrame:
    """Contents of the groups: one row each, and more for a group whose contents differ."""
    keys = ["depth", "fp", "path", "parent_fp", "parent_path", "role", "text"]  # the parents' follow from the others
    made = turns.groupBy(*keys).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n"))
    return saved(made.select("depth", "fp", "path", "conv_id", "n", "parent_fp", "parent_path", F.expr(WORDS).cast("long").alias("words")))


def trie(turns: DataFrame, conversations: DataFrame | None = None, primes: tuple[int, int] = PRIMES) -> DataFrame:
    """A row for each distinct prefix of ``turns(conv_id, turn, role, text)``; ``conversations(conv_id)``, distinct,
    names those without turns too."""
    spark = turns.sparkSession
    prefixes = scanned(turns, primes).withColumns({"path": F.lit(""), "parent_path": F.lit("")})
    nodes = _nodes(prefixes)
    collided = nodes.groupBy("depth", "fp").agg(F.count("*").alias("contents")).where("contents > 1").select("depth", "fp")
    if not collided.isEmpty():
        prefixes = _split(prefixes, collided)
        nodes = _nodes(prefixes)
    last = prefixes.groupBy("conv_id").agg(F.max_by(F.struct("fp", "path"), "depth").alias("end"), F.max("depth").alias("depth"))
    last = last.select("conv_id", "depth", "end.fp", "end.path")
    if conversations is not None:
        none = conversations.join(last, "conv_id", "left_anti").select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("fp"), F.lit("").alias("path"))
        last = last.unionByName(none)
    last = saved(last)
    least, n = last.agg(F.min("conv_id"), F.count("*")).first()
    kind = dict(last.dtypes)["conv_id"]
    root = spark.createDataFrame([(0, 0, "", least, n, None, None, 0)] if n else [], f"depth long, fp long, path string, conv_id {kind}, n long, parent_fp long, parent_path string, words long")
    nodes = nodes.unionByName(root)
    # From here on a node is named by its smallest conversation and its depth.
    key = ["depth", "fp", "path"]
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("fp").alias("parent_fp"), F.col("path").alias("parent_path"), F.col("conv_id").alias("parent_conv_id"))
    tree = saved(nodes.join(above, ["depth", "parent_fp", "parent_path"], "left").select(*key, "conv_id", "parent_conv_id", "n", "words"))
    ends = _digests(last.join(tree.select(*key, F.col("conv_id").alias("node")), key).select("node", "depth", "conv_id"))
    below = tree.where("depth > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("children"), F.sum((F.col("n") == 1).cast("long")).alias("single"))
    out = tree.join(below, ["conv_id", "depth"], "left").join(_rolled_up(tree, below), ["conv_id", "depth"], "left").join(ends.withColumnRenamed("node", "conv_id"), ["conv_id", "depth"], "left")
    zero = F.lit(0).cast("long")
    return out.select(
        "conv_id",
        "depth",
        "parent_conv_id",
        F.col("n").alias("n_convs"),
        F.coalesce("children", zero).alias("n_children"),
        F.coalesce("leaves", F.lit(1).cast("long")).alias("n_leaves"),
        F.coalesce("tokens", zero).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )


def _rolled_up(tree: DataFrame, below: DataFrame) -> DataFrame:
    """``conv_id, depth, leaves, tokens``: sums over the subtrees of nodes of two or more conversations."""
    own = tree.where("n > 1").join(below, ["conv_id", "depth"], "left")
    work = saved(
        own.select(
            "conv_id", "depth", F.col("parent_conv_id").alias("up"), F.expr("if(children is null, 1, 0) + coalesce(single, 0)").cast("long").alias("leaves"), ((F.col("n") - 1) * F.col("words")).alias("tokens")
        )
    )
    step = 1
    while not work.where("up is not null").isEmpty():
        moving = work.where("up is not null")
        added = moving.groupBy(F.col("up").alias("conv_id"), (F.col("depth") - step).alias("depth")).agg(F.sum("leaves").alias("more_leaves"), F.sum("tokens").alias("more_tokens"))
        higher = work.where("up is not null").select(F.col("conv_id").alias("up"), (F.col("depth") + step).alias("depth"), F.col("up").alias("next"))
        found = work.join(higher, ["up", "depth"], "left").join(added, ["conv_id", "depth"], "left")
        total = lambda c: (F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c)
        work = saved(found.select("conv_id", "depth", F.col("next").alias("up"), total("leaves"), total("tokens")))
        step *= 2
    return work.drop("up")


def _digests(ends: DataFrame) -> DataFrame:
    """``node, depth, ends_sha256`` of ``ends(node, depth, conv_id)``: rows of CHUNK ids by range, then their hash in order."""

    def joined(it):
        held, ids = None, []

        def row():
            return {"node": held[0], "depth": held[1], "first": ids[0], "ids": ",".join(map(str, ids))}

        for batch in it:
            out = []
            for node, depth, conv in zip(*(batch.column(c).to_pylist() for c in ("node", "depth", "conv_id"))):
                if ids and (held != (node, depth) or len(ids) == CHUNK):
                    out.append(row())
                    ids = []
                held = (node, depth)
                ids.append(conv)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=chunk_type)
        if ids:
            yield pa.RecordBatch.from_pylist([row()], schema=chunk_type)

    def hashed(it):
        held, digest = None, None
        for batch in it:
            out = []
            for node, depth, ids in zip(*(batch.column(c).to_pylist() for c in ("node", "depth", "ids"))):
                if held != (node, depth):
                    if held:
                        out.append((*held, digest.hexdigest()))
                    held, digest = (node, depth), hashlib.sha256(ids.encode())
                else:
                    digest.update(f",{ids}".encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), hash_type.types)], schema=hash_type)
        if held:
            yield pa.RecordBatch.from_pylist([dict(zip(hash_type.names, (*held, digest.hexdigest())))], schema=hash_type)

    kind = dict(ends.dtypes)["node"]
    number = pa.int64() if kind == "bigint" else pa.int32()
    chunk_type = pa.schema([("node", number), ("depth", pa.int64()), ("first", number), ("ids", pa.string())])
    hash_type = pa.schema([("node", number), ("depth", pa.int64()), ("ends_sha256", pa.string())])
    chunks = ends.repartitionByRange("node", "depth", "conv_id").sortWithinPartitions("node", "depth", "conv_id").mapInArrow(joined, f"node {kind}, depth long, first {kind}, ids string")
    return chunks.repartition("node", "depth").sortWithinPartitions("node", "depth", "first").mapInArrow(hashed, f"node {kind}, depth long, ends_sha256 string")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first h turns are those of the conversation at the last multiple of 20, and all their ids;
    h is the crc32 of the id modulo 4. An id's remainder has the id's sign."""
    ranked = scanned(turns).select("conv_id", F.col("depth").alias("turn"), "role", "text")
    h = F.crc32(F.col("conv_id").cast("string")) % 4
    every = ranked.where("turn = 1").select("conv_id", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % 20).alias("base"))
    heads = ranked.where("turn <= 3 and conv_id % 20 = 0").withColumnRenamed("conv_id", "base")
    given = every.where("h > 0").join(heads, "base").where("turn <= h").select("conv_id", "turn", "role", "text")
    return ranked.where(F.col("turn") > h).unionByName(given), every.select("conv_id")
