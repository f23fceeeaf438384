"""Topology kernels over an undirected simple graph ``edges(a, b)`` of node ids.

Label propagation and betweenness are exact, run where the edges are, and take graphs of any size. Ids that have no
edge are communities of their own and lie on no path.

``labels`` visits nodes in id order, and each sees the new labels of smaller neighbours and the old ones of larger
ones. So a sweep is a triangular system with one solution: any assignment that agrees with itself is that solution.
Nodes are cut into parts of consecutive ids; each part is settled against the others' labels as they stand, again and
again until no label changes (``propagation``).

``betweenness`` is Brandes' algorithm level by level, forward with counts of shortest paths and backward with dependencies.
Where a task can hold the graph, each task does so for pivots of its own; else it is done ``PIVOTS`` pivots at a time in
packed blocks (``paths``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from knotwork.operators.paths import Blocks
from knotwork.operators.propagation import HUB, propagated
from knotwork.sources.cut import cut

#: Pivots whose paths are counted together; what is stored is a value a pivot and node in its reach, or less.
PIVOTS = 256


def _both(edges: DataFrame) -> DataFrame:
    """(u, v): every edge in both directions, once, without loops."""
    pairs = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u <> v")
    return pairs.union(pairs.select("v", "u")).distinct()


def _places(rows: DataFrame) -> DataFrame:
    """(id, place): the places of ids in their order, from 0; parts are counted apart, so no task orders them all."""
    parts = cut(rows.select("id").repartitionByRange("id").withColumn("part", F.spark_partition_id()))
    sizes = parts.groupBy("part").agg(F.count("*").alias("n"))
    starts = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("start"))  # a row a part
    inside = F.row_number().over(Window.partitionBy("part").orderBy("id")) - 1
    return parts.withColumn("at", inside).join(F.broadcast(starts), "part").select("id", (F.col("start") + F.col("at")).alias("place"))


def labels(nodes: DataFrame, edges: DataFrame, rounds: int = 50, part: int | None = None, hub: int = HUB) -> DataFrame:
    """(id, community) by asynchronous label propagation in id order; 0 is the largest community, then by
    smallest member. The most frequent neighbour label wins, the smallest of equals. A node without an edge is a
    community of its own."""
    pairs = edges.select("a", "b").where("a <> b")
    numbered = cut(_places(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()))
    end = lambda c, place: numbered.select(F.col("id").alias(c), F.col("place").alias(place)).hint("merge")
    arcs = cut(pairs.join(end("a", "v"), "a").join(end("b", "w"), "b").select("v", "w"))
    found = propagated(arcs, numbered.count(), rounds, part, hub)
    now = cut(numbered.join(found.hint("merge"), "place").select("id", F.col("label").alias("new")))
    sizes = cut(now.groupBy("new").agg(F.count("*").alias("size"), F.min("id").alias("least")))
    several = sizes.where("size > 1").select("new", F.format_string("%020d %s", F.lit(1 << 62) - F.col("size"), "least").alias("id"))
    ranks = _places(several).join(several, "id").select("new", F.col("place").cast("int").alias("community"))
    many = now.select("id", "new").join(ranks, "new").select("id", "community")
    alone = _places(nodes.join(many, "id", "left_anti")).select("id", (F.col("place") + several.count()).cast("int").alias("community"))
    return many.join(nodes.select("id"), "id", "left_semi").unionByName(alone)


def synchronous_labels(edges: DataFrame, rounds: int = 10) -> DataFrame:
    """(id, label): every round, all nodes take their neighbours' most frequent label at once."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a")).distinct()
    now = both.select(F.col("u").alias("id")).distinct().withColumn("label", F.col("id"))
    for _ in range(rounds):
        counts = both.join(now.withColumnRenamed("id", "v"), "v").groupBy("u", "label").agg(F.count("*").alias("n"))
        first = F.row_number().over(Window.partitionBy("u").orderBy(F.desc("n"), "label"))
        now = counts.withColumn("rk", first).where("rk = 1").select(F.col("u").alias("id"), "label")
        now = cut(now)
    return now


def modularity(edges: DataFrame, communities: DataFrame) -> DataFrame:
    """One row q = sum of (inside / m - (degree / 2m)^2) over ``communities(id, community)``."""
    m = edges.agg(F.count("*").alias("m"))
    ends = edges.select(F.col("a").alias("id")).union(edges.select("b"))
    degree = ends.join(communities, "id").groupBy("community").agg(F.count("*").alias("d"))
    of = lambda c: communities.select(F.col("id").alias(c), F.col("community").alias(f"of_{c}"))
    inside = edges.join(of("a"), "a").join(of("b"), "b").where("of_a = of_b").groupBy(F.col("of_a").alias("community")).agg(F.count("*").alias("n"))
    part = F.coalesce("n", F.lit(0)) / F.col("m") - F.pow(F.col("d") / (2 * F.col("m")), F.lit(2))
    return degree.join(inside, "community", "left").join(F.broadcast(m)).agg(F.sum(part).alias("q"))  # m: one row


def betweenness(nodes: DataFrame, edges: DataFrame, sample: int | None = None, batch: int = PIVOTS) -> DataFrame:
    """(id, betweenness) in [0, 1], to 12 digits; with ``sample``, from every ceil(n / sample)-th id, scaled up."""
    size = nodes.count()
    step = -(-size // sample) if sample and sample < size else 1
    both = cut(_both(edges))
    numbered = cut(_places(both.select(F.col("u").alias("id")).distinct()))
    end = lambda c, place: numbered.select(F.col("id").alias(c), F.col("place").alias(place)).hint("merge")
    blocks = Blocks(cut(both.join(end("u", "v0"), "u").join(end("v", "w0"), "v").select(F.col("v0").alias("v"), F.col("w0").alias("w"))), numbered.count())
    # Pivots are every step-th of all ids; those without an edge lie on no path.
    pivots = _places(nodes).where(F.col("place") % step == 0).select("id", (F.col("place") / step).cast("long").alias("number"))
    pivots = cut(pivots.join(numbered, "id").select("place", (F.col("number") % batch).alias("number"), F.floor(F.col("number") / batch).alias("batch")))
    if blocks.fits:
        parts = [blocks.whole(pivots.select("place", (F.col("batch") * batch + F.col("number")).alias("number")))]
    else:
        parts = [blocks.dependencies(pivots.where(F.col("batch") == r.batch)) for r in pivots.select("batch").distinct().orderBy("batch").collect()]
    norm, pivots = max((size - 1) * (size - 2), 1), -(-size // step) if size else 0
    share = F.round(F.coalesce("part", F.lit(0.0)) * (size / max(1, pivots) / norm), 12).alias("betweenness")
    if not parts:
        return nodes.select("id", F.lit(0.0).alias("betweenness"))
    summed = reduce(DataFrame.unionByName, parts).groupBy("place").agg(F.sum("part").alias("part")).join(numbered.hint("merge"), "place")
    return nodes.select("id").join(summed.select("id", "part").hint("merge"), "id", "left").select("id", share)


def shortest_paths(edges: DataFrame, start: str, depth: int = 4, goal: str | None = None) -> DataFrame:
    """(id, path) of every node within ``depth`` steps, or of ``goal`` alone: the shortest path, the first in order of
    its ids among equals. A frontier is joined with the edges once a step."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a")).distinct()
    now = edges.sparkSession.createDataFrame([(start, [start])], "u string, path array<string>")
    seen = now
    for _ in range(depth if goal != start else 0):
        if goal is not None and not now.where(F.col("u") == goal).isEmpty():
            break
        grown = now.join(both, "u").join(seen.select(F.col("u").alias("v")), "v", "left_anti")
        now = cut(grown.groupBy("v").agg(F.min(F.concat("path", F.array("v"))).alias("path")).select(F.col("v").alias("u"), "path"))
        seen = seen.unionByName(now)
    out = seen.select(F.col("u").alias("id"), "path")
    return out.where(F.col("id") == goal) if goal is not None else out.where(F.col("id") != start)


def shortest_path(edges: DataFrame, start: str, goal: str, depth: int = 4) -> DataFrame:
    """One row (path); none if out of reach."""
    return shortest_paths(edges, start, depth, goal).select("path")


def neighbors(nodes: DataFrame, edges: DataFrame, node_id: str, hops: int = 1, kinds: list[str] | None = None, pending: bool = False, limit: int | None = None) -> DataFrame:
    """(id, text, kind, direction, pending, confidence, hops) around a node, in order of hops, kind and id. Edges are live
    and run both ways; those to a tombstone don't count. Of several ways to a node the first holds: by the order in
    which the nearer nodes were found, then kind and seq. Beyond the first step a direction is the other way round."""
    dead = nodes.where("status = 'tombstone'").select("id")
    rows = edges.where("not rejected and to_s is null and source <> target")
    rows = rows if pending else rows.where("not pending")
    rows = rows if kinds is None else rows.where(F.col("kind").isin(*kinds) if kinds else F.lit(False))
    for end in ("source", "target"):
        rows = rows.join(dead.withColumnRenamed("id", end), end, "left_anti")
    arc = lambda u, v, way: rows.select(F.col(u).alias("u"), F.col(v).alias("v"), "kind", "seq", "pending", "confidence", F.lit(way).alias("direction"))
    arcs = arc("source", "target", "out").unionByName(arc("target", "source", "in"))
    front = nodes.sparkSession.createDataFrame([(node_id, 0)], "u string, ord long")
    seen, out = front.select("u"), None
    for hop in range(1, hops + 1):
        way = F.col("direction") if hop == 1 else F.when(F.col("direction") == "out", "in").otherwise("out")
        steps = arcs.join(front, "u").join(seen.withColumnRenamed("u", "v"), "v", "left_anti")
        first = F.row_number().over(Window.partitionBy("v").orderBy("ord", "kind", "seq"))
        found = steps.withColumn("rk", first).where("rk = 1").select(F.col("v").alias("id"), "kind", way.alias("direction"), "pending", "confidence", F.lit(hop).cast("long").alias("hops"), "ord")
        if hop < hops:
            found = cut(found)
            # The order of finding: by the nearer node's, then kind and id. One node's surroundings.
            front = found.select(F.col("id").alias("u"), F.row_number().over(Window.orderBy("ord", "kind", "id")).cast("long").alias("ord"))
            seen = seen.union(found.select("id"))
        out = found if out is None else out.unionByName(found)
    named = out.join(nodes.select("id", "text"), "id", "left").select("id", "text", "kind", "direction", "pending", "confidence", "hops").orderBy("hops", "kind", "id")
    return named if limit is None else named.limit(limit)
