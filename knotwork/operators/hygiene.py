"""Counts over the graph: connectivity, degrees, kinds and bands, review queues, coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from knotwork.functions import text as T
from knotwork.functions.matcher import matched
from knotwork.operators.transitions import degrees, live

REVIEWED = ("contradicts", "supersedes")


def connectivity(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: live nodes, live edges, islands (degree 1 at most), weak (2), orphans (0), largest and mean degree."""
    facts = nodes.where("status <> 'tombstone'").select("id").join(degrees(edges), "id", "left").select(F.coalesce("degree", F.lit(0)).alias("d"))
    rows = facts.agg(F.count("*").alias("total"), F.count(F.when(F.col("d") <= 1, 1)).alias("islands"), F.count(F.when(F.col("d") == 2, 1)).alias("weak"), F.count(F.when(F.col("d") == 0, 1)).alias("orphans"), F.max("d").alias("max_degree"), F.round(F.avg("d"), 6).alias("mean_degree"))
    return rows.crossJoin(live(edges).agg(F.count("*").alias("edges"))).select("total", "edges", "islands", "weak", "orphans", F.coalesce("max_degree", F.lit(0)).cast("long").alias("max_degree"), "mean_degree")  # a row each


def status_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("status").agg(F.count("*").alias("n"))


def degree_percentiles(nodes: DataFrame, edges: DataFrame, shares: tuple[float, ...] = (0.5, 0.9, 0.99)) -> DataFrame:
    """One row (p50, p90, p99): the element at min(floor(share * n), n - 1) of the live nodes' sorted degrees, unconnected
    nodes included. Runs over a row a distinct degree."""
    held = nodes.where("status <> 'tombstone'").select("id").join(degrees(edges), "id", "left").groupBy(F.coalesce("degree", F.lit(0)).alias("d")).agg(F.count("*").alias("c"))
    upto = held.select("d", F.sum("c").over(Window.orderBy("d")).alias("upto"), F.sum("c").over(Window.partitionBy()).alias("n"))  # distinct degrees
    at = lambda q: F.least(F.floor(F.lit(q) * F.col("n")), F.col("n") - 1)
    return upto.agg(*(F.min(F.when(F.col("upto") > at(q), F.col("d"))).alias(f"p{round(q * 100)}") for q in shares))


def hubs(edges: DataFrame, top: int = 10) -> DataFrame:
    return degrees(edges).orderBy(F.desc("degree"), "id").limit(max(top, 0))


def intent_queue(edges: DataFrame, top: int | None = None) -> DataFrame:
    """(source, fan_out, pending, kind, warn) of sources with live reviewed edges; the ``top`` by fan-out, then id."""
    rows = live(edges).where(F.col("kind").isin(*REVIEWED)).groupBy("source")
    kind = F.when(F.min("kind") == F.max("kind"), F.min("kind")).otherwise("mixed").alias("kind")
    out = rows.agg(F.count("*").alias("fan_out"), F.count(F.when(F.col("pending"), 1)).alias("pending"), kind).withColumn("warn", F.col("fan_out") >= 3)
    return out if top is None else out.orderBy(F.desc("fan_out"), "source").limit(max(top, 0))


def extends_only(edges: DataFrame) -> DataFrame:
    ends = live(edges).select("kind", F.explode(F.array("source", "target")).alias("id"))
    return ends.groupBy("id").agg(F.count("*").alias("n"), F.min("kind").alias("low"), F.max("kind").alias("high")).where("low = 'extends' and high = 'extends'").select("id", "n")


def classified(nodes: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """(area, id): live nodes whose folded text has a keyword of ``taxonomy(area, keyword)`` as whole words."""
    words = taxonomy.select("area", T.umlaut_fold(F.lower("keyword")).alias("keyword"))
    body = nodes.where("status <> 'tombstone'").select("id", T.umlaut_fold(F.lower(F.coalesce(T.body(F.col("text")), F.lit("")))).alias("body"))
    return matched(body, words, whole_words=True).select("area", "id")


def coverage(nodes: DataFrame, taxonomy: DataFrame, examples: int = 5) -> DataFrame:
    """(area, n, examples, unclassified): nodes an area, the first ids, and how many nodes are in none; empty areas too."""
    hits = classified(nodes, taxonomy)
    first = hits.withColumn("rk", F.row_number().over(Window.partitionBy("area").orderBy("id"))).where(F.col("rk") <= examples)
    shown = first.groupBy("area").agg(F.sort_array(F.collect_list("id")).alias("examples"))
    none = nodes.where("status <> 'tombstone'").select("id").join(hits.select("id").distinct(), "id", "left_anti").agg(F.count("*").alias("unclassified"))
    out = taxonomy.select("area").distinct().join(hits.groupBy("area").agg(F.count("*").alias("n")), "area", "left").join(shown, "area", "left")
    return out.crossJoin(none).select("area", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("examples", F.array().cast("array<string>")).alias("examples"), "unclassified")  # one row


def thin_areas(covered: DataFrame, threshold: int) -> DataFrame:
    """Areas below the threshold, thinnest first."""
    return covered.where(F.col("n") < threshold).orderBy("n", "area").select("area", "n")


def origins(edges: DataFrame) -> DataFrame:
    """(origin, n, most) of live, accepted edges: how many there are of each origin, and the most from one source; a null
    origin counts as one."""
    each = live(edges, pending=False).groupBy("origin", "source").agg(F.count("*").alias("n"))
    return each.groupBy("origin").agg(F.sum("n").alias("n"), F.max("n").alias("most"))
