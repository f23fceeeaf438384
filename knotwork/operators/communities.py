"""Communities of an undirected graph: their rows, hubs, and the links missing between them.

``labels(id, community)`` may come from ``graph.labels``, from ``graph.synchronous_labels`` or from
anywhere else; ``pairs(a, b)`` is the simple graph. Everything but the choice of five god nodes is
declarative; what is broadcast is a row a community or fewer.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from knotwork.functions import text as T
from knotwork.functions.matcher import matched
from knotwork.operators import graph
from knotwork.sources.cut import cut

NONE = "UNCLASSIFIED"
SAMPLE_CHARS, GODS = 72, 5


def areas_of(nodes: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """(id, area) of each node whose folded text holds a keyword of ``taxonomy(area, keyword)`` anywhere."""
    words = taxonomy.select("area", T.umlaut_fold(F.lower("keyword")).alias("keyword"))
    body = nodes.select("id", T.umlaut_fold(F.lower(T.body(F.coalesce("text", F.lit(""))))).alias("body"))
    return matched(body, words, whole_words=False).distinct()


def degrees(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def _members(labels: DataFrame, pairs: DataFrame) -> DataFrame:
    return labels.join(degrees(pairs), "id", "left").select("id", "community", F.coalesce("degree", F.lit(0)).alias("degree"))


def stats(nodes: DataFrame, pairs: DataFrame, labels: DataFrame, taxonomy: DataFrame | None = None) -> DataFrame:
    """(community, size, internal_edges, degree_sum, label, hub, sample): a row a community. Its label is the area
    that most members have (the first by name of equals), its hub the member of highest degree, the largest id of equals."""
    members = _members(labels, pairs)
    of = lambda c: labels.select(F.col("id").alias(c), F.col("community").alias(f"of_{c}"))
    inside = pairs.join(of("a"), "a").join(of("b"), "b").where("of_a = of_b").groupBy(F.col("of_a").alias("community")).agg(F.count("*").alias("internal_edges"))
    out = members.groupBy("community").agg(F.count("*").alias("size"), F.sum("degree").alias("degree_sum"), F.max(F.struct("degree", "id"))["id"].alias("hub"))
    out = out.join(inside, "community", "left").withColumn("internal_edges", F.coalesce("internal_edges", F.lit(0)))
    out = out.join(nodes.select(F.col("id").alias("hub"), T.snippet(F.coalesce("text", F.lit("")), SAMPLE_CHARS).alias("sample")), "hub", "left")
    if taxonomy is None:
        return out.select("community", "size", "internal_edges", "degree_sum", F.lit(NONE).alias("label"), "hub", "sample")
    counts = areas_of(nodes, taxonomy).join(labels, "id").groupBy("community", "area").agg(F.count("*").alias("n"))
    label = counts.groupBy("community").agg(F.min(F.struct(-F.col("n"), "area"))["area"].alias("label"))
    return out.join(label, "community", "left").select("community", "size", "internal_edges", "degree_sum", F.coalesce("label", F.lit(NONE)).alias("label"), "hub", "sample")


def gaps(nodes: DataFrame, pairs: DataFrame, labels: DataFrame, rows: DataFrame | None = None, min_size: int = 10, top: int = 10) -> DataFrame:
    """Pairs of communities of ``min_size`` members with the fewest edges for their degrees, the ``top`` by deficit, then by
    expectation: (a, b, labels, sizes, observed, expected, deficit, bridge_nodes, samples). Expected is the product of
    the degree sums over twice the edges; bridge nodes are up to ten smallest ids with an edge to the other side."""
    rows = stats(nodes, pairs, labels) if rows is None else rows
    big = rows.where((F.col("size") >= min_size) & (F.col("degree_sum") > 0)).select("community", "label", "size", "degree_sum")
    edges = pairs.agg(F.count("*").alias("m"))
    side = lambda c: big.select(F.col("community").alias(c), F.col("label").alias(f"{c}_label"), F.col("size").alias(f"{c}_size"), F.col("degree_sum").alias(f"{c}_sum"))
    of = lambda c: labels.select(F.col("id").alias(c), F.col("community").alias(f"of_{c}"))
    cross = pairs.join(of("a"), "a").join(of("b"), "b").where("of_a <> of_b")
    between = cross.select(F.least("of_a", "of_b").alias("x"), F.greatest("of_a", "of_b").alias("y"), "a", "b")
    observed = between.groupBy("x", "y").agg(F.count("*").alias("observed"))
    expected = F.col("x_sum") * F.col("y_sum") / (2.0 * F.col("m"))
    # Pairs of large communities: their number is the result's own size before the cut to the first ``top``.
    found = side("x").join(side("y"), F.col("x") < F.col("y")).join(F.broadcast(edges)).join(observed, ["x", "y"], "left")
    found = found.withColumn("observed", F.coalesce("observed", F.lit(0))).withColumn("expected", expected)
    found = found.withColumn("deficit", (F.col("expected") - F.col("observed")) / F.col("expected")).orderBy(F.desc("deficit"), F.desc("expected"), "x", "y").limit(max(top, 0))
    ends = between.select("x", "y", F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("rk", F.row_number().over(Window.partitionBy("x", "y").orderBy("id"))).where("rk <= 10")
    bridges = ends.groupBy("x", "y").agg(F.sort_array(F.collect_list("id")).alias("bridge_nodes"))
    samples = strongest(labels, pairs, 2).join(nodes.select("id", T.snippet(F.coalesce("text", F.lit("")), SAMPLE_CHARS).alias("sample")), "id")
    samples = samples.groupBy("community").agg(F.transform(F.sort_array(F.collect_list(F.struct("rk", "sample"))), lambda s: s["sample"]).alias("samples"))  # two a community
    shown = lambda c: samples.select(F.col("community").alias(c), F.col("samples").alias(f"{c}_samples"))
    out = found.join(bridges, ["x", "y"], "left").join(shown("x"), "x", "left").join(shown("y"), "y", "left")
    return out.select(
        F.col("x").alias("a"), F.col("y").alias("b"), F.col("x_label").alias("a_label"), F.col("y_label").alias("b_label"), F.col("x_size").alias("a_size"), F.col("y_size").alias("b_size"),
        F.col("observed").cast("long").alias("observed"), F.round("expected", 6).alias("expected"), F.round("deficit", 6).alias("deficit"),
        F.coalesce("bridge_nodes", F.array().cast("array<string>")).alias("bridge_nodes"), F.col("x_samples").alias("a_samples"), F.col("y_samples").alias("b_samples"),
    ).orderBy(F.desc("deficit"), F.desc("expected"), "a", "b")


def strongest(labels: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """(community, id, degree, rk): the k members of highest degree, the smallest ids first among equals."""
    rank = F.row_number().over(Window.partitionBy("community").orderBy(F.desc("degree"), "id"))
    return _members(labels, pairs).withColumn("rk", rank).where(F.col("rk") <= k).select("community", "id", "degree", "rk")


def god_nodes(nodes: DataFrame, pairs: DataFrame, sample: int | None = None) -> DataFrame:
    """(id, degree, betweenness, rounded, text): the five nodes of highest betweenness."""
    top = graph.betweenness(nodes.select("id"), pairs, sample).orderBy(F.desc("betweenness"), "id").limit(GODS)
    return top.join(degrees(pairs), "id", "left").join(nodes.select("id", T.snippet(F.coalesce("text", F.lit("")), SAMPLE_CHARS).alias("text")), "id").select(
        "id", F.coalesce("degree", F.lit(0)).alias("degree"), "betweenness", F.round("betweenness", 1).alias("rounded"), "text"
    )


@dataclass
class Report:
    labels: DataFrame
    communities: DataFrame
    modularity: DataFrame
    find_gods: Callable[[], DataFrame]
    gaps: DataFrame
    isolated: DataFrame
    unclassified: DataFrame

    @cached_property
    def gods(self) -> DataFrame:
        """Found when they are first asked for: betweenness is more work than all the rest."""
        return self.find_gods()


def analyze(nodes: DataFrame, edges: DataFrame, taxonomy: DataFrame | None = None, min_size: int = 10, top: int = 10, sample: int | None = None, pending: bool = True, exclude: DataFrame | None = None) -> Report:
    """All of this for live ``nodes(id, text, status)`` and ``edges``, without the nodes of ``exclude(id)``."""
    live = nodes.where("status <> 'tombstone'")
    live = (live if exclude is None else live.join(exclude.select("id"), "id", "left_anti")).select("id", "text")
    pairs = cut(simple(live, edges, pending))
    labels = cut(graph.labels(live, pairs))
    rows = stats(live, pairs, labels, taxonomy)
    known = areas_of(live, taxonomy).select("id").distinct() if taxonomy is not None else live.select("id").limit(0)
    return Report(
        labels, rows, graph.modularity(pairs, labels), lambda: god_nodes(live, pairs, sample), gaps(live, pairs, labels, rows, min_size, top),
        live.join(degrees(pairs), "id", "left_anti").select("id"), live.join(known, "id", "left_anti").agg(F.count("*").alias("unclassified")),
    )


def simple(nodes: DataFrame, edges: DataFrame, pending: bool = True) -> DataFrame:
    """(a, b), a < b: live edges between two of ``nodes``, once each and without loops."""
    kept = edges.where("not rejected and to_s is null and source <> target")
    kept = kept if pending else kept.where("not pending")
    ends = kept.select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).distinct()
    return ends.join(nodes.select(F.col("id").alias("a")), "a", "left_semi").join(nodes.select(F.col("id").alias("b")), "b", "left_semi").select("a", "b")


def provider(report: Report, min_size: int = 10, top: int = 5) -> DataFrame:
    """(kind, label, node_ids, score, hint): rows for a report, large communities (with up to 20 smallest member
    ids) and then gaps."""
    rank = F.row_number().over(Window.partitionBy("community").orderBy("id"))
    ids = report.labels.withColumn("rk", rank).where("rk <= 20").groupBy("community").agg(F.sort_array(F.collect_list("id")).alias("node_ids"))
    big = report.communities.where(F.col("size") >= min_size).orderBy("community").limit(top).join(ids, "community")
    first = big.select(F.lit("community").alias("kind"), "label", "node_ids", F.col("size").cast("double").alias("score"), F.col("sample").alias("hint"))
    evidence = F.array_join(F.slice(F.concat("a_samples", "b_samples"), 1, 2), " / ")
    name = lambda c: F.concat(F.lit("C"), F.col(c), F.lit(" ("), F.col(f"{c}_label"), F.lit(", n="), F.col(f"{c}_size"), F.lit(")"))
    hint = F.concat(name("a"), F.lit(" <-> "), name("b"), F.lit(": "), F.col("observed"), F.lit(" of "), F.round("expected", 1), F.lit(" expected edges; evidence: "), evidence)
    holes = report.gaps.select(F.lit("hole").alias("kind"), F.concat_ws(" <-> ", "a_label", "b_label").alias("label"), F.col("bridge_nodes").alias("node_ids"), F.round("deficit", 2).alias("score"), hint.alias("hint"))
    return first.unionByName(holes)
