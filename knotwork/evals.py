"""End states as acceptance cases: a sequence of texts goes in, and what must hold in the end is checked.

A case has ``texts``, options for each, and expectations: nodes and edges there must be, duplicates, search
answers, neighbourhoods and communities. ``run`` plays a case several times; it passes if every play does.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from knotwork.api import Graph
from knotwork.functions.embedding import normal_text
from knotwork.operators import graph
from knotwork.operators.communities import simple
from knotwork.sources.state import empty


@dataclass
class Case:
    name: str
    texts: list[str]
    options: dict = field(default_factory=dict)
    nodes: int | None = None
    edges: list[tuple[str, str, str]] = field(default_factory=list)  # (source text, target text, kind)
    absent: list[tuple[str, str]] = field(default_factory=list)
    kinds_most: dict[str, int] = field(default_factory=dict)  # accepted edges of a kind a source
    origins_least: dict[str, int] = field(default_factory=dict)
    search: dict[str, str] = field(default_factory=dict)  # query: the text that comes first
    neighbors: list[tuple[str, str, int]] = field(default_factory=list)  # (text, other text, hops)
    together: list[tuple[str, str]] = field(default_factory=list)
    apart: list[tuple[str, str]] = field(default_factory=list)


def find(g: Graph, text: str) -> str | None:
    """The id of a text: an exact match first, then the shortest text that it begins."""
    wanted = normal_text(text)
    body = F.trim(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), r"(?U)\s+", " "))
    rows = g.state.nodes.select("id", body.alias("body")).where(F.col("body").startswith(wanted))
    found = rows.orderBy(F.col("body") != wanted, F.length("body"), "id").limit(1).collect()
    return found[0].id if found else None


def play(spark: SparkSession, case: Case) -> Graph:
    g = Graph(spark, state=empty(spark))
    for text in case.texts:
        g.remember(text, source="human", **case.options)
    return g


def failures(g: Graph, case: Case) -> list[str]:
    out: list[str] = []
    say = lambda good, what: None if good else out.append(what)
    shown = g.state.edges.where("not rejected and to_s is null")
    if case.nodes is not None:
        n = g.state.nodes.where("status <> 'tombstone'").count()
        say(n == case.nodes, f"{n} nodes, not {case.nodes}")
    pairs = {(r.source, r.target, r.kind) for r in shown.select("source", "target", "kind").collect()}  # a case's own graph
    for a, b, kind in case.edges:
        say((find(g, a), find(g, b), kind) in pairs, f"no {kind} edge from {a!r} to {b!r}")
    for a, b in case.absent:
        ends = {find(g, a), find(g, b)}
        say(not any({x, y} == ends for x, y, _ in pairs), f"an edge between {a!r} and {b!r}")
    for kind, most in case.kinds_most.items():
        top = shown.where(~F.col("pending") & (F.col("kind") == kind)).groupBy("source").count().agg(F.max("count")).first()[0] or 0
        say(top <= most, f"{top} accepted {kind} edges of one source")
    for origin, least in case.origins_least.items():
        say(shown.where(F.col("origin") == origin).count() >= least, f"fewer than {least} edges by {origin}")
    for query, first in case.search.items():
        hits = g.search(query)["results"]
        say(bool(hits) and hits[0]["id"] == find(g, first), f"{query!r} does not find {first!r} first")
    for a, b, hops in case.neighbors:
        near = g.neighbors(find(g, a), hops=hops, include_pending=True, limit=50)["neighbors"]
        say(any(r["id"] == find(g, b) for r in near), f"{b!r} is not within {hops} of {a!r}")
    if case.together or case.apart:
        nodes = g.state.nodes.where("status <> 'tombstone'").select("id")
        of = {r.id: r.community for r in graph.labels(nodes, simple(nodes, g.state.edges)).collect()}
        for a, b in case.together:
            say(of[find(g, a)] == of[find(g, b)], f"{a!r} and {b!r} are apart")
        for a, b in case.apart:
            say(of[find(g, a)] != of[find(g, b)], f"{a!r} and {b!r} are together")
    return out


def run(spark: SparkSession, cases: list[Case], times: int = 1) -> dict[str, list[str]]:
    """The failures of each case that has any, over ``times`` plays."""
    out: dict[str, list[str]] = {}
    for case in cases:
        for _ in range(times):
            if found := failures(play(spark, case), case):
                out.setdefault(case.name, []).extend(found)
    return out
