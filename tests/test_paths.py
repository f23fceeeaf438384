"""Betweenness in packed blocks: small parts against brute force, and what is shuffled against the arcs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from knotwork.operators import communities, graph, paths
from tests.test_topology import brandes, tables


def test_matrices_are_packed_and_unpacked():
    rng = np.random.default_rng(1)
    for share, top in ((0.001, 3), (0.5, 200), (0.9, 70000), (0.2, 1 << 40), (0.5, 0.5), (0.0, 1)):
        matrix = np.where(rng.random((64, paths.GROUP)) < share, rng.integers(1, 1000, (64, paths.GROUP)) * top, 0)
        bits, at, code, held = paths._pack(matrix.astype(float))
        where, values = paths._unpack(type("Row", (), {"bits": bits, "at": at, "code": code, "held": held}))
        again = np.zeros(matrix.size)
        again[where] = values
        assert np.array_equal(again, matrix.ravel())


def test_betweenness_over_several_parts_and_blocks_equals_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    pairs = sorted({tuple(sorted(rng.sample(range(40), 2))) for _ in range(90)} | {(0, j) for j in range(1, 30)})
    names, pairs = [f"n{i:02d}" for i in range(44)], [(f"n{a:02d}", f"n{b:02d}") for a, b in pairs]  # four have no edge
    sizes = []

    class Small(paths.Blocks):
        def __init__(self, both, size):
            super().__init__(both, size, part=16, arcs=24)
            sizes.append((self.parts, self.per))

        def sent(self, cells):
            out = super().sent(cells)
            assert out.count() <= cells.count() * self.parts * self.per  # a row a cell and block, however many arcs
            return out

    monkeypatch.setattr(graph, "Blocks", Small)
    found = {r.id: r.betweenness for r in graph.betweenness(*tables(spark, names, pairs)).collect()}
    assert found == pytest.approx(brandes(names, pairs), abs=1e-11)
    assert sizes[0][0] == 3 and sizes[0][1] > 1


def test_a_report_that_shows_no_god_nodes_counts_no_paths(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(communities.graph, "betweenness", lambda nodes, pairs, sample=None: asked.append(sample) or nodes.select("id", F.lit(0.5).alias("betweenness")))
    nodes = spark.createDataFrame([(i, f"text {i}", "new") for i in "abc"], "id string, text string, status string")
    edges = spark.createDataFrame([("a", "b", False, None, False), ("b", "c", False, None, False)], "source string, target string, rejected boolean, to_s long, pending boolean")
    found = communities.analyze(nodes, edges, min_size=1, sample=2)
    assert communities.provider(found, min_size=1).count() == 1 and asked == []
    assert found.gods.count() == 3 and found.gods.count() == 3 and asked == [2]


def test_a_task_that_holds_the_graph_gives_the_same_as_levels(spark, monkeypatch):
    rng = random.Random(8)
    pairs = sorted({tuple(sorted(rng.sample(range(70), 2))) for _ in range(120)} | {(0, j) for j in range(1, 30)} | {(100, 101), (101, 102)})
    names, pairs = [f"n{i:03d}" for i in range(110)], [(f"n{a:03d}", f"n{b:03d}") for a, b in pairs]
    given, want = tables(spark, names, pairs), brandes(names, pairs)
    monkeypatch.setattr(paths, "_SLOTS", 4)  # a hub has more
    monkeypatch.setattr(paths.Blocks, "dependencies", None)
    assert {r.id: r.betweenness for r in graph.betweenness(*given).collect()} == pytest.approx(want, abs=1e-11)
    some = {r.id: r.betweenness for r in graph.betweenness(*given, sample=20).collect()}
    monkeypatch.undo()
    monkeypatch.setattr(paths, "WHOLE", 0)
    assert some == pytest.approx({r.id: r.betweenness for r in graph.betweenness(*given, sample=20).collect()}, abs=1e-11)


def test_god_nodes_follows_the_paths_of_every_node(spark, monkeypatch):
    from knotwork import queries

    rng = random.Random(3)
    pairs = sorted({tuple(sorted(rng.sample(range(450), 2))) for _ in range(700)})
    names, pairs = [f"n{i:03d}" for i in range(450)], [(f"n{a:03d}", f"n{b:03d}") for a, b in pairs]
    nodes, edges = tables(spark, names, pairs)
    monkeypatch.setattr(queries, "_live", lambda *_: nodes.withColumn("text", F.col("id")))
    monkeypatch.setattr(queries, "undirected_graph", lambda *_: edges)
    want = sorted(brandes(names, pairs).items(), key=lambda x: (-x[1], x[0]))[:5]
    assert {r.id: r.betweenness for r in queries.god_nodes(spark, "").collect()} == pytest.approx(dict(want), abs=1e-11)
