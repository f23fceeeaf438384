"""Label propagation and betweenness against plain sequential versions."""

import random
from collections import Counter, deque

import pytest

from knotwork.operators import graph, propagation
from knotwork.sources.cut import cut


def random_graph(n, m, seed, star=0):
    rng = random.Random(seed)
    out = {tuple(sorted(rng.sample(range(n), 2))) for _ in range(m)} | {(0, j) for j in range(1, star)}
    return [f"n{i:05d}" for i in range(n)], [(f"n{a:05d}", f"n{b:05d}") for a, b in sorted(out)]


def around(names, pairs):
    near = {n: set() for n in names}
    for a, b in pairs:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    return near


def one_by_one(names, pairs, rounds=50):
    near, label = around(names, pairs), {n: n for n in names}
    for _ in range(rounds):
        before = dict(label)
        for n in sorted(names):
            if near[n]:
                label[n] = min(Counter(label[x] for x in near[n]).items(), key=lambda c: (-c[1], c[0]))[0]
        if label == before:
            break
    groups = {}
    for n in sorted(names):
        groups.setdefault(label[n], []).append(n)
    return {n: i for i, g in enumerate(sorted(groups.values(), key=lambda g: (-len(g), g[0]))) for n in g}


def brandes(names, pairs):
    near, total = around(names, pairs), dict.fromkeys(names, 0.0)
    for s in names:
        depth, paths, order, queue = {s: 0}, Counter({s: 1}), [], deque([s])
        while queue:
            v = queue.popleft()
            order.append(v)
            for w in near[v]:
                if w not in depth:
                    depth[w] = depth[v] + 1
                    queue.append(w)
                if depth[w] == depth[v] + 1:
                    paths[w] += paths[v]
        share = Counter()
        for w in reversed(order):
            for v in near[w]:
                if depth[v] == depth[w] - 1:
                    share[v] += paths[v] / paths[w] * (1 + share[w])
            total[w] += share[w] if w != s else 0
    return {n: x / max((len(names) - 1) * (len(names) - 2), 1) for n, x in total.items()}


def tables(spark, names, pairs):
    return spark.createDataFrame([(n,) for n in names], "id string"), spark.createDataFrame(pairs, "a string, b string")


@pytest.mark.parametrize("n, m, part, hub, star", [(3000, 5200, 400, 8, 900), (3000, 4000, 4096, 1024, 0), (40, 60, 1, 100, 0)])
def test_labels_in_parts_equal_one_by_one(spark, n, m, part, hub, star):
    names, pairs = random_graph(n, m, n + m, star)
    pairs += [(b, a) for a, b in pairs[:5]] + [(names[0], names[0])]
    found = graph.labels(*tables(spark, names, pairs), part=part, hub=hub)
    assert {r.id: r.community for r in found.collect()} == one_by_one(names, pairs)


def test_betweenness_in_batches_equals_brute_force(spark):
    names, pairs = random_graph(60, 75, 3)
    found = {r.id: r.betweenness for r in graph.betweenness(*tables(spark, names, pairs), batch=25).collect()}
    assert found == pytest.approx(brandes(names, pairs), abs=1e-11)


def test_graphs_without_edges(spark):
    nodes, pairs = tables(spark, ["b", "a"], [])
    assert {r.id: r.community for r in graph.labels(nodes, pairs).collect()} == {"a": 0, "b": 1}
    assert {r.id: r.betweenness for r in graph.betweenness(nodes, pairs).collect()} == {"a": 0, "b": 0}
    assert graph.labels(nodes.limit(0), pairs).collect() == []


def test_labels_over_several_rows_of_state_and_pieces_of_hubs(spark, monkeypatch):
    monkeypatch.setattr(propagation, "STATE", 512)
    monkeypatch.setattr(propagation, "ARCS", 300)
    names, pairs = random_graph(2000, 3000, 9, star=700)
    found = graph.labels(*tables(spark, names, pairs), part=700, hub=500)
    assert {r.id: r.community for r in found.collect()} == one_by_one(names, pairs)


def test_a_graph_of_one_part_is_swept_without_a_table_a_sweep(spark, monkeypatch):
    written = []
    for module in (graph, propagation):
        monkeypatch.setattr(module, "cut", lambda rows: written.append(1) or cut(rows))
    names = [f"n{i:05d}" for i in range(5000)]  # more nodes than 4096; labels move a step a sweep
    pairs = list(zip(names, names[1:]))
    rng = random.Random(2)
    pairs += [tuple(sorted(rng.sample(names, 2))) for _ in range(3000)]
    found = graph.labels(*tables(spark, names, pairs)).collect()
    assert {r.id: r.community for r in found} == one_by_one(names, pairs)
    assert len(written) <= 12
