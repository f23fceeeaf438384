"""Dual-tree clustering against plain loops over exact integers."""

import hashlib
import math
import random

import numpy as np

from knotwork.llm import dual_tree, queries


def plain_clusters(rows, k=40, rounds=5, size=64):
    kept = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    centroids = [v for _, v in sorted((digest(f"2:{'' if i is None else i}"), v) for i, v in kept)[:k]]
    square = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    for n in range(rounds + 1):
        at = [min(range(len(centroids)), key=lambda c: (square(v, centroids[c]), c)) for _, v in kept]
        if n < rounds:
            for c in range(len(centroids)):
                mine = [v for (_, v), a in zip(kept, at) if a == c]
                if mine:
                    centroids[c] = [sum(x) // len(mine) for x in zip(*mine)]
    far = [square(v, centroids[a]) for (_, v), a in zip(kept, at)]
    whole = lambda n: min(n, dual_tree.LARGEST)
    total = [sum(whole(d) for d, a in zip(far, at) if a == c) for c in range(len(centroids))]
    return [(i, a, whole(d), whole(total[a]), whole(sum(total)), digest(",".join(map(str, centroids[a])))) for (i, _), a, d in zip(kept, at, far)]


def clustered_rows(seed=5, n=260, spread=0.02):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 0.3) for _ in range(64)] for _ in range(30)]
    return [(i, [float(np.float32(x + rng.gauss(0, spread))) for x in rng.choice(centres)]) for i in range(n)]


def same(spark, tables, rows, schema="vec_id long, embedding array<float>"):
    out = queries.op11_dual_tree_clusters(spark, tables(embeddings=([(*r, 1) for r in rows], schema + ", label int")))
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, out.collect()), key=key) == sorted(plain_clusters(rows), key=key)


def test_equals_plain_lloyd_with_hot_and_odd_vectors(spark, tables):
    rows = clustered_rows()
    rows += [(1000 + i, rows[3][1]) for i in range(150)] + [(5, rows[9][1]), (None, rows[10][1]), (None, rows[11][1])]
    rows += [(2000, None), (2001, []), (2002, [0.5] * 63), (2003, [None] + [0.1] * 63), (2004, [float("nan")] * 64), (2005, [float("inf")] * 64), (2006, [0.0] * 64)]
    same(spark, tables, rows)


def test_few_equal_and_no_vectors(spark, tables):
    same(spark, tables, [(i, [0.25] * 64) for i in range(50)])
    same(spark, tables, [(1, [0.5] * 64), (2, [-0.501] * 64)])
    same(spark, tables, [])


def test_large_components_stay_exact(spark, tables):
    rng = random.Random(2)
    for size in (1e4, 1e7, 1e30):
        same(spark, tables, [(i, [rng.uniform(-size, size) for _ in range(64)]) for i in range(60)], "vec_id long, embedding array<double>")


def test_pruned_pairs_are_never_compared():
    points = np.floor(256 * np.array([v for _, v in clustered_rows(n=1500, spread=0.001)]))
    order, nodes = dual_tree.cover_tree(np.unique(points, axis=0), dual_tree.LEAF)
    points = np.unique(points, axis=0)[order]
    centroids = dual_tree.Centroids([list(map(int, p)) for p in points[:: len(points) // 40][:40]])
    found, compared = np.full(len(points), -1), 0
    for low, high, numbers, n in centroids.ranges(points, nodes):
        found[low:high], compared = numbers, compared + n
    assert (found == centroids.nearest(points, np.arange(len(centroids.numbers)))).all()
    assert compared < len(points) * 40 / 2
    for n in nodes:  # a node's points lie within its radius
        part = points[int(n[2]) : int(n[3])]
        assert np.sqrt(((part - points[int(n[0])]) ** 2).sum(axis=1)).max() <= n[1] + 1e-9
