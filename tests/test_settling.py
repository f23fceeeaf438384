"""Duplicates inside a batch, settled part by part."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from knotwork.operators import ingest, transitions
from knotwork.operators import vectors as V


def in_turn(n, known, pairs):
    fresh = []
    for i in range(n):
        fresh.append(i not in known and not any(fresh[j] for a, j in pairs if a == i))
    return fresh


@pytest.mark.parametrize("part,n", [(4, 40), (1024, 40)])
def test_parts_settle_as_one_by_one(spark, monkeypatch, part, n):
    monkeypatch.setattr(ingest, "PART", part)
    rng = random.Random(part)
    known, pairs = {3, n - 1}, {(a, rng.randrange(a)) for a in (rng.randrange(1, n) for _ in range(2 * n))}
    order = spark.createDataFrame([(f"a{i:03d}", i) for i in range(n)], "id string, seq long")
    got = ingest._settled(order, spark.createDataFrame([(f"a{i:03d}",) for i in known], "id string"), spark.createDataFrame([(f"a{a:03d}", f"a{b:03d}") for a, b in pairs], "source string, target string"))
    assert [r.fresh for r in got.orderBy("id").collect()] == in_turn(n, known, pairs)


def test_a_chain_takes_few_rounds(spark, monkeypatch):
    rounds, n = [], 3000
    cut = ingest.cut
    monkeypatch.setattr(ingest, "cut", lambda rows: rounds.append(1) or cut(rows))
    order = spark.range(n).selectExpr("lpad(id, 6, '0') as id", "id as seq")
    chain = spark.range(1, n).selectExpr("lpad(id, 6, '0') as source", "lpad(id - 1, 6, '0') as target")
    got = ingest._settled(order, order.limit(0).select("id"), chain)
    assert [r.fresh for r in got.orderBy("id").collect()] == [i % 2 == 0 for i in range(n)]
    assert len(rounds) == 2 + 3


def test_consolidate_compares_only_the_nodes_that_wait(spark, monkeypatch):
    rng = np.random.default_rng(6)
    v = rng.normal(size=(400, 8))
    v[200:] = v[rng.integers(0, 200, 200)] + rng.normal(size=(200, 8)) * 0.01  # near copies
    rows = [(f"n{i:03d}", "probation" if i % 4 == 1 else "active", v[i].tolist()) for i in rng.permutation(400)]
    nodes = spark.createDataFrame(rows, "id string, status string, vec array<double>").withColumn("source", F.col("id"))
    vectors, asked = nodes.select("id", "vec"), []
    crossed = V._crossed
    monkeypatch.setattr(V, "_crossed", lambda *given: asked.append(crossed(*given)) or asked[-1])
    found = {r.id: r.status for r in transitions.consolidate(nodes, vectors).select("id", "status").collect()}
    assert {i for r in asked[0].select("a").collect() for i in r.a} == {i for i, status, _ in rows if status == "probation"}
    u = v / np.linalg.norm(v, axis=1)[:, None]
    cos = u @ u.T
    np.fill_diagonal(cos, -1)
    gone = {}
    for i, name in enumerate(f"n{j:03d}" for j in range(400)):
        other = int(np.argmax(np.round(cos[i], 9)))
        gone[i] = i % 4 == 1 and cos[i, other] >= 0.92 and not gone.get(other, False)
        assert found[name] == ("tombstone" if gone[i] else "active")
