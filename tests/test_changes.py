"""Versions that hold only what changes."""

from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from knotwork.api import Graph
from knotwork.sources import state


def clock():
    return datetime(2024, 7, 1, tzinfo=timezone.utc)


def rows(table):
    return sorted(map(repr, table.collect()))


def same(a, b):
    return all(rows(getattr(a, name)) == rows(getattr(b, name)) for name in ("nodes", "edges", "vectors", "ledger"))


def test_changes_give_the_state_that_whole_versions_give(spark, tmp_path):
    store = state.Store(spark, f"{tmp_path}/s")
    store.publish(state.demo(spark), "t", "first")
    kept, plain = Graph(spark, store=store, clock=clock), Graph(spark, state=store.read(), clock=clock)
    pending = [r.id for r in plain.state.edges.where("pending").orderBy("seq").collect()]
    steps = [
        lambda g: g.remember("Barley grain is malted for beer", tags=["malt"], relations=[("beer", "extends")]),
        lambda g: g.remember("Sourdough bread rises slowly and keeps for days", source="other"),
        lambda g: g.recall("beer and bread", 2),
        lambda g: g.resolve(pending[0], False),
        lambda g: g.link("island", "water", "extends"),
        lambda g: g.merge("bread", "bread2"),
        lambda g: g.forget("hops", "tried"),
        lambda g: g.recall("cheese", 1),
        lambda g: g.dream(dry_run=True),
    ]
    for number, step in enumerate(steps):
        assert step(kept) == step(plain), number
    assert same(kept.state, plain.state)
    assert [v["changed"] is None for v in store.history()] == [True] + [False] * 8
    # What a version holds grows with what it changes: one node and its edges here, of 13 nodes.
    second = store.history()[1]
    part = lambda name: spark.read.parquet(f"{store.path}/{second['folder']}/{name}")
    assert part("nodes").count() < 5 and part("vectors").count() == 1 and part("edges").count() == part("edges_ids").count() < 10
    assert store.read(1).nodes.count() == 13 and store.read(2).nodes.count() == 14 and store.read(5).edges.where(F.col("id") == pending[0]).first().rejected
    # Usage that is folded in stays on record, once.
    used = rows(kept.state.ledger)
    assert used and kept.dream()["recalls"] == len(used) == 2
    assert kept.state.ledger.isEmpty() and rows(store.processed().drop("version")) == used
    assert kept.dream()["recalls"] == 0 and store.processed().count() == 2


def test_a_row_of_changes_ends_in_a_whole_version(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(state, "COMPACT", 3)
    store = state.Store(spark, f"{tmp_path}/s")
    store.publish(state.demo(spark), "t", "first")
    g = Graph(spark, store=store, clock=clock)
    for edge in ("e00", "e01", "e02", "e03", "e04"):
        g.undo(edge)
        assert g.state.edges.where("pending").count() == 3 + int(edge[1:])
    assert [v["changed"] is None for v in store.history()] == [True, False, False, True, False, False]
    assert [store.read(v).edges.where("pending").count() for v in range(1, 7)] == [2, 3, 4, 5, 6, 7]
    assert store.read(None) and store.compact("t") == 7 and store.history()[-1]["changed"] is None and store.read().edges.where("pending").count() == 7


def test_null_and_repeated_ids(spark, tmp_path):
    edges = [(0, None, "a", "b"), (1, None, "x", "y"), (2, "e", "a", "b"), (3, "e", "x", "y"), (4, "f", "x", "y")]
    nodes = spark.createDataFrame([("a", "A", "active"), ("a", "A again", "active"), (None, "nobody", "active"), ("x", None, "active")], "id string, text string, status string")
    first = state.of_tables(nodes, spark.createDataFrame(edges, "seq long, id string, source string, target string"))
    store = state.Store(spark, f"{tmp_path}/s")
    store.publish(first, "t", "first")
    before = store.read()
    touches = F.col("source") == "a"
    after = before.with_(edges=before.edges.withColumn("to_s", F.when(touches, 7)), nodes=before.nodes.where("id is not null and not (text <=> 'A')"))
    store.publish_changes(before, after, {"edges": touches, "nodes": F.expr("id is null or text = 'A'")}, "t", "second")
    assert same(store.read(), after) and same(store.read(1), before)
    second = store.history()[1]
    assert spark.read.parquet(f"{store.path}/{second['folder']}/edges").count() == 4  # all rows of both ids
    third = after.with_(nodes=after.nodes.limit(0))
    store.publish_changes(store.read(), third, {"nodes": F.lit(True)}, "t", "third")
    assert store.read().nodes.isEmpty() and store.read(2).nodes.count() == 2


def test_of_two_writers_of_changes_one_is_refused(spark, tmp_path):
    one, two = state.Store(spark, f"{tmp_path}/s"), state.Store(spark, f"{tmp_path}/s")
    one.publish(state.demo(spark), "t", "first")
    a, b = one.read(), two.read()
    gone = lambda s, i: s.with_(nodes=s.nodes.where(F.col("id") != i))
    one.publish_changes(a, gone(a, "beer"), {"nodes": F.col("id") == "beer"}, "t", "one")
    with pytest.raises(state.Conflict):
        two.publish_changes(b, gone(b, "hops"), {"nodes": F.col("id") == "hops"}, "t", "two")
    again = two.read()
    two.publish_changes(again, gone(again, "hops"), {"nodes": F.col("id") == "hops"}, "t", "two")
    assert two.read().nodes.where("id in ('beer', 'hops')").isEmpty() and two.read().nodes.count() == 11
