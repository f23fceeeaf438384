"""Searches that read stored vectors, and versions of two writers."""

import pytest
from pyspark.sql import functions as F

from knotwork import api
from knotwork.functions.embedding import HashEmbedder, stored
from knotwork.operators import search
from knotwork.sources import state

TEXTS = [(f"n{i:02d}", f"{w} and {v}") for i, (w, v) in enumerate((w, v) for w in ("bread", "beer", "cheese") for v in ("water", "Rye  flour", "hops", "salt"))]


class Counting(HashEmbedder):
    """Counts the texts that are embedded, wherever that happens."""

    def __init__(self, spark):
        super().__init__()
        self.calls = spark.sparkContext.accumulator(0)

    def __getstate__(self):
        return super().__getstate__() | {"calls": self.calls}

    def embed(self, texts):
        self.calls.add(len(texts))
        return super().embed(texts)


@pytest.fixture
def nodes(spark):
    return spark.createDataFrame([*TEXTS, ("gone", "bread and water"), ("null", None)], "id string, text string").withColumn("status", F.expr("if(id = 'gone', 'tombstone', 'keep')"))


def test_a_search_over_stored_vectors_embeds_one_text(spark, nodes):
    queries = spark.createDataFrame([(1, "beer with rye flour")], "qid int, text string")
    table = spark.createDataFrame(stored(nodes)[0].collect(), "id string, key string, model string, vec array<double>")
    for find in (search.dense, search.hybrid, search.retrieve):
        counting = Counting(spark)
        plain, found = find(nodes, queries, 5).collect(), find(nodes, queries, 5, embedder=counting, vectors=table.withColumn("model", F.lit(counting.name))).collect()
        assert sorted(map(tuple, plain)) == sorted(map(tuple, found)) and found
        assert counting.calls.value == 1, find


def test_only_new_and_changed_texts_are_embedded(spark, nodes):
    first = spark.createDataFrame(stored(nodes)[0].collect(), "id string, key string, model string, vec array<double>")
    changed = nodes.where("id <> 'n03'").unionByName(spark.createDataFrame([("n03", "another text", "keep"), ("n99", "new", "keep"), ("n04", "beer and water", "keep")], nodes.schema)).where("not (id = 'n04' and text <> 'beer and water')")
    counting = Counting(spark)
    every, fresh = stored(changed, first, counting)
    assert sorted(r.id for r in fresh.collect()) == ["n03", "n99"]
    assert counting.calls.value == 2
    want = {r.id: tuple(r.vec) for r in stored(changed)[0].collect()}
    assert {r.id: tuple(r.vec) for r in every.collect()} == want
    other = first.withColumn("model", F.lit("another"))
    assert stored(changed, other)[1].count() == changed.count()
    # A stale vector is not used: the text of n03 has changed.
    queries = spark.createDataFrame([(1, "another text")], "qid int, text string")
    assert search.dense(changed, queries, 1, vectors=first).first().id == "n03"


def test_vectors_of_another_length_are_made_anew(spark, nodes):
    queries = spark.createDataFrame([(1, "bread and salt"), (2, None)], "qid int, text string")
    short = spark.createDataFrame([("n00", [1.0, 0.0]), ("n01", None)], "id string, vec array<double>")
    assert sorted(map(tuple, search.hybrid(nodes, queries, 4, vectors=short).collect())) == sorted(map(tuple, search.hybrid(nodes, queries, 4).collect()))


def test_two_writers_of_one_version_do_not_lose_an_update(spark, nodes, tmp_path):
    one, two = state.Store(spark, f"{tmp_path}/s"), state.Store(spark, f"{tmp_path}/s")
    made = state.of_tables(nodes, spark.createDataFrame([], state.EDGES))
    assert one.publish(made, "t1", "first") == 1
    a, b = one.read(), two.read()
    assert one.publish(a.with_(nodes=a.nodes.where("id < 'n05'")), "t2", "one") == 2
    with pytest.raises(state.Conflict):
        two.publish(b.with_(nodes=b.nodes.where("id >= 'n05'")), "t3", "two")
    assert [(v["version"], v["message"]) for v in two.history()] == [(1, "first"), (2, "one")]
    assert {r.id for r in two.read().nodes.collect()} == {"gone", "n00", "n01", "n02", "n03", "n04"}
    assert two.publish(two.read(), "t4", "two again") == 3 and one.read(1).nodes.count() == 14


def test_a_claimed_number_is_refused_even_when_the_log_was_read_before(spark, tmp_path):
    path = f"{tmp_path}/LOG/00000001.json"
    assert state.create_text(spark, path, "a\n") and not state.create_text(spark, path, "b\n")
    assert [r.value for r in spark.read.text(f"{tmp_path}/LOG").collect()] == ["a"]
