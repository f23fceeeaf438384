"""The stored BM25 index against the search that reads every text."""

import random

import pytest
from pyspark.sql import functions as F

from knotwork.operators import search
from knotwork.operators.inverted import Index, _Block
from knotwork.sources.state import Conflict

NODE = "id string, text string, status string"
WORDS = [f"w{i}" for i in range(60)]


def texts(n, seed):
    rng = random.Random(seed)
    return [(f"n{i:04d}", " ".join(rng.choices(WORDS, [1 / (r + 1) for r in range(60)], k=rng.choice([0, 1, 5, 20, 80]))), "new") for i in range(n)]


def found(rows):
    return sorted((r.qid, r.rank, r.id, round(r.score, 8)) for r in rows.collect())


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame([(1, "w0 w1 w50 w50"), (2, "W3"), (3, ""), (4, None), (5, "absent w59"), (6, "w7 w0 nothing")], "qid int, text string")


def test_increments_replacements_and_removals_equal_a_whole_pass(spark, queries, tmp_path):
    rows = texts(400, 1)
    index = Index(spark, str(tmp_path / "index"), range_size=16)
    assert index.search(queries).collect() == []
    index.add(spark.createDataFrame(rows[:250] + [("gone", "w50 w59 w3", "new"), (None, "w50", "new")], NODE))
    index.add(spark.createDataFrame(rows[250:] + [(i, f"{t} w59", s) for i, t, s in rows[:20]] + [("gone", "w50", "tombstone"), ("never", "w50", "tombstone")], NODE))
    index.add(spark.createDataFrame([(i, None, s) for i, _, s in rows[20:30]], NODE))
    now = [(i, f"{t} w59", s) for i, t, s in rows[:20]] + [(i, None, s) for i, _, s in rows[20:30]] + rows[30:]
    want = found(search.bm25(spark.createDataFrame(now, NODE), queries, 7))
    assert found(index.search(queries, 7)) == want and len(want) > 20
    once = Index(spark, str(tmp_path / "once"), range_size=50)
    once.add(spark.createDataFrame(now, NODE))
    assert found(once.search(queries, 7)) == want
    index.compact()
    assert len(index.generations()) == 1
    assert found(index.search(queries, 7)) == want


def test_ranges_under_the_floor_are_skipped_and_only_asked_words_are_read(spark, tmp_path):
    index = Index(spark, str(tmp_path), range_size=16)
    rows = [(i, f"{t} rare" if n % 150 == 7 else t, s) for n, (i, t, s) in enumerate(texts(1500, 2))]
    index.add(spark.createDataFrame(rows, NODE))
    block = _Block(index, index.generations(), ["w0 rare"])
    _, every, later = block.ranges(3)
    assert later.count() + 3 < every.count() / 2  # ranges without the rare word can't reach the floor
    assert {r.word for r in block.lists.select("word").distinct().collect()} == {"w0", "rare"}
    plan = block.bounds()._jdf.queryExecution().executedPlan().toString()
    assert "list#" not in plan and "PartitionFilters" in plan and "bucket" in plan


def test_of_two_additions_to_one_generation_the_second_is_refused(spark, tmp_path):
    index, other = Index(spark, str(tmp_path)), Index(spark, str(tmp_path))
    seen = other.generations()
    index.add(spark.createDataFrame(texts(5, 3), NODE))
    other.generations = lambda: seen
    with pytest.raises(Conflict):
        other.add(spark.createDataFrame(texts(5, 4), NODE))
    assert [g["docs"] for g in index.generations()] == [5]


def test_an_empty_batch_and_a_repeated_id(spark, tmp_path):
    index = Index(spark, str(tmp_path))
    index.add(spark.createDataFrame([], NODE))
    index.add(spark.createDataFrame([("a", "x", "new"), ("a", "y", "new"), ("b", "y", "tombstone")], NODE).withColumn("word", F.lit("clash")))
    got = index.search(spark.createDataFrame([(1, "y")], "qid int, text string"))
    assert [(r.id, r.rank) for r in got.collect()] == [("a", 1)]


def test_lists_are_made_and_scored_where_ranges_are(spark, tmp_path):
    index = Index(spark, str(tmp_path), range_size=16)
    index.add(spark.createDataFrame(texts(300, 6), NODE))
    block = _Block(index, index.generations(), ["w0 w1 w2", "w0 w1", "w1 w2", "w0"])
    picked = block.bounds().select("q", "gen", "range")
    assert block.scores(picked, 2).groupBy("q").count().where("count > 2 * 60").isEmpty()  # a few of each range go on, not every hit
    best = {(r.q, r.id, r.score) for r in block.best(2).collect()}
    want = search.bm25(spark.createDataFrame(texts(300, 6), NODE), spark.createDataFrame([(0, "w0 w1 w2"), (1, "w0 w1"), (2, "w1 w2"), (3, "w0")], "qid int, text string"), 2)
    assert best == {(r.qid, r.id, r.score) for r in want.collect()} and len(best) == 8
