"""Keywords by one automaton against plain loops, and stamps in a session of another zone."""

import random
import re

from pyspark.sql import functions as F

from knotwork.functions import matcher, text
from knotwork.operators import communities, hygiene


def test_areas_equal_plain_loops(spark, monkeypatch):
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abé_1", k=rng.randint(1, 3)))
    taxonomy = [(f"area{i % 7}", " ".join(word() for _ in range(rng.randint(1, 2)))) for i in range(60)] + [("area1", None), ("area1", ""), ("odd", "\\Ea.b")]
    nodes = [(f"n{i}", " ".join(word() for _ in range(rng.randint(0, 6))), "keep") for i in range(80)] + [("null", None, "keep"), ("odd", "x \\Ea.b y", "keep"), ("gone", "a b", "tombstone")]
    keywords, rows = spark.createDataFrame(taxonomy, "area string, keyword string"), spark.createDataFrame(nodes, "id string, text string, status string")
    whole = {(a, i) for a, k in taxonomy if k for i, t, s in nodes if s == "keep" and re.search(rf"(?<!\w){re.escape(k)}(?!\w)", t or "")}
    within = {(i, a) for a, k in taxonomy if k for i, t, _ in nodes if k in (t or "")}
    for block in (matcher.BLOCK, 9):
        monkeypatch.setattr(matcher, "BLOCK", block)
        assert sorted(map(tuple, hygiene.classified(rows, keywords).collect())) == sorted(whole)
        assert sorted(map(tuple, communities.areas_of(rows, keywords).collect())) == sorted(within)


def test_ten_thousand_keywords_without_a_cartesian_product(spark):
    taxonomy = spark.range(10_000).select(F.concat(F.lit("area"), F.col("id") % 50).alias("area"), F.concat(F.lit("word"), "id").alias("keyword"))
    nodes = spark.range(300).select(F.concat(F.lit("n"), "id").alias("id"), F.concat(F.lit("some word"), F.col("id") * 31, F.lit(" here")).alias("text"), F.lit("keep").alias("status"))
    found = hygiene.classified(nodes, taxonomy)
    assert {(r.area, r.id) for r in found.collect()} == {(f"area{i * 31 % 50}", f"n{i}") for i in range(300)}
    assert not re.search("Cartesian|NestedLoop", found._jdf.queryExecution().toString())


def test_stamps_without_a_zone_are_in_utc(spark):
    stamps = ["2024-01-01T00:00:00", "2024-01-01", "2024-01-01T00:00:00Z", "2024-01-01 02:00:00+02:00", "2023-12-31T19:00:00-05:00", "no stamp", None]
    rows = spark.createDataFrame([(s,) for s in stamps], "s string")
    for zone in ("UTC", "America/New_York"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            found = rows.select(text.parsed(F.col("s"), F.lit(-1)).alias("at"), text.age_days(F.col("s"), 1704067200 + 86400).alias("age")).collect()
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
        assert [r["at"] for r in found] == [1704067200] * 5 + [-1, -1], zone
        assert [r["age"] for r in found] == [1.0] * 5 + [0.0, 0.0]
