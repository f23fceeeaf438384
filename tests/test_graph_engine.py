"""The graph engine on hand-made graphs, and a sample of its queries against DuckDB."""

import json

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from knotwork import queries
from knotwork.functions import embedding, intent
from knotwork.functions import text as T
from knotwork.operators import graph, search, transitions, vectors
from knotwork.sources import files, state
from knotwork.streaming import recalls

SF = "/root/testdata/sf0.001"
NODES = "id string, text string, source string, lang string, ntype string, status string, created_s long"
EDGES = "seq long, id string, source string, target string, kind string, pending boolean, rejected boolean, from_s long, to_s long, confidence double"


def nodes(spark, *rows):
    return spark.createDataFrame([(i, t, "s", "en", "semantic", status, 0) for i, t, status in rows], NODES)


def edges(spark, *rows):
    return spark.createDataFrame([(k, f"e{k}", a, b, kind, pending, False, 0, None, 0.5) for k, (a, b, kind, pending) in enumerate(rows)], EDGES)


def pairs(spark, *rows):
    return spark.createDataFrame(list(rows), "a string, b string")


TRIANGLES = [("a", "b"), ("b", "c"), ("a", "c"), ("x", "y"), ("y", "z"), ("x", "z")]


def ids(spark, names):
    return spark.createDataFrame([(n,) for n in names], "id string")


def test_two_triangles(spark):
    found = graph.labels(ids(spark, "abcxyz"), pairs(spark, *TRIANGLES))
    assert {r.id: r.community for r in found.collect()} == dict(zip("abcxyz", [0, 0, 0, 1, 1, 1]))
    assert graph.modularity(pairs(spark, *TRIANGLES), found).first().q == pytest.approx(0.5)
    assert len({r.label for r in graph.synchronous_labels(pairs(spark, *TRIANGLES), 3).collect()}) == 2


def test_betweenness_of_path_and_star(spark):
    path = graph.betweenness(ids(spark, "abc"), pairs(spark, ("a", "b"), ("b", "c")))
    assert {r.id: r.betweenness for r in path.collect()} == {"a": 0, "b": 1, "c": 0}
    star = graph.betweenness(ids(spark, "habc"), pairs(spark, ("h", "a"), ("h", "b"), ("c", "h")))
    assert {r.id: r.betweenness for r in star.collect()} == {"h": 1, "a": 0, "b": 0, "c": 0}


def test_shortest_path(spark):
    g = pairs(spark, ("a", "b"), ("b", "d"), ("a", "c"), ("c", "d"), ("d", "e"))
    assert graph.shortest_path(g, "a", "e").first().path == ["a", "b", "d", "e"]
    assert graph.shortest_path(g, "a", "e", depth=2).collect() == []
    assert graph.shortest_path(g, "a", "nowhere").collect() == []


def test_vectors(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0, 0.0]), ("b", [0.8, 0.6, 0.0]), ("c", [0.0, 1.0, 0.0])], "id string, vec array<double>")
    assert [(r.a, r.b, round(r.score, 6)) for r in vectors.near_duplicates(v).collect()] == [("a", "b", 0.8)]
    assert {(r.source, r.target) for r in vectors.nearest(v, 1).collect()} == {("a", "b"), ("b", "a"), ("c", "b")}
    assert vectors.nearest(v, 0).collect() == []
    assert {(r.source, r.kind, r.pending) for r in vectors.suggest(v).where("score > 0.7").collect()} == {("a", "similar", True), ("b", "similar", True)}
    mixed = v.union(spark.createDataFrame([("d", [1.0])], v.schema))
    assert vectors.dominant_dimension(mixed).count() == 3


@pytest.mark.parametrize(
    "new, old, kind",
    [
        ("The parser replaces the scanner", "The scanner reads files", "supersedes"),
        ("The scanner is not reliable", "The scanner reads files", "contradicts"),
        ("The cache builds on the scanner", "The scanner reads files", "continues"),
        ("Der Mitarbeiter wird versetzt", "Der Mitarbeiter kommt", None),
        ("keine Zeit für das Review", "Das Review dauert", None),
        ("Das Treffen findet statt", "Das Treffen dauert", None),
        ("It never rains", "Stars shine", None),
    ],
)
def test_intent(spark, new, old, kind):
    assert intent.kind_of(new, old) == kind
    row = spark.createDataFrame([(new, old)], "new string, old string")
    both = intent.profiles(intent.profiles(row, "new", "a"), "old", "b")
    assert intent.with_kind(both, "a", "b").first().intent == kind


def test_text_functions(spark):
    row = spark.createDataFrame([("  Ähm\tÖl\n ", ["b", "a"])], "t string, ids array<string>")
    got = row.select(T.normalized(F.col("t")), T.umlaut_fold(F.lower("t")), T.snippet(F.col("t"), 3), T.summary_id(F.col("ids")), T.fingerprint(F.lit(" A  b "))).first()
    import hashlib

    assert got[0] == "ähm öl" and "aehm" in got[1] and got[2] == "Ähm…"
    assert got[3] == "c" + hashlib.sha1(b"a|b").hexdigest()[:11] and got[4] == hashlib.sha1(b"a b").hexdigest()[:10]
    levels = spark.range(1).select(*(T.degradation_level(F.lit(x)) for x in (0.7, 0.5, 0.3, 0.1))).first()
    assert list(levels) == ["record", "summary", "gist", "tombstone"]


def test_transitions(spark):
    n = nodes(spark, ("a", "one", "active"), ("b", "two", "active"), ("c", "three", "probation"))
    e = edges(spark, ("a", "b", "similar", True), ("b", "c", "supersedes", False), ("a", "c", "extends", False), ("c", "b", "similar", False))
    state = lambda d: {r.id: (r.pending, r.rejected, r.to_s) for r in d.collect()}
    assert state(transitions.resolve(e, "e0", True))["e0"] == (False, False, None)
    no = transitions.resolve(e, "e0", False)
    assert state(no)["e0"] == (False, True, None) and state(transitions.undo(no, "e0"))["e0"] == (True, False, None)
    n2, e2 = transitions.forget(n, e, "b", 99)
    assert {r.id for r in n2.where("status = 'tombstone'").collect()} == {"b"} and sum(r.to_s == 99 for r in e2.collect()) == 3
    assert state(transitions.undo(transitions.resolve(e, "e0", True), "e0"))["e0"] == (True, False, None)
    n3, e3 = transitions.merge(n, e, "a", "b", "2024-01-01", 99)
    # b's own statement stays where it was and is closed; a-c comes before c-b, which would be the same pair.
    assert {(r.id, r.source, r.target, r.to_s) for r in e3.collect()} == {("e1", "b", "c", 99), ("e2", "a", "c", None)}
    assert transitions.merge_counts(e, "a", "b").first().asDict() == {"edges_redirected": 2, "edges_removed": 2, "edges_invalidated": 1}
    after = {r.id: (r.text, r.status) for r in n3.collect()}
    assert after["a"] == ("one\n\n[consolidated from b on 2024-01-01: two]", "active") and after["b"][1] == "tombstone"
    for bad in (("a", "a"), ("a", "nobody")):
        with pytest.raises(ValueError):
            transitions.merge(n, e, *bad, "2024-01-01", 99)
    assert transitions.link(n, e, "a", "c", "extends", 5).count() == 4 and transitions.link(n, e, "c", "a", "extends", 5).count() == 5
    with pytest.raises(ValueError):
        transitions.link(n, e, "a", "nobody", "extends", 5)


def test_review_cap_and_consolidation(spark):
    e = edges(spark, *[("a", x, "contradicts", k > 0) for k, x in enumerate("bcdef")], ("a", "g", "similar", True))
    accepted = {r.id for r in transitions.accept_pending(e).where("not pending").collect()}
    assert accepted == {"e0", "e1", "e2", "e5"}
    n = nodes(spark, ("a", "Same  text", "active"), ("b", "same text", "probation"), ("c", "new", "probation"), ("d", "NEW", "probation"))
    assert {r.id: r.status for r in transitions.consolidate(n).collect()} == {"a": "active", "b": "tombstone", "c": "active", "d": "tombstone"}
    related = edges(spark, ("c", "z", "similar", True))
    assert {r.id: r.status for r in transitions.consolidate(n, admitted_by=related).collect()} == {"a": "active", "b": "tombstone", "c": "active", "d": "tombstone"}
    assert {r.id: r.status for r in transitions.consolidate(n, admitted_by=related.limit(0)).collect()}["c"] == "probation"
    assert transitions.demote_forgotten(n, F.lit("tombstone")).where("status = 'tombstone'").count() == 1
    big = spark.createDataFrame([(f"n{i:02}", 0) for i in range(12)] + [("m", 1)], "id string, community int")
    assert [r.size for r in transitions.distill(n, big).collect()] == [12]


def test_consolidation_by_nearest_node(spark):
    """Near copies are duplicates too; a node's duplicate counts only while it is no tombstone."""
    import random

    import numpy as np

    rng = random.Random(3)
    rows, vecs = [], []
    for i in range(120):
        base = rng.choice(vecs)[1] if vecs and rng.random() < 0.8 else [rng.gauss(0, 1) for _ in range(8)]
        vecs.append((f"n{i:03}", [x + rng.gauss(0, 0.08) for x in base]))
        rows.append((f"n{i:03}", f"text {i}", f"s{i % 5}", "en", "semantic", rng.choice(["probation"] * 6 + ["active", "tombstone"]), 0))
    order = rng.sample(range(120), 120)
    names = [f"n{i:03}" for i in order]  # so that chains run in both directions
    rows, vecs = [(n, *r[1:]) for n, r in zip(names, rows)], [(n, v) for n, (_, v) in zip(names, vecs)]
    status, source, sources = {r[0]: r[5] for r in rows}, {r[0]: r[2] for r in rows}, {}
    vec = {n: np.array(v) / np.linalg.norm(v) for n, v in vecs}
    for n in sorted(status):
        if status[n] == "probation":
            best = max((m for m in sorted(vec) if m != n), key=lambda m: vec[n] @ vec[m])
            if vec[n] @ vec[best] >= 0.92 and status[best] != "tombstone":
                status[n] = "tombstone"
                held = sources.setdefault(best, [source[best]])
                held += [source[n]] * (source[n] not in held)
            else:
                status[n] = "active"
    got = transitions.consolidate(spark.createDataFrame(rows, NODES), spark.createDataFrame(vecs, "id string, vec array<double>")).collect()
    assert {r.id: r.status for r in got} == status and {r.id: r.sources for r in got if r.sources} == sources
    assert len({r[5] for r in rows}) == 3 and len(sources) > 5


def test_distillation_names_and_links_the_strongest(spark):
    members = [f"n{i:02}" for i in range(12)]
    groups = spark.createDataFrame([(m, 0) for m in members], "id string, community int")
    e = edges(spark, *[("n11", m, "extends", False) for m in members[:4]], ("n10", "n03", "similar", False), *[("n09", m, "similar", True) for m in members[:5]])
    n = nodes(spark, *[(m, m, "active") for m in members])
    made = transitions.distill(n, groups, edges=e)
    lines = made.first().digest.split("\n")
    assert lines[0].startswith("Community abstraction (12 nodes, dominant area: UNCLASSIFIED)") and lines[1] == "Edge mix inside the community: similar 6, extends 4."
    assert lines[3:8] == ["- n11", "- n03", "- n00", "- n01", "- n02"]
    assert transitions.distill(n, groups, edges=e, summarizer=F.upper).first().digest.startswith("COMMUNITY") and transitions.distill(n, groups, edges=e, limit=0).isEmpty()
    known = n.unionByName(spark.createDataFrame([(made.first().id, "summary", "c", "en", "semantic", "active", 0)], NODES))
    assert transitions.distill(known, groups, edges=e).isEmpty()
    links = transitions.summary_edges(made, groups, e).collect()
    assert {(r.source, r.target, r.kind, r.pending) for r in links} == {(made.first().id, m, "extends", False) for m in ("n11", "n03", "n00", "n01", "n02")}


def test_files(spark, tmp_path):
    (tmp_path / "n").mkdir()
    (tmp_path / "n/a.md").write_text("---\nid: a\nstatus: odd\ntags: [x, y]\nrecalls: 2\n---\nBody\nmore\n")
    (tmp_path / "n/b.md").write_text("no head")
    row = files.read_nodes(spark, f"{tmp_path}/n", "now").collect()
    assert [(r.id, r.status, r.tags, r.recall_count, r.created, r.text) for r in row] == [("a", "probation", ["x", "y"], 2, "now", "Body\nmore")]
    assert "recalls: 2" in files.to_markdown(files.read_nodes(spark, f"{tmp_path}/n", "now")).first().value
    used = spark.createDataFrame([("a", "A text", 3, ["f1", "f2"], "2024-05-01T00:00:00Z"), ("b", "B", 0, ["f3"], "2024"), ("c", "C", 1, None, None)], "id string, text string, recall_count int, recall_queries array<string>, last_recalled string")
    whole = state.fitted(used, state.NODES).withColumn("created", F.lit("2024")).withColumns({c: F.array().cast("array<string>") for c in ("sources", "tags")}).fillna("human", ["source"]).fillna("semantic", ["ntype"]).fillna("active", ["status"])
    files.write_markdown(whole, f"{tmp_path}/used")
    back = {r.id: (r.recall_count, r.recall_queries, r.last_recalled) for r in files.read_nodes(spark, f"{tmp_path}/used/*", "now").collect()}
    assert back == {"a": (3, ["f1", "f2"], "2024-05-01T00:00:00Z"), "b": (0, [], None), "c": (1, [], None)}
    (tmp_path / "e.jsonl").write_text('{"id":"e","source":"a","target":"b","kind":"similar"}\nbroken\n{"id":"f","source":"a","target":"b","kind":"x","rejected":true}\n')
    assert [(r.id, r.pending, r.valid_from) for r in files.read_edges(spark, f"{tmp_path}/e.jsonl", "now").collect()] == [("e", False, "now")]
    (tmp_path / "v.jsonl").write_text('{"id":"a","vec":[1,2]}\n{"id":"a","vec":[3,4]}\n')
    assert files.read_vectors(spark, f"{tmp_path}/v.jsonl").first().vec == [3.0, 4.0]
    (tmp_path / "t.json").write_text(json.dumps({"area": ["k1", "k2"]}))
    assert {(r.area, r.keyword) for r in files.read_taxonomy(spark, f"{tmp_path}/t.json").collect()} == {("area", "k1"), ("area", "k2")}
    (tmp_path / "f.txt").write_text("src\tfinding one\nfinding two\nother\tfinding one\n\n")
    assert {(r.source, r.finding) for r in files.collect_findings(spark, f"{tmp_path}/f.txt").collect()} == {("src", "finding one"), ("unknown", "finding two")}


def test_stream_of_recalls(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lines = [{"ts": f"2024-01-01T00:0{i}:00Z", "q": "q", "ids": ["a", "b"][: 1 + i % 2]} for i in range(4)]
    (tmp_path / "in/1.json").write_text("\n".join(map(json.dumps, lines)))
    seen: list = []
    query = recalls.fold_batches(recalls.ledger(spark, f"{tmp_path}/in"), lambda d, _: seen.extend(d.groupBy("id").count().collect()), f"{tmp_path}/ck")
    query.awaitTermination(120)
    assert {r.id: r["count"] for r in seen} == {"a": 4, "b": 2}
    table = spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:10:00"), ("a", "2024-01-02 00:00:00")], "id string, t string").select("id", F.to_timestamp("t").alias("ts"))
    assert sorted(r.n for r in recalls.windowed(table).collect()) == [1, 2] and sorted(r.n for r in recalls.sessions(table).collect()) == [1, 2]


def written(spark, folder, docs, benchmark=(), labels=()):
    """A folder with tables of these documents (doc_id, text), benchmark texts (item_id, text) and labels."""
    for name, rows, schema in (
        ("documents", [(i, t, "en", "s") for i, t in docs], "doc_id long, text string, lang string, source string"),
        ("benchmark", list(benchmark), "item_id long, text string"),
        ("labels", list(labels), "doc_id long, quality int, toxic int"),
    ):
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def both_engines(spark, folder, name):
    """The query's rows, which Spark and DuckDB must share."""
    db = duckdb.connect()
    for table in ("documents", "benchmark", "labels"):
        db.sql(f"create view {table} as select * from '{folder}/{table}.parquet/*.parquet'")
    got = queries.QUERIES[name](spark, folder)
    rows = sorted(map(tuple, got.collect()))
    assert rows == sorted(db.sql(f"select {', '.join(got.columns)} from ({queries.ORACLES[name]})").fetchall())
    return rows


def test_search_uses_every_word(spark, tmp_path):
    import math

    docs = [(i, t) for i, t in enumerate(["nine ten ten", "one two three", "other words here", "eleven"])]
    where = written(spark, tmp_path, docs, [(7, "one two three four five six seven eight nine ten eleven ten")])
    texts = [t.split() for _, t in docs]
    mean = sum(map(len, texts)) / len(texts)
    query, want = "one two three four five six seven eight nine ten eleven ten".split(), {}
    for i, words in enumerate(texts):
        for q in query:
            df, tf = sum(q in w for w in texts), words.count(q)
            if tf:
                want[i] = want.get(i, 0) + math.log(1 + (len(texts) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(words) / mean))
    got = both_engines(spark, where, "bm25_topk")
    assert {r[2]: r[3] for r in got} == {f"d{i:08}": pytest.approx(x, abs=1e-5) for i, x in want.items()} and len(want) == 3
    assert {r[2] for r in both_engines(spark, where, "hybrid_search")} >= {"d00000000", "d00000003"}


def test_find_by_text_compares_whole_texts(spark):
    long = "a text that is much longer than forty characters, "
    texts = [(1, long + "with one end"), (2, long + "with\n ANOTHER  end "), (3, long + "with another end [evolved]"), (4, "100% of it"), (5, "short"), (6, "shortest"), (7, None)]
    wanted = [(1, long + "with another end"), (2, long + "with no end"), (3, "100_ of it"), (4, "shor"), (5, "Short"), (6, long + "with one"), (7, " "), (8, None)]
    refs = spark.createDataFrame(wanted, "qid long, text string")
    got = search.find_by_text(nodes(spark, *[(str(i), t, "active") for i, t in texts]), refs)
    assert sorted(map(tuple, got.collect())) == [(1, "2", True), (4, "5", False), (5, "5", True), (6, "1", False)]


def test_link_check_takes_every_edge(spark, monkeypatch):
    rows = [(900, "a", "b", "extends", False, None), (901, "a", "b", "extends", False, None), (902, "b", "c", "similar", False, None), (3, "c", "d", "extends", True, None), (904, "d", "a", "extends", False, 9)]
    made = spark.createDataFrame([(k, f"e{k}", s, t, kind, False, no, 0, to, None) for k, s, t, kind, no, to in rows], EDGES)
    monkeypatch.setitem(queries.tables.VIEWS, "edges", lambda *_: made)
    got = [tuple(r) for r in queries.QUERIES["link_check"](spark, SF).collect()]
    assert sorted(got) == [("a", "b", 2), ("b", "c", 0), ("c", "d", 0), ("d", "a", 0)]


def test_coverage_by_word_boundary(spark, tmp_path, monkeypatch):
    import re

    taxonomy = [("a", "that"), ("a", "der"), ("b", "two words"), ("b", "gruen"), ("c", "a.b"), ("d", "absent")]
    monkeypatch.setattr(queries.tables, "TAXONOMY", taxonomy)
    texts = ["that, is", "(the other) of (that)", "thatch", "_that", "ändern der", "wunder", "these two words.", "two  words", "GRÜN!", "axb", "a.b", "nothing", "that"]
    where = written(spark, tmp_path, list(enumerate(texts)), labels=[(12, 0, 1)])
    folded = [t.lower().replace("ä", "ae").replace("ü", "ue") for t in texts[:12]]
    hits = {area: [f"d{i:08}" for i, t in enumerate(folded) if any(re.search(rf"\b{re.escape(k)}\b", t) for x, k in taxonomy if x == area)] for area, _ in taxonomy}
    missed = 12 - len(set().union(*hits.values()))
    got = {r.area: (r.n, r.first_example, r.unclassified) for r in queries.QUERIES["coverage"](spark, where).collect()}
    assert got == {a: (len(h), min(h, default=None), missed) for a, h in hits.items()} and got["a"][0] == 3 and missed == 6
    assert {r.area: r.n for r in queries.QUERIES["coverage_gaps"](spark, where).collect()} == {a: len(h) for a, h in hits.items()}


@pytest.mark.parametrize("name", ["hybrid_search", "connectivity", "degree_pct", "neighbors_2hop", "lifecycle", "accept_pending", "near_dup", "dream_plan", "recall_fold_state", "origin_minimum"])
def test_query_equals_duckdb(spark, name):
    db = duckdb.connect()
    for table in ("documents", "labels", "orders", "events", "benchmark", "conversations"):
        db.sql(f"create view {table} as select * from '{SF}/{table}.parquet'")
    want, got = db.sql(queries.ORACLES[name]).df(), queries.QUERIES[name](spark, SF).toPandas()
    assert sorted(want.columns) == sorted(got.columns)
    columns = sorted(want.columns)
    rows = lambda d: sorted(d[columns].astype(str).itertuples(index=False, name=None))
    assert rows(want) == rows(got)


def test_vectors_in_blocks_and_tiles_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 70)
    monkeypatch.setattr(vectors, "TILE", 8)
    rng = np.random.default_rng(7)
    rows = np.repeat(rng.integers(-3, 4, (150, 6)), 2, axis=0)[:280].astype(float)  # copies, and many equal cosines
    names = [f"v{i:03d}" for i in rng.permutation(len(rows))]
    v = spark.createDataFrame([(n, r.tolist()) for n, r in zip(names, rows)], "id string, vec array<double>")
    unit = rows / np.maximum(np.sqrt((rows * rows).sum(axis=1)), 1e-300)[:, None]
    cos = np.round(unit @ unit.T, 9)
    pairs = {tuple(sorted((names[i], names[j]))) for i in range(len(rows)) for j in range(i) if 0.7801 <= cos[i, j] < 0.92}
    assert {(r.a, r.b) for r in vectors.near_duplicates(v, 0.7801, 0.92).collect()} == pairs
    assert vectors.near_counts(v, 0.7801, 0.92).agg(F.sum("pairs")).first()[0] == len(pairs) > 100
    for k, low in ((1, 0.92), (3, -np.inf), (2, 0.5)):
        best = {(names[i], names[j]) for i in range(len(rows)) for j in sorted((j for j in range(len(rows)) if j != i and cos[i, j] >= low), key=lambda j: (-cos[i, j], names[j]))[:k]}  # noqa: B023
        assert {(r.source, r.target) for r in vectors.nearest(v, k, low).collect()} == best
    assert "Exchange" not in vectors._crossed(vectors._packed(v), True)._jdf.queryExecution().executedPlan().toString()  # a pair of blocks copies no rows


def test_find_by_text_pairs_no_common_beginnings(spark):
    """Refs and texts that share a beginning of a power of two of characters meet by whole refs only."""
    texts = [(f"n{i:03d}", f"a common head {i:03d} and its tail{'s' * (i % 3)}") for i in range(300)]
    nodes = spark.createDataFrame(texts, "id string, text string")
    refs = spark.createDataFrame([(i, f"A common  head {i:03d}") for i in range(300)] + [(900, "a common head 00"), (901, texts[7][1]), (902, "a common head x")], "qid long, text string")
    found = search.find_by_text(nodes, refs)
    want = {i: (f"n{i:03d}", False) for i in range(300)} | {900: ("n000", False), 901: ("n007", True)}
    assert {r.qid: (r.id, r.exact) for r in found.collect()} == want
    assert "startswith" not in found._jdf.queryExecution().optimizedPlan().toString().lower()


def test_batches_are_read_in_slices(spark):
    rows = spark.range(1500).select(F.col("id").cast("string").alias("id"), F.lit("the parser replaces the scanner").alias("text")).coalesce(1)
    sizes = lambda it: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"]) for b in it)
    for made in (intent.profiles(rows), embedding.vectors_of(rows)):
        assert made.count() == 1500
    assert [b.num_rows for b in embedding.slices(pa.Table.from_pydict({"x": list(range(1500))}).to_batches())] == [512, 512, 476]
    assert max(r.n for r in rows.mapInArrow(lambda it: sizes(embedding.slices(it, 100)), "n long").collect()) == 100


def test_labels_send_no_table_to_the_driver(spark):
    seen, keep = [], graph.cut
    try:
        graph.cut = lambda rows: seen.append(rows._jdf.queryExecution().executedPlan().toString()) or keep(rows)
        graph.labels(ids(spark, "abcxyz"), pairs(spark, *TRIANGLES), part=2).collect()
    finally:
        graph.cut = keep
    assert sum("Join" in p for p in seen) > 2 and not any("BroadcastHashJoin" in p and "part_u" in p or "BroadcastHashJoin" in p and "before" in p for p in seen)
