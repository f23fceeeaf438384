"""Ingest, search, communities, reports, versions and the object that ties them together."""

import json
from datetime import datetime, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from knotwork import evals, report
from knotwork.api import Graph
from knotwork.functions import embedding, gate, intent
from knotwork.functions import text as T
from knotwork.operators import communities, graph, hygiene, ingest, search, transitions
from knotwork.sources import files, state

NOW = datetime(2024, 7, 1, tzinfo=timezone.utc)
NODES = "id string, text string, status string"
EDGES = "seq long, id string, source string, target string, kind string, pending boolean, rejected boolean, from_s long, to_s long, confidence double"


def nodes(spark, *texts, status="active"):
    return state.fitted(spark.createDataFrame([(f"n{i:02}", t, status) for i, t in enumerate(texts)], NODES), state.NODES)


def edges(spark, *rows):
    return state.fitted(spark.createDataFrame([(k, f"e{k}", a, b, kind, False, False, 0, None, None) for k, (a, b, kind) in enumerate(rows)], EDGES), state.EDGES)


def brute_hybrid(texts, query, k):
    """Both rankings whole, and their sum."""
    words = [(t or "").lower().split() for t in texts]
    q, n = query.lower().split(), len(texts)
    mean = sum(map(len, words)) / n
    bm = [sum(np.log(1 + (n - df + 0.5) / (df + 0.5)) * w.count(x) * 2.2 / (w.count(x) + 1.2 * (0.25 + 0.75 * len(w) / mean)) for x in q if (df := sum(x in v for v in words)) and x in w) for w in words]
    e = embedding.HashEmbedder()
    v = np.round(e.embed([embedding.normal_text(t) for t in texts]) @ e.embed([embedding.normal_text(query)])[0], 9)
    rank = lambda scores, rows: {i: r for r, i in enumerate(sorted(rows, key=lambda i: (-round(scores[i], 9), i)), 1)}
    lexical = rank(bm, [i for i in range(n) if bm[i] > 0])
    dense = rank(v, [i for i in range(n) if bm[i] > 0 or v[i] > 0])
    fused = {i: 1 / (60 + dense[i]) + (1 / (60 + lexical[i]) if i in lexical else 0) for i in dense}
    return sorted(((round(s, 9), i) for i, s in fused.items()), key=lambda x: (-x[0], x[1]))[:k]


def test_hybrid_equals_whole_rankings(spark):
    rng = np.random.default_rng(4)
    texts = [" ".join(rng.choice([f"w{i}" for i in range(60)], rng.integers(1, 12))) for _ in range(400)] + [None, "", texts_twice := "w1 w2 w3", texts_twice]
    n = spark.createDataFrame([(f"n{i:04}", t, "active") for i, t in enumerate(texts)] + [("gone", "w1 w2 w3", "tombstone")], NODES).repartition(5)
    asked = ["w1 w2 w3", "w5 w5 w9 absent", "w7", "nothing here", ""]
    queries = spark.createDataFrame(list(enumerate(asked)), "qid long, text string")
    for k in (1, 7):
        got = {}
        for r in search.hybrid(n, queries, k).orderBy("qid", "rank").collect():
            got.setdefault(r.qid, []).append((r.rrf, int(r.id[1:])))
        assert got == {q: want for q, text in enumerate(asked) if (want := brute_hybrid(texts, text, k))}
    assert search.hybrid(n, queries, 0).collect() == [] and search.bm25(n.limit(0), queries, 3).collect() == []


def test_rerank_usage_and_cache(spark):
    n = nodes(spark, "red apple", "green apple", "red car")
    q = spark.createDataFrame([(0, "Red  apple")], "qid int, text string")
    plain = [r.id for r in search.retrieve(n, q, 3).orderBy("rank").collect()]
    turned = search.retrieve(n, q, 3, reranker=search.reverse_order).orderBy("rank").collect()
    assert [r.id for r in turned] == plain[::-1] and [r.rank for r in turned] == [1, 2, 3]
    used = search.usage(search.retrieve(n, q, 2), q, "2024").first()
    assert used.ids == plain[:2] and used.q == spark.range(1).select(T.fingerprint(F.lit("red apple"))).first()[0]
    known = spark.createDataFrame([("n00", [1.0, 2.0]), ("other", [0.0])], "id string, vec array<double>")
    whole, fresh = embedding.vectors_for(n, known)
    assert {r.id: len(r.vec) for r in whole.collect()} == {"n00": 2, "n01": 64, "n02": 64} and fresh.count() == 2
    mixed = spark.createDataFrame([("a", [3.0, 4.0], 0), ("a", [0.0, 2.0], 1), ("b", [1.0], 2)], "id string, vec array<double>, seq long")
    assert {r.id: [round(x, 6) for x in r.vec] for r in embedding.dominant(mixed).collect()} == {"a": [0.0, 1.0]}


def ingested(spark, old, texts, **options):
    n = nodes(spark, *old)
    arrivals = spark.createDataFrame([(f"x{i}", i, t, "s") for i, t in enumerate(texts)], "id string, seq long, text string, source string")
    return ingest.ingest(n, edges(spark), embedding.vectors_of(n), arrivals, 5, "2024-07-01", **options)


def plain_ingest(old, texts, cap=3, floor=0.0, auto=False):
    """One text after another, against everything that is there by then; texts as they stood at the start."""
    e = embedding.HashEmbedder()
    embed = lambda t: e.embed([embedding.normal_text(t)])[0]
    known = {f"n{i:02}": (t, embed(t)) for i, t in enumerate(old)}
    notes = {i: [] for i in known}
    outcome, edges = {}, []
    for at, text in enumerate(texts):
        me, vec = f"x{at}", embed(text)
        scores = {i: round(float(vec @ v), 9) for i, (_, v) in known.items()}
        best = min(scores, key=lambda i: (-scores[i], i), default=None)
        if best is not None and scores[best] >= 0.92:
            outcome[me] = (best, True)
            continue
        outcome[me] = (me, False)
        left, mine = cap, []
        for other in sorted(i for i, s in scores.items() if s >= 0.45):
            if kind := intent.kind_of(text, known[other][0]):
                mine.append((me, other, kind, left <= 0, None, "intent"))
                left -= 1
        claimed = {other for _, other, *_ in mine}
        for other in sorted(scores, key=lambda i: (-scores[i], i))[:3]:
            if scores[other] >= max(0.45, floor) and other not in claimed:
                kind = "similar" if scores[other] >= 0.75 else "extends"
                mine.append((me, other, kind, scores[other] < 0.95 and not auto, scores[other], "suggester"))
                if kind == "similar" and not mine[-1][3]:
                    notes[other].append(f"[evolved 2024-07-01: connected to {me} “{embedding.normal_text(text)[:40]}…”]")
        edges += mine
        known[me], notes[me] = (text, vec), []
    return outcome, edges, {i: "\n\n".join([t, *notes[i][:5]]) for i, (t, _) in known.items()}


@pytest.mark.parametrize("options", [{}, {"cap": 1, "floor": 0.7}, {"auto_accept": True}])
def test_ingest_equals_one_by_one(spark, options):
    rng = np.random.default_rng(len(str(options)))
    words = ["scanner", "parser", "files", "reads", "replaces", "never", "false", "builds on", "extends", "is not", "cache", "the", "old", "new", "table", "rows", "instead of", "."]
    texts = [" ".join(rng.choice(words, rng.integers(2, 9))) for _ in range(70)]
    texts[50], texts[60], texts[61] = texts[3].upper(), texts[45], texts[45] + " "
    old, new = texts[:30], texts[30:]
    done = ingested(spark, old, new, **options)
    outcome, edges, notes = plain_ingest(old, new, options.get("cap", 3), options.get("floor", 0.0), options.get("auto_accept", False))
    assert {r.id: (r.node_id, r.duplicate) for r in done.outcome.collect()} == outcome and sum(d for _, d in outcome.values()) >= 3
    got = {(r.source, r.target, r.kind, r.pending, None if r.confidence is None else round(r.confidence, 6), r.origin) for r in done.new_edges.collect()}
    assert got == {(*e[:4], None if e[4] is None else round(e[4], 6), e[5]) for e in edges} and len(edges) > 40
    assert {r.id: r.text for r in done.nodes.collect()} == {i: t.strip() for i, t in notes.items()}


def test_ingest_duplicates_in_order(spark):
    done = ingested(spark, ["the cat sat on the mat", "a wholly different sentence"], ["The cat  sat on the mat", "new idea about boats", "NEW idea about boats", "birds fly south in winter"])
    assert {r.id: (r.node_id, r.duplicate) for r in done.outcome.collect()} == {"x0": ("n00", True), "x1": ("x1", False), "x2": ("x1", True), "x3": ("x3", False)}
    kept = {r.id: (r.status, r.sources) for r in done.nodes.collect()}
    assert kept["x1"] == ("probation", ["s"]) and kept["n00"][1] == [None, "s"] or kept["n00"][1] == ["s"]
    assert {r.id for r in done.vectors.collect()} == {"n00", "n01", "x1", "x3"}
    assert ingested(spark, ["same"], ["same"], allow_duplicates=True).nodes.count() == 2
    with pytest.raises(ValueError):
        ingested(spark, ["a"], [" "])


def test_ingest_edges_and_references(spark):
    old = [f"the scanner reads files number {i}" for i in range(5)]
    done = ingested(spark, old, ["the scanner replaces files number one"], relations=spark.createDataFrame([("x0", " THE scanner reads files number 4", "same_as"), ("x0", "nothing", "same_as")], "id string, ref string, kind string"))
    rows = done.new_edges.orderBy("seq").collect()
    meant = [(r.target, r.kind, r.pending) for r in rows if r.origin == "intent"]
    assert meant and all(kind == "supersedes" for _, kind, _ in meant) and [p for *_, p in meant] == [i >= 3 for i in range(len(meant))] and sorted(meant) == meant
    assert [(r.target, r.kind, r.pending) for r in rows if r.origin == "manual"] == [("n04", "same_as", False)]
    assert not {r.target for r in rows if r.origin == "suggester"} & {t for t, *_ in meant} and [r.seq for r in rows] == list(range(len(rows)))
    near = ingested(spark, ["one two three four five six seven"], ["one two three four five six eight"], auto_accept=True, allow_duplicates=True)
    (edge,) = near.new_edges.collect()
    assert (edge.kind, edge.pending, edge.origin) == ("similar", False, "suggester")
    text = near.nodes.where("id = 'n00'").first().text
    assert text.endswith("[evolved 2024-07-01: connected to x0 “one two three four five six eight…”]")
    full = ingested(spark, ["one two three four five six seven" + " [evolved x]" * 0 + "\n\n[evolved a]" * 5], ["one two three four five six seven"], auto_accept=True, allow_duplicates=True)
    assert full.nodes.where("id = 'n00'").first().text.count("[evolved") == 5
    assert ingested(spark, ["one two three"], ["one two four"], floor=0.99, allow_duplicates=True).new_edges.isEmpty()


def triangles(spark):
    names = "abcxyz"
    n = state.fitted(spark.createDataFrame([(i, f"text of {i} grün" if i < "c" else f"text {i}", "active") for i in names] + [("lone", None, "active"), ("dead", "x", "tombstone")], NODES), state.NODES)
    rows = [("a", "b"), ("b", "c"), ("a", "c"), ("x", "y"), ("y", "z"), ("x", "z"), ("b", "a"), ("a", "a"), ("a", "dead")]
    return n, edges(spark, *[(a, b, "similar") for a, b in rows])


def test_community_report(spark):
    n, e = triangles(spark)
    taxonomy = spark.createDataFrame([("colour", "Grün"), ("any", "text"), ("none", "zzz")], "area string, keyword string")
    found = communities.analyze(n, e, taxonomy, min_size=2, top=5)
    rows = {r.community: (r["size"], r.internal_edges, r.degree_sum, r.label, r.hub) for r in found.communities.collect()}
    assert rows == {0: (3, 3, 6, "any", "c"), 1: (3, 3, 6, "any", "z"), 2: (1, 0, 0, "UNCLASSIFIED", "lone")}
    gap = found.gaps.collect()
    assert [(g.a, g.b, g.observed, g.expected, g.deficit, g.bridge_nodes) for g in gap] == [(0, 1, 0, 3.0, 1.0, [])] and gap[0].a_samples == ["text of a grün", "text of b grün"]
    assert [r.id for r in found.isolated.collect()] == ["lone"] and found.unclassified.first().unclassified == 1
    assert found.modularity.first().q == pytest.approx(0.5) and found.gods.count() == 5
    kinds = [(r.kind, r.score) for r in communities.provider(found, min_size=2).collect()]
    assert kinds == [("community", 3.0), ("community", 3.0), ("hole", 1.0)]
    assert communities.gaps(n, communities.simple(n.where("status <> 'tombstone'"), e), found.labels, min_size=99).isEmpty()
    without = communities.analyze(n, e, min_size=2, exclude=spark.createDataFrame([("c",)], "id string"))
    assert {r["size"] for r in without.communities.collect()} == {1, 2, 3} and "C0" in report.render_communities(found, 2)


def test_neighbors_take_arguments(spark):
    n, e = triangles(spark)
    got = graph.neighbors(n, e, "a", 2).collect()
    assert [(r.id, r.hops, r.direction) for r in got] == [("b", 1, "out"), ("c", 1, "out")]
    assert graph.neighbors(n, e, "a", kinds=["extends"]).isEmpty() and graph.neighbors(n, e, "a", limit=1).count() == 1


def test_hygiene(spark):
    n, e = triangles(spark)
    assert hygiene.degree_percentiles(n, e).first().asDict() == {"p50": 2, "p90": 6, "p99": 6}
    taxonomy = spark.createDataFrame([("colour", "grün"), ("none", "gr")], "area string, keyword string")
    got = {r.area: (r.n, r.examples, r.unclassified) for r in hygiene.coverage(n, taxonomy).collect()}
    assert got == {"colour": (2, ["a", "b"], 5), "none": (0, [], 5)}
    assert [r.area for r in hygiene.thin_areas(hygiene.coverage(n, taxonomy), 2).collect()] == ["none"]
    levels = spark.createDataFrame([(50, 1.0), (0, 500.0), (50, 500.0), (9, 0.0)], "n int, age double")
    assert [r.level for r in levels.select(T.decay_level(F.col("n"), F.col("age")).alias("level")).collect()] == ["record", "tombstone", "tombstone", "summary"]


def test_recalls_fold_once_and_cap(spark):
    n = nodes(spark, "a", "b").withColumn("recall_queries", F.when(F.col("id") == "n00", F.array(F.lit("zz"))))
    rows = [(f"2024-01-{i:02}", f"q{i:02}", ["n00", "gone"]) for i in range(1, 31)] + [("2023", None, ["n01", "n01"])]
    got = {r.id: r for r in transitions.fold_recalls(n, spark.createDataFrame(rows, state.LEDGER)).collect()}
    assert got["n00"].recall_count == 30 and got["n00"].recall_queries == ["zz"] + [f"q{i:02}" for i in range(1, 25)] and got["n00"].last_recalled == "2024-01-30"
    assert got["n01"].recall_count == 2 and not got["n01"].recall_queries and got["n01"].last_recalled == "2023"


def test_lifecycle_leaves_summaries(spark):
    rows = [("a", "probation", 1), ("b", "stale", 1), ("c", "active", 0), ("d", "active", 0), ("s", "active", 0)]
    n = state.fitted(spark.createDataFrame([(i, i, s, k, 0) for i, s, k in rows], "id string, text string, status string, recall_count int, created_s long"), state.NODES)
    n = n.withColumn("tags", F.when(F.col("id") == "s", F.array(F.lit(transitions.SUMMARY))))
    e = edges(spark, ("a", "b", "similar"), ("a", "b", "extends"), *[("d", x, "similar") for x in "def"])
    plan = {r.id: (r.after, r.move) for r in transitions.lifecycle_plan(n, e, 31 * 86400).collect()}
    assert plan == {"a": ("active", "promote"), "b": ("active", "revive"), "c": ("stale", "decay")}
    assert {r.id: r.status for r in transitions.lifecycle(n, e, 31 * 86400).collect()} == {"a": "active", "b": "active", "c": "stale", "d": "active", "s": "active"}
    wrong = e.withColumns({"origin": F.lit("suggester"), "confidence": F.lit(0.8), "kind": F.lit("extends")})
    assert {r.kind for r in transitions.refresh(wrong).collect()} == {"similar"}


def test_graph_object(spark, tmp_path):
    store = state.Store(spark, f"{tmp_path}/store")
    heard: list = []
    g = Graph(spark, state=state.demo(spark), store=store, clock=lambda: NOW, listener=lambda event, answer: heard.append(event))
    assert g.status()["total"] == 13 and g.status()["edges"] == 19 and g.status()["pending_edges"] == 2 and g.status()["orphans"] == 1
    for call, kind in ((lambda: g.search(" "), "invalid_params"), (lambda: g.search("x" * 501), "invalid_params"), (lambda: g.search("x", 21), "invalid_params"), (lambda: g.get_node("none"), "node_not_found"),
                       (lambda: g.get_node("a/b"), "invalid_params"), (lambda: g.neighbors("bread", hops=3), "invalid_params"), (lambda: g.forget("bread", ""), "invalid_params"), (lambda: g.remember("")  , "invalid_params"), (lambda: g.get_node("bread", 99), "invalid_params")):
        answer = call()
        assert answer["ok"] is False and answer["error"]["code"] == kind
    assert g.search("sourdough bread")["results"][0]["id"] in ("bread", "bread2") and g.search("zzzz qqqq")["ok"]
    node = g.get_node("oven")
    assert node["degree"] == 3 and {x["direction"] for x in node["edges"]} == {"in", "out"} and node["node"]["text"].startswith("A stone")
    assert {r["id"] for r in g.neighbors("oven")["neighbors"]} == {"bread", "bread2", "mill"} and g.path("oven", "hops")["path"][-1] == "hops" and g.path("oven", "island")["path"] is None
    again = g.remember("sourdough BREAD rises slowly and keeps for days")
    assert again["duplicate"] and again["node_id"] == "bread"
    new = g.remember("Honey keeps for years", tags=["food"], relations=[("hops", "similar")])
    assert not new["duplicate"] and g.get_node(new["node_id"])["node"]["tags"] == ["food"]
    assert g.recall("honey years", 1)["results"][0]["id"] == new["node_id"] and g.dream()["recalls"] == 1
    assert g.get_node(new["node_id"])["node"]["status"] in ("active", "probation") and g.state.ledger.isEmpty()
    assert g.link("island", "water", "similar")["added"] and not g.link("island", "water", "similar")["added"]
    waiting = g.pending()["edges"][0]["id"]
    assert g.resolve(waiting, True)["ok"] and not g.resolve(waiting, True)["ok"] and g.undo(waiting)["ok"]
    assert g.forget("island", "off topic")["edges_invalidated"] == 1 and g.forget("island", "again")["already_forgotten"]
    assert g.merge("bread", "bread2")["ok"] and g.get_node("bread2")["node"]["status"] == "tombstone"
    assert store.read(1).nodes.count() == 13 and [h["version"] for h in store.history()] == list(range(1, len(store.history()) + 1))
    assert heard[0] == "ingested" and {"edge_linked", "edge_resolved", "edge_restored", "forgotten", "merged", "dreamt"} <= set(heard)
    assert Graph(spark, store=store).get_node(new["node_id"])["ok"]


def test_report(spark, tmp_path):
    g = state.demo(spark)
    found = report.data(g.nodes, g.edges, NOW, since="2024-06-30", top=0)
    assert found["nodes"] == 13 and found["deltas"]["nodes"] == 13 and found["kinds"]["extends"] == 12 and len(found["hubs"]) == 10
    shown = report.render(found)
    report.write_report(spark, f"{tmp_path}/r.md", found)
    report.write_report(spark, f"{tmp_path}/r.md", found)
    assert (tmp_path / "r.md").read_text() == shown and "## Hubs" in shown
    with pytest.raises(ValueError):
        state.write_text(spark, f"{tmp_path}/r.md", "")
    with pytest.raises(ValueError):
        report.parse_since("soon", NOW)
    assert report.parse_since("2024-06-01T00:00:00", NOW).isoformat() == "2024-06-01T00:00:00+00:00" and (NOW - report.parse_since(None, NOW)).days == 1
    plan = report.strategy([{"timed_out": True}, {"timed_out": True, "nodes_added": 5, "islands_found": 1, "true_merges": 3, "marker_words": ["b", "a"]}], {"x": 1, "y": 3}, {"x"})
    assert plan["batch_size"] == 3 and plan["topic_weights"] == {"x": 3.5, "y": 1.25} and len(plan["findings_rules"]) == 3 and plan["blocked_marker_words"] == ["a", "b"]
    report.write_strategy(spark, f"{tmp_path}/s.json", plan)
    assert json.loads((tmp_path / "s.json").read_text()) == plan


def test_more_files(spark, tmp_path):
    for i in range(8):
        report.append_metrics(spark, f"{tmp_path}/m", {"ts": str(i), "nodes_added": i})
    assert files.read_metrics(spark, f"{tmp_path}/m").count() == 6 and files.read_metrics(spark, f"{tmp_path}/m", None).count() == 8
    (tmp_path / "h").write_text('{"a": 1}\nbroken\n{"b": 2}\n')
    assert [r.value for r in files.read_history(spark, f"{tmp_path}/h").orderBy("seq").collect()] == ['{"a": 1}', '{"b": 2}']
    (tmp_path / "n").write_text('{"id": "a", "text": "t"}\n{"id": "b"}\n')
    (tmp_path / "e").write_text('{"id": "e", "source": "a", "target": "b", "kind": "k", "pending": true}\n')
    n, e = files.read_legacy(spark, f"{tmp_path}/n", f"{tmp_path}/e")
    assert [tuple(r) for r in n.collect()] == [("a", "t", 0.0)] and files.resolve_legacy(e, "e", False).isEmpty() and not files.resolve_legacy(e, "e", True).first().pending
    files.append_usage(spark.createDataFrame([("1", "q", ["a", ""]), ("2", "q", [])], state.LEDGER), f"{tmp_path}/l")
    assert [(r.ts, r.ids) for r in files.read_ledger(spark, f"{tmp_path}/l").collect()] == [("1", ["a"])]
    g = state.demo(spark)
    files.write_markdown(g.nodes.withColumn("created", F.lit("2024")), f"{tmp_path}/md")
    back = files.read_nodes(spark, f"{tmp_path}/md/*", "now")
    assert {(r.id, r.text) for r in back.collect()} == {(r.id, r.text) for r in g.nodes.collect()}
    state.write_index(g.nodes, f"{tmp_path}/index")
    assert spark.read.text(f"{tmp_path}/index").count() == 17
    (tmp_path / "t.json").write_text('{"area": "no list"}')
    with pytest.raises(ValueError):
        files.read_taxonomy(spark, f"{tmp_path}/t.json")


def test_marker_gate(spark):
    rows = spark.createDataFrame([(1, "Das ersetzt es"), (2, "ｋeine Zeit"), (3, "er stattet sie aus"), (4, "kеin Problem"), (5, "plain"), (6, None), (7, "BASIERT  auf"), (8, "basiert auf")], "n int, finding string")
    assert {(r.n, r.marker) for r in gate.marker_scan(rows).collect()} == {(1, "ersetzt"), (2, "keine"), (4, "kein"), (8, "basiert auf")}
    assert {r.n for r in gate.passed(rows).collect()} == {3, 5, 6, 7}


def test_stream_of_arrivals(spark, tmp_path):
    from knotwork.streaming import arrivals

    (tmp_path / "in").mkdir()
    store = state.Store(spark, f"{tmp_path}/store")
    clock = lambda: (5, "2024-07-01T00:00:00Z")
    lines = [{"ts": "1", "text": "the kettle boils fast"}, {"ts": "2", "text": "The  kettle boils fast", "source": "b"}, {"ts": "3", "text": "  "}]
    (tmp_path / "in/1.json").write_text("\n".join(map(json.dumps, lines)))
    assert arrivals.start(arrivals.read(spark, f"{tmp_path}/in"), store, f"{tmp_path}/ck", clock).awaitTermination(120)
    assert [(r.text, r.sources) for r in store.read().nodes.collect()] == [("the kettle boils fast", ["stream", "b"])]
    arrivals.take_in(store, clock)(spark.createDataFrame([("9", "again", "s")], arrivals.ARRIVAL), 0)  # that batch is known
    assert len(store.history()) == 1


def test_command_line(spark, tmp_path, capsys):
    from knotwork.__main__ import main

    def call(*words):
        code = main(["--store", f"{tmp_path}/s", *words])
        return code, capsys.readouterr().out

    assert call("status")[0] == 1 and call("demo")[0] == 0
    assert json.loads(call("search", "sourdough", "-k", "2")[1])["count"] == 2
    assert "## Hubs" in call("report")[1] and "modularity" in call("communities")[1] and "Comets" in call("list")[1]
    assert call("forget", "island", "off topic")[0] == 0 and len(json.loads(call("history")[1])["versions"]) == 2


CASES = [
    evals.Case("duplicate", ["The river floods in spring", "the RIVER floods in spring"], nodes=1),
    evals.Case("similar", ["A cat sleeps on the warm red sofa", "A cat sleeps on the warm blue sofa"], options={"auto_accept": True}, edges=[("A cat sleeps on the warm blue sofa", "A cat sleeps on the warm red sofa", "similar")], origins_least={"suggester": 1}),
    evals.Case("intent", ["The scanner reads the files of the project", "The parser replaces the scanner of the project files"], nodes=2, edges=[("The parser replaces the scanner of the project files", "The scanner reads the files of the project", "supersedes")], kinds_most={"supersedes": 3}),
    evals.Case("unrelated", ["Comets carry ice", "Bakers knead dough daily"], nodes=2, absent=[("Comets carry ice", "Bakers knead dough daily")], apart=[("Comets carry ice", "Bakers knead dough daily")], search={"comets ice": "Comets carry ice"}),
]


def test_end_states(spark):
    assert evals.run(spark, CASES) == {}
    assert evals.failures(evals.play(spark, CASES[0]), evals.Case("wrong", [], nodes=7, search={"river": "no such text"})) != []
