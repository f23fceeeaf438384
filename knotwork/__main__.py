"""``python -m knotwork --store FOLDER COMMAND ...``: the graph from a shell, with answers as JSON or text."""

from __future__ import annotations

import argparse
import json
import sys
from datetime import datetime, timezone


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="knotwork")
    p.add_argument("--store", required=True, help="folder of the graph's versions")
    c = p.add_subparsers(dest="command", required=True)
    for name, *words in (
        ("init",), ("demo",), ("status",), ("history",), ("list",), ("pending",), ("hygiene",), ("dream",), ("plan",), ("ingest", "text"), ("search", "query"), ("recall", "query"), ("get", "id"), ("neighbors", "id"),
        ("path", "a", "b"), ("accept", "edge"), ("reject", "edge"), ("undo", "edge"), ("link", "source", "target", "kind"), ("merge", "survivor", "deletee"), ("forget", "id", "reason"), ("communities",), ("report",), ("gaps", "taxonomy"),
    ):
        sub = c.add_parser(name)
        for word in words:
            sub.add_argument(word)
        if name in ("search", "recall"):
            sub.add_argument("-k", type=int, default=5)
        if name == "neighbors":
            sub.add_argument("--hops", type=int, default=1)
        if name == "ingest":
            sub.add_argument("--source", default="human")
            sub.add_argument("--tag", action="append")
        if name == "gaps":
            sub.add_argument("--threshold", type=int, default=10)
        if name == "report":
            sub.add_argument("--since")
            sub.add_argument("--top", type=int)
    return p


def run(spark, args) -> dict | str:
    from knotwork import report
    from knotwork.api import Graph
    from knotwork.operators import communities, hygiene, transitions, vectors
    from knotwork.sources import files, state

    store, now = state.Store(spark, args.store), datetime.now(timezone.utc)
    if args.command in ("init", "demo"):
        made = state.demo(spark, int(now.timestamp())) if args.command == "demo" else state.empty(spark)
        return {"ok": True, "version": store.publish(made, now.strftime("%Y-%m-%dT%H:%M:%SZ"), args.command)}
    if not store.history():
        from knotwork.api import failure

        return failure("store_missing", f"No graph found at {args.store!r}.")
    g = Graph(spark, store=store)
    nodes, edges = g.state.nodes, g.state.edges
    calls = {
        "status": g.status, "pending": g.pending, "dream": g.dream, "ingest": lambda: g.remember(args.text, args.tag, args.source), "search": lambda: g.search(args.query, args.k), "recall": lambda: g.recall(args.query, args.k),
        "get": lambda: g.get_node(args.id), "neighbors": lambda: g.neighbors(args.id, args.hops), "path": lambda: g.path(args.a, args.b), "accept": lambda: g.resolve(args.edge, True), "reject": lambda: g.resolve(args.edge, False),
        "undo": lambda: g.undo(args.edge), "link": lambda: g.link(args.source, args.target, args.kind), "merge": lambda: g.merge(args.survivor, args.deletee), "forget": lambda: g.forget(args.id, args.reason),
        "history": lambda: {"ok": True, "versions": store.history()}, "list": lambda: "\n".join(r.value for r in state.index_lines(nodes).orderBy("id").limit(1000).collect()),
        "hygiene": lambda: {"ok": True, **hygiene.connectivity(nodes, edges).first().asDict(), "near_duplicates": [list(r) for r in vectors.near_counts(g.state.vectors).orderBy("score", ascending=False).limit(50).collect()]},
        "communities": lambda: report.render_communities(communities.analyze(nodes, edges)),
        "report": lambda: report.render(report.data(nodes, edges, now, args.since, args.top, communities.provider(communities.analyze(nodes, edges, sample=200)))),
        "gaps": lambda: report.render_coverage([r.asDict() for r in hygiene.coverage(nodes, files.read_taxonomy(spark, args.taxonomy)).collect()], args.threshold),
        "plan": lambda: {"ok": True, **transitions.eligible(nodes, edges, vectors.near_counts(g.state.vectors), communities.analyze(nodes, edges).labels, int(now.timestamp())).first().asDict()},
    }
    return calls[args.command]()


def main(argv: list[str] | None = None) -> int:
    from pyspark.sql import SparkSession

    args = parser().parse_args(argv)
    answer = run(SparkSession.builder.appName("knotwork").getOrCreate(), args)
    print(answer if isinstance(answer, str) else json.dumps(answer, indent=2, ensure_ascii=False, default=str))
    return 0 if isinstance(answer, str) or answer.get("ok") else 1


if __name__ == "__main__":
    sys.exit(main())
