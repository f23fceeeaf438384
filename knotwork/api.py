"""The graph as an object: searches, lookups and writes with checked arguments and plain answers.

Every call answers with a dict, ``{"ok": True, ...}`` or ``{"ok": False, "error": {code, message, hint}}``.
Reads are one plan each, and what they bring to the driver is bounded by their arguments. Writes take the
state on to the next version of a ``Store``, or hold it in memory where there is none.
"""

from __future__ import annotations

import re
from collections import Counter
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.functions import text as T
from knotwork.functions.embedding import Embedder, vectors_for
from knotwork.operators import graph, search, transitions
from knotwork.operators import ingest as I
from knotwork.sources.cut import cut
from knotwork.sources.state import LEDGER, State, Store, fitted

#: Bounds of arguments and answers.
QUERY_CHARS, MOST_HITS, NODE_CHARS, LEAST_CHARS, MOST_CHARS, NEIGHBORS, MOST_NEIGHBORS, REMEMBER_CHARS, SNIPPET = 500, 20, 2000, 100, 8000, 20, 50, 20_000, 200
HINTS = {"node_not_found": "Search first to find node ids.", "store_missing": "Name a folder that holds a published state."}


class Refused(ValueError):
    """An argument out of its bounds."""


def failure(code: str, message: str, hint: str | None = None) -> dict:
    return {"ok": False, "error": {"code": code, "message": message, "hint": hint or HINTS.get(code)}}


#: What a listener hears, by call.
EVENTS = {"remember": "ingested", "resolve": "edge_resolved", "undo": "edge_restored", "link": "edge_linked", "merge": "merged", "forget": "forgotten", "dream": "dreamt"}


def _answer(call):
    """Turns refusals and missing nodes into answers, and tells the listener of writes."""

    def run(self, *args, **kwargs):
        try:
            answer = {"ok": True, **call(self, *args, **kwargs)}
            if call.__name__ in EVENTS:
                self.listener(EVENTS[call.__name__], answer)
            return answer
        except Refused as why:
            return failure("invalid_params", str(why))
        except LookupError as why:
            return failure("node_not_found", str(why.args[0]))

    run.__name__, run.__doc__ = call.__name__, call.__doc__
    return run


def text_in(value, name: str, most: int | None = None) -> str:
    out = (value or "").strip() if isinstance(value, str) or value is None else None
    if not out:
        raise Refused(f"{name} must be a non-empty string")
    if most is not None and len(out) > most:
        raise Refused(f"{name} exceeds {most} characters")
    return out


def whole_in(value, name: str, low: int, high: int) -> int:
    if not isinstance(value, int) or isinstance(value, bool) or not low <= value <= high:
        raise Refused(f"{name} must be an integer between {low} and {high}")
    return value


def node_id_in(value) -> str:
    """An id that can name a file: no slash, no leading dot, no NUL, 200 characters at most."""
    out = text_in(value, "id", 200)
    if re.search(r"[/\\\x00]", out) or out.startswith("."):
        raise Refused(f"invalid node id: {out!r}")
    return out


class Graph:
    def __init__(self, spark: SparkSession, state: State | None = None, store: Store | None = None, embedder: Embedder | None = None, reranker=None, clock=None, listener=None):
        self.spark, self.store, self.embedder, self.reranker = spark, store, embedder, reranker
        self.listener = listener or (lambda event, answer: None)  # hears of every write, as (event, answer)
        self.clock = clock or (lambda: datetime.now(timezone.utc))
        self.state = state if state is not None else (store or Store(spark, "")).read()

    # --- reads

    def _query(self, query: str) -> DataFrame:
        return self.spark.createDataFrame([(0, query)], "qid int, text string")

    def _hits(self, query: str, k: int) -> tuple[DataFrame, list[dict]]:
        found = search.retrieve(self.state.nodes, self._query(query), k, embedder=self.embedder, reranker=self.reranker, vectors=self.state.vectors)
        rows = found.join(self.state.nodes, "id").select("rank", "id", "rrf", T.cell(F.col("text"), SNIPPET).alias("snippet"), "status", "ntype", "tags", "created_s", "recall_count").orderBy("rank").collect()  # k rows
        return found, [{"id": r.id, "score": round(r.rrf, 4), "snippet": r.snippet, "status": r.status, "type": r.ntype, "tags": r.tags or [], "created_s": r.created_s, "recall_count": r.recall_count or 0} for r in rows]

    @_answer
    def search(self, query: str, k: int = 5) -> dict:
        """Hybrid search, which leaves no trace. Scores fuse ranks and are no similarities."""
        query, k = text_in(query, "query", QUERY_CHARS), whole_in(k, "k", 1, MOST_HITS)
        hits = self._hits(query, k)[1]
        hint = {} if hits else {"hint": f"No node matched. Try fewer or other words; there are {self.state.nodes.count()} nodes."}
        return {"query": query, "count": len(hits), "results": hits, **hint}

    def _node(self, node_id: str):
        found = self.state.nodes.where(F.col("id") == node_id).limit(1).collect()
        if not found:
            raise LookupError(f"No node with id {node_id!r}.")
        return found[0]

    @_answer
    def get_node(self, id: str, max_chars: int = NODE_CHARS) -> dict:
        """A node with its text, cut at ``max_chars``, and its live edges."""
        node_id, most = node_id_in(id), whole_in(max_chars, "max_chars", LEAST_CHARS, MOST_CHARS)
        node = self._node(node_id)
        other = F.when(F.col("source") == node_id, F.col("target")).otherwise(F.col("source"))
        mine = self.state.edges.where((F.col("source") == node_id) | (F.col("target") == node_id)).where("not rejected and to_s is null").withColumn("other", other)
        texts = self.state.nodes.select(F.col("id").alias("other"), T.cell(F.col("text"), 80).alias("other_snippet"))
        rows = mine.join(texts, "other", "left").orderBy("seq").collect()  # a node's edges are its answer
        edges = [{"id": r.id, "kind": r.kind, "direction": "out" if r.source == node_id else "in", "other_id": r.other, "other_snippet": r.other_snippet or "?", "pending": r.pending, "confidence": r.confidence, "from_s": r.from_s, "to_s": r.to_s} for r in rows]
        text = node.text or ""
        shown = {"id": node.id, "text": text[:most], "created_s": node.created_s, "source": node.source, "sources": node.sources or [], "type": node.ntype, "status": node.status, "tags": node.tags or []}
        return {"node": shown, "truncated": len(text) > most, "text_chars": len(text), "edges": edges, "degree": len(edges)}

    @_answer
    def neighbors(self, id: str, hops: int = 1, kinds: list[str] | None = None, include_pending: bool = False, limit: int = NEIGHBORS) -> dict:
        """What a node is connected to, over one or two live edges in either direction."""
        node_id, hops, limit = node_id_in(id), whole_in(hops, "hops", 1, 2), whole_in(limit, "limit", 1, MOST_NEIGHBORS)
        self._node(node_id)
        rows = graph.neighbors(self.state.nodes, self.state.edges, node_id, hops, kinds, include_pending, limit).withColumn("snippet", T.cell(F.coalesce("text", F.lit("?")), SNIPPET)).collect()
        found = [{"id": r.id, "snippet": r.snippet, "kind": r.kind, "direction": r.direction, "pending": r.pending, "confidence": r.confidence, "hops": r.hops} for r in rows]
        return {"id": node_id, "hops": hops, "count": len(found), "truncated": len(found) >= limit, "neighbors": found, "kinds_present": dict(Counter(r["kind"] for r in found))}

    @_answer
    def path(self, a: str, b: str, max_depth: int = 4) -> dict:
        """The shortest way between two nodes over live, accepted edges; None if there is none."""
        a, b = node_id_in(a), node_id_in(b)
        self._node(a), self._node(b)
        from knotwork.operators.communities import simple

        pairs = simple(self.state.nodes.where("status <> 'tombstone'"), self.state.edges, pending=False)
        found = graph.shortest_path(pairs, a, b, max_depth).collect()
        return {"path": found[0].path if found else None}

    @_answer
    def status(self) -> dict:
        """Sizes, connectivity and what waits for a decision."""
        from knotwork.operators import hygiene

        row = hygiene.connectivity(self.state.nodes, self.state.edges).first().asDict()
        counts = {r.status: r.n for r in hygiene.status_counts(self.state.nodes).collect()}
        pending = self.state.edges.where("pending and not rejected").count()
        return {**row, "mean_degree": round(row["mean_degree"] or 0.0, 2), "pending_edges": pending, "status": {s: counts.get(s, 0) for s in ("active", "probation", "stale", "tombstone")}}

    @_answer
    def pending(self, limit: int = MOST_NEIGHBORS) -> dict:
        """Suggested edges that wait for a decision, oldest first."""
        snippet = lambda c: self.state.nodes.select(F.col("id").alias(c), T.cell(F.col("text"), 60).alias(f"{c}_text"))
        rows = self.state.edges.where("pending and not rejected").join(snippet("source"), "source", "left").join(snippet("target"), "target", "left")
        return {"edges": [r.asDict() for r in rows.select("id", "kind", "source", "source_text", "target", "target_text", "confidence", "seq").orderBy("seq").limit(whole_in(limit, "limit", 1, 500)).drop("seq").collect()]}

    # --- writes

    def _now(self) -> tuple[int, str]:
        now = self.clock()
        return int(now.timestamp()), now.strftime("%Y-%m-%dT%H:%M:%SZ")

    def _keep(self, message: str, touched: dict | None = None, processed: DataFrame | None = None, **tables: DataFrame) -> None:
        """Publishes ``tables``: as changes of the rows that ``touched`` names (see ``Store``), else whole."""
        state = self.state.with_(**tables)
        if self.store is None or not self.store.path:
            self.state = state.with_(**{name: cut(rows) for name, rows in tables.items()})
            return
        if touched is not None:
            self.store.publish_changes(self.state, state, touched, self._now()[1], message)
        else:
            self.store.publish(state, self._now()[1], message, processed)
        self.state = self.store.read()

    @_answer
    def remember(self, text: str, tags: list[str] | None = None, source: str = "agent", relations: list[tuple[str, str]] | None = None, **options) -> dict:
        """Takes in one text; a near duplicate only adds the source to the node that has it."""
        text = text_in(text, "text", REMEMBER_CHARS)
        if tags is not None and not isinstance(tags, list):
            raise Refused("tags must be a list of strings")
        now_s, stamp = self._now()
        last = self.state.edges.agg(F.max("seq")).first()[0] or 0
        node_id = self.spark.range(1).select(F.substring(F.sha1(F.lit(f"{stamp}|{last}|{text}")), 1, 12)).first()[0]
        arrivals = self.spark.createDataFrame([(node_id, 0, text, source)], "id string, seq long, text string, source string")
        said = self.spark.createDataFrame([(node_id, ref, kind) for ref, kind in relations], "id string, ref string, kind string") if relations else None
        vectors, _ = vectors_for(self.state.nodes, self.state.vectors, self.embedder)
        done = I.ingest(self.state.nodes, self.state.edges, vectors, arrivals, now_s, stamp[:10], self.embedder, relations=said, relation_origin=source if source == "agent" else "manual", **options)
        out = done.outcome.first()
        nodes = done.nodes
        if tags and not out.duplicate:
            nodes = nodes.withColumn("tags", F.when(F.col("id") == node_id, F.array(*map(F.lit, tags))).otherwise(F.col("tags")))
        count = done.new_edges.count()
        self._keep(f"ingest{' dup of ' + out.node_id[:8] if out.duplicate else ''}: {text[:50]}", I.touched(done, self.state.nodes, self.state.vectors), nodes=nodes, edges=done.edges, vectors=done.vectors)
        hint = {"hint": "Near duplicate: merged into the node that has it."} if out.duplicate else {}
        return {"node_id": out.node_id, "status": self._node(out.node_id).status, "edges": count, "duplicate": out.duplicate, **hint}

    @_answer
    def recall(self, query: str, k: int = 5) -> dict:
        """A search that counts as use: what it finds goes to the ledger."""
        query, k = text_in(query, "query", QUERY_CHARS), whole_in(k, "k", 1, MOST_HITS)
        found, hits = self._hits(query, k)
        if hits:
            used = cut(fitted(search.usage(found, self._query(query), self._now()[1]), LEDGER))
            self._keep(f"recall: {query[:50]}", {"ledger": used}, ledger=self.state.ledger.unionByName(used))
        return {"query": query, "count": len(hits), "tracked": True, "results": hits}

    @_answer
    def forget(self, id: str, reason: str) -> dict:
        """Makes a node a tombstone and closes its live edges; nothing is deleted, and a second time changes nothing."""
        node_id, reason = node_id_in(id), text_in(reason, "reason")
        if self._node(node_id).status == "tombstone":
            return {"node_id": node_id, "status": "tombstone", "edges_invalidated": 0, "already_forgotten": True}
        now_s = self._now()[0]
        closed = transitions.live(self.state.edges).where((F.col("source") == node_id) | (F.col("target") == node_id)).count()
        nodes, edges = transitions.forget(self.state.nodes, self.state.edges, node_id, now_s)
        self._keep(f"forget: {node_id} - {reason}", {"nodes": F.col("id") == node_id, "edges": _ends(node_id)}, nodes=nodes, edges=edges)
        return {"node_id": node_id, "status": "tombstone", "edges_invalidated": closed, "already_forgotten": False}

    def _edge(self, edge_id: str, rows: DataFrame):
        found = rows.where(F.col("id") == edge_id).limit(1).collect()
        if not found:
            raise LookupError(f"No such edge to change: {edge_id!r}.")
        return found[0]

    @_answer
    def resolve(self, edge_id: str, accept: bool) -> dict:
        """Accepts or rejects a pending edge."""
        self._edge(edge_id, transitions.live(self.state.edges).where("pending"))
        self._keep(f"edge {'accept' if accept else 'reject'}: {edge_id}", {"edges": F.col("id") == edge_id}, edges=transitions.resolve(self.state.edges, edge_id, accept))
        return {"edge_id": edge_id, "accepted": accept}

    @_answer
    def undo(self, edge_id: str) -> dict:
        """Puts a settled edge back among the pending."""
        self._edge(edge_id, self.state.edges.where("not pending and to_s is null"))
        self._keep(f"edge undo: {edge_id}", {"edges": F.col("id") == edge_id}, edges=transitions.undo(self.state.edges, edge_id))
        return {"edge_id": edge_id}

    @_answer
    def link(self, source: str, target: str, kind: str) -> dict:
        """An accepted edge between two known nodes, unless a live one of that kind runs the same way."""
        source, target, kind = node_id_in(source), node_id_in(target), text_in(kind, "kind")
        if source == target:
            raise Refused("an edge joins two different nodes")
        self._node(source), self._node(target)
        before = self.state.edges
        after = transitions.link(self.state.nodes, before, source, target, kind, self._now()[0])
        if after is not before:
            self._keep(f"link: {source} {kind} {target}", {"edges": (F.col("source") == source) & (F.col("target") == target)}, edges=after)
        return {"source": source, "target": target, "kind": kind, "added": after is not before}

    @_answer
    def merge(self, survivor: str, deletee: str) -> dict:
        """One node takes over another, with its edges and its text."""
        survivor, deletee = node_id_in(survivor), node_id_in(deletee)
        if survivor == deletee:
            raise Refused("survivor and deletee are one node")
        self._node(survivor), self._node(deletee)
        now_s, stamp = self._now()
        counts = transitions.merge_counts(self.state.edges, survivor, deletee).first().asDict()
        nodes, edges = transitions.merge(self.state.nodes, self.state.edges, survivor, deletee, stamp, now_s)
        vectors, _ = vectors_for(nodes, self.state.vectors.where(~F.col("id").isin(survivor, deletee)), self.embedder)
        both, old = F.col("id").isin(survivor, deletee), self.state.edges
        gone = old.select("id", "seq").exceptAll(edges.select("id", "seq")).select("id")  # repeated pairs go everywhere
        ends = old.where(_ends(survivor, deletee)).select("id").unionByName(edges.where(_ends(survivor, deletee)).select("id"))
        new = self.state.nodes.where(both).select("id").unionByName(I.unmatched(self.state.nodes, self.state.vectors))
        self._keep(f"merge: {deletee} into {survivor}", {"nodes": both, "edges": gone.unionByName(ends), "vectors": new}, nodes=nodes, edges=edges, vectors=vectors.where(F.col("id") != deletee))
        return {"survivor": survivor, "deletee": deletee, **counts}

    @_answer
    def dream(self, dry_run: bool = False) -> dict:
        """Maintenance: kinds derived anew, the ledger folded in (emptied, and kept beside the version as ``processed``),
        promotion and decay. A dry run says what would happen."""
        now_s = self._now()[0]
        nodes = cut(transitions.fold_recalls(self.state.nodes, self.state.ledger))
        edges = cut(transitions.refresh(self.state.edges))
        moves = {r.move: r["count"] for r in transitions.lifecycle_plan(nodes, edges, now_s).groupBy("move").count().collect()}
        recalls = self.state.ledger.count()
        if not dry_run:
            self._keep("dream", processed=self.state.ledger, nodes=transitions.lifecycle(nodes, edges, now_s), edges=edges, ledger=self.state.ledger.limit(0))
        return {"recalls": recalls, "promoted": moves.get("promote", 0), "revived": moves.get("revive", 0), "staled": moves.get("decay", 0), "dry_run": dry_run}


def _ends(*node_ids: str) -> Column:
    return F.col("source").isin(*node_ids) | F.col("target").isin(*node_ids)
