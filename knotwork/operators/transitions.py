"""State transitions as functions from tables to new tables.

Nodes and edges have the columns of ``sources.tables``; edges keep ``seq``, the order in
which they were made. Every time is passed in, so a transition can be repeated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from knotwork.functions import text as T
from knotwork.operators import vectors as V
from knotwork.sources.cut import cut

#: The cosine from which a node's nearest other one is its duplicate.
DUPLICATE = 0.92
INTENT = ("supersedes", "contradicts", "continues")


def live(edges: DataFrame, pending: bool = True) -> DataFrame:
    kept = edges.where("not rejected and to_s is null")
    return kept if pending else kept.where("not pending")


def resolve(edges: DataFrame, edge_id: str, accept: bool) -> DataFrame:
    """Settles one pending, valid edge; a rejected one keeps its row."""
    hit = (F.col("id") == edge_id) & F.col("pending") & F.col("to_s").isNull() & ~F.col("rejected")
    return edges.withColumns({"pending": F.when(hit, False).otherwise(F.col("pending")), "rejected": F.when(hit, not accept).otherwise(F.col("rejected"))})


def undo(edges: DataFrame, edge_id: str) -> DataFrame:
    """Puts a settled edge, accepted or rejected, back among the pending; an invalidated one stays."""
    hit = (F.col("id") == edge_id) & ~F.col("pending") & F.col("to_s").isNull()
    return edges.withColumns({"pending": F.when(hit, True).otherwise(F.col("pending")), "rejected": F.when(hit, False).otherwise(F.col("rejected"))})


def invalidate(edges: DataFrame, edge_id: str, now_s: int, by: str | None = None) -> DataFrame:
    """Closes an edge that is neither rejected nor closed; ``by`` names the edge that did it."""
    hit = (F.col("id") == edge_id) & F.col("to_s").isNull() & ~F.col("rejected")
    out = edges.withColumn("was_open", hit).withColumn("to_s", F.when(hit, F.lit(now_s)).otherwise(F.col("to_s")))
    if by is not None:
        known = F.col("invalidated_by") if "invalidated_by" in edges.columns else F.lit(None).cast("string")
        out = out.withColumn("invalidated_by", F.when(F.col("was_open"), by).otherwise(known))
    return out.drop("was_open")


def with_status(nodes: DataFrame, node_id: str, status: str) -> DataFrame:
    return nodes.withColumn("status", F.when(F.col("id") == node_id, status).otherwise(F.col("status")))


def promote(nodes: DataFrame, node_id: str) -> DataFrame:
    return with_status(nodes, node_id, "active")


def tombstone(nodes: DataFrame, node_id: str) -> DataFrame:
    return with_status(nodes, node_id, "tombstone")


def link(nodes: DataFrame, edges: DataFrame, source: str, target: str, kind: str, now_s: int) -> DataFrame:
    """Adds an accepted edge between two known nodes unless a live one of that kind runs the same way."""
    if source == target or nodes.where(F.col("id").isin(source, target)).select("id").distinct().count() < 2:
        raise ValueError("an edge joins two different known nodes")
    if not live(edges).where((F.col("source") == source) & (F.col("target") == target) & (F.col("kind") == kind)).isEmpty():
        return edges
    last = edges.agg(F.coalesce(F.max("seq"), F.lit(-1)) + 1).first()[0]
    row = {"seq": last, "id": f"e{last:09d}", "source": source, "target": target, "kind": kind, "pending": False, "rejected": False, "from_s": now_s, "origin": "manual"}
    one = edges.sparkSession.range(1)
    return edges.unionByName(one.select(*(F.lit(row.get(f.name)).cast(f.dataType).alias(f.name) for f in edges.schema)))


def forget(nodes: DataFrame, edges: DataFrame, node_id: str, now_s: int) -> tuple[DataFrame, DataFrame]:
    """Tombstones a node and closes its live edges; a second time changes nothing."""
    touches = ((F.col("source") == node_id) | (F.col("target") == node_id)) & F.col("to_s").isNull() & ~F.col("rejected")
    return (
        nodes.withColumn("status", F.when(F.col("id") == node_id, "tombstone").otherwise(F.col("status"))),
        edges.withColumn("to_s", F.when(touches, F.lit(now_s)).otherwise(F.col("to_s"))),
    )


#: Kinds whose statement is the source's own, so that another node can't take it over.
DIRECTIONAL = ("supersedes", "ersetzt", "contradicts", "replaces", "obsoletes", "korrigiert", "widerspricht")


def merged_edges(edges: DataFrame, survivor: str, deletee: str, now_s: int) -> DataFrame:
    """``edges`` once the survivor stands for the deletee. Directional edges from the deletee are closed where
    they are; other edges of it move; loops go, and so do later edges (by seq, whatever their kind) of an unordered
    pair. Rejected edges stay unless they touch the deletee."""
    touches = (F.col("source") == deletee) | (F.col("target") == deletee)
    moved = lambda c: F.when(F.col(c) == deletee, survivor).otherwise(F.col(c))
    stays = F.col("kind").isin(*DIRECTIONAL) & (F.col("source") == deletee)
    kept = edges.where(~F.col("rejected"))
    closed = kept.where(stays).withColumn("to_s", F.coalesce("to_s", F.lit(now_s)))
    redirected = kept.where(~stays).withColumns({"source": moved("source"), "target": moved("target")}).where("source <> target")
    first = F.row_number().over(Window.partitionBy(F.least("source", "target"), F.greatest("source", "target")).orderBy("seq"))
    return redirected.withColumn("rk", first).where("rk = 1").drop("rk").unionByName(closed).unionByName(edges.where(F.col("rejected") & ~touches))


def merge(nodes: DataFrame, edges: DataFrame, survivor: str, deletee: str, now: str, now_s: int) -> tuple[DataFrame, DataFrame]:
    """The survivor takes over the deletee's edges (``merged_edges``) and its text, with the date ``now``; the
    deletee becomes a tombstone. Both must be known."""
    if survivor == deletee:
        raise ValueError("survivor and deletee are one node")
    for wanted in (survivor, deletee):
        if nodes.where(F.col("id") == wanted).isEmpty():
            raise ValueError(f"node not found: {wanted}")
    gone = nodes.where(F.col("id") == deletee).select(F.col("text").alias("more")).limit(1)
    joined = nodes.join(F.broadcast(gone), F.col("id") == survivor, "left")  # one row
    note = F.concat(F.rtrim(F.coalesce("text", F.lit(""))), F.lit(f"\n\n[consolidated from {deletee} on {now}: "), F.trim("more"), F.lit("]"))
    text = F.when(F.col("more").isNotNull(), note).otherwise(F.col("text"))
    return tombstone(joined.withColumn("text", text).select(*nodes.columns), deletee), merged_edges(edges, survivor, deletee, now_s)


def merge_counts(edges: DataFrame, survivor: str, deletee: str) -> DataFrame:
    """One row of what a merge does: ends redirected, edges removed (loops, repeated pairs, directional ones
    that were closed before) and edges closed."""
    rows = edges.where(~F.col("rejected"))
    touches = (F.col("source") == deletee) | (F.col("target") == deletee)
    stays = F.col("kind").isin(*DIRECTIONAL) & (F.col("source") == deletee)
    ends = F.when(touches & ~stays, (F.col("source") == deletee).cast("int") + (F.col("target") == deletee).cast("int")).otherwise(0)
    before = rows.agg(F.sum(ends).alias("edges_redirected"), F.count(F.when(stays & F.col("to_s").isNull(), 1)).alias("edges_invalidated"), F.count("*").alias("n"), F.count(F.when(stays & F.col("to_s").isNotNull(), 1)).alias("closed"))
    after = merged_edges(rows, survivor, deletee, 0).agg(F.count("*").alias("left"))
    return before.crossJoin(after).select(F.coalesce("edges_redirected", F.lit(0)).cast("long").alias("edges_redirected"), (F.col("n") - F.col("left") + F.col("closed")).alias("edges_removed"), "edges_invalidated")  # one row each


def accept_pending(edges: DataFrame, cap: int = 3) -> DataFrame:
    """Accepts pending edges in id order; of the intent kinds, up to ``cap`` live ones a source."""
    intent = F.col("kind").isin(*INTENT)
    have = live(edges, pending=False).where(intent).groupBy("source").agg(F.count("*").alias("have"))
    queue = live(edges).where("pending")
    rank = F.row_number().over(Window.partitionBy("source", intent).orderBy("id"))
    decided = queue.join(have, "source", "left").withColumn("rk", rank).where(~intent | (F.coalesce("have", F.lit(0)) + F.col("rk") <= cap)).select("id").withColumn("taken", F.lit(True))
    out = edges.join(decided, "id", "left").withColumn("pending", F.when(F.col("taken"), False).otherwise(F.col("pending")))
    return out.select(*edges.columns)


def consolidate(nodes: DataFrame, vectors: DataFrame | None = None, admitted_by: DataFrame | None = None) -> DataFrame:
    """Settles each probation node, in id order. With ``vectors(id, vec)`` of all nodes, one whose nearest
    other node has a cosine of ``DUPLICATE`` or more and is no tombstone by then is tombstoned, and its source
    joins the other's ``sources``; the others are promoted, if ``admitted_by`` is given only those with an edge of it
    that is neither rejected nor closed. Without vectors, duplicates are only the nodes
    whose normalised text an earlier live node has."""
    if vectors is not None:
        return _admitted(nodes, _consolidate_near(nodes, vectors), admitted_by)
    key = Window.partitionBy(T.normalized(F.col("text")), F.col("status") == "tombstone").orderBy(F.when(F.col("status") == "probation", 1).otherwise(0), "id")
    ranked = nodes.withColumn("rk", F.row_number().over(key))
    status = F.when(F.col("status") != "probation", F.col("status")).when(F.col("rk") > 1, "tombstone").otherwise("active")
    return _admitted(nodes, ranked.withColumn("status", status).drop("rk"), admitted_by)


def _admitted(before: DataFrame, after: DataFrame, edges: DataFrame | None) -> DataFrame:
    if edges is None:
        return after
    known = live(edges).select(F.explode(F.array("source", "target")).alias("id")).distinct().withColumn("related", F.lit(True))
    was = before.select("id", (F.col("status") == "probation").alias("waited"))
    back = F.col("waited") & (F.col("status") == "active") & F.col("related").isNull()
    return after.join(was, "id").join(known, "id", "left").withColumn("status", F.when(back, "probation").otherwise(F.col("status"))).drop("waited", "related")


def _consolidate_near(nodes: DataFrame, vectors: DataFrame) -> DataFrame:
    old = nodes.select("id", "status")
    near = cut(V.nearest(vectors, 1, DUPLICATE, old.where("status = 'probation'")).select(F.col("source").alias("id"), F.col("target").alias("other")))
    has = near.select(F.col("id").alias("other"), F.lit(True).alias("waits"))
    facts = near.join(old.select(F.col("id").alias("other"), F.col("status").alias("was")), "other").join(has, "other", "left")
    # An earlier probation node with a duplicate of its own is settled first; the others are known at once.
    merged = F.when(F.col("was") == "tombstone", False).when((F.col("was") == "probation") & (F.col("other") < F.col("id")) & F.col("waits"), None).otherwise(True)
    # merged is null while it waits: it is then that of ``at``, the other way round if ``odd``.
    state = cut(facts.select("id", "other", merged.alias("merged"), F.col("other").alias("at"), F.lit(True).alias("odd")))
    while not state.where("merged is null").isEmpty():  # chains halve every round
        step = state.select(F.col("id").alias("at"), F.col("merged").alias("m"), F.col("at").alias("next"), F.col("odd").alias("o"))
        flip = F.col("odd") != F.col("o")
        waits = state.where("merged is null").join(step, "at").select("id", "other", (F.col("m") != F.col("odd")).alias("merged"), F.col("next").alias("at"), flip.alias("odd"))
        state = cut(state.where("merged is not null").unionByName(waits))
    gone = state.where("merged").select("id", "other")
    added = gone.join(nodes.select("id", "source"), "id").groupBy("other", "source").agg(F.min("id").alias("first")).groupBy("other").agg(F.sort_array(F.collect_list(F.struct("first", "source"))).alias("added"))
    out = nodes.join(gone.select("id", F.lit(True).alias("gone")), "id", "left").join(added.withColumnRenamed("other", "id"), "id", "left")
    status = F.when(F.col("status") != "probation", F.col("status")).when(F.col("gone"), "tombstone").otherwise("active")
    sources = F.when(F.col("added").isNotNull(), F.array_distinct(F.concat(F.array("source"), F.col("added.source"))))
    return out.withColumns({"status": status, "sources": sources}).drop("gone", "added")


def demote_forgotten(nodes: DataFrame, level) -> DataFrame:
    """Tombstones active nodes whose level, a column expression, is ``tombstone``."""
    return nodes.withColumn("status", F.when((F.col("status") == "active") & (level == "tombstone"), "tombstone").otherwise(F.col("status")))


SUMMARY = "community-summary"


def _summaries(nodes: DataFrame) -> DataFrame:
    """Ids of nodes that an earlier pass made."""
    if "tags" not in nodes.columns:
        return nodes.limit(0).select("id")
    return nodes.where(F.array_contains(F.coalesce("tags", F.array().cast("array<string>")), SUMMARY)).select("id")


def degrees(edges: DataFrame, pending: bool = True) -> DataFrame:
    """(id, degree) over live edges; a loop counts twice."""
    return live(edges, pending).select(F.explode(F.array("source", "target")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def lifecycle_plan(nodes: DataFrame, edges: DataFrame, now_s: int, min_recall: int = 1, min_degree: int = 2, stale_days: int = 30, max_degree: int = 2) -> DataFrame:
    """(id, before, after, move) of the nodes that a pass would promote, revive or let decay; ``nodes`` have
    recall_count and created_s. Summaries and tombstones are left alone."""
    facts = nodes.where("status <> 'tombstone'").join(_summaries(nodes), "id", "left_anti").join(degrees(edges, pending=False), "id", "left")
    used, degree = F.coalesce("recall_count", F.lit(0)), F.coalesce("degree", F.lit(0))
    age = F.coalesce((F.lit(now_s) - F.col("created_s")) / 86400.0, F.lit(0.0))
    ready = (used >= min_recall) & (degree >= min_degree)
    move = F.when((F.col("status") == "probation") & ready, "promote").when((F.col("status") == "stale") & ready, "revive")
    move = move.when(F.col("status").isin("probation", "active") & (used == 0) & (degree <= max_degree) & (age >= stale_days), "decay")
    return facts.select("id", F.col("status").alias("before"), F.when(move == "decay", "stale").otherwise("active").alias("after"), move.alias("move")).where("move is not null")


def lifecycle(nodes: DataFrame, edges: DataFrame, now_s: int, **gates) -> DataFrame:
    """``nodes`` after ``lifecycle_plan``; nothing is deleted."""
    plan = lifecycle_plan(nodes, edges, now_s, **gates).select("id", "after")
    return nodes.join(plan, "id", "left").withColumn("status", F.coalesce("after", "status")).select(*nodes.columns)


def mismatched(edges: DataFrame, pending: bool = True) -> DataFrame:
    """(id, kind, expected) of live suggested edges whose kind is not that of their confidence; a plan leaves
    ``pending`` ones out, the pass itself takes them in."""
    expected = F.when(F.col("confidence") >= V.SIMILAR, "similar").otherwise("extends")
    suggested = (F.col("origin") == "suggester") if "origin" in edges.columns else F.lit(True)
    return live(edges, pending).where(suggested & F.col("confidence").isNotNull() & F.col("kind").isin("extends", "similar")).select("id", "kind", expected.alias("expected")).where("kind <> expected")


def refresh(edges: DataFrame) -> DataFrame:
    """``edges`` with the kinds of suggested ones derived anew; manual edges stay."""
    new = mismatched(edges).select("id", "expected")
    return edges.join(new, "id", "left").withColumn("kind", F.coalesce("expected", "kind")).select(*edges.columns)


def fold_recalls(nodes: DataFrame, ledger: DataFrame, most: int = 25) -> DataFrame:
    """``nodes`` with the ledger rows ``(ts, q, ids)`` folded in: recall_count, the distinct fingerprints in
    recall_queries (new ones behind the old, in order, at most ``most``) and the last time. Ids that are no node count for nothing."""
    seen = ledger.select("ts", "q", F.explode("ids").alias("id"))
    found = seen.groupBy("id").agg(F.count("*").cast("int").alias("more"), F.max("ts").alias("last"))
    # A node has ``most`` old fingerprints at most, so no more than 2 * most of the smallest new ones can matter.
    rank = F.row_number().over(Window.partitionBy("id").orderBy("q"))
    few = seen.select("id", "q").where("q is not null").distinct().withColumn("rk", rank).where(F.col("rk") <= 2 * most)
    fresh = few.groupBy("id").agg(F.sort_array(F.collect_list("q")).alias("fresh"))
    joined = nodes.join(found, "id", "left").join(fresh, "id", "left")
    old = F.coalesce("recall_queries", F.array().cast("array<string>"))
    return joined.withColumns({
        "recall_count": F.coalesce("recall_count", F.lit(0)) + F.coalesce("more", F.lit(0)),
        "recall_queries": F.when(F.col("more").isNotNull(), F.slice(F.concat(old, F.array_except(F.coalesce("fresh", F.array().cast("array<string>")), old)), 1, most)).otherwise(F.col("recall_queries")),
        "last_recalled": F.greatest("last_recalled", "last"),
    }).select(*nodes.columns)


def distill(nodes: DataFrame, communities: DataFrame, least: int = 10, edges: DataFrame | None = None, limit: int = 10, labels: DataFrame | None = None, summarizer=None) -> DataFrame:
    """A summary (id, community, size, digest) of each of the first ``limit`` communities (by smallest member) of at least
    ``least`` members, unless its id is known: it is made from the members' ids. The digest names the size, the area
    (``labels(community, label)``), the kinds of edges that touch a member, and the strongest members' first lines; a
    ``summarizer``, a function of a column, may turn it into another text."""
    ids = communities.groupBy("community").agg(F.sort_array(F.collect_set("id")).alias("ids"))  # ids only: a summary's id is made of them
    chosen = ids.where(F.size("ids") >= least).orderBy(F.col("ids")[0]).limit(limit)
    made = chosen.select(T.summary_id(F.col("ids")).alias("id"), "community", F.size("ids").alias("size")).join(nodes.select("id"), "id", "left_anti")
    top = _strongest(communities, edges)
    given = nodes.select(F.col("id").alias("member"), F.substring(F.split("text", "\n")[0], 1, 90).alias("line")) if "text" in nodes.columns else top.select("member", F.lit(None).cast("string").alias("line"))
    heads = top.join(given, "member", "left").withColumn("title", F.coalesce("line", "member"))
    first = heads.groupBy("community").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rk", "title"))), lambda m: F.concat(F.lit("- "), m["title"])), "\n").alias("titles"))  # five rows
    out = made.join(first, "community")
    mix = _census(communities, edges) if edges is not None else out.select("community").withColumn("mix", F.lit("none yet"))
    area = labels.select("community", "label") if labels is not None else out.select("community").withColumn("label", F.lit("UNCLASSIFIED"))
    out = out.join(mix, "community", "left").join(area, "community", "left")
    head = F.concat(F.lit("Community abstraction ("), F.col("size"), F.lit(" nodes, dominant area: "), F.coalesce("label", F.lit("UNCLASSIFIED")), F.lit(")."))
    digest = F.concat_ws("\n", head, F.concat(F.lit("Edge mix inside the community: "), F.coalesce("mix", F.lit("none yet")), F.lit(".")), F.lit("Strongest members:"), F.col("titles"), F.lit("It stands for the community in searches and replaces none of its members."))
    return out.select("id", "community", "size", (summarizer(digest) if summarizer else digest).alias("digest"))


def _census(communities: DataFrame, edges: DataFrame) -> DataFrame:
    """(community, mix): the six most frequent kinds of all edges, rejected and closed ones too, that touch a member."""
    ends = edges.select("id", "kind", F.explode(F.array_distinct(F.array("source", "target"))).alias("member"))
    of = ends.join(communities.select(F.col("id").alias("member"), "community"), "member").select("id", "kind", "community").distinct()
    rank = F.row_number().over(Window.partitionBy("community").orderBy(F.desc("n"), "kind"))
    rows = of.groupBy("community", "kind").agg(F.count("*").alias("n")).withColumn("rk", rank).where("rk <= 6")
    return rows.groupBy("community").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rk", "kind", "n"))), lambda x: F.concat(x["kind"], F.lit(" "), x["n"])), ", ").alias("mix"))


def summary_nodes(summaries: DataFrame, now_s: int) -> DataFrame:
    """The active nodes of distill's summaries, tagged so that no later pass takes them as members."""
    return summaries.select("id", F.col("digest").alias("text"), F.lit("consolidator").alias("source"), F.array(F.lit(SUMMARY)).alias("tags"), F.lit("semantic").alias("ntype"), F.lit("active").alias("status"), F.lit(now_s).cast("long").alias("created_s"))


def summary_edges(summaries: DataFrame, communities: DataFrame, edges: DataFrame) -> DataFrame:
    """The accepted ``extends`` edges (source, target, kind, pending, origin) from each of distill's summaries to its five strongest members."""
    to = summaries.select(F.col("id").alias("source"), "community").join(_strongest(communities, edges), "community")
    return to.select("source", F.col("member").alias("target"), F.lit("extends").alias("kind"), F.lit(False).alias("pending"), F.lit("consolidator").alias("origin"))


def eligible(nodes: DataFrame, edges: DataFrame, near: DataFrame, communities: DataFrame, now_s: int, least: int = 10, **gates) -> DataFrame:
    """One row of what a pass would do: live nodes and edges, moves, near duplicates (``near(a, b, score)``, or ``near(pairs)``
    with counts of them), communities to distill, mismatched kinds."""
    count = lambda rows, name: rows.agg(F.count("*").alias(name))
    plan = lifecycle_plan(nodes, edges, now_s, **gates)
    parts = [
        count(nodes.where("status <> 'tombstone'"), "nodes"), count(live(edges, pending=False), "edges"),
        plan.agg(F.count(F.when(F.col("move") != "decay", 1)).alias("promotions"), F.count(F.when(F.col("move") == "decay", 1)).alias("decays")),
        near.agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("merges")) if "pairs" in near.columns else count(near, "merges"), count(communities.groupBy("community").agg(F.count("*").alias("n")).where(F.col("n") >= least), "distills"), count(mismatched(edges, pending=False), "kind_mismatches"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.crossJoin(part)  # one row each
    return out


def declared(arrivals: DataFrame, nodes: DataFrame) -> DataFrame:
    """(source, target, kind) of ``arrivals(id, ref, kind)``: a ref is an id or, but for case and outer white space, a text;
    the first node in id order, and not the arrival itself."""
    key = lambda c: F.lower(F.trim(F.col(c)))
    refs = arrivals.select(F.col("id").alias("source"), "ref", "kind").distinct()
    by_id = refs.join(nodes.select(F.col("id").alias("target")), F.col("ref") == F.col("target"))
    by_text = refs.withColumn("key", key("ref")).join(nodes.select(F.col("id").alias("target"), key("text").alias("key")), "key").drop("key")
    found = by_id.select("source", "ref", "kind", "target").unionByName(by_text.select("source", "ref", "kind", "target"))
    return found.groupBy("source", "ref", "kind").agg(F.min("target").alias("target")).where("source <> target").select("source", "target", "kind")


def add_sources(nodes: DataFrame, added: DataFrame) -> DataFrame:
    """``nodes`` with the sources of ``added(id, seq, source)`` behind their own, in order of seq, none twice."""
    more = added.groupBy("id", "source").agg(F.min("seq").alias("seq")).groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "source"))), lambda x: x["source"]).alias("more"))  # distinct sources of a node
    old = F.coalesce("sources", F.array().cast("array<string>"))
    all_ = F.array_distinct(F.concat(F.when(F.array_contains(old, F.col("source")), F.array().cast("array<string>")).otherwise(F.array("source")), old, F.col("more")))
    return nodes.join(more, "id", "left").withColumn("sources", F.when(F.col("more").isNotNull(), all_).otherwise(F.col("sources"))).drop("more")


def _strongest(communities: DataFrame, edges: DataFrame | None) -> DataFrame:
    members = communities.select("community", F.col("id").alias("member")).distinct()
    if edges is None:
        members = members.withColumn("n", F.lit(0))
    else:
        known = live(edges, pending=False)
        degree = known.select(F.col("source").alias("member")).union(known.select("target")).groupBy("member").agg(F.count("*").alias("n"))
        members = members.join(degree, "member", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("community").orderBy(F.desc("n"), "member"))
    return members.withColumn("rk", rank).where("rk <= 5").select("community", "member", "rk")
