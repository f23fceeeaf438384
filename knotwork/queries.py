"""Registry of the engine's queries and their DuckDB equivalents."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork import report
from knotwork.functions import embedding, gate, intent, text
from knotwork.operators import communities as communities_of
from knotwork.operators import graph, hygiene, ingest, inverted, search, transitions, vectors
from knotwork.plans.graph_sql import PLANS
from knotwork.sources import tables
from knotwork.sources.cut import cut, shared_folder
from knotwork.sources.state import EDGES, NODES, fitted, index_lines
from knotwork.streaming import folding

_BASE = ("benchmark", "conversations")


def _views(plan: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", plan)))


def spark_query(plan: str) -> Callable[[SparkSession, str], DataFrame]:
    """A plan over DataFrames; only the views it names are built, and Catalyst prunes the rest."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        given = {v: tables.read(spark, sf_dir, v) if v in _BASE else tables.VIEWS[v](spark, sf_dir) for v in _views(plan)}
        ctes, mark, main = plan.partition("\n--\n")
        return spark.sql(f"with {ctes}\n{main}" if mark else plan, **given)

    return run


def duckdb_query(plan: str) -> str:
    wanted: list[str] = []
    for view in _views(plan):
        wanted += [*tables.NEEDS.get(view, []), view]
    views = [f"{v} as {tables.SQL[v]}" for v in tables.SQL if v in wanted]
    ctes, mark, main = plan.partition("\n--\n")
    heads = [*views, *([ctes] if mark else [])]
    whole = (f"with {', '.join(heads)}\n" if heads else "") + (main if mark else plan)
    return re.sub(r"\{(\w+)\}", r"\1", whole).replace("\\\\|", "\\|")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: spark_query(plan) for name, plan in PLANS.items()}
ORACLES: dict[str, str] = {name: duckdb_query(plan) for name, plan in PLANS.items()}


# --- queries that run the operators; their SQL states the same result on its own

NODE, OTHER, NOW_S, SINCE_S = "d00000042", "d00000043", 1719792000, 1704067200 + 6000


def _live(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.nodes(spark, sf_dir).where("status <> 'tombstone'")


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text")


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.bm25(tables.nodes(spark, sf_dir), _texts(spark, sf_dir)).withColumn("score", F.round("score", 6))


def bm25_index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a stored index: all nodes taken in, then tombstones removed by a second generation."""
    nodes, index = tables.nodes(spark, sf_dir), inverted.Index(spark, shared_folder(spark))
    index.add(nodes.drop("status"))
    index.add(nodes.where("status = 'tombstone'"))
    return index.search(_texts(spark, sf_dir)).withColumn("score", F.round("score", 6))


def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.dense(tables.nodes(spark, sf_dir), _texts(spark, sf_dir)).withColumn("score", F.round("score", 6))


def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.hybrid(tables.nodes(spark, sf_dir), _texts(spark, sf_dir))


def rerank_reverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.retrieve(tables.nodes(spark, sf_dir), _texts(spark, sf_dir), 5, reranker=search.reverse_order)


def search_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five hits of each search with what is shown of their nodes."""
    nodes = tables.nodes(spark, sf_dir)
    return search.retrieve(nodes, _texts(spark, sf_dir)).join(nodes, "id").select("qid", "rank", "id", F.round("rrf", 4).alias("score"), text.cell(F.col("text"), 200).alias("snippet"), "status", "ntype")


def find_by_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes that whole benchmark texts, and the first sentences of all documents (8 characters or more), name."""
    heads = tables.numbered(spark, sf_dir).select((F.lit(1000000) + F.col("seq")).alias("qid"), F.substring_index(F.coalesce("text", F.lit("")), ".", 1).alias("text"))
    refs = _texts(spark, sf_dir).unionByName(heads).where(F.length(text.normalized(F.col("text"))) >= 8)
    return search.find_by_text(tables.nodes(spark, sf_dir), refs).withColumnRenamed("qid", "item_id")


def hash_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = embedding.vectors_of(_live(spark, sf_dir)).select("id", F.posexplode("vec").alias("dim", "w"))
    return rows.where("w <> 0").select("id", F.col("dim").cast("long").alias("dim"), F.round("w", 9).alias("w"))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding.vectors_of(_live(spark, sf_dir))


def near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(_vectors(spark, sf_dir)).select("a", "b", F.round("score", 6).alias("score"))


def knn_suggest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.suggest(_vectors(spark, sf_dir)).select("source", "target", "kind", F.round("score", 6).alias("score"), "pending")


def dup_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each node's nearest other one, where it is near enough to be its duplicate."""
    found = vectors.nearest(_vectors(spark, sf_dir), 1, 0.92)
    return found.select(F.col("source").alias("id"), F.col("target").alias("duplicate_of"), F.round("score", 6).alias("score"))


def intent_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The intent of each shown edge's source text towards its target text, where there is one."""
    pairs = transitions.live(tables.edges(spark, sf_dir), pending=False).select("id", "source", "target")
    read = cut(intent.profiles(_live(spark, sf_dir).select("id", "text")))
    return ingest.intents(pairs, read).where("kind is not null").select("id", F.col("kind").alias("intent"))


def connectivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hygiene.connectivity(tables.nodes(spark, sf_dir), tables.edges(spark, sf_dir))


def degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _live(spark, sf_dir).select("id").join(transitions.degrees(tables.edges(spark, sf_dir)), "id", "left")
    return found.select("id", F.coalesce("degree", F.lit(0)).alias("degree")).withColumn("size", F.round(1 + F.log2(1 + F.col("degree")), 6))


def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hygiene.status_counts(tables.nodes(spark, sf_dir))


def conf_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transitions.live(tables.edges(spark, sf_dir)).groupBy(text.confidence_band(F.col("confidence")).alias("band")).agg(F.count("*").alias("n"))


def extends_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hygiene.extends_only(tables.edges(spark, sf_dir))


def intent_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hygiene.intent_queue(tables.edges(spark, sf_dir))


def hubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hygiene.hubs(tables.edges(spark, sf_dir))


def degree_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hygiene.degree_percentiles(tables.nodes(spark, sf_dir), tables.edges(spark, sf_dir))


def since_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.deltas(tables.nodes(spark, sf_dir), tables.edges(spark, sf_dir), SINCE_S)


def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hygiene.coverage(tables.nodes(spark, sf_dir), tables.taxonomy(spark, sf_dir))
    return found.select("area", "n", F.try_element_at("examples", F.lit(1)).alias("first_example"), F.array_max("examples").alias("fifth_example"), "unclassified")


def coverage_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hygiene.thin_areas(hygiene.coverage(tables.nodes(spark, sf_dir), tables.taxonomy(spark, sf_dir)), 10)


def _around(spark: SparkSession, sf_dir: str, hops: int) -> DataFrame:
    return graph.neighbors(tables.nodes(spark, sf_dir), tables.edges(spark, sf_dir), NODE, hops).select("id", "kind", "direction", "hops")


def neighbors_1hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _around(spark, sf_dir, 1)


def neighbors_2hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _around(spark, sf_dir, 2)


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    nodes = _live(spark, sf_dir).select("id")
    return nodes, communities_of.simple(nodes, tables.edges(spark, sf_dir))


def undirected_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir)[1]


def shortest_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shortest path to every node within four steps, as ids joined by >."""
    return graph.shortest_paths(cut(undirected_graph(spark, sf_dir)), NODE).select("id", F.array_join("path", ">").alias("path"))


def communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.labels(*_graph(spark, sf_dir))


def betweenness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.betweenness(*_graph(spark, sf_dir), sample=200)


def _languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages in the place of communities, so that SQL can follow; ``community_report`` takes found ones."""
    return _live(spark, sf_dir).select("id", F.col("lang").alias("community"))


def modularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.modularity(undirected_graph(spark, sf_dir), _languages(spark, sf_dir)).select(F.round("q", 6).alias("q"))


def community_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = communities_of.stats(_live(spark, sf_dir), undirected_graph(spark, sf_dir), _languages(spark, sf_dir))
    return found.select("community", "size", "internal_edges", "degree_sum", "hub")


def structural_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = communities_of.gaps(_live(spark, sf_dir), undirected_graph(spark, sf_dir), _languages(spark, sf_dir), min_size=1, top=1000)
    return found.select("a", "b", "observed", "expected", "deficit")


def community_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Provider rows over the communities that label propagation finds."""
    found = communities_of.analyze(tables.nodes(spark, sf_dir), tables.edges(spark, sf_dir), tables.taxonomy(spark, sf_dir), sample=200)
    return communities_of.provider(found)


def god_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return communities_of.god_nodes(_live(spark, sf_dir), undirected_graph(spark, sf_dir))


def accept_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = tables.edges(spark, sf_dir)
    after = transitions.accept_pending(edges).select("id", (~F.col("pending")).alias("accepted"))
    return transitions.live(edges).where("pending").select("id").join(after, "id")


def _used(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = tables.recalls(spark, sf_dir).groupBy("id").agg(F.count("*").cast("int").alias("recall_count"))
    return tables.nodes(spark, sf_dir).join(counts, "id", "left").withColumn("recall_count", F.coalesce("recall_count", F.lit(0)))


def lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transitions.lifecycle_plan(_used(spark, sf_dir), tables.edges(spark, sf_dir), NOW_S)


def decay_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    age, n = (F.lit(NOW_S) - F.col("created_s")) / 86400.0, F.col("recall_count")
    return _used(spark, sf_dir).select("id", F.round(text.weibull(age), 9).alias("decay"), F.round(text.retention(n), 9).alias("retention"), text.decay_level(n, age).alias("level"))


def refresh_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transitions.mismatched(tables.edges(spark, sf_dir))


def recall_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = tables.recalls(spark, sf_dir).select(F.lpad(F.col("ts_s").cast("string"), 12, "0").alias("ts"), "q", F.array("id").alias("ids"))
    folded = transitions.fold_recalls(fitted(tables.nodes(spark, sf_dir), NODES), ledger).where("recall_count > 0")
    q = F.col("recall_queries")
    return folded.select("id", F.col("recall_count").cast("long").alias("recalls"), F.size(q).cast("long").alias("kept"), F.array_min(q).alias("first_q"), F.array_max(q).alias("last_q"), F.col("last_recalled").cast("long").alias("last_s"))


def recall_fold_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by the state that a stream of usage keeps, over the whole ledger at once."""
    events = tables.recalls(spark, sf_dir).select(F.timestamp_seconds("ts_s").alias("ts"), "q", "id")
    q = F.col("recall_queries")
    known = folding.folded(events).join(tables.nodes(spark, sf_dir).select("id"), "id", "left_semi")
    return known.select("id", F.col("recall_count").alias("recalls"), F.size(q).cast("long").alias("kept"), F.array_min(q).alias("first_q"), F.array_max(q).alias("last_q"), F.unix_timestamp("last_recalled").alias("last_s"))


def origin_minimum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hygiene.origins(tables.edges(spark, sf_dir).withColumn("origin", text.origin_of(F.col("kind"), F.col("confidence"))))


def forget(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, old = tables.nodes(spark, sf_dir), tables.edges(spark, sf_dir)
    nodes, edges = transitions.forget(before, old, NODE, NOW_S)
    closed = edges.join(transitions.live(old).select("id"), "id", "left_semi").where("to_s is not null").agg(F.count("*").alias("closed"))
    was = before.where(F.col("id") == NODE).where("status <> 'tombstone'").select("id")
    return nodes.join(was, "id", "left_semi").select("id", F.col("status").alias("new_status")).crossJoin(closed)  # one row each


def undo_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every settled edge that an undo would put back."""
    old = tables.edges(spark, sf_dir)
    back = transitions.undo(old, F.col("id")).join(old.where("not pending").select("id"), "id", "left_semi")
    return back.where("pending").select("id", "pending", "rejected")


def merge_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transitions.merged_edges(tables.edges(spark, sf_dir), NODE, OTHER, NOW_S).select("id", "source", "target", F.coalesce(F.col("to_s").cast("long"), F.lit(0)).alias("to_s"))


def merge_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transitions.merge_counts(tables.edges(spark, sf_dir), NODE, OTHER)


def backfill_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.edges(spark, sf_dir).select("id", text.origin_of(F.col("kind"), F.col("confidence")).alias("origin"))


def migrate_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every other edge under the kind's old name, brought to the new one."""
    old = {"similar": F.when(F.col("seq") % 3 == 0, "ähnlich").otherwise("aehnlich"), "extends": F.lit("erweitert"), "contradicts": F.lit("kontradiktorisch")}
    named = F.col("kind")
    for kind, name in old.items():
        named = F.when((F.col("kind") == kind) & (F.col("seq") % 2 == 0), name).otherwise(named)
    return tables.edges(spark, sf_dir).select("id", text.migrated_kind(named).alias("kind"))


def index_md(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = index_lines(tables.nodes(spark, sf_dir))
    return lines.select("id", F.regexp_replace("value", r" \| [0-9TZ:-]+ \|$", "").alias("line"))


def summary_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The id that a summary of each source's nodes would have."""
    return _live(spark, sf_dir).groupBy("source").agg(text.summary_id(F.collect_list("id")).alias("id"))  # ids only: the id is made of them


def dream_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a pass would do, pairs to merge among it; languages stand for communities."""
    nodes, near = _used(spark, sf_dir), vectors.near_counts(_vectors(spark, sf_dir))
    return transitions.eligible(nodes, tables.edges(spark, sf_dir), near, _languages(spark, sf_dir), NOW_S)


def distill(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, pairs = _graph(spark, sf_dir)
    found = cut(graph.labels(nodes, pairs))
    live, edges = _live(spark, sf_dir), tables.edges(spark, sf_dir)
    return transitions.distill(live, found, edges=edges, labels=communities_of.stats(live, pairs, found, tables.taxonomy(spark, sf_dir)))


def consolidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = tables.nodes(spark, sf_dir)
    return transitions.consolidate(nodes, embedding.vectors_of(nodes)).select("id", "status")


def ingest_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All benchmark texts taken in as one batch: what became of each, and the edges each brought."""
    nodes, edges = fitted(tables.nodes(spark, sf_dir), NODES), fitted(tables.edges(spark, sf_dir), EDGES)
    number = F.col("item_id")
    arrivals = tables.read(spark, sf_dir, "benchmark").where("trim(text) <> ''").select(F.concat(F.lit("b"), F.lpad(number.cast("string"), 8, "0")).alias("id"), number.alias("seq"), "text", F.lit("benchmark").alias("source"))
    done = ingest.ingest(nodes, edges, cut(embedding.vectors_of(nodes)), arrivals, NOW_S, "2024-07-01")
    counts = done.new_edges.groupBy(F.col("source").alias("id")).agg(F.count("*").alias("edges"), F.count(F.when(F.col("origin") == "intent", 1)).alias("meant"), F.count(F.when(F.col("pending"), 1)).alias("pending"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return done.outcome.join(counts, "id", "left").select("id", "node_id", "duplicate", zero("edges"), zero("meant"), zero("pending"))


def marker_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The markers in each turn of the conversations."""
    return gate.marker_scan(tables.read(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), "text").select("conv_id", "turn", "marker")


_DUCK_WORDS = "'[a-zäöüß0-9]+'"
_STOPS = ", ".join(f"'{w}'" for w in text.STOP_WORDS)
_MARKS = ", ".join(f"({order}, '{kind}', '{marker}', {str(marker.split()[0] in text.OBJECT_MARKERS).lower()})" for order, kind in enumerate(text.PRIORITY) for marker in text.PRIORITY[kind])
INTENT_SQL = rf"""with nodes as {tables.SQL['nodes']}, edges as {tables.SQL['edges']},
marks(prio, kind, marker, needs) as (select * from (values {_MARKS}) t),
live as (select id, lower(text) as body from nodes where status <> 'tombstone' and text is not null),
pairs as (select e.id, source, target from edges e where not rejected and to_s is null and not pending and source in (select id from live) and target in (select id from live)),
content as (select distinct id, w from (select id, unnest(regexp_extract_all(body, {_DUCK_WORDS})) as w from live) where length(w) >= 3 and w not in ({_STOPS})),
parts as (select id, unnest(string_split_regex(body, '[.!?;,:()\[\]"'']|\n')) as part from live),
clauses as (select row_number() over () as c, id, ws, ' ' || array_to_string(ws, ' ') || ' ' as spaced from (select id, regexp_extract_all(part, {_DUCK_WORDS}) as ws from parts) where len(ws) > 0),
hits as (select c, id, prio, kind, needs, marker, ws from clauses join marks on contains(spaced, ' ' || marker || ' ')),
spots as (select c, id, prio, kind, needs, ws, len(string_split(marker, ' ')) as size, marker, unnest(range(1, len(ws) + 1)) as p from hits),
found as (select c, id, prio, kind, needs, ws, list_slice(ws, p + size, p + size + 1) as object from spots where array_to_string(list_slice(ws, p, p + size - 1), ' ') = marker),
words as (select distinct c, id, prio, kind, needs, w, list_contains(object, w) as obj from (select c, id, prio, kind, needs, object, unnest(ws) as w from found)),
shared as (select p.id as eid, x.w, p.source, p.target from pairs p join content x on x.id = p.source join content y on y.id = p.target and y.w = x.w),
sides as (select eid, w, source as id from shared union all select eid, w, target from shared),
said as (select s.eid, k.c, k.prio, k.kind, k.needs, bool_or(k.obj) as obj from sides s join words k on k.id = s.id and k.w = s.w group by all),
objects as (select s.eid, f.c, f.prio, f.kind from sides s join found f on f.id = s.id and list_contains(f.object, s.w) where f.needs)
select eid as id, min_by(kind, prio) as intent from (select eid, prio, kind from said where not needs union select eid, prio, kind from said join objects using (eid, c, prio, kind) where needs) group by eid"""


_COSINES = """with nodes as {nodes}, words as {words}, embeds as {embeds}, norm as (select id, sqrt(sum(w * w)) as n from embeds group by id),
cos as (select x.id as a, y.id as b, sum(x.w * y.w) as dot from embeds x join embeds y on x.dim = y.dim and x.id {op} y.id group by 1, 2),
scored as (select a, b, dot / (p.n * q.n) as score from cos join norm p on p.id = a join norm q on q.id = b),
ranked as (select a, b, score, row_number() over (partition by a order by round(score, 9) desc, b) as rk from scored)
"""


def _cosine_sql(op: str, select: str) -> str:
    return _COSINES.format(**tables.SQL, op=op) + select


_OPERATED = (
    bm25_topk, bm25_index_topk, dense_topk, hybrid_search, rerank_reverse, search_hits, find_by_text, hash_embed, near_dup, knn_suggest, dup_lookup, intent_detect, connectivity, degrees, status_counts, conf_bands, extends_only,
    intent_queue, hubs, degree_pct, since_deltas, coverage, coverage_gaps, neighbors_1hop, neighbors_2hop, undirected_graph, shortest_path, communities, betweenness, modularity, community_stats,
    structural_gaps, community_report, god_nodes, accept_pending, lifecycle, decay_levels, refresh_kinds, recall_fold, recall_fold_state, origin_minimum, forget, undo_edge, merge_edges, merge_report, backfill_origin, migrate_kinds, index_md,
    summary_ids, dream_plan, distill, consolidate, ingest_batch, marker_scan,
)
def _hits_sql() -> str:
    """The five best of the fused ranking, with the nodes' texts on one line, cut and then escaped."""
    top = duckdb_query(PLANS["hybrid_search"].replace("rank <= 10", "rank <= 5"))
    flat = "trim(regexp_replace(n.text, '\\s+', ' ', 'g'))"
    shown = f"case when length({flat}) > 200 then substr({flat}, 1, 200) || '…' else {flat} end"
    for sign in "|<>&":
        shown = f"replace({shown}, '{sign}', chr(92) || '{sign}')"
    return f"select qid, rank, h.id, round(rrf, 4) as score, coalesce({shown}, '') as snippet, status, ntype from ({top}) h join {tables.SQL['nodes']} n on n.id = h.id"


QUERIES |= {f.__name__: f for f in _OPERATED}
ORACLES |= {
    "bm25_index_topk": ORACLES["bm25_topk"],
    "recall_fold_state": ORACLES["recall_fold"],
    "intent_detect": INTENT_SQL,
    "search_hits": _hits_sql(),
    "merge_report": "with " + duckdb_query(PLANS["merge_edges"]).removeprefix("with ").split("\nselect id, s as source")[0] + f"""
select (select cast(sum((source = '{OTHER}')::int + (target = '{OTHER}')::int) as bigint) from marked where not stays) as edges_redirected,
 (select cast(count(*) as bigint) from marked) - (select cast(count(*) as bigint) from ranked where rk = 1) - (select cast(count(*) as bigint) from marked where stays and to_s is null) as edges_removed,
 (select cast(count(*) as bigint) from marked where stays and to_s is null) as edges_invalidated""",
    "near_dup": _cosine_sql("<", "select a, b, round(score, 6) as score from scored where score >= 0.78 and score < 0.92 + 1e-6"),
    "knn_suggest": _cosine_sql("<>", "select a as source, b as target, case when round(score, 9) >= 0.75 then 'similar' else 'extends' end as kind, round(round(score, 9), 6) as score, round(score, 9) < 0.95 as pending from ranked where rk <= 3 and round(score, 9) >= 0.45"),
    "dup_lookup": _cosine_sql("<>", "select a as id, b as duplicate_of, round(round(score, 9), 6) as score from ranked where rk = 1 and round(score, 9) >= 0.92"),
}
ORACLES["dream_plan"] = f"select p.*, (select cast(count(*) as bigint) from ({ORACLES['near_dup']}) d) as merges from ({ORACLES['dream_plan']}) p"
