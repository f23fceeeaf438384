"""Ingest: a batch of texts becomes nodes, edges and vectors.

The batch has an order (``seq``), and an arrival meets the nodes that were there and the earlier
arrivals that became nodes, as if they came one by one; texts are compared as they stood when the
batch began. In turn:

* a duplicate, of cosine ``DUPLICATE`` or more with some node, only adds its source to the nearest
  one (the smallest id of equals; tombstones count unless told otherwise);
* other arrivals become probation nodes, with intent edges to nodes of cosine ``RELATED`` or more
  (the first ``cap`` in order of target are accepted at once), declared edges, and the edges that
  the three nearest nodes suggest, unless that pair has one already;
* an accepted ``similar`` edge leaves a reference in its target's text, five a text at most.

Empty texts are refused. Whatever is matched with all nodes comes in blocks of ``BLOCK`` arrivals,
so that nothing broadcast grows with the batch.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from knotwork.functions import intent
from knotwork.functions.embedding import Embedder, slices, vectors_of
from knotwork.operators import transitions as T
from knotwork.operators import vectors as V
from knotwork.sources.cut import cut

RELATED, NEAREST, BLOCK, REFERENCES = 0.45, 3, 1024, 5


@dataclass
class Ingested:
    """The new state, and what became of each arrival: ``outcome(id, node_id, duplicate)``."""

    nodes: DataFrame
    edges: DataFrame
    vectors: DataFrame
    outcome: DataFrame
    new_edges: DataFrame


def matches(left: DataFrame, right: DataFrame, low: float, k: int | None = None) -> DataFrame:
    """(source, target, score) of pairs of ``left(id, vec)`` and ``right(id, vec)`` with a cosine of ``low`` or more,
    with ``k`` the best k of each source in each task at least; vectors of other lengths don't match."""
    spark, blocks, held, out = left.sparkSession, [], [], None
    for row in left.select("id", "vec").toLocalIterator():
        held.append((row.id, np.array(row.vec)))
        if len(held) == BLOCK:
            blocks.append(held)
            held = []
    schema = "source string, target string, score double"
    for block in [*blocks, *([held] if held else [])]:
        shared = spark.sparkContext.broadcast(block)

        def run(it, shared=shared):
            by_size: dict[int, list] = {}
            for i, v in shared.value:
                by_size.setdefault(len(v), []).append((i, v))
            sides = {}
            for size, rows in by_size.items():
                m = np.stack([v for _, v in rows])
                sides[size] = np.array([i for i, _ in rows], dtype=object), m / np.maximum(np.sqrt((m * m).sum(axis=1)), 1e-300)[:, None]
            for batch in slices(it, BLOCK):
                ids, vecs = batch.column("id").to_pylist(), batch.column("vec").to_pylist()
                for size, (sources, m) in sides.items():
                    rows = [r for r, v in enumerate(vecs) if v is not None and len(v) == size]
                    if not rows:
                        continue
                    n = np.array([vecs[r] for r in rows], np.float64)
                    n /= np.maximum(np.sqrt((n * n).sum(axis=1)), 1e-300)[:, None]
                    score = np.round(m @ n.T, 9)
                    targets = np.array([ids[r] for r in rows], dtype=object)
                    good = (score >= low) & (sources[:, None] != targets[None, :])
                    if k is not None and score.shape[1] > 2 * k:
                        good &= score >= -np.partition(-np.where(good, score, -2.0), k - 1, axis=1)[:, k - 1 : k]
                    i, j = np.nonzero(good)
                    yield pa.RecordBatch.from_arrays([pa.array(sources[i], pa.string()), pa.array(targets[j], pa.string()), pa.array(score[i, j])], names=["source", "target", "score"])

        part = right.select("id", "vec").mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], schema)


#: Arrivals of consecutive seq that one task settles in order.
PART = 1024


def _in_order(rows: pd.DataFrame) -> pd.DataFrame:
    """A part's arrivals (other is null) settled as far as can be: by earlier ones of the part (rows with other) and what
    is known of those before it (hit, waits)."""
    own = rows[rows["other"].isna()].sort_values("seq")
    inside = rows[rows["other"].notna()].groupby("id")["other"].agg(list).to_dict()
    fresh: dict[str, bool | None] = {}
    for key, known, hit, waits in zip(own["id"], own["fresh"], own["hit"], own["waits"]):
        if pd.isna(known):
            before = [fresh[o] for o in inside.get(key, [])]
            known = False if hit or True in before else None if waits or None in before else True
        fresh[key] = None if known is None else bool(known)
    return own[["id", "seq", "part"]].assign(fresh=pd.Series(list(fresh.values()), index=own.index, dtype=object))


def _settled(order: DataFrame, known: DataFrame, inside: DataFrame) -> DataFrame:
    """(id, fresh): whether each arrival of ``order(id, seq)`` becomes a node. ``known(id)`` have a duplicate among the
    nodes, ``inside(source, target)`` pairs an arrival with an earlier one that is near enough: a duplicate if that
    became a node.

    Rounds settle parts of ``PART`` places in order, each against what is known of the others, so a chain of n arrivals
    takes about n / PART of them. A part's task gets its pairs inside the part, fewer than PART * PART / 2, and one row
    an arrival of all others."""
    place = order.select("id", "seq", F.floor(F.col("seq") / PART).alias("part"))
    end = lambda c: place.select(F.col("id").alias(c), F.col("part").alias(f"{c}_part"))
    pairs = cut(inside.distinct().join(end("source"), "source").join(end("target"), "target"))
    far, same = pairs.where("source_part <> target_part"), pairs.where("source_part = target_part")
    near = same.select(F.col("source").alias("id"), F.lit(None).cast("long").alias("seq"), F.col("source_part").alias("part"), F.col("target").alias("other"), F.lit(None).cast("boolean").alias("fresh"), F.lit(False).alias("hit"), F.lit(0).cast("long").alias("waits"))
    state = cut(place.join(known.select("id").distinct().withColumn("dup", F.lit(True)), "id", "left").select("id", "seq", "part", F.when(F.col("dup"), False).alias("fresh")))
    while True:
        facts = far.join(state.select(F.col("id").alias("target"), F.col("fresh").alias("there")), "target").groupBy(F.col("source").alias("id"))
        facts = facts.agg(F.max("there").alias("hit"), F.count(F.when(F.col("there").isNull(), 1)).alias("waits"))
        rows = state.join(facts, "id", "left").select("id", "seq", "part", F.lit(None).cast("string").alias("other"), "fresh", F.coalesce("hit", F.lit(False)).alias("hit"), F.coalesce("waits", F.lit(0)).alias("waits"))
        state = cut(rows.unionByName(near).groupBy("part").applyInPandas(_in_order, "id string, seq long, part long, fresh boolean"))
        if state.where("fresh is null").isEmpty():  # every round settles the first part open at least
            return state.select("id", "fresh")


def ingest(
    nodes: DataFrame, edges: DataFrame, vectors: DataFrame, arrivals: DataFrame, now_s: int, today: str, embedder: Embedder | None = None,
    relations: DataFrame | None = None, cap: int = 3, floor: float = 0.0, auto_accept: bool = False, intent_pending: bool = False,
    allow_duplicates: bool = False, include_tombstones: bool = True, relation_origin: str = "manual",
) -> Ingested:
    """Takes in ``arrivals(id, seq, text, source)``; ``nodes`` and ``edges`` have the columns of ``sources.state``,
    ``vectors(id, vec)`` those of nodes, and ``relations(id, ref, kind)`` edges that arrivals declare."""
    if not arrivals.where("text is null or trim(text) = ''").isEmpty():
        raise ValueError("an empty text cannot be ingested")
    arrivals = cut(arrivals.withColumn("text", F.regexp_replace("text", r"(?U)\A\s+|\s+\z", "")))
    own = cut(vectors_of(arrivals, embedder))
    seqs = arrivals.select("id", "seq")
    there = nodes if include_tombstones else nodes.where("status <> 'tombstone'")
    candidates = vectors.join(there.select("id"), "id", "left_semi")
    old = cut(matches(own, candidates, RELATED))
    earlier = seqs.select(F.col("id").alias("target"), F.col("seq").alias("target_seq"))
    batch = cut(matches(own, own, RELATED).join(seqs.withColumnRenamed("id", "source"), "source").join(earlier, "target").where("target_seq < seq").select("source", "target", "score"))

    near = F.col("score") >= T.DUPLICATE
    if allow_duplicates:
        fresh = seqs.select("id").withColumn("fresh", F.lit(True))
    else:
        fresh = _settled(seqs, old.where(near).select(F.col("source").alias("id")), batch.where(near).select("source", "target"))
    became = fresh.where("fresh").select("id")
    pairs = old.unionByName(batch.join(became.withColumnRenamed("id", "target"), "target", "left_semi").select("source", "target", "score"))
    first = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("score"), "target"))
    merged = pairs.where(near).join(fresh.where("not fresh").select(F.col("id").alias("source")), "source", "left_semi").withColumn("rk", first).where("rk = 1")
    merged = cut(merged.select(F.col("source").alias("id"), F.col("target").alias("node_id")))
    pairs = cut(pairs.join(became.withColumnRenamed("id", "source"), "source", "left_semi"))

    added = arrivals.join(became, "id", "left_semi")
    new_nodes = added.select(*(F.lit(v).cast(nodes.schema[c].dataType).alias(c) if c not in ("id", "text", "source") else F.col(c) for c, v in (
        (c, {"status": "probation", "ntype": "semantic", "created_s": now_s, "recall_count": 0}.get(c)) for c in nodes.columns)))
    whole = nodes.unionByName(new_nodes)

    # Intent: texts of related pairs only, each read once.
    wanted = pairs.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    read = cut(intent.profiles(whole.select("id", "text").join(wanted, "id", "left_semi")))
    kinds = intents(pairs.select("source", "target"), read).where("kind is not null")
    place = F.row_number().over(Window.partitionBy("source").orderBy("target"))
    meant = kinds.withColumn("rk", place).select("source", "target", "kind", (F.lit(intent_pending) | (F.col("rk") > cap)).alias("pending"), F.lit(None).cast("double").alias("confidence"), F.lit("intent").alias("origin"), F.lit(0).alias("turn"))
    if relations is not None:
        said = T.declared(relations.join(became, "id", "left_semi"), whole)
        meant = meant.unionByName(said.select("source", "target", "kind", F.lit(False).alias("pending"), F.lit(None).cast("double").alias("confidence"), F.lit(relation_origin).alias("origin"), F.lit(1).alias("turn")))
    meant = cut(meant)
    score = F.col("score")
    like = pairs.withColumn("rk", first).where(F.col("rk") <= NEAREST).where(score >= floor)
    like = like.select("source", "target", F.when(score >= V.SIMILAR, "similar").otherwise("extends").alias("kind"), ((score < V.AUTO_ACCEPT) & ~F.lit(auto_accept)).alias("pending"), score.alias("confidence"), F.lit("suggester").alias("origin"), F.lit(2).alias("turn"))
    claimed = meant.select("source", "target").unionByName(edges.select("source", "target")).distinct()
    made = meant.join(edges.select("source", "target").distinct(), ["source", "target"], "left_anti").unionByName(like.join(claimed, ["source", "target"], "left_anti"))
    new_edges = cut(numbered(made, seqs, edges, now_s))

    sources = merged.join(arrivals.select("id", "seq", "source"), "id").select(F.col("node_id").alias("id"), "seq", "source")
    state = _referenced(T.add_sources(whole, sources), new_edges, arrivals, today)
    outcome = seqs.select("id").join(merged, "id", "left").select("id", F.coalesce("node_id", "id").alias("node_id"), F.col("node_id").isNotNull().alias("duplicate"))
    return Ingested(state, edges.unionByName(new_edges), vectors.unionByName(own.join(became, "id", "left_semi").select("id", "vec")), outcome, new_edges)


def touched(done: Ingested, nodes: DataFrame, vectors: DataFrame) -> dict[str, DataFrame]:
    """The ids that an ingest may have changed in each table of a state that had ``nodes`` and ``vectors`` before: what became
    of the arrivals, targets of new edges, and vectors that were missing or stood for no node."""
    became = done.outcome.select(F.col("node_id").alias("id"))
    return {"nodes": became.unionByName(done.new_edges.select(F.col("target").alias("id"))), "edges": done.new_edges.select("id"), "vectors": became.unionByName(unmatched(nodes, vectors))}


def unmatched(nodes: DataFrame, vectors: DataFrame) -> DataFrame:
    """Ids of nodes without a vector, and of vectors without a node."""
    left = lambda a, b: a.select("id").join(b.select("id"), "id", "left_anti")
    return left(nodes, vectors).unionByName(left(vectors, nodes))


def intents(pairs: DataFrame, read: DataFrame) -> DataFrame:
    """(other columns, kind) of ``pairs(source, target, ...)`` whose texts' profiles are ``read(id, profile)``; pairs without
    a marker in either text say nothing and are left out before any profile is joined."""
    marked = read.where(F.size("profile.hits") > 0).select("id")
    flag = lambda c: marked.select(F.col("id").alias(c), F.lit(True).alias(f"{c}_says"))
    some = pairs.join(flag("source"), "source", "left").join(flag("target"), "target", "left").where("source_says or target_says").drop("source_says", "target_says")
    side = lambda c: read.select(F.col("id").alias(c), F.col("profile").alias(f"of_{c}"))
    return intent.with_kind(some.join(side("source"), "source").join(side("target"), "target"), "of_source", "of_target", "kind")


def numbered(made: DataFrame, seqs: DataFrame, edges: DataFrame, now_s: int) -> DataFrame:
    """``made`` as rows of ``edges``: ids from what they join, seq behind the known ones, in order of the batch."""
    last = edges.agg(F.coalesce(F.max("seq"), F.lit(-1))).first()[0]
    rows = made.join(seqs.select(F.col("id").alias("source"), F.col("seq").alias("at")), "source")
    # Places: within an arrival by its few edges, between arrivals by running sums of a count an arrival.
    counts = rows.groupBy("source", "at").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.orderBy("at")) - F.col("n")).select("source", "before")  # a row an arrival of the batch
    inside = F.row_number().over(Window.partitionBy("source").orderBy("turn", F.when(F.col("turn") == 2, -F.col("confidence")), "target", "kind"))
    placed = rows.withColumn("place", inside).join(before, "source")
    given = {
        "seq": (F.lit(last) + F.col("before") + F.col("place")).cast("long"),
        "id": F.concat(F.lit("e"), F.substring(F.sha1(F.concat_ws("|", "source", "target", "kind", F.lit(str(now_s)))), 1, 11)),
        "source": F.col("source"), "target": F.col("target"), "kind": F.col("kind"), "pending": F.col("pending"), "rejected": F.lit(False), "from_s": F.lit(now_s).cast("long"),
        "confidence": F.col("confidence"), "origin": F.col("origin"),
    }
    return placed.select(*(given.get(c, F.lit(None)).cast(edges.schema[c].dataType).alias(c) for c in edges.columns))


def _referenced(nodes: DataFrame, new_edges: DataFrame, arrivals: DataFrame, today: str) -> DataFrame:
    """``nodes`` with a reference to the new node behind the text of each accepted ``similar`` edge's target, unless
    it is a tombstone, has ``REFERENCES`` of them, or names that node already."""
    short = F.substring(F.regexp_replace(F.lower("text"), r"(?U)\s+", " "), 1, 40)
    line = arrivals.select(F.col("id").alias("source"), F.col("seq").alias("at"), F.concat(F.lit(f"[evolved {today}: connected to "), F.substring("id", 1, 8), F.lit(" “"), short, F.lit("…”]")).alias("line"))
    to = new_edges.where("not pending and kind = 'similar'").select("source", "target").join(line, "source")
    texts = nodes.where("status <> 'tombstone'").select(F.col("id").alias("target"), F.coalesce("text", F.lit("")).alias("text"))
    room = to.join(texts, "target").where(~(F.contains("text", F.lit("evolved")) & F.contains("text", F.substring("source", 1, 8))))
    has = (F.length("text") - F.length(F.replace("text", F.lit("[evolved "), F.lit("")))) / len("[evolved ")
    rank = F.row_number().over(Window.partitionBy("target").orderBy("at"))
    few = room.select("target", "line", "at", has.alias("has")).withColumn("rk", rank).where(F.col("has") + F.col("rk") <= REFERENCES)
    more = few.groupBy("target").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rk", "line"))), lambda x: x["line"]), "\n\n").alias("more"))  # five a node
    out = nodes.join(more.withColumnRenamed("target", "id"), "id", "left")
    return out.withColumn("text", F.when(F.col("more").isNotNull(), F.concat("text", F.lit("\n\n"), "more")).otherwise(F.col("text"))).drop("more").select(*nodes.columns)
