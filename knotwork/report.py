"""Reports: what a graph looks like and what changed, as one dict and as text; and the controller of batch runs.

What comes to the driver is a row a kind, band, status, or one of ``top`` rows.
"""

from __future__ import annotations

import json
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.functions import text as T
from knotwork.operators import communities as C
from knotwork.operators import hygiene as H
from knotwork.operators.transitions import live

TOP, HOURS, TITLE = 10, 24, 60


def parse_since(since, now: datetime) -> datetime:
    """The start of a window: hours back, or an ISO stamp (UTC if it names no zone); a day back by default."""
    if since is None:
        since = HOURS
    try:
        return now - timedelta(hours=float(since))
    except (TypeError, ValueError):
        pass
    try:
        at = datetime.fromisoformat(str(since).strip().replace("Z", "+00:00"))
    except ValueError as why:
        raise ValueError(f"since takes hours or an ISO time, not {since!r}") from why
    return at if at.tzinfo else at.replace(tzinfo=timezone.utc)


def deltas(nodes: DataFrame, edges: DataFrame, since_s: int) -> DataFrame:
    """One row (nodes, edges, intent_edges, tombstones) of what began at ``since_s`` or later; tombstones by when they were made."""
    fresh = nodes.where(F.col("created_s") >= since_s)
    a = fresh.agg(F.count(F.when(F.col("status") != "tombstone", 1)).alias("nodes"), F.count(F.when(F.col("status") == "tombstone", 1)).alias("tombstones"))
    b = live(edges).where(F.col("from_s") >= since_s).agg(F.count("*").alias("edges"), F.count(F.when(F.col("kind").isin(*H.REVIEWED), 1)).alias("intent_edges"))
    return a.crossJoin(b).select("nodes", "edges", "intent_edges", "tombstones")  # one row each


def data(nodes: DataFrame, edges: DataFrame, now: datetime, since=None, top: int | None = None, structural: DataFrame | None = None, near: DataFrame | None = None) -> dict:
    """The report's content. ``top`` rows a list, where 0 stands for the usual 10; ``structural`` are provider rows
    (kind, label, score, hint) and ``near`` pairs of near duplicates, both left out where not given."""
    top = max(int(top or TOP), 0)
    start = parse_since(since, now)
    title = T.cell(F.col("text"), TITLE)
    names = nodes.where("status <> 'tombstone'").select("id", title.alias("title"))
    counts = lambda rows, key: {r[0]: r[1] for r in rows.groupBy(key).count().collect()}
    shown = live(edges)
    queue = H.intent_queue(edges, top).join(names.withColumnRenamed("id", "source"), "source", "left").orderBy(F.desc("fan_out"), "source").collect()
    hubs = H.hubs(edges, top).join(names, "id", "left").orderBy(F.desc("degree"), "id").collect()
    conn = H.connectivity(nodes, edges).first()
    rows = [r.asDict() for r in structural.where("kind in ('hole', 'community')").limit(top).collect()] if structural is not None and top else []
    intent = [{"source": r.source, "fan_out": r.fan_out, "pending": r.pending, "kind": r.kind, "title": r.title or "?", "warn": r.warn} for r in queue]
    research = [f"resolve {q['fan_out']}x {q['kind']} from {q['source']}: {q['title']}" for q in intent[:3]] + [r.get("hint") or f"bridge {r.get('label', 'gap')}" for r in rows[:2]]
    return {
        "generated_at": now.strftime("%Y-%m-%dT%H:%M:%SZ"), "nodes": conn.total, "edges": conn.edges, "since": start.isoformat(),
        "deltas": deltas(nodes, edges, int(start.timestamp())).first().asDict(), "kinds": counts(shown, "kind"), "confidence_bands": counts(shown.select(T.confidence_band(F.col("confidence")).alias("band")), "band"),
        "extends_only_nodes": H.extends_only(edges).count(), "intent_queue": intent, "hubs": [{"id": r.id, "degree": r.degree, "title": r.title or "?"} for r in hubs],
        "degree_percentiles": H.degree_percentiles(nodes, edges).first().asDict(), "structural": rows,
        "hygiene": {"orphans": conn.orphans, "islands": conn.islands, "weak": conn.weak, "near_dup_pairs": near.count() if near is not None else None, "statuses": counts(nodes, "status")},
        "research_next": research[:5],
    }


def render(report: dict) -> str:
    """The report as Markdown; empty sections are left out."""
    mix = lambda d: ", ".join(f"{k} {v}" for k, v in sorted(d.items(), key=lambda x: (-x[1], str(x[0])))) or "none"
    d, h, p = report["deltas"], report["hygiene"], report["degree_percentiles"]
    lines = ["# Graph report", "", f"{report['generated_at']}: {report['nodes']} nodes, {report['edges']} edges", "", f"## Since {report['since']}", "", f"{d['nodes']} nodes, {d['edges']} edges ({d['intent_edges']} of intent), {d['tombstones']} tombstones", "", "## Edges", "", f"kinds: {mix(report['kinds'])}", f"confidence: {mix(report['confidence_bands'])}", f"nodes with extends edges only: {report['extends_only_nodes']}"]
    if report["intent_queue"]:
        lines += ["", "## To review", "", "| Source | Edges | Pending | Kind | Idea |", "|---|---|---|---|---|"]
        lines += [f"| {q['source']}{' (!)' if q['warn'] else ''} | {q['fan_out']} | {q['pending']} | {q['kind']} | {q['title']} |" for q in report["intent_queue"]]
    lines += ["", "## Hubs", "", f"degrees: median {p['p50']}, p90 {p['p90']}, p99 {p['p99']}"] + [f"- {r['degree']}  {r['id']}  {r['title']}" for r in report["hubs"]]
    if report["structural"]:
        lines += ["", "## Structure", ""] + [f"- {r['kind']} {r['label']}: {r['hint']}" for r in report["structural"]]
    lines += ["", "## Hygiene", "", f"orphans {h['orphans']}, islands {h['islands']}, weak {h['weak']}; status: {mix(h['statuses'])}"]
    if h["near_dup_pairs"] is not None:
        lines.append(f"near duplicates: {h['near_dup_pairs']} pairs")
    if report["research_next"]:
        lines += ["", "## Next", ""] + [f"- {r}" for r in report["research_next"]]
    return "\n".join(lines) + "\n"


def render_coverage(rows: list, threshold: int) -> str:
    """Rows (area, n, unclassified) of ``hygiene.coverage`` as text, with a bar each and the thin areas at the end."""
    most = max([r["n"] for r in rows] + [1])
    lines = [f"{r['n']:>5}  {r['area']:<40}  {'#' * (30 * r['n'] // most)}{'  < gap' if r['n'] < threshold else ''}" for r in sorted(rows, key=lambda r: (-r["n"], r["area"]))]
    thin = [f"  {r['n']:>3}  {r['area']}" for r in sorted(rows, key=lambda r: (r["n"], r["area"])) if r["n"] < threshold]
    tail = [f"{rows[0]['unclassified']:>5}  {C.NONE}"] if rows else []
    return "\n".join([*lines, *tail, *(["", f"Below {threshold}, thinnest first:", *thin] if thin else [])])


def render_communities(report: C.Report, min_size: int = 10) -> str:
    """A ``communities.Report`` as text."""
    size = report.communities.agg(F.count("*").alias("n"), F.sum("size").alias("nodes"), F.sum("degree_sum").alias("ends")).first()
    lines = [f"{size.n} communities of {size.nodes or 0} nodes and {(size.ends or 0) // 2} edges, modularity {report.modularity.first().q or 0.0:.4f}", ""]
    lines += [f"C{r.community}  {r['size']} nodes, {r.internal_edges} inside, {r.label}: {r['sample']}" for r in report.communities.where(F.col("size") >= min_size).orderBy("community").limit(50).collect()]
    lines += ["", "Between the others:"] + [f"{r.id}  degree {r.degree}, betweenness {r.betweenness:.4f}: {r.text}" for r in report.gods.orderBy(F.desc("betweenness"), "id").collect()]
    lines += ["", "Missing links:"] + [f"C{r.a} ({r.a_label}) <-> C{r.b} ({r.b_label}): {r.observed} of {r.expected:.1f} edges" for r in report.gaps.collect()]
    return "\n".join([*lines, "", f"isolated: {report.isolated.count()}, unclassified: {report.unclassified.first().unclassified}"])


def strategy(metrics: list[dict], areas: dict[str, int], focus: set[str] = frozenset(), batch_size: int = 4) -> dict:
    """What the next batch run should do, by the last six ``metrics`` and the nodes an area: smaller batches after two
    time-outs, more weight for thin areas and those in ``focus``, and rules for findings."""
    recent = metrics[-6:]
    n = lambda key: sum(int(r.get(key) or 0) for r in recent)
    late = sum(bool(r.get("timed_out")) for r in recent)
    if late >= 2:
        batch_size = 3
    elif late == 0 and all((r.get("nodes_added") or 0) > 0 for r in recent[-3:]):
        batch_size = 4
    total = sum(areas.values()) or 1
    out = {"topic_weights": {a: round((2.0 if a in focus else 1.0) * (2.0 - c / total), 3) for a, c in areas.items()}, "findings_rules": [], "batch_size": batch_size}
    if n("nodes_added") and n("islands_found") / n("nodes_added") > 0.1:
        out["findings_rules"].append("Over a tenth of the new nodes are islands: each finding should touch two known topics.")
    if n("true_merges") >= 3:
        out["findings_rules"].append("Many findings are duplicates: search before adding one, and take it only if little is found.")
    words = sorted({w for r in recent for w in r.get("marker_words") or []})
    if words:
        out["findings_rules"].append("Words that stopped recent runs: " + ", ".join(words))
        out["blocked_marker_words"] = words
    return out


def write_report(spark, path: str, report: dict) -> None:
    """Puts the rendered report in place of the last one; an empty one is refused."""
    from knotwork.sources.state import write_text

    write_text(spark, path, render(report))


def write_strategy(spark, path: str, plan: dict) -> None:
    from knotwork.sources.state import write_text

    write_text(spark, path, json.dumps(plan, indent=2, ensure_ascii=False, sort_keys=True) + "\n")


def append_metrics(spark, path: str, row: dict) -> None:
    """One more line of a run's figures."""
    spark.createDataFrame([(json.dumps(row, ensure_ascii=False, sort_keys=True),)], "value string").coalesce(1).write.mode("append").text(path)
