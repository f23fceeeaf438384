"""Declarative queries over the views of ``sources.tables``, one plan each.

Those that ``queries`` answers through the operators serve as the other engine's statement of the same
result; the rest run as they stand in both.

``{nodes}`` and its like stand for a view. A plan may begin with CTEs (without the word
"with"), divided from its main select by a line "--". Counts and ranks are cast, and
scores rounded, so that types and values agree between engines.
"""

NOW_S = 1719792000  # 2024-07-01, the "now" of every age
LIVE = "not rejected and to_s is null"
_DEGREE = f"ends as (select source as id from {{edges}} where {LIVE} union all select target from {{edges}} where {LIVE}), degree as (select id, count(*) as deg from ends group by id)"
_SHOWN = f"live as (select e.* from {{edges}} e where {LIVE} and not pending and source in (select id from {{nodes}} where status <> 'tombstone') and target in (select id from {{nodes}} where status <> 'tombstone'))"
_PAIRS = f"und as (select distinct least(source, target) as a, greatest(source, target) as b from {{edges}} where {LIVE} and source <> target and source in (select id from {{nodes}} where status <> 'tombstone') and target in (select id from {{nodes}} where status <> 'tombstone'))"
_BOTH = _PAIRS + ", adj as (select a as u, b as v from und union all select b, a from und)"
_STATS = "counted as (select id, count(*) as c from {words} group by id), lens as (select n.id, coalesce(c, 0) as len from {nodes} n left join counted on n.id = counted.id where status <> 'tombstone'), total as (select count(*) as n, avg(len) as avgdl from lens)"
_BM25 = (
    _STATS
    + """, tf as (select id, word, count(*) as tf from {words} where word in (select word from {searches}) group by id, word),
df as (select word, count(*) as df from tf group by word),
qn as (select qid, word, count(*) as qn from {searches} group by qid, word),
bm25 as (select qid, tf.id, round(sum(qn * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avgdl))), 9) as score
 from qn join tf on qn.word = tf.word join df on tf.word = df.word join lens on tf.id = lens.id cross join total group by qid, tf.id)"""
)
_DENSE = """norm as (select id, sqrt(sum(w * w)) as nd from {embeds} group by id), qnorm as (select qid, sqrt(sum(w * w)) as nq from {sembeds} group by qid),
dots as (select qid, id, sum(e.w * s.w) as dot from {sembeds} s join {embeds} e on s.dim = e.dim group by qid, id),
dense as (select dots.qid, dots.id, round(dot / (nd * nq), 9) as score from dots join norm on dots.id = norm.id join qnorm on dots.qid = qnorm.qid)"""
_RANKED = """db as (select qid, id, row_number() over (partition by qid order by score desc, id) as rk from bm25 where score > 0),
overlap as (select qid, id from dense where score > 0 union select qid, id from bm25 where score > 0),
dd as (select o.qid, o.id, row_number() over (partition by o.qid order by coalesce(score, 0) desc, o.id) as rk from overlap o left join dense d on o.qid = d.qid and o.id = d.id),
fused as (select qid, id, round(sum(1.0e0 / (60 + rk)), 9) as rrf from (select * from db union all select * from dd) x group by qid, id)"""
_TOP = "select qid, cast(rank as bigint) as rank, id, round({score}, {digits}) as {score} from (select *, row_number() over (partition by qid order by {score} desc, id) as rank from {rows} where {score} > 0) r where rank <= {k}"


def _top(rows: str, score: str, k: int) -> str:
    return _TOP.replace("{score}", score).replace("{rows}", rows).replace("{k}", str(k)).replace("{digits}", "6" if score == "score" else "9")


# Lower case, runs of white space as one space: a space and a mark for each, then no mark before a space.
_NORMAL = "lower(text)"
for _code in (9, 10, 11, 12, 13):
    _NORMAL = f"replace({_NORMAL}, chr({_code}), ' ')"
_NORMAL = f"trim(replace(replace(replace({_NORMAL}, ' ', ' ' || chr(1)), chr(1) || ' ', ''), chr(1), ''))"

# (area, id) of each live node whose folded text has a keyword with no letter, digit or underscore on either side.
# chr(92) is a backslash, which the engines' literals write differently; \Q and \E quote the keyword.
_FOLDED = "lower(coalesce(text, ''))"
for _letter, _plain in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")):
    _FOLDED = f"replace({_FOLDED}, '{_letter}', '{_plain}')"
_OTHER = "[^_' || chr(92) || 'pL' || chr(92) || 'pN]"
_HITS = f"""folded as (select id, {_FOLDED} as body from {{nodes}} where status <> 'tombstone'),
hit as (select distinct area, id from {{taxonomy}} join folded on regexp_extract(body, '(^|{_OTHER})(' || chr(92) || 'Q' || keyword || chr(92) || 'E)($|{_OTHER})', 2) <> '')"""

_INTENT = "kind in ('supersedes', 'contradicts', 'continues')"

PLANS = {
    # retrieval
    "bm25_topk": _BM25 + "\n--\n" + _top("bm25", "score", 10),
    "dense_topk": _DENSE + "\n--\n" + _top("dense", "score", 10),
    "hybrid_search": _BM25 + ",\n" + _DENSE + ",\n" + _RANKED + "\n--\n" + _top("fused", "rrf", 10),
    "rerank_reverse": _BM25 + ",\n" + _DENSE + ",\n" + _RANKED + ",\ncand as (" + _top("fused", "rrf", 30) + "), rev as (select qid, id, rrf, row_number() over (partition by qid order by rank desc) as rank from cand)\n--\nselect qid, cast(rank as bigint) as rank, id, rrf from rev where rank <= 5",
    "hash_embed": "norms as (select id, sqrt(sum(w * w)) as n from {embeds} group by id)\n--\nselect e.id, cast(dim as bigint) as dim, round(w / n, 9) as w from {embeds} e join norms on e.id = norms.id",
    "bm25_index": _STATS + "\n--\nselect word, cast(count(distinct id) as bigint) as df, cast(count(*) as bigint) as cf from {words} group by word",
    # hygiene and reports
    "connectivity": _DEGREE + f"""
--
select cast(count(*) as bigint) as total, (select cast(count(*) as bigint) from {{edges}} where {LIVE}) as edges,
 cast(count(case when coalesce(deg, 0) <= 1 then 1 end) as bigint) as islands, cast(count(case when deg = 2 then 1 end) as bigint) as weak,
 cast(count(case when deg is null then 1 end) as bigint) as orphans, cast(max(coalesce(deg, 0)) as bigint) as max_degree, round(avg(coalesce(deg, 0)), 6) as mean_degree
from {{nodes}} n left join degree d on n.id = d.id where status <> 'tombstone'""",
    "degrees": _DEGREE + "\n--\nselect n.id, cast(coalesce(deg, 0) as bigint) as degree, round(1 + log2(1 + coalesce(deg, 0)), 6) as size from {nodes} n left join degree d on n.id = d.id where status <> 'tombstone'",
    "status_counts": "select status, cast(count(*) as bigint) as n from {nodes} group by status",
    "edge_mix": f"select kind, cast(count(*) as bigint) as n from {{edges}} where {LIVE} group by kind",
    "conf_bands": f"""select case when confidence is null then 'none' when confidence < 0.45 then 'none' when confidence < 0.75 then 'low' when confidence < 0.95 then 'mid' else 'auto' end as band,
 cast(count(*) as bigint) as n from {{edges}} where {LIVE} group by 1""",
    "band_kinds": "select id, confidence, case when confidence >= 0.75 then 'similar' when confidence >= 0.45 then 'extends' end as expected, confidence >= 0.95 as auto_accept from {edges} where confidence is not null",
    "conf_floor": """ranked as (select *, row_number() over (partition by source order by confidence desc, id) as rk from {edges} where confidence is not null)
--
select source, target, confidence, cast(rk as bigint) as rank from ranked where rk <= 3 and confidence >= 0.5""",
    "extends_only": f"ends as (select source as id, kind from {{edges}} where {LIVE} union all select target, kind from {{edges}} where {LIVE})\n--\nselect id, cast(count(*) as bigint) as n from ends group by id having min(kind) = 'extends' and max(kind) = 'extends'",
    "intent_queue": f"""select source, cast(count(*) as bigint) as fan_out, cast(count(case when pending then 1 end) as bigint) as pending,
 case when min(kind) = max(kind) then min(kind) else 'mixed' end as kind, count(*) >= 3 as warn
from {{edges}} where {LIVE} and kind in ('contradicts', 'supersedes') group by source""",
    "hubs": _DEGREE + "\n--\nselect id, cast(deg as bigint) as degree from degree order by deg desc, id limit 10",
    "degree_pct": _DEGREE + """, every as (select coalesce(deg, 0) as deg from {nodes} n left join degree d on n.id = d.id where status <> 'tombstone'), ranked as (select deg, row_number() over (order by deg) - 1 as pos, count(*) over () as n from every)
--
select cast(max(case when pos = least(cast(floor(0.5 * n) as bigint), n - 1) then deg end) as bigint) as p50, cast(max(case when pos = least(cast(floor(0.9 * n) as bigint), n - 1) then deg end) as bigint) as p90,
 cast(max(case when pos = least(cast(floor(0.99 * n) as bigint), n - 1) then deg end) as bigint) as p99 from ranked""",
    "since_deltas": f"""select (select cast(count(*) as bigint) from {{nodes}} where status <> 'tombstone' and created_s >= 1704067200 + 6000) as nodes, (select cast(count(*) as bigint) from {{edges}} where {LIVE} and from_s >= 1704067200 + 6000) as edges,
 (select cast(count(*) as bigint) from {{edges}} where {LIVE} and from_s >= 1704067200 + 6000 and kind in ('contradicts', 'supersedes')) as intent_edges, (select cast(count(*) as bigint) from {{nodes}} where status = 'tombstone' and created_s >= 1704067200 + 6000) as tombstones""",
    "brain_status": f"""select (select cast(count(*) as bigint) from {{nodes}} where status <> 'tombstone') as nodes, (select cast(count(*) as bigint) from {{edges}} where {LIVE}) as edges,
 (select cast(count(*) as bigint) from {{edges}} where pending and not rejected) as pending, (select cast(count(*) as bigint) from {{recalls}}) as recalls""",
    # liveness presets
    "live_edges_graph": "select e.id from {edges} e left join {nodes} s on e.source = s.id left join {nodes} t on e.target = t.id where not rejected and to_s is null and not pending and coalesce(s.status, '') <> 'tombstone' and coalesce(t.status, '') <> 'tombstone'",
    "live_edges_hygiene": f"select id from {{edges}} where {LIVE}",
    "live_edges_communities": _PAIRS + "\n--\nselect a, b from und",
    "live_edges_dream": f"select id from {{edges}} where {LIVE} and not pending",
    "live_edges_ui": f"select id from {{edges}} where {LIVE} and source in (select id from {{nodes}}) and target in (select id from {{nodes}})",
    "edges_as_of": "select id, kind from {edges} where not rejected and from_s <= 900000000 and (to_s is null or to_s > 900000000)",
    "pending_list": "select e.id, kind, substr(s.text, 1, 60) as source_text, substr(t.text, 1, 60) as target_text from {edges} e left join {nodes} s on e.source = s.id left join {nodes} t on e.target = t.id where pending and not rejected",
    # lookups
    "node_scan": "select id, source, ntype, status, cast(length(text) as bigint) as chars from {nodes}",
    "read_node": "select id, status, cast(length(text) as bigint) as chars from {nodes} where id = 'd00000042'",
    "get_node": f"""select id, other, kind, direction, pending from (
 select id, target as other, kind, 'out' as direction, pending from {{edges}} where source = 'd00000042' and {LIVE}
 union all select id, source, kind, 'in', pending from {{edges}} where target = 'd00000042' and {LIVE}) x where other in (select id from {{nodes}})""",
    "substring_search": "select id, substr(text, 1, 40) as snippet from {nodes} where status <> 'tombstone' and lower(text) like '%the thing%' order by id limit 12",
    "find_by_text": f"""sought as (select item_id, text from {{benchmark}} union all select 1000000 + seq, split_part(coalesce(text, ''), '.', 1) from {{numbered}}), want as (select item_id, {_NORMAL} as ref from sought), given as (select id, {_NORMAL} as body from {{nodes}}),
ranked as (select item_id, id, body = ref as exact, row_number() over (partition by item_id order by case when body = ref then 0 else 1 end, length(body), id) as rk from want join given on substr(body, 1, 8) = substr(ref, 1, 8) and substr(body, 1, length(ref)) = ref where length(ref) >= 8)
--
select item_id, id, exact from ranked where rk = 1""",
    "neighbor_kinds": f"select kind, cast(count(*) as bigint) as n from {{edges}} where {LIVE} and not pending and (source = 'd00000042' or target = 'd00000042') group by kind",
    # graph
    "neighbors_1hop": _SHOWN + """, hop as (select case when source = 'd00000042' then target else source end as id, kind, case when source = 'd00000042' then 'out' else 'in' end as direction, seq from live where source = 'd00000042' or target = 'd00000042'),
first as (select *, row_number() over (partition by id order by kind, seq) as rk from hop where id <> 'd00000042')
--
select id, kind, direction, cast(1 as bigint) as hops from first where rk = 1""",
    "neighbors_2hop": _SHOWN + """, arcs as (select source as u, target as v, kind, seq, 'out' as direction from live where source <> target union all select target, source, kind, seq, 'in' from live where source <> target),
one as (select v as id, kind, direction, row_number() over (partition by v order by kind, seq) as rk from arcs where u = 'd00000042'),
near as (select id, kind, direction, row_number() over (order by kind, id) as ord from one where rk = 1),
two as (select b.v as id, b.kind, case when b.direction = 'out' then 'in' else 'out' end as direction, row_number() over (partition by b.v order by near.ord, b.kind, b.seq) as rk
 from near join arcs b on b.u = near.id where b.v <> 'd00000042' and b.v not in (select id from near))
--
select id, kind, direction, cast(1 as bigint) as hops from near union all select id, kind, direction, cast(2 as bigint) from two where rk = 1""",
    "undirected_graph": _PAIRS + "\n--\nselect a, b from und",
    "isolated": _BOTH + "\n--\nselect n.id from {nodes} n left join adj on n.id = adj.u where status <> 'tombstone' and adj.u is null",
    "shortest_path": _BOTH + """, d1 as (select v, u || '>' || v as path from adj where u = 'd00000042'), d2 as (select adj.v, min(d1.path || '>' || adj.v) as path from d1 join adj on adj.u = d1.v where adj.v <> 'd00000042' and adj.v not in (select v from d1) group by adj.v),
d3 as (select adj.v, min(d2.path || '>' || adj.v) as path from d2 join adj on adj.u = d2.v where adj.v <> 'd00000042' and adj.v not in (select v from d1) and adj.v not in (select v from d2) group by adj.v),
d4 as (select adj.v, min(d3.path || '>' || adj.v) as path from d3 join adj on adj.u = d3.v where adj.v <> 'd00000042' and adj.v not in (select v from d1) and adj.v not in (select v from d2) and adj.v not in (select v from d3) group by adj.v)
--
select v as id, path from d1 union all select v, path from d2 union all select v, path from d3 union all select v, path from d4""",
    "modularity": _BOTH + """, cut as (select count(*) as m from und), ld as (select n.lang, count(*) as degree_sum from adj join {nodes} n on n.id = adj.u group by n.lang),
inside as (select x.lang, count(*) as n from und join {nodes} x on x.id = a join {nodes} y on y.id = b where x.lang = y.lang group by x.lang)
--
select round(sum(coalesce(n, 0) / (1.0e0 * m) - power(degree_sum / (2.0e0 * m), 2)), 6) as q from ld left join inside on ld.lang = inside.lang cross join cut""",
    "community_stats": _BOTH + """, deg as (select u as id, count(*) as d from adj group by u), ranked as (select lang, n.id, d, row_number() over (partition by lang order by coalesce(d, 0) desc, n.id desc) as rk from {nodes} n left join deg on n.id = deg.id where status <> 'tombstone'),
inside as (select x.lang, count(*) as n from und join {nodes} x on x.id = a join {nodes} y on y.id = b where x.lang = y.lang group by x.lang)
--
select r.lang as community, cast(count(*) as bigint) as size, cast(max(coalesce(n, 0)) as bigint) as internal_edges, cast(sum(coalesce(d, 0)) as bigint) as degree_sum, max(case when rk = 1 then id end) as hub from ranked r left join inside on inside.lang = r.lang group by r.lang""",
    "structural_gaps": _BOTH + """, cut as (select count(*) as m from und), ld as (select n.lang, count(*) as d from adj join {nodes} n on n.id = adj.u group by n.lang),
seen as (select least(x.lang, y.lang) as a, greatest(x.lang, y.lang) as b, count(*) as observed from und join {nodes} x on x.id = und.a join {nodes} y on y.id = und.b where x.lang <> y.lang group by 1, 2)
--
select p.lang as a, q.lang as b, cast(coalesce(observed, 0) as bigint) as observed, round(p.d * q.d / (2.0e0 * m), 6) as expected, round((p.d * q.d / (2.0e0 * m) - coalesce(observed, 0)) / (p.d * q.d / (2.0e0 * m)), 6) as deficit
from ld p join ld q on p.lang < q.lang left join seen on seen.a = p.lang and seen.b = q.lang cross join cut""",
    # coverage by word boundary, of the areas and keywords of {taxonomy}
    "coverage": f"""{_HITS}, ranked as (select *, row_number() over (partition by area order by id) as rk from hit)
--
select x.area, cast(count(id) as bigint) as n, min(id) as first_example, max(case when rk <= 5 then id end) as fifth_example,
 (select cast(count(*) as bigint) from folded where id not in (select id from hit)) as unclassified from (select distinct area from {{taxonomy}}) x left join ranked r on x.area = r.area group by x.area""",
    "coverage_gaps": f"""{_HITS}, counted as (select area, count(*) as n from hit group by area)
--
select x.area, cast(coalesce(n, 0) as bigint) as n from (select distinct area from {{taxonomy}}) x left join counted on x.area = counted.area where coalesce(n, 0) < 10""",
    "taxonomy_substring": """areas as (select 'articles' as area, 'the' as keyword union all select 'pronouns', 'this' union all select 'absent', 'zyzzyva')
--
select area, cast(count(distinct id) as bigint) as n from areas join {nodes} n on lower(text) like '%' || keyword || '%' where status <> 'tombstone' group by area""",
    # decisions
    "intent_cap": f"""ranked as (select id, source, target, row_number() over (partition by source order by target, id) as rk from {{edges}} where {LIVE} and {_INTENT})
--
select id, source, rk > 3 as pending from ranked""",
    "accept_pending": f"""live as (select source, count(*) as n from {{edges}} where {LIVE} and not pending and {_INTENT} group by source),
queue as (select e.*, case when {_INTENT} then row_number() over (partition by source, {_INTENT} order by id) end as rk from {{edges}} e where {LIVE} and pending)
--
select id, rk is null or coalesce(n, 0) + rk <= 3 as accepted from queue left join live on queue.source = live.source""",
    "lifecycle": """deg as (select id, count(*) as deg from (select source as id from {edges} where not rejected and to_s is null and not pending union all select target from {edges} where not rejected and to_s is null and not pending) x group by id),
used as (select id, count(*) as recalls from {recalls} group by id),
facts as (select n.id, status, coalesce(deg, 0) as deg, coalesce(recalls, 0) as recalls, (1719792000 - created_s) / 86400.0e0 as age from {nodes} n left join deg on n.id = deg.id left join used on n.id = used.id where status <> 'tombstone'),
moves as (select id, status, case when status = 'probation' and recalls >= 1 and deg >= 2 then 'promote' when status = 'stale' and recalls >= 1 and deg >= 2 then 'revive' when status in ('probation', 'active') and recalls = 0 and deg <= 2 and age >= 30 then 'decay' end as move from facts)
--
select id, status as before, case when move = 'decay' then 'stale' else 'active' end as after, move from moves where move is not null""",
    "decay_levels": """used as (select id, count(*) as recalls from {recalls} group by id),
scored as (select n.id, (1719792000 - created_s) / 86400.0e0 as age, coalesce(recalls, 0) as n from {nodes} n left join used on n.id = used.id),
curve as (select id, case when age <= 0 then 1.0e0 else exp(-power(age / 30.0e0, 1.5e0)) end as kept, case when n <= 0 then 0.0e0 else 1 - exp(-n / 10.0e0) end as held from scored)
--
select id, round(kept, 9) as decay, round(held, 9) as retention, case when held * kept >= 0.6 then 'record' when held * kept >= 0.4 then 'summary' when held * kept >= 0.2 then 'gist' else 'tombstone' end as level from curve""",
    "refresh_kinds": f"select id, kind, case when confidence >= 0.75 then 'similar' else 'extends' end as expected from {{edges}} where {LIVE} and confidence is not null and kind in ('similar', 'extends') and kind <> case when confidence >= 0.75 then 'similar' else 'extends' end",
    "recall_fold": """ranked as (select id, q, row_number() over (partition by id order by q) as rk from (select distinct id, q from {recalls}) x),
few as (select id, count(*) as kept, min(q) as first_q, max(q) as last_q from ranked where rk <= 25 group by id)
--
select r.id, cast(count(*) as bigint) as recalls, max(cast(kept as bigint)) as kept, max(first_q) as first_q, max(last_q) as last_q, max(ts_s) as last_s from {recalls} r join {nodes} n on r.id = n.id join few on few.id = r.id group by r.id""",
    "recall_top": "select id, cast(count(*) as bigint) as recalls from {recalls} group by id order by count(*) desc, id limit 10",
    "recall_windows": "select id, ts_s - ts_s % 86400 as day_s, cast(count(*) as bigint) as n from {recalls} group by id, ts_s - ts_s % 86400",
    "forget": f"select id, 'tombstone' as new_status, (select cast(count(*) as bigint) from {{edges}} where {LIVE} and (source = 'd00000042' or target = 'd00000042')) as closed from {{nodes}} where id = 'd00000042' and status <> 'tombstone'",
    "resolve_edge": "select id, case when seq % 8 = 0 then false else pending end as pending, case when seq % 8 = 4 then true else rejected end as rejected from {edges} where pending and to_s is null and not rejected",
    "undo_edge": "select id, pending, rejected from (select id, case when not pending and to_s is null then true else pending end as pending, case when not pending and to_s is null then false else rejected end as rejected, pending as was from {edges}) x where not was and pending",
    "invalidate_edges": f"select id, from_s, 1719792000 as to_s from {{edges}} where {LIVE} and source = 'd00000042'",
    "link_check": f"""want as (select distinct source as a, target as b, 'extends' as kind from {{edges}}), have as (select source, target, kind, count(*) as n from {{edges}} where {LIVE} group by source, target, kind)
--
select a, b, cast(coalesce(n, 0) as bigint) as existing from want left join have on source = a and target = b and have.kind = want.kind""",
    "merge_edges": """marked as (select *, source = 'd00000043' and kind in ('supersedes', 'ersetzt', 'contradicts', 'replaces', 'obsoletes', 'korrigiert', 'widerspricht') as stays from {edges} where not rejected),
moved as (select seq, id, kind, to_s, case when source = 'd00000043' then 'd00000042' else source end as s, case when target = 'd00000043' then 'd00000042' else target end as t from marked where not stays),
ranked as (select *, row_number() over (partition by least(s, t), greatest(s, t) order by seq) as rk from moved where s <> t)
--
select id, s as source, t as target, coalesce(cast(to_s as bigint), 0) as to_s from ranked where rk = 1 union all select id, source, target, coalesce(to_s, 1719792000) from marked where stays
union all select id, source, target, coalesce(to_s, 0) from {edges} where rejected and source <> 'd00000043' and target <> 'd00000043'""",
    "backfill_origin": f"select id, case when {_INTENT} then 'intent' when confidence is not null then 'suggester' else 'manual' end as origin from {{edges}}",
    "migrate_kinds": "old as (select id, case when seq % 2 = 0 and kind = 'similar' then case when seq % 3 = 0 then 'ähnlich' else 'aehnlich' end when seq % 2 = 0 and kind = 'extends' then 'erweitert' when seq % 2 = 0 and kind = 'contradicts' then 'kontradiktorisch' else kind end as k from {edges})\n--\nselect id, case k when 'aehnlich' then 'similar' when 'ähnlich' then 'similar' when 'erweitert' then 'extends' when 'kontradiktorisch' then 'contradicts' else k end as kind from old",
    "index_md": "select id, '| [' || replace(substr(coalesce(text, ''), 1, 60), '|', '\\\\|') || '](nodes/' || id || '.md) | ' || coalesce(source, '') as line from {nodes} where status <> 'tombstone'",
    "findings_collect": "ranked as (select conv_id, turn, role as source, text, row_number() over (partition by text order by conv_id, turn) as rk from {conversations} where text is not null and trim(text) <> '')\n--\nselect conv_id, turn, source, text from ranked where rk = 1",
    "adapt_strategy": "counts as (select lang as area, count(*) as n from {nodes} group by lang), total as (select sum(n) as t from counts)\n--\nselect area, round((case when area = 'de' then 2 else 1 end) * (1 + 1 - n / (1.0e0 * t)), 3) as weight from counts cross join total",
    "origin_minimum": f"select origin, cast(sum(n) as bigint) as n, cast(max(n) as bigint) as most from (select source, origin, count(*) as n from (select source, case when {_INTENT} then 'intent' when confidence is not null then 'suggester' else 'manual' end as origin from {{edges}} where {LIVE} and not pending) e group by source, origin) x group by origin",
    "summary_ids": "select source, 'c' || substr(sha1(string_agg(id, '|' order by id)), 1, 11) as id from {nodes} where status <> 'tombstone' group by source",
    "consolidate_duplicates": "ranked as (select id, row_number() over (partition by lower(trim(text)) order by id) as rk, min(id) over (partition by lower(trim(text))) as survivor from {nodes} where status <> 'tombstone')\n--\nselect id, survivor from ranked where rk > 1",
    "dream_plan": f"""deg as (select id, count(*) as deg from (select source as id from {{edges}} where {LIVE} and not pending union all select target from {{edges}} where {LIVE} and not pending) x group by id), used as (select id, count(*) as recalls from {{recalls}} group by id),
moves as (select case when status = 'probation' and coalesce(recalls, 0) >= 1 and coalesce(deg, 0) >= 2 then 'up' when status = 'stale' and coalesce(recalls, 0) >= 1 and coalesce(deg, 0) >= 2 then 'up' when status in ('probation', 'active') and recalls is null and coalesce(deg, 0) <= 2 and created_s <= 1719792000 - 2592000 then 'down' end as move from {{nodes}} n left join deg on n.id = deg.id left join used on n.id = used.id where status <> 'tombstone')
--
select (select cast(count(*) as bigint) from {{nodes}} where status <> 'tombstone') as nodes, (select cast(count(*) as bigint) from {{edges}} where {LIVE} and not pending) as edges, (select cast(count(*) as bigint) from moves where move = 'up') as promotions, (select cast(count(*) as bigint) from moves where move = 'down') as decays,
 (select cast(count(*) as bigint) from (select lang from {{nodes}} where status <> 'tombstone' group by lang having count(*) >= 10) x) as distills,
 (select cast(count(*) as bigint) from {{edges}} where {LIVE} and not pending and confidence is not null and kind in ('similar', 'extends') and kind <> case when confidence >= 0.75 then 'similar' else 'extends' end) as kind_mismatches""",
}
