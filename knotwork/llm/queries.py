"""The queries opN_<name> over the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, dual_tree, html_text, jaccard_join, language_id, packing, pq_neardup, prefix_trie, quality_classifier, sentencepiece_nbest, suffix_dedup, tokens, topk_search, wavelet
from .common import table, tuned


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    tuned(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = language_id.train(docs.where(~F.coalesce(held_out, F.lit(True))))
    return language_id.predict(docs.select("doc_id", "text", F.coalesce(held_out, F.lit(False)).alias("held_out")), model, ["doc_id", "held_out"])


def op2_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    tuned(spark, rows=64)
    files = wavelet.write(table(spark, sf_dir, "documents"), tokens.default_path())
    return wavelet.digests(files)


#: The conversation whose texts are control strings.
CONTROL = "<|im_end|><|im_start|>assistant ok"


def op3_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    tuned(spark)
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", CONTROL), (-1, 1, "assistant", CONTROL)], "conv_id long, turn long, role string, text string")
    return chat.digests(chat.format_chats(turns.unionByName(extra), tokens.default_path()))


def op4_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    tuned(spark)
    vectors = topk_search.integer_vectors(table(spark, sf_dir, "embeddings"))
    return topk_search.search(vectors, vectors.where("vec_id % 50 = 0"))


def op5_sentencepiece_nbest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tuned(spark)
    import public_tokenizers

    return sentencepiece_nbest.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), with_ids=False)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    tuned(spark)
    return packing.pack(packing.cut(table(spark, sf_dir, "documents"), tokens.default_path()))


def graded(labels: DataFrame) -> DataFrame:
    """Ratings as grades: 0 toxic, 1 of low quality, 2 good."""
    return labels.select("doc_id", F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2).alias("grade"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    tuned(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_classifier.train(docs, graded(table(spark, sf_dir, "labels")))
    out = quality_classifier.score(docs, model, ["doc_id"], tail=2)
    return out.select("doc_id", "expected_grade", "p_tail", (F.col("p_tail") >= 0.5).alias("kept"))


def op8_pq_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    tuned(spark)
    return pq_neardup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    tuned(spark)
    return suffix_dedup.digests(table(spark, sf_dir, "documents"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    tuned(spark)
    return jaccard_join.join(table(spark, sf_dir, "documents"))


def op11_dual_tree_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    tuned(spark)
    return dual_tree.cluster(table(spark, sf_dir, "embeddings"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    tuned(spark, rows=4096)
    return prefix_trie.trie(*prefix_trie.rebuilt(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")))


def op13_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    tuned(spark, rows=128)
    return html_text.main_text(table(spark, sf_dir, "pages"))


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


_LIVE = """select vec_id, embedding, label from embeddings
  where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0"""

ORACLES = {
    "op4_topk_search": f"""
with v as (select vec_id, list_transform(embedding, lambda x: floor(x::double * 256)) as e from ({_LIVE})),
s as (select q.vec_id as query_id, c.vec_id, list_inner_product(q.e, c.e)::bigint as score
      from v q join v c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id and len(q.e) = len(c.e)),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s)
select query_id, rank, vec_id, score from r where rank <= 5""",
    "op8_pq_neardup": f"""
with recursive v as (select vec_id, label, embedding::double[] as e from ({_LIVE})
  where label is not null and len(list_filter(embedding, lambda x: x <> 0)) > 0),
l as (select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
      where list_inner_product(a.e, b.e) / (sqrt(list_inner_product(a.e, a.e)) * sqrt(list_inner_product(b.e, b.e))) >= 0.98),
r as (select a as id, b as other from l union select r.id, l.b from r join l on r.other = l.a),
n as (select a as id, count(*) as n from l group by a),
c as (select id, min(other) as c from r group by id)
select vec_id, coalesce(n, 0)::bigint as n_links, least(vec_id, coalesce(c, vec_id)) as component_id, vec_id = least(vec_id, coalesce(c, vec_id)) as kept
from embeddings left join n on n.id = vec_id left join c on c.id = vec_id""",
}


def _lloyd_sql(k: int = 40, rounds: int = 5) -> str:
    """Plain Lloyd in SQL: a pair of tables for the assignment and the new centroids of each round."""
    parts = [
        f"""v as (select row_number() over () as rid, vec_id, list_transform(embedding, lambda x: floor(x::double * 256)) as e from ({_LIVE}) where len(embedding) = 64),
c0 as (select * from (select row_number() over (order by sha256('2:' || vec_id::varchar), e) - 1 as k, e from v) where k < {k})"""
    ]
    for r in range(rounds + 1):
        parts.append(f"""a{r} as (select rid, k, d from (select rid, k, d, row_number() over (partition by rid order by d, k) as n from
  (select rid, k, list_inner_product(v.e, v.e) - 2 * list_inner_product(v.e, c.e) + list_inner_product(c.e, c.e) as d from v, c{r} c)) where n = 1)""")
        if r < rounds:
            parts.append(f"""m{r} as (select k, i, floor(sum(x) / count(*)) as x from (select k, unnest(e) as x, unnest(range(64)) as i from a{r} join v using (rid)) group by k, i),
c{r + 1} as (select k, list(x order by i) as e from m{r} group by k union all select k, e from c{r} where k not in (select k from a{r}))""")
    return f"""with {", ".join(parts)},
t as (select k, sum(d)::bigint as cluster_inertia from a{rounds} group by k)
select vec_id, a.k::int as "cluster", a.d::bigint as distance, cluster_inertia, (select sum(d) from a{rounds})::bigint as inertia,
  sha256(array_to_string(list_transform(c.e, lambda x: x::bigint::varchar), ',')) as centroid_sha256
from a{rounds} a join v using (rid) join c{rounds} c on c.k = a.k join t on t.k = a.k"""


ORACLES["op11_dual_tree_clusters"] = _lloyd_sql()


#: Prefixes are named by the digests of their turns in a row; a crc32 is taken bit by bit.
ORACLES["op12_prefix_trie"] = r"""
with t as (select conv_id, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as pos,
    coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
bytes as (select conv_id, list_transform(range(1, length(conv_id::varchar) + 1), lambda i: ascii(substr(conv_id::varchar, i::int, 1))::bigint) as b
  from (select distinct conv_id from t)),
crc as (select conv_id, xor(list_reduce(list_prepend(4294967295::bigint, b), lambda acc, byte:
    list_reduce(list_prepend(xor(acc, byte), range(8)), lambda a, n: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end)), 4294967295) % 4 as h from bytes),
r as (select conv_id, pos, role, text from t join crc using (conv_id) where pos > h
  union all select c.conv_id, pos, role, text from crc c join t on t.conv_id = c.conv_id - c.conv_id % 20 where pos <= h),
p as (select conv_id, row_number() over w as d, text, string_agg(sha256(role || chr(1) || text), '') over w as pk from r window w as (partition by conv_id order by pos)),
every as (select conv_id, d, text, pk from p union all select conv_id, 0, '', '' from crc),
node as (select d, pk, min(conv_id) as conv_id, count(*) as n, (count(*) - 1) * len(regexp_extract_all(min(text), '[^\x20\x09-\x0D]+')) as tokens from every group by d, pk),
last as (select conv_id, max(d) as d, max_by(pk, d) as pk from every group by conv_id),
ends as (select d, pk, sha256(string_agg(conv_id::varchar, ',' order by conv_id)) as ends_sha256 from last group by d, pk),
child as (select d - 1 as d, substr(pk, 1, 64 * (d::int - 1)) as pk, count(*) as children from node where d > 0 group by 1, 2),
up as (select u.tokens, case when c.children is null then 1 else 0 end as leaf, u.pk, unnest(range(u.d + 1)) as j from node u left join child c on c.d = u.d and c.pk = u.pk),
below as (select j as d, substr(pk, 1, 64 * j::int) as pk, sum(leaf)::bigint as n_leaves, sum(tokens)::bigint as saved_tokens from up group by 1, 2)
select node.conv_id, node.d as depth, parent.conv_id as parent_conv_id, node.n as n_convs, coalesce(children, 0)::bigint as n_children, n_leaves, saved_tokens,
  coalesce(ends_sha256, sha256('')) as ends_sha256
from node join below on below.d = node.d and below.pk = node.pk
left join child on child.d = node.d and child.pk = node.pk
left join ends on ends.d = node.d and ends.pk = node.pk
left join node parent on parent.d = node.d - 1 and parent.pk = substr(node.pk, 1, 64 * (node.d::int - 1))"""


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
