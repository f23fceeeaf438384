"""The graph's tables as views of the driver's tables, and the same views in DuckDB's SQL.

nodes(id, text, source, lang, ntype, status, created_s), edges(seq, id, source, target, kind,
pending, rejected, from_s, to_s, confidence), recalls(ts_s, q, id), and words with hash
embeddings of documents and of search queries. Times are seconds since 1970, in UTC.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

START_S = 1704067200  # 2024-01-01
KINDS = ["similar", "extends", "contradicts", "supersedes", "continues"]
NTYPES = ["semantic", "episodic", "procedural"]
DIMS = 64


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def node_id(number) -> F.Column:
    return F.concat(F.lit("d"), F.lpad(number.cast("string"), 8, "0"))


def words_of(text) -> F.Column:
    """Lower-cased words between white space of any kind; punctuation stays."""
    return F.filter(F.split(F.lower(text), r"(?U)\s+"), lambda w: w != "")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    status = F.when(F.col("toxic") == 1, "tombstone").when(F.col("quality") == 1, "active").when(F.col("quality") == 0, "stale").otherwise("probation")
    ntype = F.element_at(F.array(*map(F.lit, NTYPES)), (F.col("doc_id") % 3 + 1).cast("int"))
    return docs.join(labels, "doc_id", "left").select(
        node_id(F.col("doc_id")).alias("id"), "text", "source", "lang", ntype.alias("ntype"), status.alias("status"), (F.lit(START_S) + F.col("doc_id") * 60).alias("created_s")
    )


def _size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row n: the number of documents, counted where the plan runs."""
    return F.broadcast(read(spark, sf_dir, "documents").agg(F.count("*").alias("n")))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n")
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("o_orderkey") % 5 + 1).cast("int"))
    start = F.unix_timestamp("o_orderdate")
    return read(spark, sf_dir, "orders").crossJoin(_size(spark, sf_dir)).select(
        F.col("o_orderkey").alias("seq"),
        F.concat(F.lit("e"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0")).alias("id"),
        node_id((F.col("o_orderkey") * 7 + 3) % n).alias("source"),
        node_id((F.col("o_custkey") * 13 + F.col("o_orderkey") % 17) % n).alias("target"),
        kind.alias("kind"),
        (F.col("o_orderkey") % 4 == 0).alias("pending"),
        (F.col("o_orderkey") % 13 == 0).alias("rejected"),
        start.alias("from_s"),
        F.when(F.col("o_orderkey") % 11 == 0, start + 30 * 86400).alias("to_s"),
        F.when(F.col("o_orderkey") % 5 < 2, (F.col("o_orderkey") * 37 % 1000) / 1000.0).alias("confidence"),
    )


def recalls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").crossJoin(_size(spark, sf_dir))
    return rows.select(F.unix_timestamp("ts").alias("ts_s"), F.substring(F.sha1("props"), 1, 10).alias("q"), node_id(F.col("user_id") % F.col("n")).alias("id"))


def searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search queries: all words of each benchmark text, in order, repetitions included."""
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.explode(words_of(F.col("text"))).alias("word"))


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes(spark, sf_dir).where("status <> 'tombstone'").select("id", F.explode(words_of(F.col("text"))).alias("word"))


def numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq"), "text")


def embedded(rows: DataFrame, key: str) -> DataFrame:
    """Hash embedding of ``rows(key, word)``: (key, dim, w) with whole weights, zero ones left out."""
    digest = F.sha2(F.col("word"), 256)
    nibble = lambda at, size: F.conv(F.substring(digest, at, size), 16, 10).cast("int")
    sign = F.when(nibble(62, 1) % 2 == 1, 1).otherwise(-1)
    counted = rows.groupBy(key, "word").agg(F.count("*").alias("n"))
    return counted.groupBy(key, (nibble(63, 2) % DIMS).alias("dim")).agg(F.sum(sign * F.col("n")).alias("w")).where("w <> 0")


#: The taxonomy of the coverage queries: areas of frequent words, one of them absent.
TAXONOMY = [("articles", "the"), ("articles", "der"), ("pronouns", "this"), ("pronouns", "that"), ("absent", "zyzzyva")]


def taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(area, keyword); keywords are in lower case, with umlauts spelt out."""
    return spark.createDataFrame(TAXONOMY, "area string, keyword string")


VIEWS = {
    "nodes": nodes,
    "edges": edges,
    "recalls": recalls,
    "words": words,
    "searches": searches,
    "taxonomy": taxonomy,
    "numbered": numbered,
    "embeds": lambda s, d: embedded(words(s, d), "id"),
    "sembeds": lambda s, d: embedded(searches(s, d), "qid"),
}

_EMBED = """(select {key}, dim, sum(n * s)::bigint as w from (
  select {key}, word, n, (('0x' || substr(sha256(word), 63, 2))::int % 64) as dim,
         case when ('0x' || substr(sha256(word), 62, 1))::int % 2 = 1 then 1 else -1 end as s
  from (select {key}, word, count(*) as n from {rows} group by 1, 2)) group by 1, 2 having sum(n * s) <> 0)"""

#: The same views for DuckDB, each in terms of the driver's tables and those before it.
SQL = {
    "nodes": f"""(select 'd' || lpad(doc_id::varchar, 8, '0') as id, text, source, lang,
  ['semantic', 'episodic', 'procedural'][(doc_id % 3 + 1)::int] as ntype,
  case when toxic = 1 then 'tombstone' when quality = 1 then 'active' when quality = 0 then 'stale' else 'probation' end as status,
  {START_S} + doc_id * 60 as created_s from documents left join labels using (doc_id))""",
    "edges": """(select o_orderkey as seq, 'e' || lpad(o_orderkey::varchar, 9, '0') as id,
  'd' || lpad(((o_orderkey * 7 + 3) % n)::varchar, 8, '0') as source,
  'd' || lpad(((o_custkey * 13 + o_orderkey % 17) % n)::varchar, 8, '0') as target,
  ['similar', 'extends', 'contradicts', 'supersedes', 'continues'][(o_orderkey % 5 + 1)::int] as kind,
  o_orderkey % 4 = 0 as pending, o_orderkey % 13 = 0 as rejected, floor(epoch(o_orderdate))::bigint as from_s,
  case when o_orderkey % 11 = 0 then floor(epoch(o_orderdate))::bigint + 2592000 end as to_s,
  case when o_orderkey % 5 < 2 then (o_orderkey * 37 % 1000) / 1000.0::double end as confidence
  from orders, (select count(*) as n from documents))""",
    "recalls": """(select floor(epoch(ts))::bigint as ts_s, substr(sha1(props), 1, 10) as q,
  'd' || lpad((user_id % n)::varchar, 8, '0') as id from events, (select count(*) as n from documents))""",
    "words": r"""(select id, word from (select id, unnest(string_split_regex(lower(text), '\s+')) as word from nodes
  where status <> 'tombstone') where word <> '')""",
    "searches": r"""(select item_id as qid, unnest(list_filter(string_split_regex(lower(text), '\s+'), lambda w: w <> '')) as word from benchmark)""",
    "embeds": _EMBED.format(key="id", rows="words"),
    "sembeds": _EMBED.format(key="qid", rows="searches"),
}
SQL["numbered"] = "(select doc_id as seq, text from documents)"
SQL["taxonomy"] = f"(select * from (values {', '.join(map(str, TAXONOMY))}) t(area, keyword))"
NEEDS = {"words": ["nodes"], "embeds": ["nodes", "words"], "sembeds": ["searches"]}
