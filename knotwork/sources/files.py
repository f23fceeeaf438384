"""Readers and writers of the store's files: Markdown nodes, JSON-lines edges, vectors and usage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EDGE = "id string, source string, target string, kind string, pending boolean, valid_from string, valid_to string, confidence double, invalidated_by string, rejected boolean, origin string, _bad string"
RECALL = "ts string, q string, ids array<string>, _bad string"
STATUSES, TYPES = ("probation", "active", "stale", "tombstone"), ("semantic", "episodic", "procedural")


def read_nodes(spark: SparkSession, path: str, now: str) -> DataFrame:
    """Markdown files with a head between lines of ---; files without a head or an id are left out."""
    raw = spark.read.text(path, wholetext=True).select(F.regexp_extract("value", r"(?s)\A---\n(.*?)\n---\n?(.*)\z", 1).alias("head"), F.regexp_extract("value", r"(?s)\A---\n(.*?)\n---\n?(.*)\z", 2).alias("text"))

    def field(name: str):
        found = F.trim(F.regexp_extract("head", rf"(?m)^{name}:[ \t]*(.*)$", 1))
        return F.when(found != "", found)

    def items(name: str):
        inner = F.regexp_extract(F.coalesce(field(name), F.lit("")), r"\[(.*)\]", 1)
        return F.filter(F.transform(F.split(inner, ","), lambda x: F.trim(x)), lambda x: x != "")

    known = lambda name, values, default: F.when(field(name).isin(*values), field(name)).otherwise(default)
    return raw.where(field("id").isNotNull()).select(
        field("id").alias("id"), F.regexp_replace("text", r"\A\s+|\s+\z", "").alias("text"), F.coalesce(field("created"), F.lit(now)).alias("created"), F.coalesce(field("source"), F.lit("human")).alias("source"),
        items("sources").alias("sources"), items("tags").alias("tags"), known("type", TYPES, "semantic").alias("ntype"), known("status", STATUSES, "probation").alias("status"),
        F.coalesce(F.expr("try_cast(trim(regexp_extract(head, '(?m)^recalls:[ \\\\t]*(.*)$', 1)) as int)"), F.lit(0)).alias("recall_count"),
        items("recall_queries").alias("recall_queries"), field("last_recalled").alias("last_recalled"),
    )


def to_markdown(nodes: DataFrame) -> DataFrame:
    """(id, value) with the head and text of each node; usage only where there is any."""
    line = lambda name, c: F.concat(F.lit(f"{name}: "), c)
    items = lambda c: F.concat(F.lit("["), F.array_join(c, ", "), F.lit("]"))
    used, none = F.col("recall_count") > 0, F.array().cast("array<string>")
    column = lambda name, else_: F.col(name) if name in nodes.columns else else_
    usage = [
        F.when(used, line("recalls", F.col("recall_count").cast("string"))), F.when(used, line("recall_queries", items(F.coalesce(column("recall_queries", none), none)))),
        F.when(used, line("last_recalled", column("last_recalled", F.lit(None).cast("string")))),
    ]
    parts = [F.lit("---"), *(line(n, F.col(c)) for n, c in (("id", "id"), ("created", "created"), ("source", "source"), ("type", "ntype"), ("status", "status"))), line("sources", items("sources")), line("tags", items("tags")), *usage, F.lit("---"), F.col("text")]
    return nodes.select("id", F.concat_ws("\n", *parts).alias("value"))


def _json(spark: SparkSession, path: str, schema: str, order: bool = False) -> DataFrame:
    """Rows of JSON lines without the malformed ones; ``order`` adds file, block and line, which sort as the lines stand."""
    lines = spark.read.text(path)
    if order:
        lines = lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    rows = lines.where(F.trim("value") != "").withColumn("row", F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    return rows.where("row is not null and row._bad is null").select("row.*", *(["file", "block", "line"] if order else [])).drop("_bad")


def read_edges(spark: SparkSession, path: str, now: str, rejected: bool = False) -> DataFrame:
    """Malformed lines are left out; a missing pending or rejected is false, a missing valid_from is ``now``. seq is the
    lines' order."""
    edges = _json(spark, path, EDGE, order=True).where("id is not null").fillna(False, ["pending", "rejected"]).fillna(now, ["valid_from"])
    edges = numbered(edges, "seq")
    return edges if rejected else edges.where("not rejected")


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` of ``_json`` with their place among all lines instead of file, block and line. Lines of one block are counted
    by its own window; blocks, which are few, get their starts from a running sum."""
    block = ["file", "block"]
    inside = rows.withColumn("at", F.row_number().over(Window.partitionBy(*block).orderBy("line")))
    sizes = rows.groupBy(*block).agg(F.count("*").alias("n"))
    starts = sizes.select(*block, (F.sum("n").over(Window.orderBy(*block)) - F.col("n")).alias("start"))  # a row a block of a file
    return inside.join(starts, block).withColumn(name, F.col("start") + F.col("at") - 1).drop("start", "at", "line", *block)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """The last line of each id, whatever files they stand in."""
    rows = _json(spark, path, "id string, vec array<double>, _bad string", order=True).where("id is not null and vec is not null")
    return rows.groupBy("id").agg(F.max_by("vec", F.struct("file", "block", "line")).alias("vec"))


def write_vectors(vectors: DataFrame, path: str) -> None:
    """JSON lines in id order."""
    vectors.select("id", "vec").orderBy("id").write.mode("overwrite").json(path)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    return _json(spark, path, RECALL)


def append_usage(events: DataFrame, path: str) -> None:
    """Adds rows (ts, q, ids) to a ledger; empty ids are dropped, and rows without any are not written."""
    known = events.withColumn("ids", F.filter("ids", lambda i: i.isNotNull() & (i != ""))).where(F.size("ids") > 0)
    known.select("ts", "q", "ids").write.mode("append").json(path)


#: Rows that a batch run leaves about itself, and the history of strategies.
METRICS = "ts string, nodes_before long, nodes_after long, nodes_added long, findings long, failed long, true_merges long, islands_found long, duration_s double, timed_out boolean, aborted string, marker_fails long, marker_words array<string>, _bad string"


def read_metrics(spark: SparkSession, path: str, last: int | None = 6) -> DataFrame:
    """The ``last`` lines (all for None), malformed ones left out, with their place in seq."""
    rows = numbered(_json(spark, path, METRICS, order=True), "seq")
    return rows if last is None else rows.orderBy(F.desc("seq")).limit(last).orderBy("seq")


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """(seq, value): the lines that are JSON, as they stand."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    return numbered(lines.where(F.trim("value") != "").where(F.expr("try_parse_json(value)").isNotNull()), "seq").select("seq", "value")


def read_legacy(spark: SparkSession, nodes: str, edges: str) -> tuple[DataFrame, DataFrame]:
    """Tables of the oldest files: nodes (id, text, created) and edges (id, source, target, kind, pending, created), times
    in seconds, 0 where missing."""
    a = _json(spark, nodes, "id string, text string, created double, _bad string").where("id is not null and text is not null").fillna(0.0, ["created"])
    b = _json(spark, edges, "id string, source string, target string, kind string, pending boolean, created double, _bad string").where("id is not null").fillna(0.0, ["created"]).fillna(False, ["pending"])
    return a, b


def resolve_legacy(edges: DataFrame, edge_id: str, accept: bool) -> DataFrame:
    """There a rejected edge is deleted."""
    hit = (F.col("id") == edge_id) & F.col("pending")
    return edges.withColumn("pending", F.col("pending") & ~hit) if accept else edges.where(~hit)


def read_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """(area, ord, keyword) of a JSON object of lists; anything else is refused."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string, array<string>>").alias("areas"), F.from_json("value", "map<string, string>").alias("raw"))
    lists = F.forall(F.map_values("raw"), lambda v: v.startswith("["))
    if not whole.where(F.coalesce(F.col("areas").isNull() | ~lists, F.lit(True))).isEmpty():
        raise ValueError("a taxonomy is a JSON object of lists of keywords")
    return whole.select(F.explode("areas").alias("area", "keywords")).select("area", F.posexplode("keywords").alias("ord", "keyword"))


def collect_findings(spark: SparkSession, path: str, source: str = "unknown") -> DataFrame:
    """(source, finding) of tab-divided lines, files in order of name; the first of equal findings."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at")).where(F.trim("value") != "")
    tab = F.instr("value", "\t")
    rows = lines.select("file", "block", "at", F.when(tab > 0, F.trim(F.substring_index("value", "\t", 1))).otherwise(source).alias("source"), F.when(tab > 0, F.trim(F.expr("substring(value, instr(value, '\t') + 1)"))).otherwise(F.trim("value")).alias("finding"))
    first = F.row_number().over(Window.partitionBy("finding").orderBy("file", "block", "at"))
    return rows.withColumn("rk", first).where("rk = 1").select("source", "finding")


def write_markdown(nodes: DataFrame, path: str) -> None:
    """A folder a node, each with its Markdown file; ``read_nodes`` takes ``path/*``."""
    to_markdown(nodes).repartition("id").write.mode("overwrite").partitionBy("id").option("lineSep", "\n").text(path)


def write_jsonl(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    rows.write.mode(mode).json(path)
