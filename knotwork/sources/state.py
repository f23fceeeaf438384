"""The graph's state as tables, kept in versions.

A version has a folder of its own and a small file in ``LOG``, named by the version's number, which points to
it. That file is put in place last, and only where there is none, so readers see the old state or the new one
and no writer replaces another's version. Paths may lie in any store that Hadoop knows and that renames at once.

The folder of a whole version holds a Parquet table each for nodes, edges, vectors and the ledger. That of a
changing version holds, for each table it names, the ids it touches and the rows they have now (none: the rows
are gone), and for the ledger the rows added. Readers take the last whole version and, of each id, the rows of
the newest version that touches it. Every ``COMPACT``-th changing version in a row is written whole instead.
Ids may be null or repeat: a version that touches an id holds all of its rows.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, replace

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NODES = "id string, text string, source string, sources array<string>, tags array<string>, ntype string, status string, created_s long, recall_count int, recall_queries array<string>, last_recalled string"
EDGES = "seq long, id string, source string, target string, kind string, pending boolean, rejected boolean, from_s long, to_s long, confidence double, origin string, invalidated_by string"
VECTORS = "id string, vec array<double>"
LEDGER = "ts string, q string, ids array<string>"
_TABLES = {"nodes": NODES, "edges": EDGES, "vectors": VECTORS, "ledger": LEDGER}
_LOG = "version long, ts string, message string, folder string, changed array<string>, processed boolean"
#: Changing versions that readers put together at most.
COMPACT = 16


@dataclass
class State:
    nodes: DataFrame
    edges: DataFrame
    vectors: DataFrame
    ledger: DataFrame

    def with_(self, **tables: DataFrame) -> State:
        return replace(self, **tables)


def fitted(rows: DataFrame, schema: str) -> DataFrame:
    """``rows`` with the columns of ``schema``; missing ones are null, but for flags, which are false, and counts, 0."""
    empty = rows.sparkSession.createDataFrame([], schema).schema
    default = {"boolean": False, "int": 0}
    return rows.select(*(
        (F.coalesce(F.col(f.name).cast(f.dataType), F.lit(default[t]).cast(f.dataType)) if (t := f.dataType.simpleString()) in default else F.col(f.name).cast(f.dataType)).alias(f.name)
        if f.name in rows.columns else F.lit(default.get(f.dataType.simpleString())).cast(f.dataType).alias(f.name)
        for f in empty.fields
    ))


def empty(spark: SparkSession) -> State:
    return State(*(spark.createDataFrame([], schema) for schema in _TABLES.values()))


def of_tables(nodes: DataFrame, edges: DataFrame, vectors: DataFrame | None = None, ledger: DataFrame | None = None) -> State:
    spark = nodes.sparkSession
    given = (nodes, edges, vectors, ledger)
    return State(*(fitted(rows, schema) if rows is not None else spark.createDataFrame([], schema) for rows, schema in zip(given, _TABLES.values())))


class Store:
    """A folder of versions."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.seen = spark, path.rstrip("/"), None

    def _hadoop(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def history(self) -> list[dict]:
        """The versions in order: version, ts, message, the folder of their tables, the tables changed (None for a
        whole version), and whether usage was folded in."""
        jvm, fs = self._hadoop()
        if not fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/LOG")):
            return []
        rows = self.spark.read.schema(_LOG).json(f"{self.path}/LOG")
        return [r.asDict() for r in rows.where("version is not null").orderBy("version").collect()]  # a line a version

    def _next(self) -> tuple[list[dict], int]:
        past = self.history()
        after = self.seen if self.seen is not None else (past[-1]["version"] if past else 0)
        if past and past[-1]["version"] != after:
            raise Conflict(f"version {after} is no longer the newest; {past[-1]['version']} is")
        return past, after + 1

    def _claim(self, version: int, **line) -> int:
        if not create_text(self.spark, f"{self.path}/LOG/{version:08d}.json", json.dumps({"version": version, **line}, ensure_ascii=False) + "\n"):
            raise Conflict(f"version {version} was published by another writer meanwhile")
        self.seen = version
        return version

    def publish(self, state: State, ts: str, message: str, processed: DataFrame | None = None) -> int:
        """Writes ``state`` as the next version, whole, which readers see at once or not at all.

        The next version follows the one that this store read or published last (the newest where it did neither).
        Tables go to a folder of their own before the version's number is claimed, so of writers that follow one
        version the first wins and the others get a ``Conflict`` and harm nothing. ``processed`` are rows of the
        ledger that this version has folded in; they are kept beside it."""
        version, folder = self._next()[1], f"data/{uuid.uuid4().hex}"
        for name, schema in _TABLES.items():
            fitted(getattr(state, name), schema).write.parquet(f"{self.path}/{folder}/{name}")
        if processed is not None:
            fitted(processed, LEDGER).write.parquet(f"{self.path}/{folder}/processed")
        return self._claim(version, ts=ts, message=message, folder=folder, processed=processed is not None)

    def publish_changes(self, before: State, after: State, touched: dict[str, Column | DataFrame], ts: str, message: str) -> int:
        """The next version as what changes between ``before``, the version it follows, and ``after``.

        ``touched`` names the tables that change: a condition or a table of ids that takes in all rows that differ, on
        either side, and for the ledger the rows added. What is written grows with these rows, not with the graph."""
        past, version = self._next()
        if not past or len(past) - 1 - max(i for i, v in enumerate(past) if v["changed"] is None) >= COMPACT - 1:
            return self.publish(after, ts, message)
        folder = f"data/{uuid.uuid4().hex}"
        at = f"{self.path}/{folder}"
        for name, rows in touched.items():
            new = fitted(getattr(after, name), _TABLES[name])
            if name == "ledger":
                fitted(rows, LEDGER).coalesce(1).write.parquet(f"{at}/ledger")
                continue
            ids = rows.select("id") if isinstance(rows, DataFrame) else getattr(before, name).where(rows).select("id").unionByName(new.where(rows).select("id"))
            ids.distinct().coalesce(1).write.parquet(f"{at}/{name}_ids")
            ids = self.spark.read.schema("id string").parquet(f"{at}/{name}_ids")
            new.join(ids, new["id"].eqNullSafe(ids["id"]), "left_semi").coalesce(1).write.parquet(f"{at}/{name}")
        return self._claim(version, ts=ts, message=message, folder=folder, changed=list(touched))

    def compact(self, ts: str) -> int:
        """The newest version once more, whole."""
        return self.publish(self.read(), ts, "compact")

    def read(self, version: int | None = None) -> State:
        """A version, the last one if none is named; an empty state where there is none."""
        past = self.history()
        if version is None:
            self.seen = past[-1]["version"] if past else 0
        if not past:
            return empty(self.spark)
        until = next(i for i in reversed(range(len(past))) if version in (None, past[i]["version"]))
        whole = max(i for i in range(until + 1) if past[i]["changed"] is None)
        return State(*(self._merged(name, past[whole : until + 1]) for name in _TABLES))

    def _merged(self, name: str, versions: list[dict]) -> DataFrame:
        """A table of the first of ``versions``, which is whole, with the changes of the others."""
        load = lambda v, table, schema: self.spark.read.schema(schema).parquet(f"{self.path}/{v['folder']}/{table}")
        base, later = load(versions[0], name, _TABLES[name]), [v for v in versions[1:] if name in v["changed"]]
        if not later:
            return base
        if name == "ledger":
            for v in later:
                base = base.unionByName(load(v, name, LEDGER))
            return base
        rows, touched = base.withColumn("_v", F.lit(versions[0]["version"])), None
        for v in later:
            rows = rows.unionByName(load(v, name, _TABLES[name]).withColumn("_v", F.lit(v["version"])))
            ids = load(v, f"{name}_ids", "id string").select(F.col("id").alias("_id"), F.lit(v["version"]).alias("_newest"))
            touched = ids if touched is None else touched.unionByName(ids)
        newest = touched.groupBy("_id").agg(F.max("_newest").alias("_newest"))
        joined = rows.join(newest, rows["id"].eqNullSafe(newest["_id"]), "left")
        return joined.where("_newest is null or _newest = _v").select(*base.columns)

    def processed(self) -> DataFrame:
        """The usage that versions have folded in, (ts, q, ids, version)."""
        out = self.spark.createDataFrame([], f"{LEDGER}, version long")
        for v in self.history():
            if v["processed"]:
                out = out.unionByName(self.spark.read.schema(LEDGER).parquet(f"{self.path}/{v['folder']}/processed").withColumn("version", F.lit(v["version"]).cast("long")))
        return out


class Conflict(RuntimeError):
    """Another writer has published since this one read."""


def create_text(spark: SparkSession, path: str, text: str) -> bool:
    """Puts a small file where none is, whole and at once; False where there is one."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    to = jvm.org.apache.hadoop.fs.Path(path)
    fs = to.getFileSystem(conf)
    part = jvm.org.apache.hadoop.fs.Path(to.getParent(), f"_{uuid.uuid4().hex}")  # readers pass over names that begin so
    out = fs.create(part, False)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()
    try:
        if fs.getUri().getScheme() == "file":  # a rename of local files would replace
            local = lambda at: jvm.java.nio.file.Paths.get(fs.makeQualified(at).toUri())
            jvm.java.nio.file.Files.createLink(local(to), local(part))
        else:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(part, to, spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
    except Py4JJavaError as error:
        if "AlreadyExists" in error.java_exception.getClass().getName():
            return False
        raise
    finally:
        fs.delete(part, False)
    return True


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Puts a small file in the place of another by renaming it."""
    if not text:
        raise ValueError("an empty file is not written")
    jvm = spark.sparkContext._jvm
    to, part = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.part")
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(to.toUri(), spark.sparkContext._jsc.hadoopConfiguration()) if to.toUri().getScheme() else jvm.org.apache.hadoop.fs.FileContext.getFileContext(spark.sparkContext._jsc.hadoopConfiguration())
    fs = to.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(part, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    context.rename(part, to, options)


def index_lines(nodes: DataFrame) -> DataFrame:
    """(id, value): the lines of a table of contents, without tombstones; titles are cut first and escaped then."""
    title = F.replace(F.substring(F.coalesce("text", F.lit("")), 1, 60), F.lit("|"), F.lit("\\|"))
    created = F.date_format(F.timestamp_seconds("created_s"), "yyyy-MM-dd'T'HH:mm:ss'Z'") if "created_s" in nodes.columns else F.col("created")
    return nodes.where("status <> 'tombstone'").select("id", F.concat(F.lit("| ["), title, F.lit("](nodes/"), F.col("id"), F.lit(".md) | "), F.coalesce("source", F.lit("")), F.lit(" | "), created, F.lit(" |")).alias("value"))


def write_index(nodes: DataFrame, path: str) -> None:
    """The table of contents as text: head first, then a line a node in id order."""
    head = nodes.sparkSession.createDataFrame([("", "# Index"), ("\x01", ""), ("\x02", "| Idea | Source | Created |"), ("\x03", "|---|---|---|")], "id string, value string")
    head.unionByName(index_lines(nodes)).orderBy("id").select("value").write.mode("overwrite").text(path)


#: A small graph to look around in: topics of a workshop, one pair that is nearly the same, and one island.
_SEED = [
    ("bread", "Sourdough bread rises slowly and keeps for days"), ("bread2", "Sourdough bread rises slowly and keeps for some days"), ("starter", "A sourdough starter is fed with flour and water"),
    ("oven", "A stone oven holds heat for bread and pizza"), ("grain", "Rye grain grows on poor soil"), ("mill", "A mill grinds grain into flour"), ("water", "Hard water slows yeast"),
    ("yeast", "Yeast turns sugar into gas and alcohol"), ("beer", "Beer is made with grain, water and yeast"), ("hops", "Hops keep beer from spoiling"), ("cellar", "A cool cellar stores beer and cheese"),
    ("cheese", "Cheese ripens in a cellar"), ("island", "Comets are made of ice"),
]
_LINKS = [
    ("bread", "starter", "extends"), ("bread", "oven", "extends"), ("starter", "yeast", "continues"), ("starter", "water", "extends"), ("oven", "mill", "similar"), ("grain", "mill", "extends"),
    ("mill", "bread", "continues"), ("water", "yeast", "contradicts"), ("yeast", "beer", "extends"), ("grain", "beer", "extends"), ("water", "beer", "extends"), ("hops", "beer", "extends"),
    ("cellar", "beer", "similar"), ("cellar", "cheese", "extends"), ("bread2", "starter", "extends"), ("bread2", "oven", "extends"), ("cheese", "bread", "similar"), ("hops", "cellar", "similar"), ("grain", "bread", "extends"),
]


def demo(spark: SparkSession, now_s: int = 1719792000) -> State:
    """13 nodes and 19 edges, two of them pending, with vectors."""
    from knotwork.functions.embedding import vectors_of

    nodes = spark.createDataFrame([(i, text, "human", "semantic", "active", now_s) for i, text in _SEED], "id string, text string, source string, ntype string, status string, created_s long")
    rows = [(n, f"e{n:02d}", a, b, kind, n >= len(_LINKS) - 2, False, now_s, None, None, "manual") for n, (a, b, kind) in enumerate(_LINKS)]
    edges = spark.createDataFrame(rows, "seq long, id string, source string, target string, kind string, pending boolean, rejected boolean, from_s long, to_s long, confidence double, origin string")
    return of_tables(nodes, edges, vectors_of(nodes))
