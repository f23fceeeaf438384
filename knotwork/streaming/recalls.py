"""Usage events as streams: windowed counts, sessions, and micro-batches folded into a table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.sources.files import RECALL


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """(ts, q, id) of the ledger's lines as they arrive."""
    rows = spark.readStream.schema(RECALL.removesuffix(", _bad string")).json(path)
    return rows.select(F.to_timestamp("ts").alias("ts"), "q", F.explode("ids").alias("id"))


def windowed(events: DataFrame, width: str = "1 day", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Recalls a node and window; works on a stream or a table."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(window.alias("w"), "id").agg(F.count("*").alias("n")).select("id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Bursts of use of a node, divided by gaps."""
    burst = F.session_window("ts", gap)
    return events.withWatermark("ts", late).groupBy(burst.alias("w"), "id").agg(F.count("*").alias("n")).select("id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def fold_batches(events: DataFrame, merge: Callable[[DataFrame, int], None], checkpoint: str):
    """Starts a query that hands each micro-batch to ``merge``; the checkpoint keeps a batch from being lost."""
    return events.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
