"""Texts that arrive as a stream, taken into a store batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from knotwork.functions.embedding import Embedder, vectors_for
from knotwork.operators import ingest as I
from knotwork.sources.cut import cut
from knotwork.sources.state import Store

ARRIVAL = "ts string, text string, source string"


def read(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines (ts, text, source) as they arrive."""
    return spark.readStream.schema(ARRIVAL).json(path)


def take_in(store: Store, now: Callable[[], tuple[int, str]], embedder: Embedder | None = None, **options):
    """A function for ``foreachBatch``: each micro-batch becomes one version of ``store``. A batch that is played again
    after a failure is found in the history by its number and left alone."""

    def run(batch: DataFrame, number: int) -> None:
        message = f"stream batch {number}"
        rows = batch.where("text is not null and trim(text) <> ''")
        if any(h["message"] == message for h in store.history()) or rows.isEmpty():
            return
        now_s, stamp = now()
        state = store.read()
        order = F.row_number().over(Window.orderBy("ts", "text")).cast("long")  # one batch, whose size the trigger bounds
        named = cut(rows.select("ts", "text", F.coalesce("source", F.lit("stream")).alias("source")).withColumn("seq", order))
        arrivals = named.select(F.substring(F.sha1(F.concat_ws("|", F.lit(str(number)), "seq", "text")), 1, 12).alias("id"), "seq", "text", "source")
        vectors, _ = vectors_for(state.nodes, state.vectors, embedder)
        done = I.ingest(state.nodes, state.edges, cut(vectors), cut(arrivals), now_s, stamp[:10], embedder, **options)
        after = state.with_(nodes=done.nodes, edges=done.edges, vectors=done.vectors)
        store.publish_changes(state, after, I.touched(done, state.nodes, state.vectors), stamp, message)

    return run


def start(stream: DataFrame, store: Store, checkpoint: str, now: Callable[[], tuple[int, str]], **options):
    """Starts the query; it ends when what is there has been taken in."""
    return stream.writeStream.foreachBatch(take_in(store, now, **options)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
