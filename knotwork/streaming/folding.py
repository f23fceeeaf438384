"""Usage folded into a row a node by state that lives with the stream.

The state of a node is its number of recalls, the ``most`` smallest of its distinct fingerprints and the time of
the last one. These don't depend on how rows are divided into batches or on their order, so a stream that is
interrupted, replayed from its checkpoint or fed late ends with what ``transitions.fold_recalls`` makes of the whole
ledger for nodes without any usage before. Tasks combine their rows a node before the shuffle, so a node that a third
of all rows name costs a row a batch and task.

Null ids are left out; a null fingerprint counts as a recall and is not kept; a null time counts too where there is no watermark.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

_FOLDED = "id string, recall_count long, recall_queries array<string>, last_recalled timestamp, quiet boolean"
_PART = "id string, n long, qs array<string>, last timestamp"
_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Fold(StatefulProcessor):
    def __init__(self, most: int, quiet_ms: int | None):
        self.most, self.quiet_ms = most, quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("usage", "n long, qs array<string>, last_us long")

    def _row(self, key, state: tuple, quiet: bool) -> pd.DataFrame:
        n, qs, last = state
        return pd.DataFrame({"id": [key[0]], "recall_count": [n], "recall_queries": [list(qs)], "last_recalled": pd.Series([pd.NaT if last is None else pd.Timestamp(last, unit="us")], dtype="datetime64[us]"), "quiet": [quiet]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        n, qs, last = self.held.get() or (0, [], None)
        qs = set(qs)
        for part in rows:
            n += int(part["n"].sum())
            qs = set(sorted(qs.union(*part["qs"]))[: self.most])
            if (new := part["last"].max()) is not pd.NaT:
                last = max(last or 0, new.value // 1000)
        state = (n, sorted(qs), last)
        self.held.update(state)
        if self.quiet_ms is not None and last is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(last // 1000 + self.quiet_ms)
        yield self._row(key, state, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        yield self._row(key, self.held.get(), True)

    def close(self) -> None:
        pass


def _combined(most: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in frames:
            by = rows.groupby("id", sort=False)
            out = by.agg(n=("id", "size"), last=("ts", "max"))
            out["qs"] = by["q"].agg(lambda q: sorted(set(q.dropna()))[:most])
            yield out.reset_index()[["id", "n", "qs", "last"]]

    return run


def folded(events: DataFrame, most: int = 25, quiet_days: float | None = None, late: str = "1 hour") -> DataFrame:
    """(id, recall_count, recall_queries, last_recalled, quiet) of ``events(ts, q, id)``, a stream or a table.

    A stream gives, for each batch, a row with the totals of each node that the batch names (output mode update). With
    ``quiet_days``, a node that no row has named for so long, by the times of the rows, gets its row once more with quiet
    true; that needs a watermark, so rows more than ``late`` behind the newest are then lost. Without it none are."""
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)
    _ = spark.streams.active  # starts what coordinates state stores, which a table needs too
    parts = events.where("id is not null").select("id", "q", "ts").mapInPandas(_combined(most), _PART)
    if quiet_days is not None:
        parts = parts.withWatermark("last", late)
    processor = _Fold(most, None if quiet_days is None else int(quiet_days * 86_400_000))
    return parts.groupBy("id").transformWithStateInPandas(processor, _FOLDED, "Update", "EventTime" if quiet_days is not None else "None")
