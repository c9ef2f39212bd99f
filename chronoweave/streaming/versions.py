"""Documents that come again in a stream: a later version takes back what the one before it gave."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The state of a document can be large in number, so it is kept on disk; Spark asks for this store.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
CHANGES = "doc_id string, op string, version long, content string"


class LatestVersion(StatefulProcessor):
    """By doc_id: the latest version and its content. Each batch gives at most one change: the old content is
    retracted, the new one inserted. Versions that are no later than the known one change nothing, whenever they
    come; of equal versions the first stays. After ttl_ms of event time without a new version, a document's state
    is dropped, and it is then as if it had never come."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.latest = handle.getValueState("latest", "version long, content string, timer long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.latest.get() if self.latest.exists() else None
        best, seen = known, 0
        for batch in rows:
            for version, content, at in zip(batch["version"], batch["content"], batch["at"], strict=True):
                seen = max(seen, int(at))
                if best is None or version > best[0]:
                    best = (int(version), content, 0)
        if best is known:
            return
        if known is not None:
            self.handle.deleteTimer(known[2])
        timer = max(seen, timerValues.getCurrentWatermarkInMs()) + self.ttl_ms
        self.handle.registerTimer(timer)
        self.latest.update((best[0], best[1], timer))
        out = [(key[0], "retract", known[0], known[1])] if known is not None and known[1] != best[1] else []
        if known is None or known[1] != best[1]:
            out.append((key[0], "insert", best[0], best[1]))
        if out:
            yield pd.DataFrame(out, columns=["doc_id", "op", "version", "content"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.latest.clear()
        yield from ()

    def close(self) -> None:
        pass


def prepare(spark: SparkSession) -> None:
    """Set the state store that latest() needs, before its query starts."""
    spark.conf.set(*STATE_STORE)


def latest(stream: DataFrame, ts: str, late: str = "1 hour", ttl_ms: int = 86_400_000) -> DataFrame:
    """Changes (doc_id, op, version, content) of a stream with doc_id, version, content and an event time.

    Rows without doc_id or version don't count. A repeated batch or a restart from the checkpoint changes nothing,
    since the state is part of the checkpoint."""
    rows = stream.where("doc_id is not null and version is not null").withWatermark(ts, late)
    rows = rows.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("version").cast("long").alias("version"), F.col("content").cast("string").alias("content"), F.unix_millis(ts).alias("at"), ts)
    return rows.groupBy("doc_id").transformWithStateInPandas(LatestVersion(ttl_ms), CHANGES, "Append", "EventTime")
