"""A store-backed engine: ingest, timeline, evidence, annotations and quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import events, state
from ..sources import readers
from ..sources.store import Store
from . import documents


class Engine:
    def __init__(self, spark: SparkSession, root: str, as_of: int):
        self.spark, self.store, self.as_of = spark, Store(spark, root), as_of
        self.store.init()

    def ingest(self, rows: DataFrame) -> None:
        """(filename, content, text): derived rows of each document are replaced, notes and states stay."""
        docs = readers.submit(rows).dropDuplicates(["doc_id"])
        out = documents.analyse(docs, self.as_of)
        meta = docs.select("doc_id", "filename", F.lit("upload").alias("source"), F.lit("READY").alias("status"), F.current_timestamp().alias("created"), F.lit(1).alias("pages"), F.length("text").alias("chars"), F.lit(None).cast("string").alias("candidate"))
        none = F.array().cast("array<string>")
        gap_id = F.substring(F.sha2(F.concat_ws("|", "doc_id", F.col("s").cast("string"), F.col("e").cast("string"), "state"), 256), 1, 16)
        self.store.replace("documents", meta)
        self.store.replace("events", out["events"].withColumn("reasons", none), docs)
        self.store.replace("gaps", out["gaps"].withColumns({"id": gap_id, "reasons": none}), docs)

    def timeline(self, doc_id: str) -> DataFrame:
        return self.store.get("events", doc_id).where("s is not null and e is not null").orderBy("s", "e", "id")

    def unresolved(self, doc_id: str) -> DataFrame:
        return self.store.get("events", doc_id).where("s is null or e is null")

    def gaps(self, doc_id: str) -> DataFrame:
        """Gaps with dismissals from the feedback log."""
        return state.dismiss(self.store.get("gaps", doc_id), state.fold_feedback(self.store.get("feedback", doc_id)))

    def annotate(self, notes: DataFrame) -> None:
        old = self.store.read("notes").join(notes.select("doc_id").distinct(), "doc_id", "left_semi")
        self.store.replace("notes", state.append_notes(old, notes), notes)

    def feedback(self, rows: DataFrame) -> None:
        old = self.store.read("feedback").join(rows.select("doc_id").distinct(), "doc_id", "left_semi")
        self.store.replace("feedback", old.unionByName(rows), rows)

    def quality(self) -> DataFrame:
        return events.quality(self.store.read("events"))
