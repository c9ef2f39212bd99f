"""Keyed state: feedback, notes and flags as logs that are folded on read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fold_feedback(log: DataFrame) -> DataFrame:
    """doc_id, dismissed (all ids ever dismissed, sorted), reviewed (last non-null), entries."""
    return log.groupBy("doc_id").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("dismissed", F.array().cast("array<string>")))))).alias("dismissed"),
        F.max_by("reviewed", F.when(F.col("reviewed").isNotNull(), F.col("seq"))).alias("reviewed"),
        F.count(F.lit(1)).alias("entries"),
    )


def latest(log: DataFrame, key: list[str], order: str, fields: list[str]) -> DataFrame:
    """Partial updates: the last non-null value of each field."""
    return log.groupBy(*key).agg(*(F.max_by(f, F.when(F.col(f).isNotNull(), F.col(order))).alias(f) for f in fields))


def append_notes(notes: DataFrame, new: DataFrame) -> DataFrame:
    """notes with new ones; a known id with the same text is ignored, with another text an error."""
    known = notes.select("doc_id", "id", F.col("text").alias("__old"))
    j = new.join(known, ["doc_id", "id"], "left")
    clash = F.raise_error(F.concat(F.lit("note exists with another text: "), F.col("id"))).cast("boolean")
    fresh = j.where(F.when(F.col("__old").isNull(), F.lit(True)).when(F.col("__old") == F.col("text"), F.lit(False)).otherwise(clash))
    return notes.unionByName(fresh.select(notes.columns))


def carry_notes(documents: DataFrame, notes: DataFrame) -> DataFrame:
    """Notes of documents with the same content, on the newest of them: (doc_id, from_doc, id, text)."""
    d = documents.select("doc_id", "hash", "created")
    newest = d.groupBy("hash").agg(F.max(F.struct("created", "doc_id")).alias("n"), F.count(F.lit(1)).alias("c")).where("c > 1").select("hash", F.col("n.doc_id").alias("newest"))
    old = d.join(newest, "hash").where("doc_id <> newest")
    return old.join(notes, "doc_id").select(F.col("newest").alias("doc_id"), F.col("doc_id").alias("from_doc"), "id", "text")


def known_targets(state: DataFrame, events: DataFrame, gaps: DataFrame) -> DataFrame:
    """State rows whose item is an event or a gap of their document."""
    items = events.select("doc_id", F.col("id").alias("item_id")).unionByName(gaps.select("doc_id", F.col("id").alias("item_id")))
    return state.join(items, ["doc_id", "item_id"], "left_semi")


def request_errors(rows: DataFrame, most_note: int = 4000, most_name: int = 255) -> DataFrame:
    """rows with an array of what is wrong with them."""
    e = F.array(
        F.when(F.coalesce(F.trim("filename"), F.lit("")) == "", "filename missing"),
        F.when(F.length("filename") > most_name, "filename too long"),
        F.when(F.length("note") > most_note, "note too long"),
        F.when(F.col("content").isNull() & F.col("text").isNull(), "nothing to read"),
    )
    return rows.withColumn("errors", F.array_compact(e))


def dismiss(gaps: DataFrame, folded: DataFrame) -> DataFrame:
    """gaps whose ids were dismissed change their state; the others keep it."""
    g = gaps.join(folded.select("doc_id", "dismissed"), "doc_id", "left")
    hit = F.coalesce(F.array_contains("dismissed", F.col("id")), F.lit(False))
    return g.withColumn("state", F.when(hit, "DISMISSED_GAP").otherwise(F.col("state"))).drop("dismissed")
