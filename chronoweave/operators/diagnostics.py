"""Diagnostics of extracted fields against their sources, and small structural helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import routing


def grounding(events: DataFrame) -> DataFrame:
    """Share of non-empty titles and organisations that have a source, by document; 1 if there are none."""
    given = sum(((F.coalesce(f, F.lit("")) != "").cast("int") for f in ("title", "org")), F.lit(0))
    found = sum((((F.coalesce(f, F.lit("")) != "") & F.col(f"{f}_source").isNotNull()).cast("int") for f in ("title", "org")), F.lit(0))
    return events.groupBy("doc_id").agg(F.round(F.coalesce(F.try_divide(F.sum(found).cast("double"), F.sum(given)), F.lit(1.0)), 4).alias("grounding"))


def dated_share(events: DataFrame) -> DataFrame:
    return events.groupBy("doc_id").agg(F.round(F.avg((F.col("s").isNotNull() & F.col("e").isNotNull()).cast("double")), 4).alias("dated"))


def components(scored: DataFrame) -> DataFrame:
    """(doc_id, component, points): what each part adds to a score of 100."""
    parts = F.array(*(F.struct(F.lit(k).alias("component"), F.round(100 * w * (F.lit(1.0) if k == "agreement" else F.col(k)), 3).alias("points")) for k, w in routing.COMPONENTS.items()))
    return scored.select("doc_id", F.explode(parts).alias("c")).select("doc_id", "c.component", "c.points")


def phrase_occurrence(phrases: DataFrame, texts: DataFrame) -> DataFrame:
    """checked, found and percentage by document; an empty text checks nothing and is an issue of its own."""
    j = texts.join(phrases, "doc_id", "left")
    empty = F.coalesce(F.trim("text"), F.lit("")) == ""
    checked = ~empty & F.col("phrase").isNotNull()
    found = checked & F.lower("text").contains(F.lower("phrase"))
    out = j.groupBy("doc_id").agg(F.sum(checked.cast("int")).alias("checked"), F.sum(F.coalesce(found, F.lit(False)).cast("int")).alias("found"), F.when(F.max(empty.cast("int")) == 1, "empty_source_text").alias("issue"))
    return out.withColumn("pct", F.round(100 * F.try_divide(F.col("found").cast("double"), F.col("checked")), 2))


def positional_match(predicted: DataFrame, truth: DataFrame, key: list[str], value: str) -> DataFrame:
    """Positions at which a predicted value holds the true one as a part, by key."""
    at = Window.partitionBy(*key).orderBy("ord")
    p = predicted.select(*key, F.row_number().over(at).alias("i"), F.lower(value).alias("p"))
    t = truth.select(*key, F.row_number().over(at).alias("i"), F.lower(value).alias("t"))
    j = t.join(p, [*key, "i"], "left")
    return j.groupBy(*key).agg(F.count(F.lit(1)).alias("positions"), F.count_if(F.coalesce(F.col("p").contains(F.col("t")), F.lit(False))).alias("hits"))


def section_span(lines: DataFrame, key: list[str], starts: Column, stops: Column) -> DataFrame:
    """Lines after the first that starts a section and before the next that stops it."""
    at = Window.partitionBy(*key).orderBy("ord")
    seen = lines.withColumns({"__a": starts, "__z": stops}).withColumn("__from", F.min(F.when(F.col("__a"), F.col("ord"))).over(Window.partitionBy(*key)))
    ended = F.coalesce(F.max((F.col("__z") & (F.col("ord") > F.col("__from"))).cast("int")).over(at.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    return seen.withColumn("__end", ended).where("ord > __from and __end = 0").drop("__a", "__z", "__from", "__end")


def by_fuzzy_name(left: DataFrame, right: DataFrame, key: Column, order: str) -> DataFrame:
    """Pairs of equal normalised names; of several right rows the last by order."""
    r = right.withColumn("k", key).groupBy("k").agg(F.max_by("id", order).alias("right_id"))
    return left.withColumn("k", key).join(r, "k").select(F.col("id").alias("left_id"), "right_id")


def section_order(meta: Column) -> Column:
    """A map of section names to positions as a list of names in their order."""
    return F.transform(F.array_sort(F.transform(F.map_entries(meta), lambda e: F.struct(e["value"].alias("p"), e["key"].alias("k")))), lambda x: x["k"])


def next_id(ids: Column) -> Column:
    return F.coalesce(F.array_max(ids), F.lit(0)) + 1


def set_scores(have: Column, truth: Column) -> tuple[Column, Column]:
    """Precision and recall of two sets; null where a set is empty."""
    both = F.size(F.array_intersect(have, truth)).cast("double")
    return F.round(F.try_divide(both, F.size(have)), 4), F.round(F.try_divide(both, F.size(truth)), 4)
