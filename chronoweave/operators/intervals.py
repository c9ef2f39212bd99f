"""Month-interval algebra: inclusive integer intervals [s, e], grouped by any key columns.

Every operator is one window over the key, so a key's rows meet once; results stay partitioned by it and
Spark reuses the exchange from one step to the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _before(key: list[str], *order: str):
    return Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def union(iv: DataFrame, key: list[str]) -> DataFrame:
    """Maximal runs: intervals that overlap or touch become one. Rows with e < s or a null end are ignored."""
    runs = iv.where("s <= e").withColumn("__reach", F.max("e").over(_before(key, "s", "e")))
    runs = runs.withColumn("__new", (F.col("__reach").isNull() | (F.col("s") > F.col("__reach") + 1)).cast("int"))
    runs = runs.withColumn("__run", F.sum("__new").over(Window.partitionBy(*key).orderBy("s", "e").rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*key, "__run").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("__run")


def total_months(iv: DataFrame, key: list[str]) -> DataFrame:
    """Months in the union of a key's intervals."""
    return union(iv, key).groupBy(*key).agg(F.sum(F.col("e") - F.col("s") + 1).alias("months"))


def span(iv: DataFrame, key: list[str]) -> DataFrame:
    return iv.groupBy(*key).agg(F.min("s").alias("s"), F.max("e").alias("e"))


def uncovered(iv: DataFrame, key: list[str], spans: DataFrame) -> DataFrame:
    """Holes of the union inside spans (key, lo, hi): before, between and after. A run past hi isn't clipped."""
    runs = union(iv, key)
    at = Window.partitionBy(*key).orderBy("s")
    both = runs.join(spans, key).withColumns({"pe": F.lag("e").over(at), "ns": F.lead("s").over(at)})
    left = both.select(*key, F.when(F.col("pe").isNull(), F.col("lo")).otherwise(F.col("pe") + 1).alias("s"), (F.col("s") - 1).alias("e")).where("s <= e")
    tail = both.where("ns is null").select(*key, F.greatest(F.col("e") + 1, F.col("lo")).alias("s"), F.col("hi").alias("e")).where("s <= e")
    bare = spans.join(runs.select(*key).distinct(), key, "left_anti").select(*key, F.col("lo").alias("s"), F.col("hi").alias("e"))
    return left.union(tail).union(bare)


def gaps(iv: DataFrame, key: list[str], carry: str | None = None) -> DataFrame:
    """Walk by start with a running maximum end; ties on it keep the earlier event.

    Columns: key, before_id, after_id, s, e, months, and with carry that column of both events as before_...
    and after_.... iv has id and precision; a hole between two events is a gap only if both are of month
    precision.
    """
    iv = iv.where("s <= e")
    at = Window.partitionBy(*key).orderBy("s", "e", "id")
    numbered = iv.withColumn("__n", F.row_number().over(at))
    more = [carry] if carry else []
    reach = F.max(F.struct("e", (-F.col("__n")).alias("n"), "id", "precision", *more)).over(Window.partitionBy(*key).orderBy("__n").rowsBetween(Window.unboundedPreceding, -1))
    seen = numbered.withColumn("__m", reach)
    months = F.col("s") - F.col("__m.e") - 1
    found = seen.where((months > 0) & (F.col("precision") == "month") & (F.col("__m.precision") == "month"))
    sides = [x for c in more for x in (F.col(f"__m.{c}").alias(f"before_{c}"), F.col(c).alias(f"after_{c}"))]
    return found.select(*key, F.col("__m.id").alias("before_id"), F.col("id").alias("after_id"), (F.col("__m.e") + 1).alias("s"), (F.col("s") - 1).alias("e"), months.alias("months"), *sides)


def neighbour_gaps(iv: DataFrame, key: list[str], by: str = "e") -> DataFrame:
    """Holes between neighbours in order of one end only, without a running maximum."""
    at = Window.partitionBy(*key).orderBy(by, "id")
    nxt = iv.where("s <= e").withColumns({"__s": F.lead("s").over(at), "__id": F.lead("id").over(at)})
    return nxt.where("__s > e + 1").select(*key, F.col("id").alias("before_id"), F.col("__id").alias("after_id"), (F.col("e") + 1).alias("s"), (F.col("__s") - 1).alias("e"), (F.col("__s") - F.col("e") - 1).alias("months"))


def strict_gaps(iv: DataFrame, key: list[str]) -> DataFrame:
    """gaps(), but a key with any interval that isn't of month precision has none."""
    coarse = F.max((F.col("precision") != "month").cast("int")).over(Window.partitionBy(*key))
    return gaps(iv.withColumn("__c", coarse).where("__c = 0").drop("__c"), key)


def neighbour_overlaps(iv: DataFrame, key: list[str]) -> DataFrame:
    """Neighbours by start that share a month."""
    at = Window.partitionBy(*key).orderBy("s", "e", "id")
    nxt = iv.where("s <= e").withColumns({"__s": F.lead("s").over(at), "__id": F.lead("id").over(at)})
    return nxt.where("__s <= e").select(*key, F.col("id").alias("first_id"), F.col("__id").alias("second_id"))


def months_covered(iv: DataFrame, key: list[str]) -> DataFrame:
    """Distinct months, counted from the union so that long or repeated intervals don't multiply rows."""
    return total_months(iv, key)


def best_overlap(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """For each left interval the right one of the largest overlap, the first of equals, if there is any overlap."""
    l = left.select(*key, F.col("id").alias("left_id"), F.col("s").alias("ls"), F.col("e").alias("le")).where("ls <= le")
    r = right.select(*key, F.col("id").alias("right_id"), F.col("s").alias("rs"), F.col("e").alias("re")).where("rs <= re")
    met = l.join(r, key).where("ls <= re and rs <= le")
    months = F.least("le", "re") - F.greatest("ls", "rs") + 1
    best = met.groupBy(*key, "left_id").agg(F.min(F.struct((-months).alias("n"), "rs", "re", "right_id")).alias("b"), F.first("ls").alias("s"), F.first("le").alias("e"))
    return best.select(*key, "left_id", F.col("b.right_id").alias("right_id"), (-F.col("b.n")).alias("months"), "s", "e", F.col("b.rs").alias("rs"), F.col("b.re").alias("re"))


def outside(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """Left intervals that meet no right one, for keys that have right ones at all."""
    runs = union(right, key).select(*key, F.col("s").alias("rs"), F.col("e").alias("re"))
    some = left.join(runs.select(*key).distinct(), key, "left_semi")
    cond = [some[k] == runs[k] for k in key] + [some["s"] <= runs["re"], runs["rs"] <= some["e"]]
    return some.join(runs, cond, "left_anti")


def conflicts(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """Left intervals that stick out of the right one they overlap most."""
    return best_overlap(left, right, key).where("s < rs or e > re")


def sessions(points: DataFrame, key: list[str], ts: str, gap: str) -> DataFrame:
    """Runs of points with no silence longer than gap."""
    return points.groupBy(*key, F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.min(ts).alias("first"), F.max(ts).alias("last")).drop("w")


def section_of(marks: DataFrame, key: list[str], at: str, kind: str) -> DataFrame:
    """As-of: every row gets the kind of the last row at or before it that has one."""
    w = Window.partitionBy(*key).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    return marks.withColumn("section", F.last(kind, ignorenulls=True).over(w))
