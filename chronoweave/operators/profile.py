"""Profile heuristics over a document's events and gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import events, intervals

# Thresholds in months and counts.
SENIOR, MID, LONG_GAP, STUDY_GAP, SHORT_STINT, STABLE, FEW_SKILLS = 60, 24, 3, 6, 12, 24, 5


def pros_cons(timeline: DataFrame, skills: DataFrame | None = None) -> DataFrame:
    """doc_id, months, pros, cons; missing values decide nothing."""
    work = timeline.where("type in ('EMPLOYMENT', 'INTERNSHIP') and s is not null and e is not null")
    total = intervals.total_months(work, ["doc_id"])
    stint = work.groupBy("doc_id").agg(F.min(F.col("e") - F.col("s") + 1).alias("shortest"), F.avg(F.col("e") - F.col("s") + 1).alias("mean"), F.min("s").alias("first"))
    study = timeline.where("type = 'EDUCATION'").groupBy("doc_id").agg(F.max("e").alias("graduated"))
    gap = intervals.gaps(events.usable(timeline), ["doc_id"]).groupBy("doc_id").agg(F.max("months").alias("gap"))
    j = timeline.select("doc_id").distinct().join(total, "doc_id", "left").join(stint, "doc_id", "left").join(study, "doc_id", "left").join(gap, "doc_id", "left")
    n = F.lit(None).cast("int")
    if skills is not None:
        j = j.join(skills.groupBy("doc_id").agg(F.countDistinct("skill").alias("skills")), "doc_id", "left")
        n = F.col("skills")
    after = F.col("first") - F.col("graduated")
    pros = F.array(F.when(F.col("months") >= SENIOR, "experienced").when(F.col("months") >= MID, "some experience"), F.when(F.col("mean") >= STABLE, "stable"), F.when(after.between(0, STUDY_GAP), "started soon after study"))
    cons = F.array(F.when(F.col("gap") > LONG_GAP, "long gap"), F.when(after > STUDY_GAP, "late start"), F.when(F.col("shortest") < SHORT_STINT, "short stint"), F.when(n < FEW_SKILLS, "few skills"))
    return j.select("doc_id", "months", F.array_compact(pros).alias("pros"), F.array_compact(cons).alias("cons"))


def unexplained_projects(claims: DataFrame) -> DataFrame:
    """Claimed projects (the largest number in text) beyond those described."""
    numbers = F.transform(F.regexp_extract_all("text", F.lit(r"(?i)(\d+)\s*\+?\s*projects"), F.lit(1)), lambda x: x.cast("int"))
    return claims.withColumn("claimed", F.coalesce(F.array_max(numbers), F.lit(0))).withColumn("unexplained", F.greatest(F.lit(0), F.col("claimed") - F.col("described")))
