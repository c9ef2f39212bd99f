"""Typed, dated events of a document: association, confidence, deduplication, conflicts, gaps, lineage.

An event row has doc_id, id, type, title, org, s, e (month indices), precision, status, confidence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import intervals

# Event types, states and weights of the evidence model.
WORK = ("EMPLOYMENT", "INTERNSHIP")
CORE = ("EMPLOYMENT", "INTERNSHIP", "EDUCATION", "PROJECT")
STATES = ("POTENTIAL_GAP", "NO_GAP_DETECTED", "INSUFFICIENT_EVIDENCE", "DISMISSED_GAP")
STATUS_WEIGHT = {"CONFIRMED": 1.0, "AMBIGUOUS": 0.6, "UNRESOLVED": 0.3}
PRECISION_WEIGHT = {"month": 1.0, "year": 0.7}


def weight(name: Column, table: dict[str, float], other: float) -> Column:
    out = F.lit(other)
    for k, v in table.items():
        out = F.when(name == k, v).otherwise(out)
    return out


def chain_confidence(links: Column) -> Column:
    """Product of confidences, each clamped to 0..1, to three places."""
    return F.round(F.aggregate(links, F.lit(1.0), lambda a, x: a * F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))), 3)


def event_confidence(status: Column, precision: Column, section: Column, hint: Column) -> Column:
    """Status x precision x section x hint, a missing section or hint counting as 1."""
    return F.round(weight(status, STATUS_WEIGHT, 0.3) * weight(precision, PRECISION_WEIGHT, 0.7) * F.coalesce(section, F.lit(1.0)) * F.coalesce(hint, F.lit(1.0)), 3)


def gap_confidence(before: Column, after: Column, bounded: Column) -> Column:
    """The weaker bound, zero or missing ones as a half, less if one side is open."""
    known = lambda c: F.coalesce(F.nullif(c, F.lit(0.0)), F.lit(0.5))
    return F.round(F.least(known(before), known(after)) * F.when(bounded, 1.0).otherwise(0.6), 3)


def usable(events: DataFrame) -> DataFrame:
    """Confirmed events with both ends, year-precision ends widened to their year."""
    from ..functions import months

    dated = events.where("status = 'CONFIRMED' and s is not null and e is not null")
    return dated.withColumns({"s": months.widen(F.col("s"), F.col("precision"), False), "e": months.widen(F.col("e"), F.col("precision"), True)})


def coverage(events: DataFrame) -> DataFrame:
    """Union of usable events and its months, by document."""
    return intervals.total_months(usable(events), ["doc_id"])


def _placed() -> Column:
    return F.expr("status = 'CONFIRMED' and s is not null and e is not null")


def primary_gaps(events: DataFrame, incomplete: DataFrame | None = None) -> DataFrame:
    """doc_id, state, confidence, before_id, after_id, s, e, months, scope, uncertain, unplaced.

    A document has its gaps, or one row that says that there is none or that the evidence is too thin:
    fewer than two dated core events, uncertain work or project events, or incomplete reading. uncertain are
    the ids of the latter events, unplaced those of all core events without a confirmed tenure.
    """
    core = events.where(F.col("type").isin(*CORE))
    unsure = (F.col("type").isin(*WORK) & (F.col("status") != "CONFIRMED")) | ((F.col("type") == "PROJECT") & (F.col("status") == "AMBIGUOUS"))
    ids = lambda which: F.array_sort(F.collect_list(F.when(which, F.col("id"))))
    flags = core.groupBy("doc_id").agg(
        F.count_if(_placed()).alias("n"), F.bool_or(F.col("precision") != "month").alias("coarse"),
        ids(unsure).alias("uncertain"), ids(~F.coalesce(_placed(), F.lit(False))).alias("unplaced"),
    )
    flags = events.select("doc_id").distinct().join(flags, "doc_id", "left")
    if incomplete is not None:
        flags = flags.join(incomplete.select("doc_id").distinct().withColumn("inc", F.lit(True)), "doc_id", "left")
    else:
        flags = flags.withColumn("inc", F.lit(False))
    thin = (F.coalesce("n", F.lit(0)) < 2) | (F.size("uncertain") > 0) | F.coalesce("inc", F.lit(False))
    flags = flags.select("doc_id", F.coalesce(thin, F.lit(True)).alias("thin"), F.coalesce("coarse", F.lit(False)).alias("coarse"), "uncertain", "unplaced")
    dated = usable(core)
    found = intervals.gaps(dated, ["doc_id"], carry="confidence")
    work = intervals.total_months(dated.where(F.col("type").isin(*WORK)), ["doc_id"]).withColumnRenamed("months", "w")
    every = intervals.total_months(dated, ["doc_id"]).withColumnRenamed("months", "a")
    scope = every.join(work, "doc_id", "left").select("doc_id", F.when(F.col("w") == F.col("a"), "employment").otherwise("all_dated_activity").alias("scope"))
    joined = flags.join(found, "doc_id", "left").join(scope, "doc_id", "left")
    gap = ~F.col("thin") & F.col("months").isNotNull()
    state = F.when(gap, "POTENTIAL_GAP").when(F.col("thin") | F.col("coarse"), "INSUFFICIENT_EVIDENCE").otherwise("NO_GAP_DETECTED")
    confidence = F.when(gap, gap_confidence(F.col("before_confidence"), F.col("after_confidence"), F.lit(True))).when(F.col("thin") | F.col("coarse"), 0.4).otherwise(0.9)
    only = lambda c: F.when(gap, F.col(c)).alias(c)
    return joined.select("doc_id", state.alias("state"), confidence.alias("confidence"), *(only(c) for c in ("before_id", "after_id", "s", "e", "months", "scope")), "uncertain", "unplaced").distinct()


def employment_only_gaps(events: DataFrame) -> DataFrame:
    """The other reading of a timeline: gaps between work and education tenures, dated projects left out."""
    return intervals.gaps(usable(events.where(F.col("type").isin(*WORK, "EDUCATION"))), ["doc_id"])


def period_state() -> Column:
    """State of one written period; the first rule that holds decides.

    Columns: ocr, status, n_ranges, n_singles, s, e, precision, duration. A single range is expected to
    have filled s and e.
    """
    both = F.col("s").isNotNull() & F.col("e").isNotNull()
    some = F.col("s").isNotNull() | F.col("e").isNotNull() | (F.col("n_singles") > 0)
    single = (F.col("n_ranges") == 0) & (F.col("n_singles") == 1)
    return (
        F.when(F.col("ocr"), "ambiguous")
        .when(F.col("status").isin("AMBIGUOUS", "UNRESOLVED") & single, "single_date")
        .when(F.col("status") == "AMBIGUOUS", "ambiguous")
        .when(F.col("status") == "UNRESOLVED", "undated")
        .when(F.col("n_ranges") > 1, "ambiguous")
        .when(single & (~both | (F.col("s") == F.col("e")) | (F.col("precision") == "year")), "single_date")
        .when(both & (F.col("e") < F.col("s")), "invalid")
        .when(both & (F.col("precision") == "month"), "month_range")
        .when(both, "year_range")
        .when(F.coalesce(F.lower(F.trim("duration")).rlike(r"^\d+\s*(?:months?|years?)$"), F.lit(False)), "duration_only")
        .when(some, "single_date")
        .otherwise("undated")
    )


def category_breaks(periods: DataFrame) -> DataFrame:
    """Gaps inside (doc_id, category), only where all of its entries are month ranges."""
    w = Window.partitionBy("doc_id", "category")
    clean = periods.withColumn("__all", F.min((F.col("state") == "month_range").cast("int")).over(w)).where("__all = 1").drop("__all")
    return intervals.gaps(clean.withColumn("precision", F.lit("month")), ["doc_id", "category"])


# States of a written period, and reasons of an association.
PERIOD_STATES = ("month_range", "year_range", "single_date", "duration_only", "undated", "ambiguous", "invalid")
SAME_LINE, PROXIMITY, PAIR, MULTI, NO_DATE = "ASSOC_SAME_LINE", "ASSOC_PROXIMITY", "ASSOC_DATE_PAIR", "ASSOC_AMBIGUOUS_MULTI", "ASSOC_UNRESOLVED_NO_DATE"


def category_analysis(periods: DataFrame) -> DataFrame:
    """By (doc_id, category): entries, dated ones (month and year ranges), represented months, overlap, whether
    all entries are month ranges, and the number of entries in each state."""
    ranged = periods.where("state = 'month_range'")
    covered = intervals.total_months(ranged, ["doc_id", "category"]).withColumnRenamed("months", "represented")
    count = lambda *states: F.count_if(F.col("state").isin(*states))
    sums = periods.groupBy("doc_id", "category").agg(
        F.count(F.lit(1)).alias("entries"), count("month_range", "year_range").alias("dated"), F.sum(F.expr("if(state = 'month_range', e - s + 1, 0)")).alias("total"),
        F.bool_and(F.col("state") == "month_range").alias("precise"), *(count(x).alias(x) for x in PERIOD_STATES),
    )
    out = sums.join(covered, ["doc_id", "category"], "left")
    return out.select("doc_id", "category", "entries", "dated", F.coalesce("represented", F.lit(0)).alias("represented"), (F.col("total") - F.coalesce("represented", F.lit(0))).alias("overlap"), "precise", *PERIOD_STATES)


def associate(mentions: DataFrame, entries: DataFrame | None = None) -> DataFrame:
    """Status of every date mention in its entry: (entry_id, id, ord, is_range, s, e) to status, confidence, reason.

    One range decides; of several, the first is likelier; without one, a single date or an ordered pair counts.
    A column in_entry tells whether the mention stands on a line of the entry itself (it does if there is no
    such column). Entries (entry_id) without a mention get a row without id.

    Mentions are evaluated, exchanged and sorted once: entries go through the same window, after the mentions.
    """
    inside = F.col("in_entry") if "in_entry" in mentions.columns else F.lit(True)
    m = mentions.withColumns({"__given": F.lit(True), "__range": F.col("is_range").cast("int")})
    if entries is not None:
        m = m.unionByName(entries.select("entry_id", F.lit(False).alias("__given")), allowMissingColumns=True)
    at = Window.partitionBy("entry_id").orderBy(F.desc("__given"), "ord")
    w = at.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    bare = ~F.col("__given")
    m = m.withColumns({
        "ranges": F.sum("__range").over(w), "n": F.count_if(F.col("__given")).over(w), "range_no": F.sum("__range").over(at.rowsBetween(Window.unboundedPreceding, 0)),
        "first_s": F.first("s").over(w), "second_e": F.nth_value("e", 2).over(w),
    })
    kept = m.where(F.when(bare, F.col("n") == 0).otherwise((F.col("ranges") == 0) | (F.col("__range") == 1)))
    pair = (F.col("n") == 2) & (F.col("first_s") <= F.col("second_e"))
    ranges, alone = F.col("ranges"), F.col("n") == 1
    where = F.when(inside, SAME_LINE).otherwise(PROXIMITY)
    status = F.when(bare, "UNRESOLVED").when(ranges == 1, "CONFIRMED").when(ranges > 1, "AMBIGUOUS").when(alone | pair, "CONFIRMED").otherwise("AMBIGUOUS")
    confidence = F.when(bare, 0.3).when(ranges == 1, 0.9).when(ranges > 1, F.when(F.col("range_no") == 1, 0.6).otherwise(0.5)).when(alone | pair, 0.85).otherwise(0.3)
    reason = F.when(bare, NO_DATE).when(ranges == 1, where).when(ranges > 1, MULTI).when(alone, where).when(pair, PAIR).otherwise(NO_DATE)
    return kept.select("entry_id", "id", status.alias("status"), confidence.alias("confidence"), reason.alias("reason"))


def deduplicate(events: DataFrame, literal: bool = False) -> DataFrame:
    """One event of each type, title and organisation (trimmed, case apart) and tenure: dated before undated;
    of dated ones the confirmed first, then the surest, then the first; of undated ones the surest, then the
    first. literal leaves the tenure out of the key, which also merges separate tenures."""
    plain = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    key = ["doc_id", "type", plain("title"), plain("org")]
    dated = F.col("s").isNotNull() & F.col("e").isNotNull()
    has = F.max(dated.cast("int")).over(Window.partitionBy(*key))
    kept = events.withColumn("__has", has).where(dated | (F.col("__has") == 0)).drop("__has")
    if not literal:
        key += ["s", "e"]
    order = Window.partitionBy(*key).orderBy(F.when(dated & (F.col("status") != "CONFIRMED"), 1).otherwise(0), F.desc("confidence"), "id")
    return kept.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def mark_conflicts(projects: DataFrame, tenures: DataFrame) -> DataFrame:
    """Projects with their parent; one that sticks out of it loses confidence and gets a reason."""
    best = intervals.best_overlap(projects.where("status = 'CONFIRMED'"), tenures.where("status = 'CONFIRMED'"), ["doc_id"])
    best = best.select("doc_id", F.col("left_id").alias("id"), F.col("right_id").alias("parent_id"), ((F.col("s") < F.col("rs")) | (F.col("e") > F.col("re"))).alias("conflict"))
    j = projects.join(best, ["doc_id", "id"], "left").withColumn("conflict", F.coalesce("conflict", F.lit(False)))
    return j.withColumns({"confidence": F.when(F.col("conflict"), F.round(F.col("confidence") * 0.7, 3)).otherwise(F.col("confidence")), "reason": F.when(F.col("conflict"), "DATE_CONFLICT")})


def place_projects(events: DataFrame, projects: DataFrame) -> DataFrame:
    """Events together with those that dated project blocks make.

    events and projects have block_ids. A project with a tenure becomes an event, ambiguous if it was read by
    OCR (column ocr), unless a dated project event already stands on one of its blocks. Undated project events
    all of whose blocks belong to dated, confirmed ones are dropped.
    """
    own = ["doc_id", "id", "type", "title", "org", "s", "e", "precision", "status", "confidence", "block_ids"]
    dated = F.col("s").isNotNull() & F.col("e").isNotNull()
    block = lambda df: df.select("doc_id", "id", F.explode("block_ids").alias("block"))
    held = block(events.where((F.col("type") == "PROJECT") & dated)).select("doc_id", "block").distinct()
    known = block(projects).join(held, ["doc_id", "block"], "left_semi").select("doc_id", "id").distinct()
    new = projects.where(dated & (F.col("s") <= F.col("e"))).join(known, ["doc_id", "id"], "left_anti")
    new = new.withColumns({"type": F.lit("PROJECT"), "status": F.when(F.col("ocr"), "AMBIGUOUS").otherwise("CONFIRMED"), "confidence": F.when(F.col("ocr"), 0.5).otherwise(0.85)})
    every = events.select(*own).unionByName(new.select(*own))
    covered = block(every.where((F.col("type") == "PROJECT") & dated & (F.col("status") == "CONFIRMED"))).groupBy("doc_id").agg(F.collect_set("block").alias("__covered"))
    stub = (F.col("type") == "PROJECT") & ~dated & F.col("__covered").isNotNull() & (F.size(F.array_except("block_ids", "__covered")) == 0)
    return every.join(covered, "doc_id", "left").where(~F.coalesce(stub, F.lit(False))).drop("__covered")


def quality(events: DataFrame) -> DataFrame:
    """Dated share, unresolved and ambiguous counts, mean confidence and a clamped document score, by document."""
    dated = F.col("s").isNotNull() & F.col("e").isNotNull()
    q = events.groupBy("doc_id").agg(F.count(F.lit(1)).alias("total_events"), F.count_if(dated).alias("dated_events"), F.count_if(~dated).alias("unresolved"), F.count_if(F.col("status") == "AMBIGUOUS").alias("ambiguous"), F.round(F.avg("confidence"), 3).alias("mean_event_confidence"))
    q = q.withColumn("dated_share", F.round(F.col("dated_events") / F.col("total_events"), 3))
    return q.withColumn("document_accuracy", F.greatest(F.lit(0.70), F.least(F.lit(0.96), F.coalesce("mean_event_confidence", F.lit(0.88)))))


def lineage(gaps: DataFrame, events: DataFrame, entries: DataFrame, blocks: DataFrame) -> DataFrame:
    """Gap to its two events, their entries and text blocks: one row per gap with an array of links."""
    ends = gaps.select("doc_id", F.col("id").alias("gap_id"), F.posexplode(F.array("before_id", "after_id")).alias("side", "event_id")).where("event_id is not null")
    e = events.select("doc_id", F.col("id").alias("event_id"), "entry_id", "title", "org")
    n = entries.select("doc_id", F.col("id").alias("entry_id"), F.posexplode("block_ids").alias("ord", "block_id"))
    b = blocks.select("doc_id", F.col("id").alias("block_id"), "text")
    links = ends.join(e, ["doc_id", "event_id"], "left").join(n, ["doc_id", "entry_id"], "left").join(b, ["doc_id", "block_id"], "left")
    quoted = links.groupBy("doc_id", "gap_id", "side", "event_id", "entry_id", "title", "org").agg(F.left(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), "\n"), F.lit(500)).alias("quote"))
    return quoted.groupBy("doc_id", "gap_id").agg(F.array_sort(F.collect_list(F.struct("side", "event_id", "entry_id", "title", "org", "quote"))).alias("links"))
