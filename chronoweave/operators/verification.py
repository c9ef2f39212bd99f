"""Extracted events against the text they came from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import months
from . import evaluation, intervals

# How a month is written in a source, in this order, and words for an open end.
NAMES = (("january", "jan"), ("february", "feb"), ("march", "mar"), ("april", "apr"), ("may",), ("june", "jun"), ("july", "jul"), ("august", "aug"), ("september", "sep", "sept"), ("october", "oct"), ("november", "nov"), ("december", "dec"))
OPEN_ENDS = ("present", "till date", "current", "ongoing")
FIELDS = ("title", "org", "start", "end")
#: All that a written month can need stands in so many characters before the last digits of a year, and after them.
_AROUND_YEARS = r"(?s).{0,16}[0-9]{4}(?:-[0-9]{2})?"


def date_context(text: Column) -> Column:
    """The parts of a text around its four-digit numbers: what a search for months and years has to look at."""
    return F.array_join(F.regexp_extract_all(F.lower(text), F.lit(f"({_AROUND_YEARS})"), F.lit(1)), "\n")


def written(i: Column) -> Column:
    """The ways in which a month index may be written: numbers first, then names."""
    y, m = months.year_of(i).cast("string"), months.month_of(i)
    names = F.element_at(F.array(*(F.array(*(F.lit(n) for n in n_)) for n_ in NAMES)), m)
    plain = m.cast("string")
    numbers = F.array(F.concat(plain, F.lit("/"), y), F.concat(y, F.lit("-"), F.lpad(plain, 2, "0")), F.concat(plain, F.lit("-"), y))
    return F.concat(numbers, F.flatten(F.transform(names, lambda n: F.array(F.concat(n, F.lit(" "), y), F.concat(n, F.lit(". "), y), F.concat(n, F.lit("-"), y)))))


def _found_date(i: Column, context: Column) -> Column:
    """The way in which the text has the month, or else its year; null if it has neither."""
    whole = F.try_element_at(F.filter(written(i), lambda v: context.contains(v)), F.lit(1))
    return F.when(i.isNotNull(), F.coalesce(whole, F.when(context.contains(months.year_of(i).cast("string")), months.year_of(i).cast("string"))))


def verify(events: DataFrame, texts: DataFrame) -> DataFrame:
    """events with title_verified, org_verified, start_verified, end_verified, start_found and end_found (how the text
    has the dates, month or year alone), positions (title, org, start, end in the text, from 0) and verified: whether
    all fields that the event has are there.

    texts is (doc_id, text), one row a document. The end of a running event (is_present) is a word for that. An
    event without text has nothing verified; a field that is empty is neither found nor missed."""
    sources = texts.select("doc_id", F.lower("text").alias("__text"), date_context(F.col("text")).alias("__dates"))
    e = events.join(sources, "doc_id", "left").withColumns({"__text": F.coalesce("__text", F.lit("")), "__dates": F.coalesce("__dates", F.lit(""))})
    now = F.coalesce(F.col("is_present"), F.lit(False))
    open_end = F.coalesce(*(F.when(F.col("__text").contains(w), F.lit(w)) for w in OPEN_ENDS))
    in_text = lambda c: (F.coalesce(F.col(c), F.lit("")) != "") & F.col("__text").contains(F.lower(F.col(c)))
    e = e.withColumns({"title_verified": in_text("title"), "org_verified": in_text("org"), "start_found": _found_date(F.col("s"), F.col("__dates")), "end_found": F.when(now, open_end).otherwise(_found_date(F.col("e"), F.col("__dates")))})
    e = e.withColumns({"start_verified": F.col("start_found").isNotNull(), "end_verified": F.col("end_found").isNotNull()})
    at = lambda found, value: F.when(found, F.instr("__text", value) - 1)
    place = F.struct(at(F.col("title_verified"), F.lower("title")).alias("title"), at(F.col("org_verified"), F.lower("org")).alias("org"), at(F.col("start_verified"), F.col("start_found")).alias("start"), at(F.col("end_verified"), F.col("end_found")).alias("end"))
    given = {"title": F.coalesce(F.col("title"), F.lit("")) != "", "org": F.coalesce(F.col("org"), F.lit("")) != "", "start": F.col("s").isNotNull(), "end": F.col("e").isNotNull()}
    whole = F.lit(True)
    for f, has in given.items():
        whole = whole & (~has | F.col(f"{f}_verified"))
    return e.withColumns({"positions": place, "verified": whole}).drop("__text", "__dates")


def verification_metrics(verified: DataFrame, by: list[str]) -> DataFrame:
    """By group: total, verified events, their share, and the share of each field that is verified."""
    share = lambda c: F.round(F.avg(F.col(c).cast("double")), 3)
    return verified.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), F.count_if("verified").alias("verified"), share("verified").alias("precision"), *(share(f"{f}_verified").alias(f) for f in FIELDS))


def verified_gaps(verified: DataFrame) -> DataFrame:
    """Gaps between employments both of whose ends are in the text, in the order of their ends."""
    return intervals.neighbour_gaps(verified.where("type = 'EMPLOYMENT' and start_verified and end_verified and e is not null"), ["doc_id"])


def label_matches(predicted: DataFrame, labels: DataFrame, case: str = "case") -> DataFrame:
    """(case, label, predicted): each label's first unused prediction, in the order of labels and predictions.

    predicted: case, ord, org, s, e, date_label, precision, is_present. labels: case, ord, org_part, and either
    date_label and precision or s and e (null for a running one). A prediction fits if its organisation holds
    the label's part, in any case, and its dates are the label's. Dates are equal, so both kinds of labels join
    on them and the part is compared only within; what remains is a choice inside one case.
    """
    p = predicted.select(case, F.col("ord").alias("j"), F.lower(F.coalesce("org", F.lit(""))).alias("org"), F.col("s").alias("ps"), F.when(~F.coalesce("is_present", F.lit(False)), F.col("e")).alias("pe"), F.coalesce("is_present", F.lit(False)).alias("now"), F.col("date_label").alias("pl"), F.col("precision").alias("pp"))
    t = labels.select(case, F.col("ord").alias("i"), F.lower("org_part").alias("part"), "s", "e", "date_label", "precision")
    worded = t.where("date_label is not null").withColumnsRenamed({"date_label": "pl", "precision": "pp"}).join(p, [case, "pl", "pp"])
    dated = t.where("date_label is null").withColumn("now", F.col("e").isNull()).withColumnRenamed("s", "ps").join(p, [case, "ps", "now"]).where("now or e = pe")
    fits = worded.select(case, "i", "j", "org", "part").unionByName(dated.select(case, "i", "j", "org", "part")).where(F.col("org").contains(F.col("part")))
    edges = fits.select(case, "i", "j", (-F.col("i")).cast("double").alias("score"))
    return evaluation.greedy_match(edges, [case]).select(case, F.col("i").alias("label"), F.col("j").alias("predicted"))


def label_counts(predicted: DataFrame, labels: DataFrame, case: str = "case") -> DataFrame:
    """(case, tp, fp, fn) of label_matches(), for every case that has labels or predictions."""
    n = lambda df, name: df.groupBy(case).agg(F.count(F.lit(1)).alias(name))
    both = n(predicted, "p").join(n(labels, "t"), case, "full_outer").join(n(label_matches(predicted, labels, case), "tp"), case, "left").na.fill(0)
    return both.select(case, "tp", (F.col("p") - F.col("tp")).alias("fp"), (F.col("t") - F.col("tp")).alias("fn"))


def false_positive_rate(cases: DataFrame, expected: str, found: str) -> DataFrame:
    """One row: negative cases (nothing expected), those with something found, and their share (null without any)."""
    c = cases.where(F.col(expected) == 0)
    return c.agg(F.count(F.lit(1)).alias("negative"), F.count_if(F.col(found) > 0).alias("false_positive"), F.round(F.avg((F.col(found) > 0).cast("double")), 3).alias("rate"))
