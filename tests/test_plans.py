"""How often plans of queries exchange, sort and evaluate what is dear, which decides how they grow."""

from pyspark.sql import functions as F

from chronoweave.functions import lines as L
from chronoweave.functions import labels, text
from chronoweave.operators import evaluation, events
from chronoweave.plans import documents, registry
from chronoweave.sources.staging import staged

SF = "/root/testdata/sf0.001"


def _plan(spark, name):
    return registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_project_starts_share_one_exchange(spark):
    plan = _plan(spark, "b8_project_starts")
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("- Sort [") == 2


def test_titles_and_kinds_of_odd_lines(spark):
    rows = ["# # Project 1", "SKILLS ", "sKILLS:", "Work\t History", "** KEY PROJECTS **", "Education and more", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string").orderBy("i")
    got = df.select("i", L.is_explicit_project(F.col("t")).alias("p"), L.is_emphasised(F.col("t")).alias("e"), text.header_kind(F.col("t")).alias("h"), L.section_kind(F.col("t")).alias("s")).collect()
    assert [r.h for r in got] == [None, "SKILLS", "SKILLS", "EXPERIENCE", "PROJECTS", None, None, None]
    assert [r.s for r in got] == [None, "SKILLS", "SKILLS", "EXPERIENCE", "PROJECTS", None, None, None]
    assert [r.p for r in got] == [False] * 7 + [None] and [r.e for r in got] == [True, True, False, False, True, False, False, None]


def test_offset_maps_are_made_once(spark):
    assert _plan(spark, "h20_offset_map").count("regexp_extract_all(") == 2


def test_association_reads_and_sorts_mentions_once(spark):
    plan = _plan(spark, "k10_date_association")
    assert plan.count("FileScan parquet") == 2 and plan.count("- Sort [") == 2
    assert not any(x in plan for x in ("Join", "Partial"))


def test_association_with_all_entries_given(spark):
    rows = [(1, 1, False, 5, 6), (1, 2, False, 7, 7), (2, 1, False, 9, 9), (2, 2, False, 3, 4), (3, 1, True, 1, 2), (3, 2, True, 3, 4), (3, 3, False, 0, 0), (None, 1, False, 5, 5)]
    mentions = spark.createDataFrame([(k, f"{k}:{o}", o, *more) for k, o, *more in rows], "entry_id int, id string, ord int, is_range boolean, s int, e int")
    entries = spark.createDataFrame([(1,), (2,), (3,), (4,), (None,)], "entry_id int")
    got = {(r.entry_id, r.id): (r.status, r.confidence, r.reason) for r in events.associate(mentions, entries).collect()}
    assert got == {
        (1, "1:1"): ("CONFIRMED", 0.85, events.PAIR), (1, "1:2"): ("CONFIRMED", 0.85, events.PAIR), (2, "2:1"): ("AMBIGUOUS", 0.3, events.NO_DATE), (2, "2:2"): ("AMBIGUOUS", 0.3, events.NO_DATE),
        (3, "3:1"): ("AMBIGUOUS", 0.6, events.MULTI), (3, "3:2"): ("AMBIGUOUS", 0.5, events.MULTI), (None, "None:1"): ("CONFIRMED", 0.85, events.SAME_LINE), (4, None): ("UNRESOLVED", 0.3, events.NO_DATE),
    }


def test_cosines_exchange_each_document_once(spark):
    plan = _plan(spark, "h53_term_cosine")
    assert plan.count("Exchange hashpartitioning(doc_id") == 1


def test_cosines_of_counts(spark):
    terms = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "c"), (3, "d"), (None, "a")], "doc_id int, term string")
    queries = spark.createDataFrame([("q", "a"), ("q", "c"), (None, "a")], "query_id string, term string")
    got = {(r.doc_id, r.query_id): r.cosine for r in evaluation.term_cosine(terms, queries).collect()}
    assert got == {(1, "q"): round(2 / (5 * 2) ** 0.5, 6), (2, "q"): round(1 / 2**0.5, 6)}


def test_documents_are_sorted_once_a_division_and_labelled_once_an_entry(spark):
    docs = spark.createDataFrame([("a", "WORK EXPERIENCE\nEngineer, Blue Labs Ltd, Jan 2020 - Dec 2022\n• Built it")], "doc_id string, text string")
    planned = lambda df: df._jdf.queryExecution().executedPlan().toString()
    parted = documents.sections(documents.blocks(docs, 24321))
    # lines in both orders of blocks() and sections(), then parts by headings, parts by jobs, sections
    assert planned(parted).count("- Sort [") == 5
    lines = documents.entries(staged(parted, "sections"))
    # groups of both kinds of sections; none again for entries
    assert planned(lines).count("Exchange hashpartitioning") == 2
    # asked in four places of one expression
    assert planned(documents.extract(staged(lines, "lines"))).count(labels._ROLE_AT_EMPLOYER) == 4
