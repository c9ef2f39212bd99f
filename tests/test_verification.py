"""Events against their source, labels against predictions, matches of each kind, hidden parts of pages."""

from pyspark.sql import functions as F

from chronoweave.functions import text
from chronoweave.operators import evaluation, verification

EVENT = "doc_id string, id int, type string, title string, org string, s int, e int, is_present boolean"


def _event(i, s, e, title="Engineer", org="Blue Ltd", now=False, doc="a", kind="EMPLOYMENT"):
    return (doc, i, kind, title, org, s, e, now)


def test_events_in_their_text(spark):
    source = "ENGINEER at Blue Ltd, Sept. 2019 - 3/2021\nmanager, 2015-07 to Present; also 11/2012 and 1999"
    rows = [
        _event(1, 2019 * 12 + 9, 2021 * 12 + 3), _event(2, 2015 * 12 + 7, 24321, "Manager", "", True), _event(3, 2012 * 12 + 1, 1999 * 12 + 4, "Baker", "Green"), _event(4, 2001 * 12 + 1, None, "", "blue ltd"),
        _event(5, 24000, 24010, doc="no text"), _event(6, 24000, 24010, doc="null"),
    ]
    out = verification.verify(spark.createDataFrame(rows, EVENT), spark.createDataFrame([("a", source), ("null", None)], "doc_id string, text string"))
    got = {r.id: r for r in out.collect()}
    assert (got[1].start_found, got[1].end_found, got[1].verified) == ("sept. 2019", "3/2021", True)
    assert got[1].positions.start == source.lower().index("sept. 2019") and got[1].positions.title == 0
    assert (got[2].start_found, got[2].end_found, got[2].org_verified, got[2].verified) == ("2015-07", "present", False, True)  # no organisation is none missed
    assert (got[3].start_found, got[3].end_found, got[3].title_verified, got[3].verified) == ("1/2012", "1999", False, False)  # part of 11/2012, as the rule has it
    assert (got[4].start_verified, got[4].end_verified, got[4].org_verified, got[4].verified) == (False, False, True, False)
    assert not any((got[i].verified or got[i].title_verified) for i in (5, 6))
    (m,) = verification.verification_metrics(out.where("doc_id = 'a'"), ["doc_id"]).collect()
    assert (m.total, m.verified, m.precision, m.title, m.org, m.start, m.end) == (4, 2, 0.5, 0.5, 0.5, 0.75, 0.75)


def test_gaps_between_verified_employments(spark):
    source = "Jan 2010 - Dec 2010, Mar 2011 to Jun 2011, Jul 2015 - Aug 2015"
    rows = [_event(1, 24121, 24132), _event(2, 24135, 24138), _event(3, 24187, 24188), _event(4, 24150, 24160), _event(5, 24140, 24141, kind="PROJECT")]
    out = verification.verify(spark.createDataFrame(rows, EVENT).withColumn("title", F.lit("")).withColumn("org", F.lit("")), spark.createDataFrame([("a", source)], "doc_id string, text string"))
    assert [(r.s, r.e, r.months) for r in verification.verified_gaps(out).orderBy("s").collect()] == [(24133, 24134, 2), (24139, 24186, 48)]


def test_labels_take_the_first_unused_prediction(spark):
    predicted = spark.createDataFrame(
        [("x", 1, "Acme North Ltd", 100, 110, None, None, False), ("x", 2, "Acme Ltd", 100, 110, None, None, False), ("x", 3, "Beta", 120, 130, None, None, True), ("x", 4, "Gamma", None, None, "2019", "year", False), ("y", 1, "Acme", 1, 2, None, None, False), ("z", 1, None, 5, 6, None, None, None)],
        "case string, ord int, org string, s int, e int, date_label string, precision string, is_present boolean",
    )
    labels = spark.createDataFrame(
        [("x", 1, "ACME", 100, 110, None, None), ("x", 2, "acme north", 100, 110, None, None), ("x", 3, "beta", 120, None, None, None), ("x", 4, "gam", None, None, "2019", "year"), ("x", 5, "gam", None, None, "2019", "month"), ("w", 1, "acme", 1, 2, None, None)],
        "case string, ord int, org_part string, s int, e int, date_label string, precision string",
    )
    got = {(r.case, r.label, r.predicted) for r in verification.label_matches(predicted, labels).collect()}
    assert got == {("x", 1, 1), ("x", 3, 3), ("x", 4, 4)}  # label 1 takes the prediction that label 2 needs
    counts = {r.case: (r.tp, r.fp, r.fn) for r in verification.label_counts(predicted, labels).collect()}
    assert counts == {"x": (3, 1, 2), "y": (0, 1, 0), "z": (0, 1, 0), "w": (0, 0, 1)}


def test_false_positives_among_negative_cases(spark):
    cases = spark.createDataFrame([(0, 0), (0, 2), (3, 1), (0, 1)], "expected int, found int")
    assert tuple(verification.false_positive_rate(cases, "expected", "found").head()) == (3, 2, 0.667)
    assert tuple(verification.false_positive_rate(cases.where("expected > 0"), "expected", "found").head()) == (0, 0, None)


def test_matches_of_each_kind(spark):
    df = spark.createDataFrame([("blue ltd was here, engineer, 2019 and 2021. the big portal for green bank",)], "t string")
    one = lambda c: df.select(c.alias("c")).head().c
    t, lit = F.col("t"), F.lit
    assert one(evaluation.work_match(lit("blue ltd"), lit("engineer"), lit("2019-05"), lit("2021-01"), t)) == "MATCH"
    assert one(evaluation.work_match(lit("blue ltd"), lit("baker"), lit("2019-05"), lit("present"), t)) == "PARTIAL"
    assert one(evaluation.work_match(lit("red"), lit("baker"), lit("2019-05"), lit("present"), t)) == "MISSING"
    assert one(evaluation.work_match(lit(""), lit(None), lit(""), lit(None), t)) == "MISSING"
    assert one(evaluation.education_match(lit("hill"), lit(None), lit(None), lit("2021"), t)) == "PARTIAL"
    assert one(evaluation.education_match(lit(""), lit("engineer"), lit("present"), lit("2021"), t)) == "MATCH"
    assert one(evaluation.project_match(lit("a big PORTAL portal"), lit("green trust"), t)) == "MATCH"
    assert one(evaluation.project_match(lit("some thing else portal"), lit("green"), t)) == "PARTIAL"
    assert one(evaluation.project_match(lit("a b c"), lit(None), t)) == "MISSING"


def test_titles_to_compare(spark):
    df = spark.createDataFrame([("  Sr. Engineer/Lead (R&D)_2 ",), (None,), ("Ingénieur-Chef",)], "t string")
    assert [r[0] for r in df.select(text.title(F.col("t"))).collect()] == ["sr engineer lead r d _2", "", "ingénieur chef"]


def test_hidden_parts_end_where_they_close(spark):
    pages = [
        ("<p>a</p><div hidden>x<div>y</div>z</div><p>b</p>", "a\nb"), ('<p>a<input type="x" hidden>b</p>', "ab"), ("<div hidden><DIV>q</DIV><p>w</div>c<div>d</div>", "cd"), ("a<span hidden>never closed <b>x</b>", "a"),
        ("<p>1 < 2</p><div class='x' hidden='hidden'>n</div>e<div hidden>m</div>f", "1 < 2\nef"), ("<div>plain</div>", "plain"), (None, None), ("", ""),
    ]
    df = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(pages)], "id int, html string")
    assert [r.t and r.t.strip() for r in df.orderBy("id").select(text.visible_text(F.col("html")).alias("t")).collect()] == [t for _, t in pages]
