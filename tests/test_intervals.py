import random

from chronoweave.functions.mentions import find_mentions
from chronoweave.operators import evaluation, events, intervals, state
from chronoweave.sources import readers, store
from chronoweave.streaming import ingest

AS_OF = 2026 * 12 + 9


def _ix(y, m):
    return 12 * y + m


def test_union_and_uncovered_equal_month_sets(spark):
    rnd = random.Random(3)
    rows = [(k, rnd.randrange(0, 60), rnd.randrange(0, 9)) for k in range(40) for _ in range(rnd.randrange(1, 8))]
    rows = [(k, s, s + n, i) for i, (k, s, n) in enumerate(rows)] + [(99, 5, 1, 1000)]
    iv = spark.createDataFrame(rows, "k int, s int, e int, id int")
    sets = {}
    for k, s, e, _ in rows:
        sets.setdefault(k, set()).update(range(s, e + 1))
    got = {}
    for r in intervals.union(iv, ["k"]).collect():
        assert not got.setdefault(r.k, set()) & set(range(r.s, r.e + 1))
        got[r.k] |= set(range(r.s, r.e + 1))
    assert got == {k: v for k, v in sets.items() if v}
    spans = spark.createDataFrame([(k, -2, 75) for k in sets], "k int, lo int, hi int")
    holes = {}
    for r in intervals.uncovered(iv, ["k"], spans).collect():
        holes.setdefault(r.k, set()).update(range(r.s, r.e + 1))
    assert holes == {k: set(range(-2, 76)) - v for k, v in sets.items()}


def test_gap_walk_keeps_the_earlier_of_equal_ends(spark):
    rows = [(1, 1, 0, 10, "month"), (1, 2, 2, 10, "month"), (1, 3, 14, 20, "month"), (1, 4, 24, 30, "year")]
    got = intervals.gaps(spark.createDataFrame(rows, "k int, id int, s int, e int, precision string"), ["k"]).collect()
    assert [(r.before_id, r.after_id, r.s, r.e, r.months) for r in got] == [(1, 3, 11, 13, 3)]


def test_mentions():
    def of(line):
        return [(m["s"], m["e"], m["precision"], m["is_range"]) for m in find_mentions(line, AS_OF)]

    assert of("Software Developer, Jan 2020 to June 2022") == [(_ix(2020, 1), _ix(2022, 6), "month", True)]
    assert of("Engineer, Feb 2025 - Present") == [(_ix(2025, 2), AS_OF, "month", True)]
    assert of("June 2022 to Jan 2020") == [] and of(None) == []
    assert not any(is_range for *_, is_range in of("13/2018 – 10/2019"))
    assert of("B.Tech 2013-2017") == [(_ix(2013, 1), _ix(2017, 12), "year", True)]
    for m in find_mentions("A Jan 2020 - Feb 2021, B Mar 2022 - Present", AS_OF):
        assert "A Jan 2020 - Feb 2021, B Mar 2022 - Present"[m["char_start"] : m["char_end"]] == m["raw"]


def test_metrics_of_nothing_are_null(spark):
    r = evaluation.metrics(spark.createDataFrame([(0, 0, 0), (1, 1, 0)], "tp long, fp long, fn long")).collect()
    assert (r[0].precision, r[0].recall, r[0].f1) == (None, None, None) and r[1].f1 == 0.6667


def test_greedy_takes_the_best_edge_first(spark):
    edges = spark.createDataFrame([(1, 0, 0, 1), (1, 0, 1, 2), (1, 1, 1, 2), (1, 1, 0, 1)], "g int, i int, j int, score int")
    assert sorted((r.i, r.j) for r in evaluation.greedy_match(edges, ["g"]).collect()) == [(0, 1), (1, 0)]


def test_repeated_note_is_ignored(spark):
    old = spark.createDataFrame([("d", "n1", "a")], "doc_id string, id string, text string")
    new = spark.createDataFrame([("d", "n1", "a"), ("d", "n2", "b")], "doc_id string, id string, text string")
    assert sorted(r.id for r in state.append_notes(old, new).collect()) == ["n1", "n2"]


def test_store_replaces_by_document(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "store"))
    s.init()
    schema = store.SCHEMAS["gaps"]
    row = lambda d, i: (d, i, 1, 2, 2, "POTENTIAL_GAP", 0.5, [])
    s.replace("gaps", spark.createDataFrame([row("a", "1"), row("b", "2")], schema))
    s.replace("gaps", spark.createDataFrame([row("a", "3")], schema))
    assert sorted((r.doc_id, r.id) for r in s.read("gaps").collect()) == [("a", "3"), ("b", "2")]
    assert [r.id for r in s.get("gaps", "b").collect()] == ["2"]


def test_docx_body():
    import io
    import zipfile

    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    xml = f"<w:document {w}><w:body>{p('Hello')}<w:tbl><w:tr><w:tc>{p('a')}</w:tc><w:tc>{p('b')}</w:tc></w:tr></w:tbl></w:body></w:document>"
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("word/document.xml", xml)
    assert readers.docx_text(b.getvalue()) == "Hello\na | b" and readers.docx_text(b"no zip") is None


def test_stream_takes_each_content_once(spark, tmp_path):
    src, seen = tmp_path / "in", []
    spark.createDataFrame([("x",), ("y",), ("x",)], "text string").coalesce(1).write.parquet(str(src))
    stream = ingest.once(spark.readStream.schema("text string").parquet(str(src)))
    q = ingest.into(stream, lambda df, _: seen.extend(r.text for r in df.collect()), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert sorted(seen) == ["x", "y"]


def test_confidence_of_open_gap(spark):
    from pyspark.sql import functions as F

    r = spark.range(1).select(events.gap_confidence(F.lit(0.0), F.lit(0.9), F.lit(False)).alias("c")).head()
    assert r.c == 0.3
