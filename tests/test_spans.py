"""Disjoint spans, offset maps and located values against plain Python."""

import random

from pyspark.sql import functions as F

from chronoweave.functions import text
from chronoweave.operators import spans

RND = random.Random(11)


def _greedy(found):
    kept = []
    for s, e, p in sorted(found, key=lambda x: (x[0], x[2], x[0] - x[1])):
        if all(e <= a or b <= s for a, b, _ in kept):
            kept.append((s, e, p))
    return kept


def test_disjoint_spans(spark):
    rows = [(i, [(s, s + RND.randrange(1, 9), RND.randrange(3)) for s in (RND.randrange(40) for _ in range(RND.randrange(0, 25)))]) for i in range(200)]
    rows += [(900, [(0, 4, 2), (2, 9, 0), (9, 11, 1), (9, 12, 1)]), (901, []), (902, [(3, 5, 1), (3, 5, 1)])]
    df = spark.createDataFrame(rows, "id int, spans array<struct<s:int,e:int,p:int>>")
    for r in df.select("id", "spans", spans.disjoint(F.col("spans")).alias("kept")).collect():
        assert [tuple(x) for x in r.kept] == _greedy([tuple(x) for x in r.spans])


def test_map_from_a_normalised_text(spark):
    pieces = ["word", "\x00", " ", "  \t ", "➢", "•x", "déjà", "op\x00on"]
    raws = ["".join(RND.choice(pieces) for _ in range(RND.randrange(0, 12))) for _ in range(200)] + ["", " ", "\x00"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(raws)], "id int, raw string").withColumn("n", spans.normalised(F.col("raw")))
    for r in df.select("raw", "n", text.normalise(F.col("raw")).alias("plain")).collect():
        assert r.n.text == r.plain and sum(x.o for x in r.n.map) == len(r.raw) and sum(x.n for x in r.n.map) == len(r.n.text)
    word = df.where(F.col("n.text").contains("word")).withColumn("at", F.instr("n.text", "word") - 1)
    for r in word.select("raw", spans.to_original(F.col("n.map"), F.col("at"), F.col("at") + 4).alias("o")).collect():
        assert r.raw[r.o.start : r.o.end] == "word"
    whole = spark.createDataFrame([("a op\x00ons b",)], "raw string").withColumn("n", spans.normalised(F.col("raw")))
    (r,) = whole.select("n.text", spans.to_original(F.col("n.map"), F.lit(2), F.lit(9)).alias("o")).collect()
    assert r.text == "a options b" and (r.o.start, r.o.end) == (2, 8)


def test_located_values(spark):
    cases = [("Blue  Labs (Pvt) Ltd", "BLUE LABS", 0, 10), ("at Crème-Works, now", "crème works", 3, 14), ("nothing", "else", None, None), ("x", "", None, None), ("x", "--", None, None), (None, "a", None, None), ("İzmir Labs", "labs", 6, 10)]
    df = spark.createDataFrame([(i, t, v) for i, (t, v, _, _) in enumerate(cases)], "id int, t string, v string")
    got = {r.id: r.at for r in df.select("id", spans.located(F.col("t"), F.col("v")).alias("at")).collect()}
    for i, (_, _, s, e) in enumerate(cases):
        assert (got[i] is None) if s is None else (got[i].start, got[i].end) == (s, e)


def test_stretch_in_parts(spark):
    df = spark.createDataFrame([([("a", 0, 5), ("b", 6, 9), ("c", 10, 20)],)], "parts array<struct<part:string,`from`:int,to:int>>")
    cut = lambda s, e: [tuple(x) for x in df.select(spans.in_parts(F.col("parts"), F.lit(s), F.lit(e)).alias("x")).head().x]
    assert cut(3, 12) == [("a", 3, 5), ("b", 0, 3), ("c", 0, 2)]
    assert cut(5, 6) == [] and cut(0, 1) == [("a", 0, 1)]
