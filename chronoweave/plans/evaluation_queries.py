"""Evaluation operators: labels against predictions, rollups, tiers and duplicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation, profile, routing
from ._register import Register, table
from .interval_queries import WIDE, T, islands, timeline, walk

query = Register()
QUERIES, SQL = query.queries, query.sql

COUNTS = "c AS (SELECT o_orderpriority AS category, count(*) FILTER (o_orderkey % 7 < 4) AS tp, count(*) FILTER (o_orderkey % 7 = 4) AS fp, count(*) FILTER (o_orderkey % 7 = 5 AND o_orderstatus = 'F') AS fn FROM orders GROUP BY 1)"


def counts(spark, d):
    k = F.col("o_orderkey") % 7
    return table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("category")).agg(F.count_if(k < 4).alias("tp"), F.count_if(k == 4).alias("fp"), F.count_if((k == 5) & (F.col("o_orderstatus") == "F")).alias("fn"))


@query("d11_precision_recall", f"WITH {COUNTS}, x AS (SELECT *, tp / (tp + fp) AS p, tp / (tp + fn) AS r FROM c) SELECT category, tp, fp, fn, round(p, 4) AS precision, round(r, 4) AS recall, round(2 * p * r / (p + r), 4) AS f1 FROM x")
def d11(spark, d):
    return evaluation.metrics(counts(spark, d))


@query("d13_corpus_counts", f"WITH {COUNTS} SELECT sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM c")
def d13(spark, d):
    return counts(spark, d).agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")))


@query("c9_full_outer_pairing", "SELECT coalesce(a.k, b.k) AS key, CASE WHEN b.k IS NULL THEN 'no_reference' WHEN a.k IS NULL THEN 'no_prediction' ELSE 'both' END AS side FROM (SELECT c_custkey AS k FROM customer WHERE c_custkey % 3 <> 0) a FULL JOIN (SELECT c_custkey AS k FROM customer WHERE c_custkey % 5 <> 0) b ON a.k = b.k")
def c9(spark, d):
    k = table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    return evaluation.pair(k.where("k % 3 <> 0"), k.where("k % 5 <> 0"), "k")


@query("g4_key_sets", "SELECT k, 'shared' AS side FROM (SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0) UNION ALL SELECT k, 'missing' FROM (SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderkey % 3 = 0)")
def g4(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    shared = o.select(F.col("o_custkey").alias("k")).intersect(c.where("c_custkey % 2 = 0").select("c_custkey"))
    missing = c.select(F.col("c_custkey").alias("k")).subtract(o.where("o_orderkey % 3 = 0").select("o_custkey"))
    return shared.withColumn("side", F.lit("shared")).union(missing.withColumn("side", F.lit("missing")))


@query("c13_multiset_match", f"WITH {T}, p AS (SELECT doc_id, e - s AS v, count(*) AS p FROM t WHERE id % 2 = 0 GROUP BY ALL), q AS (SELECT doc_id, e - s AS v, count(*) AS q FROM t WHERE id % 3 = 0 GROUP BY ALL), j AS (SELECT coalesce(p.doc_id, q.doc_id) AS doc_id, coalesce(p, 0) AS p, coalesce(q, 0) AS q FROM p FULL JOIN q ON p.doc_id = q.doc_id AND p.v = q.v) SELECT doc_id, sum(least(p, q))::BIGINT AS tp, sum(p - least(p, q))::BIGINT AS fp, sum(q - least(p, q))::BIGINT AS fn FROM j GROUP BY 1")
def c13(spark, d):
    t = timeline(spark, d).withColumn("v", F.col("e") - F.col("s"))
    return evaluation.multiset_counts(t.where("id % 2 = 0"), t.where("id % 3 = 0"), ["doc_id"], "v")


@query("g5_multiset_intersection", "SELECT o_orderpriority AS v FROM orders WHERE o_orderkey % 2 = 0 INTERSECT ALL SELECT o_orderpriority FROM orders WHERE o_orderkey % 3 = 0")
def g5(spark, d):
    o = table(spark, d, "orders")
    return o.where("o_orderkey % 2 = 0").select(F.col("o_orderpriority").alias("v")).intersectAll(o.where("o_orderkey % 3 = 0").select("o_orderpriority"))


GREEDY = """ed AS (SELECT p.doc_id, p.id AS i, q.id AS j, (p.s = q.s)::INT + (p.e = q.e)::INT AS score FROM t p JOIN t q ON p.doc_id = q.doc_id AND p.id % 2 = 0 AND q.id % 2 = 1 WHERE p.s = q.s OR p.e = q.e),
en AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, i, j) AS n FROM ed),
st(doc_id, n, a, b) AS (SELECT DISTINCT doc_id, 0::BIGINT, []::BIGINT[], []::BIGINT[] FROM en UNION ALL SELECT en.doc_id, en.n, CASE WHEN list_contains(a, i) OR list_contains(b, j) THEN a ELSE list_append(a, i) END, CASE WHEN list_contains(a, i) OR list_contains(b, j) THEN b ELSE list_append(b, j) END FROM st JOIN en ON en.doc_id = st.doc_id AND en.n = st.n + 1),
fin AS (SELECT doc_id, a, b FROM st QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC) = 1), pr AS (SELECT doc_id, unnest(a) AS i, unnest(b) AS j FROM fin)"""


@query("c11_greedy_matching", f"WITH RECURSIVE {T}, {GREEDY} SELECT pr.doc_id, pr.i, pr.j, score FROM pr JOIN ed ON ed.i = pr.i AND ed.j = pr.j")
def c11(spark, d):
    t = timeline(spark, d)
    p = t.where("id % 2 = 0").select("doc_id", F.col("id").alias("i"), "s", "e")
    g = t.where("id % 2 = 1").select("doc_id", F.col("id").alias("j"), F.col("s").alias("gs"), F.col("e").alias("ge"))
    edges = p.join(g, "doc_id").withColumn("score", (F.col("s") == F.col("gs")).cast("int") + (F.col("e") == F.col("ge")).cast("int"))
    return evaluation.greedy_match(edges.where("score > 0"), ["doc_id"])


@query("b24_field_match", "SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'MATCH' WHEN p_partkey % 4 < 3 THEN 'PARTIAL' ELSE 'MISSING' END AS match FROM part")
def b24(spark, d):
    k = F.col("p_partkey") % 4
    found, given = [k <= 2, k == 0, k == 0], [F.lit(True), F.lit(True), k == 0]
    return table(spark, d, "part").select("p_partkey", evaluation.field_match(found, given).alias("match"))


@query("d15_field_score", "SELECT p_partkey, round((4 * (p_size % 3) / 2.0::DOUBLE + 2 * (p_size % 2) + 3 * (p_size % 5) / 4.0::DOUBLE + 1) / 10, 4) AS score FROM part")
def d15(spark, d):
    k = F.col("p_size")
    return table(spark, d, "part").select("p_partkey", evaluation.field_score((k % 3) / 2, (k % 2).cast("double"), (k % 5) / 4, F.lit(1.0)).alias("score"))


@query("d16_rollup", "SELECT o_orderpriority AS field, count(*) AS n, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY ROLLUP (o_orderpriority)")
def d16(spark, d):
    return evaluation.rollup(table(spark, d, "orders").withColumnRenamed("o_orderpriority", "field"), "field", "o_totalprice")


@query("d17_error_patterns", "SELECT e AS error, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN o_orderstatus = 'F' THEN 'final' END, CASE WHEN o_totalprice > 200000 THEN 'large' END, CASE WHEN o_orderkey % 9 = 0 THEN 'nine' END], lambda x: x IS NOT NULL)) AS e FROM orders) GROUP BY 1")
def d17(spark, d):
    e = F.array_compact(F.array(F.when(F.col("o_orderstatus") == "F", "final"), F.when(F.col("o_totalprice") > 200000, "large"), F.when(F.col("o_orderkey") % 9 == 0, "nine")))
    return table(spark, d, "orders").select(F.explode(e).alias("error")).groupBy("error").agg(F.count(F.lit(1)).alias("n"))


@query("d18_duplicate_content", "SELECT sha256(text) AS hash, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def d18(spark, d):
    return evaluation.duplicates(table(spark, d, "documents"), F.col("text"))


@query("d19_tiers", "WITH x AS (SELECT CASE WHEN l_discount * 10 >= 0.85 THEN 'HIGH' WHEN l_discount * 10 >= 0.60 THEN 'MEDIUM' ELSE 'LOW' END AS tier FROM lineitem), c AS (SELECT tier, count(*) AS n FROM x GROUP BY 1) SELECT tier, n, round(100 * n / sum(n) OVER (), 1) AS pct FROM c")
def d19(spark, d):
    return evaluation.tiers(table(spark, d, "lineitem").select((F.col("l_discount") * 10).alias("score")), "score")


@query("d20_status_histogram", "SELECT o_orderstatus AS status, floor(o_totalprice / 50000)::BIGINT AS bin, count(*) AS n, count(*) FILTER (o_orderkey % 2 = 0) AS even FROM orders GROUP BY ALL")
def d20(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("status"), F.floor(F.col("o_totalprice") / 50000).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderkey") % 2 == 0).alias("even"))


@query("d21_dated_share", f"WITH {T}, x AS (SELECT doc_id, max((type = 'EDUCATION')::INT) AS e, max((type = 'EMPLOYMENT')::INT) AS j FROM t GROUP BY 1) SELECT round(avg(e), 4) AS education, round(avg(j), 4) AS jobs FROM x")
def d21(spark, d):
    x = timeline(spark, d).groupBy("doc_id").agg(F.max((F.col("type") == "EDUCATION").cast("int")).alias("e"), F.max((F.col("type") == "EMPLOYMENT").cast("int")).alias("j"))
    return x.agg(F.round(F.avg("e"), 4).alias("education"), F.round(F.avg("j"), 4).alias("jobs"))


@query("d22_calibration", "SELECT l_returnflag AS flag, count(*) AS n, round(abs(avg(l_discount * 10) - avg((l_linestatus = 'F')::INT)), 4) AS error FROM lineitem GROUP BY 1")
def d22(spark, d):
    l = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("flag"), (F.col("l_discount") * 10).alias("p"), (F.col("l_linestatus") == "F").alias("ok"))
    return evaluation.calibration(l, ["flag"], "p", "ok")


@query("d24_verification_shares", f"WITH {T} SELECT field, round(avg(ok), 4) AS share FROM (SELECT 'title' AS field, (id % 3 = 0)::INT AS ok FROM t UNION ALL SELECT 'org', (id % 4 = 0)::INT FROM t UNION ALL SELECT 'dates', (precision = 'month')::INT FROM t) GROUP BY 1")
def d24(spark, d):
    t = timeline(spark, d)
    f = t.selectExpr("stack(3, 'title', id % 3 = 0, 'org', id % 4 = 0, 'dates', precision = 'month') as (field, ok)")
    return f.groupBy("field").agg(F.round(F.avg(F.col("ok").cast("int")), 4).alias("share"))


@query("d25_unexplained_projects", "SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey % 20 ELSE 0 END::INT AS claimed, greatest(0, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey % 20 ELSE 0 END - s_suppkey % 7)::INT AS unexplained FROM supplier")
def d25(spark, d):
    k = F.col("s_suppkey")
    s = table(spark, d, "supplier").select("s_suppkey", (k % 7).cast("int").alias("described"), F.when(k % 2 == 0, F.concat(F.lit("Did 0 projects, then "), (k % 20).cast("string"), F.lit("+ projects"))).otherwise("none").alias("text"))
    return profile.unexplained_projects(s).select("s_suppkey", "claimed", "unexplained")


@query("d30_composite", "SELECT p_partkey, round(0.35 * (p_size % 10) / 10.0::DOUBLE + 0.25 * (p_size % 4) / 4.0::DOUBLE + 0.20 + 0.20 * (p_size % 2)::DOUBLE, 4)::DOUBLE AS score FROM part")
def d30(spark, d):
    k = F.col("p_size")
    p = table(spark, d, "part").select("p_partkey", ((k % 10) / 10).alias("a"), ((k % 4) / 4).alias("b"), F.lit(1.0).alias("c"), (k % 2).cast("double").alias("e"))
    return p.select("p_partkey", evaluation.composite({"a": 0.35, "b": 0.25, "c": 0.20, "e": 0.20}).alias("score"))


@query("d31_overall_status", "SELECT l_orderkey AS doc_id, CASE WHEN bool_or(l_returnflag = 'R' AND l_linenumber > 4) THEN 'FAILED' WHEN bool_or(l_returnflag = 'A') THEN 'PARTIAL' ELSE 'SUCCESS' END AS status FROM lineitem GROUP BY 1")
def d31(spark, d):
    s = F.when((F.col("l_returnflag") == "R") & (F.col("l_linenumber") > 4), "FAILED").when(F.col("l_returnflag") == "A", "PARTIAL").otherwise("SUCCESS")
    return routing.overall_status(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), s.alias("status")))


SKILLS = "h AS (SELECT o_custkey AS k, list_sort(list_distinct(list(o_orderpriority))) AS have FROM orders GROUP BY 1)"


@query("c17_skill_fit", f"WITH {SKILLS}, x AS (SELECT k, list_sort(list_intersect(have, ['1-URGENT', '2-HIGH', '9-NONE'])) AS s FROM h) SELECT k, array_to_string(s, ',') AS shared, round(len(s) / 3, 6) AS skill, round(100 * (0.7::DOUBLE * len(s) / 3 + 0.3::DOUBLE * 0.5))::INT AS score FROM x")
def c17(spark, d):
    h = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.collect_set("o_orderpriority").alias("have"))
    shared, _, skill = evaluation.skill_fit(F.col("have"), F.array(*(F.lit(x) for x in ("1-URGENT", "2-HIGH", "9-NONE"))))
    return h.select("k", F.array_join(shared, ",").alias("shared"), F.round(skill, 6).alias("skill"), evaluation.fit_verdict(skill, F.lit(0.5))[0].alias("score"))


@query("k13_profile", f"""WITH {T}, {WIDE}, {walk('u')}, wk AS (SELECT * FROM t WHERE type = 'EMPLOYMENT'), {islands('wk')}, m AS (SELECT doc_id, sum(e - s + 1)::BIGINT AS months FROM i GROUP BY 1), st AS (SELECT doc_id, min(e - s + 1) AS lo, avg(e - s + 1) AS av, min(s) AS f FROM wk GROUP BY 1),
ed AS (SELECT doc_id, max(e) AS g FROM t WHERE type = 'EDUCATION' GROUP BY 1), gp AS (SELECT doc_id, max(months) AS gap FROM w GROUP BY 1)
SELECT d.doc_id, m.months, array_to_string(list_filter([CASE WHEN months >= 60 THEN 'experienced' WHEN months >= 24 THEN 'some experience' END, CASE WHEN av >= 24 THEN 'stable' END, CASE WHEN f - g BETWEEN 0 AND 6 THEN 'started soon after study' END], lambda x: x IS NOT NULL), ';') AS pros,
 array_to_string(list_filter([CASE WHEN gap > 3 THEN 'long gap' END, CASE WHEN f - g > 6 THEN 'late start' END, CASE WHEN lo < 12 THEN 'short stint' END], lambda x: x IS NOT NULL), ';') AS cons
FROM (SELECT DISTINCT doc_id FROM t) d LEFT JOIN m ON d.doc_id = m.doc_id LEFT JOIN st ON d.doc_id = st.doc_id LEFT JOIN ed ON d.doc_id = ed.doc_id LEFT JOIN gp ON d.doc_id = gp.doc_id""")  # fmt: skip
def k13(spark, d):
    return profile.pros_cons(timeline(spark, d)).select("doc_id", "months", F.array_join("pros", ";").alias("pros"), F.array_join("cons", ";").alias("cons"))


@query("c14_corrections", f"WITH {T} SELECT id, CASE WHEN id % 4 = 0 THEN 'Fixed' ELSE title END AS title, CASE WHEN id % 4 = 0 THEN 'title' ELSE '' END AS corrected FROM t")
def c14(spark, d):
    t = timeline(spark, d)
    c = t.where("id % 4 = 0").select("id", F.lit("Fixed").alias("title"), F.lit(None).cast("string").alias("org"))
    return routing.merge_corrections(t, c, ["title", "org"]).select("id", "title", F.array_join("corrected", ",").alias("corrected"))


@query("b14_weak_fields", f"WITH {T} SELECT id, unnest(CASE WHEN id % 2 = 0 THEN ['org', 's', 'e'] ELSE ['title', 'org', 's', 'e'] END) AS field FROM t WHERE confidence < 0.7")
def b14(spark, d):
    t = timeline(spark, d).withColumn("title_source", F.when(F.col("id") % 2 == 0, "b1"))
    return routing.weak_fields(t.withColumns({f"{f}_source": F.lit(None).cast("string") for f in ("org", "s", "e")}))
