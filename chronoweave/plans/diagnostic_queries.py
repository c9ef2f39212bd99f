"""Diagnostics over orders, lines and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import diagnostics, evaluation
from ._register import Register, table
from .interval_queries import ROUTE, T, timeline
from .text_queries import LINES, lines

query = Register()
QUERIES, SQL = query.queries, query.sql


@query("d7_grounding", f"WITH {T} SELECT doc_id, round(sum((id % 3 = 0)::INT + (id % 2 = 0)::INT) / sum(2), 4) AS grounding FROM t GROUP BY 1")
def d7(spark, d):
    t = timeline(spark, d)
    return diagnostics.grounding(t.withColumns({"title_source": F.when(F.col("id") % 3 == 0, "b"), "org_source": F.when(F.col("id") % 2 == 0, "b")}))


@query("d8_dated_share", f"WITH {T} SELECT doc_id, round(avg((id % 5 <> 0)::INT), 4) AS dated FROM t GROUP BY 1")
def d8(spark, d):
    return diagnostics.dated_share(timeline(spark, d).withColumn("e", F.when(F.col("id") % 5 != 0, F.col("e"))))


@query("d10_score_components", f"WITH {ROUTE} SELECT doc_id, c AS component, round(v, 3) AS points FROM (SELECT doc_id, unnest(['event', 'grounding', 'dated', 'agreement', 'readability']) AS c, unnest([35 * event, 20 * grounding, 15 * dated, 5, 25 * readability]) AS v FROM r)")
def d10(spark, d):
    k = F.col("c_custkey")
    r = table(spark, d, "customer").select(k.alias("doc_id"), ((k % 101) / 100).alias("event"), ((k % 37) / 36).alias("grounding"), ((k % 29) / 28).alias("dated"), ((k % 3) / 2).alias("readability"))
    return diagnostics.components(r)


@query("d12_metrics_of_nothing", "SELECT o_orderpriority AS category, round(coalesce(tp / nullif(tp + fp, 0), 1), 3) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 1), 3) AS recall FROM (SELECT o_orderpriority, count(*) FILTER (o_orderkey % 7 = 0 AND o_orderpriority < '3') AS tp, count(*) FILTER (o_orderkey % 7 = 1 AND o_orderpriority < '3') AS fp, count(*) FILTER (o_orderkey % 7 = 2 AND o_orderpriority < '2') AS fn FROM orders GROUP BY 1)")
def d12(spark, d):
    k, p = F.col("o_orderkey") % 7, F.col("o_orderpriority")
    c = table(spark, d, "orders").groupBy(p.alias("category")).agg(F.count_if((k == 0) & (p < "3")).alias("tp"), F.count_if((k == 1) & (p < "3")).alias("fp"), F.count_if((k == 2) & (p < "2")).alias("fn"))
    return evaluation.metrics(c, places=3, empty=1.0).select("category", "precision", "recall")


@query("d14_phrase_occurrence", "WITH p AS (SELECT doc_id, unnest(['the', 'zzzz', 'of']) AS phrase, text FROM documents) SELECT doc_id, count(*)::BIGINT AS checked, count(*) FILTER (contains(lower(text), phrase))::BIGINT AS found, NULL::VARCHAR AS issue, round(100 * count(*) FILTER (contains(lower(text), phrase)) / count(*), 2) AS pct FROM p GROUP BY 1")
def d14(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return diagnostics.phrase_occurrence(docs.select("doc_id", F.explode(F.array(F.lit("the"), F.lit("zzzz"), F.lit("OF"))).alias("phrase")), docs)


@query("d32_positional_match", "WITH a AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS i, l_returnflag AS v FROM lineitem), b AS (SELECT o_orderkey AS k, 1 AS i, 'A' AS v FROM orders UNION ALL SELECT o_orderkey, 2, 'R' FROM orders) SELECT b.k, count(*) AS positions, count(*) FILTER (a.v = b.v) AS hits FROM b LEFT JOIN a ON a.k = b.k AND a.i = b.i GROUP BY 1")
def d32(spark, d):
    l = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("ord"), F.col("l_returnflag").alias("v"))
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.posexplode(F.array(F.lit("A"), F.lit("R"))).alias("ord", "v"))
    return diagnostics.positional_match(l, o, ["k"], "v")


@query("e14_section_span", f"WITH {LINES}, f AS (SELECT *, min(CASE WHEN len(line) % 4 = 0 THEN ord END) OVER (PARTITION BY doc_id) AS a FROM ln), g AS (SELECT *, coalesce(max((len(line) % 7 = 0 AND ord > a)::INT) OVER (PARTITION BY doc_id ORDER BY ord ROWS UNBOUNDED PRECEDING), 0) AS z FROM f) SELECT doc_id, ord FROM g WHERE ord > a AND z = 0")
def e14(spark, d):
    n = F.length("line")
    return diagnostics.section_span(lines(spark, d), ["doc_id"], n % 4 == 0, n % 7 == 0).select("doc_id", "ord")


@query("c10_fuzzy_names", "WITH r AS (SELECT lower(p_name) AS k, max(p_partkey) AS right_id FROM part WHERE p_partkey % 2 = 0 GROUP BY 1) SELECT p_partkey AS left_id, right_id FROM part JOIN r ON lower(p_name) = k WHERE p_partkey % 2 = 1")
def c10(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_name")
    return diagnostics.by_fuzzy_name(p.where("id % 2 = 1"), p.where("id % 2 = 0"), F.trim(F.lower("p_name")), "id")


@query("g7_distinct_rows", "SELECT DISTINCT l_orderkey, l_returnflag, l_linestatus FROM lineitem")
def g7(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus").dropDuplicates()


@query("g6_ordered_distinct", "SELECT doc_id, array_to_string(list_distinct(list_transform(range(1, 6), lambda i: (doc_id * i) % 3)).list_sort(), ',') AS v, (doc_id % 3) AS first FROM documents")
def g6(spark, d):
    v = F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(5)), lambda i: (F.col("doc_id") * i) % 3))
    return table(spark, d, "documents").select("doc_id", F.array_join(F.array_sort(v), ",").alias("v"), v[0].alias("first"))


@query("h57_section_order", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'b,a,c' ELSE 'a,c,b' END AS sections, CASE WHEN p_size % 2 = 0 THEN p_size + 1 ELSE 1 END AS next FROM part")
def h57(spark, d):
    even = F.col("p_size") % 2 == 0
    meta = F.create_map(F.lit("a"), F.when(even, 2).otherwise(1), F.lit("b"), F.when(even, 1).otherwise(3), F.lit("c"), F.when(even, 3).otherwise(2))
    return table(spark, d, "part").select("p_partkey", F.array_join(diagnostics.section_order(meta), ",").alias("sections"), diagnostics.next_id(F.when(even, F.array("p_size", F.lit(1))).otherwise(F.array().cast("array<int>"))).alias("next"))


@query("h53_set_scores", "WITH h AS (SELECT o_custkey AS k, list_distinct(list(o_orderpriority)) AS have FROM orders GROUP BY 1) SELECT k, round(len(list_intersect(have, ['1-URGENT', '2-HIGH', 'x'])) / len(have), 4) AS precision, round(len(list_intersect(have, ['1-URGENT', '2-HIGH', 'x'])) / 3, 4) AS recall FROM h")
def h53s(spark, d):
    h = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.collect_set("o_orderpriority").alias("have"))
    p, r = diagnostics.set_scores(F.col("have"), F.array(F.lit("1-URGENT"), F.lit("2-HIGH"), F.lit("x")))
    return h.select("k", p.alias("precision"), r.alias("recall"))
