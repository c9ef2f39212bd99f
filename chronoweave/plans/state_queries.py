"""Sessions, logs folded on read, and replacement by key."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import intervals, state
from ..sources import store
from ._register import Register, table

query = Register()
QUERIES, SQL = query.queries, query.sql


@query("i7_sessions", """WITH x AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 6 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
g AS (SELECT user_id, ts, sum(n) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM x) SELECT user_id, count(*) AS n, min(ts) AS first, max(ts) AS last FROM g GROUP BY user_id, g""")  # fmt: skip
def i7(spark, d):
    return intervals.sessions(table(spark, d, "events"), ["user_id"], "ts", "6 hours")


LOG = "lg AS (SELECT user_id AS doc_id, event_id AS seq, event_type, CASE WHEN event_type = 'click' THEN ['g' || (event_id % 5)] END AS dismissed, CASE WHEN event_type = 'view' THEN event_id % 2 = 0 END AS reviewed, CASE WHEN event_type = 'error' THEN event_id % 3 = 0 END AS hidden FROM events)"


def log(spark, d):
    t = F.col("event_type")
    return table(spark, d, "events").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("seq"), F.when(t == "click", F.array(F.concat(F.lit("g"), (F.col("event_id") % 5).cast("string")))).alias("dismissed"), F.when(t == "view", F.col("event_id") % 2 == 0).alias("reviewed"), F.when(t == "error", F.col("event_id") % 3 == 0).alias("hidden"))


@query("i3_feedback_fold", f"WITH {LOG} SELECT doc_id, coalesce(array_to_string(list_sort(list_distinct(flatten(list(dismissed) FILTER (dismissed IS NOT NULL)))), ','), '') AS dismissed, arg_max(reviewed, seq) FILTER (reviewed IS NOT NULL) AS reviewed, count(*) AS entries FROM lg GROUP BY 1")
def i3(spark, d):
    return state.fold_feedback(log(spark, d)).withColumn("dismissed", F.array_join("dismissed", ","))


@query("i2_latest_state", f"WITH {LOG} SELECT doc_id, arg_max(reviewed, seq) FILTER (reviewed IS NOT NULL) AS reviewed, arg_max(hidden, seq) FILTER (hidden IS NOT NULL) AS hidden FROM lg GROUP BY 1")
def i2(spark, d):
    return state.latest(log(spark, d), ["doc_id"], "seq", ["reviewed", "hidden"])


@query("e11_last_non_null", f"WITH {LOG} SELECT doc_id, seq, last_value(reviewed IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS section FROM lg")
def e11(spark, d):
    return intervals.section_of(log(spark, d), ["doc_id"], "seq", "reviewed").select("doc_id", "seq", "section")


@query("c16_carried_notes", "WITH h AS (SELECT doc_id, sha256(text) AS h FROM documents), n AS (SELECT h, max(doc_id) AS newest FROM h GROUP BY 1 HAVING count(*) > 1) SELECT n.newest AS doc_id, h.doc_id AS from_doc, 'n' || h.doc_id AS id FROM h JOIN n ON h.h = n.h WHERE h.doc_id <> n.newest AND h.doc_id % 2 = 0")
def c16(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("hash"), F.col("doc_id").alias("created"))
    notes = docs.where("doc_id % 2 = 0").select("doc_id", F.concat(F.lit("n"), F.col("doc_id").cast("string")).alias("id"), F.lit("seen").alias("text"))
    return state.carry_notes(docs, notes).drop("text")


@query("c19_known_targets", "SELECT o_custkey AS doc_id, o_orderkey AS item_id FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber = 3) OR o_orderkey % 10 = 0")
def c19(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("item_id"))
    l = table(spark, d, "lineitem").where("l_linenumber = 3").select(F.col("l_orderkey").alias("item_id"))
    events = o.join(l, "item_id", "left_semi").select("doc_id", F.col("item_id").alias("id"))
    return state.known_targets(o, events, o.where("item_id % 10 = 0").select("doc_id", F.col("item_id").alias("id")))


@query("a21_replace_by_key", "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_nationkey <> 3 UNION ALL SELECT c_custkey, upper(c_name), 0.0 FROM customer WHERE c_nationkey = 3")
def a21(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    new = table(spark, d, "customer").where("c_nationkey = 3").select("c_custkey", F.upper("c_name").alias("c_name"), F.lit(0.0).alias("c_acctbal"))
    return store.replace_by_key(c, new, ["c_custkey"])


@query("b20_request_errors", "SELECT doc_id, concat_ws(',', CASE WHEN doc_id % 3 = 0 THEN 'filename missing' END, CASE WHEN length(text) > 4000 THEN 'note too long' END, CASE WHEN text IS NULL THEN 'nothing to read' END) AS errors FROM documents")
def b20(spark, d):
    r = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, " ").otherwise("a.txt").alias("filename"), F.col("text").alias("note"), "text", F.lit(None).cast("binary").alias("content"))
    return state.request_errors(r).select("doc_id", F.array_join("errors", ",").alias("errors"))


@query("g3_timeline_and_unresolved", "SELECT o_orderkey AS id, o_orderdate AS at FROM orders WHERE o_orderstatus <> 'P' UNION ALL SELECT o_orderkey, NULL FROM orders WHERE o_orderstatus = 'P'")
def g3(spark, d):
    o = table(spark, d, "orders")
    return o.where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("at")).unionByName(o.where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("id")), allowMissingColumns=True)


@query("b17_dismissed_gaps", "WITH f AS (SELECT c_custkey AS doc_id, c_custkey % 3 AS k FROM customer WHERE c_custkey % 4 <> 0) SELECT o_orderkey AS id, CASE WHEN coalesce(k = o_orderkey % 3, false) THEN 'DISMISSED_GAP' ELSE 'POTENTIAL_GAP' END AS state FROM orders LEFT JOIN f ON o_custkey = doc_id")
def b17(spark, d):
    k = F.col("c_custkey")
    folded = table(spark, d, "customer").where("c_custkey % 4 <> 0").select(k.alias("doc_id"), F.array((k % 3).cast("string")).alias("dismissed"))
    gaps = table(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), (F.col("o_orderkey") % 3).cast("string").alias("id"), F.col("o_orderkey").alias("key"), F.lit("POTENTIAL_GAP").alias("state"))
    return state.dismiss(gaps, folded).select(F.col("key").alias("id"), "state")


@query("i4_append_notes", "SELECT o_custkey AS doc_id, o_orderkey::VARCHAR AS id, o_orderpriority AS text FROM orders")
def i4(spark, d):
    """Half of the notes are there, a third arrive again or for the first time, the rest come last."""
    n = table(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderpriority").alias("text"), F.col("o_orderkey").alias("k"))
    own = ["doc_id", "id", "text"]
    first = state.append_notes(n.where("k % 2 = 0").select(*own), n.where("k % 3 = 0").select(*own))
    return state.append_notes(first, n.select(*own))
