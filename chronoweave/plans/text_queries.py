"""Text predicates, normalisers and date parsers over documents, pages, parts and customers."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import months, text
from ..operators import evaluation, intervals
from ..sources import readers
from ._register import Register, table

query = Register()
QUERIES, SQL = query.queries, query.sql

LINES = "ln AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10)))))::INT AS ord, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL)"


def lines(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ord", "line"))


# Order dates, written in all forms that the parser knows, and in some that it doesn't
WRITTEN = """wr AS (SELECT o_orderkey AS id, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS dd, ['Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec'][month(o_orderdate)] AS n, o_orderkey % 14 AS f FROM orders),
w AS (SELECT id, y, m, CASE f WHEN 0 THEN n || ' ' || y WHEN 1 THEN n || ' ' || dd || ', ' || y WHEN 2 THEN dd || ' ' || n || ' ' || y WHEN 3 THEN n || chr(39) || printf('%02d', y % 100) WHEN 4 THEN y || '-' || printf('%02d', m) WHEN 5 THEN printf('%02d', m) || '/' || y WHEN 6 THEN y::VARCHAR WHEN 7 THEN printf('%02d', m + 12) || '/' || y
 WHEN 8 THEN n || '-' || y WHEN 9 THEN n || '/' || y WHEN 10 THEN n || y WHEN 11 THEN printf('%02d', m) || '-' || y WHEN 12 THEN y || '/' || printf('%02d', m) ELSE n || '.' || printf('%02d', y % 100) END AS t, f FROM wr)"""


def written(spark, d):
    o, at = table(spark, d, "orders"), F.col("o_orderdate")
    y, m, day = F.year(at), F.month(at), F.dayofmonth(at)
    n, f = F.date_format(at, "MMM"), F.col("o_orderkey") % 14
    fs = F.format_string
    t = F.when(f == 0, fs("%s %d", n, y)).when(f == 1, fs("%s %d, %d", n, day, y)).when(f == 2, fs("%d %s %d", day, n, y)).when(f == 3, fs("%s'%02d", n, y % 100)).when(f == 4, fs("%d-%02d", y, m)).when(f == 5, fs("%02d/%d", m, y)).when(f == 6, y.cast("string")).when(f == 7, fs("%02d/%d", m + 12, y))
    t = t.when(f == 8, fs("%s-%d", n, y)).when(f == 9, fs("%s/%d", n, y)).when(f == 10, fs("%s%d", n, y)).when(f == 11, fs("%02d-%d", m, y)).when(f == 12, fs("%d/%02d", y, m)).otherwise(fs("%s.%02d", n, y % 100))
    return o.select(F.col("o_orderkey").alias("id"), t.alias("t"))


@query("h30_parse_month_year", f"WITH {WRITTEN} SELECT id, CASE WHEN f NOT IN (6, 7) THEN (y * 12 + m)::INT END AS i FROM w")
def h30(spark, d):
    return written(spark, d).select("id", months.parse_month_year(F.col("t")).alias("i"))


@query("h36_endpoint", f"WITH {WRITTEN} SELECT id, (y * 12 + CASE WHEN f IN (6, 7) THEN 1 ELSE m END)::INT AS i, CASE WHEN f IN (6, 7) THEN 'year' ELSE 'month' END AS precision FROM w")
def h36(spark, d):
    return written(spark, d).select("id", months.endpoint(F.col("t"), F.lit(24321)).alias("p")).select("id", "p.i", "p.precision")


@query("h38_comparable_date", f"WITH {WRITTEN} SELECT id, CASE WHEN f IN (0, 4, 5, 8, 9, 10, 11, 12) THEN printf('%04d-%02d', y, m) WHEN f = 6 THEN y::VARCHAR ELSE 'invalid:' || lower(t) END AS c FROM w")
def h38(spark, d):
    return written(spark, d).select("id", months.comparable(F.col("t")).alias("c"))


@query("h42_date_variants_found", f"WITH {WRITTEN} SELECT id, f IN (0, 2, 3, 4, 5) AS found FROM w")
def h42(spark, d):
    w = written(spark, d).join(table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), months.of_date(F.col("o_orderdate")).alias("i")), "id")
    return w.select("id", text.source_variants_found(F.col("t"), months.variants(F.col("i"))).alias("found"))


@query("h43_stored_pairs", "SELECT o_orderkey AS id, (year(o_orderdate) * 12 + month(o_orderdate))::INT AS i FROM orders")
def h43(spark, d):
    at = F.col("o_orderdate")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), months.stored(F.format_string("(%d, %d)", F.year(at), F.month(at))).alias("i"))


@query("k0_find_mentions", f"""WITH {WRITTEN}, j AS (SELECT *, ['to', '-', '–', 'till'][(id // 14) % 4 + 1] AS sep FROM w)
SELECT id, f <> 7 AS is_range, (y * 12 + CASE WHEN f IN (6, 7) THEN 1 ELSE m END)::INT AS s, CASE WHEN f = 7 THEN y * 12 + 12 ELSE 24321 END::INT AS e, CASE WHEN f IN (6, 7) THEN 'year' ELSE 'month' END AS precision, f <> 7 AS is_present FROM j""")  # fmt: skip
def k0(spark, d):
    from ..functions.mentions import mentions

    sep = F.element_at(F.array(*(F.lit(x) for x in ("to", "-", "–", "till"))), (F.floor(F.col("id") / 14) % 4 + 1).cast("int"))
    w = written(spark, d).select("id", F.concat(F.lit("Worked from "), F.col("t"), F.lit(" "), sep, F.lit(" Present as lead")).alias("line"))
    return w.select("id", F.explode(mentions(24321)("line")).alias("m")).select("id", "m.is_range", "m.s", "m.e", "m.precision", "m.is_present")


@query("h31_closed_ranges", f"""WITH {WRITTEN}, j AS (SELECT *, (y * 12 + m)::INT AS a, ((y + 1) * 12 + 3)::INT AS z FROM w)
SELECT id, CASE WHEN f IN (6, 7) THEN y * 12 + 1 ELSE a END::INT AS s, CASE WHEN f = 7 THEN y * 12 + 12 WHEN f = 6 AND id % 3 = 0 THEN (y + 1) * 12 + 12 WHEN id % 3 = 0 THEN (y + 1) * 12 + 12 ELSE z END::INT AS e, CASE WHEN f IN (6, 7) OR id % 3 = 0 THEN 'year' ELSE 'month' END AS precision FROM j WHERE f <> 7
UNION ALL SELECT id, y * 12 + 1, y * 12 + 12, 'year' FROM j WHERE f = 7 UNION ALL SELECT id, CASE WHEN id % 3 = 0 THEN (y + 1) * 12 + 1 ELSE z END, CASE WHEN id % 3 = 0 THEN (y + 1) * 12 + 12 ELSE z END, CASE WHEN id % 3 = 0 THEN 'year' ELSE 'month' END FROM j WHERE f = 7""")  # fmt: skip
def h31(spark, d):
    """Ranges whose second side is a month or a bare year; where the first side is no month, two dates remain."""
    from ..functions.mentions import mentions

    w = written(spark, d).join(table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.year("o_orderdate") + 1).alias("next")), "id")
    side = F.when(F.col("id") % 3 == 0, F.col("next").cast("string")).otherwise(F.format_string("March %d", "next"))
    w = w.select("id", F.concat(F.col("t"), F.lit(" until "), side).alias("line"))
    return w.select("id", F.explode(mentions(24321)("line")).alias("m")).select("id", "m.s", "m.e", "m.precision")


@query("h25_years_count", "SELECT doc_id, len(regexp_extract_all(text, '\\b(?:19|20)[0-9]{2}\\b'))::INT AS n FROM documents")
def h25(spark, d):
    return table(spark, d, "documents").select("doc_id", text.years_count(F.col("text")).alias("n"))


@query("h7_clean_text", "SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(p_name || ', ' || p_brand), '[^a-z0-9\\s]+', ' ', 'g'), '\\s+', ' ', 'g')) AS t FROM part")
def h7(spark, d):
    return table(spark, d, "part").select("p_partkey", text.clean_text(F.concat_ws(", ", "p_name", "p_brand")).alias("t"))


@query("h14_url_normalise", "SELECT page_id, rtrim(regexp_replace(regexp_replace(lower(trim(url)), '^https?://', ''), '^www\\.', ''), '/') AS u FROM pages")
def h14(spark, d):
    return table(spark, d, "pages").select("page_id", text.url(F.col("url")).alias("u"))


@query("h9_file_key", "SELECT page_id, CASE WHEN url LIKE '%.html' OR url LIKE '%.htm' THEN 'x' ELSE 'y' END AS kind, trim(regexp_replace(regexp_replace(regexp_extract(lower(url), '([^/]*)$', 1), '(?:\\.[a-z0-9]{1,5}){1,2}$', ''), '[^a-z0-9]+', ' ', 'g')) AS k FROM pages")
def h9(spark, d):
    return table(spark, d, "pages").select("page_id", F.when(F.col("url").endswith(".html") | F.col("url").endswith(".htm"), "x").otherwise("y").alias("kind"), text.file_key(F.col("url")).alias("k"))


@query("h11_phone", "SELECT c_custkey, CASE WHEN (c_custkey % 10) >= 6 THEN (c_custkey % 10) || lpad(c_custkey::VARCHAR, 9, '0') END AS phone FROM customer")
def h11(spark, d):
    k = F.col("c_custkey")
    raw = F.concat(F.lit("+91 "), (k % 10).cast("string"), F.lit("-"), F.lpad(k.cast("string"), 9, "0"))
    return table(spark, d, "customer").select("c_custkey", text.phone(raw).alias("phone"))


@query("h12_emails", "SELECT doc_id, list_min(e) AS first, len(e)::INT AS n FROM (SELECT doc_id, list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}'), lambda x: lower(x))) AS e FROM documents)")
def h12(spark, d):
    e = table(spark, d, "documents").select("doc_id", text.emails(F.col("text")).alias("e"))
    return e.select("doc_id", F.array_min("e").alias("first"), F.size("e").alias("n"))


@query("h17_vocabulary_match", "SELECT p_partkey, regexp_matches(lower(p_name), '(^|[^a-z0-9+#])ring($|[^a-z0-9+#])') AS ring, regexp_matches(lower(p_name), '(^|[^a-z0-9+#])widget($|[^a-z0-9+#])') AS widget FROM part")
def h17(spark, d):
    v = text.vocabulary_hits(F.col("p_name"), ["ring", "widget", "c++"])
    return table(spark, d, "part").select("p_partkey", F.array_contains(v, "ring").alias("ring"), F.array_contains(v, "widget").alias("widget"))


STOPS = ", ".join(f"'{w}'" for w in text.STOP)
TOKENS = f"tk AS (SELECT doc_id, unnest(list_filter(regexp_extract_all(lower(text), '[a-z0-9+#./]+'), lambda x: len(x) > 1 AND x NOT IN ({STOPS}))) AS term FROM documents)"


def terms(spark, d):
    """Whole texts are exchanged, before they become many rows, so that what is counted by document needs no more. A
    given number of partitions isn't merged by the size of the texts, which is less than that of their terms."""
    docs = table(spark, d, "documents").select("doc_id", "text").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id")
    return docs.select("doc_id", F.explode(text.tokens(F.col("text"))).alias("term"))


@query("h18_tokens", f"WITH {TOKENS} SELECT doc_id, count(*) AS n, count(DISTINCT term) AS kinds FROM tk GROUP BY 1")
def h18(spark, d):
    return terms(spark, d).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("term").alias("kinds"))


@query("d27_term_vectors", f"WITH {TOKENS}, c AS (SELECT doc_id, term, count(*) AS c FROM tk GROUP BY ALL) SELECT doc_id, count(*) AS terms, round(sqrt(sum(c * c)), 6) AS norm FROM c GROUP BY 1")
def d27(spark, d):
    c = terms(spark, d).groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("c"))
    return c.groupBy("doc_id").agg(F.count(F.lit(1)).alias("terms"), F.round(F.sqrt(F.sum(F.col("c") * F.col("c"))), 6).alias("norm"))


BTOKENS = f"bt AS (SELECT item_id AS query_id, unnest(list_filter(regexp_extract_all(lower(text), '[a-z0-9+#./]+'), lambda x: len(x) > 1 AND x NOT IN ({STOPS}))) AS term FROM benchmark)"


@query("h53_term_cosine", f"""WITH {TOKENS}, {BTOKENS}, c AS (SELECT doc_id, term, count(*) AS c FROM tk GROUP BY ALL), q AS (SELECT query_id, term, count(*) AS k FROM bt GROUP BY ALL),
dn AS (SELECT doc_id, sqrt(sum(c * c)) AS n FROM c GROUP BY 1), qn AS (SELECT query_id, sqrt(sum(k * k)) AS n FROM q GROUP BY 1), x AS (SELECT doc_id, query_id, sum(c * k) AS dot FROM c JOIN q USING (term) GROUP BY ALL)
SELECT x.doc_id, x.query_id, round(dot / (dn.n * qn.n), 6) AS cosine FROM x JOIN dn ON dn.doc_id = x.doc_id JOIN qn ON qn.query_id = x.query_id""")  # fmt: skip
def h53(spark, d):
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(text.tokens(F.col("text"))).alias("term"))
    return evaluation.term_cosine(terms(spark, d), q)


@query("e1_neighbour_lines", f"WITH {LINES} SELECT doc_id, ord, coalesce(regexp_matches(lag(line) OVER w, '[0-9]'), false) AS before, coalesce(regexp_matches(lead(line) OVER w, '[0-9]'), false) AS after FROM ln WINDOW w AS (PARTITION BY doc_id ORDER BY ord)")
def e1(spark, d):
    w = Window.partitionBy("doc_id").orderBy("ord")
    return lines(spark, d).select("doc_id", "ord", F.coalesce(F.lag("line").over(w).rlike("[0-9]"), F.lit(False)).alias("before"), F.coalesce(F.lead("line").over(w).rlike("[0-9]"), F.lit(False)).alias("after"))


HEAD = "regexp_matches(trim(line), '^(?:[A-Z][a-z]*[:.]?(?:\\s+|$))+$') OR (trim(line) = upper(trim(line)) AND regexp_matches(trim(line), '[A-Z]'))"


@query("b18_headings", f"WITH {LINES} SELECT doc_id, ord, trim(line) AS heading FROM ln WHERE length(trim(line)) BETWEEN 3 AND 50 AND len(regexp_split_to_array(trim(line), '\\s+')) <= 6 AND NOT regexp_matches(line, '[0-9]') AND ({HEAD})")
def b18(spark, d):
    return lines(spark, d).where(text.is_heading(F.col("line"))).select("doc_id", "ord", F.trim("line").alias("heading"))


@query("f7_top_headings", f"WITH {LINES}, h AS (SELECT trim(line) AS heading FROM ln WHERE length(trim(line)) BETWEEN 3 AND 50 AND len(regexp_split_to_array(trim(line), '\\s+')) <= 6 AND NOT regexp_matches(line, '[0-9]') AND ({HEAD})) SELECT heading, count(*) AS n FROM h GROUP BY 1 ORDER BY n DESC, heading LIMIT 12")
def f7(spark, d):
    return evaluation.top_k(b18(spark, d), "heading", 12)


@query("c4_section_asof", f"WITH {LINES}, k AS (SELECT *, CASE WHEN len(line) % 5 = 0 THEN 'S' || (len(line) % 3) END AS kind FROM ln) SELECT doc_id, ord, last_value(kind IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ord ROWS UNBOUNDED PRECEDING) AS section FROM k")
def c4(spark, d):
    k = lines(spark, d).withColumn("kind", F.when(F.length("line") % 5 == 0, F.concat(F.lit("S"), (F.length("line") % 3).cast("string"))))
    return intervals.section_of(k, ["doc_id"], "ord", "kind").select("doc_id", "ord", "section")


@query("e4_section_bounds", f"WITH {LINES}, k AS (SELECT * FROM ln WHERE len(line) % 5 = 0) SELECT doc_id, ord AS starts, lead(ord) OVER (PARTITION BY doc_id ORDER BY ord) AS stops FROM k")
def e4(spark, d):
    k = lines(spark, d).where(F.length("line") % 5 == 0)
    return k.select("doc_id", F.col("ord").alias("starts"), F.lead("ord").over(Window.partitionBy("doc_id").orderBy("ord")).alias("stops"))


@query("b11_sentence_fragments", f"""WITH {LINES}, x AS (SELECT doc_id, ord, trim(line) AS t, regexp_split_to_array(trim(line), '\\s+') AS w FROM ln), y AS (SELECT *, list_filter(w, lambda z: regexp_matches(z, '\\p{{L}}')) AS l FROM x)
SELECT doc_id, ord, t <> '' AND (regexp_matches(t, '^[\\p{{Ll}},.;:-]') OR lower(w[1]) IN ('and', 'with', 'or', 'in', 'at', 'for') OR (len(w) > 12 AND len(l) > 0 AND len(list_filter(l, lambda z: regexp_matches(z, '^\\p{{Lu}}'))) / len(l) < 0.4)) AS fragment FROM y""")  # fmt: skip
def b11(spark, d):
    return lines(spark, d).select("doc_id", "ord", text.is_fragment(F.col("line")).alias("fragment"))


@query("b1_header_kinds", "SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'EXPERIENCE' WHEN 1 THEN 'EDUCATION' WHEN 2 THEN 'SKILLS' WHEN 3 THEN 'PROJECTS' WHEN 4 THEN 'EXPERIENCE' END AS kind FROM part")
def b1(spark, d):
    k = F.col("p_partkey") % 6
    line = F.when(k == 0, "## WORK EXPERIENCE:").when(k == 1, "1. Education").when(k == 2, "Core Skills -").when(k == 3, "PROJECTS").when(k == 4, "Chronological Experience").otherwise(F.concat(F.lit("about "), F.col("p_name")))
    return table(spark, d, "part").select("p_partkey", text.header_kind(line).alias("kind"))


@query("h3_clean_org", "SELECT s_suppkey, 'Acme ' || s_suppkey || ' Ltd' AS org FROM supplier")
def h3(spark, d):
    raw = F.concat(F.lit("• [Acme "), F.col("s_suppkey").cast("string"), F.lit(" Ltd] | Pune, "))
    return table(spark, d, "supplier").select("s_suppkey", text.clean_org(raw).alias("org"))


@query("h10_company_key", "SELECT s_suppkey, 'acme ' || s_suppkey AS k FROM supplier")
def h10(spark, d):
    raw = F.concat(F.lit("Acme "), F.col("s_suppkey").cast("string"), F.lit(" Technologies Pvt. Ltd."))
    return table(spark, d, "supplier").select("s_suppkey", text.company(raw).alias("k"))


@query("h54_document_ids", "SELECT doc_id, substring(sha256(text), 1, 32) AS id FROM documents")
def h54(spark, d):
    return table(spark, d, "documents").select("doc_id", F.substring(F.sha2("text", 256), 1, 32).alias("id"))


@query("h55_json_fields", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def h55(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("h24_outer_json", "SELECT event_id, props AS answer FROM events")
def h24(spark, d):
    fenced = F.concat(F.lit("Here:\n```json\n"), F.col("props"), F.lit("\n```"))
    return table(spark, d, "events").select("event_id", text.outer_json(fenced).alias("answer"))


@query("c18_unique_fragment", "SELECT doc_id, ((length(text) - length(replace(text, ' the ', ''))) / 5)::INT AS n FROM documents")
def c18(spark, d):
    return table(spark, d, "documents").select("doc_id", text.occurrences(F.col("text"), F.lit(" the ")).alias("n"))


@query("a28_visible_text", """WITH a AS (SELECT page_id, regexp_replace(html, '(?is)<script\\b[^>]*>.*?</script\\s*>|<style\\b[^>]*>.*?</style\\s*>|<noscript\\b[^>]*>.*?</noscript\\s*>|<template\\b[^>]*>.*?</template\\s*>|<head\\b[^>]*>.*?</head\\s*>', '', 'g') AS t FROM pages),
b AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(t, '(?s)<!--.*?-->', '', 'g'), '(?i)<(?:br|/p|/div|/li|/h[1-6]|/tr|/ul|/ol|/section|/article|/table)\\b[^>]*>', chr(10), 'g'), '(?s)<[^>]*>', '', 'g') AS t FROM a),
c AS (SELECT page_id, replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&') AS t FROM b)
SELECT page_id, trim(regexp_replace(regexp_replace(t, '[ \\t\\r\\f]+', ' ', 'g'), '\\s*\\n\\s*', chr(10), 'g')) AS t FROM c""")  # fmt: skip
def a28(spark, d):
    return table(spark, d, "pages").select("page_id", text.visible_text(F.col("html")).alias("t"))


@query("a12_ocr_lines", "SELECT l_orderkey AS page, string_agg(l_partkey::VARCHAR, ' ' ORDER BY l_linenumber, l_partkey, l_suppkey) AS line FROM lineitem WHERE l_linenumber > 1 GROUP BY 1")
def a12(spark, d):
    words = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("page"), F.when(F.col("l_linenumber") > 1, 5).otherwise(4).alias("level"), F.lit(1).alias("block_num"), F.lit(1).alias("par_num"), F.lit(1).alias("line_num"), (F.col("l_linenumber") * 1e9 + F.col("l_partkey") + F.col("l_suppkey") / 1e6).alias("left"), F.col("l_partkey").cast("string").alias("text"))
    return readers.ocr_lines(words, ["page"]).select("page", F.col("text").alias("line"))


# Lines of many kinds, from part names
BULLETS = "[" + text.BULLETS + "*\\-–]"
MIXED = """mx AS (SELECT p_partkey AS id, CASE p_partkey % 11 WHEN 0 THEN '• Developed ' || p_name WHEN 1 THEN 'Date of Birth: 1990-01-0' || p_partkey % 9 WHEN 2 THEN 'managed ' || p_name || ' and ' || p_brand WHEN 3 THEN '- ' || p_name WHEN 4 THEN 'JOHN SMITH Lead  ' || p_name
 WHEN 5 THEN 'Project ' || p_partkey || ': ' || p_name WHEN 6 THEN 'POC: ' || p_partkey WHEN 7 THEN 'see github.com/u' || p_partkey || ', https://www.linkedin.com/in/x-' || p_partkey || ' or github.com/u' || p_partkey WHEN 8 THEN 'well-' || chr(10) || 'known' || chr(10) || chr(10) || chr(10) || chr(10) || p_name
 WHEN 9 THEN 'Nationality  Indian, ' || p_name ELSE p_name || ', ' || p_brand END AS t FROM part)"""


def mixed(spark, d):
    k, n, b = F.col("p_partkey"), F.col("p_name"), F.col("p_brand")
    key, lit = k.cast("string"), F.lit
    t = F.when(k % 11 == 0, F.concat(lit("• Developed "), n)).when(k % 11 == 1, F.concat(lit("Date of Birth: 1990-01-0"), (k % 9).cast("string"))).when(k % 11 == 2, F.concat(lit("managed "), n, lit(" and "), b)).when(k % 11 == 3, F.concat(lit("- "), n)).when(k % 11 == 4, F.concat(lit("JOHN SMITH Lead  "), n))
    t = t.when(k % 11 == 5, F.concat(lit("Project "), key, lit(": "), n)).when(k % 11 == 6, F.concat(lit("POC: "), key)).when(k % 11 == 7, F.concat(lit("see github.com/u"), key, lit(", https://www.linkedin.com/in/x-"), key, lit(" or github.com/u"), key)).when(k % 11 == 8, F.concat(lit("well-\nknown\n\n\n\n"), n))
    t = t.when(k % 11 == 9, F.concat(lit("Nationality  Indian, "), n)).otherwise(F.concat_ws(", ", n, b))
    return table(spark, d, "part").select(k.alias("id"), t.alias("t"))


@query("b4_descriptions", f"WITH {MIXED} SELECT id, regexp_matches(trim(t), '(?i)^(?:{BULLETS}\\s*)?(?:{text.VERBS})\\b') AS hit FROM mx")
def b4(spark, d):
    return mixed(spark, d).select("id", text.is_description(F.col("t")).alias("hit"))


@query("b9_personal_lines", f"WITH {MIXED} SELECT id, regexp_matches(t, '(?i)(^|\\W)(date of birth|d\\.?o\\.?b|father''?s name|marital status|nationality|gender|passport)($|\\W)') AS hit FROM mx")
def b9(spark, d):
    return mixed(spark, d).select("id", text.is_personal(F.col("t")).alias("hit"))


@query("b10_bullets", f"WITH {MIXED} SELECT id, regexp_matches(trim(t), '^{BULLETS}\\s*\\S') OR regexp_matches(trim(t), '(?i)^(?:{text.VERBS})\\b') AS hit FROM mx")
def b10(spark, d):
    return mixed(spark, d).select("id", text.is_bullet(F.col("t")).alias("hit"))


@query("b19_profile_pages", "SELECT page_id, regexp_matches(lower(url), 'resume|curriculum|/cv(?:[/.?]|$)|profile') OR regexp_matches(lower(html), '\\b(?:curriculum vitae|work experience|resume)\\b') AS hit FROM pages")
def b19(spark, d):
    return table(spark, d, "pages").select("page_id", text.is_profile_page(F.col("url"), F.col("html")).alias("hit"))


@query("h1_normalise", f"WITH {MIXED} SELECT id, trim(regexp_replace(t, '[ \\t]+', ' ', 'g')) AS t FROM mx")
def h1(spark, d):
    return mixed(spark, d).select("id", text.normalise(F.col("t")).alias("t"))


@query("h2_leading_capitals", f"WITH {MIXED} SELECT id, regexp_replace(t, '^(?:[A-Z]{{2,}}\\s+){{2,}}([A-Z][a-z])', '\\1') AS t FROM mx")
def h2(spark, d):
    return mixed(spark, d).select("id", text.strip_leading_caps(F.col("t")).alias("t"))


@query("h6_project_prefix", f"WITH {MIXED} SELECT id, CASE WHEN id % 11 = 5 THEN substr(t, length('Project ' || id || ': ') + 1) ELSE t END AS t FROM mx")
def h6(spark, d):
    return mixed(spark, d).select("id", text.strip_project_prefix(F.col("t")).alias("t"))


@query("h8_dehyphenate", f"WITH {MIXED} SELECT id, regexp_replace(replace(t, 'well-' || chr(10), 'well'), '\\n{{3,}}', chr(10) || chr(10), 'g') AS t FROM mx")
def h8(spark, d):
    return mixed(spark, d).select("id", text.dehyphenate(F.col("t")).alias("t"))


@query("h13_links", f"WITH {MIXED} SELECT id, array_to_string(list_sort(list_distinct(regexp_extract_all(t, '(?i)(?:https?://)?(?:www\\.)?(?:linkedin\\.com/in|github\\.com)/[\\w-]+'))), ' ') AS links FROM mx")
def h13(spark, d):
    return mixed(spark, d).select("id", F.array_join(F.array_sort(text.links(F.col("t"))), " ").alias("links"))


@query("h34_expand_year", "SELECT p_partkey, CASE WHEN p_partkey % 100 <= 39 THEN 2000 ELSE 1900 END + (p_partkey % 100)::INT AS y FROM part")
def h34(spark, d):
    return table(spark, d, "part").select("p_partkey", months.expand_year(F.format_string("%02d", F.col("p_partkey") % 100)).alias("y"))


@query("h10_title_skills", """SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(p_name || ' (' || p_brand || ')'), '[^a-z0-9_\\s]+', ' ', 'g'), '\\s+', ' ', 'g')) AS title,
 CASE p_partkey % 4 WHEN 0 THEN 'kubernetes,python' WHEN 1 THEN 'node.js,postgres' WHEN 2 THEN 'amazon web services' ELSE 'python' END AS skills FROM part""")  # fmt: skip
def h10b(spark, d):
    k = F.col("p_partkey") % 4
    given = F.when(k == 0, F.array(F.lit("K8s"), F.lit("Python 3.11"), F.lit("python"))).when(k == 1, F.array(F.lit("NodeJS"), F.lit(""), F.lit(" PostgreSQL "))).when(k == 2, F.array(F.lit("AWS"), F.lit("aws"))).otherwise(F.array(F.lit("Python"), F.lit("python 2.7"), F.lit(None)))
    return table(spark, d, "part").select("p_partkey", text.clean_text(F.concat(F.col("p_name"), F.lit(" ("), F.col("p_brand"), F.lit(")"))).alias("title"), F.array_join(text.skills(given), ",").alias("skills"))
