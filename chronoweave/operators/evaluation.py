"""Predictions against labels: matching, precision and recall, rollups, calibration, tiers, duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def ratio(a: Column, b: Column, places: int | None = None, empty: float | None = None) -> Column:
    r = F.try_divide(a.cast("double"), b.cast("double"))
    r = F.round(r, places) if places is not None else r
    return r if empty is None else F.coalesce(r, F.lit(empty))


def metrics(counts: DataFrame, places: int = 4, empty: float | None = None) -> DataFrame:
    """tp, fp, fn to precision, recall and f1; undefined ones are null, or `empty`."""
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    f = F.try_divide(2 * F.coalesce(p, F.lit(0.0)) * F.coalesce(r, F.lit(0.0)), F.coalesce(p, F.lit(0.0)) + F.coalesce(r, F.lit(0.0)))
    f = F.when(p.isNull() & r.isNull(), None).otherwise(F.coalesce(f, F.lit(0.0)))
    done = lambda c: F.coalesce(F.round(c, places), F.lit(empty)) if empty is not None else F.round(c, places)
    return counts.withColumns({"precision": done(p), "recall": done(r), "f1": done(f)})


def pair(predictions: DataFrame, references: DataFrame, key: str) -> DataFrame:
    """Full outer pairing with the side on which a key is missing."""
    p = predictions.select(F.col(key).alias("pk"))
    r = references.select(F.col(key).alias("rk"))
    side = F.when(F.col("rk").isNull(), "no_reference").when(F.col("pk").isNull(), "no_prediction").otherwise("both")
    return p.join(r, F.col("pk") == F.col("rk"), "full_outer").select(F.coalesce("pk", "rk").alias("key"), side.alias("side"))


def greedy_match(edges: DataFrame, group: list[str]) -> DataFrame:
    """One-to-one matching inside each group: edges (i, j, score) by falling score, then i, then j.

    A group is one document's items of one kind, whose number is bounded by the document; its edges are folded
    in the order of their scores, each of which stays if both of its ends are free.
    """
    names = [f for f in edges.columns if f in (*group, "i", "j", "score")]
    rows = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("o"), "i", "j", "score")))
    grouped = edges.groupBy(*group).agg(rows.alias("edges"))
    free = lambda kept, x: ~F.exists(kept, lambda y: (y["i"] == x["i"]) | (y["j"] == x["j"]))
    none = F.filter("edges", lambda x: F.lit(False))
    kept = F.aggregate("edges", none, lambda a, x: F.when(free(a, x), F.concat(a, F.array(x))).otherwise(a))
    return grouped.select(*group, F.explode(kept).alias("x")).select(*(f if f in group else F.col(f"x.{f}").alias(f) for f in names))


def multiset_counts(predicted: DataFrame, truth: DataFrame, group: list[str], value: str) -> DataFrame:
    """tp, fp and fn of equal values, each used once."""
    p = predicted.groupBy(*group, value).agg(F.count(F.lit(1)).alias("p"))
    t = truth.groupBy(*group, value).agg(F.count(F.lit(1)).alias("t"))
    both = p.join(t, [*group, value], "full_outer").na.fill(0, ["p", "t"])
    return both.groupBy(*group).agg(F.sum(F.least("p", "t")).alias("tp"), F.sum(F.col("p") - F.least("p", "t")).alias("fp"), F.sum(F.col("t") - F.least("p", "t")).alias("fn"))


def field_match(found: list[Column], given: list[Column]) -> Column:
    """MATCH if all given fields are found, PARTIAL if half of them (one at least), else MISSING."""
    n = sum((g.cast("int") for g in given), F.lit(0))
    k = sum(((f & g).cast("int") for f, g in zip(found, given, strict=True)), F.lit(0))
    return F.when((n > 0) & (k == n), "MATCH").when((n > 0) & (k >= F.greatest(F.lit(1), F.floor(n / 2))), "PARTIAL").otherwise("MISSING")


def _year(date: Column) -> Column:
    return F.when(F.coalesce(date, F.lit("")).rlike("^[0-9]{4}"), F.left(date, F.lit(4)))


def _given(value: Column) -> Column:
    return F.coalesce(value, F.lit("")) != ""


def _held(value: Column, text_: Column) -> Column:
    return _given(value) & text_.contains(value)


def work_match(company: Column, title: Column, start: Column, end: Column, source: Column) -> Column:
    """How far a source, in lower case, bears out a job: its normalised names, and the years of its dates."""
    dates = [(F.coalesce(text_.contains(_year(d)), F.lit(False)) & (d != "present")) for text_, d in ((source, start), (source, end))]
    return field_match([_held(company, source), _held(title, source), *dates], [_given(c) for c in (company, title, start, end)])


def education_match(institution: Column, degree: Column, start: Column, end: Column, source: Column) -> Column:
    """The same for a study, whose dates count as one field: the year of either."""
    year = F.coalesce(source.contains(_year(start)), F.lit(False)) | F.coalesce(source.contains(_year(end)), F.lit(False))
    return field_match([_held(institution, source), _held(degree, source), year], [_given(institution), _given(degree), _given(start) | _given(end)])


def project_match(name: Column, client: Column, source: Column) -> Column:
    """The same for a project: any of the first three longer words of its name, and of its client's; one is enough for
    a part."""
    long = lambda c: F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda w: F.length(w) > 3)
    found = [F.exists(F.slice(long(c), 1, 3), lambda w: source.contains(w)) for c in (name, client)]
    given = [F.size(long(c)) > 0 for c in (name, client)]
    n, k = (sum((x.cast("int") for x in xs), F.lit(0)) for xs in (given, found))
    return F.when((n > 0) & (k == n), "MATCH").when(k >= 1, "PARTIAL").otherwise("MISSING")


def field_score(work: Column, projects: Column, education: Column, gaps: Column) -> Column:
    """Weighted share of fields, weights 4, 2, 3 and 1."""
    return F.round((4 * work + 2 * projects + 3 * education + gaps) / 10, 4)


def rollup(rows: DataFrame, by: str, value: str) -> DataFrame:
    """Count and mean by field and over all (field null)."""
    return rows.rollup(by).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(value), 4).alias("mean"))


def tiers(rows: DataFrame, score: str) -> DataFrame:
    """HIGH from .85, MEDIUM from .60, else LOW, with percentages to one place."""
    tier = F.when(F.col(score) >= 0.85, "HIGH").when(F.col(score) >= 0.60, "MEDIUM").otherwise("LOW")
    counts = rows.groupBy(tier.alias("tier")).agg(F.count(F.lit(1)).alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1)))  # three rows
    return counts.select("tier", "n", F.round(100 * share, 1).alias("pct"))


def duplicates(docs: DataFrame, text: Column) -> DataFrame:
    """Groups of equal content: hash, members, first id."""
    return docs.groupBy(F.sha2(text, 256).alias("hash")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


def calibration(rows: DataFrame, by: list[str], predicted: str, right: str) -> DataFrame:
    """Absolute difference of mean prediction and share that is right."""
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.round(F.abs(F.avg(predicted) - F.avg(F.col(right).cast("double"))), 4).alias("error"))


def top_k(rows: DataFrame, column: str, k: int) -> DataFrame:
    """The k commonest values, ties by value."""
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column).limit(k)


def composite(parts: dict[str, float]) -> Column:
    """Weighted sum of columns; a diagnostic, not an accuracy."""
    return F.round(sum((F.col(c) * w for c, w in parts.items()), F.lit(0.0)), 4)


def unique_or_fail(rows: DataFrame, key: list[str]) -> DataFrame:
    """rows, or an error as soon as a key occurs twice."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*key))
    return rows.withColumn("__n", n).where(F.when(F.col("__n") > 1, F.raise_error(F.concat(F.lit("duplicate identity: "), F.to_json(F.struct(*key)))).cast("boolean")).otherwise(F.lit(True))).drop("__n")


def term_cosine(terms: DataFrame, queries: DataFrame) -> DataFrame:
    """Cosine of term counts of each document and each query that share a term: (doc_id, query_id, cosine).

    Terms that are dealt out by doc_id stay where they are, as long as the queries' terms can be broadcast."""
    d = terms.where("doc_id is not null").groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("c"))
    d = d.withColumn("dn", F.sqrt(F.sum(F.col("c") * F.col("c")).over(Window.partitionBy("doc_id"))))
    q = queries.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("k"))
    qn = q.groupBy("query_id").agg(F.sqrt(F.sum(F.col("k") * F.col("k"))).alias("qn"))
    dot = d.join(q, "term").groupBy("doc_id", "dn", "query_id").agg(F.sum(F.col("c") * F.col("k")).alias("dot"))
    return dot.join(qn, "query_id").select("doc_id", "query_id", F.round(F.col("dot") / (F.col("dn") * F.col("qn")), 6).alias("cosine"))


def skill_fit(have: Column, want: Column) -> tuple[Column, Column, Column]:
    """Shared skills, missing skills, and the share of wanted ones."""
    shared = F.array_sort(F.array_intersect(have, want))
    return shared, F.array_sort(F.array_except(want, have)), F.try_divide(F.size(shared).cast("double"), F.size(want).cast("double"))


def fit_verdict(skill: Column, text: Column) -> tuple[Column, Column]:
    score = F.round(100 * (0.7 * F.coalesce(skill, F.lit(0.0)) + 0.3 * F.coalesce(text, F.lit(0.0))))
    return score.cast("int"), F.when(score >= 60, "strong").when(score >= 35, "possible").otherwise("weak")
