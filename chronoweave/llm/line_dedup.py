"""Repeated runs of lines, found by a distributed suffix array over line ids; DataFrame operations only.

Each distinct repeated line gets an id. Prefix doubling then gives every position, level by level, the
place of its next 2^k lines in sorted order: pairs of neighbouring ranks are counted, pairs that occur
once are dropped (their suffixes share no more with any other), and the rest are sorted by range over the
whole cluster and numbered in that order. Suffixes of equal rank at level k are an interval of the suffix
array with a longest common prefix of at least 2^k lines; two overlapping ranks give the interval for any
length in between.

A run counts if it has at least min_words words. For each position, the shortest such run that starts
there and the shortest that ends there are looked up; the maximal repeated runs are exactly the unions of
these, because every line of a long enough run lies in one of them. All copies of a run but the first, in
order of doc_id and line, are deleted, so the first copy of every line in the corpus always stays.
Ranks are refined only as deep as the longest such shortest run: deeper levels can't change a deletion.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import Workspace

MIN_WORDS = 50
_KEY = ["__d", "__t"]
#: A null doc_id sorts before all others.
_FIRST = -(1 << 63)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"__d": F.coalesce(F.col("doc_id").cast("long"), F.lit(_FIRST)), "__t": F.xxhash64("text")})


def _named(ws: Workspace, keys: DataFrame, by: list[str]) -> DataFrame:
    """keys with r, their place in sorted order: ascending, not dense."""
    ordered = keys.repartitionByRange(*by).sortWithinPartitions(*by)
    return ws.stage(ordered.withColumn("r", F.monotonically_increasing_id()), "names")


def repeated_lines(ws: Workspace, docs: DataFrame) -> DataFrame:
    """(__d, __t, pos, r, w): positions of lines that occur more than once, ids in r, words in w."""
    lines = _keyed(docs.select("doc_id", F.col("text").cast("string").alias("text"))).select(*_KEY, F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    words = F.expr("regexp_count(line, '[^ \\\\t\\\\r\\\\f]+')")
    lines = ws.stage(lines.select(*_KEY, "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("second"), "line").alias("h2"), words.alias("w")), "lines")
    ids = _named(ws, lines.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("h1", "h2"), ["h1", "h2"])
    out = ws.stage(lines.join(ids, ["h1", "h2"]).select(*_KEY, "pos", "r", "w").dropDuplicates([*_KEY, "pos"]), "positions")
    ws.drop(lines)
    return out


def doubled(ws: Workspace, level: DataFrame, step: int) -> DataFrame:
    """Ranks by twice as many lines (2 * step); positions whose stretch occurs once are gone."""
    ahead = level.select(*_KEY, (F.col("pos") - step).alias("pos"), F.col("r").alias("r2"))
    pairs = ws.stage(level.select(*_KEY, "pos", F.col("r").alias("r1")).join(ahead, [*_KEY, "pos"]), "pairs")
    names = _named(ws, pairs.groupBy("r1", "r2").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("r1", "r2"), ["r1", "r2"])
    return ws.stage(pairs.join(names, ["r1", "r2"]).select(*_KEY, "pos", "r"), "level")


def shortest_runs(positions: DataFrame, min_words: int) -> DataFrame:
    """(__d, __t, s, e): for each position the shortest runs of min_words words that start or end there.

    Sums run over stretches of neighbouring repeated lines, which are parts of one document.
    """
    by_pos = Window.partitionBy(*_KEY).orderBy("pos")
    p = positions.withColumn("part", F.col("pos") - F.row_number().over(by_pos))
    part = Window.partitionBy(*_KEY, "part")
    p = p.withColumns({"upto": F.sum("w").over(part.orderBy("pos")), "total": F.sum("w").over(part), "last": F.max("pos").over(part), "first": F.min("pos").over(part)})
    p = p.withColumn("rest", F.col("total") - F.col("upto") + F.col("w"))
    far = Window.unboundedPreceding
    p = p.withColumns({"before": F.max("pos").over(part.orderBy("upto").rangeBetween(far, -min_words)), "after": F.min("pos").over(part.orderBy("rest").rangeBetween(far, -min_words))})
    ending = p.where(F.col("upto") >= min_words).select(*_KEY, F.coalesce(F.col("before") + 1, F.col("first")).alias("s"), F.col("pos").alias("e"))
    starting = p.where(F.col("rest") >= min_words).select(*_KEY, F.col("pos").alias("s"), F.coalesce(F.col("after") - 1, F.col("last")).alias("e"))
    return ending.union(starting).distinct()


def later_copies(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(__d, __t, gone): sorted line numbers to delete, for the documents that have any."""
    ws = Workspace(docs.sparkSession, "lines")
    level = repeated_lines(ws, docs)
    runs = ws.stage(shortest_runs(level, min_words).withColumn("m", F.col("e") - F.col("s") + 1), "runs")
    longest = runs.agg(F.max("m")).head()[0] or 1
    found, size = [], 1
    for k in range(int(math.log2(longest)) + 1):
        if k:
            level = doubled(ws, level, size)
            size *= 2
        some = runs.where((F.col("m") >= size) & (F.col("m") < 2 * size))
        head = level.select(*_KEY, F.col("pos").alias("s"), F.col("r").alias("ra"))
        some = some.join(head, [*_KEY, "s"])
        if k:
            tail = level.select(*_KEY, (F.col("pos") + size - 1).alias("e"), F.col("r").alias("rb"))
            some = some.join(tail, [*_KEY, "e"])
        else:
            some = some.withColumn("rb", F.col("ra"))
        found.append(some.select(*_KEY, "s", "e", "m", "ra", "rb"))
    every = found[0]
    for more in found[1:]:
        every = every.union(more)
    every = ws.stage(every, "intervals")
    first = every.groupBy("m", "ra", "rb").agg(F.min(F.struct(*_KEY, "s")).alias("f"), F.count(F.lit(1)).alias("c")).where("c > 1").select("m", "ra", "rb", "f")
    copies = every.join(ws.stage(first, "first"), ["m", "ra", "rb"])
    copies = copies.where("__d > f.__d or (__d = f.__d and (__t > f.__t or (__t = f.__t and s > f.s)))")
    gone = copies.select(*_KEY, F.explode(F.sequence("s", "e")).alias("pos")).distinct()
    out = ws.stage(gone.groupBy(*_KEY).agg(F.sort_array(F.collect_list("pos")).alias("__gone")), "gone")
    ws.only(out)
    return out


def _applied(docs: DataFrame, min_words: int, carried: list[str]) -> DataFrame:
    """rest, a struct of the carried columns, with __lines and __kept, the lines and the numbers of those that stay."""
    gone = later_copies(docs, min_words)
    rest = F.struct(*(F.col(f"`{c}`") for c in carried)).alias("rest")
    own = docs.select(rest, "doc_id", F.col("text").cast("string").alias("text"))
    split = _keyed(own).withColumn("__lines", F.split("text", "\n")).drop("text", "doc_id")
    every = F.sequence(F.lit(0), F.size("__lines") - 1)
    # a merge join at every size: the plan, and what it needs, then grow with the input
    return split.join(gone.hint("merge"), _KEY, "left").withColumn("__kept", F.when(F.col("__gone").isNull(), every).otherwise(F.array_except(every, "__gone")))


def _text():
    return F.when(F.col("__gone").isNull(), F.array_join("__lines", "\n")).otherwise(F.array_join(F.transform("__kept", lambda i: F.get("__lines", i)), "\n"))


def report(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per row of docs: doc_id, n_lines, n_removed, text without later copies.

    Lines end at each newline only. A null text stays null, with 0 lines; an empty one has one line.
    A null doc_id counts as the smallest. Rows with equal doc_id and text are one document listed again
    and get the same result; rows that share a doc_id only are ordered by a hash of their texts.
    """
    d = _applied(docs, min_words, ["doc_id"])
    n = F.coalesce(F.size("__lines"), F.lit(0)).cast("long")
    return d.select(F.col("rest.doc_id").alias("doc_id"), F.greatest(n, F.lit(0)).alias("n_lines"), F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias("n_removed"), _text().alias("text"))


def remove_later_copies(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with the same columns, texts without later copies, and n_chars (if there) brought up to date.

    A document all of whose lines were later copies is dropped; all others stay, null and empty ones too.
    Other columns stay as they are, whatever their names. Texts of any length are split whole.
    """
    d = _applied(docs, min_words, [c for c in docs.columns if c != "text"]).where("__lines is null or size(__kept) > 0").withColumn("text", _text())
    out = {c: F.col("text") if c == "text" else F.col(f"rest.`{c}`") for c in docs.columns}
    if "n_chars" in out:
        out["n_chars"] = F.when(F.col("__gone").isNull(), out["n_chars"]).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType)
    return d.select(*(value.alias(c) for c, value in out.items()))
