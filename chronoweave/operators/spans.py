"""Spans inside a row: choosing disjoint ones, and carrying places through changes of a text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.lines import let
from ..functions.text import BULLETS

#: How a text is cut into runs, each of which normalise() changes as a whole or letter by letter.
_RUNS = r"\x00|[ \t]+|[^\x00 \t]+"


def disjoint(spans: Column) -> Column:
    """Of an array of structs (s, e, p), e exclusive, those that don't overlap an earlier one: by start, then the
    smaller p, then the longest. Sorted like that, a span is free if it begins where the last kept one has ended
    or later (an empty one also where that begins), so one pass decides."""
    order = lambda a, b: F.coalesce(F.nullif(a["s"] - b["s"], F.lit(0)), F.nullif(a["p"] - b["p"], F.lit(0)), b["e"] - a["e"]).cast("int")
    ordered = F.array_sort(spans, order)
    # the end of the last kept span, before each span; what is kept follows from it
    step = lambda end, x: F.when(x["s"] >= end, F.greatest(end, x["e"])).otherwise(end)
    none = F.array().cast("array<bigint>")
    ends = lambda o: F.aggregate(o, F.struct(F.lit(-(1 << 62)).cast("bigint").alias("end"), none.alias("all")), lambda a, x: F.struct(step(a["end"], x).cast("bigint").alias("end"), F.concat(a["all"], F.array(a["end"])).alias("all")), lambda a: a["all"])
    kept = lambda o: F.transform(F.filter(F.zip_with(o, ends(o), lambda x, end: F.struct(x.alias("span"), end.alias("end"))), lambda z: z["span"]["s"] >= z["end"]), lambda z: z["span"])
    return let(ordered, kept)


def normalised(text: Column) -> Column:
    """A text as functions.text.normalise() leaves it, with the map back: struct(text, map).

    The map is run-length coded: an array of structs (n, o), the lengths of a stretch in the new text and in the
    old one. A NUL becomes two letters, blanks become one, at the ends none; other runs keep their length."""
    marks = F.translate(text, BULLETS, BULLETS[0] * len(BULLETS))
    runs = F.regexp_extract_all(marks, F.lit(f"({_RUNS})"), F.lit(1))

    def piece(run: Column, last: Column, i: Column) -> Column:
        blank = run.startswith(" ") | run.startswith("\t")
        of = lambda t, n: F.struct(t.alias("t"), n.alias("n"), F.length(run).alias("o"))
        edge = F.when((i == 0) | (i == last), of(F.lit(""), F.lit(0))).otherwise(of(F.lit(" "), F.lit(1)))
        return F.when(blank, edge).when(run == "\x00", of(F.lit("ti"), F.lit(2))).otherwise(of(run, F.length(run)))

    pieces = lambda r: F.transform(r, lambda run, i: piece(run, F.size(r) - 1, i))
    whole = lambda p: F.struct(F.array_join(p["t"], "").alias("text"), F.transform(p, lambda x: F.struct(x["n"].alias("n"), x["o"].alias("o"))).alias("map"))
    return let(let(F.coalesce(runs, F.array().cast("array<string>")), pieces), whole)


def to_original(map_: Column, start: Column, end: Column) -> Column:
    """struct(start, end) in the old text for a stretch of the new one, end exclusive. Inside a run that keeps its
    length places are exact, inside others they are the run's ends. Only the first and the last run of a map may be
    empty in the new text, so as many runs as the stretch's end has letters, and two, hold all of it."""
    zero = F.from_json(F.lit('{"n":0,"o":0}'), "struct<n:int,o:int,start:int,end:int>")

    def step(a: Column, run: Column) -> Column:
        touched = (a["n"] + run["n"] > start) & (a["n"] < end)
        kept = run["n"] == run["o"]
        first = a["o"] + F.when(kept, F.greatest(start - a["n"], F.lit(0))).otherwise(0)
        last = a["o"] + F.when(kept, F.least(end - a["n"], run["n"])).otherwise(run["o"])
        return F.struct((a["n"] + run["n"]).alias("n"), (a["o"] + run["o"]).alias("o"), F.coalesce(a["start"], F.when(touched, first).cast("int")).alias("start"), F.when(touched, last.cast("int")).otherwise(a["end"]).alias("end"))

    return F.aggregate(F.slice(map_, 1, F.greatest(end, F.lit(0)) + 2), zero, step, lambda a: F.struct(a["start"].alias("start"), a["end"].alias("end")))


def located(text: Column, value: Column) -> Column:
    """struct(start, end) of the first place where text has the letters and digits of value in this order, whatever
    stands between them and in any case; null if there is none, or value has none."""
    fold = lambda t: F.regexp_replace(F.lower(t), r"[^\p{L}\p{N}]+", "")
    # a letter for each place of the text; lower-casing may not change the number of letters
    letters = F.filter(F.transform(F.split(text, ""), lambda c, i: F.struct(F.lower(c).alias("c"), i.alias("i"))), lambda x: x["c"].rlike(r"^[\p{L}\p{N}]") & (F.length(x["c"]) == 1))
    wanted = fold(value)
    at = lambda x: F.struct(x.alias("x"), F.instr(F.array_join(F.transform(x, lambda y: y["c"]), ""), wanted).alias("at"))
    found = lambda z: F.when((z["at"] > 0) & (wanted != ""), F.struct(F.element_at(z["x"], z["at"])["i"].alias("start"), (F.element_at(z["x"], z["at"] + F.length(wanted) - 1)["i"] + 1).alias("end")))
    return let(let(letters, at), found)


def in_parts(parts: Column, start: Column, end: Column) -> Column:
    """The pieces of the stretch [start, end) of a joined text in its parts: an array of structs (part, start, end).

    parts is an array of structs (part, from, to): the part's place in the joined text, end exclusive, ascending.
    start and end of a piece count from the part's own beginning."""
    touched = F.filter(parts, lambda p: (p["to"] > start) & (p["from"] < end))
    return F.transform(touched, lambda p: F.struct(p["part"].alias("part"), (F.greatest(p["from"], start) - p["from"]).alias("start"), (F.least(p["to"], end) - p["from"]).alias("end")))
