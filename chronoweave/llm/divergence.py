"""Source divergence audit: how far the term frequencies of each source lie from those of the others in its language.

Document frequencies of all terms go into a merged count-min sketch first. It never underestimates, so a term
below the least number of documents there can't reach it and is discarded inside the tasks, before anything is
shuffled. The survivors are counted exactly, pre-aggregated in each task and again by the shuffle; the exact
document frequencies then decide.

The distance of two sources sums over all kept terms of the language, but is computed from those that occur:
every source's own terms against the other's probability of an unseen term (prefix sums over the sorted
values), a correction for each term that occurs in both, from a sparse join of the counts on the term, and the
terms that neither has as one product. Probabilities are integers in units of 1 / SCALE; nothing is rounded.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import _sketch
from ._common import Workspace, byte_table, hash_words, mix64, release, text_buffer
from ._common import broadcast_if_small as sized
from .minhash import _pieces

#: A language keeps the terms of so many documents; counts are smoothed by ALPHA; probabilities are in 1 / SCALE; ranks of terms go to TOP.
MIN_DOCS, ALPHA, SCALE, TOP = 30, 5, 1_000_000_000, 50
#: Cells of the sketch for each document, up to 4 rows of 2^26 cells (32 MB of bits).
CELLS_PER_DOC = 4
PIECE_BYTES = 2 << 20
#: Rows of counts that a task holds before it hands them on.
HELD_ROWS = 200_000
_LETTER = byte_table(bytes(range(0x41, 0x5B)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100)))
#: A-Z become a-z, what is no letter and below 0x80 becomes a space.
_MAP = np.where(_LETTER, np.arange(256), 0x20).astype(np.uint8)
_MAP[0x41:0x5B] += 32
_COUNTS = "lang string, source string, term string, n long, docs long"


def _terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Distinct (row, term) with the number of occurrences, and the terms themselves."""
    data, bounds = text_buffer(column)
    mapped = pa.LargeStringArray.from_buffers(len(bounds) - 1, pa.py_buffer(np.ascontiguousarray(bounds)), pa.py_buffer(_MAP[data]))
    lists = pc.split_pattern(mapped, " ")
    words = lists.flatten()
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(lists.offsets.to_numpy()))
    some = pc.greater(pc.binary_length(words), 0)
    coded = words.filter(some).dictionary_encode()
    row = row[some.to_numpy(zero_copy_only=False)]
    k = max(1, len(coded.dictionary))
    both, n = np.unique(row * k + coded.indices.to_numpy().astype(np.int64), return_counts=True)
    return both // k, both % k, n, coded.dictionary


def _keys(lang: pa.Array, terms: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of languages and of terms."""
    out = []
    for column in (lang, terms):
        data, bounds = text_buffer(column)
        out.append(hash_words(data, bounds[:-1], bounds[1:]) if len(bounds) > 1 else np.zeros(0, np.uint64))
    return mix64(out[0]), out[1]


def _document_frequencies(width: int, cap: int):
    def run(batches):
        release()
        touched = _sketch.Touched(cap)
        for batch in _pieces(batches, PIECE_BYTES):
            row, code, _, terms = _terms(batch.column("text"))
            lang = batch.column("lang").dictionary_encode()
            langs, hashed = _keys(lang.dictionary, terms)
            k = max(1, len(terms))
            both, docs = np.unique(lang.indices.to_numpy()[row] * k + code, return_counts=True)
            yield from touched.add(_sketch.cells_of(langs[both // k] ^ hashed[both % k], width), docs)
        yield from touched.rest()

    return run


def _counts(shared, width: int):
    def run(batches):
        release()
        held: list[pa.Table] = []
        size = 0
        add_up = lambda: pa.concat_tables(held).group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("docs", "sum")]).rename_columns(["lang", "source", "term", "n", "docs"])
        for batch in _pieces(batches, PIECE_BYTES):
            row, code, n, terms = _terms(batch.column("text"))
            lang, source = (batch.column(c).dictionary_encode() for c in ("lang", "source"))
            langs, hashed = _keys(lang.dictionary, terms)
            of_lang = lang.indices.to_numpy()[row].astype(np.int64)
            # one look into the sketch for each language and term of the piece
            k = max(1, len(terms))
            both, at = np.unique(of_lang * k + code, return_inverse=True)
            may = _sketch.found(shared.value, langs[both // k] ^ hashed[both % k], width)[at]
            group = of_lang[may] * max(1, len(source.dictionary)) + source.indices.to_numpy()[row[may]]
            both, at, docs = np.unique(group * k + code[may], return_inverse=True, return_counts=True)
            occurrences = np.bincount(at, n[may], len(both)).astype(np.int64)
            group, code = both // k, both % k
            g = max(1, len(source.dictionary))
            take = lambda values, i: values.take(pa.array(i)).cast(pa.large_string())
            held.append(pa.table([take(lang.dictionary, group // g), take(source.dictionary, group % g), take(terms, code), pa.array(occurrences), pa.array(docs.astype(np.int64))], names=["lang", "source", "term", "n", "docs"]))
            size += len(both)
            if size > 2 * HELD_ROWS:
                held = [add_up()]
                size = held[0].num_rows
                if size > HELD_ROWS:
                    yield from _strings(held[0])
                    held, size = [], 0
        if held:
            yield from _strings(add_up())

    return run


def _strings(table: pa.Table):
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
    for i in range(0, table.num_rows, 100_000):
        yield from table.slice(i, 100_000).cast(schema).combine_chunks().to_batches()


def _probability(count: str, total: str, kinds: str):
    """1 + floor(SCALE * (count + ALPHA) / (total + ALPHA * kinds)), exact; null where there are no terms."""
    return F.expr(f"1 + (cast({SCALE} as decimal(12,0)) * cast({count} + {ALPHA} as decimal(20,0))) div nullif(cast({total} as decimal(20,0)) + {ALPHA} * cast({kinds} as decimal(18,0)), 0)").cast("long")


def term_counts(ws: Workspace, docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, source, term, n, in_lang): occurrences of the terms in min_docs documents of the language (255 at most go into the sketch as they are)."""
    width, cap = _sketch.width_for(docs.count(), CELLS_PER_DOC), min(min_docs, 255)
    (bitmap,) = _sketch.merge(docs.select("lang", "text").mapInArrow(_document_frequencies(width, cap), _sketch.TOUCHED), width, [cap])
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)
    counts = docs.mapInArrow(_counts(shared, width), _COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    counts = ws.stage(counts, "counts")
    shared.destroy()
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("in_lang")).where(F.col("docs") >= min_docs)
    out = ws.stage(counts.drop("docs").join(kept.drop("docs"), ["lang", "term"]), "kept")
    ws.drop(counts)
    return out


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank), for every (lang, source) that occurs in docs.

    Part pair: item is each other source of the language, value the distance of the two over all terms that
    the language keeps, 0 if it keeps none. Part term: item is a kept term that the source has and that is more
    probable there than in the language, value by how much, the first `top` ones. Ranks start at 1 in each
    group and part, value descending, then item by its UTF-8 bytes.

    Null text, lang or source are ''. Empty texts count as documents of their group, which is listed even if it
    has no term at all; repeated rows count as often as they come, rows without doc_id too. Long texts are
    counted whole, in pieces of a few MB of whole texts. An empty table gives an empty result. Other columns
    are not read.
    """
    ws = Workspace(docs.sparkSession, "divergence")
    own = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    counts = term_counts(ws, own, min_docs)
    by_lang = counts.select("lang", "term", "in_lang").distinct().groupBy("lang").agg(F.sum("in_lang").alias("lang_total"), F.count(F.lit(1)).alias("kinds"))
    by_group = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("own"))
    groups = own.select("lang", "source").distinct().join(by_group, ["lang", "source"], "left").join(by_lang, "lang", "left").na.fill(0)
    groups = ws.stage(groups.withColumn("unseen", F.coalesce(_probability("0", "total", "kinds"), F.lit(0))), "groups")
    valued = counts.join(sized(groups), ["lang", "source"]).select("lang", "source", "term", _probability("n", "total", "kinds").alias("p"), _probability("in_lang", "lang_total", "kinds").alias("q"), "unseen")
    valued = ws.stage(valued, "valued")

    ordered = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = valued.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(ordered)).where(F.col("rank") <= top)

    # each source's own terms against the other's unseen probability x: sums of p below x and above it
    other = groups.select("lang", F.col("source").alias("item"), F.col("unseen").alias("x"), F.col("own").alias("other_own"))
    pairs = groups.join(other, "lang").where("source <> item").select("lang", "source", "item", "unseen", "x", "own", "other_own", "kinds")
    pairs = ws.stage(pairs, "pairs")
    some = valued.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("c"))
    points = some.select("lang", "source", F.col("p").alias("v"), "c", F.lit(None).cast("string").alias("item")).union(pairs.select("lang", "source", "x", F.lit(0).cast("long"), "item"))
    group = Window.partitionBy("lang", "source")
    upto = group.orderBy("v")
    below, low = F.sum("c").over(upto), F.sum(F.col("c") * F.col("v")).over(upto)
    every, whole = F.sum("c").over(group), F.sum(F.col("c") * F.col("v")).over(group)
    alone = F.col("v") * below - low + (whole - low) - F.col("v") * (every - below)
    alone = ws.stage(points.withColumn("alone", alone).where("item is not null").select("lang", "source", "item", "alone"), "alone")

    a = valued.select("lang", "term", "source", F.col("p").alias("pa"), F.col("unseen").alias("ua"))
    b = valued.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("pb"), F.col("unseen").alias("ub"))
    shift = F.abs(F.col("pa") - F.col("pb")) - F.abs(F.col("pa") - F.col("ub")) - F.abs(F.col("ua") - F.col("pb"))
    shared = a.join(b, ["lang", "term"]).where("source < item").groupBy("lang", "source", "item").agg(F.sum(shift).alias("shift"), F.count(F.lit(1)).alias("both"))
    once = ws.stage(shared, "shared")
    shared = once.union(once.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "shift", "both"))
    mirrored = alone.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), F.col("alone").alias("mirrored"))
    key = ["lang", "source", "item"]
    neither = F.col("kinds") - F.col("own") - F.col("other_own") + F.coalesce("both", F.lit(0))
    value = F.col("alone") + F.col("mirrored") + F.coalesce("shift", F.lit(0)) + neither * F.abs(F.col("unseen") - F.col("x"))
    distance = pairs.join(alone, key).join(mirrored, key).join(shared, key, "left").select("lang", "source", F.lit("pair").alias("part"), "item", value.alias("value"))
    distance = distance.withColumn("rank", F.row_number().over(ordered))
    ws.only(valued, groups, pairs, alone, once)
    return distance.union(terms).select("lang", "source", "part", "item", "value", "rank")
