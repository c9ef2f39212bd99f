"""Exact substring deduplication by fixed-block anchors.

A passage of WINDOW words holds a whole aligned block of its document, one that begins at a multiple of BLOCK
words, wherever the passage begins. So the index has non-overlapping blocks only. It is a sketch of fixed size
over all documents; every rolling window of BLOCK words of every document probes it. A document's own aligned
blocks are in the index too: they count as hits if another block there is equal, or if a rolling window
elsewhere has hit them, which a second sketch, of those hits, tells.

Hits are extended to the windows of WINDOW words around them. Their 96-bit hashes meet in a shuffle, which
finds the smallest document in which each begins; windows with a smaller one merge into the maximal exact
repeats. No pairs of documents are formed: a passage in a third of all documents costs each of them its own
windows. Window keys so frequent that one task would get too many rows of them (HOT_KEYS at most, by counting)
are looked up by broadcast, all others by a merge join. A sketch can only add candidates, never lose one.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _sketch
from ._common import AS_IS, NOT_SPACE, Workspace, hash_words, mix64, release, scan_words, text_buffer
from .minhash import _pieces

WINDOW = 50
#: Any WINDOW words hold a whole aligned block of so many.
BLOCK = WINDOW // 2
#: Cells of the sketch for each document, up to 4 rows of 2^26 cells (32 MB of bits for each of three bitmaps).
CELLS_PER_DOC = 128
#: A window key with more than a share of 1 / HOT_KEYS of all candidates is hot; there are fewer than HOT_KEYS of them.
HOT_KEYS = 1000
#: A null doc_id sorts before all others.
_FIRST = -(1 << 63)
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)


class _Powers:
    """Powers of an odd base and of its inverse, as far as asked for."""

    def __init__(self, base: int):
        self.bases, self.tables = (base, pow(base, -1, 1 << 64)), (np.ones(1, np.uint64),) * 2

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.tables[0]) < n:
            size = 1 << n.bit_length()
            self.tables = tuple(np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size, b, np.uint64))]) for b in self.bases)
        return self.tables


_POWERS = [_Powers(b) for b in _BASES]


def _rolling(words: np.ndarray, length: int, which: int = 0) -> np.ndarray:
    """Hashes of all stretches of so many words."""
    n = len(words)
    if n < length:
        return np.zeros(0, np.uint64)
    power, inverse = _POWERS[which].upto(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(words * power[:n], out=total[1:])
    return mix64((total[length:] - total[:-length]) * inverse[: n - length + 1])


class _Words:
    """The words of a piece: their places in its bytes, hashes, and the rows that they belong to."""

    def __init__(self, column: pa.Array):
        self.data, bounds = text_buffer(column)
        self.starts, self.ends, self.rows = scan_words(self.data, bounds, NOT_SPACE)
        self.hashed = hash_words(self.data, self.starts, self.ends, values=AS_IS)
        self.n = np.diff(self.rows)
        self.row = np.repeat(np.arange(len(self.n)), self.n)
        self.pos = np.arange(len(self.row)) - self.rows[self.row]

    def inside(self, length: int) -> np.ndarray:
        """Which words begin a stretch of so many words of their own row."""
        return self.pos + length <= self.n[self.row]

    def joined(self, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the kept words with a space between, and the row bounds in them."""
        edge = np.zeros(len(self.data) + 1, np.int8)
        np.add.at(edge, self.starts[kept], 1)
        np.add.at(edge, self.ends[kept], -1)
        mask = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
        row = self.row[kept]
        gap = self.ends[kept][:-1][row[1:] == row[:-1]]  # the byte after a kept word that another one follows in its row
        data = self.data.copy()
        data[gap] = 0x20
        mask[gap] = True
        upto = np.concatenate([[0], np.cumsum(mask)])
        first = np.zeros(len(self.n) + 1, np.int64)
        first[1:] = np.cumsum(np.bincount(row, self.ends[kept] - self.starts[kept], len(self.n)) + np.maximum(np.bincount(row, minlength=len(self.n)) - 1, 0))
        assert first[-1] == upto[-1]
        return data[mask], first


def _blocks(width: int, block: int):
    """Index: cells of the aligned blocks."""

    def run(batches):
        release()
        touched = _sketch.Touched(2)
        for batch in _pieces(batches):
            w = _Words(batch.column("text"))
            keys = _rolling(w.hashed, block)
            at = np.flatnonzero(w.inside(block) & (w.pos % block == 0))
            yield from touched.add(_sketch.cells_of(keys[at], width))
        yield from touched.rest()

    return run


def _probes(once, width: int, block: int):
    """Cells of the rolling windows, not aligned ones, that hit the index."""

    def run(batches):
        release()
        touched = _sketch.Touched(1)
        for batch in _pieces(batches):
            w = _Words(batch.column("text"))
            keys = _rolling(w.hashed, block)
            at = np.flatnonzero(w.inside(block) & (w.pos % block != 0))
            hit = keys[at][_sketch.found(once.value, keys[at], width)]
            yield from touched.add(_sketch.cells_of(hit, width))
        yield from touched.rest()

    return run




def _candidates(once, twice, probed, width: int, window: int, block: int):
    """Adds the number of words, the windows around hits, and the kept_sha256 of texts without any."""

    def run(batches):
        release()
        for batch in _pieces(batches):
            w = _Words(batch.column("text"))
            keys = _rolling(w.hashed, block)
            rolls = np.flatnonzero(w.inside(block))
            aligned = w.pos[rolls] % block == 0
            own, other = rolls[aligned], rolls[~aligned]
            live = _sketch.found(twice.value, keys[own], width)
            live[~live] = _sketch.found(probed.value, keys[own[~live]], width)
            hits = np.concatenate([own[live], other[_sketch.found(once.value, keys[other], width)]])
            # a window is a candidate if a hit lies inside it: windows that begin up to window - block words before one
            near = np.zeros(len(w.hashed) + 1, np.int32)
            np.add.at(near, np.maximum(hits - (window - block), w.rows[w.row[hits]]), 1)
            np.add.at(near, hits + 1, -1)
            at = np.flatnonzero((np.cumsum(near[:-1]) > 0) & w.inside(window))
            k1, k2 = (_rolling(w.hashed if i == 0 else mix64(w.hashed + np.uint64(i)), window, i)[at] if len(at) else np.zeros(0, np.uint64) for i in (0, 1))
            count = np.bincount(w.row[at], minlength=len(w.n))
            bounds = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
            windows = pa.ListArray.from_arrays(pa.array(bounds), pa.StructArray.from_arrays([pa.array(w.pos[at].astype(np.int32)), pa.array(k1.view(np.int64)), pa.array((k2 >> np.uint64(32)).astype(np.uint32).view(np.int32))], names=["p", "k1", "k2"]))
            clean = count == 0
            data, first = w.joined(clean[w.row])
            sha = [hashlib.sha256(data[a:b]).hexdigest() if ok else None for ok, a, b in zip(clean.tolist(), first[:-1].tolist(), first[1:].tolist(), strict=True)]
            columns = [batch.column(c) for c in batch.schema.names]
            names = list(batch.schema.names)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(w.n.astype(np.int64)), windows, pa.array(sha, pa.string())], names=[*names, "n_words", "windows", "kept_sha256"])

    return run


def _cut(window: int):
    """Takes out the words of the windows that begin at the listed places."""

    def run(batches):
        release()
        for batch in _pieces(batches):
            w = _Words(batch.column("text"))
            lists = batch.column("gone")
            at = lists.flatten().to_numpy().astype(np.int64)
            count = np.diff(lists.offsets.to_numpy()) if len(lists) else np.zeros(0, np.int64)
            count = np.where(lists.is_valid().to_numpy(zero_copy_only=False), count, 0)
            begin = at + np.repeat(w.rows[:-1], count)
            edge = np.zeros(len(w.hashed) + 1, np.int32)
            np.add.at(edge, begin, 1)
            np.add.at(edge, begin + window, -1)
            kept = np.cumsum(edge[:-1]) == 0
            data, first = w.joined(kept)
            removed = np.bincount(w.row[~kept], minlength=len(w.n)).astype(np.int64)
            texts = [data[a:b].tobytes() for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
            sha = [hashlib.sha256(t).hexdigest() for t in texts]
            texts = pa.array([t.decode() if n else None for t, n in zip(texts, removed.tolist(), strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("rest"), batch.column("n_words"), pa.array(removed), pa.array(sha, pa.string()), texts if removed.any() else pa.nulls(len(w.n), pa.string())], names=["rest", "n_words", "n_removed", "kept_sha256", "cut"])

    return run


def _judged(docs: DataFrame, window: int, carried: list[str]) -> DataFrame:
    """(rest, n_words, n_removed, kept_sha256, cut): rest has the carried columns, cut the text where words went."""
    ws, sc, block = Workspace(docs.sparkSession, "substrings"), docs.sparkSession.sparkContext, window // 2
    rest = F.struct(*(F.col(f"`{c}`") for c in carried)).alias("rest")
    own = docs.select(rest, F.coalesce(F.col("doc_id").cast("long"), F.lit(_FIRST)).alias("id"), F.col("text").cast("string").alias("text"))
    texts = own.select("text")
    width = _sketch.width_for(docs.count(), CELLS_PER_DOC)
    once, twice = (sc.broadcast(b) for b in _sketch.merge(texts.mapInArrow(_blocks(width, block), _sketch.TOUCHED), width, [1, 2]))
    (probed,) = (sc.broadcast(b) for b in _sketch.merge(texts.mapInArrow(_probes(once, width, block), _sketch.TOUCHED), width, [1]))
    windows = T.ArrayType(T.StructType([T.StructField("p", T.IntegerType()), T.StructField("k1", T.LongType()), T.StructField("k2", T.IntegerType())]))
    schema = T.StructType([*own.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("windows", windows), T.StructField("kept_sha256", T.StringType())])
    found = own.mapInArrow(_candidates(once, twice, probed, width, window, block), schema)
    # a text without candidates is done; rows get numbers, fixed by being written
    found = found.withColumns({"row": F.monotonically_increasing_id(), "text": F.when(F.col("kept_sha256").isNull(), F.col("text"))})
    found = ws.stage(found, "candidates")
    for shared in (once, twice, probed):
        shared.destroy()

    some = found.where("kept_sha256 is null")
    rows = some.select("row", "id", F.explode("windows").alias("w")).select("row", "id", "w.*")
    repeats = rows.groupBy("k1", "k2").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count(F.lit(1)).alias("c")).where("first < last").drop("last")
    repeats = ws.stage(repeats, "repeats")
    total = repeats.agg(F.sum("c")).head()[0] or 0
    hot = repeats.where(F.col("c") * HOT_KEYS > total)
    cold = repeats.where(F.col("c") * HOT_KEYS <= total).select("k1", "k2", "first")
    # hot keys are answered by the first join, and then dealt by their rows instead of their keys
    marked = rows.join(F.broadcast(hot.select("k1", "k2", F.col("first").alias("known"))), ["k1", "k2"], "left")
    marked = marked.withColumn("k1", F.when(F.col("known").isNull(), F.col("k1")).otherwise(F.xxhash64("row", "p")))
    found_first = marked.join(cold.hint("merge"), ["k1", "k2"], "left")
    gone = found_first.where(F.coalesce("known", "first") < F.col("id")).select("row", "p")
    gone = ws.stage(gone.groupBy("row").agg(F.collect_list("p").alias("gone")), "gone")
    cut = some.select("row", "rest", "text", "n_words").join(gone.hint("merge"), "row", "left").drop("row")
    schema = T.StructType([T.StructField("rest", own.schema["rest"].dataType), *(T.StructField(n, t) for n, t in (("n_words", T.LongType()), ("n_removed", T.LongType()), ("kept_sha256", T.StringType()), ("cut", T.StringType())))])
    cut = cut.mapInArrow(_cut(window), schema)
    ws.only(found, gone)
    done = found.where("kept_sha256 is not null").select("rest", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256", F.lit(None).cast("string").alias("cut"))
    return done.union(cut)


def report(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by a space).

    Words are stretches without ASCII white space, as they are. A word goes if it lies in a window of `window`
    words that also begins in a document with a smaller doc_id; windows are those of the
    input, so it doesn't matter what else goes. A null or empty text has no words; a null doc_id counts as the
    smallest. Rows with equal doc_id remove nothing from each other, so repeated rows get equal results.
    Texts of any length are judged whole, and bound what a task holds. An empty table gives an empty result.
    """
    found = _judged(docs, window, ["doc_id"])
    return found.select(F.col("rest.doc_id").alias("doc_id"), "n_words", "n_removed", "kept_sha256")


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with the same columns; texts from which words went are the kept words joined by a space, all others
    stay as they are. n_chars, if there, is brought up to date. Rules and special cases as in report()."""
    found = _judged(docs, window, docs.columns).select(F.when(F.col("cut").isNull(), F.col("rest")).otherwise(F.col("rest").withField("text", F.col("cut"))).alias("rest"), F.col("cut").isNotNull().alias("changed"))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        found = found.withColumn("rest", F.when(F.col("changed"), F.col("rest").withField("n_chars", F.length("rest.text").cast(kind))).otherwise(F.col("rest")))
    return found.select("rest.*")
