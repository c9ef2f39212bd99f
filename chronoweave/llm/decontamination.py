"""Benchmark decontamination with suffix arrays over the training words.

Every task builds a suffix array over the words of its shard (a few MB of whole texts), binary-searches
all benchmark suffixes in it, and reads off occurrences and longest verbatim matches. The training text
is never shuffled. Benchmark items come to the tasks in blocks of bounded size; one more block is one
more pass over the shards, so a benchmark of any size is searched whole.

Words outside the block's vocabulary get id 0: no benchmark word equals them, so suffixes that begin
with one can match nothing and are left out of the array, and a comparison ends at one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import ITEM_WORD, hash_words, release, scan_words, text_buffer
from .minhash import _pieces

WINDOW = 10
#: Bytes of benchmark text in a block, which bounds what is broadcast at once.
BLOCK_BYTES = 8 << 20
SHARD_BYTES = 4 << 20


def suffix_array(words: np.ndarray) -> np.ndarray:
    """Positions of non-zero words, sorted by what follows, up to the next zero. Prefix doubling."""
    top = int(words.max()) if len(words) else 0
    bits = max(1, top.bit_length())
    packed = max(1, 63 // bits)
    key = np.zeros(len(words), np.uint64)
    for t in range(packed):
        key <<= np.uint64(bits)
        key[: max(len(words) - t, 0)] |= words[t:].astype(np.uint64)
    where = np.flatnonzero(words)
    order = np.argsort(key[where])
    sa = where[order]
    k = key[sa]
    if not len(sa):
        return sa
    fresh = np.empty(len(sa), bool)
    fresh[0] = True
    np.not_equal(k[1:], k[:-1], out=fresh[1:])
    # rank: the place in the array where a suffix's group begins, from 1
    group = np.flatnonzero(fresh)
    rank = np.zeros(len(words) + 1, np.int64)
    rank[sa] = np.repeat(group + 1, np.diff(np.append(group, len(sa))))
    ended = (k & np.uint64((1 << bits) - 1)) == 0  # a zero is among the words compared so far
    size = np.repeat(np.diff(np.append(group, len(sa))), np.diff(np.append(group, len(sa))))
    tied = np.flatnonzero((size > 1) & ~ended)
    h = packed
    while len(tied):
        own = sa[tied]
        following = rank[np.minimum(own + h, len(words))]
        first = rank[own]
        again = np.lexsort((following, first))
        own, first, following = own[again], first[again], following[again]
        sa[tied] = own
        new = np.empty(len(tied), bool)
        new[0] = True
        new[1:] = (first[1:] != first[:-1]) | (following[1:] != following[:-1])
        begins = np.flatnonzero(new)
        count = np.diff(np.append(begins, len(tied)))
        rank[own] = np.repeat(tied[begins] + 1, count)
        more = np.repeat(count, count) > 1
        tied = tied[more & (following > 0)]
        h *= 2
    return sa


class Block:
    """Benchmark items of a block: vocabulary, concatenated words, item bounds and distinct windows."""

    def __init__(self, ids: list[int], texts: list[str], window: int):
        column = pa.array(texts, pa.large_string())
        data, bounds = text_buffer(column)
        starts, ends, rows = scan_words(data, bounds, ITEM_WORD)
        hashed = hash_words(data, starts, ends)
        self.vocabulary, words = np.unique(hashed, return_inverse=True)
        self.words = words.astype(np.int32) + 1
        self.ids = np.array(ids, np.int64)
        at, width, item = [], [], []
        for i, (a, b) in enumerate(zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True)):
            n = b - a
            if n:
                w = min(window, n)
                at.append(np.arange(a, b - w + 1))
                width.append(np.full(n - w + 1, w))
                item.append(np.full(n - w + 1, i))
        join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        self.at, self.width, self.item = join(at), join(width), join(item)
        self.item_end = rows[1:][self.item] if len(self.item) else self.item
        self.slot = np.zeros(1 << 16, bool)
        self.slot[(self.vocabulary & np.uint64(0xFFFF)).astype(np.int64)] = True

    def spell(self, hashed: np.ndarray) -> np.ndarray:
        out = np.zeros(len(hashed), np.int32)
        if len(self.vocabulary):
            maybe = np.flatnonzero(self.slot[(hashed & np.uint64(0xFFFF)).astype(np.int64)])
            h = hashed[maybe]
            i = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
            hit = self.vocabulary[i] == h
            out[maybe[hit]] = i[hit] + 1
        return out

    def bound(self, text: np.ndarray, sa: np.ndarray, upper: bool) -> np.ndarray:
        """For each window, the first place in sa whose suffix isn't below it (upper: is above it)."""
        lo, hi = np.zeros(len(self.at), np.int64), np.full(len(self.at), len(sa), np.int64)
        deepest = int(self.width.max()) if len(self.width) else 0
        while True:
            live = np.flatnonzero(lo < hi)
            if not len(live):
                return lo
            mid = (lo[live] + hi[live]) >> 1
            p, q, left = sa[mid], self.at[live], self.width[live]
            go_right = np.full(len(live), upper)  # equal over the whole width
            open_ = np.arange(len(live))
            for d in range(deepest):
                open_ = open_[left[open_] > d]
                if not len(open_):
                    break
                x, y = text[np.minimum(p[open_] + d, len(text) - 1)], self.words[q[open_] + d]
                go_right[open_[x < y]] = True
                go_right[open_[x > y]] = False
                open_ = open_[x == y]
            lo[live[go_right]] = mid[go_right] + 1
            hi[live[~go_right]] = mid[~go_right]

    def search(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Window numbers, their places in text, and the length of the longest match from there."""
        sa = suffix_array(text)
        if not len(sa) or not len(self.at):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        lo, hi = self.bound(text, sa, False), self.bound(text, sa, True)
        count = hi - lo
        which = np.repeat(np.arange(len(self.at)), count)
        place = sa[np.repeat(lo - np.cumsum(count) + count, count) + np.arange(len(which))]
        length = self.width[which].copy()
        go = np.arange(len(which))
        while len(go):
            q = self.at[which[go]] + length[go]
            p = place[go] + length[go]
            ok = (q < self.item_end[which[go]]) & (p < len(text))
            go, q, p = go[ok], q[ok], p[ok]
            go = go[self.words[q] == text[p]]
            length[go] += 1
            if len(go) > 64:  # extend only where a match begins; those inside one are covered by it
                w = which[go]
                first = (w == 0) | (self.item[w - 1] != self.item[w]) | (place[go] == 0)
                first |= self.words[np.maximum(self.at[w] - 1, 0)] != text[np.maximum(place[go] - 1, 0)]
                go = go[first]
        return which, place, length


def blocks(benchmark: DataFrame, window: int) -> list:
    """Broadcast blocks of bounded size. Rows without an item_id are no items."""
    sc = benchmark.sparkSession.sparkContext
    out, ids, texts, size = [], [], [], 0
    for row in benchmark.where("item_id is not null").select(F.col("item_id").cast("long"), F.coalesce(F.col("text"), F.lit(""))).toLocalIterator():
        if size + len(row[1]) > BLOCK_BYTES and ids:
            out.append(sc.broadcast(Block(ids, texts, window)))
            ids, texts, size = [], [], 0
        ids.append(row[0])
        texts.append(row[1])
        size += len(row[1])
    return [*out, sc.broadcast(Block(ids, texts, window))]


def _shard(block: Block, column: pa.Array):
    """Words per row, and for each row the merged hit spans, the items found and the longest match."""
    data, bounds = text_buffer(column)
    starts, ends, rows = scan_words(data, bounds, ITEM_WORD)
    ids = block.spell(hash_words(data, starts, ends))
    # a zero after each row, so that no suffix reaches into the next one
    n = np.diff(rows)
    shift = np.repeat(np.arange(len(n)), n)
    text = np.zeros(len(ids) + len(n), np.int32)
    text[np.arange(len(ids)) + shift] = ids
    base = rows[:-1] + np.arange(len(n))
    which, place, length = block.search(text)
    row = np.searchsorted(base, place, "right") - 1
    start = place - base[row]
    end = start + block.width[which]
    spans, items, longest = [[] for _ in n], [[] for _ in n], np.zeros(len(n), np.int64)
    order = np.lexsort((start, row))
    for r, s, e in zip(row[order].tolist(), start[order].tolist(), end[order].tolist(), strict=True):
        own = spans[r]
        if own and s <= own[-1]["e"]:
            own[-1]["e"] = max(own[-1]["e"], e)
        else:
            own.append({"s": s, "e": e})
    found = np.unique(np.stack([row, block.ids[block.item[which]]]), axis=1) if len(which) else np.zeros((2, 0), np.int64)
    for r, i in found.T.tolist():
        items[r].append(i)
    np.maximum.at(longest, row, length)
    return n, spans, items, longest


_SPAN = T.StructType([T.StructField("s", T.IntegerType()), T.StructField("e", T.IntegerType())])
_FOUND = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text_hash", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(_SPAN)), T.StructField("items", T.ArrayType(T.LongType())), T.StructField("longest", T.LongType())])
_ARROW = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))), ("items", pa.list_(pa.int64())), ("longest", pa.int64())])


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per row of docs: doc_id, n_words, spans of hit words [s, e), items, longest match in words.

    A null or empty text has no words and is clean; a null doc_id is kept as it is. Benchmark rows
    without words or item_id match nothing; an item shorter than the window is one window. Repeated
    rows give repeated results, empty tables empty or clean ones. Other columns are not read.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    own = own.withColumn("text_hash", F.xxhash64("text"))
    parts = blocks(benchmark, window)

    def pass_over(block):
        def run(batches):
            release()
            for batch in _pieces(batches, SHARD_BYTES):
                n, spans, items, longest = _shard(block.value, batch.column("text"))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(n), pa.array(spans, _ARROW.field("spans").type), pa.array(items, _ARROW.field("items").type), pa.array(longest)], schema=_ARROW)

        return own.mapInArrow(run, _FOUND)

    found = pass_over(parts[0])
    if len(parts) > 1:
        for block in parts[1:]:
            found = found.union(pass_over(block))
        merged = found.groupBy("doc_id", "text_hash", "n_words").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.max("longest").alias("longest"), F.count(F.lit(1)).alias("copies"))
        found = merged.withColumn("copy", F.explode(F.expr(f"sequence(1, int(copies / {len(parts)}))")))
    return found.select("doc_id", "n_words", F.array_sort("spans").alias("spans"), "items", "longest")


def _covered(spans: Column) -> Column:
    """Words in the union of spans that are sorted by their starts."""
    zero = F.struct(F.lit(0).alias("to"), F.lit(0).cast("long").alias("n"))
    step = lambda a, x: F.struct(F.greatest(a["to"], x["e"]).alias("to"), (a["n"] + F.greatest(x["e"] - F.greatest(a["to"], x["s"]), F.lit(0))).alias("n"))
    return F.aggregate(spans, zero, step, lambda a: a["n"])


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, longest_match."""
    found = find(docs, benchmark, window)
    hit = _covered(F.col("spans"))
    listed = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(listed, 256).alias("items_sha256"), (hit > 0).alias("contaminated"), F.col("longest").alias("longest_match"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs in which no benchmark window occurs, with all their columns; no shuffle."""
    names = docs.columns
    docs = docs.toDF(*(c if c == "text" else f"c{i}" for i, c in enumerate(names)))
    for block in blocks(benchmark, window):

        def run(batches, block=block):
            release()
            for batch in _pieces(batches, SHARD_BYTES):
                _, spans, _, _ = _shard(block.value, batch.column("text"))
                yield batch.filter(pa.array([not s for s in spans]))

        docs = docs.mapInArrow(run, docs.schema)
    return docs.toDF(*names)
