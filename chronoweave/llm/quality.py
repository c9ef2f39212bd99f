"""Quality classifier: interpolated modified Kneser-Ney n-grams over UTF-8 bytes of trusted text.

Counts of the highest order are gathered over all trusted documents, pre-aggregated in each task and
summed by a shuffle; every further table (continuation counts, discounts, context masses, interpolated
probabilities) comes from joins that are sharded by n-gram. A context has at most 256 continuations, so
no key is hot. A packed 64-bit integer is the n-gram itself, so n-grams don't collide; a NUL byte in a text
is taken as the padding before it.

A document's score is its mean negative log-probability per byte, together with PRIOR_BYTES at its language's
mean, so that a few words decide little; its perplexity is that of this score. Thresholds are quantiles of the
same scores, by language, over all trusted documents, each scored by a model of the other folds; the quantile's
rank is off by a ten-thousandth of these documents at most. The models of all folds but one and of all folds
are estimated together. A finished model goes to the tasks in shards split by the byte before the predicted
one, of about SHARD_ROWS or of one such byte; each position falls into one shard, and one more shard is one
more pass.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import Workspace, broadcast_if_small, fresh, keep, release, text_buffer
from .minhash import _pieces

ORDER = 5
#: Rows of the model in one broadcast shard (about 100 MB in a worker).
SHARD_ROWS = 4_000_000
#: Trusted documents fall into so many folds, by a hash of their ids; each fold is scored by a model of the others.
FOLDS = 3
QUANTILE = 0.99
#: Bytes at the language's mean rate that are added to each document, so that a few words decide little.
PRIOR_BYTES = 256
#: Where counts of counts are odd (low orders, where all n-grams are frequent), something is still left to lower orders.
LEAST_DISCOUNT = 0.1
#: Distinct n-grams that a task holds before it hands them on.
HELD_NGRAMS = 2_000_000


def _grams(data: np.ndarray, bounds: np.ndarray, order: int) -> np.ndarray:
    """Packed n-grams that end at each byte; before a text stand zero bytes."""
    key = np.zeros(len(data), np.int64)
    at = np.arange(len(data)) - np.repeat(bounds[:-1], np.diff(bounds))
    for k in range(order):
        part = data[: len(data) - k].astype(np.int64) << (8 * k)
        key[k:] |= np.where(at[k:] >= k, part, 0) if k else part
    return key


def count_ngrams(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """(g, c) over all texts."""

    def run(batches):
        release()
        held: list = []
        size = 0

        def merged():
            keys = np.concatenate([k for k, _ in held])
            counts = np.concatenate([c for _, c in held])
            by = np.argsort(keys)
            keys, counts = keys[by], counts[by]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            return keys[first], np.add.reduceat(counts, first)

        for batch in _pieces(batches):
            data, bounds = text_buffer(batch.column("text"))
            if len(data):
                held.append(np.unique(_grams(data, bounds, order), return_counts=True))
                size += len(held[-1][0])
            if size > 2 * HELD_NGRAMS:
                held = [merged()]
                size = len(held[0][0])
                if size > HELD_NGRAMS:
                    yield pa.RecordBatch.from_arrays([pa.array(held[0][0]), pa.array(held[0][1])], names=["g", "c"])
                    held, size = [], 0
        if held:
            g, c = merged()
            yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(c)], names=["g", "c"])

    return texts.select("text").mapInArrow(run, "g long, c long").groupBy("g").agg(F.sum("c").alias("c"))


def train(texts: DataFrame, ws: Workspace, order: int = ORDER) -> DataFrame:
    """Model rows (n, g, v): for n > 0 the natural log of the interpolated probability of the n-gram's last
    byte after the others; for n < 0 the log of the mass that context g of -n bytes leaves to lower orders."""
    ngrams = ws.stage(count_ngrams(texts, order).select(F.lit(0).alias("k"), "g", "c"), "ngrams")
    return estimate(ngrams, ws, order).drop("k")


def estimate(ngrams: DataFrame, ws: Workspace, order: int = ORDER) -> DataFrame:
    """Models (k, n, g, v) of (k, g, c), the counts of the highest order for each of a few models k, all in one pass."""
    counts = [ngrams]
    for n in range(order - 1, 0, -1):  # continuation counts: how many different bytes stand before
        mask = (1 << (8 * n)) - 1
        counts.append(ws.stage(counts[-1].groupBy("k", F.col("g").bitwiseAND(F.lit(mask)).alias("g")).agg(F.count(F.lit(1)).alias("c")), "continuations"))
    rows, lower = [], None
    for n, own in enumerate(reversed(counts), 1):
        found = own.groupBy("k", F.least("c", F.lit(4)).alias("c")).agg(F.count(F.lit(1)).alias("n")).collect()  # 4 rows a model at most
        d = F.lit(None).cast("double")
        for k in {r.k for r in found}:
            of = {r.c: r.n for r in found if r.k == k}
            n1, n2, n3, n4 = (of.get(i, 0) for i in (1, 2, 3, 4))
            y = n1 / (n1 + 2 * n2) if n1 else 0.5
            discount = [max(LEAST_DISCOUNT, i - (i + 1) * y * b / a) if a and b else 0.5 for i, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
            d = F.when(F.col("k") == k, F.when(F.col("c") == 1, discount[0]).when(F.col("c") == 2, discount[1]).otherwise(discount[2])).otherwise(d)
        keyed = own.withColumn("h", F.shiftright("g", 8)).withColumn("d", d)
        mass = keyed.groupBy("k", "h").agg(F.sum("c").alias("total"), (F.sum("d") / F.sum("c")).alias("left"))
        joined = keyed.join(mass, ["k", "h"])
        own_part = (F.col("c") - F.col("d")) / F.col("total")
        if lower is None:
            p = joined.select("k", "g", (own_part + F.col("left") / 256).alias("p"))
        else:
            low = lower.toDF("k", "low", "q")
            p = joined.withColumn("low", F.col("g").bitwiseAND(F.lit((1 << (8 * (n - 1))) - 1))).join(low, ["k", "low"], "left")
            p = p.select("k", "g", (own_part + F.col("left") * F.coalesce("q", F.lit(1 / 256))).alias("p"))
        lower = ws.stage(p, "probabilities")
        rows.append(lower.select("k", F.lit(n).alias("n"), "g", F.log("p").cast("float").alias("v")))
        rows.append(mass.select("k", F.lit(1 - n).alias("n"), F.col("h").alias("g"), F.log("left").cast("float").alias("v")).where(f"{n} > 1"))
        if n == 1:
            rows.append(mass.select("k", F.lit(0).alias("n"), F.lit(0).cast("long").alias("g"), F.log(F.col("left") / 256).cast("float").alias("v")))
    return ws.stage(reduce(DataFrame.union, rows), "model")


class _Table:
    """Open addressing over packed keys."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(2.5 * len(keys) + 1).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.zeros(1 << self.bits, np.float32)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = self.keys[slot[left]] == -1
            put = left[free]
            self.keys[slot[put]] = keys[put]
            won = self.keys[slot[left]] == keys[left]
            self.values[slot[left[won]]] = values[left[won]]
            left = left[~won]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values, and which keys were found."""
        slot = self._slot(keys)
        there = self.keys[slot]
        hit = there == keys
        out = self.values[slot]
        left = np.flatnonzero(~hit & (there != -1))
        slot = slot[left]
        while len(left):
            slot = (slot + 1) & ((1 << self.bits) - 1)
            there = self.keys[slot]
            ok = there == keys[left]
            out[left[ok]] = self.values[slot[ok]]
            hit[left[ok]] = True
            go = ~ok & (there != -1)
            left, slot = left[go], slot[go]
        return out, hit


class Scorer:
    def __init__(self, n: np.ndarray, g: np.ndarray, v: np.ndarray, order: int, before: np.ndarray):
        """before: for each byte, whether this shard scores positions that follow it."""
        self.order, self.before = order, before
        self.tables = {k: _Table(g[n == k], v[n == k]) for k in range(1 - order, order + 1) if k}
        self.floor = float(v[n == 0][0]) if (n == 0).any() else float(np.log(1 / 256))

    def logs(self, grams: np.ndarray) -> np.ndarray:
        out, left = np.zeros(len(grams), np.float32), np.arange(len(grams))
        for n in range(self.order, 0, -1):
            key = grams[left] & ((1 << (8 * n)) - 1)
            value, hit = self.tables[n].find(key)
            out[left[hit]] += value[hit]
            left = left[~hit]
            if not len(left):
                return out
            if n > 1:
                mass, known = self.tables[1 - n].find(key[~hit] >> 8)
                out[left[known]] += mass[known]
        out[left] += self.floor
        return out

    def rate(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Sums of negative logs over this shard's positions, and bytes, by row."""
        data, bounds = text_buffer(column)
        sums = np.zeros(len(bounds) - 1)
        for i in range(0, len(data), 1 << 20):  # cache-sized pieces, each with the bytes before it
            a, end = max(0, i - self.order), min(len(data), i + (1 << 20))
            starts = bounds[(bounds > a) & (bounds < end)]
            grams = _grams(data[a:end], np.concatenate([[a], starts, [end]]) - a, self.order)[i - a :]
            if self.before.all():
                logs = self.logs(grams)
            else:
                own = self.before[(grams >> 8) & 255]
                logs = np.zeros(len(grams), np.float32)
                logs[own] = self.logs(grams[own])
            row = np.searchsorted(bounds, np.arange(i, end), "right") - 1
            sums += np.bincount(row, -logs.astype(np.float64), len(sums))
        return sums, np.diff(bounds)


def shards(model: DataFrame, order: int = ORDER) -> list:
    """Broadcast scorers of bounded size, split by the byte before the predicted one."""
    sc = model.sparkSession.sparkContext
    # in n-grams of 2 and more it is the last but one, in contexts the last
    before = F.when(F.col("n") >= 2, F.shiftright("g", 8).bitwiseAND(F.lit(255))).when(F.col("n") < 0, F.col("g").bitwiseAND(F.lit(255))).otherwise(F.lit(-1)).alias("b")
    sizes = {r.b: r.c for r in model.groupBy(before).agg(F.count(F.lit(1)).alias("c")).collect()}  # 257 rows at most
    groups: list[list[int]] = [[]]
    size = 0
    for b in range(256):
        if size + sizes.get(b, 0) > SHARD_ROWS and groups[-1]:
            groups.append([])
            size = 0
        groups[-1].append(b)
        size += sizes.get(b, 0)
    out = []
    for group in groups:
        own = np.zeros(256, bool)
        own[group] = True
        rows = (model if len(groups) == 1 else model.where(before.isin([-1, *group]))).toArrow()
        out.append(sc.broadcast((rows["n"].to_numpy(), rows["g"].to_numpy(), rows["v"].to_numpy(), order, own)))
    return out


def _scorer(shared) -> Scorer:
    """A worker builds the tables of a shard once and keeps those of one shard."""
    return keep(("scorer", shared.id), lambda: Scorer(*shared.value))


class _Shared:
    """A broadcast and its identity."""

    def __init__(self, broadcast):
        import uuid

        self.broadcast, self.id = broadcast, uuid.uuid4().hex

    @property
    def value(self):
        return self.broadcast.value


def add_scores(docs: DataFrame, parts: list, nll: str, size: str) -> DataFrame:
    """docs with two more columns: the sum of negative logs and the bytes of each text."""
    out = docs.withColumns({nll: F.lit(0.0), size: F.lit(0).cast("long")})
    for part in parts:
        shared = _Shared(part)

        def run(batches, shared=shared):
            scorer = _scorer(shared)
            for batch in _pieces(batches):
                sums, n = scorer.rate(batch.column("text"))
                i = batch.schema.get_field_index(nll)
                columns = list(batch.columns)
                columns[i] = pa.array(batch.column(i).to_numpy() + sums)
                columns[batch.schema.get_field_index(size)] = pa.array(n.astype(np.int64))
                yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

        out = out.mapInArrow(run, T.StructType([T.StructField(f.name, f.dataType) for f in out.schema.fields]))
    return out


def judge(docs: DataFrame, labels: DataFrame, order: int = ORDER, quantile: float = QUANTILE, folds: int = FOLDS) -> DataFrame:
    """docs with four more columns, whose names don't clash with those of docs (judged() gives them): perplexity,
    plain_perplexity (of the text alone, without PRIOR_BYTES), threshold and keep.

    Trusted: documents with labels, all of quality 1 and none toxic. keep: perplexity is at
    most threshold, that of the text's language. A language
    without trusted documents (or a null one) takes the threshold of all. A null or empty text has no
    perplexity and is kept, as is everything if nothing is trusted. Labels without doc_id or quality
    don't count; a null toxic is 0. Repeated rows are judged alike. Texts of any length are scored whole, in
    pieces of 1 MB.
    """
    names = judged(docs)
    columns = docs.columns
    carried = [c for c, kind in docs.dtypes if (c, kind) != ("text", "string")]
    docs = docs.select(F.struct(*(F.col(f"`{c}`") for c in carried)).alias("row"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), F.col("doc_id").cast("long").alias("doc_id"))
    unpacked = lambda df, *more: df.select(*(F.col(f"row.`{c}`").alias(c) if c in carried else F.col(c) for c in columns), *(value.alias(name) for value, name in zip(more, names, strict=True)))
    ws = Workspace(docs.sparkSession, "quality")
    good = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t")).where("q = 1 and t = 0").select("doc_id")
    good = ws.stage(good, "trusted")
    trusted = docs.select("doc_id", "text", "lang").where("text <> ''").join(broadcast_if_small(good), "doc_id", "left_semi")
    trusted = ws.stage(trusted.select("text", "lang", F.pmod(F.xxhash64("doc_id"), F.lit(folds)).alias("fold")), "trusted-texts")
    # model k < folds counts all folds but k, model `folds` counts all
    fold = reduce(DataFrame.union, [count_ngrams(trusted.where(F.col("fold") == k), order).withColumn("fold", F.lit(k)) for k in range(folds)])
    into = F.filter(F.sequence(F.lit(0), F.lit(folds)), lambda k: k != F.col("fold"))
    ngrams = ws.stage(fold.withColumn("k", F.explode(into)).groupBy("k", "g").agg(F.sum("c").alias("c")), "ngrams")
    models = estimate(ngrams, ws, order)
    rates = []
    for k in range(folds):
        others = shards(models.where(F.col("k") == k), order)
        own = add_scores(trusted.where(F.col("fold") == k).select("text", "lang"), others, "nll", "bytes")
        rates.append(ws.stage(own.select("lang", "nll", "bytes"), "held-out"))
        for part in others:
            part.destroy()
    held = reduce(DataFrame.union, rates)
    means = {r.lang: r.m for r in held.rollup("lang").agg((F.sum("nll") / F.sum("bytes")).alias("m")).collect()}  # a row per language
    overall = means.get(None)
    if overall is None:
        none = F.lit(None).cast("double")
        return unpacked(docs, none, none, none, F.lit(True))
    mean = _by_language({k: v for k, v in means.items() if k is not None}, overall)
    rate = (F.col("nll") + PRIOR_BYTES * mean) / (F.col("bytes") + PRIOR_BYTES)
    limits = held.withColumn("r", rate).rollup("lang").agg(F.percentile_approx("r", quantile, 10_000).alias("q")).collect()
    of = {r.lang: r.q for r in limits if r.lang is not None}
    limit = _by_language(of, max(r.q for r in limits if r.lang is None))
    parts = shards(models.where(F.col("k") == folds), order)
    ws.only()  # the broadcast model is all that scoring needs
    scored = add_scores(docs.select("row", "text", "lang"), parts, "nll", "bytes")
    empty = F.col("bytes") == 0
    return unpacked(scored, F.when(~empty, F.exp(rate)), F.when(~empty, F.exp(F.col("nll") / F.col("bytes"))), F.exp(limit), empty | (rate <= limit))


def _by_language(values: dict, other: float):
    lang = F.col("lang").cast("string")
    out = F.lit(other)
    for k, v in values.items():
        out = F.when(lang == k, v).otherwise(out)
    return out


def judged(docs: DataFrame) -> list[str]:
    """The names of the columns that judge() adds to docs."""
    return fresh(docs, "perplexity", "plain_perplexity", "threshold", "keep")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the classifier doesn't reject, with their columns, whatever their names."""
    return judge(docs, labels).where(F.col(judged(docs)[3])).select(*(F.col(f"`{c}`") for c in docs.columns))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, lang, perplexity, plain_perplexity, threshold, keep."""
    return judge(docs.select("doc_id", "lang", "text"), labels).drop("text")
