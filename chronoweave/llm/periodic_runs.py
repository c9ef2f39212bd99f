"""Periodic runs of words in each document, by the runs theorem.

The periods of a run appear in it as Lyndon words: under one of the two orders of the words (ascending ids or
descending) each Lyndon root of a run is the longest Lyndon word that begins there, and the longest Lyndon word
at a place ends where the next smaller suffix begins. So for either order the inverse suffix array of all
documents of a piece is built, its next-smaller values give one candidate root a word, and roots are extended
to both sides by longest common extensions: the minimum of the array of longest common prefixes between two
ranks, from a sparse table; to the left in the reversed texts. Documents are apart in the suffix array, since
their number leads the sort key, so each one is judged by itself.

Only runs of MIN_EXPONENT periods are asked for. Their first root is followed by two more periods at least,
so roots that are not are put aside before any table is built, and a document without others needs none.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import release
from .minhash import _pieces

#: A run has so many words and so many periods at least.
MIN_WORDS, MIN_EXPONENT = 6, 4
PIECE_BYTES = 2 << 20
#: Rounds of pointer jumping for next smaller values; what is left then is settled by a stack.
ROUNDS = 64


class Suffixes:
    """Suffix array of word ids from 1, with a 0 after each document: sa, rank, and the ranks by the first h words for doubling h."""

    def __init__(self, words: np.ndarray, doc: np.ndarray):
        n = len(words)
        self.words = words
        bits = max(1, int(words.max(initial=0)).bit_length())
        self.packed = packed = max(1, min(4, (63 - max(1, int(doc.max(initial=0)).bit_length())) // bits))
        key, part, open_ = doc.astype(np.int64), words, words != 0
        for s in range(packed):
            if s:
                part = np.zeros(n, np.int64)
                part[: max(n - s, 0)] = words[s:]
                part[~open_] = 0
                open_ = part != 0
            key = (key << bits) | part
        where = np.flatnonzero(words)
        order = np.argsort(key[where], kind="stable")
        self.sa = sa = where[order]
        k = key[sa]
        fresh = np.ones(len(sa), bool)
        fresh[1:] = k[1:] != k[:-1]
        group = np.flatnonzero(fresh)
        size = np.diff(np.append(group, len(sa)))
        self.rank = rank = np.zeros(n + 1, np.int32)
        rank[sa] = np.repeat(group + 1, size)
        self.levels = [(packed, rank.copy())]
        tied = np.flatnonzero(np.repeat(size, size) > 1)  # such suffixes go on beyond the words compared: the end of a document occurs once
        h = packed
        while len(tied):
            own = sa[tied]
            first, following = rank[own], rank[own + h]
            again = np.argsort(first.astype(np.int64) << 32 | following, kind="stable")
            own, first, following = own[again], first[again], following[again]
            sa[tied] = own
            new = np.ones(len(tied), bool)
            new[1:] = (first[1:] != first[:-1]) | (following[1:] != following[:-1])
            begins = np.flatnonzero(new)
            count = np.diff(np.append(begins, len(tied)))
            rank[own] = np.repeat(tied[begins] + 1, count)
            tied = tied[np.repeat(count, count) > 1]
            h *= 2
            if len(tied):
                self.levels.append((h, rank.copy()))

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Longest common prefixes of suffixes of one document, by descending through the levels."""
        a, b = a.copy(), b.copy()
        start = a.copy()
        for h, rank in reversed(self.levels):
            same = rank[a] == rank[b]
            a[same] += h
            b[same] += h
        left = np.arange(len(a))
        for _ in range(self.packed - 1):
            x = self.words[a[left]]
            left = left[(x == self.words[b[left]]) & (x != 0)]
            a[left] += 1
            b[left] += 1
        return a - start


class Extensions:
    """Longest common extensions to the right: a sparse table of minima over the longest common prefixes."""

    def __init__(self, suffixes: Suffixes, longest: int):
        """longest: words of the longest document."""
        self.rank = suffixes.rank
        sa = suffixes.sa
        lcp = np.zeros(len(sa) + 1, np.int32)  # lcp[r]: of the suffixes of ranks r and r + 1, which count from 1
        doc_ends = np.cumsum(suffixes.words == 0)
        same = np.flatnonzero(doc_ends[sa[1:]] == doc_ends[sa[:-1]])
        lcp[same + 1] = suffixes.common(sa[:-1][same], sa[1:][same])
        self.table = [lcp]
        while 2 << (len(self.table) - 1) <= min(longest, len(lcp)):
            last, step = self.table[-1], 1 << (len(self.table) - 1)
            more = last.copy()
            more[: len(last) - step] = np.minimum(last[: len(last) - step], last[step:])
            self.table.append(more)

    def of(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """For two different places of one document, how many words from there on are equal."""
        a, b = self.rank[i], self.rank[j]
        lo, hi = np.minimum(a, b).astype(np.int64), np.maximum(a, b).astype(np.int64)  # the minimum of lcp[lo] to lcp[hi - 1]
        level = np.log2(np.maximum(hi - lo, 1)).astype(np.int64)
        out = np.zeros(len(i), np.int64)
        for k in np.unique(level).tolist():
            own = np.flatnonzero(level == k)
            out[own] = np.minimum(self.table[k][lo[own]], self.table[k][hi[own] - (1 << k)])
        return out


def next_smaller(rank: np.ndarray) -> np.ndarray:
    """For each place the next one of smaller rank; the rank 0 at the end of each document is smaller than all others."""
    n = len(rank)
    to = np.arange(1, n + 1)
    left = np.flatnonzero(rank[:-1])
    for _ in range(ROUNDS):
        left = left[rank[to[left]] > rank[left]]
        if not len(left):
            return to
        to[left] = to[to[left]]
    for i in left[::-1].tolist():  # every place to the right is settled
        j = int(to[i])
        while rank[j] > rank[i]:
            j = int(to[j])
        to[i] = j
    return to


def runs(words: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, length, period) of all runs, in this order. words: ids from 1 of all rows, n: words of each row."""
    none = (np.zeros(0, np.int64),) * 4
    if not len(words):
        return none
    doc = np.repeat(np.arange(len(n)), n + 1)
    base = np.cumsum(n + 1) - (n + 1)
    end = base + n
    text = np.zeros(len(doc), np.int64)
    text[np.arange(len(words)) + np.repeat(np.arange(len(n)), n)] = words
    top = int(words.max()) + 1
    found, suffixes = [], None
    for order in (text, np.where(text > 0, top - text, 0)):
        s = Suffixes(order, doc)
        suffixes = suffixes or s
        j = next_smaller(s.rank)[: len(text)]
        i = np.arange(len(text))
        q = j - i
        ok = np.flatnonzero((text > 0) & (j + 2 * q <= end[doc]))
        ok = ok[(text[i[ok]] == text[j[ok]]) & (text[i[ok] + 2 * q[ok] - 1] == text[j[ok] + 2 * q[ok] - 1])]
        ok = ok[text[i[ok] + q[ok] - 1] == text[j[ok] + q[ok] - 1]]
        found.append(np.stack([i[ok], j[ok]]))
    i, j = np.concatenate(found, axis=1)
    if not len(i):
        return none
    longest = int(n.max())
    right = Extensions(suffixes, longest).of(i, j)
    keep = right >= 2 * (j - i)
    i, j, right = i[keep], j[keep], right[keep]
    if not len(i):
        return none
    # all roots of a run have its end and its period; the first one is next to its beginning
    by = np.lexsort((i, j - i, j + right))
    i, j, right = i[by], j[by], right[by]
    stop, q = j + right, j - i
    first = np.ones(len(i), bool)
    first[1:] = (stop[1:] != stop[:-1]) | (q[1:] != q[:-1])
    i, j, stop, q = i[first], j[first], stop[first], q[first]
    # to the left: the rows with candidates, reversed
    rows = np.unique(doc[i])
    sizes = n[rows] + 1
    rbase = np.cumsum(sizes) - sizes
    at = np.repeat(np.arange(len(rows)), sizes)
    offset = np.arange(int(sizes.sum())) - rbase[at]
    back = np.where(offset < n[rows][at], text[base[rows][at] + n[rows][at] - 1 - np.minimum(offset, n[rows][at] - 1)], 0)
    own = np.searchsorted(rows, doc[i])
    mirror = lambda x: rbase[own] + end[doc[x]] - x  # noqa: E731  the place that reads from the word before x to the left
    inner = i > base[doc[i]]
    left = np.zeros(len(i), np.int64)
    if inner.any():
        left[inner] = Extensions(Suffixes(back, at), longest).of(mirror(i)[inner], mirror(j)[inner])
    start, row = i - left, doc[i]
    length = stop - start
    good = (length >= MIN_EXPONENT * q) & (length >= MIN_WORDS)
    out = np.unique(np.stack([row, start - base[row], length, q])[:, good], axis=1)
    by = np.lexsort((out[3], out[1], out[0]))
    return tuple(out[:, by])


def _split(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of all rows, and how many each row has."""
    lists = pc.ascii_split_whitespace(pc.fill_null(column.cast(pa.string()), ""))
    words, offsets = lists.flatten(), lists.offsets.to_numpy()
    some = pc.greater(pc.binary_length(words), 0)
    upto = np.concatenate([[0], np.cumsum(some.to_numpy(zero_copy_only=False))])
    return words.filter(some), np.diff(upto[offsets.astype(np.int64) - offsets[0]])


def make_periodic(ids: list, n: np.ndarray) -> np.ndarray:
    """Which word of all rows stands at each place, after the texts of about a tenth of the documents, by a checksum of doc_id, are made periodic from some word on. A null doc_id stays as it is."""
    which = np.arange(int(n.sum()))
    base = np.cumsum(n) - n
    for row, (doc_id, size) in enumerate(zip(ids, n.tolist(), strict=True)):
        h = zlib.crc32(str(doc_id).encode())
        if doc_id is not None and h % 10 == 0 and size:
            g = h // 10
            a = g % size
            p = 1 + (size - a) // (3 + g % 8)
            which[base[row] + a : base[row] + size] = base[row] + a + np.arange(size - a) % p
    return which


_REPORT = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
_FOUND = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def _collapsed(words: pa.Array, which: np.ndarray, n: np.ndarray, found) -> pa.Array:
    """Texts without the words that stand in a run after its first period."""
    base = np.cumsum(n) - n
    row, start, length, period = found
    edge = np.zeros(len(which) + 1, np.int64)
    np.add.at(edge, base[row] + start + period, 1)
    np.add.at(edge, base[row] + start + length, -1)
    kept = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
    bounds = np.searchsorted(kept, np.append(base, len(which)))
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), words.take(pa.array(which[kept]))), " ")


def _found(batch: pa.RecordBatch, periodic: bool):
    words, n = _split(batch.column("text"))
    which = make_periodic(batch.column("doc_id").to_pylist(), n) if periodic else np.arange(len(words))
    codes = words.dictionary_encode().indices.to_numpy().astype(np.int64)[which] + 1
    found = runs(codes, n)
    return n, found, np.searchsorted(found[0], np.arange(len(n) + 1)), _collapsed(words, which, n, found)


def _digests(periodic: bool):
    def run(batches):
        release()
        for batch in _pieces(batches, PIECE_BYTES):
            n, (_, start, length, period), bounds, collapsed = _found(batch, periodic)
            best: list[tuple] = []
            listed: list[str] = []
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                own = list(zip(start[a:b].tolist(), length[a:b].tolist(), period[a:b].tolist(), strict=True))
                top = None
                for x in own:  # in order of start, then period, so that the first of equals stays
                    if top is None or x[1] * top[2] > top[1] * x[2]:
                        top = x
                best.append((None,) * 4 if top is None else (*top, 1000 * top[1] // top[2]))
                listed.append(hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in own).encode()).hexdigest())
            shas = [hashlib.sha256(t.as_buffer()).hexdigest() for t in collapsed]
            columns = [pa.array(list(c), pa.int64()) for c in zip(*best, strict=True)] if best else [pa.array([], pa.int64())] * 4
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(bounds)), *columns, pa.array(listed, pa.string()), pa.array(shas, pa.string())], names=[f.split(" ")[0] for f in _REPORT.split(", ")])

    return run


def _listed(periodic: bool):
    def run(batches):
        release()
        for batch in _pieces(batches, PIECE_BYTES):
            n, (_, start, length, period), bounds, collapsed = _found(batch, periodic)
            lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.StructArray.from_arrays([pa.array(start), pa.array(length), pa.array(period)], names=["start", "length", "period"]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n.astype(np.int64)), lists, collapsed], names=["doc_id", "n_words", "runs", "collapsed"])

    return run


def _own(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def find(docs: DataFrame, periodic: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_words, runs (start, length and period in words, by start, then period) and
    collapsed, the words joined by a space without those that stand in a run after its first period.

    Words are stretches without ASCII white space. A run is a longest possible stretch whose words are equal to
    those a period later, for its smallest period, with 6 words and 4 periods at least. A null or empty text has
    no words, no runs and an empty collapsed text; a null doc_id is kept. Every row is judged by itself, so
    repeated rows and ties get equal results. A text is never cut; the longest one bounds what a task holds.
    An empty table gives an empty result. Other columns are not read. No shuffle.
    """
    return _own(docs).mapInArrow(_listed(periodic), _FOUND)


def report(docs: DataFrame, periodic: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_runs, the run with the greatest exponent (smallest start, then period,
    among equals; nulls if there is none) and digests of all runs and of the collapsed text. Rules as in find()."""
    return _own(docs).mapInArrow(_digests(periodic), _REPORT)
