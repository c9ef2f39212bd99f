"""Shared pieces: staged tables in the shared folder, UTF-8 word scanning, mixing functions, components."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join may be broadcast up to this many rows of a few longs each (about 8 MB); beyond it a merge join runs.
BROADCAST_ROWS = 400_000


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Unset, a local run (one process) takes a
    temporary folder; a cluster has no such folder that all its machines see, so there it is an error."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir is not set: it must name a folder that driver and executors share")
        root = os.path.join(tempfile.gettempdir(), "checkpoints")
    return root.rstrip("/")


#: Spark's own switch for freeing the shuffle files of a query that has ended.
_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Workspace:
    """Tables that cut lineage. Each is written once and read back, so a lost executor costs one stage, not all.
    What a written table was computed from is not needed again, so its shuffle files go at once."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
        self._n = 0
        self._staged: list[str] = []
        atexit.register(self._quietly_remove, self.root)

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def stage(self, df: DataFrame, name: str) -> DataFrame:
        where, conf = self.path(name), self.spark.conf
        before = conf.get(_FREE_SHUFFLES, "false")
        conf.set(_FREE_SHUFFLES, "true")
        try:
            df.write.parquet(where)
        finally:
            conf.set(_FREE_SHUFFLES, before)
        out = self.spark.read.schema(df.schema).parquet(where)
        out._stage_path = where
        self._staged.append(where)
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Free the disk of tables that no later step reads."""
        for df in frames:
            self._staged.remove(df._stage_path)
            self.remove(df._stage_path)

    def only(self, *frames: DataFrame) -> None:
        """Free the disk of all tables but these, the ones that a result still reads."""
        kept = {df._stage_path for df in frames}
        for where in self._staged:
            if where not in kept:
                self.remove(where)
        self._staged = [where for where in self._staged if where in kept]

    def remove(self, where: str) -> None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(where)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def _quietly_remove(self, where: str) -> None:
        try:
            if self.spark.sparkContext._jsc is not None:
                self.remove(where)
        except Exception:  # the session may be gone at exit; then there is nothing to do it with
            pass


def broadcast_if_small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Broadcast a staged table of few narrow rows; a larger one goes through a merge join."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= BROADCAST_ROWS else df.hint("merge")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before those that df has columns of already, in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- what a worker keeps between tasks

_kept: dict = {}


def keep(key, make):
    """make()'s result, made once while a reused worker runs tasks with the same key. A worker keeps one thing
    at a time: a task with another key frees what the one before left, so stages don't add up in memory."""
    if key not in _kept:
        release()
        _kept[key] = make()
    return _kept[key]


def release() -> None:
    """Free what the worker keeps, and hand free memory back to the system."""
    import ctypes
    import gc

    import pyarrow as pa

    if _kept:
        _kept.clear()
        gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library: it keeps its free memory
        pass


# ---------------------------------------------------------------- hashing


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words (xor-shift and odd multiplication)."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


_BASE = 0x9E3779B97F4A7C15 | 1
_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def _grow(base: int, have: np.ndarray, n: int) -> np.ndarray:
    while len(have) < n:
        step = np.uint64(pow(base, len(have), 1 << 64))
        have = np.concatenate([have, have * step])
    return have


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverses
    if len(_powers) < n:
        _powers = _grow(_BASE, _powers, n)
        _inverses = _grow(pow(_BASE, -1, 1 << 64), _inverses, n)
    return _powers, _inverses


# ---------------------------------------------------------------- words


def byte_table(members: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(members)] = True
    return t


#: Any byte but ASCII white space.
NOT_SPACE = ~byte_table(b" \t\n\x0b\x0c\r")
#: 0-9, A-Z, a-z and everything beyond ASCII.
ITEM_WORD = byte_table(bytes(range(0x30, 0x3A)) + bytes(range(0x41, 0x5B)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100)))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_VALUE = _LOWER.astype(np.uint64) + np.uint64(1)
#: Letters as they are, for hash_words.
AS_IS = np.arange(1, 257, dtype=np.uint64)


def text_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of an Arrow string column and the row bounds in them; null is empty."""
    import pyarrow as pa

    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def chunks(column):
    """Texts cut before every line break and at every space: row bounds, and the chunks as a dictionary array.

    A chunk that begins with a line break stands at the start of a line; the spaces are gone.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    lists = pc.split_pattern(pc.replace_substring(column.cast(pa.large_string()), "\n", " \n"), " ")
    bounds = lists.offsets.to_numpy().astype(np.int64)
    return bounds - bounds[0], lists.flatten().dictionary_encode()


def scan_words(data: np.ndarray, bounds: np.ndarray, members: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words in bytes, and the word bounds of each row."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(bounds), np.int64)
    word = members[data]
    before = np.empty_like(word)
    before[0] = False
    before[1:] = word[:-1]
    before[bounds[:-1][bounds[:-1] < len(data)]] = False
    after = np.empty_like(word)
    after[-1] = False
    after[:-1] = word[1:]
    last = bounds[1:] - 1
    after[last[last >= 0]] = False
    starts = np.flatnonzero(word & ~before)
    ends = np.flatnonzero(word & ~after) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, chunk: int = 1 << 19, values: np.ndarray = _VALUE) -> np.ndarray:
    """64-bit hashes of words, lower-cased by default: a rolling polynomial over cache-sized pieces, then mixed."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        base = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, base + chunk, "right")))
        s, e = starts[i:j] - base, ends[i:j] - base
        power, inverse = _power_tables(int(e[-1]) + 1)
        total = np.empty(int(e[-1]) + 1, np.uint64)
        total[0] = 0
        np.cumsum(values[data[base : base + e[-1]]] * power[: e[-1]], out=total[1:])
        out[i:j] = (total[e] - total[s]) * inverse[s]
        i = j
    return mix64(out)


# ---------------------------------------------------------------- components


def components(ws: Workspace, edges: DataFrame) -> DataFrame:
    """(node, label) for the nodes of edges (a, b): label is the smallest node that can be reached.

    Every node hooks to its smallest neighbour, chains are halved by pointer jumping, and the edges
    contract to the roots; no step gathers a neighbourhood. Each round is a staged table.
    """
    e = ws.stage(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = None
    while e.count():
        both = e.select(F.col("a").alias("node"), F.col("b").alias("to")).union(e.select("b", "a"))
        kept = ws.stage(both.groupBy("node").agg(F.min("to").alias("up")).select("node", F.least("node", "up").alias("up"), F.lit(True).alias("moved")), "hooks")
        while True:
            up = kept.select("node", "up")
            if not kept.where("moved").limit(1).count():
                break
            top = up.select(F.col("node").alias("up"), F.col("up").alias("top"))
            before, kept = kept, ws.stage(up.join(top, "up").select("node", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved")), "jumps")
            ws.drop(before)
        root_a, root_b = up.toDF("a", "ra"), up.toDF("b", "rb")
        left = ws.stage(e.join(root_a, "a").join(root_b, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
        if labels is None:
            now = ws.stage(up.toDF("node", "label"), "labels")
        else:
            step = up.toDF("label", "root")
            now = ws.stage(labels.join(step, "label", "left").select("node", F.coalesce("root", "label").alias("label")), "labels")
            ws.drop(labels)
        ws.drop(e, kept)
        e, labels = left, now
    if labels is None:
        labels = ws.stage(e.toDF("node", "label"), "labels")
    ws.drop(e)
    return labels
