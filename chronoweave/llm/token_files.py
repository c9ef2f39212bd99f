"""Token ids in canonical, length-limited Huffman code.

Two passes: tokenize and count ids, and derive the code from the counts of all documents on the driver (its
size is that of the vocabulary); order by doc_id, encode and write.

File format: a Parquet table with a row per block (so the files split, carry checksums and commit like
any other), blocks ascending by doc_id within a part and parts ascending among each other:
  part, block           place in the order
  first                 ids that come before the block within its part
  doc_ids, counts       the documents of the block and their numbers of ids
  bytes                 where each document's bits begin in the payload
  checkpoints           little-endian u32: for every STEP-th id of each document its bit in the document
  payload               the documents' bits, each document from a byte boundary
plus a table `code` with a row per used id and its code length; canonical codes follow from lengths.
A block can be decoded by itself, and a document from any checkpoint.
"""

from __future__ import annotations

import gc
import os
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import Workspace, chunks, keep, release
from .minhash import _pieces

STEP = 256
MAX_BITS = 16
#: Bytes of ids in a block; a document is never split.
BLOCK_BYTES = 1 << 20
#: Text that is tokenized at once, and chunks that a worker remembers the ids of; beyond that it goes on with those of the text at hand.
PIECE_BYTES, REMEMBERED = 16 << 20, 1_000_000


# ---------------------------------------------------------------- tokenizing


class Encoder:
    """Ids of whole texts by the tokenizers library; chunks between single spaces are remembered.

    The byte-level pre-tokenizer always cuts before a single space that follows a non-space, and at a
    single line break between non-spaces, so chunks can be encoded one by one. Texts that begin or end with
    white space, with any two white spaces in a row, or with a special token go to the library whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        self.kind = np.uint16 if self.size <= 1 << 16 else np.uint32
        self.known: dict[str, bytes] = {"": b""}
        # how the byte-level pre-tokenizer writes bytes: printable ones as themselves, others from U+0100 on
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        moved = {b: 0x100 + i for i, b in enumerate(sorted(set(range(256)) - set(shown)))}
        self.spelled = [chr(moved.get(b, b)) for b in range(256)]
        self.tails = dict(zip(["", ".", ","], self._plain(["", ".", ","]), strict=True))
        white = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]"
        special = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.whole = "|".join([f"{white}{white}", f"^{white}", f"{white}$", *special])
        self.newline = self._plain(["\n"])[0]
        probe = "a b\nc d,e f"
        self.cuts = len(self.newline) == np.dtype(self.kind).itemsize and self._plain([probe])[0] == b"".join(self._plain(["a", " b", "\n", "c", " d,e", " f"]))

    def _plain(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, missing: list[str], lead: str) -> None:
        """Chunks that follow a space (lead " ") or a line break, which they begin with (lead "").

        A word of Latin letters is one pre-token, which the library's model takes as it is; the rest goes
        through the whole library.
        """
        model, spell, tails, known = self.tokenizer.model.tokenize, self.spelled.__getitem__, self.tails, self.known
        kind, before, skip = np.dtype(self.kind).char, (b"" if lead else self.newline), (0 if lead else 1)
        space = "".join(map(spell, lead.encode()))
        rest = []
        for w in missing:
            tail = w[-1] if w[-1] in ".," else ""
            body = w[skip : len(w) - len(tail)] if skip or tail else w
            if body.isalpha() and (body.isascii() or max(body) < "\u0250"):
                ids = known.get(w[: len(w) - 1]) if tail else None
                if ids is None:
                    shown = space + (body if body.isascii() else "".join(map(spell, body.encode())))
                    ids = before + array(kind, [t.id for t in model(shown)]).tobytes()
                known[w] = ids + tails[tail] if tail else ids
            elif len(w) == skip:
                known[w] = before
            else:
                rest.append(w)
        mark = int(np.frombuffer(self.newline, self.kind)[0])
        for i in range(0, len(rest), 4096):
            some = rest[i : i + 4096]
            joined = [lead + f"\n{lead}".join(w[skip:] for w in some[j : j + 64]) for j in range(0, len(some), 64)]
            out = []
            for e in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False):
                ids = np.array(e.ids, self.kind)
                begin = 0
                for c in [*np.flatnonzero(ids == mark).tolist(), len(ids)]:
                    out.append(before + ids[begin:c].tobytes())
                    begin = c + 1
            known.update(zip(some, out, strict=True))

    def encode(self, column: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, each followed by the end id, and the rows' bounds in them; null is empty."""
        column = pc.fill_null(column.cast(pa.large_string()), "")
        if self.cuts:
            odd = pc.match_substring_regex(column, self.whole)
        else:
            odd = pc.greater(pc.binary_length(column), 0)
        whole = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        # a line break before each text: its one id is where the end id of the text before goes
        bounds, found = chunks(pc.binary_join_element_wise(_BREAK, pc.if_else(odd, _EMPTY, column), _EMPTY))
        words = found.dictionary.to_pylist()
        known = self.known
        missing = [w for w in words if w not in known]
        if len(known) + len(missing) > REMEMBERED:
            known = self.known = {w: known[w] for w in ["", *words] if w in known}
        self._learn([w for w in missing if w[0] != "\n"], " ")
        self._learn([w for w in missing if w[0] == "\n"], "")
        coded = pa.array(list(map(known.__getitem__, words)), pa.large_binary()).take(found.indices)
        size = np.dtype(self.kind).itemsize
        at = (np.frombuffer(coded.buffers()[1], np.int64)[coded.offset : coded.offset + len(coded) + 1] // size)[bounds] if len(coded) else np.zeros(1, np.int64)
        ids = np.empty(int(at[-1] - at[0]), self.kind)
        if len(ids):
            ids[:-1] = np.frombuffer(coded.buffers()[2], self.kind)[at[0] + 1 : at[-1]]
            at = at - at[0]
            ids[at[1:] - 1] = end
        if not len(whole):
            return ids, at
        parts = [ids[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        for i, raw in zip(whole.tolist(), self._plain(column.take(pa.array(whole)).to_pylist()), strict=True):
            parts[i] = np.append(np.frombuffer(raw, self.kind), self.kind(end))
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])


_BREAK, _EMPTY = pa.scalar("\n", pa.large_string()), pa.scalar("", pa.large_string())


def load(path: str) -> Encoder:
    return keep(("token-files", path), lambda: Encoder(path))


# ---------------------------------------------------------------- the code


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths up to a limit (package-merge); 0 for ids that don't occur."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    limit = max(limit, int(len(used) - 1).bit_length())
    order = used[np.argsort(counts[used], kind="stable")]
    weight = counts[order].astype(np.float64)
    levels, row = [], weight
    for _ in range(limit):
        is_item = np.zeros(len(row), bool)
        if not levels:
            is_item[:] = True
        else:
            merged = np.concatenate([weight, packages])  # noqa: F821
            by = np.argsort(merged, kind="stable")
            row = merged[by]
            is_item = by < len(weight)
        levels.append(is_item)
        pairs = len(row) // 2 * 2
        packages = row[0:pairs:2] + row[1:pairs:2]  # noqa: F841
    take = 2 * len(used) - 2
    for is_item in reversed(levels):
        items = int(is_item[:take].sum())
        lengths[order[:items]] += 1
        take = 2 * (take - items)
    return lengths


class Code:
    """Canonical codes of given lengths: shorter ones first, then by id."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths
        self.bits = max(1, int(lengths.max()) if len(lengths) else 1)
        used = np.flatnonzero(lengths)
        order = used[np.lexsort((used, lengths[used]))]
        step = np.int64(1) << (self.bits - lengths[order].astype(np.int64))
        place = np.cumsum(step) - step
        self.codes = np.zeros(len(lengths), np.uint32)
        self.codes[order] = (place >> (self.bits - lengths[order].astype(np.int64))).astype(np.uint32)
        # codes that begin at the top bit of a word with room for a shift of seven
        wide = np.uint32 if self.bits <= 24 else np.uint64
        self.left = self.codes.astype(wide) << (np.dtype(wide).itemsize * 8 - np.maximum(lengths, 1).astype(np.int64)).astype(wide)
        self.symbol = np.zeros(1 << self.bits, np.uint32)
        self.width = np.ones(1 << self.bits, np.uint8)
        filled = int(step.sum())
        self.symbol[:filled] = np.repeat(order, step)
        self.width[:filled] = np.repeat(lengths[order], step)

    def encode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Payload, its bounds by document, and the bit of every id in its document."""
        width = self.lengths[ids]
        ends = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(width, out=ends[1:])
        cut = np.concatenate([[0], np.cumsum(counts)])
        sizes = (ends[cut[1:]] - ends[cut[:-1]] + 7) >> 3
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        begins = ends[cut[:-1]]
        # each document starts at a byte: its bits move by so many
        at = ends[:-1] + np.repeat(bounds[:-1] * 8 - begins, counts)
        payload = np.zeros(int(bounds[-1]) + 4, np.uint8)
        if len(ids):
            value = self.left[ids] >> (at & 7).astype(np.uint32 if self.bits <= 24 else np.uint64)
            byte = at >> 3
            fresh = np.flatnonzero(np.concatenate([[True], byte[1:] != byte[:-1]]))
            value, byte = np.add.reduceat(value, fresh, dtype=value.dtype), byte[fresh]
            top = value.dtype.itemsize * 8 - 8
            for k in range((self.bits + 14) // 8):
                payload[byte + k] |= (value >> value.dtype.type(top - 8 * k)).astype(np.uint8)
        return payload[: int(bounds[-1])], bounds, ends[:-1] - np.repeat(begins, counts)

    def decode(self, payload: np.ndarray, at: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Ids from bit positions on, count of them from each, one lane for each position."""
        if not len(at):
            return np.zeros(0, np.uint32)
        padded = np.concatenate([payload, np.zeros(8, np.uint8)]).astype(np.uint32)
        window = padded[:-3] << np.uint32(24) | padded[1:-2] << np.uint32(16) | padded[2:-1] << np.uint32(8) | padded[3:]
        table = self.symbol << np.uint32(8) | self.width
        by = np.argsort(-count, kind="stable")
        left, at = count[by], at[by].astype(np.int64)
        out = np.zeros((int(left[0]), len(at)), np.uint32)
        down = np.uint32(32 - self.bits)
        live = np.searchsorted(-left, -np.arange(int(left[0])), "left")
        for i in range(int(left[0])):
            n = live[i]
            a = at[:n]
            hit = table[(window[a >> 3] << (a & 7).astype(np.uint32)) >> down]
            out[i, :n] = hit >> np.uint32(8)
            at[:n] += hit & np.uint32(255)
        back = np.empty_like(by)
        back[by] = np.arange(len(by))
        kept = np.arange(int(left[0]))[None, :] < count[:, None]
        return out.T[back][kept]


# ---------------------------------------------------------------- writing


#: A row per document; and at the end of each task one with doc_id, tie and ids null and the task's counts of ids.
_TOKENS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("tie", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("used", T.ArrayType(T.IntegerType())), T.StructField("times", T.ArrayType(T.LongType()))])
_BLOCK = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("block", T.IntegerType()), T.StructField("first", T.LongType()), T.StructField("doc_ids", T.ArrayType(T.LongType())), T.StructField("counts", T.ArrayType(T.LongType())), T.StructField("bytes", T.ArrayType(T.LongType())), T.StructField("checkpoints", T.BinaryType()), T.StructField("payload", T.BinaryType())])


def write(docs: DataFrame, tokenizer_path: str, end_id: int, ws: Workspace) -> tuple[DataFrame, DataFrame]:
    """Tokenize, count, encode and write; returns the tables of blocks and of code lengths."""
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("tie"), F.col("text").cast("string").alias("text"))

    def tokenize(batches):
        gc.disable()  # nothing here makes cycles, and a collection would visit all that is remembered
        encoder = load(tokenizer_path)
        total = np.zeros(max(encoder.size, end_id + 1), np.int64)
        schema = _arrow(_TOKENS)
        for batch in _pieces(batches, PIECE_BYTES):
            ids, bounds = encoder.encode(batch.column("text"), end_id)
            total += np.bincount(ids, minlength=len(total))
            raw = pa.Array.from_buffers(pa.large_binary(), batch.num_rows, [None, pa.py_buffer(bounds * ids.itemsize), pa.py_buffer(ids)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tie"), raw, *(pa.nulls(batch.num_rows, f.type) for f in (schema.field("used"), schema.field("times")))], schema=schema)
        gc.enable()
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_pylist([{"used": used.tolist(), "times": total[used].tolist()}], schema=schema)

    where = ws.path("tokens")
    own.mapInArrow(tokenize, _TOKENS).write.option("compression", "zstd").parquet(where)
    written = spark.read.schema(_TOKENS).parquet(where)
    tokens = written.where("ids is not null").select("doc_id", "tie", "ids")
    encoder = load(tokenizer_path)
    size, kind = max(encoder.size, end_id + 1), encoder.kind
    totals = written.where("ids is null").select(F.explode(F.arrays_zip("used", "times")).alias("x")).groupBy(F.col("x.used").alias("id")).agg(F.sum("x.times").alias("n"))
    counts = np.zeros(size, np.int64)
    for row in totals.collect():  # a row per vocabulary entry at most
        counts[row.id] = row.n
    lengths = code_lengths(counts)
    code = ws.stage(spark.createDataFrame([(int(i), int(lengths[i])) for i in np.flatnonzero(lengths)], "id int, length int").coalesce(1), "code")
    shared = spark.sparkContext.broadcast(lengths)

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    ordered = tokens.repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "ids", F.spark_partition_id().alias("part"))

    def encode(batches):
        release()
        code, schema = Code(shared.value), _arrow(_BLOCK)
        held: list = []
        block = first = size = 0

        def row(part):
            ids = np.frombuffer(b"".join(x for _, x in held), kind)
            n = np.array([len(x) for _, x in held], np.int64) // ids.itemsize
            payload, bounds, bit = code.encode(ids, n)
            lanes = -(-n // STEP)
            inside = np.arange(int(lanes.sum())) - np.repeat(np.cumsum(lanes) - lanes, lanes)
            marks = bit[np.repeat(np.cumsum(n) - n, lanes) + inside * STEP].astype("<u4")
            one = {"part": part, "block": block, "first": first, "doc_ids": [d for d, _ in held], "counts": n.tolist(), "bytes": bounds[:-1].tolist(), "checkpoints": marks.tobytes(), "payload": payload.tobytes()}
            return pa.RecordBatch.from_pylist([one], schema=schema), int(n.sum())

        part = 0
        for batch in batches:
            for d, ids, part in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "ids", "part")), strict=True):
                if size >= BLOCK_BYTES:
                    out, n = row(part)
                    yield out
                    block, first, size = block + 1, first + n, 0
                    held.clear()
                held.append((d, ids))
                size += len(ids)
        if held:
            yield row(part)[0]

    blocks = ws.stage(ordered.mapInArrow(encode, _BLOCK), "blocks")
    ws.remove(where)
    return blocks, code


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


# ---------------------------------------------------------------- reading


def read(blocks: DataFrame, code: DataFrame, with_ids: bool = False) -> DataFrame:
    """A row per document: doc_id, start, n_tokens, ids_crc32, and on request the ids."""
    spark = blocks.sparkSession
    rows = code.collect()
    lengths = np.zeros(max((r.id for r in rows), default=0) + 1, np.uint8)
    for r in rows:
        lengths[r.id] = r.length
    before, sums = 0, {}
    totals = blocks.select("part", F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).groupBy("part").agg(F.sum("n").alias("n"))
    for r in sorted(totals.collect()):  # a row per part
        sums[r.part], before = before, before + r.n
    shared = spark.sparkContext.broadcast((lengths, sums))
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")

    def decode(batches):
        release()
        lengths, sums = shared.value
        code = Code(lengths)
        for batch in batches:
            for r in batch.to_pylist():
                n = np.array(r["counts"], np.int64)
                lanes = -(-n // STEP)
                bit = np.frombuffer(r["checkpoints"], "<u4").astype(np.int64) + np.repeat(np.array(r["bytes"], np.int64) * 8, lanes)
                inside = np.arange(int(lanes.sum())) - np.repeat(np.cumsum(lanes) - lanes, lanes)
                many = np.minimum(np.repeat(n, lanes) - inside * STEP, STEP)
                ids = code.decode(np.frombuffer(r["payload"], np.uint8), bit, many)
                cut = np.concatenate([[0], np.cumsum(n)])
                raw = ids.astype("<u4").tobytes()
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
                start = sums[r["part"]] + r["first"] + cut[:-1]
                out = [pa.array(r["doc_ids"], pa.int64()), pa.array(start), pa.array(n), pa.array(crc, pa.int64())]
                if with_ids:
                    out.append(pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(out, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(out)])

    return blocks.mapInArrow(decode, schema)


def round_trip(docs: DataFrame, tokenizer_path: str, end_id: int = 2) -> DataFrame:
    """Write docs as token files and read them back: doc_id, start, n_tokens, ids_crc32.

    Null or empty texts have the end id only. Order: null doc_ids first, then ascending; rows that share
    a doc_id by a hash of their texts. Repeated rows are written as often as they come. Other columns
    are not read. An empty table gives an empty file and result.
    """
    ws = Workspace(docs.sparkSession, "token-files")
    return read(*write(docs, tokenizer_path, end_id, ws))
