"""SentencePiece encoding and decoding by streaming Viterbi, for unigram and BPE model files.

The lattice over a text has a boundary after each character and an edge for each piece. Only boundaries
within the longest piece's length of the front can be extended, so that window is all the search keeps
open. Whenever the backpointer paths of all boundaries in the window meet in one, what lies before it
is final: its ids are committed and its cells freed.

In a unigram model the surviving path into a boundary is the one of the highest score. A BPE model's
scores are merge priorities and don't add up; there, the surviving path into a boundary is the one whose
neighbouring pieces don't merge, which is unique and equals what merging by priority would give.

A segment is a stretch that no piece crosses at either end (spaces stand at the front of pieces only, and
a character in no piece stands alone), so all paths meet there; segments that were searched once are
remembered.
"""

from __future__ import annotations

import gc
import re
import struct
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import chunks, keep
from .minhash import _pieces

SPACE = "▁"
_LETTER = re.compile(r"[^\W\d_]")
#: Characters that a search takes at once.
STEP = 4096
#: Text that is encoded at once, and chunks and pairs that a worker remembers; beyond that it goes on with those of the text at hand.
PIECE_BYTES, REMEMBERED = 4 << 20, 300_000


def _varint(b: bytes, i: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        c = b[i]
        i += 1
        value |= (c & 127) << shift
        shift += 7
        if c < 128:
            return value, i


def _fields(b: bytes):
    """Field numbers and values of a protocol-buffer message."""
    i = 0
    while i < len(b):
        key, i = _varint(b, i)
        if key & 7 == 0:
            value, i = _varint(b, i)
        else:
            if key & 7 == 2:
                n, i = _varint(b, i)
            else:
                n = 4 if key & 7 == 5 else 8
            value, i = b[i : i + n], i + n
        yield key >> 3, value


class Open:
    """A search under way: the characters that are not final, and for each boundary between them the length
    of the piece that ends there, what is known to stand beside that piece (BPE) or the best sum (unigram)."""

    def __init__(self):
        self.window, self.back, self.done = "", [0], False
        self.beside, self.best = [{}], [0.0]

    def commit(self, meet: int) -> None:
        self.done = True
        self.window, self.back = self.window[meet:], [0, *self.back[meet + 1 :]]
        self.beside = self.beside[meet:]
        self.best = [b - self.best[meet] for b in self.best[meet:]]

    def back_to(self, text: str) -> Open:
        """The search as it was where text and the window part."""
        n = 0
        for a, b in zip(self.window, text, strict=False):
            if a != b:
                break
            n += 1
        self.window = text[:n]
        del self.back[n + 1 :], self.beside[n + 1 :], self.best[n + 1 :]
        return self


class Model:
    """Pieces, scores and settings of a model file, or of a given list of (piece, score, type)."""

    NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6

    def __init__(self, path: str | None = None, pieces=None, bpe: bool = False, dummy_prefix: bool = True):
        self.bpe, self.dummy_prefix = bpe, dummy_prefix
        if path is not None:
            pieces = []
            for number, value in _fields(open(path, "rb").read()):
                if number == 1:
                    f = dict(_fields(value))
                    pieces.append((f[1].decode(), struct.unpack("<f", f.get(2, b"\0\0\0\0"))[0], f.get(3, 1)))
                elif number == 2:
                    kind = dict(_fields(value)).get(3, 1)
                    if kind not in (1, 2):
                        raise ValueError("only unigram and BPE models are read")
                    self.bpe = kind == 2
                elif number == 3:
                    f = dict(_fields(value))
                    if f.get(2) or f.get(4, 1):
                        raise ValueError("only models without normalization are read")
                    self.dummy_prefix = bool(f.get(3, 1))
        self.score = {p: s for p, s, kind in pieces if kind in (self.NORMAL, self.USER)}
        self.id = {p: i for i, (p, _, kind) in enumerate(pieces) if kind in (self.NORMAL, self.USER)}
        self.unknown = next((i for i, p in enumerate(pieces) if p[2] == self.UNKNOWN), 0)
        self.byte = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == self.BYTE}
        self.longest = max(map(len, self.id), default=1)
        self.lowest = min(self.score.values(), default=0.0) - 10.0
        surface = []
        for p, _, kind in pieces:
            if kind == self.BYTE:
                surface.append(bytes([int(p[3:5], 16)]))
            elif kind == self.CONTROL:
                surface.append(b"")
            elif kind == self.UNKNOWN:
                surface.append(" ⁇ ".encode())
            else:
                surface.append(p.replace(SPACE, " ").encode())
        self.surface = surface
        known = set("".join(self.id))
        after_letter = {p[i + 1] for p in self.id for i in range(len(p) - 1) if _LETTER.match(p[i])}
        ends = "".join(re.escape(c) for c in ".,;:!?)" if c not in after_letter)
        self._cut = re.compile((f"{SPACE}*[^\\W\\d_]+(?=[{ends}])|" if ends else "") + f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n").findall
        inner = "".join(p[i : i + 2] for p in self.id for i in range(len(p) - 1) if p[i] != SPACE and p[i + 1] == SPACE)
        self.splits_at_space = not inner
        self.splits_at_newline = "\n" not in known
        self._packed = {p: struct.pack("<i", i) for p, i in self.id.items()}
        self._pair: dict[str, dict[str, bool]] = {}
        self._pairs = 0
        self._chunks: dict[str, bytes] = {}
        self._marks: dict[str, bytes] = {}
        self._spelling = pa.array(surface, pa.large_binary())
        #: Commits of the searches so far, and the widest window that one held.
        self.commits, self.widest = 0, 0
        if self.bpe:
            self._place = {x: i + 1 for i, x in enumerate(sorted(set(self.score.values()), reverse=True))}
            self._rank_pieces()

    # ---- the lattice

    def merge(self, text: str) -> list[str]:
        """Pieces by repeatedly merging the best neighbours; for short strings."""
        s = list(text)
        while True:
            best = max(((self.score[a + b], -i) for i, (a, b) in enumerate(zip(s, s[1:], strict=False)) if a + b in self.score), default=None)
            if best is None:
                return s
            i = -best[1]
            s[i : i + 2] = [s[i] + s[i + 1]]

    def _rank_pieces(self) -> None:
        """For BPE: rank, last merge and self-encoding of every piece."""
        count, place = Counter(self.score.values()), self._place
        self._rank, self._split, self._slow = {}, {}, set()
        for p, x in self.score.items():
            if len(p) == 1:
                self._rank[p], self._split[p] = 0, None
                continue
            if count[x] > 1:
                self._slow.add(p)
            parts, last = list(p), None
            while len(parts) > 1:
                best = max(((self.score[l + r], -i) for i, (l, r) in enumerate(zip(parts, parts[1:], strict=False)) if l + r in self.score), default=None)
                if best is None:
                    break
                i = -best[1]
                last = (parts[i], parts[i + 1])
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            if len(parts) == 1:  # others never come out of merging
                self._rank[p], self._split[p] = place[x], last
        self._slow |= {p for p, q in self._split.items() if q and (q[0] in self._slow or q[1] in self._slow)}

    def stays(self, left: str, right: str) -> bool:
        """Whether two pieces beside each other don't merge into other ones.

        Undoes the merges on both sides of the joint, latest first; before each, whatever would merge
        across the joint must come later than it.
        """
        beside = self._pair.setdefault(left, {})
        known = beside.get(right)
        if known is not None:
            return known
        if left in self._slow or right in self._slow:
            known = self.merge(left + right) == [left, right]
        else:
            rank, split, score_of = self._rank, self._split, self._rank_of
            x, y, limit, ties = left, right, 1 << 60, False
            while True:
                across = score_of(x + y)
                if across is not None and (across < limit or (ties and across == limit)):
                    known = False
                    break
                rx, ry = rank.get(x, 0), rank.get(y, 0)
                if not rx and not ry:
                    known = True
                    break
                if rx > ry:  # the left side's last merge came after the right side's: it is undone first
                    limit, ties, x = rx, False, split[x][1]
                else:
                    limit, ties, y = ry, True, split[y][0]
        self._pairs += 1
        beside[right] = known
        return known

    def _rank_of(self, p: str):
        x = self.score.get(p)
        return None if x is None else self._place[x]

    def ids_of(self, piece: str) -> list[int]:
        i = self.id.get(piece)
        if i is not None:
            return [i]
        return [self.byte[b] for b in piece.encode()] if self.byte else [self.unknown]

    def search(self, text) -> Iterator[str]:
        """Pieces of a text, or of a stream of strings, as soon as they are final."""
        for final in self._committed(text):
            yield from final

    def _committed(self, text, begun: Open | None = None) -> Iterator[list[str]]:
        """What search() finds, commit by commit.

        begun is an open search of another text that has committed nothing; what it found for the beginning
        that both texts share is taken over.
        """
        parts = (text[a : a + STEP] for a in range(0, len(text), STEP)) if isinstance(text, str) else text
        s = begun or Open()
        for part in parts:
            s.window += part
            while len(s.back) <= len(s.window):
                (self._extend_bpe if self.bpe else self._extend_unigram)(s, min(len(s.window), len(s.back) + 2 * self.longest))
                meet = self._meeting(s.back) if len(s.back) > 2 * self.longest else 0
                if meet > 0:
                    self.commits += 1
                    self.widest = max(self.widest, len(s.back) - 1)
                    yield self._walk(s.window, s.back, meet)
                    s.commit(meet)
        yield self._walk(s.window, s.back, len(s.window))

    def _extend_bpe(self, s: Open, upto: int) -> None:
        """Backpointers of the boundaries up to upto: the length of the piece that ends at each, the longest
        one that stays beside the piece before it."""
        rank, pair, stays, longest, window, back, beside = self._rank, self._pair, self.stays, self.longest, s.window, s.back, s.beside
        for i in range(len(back), upto + 1):
            for k in range(i - longest if i > longest else 0, i):
                p = window[k:i]
                if p in rank or k == i - 1:
                    if not k:
                        break
                    ok = beside[k].get(p)
                    if ok or (ok is None and stays(window[k - back[k] : k], p)):
                        break
            back.append(i - k)
            known = pair.get(p)
            if known is None:
                known = pair[p] = {}
            beside.append(known)

    def _extend_unigram(self, s: Open, upto: int) -> None:
        """The same with the best sum of scores, which best holds for each boundary."""
        window, back, best = s.window, s.back, s.best
        for i in range(len(back), upto + 1):
            top, length = best[i - 1] + self.score.get(window[i - 1 : i], self.lowest), 1
            for n in range(2, min(self.longest, i) + 1):
                x = self.score.get(window[i - n : i])
                if x is not None and best[i - n] + x > top:
                    top, length = best[i - n] + x, n
            back.append(length)
            best.append(top)

    def _meeting(self, back: list[int]) -> int:
        """Where the paths of all boundaries meet that a piece can still extend; 0 if nowhere in the window."""
        i = len(back) - 1
        live = set(range(max(0, i - self.longest + 1), i + 1))
        while len(live) > 1:
            last = max(live)
            live.discard(last)
            live.add(last - back[last])
        meet = live.pop()
        # the piece before the meeting point is still looked at
        return meet - back[meet] if self.bpe and meet else meet

    @staticmethod
    def _walk(window: str, back: list[int], end: int) -> list[str]:
        out = []
        while end > 0:
            out.append(window[end - back[end] : end])
            end -= back[end]
        return out[::-1]

    def _searched(self, text: str, begun: Open | None = None) -> bytes:
        own, spell = self._packed, self.ids_of
        return b"".join([own[p] if p in own else struct.pack(f"<{len(x := spell(p))}i", *x) for final in self._committed(text, begun) for p in final])

    def _written(self, text: str) -> str:
        text = text.replace(" ", SPACE)
        return SPACE + text if self.dummy_prefix else text

    def encode_bytes(self, text: str) -> bytes:
        """Ids as little-endian 32-bit integers."""
        return self._searched(self._written(text)) if text else b""

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), np.int32).tolist()

    def _learn(self, words: list[str]) -> None:
        """Ids of chunks between spaces, searched segment by segment, in sorted order: the search of a segment
        goes on where the one before it has the same beginning."""
        known, marks, open_ = self._chunks, self._marks, None
        for w in sorted(words):
            out = []
            for s in self._cut(w if w[:1] == "\n" else SPACE + w):
                alone = s[1:] if s[0] == SPACE and s[1:2] != SPACE else None
                ids = marks.get(s) if alone is None else None if alone == w else known.get(alone)
                if ids is None:
                    open_ = Open() if open_ is None or open_.done else open_.back_to(s)
                    ids = self._searched(s[len(open_.window) :], open_)
                    if alone is None and len(s) == 1:
                        marks[s] = ids
                    elif alone is not None and w.startswith(alone):
                        known[alone] = ids
                out.append(ids)
            known[w] = b"".join(out)

    def encode_column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, and the rows' bounds in them; null is empty.

        A piece begins with its spaces, and none crosses a line break, so chunks between single spaces have
        ids of their own, which are searched once and remembered. Other texts are searched whole.
        """
        column = pc.fill_null(column.cast(pa.large_string()), "")
        n = len(column)
        if self.dummy_prefix and self.splits_at_space and self.splits_at_newline:
            odd = pc.match_substring_regex(column, f"  |^ |{SPACE}").to_numpy(zero_copy_only=False)
        else:
            odd = np.ones(n, bool)
        empty = pc.equal(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        plain = np.flatnonzero(~odd & ~empty)
        bounds, found = chunks(column.take(pa.array(plain)))
        words = found.dictionary.to_pylist()
        known = self._chunks
        missing = [w for w in words if w not in known]
        if len(known) + len(missing) > REMEMBERED:
            known = self._chunks = {w: known[w] for w in words if w in known}
        if self._pairs > 2 * REMEMBERED:
            self._pair.clear()
            self._pairs = 0
        self._learn(missing)
        coded = pa.array(list(map(known.__getitem__, words)), pa.large_binary()).take(found.indices)
        at = np.frombuffer(coded.buffers()[1], np.int64)[coded.offset : coded.offset + len(coded) + 1][bounds] // 4 if len(coded) else np.zeros(len(bounds), np.int64)
        ids = np.frombuffer(coded.buffers()[2], np.int32)[at[0] : at[-1]] if len(coded) else np.zeros(0, np.int32)
        sizes = np.zeros(n, np.int64)
        sizes[plain] = np.diff(at)
        whole = np.flatnonzero(odd & ~empty)
        if len(whole):
            parts: list = [b""] * n
            for i, a, b in zip(plain.tolist(), (at[:-1] - at[0]).tolist(), (at[1:] - at[0]).tolist(), strict=True):
                parts[i] = ids[a:b].tobytes()
            for i, t in zip(whole.tolist(), column.take(pa.array(whole)).to_pylist(), strict=True):
                parts[i] = self.encode_bytes(t)
            sizes[whole] = [len(parts[i]) // 4 for i in whole.tolist()]
            ids = np.frombuffer(b"".join(parts), np.int32)
        return ids, np.concatenate([[0], np.cumsum(sizes)])

    def forget(self) -> None:
        """Drop the remembered chunks and pairs: an idle worker holds the model only."""
        self._chunks, self._pair, self._pairs = {}, {}, 0

    def surfaces(self, ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
        """The bytes that each row's ids spell, the dummy prefix included."""
        spelled = self._spelling.take(pa.array(ids))
        cut = np.frombuffer(spelled.buffers()[1], np.int64)[spelled.offset : spelled.offset + len(spelled) + 1][bounds] if len(ids) else np.zeros(len(bounds), np.int64)
        return pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(cut), spelled.buffers()[2] if len(ids) else pa.py_buffer(b"")])

    def decode(self, ids) -> str:
        out = b"".join(map(self.surface.__getitem__, ids)).decode("utf-8", "replace")
        return out[1:] if self.dummy_prefix and out.startswith(" ") else out


def load(path: str) -> Model:
    """A worker reads a model once."""
    return keep(("pieces", path), lambda: Model(path))


def encode_documents(docs: DataFrame, model_path: str) -> DataFrame:
    """One row per row of docs: doc_id, ids, n_tokens, decoded text's length, and whether decoding gives the text back.

    A null text counts as empty and has no ids; doc_id may be null or repeat, rows stay apart. The whole
    text is encoded, however long. Of unigram paths with equal scores the one with the longer last piece
    loses; a BPE model's path is unique, equal priorities merging from the left. Decoding gives back every
    text but those that hold U+2581, which SentencePiece can't tell from a space. Other columns are not read.
    """
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType()), T.StructField("decoded_chars", T.LongType()), T.StructField("round_trip", T.BooleanType())])

    def run(batches):
        gc.disable()  # nothing here makes cycles, and a collection would visit all that is remembered
        model = load(model_path)
        for batch in _pieces(batches, PIECE_BYTES):
            texts = pc.fill_null(batch.column("text").cast(pa.large_string()), "")
            ids, bounds = model.encode_column(texts)
            spelled = model.surfaces(ids, bounds)
            lead = pc.if_else(pc.equal(pc.binary_length(texts), 0), b"", b" " if model.dummy_prefix else b"").cast(pa.large_binary())
            same = pc.equal(spelled, pc.binary_join_element_wise(lead, texts.cast(pa.large_binary()), pa.scalar(b"", pa.large_binary())))
            chars, back = pc.utf8_length(texts).to_numpy().copy(), same.to_numpy(zero_copy_only=False).copy()
            for i in np.flatnonzero(~back).tolist():
                decoded = model.decode(ids[bounds[i] : bounds[i + 1]].tolist())
                chars[i], back[i] = len(decoded), decoded == texts[i].as_py()
            listed = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), listed, pa.array(np.diff(bounds)), pa.array(chars.astype(np.int64)), pa.array(back)], names=schema.names)
        model.forget()
        gc.enable()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
