"""Counters of bounded size over all tasks: rows of cells, merged by slices, read back as bitmaps.

A key has one cell in each of DEPTH rows, so the smallest of its counters is never below its true count.
Tasks hand on the cells that they touched, a shuffle by slice adds them up as a stream, and of each cell
one bit a threshold is left: whether the counter reaches it. The bitmaps have a fixed size, whatever the input.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._common import mix64

DEPTH = 4
#: Cells in a slice; offsets in one fit 16 bits.
SLICE = 1 << 14
#: Touched cells that a task holds before it hands them on.
HELD_CELLS = 500_000
TOUCHED = "slice long, cells binary, counts binary"
_MERGED = "slice long, bits binary"


def width_for(rows: int, each: int, least: int = 1 << 16, most: int = 1 << 26) -> int:
    """Cells in a row of the sketch: a power of two of at least `each` cells for each of so many input rows, within bounds."""
    return min(most, max(least, 1 << max(0, rows * each - 1).bit_length()))


def cells_of(keys: np.ndarray, width: int) -> np.ndarray:
    """Cells of 64-bit keys, one line for each row of the sketch."""
    return np.stack([((mix64(keys + np.uint64(0x9E3779B97F4A7C15 * (k + 1) % (1 << 64))) & np.uint64(width - 1)) + np.uint64(k * width)).astype(np.int64) for k in range(DEPTH)])


class Touched:
    """The cells that a task has touched, as rows for merge()."""

    def __init__(self, cap: int):
        self.cap, self.held, self.size = cap, [], 0

    def add(self, cells: np.ndarray, counts: np.ndarray | None = None):
        """Batches to hand on, mostly none."""
        counts = np.ones(cells.size, np.int64) if counts is None else np.broadcast_to(counts, cells.shape).reshape(-1)
        self.held.append((cells.reshape(-1), counts))
        self.size += cells.size
        if self.size > 2 * HELD_CELLS:
            self.held = [self._merged()]
            self.size = len(self.held[0][0])
            if self.size > HELD_CELLS:
                yield from self.rest()

    def _merged(self):
        cells, counts = (np.concatenate(x) for x in zip(*self.held, strict=True))
        by = np.argsort(cells)
        cells, counts = cells[by], counts[by]
        first = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]]))
        return cells[first], np.minimum(np.add.reduceat(counts, first), self.cap)

    def rest(self):
        if not self.size:
            return
        cells, counts = self._merged()
        self.held, self.size = [], 0
        slices, at = np.unique(cells // SLICE, return_index=True)
        ends = np.append(at[1:], len(cells))
        low, n = (cells % SLICE).astype("<u2"), counts.astype(np.uint8)
        for k in range(0, len(slices), 1024):  # rows of up to 48 kB each
            s = slice(k, k + 1024)
            yield pa.RecordBatch.from_arrays([pa.array(slices[s]), pa.array([low[a:b].tobytes() for a, b in zip(at[s], ends[s], strict=True)], pa.binary()), pa.array([n[a:b].tobytes() for a, b in zip(at[s], ends[s], strict=True)], pa.binary())], names=["slice", "cells", "counts"])


def merge(touched: DataFrame, width: int, thresholds: list[int]) -> list[np.ndarray]:
    """Bitmaps, one a threshold (255 at most): which cells of the sketch were counted so often over all tasks.

    They come to the driver, DEPTH * width / 8 bytes each, which does not depend on the input.
    """

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, cells, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = sums.setdefault(k, np.zeros(SLICE, np.uint8))
                at, n = np.frombuffer(cells, "<u2"), np.frombuffer(counts, np.uint8)
                own[at] = np.minimum(own[at].astype(np.uint16) + n, 255)
        for k, own in sums.items():
            bits = b"".join(np.packbits(own >= t, bitorder="little").tobytes() for t in thresholds)
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([bits], pa.binary())], names=["slice", "bits"])

    out = [np.zeros(DEPTH * width // 8, np.uint8) for _ in thresholds]
    step = SLICE // 8
    for row in touched.repartition("slice").mapInArrow(run, _MERGED).toLocalIterator():
        for t, bitmap in enumerate(out):
            bitmap[row.slice * step : (row.slice + 1) * step] = np.frombuffer(row.bits, np.uint8)[t * step : (t + 1) * step]
    return out


def found(bitmap: np.ndarray, keys: np.ndarray, width: int) -> np.ndarray:
    """For each key, whether all its cells are set; later rows are looked at only where the earlier ones are set."""
    left = np.arange(len(keys))
    for k in range(DEPTH):
        cells = ((mix64(keys[left] + np.uint64(0x9E3779B97F4A7C15 * (k + 1) % (1 << 64))) & np.uint64(width - 1)) + np.uint64(k * width)).astype(np.int64)
        left = left[(bitmap[cells >> 3] >> (cells & 7).astype(np.uint8)) & 1 == 1]
    out = np.zeros(len(keys), bool)
    out[left] = True
    return out
