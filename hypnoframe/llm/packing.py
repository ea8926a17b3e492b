"""Bounded-space online best-fit packing of pieces into fixed-length sequences."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hypnoframe.llm.store import settled


class BestFit:
    """Open bins keyed by free space.

    ``mask`` has bit f set while some open bin has f free places, so the tightest
    bin for a piece is the lowest set bit at or above the piece's length.  When
    ``open_bins`` are open and none fits, the fullest (lowest bit of all) closes.
    """

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.open_bins = capacity, open_bins
        self.mask, self.by_free, self.n_open, self.n = 0, [[] for _ in range(capacity + 1)], 0, 0

    def _take(self, free: int) -> int:
        number = self.by_free[free].pop()
        if not self.by_free[free]:
            self.mask &= ~(1 << free)
        self.n_open -= 1
        return number

    def put(self, length: int) -> tuple[int, int]:
        """Bin number and offset of a piece of 1 to ``capacity`` ids."""
        fits = self.mask >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            number = self._take(free)
        else:
            if self.n_open >= self.open_bins:
                self._take((self.mask & -self.mask).bit_length() - 1)
            number, free = self.n, self.capacity
            self.n += 1
        left = free - length
        if left:
            self.by_free[left].append(number)
            self.mask |= 1 << left
            self.n_open += 1
        return number, self.capacity - free


def pack(pieces: DataFrame, capacity: int = 4096, open_bins: int = 1024, per_packer: int = 100_000) -> DataFrame:
    """Adds sequence_id and offset to ``pieces`` (any columns, with ``length`` from 1 to capacity).

    Pieces are dealt by hash to packers of about ``per_packer`` pieces, each of
    which packs its own in one pass with ``open_bins`` open bins; at most that many
    sequences a packer stay partly filled, so packers are as few as memory allows.
    Pieces arrive in the order of a hash of their row, which a retried task repeats.
    Equal rows are packed each on their own; no rows give no rows.  An added column
    replaces one of the same name.
    """
    pieces = settled(pieces, "pieces")
    packers = max(1, math.ceil(pieces.count() / per_packer))
    keys = [c for c in pieces.columns if c != "ids"]
    order = F.xxhash64(*keys)
    fields = [f for f in pieces.schema.fields if f.name not in ("sequence_id", "offset")]
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fit, first = BestFit(capacity, open_bins), TaskContext.get().partitionId() << 36
        for b in batches:
            placed = [fit.put(x) for x in b.column("length").to_pylist()]
            got = np.array(placed, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(got[:, 0] + first), pa.array(got[:, 1])], names=[*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", sequence_id long, offset long"
    return pieces.select(*names).repartition(packers, order).sortWithinPartitions(order, *[c for c in keys if c in names]).mapInArrow(run, schema)
