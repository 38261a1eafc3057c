"""Counts by hash bucket in a table of fixed size: each task counts into its own table, tables are summed block by block.

A bucket's count is never below the count of anything in it, so what stays below a threshold surely is below it. Counts
stop at a limit, which keeps sums of them right up to there. How full the table is changes only how much it says.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Buckets of a table, and of a block of it. A task's table has one or two bytes for each.
BUCKETS, BLOCK = 1 << 24, 1 << 12

ROWS = "block int, at binary, counts binary"


def bucket_of(hashes: np.ndarray, buckets: int = BUCKETS) -> np.ndarray:
    """The bucket of each 64-bit hash, by its high bits."""
    return (hashes >> np.uint64(65 - buckets.bit_length())).astype(np.int64)


class Tally:
    """One task's table."""

    def __init__(self, limit: int, buckets: int = BUCKETS) -> None:
        self.limit, self.buckets = limit, buckets
        self.kind = np.uint8 if limit < 256 else np.uint16
        self.counts = np.zeros(buckets, self.kind)

    def add(self, hashes: np.ndarray) -> None:
        at, n = np.unique(bucket_of(hashes, self.buckets), return_counts=True)
        self.counts[at] = np.minimum(self.counts[at] + np.minimum(n, self.limit), self.limit)

    def rows(self) -> pa.RecordBatch:
        """The blocks that hold anything: positions and counts of their buckets."""
        table = self.counts.reshape(-1, min(BLOCK, self.buckets))
        blocks = np.flatnonzero(table.any(axis=1))
        places = [np.flatnonzero(table[b]).astype("<u2") for b in blocks]
        return pa.RecordBatch.from_arrays(
            [pa.array(blocks, pa.int32()), pa.array([p.tobytes() for p in places], pa.binary()), pa.array([table[b][p].astype("<u2").tobytes() for b, p in zip(blocks, places)], pa.binary())],
            ["block", "at", "counts"],
        )


def _summed(rows: DataFrame, limit: int, buckets: int, sent) -> dict[int, bytes]:
    """What ``sent`` makes of the sums of each block that has any, stopped at the limit; done where the blocks are."""
    size = min(BLOCK, buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, at, counts in zip(*(batch[c].to_pylist() for c in ("block", "at", "counts"))):
                sums = held.setdefault(block, np.zeros(size, np.uint16))
                places = np.frombuffer(at, "<u2")
                sums[places] = np.minimum(sums[places].astype(np.int64) + np.frombuffer(counts, "<u2"), limit)
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([sent(s) for s in held.values()], pa.binary())], ["block", "said"])

    found = rows.repartition("block").mapInArrow(run, "block int, said binary").toArrow()
    return dict(zip(found["block"].to_pylist(), found["said"].to_pylist()))


def table(rows: DataFrame, limit: int, buckets: int = BUCKETS) -> np.ndarray:
    """The sum of all tasks' tables, stopped at the limit; one or two bytes a bucket come to the driver."""
    kind = np.dtype(np.uint8 if limit < 256 else np.uint16)
    out = np.zeros((-(-buckets // BLOCK), min(BLOCK, buckets)), kind)
    for block, said in _summed(rows, limit, buckets, lambda sums: sums.astype(kind).tobytes()).items():
        out[block] = np.frombuffer(said, kind)
    return out.reshape(-1)


def bitmap(rows: DataFrame, least: int, buckets: int = BUCKETS) -> np.ndarray:
    """A bit for each bucket: whether its count reaches ``least``. Only the bits come to the driver."""
    out = np.zeros((-(-buckets // BLOCK), min(BLOCK, buckets) // 8), np.uint8)
    for block, said in _summed(rows, least, buckets, lambda sums: np.packbits(sums >= least).tobytes()).items():
        out[block] = np.frombuffer(said, np.uint8)
    return out.reshape(-1)


def marked(bits: np.ndarray, hashes: np.ndarray, buckets: int = BUCKETS) -> np.ndarray:
    """Whether the buckets of the hashes have their bit."""
    at = bucket_of(hashes, buckets)
    return (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
