"""Filters and counts of a fixed size, put together from all tasks whatever the input.

A filter is a bitmap, of ``FILTER_BITS`` at most, over hashes of numbers: it never misses a number that
was put in, and lets others pass the more often the fuller it is; what it lets pass is
checked by joins.  So it only saves work, and is sent to all tasks whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fusegrid.llm.words import mix

#: Tables travel in PIECES, and are put together by FAN groups of tasks first, so that no group holds a row of every task.
PIECES, FAN = 32, 256
FILTER_BITS = 1 << 25
#: Bits for each of few numbers.
BITS_EACH = 32
ROW = "task int, piece int, bytes binary"


def pieces(table: np.ndarray) -> list[pa.Array]:
    """(task, piece, bytes) of a task's table of a fixed size."""
    task = TaskContext.get().partitionId()
    blobs = [x.tobytes() for x in np.split(table, PIECES)]
    return [pa.array(np.full(PIECES, task, np.int32)), pa.array(np.arange(PIECES, dtype=np.int32)), pa.array(blobs, pa.binary())]


def summed(rows: DataFrame, dtype, join: Callable[[list[np.ndarray]], np.ndarray]) -> np.ndarray | None:
    """The tables of all tasks, rows of ``pieces``, put together by ``join``; None without any."""

    def one(t: pa.Table) -> pa.Table:
        held = join([np.frombuffer(x, dtype) for x in t.column("bytes").to_pylist()])
        return pa.table({"piece": t.column("piece").slice(0, 1), "bytes": pa.array([held.tobytes()], pa.binary())})

    first = rows.groupBy("piece", F.pmod("task", F.lit(FAN)).alias("fan")).applyInArrow(one, "piece int, bytes binary")
    got = dict(map(tuple, first.groupBy("piece").applyInArrow(one, "piece int, bytes binary").collect()))
    return np.concatenate([np.frombuffer(got[k], dtype) for k in range(PIECES)]) if got else None


def hashed(*columns: np.ndarray) -> np.ndarray:
    """One 64-bit number for each row of integer columns."""
    h = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        h = mix(h * np.uint64(3) ^ c.astype(np.uint64))
    return h


def filter_of(rows: DataFrame, n: int | None = None) -> np.ndarray:
    """The filter of the rows of integer columns without nulls; smaller if they are known to be ``n`` at most."""
    size = FILTER_BITS if n is None else min(FILTER_BITS, max(1 << 16, 1 << (BITS_EACH * n).bit_length()))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(size, bool)
        for b in batches:
            bits[(hashed(*(c.to_numpy() for c in b.columns)) % np.uint64(size)).astype(np.int64)] = True
        if bits.any():
            yield pa.RecordBatch.from_arrays(pieces(np.packbits(bits, bitorder="little")), ["task", "piece", "bytes"])

    out = summed(rows.mapInArrow(mark, ROW), np.uint8, np.bitwise_or.reduce)
    return np.zeros(size // 8, np.uint8) if out is None else out


def held(bits: np.ndarray, *columns: np.ndarray) -> np.ndarray:
    """Whether a filter may hold each row."""
    at = (hashed(*columns) % np.uint64(8 * len(bits))).astype(np.int64)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
