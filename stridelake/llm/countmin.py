"""Count-min sketches of 64-bit hashes, summed over partitions in a tree.

A task sends the cells that it touched, by ranges, as packed lists.  Lists of a range are
added ``FAN`` tasks at a time, so that no task holds the lists of all others, however many
there are.  What comes out is bounded: a bit for each cell and the cells at or above a count.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

RANGE = 1 << 22  # cells that one task adds up at a time
FAN = 32  # tasks whose lists are added at once
PARTS = "part int, src int, touched binary"


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as byte planes, compressed."""
    head = np.array([len(arrays), *(len(a) for a in arrays), *(a.dtype.itemsize for a in arrays)], dtype="<i8").tobytes()
    planes = b"".join(np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.dtype.itemsize).T).tobytes() for a in arrays)
    return zstandard.ZstdCompressor(level=1).compress(head + planes)


def unpack(raw: bytes, *kinds) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(raw)
    k = len(kinds)
    head = np.frombuffer(raw, dtype="<i8", count=1 + 2 * k)
    out, at = [], 8 * (1 + 2 * k)
    for n, size, kind in zip(head[1 : 1 + k], head[1 + k :], kinds):
        part = np.frombuffer(raw, dtype=np.uint8, count=n * size, offset=at)
        out.append(np.ascontiguousarray(part.reshape(size, n).T).view(kind).ravel())
        at += int(n * size)
    return out


def cells_of(h: np.ndarray, cells: int, rows: int) -> list[np.ndarray]:
    """The cell of each hash in each of the sketch's rows; ``cells`` is a power of two."""
    return [((h >> np.uint64(32 * row)) & np.uint64(cells - 1)).astype(np.int64) for row in range(rows)]


def touched(h: np.ndarray, cells: int, rows: int) -> list[tuple[int, bytes]]:
    """``(part, list)`` of the ranges that the hashes fall into."""
    ranges = -(-cells // RANGE)
    out = []
    for row, c in enumerate(cells_of(h, cells, rows)):
        c.sort()
        first = np.flatnonzero(np.r_[True, c[1:] != c[:-1]]) if len(c) else np.zeros(0, np.int64)
        n = np.diff(np.r_[first, len(c)]).astype(np.uint64)
        c = c[first]
        cuts = np.searchsorted(c, np.arange(ranges + 1) * RANGE)
        for k in range(ranges):
            a, b = cuts[k], cuts[k + 1]
            if b > a:
                out.append((row * ranges + k, _list(c[a:b] - k * RANGE, n[a:b])))
    return out


def _list(at: np.ndarray, n: np.ndarray) -> bytes:
    kind = np.uint8 if n.max() < 256 else np.uint64
    return pack(np.diff(at, prepend=0).astype(np.uint32), n.astype(kind))


def as_batch(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    """Rows of ``PARTS`` of the running task."""
    src = TaskContext.get().partitionId()
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([src] * len(rows), pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["part", "src", "touched"])


def _added(group: pa.Table) -> np.ndarray:
    count = np.zeros(RANGE, dtype=np.uint64)
    for raw in group.column("touched"):
        raw = raw.as_py()
        wide = int(np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), "<i8", 5)[4]) == 8
        step, n = unpack(raw, np.uint32, np.uint64 if wide else np.uint8)
        count[np.cumsum(step, dtype=np.int64)] += n
    return count


def summed(parts: DataFrame, tasks: int, hot: int) -> DataFrame:
    """``part, bits, hot, counts, n`` of the sum of ``parts``, which ``tasks`` tasks made.

    ``bits`` has a bit for each cell counted twice or more, ``hot`` the cells counted ``hot`` times
    or more with their ``counts``, ``n`` what the cells counted twice or more add up to.
    """

    def again(key, group):
        count = _added(group)
        at = np.flatnonzero(count)
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "src": pa.array([key[1].as_py()], pa.int32()), "touched": pa.array([_list(at, count[at])], pa.binary())})

    def last(key, group):
        count = _added(group)
        at = np.flatnonzero(count >= hot).astype(np.int64)
        bits = np.packbits(count >= 2, bitorder="little").tobytes()
        packed = zstandard.ZstdCompressor(level=1).compress(bits)
        cols = {"part": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([packed], pa.binary()), "hot": pa.array([at.tobytes()], pa.binary())}
        return pa.table(cols | {"counts": pa.array([count[at].tobytes()], pa.binary()), "n": pa.array([int(count[count >= 2].sum())], pa.int64())})

    while tasks > FAN:
        parts = parts.withColumn("src", F.floor(F.col("src") / FAN).cast("int")).groupBy("part", "src").applyInArrow(again, PARTS)
        tasks = -(-tasks // FAN)
    return parts.groupBy("part").applyInArrow(last, "part int, bits binary, hot binary, counts binary, n bigint")


class Estimates:
    """A summed sketch of ``rows`` rows of ``cells`` cells; no estimate is below its hash's count."""

    def __init__(self, cells: int, rows: int, found):
        ranges, width = -(-cells // RANGE), RANGE // 8
        self.cells, self.rows = cells, rows
        self.bits = [np.zeros(ranges * width, np.uint8) for _ in range(rows)]
        hot = [([], []) for _ in range(rows)]
        self.entries = 0
        for r in found:
            row, k = divmod(r["part"], ranges)
            self.bits[row][k * width : (k + 1) * width] = np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(r["bits"])), np.uint8)
            hot[row][0].append(np.frombuffer(bytes(r["hot"]), np.int64) + k * RANGE)
            hot[row][1].append(np.frombuffer(bytes(r["counts"]), np.uint64))
            self.entries += r["n"] * (row == 0)
        self.hot_cells, self.hot_counts = [], []
        for at, n in hot:
            at, n = (np.concatenate(at), np.concatenate(n)) if at else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
            order = np.argsort(at)
            self.hot_cells.append(at[order])
            self.hot_counts.append(n[order])

    def repeated(self, h: np.ndarray) -> np.ndarray:
        """Whether each hash is estimated at two or more."""
        out = np.ones(len(h), bool)
        for bits, c in zip(self.bits, cells_of(h, self.cells, self.rows)):
            out &= (bits[c >> 3] >> (c & 7).astype(np.uint8) & 1).astype(bool)
        return out

    def hot_count(self, h: np.ndarray) -> np.ndarray:
        """Each hash's estimate if it is at the hot count or above, else 0."""
        out = np.full(len(h), np.iinfo(np.uint64).max, np.uint64)
        for known, n, c in zip(self.hot_cells, self.hot_counts, cells_of(h, self.cells, self.rows)):
            if not len(known):
                return np.zeros(len(h), np.uint64)
            at = np.minimum(np.searchsorted(known, c), len(known) - 1)
            out = np.minimum(out, np.where(known[at] == c, n[at], np.uint64(0)))
        return out
