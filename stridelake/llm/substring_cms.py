"""Substring dedup: word windows that an earlier document has, found behind a count-min prefilter.

Pass 1 counts every window in partition sketches (two rows of cells, sent as
compressed lists of the cells touched) that are summed by cell range in a tree.  The
estimate, the smaller of a window's two cells, is never below its count, so that
pass 2 loses nothing when it groups, exactly, only windows estimated twice or more.
Pass 2 sends windows in packed blocks to the task of their hash range, which finds
the smallest document of each; only positions travel back to the texts.

Windows that are estimated above ``hot`` go another way: their smallest documents
are aggregated before any exchange and broadcast.  At most (windows / hot) can be
so frequent, and ``hot`` follows the corpus, which bounds that table.

The sketch has at most ``2 * MAX_CELLS`` cells, 64 MB as bits.  On corpora of far
more windows it fills up and lets more through; the result stays the same.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from stridelake.llm import countmin
from stridelake.llm.countmin import pack, unpack

MAX_CELLS = 1 << 28
ROWS = 2  # of the sketch
FLUSH = 4_000_000  # windows that a task holds
HOT_ROWS = 200_000  # most rows of the hot table
LAST = np.iinfo(np.int64).max  # stands for a null id, after all others
_C = np.random.default_rng(20240229).integers(1, 1 << 63, (2, 64), dtype=np.uint64) | np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def words_of(text: str | None) -> list[bytes]:
    """Maximal runs of bytes other than the space and 0x09-0x0D."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def window_hashes(words: list[bytes], size: int, lane: int = 0) -> np.ndarray:
    """A hash of each window, by its start: 64 bits in lane 0, 32 in lane 1; the lanes come from independent hashes of the words, and depend on their order."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint32 if lane else np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest if lane else xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out += h[k : k + n] * _C[lane, k % 64]
        if k % 64 == 63:
            out = _mix(out)
    return (_mix(out) >> np.uint64(32)).astype(np.uint32) if lane else _mix(out)


def _sketches(cells: int, size: int):
    """Each task's sketch, as rows of ``countmin.PARTS``."""

    def run(batches):
        held, n = [], 0
        for b in batches:
            for t in b.column(0):
                h = window_hashes(words_of(t.as_py()), size)
                held.append(h)
                n += len(h)
                if n > FLUSH:
                    yield countmin.as_batch(countmin.touched(np.concatenate(held), cells, ROWS))
                    held, n = [], 0
        if n:
            yield countmin.as_batch(countmin.touched(np.concatenate(held), cells, ROWS))

    return run


def _hot_owners(shared, size: int):
    """The task's smallest id of each hot window: ``(h1, h2, low)``."""

    def run(batches):
        est = shared.value
        low: dict[tuple[int, int], int] = {}
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                words = words_of(t.as_py())
                h1 = window_hashes(words, size)
                at = np.flatnonzero(est.hot_count(h1) > 0)
                if len(at):
                    h2 = window_hashes(words, size, 1)
                    for k in zip(h1[at].tolist(), h2[at].tolist()):
                        low[k] = min(i, low.get(k, LAST))
        if low:
            h = np.array([k[0] for k in low], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array([k[1] for k in low], pa.int64()), pa.array(list(low.values()), pa.int64())], names=["h1", "h2", "low"])

    return run


def _starts(shared, owners, size: int, buckets: int):
    """Pass 2.  Rows ``(bucket, block)``: packed windows for a hash range; under -1 - g, starts decided here for group g."""
    shift = np.uint64(64 - buckets.bit_length() + 1)

    def flush(held):
        h1, h2, doc, pos = (np.concatenate([x[k] for x in held[0]]) for k in range(4))
        ids, tkeys = np.array(held[1], np.int64), np.array(held[2], np.int64)
        order = np.lexsort((h2, h1))
        h1, h2, doc, pos = h1[order], h2[order], doc[order], pos[order]
        first = np.flatnonzero(np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])
        cut = np.searchsorted(h1[first], np.arange(buckets, dtype=np.uint64) << shift) if buckets > 1 else np.zeros(1, np.int64)
        cut = np.r_[cut, len(first)]
        ends = np.r_[first, len(h1)]
        for k in range(buckets):
            a, b = cut[k], cut[k + 1]
            if b > a:
                lo, hi = ends[a], ends[b]
                used, local = np.unique(doc[lo:hi], return_inverse=True)
                f = first[a:b]
                yield k, pack(h1[f], h2[f], np.diff(ends[a : b + 1]).astype(np.uint32), local.astype(np.uint32), pos[lo:hi], ids[used], tkeys[used])

    def batch(held, decided):
        rows = list(flush(held)) if held[1] else []
        if decided:
            n = [len(x[2]) for x in decided]
            i, t = (np.repeat(np.array([x[k] for x in decided], np.int64), n) for k in range(2))
            rows += [(-1 - g, raw) for g, raw in _by_document(i, t, np.concatenate([x[2] for x in decided]), buckets)]
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.int32()), pa.array([x[1] for x in rows], pa.binary())], names=["bucket", "block"])

    def run(batches):
        est, (known, low) = shared.value, owners.value
        held, n, decided = ([], [], []), 0, []
        for b in batches:
            for i, tk, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                words = words_of(t.as_py())
                h1 = window_hashes(words, size)
                want = est.repeated(h1)
                h2 = window_hashes(words, size, 1) if want.any() else np.zeros(0, np.uint32)
                if len(known) and len(h2):
                    very = np.flatnonzero(est.hot_count(h1) > 0)
                    if len(very):
                        key = np.rec.fromarrays([h1[very].view(np.int64), h2[very].astype(np.int64)], dtype=known.dtype)
                        gone = very[low[np.searchsorted(known, key)] < i]
                        if len(gone):
                            decided.append((i, tk, gone.astype(np.int32)))
                        want[very] = False
                at = np.flatnonzero(want)
                if len(at):
                    held[0].append((h1[at], h2[at], np.full(len(at), len(held[1]), np.uint32), at.astype(np.uint32)))
                    held[1].append(i)
                    held[2].append(tk)
                    n += len(at)
                if n > FLUSH // 2:
                    yield batch(held, decided)
                    held, n, decided = ([], [], []), 0, []
        if n or decided:
            yield batch(held, decided)

    return run


def _by_document(i: np.ndarray, t: np.ndarray, p: np.ndarray, groups: int):
    """Starts as ``(group, packed)``, one for each group of documents that has any."""
    order = np.lexsort((p, t, i))
    i, t, p = i[order], t[order], p[order].astype(np.uint32)
    g = (_mix(i.view(np.uint64)) % np.uint64(groups)).astype(np.int64)
    for k in np.unique(g).tolist():
        at = np.flatnonzero(g == k)
        a, b = i[at], t[at]
        first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        n = np.diff(np.r_[first, len(at)]).astype(np.uint32)
        yield k, pack(np.diff(a[first], prepend=0), b[first], n, p[at])


def _removed(groups: int):
    """Of one hash range: starts of windows that a smaller id has, packed for the groups of documents."""

    def run(key, group):
        (bucket,) = key
        if bucket.as_py() < 0:
            raw = group.column("block").combine_chunks()
            return pa.table({"g": pa.array(np.full(len(raw), -1 - bucket.as_py(), np.int32)), "starts": raw})
        blocks = [unpack(x.as_py(), np.uint64, np.uint32, np.uint32, np.uint32, np.uint32, np.int64, np.int64) for x in group.column("block")]
        h1, h2 = (np.concatenate([b[k] for b in blocks]) for k in range(2))
        low = np.concatenate([np.minimum.reduceat(b[5][b[3]], np.r_[0, np.cumsum(b[2][:-1], dtype=np.int64)]) for b in blocks])
        order = np.lexsort((h2, h1))
        a, c = h1[order], h2[order]
        first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (c[1:] != c[:-1])])
        owner = np.empty(len(h1), np.int64)
        owner[order] = np.repeat(np.minimum.reduceat(low[order], first), np.diff(np.r_[first, len(h1)]))
        at, found = 0, ([], [], [])
        for b in blocks:
            mine = np.repeat(owner[at : at + len(b[0])], b[2])
            at += len(b[0])
            gone = b[5][b[3]] > mine
            found[0].append(b[5][b[3][gone]])
            found[1].append(b[6][b[3][gone]])
            found[2].append(b[4][gone])
        rows = list(_by_document(*map(np.concatenate, found), groups))
        return pa.table({"g": pa.array([r[0] for r in rows], pa.int32()), "starts": pa.array([r[1] for r in rows], pa.binary())})

    return run


def _merged(group: pa.Table) -> pa.Table:
    """One group's starts, a row for each document."""
    i, t, p = [], [], []
    for raw in group.column("starts"):
        a, b, n, starts = unpack(raw.as_py(), np.int64, np.int64, np.uint32, np.uint32)
        i.append(np.repeat(np.cumsum(a), n))
        t.append(np.repeat(b, n))
        p.append(starts)
    i, t, p = np.concatenate(i), np.concatenate(t), np.concatenate(p).astype(np.int32)
    order = np.lexsort((p, t, i))
    i, t, p = i[order], t[order], p[order]
    first = np.flatnonzero(np.r_[True, (i[1:] != i[:-1]) | (t[1:] != t[:-1])])
    return pa.table({"id": i[first], "tkey": t[first], "at": pa.ListArray.from_arrays(pa.array(np.r_[first, len(i)].astype(np.int32)), pa.array(p))})


def kept_words(text: str | None, starts, size: int) -> tuple[int, int, bytes]:
    """Words, removed words and what is left, given the starts of windows to remove."""
    words = words_of(text)
    if starts is None or not len(starts):
        return len(words), 0, b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(np.asarray(starts) + size, len(words)), -1)
    keep = np.cumsum(edge[:-1]) == 0
    left = [w for w, k in zip(words, keep.tolist()) if k]
    return len(words), len(words) - len(left), b" ".join(left)


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 13, digest: bool = True) -> DataFrame:
    """Remove words covered by ``size``-word windows that also start in a row with a smaller key.

    Windows are judged on the input.  Returns ``key, n_words, n_removed`` and, with
    ``digest``, ``kept_sha256`` of the kept words joined by one space, else ``kept_text``.
    Keys are whole numbers.  Null, empty and blank texts have no words.  Rows with fewer than ``size`` words lose
    nothing.  Rows that share a key remove nothing from each other; a null key comes
    after all others.  Every row is returned, repeated ones as often as they occur; an
    empty table gives an empty result.
    """
    spark = docs.sparkSession
    kind = dict(docs.dtypes)[key]
    base = docs.select(F.coalesce(F.col(key).cast("bigint"), F.lit(int(LAST))).alias("id"), F.xxhash64(text).alias("tkey"), F.col(text).alias("text"))
    chars = docs.agg(F.sum(F.length(text))).first()[0] or 0
    windows = chars // 6 + 1
    cells = min(MAX_CELLS, max(countmin.RANGE, 1 << (2 * windows - 1).bit_length()))
    hot = max(4096, windows // HOT_ROWS)
    parts = base.select("text").mapInArrow(_sketches(cells, size), countmin.PARTS)
    merged = countmin.summed(parts, docs.rdd.getNumPartitions(), hot)
    est = countmin.Estimates(cells, ROWS, merged.toLocalIterator())
    shared = spark.sparkContext.broadcast(est)
    kind_of = np.dtype([("a", np.int64), ("b", np.int64)])
    known, low = np.zeros(0, kind_of), np.zeros(0, np.int64)
    if all(len(c) for c in est.hot_cells):
        found = base.select("id", "text").mapInArrow(_hot_owners(shared, size), "h1 bigint, h2 bigint, low bigint")
        rows = found.groupBy("h1", "h2").agg(F.min("low").alias("low")).toArrow()  # at most windows / hot
        known = np.rec.fromarrays([rows.column("h1").to_numpy(), rows.column("h2").to_numpy()], dtype=kind_of)
        order = np.argsort(known)
        known, low = np.asarray(known)[order], rows.column("low").to_numpy()[order]
    owners = spark.sparkContext.broadcast((known, low))
    buckets = 1 << max(4, (est.entries // 300_000).bit_length())
    blocks = base.mapInArrow(_starts(shared, owners, size, buckets), "bucket int, block binary")
    packed = blocks.groupBy("bucket").applyInArrow(_removed(buckets), "g int, starts binary")
    gone = packed.groupBy("g").applyInArrow(_merged, "id bigint, tkey bigint, at array<int>")

    def run(batches):
        for b in batches:
            n, m, out = [], [], []
            for t, s in zip(b.column(1), b.column(2)):
                total, lost, left = kept_words(t.as_py(), s.values.to_numpy() if s.is_valid else None, size)
                n.append(total)
                m.append(lost)
                out.append(hashlib.sha256(left).hexdigest() if digest else left.decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(m, pa.int64()), pa.array(out, pa.string())], names=[key, "n_words", "n_removed", last])

    last = "kept_sha256" if digest else "kept_text"
    rows = docs.select(F.col(key), F.col(text).alias("text"), F.coalesce(F.col(key).cast("bigint"), F.lit(int(LAST))).alias("id"), F.xxhash64(text).alias("tkey"))
    joined = rows.join(gone.hint("shuffle_hash"), ["id", "tkey"], "left").select(key, "text", "at")
    return joined.mapInArrow(run, f"`{key}` {kind}, n_words bigint, n_removed bigint, {last} string")
