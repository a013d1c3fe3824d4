"""SimHash near-duplicates: fingerprints, BK-trees in shards, components.

A pair within the radius agrees on at least one of ``radius + 1`` bit blocks, so
the distinct fingerprints are dealt into shards by (block, its bits); each shard
gets a BK-tree whose children are keyed by their Hamming distance to the parent,
and a search follows only edges within the radius of the distance at hand.  No
pair is lost and none is emitted: a shard reports, for each fingerprint, the
smallest one that it reaches inside the shard.

Trees are delivered to the tasks that hold the matching queries by the shard
exchange, not by a broadcast to all: the trees together grow with the corpus.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from stridelake.operators.graph import connected_components
from stridelake.operators.scratch import Scratch

SEED = 42
BLOCK = 2048  # queries that walk a tree together
SHARD = 100_000  # fingerprints whose trees are built together
CHUNK = 50_000  # fingerprints of a shard; one with more is searched in pairs of so many


def fingerprint(text: str | None, words: int = 3) -> int:
    """64-bit SimHash of the text's word shingles, repeats included; 0 without words."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    shingles = [b" ".join(w)] if len(w) < words else list(map(b" ".join, zip(*(w[i:] for i in range(words)))))
    n = len(shingles)
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 65536):  # whatever the text's length, so many at once
        part = shingles[at : at + 65536]
        h = np.fromiter((digest(s, SEED) for s in part), dtype="<u8", count=len(part))
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """``key, fp`` for every row, ``fp`` a signed 64-bit long; a narrow scan of two columns."""

    def run(batches):
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py(), words) for t in batch.column(1)), dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=[key, "fp"])

    kind = dict(docs.dtypes)[key]
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, fp bigint")


class BKForest:
    """One BK-tree per shard over ``fp``, which is sorted by ``shard``; built level by level.

    ``fp`` holds one 64-bit word a node, or a row of several.
    ``edge[i]`` is the node's Hamming distance to its parent.  Children are found by
    binary search in ``slots``, which holds ``parent * span + edge`` in order.
    """

    def __init__(self, shard: np.ndarray, fp: np.ndarray):
        n = len(fp)
        self.fp = fp = fp.reshape(n, -1)
        self.span = 64 * fp.shape[1] + 1 if n else 65
        first = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]) if n else np.zeros(0, np.int64)
        self.root = np.repeat(first, np.diff(np.r_[first, n]))
        at = self.root.copy()
        left = np.setdiff1d(np.arange(n), first, assume_unique=True)
        slots, child = [], []
        while len(left):
            key = at[left] * self.span + self._apart(left, at[left])
            taken, where, back = np.unique(key, return_index=True, return_inverse=True)
            slots.append(taken)
            child.append(left[where])
            at[left] = left[where][back]
            left = np.delete(left, where)
        key = np.concatenate(slots) if slots else np.zeros(0, np.int64)
        order = np.argsort(key)
        self.slots, self.child = key[order], (np.concatenate(child) if child else np.zeros(0, np.int64))[order]

    def _apart(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return np.bitwise_count(self.fp[i] ^ self.fp[j]).sum(axis=1, dtype=np.int64)

    def within(self, query: np.ndarray, radius: int):
        """Pairs ``(i, j)`` of nodes at most ``radius`` apart, for ``i`` in ``query``; walks all trees together."""
        i, j, found = query, self.root[query], []
        while len(i):
            d = self._apart(i, j)
            hit = d <= radius
            found.append((i[hit], j[hit]))
            low = np.searchsorted(self.slots, j * self.span + np.maximum(d - radius, 0), "left")
            n = np.searchsorted(self.slots, j * self.span + np.minimum(d + radius, self.span - 1), "right") - low
            i = np.repeat(i, n)
            j = self.child[np.repeat(low - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(len(i))]
        return tuple(map(np.concatenate, zip(*found))) if found else (query[:0], query[:0])


def _shard_links(shard: np.ndarray, fp: np.ndarray, radius: int):
    """For each node the smallest node that it reaches; only nodes that reach a smaller one."""
    forest = BKForest(shard, fp)
    n = len(fp)
    kept_i, kept_j = [], []
    for at in range(0, n, BLOCK):
        i, j = forest.within(np.arange(at, min(n, at + BLOCK)), radius)
        keep = j < i
        i, j = i[keep], j[keep]
        if len(i):
            kept_i.append(i)
            kept_j.append(j)
            if sum(map(len, kept_i)) > 8 * BLOCK * 64:
                kept_i, kept_j = _thinned(kept_i, kept_j, n)
    label = _labels(kept_i, kept_j, n)
    out = np.flatnonzero(label < np.arange(n))
    return fp[out], fp[label[out]]


def _labels(kept_i: list, kept_j: list, n: int) -> np.ndarray:
    """Smallest reachable index by hooking and pointer jumping."""
    label = np.arange(n)
    if not kept_i:
        return label
    i, j = np.concatenate(kept_i), np.concatenate(kept_j)
    while True:
        a, b = label[i], label[j]
        low = np.minimum(a, b)
        if (a == b).all():
            return label
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        while (label[label] != label).any():
            label = label[label]


def _thinned(kept_i: list, kept_j: list, n: int):
    """As few links with the same components."""
    label = _labels(kept_i, kept_j, n)
    i = np.flatnonzero(label < np.arange(n))
    return [i], [label[i]]


def links(fps: DataFrame, scratch: Scratch, radius: int = 3) -> DataFrame:
    """``(a, b)``: enough links to tell the components of distinct fingerprints ``fps(fp)``.

    Exact for every radius below 16.  A shard with more than ``CHUNK`` fingerprints is cut
    into parts, each pair of which has trees of its own.  The result is at most one row for each
    fingerprint and block.
    """
    blocks = radius + 1
    cuts = [round(64 * k / blocks) for k in range(blocks + 1)]
    keys = F.array(*(F.struct(F.lit(k).alias("block"), F.expr(f"shiftrightunsigned(fp, {cuts[k]}) & {(1 << (cuts[k + 1] - cuts[k])) - 1}L").alias("bits")) for k in range(blocks)))
    dealt = fps.select("fp", F.explode(keys).alias("s")).select((F.col("s.bits") * 16 + F.col("s.block")).alias("shard"), "fp")
    hot = dealt.groupBy("shard").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("c")).where("c > 1").withColumnRenamed("shard", "hot")
    hot = scratch.keep(hot, "hot")
    own = F.pmod(F.xxhash64("fp"), F.col("c")).cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("c") - 1), lambda o: o != own)  # a part meets itself there, too
    split = dealt.join(hot, F.col("shard") == F.col("hot")).withColumn("o", F.explode(others))
    split = split.select(F.xxhash64("shard", F.least("o", own), F.greatest("o", own)).alias("shard"), "fp")
    dealt = dealt.join(hot, F.col("shard") == F.col("hot"), "left_anti").unionByName(split)

    def run(batches):
        def emit(shard, fp):
            a, b = _shard_links(shard, fp.view(np.uint64), radius)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        shard, fp = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            shard = np.r_[shard, batch.column(0).to_numpy()]
            fp = np.r_[fp, batch.column(1).to_numpy()]
            if len(shard) > SHARD:
                cut = np.searchsorted(shard, shard[-1])  # the last shard may go on
                if cut:
                    yield emit(shard[:cut], fp[:cut])
                    shard, fp = shard[cut:], fp[cut:]
        if len(shard):
            yield emit(shard, fp)

    return dealt.repartition("shard").sortWithinPartitions("shard", "fp").mapInArrow(run, "a bigint, b bigint")


def simhash_components(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3, radius: int = 3) -> DataFrame:
    """``key, fingerprint, component_id`` for every row of ``docs``.

    ``fingerprint`` is 16 hex digits; rows link when at most ``radius`` bits differ,
    and ``component_id`` is the smallest key reachable, the row's own included.
    Null, empty and blank texts have fingerprint zero and link like any other.  A
    null key never names a component: such a row gets the smallest non-null key of
    its component, or null if there is none.  Repeated rows are returned as often as
    they occur.  An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    fps = scratch.keep(fingerprints(docs, key, text, words), "fingerprints")
    classes = scratch.keep(fps.groupBy("fp").agg(F.min(key).alias("low")), "classes")
    parts = connected_components(links(classes.select("fp"), scratch, radius), scratch)
    merged = classes.join(parts, F.col("fp") == F.col("id"), "left").select("fp", "low", F.coalesce("component", "fp").alias("component"))
    merged = scratch.keep(merged, "merged")
    lows = merged.groupBy("component").agg(F.min("low").alias("component_id"))
    named = scratch.keep(merged.join(lows, "component").select("fp", "component_id"), "named")
    scratch.drop(classes, merged)
    return fps.join(named, "fp").select(key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3, radius: int = 3) -> DataFrame:
    """Rows of ``docs`` whose key is the smallest of their component; all columns pass through.

    Of rows that repeat the smallest key all stay.  Rows with a null key stay only
    if no row of their component has a key.
    """
    groups = simhash_components(docs, key, text, words, radius)
    kept = groups.where(F.col(key).eqNullSafe(F.col("component_id"))).select(F.col(key).alias("__kept")).distinct()
    return docs.join(kept, docs[key].eqNullSafe(kept["__kept"]), "left_semi")
