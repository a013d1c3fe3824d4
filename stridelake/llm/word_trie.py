"""Importance resampling towards a target's distribution of hashed word n-grams, by word tries.

A feature is a run of one to three words, its bucket the CRC-32 of its bytes.  Each task
puts its texts into bounded tries of three levels: a node is a run, holds how often it occurs
and the CRC after it, which follows from its parent's by a table for the length of the last
word.  Pass 1 adds the counts up by bucket, over all tasks; a bucket's gain is the scaled log ratio of its
smoothed shares in target and corpus.  Pass 2 builds the tries again, with gains at their
nodes, and a document's weight is what its paths collect.  Texts never move.

The draw takes the highest of weight plus Gumbel noise, which is hashed from the key; ranks are
counted by ranges of the score, so that no task sorts all documents.
"""

from __future__ import annotations

import math
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from stridelake.operators.scratch import Scratch

BUCKETS = 10_000
NODES = 400_000  # words that a trie is built from
PIECE = 1 << 20  # bytes of a text that are split at a time
#: Bytes of a text as words see them: A-Z in lower case, whatever stands between words a space.
SEEN = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def _zeros(length: int) -> np.ndarray:
    """Tables, for each byte of a CRC, of what it becomes after ``length`` zero bytes."""
    one = lambda x: zlib.crc32(bytes(length), x) ^ zlib.crc32(bytes(length))  # noqa: E731  linear in x
    bits = [one(1 << k) for k in range(32)]
    table = np.zeros((4, 256), np.uint32)
    for b in range(4):
        for k in range(8):
            table[b, 1 << k : 2 << k] = table[b, : 1 << k] ^ np.uint32(bits[8 * b + k])
    return table


class _Tables(dict):
    def __missing__(self, length: int) -> np.ndarray:
        got = self[length] = _zeros(length)
        return got


_TABLES = _Tables()


def extended(crc: np.ndarray, lengths: np.ndarray, tails: np.ndarray) -> np.ndarray:
    """CRCs of texts that go on, by tails of known lengths and CRCs."""
    out = np.empty(len(crc), np.uint32)
    order = np.argsort(lengths, kind="stable")
    cuts = np.flatnonzero(np.r_[True, np.diff(lengths[order]) != 0, True]) if len(order) else np.zeros(1, np.int64)
    for a, b in zip(cuts[:-1], cuts[1:]):
        at = order[a:b]
        t, c = _TABLES[int(lengths[at[0]])], crc[at]
        out[at] = t[0][c & 255] ^ t[1][c >> 8 & 255] ^ t[2][c >> 16 & 255] ^ t[3][c >> 24]
    return out ^ tails


class _Words(dict):
    """Numbers of words, with lengths and CRCs, alone and after a space."""

    def __init__(self):
        super().__init__()
        self.alone, self.after, self.size = array("L"), array("L"), array("q")

    def __missing__(self, word: bytes) -> int:
        self.alone.append(zlib.crc32(word))
        self.after.append(zlib.crc32(b" " + word))
        self.size.append(len(word) + 1)
        n = self[word] = len(self)
        return n


class Trie:
    """Runs of up to three words of some documents: nodes by level with counts and CRCs.

    ``words`` come with the number of their stretch, which no run leaves, and whether they are
    ``new``; those that aren't only precede new ones.
    """

    def __init__(self, table: _Words, words: np.ndarray, stretch: np.ndarray, new: np.ndarray):
        n = np.int64(max(len(table), 1))
        alone, after, size = np.array(table.alone, np.uint32), np.array(table.after, np.uint32), np.array(table.size, np.int64)
        one = np.flatnonzero(new)
        self.levels = [(np.bincount(words[one], minlength=len(table)), alone, one, words[one])]
        two = np.flatnonzero(stretch[1:] == stretch[:-1]) + 1  # where a run of two ends, new or not: it has children
        keys, node = np.unique(words[two - 1] * n + words[two], return_inverse=True)
        first, last = keys // n, keys % n
        crc = extended(alone[first], size[last], after[last])
        own = new[two]
        self.levels.append((np.bincount(node[own], minlength=len(keys)), crc, two[own], node[own]))
        parent = np.full(len(words), -1, np.int64)
        parent[two] = node
        three = two[1:][(np.diff(two) == 1) & (stretch[two[1:]] == stretch[two[1:] - 2])] if len(two) else two
        three = three[new[three]]
        keys, node = np.unique(parent[three - 1] * n + words[three], return_inverse=True)
        above, last = keys // n, keys % n
        self.levels.append((np.bincount(node, minlength=len(keys)), extended(crc[above], size[last], after[last]), three, node))

    def totals(self, buckets: int) -> np.ndarray:
        """Occurrences by bucket."""
        out = np.zeros(buckets, np.int64)
        for count, crc, _, _ in self.levels:
            out += np.bincount(crc % np.uint32(buckets), weights=count, minlength=buckets).astype(np.int64)
        return out

    def collect(self, gains: np.ndarray, doc: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
        """Features of each document, and the gains on the nodes of its paths."""
        n, total = np.zeros(docs, np.int64), np.zeros(docs, np.int64)
        for _, crc, at, node in self.levels:
            n += np.bincount(doc[at], minlength=docs)
            total += np.bincount(doc[at], weights=gains[crc % np.uint32(len(gains))][node], minlength=docs).astype(np.int64)
        return n, total


def _pieces(text: str | None):
    """Lists of words of a text, about ``PIECE`` bytes at a time."""
    seen = (text or "").encode("utf-8", "surrogatepass").translate(SEEN)
    at = 0
    while at < len(seen):
        end = seen.find(b" ", at + PIECE)
        end = len(seen) if end < 0 else end
        yield seen[at:end].split()
        at = end


def tries(texts, nodes: int = NODES):
    """``(trie, documents of its words)`` over ``texts``, each built from about ``nodes`` words.

    A long text comes in stretches, each after a copy of the two words before it.
    """
    table, held, doc, new, n = _Words(), [], [], [], 0

    def built():
        stretch = np.repeat(np.arange(len(held)), [len(h) for h in held])
        return Trie(table, np.concatenate(held), stretch, np.concatenate(new)), np.array(doc, np.int64)[stretch]

    for i, text in enumerate(texts):
        before: list[bytes] = []
        for piece in _pieces(text):
            for at in range(0, len(piece), nodes):
                part = before + piece[at : at + nodes]
                held.append(np.fromiter(map(table.__getitem__, part), np.int64, len(part)))
                doc.append(i)
                new.append(np.arange(len(part)) >= len(before))
                n += len(part)
                if n >= nodes:
                    yield built()
                    table, held, doc, new, n = _Words(), [], [], [], 0
                before = part[-2:]  # what a next part's first runs begin with
    if n:
        yield built()


def bucket_totals(texts: DataFrame, buckets: int) -> np.ndarray:
    """Features by bucket of the one column of ``texts``; tasks send sums of what they have."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for trie, _ in tries(t.as_py() for t in b.column(0)):
                total += trie.totals(buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in texts.mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # ``buckets`` rows at most
        out[r["bucket"]] = r["n"]
    return out


def gains_of(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A bucket's gain in thousandths of a nat, floored."""
    s, t = float(corpus.sum() + len(corpus)), float(target.sum() + len(target))
    return np.array([math.floor(1000 * math.log((float(b) + 1) * s / ((float(a) + 1) * t))) for a, b in zip(corpus, target)], np.int64)


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: str = "42", key: str = "doc_id", text: str = "text", target_text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """``key, n_features, weight, score, rank, n_words``: how much each document is like the target, and its place in the draw.

    Of the documents with ``least_words`` or more words, ``percent`` in a hundred (floored) are
    drawn, those with the highest scores, ties by key (nulls last); others have a null rank.  Every row is returned, and
    rows that repeat a key and a text take places side by side.  Null and empty texts have no features and weight 0;
    a null key draws as an empty one.  An empty target or an empty table is a table without features.
    """
    scratch = Scratch(docs.sparkSession, "resample")
    gains = docs.sparkSession.sparkContext.broadcast(gains_of(bucket_totals(docs.select(text), buckets), bucket_totals(target.select(target_text), buckets)))  # ``buckets`` longs
    kind = dict(docs.dtypes)[key]

    def run(batches):
        for b in batches:
            m = b.num_rows
            n, weight, count = np.zeros(m, np.int64), np.zeros(m, np.int64), np.zeros(m, np.int64)
            for trie, doc in tries(t.as_py() for t in b.column(1)):
                a, w = trie.collect(gains.value, doc, m)
                n, weight = n + a, weight + w
                count += np.bincount(doc[trie.levels[0][2]], minlength=m)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x) for x in (n, weight, count))], names=["key", "n_features", "weight", "n_words"])

    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("key").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    scored = docs.select(F.col(key).alias("key"), F.col(text).alias("t")).mapInArrow(run, f"key {kind}, n_features bigint, weight bigint, n_words bigint")
    scored = scratch.keep(scored.withColumn("score", F.col("weight") + noise), "scored")
    order = [F.desc("score"), F.asc_nulls_last("key")]
    most = scored.where(F.col("n_words") >= least_words).count() * percent // 100
    ranged = scored.where(F.col("n_words") >= least_words).repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    ranged = scratch.keep(ranged, "ranged")
    parts = ranged.groupBy("part").agg(F.count("*").alias("n"))  # a row for each range
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(*order)) + F.col("before")
    ranked = ranged.join(F.broadcast(before), "part").withColumn("place", place).withColumn("rank", F.when(F.col("place") <= most, F.col("place")).cast("bigint"))
    both = ranked.select(*scored.columns, "rank").unionByName(scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("bigint")))
    return both.select(F.col("key").alias(key), "n_features", "weight", "score", "rank", "n_words")
