"""p-stable hashing of vectors: near-duplicate links and nearest neighbours.

A hash is ``floor((a.x + b) / w)`` with Gaussian ``a``; ``k`` of them make a bucket and
several independent sets of ``k`` make tables.  Seeds are fixed, so that every task has
the same tables.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from stridelake.llm import streams
from stridelake.operators.graph import connected_components
from stridelake.operators.scratch import Scratch


class Tables:
    """``tables`` sets of ``k`` quantised Gaussian projections of ``dim`` numbers."""

    def __init__(self, dim: int, k: int, width: float, tables: int, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.k, self.width, self.n = k, width, tables
        self.a = rng.standard_normal((tables, dim, k))
        self.b = rng.uniform(0, width, (tables, 1, k))
        self.radix = np.array([1_000_003**i % (1 << 61) for i in range(k)], dtype=np.int64)

    def place(self, x: np.ndarray, t: int) -> np.ndarray:
        """Where rows fall on table ``t``'s lines, in bucket widths."""
        return (x @ self.a[t] + self.b[t]) / self.width

    def key(self, cell: np.ndarray) -> np.ndarray:
        """One integer for ``k`` cell numbers; linear, so that a shifted cell's key is a shifted key."""
        with np.errstate(over="ignore"):
            return (cell.astype(np.int64) * self.radix).sum(axis=-1)

    def keys(self, x: np.ndarray) -> np.ndarray:
        return np.stack([self.key(np.floor(self.place(x, t))) for t in range(self.n)], axis=1)


def _usable(vector: str):
    """A non-empty vector without nulls, NaN or infinities that isn't all zeros."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.ListArray) -> np.ndarray:
    """Rows of equal length as doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


# ---- near-duplicates

CHUNK = 2048  # vectors of a bucket or a cluster that one task compares with as many
PAIRS = 1_000_000  # pairs that are looked at together
SEEN = 50_000  # vectors that a task remembers, so that copies are sent once
APART = 16  # of 64 sign bits; at a cosine of 0.98 four differ on average, seventeen once in a million pairs


def _chunked(members: DataFrame, chunks, by: str) -> DataFrame:
    """``members`` with ``g``, a group of two chunks of what ``by`` names, or of one; ``own`` and ``across`` tell the chunks apart."""
    own = F.pmod(F.xxhash64("node"), chunks.cast("int")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), chunks.cast("int") - 1), lambda o: F.struct(F.least(o, F.col("own")).alias("p"), F.greatest(o, F.col("own")).alias("q")))
    dealt = members.withColumn("own", own).withColumn("pq", F.explode(pairs))
    return dealt.withColumn("g", F.xxhash64(by, "pq")).withColumn("across", F.expr("pq.p != pq.q")).drop("pq")


def _buckets(tables: int, k: int, width: float):
    """``g, node, signs``: each vector's bucket in every table, and the signs of 64 projections."""

    def run(batches):
        made: dict[int, tuple[Tables, np.ndarray]] = {}
        seen: set[int] = set()
        for b in batches:
            node, label = b.column("node").to_numpy(), b.column("label").to_numpy().view(np.uint64)
            fresh = np.zeros(len(node), bool)
            for i, v in enumerate(node.tolist()):
                if v not in seen:
                    fresh[i] = True
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(v)
            lengths = b.column("x").value_lengths().to_numpy()
            for d in np.unique(lengths[fresh]).tolist():
                at = np.flatnonzero(fresh & (lengths == d))
                x = _matrix(b.column("x").take(pa.array(at)))
                x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
                if d not in made:
                    made[d] = Tables(d, k, width, tables), np.random.default_rng(17).standard_normal((d, 64))
                hashing, signs = made[d]
                with np.errstate(over="ignore"):
                    salt = label[at] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(d)
                    key = hashing.keys(x).view(np.uint64) + salt[:, None] + np.arange(tables, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
                    key = (key ^ key >> np.uint64(32)) * np.uint64(0xC4CEB9FE1A85EC53)
                word = np.packbits(x @ signs > 0, axis=1, bitorder="little").view("<i8").ravel()
                cols = [pa.array((key ^ key >> np.uint64(29)).view(np.int64).ravel()), pa.array(np.repeat(node[at], tables)), pa.array(np.repeat(word, tables))]
                yield pa.RecordBatch.from_arrays(cols, names=["g", "node", "signs"])

    return run


def _forest(i: np.ndarray, j: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """As few links with the same components, by hooking and pointer jumping."""
    label = np.arange(n)
    while len(i):
        a, b = label[i], label[j]
        low = np.minimum(a, b)
        if (a == b).all():
            break
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        while (label[label] != label).any():
            label = label[label]
    at = np.flatnonzero(label < np.arange(n))
    return at, label[at]


def _maybe(batches):
    """``a, b``: a forest of the vectors that share a bucket and most signs."""
    for table, _ in streams.runs(batches, "g", 100_000):
        g, node, signs = (table.column(c).to_numpy() for c in ("g", "node", "signs"))
        new = np.r_[True, (g[1:] != g[:-1]) | (node[1:] != node[:-1])]  # a vector once, however many tasks sent it
        g, node, signs = g[new], node[new], signs[new].view(np.uint64)
        names, back = np.unique(node, return_inverse=True)
        first = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
        start = np.repeat(first, np.diff(np.r_[first, len(g)]))
        ends = np.cumsum(np.arange(len(g)) - start)  # pairs of a row and an earlier one of its group
        at, i, j = 0, np.zeros(0, np.int64), np.zeros(0, np.int64)
        while at < len(g):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
            count = np.arange(at, to) - start[at:to]
            p = np.repeat(np.arange(at, to), count)
            q = start[p] + np.arange(len(p)) - np.repeat(np.cumsum(count) - count, count)
            near = np.bitwise_count(signs[p] ^ signs[q]) <= APART
            i, j = np.r_[i, back[p[near]]], np.r_[j, back[q[near]]]
            if len(i) > 4 * PAIRS:
                i, j = _forest(i, j, len(names))
            at = to
        i, j = _forest(i, j, len(names))
        if len(i):
            yield pa.RecordBatch.from_arrays([pa.array(names[i]), pa.array(names[j])], names=["a", "b"])


def _compared(threshold: float):
    """``a, b, links`` of each group: rows linked with ``a``, and edges enough for the components; similarities are exact."""

    def one(node, n, label, x, half):
        m = len(node)
        links, edges = np.zeros(m, np.int64), ([], [])
        norm = np.sqrt((x * x).sum(axis=1))
        for at in range(0, m, 512):
            rows = np.arange(at, min(m, at + 512))
            near = (x[rows] @ x.T) / (norm[rows][:, None] * norm[None, :]) >= threshold
            near &= label[rows][:, None] == label[None, :]
            near[np.arange(len(rows)), rows] = False
            if half is not None:  # two chunks: each settles its own pairs alone
                near &= half[rows][:, None] != half[None, :]
            links[rows] = near @ n
            i, j = np.nonzero(near)
            edges[0].append(rows[i])
            edges[1].append(j)
        i, j = _forest(np.concatenate(edges[0]), np.concatenate(edges[1]), m)
        low = np.arange(m)
        low[i] = j
        at = np.flatnonzero(links > 0)
        return node[at], node[low[at]], links[at]

    def run(batches):
        for table, starts in streams.runs(batches, "g", 4 * CHUNK):
            node, n, own, label = (table.column(c).to_numpy() for c in ("node", "n", "own", "label"))
            across = table.column("across").to_numpy(zero_copy_only=False)
            values, at = streams.flat(table.column("x"))
            out = []
            for lo, hi in zip(starts, np.r_[starts[1:], len(node)]):
                k = lo + np.unique(node[lo:hi], return_index=True)[1]
                size = at[k + 1] - at[k]
                for d in np.unique(size):  # vectors of different lengths never link
                    w = k[size == d]
                    if len(w) > 1:
                        x = np.stack([values[at[v] : at[v + 1]] for v in w]).astype(np.float64)
                        out.append(one(node[w], n[w], label[w], x, own[w] if across[lo] else None))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["a", "b", "links"])

    return run


def _name(seed: int, label: Column, plain: Column) -> Column:
    return F.xxhash64(label, plain) if seed == 0 else F.xxhash64(F.lit(seed), label, plain)


def _classes(given: DataFrame, kind: str, scratch: Scratch, seeds: int = 64) -> tuple[DataFrame, DataFrame]:
    """``id, x, label, node`` of all rows and ``node, rep, n`` of the classes of equal labels and vectors.

    Members of a class are compared with each other; where unequal ones share a name, all
    are named anew.  Only rows of classes with several members travel for that.
    """
    plain = F.transform("x", lambda v: v.cast("double") + F.lit(0.0))  # -0.0 is 0.0
    whole = F.col("label").cast("bigint") if kind in ("tinyint", "smallint", "int", "bigint") else F.xxhash64("label")
    for seed in range(seeds):
        rows = given.select("id", "x", whole.alias("label"), _name(seed, F.col("label"), plain).alias("node"))
        classes = scratch.keep(rows.groupBy("node").agg(F.min("id").alias("rep"), F.count("*").alias("n")), "classes")
        own = given.select(F.struct("label", plain.alias("x")).alias("v"), _name(seed, F.col("label"), plain).alias("node"))
        several = own.join(classes.where("n > 1").select("node"), "node", "left_semi")
        if several.groupBy("node").agg(F.min("v").alias("low"), F.max("v").alias("high")).where("low <> high").isEmpty():
            return rows, classes
    raise RuntimeError(f"unequal vectors still share names after {seeds} seeds")


def cosine_links(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = 0.98, k: int = 10, width: float = 1.5, tables: int = 24) -> DataFrame:
    """``key, n_links, component_id, kept`` for every row.

    Rows link when their labels are equal and not null and their cosine, in double
    precision, is at least ``threshold``.  Vectors that are null, empty or zero, hold a
    null or non-finite number, and rows with a null key link with nothing; ``component_id``
    is then the key itself and ``kept`` holds (null and false for a null key).  Vectors of
    different lengths never link.  Rows that repeat a key are rows of their own.

    Equal vectors of one label are one class, so that copies are counted, not paired; a class is named by
    64 bits of hash, and names are changed until no two unequal vectors share one.  A class travels as its name and 64 signs of projections to its bucket in
    each table; those that share a bucket and most signs are joined to clusters by forests, and only
    members of clusters travel as vectors, once, or once a pair of chunks where a cluster or a
    bucket has more than ``CHUNK``.  There all pairs are compared; none leaves its task.  A pair
    at cosine 0.98 is missed with a probability of about 0.0001, nearer ones less.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "cosine")
    given = vectors.select(F.col(key).alias("id"), F.col(label).alias("label"), F.col(vector).alias("x"))
    ok = _usable("x") & F.col("label").isNotNull() & F.col("id").isNotNull()
    rows, classes = _classes(given.where(ok), dict(vectors.dtypes)[label], scratch)
    dealt = scratch.keep(rows.select("node", "label", "x").mapInArrow(_buckets(tables, k, width), "g bigint, node bigint, signs bigint"), "buckets")
    hot = dealt.groupBy("g").agg(F.ceil(F.count("*") / CHUNK).alias("c")).where("c > 1").withColumnRenamed("g", "hot")
    hot = scratch.keep(hot, "hot")
    split = _chunked(dealt.join(hot, F.col("g") == F.col("hot")).withColumnRenamed("g", "bucket"), F.col("c"), "bucket").where("across").select("g", "node", "signs")
    rest = dealt.join(hot, F.col("g") == F.col("hot"), "left_anti").unionByName(split)
    maybe = scratch.keep(rest.repartition("g").sortWithinPartitions("g", "node").mapInArrow(_maybe, "a bigint, b bigint"), "maybe")

    scratch.drop(dealt)
    clusters = connected_components(maybe, scratch).select(F.col("id").alias("node"), "component")
    clusters = scratch.keep(clusters.union(clusters.select("component", "component").distinct()), "clusters")
    sizes = clusters.groupBy("component").agg(F.ceil(F.count("*") / CHUNK).alias("c"))
    members = clusters.join(sizes, "component").join(classes, "node").select(F.col("node").alias("__node"), "rep", "n", "component", "c")
    fetched = members.join(rows, (F.col("rep") == F.col("id")) & (F.col("__node") == F.col("node"))).select("node", "n", "label", "x", "component", "c")
    met = _chunked(fetched, F.col("c"), "component").select("g", "across", "own", "node", "n", "label", "x")
    found = scratch.keep(met.repartition("g").sortWithinPartitions("g").mapInArrow(_compared(threshold), "a bigint, b bigint, links bigint"), "found")

    links = found.groupBy("a").agg(F.sum("links").alias("links"))
    parts = connected_components(found.select("a", "b"), scratch)
    named = classes.join(links, F.col("node") == F.col("a"), "left").join(parts, F.col("node") == F.col("id"), "left")
    named = scratch.keep(named.select("node", "rep", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component")), "named")
    lows = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = scratch.keep(named.join(lows, "component").select("node", "n_links", "component_id"), "labels")
    inside = rows.select("id", "node").join(named, "node").select(F.col("id").alias(key), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))
    alone = given.where(~ok).select(F.col("id").alias(key), F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"), F.col("id").isNotNull().alias("kept"))
    return inside.unionByName(alone)


# ---- nearest neighbours

BLOCK = 16_384  # rows of a cell that a task holds
QUERIES = 16_384  # queries that a task answers
BATCH = 256  # queries that are multiplied at once
HELD = 50_000  # queries whose best rows a task holds before it hands them out


def _padded(x: np.ndarray, scale: float) -> np.ndarray:
    """Rows of at most unit length, and one more number that brings each to unit length."""
    y = x / scale
    return np.c_[y, np.sqrt(np.maximum(0.0, 1.0 - (y * y).sum(axis=1)))]


def _asked(q: np.ndarray) -> np.ndarray:
    """Queries of unit length, padded with 0: their nearest padded rows have the largest inner products."""
    return np.c_[q / np.sqrt((q * q).sum(axis=1, keepdims=True)), np.zeros(len(q))]


def _code(cell: np.ndarray) -> np.ndarray:
    """``k`` cell numbers, up to three, as one long of 20 bits each."""
    out = np.zeros(cell.shape[:-1], np.int64)
    for j in range(cell.shape[-1]):
        out = out << 20 | (cell[..., j].astype(np.int64) + (1 << 19))
    return out


def _uncode(code: np.ndarray, k: int) -> np.ndarray:
    return np.stack([(code >> 20 * (k - 1 - j) & 0xFFFFF) - (1 << 19) for j in range(k)], axis=1)


class _Cells:
    """The occupied cells of each vector length and table, and how many rows each has."""

    def __init__(self, rows, tables: int, k: int, width: float):
        self.k, self.width, self.tables = k, width, tables
        by: dict[tuple[int, int], list] = {}
        for r in rows:
            by.setdefault((r["d"], r["t"]), []).append((r["cell"], r["n"]))
        self.cells = {key: tuple(np.array(x, np.int64) for x in zip(*sorted(v))) for key, v in by.items()}
        self.hashing: dict[int, Tables] = {}

    def tables_of(self, d: int) -> Tables:
        if d not in self.hashing:
            self.hashing[d] = Tables(d + 1, self.k, self.width, self.tables)
        return self.hashing[d]

    def visited(self, q: np.ndarray, t: int, share: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each query the cells of table ``t`` in the order of their distance from where it falls, until they hold ``share`` of the rows.

        Returns the query's number, the cell and its rows.  The smaller the distance to a cell's
        box, the likelier the cell holds a near row.
        """
        d = q.shape[1]
        code, n = self.cells[d, t]
        place = self.tables_of(d).place(_asked(q), t)
        low = _uncode(code, self.k)[None, :, :] - place[:, None, :]
        gap = np.maximum(0.0, np.maximum(low, -(low + 1)))
        order = np.argsort((gap * gap).sum(axis=2), axis=1, kind="stable")
        before = np.cumsum(n[order], axis=1) - n[order]
        i, j = np.nonzero(before < share * n.sum())
        at = order[i, j]
        return i, code[at], n[at]


def _place(tables: int, k: int, width: float):
    """``id, x, d, q, cells``: each row's cell in every table."""

    def run(batches):
        made: dict[int, Tables] = {}
        for b in batches:
            dims, scales = b.column("d").to_numpy(), b.column("scale").to_numpy()
            cells = np.zeros((len(dims), tables), np.int64)
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                y = _padded(_matrix(b.column("x").take(pa.array(at))), scales[at[0]])
                hashing = made.setdefault(int(d), Tables(int(d) + 1, k, width, tables))
                for t in range(tables):
                    cells[at, t] = _code(np.floor(hashing.place(y, t)))
            ends = pa.array(np.arange(len(dims) + 1, dtype=np.int32) * tables)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("id", "x", "d", "q", "m")), pa.ListArray.from_arrays(ends, pa.array(cells.ravel()))], names=["id", "x", "d", "q", "m", "cells"])

    return run


def _visits(shared, share: float):
    """``id, x, d, visits``: the blocks of cells that each query visits."""

    def run(batches):
        for b in batches:
            cells, dims = shared.value, b.column("d").to_numpy()
            out: list[list] = [[] for _ in dims]
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                q = _matrix(b.column("x").take(pa.array(at)))
                for t in range(cells.tables):
                    for lo in range(0, len(q), 1024):
                        for i, cell, n in zip(*(v.tolist() for v in cells.visited(q[lo : lo + 1024], t, share))):
                            out[at[lo + i]] += [{"t": t, "cell": cell, "s": s} for s in range(-(-n // BLOCK))]
            kind = pa.list_(pa.struct([("t", pa.int32()), ("cell", pa.int64()), ("s", pa.int32())]))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("x"), b.column("d"), b.column("m"), pa.array(out, kind)], names=["id", "x", "d", "m", "visits"])

    return run


class _Best:
    """The best rows of each query that a task has met: largest product first, ties to the smaller id, an id once."""

    def __init__(self, top: int):
        self.top = top
        self.known: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def floor(self, query: int) -> float:
        got = self.known.get(query)
        return got[0][-1] if got is not None and len(got[0]) == self.top else -np.inf

    def add(self, query: int, score: np.ndarray, ids: np.ndarray) -> None:
        got = self.known.get(query)
        if got is not None:
            score, ids = np.r_[got[0], score], np.r_[got[1], ids]
        order = np.lexsort((ids, -score))
        score, ids = score[order], ids[order]
        first = np.sort(np.unique(ids, return_index=True)[1])[: self.top]
        self.known[query] = score[first], ids[first]

    def rows(self) -> pa.RecordBatch:
        n = [len(s) for s, _ in self.known.values()]
        query = np.repeat(np.fromiter(self.known, np.int64, len(n)), n)
        score, ids = (np.concatenate([v[k] for v in self.known.values()]) for k in range(2))
        self.known = {}
        return pa.RecordBatch.from_arrays([pa.array(query), pa.array(ids), pa.array(score)], names=["query_id", "vec_id", "score"])


def _ranked(top: int):
    """Of a stream of blocks, each its rows and then its queries: the best rows of each query."""

    def score(best: _Best, qid: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, slack: float):
        for at in range(0, len(q), BATCH):
            s = q[at : at + BATCH] @ x.T  # finds candidates; their products are taken again, one way for all
            for r, row in enumerate(s):
                own = qid[at + r]
                row[np.searchsorted(ids, own, "left") : np.searchsorted(ids, own, "right")] = -np.inf
                near = np.flatnonzero((row >= best.floor(own) - slack) & (row > -np.inf))
                if len(near) > top:
                    v = row[near]
                    near = near[v >= np.partition(v, len(v) - top)[len(v) - top] - slack]
                if len(near):
                    best.add(own, (x[near] * q[at + r]).sum(axis=1), ids[near])

    def run(batches):
        best, block, ids, x, slack = _Best(top), None, [], [], 0.0
        for b in batches:
            g, ask = b.column("g").to_numpy(), b.column("ask").to_numpy(zero_copy_only=False)
            key = b.column("id").to_numpy()
            cuts = np.r_[0, np.flatnonzero((g[1:] != g[:-1]) | (ask[1:] != ask[:-1])) + 1, len(g)]
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                if lo == hi:
                    continue
                if g[lo] != block:
                    block, ids, x = g[lo], [], []
                part = _matrix(b.column("x").slice(lo, hi - lo))
                if not ask[lo]:
                    ids.append(key[lo:hi])
                    x.append(part)
                    continue
                if not ids:
                    continue
                if len(ids) > 1 or not isinstance(x, tuple):
                    order = np.argsort(np.concatenate(ids), kind="stable")
                    ids, x = [np.concatenate(ids)[order]], (np.concatenate(x)[order],)
                    slack = 1e-12 * float(np.sqrt((x[0] * x[0]).sum(axis=1).max()))
                score(best, key[lo:hi], part, ids[0], x[0], slack * float(np.sqrt((part * part).sum(axis=1).max())))
                if len(best.known) > HELD:
                    yield best.rows()
        if best.known:
            yield best.rows()

    return run


def nearest(vectors: DataFrame, is_query: str, top: int = 20, key: str = "vec_id", vector: str = "embedding", k: int = 2, width: float = 1.0, tables: int = 3, share: float = 0.45) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's ``top`` largest inner products among other rows.

    ``is_query`` is an SQL condition on the key, a whole number.  Each table deals the rows to cells of
    ``k`` quantised projections, up to three.  A query visits the cells in the order of their
    distance from where it falls itself until they hold ``share`` of the rows; the rows of all
    tables' visited cells are its candidates, ranked by the exact product on the original vectors.
    A cell is cut into blocks; a block's rows travel to one task, the queries that visit it pass
    through there, and only the best rows of a query leave.

    Ties go to the smaller id.  Vectors that are null, empty or zero or hold a null or non-finite
    number, and null keys, take no part; vectors of another length than the query's are no
    candidates.  Rows that repeat a key count as that key once, by their largest product.  A query
    with fewer than ``top`` hits, as in a small table, is answered again from all cells; only a
    query without any candidate has no rows.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "nearest")
    rows = vectors.select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("x"), F.coalesce(F.expr(is_query), F.lit(False)).alias("q"))
    rows = rows.where(_usable("x") & F.col("id").isNotNull()).withColumn("d", F.size("x"))
    norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v))
    stats = rows.groupBy("d").agg(F.count("*").alias("n"), F.count_if("q").alias("m"), F.max(norm).alias("scale")).where("m > 0")  # a row for each vector length
    placed = rows.join(F.broadcast(stats.select("d", "m", "scale")), "d").mapInArrow(_place(tables, k, width), "id bigint, x array<double>, d int, q boolean, m bigint, cells array<bigint>")
    placed = scratch.keep(placed, "placed")
    counts = scratch.keep(placed.select("d", F.posexplode("cells").alias("t", "cell")).groupBy("d", "t", "cell").agg(F.count("*").alias("n")), "cells")
    shared = spark.sparkContext.broadcast(_Cells(counts.collect(), tables, k, width))  # vectors of unit length fall into few cells, however many they are
    blocks = F.broadcast(counts.select("d", "t", "cell", F.ceil(F.col("n") / BLOCK).cast("int").alias("c")))
    parts = F.ceil(F.col("m") / QUERIES).cast("int")
    own = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    group = F.xxhash64("d", "t", "cell", "s", "p").alias("g")
    data = placed.select("id", "x", "d", F.posexplode("cells").alias("t", "cell"), F.sequence(F.lit(0), parts - 1).alias("ps")).join(blocks, ["d", "t", "cell"])
    data = data.select("id", "x", "d", "t", "cell", own(F.col("c")).alias("s"), F.explode("ps").alias("p")).select(group, F.lit(False).alias("ask"), "id", "x")
    queries = placed.where("q")

    def answers(asking: DataFrame, share: float, name: str) -> DataFrame:
        asks = asking.select("id", "x", "d", "m").mapInArrow(_visits(shared, share), "id bigint, x array<double>, d int, m bigint, visits array<struct<t:int,cell:bigint,s:int>>")
        asks = asks.select("id", "x", "d", own(parts).alias("p"), F.explode("visits").alias("v")).select("id", "x", "d", "p", "v.*")
        both = data.union(asks.select(group, F.lit(True).alias("ask"), "id", "x")).repartition("g").sortWithinPartitions("g", "ask")
        return scratch.keep(both.mapInArrow(_ranked(top), "query_id bigint, vec_id bigint, score double"), name)

    found = answers(queries, share, "found").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    hits = found.groupBy("query_id").agg(F.count("*").alias("hits"))
    others = placed.groupBy("d").agg(F.count("*").alias("n"))
    short = queries.join(F.broadcast(others), "d").join(hits, F.col("id") == F.col("query_id"), "left").where(F.coalesce("hits", F.lit(0)) < F.least(F.lit(top), F.col("n") - 1))
    short = scratch.keep(short.select("id", "x", "d", "m"), "short")
    if not short.isEmpty():
        found = found.unionByName(answers(short, 1.0, "again")).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
