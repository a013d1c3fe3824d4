"""Whitening of embeddings: covariance in double-double, eigenvectors of the tridiagonal form.

Vectors are put on a grid of whole numbers and each distinct one counts once.  Their sums are
exact.  Tasks add up centred outer products as pairs of doubles: a product and
its rounding error (Veltkamp's split), a sum and its rounding error (Knuth's), so that nothing below
the last bit of a double is lost; the pairs of the tasks are added alike, in a tree.  The driver
solves the one small matrix by LAPACK's ``dsyevd``: Householder's tridiagonal form, then divide and conquer.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from stridelake.operators.scratch import Scratch

GRID = 256.0
BLOCK = 1 << 17  # products that are added at once
FAN = 32  # tasks whose sums are added at once


def two_sum(a, b):
    """Sum and rounding error."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def dd_add(ah, al, bh, bl):
    """The sum of two double-doubles."""
    s, e = two_sum(ah, bh)
    t, f = two_sum(al, bl)
    s, e = two_sum(s, e + t)
    return two_sum(s, e + f)


def _halves(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    c = 134217729.0 * a  # 2**27 + 1
    high = c - (c - a)
    return high, a - high


def products(high: np.ndarray, low: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Double-double products of the columns ``i`` and ``j`` of double-double rows."""
    a, b = _halves(high)
    x, y = high[:, i], high[:, j]
    p = x * y
    e = ((a[:, i] * a[:, j] - p) + a[:, i] * b[:, j] + b[:, i] * a[:, j]) + b[:, i] * b[:, j]
    return two_sum(p, e + (x * low[:, j] + low[:, i] * y))


def added(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The double-double sum of rows, in pairs."""
    while len(high) > 1:
        half = len(high) // 2
        h, l = dd_add(high[:half], low[:half], high[half : 2 * half], low[half : 2 * half])
        high, low = (h, l) if len(high) % 2 == 0 else (np.concatenate([h, high[-1:]]), np.concatenate([l, low[-1:]]))
    return high[0], low[0]


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column of ``dim`` numbers each."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``x - sums / n`` as double-double: the quotient and what it leaves, both from exact integers where they fit."""
    if int(np.abs(x).max(initial=0)) * n + int(np.abs(sums).max(initial=0)) < 1 << 52:
        top = (x * n - sums).astype(np.float64)
        q = top / n
        h, l = _halves(q)
        nh, nl = _halves(np.array([float(n)]))
        p = q * float(n)
        rest = ((h * nh - p) + h * nl + l * nh) + l * nl  # q * n is p + rest
        return q, ((top - p) - rest) / n
    mean = sums.astype(np.float64) / n
    left = np.array([float((int(s) - int(m) * n)) / n - (m - int(m)) for s, m in zip(sums.tolist(), mean.tolist())])
    s, e = two_sum(x.astype(np.float64), -mean)
    return two_sum(s, e - left)


def gram(rows: DataFrame, dim: int, width: int, prepare) -> tuple[np.ndarray, np.ndarray]:
    """Double-double sums, by upper triangle, of the products of what ``prepare`` makes of an ``x`` column's rows, ``(high, low)`` of ``width`` columns."""
    i, j = np.triu_indices(width)
    step = max(1, BLOCK // len(i))

    def run(batches):
        high, low = np.zeros(len(i)), np.zeros(len(i))
        for b in batches:
            x = matrix(b.column(0), dim)
            for at in range(0, len(x), step):
                high, low = dd_add(high, low, *added(*products(*prepare(x[at : at + step]), i, j)))
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([high.tobytes()], pa.binary()), pa.array([low.tobytes()], pa.binary())], names=["src", "high", "low"])

    def merge(group: pa.Table) -> pa.Table:
        group = group.sort_by("src")
        h, l = (np.stack([np.frombuffer(v.as_py()) for v in group.column(c)]) for c in ("high", "low"))
        h, l = added(h, l)
        return pa.table({"src": pa.array([group.column("src")[0].as_py() // FAN], pa.int32()), "high": pa.array([h.tobytes()], pa.binary()), "low": pa.array([l.tobytes()], pa.binary())})

    kind = "src int, high binary, low binary"
    tasks, parts = rows.rdd.getNumPartitions(), rows.select("x").mapInArrow(run, kind)
    while tasks > FAN:
        parts = parts.groupBy(F.floor(F.col("src") / FAN)).applyInArrow(merge, kind)
        tasks = -(-tasks // FAN)
    got = sorted(parts.collect(), key=lambda r: r["src"])  # FAN small matrices at most
    if not got:
        return np.zeros(len(i)), np.zeros(len(i))
    return added(*(np.stack([np.frombuffer(bytes(r[c])) for r in got]) for c in ("high", "low")))


def square(upper: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((width, width))
    out[np.triu_indices(width)] = upper
    return out + np.triu(out, 1).T


def gridded(vector: Column) -> Column:
    """Whole numbers of a vector at ``GRID`` a unit; null where the vector can't be used."""
    fine = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return F.when(vector.isNotNull() & fine & (F.size(vector) > 0), F.transform(vector, lambda c: F.floor(c.cast("double") * GRID)))


def whiten(vectors: DataFrame, components: int = 4, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``key, component, n, deviation, whitened, explained, identity_error`` for each usable row and component.

    Vectors that are null or empty or hold null or non-finite numbers are dropped, and so are those
    whose length isn't the most common one (ties: the longer).  ``n`` counts distinct
    grid vectors.  ``deviation``, the sum of squares of ``n * x`` less the sums, is exact, and null where
    a long can't hold it.  ``whitened`` is the projection on the component at unit variance,
    ``explained`` the component's share of the variance, ``identity_error`` the largest
    entry by which the covariance of the whitened distinct vectors, measured, is off the identity.  Components
    without variance, as all of one distinct vector, and all but the first ``components`` have no rows.
    Repeated rows all get theirs.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "whitening")
    kind = dict(vectors.dtypes)[key]
    out_kind = f"`{key}` {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    rows = vectors.select(F.col(key).alias("key"), gridded(F.col(vector)).alias("x")).where("x is not null")
    sizes = [(r["count"], r["s"]) for r in rows.groupBy(F.size("x").alias("s")).count().orderBy(F.desc("count"), F.desc("s")).limit(1).collect()]
    if not sizes:
        return spark.createDataFrame([], out_kind)
    dim = sizes[0][1]
    rows = rows.where(F.size("x") == dim)
    fit = scratch.keep(rows.select("x").distinct(), "fit")

    def sums(batches):
        n, total = 0, np.zeros(dim, object)
        for b in batches:
            x = matrix(b.column(0), dim)
            small = len(x) * int(np.abs(x).max(initial=0)) < 1 << 62
            n, total = n + len(x), total + (x.sum(axis=0) if small else x.astype(object).sum(axis=0)).astype(object)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *range(dim)], pa.int32()), pa.array([str(v) for v in (n, *total)], pa.string())], names=["d", "v"])

    whole = fit.mapInArrow(sums, "d int, v string").groupBy("d").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
    got = {r["d"]: int(r["v"]) for r in whole.collect()}  # a row for each dimension
    n, total = got[-1], [got[d] for d in range(dim)]
    s = np.array(total, np.int64)

    high, low = gram(fit, dim, dim, lambda x: _centred(x, n, s))
    cov = square((high + low) / n, dim)
    values, axes = np.linalg.eigh(cov)
    trace = float(np.trace(cov))
    take = [k for k in np.argsort(-values, kind="stable")[:components] if values[k] > dim * np.finfo(float).eps * max(trace, 0.0)]
    e, axes = values[take], axes[:, take]
    if not take:
        return spark.createDataFrame([], out_kind)

    def project(x):
        h, l = _centred(x, n, s)
        return (h @ axes + l @ axes) / np.sqrt(e)

    k = len(take)
    seen = square(np.add(*gram(fit, dim, k, lambda x: (project(x), np.zeros((len(x), k))))) / n, k)  # the mean is 0
    error = float(np.abs(seen - np.eye(k)).max())
    explained = e / trace
    biggest = max(map(abs, total), default=0)

    def run(batches):
        for b in batches:
            x = matrix(b.column(1), dim)
            most = n * int(np.abs(x).max(initial=0)) + biggest
            if dim * most * most < 1 << 63:
                d = pa.array(((n * x - s) ** 2).sum(axis=1), pa.int64())
            else:
                exact = [sum((n * int(c) - t) ** 2 for c, t in zip(v, total)) for v in x.tolist()]
                d = pa.array([v if v < 1 << 63 else None for v in exact], pa.int64())
            m, at = len(x), np.repeat(np.arange(len(x)), k)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(at)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)), d.take(pa.array(at)), pa.array(project(x).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))],
                names=[key, "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(run, out_kind)
