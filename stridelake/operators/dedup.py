"""Exact and near duplicates of sequences: hashes, pair metrics, clusters, keepers."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from stridelake.functions import vectors
from stridelake.operators import digests, ranks
from stridelake.operators.graph import connected_components
from stridelake.operators.scratch import Scratch


def near_hash(values: Column, tolerance: float = 1e-4) -> Column:
    """SHA-1 of the values quantised to multiples of the tolerance, halves to even."""
    return F.sha1(F.to_json(F.transform(values, lambda v: F.rint(v.cast("double") / tolerance).cast("bigint"))))


@F.arrow_udf(T.StringType())
def exact_hash(values: pa.Array) -> pa.Array:
    """SHA-1 of shape, type and bytes of an array of doubles, read where the batch has them; null for null, a null element is NaN."""
    import hashlib

    flat = values.flatten().fill_null(float("nan")).to_numpy(zero_copy_only=False).astype("<f8", copy=False)
    ends = np.cumsum(values.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    raw, out, at = memoryview(np.ascontiguousarray(flat)).cast("B"), [], 0
    for end, known in zip(ends.tolist(), values.is_valid().to_pylist()):
        head = f"({end - at},)<f8".encode()
        out.append(hashlib.sha1(head + raw[8 * at : 8 * end]).hexdigest() if known else None)
        at = end
    return pa.array(out, pa.string())


def window_dedup(df: DataFrame, scope: str, quality: str, key: str, exact: str, near: str) -> DataFrame:
    """Add ``dedup_status`` and ``duplicate_of``: in each scope the best of equal near hashes is unique.

    The best has the highest quality (null counts as 0), then the smallest key.  Others are
    ``duplicate_exact`` if a better row has their exact hash, else ``duplicate_near``.  Rows with
    a null near hash are unique.  The best of a hash are aggregated before the shuffle and joined
    back, so that a hash that very many rows share is a skewed join side, which adaptive
    execution splits.
    """
    order = F.struct(-F.coalesce(F.col(quality).cast("double"), F.lit(0.0)), F.col(key))
    df = Scratch(df.sparkSession, "dedup").keep(df, "hashed")  # hashes of whole contents are computed once
    rows = df.where(F.col(near).isNotNull())
    best = lambda by, out: rows.groupBy(*(F.col(c).alias(f"__{c}") for c in by)).agg(F.min_by(F.col(key), order).alias(out))
    match = lambda by: reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by))
    out = df.join(best([scope, near], "__n"), match([scope, near]), "left").drop(f"__{scope}", f"__{near}")
    out = out.join(best([scope, near, exact], "__e"), match([scope, near, exact]), "left").drop(f"__{scope}", f"__{near}", f"__{exact}")
    unique = F.col(near).isNull() | (F.col("__n") == F.col(key))
    status = F.when(unique, "unique").when(F.col(exact).isNotNull() & (F.col("__e") != F.col(key)), "duplicate_exact").otherwise("duplicate_near")
    return out.withColumn("dedup_status", status).withColumn("duplicate_of", F.when(~unique, F.col("__n"))).drop("__n", "__e")


def projection(dim: int, width: int = 32, seed: int = 0) -> np.ndarray:
    """The seeded Gaussian matrix of the candidate search, in single precision; the same on every machine."""
    return np.random.RandomState(seed).normal(0.0, 1.0 / np.sqrt(dim), (dim, width)).astype(np.float32)


BLOCKS = 16  # blocks that rows are dealt into, as long as a block has ``block`` to ``MOST`` rows: a row travels once for each
MOST = 65_536  # rows of a block
CELLS = 1 << 22  # scores that a task holds
STRIDE = 32  # scores of which the first look takes only the largest


def _nearest(u: np.ndarray, v: np.ndarray, i: np.ndarray, j: np.ndarray, k: int, same: bool):
    """Places in ``u`` and ``v`` and scores of each row's ``k`` largest products of unit vectors, ties to the smaller ``j``, which rises.

    Single precision tells which can be among them: rows at or above the ``k``-th largest of the
    maxima of strides, less what rounding adds.  Those are scored in double precision, each pair alike wherever it stands.
    """
    u32, v32, slack = u.astype(np.float32), v.astype(np.float32), np.float32((u.shape[1] + 8) * 2.4e-7)
    wide = -(-len(v) // STRIDE)
    step = max(1, CELLS // (wide * STRIDE))
    for at in range(0, len(u), step):
        n = min(step, len(u) - at)
        s = np.full((n, wide * STRIDE), -np.inf, np.float32)
        s[:, : len(v)] = u32[at : at + n] @ v32.T
        if same:
            s[:, : len(v)][i[at : at + n][:, None] == j[None, :]] = -np.inf
        s = s.reshape(n, STRIDE, wide)
        high = s.max(axis=1)
        least = (np.partition(high, wide - k, axis=1)[:, wide - k] if wide > k else np.full(n, -np.inf, np.float32)) - slack
        row, cell = np.nonzero((high >= least[:, None]) & (high > -np.inf))
        cuts = np.r_[np.arange(0, len(row), CELLS // STRIDE), len(row)]
        found = []
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            near = s[row[lo:hi], :, cell[lo:hi]]
            x, y = np.nonzero((near >= least[row[lo:hi], None]) & (near > -np.inf))
            a, b = row[lo:hi][x] + at, y * wide + cell[lo:hi][x]
            exact = np.concatenate([np.einsum("ij,ij->i", u[a[c : c + 65536]], v[b[c : c + 65536]]) for c in range(0, len(a), 65536)] or [np.zeros(0)])
            order = np.lexsort((b, -exact, a))
            first = np.r_[True, a[order][1:] != a[order][:-1]] if len(order) else np.zeros(0, bool)
            starts = np.flatnonzero(first)
            order = order[np.arange(len(order)) - np.repeat(starts, np.diff(np.r_[starts, len(order)])) < k]
            found.append((a[order], b[order], exact[order]))
        yield from found


def dealt(rows: DataFrame, blocks: int) -> DataFrame:
    """``id, x`` once for each block that a row's own meets, ``p, q``; ``first`` on the side of ``p``."""
    each = rows.withColumn("own", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return each.select("id", "x", (F.col("own") <= F.col("other")).alias("first"), F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"))


def knn_candidates(df: DataFrame, key: str, vector: str, k: int = 20, width: int | None = 32, seed: int = 0, block: int = 4096) -> DataFrame:
    """``a < b`` pairs where either is among the other's ``k`` nearest by cosine, after a seeded projection.

    Rows are dealt into blocks; every two blocks are one task, which compares them both ways and keeps ``k`` rows
    for each row; ties go to the smaller key.  ``width=None`` searches the vectors themselves.
    Null or zero vectors have no neighbours.  All pairs are compared, in matrix products: the time
    grows with the square of the rows, a task's memory doesn't.
    """
    usable = F.col(vector).isNotNull() & (F.aggregate(vector, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")) > 0)
    rows = df.where(usable).select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("x"))
    n = rows.count()
    blocks = max(1, -(-n // MOST), min(BLOCKS, -(-n // block)))  # more than BLOCKS beyond a million rows
    met = dealt(rows, blocks)

    def near(group: pa.Table) -> pa.Table:
        same = group.column("p")[0].as_py() == group.column("q")[0].as_py()
        group = group.sort_by("id")
        sides = []
        for first in (True, False):
            part = group.filter(pa.compute.equal(group.column("first"), first)).combine_chunks()
            if not part.num_rows:
                continue
            x = part.column("x").combine_chunks()
            x = x.flatten().fill_null(float("nan")).to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
            v = x if width is None else np.einsum("ij,jk->ik", x, projection(x.shape[1], width, seed))
            v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
            known = np.isfinite(v).all(axis=1)
            sides.append((np.ascontiguousarray(v[known]), part.column("id").to_numpy()[known]))
        pairs = [(sides[0], sides[0])] if same else [tuple(sides), tuple(sides[::-1])] if len(sides) == 2 else []
        out = [(i[a], j[b], s) for (u, i), (v, j) in pairs if len(u) and len(v) for a, b, s in _nearest(u, v, i, j, k, same)]
        columns = [np.concatenate(c) for c in zip(*out)] if out else [[], [], []]
        return pa.table([pa.array(c, t) for c, t in zip(columns, (group.schema.field("id").type, group.schema.field("id").type, pa.float64()))], names=["a", "b", "s"])

    kind = dict(rows.dtypes)["id"]
    found = met.groupBy("p", "q").applyInArrow(near, f"a {kind}, b {kind}, s double")
    best = found.withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("s"), "b"))).where(F.col("r") <= k)
    return best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def center_and_normalise(sequence: Column, width: int) -> Column:
    """A flattened frames-by-``width`` sequence less its mean frame, at unit length."""
    frames = (F.size(sequence) / width).cast("int")
    mean = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda j: F.aggregate(F.sequence(F.lit(0), frames - 1), F.lit(0.0), lambda s, f: s + F.get(sequence, f * width + j).cast("double")) / frames)
    return F.transform(F.array(mean), lambda m: vectors.unit(F.transform(sequence, lambda v, i: v.cast("double") - F.get(m, F.pmod(i, F.lit(width))))))[0]


def pair_metrics(pairs: DataFrame, records: DataFrame, key: str, vector: str, root: str, duration: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """Cosine, RMS pose distance, mean root distance and duration ratio of each pair ``(a, b)``.

    ``root`` is a flat array of positions of three numbers; their distances in space are averaged.
    """
    side = lambda s: records.select(F.col(key).alias(s), *(F.col(c).alias(f"{c}_{s}") for c in dict.fromkeys([vector, root, duration, *carry])))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    va, vb, ra, rb, da, db = (F.col(f"{c}_{s}") for c in (vector, root, duration) for s in "ab")
    away = lambda f: F.aggregate(F.sequence(F.lit(0), F.lit(2)), F.lit(0.0), lambda s, k: s + F.pow(F.get(ra, f * 3 + k).cast("double") - F.get(rb, f * 3 + k).cast("double"), F.lit(2.0)))
    frames = (F.size(ra) / 3).cast("int")
    root_distance = F.aggregate(F.sequence(F.lit(0), frames - 1), F.lit(0.0), lambda s, f: s + F.sqrt(away(f))) / frames
    ratio = F.when(F.greatest(da, db) > 0, F.least(da, db) / F.greatest(da, db)).otherwise(F.lit(0.0))
    return both.select("a", "b", vectors.cosine(va, vb).alias("cosine"), vectors.rms_distance(va, vb).alias("pose_rms"), root_distance.alias("root_distance"), ratio.alias("duration_ratio"), *(F.col(f"{c}_{s}") for c in carry for s in "ab"))


def exact_edges(metrics: DataFrame, cosine: float = 0.9995, ratio: float = 0.98, root: float = 0.01, pose: float = 0.005) -> DataFrame:
    same = (F.col("subject_a") == F.col("subject_b")) & (F.col("cosine") >= cosine) & (F.col("duration_ratio") >= ratio) & (F.col("root_distance") <= root) & (F.col("pose_rms") <= pose)
    return metrics.where(F.coalesce(F.col("hash_a") == F.col("hash_b"), F.lit(False)) | same).select("a", "b")


def near_edges(metrics: DataFrame, cosine: float = 0.995, ratio: float = 0.80, root: float = 0.08) -> DataFrame:
    return metrics.where((F.col("cosine") >= cosine) & (F.col("duration_ratio") >= ratio) & (F.col("root_distance") <= root)).select("a", "b")


def hash_star(df: DataFrame, key: str, hash_: str) -> DataFrame:
    """Edges from the smallest key of each shared hash to the others, so that no equal pair depends on the search."""
    low = df.where(F.col(hash_).isNotNull()).groupBy(hash_).agg(F.min(key).alias("a"), F.count("*").alias("n")).where("n > 1").select(hash_, "a")
    return df.join(low, hash_).where(F.col(key) != F.col("a")).select("a", F.col(key).alias("b"))


def components(ids: DataFrame, key: str, edges: DataFrame) -> DataFrame:
    """``key, component``: the smallest key reachable, for every row of ``ids``."""
    parts = connected_components(edges, Scratch(ids.sparkSession, "components"))
    return ids.select(key).join(parts, F.col(key) == F.col("id"), "left").select(key, F.coalesce("component", key).alias("component"))


def cluster_name(df: DataFrame, component: str, key: str) -> DataFrame:
    """``component, cluster_id, cluster_size``: twelve digits of the SHA-1 of the sorted keys, a line each."""
    named = digests.ordered_sha1(df, component, F.col(key).cast("string"))
    return named.select(component, F.concat(F.lit("cluster_"), F.substring("sha1", 1, 12)).alias("cluster_id"), F.col("rows").alias("cluster_size"))


def centrality(df: DataFrame, component: str, key: str, vector: str) -> DataFrame:
    """Add each row's cosine to the normalised mean of its component."""
    flat = df.select(component, F.posexplode(vectors.unit(F.col(vector))).alias("i", "v"))
    mean = flat.groupBy(component, "i").agg(F.avg("v").alias("m")).groupBy(component).agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("l"))
    centre = mean.select(component, vectors.unit(F.transform("l", lambda x: x["m"])).alias("__c"))
    return df.join(centre, component).withColumn("centrality", F.coalesce(vectors.dot(vectors.unit(F.col(vector)), F.col("__c")), F.lit(0.0))).drop("__c")


def keep_diverse(df: DataFrame, component: str, subject: str, rank: list, keep: int = 3) -> DataFrame:
    """Add ``cluster_rank`` and ``kept``: best of each subject first, then the rest, ``keep`` in all.

    ``rank`` orders all members of a cluster.  A subject's best is an aggregate, and ranks of a large cluster are counted in parts.
    """
    ranked = ranks.ranked(df, [component], rank, "cluster_rank")
    best = ranked.groupBy(F.col(component).alias("__c"), F.col(subject).alias("__s")).agg(F.min("cluster_rank").alias("__best"))
    ranked = ranked.join(best, F.col(component).eqNullSafe(F.col("__c")) & F.col(subject).eqNullSafe(F.col("__s")))
    later = (F.col("cluster_rank") > F.col("__best")).cast("int")
    ordered = ranks.ranked(ranked.drop("__c", "__s").withColumn("__later", later), [component], [F.asc("__later"), F.asc("cluster_rank")], "__order")
    return ordered.withColumn("kept", F.col("__order") <= keep).drop("__best", "__later", "__order")


def resolve_exact(df: DataFrame, edges: DataFrame, key: str, quality: str) -> DataFrame:
    """Add ``exact_of``: of each component of exact edges all but the best name the best; null for the others.

    The best has the highest quality (null counts as 0), then the smallest key.
    """
    both = df.join(components(df, key, edges), key)
    best = F.min_by(F.col(key), F.struct(-F.coalesce(F.col(quality).cast("double"), F.lit(0.0)), F.col(key)))
    first = both.groupBy("component").agg(best.alias("__best"))
    return both.join(first, "component").withColumn("exact_of", F.when(F.col(key) != F.col("__best"), F.col("__best"))).drop("component", "__best")


def resolve_duplicates(df: DataFrame, exact: DataFrame, near: DataFrame, key: str, quality: str, subject: str, vector: str, keep: int = 3) -> DataFrame:
    """``df`` with ``dedup_status, duplicate_of, cluster_id, cluster_size, cluster_rank, representative, centrality``.

    Exact duplicates are deferred to their best.  Near edges between the others make clusters;
    of each, ``keep`` stay, ranked by closeness to the centroid, quality and key, one of each subject
    first.  The others are deferred to the first one kept.  Rows in no cluster are unique and have
    nulls there.
    """
    scratch = Scratch(df.sparkSession, "duplicates")
    settled = scratch.keep(resolve_exact(df, exact, key, quality), "settled")
    live = settled.where("exact_of is null").drop("exact_of")
    ends = live.select(F.col(key).alias("__k"))
    inside = near.join(ends, F.col("a") == F.col("__k"), "left_semi").join(ends, F.col("b") == F.col("__k"), "left_semi")
    parts = components(live, key, inside)
    named = cluster_name(parts, "component", key).where("cluster_size > 1")
    grouped = centrality(live.join(parts, key).join(named, "component"), "component", key, vector)
    order = [F.desc("centrality"), F.desc(F.coalesce(F.col(quality).cast("double"), F.lit(0.0))), F.asc(key)]
    kept = scratch.keep(keep_diverse(grouped, "component", subject, order, keep), "kept")
    first = kept.where("kept").groupBy("component").agg(F.min_by(F.col(key), F.col("cluster_rank")).alias("representative"))
    clusters = kept.join(first, "component").select(F.col(key).alias("__k"), "cluster_id", "cluster_size", "cluster_rank", "representative", "centrality", "kept")
    both = settled.join(clusters, F.col(key) == F.col("__k"), "left").drop("__k")
    status = F.when(F.col("exact_of").isNotNull(), "defer_exact_duplicate").when(~F.col("kept"), "defer_redundant_take").when(F.col("kept"), "unique_cluster_representative").otherwise("unique")
    other = F.coalesce("exact_of", F.when(~F.col("kept"), F.col("representative")))
    return both.withColumns({"dedup_status": status, "duplicate_of": other}).drop("exact_of", "kept")


def cluster_audit(df: DataFrame, component: str, key: str, subject: str) -> DataFrame:
    """A row for each member with ``cluster_rank`` and ``kept``, beside its cluster's ``cluster_size`` and ``kept_count``."""
    sizes = df.groupBy(component).agg(F.count("*").alias("cluster_size"), F.count_if("kept").alias("kept_count"))
    return df.select(component, "cluster_rank", F.col(key).alias("motion_id"), F.col(subject).alias("subject"), "kept").join(sizes, component)
