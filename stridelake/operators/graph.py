"""Connected components over an edge table, without driver-side state."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import DataFrame, functions as F

from stridelake.operators.scratch import Scratch

FEW = 200_000  # links that one task settles, some 30 MB


def _settled(links: DataFrame) -> DataFrame:
    """What ``connected_components`` returns for up to ``FEW`` links ``u > v``, by one task: names of linked ids are hooked to the smaller one until none differ."""

    def run(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        u, v = (pa.chunked_array([b.column(k) for b in held]) for k in range(2))
        ids = pa.compute.unique(pa.chunked_array([*u.chunks, *v.chunks]))
        ids = ids.take(pa.compute.sort_indices(ids))
        u, v = (pa.compute.index_in(c, ids).to_numpy() for c in (u, v))
        name = np.arange(len(ids))
        while (name[u] != name[v]).any():
            a, b = name[u], name[v]
            low = np.minimum(a, b)
            np.minimum.at(name, a, low)
            np.minimum.at(name, b, low)
            while (name[name] != name).any():
                name = name[name]
        at = np.flatnonzero(name < np.arange(len(ids)))
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), ids.take(pa.array(name[at]))], names=["id", "component"])

    kind = links.schema["u"].dataType.simpleString()
    return links.coalesce(1).mapInArrow(run, f"id {kind}, component {kind}")


def connected_components(edges: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """Smallest reachable id for each id in ``edges(a, b)``.

    Returns ``(id, component)`` for ids that have an edge, but for the smallest of each
    component, which is itself the ``component``.  Alternating large-star and small-star rounds:
    only minima are aggregated (they combine before the shuffle) and no
    neighbour list is ever collected, so a node with millions of links is a
    skewed join side, which adaptive execution splits.  Every round is written
    to the shared folder.  Up to ``FEW`` links are settled by one task instead, as a round of
    many small jobs leaves threads and plans on the driver.  Nulls and self loops are ignored; an empty edge table
    gives an empty result.  Ids may be of any orderable type.

    Raises RuntimeError if the links have not settled after ``max_rounds``.
    """
    hi, lo = F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    now = scratch.keep(edges.where("a != b").select(hi, lo).distinct(), "links")
    if now.count() <= FEW:
        found = scratch.keep(_settled(now), "links")
        scratch.drop(now)
        return found
    before = None
    for _ in range(max_rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.when(F.col("v") == F.col("m"), F.array(F.struct("u", "v"))).otherwise(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v"))))).alias("e"))
            .select("e.u", "e.v")
        )
        after = scratch.keep(small.distinct(), "links")
        seen = after.agg(F.count("*").alias("n"), F.sum(F.hash("u", "v").cast("bigint")).alias("h"), F.sum(F.xxhash64("u", "v") % 1000003).alias("g")).first()
        scratch.drop(now)
        now = after
        if seen == before:
            return now.select(F.col("u").alias("id"), F.col("v").alias("component"))
        before = seen
    raise RuntimeError(f"components did not settle within {max_rounds} rounds")
