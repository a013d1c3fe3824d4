"""Digests of tables: one number for all rows in a tree that no task holds, and of a group's rows in order as a stream."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

LEAVES = 16  # rows under a lowest node, on average


def depth_of(rows: int) -> int:
    """Levels of hexadecimal digits for so many rows."""
    return max(1, math.ceil(math.log(max(rows, 1) / LEAVES + 1, 16)))


def tree(rows: DataFrame, name: str, digest: Column, depth: int | None = None) -> DataFrame:
    """``level, node, parent, digest`` of a tree over the digests of named rows.

    A row hangs under the first ``depth`` hexadecimal digits of its name's hash, and a node's digest is
    that of its children's in order of name: the one at level 0 stands for all rows.  By default a lowest
    node has about 16 rows, however many there are.  Trees to be compared have one depth.
    """
    own = rows.select(F.col(name).cast("string").alias("node"), digest.alias("digest"))
    depth = depth_of(own.count()) if depth is None else depth
    whole = below = own.select(F.lit(depth + 1).alias("level"), "node", F.substring(F.sha2(F.coalesce("node", F.lit("")), 256), 1, depth).alias("parent"), "digest")
    for level in range(depth, -1, -1):
        lines = F.array_sort(F.collect_list(F.concat_ws("=", "node", "digest")))  # 16 nodes, or about as many rows
        below = below.groupBy("parent").agg(F.sha2(F.array_join(lines, "\n"), 256).alias("digest"))
        above = F.when(F.lit(level) > 0, F.substring("parent", 1, max(level - 1, 0)))
        below = below.select(F.lit(level).alias("level"), F.col("parent").alias("node"), above.alias("parent"), "digest")
        whole = whole.unionByName(below)
    return whole


def differences(before: DataFrame, after: DataFrame, depth: int) -> DataFrame:
    """``name`` of the rows that two trees of one depth don't share, from the root down: only under nodes that differ are children compared."""
    differ = None
    for level in range(depth + 2):
        a, b = (t.where(F.col("level") == level).select("node", "parent", F.col("digest").alias(n)) for t, n in ((before, "was"), (after, "now")))
        both = a.join(b, ["node", "parent"] if level else ["node"], "full_outer").where(~F.col("was").eqNullSafe(F.col("now"))).select("node", *(["parent"] if level else []))
        differ = (both if differ is None else both.join(differ.withColumnRenamed("node", "__above"), F.col("parent") == F.col("__above"), "left_semi")).select("node")
        if level == 0 and differ.isEmpty():
            break
    return differ.select(F.col("node").alias("name"))


def ordered_sha1(df: DataFrame, group: str, line: Column) -> DataFrame:
    """``group, sha1, rows``: of each group the SHA-1 of its lines in order, joined by line feeds.

    Lines are sorted with spills and hashed as they come; a task holds one batch of them.
    """
    kind = df.select(group).schema
    named = df.select(F.to_json(F.struct(group)).alias("g"), line.alias("line"))

    def run(batches):
        held, sha, n, out = None, None, 0, []
        for b in batches:
            g, lines = b.column(0).to_pylist(), b.column(1).to_pylist()
            starts = [i for i in range(len(g)) if i == 0 or g[i] != g[i - 1]]
            for a, z in zip(starts, [*starts[1:], len(g)]):
                if g[a] != held:
                    if held is not None:
                        out.append((held, sha.hexdigest(), n))
                    held, sha, n = g[a], hashlib.sha1(), 0
                text = "\n".join(lines[a:z]).encode("utf-8", "surrogatepass")
                sha.update(b"\n" + text if n else text)
                n += z - a
            if len(out) > 10_000:
                yield _rows(out)
                out = []
        if held is not None:
            out.append((held, sha.hexdigest(), n))
        yield _rows(out)

    found = named.repartition("g").sortWithinPartitions("g", "line").mapInArrow(run, "g string, sha1 string, rows bigint")
    return found.select(F.from_json("g", kind)[group].alias(group), "sha1", "rows")


def _rows(out: list[tuple[str, str, int]]) -> pa.RecordBatch:
    g, sha, n = zip(*out) if out else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(g, pa.string()), pa.array(sha, pa.string()), pa.array(np.array(n, np.int64))], names=["g", "sha1", "rows"])
