"""What a step sends and holds where its tables are large."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from stridelake.functions import intervals, vectors
from stridelake.operators import dedup, quota, timeline


def test_blocks_of_the_search_are_few_and_ties_go_to_the_smaller_key(spark, monkeypatch):
    rng = np.random.default_rng(7)
    x = np.repeat(rng.normal(size=(60, 9)), 5, axis=0)  # five copies of each vector
    x[::7] += rng.normal(size=(43, 9)) * 1e-9
    monkeypatch.setattr(dedup, "CELLS", 256)
    monkeypatch.setattr(dedup, "STRIDE", 4)
    df = spark.createDataFrame([(k * 3, [float(c) for c in v]) for k, v in enumerate(x)], "id long, x array<double>")
    pairs = dedup.knn_candidates(df, "id", "x", k=6, width=None, block=4)
    assert dedup.dealt(df, 16).groupBy("id").count().where("count <> 16").isEmpty()  # a row travels once for each block
    got = {tuple(r) for r in pairs.collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = set()
    for a in range(300):
        s = np.einsum("ij,ij->i", np.broadcast_to(u[a], u.shape).copy(), u)
        s[a] = -np.inf
        want |= {(3 * min(a, b), 3 * max(a, b)) for b in np.lexsort((np.arange(300), -s))[:6].tolist()}
    assert got == want


def test_shared_values_of_descriptors_are_bound_once(spark):
    assert str(vectors.root_descriptor(F.col("marker"))).count("marker") == 1
    assert str(vectors.unit(F.col("marker"))).count("marker") == 1


def test_candidates_of_the_quota_are_columns_of_numbers():
    rows = [{"id": k % 900, "score": k % 7 / 2, "duration": 3.0, "source": f"s{k % 3}", "subject": f"p{k % 50}", "primary": "a", "dominance": 0.9, "alloc": {"a": 2.0, "b": 1.0}} for k in range(1000)]
    held = quota.Rows([quota.columns_of(rows)])
    assert sum(c.nbytes for c in held.c.values()) + held.ends.nbytes + held.same.nbytes <= 110 * len(rows)
    assert held[5] == {k: v for k, v in rows[5].items() if k not in ("id", "score")}
    out = quota.select(rows, quota.Budget(max_sec=30.0, tolerance=0.0), "global_first")
    assert len(out) == 900 and sum(v[0] for v in out.values()) == 10
    out = quota.select([*rows, {**rows[0], "id": None}], quota.Budget(max_sec=30.0, tolerance=0.0), "global_first")
    assert len(out) == 901 and out[None] == (False, None, "global_duration")


def test_a_task_of_the_sweep_holds_so_many_actions_however_many_there_are(spark, monkeypatch):
    monkeypatch.setattr(timeline, "ROWS", 50)
    rows = [(k % 40, "abc"[k % 3], float(k % 17), k % 17 + 1.5 + k % 5) for k in range(1200)]
    acts = spark.createDataFrame(rows, "id long, category string, start double, end double")
    durations = spark.createDataFrame([(k, 12.0 + k % 9) for k in range(41)], "id long, duration double")
    s = timeline.allocated_seconds(acts, durations, "id", "category", "start", "end", "duration")
    assert s.rdd.getNumPartitions() >= 24
    whole = F.array_sort(F.collect_list(F.struct("category", "start", "end")))
    lists = durations.join(acts.groupBy("id").agg(whole.alias("a")), "id", "left").withColumn("a", F.coalesce("a", F.array().cast("array<struct<category:string,start:double,end:double>>")))
    want = lists.select("id", F.explode(intervals.allocated(intervals.segments(intervals.clip(F.col("a"), F.col("duration")), F.col("duration"))))).where("value > 0")
    plain = lambda df: {(r[0], r[1]): round(r[2], 9) for r in df.collect()}
    assert plain(s) == plain(want) and plain(s)[40, "unknown"] == 16.0
