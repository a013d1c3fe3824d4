"""Percentiles by group, rotation vectors, and frames and metrics made from joint rows."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stridelake.functions import vectors
from stridelake.operators import dedup, joints, metrics, ranks, trajectory
from stridelake.operators.scratch import Scratch


@pytest.mark.parametrize("large", [1_000_000, 20])
def test_group_quantiles_against_numpy(spark, monkeypatch, large):
    monkeypatch.setattr(metrics, "LARGE", large)
    monkeypatch.setattr(metrics, "BINS", 7)
    rnd = random.Random(3)
    rows = [(g, rnd.choice([rnd.random(), 0.5, float("nan"), None]), rnd.randrange(4)) for g in ("a", "b", None) for _ in range(150)] + [("one", 2.0, 1), ("none", None, None)]
    d = spark.createDataFrame(rows, "g string, x double, y int")
    wanted = {"x1": ("x", 0.01), "xm": ("x", 0.5), "ym": ("y", 0.5), "y9": ("y", 0.99)}
    got = {r.g: r for r in metrics.group_quantiles(d, ["g"], {n: (F.col(c), s) for n, (c, s) in wanted.items()}).collect()}
    assert set(got) == {"a", "b", None, "one"}
    for g, r in got.items():
        for n, (c, s) in wanted.items():
            own = [v for k, x, y in rows if k == g and (v := x if c == "x" else y) is not None and v == v]
            assert r[n] == pytest.approx(float(np.percentile(own, 100 * s)), rel=1e-12)
    back = metrics.joined(d, metrics.group_quantiles(d, ["g"], {"m": (F.col("y"), 0.5)}), ["g"])
    assert back.count() == len(rows) and back.where("g is null and m is null").count() == 0
    table = metrics.quantile_table(d, ["x", "y"], {"a": 0.0, "b": 1.0, "c": 0.37})
    for r in table.collect():
        own = [float(v) for _, x, y in rows if (v := x if r.metric == "x" else y) is not None and v == v]
        if r.metric == "y":
            assert (r.a, r.b, r.c) == (min(own), max(own), pytest.approx(float(np.percentile(own, 37))))


def test_rotation_vectors_turn_the_shorter_way(spark):
    rng = np.random.default_rng(1)
    turns = [v / np.linalg.norm(v) * a for v in rng.normal(size=(20, 3)) for a in (0.0, 1e-9, 1.0, 3.1, 3.2, 6.0)]
    d = spark.createDataFrame([(k, [float(c) for c in v]) for k, v in enumerate(turns)], "k int, v array<double>")
    q = vectors.rotvec_to_quaternion(F.col("v"))
    for r in d.select("k", vectors.rotation_vector(q).alias("v"), vectors.rotation_vector(F.transform(q, lambda c: -c)).alias("w")).collect():
        v = turns[r.k]
        n = np.linalg.norm(v)
        want = v if n <= math.pi else v / n * (n - 2 * math.pi)
        assert np.allclose(r.v, want, atol=1e-12) and np.allclose(r.w, want, atol=1e-9 if n else 1e-12)


def test_velocities_of_single_frames_and_of_time_that_stands_still(spark):
    half = math.sqrt(0.5)
    rows = [(1, 0, 0.0, [1.0, 0.0, 0.0, 0.0], 1.0), (2, 0, 0.0, [1.0, 0.0, 0.0, 0.0], 1.0), (2, 1, 0.5, [half, 0.0, 0.0, half], 4.0), (2, 2, 1.0, [0.0, 0.0, 0.0, 1.0], 5.0)]
    d = spark.createDataFrame(rows, "s int, f int, t double, q array<double>, x double")
    both = lambda d: {(r.s, r.f): (r.v, r.w) for r in d.select("s", "f", trajectory.central_difference("x", "t", "s", "f").alias("v"), trajectory.angular_velocity("q", "t", "s", "f").alias("w")).collect()}
    got = both(d)
    assert got[1, 0] == (0.0, [0.0, 0.0, 0.0])
    assert [got[2, k][0] for k in range(3)] == [6.0, 4.0, 2.0]
    assert all(np.allclose(got[2, k][1], [0, 0, math.pi]) for k in range(3))
    with pytest.raises(Exception, match="strictly increasing: 2"):
        both(d.withColumn("t", F.when(F.col("f") == 1, 0.0).otherwise(F.col("t"))))


def plain_turns(poses):
    def quaternion(v):
        h = np.linalg.norm(v) / 2
        return np.r_[math.cos(h), np.asarray(v) * (math.sin(h) / (2 * h) if h > 1e-12 else 0.5)]

    out = [None]
    for a, b in zip(poses, poses[1:]):
        out.append([2 * math.acos(min(1.0, abs(float(quaternion(u) @ quaternion(v))))) for u, v in zip(a, b)])
    return out


def test_frames_of_joint_rows_against_numpy(spark):
    rng = np.random.default_rng(5)
    at, turn = rng.normal(size=(2, 6, 22, 3)), rng.normal(size=(2, 6, 21, 3))
    rows = [(s, f, j, *map(float, at[s, f, j]), *(map(float, turn[s, f, j - 1]) if j else (None,) * 3)) for s in range(2) for f in range(6) for j in range(22)]
    d = spark.createDataFrame(rows, "s int, f int, j int, x double, y double, z double, a double, b double, c double")
    got = {(r.s, r.f): r for r in joints.joint_frames(d, d.where("j > 0"), "s", "f", "j", ("x", "y", "z"), ("a", "b", "c"), Scratch(spark, "test")).collect()}
    assert len(got) == 12
    away = lambda p, a, b: np.linalg.norm(p[:, a] - p[:, b], axis=1)

    def bend(p, a, m, b):
        u, v = p[:, a] - p[:, m], p[:, b] - p[:, m]
        return np.degrees(np.arccos(np.clip((u * v).sum(1) / np.maximum(np.linalg.norm(u, axis=1) * np.linalg.norm(v, axis=1), 1e-8), -1, 1)))

    for s in range(2):
        p = at[s]
        scale = np.median(sum(away(p, a, b) for a, b in [(0, 1), (1, 4), (4, 7), (7, 10), (0, 3), (3, 6), (6, 9), (9, 12), (12, 15)]))
        z = p[:, :, 2]
        foot = z[:, [7, 8, 10, 11]].min(1)
        ground = np.percentile(foot, 1)
        want = {
            "foot": foot,
            "ground": np.full(6, ground),
            "pelvis": (z[:, 0] - ground) / scale,
            "head": (z[:, 15] - ground) / scale,
            "wrist": (z[:, [20, 21]].mean(1) - ground) / scale,
            "knee": (z[:, [4, 5]].mean(1) - ground) / scale,
            "span": (z.max(1) - z.min(1)) / scale,
            "torso": np.abs(p[:, 15, 2] - p[:, 0, 2]) / away(p, 15, 0),
            "knee_angle": np.minimum(bend(p, 1, 4, 7), bend(p, 2, 5, 8)),
            "elbow": np.minimum(bend(p, 16, 18, 20), bend(p, 17, 19, 21)),
            "wrist_span": away(p, 20, 21) / scale,
            "wrist_drop": (z[:, [16, 17]].mean(1) - z[:, [20, 21]].mean(1)) / scale,
            "root_step": np.r_[np.nan, np.linalg.norm(np.diff(p[:, 0], axis=0), axis=1)],
        }
        turns = plain_turns(turn[s])
        for f in range(6):
            r = got[s, f]
            for name, values in want.items():
                assert (r[name] is None) if name == "root_step" and not f else r[name] == pytest.approx(values[f], rel=1e-9), (name, s, f)
            assert (r.turn_sum is None) if not f else (r.turn_sum, r.turn_mean, r.turn_max) == pytest.approx((sum(turns[f]), np.mean(turns[f]), max(turns[f])), rel=1e-6)
    few = joints.descriptors(joints.joint_frames(d, d.where("j > 0"), "s", "f", "j", ("x", "y", "z"), ("a", "b", "c"), Scratch(spark, "test")), "s", "f", 3).collect()
    for r in few:
        assert np.allclose(r.pose, turn[r.s][[0, 2, 5]].ravel()) and np.allclose(r.root, (at[r.s][[0, 2, 5], 0] - at[r.s][0, 0]).ravel())


@pytest.mark.parametrize("large", [1_000_000, 10])
def test_ranks_and_keepers_of_large_groups(spark, monkeypatch, large):
    monkeypatch.setattr(ranks, "LARGE", large)
    rnd = random.Random(9)
    rows = [(g, k, rnd.randrange(5), rnd.choice("xyz")) for g, n in (("a", 90), ("b", 3), (None, 20)) for k in range(n)]
    d = spark.createDataFrame(rows, "g string, k int, v int, s string")
    got = {(r.g, r.k): (r.r, r.kept) for r in dedup.keep_diverse(ranks.ranked(d, ["g"], [F.desc("v"), F.asc("k")], "r"), "g", "s", [F.desc("v"), F.asc("k")], 4).collect()}
    for g in ("a", "b", None):
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[2], r[1]))
        assert [got[g, r[1]][0] for r in own] == list(range(1, len(own) + 1))
        first = [next(r for r in own if r[3] == s) for s in {r[3] for r in own}]
        want = sorted(first, key=own.index)[:4]
        want += [r for r in own if r not in want and r not in first][: 4 - len(want)]
        assert {k for (h, k), (_, kept) in got.items() if h == g and kept} == {r[1] for r in want}


def test_hashes_of_arrays_tell_length_and_order(spark):
    d = spark.createDataFrame([(1, [1.0, 2.0]), (2, [2.0, 1.0]), (3, [1.0]), (4, [2.0]), (5, []), (6, None), (7, [1.0, None]), (8, [1.0, 2.0])], "k int, v array<double>").coalesce(1)
    got = {r.k: r.h for r in d.select("k", dedup.exact_hash("v").alias("h")).collect()}
    for k, v in {1: [1.0, 2.0], 3: [1.0], 5: [], 7: [1.0, float("nan")]}.items():
        a = np.array(v, np.float64)
        assert got[k] == hashlib.sha1(str(a.shape).encode() + a.dtype.str.encode() + a.tobytes()).hexdigest()
    assert got[6] is None and got[8] == got[1] and len(set(got.values())) == 7
