"""A run's stages, counters and frozen inputs, and cases of a selection that the tables don't have."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from stridelake.operators import digests, quota, rules, selection, timeline
from stridelake.sources import files


def test_trees_tell_changed_new_and_lost_files(spark, tmp_path):
    root = tmp_path / "in"
    for k in range(60):
        at = root / f"d{k % 7}" / f"f{k}.txt"
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(f"content {k}")
    tree = lambda depth=None: files.digest_tree(spark, str(root), depth)
    before = spark.createDataFrame(tree().collect(), tree().schema)
    depth = before.agg(F.max("level")).first()[0] - 1
    assert before.where("level = 0").count() == 1 and before.where(F.col("level") == depth + 1).count() == 60
    assert digests.differences(before, tree(depth), depth).count() == 0
    (root / "d1" / "f1.txt").write_text("other")
    (root / "d2" / "f2.txt").unlink()
    (root / "new.txt").write_text("new")
    changed = sorted(r.name.rsplit("/", 1)[-1] for r in digests.differences(before, tree(depth), depth).collect())
    assert changed == ["f1.txt", "f2.txt", "new.txt"]
    for p in root.rglob("*.txt"):
        p.unlink()
    assert digests.differences(before, tree(depth), depth).count() == 60


def test_ordered_digests_of_groups_larger_than_a_batch(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [(g, k) for g in ("a", "b", None) for k in range({"a": 50, "b": 1}.get(g, 3))]
        got = {r.g: (r.sha1, r.rows) for r in digests.ordered_sha1(spark.createDataFrame(rows, "g string, k int"), "g", F.col("k").cast("string")).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for g in ("a", "b", None):
        lines = sorted(str(k) for h, k in rows if h == g)
        assert got[g] == (hashlib.sha1("\n".join(lines).encode()).hexdigest(), len(lines))


@pytest.mark.parametrize("hot", [100_000, 3])
@pytest.mark.parametrize("width", [0.7, 4.0, 100.0])
def test_range_joins_find_each_overlap_once(spark, monkeypatch, hot, width):
    monkeypatch.setattr(timeline, "HOT", hot)
    rnd = random.Random(4)
    make = lambda n: [(rnd.choice("xy"), k, float(s := rnd.randrange(-20, 20)), float(s + rnd.choice([0, 1, 2, 9]))) for k in range(n)]
    a, b = make(40), make(60)
    l, r = spark.createDataFrame(a, "k string, i int, s double, t double"), spark.createDataFrame(b, "k string, j int, u double, v double")
    got = sorted((x.i, x.j) for x in timeline.overlapping(l, r, "k", ("s", "t"), ("u", "v"), width).collect())
    assert got == sorted((i, j) for g, i, s, t in a for h, j, u, v in b if g == h and s < v and u < t and s < t and u < v)


def test_a_run_counts_on_the_way_and_fails_on_changed_inputs(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps({"a": 1}))
    run = selection.Run(spark, "test", (str(tmp_path / "in"),))
    kept = run.stage("first", spark.range(10), {"even": F.count_if(F.col("id") % 2 == 0), "sum": F.sum("id")})
    run.stage("none", kept.where("id < 0"), {"sum": F.sum("id")})
    assert sorted(map(tuple, run.counters().collect())) == [("first", "even", 5), ("first", "rows", 10), ("first", "sum", 45), ("none", "rows", 0), ("none", "sum", 0)]
    run.finish()
    (tmp_path / "in" / "b.json").write_text("{}")
    with pytest.raises(RuntimeError, match="b.json"):
        run.finish()


KEYS = "k0 string, k1 string, k2 string, k3 string"
BODY = [(0, 0, 0.95), (0, 0.09, 0.87), (0, -0.09, 0.87), (0, 0, 1.05), (0, 0.1, 0.48), (0, -0.1, 0.48), (0, 0, 1.18), (0, 0.1, 0.08), (0, -0.1, 0.08), (0, 0, 1.24), (0.13, 0.1, 0.02)]
BODY += [(0.13, -0.1, 0.02), (0, 0, 1.45), (0, 0.07, 1.37), (0, -0.07, 1.37), (0, 0, 1.55), (0, 0.17, 1.4), (0, -0.17, 1.4), (0, 0.2, 1.1), (0, -0.2, 1.1), (0, 0.2, 0.9), (0, -0.2, 0.9)]


def given(spark, motions, annotations, actions, bodies):
    m = spark.createDataFrame([(i, f"p{i}", None, None, None, "s", "x", 5.0, 30.0, float(q), False, False, bad) for i, q, bad in motions], f"motion_id bigint, {KEYS}, source string, subject string, duration double, fps double, quality double, corrupt boolean, missing boolean, invalid boolean")
    a = spark.createDataFrame([(k, f"p{i}", None, None, None, split) for k, i, split in annotations], f"ann_id bigint, {KEYS}, split string")
    act = spark.createDataFrame(actions, "ann_id bigint, category string, start double, end double")
    rows = []
    for i, (lying, pace, bend) in bodies.items():
        for f in range(6):
            for j, (x, y, z) in enumerate(BODY):
                p = (z + pace * f, y, 0.1) if lying else (x + pace * f, y, z)
                rows.append((i, f, j, *map(float, p), *((None,) * 3 if j == 0 else (0.01 * f * (1 + j * bend % 7), 0.02 * j, 0.01 * f * ((j + bend) % 5)))))
    return selection.Inputs(m, a, act, spark.createDataFrame(rows, "motion_id bigint, frame bigint, joint int, x double, y double, z double, rx double, ry double, rz double"))


RULES = selection.Rules(
    hard=("fall",), soft=("talk",), points=3, neighbours=2, near={"cosine": 0.999, "ratio": 0.5, "root": 0.05}, exact={"cosine": 1.1}, keep=1, joint_threshold=0.0,
    budget=quota.Budget(max_sec=12.0, max_count=10, tolerance=0.0), policy=rules.Policy({"A": ["walk"], "R": ["run"]}), label_seconds=0.5,
)


def test_a_selection_follows_its_stages(spark):
    """1 is kept; 2 falls, 3 lies, 4 is unreadable, 5 is 6's copy, 6 and 7 share the rest, 8 has two annotations, 9 talks too long."""
    bodies = {i: (i == 3, 0.02, 5 if i in (5, 6) else i) for i in range(1, 10)}
    motions = [(i, 10 - i if i != 1 else 20, i == 4) for i in range(1, 10)]
    annotations = [(i, i, "train") for i in range(1, 8)] + [(80, 8, "train"), (81, 8, "train"), (9, 9, "train")]
    actions = [(i, "walk", 0.0, 4.0) for i in range(1, 8)] + [(2, "fall", 1.0, 2.0), (9, "talk", 0.0, 4.5), (1, "run", 0.0, 0.2), (1, "jump", 6.0, 9.0)]
    run = selection.Run(spark, "test")
    inputs = given(spark, motions, annotations, actions, bodies)
    got = {r.motion_id: r for r in selection.select(run, inputs, RULES).collect()}
    status = {i: r.final_status for i, r in got.items()}
    assert status[2] == "reject_semantic_hard" and status[3] == "reject_floor_high_confidence" and status[4] == "reject_invalid_value" and status[9] == "reject_semantic_coverage"
    assert got[8].match_status == "ambiguous" and got[8].semantic_status == "babel_ambiguous"
    assert (got[5].dedup_status, got[6].dedup_status, got[6].duplicate_of, status[6]) == ("unique", "defer_exact_duplicate", 5, "defer_exact_duplicate")
    assert status[1] == "selected_candidate" and got[1].policy_status == "selected_candidate" and got[1].labels == ["walk"]
    chosen = [i for i, s in status.items() if s == "selected_candidate"]
    assert len(chosen) == 2 and all(s == "defer_global_budget" for i, s in status.items() if i in (5, 7, 8) and got[i].quota_status and i not in chosen)
    assert all(r.policy_status == "defer_not_in_v3_candidate" for i, r in got.items() if i not in chosen) and set(got) == set(range(1, 10))
    counted = {(r.stage, r.counter): r.n for r in run.counters().collect()}
    assert counted["final", "rows"] == 9 and counted["semantic", "reject_semantic_hard"] == 1 and counted["quota", "selected_candidate"] == 2
    inputs.motions = inputs.motions.unionByName(inputs.motions.limit(1))
    with pytest.raises(Exception, match="null or repeated"):
        selection.select(selection.Run(spark, "test"), inputs, RULES)
