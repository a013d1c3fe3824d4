"""Worked examples and models of the sequential operators."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stridelake.functions import intervals, normalize, vectors
from stridelake.operators import dedup, matching, metrics, plugins, quota, reports, rules, trajectory
from stridelake.operators.graph import connected_components
from stridelake.operators.scratch import Scratch
from stridelake.sources import files

ACTIONS = "array<struct<category:string,start:double,end:double>>"


def one(df):
    return df.collect()[0]


def test_timeline(spark):
    d = spark.createDataFrame([(10.0, [("A", 0.0, 4.0), ("B", 2.0, 6.0)])], f"d double, a {ACTIONS}")
    alloc = intervals.allocated(intervals.segments(F.col("a"), F.col("d")))
    r = one(d.select(alloc.alias("m"), intervals.primary_category(alloc).alias("p"), intervals.entropy(intervals.proportions(alloc, F.col("d"))).alias("h")))
    assert r.m == {"A": 3.0, "B": 3.0, "unknown": 4.0} and r.p == "unknown" and r.h == pytest.approx(1.0888999753)
    filled = intervals.fill_unlabeled(alloc, "fill_with_primary_seq_label", F.lit("A"))
    assert one(d.select(filled.alias("m"))).m == {"A": 7.0, "B": 3.0}
    assert one(d.select(intervals.fill_unlabeled(alloc, "ignore", F.lit("A")).alias("m"))).m == {"A": 3.0, "B": 3.0}


def test_interval_union_against_a_loop(spark):
    rnd = random.Random(3)
    rows = []
    for k in range(200):
        iv = [(float(a), float(a + rnd.randrange(1, 6))) for a in (rnd.randrange(20) for _ in range(rnd.randrange(6)))]
        rows.append((k, iv))
    d = spark.createDataFrame(rows, "k int, iv array<struct<start:double,end:double>>")
    got = {r.k: (r.u, [(x.start, x.end) for x in r.m]) for r in d.select("k", intervals.union_duration("iv").alias("u"), intervals.merge(F.col("iv")).alias("m")).collect()}
    for k, iv in rows:
        merged = []
        for s, e in sorted(iv):
            if merged and s <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(merged[-1][1], e))
            else:
                merged.append((s, e))
        assert got[k] == (sum(e - s for s, e in merged), merged)


def test_coverage_of_touching_intervals(spark):
    d = spark.createDataFrame([(10.0, [(0.0, 3.0), (2.0, 5.0)])], "d double, iv array<struct<start:double,end:double>>")
    assert one(d.select(intervals.coverage(F.col("iv"), F.col("d")).alias("c"))).c == 0.5


@pytest.mark.parametrize("sec,fps,status", [(1.0, 7.0, "review_short"), (20.0, 30.0, "defer_long"), (31.0, 30.0, "defer_very_long"), (10.0, 100.0, "defer_fps"), (10.0, 20.0, "defer_low_fps"), (10.0, 120.0, "basic_passed"), (10.0, 29.99995, "defer_low_fps"), (10.0, 30.002, "basic_passed")])
def test_basic_order(spark, sec, fps, status):
    no = F.lit(False)
    assert one(spark.range(1).select(rules.first_of(rules.basic_rules(F.lit(sec), F.lit(fps), no, no, no), "basic_passed").alias("s"))).s == status


BASE = dict.fromkeys(["static_fraction", "path_length", "joint_integral", "lying_fraction", "floor_fraction", "crawl_fraction", "sitting_fraction", "body_speed_p99", "jump_fraction", "extreme_fraction", "extreme_run", "root_speed_p99", "calibration_fraction", "calibration_run"], 0.0)


@pytest.mark.parametrize(
    "change,primary",
    [({"lying_fraction": 0.65}, "reject_floor_high_confidence"), ({"lying_fraction": 0.25}, "review_floor_or_crouch"), ({"floor_fraction": 0.36, "static_fraction": 0.85}, "review_multiple_heuristics"), ({"body_speed_p99": 45.0}, "review_body_speed"), ({"root_speed_p99": 6.0}, "review_body_speed"), ({"calibration_fraction": 0.2, "static_fraction": 0.8, "calibration_run": 1.0}, "reject_static_high_confidence"), ({"sitting_fraction": 0.8}, "review_sitting_or_squat"), ({"crawl_fraction": 0.3}, "review_crawling"), ({"root_speed_p99": 6.01}, "reject_abnormal_high_confidence"), ({}, "heuristic_passed")],
)
def test_three_tiers(spark, change, primary):
    values = {**BASE, **change}
    c = lambda n: F.lit(values[n]) if n in values else F.lit(False)
    assert one(spark.range(1).select(rules.three_tier(c, F.lit(0.0))["primary_reason"].alias("p"))).p == primary


def test_sampling(spark):
    d = spark.createDataFrame([(10, 2), (12, 3), (1, 4)], "n bigint, s int")
    assert [r.i for r in d.select(vectors.sample_indices(F.col("n"), F.col("s")).alias("i")).collect()] == [[0, 2, 4, 7, 9], [0, 4, 7, 11], [0]]


def test_bucket_and_cluster_names(spark):
    d = spark.createDataFrame([("m1",)], "id string")
    assert one(d.select(normalize.hash_bucket(7, F.col("id"), 13).alias("b"))).b == 0
    c = spark.createDataFrame([(1, "b"), (1, "a")], "c int, id string")
    assert one(dedup.cluster_name(c, "c", "id")).cluster_id == "cluster_fcd127ffa101"


def test_cascade_stops_on_ambiguity_and_reports_conflicts(spark):
    cols = "k0 string, k1 string, k2 string, k3 string"
    local = spark.createDataFrame([("l1", "a", "x", "p", "s"), ("l2", "b", "x", "p", "t"), ("l3", "c", "y", "q", "u")], f"local_id string, {cols}")
    ann = spark.createDataFrame([("1", "zz", "x", "p", "u"), ("2", "c", "n", "n", "n"), ("3", "n", "y", "n", "n"), ("4", None, None, None, None), ("5", "a", "n", "n", "n")], f"ann_id string, {cols}")
    got = {r.ann_id: (r.status, r.local_id) for r in matching.cascade_match(ann, local).collect()}
    assert got == {"1": ("ambiguous", None), "2": ("ambiguous_local_conflict", "l3"), "3": ("ambiguous_local_conflict", "l3"), "4": ("unmatched", None), "5": ("match_exact_path", "l1")}
    ends = {r.local_id: r.status for r in matching.local_status(matching.cascade_match(ann, local), local).collect()}
    assert ends == {"l1": "matched", "l2": "unmatched", "l3": "ambiguous"}


@pytest.mark.parametrize("subjects,kept", [("xxyz", [1, 3, 4]), ("xxxx", [1, 2, 3])])
def test_keep_rule(spark, subjects, kept):
    d = spark.createDataFrame([(0, k + 1, s) for k, s in enumerate(subjects)], "c int, id int, s string")
    assert sorted(r.id for r in dedup.keep_diverse(d, "c", "s", [F.col("id")]).where("kept").collect()) == kept


def test_components_against_union_find(spark):
    rnd = random.Random(5)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(230)]
    up = list(range(300))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    d = spark.createDataFrame(edges, "a bigint, b bigint")
    got = {r.id: r.component for r in connected_components(d, Scratch(spark, "t")).collect()}
    assert got and all(find(i) == c for i, c in got.items())
    assert connected_components(d.limit(0), Scratch(spark, "t")).count() == 0


def test_quaternion_continuity_against_a_loop(spark):
    rng = np.random.default_rng(1)
    q = rng.integers(-2, 3, (60, 4)).astype(float)
    rows = [(0, k, v.tolist()) for k, v in enumerate(q)]
    got = trajectory.continuous_quaternions(spark.createDataFrame(rows, "s int, f int, q array<double>"), "q", "s", "f").orderBy("f").collect()
    before = None
    for r, v in zip(got, q):
        v = -v if before is not None and before @ v < 0 else v
        np.testing.assert_array_equal(np.array(r.continuous) + 0.0, v + 0.0)
        before = v


def test_quota_ignores_order_and_keeps_bounds():
    rnd = random.Random(2)
    rows = [{"id": k, "score": rnd.random(), "duration": (d := rnd.uniform(1, 40)), "alloc": {rnd.choice("abc"): d * 0.7, "unknown": d * 0.3}, "source": f"s{rnd.randrange(4)}", "subject": f"u{rnd.randrange(6)}", "primary": "a", "dominance": 0.9} for k in range(200)]
    for r in rows:
        r["primary"] = min(c for c in r["alloc"] if c != "unknown")
    b = quota.Budget(max_sec=600, max_count=60, tolerance=10, categories={"a": quota.Limit(min_sec=50, max_ratio=0.3), "c": quota.Limit(max_ratio=0.0)}, source=quota.Limit(max_ratio=0.3, count_ratio=0.3), subject=quota.Limit(max_sec=90, max_count=6))
    out = quota.select(rows, b)
    assert out == quota.select(rows[::-1], b)
    chosen = [r for r in rows if out[r["id"]][0]]
    total = sum(r["duration"] for r in chosen)
    assert 0 < total <= 610 and sum(r["alloc"].get("c", 0.0) for r in chosen) <= 10
    for s in {r["source"] for r in chosen}:
        assert sum(r["duration"] for r in chosen if r["source"] == s) <= 0.3 * total + 1e-6


def test_longest_run_and_empty(spark):
    d = spark.createDataFrame([(1, k, m) for k, m in enumerate([True, True, False, True, None])] + [(2, 0, False)], "s int, f int, m boolean")
    assert {r.s: r.longest_run for r in metrics.longest_run(d, "s", "f", F.col("m")).collect()} == {1: 2, 2: 0}
    assert metrics.longest_run(d.limit(0), "s", "f", F.col("m")).count() == 0


def test_unicode_labels(spark):
    d = spark.createDataFrame([("  Straße  ＡＢ ",), (None,)], "s string")
    assert [r.x for r in d.select(normalize.normalize_label_unicode("s").alias("x")).collect()] == ["strasse ab", None]


def test_slerp_and_angles(spark):
    a, b = [1.0, 0.0, 0.0, 0.0], [float(np.cos(0.5)), float(np.sin(0.5)), 0.0, 0.0]
    d = spark.createDataFrame([(a, b)], "a array<double>, b array<double>")
    r = one(d.select(vectors.slerp(F.col("a"), F.col("b"), F.lit(0.5)).alias("m"), vectors.quaternion_angle(F.col("a"), F.col("b")).alias("t"), vectors.angular_displacement(F.col("a"), F.col("b")).alias("u")))
    assert r.m[:2] == pytest.approx([np.cos(0.25), np.sin(0.25)]) and r.t == pytest.approx(1.0) and r.u == pytest.approx(1.0)


def test_archives_and_annotations(spark, tmp_path):
    np.savez(tmp_path / "a_poses.npz", poses=np.ones((4, 6)), trans=np.zeros((4, 3)), mocap_framerate=2.0, gender="female", betas=np.zeros(2))
    np.savez(tmp_path / "b.npz", poses=np.full((3, 6), np.nan), mocap_framerate=30.0)
    (tmp_path / "c.npz").write_bytes(b"broken")
    found = files.discover(spark, str(tmp_path), "*.npz", content=True)
    heads = {r.path.rsplit("/", 1)[1]: r for r in files.read_archives(found).collect()}
    assert heads["a_poses.npz"].duration_sec == 2.0 and heads["a_poses.npz"].gender == "female"
    assert heads["a_poses.npz"].expected_frames_30 == 60 and heads["a_poses.npz"].lengths_match and heads["a_poses.npz"].exact_hash
    (tmp_path / "far").mkdir()
    near = {"poses": np.ones((4, 6)) + 1e-6, "trans": np.full((4, 3), 5.0), "mocap_framerate": 2.0}
    (tmp_path / "far" / "n.npz").write_bytes(files.npz_bytes(near))
    other = one(files.read_archives(files.discover(spark, str(tmp_path / "far"), "*.npz", content=True)))
    assert other.near_hash == heads["a_poses.npz"].near_hash and other.exact_hash != heads["a_poses.npz"].exact_hash
    assert files.npz_bytes(near) == files.npz_bytes(dict(reversed(near.items())))
    ids = {r.relative_path: (r.source, r.subject, r.name) for r in files.base_records(files.discover(spark, str(tmp_path), "*.npz"), str(tmp_path)).collect()}
    assert ids["far/n.npz"] == (tmp_path.name, "far", "n") and ids["c.npz"] == (tmp_path.name, "", "c")
    assert heads["b.npz"].has_nan and not heads["b.npz"].has_translation and heads["b.npz"].near_hash is None and heads["b.npz"].missing == ["trans"] and heads["c.npz"].error
    assert files.archive_frames(found.where("path like '%a_poses%'")).count() == 4
    with pytest.raises(Exception, match="bad archive"):
        files.strict(files.read_archives(found)).collect()
    (tmp_path / "train.json").write_text('{"7": {"feat_p": "x/y", "dur": 3.5, "seq_ann": {"labels": [{"raw_label": "walk", "proc_label": "walk", "act_cat": ["walk"]}]}, "frame_ann": null}}')
    r = one(files.read_annotations(spark, str(tmp_path / "train.json")))
    assert (r.ann_id, r.split, r.duration, len(r.seq_labels), r.frame_labels) == ("7", "train", 3.5, 1, [])


def test_sinks_refuse_to_overwrite(spark, tmp_path):
    d = spark.createDataFrame([(1, {"b": 2.0, "a": 1.0}, None)], "id int, m map<string,double>, n string")
    files.write_csv(d, str(tmp_path / "c"))
    with pytest.raises(Exception, match="exist|EXIST"):
        files.write_csv(d, str(tmp_path / "c"))
    files.write_jsonl(d, str(tmp_path / "j"))
    assert files.read_jsonl(spark, str(tmp_path / "j"), "id int, n string").count() == 1
    files.replace_table(d, str(tmp_path / "t"))
    files.replace_table(d.union(d), str(tmp_path / "t"))
    old = files.read_table(spark, str(tmp_path / "t"))
    assert old.count() == 2
    files.replace_table(d, str(tmp_path / "t"))
    assert (files.read_table(spark, str(tmp_path / "t")).count(), old.count()) == (1, 2)  # who has begun to read goes on
    with pytest.raises(FileNotFoundError):
        files.read_table(spark, str(tmp_path / "none"))


def test_named_bundles_and_manifests(spark, tmp_path):
    records = spark.createDataFrame([("m1", "heuristic_passed", "semantic_passed", "selected_candidate", 3), ("m2", "review_heuristic", "semantic_passed", "review_static", 4)], "motion_id string, heuristic_status string, semantic_status string, final_status string, extra int")
    small = records.select("motion_id")
    files.write_first_selection(records, small, small, small, str(tmp_path / "one"))
    assert len(list((tmp_path / "one").iterdir())) == 7 and spark.read.json(f"{tmp_path}/one/candidate_v1.jsonl").count() == 1
    assert next((tmp_path / "one" / "amass_inventory.csv").glob("part*")).read_bytes().startswith(b"\xef\xbb\xbfmotion_id,")
    files.write_refined_selection(records, small, {"quota_report.json": small}, str(tmp_path / "two"))
    assert spark.read.json(f"{tmp_path}/two/review_candidates.jsonl").first().motion_id == "m2"
    files.write_lines(records, "motion_id", str(tmp_path / "ids.txt"))
    assert files.read_path_list(spark, str(tmp_path / "ids.txt")).count() == 2
    (tmp_path / "bad.jsonl").write_text('{"id": 1}\n\n{"id": \n')
    with pytest.raises(Exception, match=r"bad\.jsonl:3: not JSON"):
        files.read_jsonl_strict(spark, str(tmp_path / "bad.jsonl"), "id int").collect()
    (tmp_path / "c.yaml").write_text("quota: {max: 3}")
    assert files.load_config(str(tmp_path / "c.yaml"), ["quota"])["quota"]["max"] == 3
    with pytest.raises(ValueError, match="no section other"):
        files.load_config(str(tmp_path / "c.yaml"), ["quota", "other"])
    frames = spark.createDataFrame([("a", 1, [1.0, 2.0]), ("a", 0, [3.0, 4.0]), ("b", 0, [5.0, 6.0])], "seq string, frame int, pose array<double>")
    assert sorted(r.frames for r in files.write_archives(frames, "seq", "frame", ["pose"], str(tmp_path / "out")).collect()) == [1, 2]
    assert np.load(tmp_path / "out" / "a.npz")["pose"].tolist() == [[3.0, 4.0], [1.0, 2.0]]
    with pytest.raises(ValueError, match="not below"):
        files.delete_below(spark, str(tmp_path / "out"), str(tmp_path / "one"))
    files.delete_below(spark, str(tmp_path), str(tmp_path / "out"))
    assert not (tmp_path / "out").exists()


def test_quota_against_plain_loops():
    """The passes written out once more, as the rules read, for both orders of checks."""
    for seed, order in [(s, o) for s in range(4) for o in ("global_first", "category_first")]:
        rnd = random.Random(seed)
        rows = []
        for k in range(120):
            d, own, p = rnd.choice([rnd.uniform(1, 40), 0.0]) if k % 20 == 0 else rnd.uniform(1, 40), rnd.choice("abc"), rnd.choice([0.6, 0.9])
            rows.append({"id": k, "score": round(rnd.random(), 2), "duration": d, "alloc": {own: d * p, "unknown": d * (1 - p)}, "source": f"s{rnd.randrange(3)}", "subject": f"u{rnd.randrange(4)}", "primary": own, "dominance": p if d else 0.0})
        L = quota.Limit
        b = quota.Budget(max_sec=500, max_count=40, categories={"a": L(min_sec=60, max_ratio=0.2, max_count=9), "b": L(min_sec=30, max_sec=90), "c": L(max_ratio=0.0), "unknown": L(max_ratio=0.3)}, source=L(max_ratio=0.5, count_ratio=0.5), sources={"s0": L(max_ratio=0.2, count_ratio=0.5)}, subject=L(max_sec=90, max_count=6))

        def run(base, count):
            took, why = {}, {}
            chosen = lambda f=lambda r: True: [r for r in rows if r["id"] in took and f(r)]
            seconds = lambda c: sum(r["alloc"].get(c, 0) for r in sorted(chosen(), key=lambda r: took[r["id"]][1]))

            def refuse(r):
                n, sec = len(took), sum(x["duration"] for x in sorted(chosen(), key=lambda x: took[x["id"]][1]))
                whole = "global_count" if n + 1 > 40 else "global_duration" if sec + r["duration"] > 510 else None
                if order == "global_first" and whole:
                    return whole
                for c in sorted(r["alloc"]):
                    l = b.categories[c]
                    top = min([x for x in (l.max_sec, None if l.max_ratio is None else l.max_ratio * 500) if x is not None])
                    long = c == r["primary"] and r["dominance"] >= 0.8 and seconds(c) + r["alloc"][c] > top + 10
                    many = l.max_count is not None and c == r["primary"] and len(chosen(lambda x: x["primary"] == c)) + 1 > l.max_count
                    for broken, what in [(many, "count"), (long, "duration")][:: 1 if order == "global_first" else -1]:
                        if broken:
                            return f"category_{what}"
                if order == "global_first":
                    return None
                mine = chosen(lambda x: x["source"] == r["source"])
                if sum(x["duration"] for x in sorted(mine, key=lambda x: took[x["id"]][1])) + r["duration"] > (0.2 if r["source"] == "s0" else 0.5) * base:
                    return "source_duration"
                if len(mine) + 1 > int(0.5 * count):
                    return "source_count"
                mine = [x for x in mine if x["subject"] == r["subject"]]
                if sum(x["duration"] for x in sorted(mine, key=lambda x: took[x["id"]][1])) + r["duration"] > 90:
                    return "subject_duration"
                return "subject_count" if len(mine) + 1 > 6 else whole

            for c, low in (("b", 30), ("a", 60)):
                for r in sorted(rows, key=lambda r: (-r["alloc"].get(c, 0), -r["score"], r["id"])):
                    if seconds(c) < low and r["id"] not in took and r["alloc"].get(c, 0) > 0 and refuse(r) is None:
                        took[r["id"]] = (f"minimum_{c}", len(took))
            for r in sorted(rows, key=lambda r: (-r["score"], r["id"])):
                if r["id"] not in took:
                    why[r["id"]] = refuse(r)
                    if why[r["id"]] is None:
                        took[r["id"]] = ("score", len(took))
            return took, why

        base, count = 500.0, 40
        while True:
            took, why = run(base, count)
            after = (min(base, sum(r["duration"] for r in sorted([r for r in rows if r["id"] in took], key=lambda r: took[r["id"]][1]))), min(count, len(took)))
            if order == "global_first" or after == (base, count):
                break
            base, count = after
        want = {r["id"]: (True, took[r["id"]][0], None) if r["id"] in took else (False, None, why[r["id"]]) for r in rows}
        assert quota.select(rows, b, order) == want
        assert len({w[2] for w in want.values()}) > 2


def test_resume_and_selection(spark):
    p = spark.createDataFrame([(1, "x"), (2, "y")], "id int, cfg string")
    assert [r.id for r in reports.resume(p, p.where("id = 1"), "id", ["cfg"]).collect()] == [2]
    with pytest.raises(Exception, match="another identity"):
        reports.resume(p, spark.createDataFrame([(1, "z")], "id int, cfg string"), "id", ["cfg"]).collect()
    ids = spark.createDataFrame([(2, 0), (1, 1)], "id int, ordinal int")
    assert [r.id for r in reports.select_items(p, ids, "id").collect()] == [2, 1]
    with pytest.raises(plugins.MissingPlugin):
        plugins.retarget(p, ["id"], "id", "id int")
