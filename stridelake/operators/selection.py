"""A whole selection from raw inputs to final statuses, as stages that are written once.

Annotations are matched to motions, their actions cover timelines, headers are checked, joints
measured, duplicates resolved and budgets applied; each decision works on what the stages before
made of it.  A second, narrower selection under a label policy follows on the first one's frozen candidates.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from stridelake.functions import intervals
from stridelake.operators import dedup, digests, joints, matching, metrics, quota, rules, timeline
from stridelake.operators.scratch import Scratch
from stridelake.session import shuffled_joins
from stridelake.sources import files


class Run:
    """Stages in the shared folder, counted while they are written, over inputs that have to stay as they are.

    ``frozen`` are folders or files whose digests are taken before the first stage and again in ``finish``.
    """

    def __init__(self, spark: SparkSession, label: str = "run", frozen: tuple[str, ...] = ()):
        self.spark, self.scratch = spark, Scratch(spark, label)
        self.observed: list[tuple[str, Observation]] = []
        self.frozen = frozen
        self.before = self.scratch.keep(files.digest_tree(spark, list(frozen)), "before") if frozen else None  # one tree for all

    def stage(self, name: str, rows: DataFrame, counters: dict[str, Column] | None = None) -> DataFrame:
        """``rows``, written and read back.  ``counters`` are aggregates that the writing tasks add up on their way."""
        seen = Observation(name)
        kept = self.scratch.keep(rows.observe(seen, F.count(F.lit(1)).alias("rows"), *(c.cast("bigint").alias(n) for n, c in (counters or {}).items())), name)
        self.observed.append((name, seen))
        return kept

    def counters(self) -> DataFrame:
        """``stage, counter, n`` of the stages written so far; no table is read for them."""
        found = [(name, counter, int(n or 0)) for name, seen in self.observed for counter, n in seen.get.items()]
        return self.spark.createDataFrame(found, "stage string, counter string, n bigint")

    def finish(self) -> None:
        """RuntimeError if a frozen input isn't what it was."""
        if self.before is None:
            return
        with shuffled_joins(self.spark):
            self._compare()

    def _compare(self) -> None:
        depth = self.before.agg(F.max("level").alias("d")).first()["d"] - 1
        changed = [r["name"] for r in digests.differences(self.before, files.digest_tree(self.spark, list(self.frozen), depth), depth).limit(20).collect()]
        if changed:
            raise RuntimeError(f"inputs changed during the run: {', '.join(sorted(changed))}")


@dataclass
class Inputs:
    """Tables of a selection; all that say ``motion_id`` mean a row of ``motions``.

    ``motions``: ``motion_id, k0..k3, source, subject, duration, fps, quality, corrupt, missing, invalid``;
    ``annotations``: ``ann_id, k0..k3, split``; ``actions``: ``ann_id, category, start, end``;
    ``joints``: ``motion_id, frame, joint``, places ``x, y, z`` and rotation vectors ``rx, ry, rz``, null at the root.
    """

    motions: DataFrame
    annotations: DataFrame
    actions: DataFrame
    joints: DataFrame


@dataclass
class Rules:
    hard: tuple[str, ...] = ()
    soft: tuple[str, ...] = ()
    hard_seconds: float = 0.0
    coverage: float = 0.35
    sit_labels: tuple[str, ...] = ("sitting",)
    basic: rules.BasicLimits = field(default_factory=rules.BasicLimits)
    pose_limit: float = 100.0
    trans_limit: float = 1000.0
    tiers: rules.TierLimits = field(default_factory=rules.TierLimits)
    joint_threshold: float | None = None
    points: int = 32
    neighbours: int = 20
    exact: dict = field(default_factory=dict)
    near: dict = field(default_factory=dict)
    keep: int = 3
    budget: quota.Budget = field(default_factory=quota.Budget)
    policy: rules.Policy = field(default_factory=rules.Policy)
    label_seconds: float = 0.10


def _counted(column: str, *values: str) -> dict[str, Column]:
    return {v: F.count_if(F.col(column) == v) for v in values}


def matched(run: Run, given: Inputs) -> DataFrame:
    """``motion_id, ann_id, split, match_status``: a motion has one annotation, or none and why."""
    local = given.motions.select(F.col("motion_id").alias("local_id"), "k0", "k1", "k2", "k3")
    found = run.stage("match", matching.cascade_match(given.annotations.drop("split"), local), {"matched": F.count_if(F.col("status").startswith("match_")), **_counted("status", "unmatched", "ambiguous", "ambiguous_local_conflict")})
    status = matching.local_status(found, local).withColumnRenamed("status", "match_status")
    own = found.where(F.col("status").startswith("match_")).select(F.col("local_id").alias("__l"), "ann_id").join(given.annotations.select("ann_id", "split"), "ann_id")
    out = status.join(own, F.col("local_id") == F.col("__l"), "left")
    return run.stage("motion_match", out.select(F.col("local_id").alias("motion_id"), "ann_id", "split", "match_status"), _counted("match_status", "matched", "ambiguous", "unmatched"))


def annotated(run: Run, given: Inputs, rule: Rules, match: DataFrame) -> DataFrame:
    """``motion_id, alloc, labels, semantic_status, semantic_status_reason, sit_supported, primary_category, dominance``.

    Actions are rows throughout; what comes back to a motion is a sum for each category.
    """
    held = match.join(given.motions.select("motion_id", "duration"), "motion_id")
    acts = given.actions.join(held.where("match_status = 'matched'").select("ann_id", "motion_id"), "ann_id").select("motion_id", "category", "start", "end")
    acts = run.stage("actions", timeline.clipped(acts, held, "motion_id", "start", "end", "duration"))
    soft = timeline.union_seconds(acts.where(F.col("category").isin(*rule.soft)), "motion_id", "start", "end").withColumnRenamed("seconds", "__soft")
    shares = timeline.allocated_seconds(acts, held.select("motion_id", "duration"), "motion_id", "category", "start", "end", "duration")
    alloc = shares.groupBy("motion_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "seconds")))).alias("alloc"))  # as many as there are categories
    length = F.col("end") - F.col("start")
    own = acts.groupBy("motion_id").agg(
        F.array_sort(F.collect_set(F.when(length >= rule.label_seconds, F.col("category")))).alias("labels"),
        F.coalesce(F.bool_or(F.col("category").isin(*rule.hard) & (length > rule.hard_seconds)), F.lit(False)).alias("__hard"),
    )
    both = held.join(alloc, "motion_id", "left").join(soft, "motion_id", "left").join(own, "motion_id", "left")
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>"))
    both = both.withColumns({"alloc": F.coalesce("alloc", none), "labels": F.coalesce("labels", F.array().cast("array<string>")), "__hard": F.coalesce("__hard", F.lit(False))})
    covered = F.when(F.col("duration") > 0, F.coalesce("__soft", F.lit(0.0)) / F.col("duration")).otherwise(F.lit(0.0))
    found = rules.first_of(rules.semantic_rules_of(F.when(F.col("__hard"), F.array(F.lit("hard"))).otherwise(F.array().cast("array<string>")), covered, ["hard"], rule.coverage), "semantic_passed")
    status = F.when(F.col("match_status") == "matched", found).otherwise(F.concat(F.lit("babel_"), F.col("match_status")))
    reason = F.when(status == "reject_semantic_coverage", F.concat(F.lit("coverage="), F.format_string("%.4f", covered))).otherwise(status)
    out = both.select(
        "motion_id", "alloc", "labels", "split", status.alias("semantic_status"), reason.alias("semantic_status_reason"),
        rules.sit_support(F.col("labels"), covered, intervals.primary_category(F.col("alloc")), list(rule.sit_labels)).alias("sit_supported"),
        intervals.primary_category(F.col("alloc")).alias("primary_category"), intervals.dominance(F.col("alloc"), F.col("duration")).alias("dominance"),
    )
    return run.stage("semantic", out, _counted("semantic_status", "reject_semantic_hard", "reject_semantic_coverage", "semantic_passed", "babel_unmatched", "babel_ambiguous"))


def checked(run: Run, given: Inputs, rule: Rules) -> DataFrame:
    """``motion_id, basic_status, basic_status_reason`` of the headers."""
    m = given.motions
    m = m.withColumn("basic_status", rules.first_of(rules.basic_rules(F.col("duration"), F.col("fps"), F.col("corrupt"), F.col("missing"), F.col("invalid"), rule.basic), "basic_passed"))
    reason = rules.basic_reason(F.col("basic_status"), F.col("duration"), F.col("fps"), F.lit("unreadable"), {"pose": F.col("missing")}, {"fps and arrays must be finite": F.col("invalid")}, rule.basic)
    return run.stage("basic", m.select("motion_id", "basic_status", reason.alias("basic_status_reason")), _counted("basic_status", "basic_passed"))


def measured(run: Run, given: Inputs, rule: Rules, pool: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Frames at the target's rate, and ``motion_id`` with the metrics, of the motions in ``pool``."""
    rate = rule.basic.target_fps
    rows = given.joints.join(pool.select("motion_id", "fps"), "motion_id")
    heads = rows.where(F.col("joint") == joints.PELVIS).select("motion_id", "frame", "fps")
    counts = heads.groupBy("motion_id").agg(F.count("*").alias("__n"))
    taken = run.stage("sampled", metrics.sampled(heads, "motion_id", "frame", F.col("fps"), rate).select("motion_id", "frame", F.col("sample_id").cast("bigint").alias("sample")))
    held = taken.groupBy("motion_id").agg(F.count("*").alias("__k")).join(counts, "motion_id").join(pool.select("motion_id", "fps"), "motion_id")
    effective = held.select("motion_id", F.when(F.col("fps") > rate, F.col("__k") / F.col("__n") * F.col("fps")).otherwise(F.col("fps")).alias("effective_fps"))
    wanted = rows.join(taken, ["motion_id", "frame"]).drop("frame", "fps").withColumnRenamed("sample", "frame")
    frames = joints.joint_frames(wanted, wanted.where(F.col("joint") != joints.PELVIS), "motion_id", "frame", "joint", ("x", "y", "z"), ("rx", "ry", "rz"), run.scratch)
    frames = frames.join(effective, "motion_id")
    return frames, run.stage("metrics", metrics.motion_metrics(frames, "motion_id", "frame", F.col("effective_fps"), run.scratch))


def magnitudes(run: Run, given: Inputs, rule: Rules) -> DataFrame:
    """``motion_id, heuristic_status, heuristic_status_reason`` of the first selection, from the largest numbers of a motion."""
    largest = lambda *cs: F.max(F.greatest(*(F.abs(F.coalesce(F.col(c), F.lit(0.0))) for c in cs)))
    m = given.joints.groupBy("motion_id").agg(largest("rx", "ry", "rz").alias("pose"), F.max(F.when(F.col("joint") == joints.PELVIS, F.greatest(F.abs("x"), F.abs("y"), F.abs("z")))).alias("trans"))
    codes = rules.all_of(rules.magnitude_rules(F.col("pose"), F.col("trans"), F.lit(1.0), rule.pose_limit, rule.trans_limit))
    m = m.withColumn("codes", codes)
    return run.stage("magnitudes", m.select("motion_id", rules.magnitude_status(F.col("codes")).alias("heuristic_status_first"), F.array_join("codes", "; ").alias("heuristic_reason_first")), _counted("heuristic_status_first", "heuristic_passed"))


def unrepeated(run: Run, rule: Rules, passed: DataFrame, frames: DataFrame) -> DataFrame:
    """``passed`` with the columns of ``resolve_duplicates``, from poses and root paths at even places."""
    d = joints.descriptors(frames.join(passed.select("motion_id"), "motion_id", "left_semi"), "motion_id", "frame", rule.points)
    width = 3 * (joints.BODY - 1)
    d = run.stage("descriptors", passed.join(d.select("motion_id", dedup.center_and_normalise(F.col("pose"), width).alias("vector"), "root", dedup.near_hash(F.col("pose"), 1e-9).alias("hash")), "motion_id").withColumn("subject_key", F.concat_ws("/", "source", "subject")))
    pairs = dedup.knn_candidates(d, "motion_id", "vector", k=rule.neighbours, width=None).union(dedup.hash_star(d, "motion_id", "hash")).distinct()
    both = dedup.pair_metrics(pairs, d.withColumn("subject", F.col("subject_key")), "motion_id", "vector", "root", "duration", ("subject", "hash"))
    both = run.stage("pairs", both)
    out = dedup.resolve_duplicates(d, dedup.exact_edges(both, **rule.exact), dedup.near_edges(both, **rule.near), "motion_id", "quality", "subject_key", "vector", rule.keep)
    return run.stage("dedup", out.drop("vector", "root", "hash"), _counted("dedup_status", "unique", "unique_cluster_representative", "defer_exact_duplicate", "defer_redundant_take"))


def budgeted(run: Run, rule: Rules, pool: DataFrame, name: str) -> DataFrame:
    """``motion_id, quota_status, quota_status_reason`` of the candidates in ``pool``."""
    scored = quota.selection_scores(pool, "motion_id", "quality", "alloc", source="source")
    chosen = quota.apply_quota(scored, rule.budget, "category_first", key="motion_id")
    status = quota.quota_status(F.col("quota_selected"), F.col("quota_reason"), "category_first")
    return run.stage(name, chosen.select("motion_id", status.alias("quota_status"), F.coalesce("quota_reason", "quota_pass").alias("quota_status_reason")), _counted("quota_status", "selected_candidate"))


def select(run: Run, given: Inputs, rule: Rules) -> DataFrame:
    """A row for each motion with the status of every stage, ``final_status`` and, under the policy, ``policy_status``, both with reasons.

    A null or repeated ``motion_id`` fails the run.  A motion without joints has no metrics, so that no metric's condition holds.
    All tables here grow with the input, so that joins shuffle them.
    """
    with shuffled_joins(run.spark):
        return _select(run, given, rule)


def _select(run: Run, given: Inputs, rule: Rules) -> DataFrame:
    motions = run.stage("motions", rules.assert_unique(given.motions, "motion_id"))
    given = Inputs(motions, given.annotations, given.actions, given.joints)
    match = matched(run, given)
    first = match.select("motion_id", "match_status").join(annotated(run, given, rule, match), "motion_id").join(checked(run, given, rule), "motion_id").join(magnitudes(run, given, rule), "motion_id", "left")
    base = run.stage("records", motions.drop("k0", "k1", "k2", "k3").join(first, "motion_id").withColumn("heuristic_status_first", F.coalesce("heuristic_status_first", F.lit("heuristic_passed"))))

    pool = base.where(rules.eligible(F.col("heuristic_status_first"), F.col("semantic_status"), F.col("basic_status")))
    frames, measures = measured(run, given, rule, pool)
    seen = pool.select("motion_id", "sit_supported").join(measures, "motion_id", "left")
    threshold = rules.joint_threshold(seen, "joint_integral", rule.joint_threshold)
    if isinstance(threshold, DataFrame):
        seen = seen.crossJoin(F.broadcast(threshold))  # one row
        threshold = F.col("joint_threshold")
    tiers = rules.three_tier(F.col, threshold, rule.tiers)
    decided = seen.select("motion_id", tiers["heuristic_status"].alias("heuristic_status"), tiers["primary_reason"].alias("heuristic_primary_reason"), F.concat(tiers["reject_reasons"], tiers["review_reasons"]).alias("heuristic_all_reasons"))
    decided = run.stage("decisions", decided, _counted("heuristic_status", "heuristic_passed", "review_heuristic", "reject_heuristic_high_confidence"))

    passed = pool.join(decided.where("heuristic_status = 'heuristic_passed'").select("motion_id"), "motion_id", "left_semi")
    repeats = unrepeated(run, rule, passed, frames)
    alone = repeats.where("dedup_status in ('unique', 'unique_cluster_representative')")
    taken = budgeted(run, rule, alone, "quota")

    records = base.join(decided, "motion_id", "left").join(repeats.select("motion_id", "dedup_status", "duplicate_of", "cluster_id"), "motion_id", "left").join(taken, "motion_id", "left")
    # a first heuristic's reject ends a record before the second one is asked
    early = F.col("heuristic_status").isNull() & (F.col("heuristic_status_first") != "heuristic_passed")
    records = records.withColumns({"heuristic_status": F.when(early, "reject_heuristic_high_confidence").otherwise(F.col("heuristic_status")), "heuristic_primary_reason": F.when(early, F.col("heuristic_status_first")).otherwise(F.col("heuristic_primary_reason")), "heuristic_all_reasons": F.when(early, F.array("heuristic_reason_first")).otherwise(F.col("heuristic_all_reasons"))})
    status, reason = rules.final_status_refined(F.col)
    final = run.stage("final", records.withColumns({"final_status": status, "final_status_reason": reason}), _counted("final_status", "selected_candidate"))
    return _under_policy(run, rule, final)


def _under_policy(run: Run, rule: Rules, final: DataFrame) -> DataFrame:
    """``final`` with ``policy_status`` and its reason: only candidates of the first selection go on, and none comes back."""
    own = final.withColumn("__hits", rule.policy.hits(F.col("labels")))
    own = own.withColumns({"in_candidate": F.col("final_status") == "selected_candidate", "core": rule.policy.status(F.col("__hits"), F.col("split"))})
    core = {"eligible": "semantic_core_eligible", "reject": "reject_semantic_any_occurrence"}
    named = F.coalesce(F.create_map(*(F.lit(x) for pair in core.items() for x in pair))[F.col("core")], F.lit("semantic_unverified"))
    own = own.withColumn("core_status", named).drop("__hits", "core")
    pool = own.where("in_candidate and core_status = 'semantic_core_eligible'")
    taken = budgeted(run, rule, pool.drop("quota_status", "quota_status_reason"), "policy_quota").select("motion_id", F.col("quota_status").alias("__q"), F.col("quota_status_reason").alias("__r"))
    both = own.join(taken, "motion_id", "left")
    of: dict[str, Column] = {"semantic_status": F.col("core_status"), "semantic_status_reason": F.concat(F.lit("policy: "), F.col("core_status")), "dedup_status": F.lit("inherited"), "quota_status": F.col("__q"), "quota_status_reason": F.col("__r")}
    column: Callable[[str], Column] = lambda n: of.get(n, F.col(n))
    status, reason = rules.final_status_policy(column)
    return run.stage("policy", both.withColumns({"policy_status": status, "policy_status_reason": reason}).drop("__q", "__r"), _counted("policy_status", "selected_candidate", "defer_not_in_v3_candidate"))
