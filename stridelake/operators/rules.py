"""Ordered rules as data: each rule is a code and a condition; the first that holds names the status."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from stridelake.functions import intervals
from stridelake.operators.metrics import quantile_table


def first_of(rules: list[tuple[str, Column]], otherwise: str | Column) -> Column:
    """The code of the first rule that holds; a null condition doesn't."""
    out = None
    for code, condition in rules:
        out = F.when(condition, code) if out is None else out.when(condition, code)
    last = otherwise if isinstance(otherwise, Column) else F.lit(otherwise)
    return out.otherwise(last) if out is not None else last


def all_of(rules: list[tuple[str, Column]]) -> Column:
    """Codes of all rules that hold, in order."""
    return F.array_compact(F.array(*(F.when(condition, F.lit(code)) for code, condition in rules))) if rules else F.array().cast("array<string>")


@dataclass
class BasicLimits:
    """Thresholds of the basic check; seconds and frames a second."""

    target_fps: float = 30.0
    min_sec: float = 2.0
    max_sec: float = 15.0
    defer_max_sec: float = 30.0
    fps_tolerance: float = 1e-4


def fps_is_multiple(fps: Column, limits: BasicLimits) -> Column:
    """Whether the rate is a whole multiple, at least once, of the target's."""
    r = fps / limits.target_fps
    return (F.abs(r - F.rint(r)) <= limits.fps_tolerance) & (F.rint(r) >= 1)


def basic_rules(duration: Column, fps: Column, corrupt: Column, missing: Column, invalid: Column, limits: BasicLimits = BasicLimits()) -> list[tuple[str, Column]]:
    return [
        ("reject_corrupt", corrupt),
        ("reject_missing_field", missing),
        ("reject_invalid_value", invalid | F.isnan(duration) | F.isnan(fps)),
        ("review_short", duration < limits.min_sec),
        ("defer_very_long", duration > limits.defer_max_sec),
        ("defer_long", duration > limits.max_sec),
        ("defer_low_fps", fps < limits.target_fps),
        ("defer_fps", ~fps_is_multiple(fps, limits)),
    ]


def _plain(value: Column, digits: int = 6) -> Column:
    """A number to so many significant digits, without zeros at the end; for magnitudes between 1e-4 and 10**digits."""
    return F.regexp_replace(F.format_string(f"%.{digits}g", value), r"(\.[0-9]*?)0+$", "$1").substr(F.lit(1), F.lit(40))


def basic_reason(status: Column, duration: Column, fps: Column, corrupt: Column, missing: dict[str, Column], invalid: dict[str, Column], limits: BasicLimits = BasicLimits()) -> Column:
    """The text that goes with a basic status; ``missing`` and ``invalid`` name what is wrong."""
    names = F.concat_ws(", ", *(F.when(c, F.lit(n)) for n, c in missing.items())) if missing else F.lit("")
    wrong = F.concat_ws("; ", *(F.when(c, F.lit(n)) for n, c in invalid.items())) if invalid else F.lit("")
    sec, rate = (lambda v: F.format_string("%.4f", v)), (lambda v: F.regexp_replace(_plain(v), r"\.$", ""))
    lit = lambda v: F.lit(float(v))
    says = {
        "reject_corrupt": corrupt,
        "reject_missing_field": F.concat(F.lit("missing required field(s): "), names),
        "reject_invalid_value": wrong,
        "review_short": F.concat(F.lit("duration="), sec(duration), F.lit("s, below minimum "), sec(lit(limits.min_sec)), F.lit("s")),
        "defer_very_long": F.concat(F.lit("duration="), sec(duration), F.lit("s, above defer limit "), sec(lit(limits.defer_max_sec)), F.lit("s")),
        "defer_long": F.concat(F.lit("duration="), sec(duration), F.lit("s, above v1 maximum "), sec(lit(limits.max_sec)), F.lit("s")),
        "defer_low_fps": F.concat(F.lit("source_fps="), rate(fps), F.lit(", below target_fps="), rate(lit(limits.target_fps))),
        "defer_fps": F.concat(F.lit("source_fps="), rate(fps), F.lit(", not an integer multiple of "), rate(lit(limits.target_fps))),
    }
    out = None
    for code, text in says.items():
        out = F.when(status == code, text) if out is None else out.when(status == code, text)
    return out.otherwise(F.lit("passed_v1_basic_filter"))


def magnitude_status(reasons: Column) -> Column:
    return F.when(F.size(reasons) > 0, "reject_heuristic").otherwise("heuristic_passed")


def heuristic_quality(motion_mean: Column, scale: float = 0.02) -> Column:
    return F.round(F.least(F.lit(1.0), motion_mean / scale), 8)


def magnitude_rules(pose_max: Column, trans_max: Column, motion_mean: Column, pose_limit: float = 100.0, trans_limit: float = 1000.0, min_motion: float = 0.0) -> list[tuple[str, Column]]:
    return [("pose_abs_max", pose_max > pose_limit), ("trans_abs_max", trans_max > trans_limit), ("low_motion", motion_mean < min_motion)]


@dataclass
class TierLimits:
    """Thresholds of the three-tier decision."""

    static_reject: float = 0.95
    static_path: float = 0.20
    static_review: float = 0.80
    lying_reject: float = 0.60
    floor_reject: float = 0.80
    lying_review: float = 0.20
    floor_review: float = 0.35
    crawl_reject: float = 0.75
    crawl_floor: float = 0.60
    crawl_review: float = 0.25
    sit_reject: float = 0.70
    sit_support: float = 0.30
    sit_review: float = 0.35
    body_p99_reject: float = 40.0
    jump: float = 0.05
    extreme: float = 0.05
    run: float = 2.0
    body_p99_review: float = 25.0
    root_reject: float = 6.0
    root_review: float = 4.5
    calibration_reject: float = 0.15
    calibration_static: float = 0.80
    calibration_run: float = 1.0
    calibration_review: float = 0.10


# fixed values: the codes in the order in which a decision lists them and picks its first
REJECTS = ["reject_floor_high_confidence", "reject_crawl_high_confidence", "reject_static_high_confidence", "reject_sitting_high_confidence", "reject_abnormal_high_confidence"]
REVIEWS = ["review_floor_or_crouch", "review_sitting_or_squat", "review_crawling", "review_static", "review_body_speed", "review_calibration"]


def three_tier(c, joint_threshold: Column, t: TierLimits = TierLimits()) -> dict[str, Column]:
    """Reject and review reasons, status and primary reason; ``c(name)`` gives a metric column.

    In each group a reject keeps the review from being tried.  Reasons stand in a fixed
    order, each once; more than one review without a reject is ``review_multiple_heuristics``.
    Only the root speed is compared strictly.  ``sit_supported`` says whether labels support
    sitting.  A null metric meets no condition.
    """
    floor, crawl, static, sit, abnormal = REJECTS
    groups = [
        (floor, (c("lying_fraction") >= t.lying_reject) | (c("floor_fraction") >= t.floor_reject), "review_floor_or_crouch", (c("lying_fraction") >= t.lying_review) | (c("floor_fraction") >= t.floor_review)),
        (crawl, (c("crawl_fraction") >= t.crawl_reject) & (c("floor_fraction") >= t.crawl_floor), "review_crawling", c("crawl_fraction") >= t.crawl_review),
        (static, (c("static_fraction") >= t.static_reject) & (c("path_length") <= t.static_path) & (c("joint_integral") <= joint_threshold), "review_static", c("static_fraction") >= t.static_review),
        (sit, (c("sitting_fraction") >= t.sit_reject) & c("sit_supported"), "review_sitting_or_squat", c("sitting_fraction") >= t.sit_review),
        (abnormal, (c("body_speed_p99") >= t.body_p99_reject) & ((c("jump_fraction") >= t.jump) | (c("extreme_fraction") >= t.extreme) | (c("extreme_run") >= t.run)), "review_body_speed", c("body_speed_p99") >= t.body_p99_review),
        (abnormal, c("root_speed_p99") > t.root_reject, "review_body_speed", c("root_speed_p99") > t.root_review),
        (static, (c("calibration_fraction") >= t.calibration_reject) & (c("static_fraction") >= t.calibration_static) & (c("calibration_run") >= t.calibration_run), "review_calibration", c("calibration_fraction") >= t.calibration_review),
    ]
    held = lambda x: F.coalesce(x, F.lit(False))
    any_of = lambda conditions: reduce(Column.__or__, conditions)
    rejects = all_of([(code, any_of([held(hard) for r, hard, _, _ in groups if r == code])) for code in REJECTS])
    reviews = all_of([(code, any_of([~held(hard) & held(soft) for _, hard, v, soft in groups if v == code])) for code in REVIEWS])
    n, m = F.size(rejects), F.size(reviews)
    status = F.when(n > 0, "reject_heuristic_high_confidence").when(m > 0, "review_heuristic").otherwise("heuristic_passed")
    primary = F.when(n > 0, F.get(rejects, F.lit(0))).when(m > 1, "review_multiple_heuristics").when(m > 0, F.get(reviews, F.lit(0))).otherwise("heuristic_passed")
    return {"reject_reasons": rejects, "review_reasons": reviews, "heuristic_status": status, "primary_reason": primary}


def sit_support(matches: Column, coverage: Column, primary: Column, sit_labels: list[str], primary_categories: tuple[str, ...] = ("sitting",), minimum: float = TierLimits.sit_support) -> Column:
    """Whether labels support sitting: enough coverage where a label for sitting matched, or the primary category."""
    own = F.arrays_overlap(F.coalesce(matches, F.array().cast("array<string>")), F.array(*map(F.lit, sit_labels)).cast("array<string>"))
    covered = F.when(own, F.coalesce(coverage, F.lit(0.0))).otherwise(F.lit(0.0))
    return (covered >= minimum) | F.coalesce(primary.isin(*primary_categories), F.lit(False))


def joint_threshold(df: DataFrame, metric: str, explicit: float | None = None, share: float = 0.05) -> Column | DataFrame:
    """The configured threshold, or the population's percentile as a one-row table to broadcast."""
    return F.lit(explicit) if explicit is not None else quantile_table(df, [metric], {"joint_threshold": share}).select("joint_threshold")


def semantic_rules(labels: Column, soft_intervals: Column, duration: Column, hard: list[str], minimum: float = 0.35) -> list[tuple[str, Column]]:
    """Hard labels reject; so do soft labels that cover enough of the duration (unrounded)."""
    return semantic_rules_of(labels, intervals.coverage(soft_intervals, duration), hard, minimum)


def semantic_rules_of(labels: Column, coverage: Column, hard: list[str], minimum: float = 0.35) -> list[tuple[str, Column]]:
    """The same for a coverage that is known."""
    return [("reject_semantic_hard", F.arrays_overlap(labels, F.array(*map(F.lit, hard)))), ("reject_semantic_coverage", coverage >= minimum)]


@dataclass
class Policy:
    """Label tiers: R rejects; A or C makes eligible; anything else is unverified."""

    tiers: dict[str, list[str]] = field(default_factory=dict)
    splits: tuple[str, ...] = ("train", "val")

    def hits(self, labels: Column) -> Column:
        return F.create_map(*(x for t in "RCAM" for x in (F.lit(t), F.array_sort(F.array_intersect(labels, F.array(*map(F.lit, self.tiers.get(t, []))).cast("array<string>"))))))

    def usable(self, split: Column) -> Column:
        """Whether annotations of the split count; others are as good as none."""
        return F.coalesce(split.isin(*self.splits), F.lit(False))

    def status(self, hits: Column, split: Column, evidence: Column | None = None) -> Column:
        """``evidence`` holds earlier hard matches that reject as a label of tier R does."""
        some = lambda t: F.size(hits[t]) > 0
        bad = some("R") if evidence is None else some("R") | (F.size(F.coalesce(evidence, F.array().cast("array<string>"))) > 0)
        return F.when(~self.usable(split), "unverified").when(bad, "reject").when(some("A") | some("C"), "eligible").otherwise("unverified")

    def reject_seconds(self, hits: Column, seconds: Column) -> Column:
        """Seconds of the labels of tier R that have frame events, rounded; ``seconds`` is what ``event_seconds`` gives."""
        return F.transform_values(F.map_filter(seconds, lambda k, v: F.array_contains(hits["R"], k)), lambda k, v: F.round(v, 6))


def policy_gaps(observed: DataFrame, policy: Policy, split: str | None = None) -> DataFrame:
    """``label, n_tiers, observed`` of labels that aren't in exactly one tier or were never observed; only usable splits count."""
    spark = observed.sparkSession
    rows = [(label, tier) for tier, labels in policy.tiers.items() for label in labels]
    tiers = spark.createDataFrame(rows, "label string, tier string").groupBy("label").agg(F.count("*").alias("n_tiers"))
    usable = observed if split is None else observed.where(policy.usable(F.col(split)))
    seen = usable.select("label").where("label is not null").distinct().withColumn("observed", F.lit(True))
    both = tiers.join(seen, "label", "full_outer").select("label", F.coalesce("n_tiers", F.lit(0)).cast("bigint").alias("n_tiers"), F.coalesce("observed", F.lit(False)).alias("observed"))
    return both.where("n_tiers <> 1 or not observed")


def validate_policy(observed: DataFrame, policy: Policy, split: str | None = None) -> DataFrame:
    """``tier, labels`` counts of a policy that covers what was observed exactly; the query fails on any gap or overlap."""
    spark = observed.sparkSession
    counts = spark.createDataFrame([(t, len(set(l))) for t, l in policy.tiers.items()], "tier string, labels int")
    bad = policy_gaps(observed, policy, split).agg(F.array_sort(F.collect_list("label")).alias("bad"))  # labels of a policy are few
    wrong = F.raise_error(F.concat(F.lit("the tiers don't cover the observed labels exactly: "), F.array_join("bad", ", "))).cast("boolean")
    return counts.crossJoin(F.broadcast(bad)).where(F.when(F.size("bad") > 0, wrong).otherwise(True)).drop("bad")


def split_events(events: Column, minimum: float = 0.10) -> tuple[Column, Column]:
    """Categories of events that last at least ``minimum`` seconds, and those only of shorter ones."""
    cats = lambda keep: F.array_sort(F.array_distinct(F.transform(F.filter(events, keep), lambda e: e["category"])))
    long = cats(lambda e: e["end"] - e["start"] >= minimum)
    return long, F.array_except(cats(lambda e: e["end"] - e["start"] < minimum), long)


def event_seconds(events: Column, minimum: float = 0.10) -> Column:
    """``map<category, seconds>`` over the events that last at least ``minimum`` seconds, in the order of the events."""
    long = F.filter(events, lambda e: e["end"] - e["start"] >= minimum)
    names = F.array_sort(F.array_distinct(F.transform(long, lambda e: e["category"])))
    total = lambda c: F.aggregate(F.filter(long, lambda e: e["category"] == c), F.lit(0.0), lambda s, e: s + (e["end"] - e["start"]))
    return F.map_from_entries(F.transform(names, lambda c: F.struct(c, total(c))))


def event_evidence(events: DataFrame, key: str, category: str, start: str, end: str, minimum: float = 0.10) -> DataFrame:
    """``key, long, short, seconds``: what ``split_events`` and ``event_seconds`` say, from a row for each event.

    Seconds are summed before the shuffle; what is gathered of a key has a place for each category, not each event.
    """
    length = F.col(end) - F.col(start)
    sums = events.groupBy(key, category).agg(F.sum(F.when(length >= minimum, length)).alias("__s"))
    own = F.struct(F.col(category).alias("category"), F.col("__s").alias("seconds"))
    held = sums.groupBy(key).agg(F.array_sort(F.collect_list(own)).alias("__l"))
    of = lambda keep: F.filter("__l", keep)
    names = lambda keep: F.transform(of(keep), lambda x: x["category"])
    return held.select(key, names(lambda x: x["seconds"].isNotNull()).alias("long"), names(lambda x: x["seconds"].isNull()).alias("short"), F.map_from_entries(of(lambda x: x["seconds"].isNotNull())).alias("seconds"))


# ---- final decisions: the first stage that doesn't pass a row names its status

PASSED_SEMANTIC = ("semantic_passed", "babel_unmatched", "babel_ambiguous")  # fixed values


def eligible(heuristic: Column, semantic: Column, basic: Column) -> Column:
    """Whether an earlier selection's row goes into the next one."""
    return F.coalesce((heuristic == "heuristic_passed") & semantic.isin(*PASSED_SEMANTIC) & (basic == "basic_passed"), F.lit(False))


def _final(stages: list[tuple[Column, Column, Column]], otherwise: Column) -> tuple[Column, Column]:
    status = reason = None
    for condition, code, text in stages:
        status = F.when(condition, code) if status is None else status.when(condition, code)
        reason = F.when(condition, text) if reason is None else reason.when(condition, text)
    return status.otherwise(otherwise), reason.otherwise(F.lit(None).cast("string"))


def _of(status: Column, other: Column) -> Column:
    return F.concat(status, F.lit(" of "), F.coalesce(other.cast("string"), F.lit("None")))


def final_status_first(c) -> tuple[Column, Column]:
    """Status and reason of the first selection; ``c(name)`` gives a column."""
    return _final(
        [
            (c("semantic_status").startswith("reject_semantic"), c("semantic_status"), c("semantic_status_reason")),
            (c("basic_status") != "basic_passed", c("basic_status"), c("basic_status_reason")),
            (c("heuristic_status") != "heuristic_passed", c("heuristic_status"), c("heuristic_status_reason")),
            (c("dedup_status") != "unique", F.lit("defer_duplicate"), _of(c("dedup_status"), c("duplicate_of"))),
            (F.lit(True), c("quota_status"), c("quota_status_reason")),
        ],
        c("quota_status"),
    )


def _decided(c) -> list[tuple[Column, Column, Column]]:
    return [(c("heuristic_status").isin("reject_heuristic_high_confidence", "review_heuristic"), c("heuristic_primary_reason"), F.array_join(c("heuristic_all_reasons"), "; "))]


def _unresolved(c) -> Column:
    return F.raise_error(F.concat(F.lit("no stage decides "), c("motion_id").cast("string"))).cast("string")


def final_status_refined(c) -> tuple[Column, Column]:
    """Status and reason of the selection with metric decisions; the query fails on a row that no stage decides."""
    deferred = c("dedup_status").isin("defer_exact_duplicate", "defer_redundant_take")
    stages = [
        (c("semantic_status").startswith("reject_semantic"), c("semantic_status"), c("semantic_status_reason")),
        (c("basic_status") != "basic_passed", c("basic_status"), c("basic_status_reason")),
        *_decided(c),
        (deferred, c("dedup_status"), _of(c("dedup_status"), c("duplicate_of"))),
        (c("heuristic_status") == "heuristic_passed", c("quota_status"), c("quota_status_reason")),
    ]
    return _final(stages, _unresolved(c))


def final_status_policy(c) -> tuple[Column, Column]:
    """Status and reason of the selection under a label policy, a subset of the one before; fails as above."""
    deferred = c("dedup_status").isin("defer_exact_duplicate", "defer_redundant_take")
    passed = c("heuristic_status") == "heuristic_passed"
    stages = [
        (~c("in_candidate"), F.lit("defer_not_in_v3_candidate"), F.lit("not selected by frozen V3 candidate set")),
        (c("semantic_status") != "semantic_core_eligible", c("semantic_status"), c("semantic_status_reason")),
        (c("basic_status") != "basic_passed", c("basic_status"), c("basic_status_reason")),
        *_decided(c),
        (passed & deferred, c("dedup_status"), _of(c("dedup_status"), c("duplicate_of"))),
        (passed, c("quota_status"), c("quota_status_reason")),
    ]
    return _final(stages, _unresolved(c))


def snapshot(df: DataFrame, columns: list[str], suffix: str, fresh: dict[str, Column]) -> DataFrame:
    """``columns`` kept under their names with ``suffix``; then ``fresh`` values, for the next selection to fill."""
    return df.withColumns({f"{c}{suffix}": F.col(c) for c in columns}).withColumns(fresh)


def hands_status(labels: Column, hits: Column, manipulation: list[str], contact: list[str], reject_phrases: list[str], review_phrases: list[str]) -> Column:
    has = lambda values, of: F.arrays_overlap(values, F.array(*map(F.lit, of)).cast("array<string>"))
    return F.when(has(labels, manipulation) | has(hits, reject_phrases), "rejected").when(has(labels, contact) | has(hits, review_phrases), "review").otherwise("core")


#: fixed values: what a row is called under the policy for robots without hands
HANDS = {"rejected": "rejected_manipulation_required", "review": "review_fixed_hand_gesture", "core": "selected_core"}


def hands_reasons(labels: Column, hits: Column, manipulation: list[str], contact: list[str], reject_phrases: list[str], review_phrases: list[str]) -> Column:
    """Why a row isn't core: the sorted labels of the list that decides, then its phrases, each after ``free_text:``; empty for core rows."""
    found = lambda values, of: F.array_sort(F.array_intersect(values, F.array(*map(F.lit, of)).cast("array<string>")))
    told = lambda of, phrases: F.concat(found(labels, of), F.transform(found(hits, phrases), lambda p: F.concat(F.lit("free_text:"), p)))
    status = hands_status(labels, hits, manipulation, contact, reject_phrases, review_phrases)
    return F.when(status == "rejected", told(manipulation, reject_phrases)).when(status == "review", told(contact, review_phrases)).otherwise(F.array().cast("array<string>"))


def decorated(df: DataFrame, policy: str, version: str, status: Column, reasons: Column, source: Column) -> DataFrame:
    """``df`` with what a policy says of a row: ``{policy}_policy_version``, ``{policy}_status``, ``{policy}_reasons`` and the file's whole path."""
    return df.withColumns({f"{policy}_policy_version": F.lit(version), f"{policy}_status": status, f"{policy}_reasons": reasons, "source_npz_absolute": source})


def keep_in_range(df: DataFrame, seconds: str | None = None, frames: str | None = None, min_sec=None, max_sec=None, min_frames=None, max_frames=None) -> DataFrame:
    """Rows within the limits that are given."""
    for column, low, high in ((seconds, min_sec, max_sec), (frames, min_frames, max_frames)):
        if low is not None:
            df = df.where(F.col(column) >= low)
        if high is not None:
            df = df.where(F.col(column) <= high)
    return df


def assert_unique(df: DataFrame, key: str) -> DataFrame:
    """Rows as they are; the query fails on a null or repeated key."""
    n = df.groupBy(key).agg(F.count("*").alias("__n"))
    bad = (F.col("__n") > 1) | F.col(key).isNull()
    return df.join(n.where(~F.when(bad, F.raise_error(F.lit(f"{key} is null or repeated")).cast("boolean")).otherwise(F.lit(False))).drop("__n"), key)


def safe_relative(path: Column) -> Column:
    """Whether a path stays inside its root: relative, and without ``..`` parts."""
    return ~path.startswith("/") & ~F.array_contains(F.split(path, r"[/\\]"), "..")
