"""Time-series metrics over frames: windows partitioned by sequence, ordered by frame."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from stridelake.functions import vectors
from stridelake.operators.scratch import Scratch


def by_frame(seq: str, frame: str):
    return Window.partitionBy(seq).orderBy(frame)


def speed(position: list[str], seq: str, frame: str, rate: Column | float) -> Column:
    """Distance from the frame before times the rate; null on the first frame."""
    w = by_frame(seq, frame)
    steps = [F.col(p) - F.lag(p).over(w) for p in position]
    return F.sqrt(sum((s * s for s in steps[1:]), steps[0] * steps[0])) * rate


def pad_first(value: str, seq: str, frame: str) -> Column:
    """A differenced series with its first frame filled from the second; 0 for a single frame."""
    return F.coalesce(F.col(value), F.lead(value).over(by_frame(seq, frame)), F.lit(0.0))


def fractions(df: DataFrame, seq: str, masks: dict[str, Column]) -> DataFrame:
    """The share of frames on which each mask holds (a null doesn't)."""
    return df.groupBy(seq).agg(*(F.avg(F.coalesce(m, F.lit(False)).cast("int")).alias(n) for n, m in masks.items()))


def longest_run(df: DataFrame, seq: str, frame: str, mask: Column) -> DataFrame:
    """``seq, longest_run``: frames of the longest stretch on which the mask holds, 0 if none."""
    w = by_frame(seq, frame)
    held = F.coalesce(mask, F.lit(False))
    marked = df.select(seq, frame, held.alias("m")).withColumn("i", F.row_number().over(w)).withColumn("g", F.col("i") - F.sum(F.col("m").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = marked.groupBy(seq, "g").agg(F.sum(F.col("m").cast("int")).alias("n"))
    return runs.groupBy(seq).agg(F.max("n").cast("bigint").alias("longest_run"))


def ground_heights(df: DataFrame, seq: str, foot: str, scale: str) -> DataFrame:
    """Add ``height``: the foot above the sequence's first percentile, in body scales."""
    ground = group_quantiles(df, [seq], {"__g": (F.col(foot), 0.01)})
    return joined(df, ground, [seq]).withColumn("height", (F.col(foot) - F.col("__g")) / F.col(scale)).drop("__g")


def body_scale(df: DataFrame, seq: str, lengths: str) -> DataFrame:
    """``seq, scale``: median of the summed bone lengths, at least 1e-6."""
    total = F.aggregate(lengths, F.lit(0.0), lambda s, v: s + v)
    return group_quantiles(df, [seq], {"m": (total, 0.5)}).select(seq, F.greatest("m", F.lit(1e-6)).alias("scale"))


def joint_speed(current: str, previous: Column, rate: float) -> tuple[Column, Column]:
    """Largest and mean angular speed over a frame's joints, given the previous frame's quaternions."""
    each = F.zip_with(F.col(current), previous, lambda a, b: vectors.angular_displacement(a, b) * rate)
    return F.array_max(each), F.aggregate(each, F.lit(0.0), lambda s, v: s + v) / F.size(each)


def static_mask(root_speed: Column, body_speed: Column, root_limit: float = 0.03, body_limit: float = 0.20) -> Column:
    return (root_speed < root_limit) & (body_speed < body_limit)


def calibration_mask(elbow: Column, span: Column, drop: Column, torso: Column) -> Column:
    return (elbow > 160) & (span > 0.65) & drop.between(-0.08, 0.32) & (torso > 0.70)


def sitting_mask(pelvis: Column, knee: Column, torso: Column) -> Column:
    return (pelvis < 0.42) & (knee < 135) & (torso > 0.70)


def lying_mask(span: Column, torso: Column, pelvis: Column, head: Column) -> Column:
    return (span < 0.55) & (torso < 0.55) & (F.least(pelvis, head) < 0.28)


def floor_mask(pelvis: Column, head: Column, limit: float = 0.28) -> Column:
    return F.least(pelvis, head) < limit


def crawl_mask(pelvis: Column, torso: Column, wrist: Column, knee: Column) -> Column:
    return (pelvis < 0.48) & (torso < 0.65) & (wrist < 0.30) & (knee < 0.30)


def jump_mask(lowest_foot: Column, ground: Column, limit: float = 0.08) -> Column:
    """Whether even the lowest foot is off the ground, in metres."""
    return lowest_foot > ground + limit


def extreme_mask(root_speed: Column, body_speed: Column) -> Column:
    return (root_speed > 8) | (body_speed > 20)


def motion_metrics(frames: DataFrame, seq: str, frame: str, fps: Column | float, scratch: Scratch | None = None) -> DataFrame:
    """A row of motion metrics for each sequence, from precomputed columns of its frames.

    Takes ``root_step, turn_sum, turn_mean, turn_max`` (metres and radians from the frame before, null on
    the first), ``pelvis, head, wrist, knee`` (heights over the ground in body scales), ``span,
    torso, knee_angle, elbow, wrist_span, wrist_drop`` (shares and degrees), ``foot, ground`` (metres).
    Speeds of the first frame are those of the second; percentiles are over steps.  ``fps`` is a
    number or a column that is the same on all frames of a sequence.
    """
    fps = fps if isinstance(fps, Column) else F.lit(float(fps))
    w = by_frame(seq, frame)
    held = lambda c: F.coalesce(F.col(c) * fps, F.lead(F.col(c) * fps).over(w), F.lit(0.0))
    f = frames.withColumns({"__root": held("root_step"), "__mean": held("turn_mean"), "__max": held("turn_max")})
    still = static_mask(F.col("__root"), F.col("__mean"))
    masks = {
        "static": still,
        "calibration": calibration_mask(F.col("elbow"), F.col("wrist_span"), F.col("wrist_drop"), F.col("torso")) & still,
        "sitting": sitting_mask(F.col("pelvis"), F.col("knee_angle"), F.col("torso")),
        "lying": lying_mask(F.col("span"), F.col("torso"), F.col("pelvis"), F.col("head")),
        "crawl": crawl_mask(F.col("pelvis"), F.col("torso"), F.col("wrist"), F.col("knee")),
        "floor": floor_mask(F.col("pelvis"), F.col("head")),
        "jump": jump_mask(F.col("foot"), F.col("ground")),
        "extreme": extreme_mask(F.col("__root"), F.col("__max")),
    }
    f = f.withColumns({f"__{n}": F.coalesce(m, F.lit(False)) for n, m in masks.items()})
    whole = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    out = f.groupBy(seq).agg(
        *(F.avg(F.col(f"__{n}").cast("int")).alias(f"{n}_fraction") for n in masks),
        whole("root_step").alias("path_length"),
        whole("turn_sum").alias("joint_integral"),
        F.max(fps).alias("__fps"),
    )
    fast = group_quantiles(frames, [seq], {"root_speed_p99": (F.col("root_step") * fps, 0.99), "body_speed_p99": (F.col("turn_max") * fps, 0.99)}, scratch)
    out = joined(out, fast, [seq]).fillna(0.0, ["root_speed_p99", "body_speed_p99"])
    runs = longest_run(f, seq, frame, F.col("__calibration")).withColumnRenamed("longest_run", "__c")
    runs = runs.join(longest_run(f, seq, frame, F.col("__extreme")).withColumnRenamed("longest_run", "extreme_run"), seq)
    return out.join(runs, seq).withColumn("calibration_run", F.when(F.col("__fps") > 0, F.col("__c") / F.col("__fps")).otherwise(F.lit(0.0))).drop("__c", "__fps")


def sampled(df: DataFrame, seq: str, frame: str, source_fps: float | Column, target_fps: float) -> DataFrame:
    """Frames at evenly spread positions, about the target's rate; frames count from 0.

    A column of rates is the same on all frames of a sequence.
    """
    rate = source_fps if isinstance(source_fps, Column) else F.lit(float(source_fps))
    counts = df.groupBy(seq).agg(F.count("*").alias("__n"), F.max(rate).alias("__rate"))
    skip = F.greatest(F.lit(1), F.floor(F.col("__rate") / F.lit(float(target_fps))))
    wanted = counts.select(seq, F.posexplode(vectors.sample_indices(F.col("__n"), skip)).alias("sample_id", frame))
    return df.join(wanted, [seq, frame])


BINS = 128  # parts of a large group's values, of which only those with wanted ranks are ordered
LARGE = 1_000_000  # values of a group that one task orders


def _at_ranks(values: DataFrame, by: list[str], shares: dict[str, float], inside: list[str], before: Column, whole: Column) -> DataFrame:
    """A row for each ``by`` with each share's percentile, linear between ranks, from values ``v`` that count ``n`` times.

    Values are ordered within ``inside``; ``before`` values come before that part, of ``whole``.
    """
    ordered = values.withColumns({"__all": whole, "__last": before + F.sum("n").over(Window.partitionBy(*inside).orderBy("v").rowsBetween(Window.unboundedPreceding, 0))})

    def part(share: float) -> Column:
        at = (F.col("__all") - 1) * F.lit(float(share))
        holds = lambda rank: (rank >= F.col("__last") - F.col("n")) & (rank < F.col("__last"))
        up = at - F.floor(at)
        return F.sum(F.when(holds(F.floor(at)), F.col("v") * (1 - up)).otherwise(F.lit(0.0)) + F.when(holds(F.ceil(at)) & (up > 0), F.col("v") * up).otherwise(F.lit(0.0)))

    return ordered.groupBy(*by).agg(*(part(s).alias(name) for name, s in shares.items()))


def _quantiles(values: DataFrame, by: list[str], shares: dict[str, float], scratch: Scratch) -> DataFrame:
    """Exact percentiles of ``v``, which counts ``n`` times, by ``by``; no task holds a group and none orders more than ``LARGE`` rows of one.

    Where a group has more, equal values are counted first, before any is written or sent.  Groups of up to
    ``LARGE`` rows are ordered by a window, which spills.  Larger ones are dealt to bins at
    approximate quantiles, the bins' counts tell which of them hold wanted ranks, and only those are ordered.
    """
    if not values.groupBy(*by).agg(F.count("*").alias("__rows")).where(F.col("__rows") > LARGE).isEmpty():
        values = values.groupBy(*by, "v").agg(F.sum("n").alias("n"))
    values = scratch.keep(values, "values")
    sizes = values.groupBy(*by).agg(F.count("*").alias("__rows"))
    large = scratch.keep(sizes.where(F.col("__rows") > LARGE).drop("__rows"), "large")
    if large.isEmpty():
        return _at_ranks(values, by, shares, by, F.lit(0), F.sum("n").over(Window.partitionBy(*by)))
    same = lambda other: reduce(Column.__and__, (values[c].eqNullSafe(other[c]) for c in by))
    small = values.join(large, same(large), "left_anti")
    few = _at_ranks(small, by, shares, by, F.lit(0), F.sum("n").over(Window.partitionBy(*by)))
    most = values.join(large, same(large), "left_semi")
    cuts = scratch.keep(most.groupBy(*by).agg(F.percentile_approx("v", [k / BINS for k in range(1, BINS)], 10 * BINS).alias("__cuts")), "cuts")
    binned = most.join(cuts, reduce(Column.__and__, (most[c].eqNullSafe(cuts[c]) for c in by))).select(*(most[c] for c in by), "v", "n", F.size(F.filter("__cuts", lambda c: c < F.col("v"))).alias("__bin"))
    bins = binned.groupBy(*by, "__bin").agg(F.sum("n").alias("__held"))  # BINS rows a large group
    bins = bins.withColumns({"__upto": F.sum("__held").over(Window.partitionBy(*by).orderBy("__bin")), "__whole": F.sum("__held").over(Window.partitionBy(*by))})
    rank = lambda s, side: side((F.col("__whole") - 1) * F.lit(float(s)))
    wanted = reduce(Column.__or__, ((r >= F.col("__upto") - F.col("__held")) & (r < F.col("__upto")) for s in shares.values() for r in (rank(s, F.floor), rank(s, F.ceil))))
    asked = bins.where(wanted).select(*(F.col(c).alias(f"__k{i}") for i, c in enumerate(by)), F.col("__bin").alias("__b"), (F.col("__upto") - F.col("__held")).alias("__before"), "__whole")
    inside = binned.join(asked, reduce(Column.__and__, [F.col("__bin") == F.col("__b"), *(F.col(c).eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate(by))]))
    return few.unionByName(_at_ranks(inside, by, shares, [*by, "__bin"], F.col("__before"), F.col("__whole")))


def quantile_table(df: DataFrame, metrics: list[str], shares: dict[str, float], scratch: Scratch | None = None) -> DataFrame:
    """``metric`` and a column for each share: exact percentiles, linear between ranks; nulls don't count.

    Equal values are counted before any shuffle.  A metric without values has no row.
    """
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics)))
    values = df.select(each.alias("x")).select("x.*").where("v is not null").groupBy("metric", "v").agg(F.count("*").alias("n"))
    return _quantiles(values, ["metric"], shares, scratch or Scratch(df.sparkSession, "quantiles"))


def group_quantiles(df: DataFrame, keys: list[str], wanted: dict[str, tuple[Column, float]], scratch: Scratch | None = None) -> DataFrame:
    """``keys`` and a column for each name in ``wanted``: the percentile of a value at a share, exact and linear between ranks.

    Nulls and NaNs don't count; null without values, and a group without any value at all has no row.
    """
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("__metric"), v.cast("double").alias("v")) for n, (v, _) in wanted.items())))
    values = df.select(*keys, each.alias("x")).select(*keys, "x.*").where("v is not null and not isnan(v)").withColumn("n", F.lit(1).cast("bigint"))
    by = [*keys, "__metric"]
    names = {s: f"__s{i}" for i, s in enumerate(dict.fromkeys(s for _, s in wanted.values()))}
    found = _quantiles(values, by, {name: s for s, name in names.items()}, scratch or Scratch(df.sparkSession, "quantiles"))
    return found.groupBy(*keys).agg(*(F.max(F.when(F.col("__metric") == n, F.col(names[s]))).alias(n) for n, (_, s) in wanted.items()))


def joined(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """``left`` with the columns of ``right``, which has a row a key at most; null keys are equal."""
    named = right.select(*(F.col(c).alias(f"__r{i}") for i, c in enumerate(keys)), *(c for c in right.columns if c not in keys))
    return left.join(named, reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"__r{i}")) for i, c in enumerate(keys))), "left").drop(*(f"__r{i}" for i in range(len(keys))))
