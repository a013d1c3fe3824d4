"""Trajectories: velocities, continuity, limits, flags, frame maps and quality reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from stridelake.functions import intervals, vectors
from stridelake.operators.metrics import by_frame, group_quantiles, joined

FLAGS = ["nonfinite", "quaternion", "forward", "ik_position", "ik_rotation", "joint_limit", "root_speed", "dof_speed"]
STRUCTURAL = 0b111


def _neighbours(time: str, seq: str, frame: str):
    """Values of a column at a frame's neighbours, itself at the ends, and the time between them.

    The query fails where that time isn't positive; it is null for a single frame.
    """
    w = by_frame(seq, frame)
    ahead = lambda c: F.coalesce(F.lead(c).over(w), F.col(c))
    behind = lambda c: F.coalesce(F.lag(c).over(w), F.col(c))
    alone = F.lead(time).over(w).isNull() & F.lag(time).over(w).isNull()
    dt = ahead(time) - behind(time)
    late = F.raise_error(F.concat(F.lit("timestamps must be strictly increasing: "), F.col(seq).cast("string"))).cast("double")
    return ahead, behind, F.when(~alone, F.when(dt > 0, dt).otherwise(late))


def central_difference(value: str, time: str, seq: str, frame: str) -> Column:
    """Velocity from both neighbours, one-sided at the ends; 0 for a single frame; fails where time stands still."""
    ahead, behind, dt = _neighbours(time, seq, frame)
    return F.coalesce((ahead(value) - behind(value)) / dt, F.lit(0.0))


def angular_velocity(q: str, time: str, seq: str, frame: str) -> Column:
    """Three components, in the frame of the earlier neighbour's body, of the rotation between the neighbours over their time apart.

    ``q`` is a unit quaternion wxyz.  Zeros for a single frame; fails where time stands still.
    """
    ahead, behind, dt = _neighbours(time, seq, frame)
    turn = vectors.rotation_vector(vectors.relative_rotation(behind(q), ahead(q)))
    return F.transform(turn, lambda v: F.coalesce(v / dt, F.lit(0.0)))


def continuous_quaternions(df: DataFrame, q: str, seq: str, frame: str, out: str = "continuous") -> DataFrame:
    """Flip signs so that neighbours agree: a negative raw dot turns the sign, a zero one resets it."""
    w = by_frame(seq, frame)
    d = df.withColumn("__d", vectors.dot(F.col(q), F.lag(q).over(w)))
    d = d.withColumn("__reset", F.sum(F.when(F.col("__d") == 0, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    turns = F.sum(F.when(F.col("__d") < 0, 1).otherwise(0)).over(Window.partitionBy(seq, "__reset").orderBy(frame).rowsBetween(Window.unboundedPreceding, 0))
    sign = F.when(turns % 2 == 1, F.lit(-1.0)).otherwise(F.lit(1.0))
    return d.withColumn("__s", sign).withColumn(out, F.transform(q, lambda v: v * F.col("__s"))).drop("__d", "__reset", "__s")


def root_offsets(df: DataFrame, x: str, y: str, z: str, seq: str, frame: str, ground: float = 0.0, normalise: bool = True) -> DataFrame:
    """First frame at the origin of the plane if ``normalise``; all frames raised by ``ground``."""
    w = by_frame(seq, frame)
    plane = {c: F.col(c) - F.first(c).over(w) for c in (x, y)} if normalise else {}
    return df.withColumns(plane | {z: F.col(z) + ground})


def joint_margin(value: Column, low: Column, high: Column, limited: Column) -> Column:
    """Distance to the nearer limit, negative beyond it; infinite without limits."""
    return F.when(limited, F.least(value - low, high - value)).otherwise(F.lit(float("inf")))


def violated(margin: Column, tolerance: float = 1e-4) -> Column:
    return margin < -tolerance


def flags(conditions: dict[str, Column]) -> Column:
    """Bit mask of the named conditions; a null condition sets nothing."""
    bits = [F.when(F.coalesce(conditions[n], F.lit(False)), F.lit(1 << k).cast("bigint")).otherwise(F.lit(0).cast("bigint")) for k, n in enumerate(FLAGS) if n in conditions]
    return sum(bits[1:], bits[0])


def frame_valid(mask: Column) -> Column:
    return mask.bitwiseAND(F.lit(STRUCTURAL)) == 0


def even_frames(df: DataFrame, frame: str) -> DataFrame:
    """Every second frame, renumbered in ``visual_frame_id``."""
    return df.where(F.col(frame) % 2 == 0).withColumn("visual_frame_id", (F.col(frame) / 2).cast("bigint"))


def frame_map_problems(frames: DataFrame, seq: str, visual: str, canonical: str, time: str, fps: float = 30.0) -> DataFrame:
    """Sequences whose frame map breaks a rule, with the counts of each."""
    w = by_frame(seq, visual)
    checked = frames.withColumn("__i", F.row_number().over(w) - 1)
    return checked.groupBy(seq).agg(
        F.count("*").alias("frames"),
        F.count_if(F.col(visual) != F.col("__i")).alias("gaps"),
        F.count_if(F.col(canonical) != 2 * F.col("__i")).alias("odd"),
        F.count_if(F.abs(F.col(time) - F.col(canonical) / fps) > 1e-9).alias("late"),
    )


def missing_ids(df: DataFrame, seq: str, ident: str) -> DataFrame:
    """``seq, id`` that 0..n-1 has and the sequence lacks, or the other way round; empty when all agree."""
    wanted = df.groupBy(seq).agg(F.count("*").alias("n")).select(F.col(seq).alias("s"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("i"))
    both = df.select(seq, ident).distinct().join(wanted, (F.col(seq) == F.col("s")) & (F.col(ident) == F.col("i")), "full_outer")
    return both.where(F.col("s").isNull() | F.col(ident).isNull()).select(F.coalesce(seq, "s").alias(seq), F.coalesce(ident, "i").alias("id"))


def resampled(df: DataFrame, q: str, seq: str, frame: str, source_fps: float, target_fps: float) -> DataFrame:
    """Quaternions at the target's rate: floor and ceiling frames joined, then slerp."""
    last = df.groupBy(seq).agg(F.max(frame).alias("__last"))
    at = last.select(seq, F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("__last") * target_fps / source_fps))).alias("target_frame")).withColumn("__x", F.col("target_frame") * source_fps / target_fps)
    lo = df.select(seq, F.col(frame).alias("__lo"), F.col(q).alias("__a"))
    hi = df.select(seq, F.col(frame).alias("__hi"), F.col(q).alias("__b"))
    both = at.withColumns({"__lo": F.floor("__x"), "__hi": F.ceil("__x")}).join(lo, [seq, "__lo"]).join(hi, [seq, "__hi"])
    return both.select(seq, "target_frame", vectors.slerp(F.col("__a"), F.col("__b"), F.col("__x") - F.col("__lo")).alias(q))


def finite(value: str) -> Column:
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), F.col(value).cast("double"))


def finite_stats(value: str, name: str) -> list[Column]:
    """Mean and maximum of finite values; null when there are none."""
    v = finite(value)
    return [F.avg(v).alias(f"{name}_mean"), F.max(v).alias(f"{name}_max")]


def quality_report(df: DataFrame, keys: list[str], valid: Column, converged: Column, position_error: str, rotation_error: str, margin: str, root_speed: str, dof_speed: str, minimum: float = 0.98, root_limit: float = 5.0, dof_limit: float = 20.0) -> DataFrame:
    """Ratios, error statistics, smallest finite margin, reasons and status of each group."""
    report = df.groupBy(*keys).agg(F.count("*").alias("frames"), F.avg(valid.cast("int")).alias("valid_ratio"), F.avg(converged.cast("int")).alias("converged_ratio"), *finite_stats(position_error, "position"), *finite_stats(rotation_error, "rotation"), F.min(finite(margin)).alias("min_margin"), F.max(root_speed).alias("max_root_speed"), F.max(dof_speed).alias("max_dof_speed"))
    report = joined(report, group_quantiles(df, keys, {"position_p95": (finite(position_error), 0.95), "rotation_p95": (finite(rotation_error), 0.95)}), keys)
    reasons = F.array_compact(F.array(F.when(F.col("valid_ratio") < 1, F.lit("invalid_frames")), F.when(F.col("converged_ratio") < minimum, F.lit("ik_not_converged")), F.when(F.col("min_margin") < -1e-4, F.lit("joint_limit")), F.when(F.col("max_root_speed") > root_limit, F.lit("root_speed")), F.when(F.col("max_dof_speed") > dof_limit, F.lit("dof_speed"))))
    return report.withColumn("reasons", reasons).withColumn("status", F.when(F.col("valid_ratio") < 1, "failed").when(F.size("reasons") > 0, "warning").otherwise("passed"))


def reconstructs(qpos: Column, root_pos: Column, root_quat: Column, dof: Column, dof_addresses: list[int], tolerance: float = 1e-6) -> Column:
    """Whether the parts of a state are those of its generalised position."""
    near = lambda a, b: (F.size(a) == F.size(b)) & F.forall(F.zip_with(a, b, lambda x, y: F.abs(x - y) <= tolerance + 1e-5 * F.abs(y)), lambda ok: ok)
    return reduce(Column.__and__, (near(a, b) for a, b in zip(split_state(qpos, dof_addresses), (root_pos, root_quat, dof))))


def validate_output(full: DataFrame, half: DataFrame, seq: str, frame: str, time: str, values: list[str], quaternion: str | None = None) -> DataFrame:
    """``seq, check, bad``: rows that break contiguity, time order, slice equality or unit length."""
    w = by_frame(seq, frame)
    rows = full.withColumns({"__i": F.row_number().over(w) - 1, "__t": F.lag(time).over(w)})
    checks = {"contiguous": F.col(frame) != F.col("__i"), "monotone": F.col(time) <= F.col("__t")}
    if quaternion:
        checks["unit"] = F.abs(vectors.norm(F.col(quaternion)) - 1) > 1e-4
    bad = rows.select(seq, F.explode(F.array(*(F.struct(F.lit(n).alias("check"), F.coalesce(c, F.lit(False)).alias("b")) for n, c in checks.items()))).alias("x")).select(seq, "x.check", "x.b")
    same = half.select(seq, frame, *(F.col(v).alias(f"{v}_h") for v in values)).join(full.select(seq, frame, *values), [seq, frame], "left")
    differs = ~F.array(*(F.col(v).eqNullSafe(F.col(f"{v}_h")) for v in values)).eqNullSafe(F.array(*(F.lit(True) for _ in values)))
    return bad.unionByName(same.select(seq, F.lit("slice").alias("check"), differs.alias("b"))).groupBy(seq, "check").agg(F.count_if("b").alias("bad"))


def task_errors(position: Column, target: Column, rotation: Column, target_rotation: Column) -> tuple[Column, Column]:
    """Distance and angle of a task from its target."""
    d = F.zip_with(position, target, lambda a, b: a - b)
    return vectors.norm(d), vectors.quaternion_angle(rotation, target_rotation)


def largest_errors(errors: Column) -> tuple[Column, Column]:
    """Largest distance and angle over ``array<struct<position, rotation, position_weight, rotation_weight>>``; only weights above 0 count, 0 if there are none."""
    top = lambda v, w: F.coalesce(F.array_max(F.transform(F.filter(errors, lambda e: e[w] > 0), lambda e: e[v])), F.lit(0.0))
    return top("position", "position_weight"), top("rotation", "rotation_weight")


def split_velocity(qvel: Column, dof_addresses: list[int], address: int = 0) -> tuple[Column, Column, Column]:
    """Root linear and angular velocity and joint velocities of a generalised velocity."""
    return F.slice(qvel, address + 1, 3), F.slice(qvel, address + 4, 3), F.transform(F.array(*map(F.lit, dof_addresses)), lambda k: F.get(qvel, k))


def off_grid(frames: DataFrame, seq: str, frame: str, time: str, fps: str, target: float = 30.0) -> DataFrame:
    """``seq, frames, wrong_rate, off_grid``: frames whose rate isn't the target's or whose time isn't frame / target."""
    late = F.abs(F.col(time) - F.col(frame) / F.lit(target)) > 1e-9 + 1e-5 * F.abs(F.col(frame) / F.lit(target))
    rate = F.abs(F.col(fps) - target) > 1e-8 + 1e-5 * target
    return frames.groupBy(seq).agg(F.count("*").alias("frames"), F.count_if(rate).alias("wrong_rate"), F.count_if(late).alias("off_grid"))


def global_rotations(local: Column, parents: list[int]) -> Column:
    """Rotations of a kinematic tree's joints from those relative to their parents, quaternions wxyz; a parent stands before its children.

    Expressions share nothing, so the tree's depth decides the plan's size: meant for trees of a few dozen joints.
    """

    def grown(parent):
        return lambda x: F.concat(x["done"], F.array(vectors.quaternion_multiply(F.get(x["done"], F.lit(parent)), x["own"])))

    out = F.array(F.get(local, F.lit(0)))
    for k, parent in enumerate(parents[1:], 1):
        out = intervals.let(F.struct(out.alias("done"), F.get(local, F.lit(k)).alias("own")), grown(parent))
    return out


def split_state(qpos: Column, dof_addresses: list[int]) -> tuple[Column, Column, Column]:
    """Root position, root quaternion (xyzw) and joint values of a generalised position."""
    return F.slice(qpos, 1, 3), vectors.wxyz_to_xyzw(F.slice(qpos, 4, 4)), F.transform(F.array(*map(F.lit, dof_addresses)), lambda k: F.get(qpos, k))


def human_height(betas: Column) -> Column:
    return F.lit(1.66) + 0.1 * F.get(betas, F.lit(0))


def scaled_joint(position: Column, root: Column, scale: Column, root_scale: Column) -> Column:
    """A joint scaled about the root, which is itself scaled about the origin."""
    return F.zip_with(position, root, lambda p, r: r * root_scale + (p - r) * scale)


def offset_joint(position: Column, rotation: Column, offset: Column, turn: Column) -> tuple[Column, Column]:
    """Position and rotation of a joint after a turn and an offset in the turned joint's own frame."""
    turned = vectors.quaternion_multiply(rotation, turn)
    return F.zip_with(position, vectors.rotate(turned, offset), lambda p, o: p + o), turned


def on_ground(df: DataFrame, seq: str, frame: str, joint: str, z: str, clearance: float = 0.1) -> DataFrame:
    """Every frame raised so that its lowest foot, a joint named so, is ``clearance`` high; frames without feet stay."""
    low = F.min(F.when(F.col(joint).contains("Foot") | F.col(joint).contains("foot"), F.col(z))).over(Window.partitionBy(seq, frame))
    return df.withColumn(z, F.col(z) + F.coalesce(clearance - low, F.lit(0.0)))
