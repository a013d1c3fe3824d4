"""Metrics of a motion from rows of its joints: positions, and rotations about the parent.

A row is one joint of one frame.  One aggregate turns a frame's rows into typed columns, so that
a frame is a row from then on and neighbours are compared once, not joint by joint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stridelake.functions import vectors
from stridelake.operators import metrics
from stridelake.operators.scratch import Scratch

#: fixed values: the numbers of the joints of a body
PELVIS, LEFT_HIP, RIGHT_HIP, SPINE1, LEFT_KNEE, RIGHT_KNEE, SPINE2, LEFT_ANKLE, RIGHT_ANKLE, SPINE3, LEFT_FOOT, RIGHT_FOOT, NECK = range(13)
HEAD, LEFT_SHOULDER, RIGHT_SHOULDER, LEFT_ELBOW, RIGHT_ELBOW, LEFT_WRIST, RIGHT_WRIST = range(15, 22)
BODY = 22
#: fixed values: the bones whose lengths make up the scale of a body, from the pelvis to the left foot and to the head
BONES = [(PELVIS, LEFT_HIP), (LEFT_HIP, LEFT_KNEE), (LEFT_KNEE, LEFT_ANKLE), (LEFT_ANKLE, LEFT_FOOT), (PELVIS, SPINE1), (SPINE1, SPINE2), (SPINE2, SPINE3), (SPINE3, NECK), (NECK, HEAD)]
_USED = [*range(13), *range(15, BODY)]


def frame_poses(joints: DataFrame, seq: str, frame: str, joint: str, axes: tuple[str, str, str]) -> DataFrame:
    """``seq, frame, p0 ... p21, top, bottom``: positions as arrays of three doubles, and the highest and lowest joint.

    ``axes`` name the columns of the coordinates, the last one up.  A joint without a row is null; of repeated rows the largest numbers count.
    """
    x, y, z = axes
    own = [F.max(F.when(F.col(joint) == k, F.col(a).cast("double"))).alias(f"__{k}{i}") for k in _USED for i, a in enumerate(axes)]
    body = F.when(F.col(joint).between(0, BODY - 1), F.col(z).cast("double"))
    rows = joints.groupBy(seq, frame).agg(*own, F.max(body).alias("top"), F.min(body).alias("bottom"))
    return rows.select(seq, frame, *(F.array(*(F.col(f"__{k}{i}") for i in range(3))).alias(f"p{k}") for k in _USED), "top", "bottom")


def _between(a: int, b: int) -> Column:
    return F.array(*(F.col(f"p{a}")[i] - F.col(f"p{b}")[i] for i in range(3)))


def _length(v: Column) -> Column:
    return F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])


def _bend(a: int, at: int, b: int) -> Column:
    """The angle at a joint between two others, in degrees."""
    return F.degrees(vectors.angle(_between(a, at), _between(b, at)))


def frame_shapes(poses: DataFrame, seq: str, frame: str) -> DataFrame:
    """A row of lengths, heights and angles for each frame of ``frame_poses``, in metres and degrees."""
    up = lambda *ks: sum((F.col(f"p{k}")[2] for k in ks[1:]), F.col(f"p{ks[0]}")[2]) / F.lit(float(len(ks)))
    torso = _between(HEAD, PELVIS)
    return poses.select(
        seq,
        frame,
        F.col(f"p{PELVIS}").alias("root"),
        sum((_length(_between(a, b)) for a, b in BONES[1:]), _length(_between(*BONES[0]))).alias("bones"),
        F.least(up(LEFT_ANKLE), up(RIGHT_ANKLE), up(LEFT_FOOT), up(RIGHT_FOOT)).alias("foot"),
        (F.col("top") - F.col("bottom")).alias("reach"),
        up(PELVIS).alias("pelvis_z"),
        up(HEAD).alias("head_z"),
        up(LEFT_WRIST, RIGHT_WRIST).alias("wrist_z"),
        up(LEFT_KNEE, RIGHT_KNEE).alias("knee_z"),
        up(LEFT_SHOULDER, RIGHT_SHOULDER).alias("shoulder_z"),
        (F.abs(torso[2]) / F.greatest(_length(torso), F.lit(1e-8))).alias("torso"),
        F.least(_bend(LEFT_HIP, LEFT_KNEE, LEFT_ANKLE), _bend(RIGHT_HIP, RIGHT_KNEE, RIGHT_ANKLE)).alias("knee_angle"),
        F.least(_bend(LEFT_SHOULDER, LEFT_ELBOW, LEFT_WRIST), _bend(RIGHT_SHOULDER, RIGHT_ELBOW, RIGHT_WRIST)).alias("elbow"),
        _length(_between(LEFT_WRIST, RIGHT_WRIST)).alias("wrists"),
    )


def frame_turns(rotations: DataFrame, seq: str, frame: str, joint: str, axes: tuple[str, str, str], first: int = 1, last: int = BODY - 1) -> DataFrame:
    """``seq, frame, pose, turn_sum, turn_mean, turn_max``: all rotation vectors in one flat array, and the angles turned since the frame before.

    ``axes`` name the columns of a joint's rotation vector.  The angles are null on the first frame.
    """
    own = [F.max(F.when(F.col(joint) == k, F.col(a).cast("double"))).alias(f"__{k}{i}") for k in range(first, last + 1) for i, a in enumerate(axes)]
    rows = rotations.groupBy(seq, frame).agg(*own)
    turn = lambda k: F.array(*(F.col(f"__{k}{i}") for i in range(3)))
    rows = rows.select(seq, frame, F.flatten(F.array(*map(turn, range(first, last + 1)))).alias("pose"), F.transform(F.array(*map(turn, range(first, last + 1))), vectors.rotvec_to_quaternion).alias("__q"))
    rows = rows.withColumn("__b", F.lag("__q").over(metrics.by_frame(seq, frame)))
    rows = rows.withColumn("__d", F.zip_with("__b", "__q", vectors.angular_displacement))
    total = F.aggregate("__d", F.lit(0.0), lambda s, v: s + v)
    return rows.select(seq, frame, "pose", total.alias("turn_sum"), (total / F.size("__d")).alias("turn_mean"), F.array_max("__d").alias("turn_max"))


def joint_frames(joints: DataFrame, rotations: DataFrame, seq: str, frame: str, joint: str, axes: tuple[str, str, str], turns: tuple[str, str, str], scratch: Scratch) -> DataFrame:
    """A row for each frame with all that ``motion_metrics`` takes, besides ``root`` and ``pose``; written once.

    Heights are over the sequence's ground, its feet's first percentile, in body scales, the median
    sum of its bones.
    """
    shapes = scratch.keep(frame_shapes(frame_poses(joints, seq, frame, joint, axes), seq, frame), "shapes")
    body = metrics.group_quantiles(shapes, [seq], {"__m": (F.col("bones"), 0.5), "ground": (F.col("foot"), 0.01)}, scratch)
    body = body.select(seq, F.greatest("__m", F.lit(1e-6)).alias("scale"), "ground")
    f = metrics.joined(shapes, body, [seq])
    before = F.lag("root").over(metrics.by_frame(seq, frame))
    step = _length(F.array(*(F.col("root")[i] - before[i] for i in range(3))))
    over = lambda c: (F.col(c) - F.col("ground")) / F.col("scale")
    share = lambda c: F.col(c) / F.col("scale")
    named = {"pelvis": over("pelvis_z"), "head": over("head_z"), "wrist": over("wrist_z"), "knee": over("knee_z"), "span": share("reach"), "wrist_span": share("wrists"), "wrist_drop": (F.col("shoulder_z") - F.col("wrist_z")) / F.col("scale")}
    f = f.withColumn("root_step", step).withColumns(named).drop("pelvis_z", "head_z", "wrist_z", "knee_z", "shoulder_z", "reach", "wrists", "bones")
    return scratch.keep(f.join(frame_turns(rotations, seq, frame, joint, turns), [seq, frame]), "frames")


def descriptors(frames: DataFrame, seq: str, frame: str, points: int = 32) -> DataFrame:
    """``seq, pose, root``: poses at ``points`` frames spread evenly, flat, and the root's places there less the first.

    Only the wanted frames are gathered, ``points`` of a sequence at most.
    """
    n = frames.groupBy(seq).agg(F.count("*").alias("__n"))
    wanted = n.select(F.col(seq).alias("__s"), F.posexplode(vectors.spread_indices(F.col("__n"), points)).alias("__i", "__f"))
    got = frames.join(wanted, (F.col(seq) == F.col("__s")) & (F.col(frame) == F.col("__f")))
    one = got.groupBy(seq).agg(F.array_sort(F.collect_list(F.struct("__i", "pose", "root"))).alias("l"))
    first = F.get("l", F.lit(0))["root"]
    return one.select(seq, F.flatten(F.transform("l", lambda x: x["pose"])).alias("pose"), F.flatten(F.transform("l", lambda x: F.zip_with(x["root"], first, lambda a, b: a - b))).alias("root"))
