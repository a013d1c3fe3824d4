"""Boundaries for what needs licensed models or solvers: body model kinematics and inverse kinematics.

The engine runs with precomputed joints.  A plug-in is a plain function over one sequence's
frames in order; it is called in a grouped map, so that its warm start stays within a sequence.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

#: The robots and the body that carries each one's root.
ROBOTS = {
    "unitree_g1": "pelvis",
    "booster_t1": "Waist",
    "stanford_toddy": "waist_link",
    "fourier_n1": "base_link",
    "engineai_pm01": "LINK_BASE",
    "hightorque_hi": "base_link",
}


def robots(spark: SparkSession) -> DataFrame:
    """``robot, base``: the robots as a table to join."""
    return spark.createDataFrame(list(ROBOTS.items()), "robot string, base string")


def robot_schema(joints: DataFrame) -> DataFrame:
    """``robot, nq, nv, dof, dof_names, limits`` from ``robot, joint, kind, qpos_address, qvel_address, limited, low, high``.

    ``kind`` is free, hinge or slide.  The query fails for a robot without exactly one free joint.
    """
    scalar = F.col("kind").isin("hinge", "slide")
    name = F.struct("qpos_address", "joint", F.when(F.col("limited"), F.col("low")).alias("low"), F.when(F.col("limited"), F.col("high")).alias("high"))
    out = joints.groupBy("robot").agg(F.count_if(F.col("kind") == "free").alias("__free"), F.count_if(scalar).alias("dof"), F.array_sort(F.array_agg(F.when(scalar, name))).alias("__j"))  # joints of one robot are few
    one = F.when(F.col("__free") != 1, F.raise_error(F.concat(F.lit("not exactly one free joint: "), "robot")).cast("boolean")).otherwise(True)
    return out.where(one).select("robot", (F.col("dof") + 7).alias("nq"), (F.col("dof") + 6).alias("nv"), "dof", F.transform("__j", lambda j: j["joint"]).alias("dof_names"), F.transform("__j", lambda j: F.struct(j["low"].alias("low"), j["high"].alias("high"))).alias("limits"))


class MissingPlugin(RuntimeError):
    pass


def forward_kinematics(frames: DataFrame, seq: str, frame: str, schema: str, model: Callable[[pd.DataFrame], pd.DataFrame] | None = None) -> DataFrame:
    """Joints of every frame by ``model``, which gets one sequence sorted by frame."""
    if model is None:
        raise MissingPlugin("forward kinematics needs a body model; pass model= or read precomputed joints")
    return frames.groupBy(seq).applyInPandas(lambda pdf: model(pdf.sort_values(frame)), schema)


def retarget(frames: DataFrame, keys: list[str], frame: str, schema: str, solver: Callable[[pd.DataFrame], pd.DataFrame] | None = None) -> DataFrame:
    """Robot states of every frame by ``solver``, which starts each frame from the one before."""
    if solver is None:
        raise MissingPlugin("retargeting needs an inverse-kinematics solver; pass solver=")
    return frames.groupBy(*keys).applyInPandas(lambda pdf: solver(pdf.sort_values(frame)), schema)
