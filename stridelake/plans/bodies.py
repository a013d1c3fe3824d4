"""Bodies in motion from the embeddings: joint rows, the metrics of a motion, and turns of the root.

Eight vectors make a motion of eight frames.  A frame's joints stand at the places of a resting body,
moved by its vector's numbers, in a posture that goes by the motion's number; conditions are
written once, in SQL that both engines read, and only what their dialects spell apart is filled in.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, functions as F

from stridelake.functions import vectors
from stridelake.operators import joints, metrics, trajectory
from stridelake.operators.scratch import Scratch
from stridelake.plans.catalogue import R, _FRAMES, frames, query, table

FRAMES = 8
SEQ, FRAME = f"CAST(floor(vec_id / {FRAMES}) AS BIGINT)", f"vec_id % {FRAMES}"

#: A resting body in metres: forward, left, up, by the numbers of its joints.
REST = [
    (0, 0, 0.95), (0, 0.09, 0.87), (0, -0.09, 0.87), (0, 0, 1.05), (0, 0.1, 0.48), (0, -0.1, 0.48), (0, 0, 1.18), (0, 0.1, 0.08), (0, -0.1, 0.08), (0, 0, 1.24), (0.13, 0.1, 0.02),
    (0.13, -0.1, 0.02), (0, 0, 1.45), (0, 0.07, 1.37), (0, -0.07, 1.37), (0, 0, 1.55), (0, 0.17, 1.4), (0, -0.17, 1.4), (0, 0.42, 1.4), (0, -0.42, 1.4), (0, 0.67, 1.4), (0, -0.67, 1.4),
]


def _at(axis: int) -> str:
    return f"CAST(CASE joint {' '.join(f'WHEN {k} THEN {float(p[axis])}' for k, p in enumerate(REST))} END AS DOUBLE)"


def _moved(axis: int) -> str:
    """A resting place and the frame's own part, ``amp`` of a number of its vector."""
    return f"({_at(axis)} + amp * {{e{axis}}})"


_ARMS = "joint IN (18, 19, 20, 21) AND seq % 8 <> 2"
_LEGS = "joint IN (4, 5, 7, 8, 10, 11)"
AMP = "CAST(CASE seq % 8 WHEN 2 THEN 0.001 WHEN 5 THEN 0.002 WHEN 6 THEN 2.0 ELSE 0.2 END AS DOUBLE)"
TURN = "CAST(CASE seq % 8 WHEN 2 THEN 0.004 WHEN 5 THEN 0.004 WHEN 6 THEN 4.0 ELSE 0.3 END AS DOUBLE)"
#: Postures: lying, low, arms out, sitting, on all fours, still, flailing, standing.
COLUMNS = {
    "x": f"CASE WHEN seq % 8 IN (0, 4) THEN {_moved(2)} WHEN seq % 8 = 3 AND joint IN (4, 5) THEN {_moved(0)} + 0.4D ELSE {_moved(0)} END",
    "y": f"CASE WHEN {_ARMS} THEN CASE WHEN joint % 2 = 0 THEN 0.2D ELSE -0.2D END + amp * {{e1}} ELSE {_moved(1)} END",
    "z": f"CASE WHEN seq % 8 = 0 THEN 0.2D + 0.1D * {_moved(0)} WHEN seq % 8 = 1 THEN 0.45D * {_moved(2)} WHEN seq % 8 = 3 AND joint IN (4, 5) THEN 0.5D + amp * {{e2}} WHEN seq % 8 = 3 AND NOT ({_LEGS}) THEN {_moved(2)} - 0.4D "
    f"WHEN seq % 8 = 4 THEN CASE WHEN {_LEGS} OR joint IN (20, 21) THEN 0.05D ELSE 0.4D END + amp * {{e2}} WHEN {_ARMS} THEN CASE WHEN joint IN (18, 19) THEN 1.12D ELSE 0.87D END + amp * {{e2}} ELSE {_moved(2)} END",
    "rx": "turn * {e3}",
    "ry": "turn * {e4}",
    "rz": "turn * {e5}",
}
_PLACES = ["joint * 3", "joint * 3 + 1", "joint * 3 + 2", "joint * 5 + 7", "joint * 5 + 20", "joint * 5 + 41"]
_SPARK_E = {f"e{i}": f"CAST(embedding[({p}) % 64] AS DOUBLE)" for i, p in enumerate(_PLACES)}
_SQL_E = {f"e{i}": f"embedding[({p}) % 64 + 1]::DOUBLE" for i, p in enumerate(_PLACES)}


def joint_rows(spark, sf_dir) -> DataFrame:
    """``seq, frame, joint, x, y, z, rx, ry, rz``; rotations are about the parent, and the root's joint has none."""
    e = table(spark, sf_dir, "embeddings").select(F.expr(SEQ).alias("seq"), F.expr(FRAME).alias("frame"), "embedding", F.explode(F.sequence(F.lit(0), F.lit(joints.BODY - 1))).alias("joint"))
    e = e.withColumns({"amp": F.expr(AMP), "turn": F.expr(TURN)})
    return e.select("seq", "frame", "joint", *(F.expr(c.format(**_SPARK_E)).alias(n) for n, c in COLUMNS.items()))


def _number(text: str) -> str:
    """Spark's double literals as DuckDB spells them."""
    return re.sub(r"([0-9])D\b", r"\1::DOUBLE", text)


JOINTS_SQL = f"""jr AS MATERIALIZED (SELECT seq, frame, joint, {', '.join(f"{_number(c.format(**_SQL_E))} AS {n}" for n, c in COLUMNS.items())}
  FROM (SELECT *, {AMP} AS amp, {TURN} AS turn FROM (SELECT {SEQ} AS seq, {FRAME} AS frame, embedding, unnest(range({joints.BODY}))::INT AS joint FROM embeddings)))"""


def _p(a: int, b: int | None = None) -> list[str]:
    return [f"({c}{a} - {c}{b})" if b is not None else f"{c}{a}" for c in "xyz"]


def _dot(u: list[str], v: list[str]) -> str:
    return "(" + " + ".join(f"{a} * {b}" for a, b in zip(u, v)) + ")"


def _bend(a: int, at: int, b: int) -> str:
    u, v = _p(a, at), _p(b, at)
    return f"degrees(acos(greatest(-1, least(1, {_dot(u, v)} / greatest(sqrt({_dot(u, u)}) * sqrt({_dot(v, v)}), 1e-8)))))"


def _apart(a: int, b: int) -> str:
    return f"sqrt({_dot(_p(a, b), _p(a, b))})"


#: Frames ``f`` of motions ``jr`` with ``seq, frame`` and all that the metrics take.
FRAMES_SQL = f"""po AS (SELECT seq, frame, {', '.join(f"max({c}) FILTER (joint = {k}) AS {c}{k}" for k in range(joints.BODY) for c in 'xyz')}, max(z) AS top, min(z) AS bottom FROM jr GROUP BY 1, 2),
sh AS (SELECT seq, frame, x0, y0, z0, {' + '.join(_apart(a, b) for a, b in joints.BONES)} AS bones, least(z7, z8, z10, z11) AS foot, top - bottom AS reach, z15, (z20 + z21) / 2 AS wz, (z4 + z5) / 2 AS kz, (z16 + z17) / 2 AS sz,
  abs(z15 - z0) / greatest({_apart(15, 0)}, 1e-8) AS torso, least({_bend(1, 4, 7)}, {_bend(2, 5, 8)}) AS knee_angle, least({_bend(16, 18, 20)}, {_bend(17, 19, 21)}) AS elbow, {_apart(20, 21)} AS wrists FROM po),
bo AS (SELECT seq, greatest(quantile_cont(bones, 0.5), 1e-6) AS scale, quantile_cont(foot, 0.01) AS ground FROM sh GROUP BY 1),
tq AS (SELECT seq, frame, joint, h, cos(h) AS w, k * rx AS a, k * ry AS b, k * rz AS c FROM (SELECT *, CASE WHEN h > 1e-12 THEN sin(h) / (2 * h) ELSE 0.5 END AS k FROM (SELECT *, sqrt(rx * rx + ry * ry + rz * rz) / 2 AS h FROM jr WHERE joint > 0))),
tl AS (SELECT seq, frame, joint, w, a, b, c, lag(w) OVER o AS w0, lag(a) OVER o AS a0, lag(b) OVER o AS b0, lag(c) OVER o AS c0 FROM tq WINDOW o AS (PARTITION BY seq, joint ORDER BY frame)),
td AS (SELECT seq, frame, 4 * asin(least(1, sqrt((w - s * w0) ** 2 + (a - s * a0) ** 2 + (b - s * b0) ** 2 + (c - s * c0) ** 2) / 2)) AS d FROM (SELECT *, CASE WHEN w * w0 + a * a0 + b * b0 + c * c0 < 0 THEN -1 ELSE 1 END AS s FROM tl) WHERE w0 IS NOT NULL),
tu AS (SELECT seq, frame, sum(d) AS turn_sum, avg(d) AS turn_mean, max(d) AS turn_max FROM td GROUP BY 1, 2),
f AS (SELECT sh.seq, sh.frame, sqrt((x0 - lag(x0) OVER o) ** 2 + (y0 - lag(y0) OVER o) ** 2 + (z0 - lag(z0) OVER o) ** 2) AS root_step, turn_sum, turn_mean, turn_max, (z0 - ground) / scale AS pelvis, (z15 - ground) / scale AS head, (wz - ground) / scale AS wrist, (kz - ground) / scale AS knee,
  reach / scale AS span, torso, knee_angle, elbow, wrists / scale AS wrist_span, (sz - wz) / scale AS wrist_drop, foot, ground FROM sh JOIN bo ON bo.seq = sh.seq LEFT JOIN tu ON tu.seq = sh.seq AND tu.frame = sh.frame WINDOW o AS (PARTITION BY sh.seq ORDER BY sh.frame))"""


def _longest(mask: str, name: str) -> str:
    return f"""{name} AS (SELECT seq, max(n) AS n FROM (SELECT seq, g, count(*) AS n FROM (SELECT seq, frame - row_number() OVER (PARTITION BY seq ORDER BY frame) AS g FROM mk WHERE {mask}) GROUP BY 1, 2) GROUP BY 1)"""


#: The fourteen metrics ``mt`` of frames ``f`` at ``fps`` of ``rate``, unrounded.
METRICS_SQL = f"""fr AS (SELECT f.*, rate.fps, coalesce(root_step * fps, lead(root_step * fps) OVER o, 0) AS rs, coalesce(turn_mean * fps, lead(turn_mean * fps) OVER o, 0) AS ms, coalesce(turn_max * fps, lead(turn_max * fps) OVER o, 0) AS xs FROM f JOIN rate ON rate.seq = f.seq WINDOW o AS (PARTITION BY f.seq ORDER BY f.frame)),
ms AS (SELECT *, rs < 0.03 AND ms < 0.2 AS st, rs > 8 OR xs > 20 AS ex FROM fr), mk AS (SELECT *, elbow > 160 AND wrist_span > 0.65 AND wrist_drop BETWEEN -0.08 AND 0.32 AND torso > 0.7 AND st AS ca FROM ms),
{_longest('ex', 'lx')}, {_longest('ca', 'lc')},
mt AS (SELECT mk.seq, avg(st::INT) AS static_fraction, avg(ca::INT) AS calibration_fraction, avg((pelvis < 0.42 AND torso > 0.7 AND knee_angle < 135)::INT) AS sitting_fraction, avg((span < 0.55 AND torso < 0.55 AND least(pelvis, head) < 0.28)::INT) AS lying_fraction,
  avg((pelvis < 0.48 AND torso < 0.65 AND wrist < 0.3 AND knee < 0.3)::INT) AS crawl_fraction, avg((least(pelvis, head) < 0.28)::INT) AS floor_fraction, avg((foot > ground + 0.08)::INT) AS jump_fraction, avg(ex::INT) AS extreme_fraction, coalesce(sum(root_step), 0) AS path_length, coalesce(sum(turn_sum), 0) AS joint_integral,
  coalesce(quantile_cont(root_step * fps, 0.99), 0) AS root_speed_p99, coalesce(quantile_cont(turn_max * fps, 0.99), 0) AS body_speed_p99, coalesce(any_value(lc.n), 0) / any_value(fps) AS calibration_run, coalesce(any_value(lx.n), 0) AS extreme_run
  FROM mk LEFT JOIN lx ON lx.seq = mk.seq LEFT JOIN lc ON lc.seq = mk.seq GROUP BY 1)"""

METRICS = ["static_fraction", "calibration_fraction", "sitting_fraction", "lying_fraction", "crawl_fraction", "floor_fraction", "jump_fraction", "extreme_fraction", "path_length", "joint_integral", "root_speed_p99", "body_speed_p99", "calibration_run"]
AXES, TURNS = ("x", "y", "z"), ("rx", "ry", "rz")


@query(f"""WITH {JOINTS_SQL}, {FRAMES_SQL}, rate AS (SELECT DISTINCT seq, 30.0::DOUBLE AS fps FROM jr), {METRICS_SQL} SELECT seq, {', '.join(f'round({m}, 6) AS {m}' for m in METRICS)}, extreme_run FROM mt""")
def q98_joint_metrics(spark, sf_dir):
    scratch, rows = Scratch(spark, "joints"), joint_rows(spark, sf_dir)
    f = joints.joint_frames(rows, rows.where("joint > 0"), "seq", "frame", "joint", AXES, TURNS, scratch)
    m = metrics.motion_metrics(f, "seq", "frame", 30.0, scratch)
    return m.select("seq", *(R(c).alias(c) for c in METRICS), "extreme_run")


#: Turns by value / 200 about the first axis, then by event_id / 7 about the third.
_TURNED = "array(cos(a) * cos(b), sin(a) * cos(b), -sin(a) * sin(b), cos(a) * sin(b))"


@query(f"""WITH {_FRAMES}, g AS (SELECT user_id, frame, us / 1e6 AS t, cos(a) * cos(b) AS w, sin(a) * cos(b) AS i, -sin(a) * sin(b) AS j, cos(a) * sin(b) AS k FROM (SELECT *, value / 400 AS a, event_id % 97 / 14.0::DOUBLE AS b FROM f)),
n AS (SELECT user_id, frame, coalesce(lead(t) OVER o, t) - coalesce(lag(t) OVER o, t) AS dt, {', '.join(f'coalesce(lag({c}) OVER o, {c}) AS {c}0, coalesce(lead({c}) OVER o, {c}) AS {c}1' for c in 'wijk')} FROM g WINDOW o AS (PARTITION BY user_id ORDER BY frame)),
r AS (SELECT user_id, frame, dt, w0 * w1 + i0 * i1 + j0 * j1 + k0 * k1 AS w, w0 * i1 - i0 * w1 - j0 * k1 + k0 * j1 AS i, w0 * j1 + i0 * k1 - j0 * w1 - k0 * i1 AS j, w0 * k1 - i0 * j1 + j0 * i1 - k0 * w1 AS k FROM n),
s AS (SELECT *, sqrt(i * i + j * j + k * k) AS l FROM r), h AS (SELECT *, CASE WHEN l > 0 THEN (CASE WHEN 2 * atan2(l, w) > pi() THEN 2 * atan2(l, w) - 2 * pi() ELSE 2 * atan2(l, w) END) / l ELSE 0 END AS m FROM s)
SELECT user_id, frame, CASE WHEN dt > 0 THEN round(i * m / dt, 6) + 0.0 ELSE 0 END AS x, CASE WHEN dt > 0 THEN round(j * m / dt, 6) + 0.0 ELSE 0 END AS y, CASE WHEN dt > 0 THEN round(k * m / dt, 6) + 0.0 ELSE 0 END AS z FROM h""")
def q99_root_turns(spark, sf_dir):
    f = frames(spark, sf_dir).withColumns({"t": F.col("us") / F.lit(1e6), "a": F.col("value") / F.lit(400.0), "b": F.col("event_id") % 97 / F.lit(14.0)})
    v = trajectory.angular_velocity("q", "t", "user_id", "frame")
    f = f.withColumn("q", F.expr(_TURNED)).select("user_id", "frame", v.alias("v"))
    return f.select("user_id", "frame", *((R(F.col("v")[i]) + 0.0).alias(c) for i, c in enumerate("xyz")))
