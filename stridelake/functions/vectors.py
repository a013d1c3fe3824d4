"""Vectors and quaternions as array columns; doubles throughout."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from stridelake.functions.intervals import let


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine; null if either vector has length zero."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def unit(a: Column) -> Column:
    scaled = lambda x, n: F.when(n > 0, F.transform(x, lambda v: v.cast("double") / n))
    return let(a, lambda x: let(norm(x), lambda n: scaled(x, n)))


def angle(a: Column, b: Column) -> Column:
    """Angle between two vectors in radians; the product of their lengths is floored at 1e-8."""
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(1e-8)))))


def rms_distance(a: Column, b: Column) -> Column:
    d = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    return F.sqrt(dot(d, d) / F.size(d))


def quaternion_angle(a: Column, b: Column) -> Column:
    """Rotation angle between unit quaternions."""
    return 2 * F.acos(F.least(F.lit(1.0), F.abs(dot(a, b))))


def wxyz_to_xyzw(q: Column) -> Column:
    return F.array(q[1], q[2], q[3], q[0])


def rotvec_to_quaternion(v: Column) -> Column:
    """Unit quaternion wxyz of a rotation vector."""
    half = norm(v) / 2
    scale = F.when(half > 1e-12, F.sin(half) / (2 * half)).otherwise(F.lit(0.5))
    return F.array(F.cos(half), v[0] * scale, v[1] * scale, v[2] * scale)


def quaternion_multiply(a: Column, b: Column) -> Column:
    w = a[0] * b[0] - a[1] * b[1] - a[2] * b[2] - a[3] * b[3]
    x = a[0] * b[1] + a[1] * b[0] + a[2] * b[3] - a[3] * b[2]
    y = a[0] * b[2] - a[1] * b[3] + a[2] * b[0] + a[3] * b[1]
    z = a[0] * b[3] + a[1] * b[2] - a[2] * b[1] + a[3] * b[0]
    return F.array(w, x, y, z)


def relative_rotation(a: Column, b: Column) -> Column:
    """The rotation, in the frame of ``a``, that leads from ``a`` to ``b``; unit quaternions wxyz."""
    return quaternion_multiply(F.array(a[0], -a[1], -a[2], -a[3]), b)


def rotation_vector(q: Column) -> Column:
    """The logarithm of a unit quaternion wxyz: its axis times its angle, by the shorter way round."""

    def of(q):
        n = F.sqrt(q[1] * q[1] + q[2] * q[2] + q[3] * q[3])
        angle = 2 * F.atan2(n, q[0])
        turn = F.when(angle > F.pi(), angle - 2 * F.pi()).otherwise(angle)
        return F.transform(F.array(F.when(n > 0, turn / n).otherwise(F.lit(0.0))), lambda k: F.array(q[1] * k, q[2] * k, q[3] * k))[0]

    return F.transform(F.array(q), of)[0]


def angular_displacement(a: Column, b: Column) -> Column:
    """Magnitude of the relative rotation from ``a`` to ``b``, unit quaternions wxyz."""
    r = relative_rotation(a, b)
    return 2 * F.atan2(F.sqrt(r[1] * r[1] + r[2] * r[2] + r[3] * r[3]), F.abs(r[0]))


def slerp(a: Column, b: Column, t: Column) -> Column:
    """Spherical interpolation along the shorter arc; linear and renormalised when nearly parallel."""
    raw = dot(a, b)
    near = F.when(raw < 0, F.transform(b, lambda v: -v)).otherwise(b)
    d = F.least(F.abs(raw), F.lit(1.0))
    theta = F.acos(d)
    line = F.zip_with(a, near, lambda x, y: x + t * (y - x))
    arc = F.zip_with(a, near, lambda x, y: (F.sin((1 - t) * theta) * x + F.sin(t * theta) * y) / F.sin(theta))
    return F.when(d > 0.9995, unit(line)).otherwise(arc)


def sample_indices(n: Column, skip: Column) -> Column:
    """``max(1, n div skip)`` indices spread evenly over 0..n-1, both ends included, halves to even."""
    k = F.greatest(F.lit(1).cast("bigint"), F.floor(n / skip))
    step = (n - 1) / (k - 1).cast("double")
    at = F.transform(F.sequence(F.lit(0).cast("bigint"), k - 1), lambda i: F.when(i == k - 1, (n - 1).cast("bigint")).otherwise(F.rint(i * step).cast("bigint")))
    return F.when(k <= 1, F.array(F.lit(0).cast("bigint"))).otherwise(at)


def spread_indices(n: Column, points: int) -> Column:
    """``points`` indices spread evenly over 0..n-1, halves to even; repeated where there are fewer; none for ``n`` of 0."""
    last = (n - 1).cast("bigint")
    at = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.when(i == points - 1, last).otherwise(F.rint(i * ((n - 1) / F.lit(float(points - 1)))).cast("bigint")))
    return F.when(n > 0, at).otherwise(F.array().cast("array<bigint>"))


def root_descriptor(positions: Column, points: int = 32) -> Column:
    """``points`` positions spread evenly over a sequence of positions, less the first, as one flat array."""
    picked = let(positions, lambda x: F.transform(spread_indices(F.size(x), points), lambda k: F.get(x, k.cast("int"))))
    less = lambda x, first: F.flatten(F.transform(x, lambda p: F.zip_with(p, first, lambda a, b: a - b)))
    return let(picked, lambda x: let(F.get(x, F.lit(0)), lambda first: less(x, first)))


def rotate(q: Column, v: Column) -> Column:
    """A vector turned by a unit quaternion wxyz."""
    turned = quaternion_multiply(quaternion_multiply(q, F.array(F.lit(0.0), v[0], v[1], v[2])), F.array(q[0], -q[1], -q[2], -q[3]))
    return F.slice(turned, 2, 3)
