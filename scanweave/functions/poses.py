"""Rigid poses as columns: seven columns tx, ty, tz, qx, qy, qz, qw (unit quaternion), combined by built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FIELDS = ("tx", "ty", "tz", "qx", "qy", "qz", "qw")
STRUCT = "struct<" + ", ".join(f"{c}: double" for c in FIELDS) + ">"


def of(c: Column) -> tuple[Column, ...]:
    """The seven fields of a struct column."""
    return tuple(c[n] for n in FIELDS)


def struct(p: tuple[Column, ...]) -> Column:
    return F.struct(*[c.cast("double").alias(n) for c, n in zip(p, FIELDS, strict=True)])


def cross(a, b) -> tuple[Column, ...]:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def multiply(a, b) -> tuple[Column, ...]:
    """The product of two quaternions (x, y, z, w)."""
    c = cross(a, b)
    return (*[a[3] * b[i] + b[3] * a[i] + c[i] for i in range(3)], a[3] * b[3] - a[0] * b[0] - a[1] * b[1] - a[2] * b[2])


def rotate(q, v) -> tuple[Column, ...]:
    """The vector v turned by the unit quaternion q."""
    c = cross(q[:3], v)
    d = cross(q[:3], tuple(c[i] + q[3] * v[i] for i in range(3)))
    return tuple(v[i] + 2 * d[i] for i in range(3))


def inverse(a) -> tuple[Column, ...]:
    q = (-a[3], -a[4], -a[5], a[6])
    return (*[-x for x in rotate(q, a[:3])], *q)


def compose(a, b) -> tuple[Column, ...]:
    t = rotate(a[3:], b[:3])
    return (*[a[i] + t[i] for i in range(3)], *multiply(a[3:], b[3:]))


def between(a, b) -> tuple[Column, ...]:
    """The pose of b in the frame of a: inverse(a) * b."""
    q = (-a[3], -a[4], -a[5], a[6])
    return (*rotate(q, tuple(b[i] - a[i] for i in range(3))), *multiply(q, b[3:]))


def length(v) -> Column:
    return F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])


def angle(q) -> Column:
    """The angle of a rotation, in [0, pi]; exact for small ones."""
    return 2 * F.atan2(length(q), F.abs(q[3]))


def euler(q) -> tuple[Column, ...]:
    """Roll, pitch and yaw: the rotation is Rz(yaw) Ry(pitch) Rx(roll)."""
    x, y, z, w = q
    roll = F.atan2(2 * (w * x + y * z), 1 - 2 * (x * x + y * y))
    pitch = F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 2 * (w * y - z * x))))
    return roll, pitch, F.atan2(2 * (w * z + x * y), 1 - 2 * (y * y + z * z))


def yaw(a: Column) -> tuple[Column, ...]:
    """The quaternion of a turn by `a` about z."""
    return F.lit(0.0), F.lit(0.0), F.sin(a / 2), F.cos(a / 2)


def interpolate(a, b, u: Column) -> tuple[Column, ...]:
    """Linear in translation, spherical along the shorter way in rotation; nearly equal rotations are mixed linearly."""
    dot = a[3] * b[3] + a[4] * b[4] + a[5] * b[5] + a[6] * b[6]
    turn = F.acos(F.least(F.lit(1.0), F.abs(dot)))
    s, small = F.sin(turn), turn < 1e-6
    wa = F.when(small, 1 - u).otherwise(F.sin((1 - u) * turn) / s)
    wb = F.when(small, u).otherwise(F.sin(u * turn) / s) * F.when(dot < 0, -1.0).otherwise(1.0)
    return (*[a[i] + u * (b[i] - a[i]) for i in range(3)], *[wa * a[i] + wb * b[i] for i in range(3, 7)])
