"""Factor and variable types of the generic least-squares solver, as vectorised residual functions.

A variable type has a flat estimate, a number of degrees of freedom and a retraction. A factor type names its variables'
types and maps a batch of their estimates and measurements to a batch of residuals; derivatives are central differences
through the retraction, over the whole batch at once. Both registries take user types.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from scanweave.functions import geometry as g


@dataclass(frozen=True)
class Variable:
    size: int
    dof: int
    retract: Callable[[np.ndarray, np.ndarray], np.ndarray]  # (batch, size), (batch, dof) -> (batch, size)


@dataclass(frozen=True)
class Factor:
    variables: tuple[str, ...]
    size: int
    residual: Callable[..., np.ndarray]  # estimates of each variable, measurement -> (batch, size)


VARIABLES: dict[str, Variable] = {}
FACTORS: dict[str, Factor] = {}
#: Factor types whose residuals are to be zero (equality) or at most zero (inequality).
CONSTRAINTS: dict[str, str] = {}


def variable(name: str, size: int, dof: int):
    def add(f):
        VARIABLES[name] = Variable(size, dof, f)
        return f

    return add


def factor(name: str, variables: tuple[str, ...], size: int):
    def add(f):
        FACTORS[name] = Factor(variables, size, f)
        return f

    return add


def _m4(x: np.ndarray) -> np.ndarray:
    return x.reshape(-1, 4, 4)


def _euler(v: np.ndarray) -> np.ndarray:
    """Pose of translation and rotations about x, y, z applied in the order z, y, x."""
    out = np.tile(np.eye(4), (len(v), 1, 1))
    out[:, :3, :3] = g.rotations("x", v[:, 3]) @ g.rotations("y", v[:, 4]) @ g.rotations("z", v[:, 5])
    out[:, :3, 3] = v[:, :3]
    return out


# variables


@variable("se3", 16, 6)
def _se3(x, d):
    return (_m4(x) @ g.v2t(d)).reshape(-1, 16)


@variable("se3_left", 16, 6)
def _se3_left(x, d):
    return (g.v2t(d) @ _m4(x)).reshape(-1, 16)


@variable("se3_euler", 16, 6)
def _se3_euler(x, d):
    return (_m4(x) @ _euler(d)).reshape(-1, 16)


@variable("se3_euler_left", 16, 6)
def _se3_euler_left(x, d):
    return (_euler(d) @ _m4(x)).reshape(-1, 16)


@variable("se3_relaxed", 16, 12)
def _se3_relaxed(x, d):
    out = _m4(x).copy()
    out[:, :3, :] += d.reshape(-1, 3, 4)
    return out.reshape(-1, 16)


@variable("so3", 9, 3)
def _so3(x, d):
    return (x.reshape(-1, 3, 3) @ g.v2t(np.hstack([0 * d, d]))[:, :3, :3]).reshape(-1, 9)


@variable("so3_relaxed", 9, 9)
def _so3_relaxed(x, d):
    return x + d


@variable("se2", 3, 3)
def _se2(x, d):
    c, s = np.cos(x[:, 2]), np.sin(x[:, 2])
    return np.stack([x[:, 0] + c * d[:, 0] - s * d[:, 1], x[:, 1] + s * d[:, 0] + c * d[:, 1], g.normalize_angle(x[:, 2] + d[:, 2])], axis=1)


@variable("so2", 1, 1)
def _so2(x, d):
    return g.normalize_angle(x + d)


@variable("sim3", 16, 7)
def _sim3(x, d):
    return (_m4(x) @ g.similarity(np.exp(d[:, 6]), g.v2t(d[:, :6]))).reshape(-1, 16)


for _name, _n in (("point2", 2), ("point3", 3), ("time", 1), ("imu_bias", 6), ("vector3", 3), ("vector9", 9)):
    variable(_name, _n, _n)(lambda x, d: x + d)


@variable("surfel", 6, 1)
def _surfel(x, d):
    """Mean and normal; the mean moves along the normal."""
    return np.hstack([x[:, :3] + d * x[:, 3:], x[:, 3:]])


# helpers


def _inv2(x):
    c, s = np.cos(x[:, 2]), np.sin(x[:, 2])
    return np.stack([-c * x[:, 0] - s * x[:, 1], s * x[:, 0] - c * x[:, 1], -x[:, 2]], axis=1)


def _local2(x, p):
    """p in the frame of a planar pose."""
    c, s = np.cos(x[:, 2]), np.sin(x[:, 2])
    d = p - x[:, :2]
    return np.stack([c * d[:, 0] + s * d[:, 1], -s * d[:, 0] + c * d[:, 1]], axis=1)


def _world2(x, p):
    c, s = np.cos(x[:, 2]), np.sin(x[:, 2])
    return np.stack([x[:, 0] + c * p[:, 0] - s * p[:, 1], x[:, 1] + s * p[:, 0] + c * p[:, 1]], axis=1)


def _compose2(a, b):
    return np.hstack([_world2(a, b[:, :2]), g.normalize_angle(a[:, 2:] + b[:, 2:])])


def _local(x, p):
    x = _m4(x)
    return np.einsum("kji,kj->ki", x[:, :3, :3], p - x[:, :3, 3])


def _world(x, p):
    x = _m4(x)
    return np.einsum("kij,kj->ki", x[:, :3, :3], p) + x[:, :3, 3]


def _turn(x, n):
    return np.einsum("kij,kj->ki", _m4(x)[:, :3, :3], n)


def _between(a, b):
    return g.inverse(_m4(a)) @ _m4(b)


def _pixel(p, k):
    """Pixels of points before a camera k = (fx, fy, cx, cy)."""
    z = np.where(np.abs(p[:, 2]) < 1e-9, 1e-9, p[:, 2])
    return np.stack([k[:, 0] * p[:, 0] / z + k[:, 2], k[:, 1] * p[:, 1] / z + k[:, 3]], axis=1)


def _essential(a, b):
    """Essential matrix between two camera poses."""
    x = _between(a, b)
    return g.skew(x[:, :3, 3]) @ x[:, :3, :3]


# planar factors


@factor("se2_circle", ("se2",), 1)
def _(x, z):
    return (x[:, :2] ** 2).sum(axis=1, keepdims=True) - z[:, :1] ** 2


@factor("se2_plane_plane", ("se2",), 3)
def _(x, z):
    """z: fixed point and normal, moving point and normal."""
    turned = _world2(np.hstack([0 * x[:, :2], x[:, 2:]]), z[:, 6:8])
    return np.hstack([((_world2(x, z[:, 4:6]) - z[:, :2]) * z[:, 2:4]).sum(axis=1, keepdims=True), turned - z[:, 2:4]])


@factor("se2_point_point", ("se2",), 2)
def _(x, z):
    return _world2(x, z[:, 2:4]) - z[:, :2]


@factor("se2_bearing", ("se2", "point2"), 1)
def _(x, p, z):
    q = _local2(x, p)
    return 2 * (1 - np.cos(np.arctan2(q[:, 1:], q[:, :1]) - z[:, :1]))


@factor("se2_pose_point", ("se2", "point2"), 2)
def _(x, p, z):
    return _local2(x, p) - z[:, :2]


@factor("se2_range_limit", ("se2", "point2"), 1)
def _(x, p, z):
    return np.maximum(0.0, z[:, :1] - np.linalg.norm(_local2(x, p), axis=1, keepdims=True))


@factor("se2_pose_pose", ("se2", "se2"), 3)
def _(a, b, z):
    return _compose2(_inv2(z), _compose2(_inv2(a), b))


@factor("se2_pose_pose_chordal", ("se2", "se2"), 6)
def _(a, b, z):
    return (g.se2(_compose2(_inv2(a), b)) - g.se2(z))[:, :2, :].reshape(-1, 6)


@factor("se2_prior", ("se2",), 3)
def _(x, z):
    return _compose2(_inv2(z), x)


# spatial factors


@factor("gps", ("se3",), 3)
def _(x, z):
    return _m4(x)[:, :3, 3] - z[:, :3]


@factor("se3_plane_plane", ("se3",), 4)
def _(x, z):
    """z: fixed point and normal, moving point and normal."""
    return np.hstack([((_world(x, z[:, 6:9]) - z[:, :3]) * z[:, 3:6]).sum(axis=1, keepdims=True), _turn(x, z[:, 9:12]) - z[:, 3:6]])


@factor("se3_point_point", ("se3",), 3)
def _(x, z):
    return _world(x, z[:, 3:6]) - z[:, :3]


@factor("se3_pose_point", ("se3", "point3"), 3)
def _(x, p, z):
    return _local(x, p) - z[:, :3]


@factor("se3_pose_point_offset", ("se3", "point3", "se3"), 3)
def _(x, p, o, z):
    return _local((_m4(x) @ _m4(o)).reshape(-1, 16), p) - z[:, :3]


@factor("se3_pose_pose", ("se3", "se3"), 6)
def _(a, b, z):
    return g.t2v(g.inverse(_m4(z[:, :16])) @ _between(a, b))


def _chordal(a, b, z):
    return (_between(a, b) - _m4(z[:, :16]))[:, :3, :].reshape(-1, 12)


for _side in ("se3", "se3_euler", "se3_euler_left", "se3_relaxed"):
    factor(f"{_side}_pose_pose_chordal", (_side, _side), 12)(_chordal)


@factor("se3_prior", ("se3",), 6)
def _(x, z):
    return g.t2v(g.inverse(_m4(z[:, :16])) @ _m4(x))


@factor("se3_prior_offset", ("se3",), 6)
def _(x, z):
    """z: measured sensor pose and the sensor's pose on the body."""
    return g.t2v(g.inverse(_m4(z[:, :16])) @ _m4(x) @ _m4(z[:, 16:32]))


@factor("se3_hand_eye", ("se3",), 6)
def _(x, z):
    """z: motion of the body and motion of the sensor; x is the sensor on the body."""
    return g.t2v(g.inverse(_m4(z[:, 16:32])) @ g.inverse(_m4(x)) @ _m4(z[:, :16]) @ _m4(x))


@factor("se2_hand_eye", ("se2",), 3)
def _(x, z):
    return _compose2(_inv2(z[:, 3:6]), _compose2(_inv2(x), _compose2(z[:, :3], x)))


@factor("se3_matchable", ("se3_euler_left",), 7)
def _(x, z):
    """z: fixed origin and direction, moving origin and direction: along the direction, directions, orthogonality."""
    d = _turn(x, z[:, 9:12])
    offset = _world(x, z[:, 6:9]) - z[:, :3]
    return np.hstack([offset * np.abs(z[:, 3:6]), d - z[:, 3:6], (d * z[:, 3:6]).sum(axis=1, keepdims=True) - 1])


@factor("se3_surfel", ("se3", "surfel"), 1)
def _(x, s, z):
    return (_turn(g.inverse(_m4(x)).reshape(-1, 16), s[:, 3:]) * (_local(x, s[:, :3]) - z[:, :3])).sum(axis=1, keepdims=True)


# projections; z holds what is fixed: pixel(s), then the camera, then the point


@factor("se3_projective", ("se3",), 2)
def _(x, z):
    return _pixel(_local(x, z[:, 6:9]), z[:, 2:6]) - z[:, :2]


@factor("se3_projective_depth", ("se3",), 3)
def _(x, z):
    p = _local(x, z[:, 7:10])
    return np.hstack([_pixel(p, z[:, 3:7]), p[:, 2:]]) - z[:, :3]


@factor("se3_stereo", ("se3",), 3)
def _(x, z):
    """z: left column and row, right column, camera, baseline, point."""
    p = _local(x, z[:, 8:11])
    left = _pixel(p, z[:, 3:7])
    right = left[:, :1] - z[:, 3:4] * z[:, 7:8] / np.where(np.abs(p[:, 2:]) < 1e-9, 1e-9, p[:, 2:])
    return np.hstack([left, right]) - z[:, :3]


@factor("ba_pinhole", ("se3", "point3"), 2)
def _(x, p, z):
    return _pixel(_local(x, p), z[:, 2:6]) - z[:, :2]


@factor("ba_stereo", ("se3", "point3"), 3)
def _(x, p, z):
    return FACTORS["se3_stereo"].residual(x, np.hstack([z[:, :8], p]))


@factor("ba_direction", ("se3", "point3", "se3"), 3)
def _(x, p, o, z):
    q = _local((_m4(x) @ _m4(o)).reshape(-1, 16), p)
    return q / np.linalg.norm(q, axis=1, keepdims=True) - z[:, :3]


@factor("epipolar", ("se3", "se3"), 1)
def _(a, b, z):
    """z: directions to one point from both cameras."""
    e = np.einsum("ki,kij,kj->k", z[:, :3], _essential(a, b), z[:, 3:6])
    return e[:, None]


@factor("essential_translation", ("point3", "point3"), 3)
def _(a, b, z):
    return np.cross(z[:, :3], b - a)


@factor("pairwise_scale", ("se3", "se3"), 1)
def _(a, b, z):
    d2 = ((_m4(a)[:, :3, 3] - _m4(b)[:, :3, 3]) ** 2).sum(axis=1, keepdims=True)
    return np.log(np.maximum(d2, 1e-30) / z[:, :1] ** 2)


# similarities, rotations, odometry


@factor("sim3_point_point", ("sim3",), 3)
def _(x, z):
    return _world(x, z[:, 3:6]) - z[:, :3]


@factor("sim3_pose_pose", ("sim3", "sim3"), 7)
def _(a, b, z):
    e = g.similarity_inverse(_m4(z[:, :16])) @ g.similarity_inverse(_m4(a)) @ _m4(b)
    scale = np.cbrt(np.linalg.det(e[:, :3, :3]))
    e = g.similarity(1 / scale, e)
    return np.hstack([g.t2v(e), np.log(scale)[:, None]])


@factor("so3_relaxed_orthogonal", ("so3_relaxed",), 9)
def _(x, z):
    r = x.reshape(-1, 3, 3)
    return (r @ np.swapaxes(r, 1, 2) - np.eye(3)).reshape(-1, 9)


@factor("so3_relaxed_pose_pose", ("so3_relaxed", "so3_relaxed"), 9)
def _(a, b, z):
    return (np.swapaxes(a.reshape(-1, 3, 3), 1, 2) @ b.reshape(-1, 3, 3)).reshape(-1, 9) - z[:, :9]


@factor("so3_pose_pose", ("so3", "so3"), 3)
def _(a, b, z):
    return g.matrix_to_quaternion(np.swapaxes(z[:, :9].reshape(-1, 3, 3), 1, 2) @ np.swapaxes(a.reshape(-1, 3, 3), 1, 2) @ b.reshape(-1, 3, 3))[:, :3]


def differential_drive(k: np.ndarray, ticks: np.ndarray) -> np.ndarray:
    """Planar motion from wheel ticks (left, right); k: left and right factors and the axle's length."""
    left, right = k[:, 0] * ticks[:, 0], k[:, 1] * ticks[:, 1]
    turn, go = (right - left) / k[:, 2], (left + right) / 2
    return np.stack([go * np.sinc(turn / np.pi), go * turn / 2 * np.sinc(turn / (2 * np.pi)) ** 2, turn], axis=1)


@factor("drive_odometry", ("point3",), 3)
def _(k, z):
    """z: measured motion and ticks."""
    return _compose2(_inv2(z[:, :3]), differential_drive(k, z[:, 3:5]))


@factor("drive_sensor_2d", ("point3", "se2"), 3)
def _(k, s, z):
    return _compose2(_inv2(z[:, :3]), _compose2(_inv2(s), _compose2(differential_drive(k, z[:, 3:5]), s)))


@factor("drive_sensor_3d", ("point3", "se3_euler"), 6)
def _(k, s, z):
    """z: measured sensor motion (pose) and ticks."""
    d = differential_drive(k, z[:, 16:18])
    body = _euler(np.hstack([d[:, :2], np.zeros((len(d), 3)), d[:, 2:]]))
    return g.t2v(g.inverse(_m4(z[:, :16])) @ g.inverse(_m4(s)) @ body @ _m4(s))


@factor("se3_time_delay", ("time", "se3"), 6)
def _(t, s, z):
    """z: sensor pose, then body poses at both ends of an interval, its length and the sensor's offset inside it."""
    u = (z[:, 49] + t[:, 0]) / z[:, 48]
    body = g.interpolate(_m4(z[:, 16:32]), _m4(z[:, 32:48]), u)
    return g.t2v(g.inverse(_m4(z[:, :16])) @ body @ _m4(s))


# IMU


def preintegrate(samples: np.ndarray, bias: np.ndarray) -> dict[str, np.ndarray | float]:
    """Rotation, velocity and position increments of (dt, ax, ay, az, gx, gy, gz) rows in order."""
    r, v, p, t = np.eye(3), np.zeros(3), np.zeros(3), 0.0
    for dt, *rest in samples:
        a, w = np.array(rest[:3]) - bias[:3], np.array(rest[3:]) - bias[3:]
        p = p + v * dt + 0.5 * dt * dt * (r @ a)
        v = v + dt * (r @ a)
        r = r @ g.exp_so3(w * dt)
        t += dt
    return {"rotation": r, "velocity": v, "position": p, "time": t}


GRAVITY = np.array([0.0, 0.0, -9.81])


@factor("imu", ("se3", "vector3", "se3", "vector3", "imu_bias", "imu_bias"), 15)
def _(a, va, b, vb, bias_a, bias_b, z):
    """z: rotation (9), velocity, position increments and the time between the poses."""
    xa, xb, t = _m4(a), _m4(b), z[:, 15:16]
    back = np.swapaxes(xa[:, :3, :3], 1, 2)
    turn = lambda m, v: np.einsum("kij,kj->ki", m, v)
    rotation = g.log_so3(np.swapaxes(z[:, :9].reshape(-1, 3, 3), 1, 2) @ back @ xb[:, :3, :3])
    velocity = turn(back, vb - va - GRAVITY * t) - z[:, 9:12]
    position = turn(back, xb[:, :3, 3] - xa[:, :3, 3] - va * t - 0.5 * GRAVITY * t * t) - z[:, 12:15]
    return np.hstack([rotation, velocity, position, bias_b - bias_a])


# constraints


def constraint(name: str, variables: tuple[str, ...], size: int, kind: str):
    def add(f):
        CONSTRAINTS[name] = kind
        return factor(name, variables, size)(f)

    return add


@constraint("se2_circle_constraint", ("se2",), 1, "equality")
def _(x, z):
    """The pose lies on the circle of radius z around the origin."""
    return (x[:, :2] ** 2).sum(axis=1, keepdims=True) - z[:, :1] ** 2


@constraint("se2_range_constraint", ("se2", "point2"), 1, "inequality")
def _(x, p, z):
    """The point is at least z away from the pose."""
    return z[:, :1] - np.linalg.norm(p - x[:, :2], axis=1, keepdims=True)


@constraint("so3_orthonormal_constraint", ("so3_relaxed",), 9, "equality")
def _(x, z):
    m = x.reshape(-1, 3, 3)
    return (m @ np.swapaxes(m, 1, 2) - np.eye(3)).reshape(-1, 9)


def evaluate(kind: str, estimates: list[np.ndarray], measurement: np.ndarray, derivatives: bool = True, step: float = 1e-4) -> tuple[np.ndarray, list[np.ndarray]]:
    """Residuals (batch, size) and for each variable the derivatives (batch, size, dof).

    Derivatives are central differences of fourth order: the step can be long, so that rounding, which steps divide, stays some
    1e-12 of the residuals' terms. Solutions of long chains multiply it by their condition."""
    f = FACTORS[kind]
    e = f.residual(*estimates, measurement)
    out = []
    for i, name in enumerate(f.variables if derivatives else ()):
        v = VARIABLES[name]
        j = np.zeros((len(e), f.size, v.dof))
        for k in range(v.dof):
            d = np.zeros((len(e), v.dof))
            d[:, k] = step
            ends = []
            for far in (1, -1, 2, -2):
                moved = list(estimates)
                moved[i] = v.retract(estimates[i], far * d)
                ends.append(f.residual(*moved, measurement))
            j[:, :, k] = (8 * (ends[0] - ends[1]) - (ends[2] - ends[3])) / (12 * step)
        out.append(j)
    return e, out
