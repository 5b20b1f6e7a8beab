"""SO(3), SE(3) and related maps on batches of numpy arrays; quaternions are (x, y, z, w)."""

from __future__ import annotations

import numpy as np


def quaternion_to_matrix(q: np.ndarray) -> np.ndarray:
    """(..., 4) -> (..., 3, 3); the quaternion is normalised first."""
    q = q / np.linalg.norm(q, axis=-1, keepdims=True)
    x, y, z, w = np.moveaxis(q, -1, 0)
    rows = [[1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)], [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)], [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]]
    return np.stack([np.stack(r, axis=-1) for r in rows], axis=-2)


def matrix_to_quaternion(r: np.ndarray) -> np.ndarray:
    """(..., 3, 3) -> (..., 4) with w >= 0, from the largest of the four squared components."""
    t = np.trace(r, axis1=-2, axis2=-1)
    squares = np.stack([1 + 2 * r[..., 0, 0] - t, 1 + 2 * r[..., 1, 1] - t, 1 + 2 * r[..., 2, 2] - t, 1 + t], axis=-1) / 4
    best = squares.argmax(axis=-1)
    s = np.sqrt(np.maximum(squares.max(axis=-1), 1e-30)) * 4
    d = [(r[..., 2, 1] - r[..., 1, 2]), (r[..., 0, 2] - r[..., 2, 0]), (r[..., 1, 0] - r[..., 0, 1])]
    p = [(r[..., 0, 1] + r[..., 1, 0]), (r[..., 0, 2] + r[..., 2, 0]), (r[..., 1, 2] + r[..., 2, 1])]
    options = np.stack([np.stack([s / 4, p[0] / s, p[1] / s, d[0] / s], -1), np.stack([p[0] / s, s / 4, p[2] / s, d[1] / s], -1), np.stack([p[1] / s, p[2] / s, s / 4, d[2] / s], -1), np.stack([d[0] / s, d[1] / s, d[2] / s, s / 4], -1)], axis=-2)
    q = np.take_along_axis(options, best[..., None, None], axis=-2)[..., 0, :]
    return np.where(q[..., 3:] < 0, -q, q)


def pose(t: np.ndarray, q: np.ndarray) -> np.ndarray:
    """(..., 3) and (..., 4) -> (..., 4, 4)."""
    out = np.zeros((*t.shape[:-1], 4, 4))
    out[..., :3, :3], out[..., :3, 3], out[..., 3, 3] = quaternion_to_matrix(q), t, 1
    return out


def v2t(v: np.ndarray) -> np.ndarray:
    """Manifold map: translation and the imaginary part of a unit quaternion -> pose."""
    im = v[..., 3:6]
    n2 = (im * im).sum(axis=-1, keepdims=True)
    long = n2 > 1
    w = np.sqrt(np.maximum(0.0, 1 - n2))
    q = np.concatenate([np.where(long, im / np.sqrt(np.maximum(n2, 1e-30)), im), np.where(long, 0.0, w)], axis=-1)
    return pose(v[..., :3], q)


def t2v(x: np.ndarray) -> np.ndarray:
    """Inverse of v2t."""
    return np.concatenate([x[..., :3, 3], matrix_to_quaternion(x[..., :3, :3])[..., :3]], axis=-1)


def inverse(x: np.ndarray) -> np.ndarray:
    """Inverse of rigid poses."""
    out = np.zeros_like(x)
    r = np.swapaxes(x[..., :3, :3], -1, -2)
    out[..., :3, :3], out[..., :3, 3], out[..., 3, 3] = r, -(r @ x[..., :3, 3:])[..., 0], 1
    return out


def skew(v: np.ndarray) -> np.ndarray:
    x, y, z = np.moveaxis(v, -1, 0)
    o = np.zeros_like(x)
    return np.stack([np.stack(r, axis=-1) for r in ([o, -z, y], [z, o, -x], [-y, x, o])], axis=-2)


def exp_so3(w: np.ndarray) -> np.ndarray:
    """Rotation vectors -> matrices; exact near 0."""
    a = np.linalg.norm(w, axis=-1)[..., None, None]
    s, k = np.sinc(a / np.pi), skew(w)
    c = np.sinc(a / (2 * np.pi)) ** 2 / 2
    return np.eye(3) + s * k + c * (k @ k)


def log_so3(r: np.ndarray) -> np.ndarray:
    q = matrix_to_quaternion(r)
    n = np.linalg.norm(q[..., :3], axis=-1, keepdims=True)
    a = 2 * np.arctan2(n, q[..., 3:])
    return np.where(n > 1e-12, a / np.maximum(n, 1e-12), 2.0) * q[..., :3]


def slerp(a: np.ndarray, b: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Rotation matrices between a (u = 0) and b (u = 1) along the shorter way."""
    return a @ exp_so3(u[..., None] * log_so3(np.swapaxes(a, -1, -2) @ b))


def interpolate(a: np.ndarray, b: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Poses between a and b: linear translation, spherical rotation."""
    out = np.zeros_like(a)
    out[..., :3, :3] = slerp(a[..., :3, :3], b[..., :3, :3], u)
    out[..., :3, 3] = a[..., :3, 3] + u[..., None] * (b[..., :3, 3] - a[..., :3, 3])
    out[..., 3, 3] = 1
    return out


def rotation_between(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The rotation of unit vector a to b about their cross product; the identity if they are parallel or opposite."""
    v, c = np.cross(a, b), (a * b).sum(axis=-1)[..., None, None]
    s2 = (v * v).sum(axis=-1)[..., None, None]
    k = skew(v)
    turned = np.eye(3) + k + k @ k * ((1 - c) / np.maximum(s2, 1e-30))
    return np.where(s2 < 1e-12, np.eye(3), turned)


def rotations(axis: str, angles: np.ndarray) -> np.ndarray:
    """Rotations about a coordinate axis."""
    out = np.zeros((*angles.shape, 3))
    out[..., "xyz".index(axis)] = angles
    return exp_so3(out)


def se2(v: np.ndarray) -> np.ndarray:
    """(..., 3) of x, y, angle -> (..., 3, 3)."""
    c, s, o, i = np.cos(v[..., 2]), np.sin(v[..., 2]), np.zeros_like(v[..., 2]), np.ones_like(v[..., 2])
    return np.stack([np.stack(r, axis=-1) for r in ([c, -s, v[..., 0]], [s, c, v[..., 1]], [o, o, i])], axis=-2)


def normalize_angle(a: np.ndarray) -> np.ndarray:
    return np.arctan2(np.sin(a), np.cos(a))


def similarity(scale: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Sim(3) matrices: scaled rotation, plain translation."""
    out = x.copy()
    out[..., :3, :3] *= scale[..., None, None]
    return out


def similarity_inverse(x: np.ndarray) -> np.ndarray:
    scale = np.cbrt(np.linalg.det(x[..., :3, :3]))[..., None, None]
    out = np.zeros_like(x)
    r = np.swapaxes(x[..., :3, :3], -1, -2) / (scale * scale)
    out[..., :3, :3], out[..., :3, 3], out[..., 3, 3] = r, -(r @ x[..., :3, 3:])[..., 0], 1
    return out
