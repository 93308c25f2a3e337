"""Turns as rotation vectors and matrices, for arrays of any leading shape."""

import numpy as np


def cross_matrix(v: np.ndarray) -> np.ndarray:
    """(..., 3, 3): the matrix whose product with a vector is the cross product of v with it."""
    out = np.zeros((*v.shape, 3))
    for i, j, k in ((0, 1, 2), (1, 2, 0), (2, 0, 1)):
        out[..., j, i], out[..., i, j] = v[..., k], -v[..., k]
    return out


def rotation_matrix(v: np.ndarray) -> np.ndarray:
    """(..., 3, 3) of rotation vectors (..., 3)."""
    angle = np.linalg.norm(v, axis=-1)[..., None, None]
    k = cross_matrix(v)
    # sinc keeps the quotients whole at a turn of zero
    return np.eye(3) + np.sinc(angle / np.pi) * k + np.sinc(angle / 2 / np.pi) ** 2 / 2 * k @ k


def rotation_vector(r: np.ndarray) -> np.ndarray:
    """(..., 3) of rotation matrices (..., 3, 3): the axis times an angle of at most half a turn."""
    odd = np.stack([r[..., 2, 1] - r[..., 1, 2], r[..., 0, 2] - r[..., 2, 0], r[..., 1, 0] - r[..., 0, 1]], -1) / 2
    sine, cosine = np.linalg.norm(odd, axis=-1), (np.trace(r, axis1=-2, axis2=-1) - 1) / 2
    angle = np.arctan2(sine, cosine)
    small = odd / np.sinc(angle / np.pi)[..., None].clip(1e-300)
    # Towards half a turn the odd part vanishes; the even part is the axis times itself.
    even = (r + np.swapaxes(r, -1, -2)) / 2 - cosine[..., None, None] * np.eye(3)
    best = np.argmax(np.diagonal(even, axis1=-2, axis2=-1), -1)
    axis = np.take_along_axis(even, best[..., None, None], -1)[..., 0]
    axis = axis / np.linalg.norm(axis, axis=-1, keepdims=True).clip(1e-300)
    axis = np.where(np.sum(axis * odd, -1, keepdims=True) < 0, -axis, axis)
    return np.where((cosine < -0.999)[..., None], axis * angle[..., None], small)


def turn_slope(v: np.ndarray) -> np.ndarray:
    """(..., 3, 3): how the rotation vector v of a turn changes with a small turn that is put in front of it."""
    angle = np.linalg.norm(v, axis=-1)
    half = np.maximum(angle / 2, 1e-4)
    c = np.where(angle < 2e-4, 1 / 12, (1 - half / np.tan(half)) / np.maximum(angle, 2e-4) ** 2)
    k = cross_matrix(v)
    return np.eye(3) - k / 2 + c[..., None, None] * k @ k
