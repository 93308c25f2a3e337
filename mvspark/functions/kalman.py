"""The constant-velocity Kalman filter and its backward pass as parallel prefixes.

A step of the filter is an element (A, b, C, e, J) of an associative operation, one of the backward pass is an affine map (E, g): runs of steps are composed in any grouping. The axes
don't mix and share one 2 x 2 covariance: a state is (position, velocity) by axis. Matrices have their two indices first, then series and steps:
one array operation serves all series and steps at once.
"""

import numpy as np

MOVE = np.array([[1.0, 1.0], [0.0, 1.0]])
NOISE = np.array([[0.25, 0.5], [0.5, 1.0]])
Element = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def mul(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return x[:, 0, None] * y[None, 0] + x[:, 1, None] * y[None, 1]


def turned(x: np.ndarray) -> np.ndarray:
    return x.swapaxes(0, 1)


def inverse(x: np.ndarray) -> np.ndarray:
    (a, b), (c, d) = x
    return np.array([[d, -b], [-c, a]]) / (a * d - b * c)


def over(x: np.ndarray, like: np.ndarray) -> np.ndarray:
    """A constant matrix for all series and steps."""
    return np.broadcast_to(x.reshape(x.shape + (1,) * (like.ndim - 2)), x.shape + like.shape[2:])


def elements(y: np.ndarray, seen: np.ndarray, std: np.ndarray, process_std: float) -> Element:
    """The step of each series and time: y (3, series, steps) counts where ``seen``."""
    q = process_std**2 * NOISE
    h = seen / (q[0, 0] + std**2)  # of the position's predicted variance
    gain = q[:, :1, None, None] * h  # (2, 1, ...)
    keep = np.eye(2)[:, :, None, None] - np.concatenate([gain, np.zeros_like(gain)], axis=1)
    to = MOVE[0][:, None, None, None] * h
    return mul(keep, over(MOVE, keep)), gain * y[None], mul(keep, over(q, keep)), to * y[None], to * MOVE[0][None, :, None, None]


def combined(i: Element, j: Element) -> Element:
    """First i, then j."""
    (a, b, c, e, k), (a2, b2, c2, e2, k2) = i, j
    eye = over(np.eye(2), c)
    on = mul(a2, inverse(eye + mul(c, k2)))
    back = mul(turned(a), inverse(eye + mul(k2, c)))
    return mul(on, a), mul(on, b + mul(c, e2)) + b2, mul(mul(on, c), turned(a2)) + c2, mul(back, e2 - mul(k2, b)) + e, mul(mul(back, k2), a) + k


def scanned(operation, x: tuple) -> tuple:
    """Of each step all up to it, in about two operations a step: pairs of steps are scanned, then the odd steps are put behind them."""
    n = x[0].shape[-1]
    if n == 1:
        return x
    pairs = scanned(operation, operation(tuple(v[..., : n - n % 2 : 2] for v in x), tuple(v[..., 1::2] for v in x)))
    odd = operation(tuple(v[..., : (n - 1) // 2] for v in pairs), tuple(v[..., 2::2] for v in x)) if n > 2 else None
    out = tuple(np.empty_like(v) for v in x)
    for k, v in enumerate(out):
        v[..., 0], v[..., 1::2] = x[k][..., 0], pairs[k]
        if odd is not None:
            v[..., 2::2] = odd[k]
    return out


def total(operation, x: tuple) -> tuple:
    """All steps as one, in one operation a step."""
    while (n := x[0].shape[-1]) > 1:
        pairs = operation(tuple(v[..., : n - n % 2 : 2] for v in x), tuple(v[..., 1::2] for v in x))
        x = tuple(np.concatenate([v, w[..., n - n % 2 :]], axis=-1) for v, w in zip(pairs, x, strict=True))
    return tuple(v[..., 0] for v in x)


def after(mean: np.ndarray, cov: np.ndarray, x: Element) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance after steps x from a state before them."""
    a, b, c, e, k = x
    on = mul(a, inverse(over(np.eye(2), c) + mul(cov, k)))
    return mul(on, mean + mul(cov, e)) + b, mul(mul(on, over(np.eye(2), c) * 0 + cov), turned(a)) + c


def start(y: np.ndarray, std: np.ndarray, before: np.ndarray, process_std: float) -> tuple[np.ndarray, np.ndarray]:
    """State at each series' first observation y (3, series), ``before`` steps after the first listed one: unit covariance predicted so often, then this observation."""
    k, q = before.astype(float), process_std**2
    cov = np.array([[1 + k * k + q * k * (4 * k * k - 1) / 12, k + q * k * k / 2], [k + q * k * k / 2, 1 + q * k]])
    gain = cov[:, 0] / (cov[0, 0] + std**2)
    return np.stack([y, np.zeros_like(y)]), cov - gain[:, None] * cov[0][None]


def backward(mean: np.ndarray, cov: np.ndarray, process_std: float) -> tuple[np.ndarray, np.ndarray]:
    """(E, g): a step's smoothed state is E of the next one's, and g."""
    move = over(MOVE, cov)
    ahead = mul(mul(move, cov), turned(move)) + over(process_std**2 * NOISE, cov)
    e = mul(mul(cov, turned(move)), inverse(ahead))
    return e, mean - mul(e, mul(move, mean))


def behind(later: tuple, now: tuple) -> tuple:
    """The backward step ``now`` after the later ones."""
    return mul(now[0], later[0]), mul(now[0], later[1]) + now[1]


def suffixes(e: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each step all from it on."""
    return tuple(v[..., ::-1] for v in scanned(behind, (e[..., ::-1], g[..., ::-1])))
