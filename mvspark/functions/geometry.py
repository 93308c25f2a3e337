"""Camera geometry as column expressions: all of it stays in generated code."""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def to_pixels(x, size) -> Column:
    """Image fraction to pixels."""
    return _c(x) * _c(size)


#: The columns of a camera's 3 x 4 matrix.
PROJECTION = [[f"p{i}{k}" for k in range(4)] for i in range(3)]


def with_projection(cameras: DataFrame) -> DataFrame:
    """Cameras (fx, fy, cx, cy, r array of nine in rows, t array of three) with the columns p00 to p23 of K [R | t]."""
    r = [[F.get("r", F.lit(3 * i + k)) for k in range(3)] + [F.get("t", F.lit(i))] for i in range(3)]
    fx, fy, cx, cy = map(F.col, ("fx", "fy", "cx", "cy"))
    rows = [[fx * r[0][k] + cx * r[2][k] for k in range(4)], [fy * r[1][k] + cy * r[2][k] for k in range(4)], r[2]]
    return cameras.withColumns({PROJECTION[i][k]: rows[i][k] for i in range(3) for k in range(4)})


def camera_centre() -> Column:
    """Where a camera (r, t) stands in the world: -Rt t."""
    return F.array(*[-sum((F.get("r", F.lit(3 * i + k)) * F.get("t", F.lit(i)) for i in (1, 2)), F.get("r", F.lit(k)) * F.get("t", F.lit(0))) for k in range(3)])


def intrinsics_of(vector: str) -> dict[str, Column]:
    """width, height, cx, cy, fx, fy and the eight distortion coefficients of a vector in this order."""
    return {n: F.get(F.col(vector), F.lit(k)) for k, n in enumerate(("width", "height", "cx", "cy", "fx", "fy"))} | {"dist": F.slice(vector, 7, 8)}


def rescaled(width: Column, height: Column) -> dict[str, Column]:
    """fx, fy, cx, cy of a camera (width, height) at another resolution."""
    sx, sy = width / F.col("width"), height / F.col("height")
    return {"fx": F.col("fx") * sx, "fy": F.col("fy") * sy, "cx": F.col("cx") * sx, "cy": F.col("cy") * sy, "width": width, "height": height}


def project(x, y, z) -> tuple[Column, Column]:
    """Pixels of a world point in a camera (p00 to p23); null at depth zero."""
    x, y, z = map(_c, (x, y, z))
    u, v, depth = (F.col(a) * x + F.col(b) * y + F.col(c) * z + F.col(d) for a, b, c, d in PROJECTION)
    return F.try_divide(u, depth), F.try_divide(v, depth)


def projection_rows() -> list[list[Column]]:
    return [[F.col(c) for c in row] for row in PROJECTION]


def gram_terms(u, v, weight=None) -> list[Column]:
    """The ten different entries of AtA of a view's two rows u P3 - P1 and v P3 - P2, times weight squared."""
    p = projection_rows()
    a = [_c(u) * p[2][k] - p[0][k] for k in range(4)]
    b = [_c(v) * p[2][k] - p[1][k] for k in range(4)]
    w = F.lit(1.0) if weight is None else _c(weight) * _c(weight)
    return [w * (a[i] * a[j] + b[i] * b[j]) for i in range(4) for j in range(i, 4)]


def _null_points(entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(x, y, z) of each row of Gram entries, and where w vanishes."""
    full = np.empty((len(entries), 4, 4))
    at = 0
    for i in range(4):
        for j in range(i, 4):
            full[:, i, j] = full[:, j, i] = entries[:, at]
            at += 1
    vec = np.linalg.eigh(full)[1][:, :, 0]
    flat = np.abs(vec[:, 3]) < 1e-12
    return vec[:, :3] / np.where(flat, 1.0, vec[:, 3])[:, None], flat


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def smallest_eigvec4(g: pd.Series) -> pd.Series:
    """Homogeneous solution of summed Gram entries, as (x, y, z); null where w vanishes. Works on aggregated rows only."""
    xyz, flat = _null_points(np.array(g.tolist(), np.float64).reshape(-1, 10))
    return pd.Series([None if f else p.tolist() for f, p in zip(flat, xyz, strict=True)])


@F.pandas_udf(T.StructType([T.StructField(c, T.DoubleType()) for c in "xyz"]))
def null_point(*g: pd.Series) -> pd.DataFrame:
    """smallest_eigvec4() of entries that are columns, without a list a row; nulls also where an entry is null."""
    entries = np.column_stack([x.to_numpy(np.float64) for x in g])
    whole = np.flatnonzero(~np.isnan(entries).any(axis=1))
    out = np.full((len(entries), 3), np.nan)
    xyz, flat = _null_points(entries[whole])
    out[whole[~flat]] = xyz[~flat]
    return pd.DataFrame(out, columns=[*"xyz"])


#: Else a filter on its result is moved before it with a second call.
smallest_eigvec4, null_point = smallest_eigvec4.asNondeterministic(), null_point.asNondeterministic()


def quaternion(r: str) -> Column:
    """(w, x, y, z) of a row-major rotation array, w >= 0."""
    m = [F.get(F.col(r), F.lit(k)) for k in range(9)]
    trace = m[0] + m[4] + m[8]
    half = lambda x: F.sqrt(F.greatest(F.lit(0.0), x)) / 2
    w = half(1 + trace)
    sign = lambda value, by: F.when(by < 0, -value).otherwise(value)
    return F.array(w, sign(half(1 + m[0] - m[4] - m[8]), m[7] - m[5]), sign(half(1 - m[0] + m[4] - m[8]), m[2] - m[6]), sign(half(1 - m[0] - m[4] + m[8]), m[3] - m[1]))


def angle_degrees(a: str, b: str) -> Column:
    """Geodesic angle between two rotation arrays."""
    trace = sum((F.get(F.col(a), F.lit(k)) * F.get(F.col(b), F.lit(k)) for k in range(1, 9)), F.get(F.col(a), F.lit(0)) * F.get(F.col(b), F.lit(0)))
    return F.degrees(F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), (trace - 1) / 2))))


def undistort_step(x: Column, y: Column, x0: Column, y0: Column, k: tuple) -> tuple[Column, Column, Column]:
    """One fixed-point step of the eight-coefficient rational model (k1 k2 p1 p2 k3 k4 k5 k6, numbers or columns) turned round: the next x and y, and whether the model's
    factor is negative, where the point stays as it is."""
    k1, k2, p1, p2, k3, k4, k5, k6 = k
    r = x * x + y * y
    scale = (1 + ((k6 * r + k5) * r + k4) * r) / (1 + ((k3 * r + k2) * r + k1) * r)
    dx, dy = 2 * p1 * x * y + p2 * (r + 2 * x * x), p1 * (r + 2 * y * y) + 2 * p2 * x * y
    return (x0 - dx) * scale, (y0 - dy) * scale, F.coalesce(scale < 0, F.lit(False))


def undistort(u, v, k: tuple, steps: int = 5) -> tuple[Column, Column]:
    """Pixels without lens distortion, by so many steps. Columns fx, fy, cx, cy. For whole tables undistort_points has a projection for each step instead."""
    x0, y0 = (_c(u) - F.col("cx")) / F.col("fx"), (_c(v) - F.col("cy")) / F.col("fy")
    # One step as SQL over a struct keeps the expression small: it grows with steps, not with its powers.
    start = F.struct(x0.alias("x"), y0.alias("y"), x0.alias("x0"), y0.alias("y0"), F.lit(False).alias("stop"))

    def step(s: Column, _) -> Column:
        x, y, stop = undistort_step(s["x"], s["y"], s["x0"], s["y0"], k)
        stop = s["stop"] | stop
        return F.struct(F.when(stop, s["x0"]).otherwise(x).alias("x"), F.when(stop, s["y0"]).otherwise(y).alias("y"), s["x0"].alias("x0"), s["y0"].alias("y0"), stop.alias("stop"))

    done = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step)
    return done["x"] * F.col("fx") + F.col("cx"), done["y"] * F.col("fy") + F.col("cy")


def box_iou(a: list[str], b: list[str]) -> Column:
    """Intersection over union of boxes x0, y0, x1, y1; 0 where they have no area."""
    ax0, ay0, ax1, ay1, bx0, by0, bx1, by1 = map(F.col, [*a, *b])
    zero = F.lit(0.0)
    inter = F.greatest(zero, F.least(ax1, bx1) - F.greatest(ax0, bx0)) * F.greatest(zero, F.least(ay1, by1) - F.greatest(ay0, by0))
    return F.coalesce(F.try_divide(inter, (ax1 - ax0) * (ay1 - ay0) + (bx1 - bx0) * (by1 - by0) - inter), zero)
