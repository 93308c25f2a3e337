"""Ordered series whose decisions feed back (steady camera sets, anchors), and doubling of the frame rate."""

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, StringType, StructField, StructType
from pyspark.sql.window import Window

from mvspark.functions.geometry import PROJECTION
from mvspark.functions.series import dealt
from mvspark.operators.triangulate import SIDE, robust_cameras, views  # noqa: F401  robust_cameras for steady_cameras' callers
from mvspark.plans.fixtures import POINTS_SQL, calibration, keypoints, true_points

#: What a view holds in its wrist's row.
VIEW = ["ord", "cam_id", "u", "v", *[c for row in PROJECTION for c in row]]


def _places(frames: DataFrame) -> DataFrame:
    """(session, frame, place): the listed frames of each session, numbered."""
    return frames.select("session", "frame").distinct().withColumn("place", F.dense_rank().over(Window.partitionBy("session").orderBy("frame")).cast("int"))


class Views(NamedTuple):
    """Wrists' views: a row a frame's wrist, a place for each of its cameras (there: whether it is taken), in their order."""

    there: np.ndarray
    ord: np.ndarray
    cam: np.ndarray
    uv: np.ndarray
    p: np.ndarray
    gram: np.ndarray


def views_of(lists: pa.ListArray, names: pa.Array) -> Views:
    """The views (lists of structs of VIEW), cameras as places in ``names``. A view without pixels counts as one, but has no Gram entries."""
    sizes, flat = pc.list_value_length(lists).to_numpy(zero_copy_only=False), lists.flatten()
    row = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    of = lambda *names: np.stack([flat.field(n).to_numpy(zero_copy_only=False).astype(float) for n in names], axis=-1)

    def spread(values: np.ndarray) -> np.ndarray:
        out = np.zeros((len(sizes), int(sizes.max(initial=0)), *values.shape[1:]), values.dtype)
        out[row, place] = values
        return out

    uv, p = of("u", "v"), of(*[c for r in PROJECTION for c in r]).reshape(-1, 3, 4)
    a = uv[:, :, None] * p[:, 2:] - p[:, :2]  # the two rows of each view
    gram = np.einsum("nik,nil->nkl", a, a)
    gram[~np.isfinite(gram).all(axis=(1, 2))] = 0.0
    return Views(*map(spread, (np.ones(len(row), bool), of("ord")[:, 0], pc.index_in(flat.field("cam_id"), names).to_numpy(zero_copy_only=False).astype(int), uv, p, gram)))


def pixel_errors(v: Views, rows: np.ndarray, gram: np.ndarray) -> np.ndarray:
    """Pixel distances of all views of some rows from the points of summed Gram entries (one a row); infinite where there is no view, no pixel or no point."""
    h = np.linalg.eigh(gram)[1][:, :, 0]
    with np.errstate(divide="ignore", invalid="ignore"):
        h = h / np.where(np.abs(h[:, 3:]) < 1e-12, np.nan, h[:, 3:])
        at = np.einsum("nsik,nk->nsi", v.p[rows], h)
        off = np.hypot(at[..., 0] / at[..., 2] - v.uv[rows, :, 0], at[..., 1] / at[..., 2] - v.uv[rows, :, 1])
    return np.where(v.there[rows] & np.isfinite(off), off, np.inf)


def inliers(errors: np.ndarray, max_px: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which views lie within max_px, how many they are, and their mean error."""
    near = errors < max_px
    n = near.sum(axis=1)
    return near, n, np.where(near, errors, 0.0).sum(axis=1) / np.maximum(n, 1)


def best_sets(v: Views, max_px: float) -> tuple[np.ndarray, np.ndarray]:
    """robust_cameras() of rows: which views are in the best set (none: no set), and its mean error."""
    chosen, size, error = np.zeros(v.there.shape, bool), np.ones(len(v.there), int), np.full(len(v.there), np.inf)
    for i in range(v.there.shape[1]):
        for j in range(i + 1, v.there.shape[1]):  # in the order of pairs: of equal ones the first stays
            rows = np.flatnonzero(v.there[:, i] & v.there[:, j] & (v.ord[:, i] < v.ord[:, j]))
            near, n, mean = inliers(pixel_errors(v, rows, v.gram[rows, i] + v.gram[rows, j]), max_px)
            better = (n > size[rows]) | ((n > 1) & (n == size[rows]) & (np.round(mean, 9) < np.round(error[rows], 9)))
            chosen[rows[better]], size[rows[better]], error[rows[better]] = near[better], n[better], mean[better]
    return chosen, error


def steady_scan(v: Views, best: np.ndarray, error: np.ndarray, before: np.ndarray, first: np.ndarray, max_px: float, margin: int, factor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Camera sets, mean errors and held flags of wrists: how often each camera (a column) is in the set, as in ``best`` (none: no set). before: the row of each wrist's
    frame before, or -1, where it follows on the cameras ``first``. The set before stays while its own point has no fewer inliers (less the margin) and at most factor
    times the error; a frame without a solution forgets it.

    All rows are tried at once on the best set of the row before; those after a row whose set came out otherwise are tried again, until none did."""
    sets, errors, held = best.copy(), error.copy(), np.zeros(len(best), bool)
    after = np.full(len(best), -1)
    after[before[before >= 0]] = np.flatnonzero(before >= 0)
    solved = best.any(axis=1)
    rows = np.flatnonzero(solved & ((before >= 0) | first.any(axis=1)))
    while len(rows):
        known = np.where((before[rows] >= 0)[:, None], sets[before[rows]] > 0, first[rows])
        used = np.take_along_axis(known, v.cam[rows], axis=1) & v.there[rows]
        kept, keep, mean = np.zeros((len(rows), best.shape[1]), best.dtype), used.sum(axis=1) >= 2, np.zeros(len(rows))
        some = rows[keep]
        near, n, mean[keep] = inliers(pixel_errors(v, some, (v.gram[some] * used[keep, :, None, None]).sum(axis=1)), max_px)
        np.add.at(kept, (np.flatnonzero(keep)[:, None], v.cam[some]), near)
        keep[keep] = (n >= np.maximum(2, best[some].sum(axis=1) - margin)) & (mean[keep] <= error[some] * factor)
        now = np.where(keep[:, None], kept, best[rows])
        moved = ((now > 0) != (sets[rows] > 0)).any(axis=1)
        sets[rows], errors[rows], held[rows] = now, np.where(keep, mean, error[rows]), keep & (kept != best[rows]).any(axis=1)
        rows = after[rows[moved]]
        rows = rows[rows >= 0]
        rows = rows[solved[rows]]
    return sets, errors, held


def _sets(lists: pa.ListArray, names: pa.Array) -> np.ndarray:
    """How often each of ``names`` is in each list (null: none)."""
    out = np.zeros((len(lists), len(names)), np.int16)
    row = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False))
    np.add.at(out, (row, pc.index_in(lists.flatten(), names).to_numpy(zero_copy_only=False).astype(int)), 1)
    return out


def _lists(sets: np.ndarray, names: pa.Array) -> pa.Array:
    """Lists of the names in their order; null where none."""
    row, cam = np.nonzero(sets)
    sizes = sets.sum(axis=1)
    offsets = pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32), mask=np.r_[sizes == 0, False])
    return pa.ListArray.from_arrays(offsets, names.take(pa.array(np.repeat(cam, sets[row, cam]))))


def _named(*arrays: pa.Array) -> pa.Array:
    """The different names, in order."""
    names = pc.unique(pa.concat_arrays([a.cast(pa.string()) for a in arrays])).drop_null()
    return names.take(pc.sort_indices(names))


def steady_cameras(seen: DataFrame, best: DataFrame | None, frames: DataFrame, max_px: float = 15.0, margin: int = 0, factor: float = 1.5, rows: int = 4096) -> DataFrame:
    """(session, part, frame, cameras, n_inliers, mean_err, held): robust camera sets that don't flicker. A wrist's views in a frame are one row, which is shuffled once, by session. best:
    robust_cameras(); None: that of the same views and max_px, worked out where the views lie. A session is a sorted run of rows, of which a task holds so many at once."""
    wrist = seen.filter("lm_id = 0").dropna(subset=[*SIDE, "cam_id"]).select(*SIDE, F.struct(F.col("ord").cast("int").alias("ord"), *VIEW[1:]).alias("view"))
    packed = wrist.groupBy(*SIDE).agg(F.sort_array(F.collect_list("view")).alias("views"))
    sets = StructType([StructField("cameras", ArrayType(StringType())), StructField("mean_err", DoubleType())])

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from (batch.slice(i, rows) for i in range(0, batch.num_rows, rows))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            names = _named(batch.column("views").flatten().field("cam_id"))
            v = views_of(batch.column("views"), names)
            near, error = best_sets(v, max_px)
            chosen = np.zeros((len(near), len(names)), np.int16)
            np.add.at(chosen, (np.arange(len(near))[:, None], v.cam), near)
            yield pa.RecordBatch.from_arrays([*batch.columns, _lists(chosen, names), pa.array(error, mask=~near.any(axis=1))], names=[*batch.schema.names, *sets.names])

    chosen = packed.mapInArrow(choose, StructType([*packed.schema, *sets])) if best is None else packed.join(best.select(*SIDE, *sets.names), SIDE, "left")
    marks = frames.select("session", "frame").dropna().distinct()
    both = chosen.unionByName(marks, allowMissingColumns=True)  # a listed frame's mark has no part, so it comes first
    out = StructType([packed.schema["session"], packed.schema["part"], packed.schema["frame"], sets["cameras"], StructField("n_inliers", IntegerType()), sets["mean_err"], StructField("held", BooleanType())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        session, places, listed, last = None, 0, (None, -1), {}  # of each part its last row's place and cameras
        for batch in slices(batches):
            mark = batch.column("views").is_null().to_numpy(zero_copy_only=False)
            place, frame = places + np.cumsum(mark), batch.column("frame").to_numpy(zero_copy_only=False)
            new = batch.column("session").dictionary_encode()
            code, at = new.indices.to_numpy(zero_copy_only=False), np.flatnonzero(mark)
            own = np.searchsorted(at, np.arange(len(mark)), side="right") - 1  # the mark that each row stands behind
            of, its = (np.r_[x[at], y][own] for x, y in ((frame, listed[1]), (code, code[0] if new.dictionary[0].as_py() == listed[0] else -1)))
            keep = np.flatnonzero(~mark & (of == frame) & (its == code))
            places, listed = int(place[-1]), (new.dictionary[code[at[-1]]].as_py(), frame[at[-1]]) if len(at) else listed
            here = batch.take(pa.array(keep))
            if new.dictionary[-1].as_py() != session:
                start, session = (session, last), new.dictionary[-1].as_py()
                last = {}
            else:
                start = session, last
            if not len(keep):
                continue
            names = _named(here.column("views").flatten().field("cam_id"), here.column("cameras").flatten(), *[pa.array(cams, pa.string()) for _, cams in start[1].values()])
            v, best, place, code = views_of(here.column("views"), names), _sets(here.column("cameras"), names), place[keep], code[keep]
            parts = here.column("part").dictionary_encode()
            part = parts.indices.to_numpy(zero_copy_only=False)
            order = np.lexsort((place, part, code))
            follows = np.r_[False, (part[order][1:] == part[order][:-1]) & (code[order][1:] == code[order][:-1])]
            before, first = np.full(len(keep), -1), np.zeros((len(keep), len(names)), bool)
            on = np.flatnonzero(follows & (np.r_[0, place[order][:-1]] == place[order] - 1))
            before[order[on]] = order[on - 1]
            for row in order[~follows]:
                key = parts.dictionary[part[row]].as_py()
                if here.column("session")[row].as_py() == start[0] and start[1].get(key, (None,))[0] == place[row] - 1:
                    first[row] = _sets(pa.array([start[1][key][1]], pa.list_(pa.string())), names)[0] > 0
            error = here.column("mean_err").to_numpy(zero_copy_only=False)
            found, error, held = steady_scan(v, best, error, before, first, max_px, margin, factor)
            for row in order[np.r_[~follows[1:], True]]:
                if here.column("session")[row].as_py() == session:
                    last[parts.dictionary[part[row]].as_py()] = int(place[row]), names.take(pa.array(np.flatnonzero(found[row]))).to_pylist()
            solved = np.flatnonzero(found.any(axis=1))
            keys = [here.column(c).take(pa.array(solved)) for c in ("session", "part", "frame")]
            done = [_lists(found[solved], names), pa.array(found[solved].sum(axis=1).astype(np.int32)), pa.array(error[solved].astype(float)), pa.array(held[solved])]
            yield pa.RecordBatch.from_arrays([*keys, *done], names=out.names)

    return dealt(both, "session").sortWithinPartitions("session", "frame", F.asc_nulls_first("part")).mapInArrow(scan, out)


def anchor_scan(at: np.ndarray, step_px: float) -> list[bool]:
    """Which positions (time, 2; nan where there is none) become the anchor: those within step_px times the frames since the last one."""
    anchor, since, out = None, 0, []
    for p in at:
        take = not np.isnan(p).any() and (anchor is None or np.linalg.norm(p - anchor) <= step_px * max(since, 1))
        anchor, since = (p, 1) if take else (anchor, since + 1)
        out.append(bool(take))
    return out


def anchors(wrists: DataFrame, frames: DataFrame, width: float, height: float, step_px: float = 200.0) -> DataFrame:
    """(session, cam_id, part, frame, accepted) of each wrist (x, y fractions): one outside the circle around the last accepted counts as missing, and the
    circle grows with every frame without one. A camera's wrist in one session is a group."""
    rows = wrists.select("session", "cam_id", "part", "frame", (F.col("x") * width).alias("u"), (F.col("y") * height).alias("v")).join(_places(frames), ["session", "frame"])

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("place")
        place = rows["place"].to_numpy() - rows["place"].iloc[0]
        at = np.full((place[-1] + 1, 2), np.nan)
        at[place] = rows[["u", "v"]]
        return rows[["session", "cam_id", "part", "frame"]].assign(accepted=np.array(anchor_scan(at, step_px))[place])

    return rows.groupBy("session", "cam_id", "part").applyInPandas(run, "session bigint, cam_id string, part string, frame bigint, accepted boolean")


def half_steps(y: np.ndarray) -> np.ndarray:
    """Values (time, k) and between each two the not-a-knot cubic spline's. At a midpoint it is the mean of its neighbours less a sixteenth of their second
    derivatives; of these the outer ones but one are plain second differences, the inner ones solve a 1-4-1 system."""
    n = len(y)
    out = np.empty((2 * n - 1, y.shape[1]))
    out[::2] = y
    if n == 1:
        return out
    curve = np.zeros_like(y)
    if n == 3:
        curve[:] = y[0] - 2 * y[1] + y[2]
    elif n > 3:
        second = y[:-2] - 2 * y[1:-1] + y[2:]
        share, part = np.zeros(n), second[0]
        parts = np.zeros_like(y)
        curve[1], curve[-2] = second[0], second[-1]
        for i in range(2, n - 2):
            share[i] = 1 / (4 - share[i - 1])
            part = parts[i] = (6 * second[i - 1] - part) * share[i]
        for i in range(n - 3, 1, -1):
            curve[i] = parts[i] - share[i] * curve[i + 1]
        curve[0], curve[-1] = 2 * curve[1] - curve[2], 2 * curve[-2] - curve[-3]
    out[1::2] = (y[:-1] + y[1:]) / 2 - (curve[:-1] + curve[1:]) / 16
    return out


def upsample(points: DataFrame, frames: DataFrame, keys: list[str]) -> DataFrame:
    """Series (keys with session first, frame, x, y, z) at twice the rate: half_place counts half frames. Series are taken as smoothed, without gaps."""
    rows = points.join(_places(frames), [keys[0], "frame"]).select(*keys, "place", "x", "y", "z")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("place")
        done = half_steps(rows[["x", "y", "z"]].to_numpy(float))
        first = 2 * (int(rows["place"].iloc[0]) - 1)
        out = pd.DataFrame({"half_place": first + np.arange(len(done)), "x": done[:, 0], "y": done[:, 1], "z": done[:, 2]})
        return out.assign(**{k: rows[k].iloc[0] for k in keys})[[*keys, "half_place", "x", "y", "z"]]

    ddl = ", ".join(f"`{k}` {points.schema[k].dataType.simpleString()}" for k in keys)
    return rows.groupBy(*keys).applyInPandas(run, ddl + ", half_place int, x double, y double, z double")


def upsample_marks(marks: DataFrame, keys: list[str], last: str) -> DataFrame:
    """Rows (keys, place from 0) at twice the rate, each half frame with its nearest frame's values (a tie: the even one). ``last`` is the last place. Even
    places hand themselves on to both sides, so there is no join."""
    even = F.col("place") % 2 == 0
    own = F.col("place") * 2
    halves = F.when(even, F.array(own - 1, own, own + 1)).otherwise(F.array(own))
    return marks.withColumn("half_place", F.explode(halves)).filter((F.col("half_place") >= 0) & (F.col("half_place") <= F.col(last) * 2)).drop("place", last)


def _steady(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = keypoints(spark, sf_dir, 2.0)
    seen = views(k, calibration(spark), 0.5)
    found = steady_cameras(seen, None, k, 2.0)
    return found.select("part", "frame", F.array_join("cameras", ",").alias("cameras"), "n_inliers", "held")


def _anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = keypoints(spark, sf_dir).filter("lm_id = 0")
    return anchors(k, k, 3360.0, 1890.0)


def _line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cubic of the frame's place: the spline must give it back between the frames."""
    p = true_points(spark, sf_dir).filter("lm_id = 0")
    t = F.dense_rank().over(Window.partitionBy("session", "part").orderBy("frame")) / 100
    return p.withColumn("t", t).withColumns({"x": F.col("t") ** 3, "y": F.col("t") ** 2, "z": F.col("t")}).drop("t")


def _marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = true_points(spark, sf_dir).filter("lm_id = 0 and part = 'left'")
    w = Window.partitionBy("session")
    m = p.select("session", "frame", (F.row_number().over(w.orderBy("frame")) - 1).alias("place"), (F.count(F.lit(1)).over(w) - 1).alias("last"))
    return upsample_marks(m, ["session"], "last").select("session", F.col("half_place").cast("long").alias("half_place"), "frame")


QUERIES = {
    "steady_cameras": _steady,
    "anchors": _anchors,
    "upsample": lambda spark, sf: upsample(s := _line(spark, sf), s, ["session", "part", "lm_id"]).select("session", "part", "half_place", *[F.round(c, 4).alias(c) for c in "xyz"]),
    "upsample_marks": _marks,
}
ORACLE_SQL = {
    "upsample": f"""with {POINTS_SQL}, n as (select session, part, count(*) as n from points where lm_id = 0 group by session, part), h as (select session, part, unnest(range(0, 2 * n - 1)) as h from n)
 select session, part, h as half_place, round(((h / 2.0::double + 1) / 100) ** 3, 4) as x, round(((h / 2.0::double + 1) / 100) ** 2, 4) as y, round((h / 2.0::double + 1) / 100, 4) as z from h""",
    "upsample_marks": f"""with {POINTS_SQL}, m as (select session, frame, row_number() over (partition by session order by frame) - 1 as place from points where lm_id = 0 and part = 'left'),
 h as (select session, unnest(range(0, 2 * count(*) - 1)) as h from m group by session)
 select h.session, h as half_place, frame from h join m on m.session = h.session and m.place = round_even(h / 2.0::double, 0)""",
}
