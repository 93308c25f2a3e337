"""Smoothing of 3D trajectories: a constant-velocity Kalman filter with its backward pass, and Savitzky-Golay."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, StructField, StructType
from pyspark.sql.window import Window

from mvspark.functions import kalman
from mvspark.functions.series import checkpointed, ranked_in_blocks
from mvspark.plans.fixtures import POINTS_SQL, true_points

PROCESS_STD, MEASURE_STD, TWO_VIEW_STD = 0.03, 0.01, 0.015
#: Listed frames of a block, blocks scanned at once, and the width of the ranges in which listed frames are counted.
BLOCK, BATCH, RANK_WIDTH = 512, 64, 100_000
#: The query adds this before it rounds: midpoints of two-decimal points would else be ties.
OFF_TIES = 3.3e-7


def kalman_rts(xyz: np.ndarray, valid: np.ndarray, std: np.ndarray, process_std: float = PROCESS_STD) -> np.ndarray:
    """Smoothed positions (time, 3) of one series, step by step: what ``smooth`` is held against. The axes don't mix and share one 2 x 2 covariance, so the filter is run once for the
    three of them: a row is (position, velocity), a column an axis."""
    move = np.array([[1.0, 1.0], [0.0, 1.0]])
    noise = process_std**2 * np.array([[0.25, 0.5], [0.5, 1.0]])
    state, cov = np.zeros((2, 3)), np.eye(2)
    state[0] = xyz[int(np.argmax(valid))]
    before, after = [], []
    for t in range(len(xyz)):
        if t:
            state, cov = move @ state, move @ cov @ move.T + noise
        before.append((state, cov))
        if valid[t]:
            gain = cov[:, :1] / (cov[0, 0] + std[t] ** 2)
            state = state + gain * (xyz[t] - state[0])
            cov = cov - gain @ cov[:1]
        after.append((state, cov))
    out = [after[-1][0]]
    for t in range(len(xyz) - 2, -1, -1):
        state, cov = after[t]
        back = cov @ move.T @ np.linalg.inv(before[t + 1][1])
        out.append(state + back @ (out[-1] - before[t + 1][0]))
    return np.array([s[0] for s in reversed(out)])


def _packed(points: DataFrame, frames: DataFrame, keys: list[str], two_view_std: float, block: int, together: tuple[str, ...]) -> DataFrame:
    """(keys, block, lo, hi, first, last, frames, at, x, y, z, std): each series' points of each block of so many listed frames, with the places of
    its first and last point and whether the block is its first or last. Blocks without points are rows too. Points and blocks are dealt out once, together."""
    session = keys[0]
    listed = checkpointed(ranked_in_blocks(frames.select(session, "frame").distinct(), [session], "frame", RANK_WIDTH, "step"))
    std = F.when(F.coalesce("n_views", F.lit(0)) == 2, two_view_std).otherwise(MEASURE_STD)
    own = points.filter("x is not null and y is not null and z is not null")
    if session in together:
        at = own.join(listed, [*together])
    else:
        steps = listed.groupBy(*together).agg(F.collect_list(F.struct(F.col(session).alias("__session"), "step")).alias("__steps"))
        at = own.join(steps, [*together]).select(*own.columns, F.inline("__steps")).filter(F.col(session) == F.col("__session"))
    # Lists of numbers beside each other, none of which is null, take half of what a list of structs does.
    obs = {"at": (F.col("step") % block).cast("int"), "x": F.col("x").cast("double"), "y": F.col("y").cast("double"), "z": F.col("z").cast("double"), "std": std}
    spans = at.groupBy(*keys).agg(F.min("step").alias("lo"), F.max("step").alias("hi"))
    names = listed.groupBy(session, F.expr(f"step div {block}").alias("block")).agg(F.array_sort(F.collect_list("frame")).alias("frames"))
    grid = spans.withColumn("block", F.explode(F.expr(f"sequence(lo div {block}, hi div {block})"))).join(names, [session, "block"])
    both = at.select(*keys, F.expr(f"step div {block}").alias("block"), *[v.alias(k) for k, v in obs.items()]).unionByName(grid, allowMissingColumns=True)
    rows = both.groupBy(*keys, "block").agg(*[F.collect_list(c).alias(c) for c in obs], F.max("lo").alias("lo"), F.max("hi").alias("hi"), F.first("frames", ignorenulls=True).alias("frames"))
    # As the joins by these keys have it, so that all who read the blocks share one plan, and what is dealt out.
    rows = rows.filter(" and ".join(f"{k} is not null" for k in [*keys, "block"]))
    ends = {"first": F.col("block") == F.expr(f"lo div {block}"), "last": F.col("block") == F.expr(f"hi div {block}")}
    return rows.select(*keys, "block", "lo", "hi", *[v.alias(k) for k, v in ends.items()], "frames", *obs)


def _observations(batch: pa.RecordBatch, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """y (3, rows, steps), seen and std (rows, steps) of a batch of packed rows."""
    lengths = pc.list_value_length(batch.column("at")).fill_null(0).to_numpy()
    row, at = np.repeat(np.arange(len(lengths)), lengths), batch.column("at").flatten().to_numpy()
    y, seen, std = np.zeros((3, len(lengths), block)), np.zeros((len(lengths), block), bool), np.ones((len(lengths), block))
    seen[row, at], std[row, at] = True, batch.column("std").flatten().to_numpy()
    for k, axis in enumerate("xyz"):
        y[k, row, at] = batch.column(axis).flatten().to_numpy()
    return y, seen, std


def _steps(batch: pa.RecordBatch, block: int, process_std: float) -> tuple[kalman.Element, np.ndarray]:
    """The steps of each block. A series' first point is a step that forgets what was before."""
    y, seen, std = _observations(batch, block)
    x = kalman.elements(y, seen, std, process_std)
    row = np.flatnonzero(batch.column("first").to_numpy(zero_copy_only=False))
    lo = batch.column("lo").to_numpy()[row]
    at = lo % block
    mean, cov = kalman.start(y[:, row, at], std[row, at], lo, process_std)
    for v, value in zip(x, (0.0, mean, cov, 0.0, 0.0), strict=True):
        v[:, :, row, at] = value
    return x, seen


def _lists(values: np.ndarray) -> pa.Array:
    """A list of doubles a row."""
    return pa.FixedSizeListArray.from_arrays(pa.array(values.reshape(len(values), -1).ravel()), values[0].size).cast(pa.list_(pa.float64()))


def _column(batch: pa.RecordBatch, name: str, shape: tuple[int, ...]) -> np.ndarray:
    """Such lists as matrices, rows last; zeros for nulls."""
    size = int(np.prod(shape))
    out = np.zeros((batch.num_rows, size))
    column = batch.column(name)
    out[column.is_valid().to_numpy(zero_copy_only=False)] = column.flatten().to_numpy().reshape(-1, size)
    return np.moveaxis(out.reshape(-1, *shape), 0, -1)


def _chained(rows: DataFrame, keys: list[str], step, names: list[str], forward: bool) -> DataFrame:
    """(keys, block, names): what reaches each block, handed from block to block of a series by ``step`` (null where nothing does). A row is a whole block; series are sorted runs of
    rows, of which a task holds a batch and one state."""
    out = StructType([*[rows.schema[k] for k in [*keys, "block"]], *[StructField(n, ArrayType(DoubleType())) for n in names]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        series, state = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            x, reached = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1), []
            for k, key in enumerate(zip(*[batch.column(c).to_pylist() for c in keys], strict=True)):
                if key != series:
                    series, state = key, None
                reached.append(state or [None] * len(names))
                state = step(state, x[k])
            lists = [pa.array([s[i] for s in reached], pa.list_(pa.float64())) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in [*keys, "block"]], *lists], names=out.names)

    order = [*keys, F.asc("block") if forward else F.desc("block")]
    return rows.repartition(*keys).sortWithinPartitions(*order).mapInArrow(run, out)


def _cut_element(x: np.ndarray) -> kalman.Element:
    return x[:4].reshape(2, 2, 1), x[4:10].reshape(2, 3, 1), x[10:14].reshape(2, 2, 1), x[14:20].reshape(2, 3, 1), x[20:].reshape(2, 2, 1)


def smooth(points: DataFrame, frames: DataFrame, keys: list[str], two_view_std: float = TWO_VIEW_STD, process_std: float = PROCESS_STD, block: int = BLOCK, together: tuple[str, ...] | None = None) -> DataFrame:
    """Each series of points (keys, frame, x, y, z, n_views) over the listed frames (first key, frame), gaps filled, from its first to its last point. The filter starts at the first
    listed frame. Series are cut into blocks of so many frames; tasks scan blocks of many series at once, and what a block amounts to is handed on along its series, forwards
    and then backwards, so that no task holds a series. Composed in another order than step by step, results differ by rounding: 1e-12 in dense series, 3e-9 where five points
    lie over 3,000 frames. together: the keys by which listed frames are brought to the points (the first key and frame); points that lie together by just these, as by frame where a
    frame is of one session, are not shuffled for it.

    Blocks are dealt out once and read three times; what a task reads beside them are their states, a few numbers a block."""
    rows = _packed(points, frames, keys, two_view_std, block, together or (keys[0], "frame"))
    own = [rows.schema[k] for k in [*keys, "block"]]

    def batches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from (batch.slice(i, BATCH) for i in range(0, batch.num_rows, BATCH))

    def summary(batch: pa.RecordBatch, values: list[np.ndarray]) -> pa.RecordBatch:
        flat = np.concatenate([np.moveaxis(v, -1, 0).reshape(batch.num_rows, -1) for v in values], axis=1)
        return pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in own], _lists(flat)], names=[*[f.name for f in own], "x"])

    def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches):
            x, _ = _steps(batch, block, process_std)
            yield summary(batch, [*kalman.total(kalman.combined, x)])

    def filtered(batch: pa.RecordBatch) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
        x, seen = _steps(batch, block, process_std)
        x = kalman.scanned(kalman.combined, x)
        mean, cov = kalman.after(_column(batch, "mean", (2, 3))[..., None], _column(batch, "cov", (2, 2))[..., None], x)
        e, g = kalman.backward(mean, cov, process_std)
        last = batch.column("last").to_numpy(zero_copy_only=False)
        e[:, :, last, -1], g[:, :, last, -1] = 0.0, mean[:, :, last, -1]
        return (e, g), seen

    def backward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches):
            steps, _ = filtered(batch)
            yield summary(batch, [*kalman.total(kalman.behind, tuple(v[..., ::-1] for v in steps))])

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches):
            steps, seen = filtered(batch)
            e, g = kalman.suffixes(*steps)
            done = kalman.mul(e, _column(batch, "next", (2, 3))[..., None])[0] + g[0]
            place = batch.column("block").to_numpy()[:, None] * block + np.arange(block)
            row, at = np.nonzero((place >= batch.column("lo").to_numpy()[:, None]) & (place <= batch.column("hi").to_numpy()[:, None]))
            lists = batch.column("frames")
            frame = lists.flatten().take(pa.array(lists.offsets.to_numpy()[row] - lists.offsets[0].as_py() + at))
            names = [batch.column(k).take(pa.array(row)) for k in keys]
            yield pa.RecordBatch.from_arrays([*names, frame, *[pa.array(done[k, row, at]) for k in range(3)], pa.array(seen[row, at])], names=[*keys, "frame", "x", "y", "z", "observed"])

    def ahead(state, x: np.ndarray):
        mean, cov = (np.asarray(v).reshape(2, -1, 1) for v in state) if state else (np.zeros((2, 3, 1)), np.zeros((2, 2, 1)))
        return [v.ravel() for v in kalman.after(mean, cov, _cut_element(x))]

    def back(state, x: np.ndarray):
        following = np.asarray(state[0]).reshape(2, 3) if state else np.zeros((2, 3))
        return [(x[:4].reshape(2, 2) @ following + x[4:].reshape(2, 3)).ravel()]

    summed = StructType([*own, StructField("x", ArrayType(DoubleType()))])
    reached = _chained(rows.mapInArrow(forward, summed), keys, ahead, ["mean", "cov"], True)
    # The hash tables hold the states, so that blocks are not sorted.
    rows = rows.join(reached.hint("shuffle_hash"), [*keys, "block"])
    following = _chained(rows.mapInArrow(backward, summed), keys, back, ["next"], False)
    out = StructType([*[points.schema[k] for k in [*keys, "frame"]], *[StructField(c, DoubleType()) for c in "xyz"], StructField("observed", BooleanType())])
    return rows.join(following.hint("shuffle_hash"), [*keys, "block"]).mapInArrow(final, out)


#: Weights of the window of seven and order three at its middle.
SAVGOL = (-2, 3, 6, 7, 6, 3, -2)


def savgol_weights(window: int, order: int = 3) -> np.ndarray:
    """Row p holds the weights of a window's values in the polynomial's value at place p."""
    powers = np.vander(np.arange(window) - window // 2, order + 1).astype(float)
    return powers @ np.linalg.pinv(powers)


def savgol(points: DataFrame, keys: list[str], value: str, whole: bool = True) -> DataFrame:
    """Savitzky-Golay (7, 3). The first and last three values are those of the polynomial of the first or last window; series of five or six have a
    window of five, shorter ones stay as they are. Unless ``whole``, all that lacks a window of seven about it stays as it is."""
    w = Window.partitionBy(*keys).orderBy("frame")
    about = {d: F.lag(value, -d).over(w) if d else F.col(value) for d in range(-6 if whole else -3, 7 if whole else 4)}
    rows = points.select("*", *[v.alias(f"__{d + 6}") for d, v in about.items()])
    # One short sum for all rows: null where the window of seven isn't whole.
    middle = sum((float(c) * F.col(f"__{d + 6}") for d, c in zip(range(-2, 4), SAVGOL[1:], strict=True)), float(SAVGOL[0]) * F.col("__3")) / 21.0
    if not whole:
        return rows.withColumn("smooth", F.coalesce(middle, F.col(value))).drop(*[f"__{d + 6}" for d in about])
    rows = points.select("*", *[v.alias(f"__{d + 6}") for d, v in about.items()], (F.row_number().over(w) - 1).alias("__r"), F.count(F.lit(1)).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("__n"))
    # Only ends look up the weights of their place: of 13 rows about them, by the window's size and the place in it.
    size = F.when(F.col("__n") >= 7, 7).otherwise(5)
    place = F.col("__r") - F.greatest(F.lit(0), F.least(F.col("__r") - F.floor(size / 2), F.col("__n") - size))
    table = [[float(row[k + d]) if 0 <= k + d < len(row) else None for d in range(-6, 7)] for weights in (savgol_weights(7), savgol_weights(5)) for k, row in enumerate(weights)]
    weights = F.get(F.array(*[F.array(*[F.lit(x).cast("double") for x in row]) for row in table]), (place + F.when(size == 7, 0).otherwise(7)).cast("int"))
    terms = F.zip_with(weights, F.array(*[F.col(f"__{d + 6}") for d in about]), lambda weight, x: F.when(weight.isNull(), 0.0).otherwise(weight * x))
    end = F.when(F.col("__n") >= 5, F.aggregate(terms, F.lit(0.0), lambda acc, x: acc + x))
    inside = (F.col("__r") >= 3) & (F.col("__r") < F.col("__n") - 3)
    return rows.withColumn("smooth", F.coalesce(F.when(inside, middle).otherwise(end), F.col(value))).drop("__n", "__r", *[f"__{d + 6}" for d in about])


def _series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return true_points(spark, sf_dir).withColumns({"n_views": F.when(F.col("frame") % 3 == 0, 2).otherwise(4)})


def _kalman(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _series(spark, sf_dir)
    seen = s.withColumns({c: F.when(F.col("frame") % 7 != 0, F.col(c)) for c in "xyz"}).dropna(subset=["x"])  # a gap in each seventh frame
    out = smooth(seen, s, ["session", "part", "lm_id"], together=("frame",))
    return out.select("session", "part", "lm_id", "frame", "observed", *[(F.rint((F.col(c) + OFF_TIES) * 1e3) / 1e3 + 0.0).alias(c) for c in "xyz"])  # without round()'s decimal numbers


QUERIES = {
    "kalman_rts": _kalman,
    # Its SQL leaves the ends of a series as they are; savgol_whole does them too.
    "savgol": lambda spark, sf: savgol(_series(spark, sf), ["session", "part", "lm_id"], "x", whole=False).select("session", "part", "lm_id", "frame", F.round("smooth", 6).alias("smooth")),
    "savgol_whole": lambda spark, sf: savgol(_series(spark, sf), ["session", "part", "lm_id"], "x").select("session", "part", "lm_id", "frame", F.round("smooth", 6).alias("smooth")),
}
_TAPS = " + ".join(f"{c} * lag(x, {-k}) over w" if k < 0 else f"{c} * lead(x, {k}) over w" if k else f"{c} * x" for k, c in zip(range(-3, 4), SAVGOL, strict=True))
#: The filter step by step from a session's first frame on, and back from a series' last point.
_KALMAN = f"""with recursive {POINTS_SQL},
fr as (select session, frame, cast(row_number() over (partition by session order by frame) - 1 as integer) as n from (select distinct session, frame from points)),
ob as (select session, part, lm_id, n, x, y, z, pow(case when frame % 3 = 0 then {TWO_VIEW_STD} else {MEASURE_STD} end, 2) as r from points join fr using (session, frame) where frame % 7 <> 0),
sp as (select row_number() over () as sid, * from (select session, part, lm_id, min(n) as lo, max(n) as hi, arg_min(x, n) as x0, arg_min(y, n) as y0, arg_min(z, n) as z0 from ob group by session, part, lm_id)),
de as materialized (select sid, fr.n, frame, x0, y0, z0, x, y, z, r, lo, hi from sp join fr on fr.session = sp.session and fr.n <= hi left join ob on ob.session = sp.session and ob.part = sp.part and ob.lm_id = sp.lm_id and ob.n = fr.n),
f as (select sid, n, x0 as px, 0.0::double as vx, y0 as py, 0.0::double as vy, z0 as pz, 0.0::double as vz, case when r is null then 1.0 else 1.0 - 1.0 / (1.0 + r) end::double as p00, 0.0::double as p01, 1.0::double as p11,
   1.0::double as a00, 0.0::double as a01, 1.0::double as a11 from de where n = 0
 union all select sid, n, px + vx + g0 * (x - px - vx), vx + g1 * (x - px - vx), py + vy + g0 * (y - py - vy), vy + g1 * (y - py - vy), pz + vz + g0 * (z - pz - vz), vz + g1 * (z - pz - vz), a00 - g0 * a00, a01 - g0 * a01, a11 - g1 * a01, a00, a01, a11
  from (select *, coalesce(a00 / (a00 + r), 0) as g0, coalesce(a01 / (a00 + r), 0) as g1 from (
   select de.sid, de.n, px, vx, py, vy, pz, vz, coalesce(x, px + vx) as x, coalesce(y, py + vy) as y, coalesce(z, pz + vz) as z, r, p00 + 2 * p01 + p11 + {PROCESS_STD**2 / 4} as a00, p01 + p11 + {PROCESS_STD**2 / 2} as a01, p11 + {PROCESS_STD**2} as a11
   from f join de on de.sid = f.sid and de.n = f.n + 1))),
k as materialized (select f.sid, f.n, px, vx, py, vy, pz, vz, ((p00 + p01) * b11 - p01 * b01) / d as c00, (p01 * b00 - (p00 + p01) * b01) / d as c01, ((p01 + p11) * b11 - p11 * b01) / d as c10, (p11 * b00 - (p01 + p11) * b01) / d as c11
  from (select *, lead(a00) over w as b00, lead(a01) over w as b01, lead(a11) over w as b11, lead(a00) over w * lead(a11) over w - pow(lead(a01) over w, 2) as d from f window w as (partition by sid order by n)) f),
s as (select k.sid, k.n, px as x, vx, py as y, vy, pz as z, vz from k join sp on sp.sid = k.sid and sp.hi = k.n
 union all select k.sid, k.n, px + c00 * (s.x - px - k.vx) + c01 * (s.vx - k.vx), k.vx + c10 * (s.x - px - k.vx) + c11 * (s.vx - k.vx), py + c00 * (s.y - py - k.vy) + c01 * (s.vy - k.vy), k.vy + c10 * (s.y - py - k.vy) + c11 * (s.vy - k.vy),
   pz + c00 * (s.z - pz - k.vz) + c01 * (s.vz - k.vz), k.vz + c10 * (s.z - pz - k.vz) + c11 * (s.vz - k.vz) from s join k on k.sid = s.sid and k.n = s.n - 1)
select session, part, lm_id, frame, r is not null as observed, round(s.x + {OFF_TIES}, 3) as x, round(s.y + {OFF_TIES}, 3) as y, round(s.z + {OFF_TIES}, 3) as z from s join de on de.sid = s.sid and de.n = s.n join sp on sp.sid = s.sid where s.n >= sp.lo"""
ORACLE_SQL = {
    "kalman_rts": _KALMAN,
    "savgol": f"with {POINTS_SQL}, s as (select * from points) select session, part, lm_id, frame, round(coalesce(({_TAPS}) / 21.0::double, x), 6) as smooth from s window w as (partition by session, part, lm_id order by frame)",
}
