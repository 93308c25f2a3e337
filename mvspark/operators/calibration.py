"""Calibration data: coverage, averages of relative poses."""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mvspark.functions.geometry import quaternion
from mvspark.plans.fixtures import FRAME_LOG_SQL, frame_log, table

GRID_ROWS, GRID_COLS = 4, 6
MIN_CORNERS, MIN_SHARPNESS, MIN_CELLS, MOST_SAMPLES = 8, 30.0, 4, 150
NEAR_M, NEAR_DEG = 0.05, 8.0
MIN_OBSERVATIONS, REFINE_DEG = 5, 1.0


def coverage(corners: DataFrame, width: float, height: float) -> DataFrame:
    """(cam_id, cells, coverage): distinct grid cells that corners (cam_id, x, y) touch."""
    cell = lambda c, size, n: F.least(F.greatest(F.floor(F.col(c) / size * n), F.lit(0)), F.lit(n - 1))
    cells = corners.select("cam_id", cell("x", width, GRID_COLS).alias("col"), cell("y", height, GRID_ROWS).alias("row"))
    return cells.groupBy("cam_id").agg(F.countDistinct("col", "row").alias("cells")).withColumn("coverage", F.round(F.col("cells") / (GRID_ROWS * GRID_COLS), 6))


def converged(status: DataFrame, max_error: float = 0.6, min_coverage: float = 0.8) -> DataFrame:
    """Status rows (rig_id, cam_id, error, coverage) with ``converged``, and ``all_converged`` of the rig."""
    from pyspark.sql.window import Window

    one = status.withColumn("converged", F.coalesce((F.col("error") <= max_error) & (F.col("coverage") >= min_coverage), F.lit(False)))
    return one.withColumn("all_converged", F.bool_and("converged").over(Window.partitionBy("rig_id")))


def stop_signal(status: DataFrame) -> DataFrame:
    """(rig_id, done): whether all cameras of a rig have converged; works on a stream's status too (update mode)."""
    return status.groupBy("rig_id").agg(F.bool_and(F.coalesce("converged", F.lit(False))).alias("done"))


def recalibration_due(count: str, least: int, every: int):
    """Whether a camera's newest accepted sample (its count so far) is one after which it is calibrated: the first with ``least`` and ``every`` samples, and each ``every`` after."""
    first = max(least, every)
    return (F.col(count) >= first) & ((F.col(count) - first) % every == 0)


def world_alignment(detections: DataFrame, poses: DataFrame, now: float, max_age_s: float = 2.0) -> DataFrame:
    """(rig_id, cam_id, align): turn of the world onto a flat board, up being the board's true upward side, by the first posed camera (ord) that saw the board in the last seconds. detections: rig_id,
    cam_id, ord, ts_s, r of the board to the camera; poses: rig_id, cam_id, r of the world to the camera. A rig without such a camera gives no row: the request stays open."""
    fresh = detections.filter(F.lit(now) - F.col("ts_s") <= max_age_s).join(poses.select("rig_id", "cam_id", F.col("r").alias("pose")), ["rig_id", "cam_id"])
    first = fresh.groupBy("rig_id").agg(F.min_by(F.struct("cam_id", "r", "pose"), F.struct("ord", -F.col("ts_s"))).alias("s")).select("rig_id", "s.*")
    at = lambda m, i, j: F.get(F.col(m), F.lit(3 * i + j))
    # The board's turn in the world is pose transposed times r; its second and third axes are turned over.
    cell = lambda i, j: sum((at("pose", k, i) * at("r", k, j) for k in (1, 2)), at("pose", 0, i) * at("r", 0, j)) * (1 if j == 0 else -1)
    return first.select("rig_id", "cam_id", F.array(*[cell(i, j) for i in range(3) for j in range(3)]).alias("align"))


def aligned_poses(poses: DataFrame, alignment: DataFrame) -> DataFrame:
    """Poses (rig_id, cam_id, r, t) in their rig's aligned world; a rig without an alignment keeps its own. Turning the world leaves t as it is."""
    both = poses.join(alignment.select("rig_id", "align"), "rig_id", "left")
    return both.withColumn("r", F.when(F.col("align").isNotNull(), multiply("r", "align")).otherwise(F.col("r"))).drop("align")


def frozen(calibrations: DataFrame, started_s: float) -> DataFrame:
    """Of each rig's calibrations (rig_id, made_s, one row a camera) the newest that was made by the start: what a recording keeps to, whatever is calibrated later."""
    made = calibrations.filter(F.col("made_s") <= started_s)
    return made.join(made.groupBy("rig_id").agg(F.max("made_s").alias("made_s")), ["rig_id", "made_s"], "left_semi")


def novel(accepted: list[tuple[np.ndarray, np.ndarray]], r: np.ndarray, t: np.ndarray) -> bool:
    """Whether no accepted pose is near both in place and in turn."""
    for r0, t0 in accepted:
        turn = np.degrees(np.arccos(np.clip((np.sum(r0 * r) - 1) / 2, -1, 1)))
        if np.linalg.norm(t - t0) < NEAR_M and turn < NEAR_DEG:
            return False
    return True


def gate_scan(rows: pd.DataFrame, accepted: list | None = None) -> list[bool]:
    """Which of a camera's candidates, in time order, are accepted: what is accepted feeds back, so this is a scan. For one camera's rows in memory."""
    accepted = [] if accepted is None else accepted
    out = []
    for r, t in zip(rows["r"], rows["t"], strict=True):
        r, t = np.asarray(r, float).reshape(3, 3), np.asarray(t, float)
        take = len(accepted) < MOST_SAMPLES and novel(accepted, r, t)
        if take:
            accepted.append((r, t))
        out.append(take)
    return out


def multiply(a: str, b: str, b_transposed: bool = False):
    """Product of two row-major 3 x 3 arrays."""
    at = lambda m, i, j: F.get(F.col(m), F.lit(3 * i + j))
    cell = lambda i, j: sum((at(a, i, k) * (at(b, j, k) if b_transposed else at(b, k, j)) for k in (1, 2)), at(a, i, 0) * (at(b, j, 0) if b_transposed else at(b, 0, j)))
    return F.array(*[cell(i, j) for i in range(3) for j in range(3)])


def apply_rotation(r: str, t: str):
    return F.array(*[sum((F.get(F.col(r), F.lit(3 * i + k)) * F.get(F.col(t), F.lit(k)) for k in (1, 2)), F.get(F.col(r), F.lit(3 * i)) * F.get(F.col(t), F.lit(0))) for i in range(3)])


def simultaneous_pairs(poses: DataFrame, tolerance_s: float) -> DataFrame:
    """Pairs of different cameras' poses (rig_id, cam_id, ts_s, seq, r, t, err) within the tolerance, each once. Times are dealt to buckets of the tolerance, and one side asks
    in the neighbouring ones: an equi-join, no range join."""
    bucket = F.floor(F.col("ts_s") / tolerance_s)
    a = poses.select("rig_id", *[F.col(c).alias(f"{c}_a") for c in ("cam_id", "ts_s", "seq", "r", "t", "err")], bucket.alias("bucket"))
    b = poses.select("rig_id", *[F.col(c).alias(f"{c}_b") for c in ("cam_id", "ts_s", "seq", "r", "t", "err")], F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("bucket"))
    return a.join(b, ["rig_id", "bucket"]).filter((F.col("cam_id_a") < F.col("cam_id_b")) & (F.abs(F.col("ts_s_a") - F.col("ts_s_b")) <= tolerance_s)).drop("bucket")


def edge_observations(pairs: DataFrame) -> DataFrame:
    """Relative transforms from camera a to b (T_b times the inverse of T_a), with the mean of the two errors."""
    rel = pairs.withColumn("r", multiply("r_b", "r_a", b_transposed=True))
    rel = rel.withColumn("ra", apply_rotation("r", "t_a"))
    t = F.array(*[F.get("t_b", F.lit(k)) - F.get("ra", F.lit(k)) for k in range(3)])
    return rel.select("rig_id", F.col("cam_id_a").alias("cam_a"), F.col("cam_id_b").alias("cam_b"), "r", t.alias("t"), ((F.col("err_a") + F.col("err_b")) / 2).alias("err"))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def mean_rotation(q: pd.Series) -> pd.Series:
    """Rotation (row-major) of summed outer products of quaternions: their dominant eigenvector. Works on aggregated rows only."""
    entries = np.array(q.tolist(), np.float64).reshape(-1, 10)
    full, at = np.empty((len(entries), 4, 4)), 0
    for i in range(4):
        for j in range(i, 4):
            full[:, i, j] = full[:, j, i] = entries[:, at]
            at += 1
    w, x, y, z = np.linalg.eigh(full)[1][:, :, -1].T
    rows = [1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y), 2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x), 2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)]
    return pd.Series(np.stack(rows, axis=1).tolist())


def edges(observations: DataFrame, least: int = MIN_OBSERVATIONS, weight: str | None = None) -> DataFrame:
    """Mean transform of each camera pair with enough observations. Outer products of quaternions have no sign and add up before the shuffle."""
    w = F.lit(1.0) if weight is None else F.col(weight)
    rows = observations.withColumns({"q": quaternion("r"), "w": w.cast("double")})
    outer = [(F.col("w") * F.get("q", F.lit(i)) * F.get("q", F.lit(j))) for i in range(4) for j in range(i, 4)]
    rows = rows.select("rig_id", "cam_a", "cam_b", "err", "w", *[x.alias(f"q{k}") for k, x in enumerate(outer)], *[(F.col("w") * F.get("t", F.lit(k))).alias(f"t{k}") for k in range(3)])
    sums = rows.groupBy("rig_id", "cam_a", "cam_b").agg(F.count(F.lit(1)).alias("n"), F.avg("err").alias("err"), F.sum("w").alias("w"), *[F.sum(c).alias(c) for c in [f"q{k}" for k in range(10)] + ["t0", "t1", "t2"]])
    sums = sums.filter(F.col("n") >= least)
    return sums.select("rig_id", "cam_a", "cam_b", mean_rotation(F.array(*[f"q{k}" for k in range(10)])).alias("r"), F.array(*[F.col(f"t{k}") / F.col("w") for k in range(3)]).alias("t"), "err", "n")


#: Turns about z by four cameras as (cos, sin), and their places.
TURNS = ((1.0, 0.0), (0.8, 0.6), (0.6, 0.8), (12 / 13, 5 / 13))


def board_poses(spark: SparkSession, sf_dir: str, moved: bool = True) -> DataFrame:
    """Poses of one board as four cameras see it, from orders: a turn about x by the order's key, moved into each camera (or left in the rig's coordinates). A quarter of the cameras miss each board."""
    c, s = (F.element_at(F.array(*[F.lit(t[k]) for t in TURNS]), (F.col("o_orderkey") % 4 + 1).cast("int")) for k in (0, 1))
    z, o = F.lit(0.0), F.lit(1.0)
    board = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("seq"), F.array(o, z, z, z, c, -s, z, s, c).alias("rb"), F.array(F.col("o_totalprice").cast("double") / 1e5, z, o).alias("tb"))
    cams = spark.createDataFrame([(f"cam{k}", k, [a, -b, 0.0, b, a, 0.0, 0.0, 0.0, 1.0], [0.5 * k, 0.25 * k, 0.0]) for k, (a, b) in enumerate(TURNS)], "cam_id string, k int, rc array<double>, tc array<double>")
    seen = board.join(F.broadcast(cams), F.lit(True)).filter(F.col("seq") % 5 != F.col("k"))  # four cameras
    seen = seen.withColumns({"r": multiply("rc", "rb"), "m": apply_rotation("rc", "tb")} if moved else {"r": F.col("rb")})
    place = F.array(*[F.get("m", F.lit(i)) + F.get("tc", F.lit(i)) for i in range(3)]) if moved else F.col("tb")
    return seen.select(F.lit("rig").alias("rig_id"), "cam_id", "k", F.col("seq").cast("double").alias("ts_s"), "seq", "r", place.alias("t"), (0.1 + F.col("seq") % 7 / 100).alias("err"))


def board_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges(edge_observations(simultaneous_pairs(board_poses(spark, sf_dir), 0.5)))


def _corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame_log(spark, sf_dir).select("cam_id", (F.col("seq") * 37 % 1920).cast("double").alias("x"), (F.col("seq") * 53 % 1080).cast("double").alias("y"))


def _aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rig for each customer: a board seen by two cameras, turned about z in the first and about x in the second; of every third rig the first's view is stale."""
    key = F.col("c_custkey")
    z, o, turn = F.lit(0.0), F.lit(1.0), lambda k: F.element_at(F.array(*[F.lit(t[k]) for t in TURNS]), (key % 4 + 1).cast("int"))
    c, s = turn(0), turn(1)
    views = [F.struct(F.lit("cam0").alias("cam_id"), F.lit(0).alias("ord"), F.when(key % 3 == 0, 5.0).otherwise(9.0).alias("ts_s"), F.array(c, -s, z, s, c, z, z, z, o).alias("r")), F.struct(F.lit("cam1").alias("cam_id"), F.lit(1).alias("ord"), F.lit(8.5).alias("ts_s"), F.array(o, z, z, z, c, -s, z, s, c).alias("r"))]
    seen = table(spark, sf_dir, "customer").select(key.alias("rig_id"), F.inline(F.array(*views)))
    poses = seen.select("rig_id", "cam_id", F.array(z, -o, z, o, z, z, z, z, o).alias("r"), F.array(o, z, z).alias("t"))
    out = aligned_poses(poses, world_alignment(seen, poses, 10.0))
    return out.filter("cam_id = 'cam0'").select("rig_id", *[(F.round(F.get("r", F.lit(k)), 6) + 0.0).alias(f"r{k}") for k in (0, 1, 3, 4, 5, 8)])


def _due(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = frame_log(spark, sf_dir).withColumn("n", F.col("idx") + 1)
    return log.select("cam_id", "n", recalibration_due("n", 12, 5).alias("due"))


def _done(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("rig_id"), F.col("s_suppkey").alias("cam_id"), ((F.col("s_suppkey") % 11) / 10).alias("error"), F.lit(0.9).alias("coverage"))
    return stop_signal(converged(s, 0.9))


def _frozen(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("rig_id"), (F.col("o_orderkey") % 90).cast("double").alias("made_s"), F.col("o_orderkey").alias("cam_id"))
    return frozen(o, 60.0)


#: The boards that each camera sees, as SQL.
BOARDS_SQL = "with o as (select o_orderkey as seq, k from orders, (values (0), (1), (2), (3)) as c(k) where o_orderkey % 5 <> k) "
QUERIES = {
    "coverage": lambda spark, sf: coverage(_corners(spark, sf), 1920.0, 1080.0),
    "simultaneous_pairs": lambda spark, sf: simultaneous_pairs(board_poses(spark, sf), 0.5).groupBy("cam_id_a", "cam_id_b").agg(F.count(F.lit(1)).alias("pairs")),
    "edge_mean": lambda spark, sf: board_edges(spark, sf).select("cam_a", "cam_b", "n", F.round("err", 6).alias("err"), *[(F.round(F.get("r", F.lit(k)), 4) + 0.0).alias(f"r{k}") for k in (0, 1, 3, 4, 8)]),
    "world_alignment": _aligned,
    "recalibration_due": _due,
    "stop_signal": _done,
    "frozen_calibration": _frozen,
}
ORACLE_SQL = {
    "coverage": f"with {FRAME_LOG_SQL}, c as (select cam_id, floor((seq * 37 % 1920) / 1920.0 * 6) as c, floor((seq * 53 % 1080) / 1080.0 * 4) as r from frame_log) select cam_id, count(*) as cells, round(count(*) / 24.0::double, 6) as coverage from (select distinct cam_id, c, r from c) group by cam_id",
    "simultaneous_pairs": BOARDS_SQL + "select 'cam' || a.k as cam_id_a, 'cam' || b.k as cam_id_b, count(*) as pairs from o a join o b on a.seq = b.seq and a.k < b.k group by a.k, b.k",
    # The relative turn of two cameras about z is known from theirs.
    "edge_mean": BOARDS_SQL + ", t as (select * from (values " + ", ".join(f"({k}, cast({a!r} as double), cast({b!r} as double))" for k, (a, b) in enumerate(TURNS)) + """) as v(k, c, s))
 select 'cam' || a.k as cam_a, 'cam' || b.k as cam_b, count(*) as n, round(avg(0.1 + a.seq % 7 / 100.0), 6) as err, round(max(ta.c * tb.c + ta.s * tb.s), 4) as r0, round(max(-(tb.s * ta.c - tb.c * ta.s)), 4) as r1, round(max(tb.s * ta.c - tb.c * ta.s), 4) as r3, round(max(ta.c * tb.c + ta.s * tb.s), 4) as r4, cast(1 as double) as r8
 from o a join o b on a.seq = b.seq and a.k < b.k join t ta on ta.k = a.k join t tb on tb.k = b.k group by a.k, b.k having count(*) >= 5""",
    # The pose is a quarter turn q: its inverse cancels it, and what stays is the board's turn with the second and third axes turned over.
    "world_alignment": "with t as (select * from (values " + ", ".join(f"({k}, cast({a!r} as double), cast({b!r} as double))" for k, (a, b) in enumerate(TURNS)) + """) as v(k, c, s)), r as (select c_custkey as rig_id, c_custkey % 3 = 0 as stale, c, s from customer join t on k = c_custkey % 4)
 select rig_id, round(case when stale then 1 else c end, 6) as r0, round(case when stale then 0 else s end, 6) as r1, round(case when stale then 0 else s end, 6) as r3, round(-c, 6) as r4, round(case when stale then s else 0 end, 6) as r5, round(case when stale then -c else -1 end, 6) as r8 from r""",
    "recalibration_due": f"with {FRAME_LOG_SQL} select cam_id, idx + 1 as n, idx + 1 >= 12 and (idx + 1 - 12) % 5 = 0 as due from frame_log",
    "stop_signal": "select s_nationkey as rig_id, bool_and(s_suppkey % 11 <= 9) as done from supplier group by s_nationkey",
    "frozen_calibration": "with o as (select o_custkey % 50 as rig_id, cast(o_orderkey % 90 as double) as made_s, o_orderkey as cam_id from orders where o_orderkey % 90 <= 60) select * from o where made_s = (select max(made_s) from o as q where q.rig_id = o.rig_id)",
}
