"""Keypoints before they are used: lens distortion, choice of cameras, frames and hands, candidates, arrays of landmarks, corners of boards."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mvspark.operators.quality import _SW, _swapped, body_wrist_swap, correct
from mvspark.operators.quality import ORACLE_SQL as QUALITY_SQL
from mvspark.operators.triangulate import undistort_points
from mvspark.plans.fixtures import FRAME_LOG_SQL, calibration, frame_log, keypoints, keypoints_sql

#: The camera that averages leave out.
SKIPPED = ("cam02",)
HAND_SIZE = 21


def without_cameras(rows: DataFrame, skip: tuple[str, ...] = SKIPPED) -> DataFrame:
    """Rows of all cameras but some."""
    return rows.filter(~F.col("cam_id").isin(*skip))


def frame_range(rows: DataFrame, start: int, most: int, place: str = "idx") -> DataFrame:
    """Each camera's frames from a place on, ``most`` of them."""
    return rows.filter((F.col(place) >= start) & (F.col(place) < start + most))


def complete_hands(points: DataFrame, keys: list[str], size: int = HAND_SIZE) -> DataFrame:
    """Keypoints of the hands (keys) that have all their landmarks."""
    whole = points.groupBy(*keys).agg(F.countDistinct("lm_id").alias("n")).filter(F.col("n") == size)
    return points.join(whole.select(*keys), keys, "left_semi")


def candidates(flagged: DataFrame, chosen: DataFrame, keys: list[str]) -> DataFrame:
    """The keys that a costly test is to see: those a cheap test flagged, and those chosen otherwise."""
    return flagged.select(*keys).unionByName(chosen.select(*keys)).distinct()


def view_counts(views: DataFrame, keys: list[str], least: int) -> DataFrame:
    """(keys, n, enough) of valid views."""
    return views.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).withColumn("enough", F.col("n") >= least)


def require_views(views: DataFrame, keys: list[str], least: int) -> DataFrame:
    """The counts of ``view_counts``; a group below the least ends the job with an error."""
    counts = view_counts(views, keys, least)
    text = F.concat(F.lit("too few valid views: "), F.concat_ws("/", *[F.col(k).cast("string") for k in keys]))
    return counts.filter(F.when(F.col("enough"), True).otherwise(F.raise_error(text).cast("boolean")))


def landmark_arrays(points: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ids, xy, conf): parallel arrays of a detection's landmarks in the order of their ids."""
    rows = points.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("lm_id", "x", "y", "conf"))).alias("s"))
    return rows.select(*keys, F.col("s.lm_id").alias("ids"), F.transform("s", lambda p: F.array(p["x"], p["y"])).alias("xy"), F.col("s.conf").alias("conf"))


def board_corner(number: Column, squares_x: int, square: float) -> tuple[Column, Column, Column]:
    """Place of a board's inner corner on the board: corners are numbered along rows of squares_x - 1."""
    across = squares_x - 1
    return (number % across) * square, F.floor(number / across) * square, F.lit(0.0)


# Queries

#: Distortion of the fixture's cameras, k1 k2 p1 p2 k3 k4 k5 k6, by their order.
_LENS = [[0.02 * (k + 1), -0.01, 0.001, -0.002 * k, 0.004, 0.003, 0.001, 0.002] for k in range(4)]


def _lenses(spark: SparkSession, radial: bool = False) -> DataFrame:
    rows = [[(d[0] if i == 0 else 0.0) if radial else x for i, x in enumerate(d)] for d in _LENS]
    dist = F.array(*[F.array(*map(F.lit, d)) for d in rows])
    return calibration(spark).withColumn("dist", F.get(dist, F.col("ord")))


def _distorted(points: DataFrame, lenses: DataFrame) -> DataFrame:
    """What a lens with a radial coefficient shows of plain keypoints."""
    rows = points.join(lenses.select("cam_id", "fx", "fy", "cx", "cy", "width", "height", "dist"), "cam_id")
    a, b = (F.col("x") * F.col("width") - F.col("cx")) / F.col("fx"), (F.col("y") * F.col("height") - F.col("cy")) / F.col("fy")
    scale = 1 + F.get("dist", F.lit(0)) * (a * a + b * b)
    moved = {"x": (a * scale * F.col("fx") + F.col("cx")) / F.col("width"), "y": (b * scale * F.col("fy") + F.col("cy")) / F.col("height")}
    return rows.withColumns(moved).select(*points.columns)


def _corrected(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, lenses = keypoints(spark, sf_dir), _lenses(spark, radial=True)
    body = _distorted(k, lenses)
    return correct(_swapped(body), body, lenses)[1].withColumn("conf", F.round("conf", 6))


def _tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = keypoints(spark, sf_dir)
    moved = _swapped(k)
    few = candidates(body_wrist_swap(moved, k).filter("swap"), moved.filter("frame % 50 = 0"), ["cam_id", "frame"])
    return moved.join(few, ["cam_id", "frame"], "left_semi").groupBy("cam_id", "frame").agg(F.count(F.lit(1)).alias("n"))


def _board(spark: SparkSession, sf_dir: str) -> DataFrame:
    corner = board_corner(F.col("l_partkey") % 70, 11, 0.5)
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return li.select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 70).alias("corner"), *[c.cast("double").alias(n) for n, c in zip("xyz", corner, strict=True)])


def _arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = landmark_arrays(keypoints(spark, sf_dir), ["session", "frame", "part", "cam_id"])
    last = F.element_at("xy", -1)
    return a.select("frame", "part", "cam_id", F.array_join("ids", ",").alias("ids"), F.round(F.get(last, F.lit(0)), 6).alias("last_x"), F.round(F.get(last, F.lit(1)), 6).alias("last_y"), F.size("conf").alias("n"))


_K = "with " + keypoints_sql(0.0)


def _undistorted_sql(steps: int = 5) -> str:
    lens = ", ".join("(" + ", ".join(map(repr, [k, *d])) + ")" for k, d in enumerate(_LENS))
    sql = _K + f""", lens as (select o, {", ".join(f"cast({n} as double) as {n}" for n in ("k1", "k2", "q1", "q2", "k3", "k4", "k5", "k6"))} from (values {lens}) as v(o, k1, k2, q1, q2, k3, k4, k5, k6)),
 s0 as (select frame, part, lm_id, cam_id, k1, k2, q1, q2, k3, k4, k5, k6, (x * {3360.0} - {1680.0}) / {2000.0} as a, (y * {1890.0} - {945.0}) / {2000.0} as b, a as a0, b as b0 from keypoint join lens on o = ord)"""
    for i in range(steps):
        sql += f""",
 r{i} as (select *, a * a + b * b as r from s{i}),
 f{i} as (select *, (1 + ((k6 * r + k5) * r + k4) * r) / (1 + ((k3 * r + k2) * r + k1) * r) as f from r{i}),
 s{i + 1} as (select * exclude (a, b, r, f), (a0 - (2 * q1 * a * b + q2 * (r + 2 * a * a))) * f as a, (b0 - (q1 * (r + 2 * b * b) + 2 * q2 * a * b)) * f as b from f{i})"""
    return sql + f" select frame, part, lm_id, cam_id, round((a * {2000.0} + {1680.0}) / {3360.0}, 5) as x, round((b * {2000.0} + {945.0}) / {1890.0}, 5) as y from s{steps}"


QUERIES = {
    "undistorted": lambda spark, sf: undistort_points(keypoints(spark, sf), _lenses(spark)).select("frame", "part", "lm_id", "cam_id", F.round("x", 5).alias("x"), F.round("y", 5).alias("y")),
    "corrections_distorted": _corrected,
    "kept_cameras": lambda spark, sf: without_cameras(keypoints(spark, sf)).groupBy("cam_id").agg(F.count(F.lit(1)).alias("n")),
    "frame_range": lambda spark, sf: frame_range(frame_log(spark, sf), 10, 500).select("cam_id", "idx", "seq"),
    "complete_hands": lambda spark, sf: complete_hands(keypoints(spark, sf).filter("conf >= 0.4"), ["session", "frame", "part", "cam_id"], 7).select("frame", "part", "cam_id", "lm_id"),
    "candidate_tests": _tests,
    "view_counts": lambda spark, sf: view_counts(keypoints(spark, sf).filter("conf >= 0.6"), ["frame", "part", "lm_id"], 3),
    "landmark_arrays": _arrays,
    "board_corners": _board,
}
ORACLE_SQL = {
    "undistorted": _undistorted_sql(),
    # The lens is taken out again, so what is corrected is what it is without one.
    "corrections_distorted": QUALITY_SQL["corrections"],
    "kept_cameras": _K + "select cam_id, count(*) as n from keypoint where cam_id <> 'cam02' group by cam_id",
    "frame_range": f"with {FRAME_LOG_SQL} select cam_id, idx, seq from frame_log where idx between 10 and 509",
    "complete_hands": _K + ", h as (select *, count(*) over (partition by frame, part, cam_id) as n from keypoint where conf >= 0.4) select frame, part, cam_id, lm_id from h where n = 7",
    "candidate_tests": _SW + " select cam_id, frame, count(*) as n from sw where frame % 50 = 0 or (frame % 5 = 0 and ord = frame % 7) group by cam_id, frame",
    "view_counts": _K + "select frame, part, lm_id, count(*) as n, count(*) >= 3 as enough from keypoint where conf >= 0.6 group by frame, part, lm_id",
    "landmark_arrays": _K + "select frame, part, cam_id, string_agg(cast(lm_id as varchar), ',' order by lm_id) as ids, round(arg_max(x, lm_id), 6) as last_x, round(arg_max(y, lm_id), 6) as last_y, cast(count(*) as integer) as n from keypoint group by frame, part, cam_id",
    "board_corners": "select l_orderkey, l_linenumber, l_partkey % 70 as corner, (l_partkey % 70) % 10 * 0.5::double as x, floor((l_partkey % 70) / 10) * 0.5::double as y, 0.0::double as z from lineitem",
}
