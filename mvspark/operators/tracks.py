"""Boxes over time: overlap, tracks, occlusion by gaps; and the fusion of meshes."""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from mvspark.functions.geometry import box_iou
from mvspark.functions.series import checkpointed
from mvspark.plans.fixtures import FRAME_LOG_SQL, POINTS_SQL, frame_log, true_points

MAX_STEP_PX, MAX_GAP = 500.0, 20
#: Frames of a range in which gaps are looked for.
RANGE = 20_000


def track_scan(rows: pd.DataFrame, max_gap: int = MAX_GAP) -> list[int]:
    """Track of each box (frame, det_id, cx, cy; in order): the nearest pairs of box and live track first, one each; other boxes begin tracks."""
    last: dict[int, tuple[int, np.ndarray]] = {}
    out, begun = [], 0
    for frame, boxes in rows.groupby("frame", sort=False):
        at = boxes[["cx", "cy"]].to_numpy(float)
        live = {k: p for k, (f, p) in last.items() if frame - f <= max_gap}
        near = sorted((d, i, k) for i, c in enumerate(at) for k, p in live.items() if (d := float(np.linalg.norm(c - p))) < MAX_STEP_PX)
        mine: dict[int, int] = {}
        for _, i, k in near:
            if i not in mine and k not in mine.values():
                mine[i] = k
        for i in range(len(at)):
            if i not in mine:
                mine[i], begun = begun, begun + 1
            last[mine[i]] = (int(frame), at[i])
            out.append(mine[i])
    return out


def tracks(boxes: DataFrame, keys: tuple[str, ...] = ("cam_id",), max_gap: int = MAX_GAP) -> DataFrame:
    """Boxes (keys, frame, det_id, x0, y0, x1, y1) with ``track``, numbered from 0 in each camera (keys). What a box is matched with depends on all before, but no further back than a gap:
    where a camera shows no box for more than ``max_gap`` frames every track has ended. There its history is cut into parts, each a group of its own; a part's tracks are
    numbered after those of the parts before. Rows are those of one scan of the whole history. Columns of the names ``part`` and ``track`` are replaced; equal (keys, frame, det_id)
    would be told apart by nothing, so they must not repeat. An empty table has no tracks."""
    rows = boxes.withColumns({"cx": (F.col("x0") + F.col("x1")) / 2, "cy": (F.col("y0") + F.col("y1")) / 2}).select(*keys, "frame", "det_id", "cx", "cy")
    # Frames with boxes, numbered in ranges, and the last one before each range: no task sorts a camera's whole history.
    frames = rows.select(*keys, "frame").distinct().withColumn("range", F.floor(F.col("frame") / RANGE))
    camera, inside = Window.partitionBy(*keys).orderBy("range"), Window.partitionBy(*keys, "range").orderBy("frame")
    ends = frames.groupBy(*keys, "range").agg(F.max("frame").alias("end"))
    ends = ends.select(*keys, "range", F.lag("end").over(camera).alias("end"))
    seen = frames.join(ends, [*keys, "range"]).withColumn("before", F.coalesce(F.lag("frame").over(inside), "end"))
    cut = F.coalesce((F.col("frame") - F.col("before") > max_gap), F.lit(True)).cast("long")
    counts = seen.groupBy(*keys, "range").agg(F.sum(cut).alias("cuts"))
    offsets = counts.select(*keys, "range", F.coalesce(F.sum("cuts").over(camera.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    parts = seen.join(offsets, [*keys, "range"]).select(*keys, "frame", (F.col("offset") + F.sum(cut).over(inside)).alias("part"))
    out = StructType([*[boxes.schema[k] for k in [*keys, "frame", "det_id"]], StructField("part", LongType()), StructField("own", LongType())])

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["frame", "det_id"])
        return rows[[*keys, "frame", "det_id", "part"]].assign(own=track_scan(rows, max_gap))

    found = checkpointed(rows.join(parts, [*keys, "frame"]).groupBy(*keys, "part").applyInPandas(run, out))
    begun = found.groupBy(*keys, "part").agg((F.max("own") + 1).alias("n"))
    order = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offset = begun.select(*keys, "part", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("offset"))
    track = (F.col("offset") + F.col("own")).cast("int").alias("track")
    return boxes.drop("track").join(found.join(offset, [*keys, "part"]).select(*keys, "frame", "det_id", track), [*keys, "frame", "det_id"])


def longest(tracked: DataFrame, keep: int = 2, keys: tuple[str, ...] = ("cam_id",)) -> DataFrame:
    """Each camera's longest tracks."""
    n = tracked.groupBy(*keys, "track").agg(F.count(F.lit(1)).alias("frames"))
    return n.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("frames"), "track"))).filter(F.col("place") <= keep)


def handedness(votes: DataFrame) -> DataFrame:
    """Side of each (cam_id, track): votes (is_right, occluded), an occluded one counts half; a tie is right."""
    w = F.when(F.col("occluded"), 0.5).otherwise(1.0)
    return votes.groupBy("cam_id", "track").agg(F.sum(F.when(F.col("is_right"), w).otherwise(-w)).alias("balance")).select("cam_id", "track", F.when(F.col("balance") >= 0, "right").otherwise("left").alias("side"))


def fuse_mesh(vertices: DataFrame, factor: float = 1.5) -> DataFrame:
    """One mesh of several cameras' (frame, side, cam_id, vert_id, x, y, z, weight): cameras whose mean distance from the median shape is within the factor of the median distance count, if
    there are over two."""
    keys = ["frame", "side"]
    rows = vertices.dropna(subset=[*keys, "vert_id"])
    # Windows, not joins: rows that lie together by frame stay where they are. Each list is of one vertex in all cameras, or of one frame's cameras.
    vertex, cam, hand = (Window.partitionBy(*keys, *more) for more in (["vert_id"], ["cam_id"], []))
    middle = lambda values: (F.get(values, F.floor((F.size(values) - 1) / 2).cast("int")) + F.get(values, F.floor(F.size(values) / 2).cast("int"))) / 2
    rows = rows.withColumns({f"__{c}": F.collect_list(c).over(vertex) for c in "xyz"}).withColumns({f"__{c}": F.col(c) - middle(F.sort_array(f"__{c}")) for c in "xyz"})
    rows = rows.withColumn("__dev", F.avg(F.sqrt(sum((F.col(f"__{c}") ** 2 for c in "yz"), F.col("__x") ** 2))).over(cam)).drop("__x", "__y", "__z")
    rows = rows.withColumn("__cams", F.collect_set(F.struct("cam_id", "__dev")).over(hand))
    near = F.col("__dev") <= factor * middle(F.sort_array(F.filter("__cams.__dev", lambda d: d.isNotNull())))
    kept = rows.filter(F.col("cam_id").isNotNull() & ((F.size("__cams") <= 2) | near))
    return kept.groupBy(*keys, "vert_id").agg(*[(F.sum(F.col("weight") * F.col(c)) / F.sum("weight")).alias(c) for c in "xyz"], F.count(F.lit(1)).alias("cams"))


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two boxes a frame that move along; each eleventh frame lacks one."""
    log = frame_log(spark, sf_dir).select("cam_id", F.col("idx").alias("frame"), F.explode(F.array(F.lit(0), F.lit(1))).alias("det_id"))
    x = F.col("det_id") * 1500 + F.col("frame") % 50 * 4
    return log.filter((F.col("frame") % 11 != 0) | (F.col("det_id") == 0)).select("cam_id", "frame", "det_id", x.cast("double").alias("x0"), F.lit(100.0).alias("y0"), (x + 200).cast("double").alias("x1"), F.lit(300.0).alias("y1"))


def _broken_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every 400 frames the last 30 show nothing, which ends tracks; 17 others in their midst do not."""
    at = F.col("frame") % 400
    found = tracks(_boxes(spark, sf_dir).filter((at < 370) & ~at.between(102, 118)))
    return found.groupBy("cam_id", "track").agg(F.count(F.lit(1)).alias("frames"), F.min("frame").alias("first"), F.max("frame").alias("last"))


def _overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each box with its detection's box before."""
    w = Window.partitionBy("cam_id", "det_id").orderBy("frame")
    prev = _boxes(spark, sf_dir).select("cam_id", "frame", "det_id", "x0", "y0", "x1", "y1", *[F.lag(c).over(w).alias(f"p{c}") for c in ("x0", "y0", "x1", "y1")]).dropna()
    return prev.select("cam_id", "frame", "det_id", F.round(box_iou(["x0", "y0", "x1", "y1"], ["px0", "py0", "px1", "py1"]), 6).alias("iou"))


def _mesh(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = true_points(spark, sf_dir).filter("lm_id < 10").withColumnRenamed("part", "side").withColumnRenamed("lm_id", "vert_id")
    cams = p.withColumn("cam", F.explode(F.sequence(F.lit(0), F.lit(3))))
    away = F.when((F.col("cam") == 3) & (F.col("frame") % 7 == 0), 0.2).otherwise(0.001 * F.col("cam"))
    return cams.select("frame", "side", F.concat(F.lit("cam"), F.col("cam").cast("string")).alias("cam_id"), "vert_id", (F.col("x") + away).alias("x"), "y", "z", (1.0 + F.col("cam")).alias("weight"))


QUERIES = {
    "tracks": _broken_tracks,
    "box_iou": _overlaps,
    "mesh_fuse": lambda spark, sf: fuse_mesh(_mesh(spark, sf)).select("frame", "side", "vert_id", "cams", *[F.round(c, 5).alias(c) for c in "xyz"]),
}
ORACLE_SQL = {
    # The two boxes of a frame are 1500 apart and move 200 at most: each is one track until a gap ends it.
    "tracks": f"""with {FRAME_LOG_SQL} select cam_id, cast(2 * (idx // 400) + d as integer) as track, count(*) as frames, min(idx) as first, max(idx) as last from frame_log, (values (0), (1)) as v(d)
 where (idx % 11 <> 0 or d = 0) and idx % 400 < 370 and idx % 400 not between 102 and 118 group by cam_id, 2 * (idx // 400) + d""",
    # All boxes are 200 by 200 and only move along x.
    "box_iou": f"""with {FRAME_LOG_SQL}, b as (select cam_id, idx as frame, d as det_id, d * 1500 + idx % 50 * 4 as x from frame_log, (values (0), (1)) as v(d) where idx % 11 <> 0 or d = 0),
 p as (select *, greatest(0, 200 - abs(x - lag(x) over (partition by cam_id, det_id order by frame))) as o, lag(x) over (partition by cam_id, det_id order by frame) as before from b)
 select cam_id, frame, det_id, round(o / (400.0::double - o), 6) as iou from p where before is not null""",
    "mesh_fuse": f"""with {POINTS_SQL}, v as (select frame, part as side, k as cam, lm_id as vert_id, x + case when k = 3 and frame % 7 = 0 then 0.2 else 0.001 * k end as x, y, z, 1.0 + k as weight from points, (values (0), (1), (2), (3)) as c(k) where lm_id < 10),
 m as (select frame, side, vert_id, quantile_cont(x, 0.5) as mx, quantile_cont(y, 0.5) as my, quantile_cont(z, 0.5) as mz from v group by frame, side, vert_id),
 d as (select frame, side, cam, avg(sqrt(pow(x - mx, 2) + pow(y - my, 2) + pow(z - mz, 2))) as dev from v join m using (frame, side, vert_id) group by frame, side, cam),
 l as (select frame, side, quantile_cont(dev, 0.5) as mid from d group by frame, side)
 select frame, side, vert_id, count(*) as cams, round(sum(weight * x) / sum(weight), 5) as x, round(sum(weight * y) / sum(weight), 5) as y, round(sum(weight * z) / sum(weight), 5) as z
 from v join d using (frame, side, cam) join l using (frame, side) where dev <= 1.5 * mid group by frame, side, vert_id""",
}
