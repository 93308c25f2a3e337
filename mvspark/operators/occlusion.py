"""Boxes of landmarks, and hands that may hide one another where only one of two is seen."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mvspark.functions.geometry import box_iou
from mvspark.functions.series import checkpointed, joined
from mvspark.plans.fixtures import FRAME_LOG_SQL, frame_log, keypoint_lists, keypoints_sql

CORNERS = ["x0", "y0", "x1", "y1"]
MIN_IOU = 0.1
#: Frames of a range.
WIDTH = 4096


def landmark_boxes(points: DataFrame, keys: list[str], lists: bool = False) -> DataFrame:
    """(keys, x0, y0, x1, y1, cx, cy, area): the least box around each group's landmarks (x, y). lists: a row is a whole group, and x and y hold its landmarks': nothing is
    shuffled or held by group."""
    if lists:
        boxes = points.select(*keys, F.array_min("x").alias("x0"), F.array_min("y").alias("y0"), F.array_max("x").alias("x1"), F.array_max("y").alias("y1"))
    else:
        boxes = points.groupBy(*keys).agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))
    return boxes.withColumns({"cx": (F.col("x0") + F.col("x1")) / 2, "cy": (F.col("y0") + F.col("y1")) / 2, "area": (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))})


def occlusions(boxes: DataFrame, keys: list[str], min_iou: float = MIN_IOU, width: int = WIDTH) -> DataFrame:
    """(keys, frame, place, iou, occluded) of the frames with one of two hands (place 1 or 2; x0, y0, x1, y1, disagree). The hand seen may hide the other if
    it overlaps the other's box nearest in time (a tie: the earlier) by more than min_iou, or if its detectors disagree on the side. One row holds a frame's
    two hands and every frame with a box has one, so the nearest box is the last before or the first after. A task holds a range of so many frames (width) of
    a series (keys) at a time."""
    box = F.struct("frame", *CORNERS)
    seen = {p: F.max(F.when(F.col("place") == p, box)).alias(f"box{p}") for p in (1, 2)}
    block = F.floor(F.col("frame") / width).alias("__block")
    rows = checkpointed(boxes.groupBy(*keys, block, "frame").agg(*seen.values(), F.max(F.coalesce("disagree", F.lit(False))).alias("disagree")))
    # Ranges of frames hand on their last and first box of each hand; in a range both frames reach back from the row, one in descending order, so that each is worked out in one pass.
    ends = rows.groupBy(*keys, "__block").agg(*[F.max(f"box{p}").alias(f"before{p}") for p in (1, 2)], *[F.min(f"box{p}").alias(f"after{p}") for p in (1, 2)])
    sides = (("before", "asc"), ("after", "desc"))
    near = lambda by, side, order, name: F.last(name, ignorenulls=True).over(Window.partitionBy(*by).orderBy(getattr(F, order)(side)).rowsBetween(Window.unboundedPreceding, -1))
    handed = ends.select(*keys, "__block", *[near(keys, "__block", order, f"{side}{p}").alias(f"{side}{p}_far") for side, order in sides for p in (1, 2)])
    for side, order in sides:
        rows = rows.withColumns({f"{side}{p}": near([*keys, "__block"], "frame", order, f"box{p}") for p in (1, 2)})
    rows = joined(rows, handed, [*keys, "__block"]).withColumns({f"{side}{p}": F.coalesce(f"{side}{p}", f"{side}{p}_far") for side, _ in sides for p in (1, 2)})
    rows = rows.filter("box1 is null or box2 is null")
    nearest = lambda p: F.when(F.col(f"after{p}").isNull() | (F.col("frame") - F.col(f"before{p}.frame") <= F.col(f"after{p}.frame") - F.col("frame")), F.col(f"before{p}")).otherwise(F.col(f"after{p}"))
    one = rows.select(*keys, "frame", F.when(F.col("box1").isNull(), 2).otherwise(1).alias("place"), F.coalesce("box1", "box2").alias("a"), F.when(F.col("box1").isNull(), nearest(1)).otherwise(nearest(2)).alias("b"), "disagree")
    iou = F.when(F.col("b").isNotNull(), box_iou([f"a.{c}" for c in CORNERS], [f"b.{c}" for c in CORNERS])).otherwise(0.0)
    return one.select(*keys, "frame", "place", iou.alias("iou"), ((iou > min_iou) | F.col("disagree")).alias("occluded"))


def _hands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two boxes that move along and apart; each eleventh frame and the one after lack the second, each thirteenth the first."""
    log = frame_log(spark, sf_dir).select("session_id", "cam_id", F.col("idx").alias("frame"), F.explode(F.array(F.lit(1), F.lit(2))).alias("place"))
    x = (F.col("frame") % 50 * 4 + (F.col("place") - 1) * (100 + F.col("frame") % 7 * 20)).cast("double")
    there = F.when(F.col("place") == 1, F.col("frame") % 13 != 0).otherwise(F.col("frame") % 11 > 1)
    return log.filter(there).select("session_id", "cam_id", "frame", "place", x.alias("x0"), F.lit(0.0).alias("y0"), (x + 200).alias("x1"), F.lit(200.0).alias("y1"), (F.col("frame") % 9 == 0).alias("disagree"))


QUERIES = {
    "hand_boxes": lambda spark, sf: landmark_boxes(keypoint_lists(spark, sf), ["cam_id", "frame", "part"], lists=True).select("cam_id", "frame", "part", *[F.round(c, 6).alias(c) for c in (*CORNERS, "cx", "cy", "area")]),
    "occlusions": lambda spark, sf: occlusions(_hands(spark, sf), ["session_id", "cam_id"]).withColumn("iou", F.round("iou", 6)),
}
ORACLE_SQL = {
    "hand_boxes": "with " + keypoints_sql(0.0) + " select cam_id, frame, part, round(min(x), 6) as x0, round(min(y), 6) as y0, round(max(x), 6) as x1, round(max(y), 6) as y1, round((min(x) + max(x)) / 2, 6) as cx, round((min(y) + max(y)) / 2, 6) as cy, round((max(x) - min(x)) * (max(y) - min(y)), 6) as area from keypoint group by cam_id, frame, part",
    "occlusions": f"""with {FRAME_LOG_SQL}, h as (select session_id, cam_id, idx as frame, p as place, cast(idx % 50 * 4 + (p - 1) * (100 + idx % 7 * 20) as double) as x0, idx % 9 = 0 as disagree from frame_log, (values (1), (2)) as s(p) where case when p = 1 then idx % 13 <> 0 else idx % 11 > 1 end),
 one as (select * from h where not exists (select 1 from h o where o.session_id = h.session_id and o.cam_id = h.cam_id and o.frame = h.frame and o.place <> h.place)),
 q as (select session_id, cam_id, frame, 3 - place as place from one),
 b as (select q.*, h.frame as bf, h.x0 as bx from q asof left join h on h.session_id = q.session_id and h.cam_id = q.cam_id and h.place = q.place and h.frame <= q.frame),
 a as (select q.*, h.frame as af, h.x0 as ax from q asof left join h on h.session_id = q.session_id and h.cam_id = q.cam_id and h.place = q.place and h.frame >= q.frame),
 n as (select one.*, case when af is null or frame - bf <= af - frame then bx else ax end as nx from one join (select session_id, cam_id, frame, bf, bx from b) using (session_id, cam_id, frame) join (select session_id, cam_id, frame, af, ax from a) using (session_id, cam_id, frame)),
 i as (select *, coalesce(greatest(0, 200 - abs(x0 - nx)) / (400 - greatest(0, 200 - abs(x0 - nx))), 0) as v from n)
 select session_id, cam_id, frame, place, round(v, 6) as iou, v > 0.1 or disagree as occluded from i""",
}
