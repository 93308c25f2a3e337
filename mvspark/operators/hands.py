"""Which hand is which: numbering of landmarks, hands matched with body wrists in images and in space, bones and the skeleton's origin."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mvspark.plans.fixtures import POINTS_SQL, keypoint_lists, keypoints, keypoints_sql, true_points

#: The BlazePose landmark of each COCO landmark 0 to 16.
BLAZE_OF_COCO = (0, 2, 5, 7, 8, 11, 12, 13, 14, 15, 16, 23, 24, 25, 26, 27, 28)
#: First landmark and number of landmarks of the parts of 133 whole-body landmarks.
WHOLE_BODY = {"body": (0, 17), "left": (91, 21), "right": (112, 21)}
#: What numbers a part's landmarks among all joints; BlazePose's wrists and hips.
OFFSETS = {"body": 0, "left": 100, "right": 200}
WRISTS, HIPS = (15, 16), (23, 24)
MIN_VISIBILITY = 0.3


def remap_body(points: DataFrame) -> DataFrame:
    """BlazePose rows (lm_id 0 to 32) as COCO rows (0 to 16); the others go."""
    place = F.array_position(F.array(*map(F.lit, BLAZE_OF_COCO)), F.col("lm_id").cast("int"))
    return points.filter(F.col("lm_id").isin(*BLAZE_OF_COCO)).withColumn("lm_id", (place - 1).cast("int"))


def split_whole_body(points: DataFrame) -> DataFrame:
    """Whole-body rows (lm_id 0 to 132) with ``part`` and lm_id counted within it; feet and face go."""
    part, first = F.lit(None).cast("string"), F.lit(0)
    for name, (start, n) in WHOLE_BODY.items():
        inside = F.col("lm_id").between(start, start + n - 1)
        part, first = F.when(inside, name).otherwise(part), F.when(inside, start).otherwise(first)
    return points.withColumns({"part": part, "lm_id": (F.col("lm_id") - first).cast("int")}).filter("part is not null")


def joint() -> Column:
    """Number of a landmark (part, lm_id) among all joints."""
    offset = F.lit(None).cast("int")
    for part, n in OFFSETS.items():
        offset = F.when(F.col("part") == part, n).otherwise(offset)
    return offset + F.col("lm_id")


def hand_score(score: str, z: str) -> Column:
    """The older confidence of a hand landmark: the score, or its nearness to the wrist's depth if that is more."""
    return F.greatest(F.col(score), 1 - F.abs(F.col(z)))


def crop_translation() -> list[Column]:
    """Metric place (tx, ty, tz) of a hand predicted in a crop: columns scale, px, py, is_right, box_x, box_y, box_size, fx, cx, cy.
    A left hand's crop was mirrored, so its px changes sign."""
    size = F.col("box_size") * F.col("scale") + 1e-9
    tx = 2 * (F.col("box_x") - F.col("cx")) / size + F.when(F.col("is_right"), F.col("px")).otherwise(-F.col("px"))
    return [tx.alias("tx"), (2 * (F.col("box_y") - F.col("cy")) / size + F.col("py")).alias("ty"), (2 * F.col("fx") / size).alias("tz")]


def part_confidence(points: DataFrame, keys: list[str], lists: bool = False) -> DataFrame:
    """A frame's confidence in a part: the mean of its landmarks'. lists: a row is a whole part, and conf holds its landmarks': nothing is shuffled or held by part."""
    if lists:
        there = F.filter("conf", lambda c: c.isNotNull())
        return points.select(*keys, F.try_divide(F.aggregate(there, F.lit(0.0), lambda acc, c: acc + c), F.size(there)).alias("conf"))
    return points.groupBy(*keys).agg(F.avg("conf").alias("conf"))


def assign_hands(hands: DataFrame, wrists: DataFrame, keys: list[str], min_visibility: float = MIN_VISIBILITY) -> DataFrame:
    """(keys, det_id, side) of the first two hands (det_id, x, y) of each frame. Where both body wrists (part, x, y, visibility) can be seen, one hand
    goes to the nearer (a tie: left) and two to the nearer pairing (a tie: as detected); elsewhere the first is left."""
    first = hands.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("det_id"))).filter("place <= 2")
    pick = lambda c, p: F.max(F.when(F.col("place") == p, F.col(c))).alias(f"{c}{p}")
    frames = first.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[pick(c, p) for c in ("det_id", "x", "y") for p in (1, 2)])
    side = lambda p, c: F.max(F.when(F.col("part") == p, F.col(c))).alias(f"{p}_{c}")
    body = wrists.filter(F.col("visibility") >= min_visibility).groupBy(*keys).agg(*[side(p, c) for p in ("left", "right") for c in "xy"]).dropna()
    d = lambda p, s: (F.col(f"x{p}") - F.col(f"{s}_x")) ** 2 + (F.col(f"y{p}") - F.col(f"{s}_y")) ** 2
    straight = F.when(F.col("left_x").isNull(), True).when(F.col("n") == 1, d(1, "left") <= d(1, "right")).otherwise(d(1, "left") + d(2, "right") <= d(1, "right") + d(2, "left"))
    both = frames.join(body, keys, "left").withColumn("straight", straight)
    named = lambda p, yes, no: F.struct(F.col(f"det_id{p}").alias("det_id"), F.when(F.col("straight"), yes).otherwise(no).alias("side"))
    return both.select(*keys, F.inline(F.array(named(1, "left", "right"), named(2, "right", "left")))).filter("det_id is not null")


def snap_hands(joints: DataFrame, keys: list[str]) -> DataFrame:
    """Joints (keys, joint, x, y, z) with each hand moved as a whole onto its body wrist: one hand to the nearer wrist there is, two hands to two wrists
    by the nearer pairing (a tie: as labelled). Two hands and one wrist stay."""
    roots = {"l": OFFSETS["left"], "r": OFFSETS["right"], "wl": WRISTS[0], "wr": WRISTS[1]}
    pick = lambda n, c: F.max(F.when(F.col("joint") == roots[n], F.col(c))).alias(f"{n}_{c}")
    frames = joints.filter(F.col("joint").isin(*roots.values())).groupBy(*keys).agg(*[pick(n, c) for n in roots for c in "xyz"])
    d = lambda a, b: F.sqrt((F.col(f"{a}_x") - F.col(f"{b}_x")) ** 2 + (F.col(f"{a}_y") - F.col(f"{b}_y")) ** 2 + (F.col(f"{a}_z") - F.col(f"{b}_z")) ** 2)
    has = lambda n: F.col(f"{n}_x").isNotNull()
    near = lambda a: F.when(~has("wr"), F.when(has("wl"), "wl")).when(~has("wl"), "wr").when(d(a, "wl") <= d(a, "wr"), "wl").otherwise("wr")
    straight = d("l", "wl") + d("r", "wr") <= d("l", "wr") + d("r", "wl")
    two = has("wl") & has("wr")
    goal = {
        "l": F.when(has("l") & ~has("r"), near("l")).when(has("l") & two, F.when(straight, "wl").otherwise("wr")),
        "r": F.when(has("r") & ~has("l"), near("r")).when(has("r") & two, F.when(straight, "wr").otherwise("wl")),
    }
    at = lambda h, c: F.when(F.col(f"to_{h}") == "wl", F.col(f"wl_{c}")).when(F.col(f"to_{h}") == "wr", F.col(f"wr_{c}")) - F.col(f"{h}_{c}")
    moves = frames.withColumns({f"to_{h}": g for h, g in goal.items()}).select(*keys, *[at(h, c).alias(f"d{h}_{c}") for h in goal for c in "xyz"])
    of = lambda h: F.col("joint").between(roots[h], roots[h] + 20)
    moved = {c: F.col(c) + F.coalesce(F.when(of("l"), F.col(f"dl_{c}")).when(of("r"), F.col(f"dr_{c}")), F.lit(0.0)) for c in "xyz"}
    return joints.join(moves, keys, "left").withColumns(moved).select(joints.columns)


def skeleton_origin(joints: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, x, y, z): the middle of both hips, else the mean of the body's joints, else 0."""
    hip, body = F.col("joint").isin(*HIPS), F.col("joint") < 100
    middle = lambda c: F.when(F.count(F.when(hip, 1)) == 2, F.avg(F.when(hip, F.col(c)))).otherwise(F.coalesce(F.avg(F.when(body, F.col(c))), F.lit(0.0)))
    return joints.groupBy(*keys).agg(*[middle(c).alias(c) for c in "xyz"])


def bones(points: DataFrame, keys: list[str], topology: list[tuple[int, int]]) -> DataFrame:
    """(keys, a, b, length) of the bones whose both ends are there. Each end is dealt to its bones and the two meet in one aggregate: no join."""
    ends = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in topology])
    mine = F.filter(ends, lambda s: (s["a"] == F.col("lm_id")) | (s["b"] == F.col("lm_id")))
    rows = points.select(*keys, "lm_id", "x", "y", "z", F.explode(mine).alias("bone")).select("*", "bone.a", "bone.b")
    end = lambda e, c: F.max(F.when(F.col("lm_id") == F.col(e), F.col(c)))
    length = F.sqrt((end("a", "x") - end("b", "x")) ** 2 + (end("a", "y") - end("b", "y")) ** 2 + (end("a", "z") - end("b", "z")) ** 2)
    return rows.groupBy(*keys, "a", "b").agg(length.alias("length")).filter("length is not null")


def _detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hands in an order that tells nothing, the left one missing in each eleventh frame."""
    k = keypoints(spark, sf_dir).filter("lm_id = 0 and not (part = 'left' and frame % 11 = 0)")
    return k.withColumn("det_id", F.when((F.col("part") == "left") == (F.col("frame") % 2 == 0), 0).otherwise(1))


def _assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    wrists = keypoints(spark, sf_dir, 2.0).filter("lm_id = 0").withColumn("visibility", F.col("conf"))
    return assign_hands(_detected(spark, sf_dir), wrists, ["cam_id", "frame"], 0.5)


def _joints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hands labelled the wrong way in each fifth frame, with body wrists a hundredth to the side."""
    p = true_points(spark, sf_dir)
    wrong = F.when(F.col("frame") % 5 != 0, F.col("part")).when(F.col("part") == "left", "right").otherwise("left")
    hands = p.select("session", "frame", F.when(wrong == "left", F.col("lm_id") + 100).otherwise(F.col("lm_id") + 200).alias("joint"), "x", "y", "z")
    body = p.filter("lm_id = 0").select("session", "frame", F.when(F.col("part") == "left", WRISTS[0]).otherwise(WRISTS[1]).alias("joint"), (F.col("x") + 0.01).alias("x"), "y", "z")
    return hands.unionByName(body)


def _body(spark: SparkSession, sf_dir: str) -> DataFrame:
    return true_points(spark, sf_dir).filter("part = 'left'").withColumn("joint", F.col("lm_id") + 22)


_BONES = [(0, 1), (1, 2), (0, 3)]
_K = "with " + keypoints_sql(2.0)
_XYZ = ", ".join(f"round({c}, 6) + 0.0 as {c}" for c in "xyz")
_rounded = lambda df, *keys: df.select(*keys, *[(F.round(c, 6) + 0.0).alias(c) for c in "xyz"])
QUERIES = {
    "wrist_assign": _assigned,
    "snap_hands": lambda spark, sf: _rounded(snap_hands(_joints(spark, sf), ["session", "frame"]), "frame", "joint"),
    "skeleton_origin": lambda spark, sf: _rounded(skeleton_origin(_body(spark, sf), ["frame"]), "frame"),
    "bones": lambda spark, sf: bones(true_points(spark, sf), ["frame", "part"], _BONES).withColumn("length", F.round("length", 6)),
    "body_remap": lambda spark, sf: _rounded(remap_body(_body(spark, sf).withColumn("lm_id", F.col("lm_id") * 5)), "frame", "lm_id"),
    "part_confidence": lambda spark, sf: part_confidence(keypoint_lists(spark, sf), ["cam_id", "frame", "part"], lists=True).withColumn("conf", F.round("conf", 6)),
}
ORACLE_SQL = {
    "wrist_assign": _K + """, k0 as (select cam_id, frame, part, x - 2.0 * ((frame * 31 + ord * 17) % 7 - 3) / 10 / (select max(width) from calibration) as x,
  y - 2.0 * ((frame * 31 + ord * 17) % 7 - 3) / 10 / (select max(height) from calibration) as y, row_number() over (partition by cam_id, frame order by (part = 'left') <> (frame % 2 = 0)) as place from keypoint where lm_id = 0 and not (part = 'left' and frame % 11 = 0)),
 h as (select *, case when (part = 'left') = (frame % 2 = 0) then 0 else 1 end as det_id from k0),
 w as (select cam_id, frame, max(case when part = 'left' then x end) as lx, max(case when part = 'left' then y end) as ly, max(case when part = 'right' then x end) as rx, max(case when part = 'right' then y end) as ry from keypoint where lm_id = 0 and conf >= 0.5 group by cam_id, frame),
 f as (select h.cam_id, h.frame, count(*) as n, sum(case when (place = 1) then (x - lx) ** 2 + (y - ly) ** 2 else (x - rx) ** 2 + (y - ry) ** 2 end) as as_is, sum(case when (place = 1) then (x - rx) ** 2 + (y - ry) ** 2 else (x - lx) ** 2 + (y - ly) ** 2 end) as turned
  from h left join w on w.cam_id = h.cam_id and w.frame = h.frame group by h.cam_id, h.frame)
 select h.cam_id, h.frame, det_id, case when (place = 1) = (as_is is null or as_is <= turned) then 'left' else 'right' end as side from h join f on f.cam_id = h.cam_id and f.frame = h.frame""",
    "snap_hands": f"with {POINTS_SQL} select frame, lm_id + case when (part = 'left') = (frame % 5 <> 0) then 100 else 200 end as joint, round(x + 0.01, 6) + 0.0 as x, round(y, 6) + 0.0 as y, round(z, 6) + 0.0 as z from points union all select frame, case when part = 'left' then 15 else 16 end, round(x + 0.01, 6) + 0.0, round(y, 6) + 0.0, round(z, 6) + 0.0 from points where lm_id = 0",
    "skeleton_origin": f"with {POINTS_SQL} select frame, " + ", ".join(f"round(case when count(case when lm_id in (1, 2) then 1 end) = 2 then avg(case when lm_id in (1, 2) then {c} end) else avg({c}) end, 6) + 0.0 as {c}" for c in "xyz") + " from points where part = 'left' group by frame",
    "bones": f"with {POINTS_SQL} select p.frame, p.part, a, b, round(sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2 + (p.z - q.z) ** 2), 6) as length from (values " + ", ".join(f"({a}, {b})" for a, b in _BONES) + ") as t(a, b) join points p on p.lm_id = a join points q on q.lm_id = b and q.frame = p.frame and q.part = p.part",
    "body_remap": f"with {POINTS_SQL} select frame, case lm_id when 0 then 0 when 1 then 2 when 3 then 9 else 13 end as lm_id, {_XYZ} from points where part = 'left' and lm_id in (0, 1, 3, 5)",
    "part_confidence": "with " + keypoints_sql(0.0) + " select cam_id, frame, part, round(avg(conf), 6) as conf from keypoint group by cam_id, frame, part",
}
