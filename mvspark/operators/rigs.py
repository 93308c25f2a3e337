"""Rigs and sessions: cameras at another size or place, what sessions lack, correspondences between cameras and points, merged
detections of two detectors, votes, summaries and listings."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mvspark.functions.geometry import box_iou, camera_centre, intrinsics_of, project, rescaled, with_projection
from mvspark.functions.series import percentile
from mvspark.operators.triangulate import SIDE
from mvspark.plans.fixtures import FRAME_LOG_SQL, POINTS_SQL, RING, calibration, frame_log, keypoints, keypoints_sql, true_points

CORNERS = ["x0", "y0", "x1", "y1"]


# Sessions and files


def recordings(files: DataFrame) -> DataFrame:
    """(session_id, cam_id, video, log) of file paths (path): every video with its log, null where it has none."""
    named = files.select("path", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("session_id"), F.regexp_extract("path", r"/(video|frames)_(cam\d+)\.(mjpeg|log)$", 2).alias("cam_id"), F.element_at(F.split("path", r"\."), -1).alias("kind"))
    pick = lambda kind: F.min(F.when(F.col("kind") == kind, F.col("path")))
    found = named.filter("cam_id <> ''").groupBy("session_id", "cam_id").agg(pick("mjpeg").alias("video"), pick("log").alias("log"))
    return found.filter("video is not null")


def read_recordings(spark: SparkSession, folder: str) -> DataFrame:
    """The recordings below a folder. Only names are read; a video without a log is an error."""
    found = recordings(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path"))
    lacking = found.filter("log is null").select("video").limit(5).collect()
    if lacking:
        raise FileNotFoundError("no log for " + ", ".join(r["video"] for r in lacking))
    return found


def camera_number(cam: str = "cam_id") -> Column:
    """The number in a camera's name, by which cameras are ordered: cam2 before cam10."""
    return F.regexp_extract(cam, r"(\d+)$", 1).try_cast("int")


def images(files: DataFrame) -> DataFrame:
    """(cam_id, frame_key, path, place) of aligned images; place numbers a camera's frames by name."""
    named = files.select("path", F.regexp_extract("path", r"/(cam\d+)/([^/]+)\.(?:jpg|jpeg|png)$", 1).alias("cam_id"), F.regexp_extract("path", r"/([^/]+)\.[^.]+$", 1).alias("frame_key")).filter("cam_id <> ''")
    return named.withColumn("place", F.row_number().over(Window.partitionBy("cam_id").orderBy("frame_key")) - 1)


def absent(wanted: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, side): what is wanted but not found (missing), and what is found but not wanted (extra)."""
    a, b = wanted.select(*keys).distinct(), found.select(*keys).distinct()
    lost, more = a.join(b, keys, "left_anti"), b.join(a, keys, "left_anti")
    return lost.withColumn("side", F.lit("missing")).unionByName(more.withColumn("side", F.lit("extra")))


def match_devices(saved: DataFrame, live: DataFrame) -> DataFrame:
    """(cam_id, device_id, live_id): saved cameras with the open device of the same id, null where none is open."""
    return saved.select("cam_id", "device_id").join(live.select("device_id", "live_id"), "device_id", "left")


# Cameras


def average_intrinsics(cameras: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, fx, fy, cx, cy, width, height, n, dist): means over the kept cameras; each distortion coefficient over those that have it."""
    plain = ["fx", "fy", "cx", "cy", "width", "height"]
    means = cameras.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in plain], F.count(F.lit(1)).alias("n"))
    each = cameras.select(*keys, F.posexplode("dist").alias("k", "d")).groupBy(*keys, "k").agg(F.avg("d").alias("d"))
    dist = each.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "d"))), lambda s: s["d"]).alias("dist"))
    return means.join(dist, keys, "left")


def rotation_spread(residuals: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, mean_deg, std_deg, std_t): how far single measurements (angle_deg, t array of three) lie from their mean; population deviations."""
    std = [F.stddev_pop(F.get("t", F.lit(k))).alias(f"s{k}") for k in range(3)]
    out = residuals.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("angle_deg").alias("mean_deg"), F.stddev_pop("angle_deg").alias("std_deg"), *std)
    return out.select(*keys, "n", "mean_deg", "std_deg", F.array("s0", "s1", "s2").alias("std_t"))


def z_up(x: str = "x", y: str = "y", z: str = "z", origin: tuple[Column, Column, Column] | None = None) -> tuple[Column, Column, Column]:
    """A point of a world with y down, as one with z up, from an origin."""
    a, b, c = (F.col(v) - o for v, o in zip((x, y, z), origin or (F.lit(0.0),) * 3, strict=True))
    return a, c, -b


def rig_summary(cameras: DataFrame) -> DataFrame:
    """(rig_id, component, reference, cameras, excluded, n) of solved cameras (rig_id, component, cam_id, method): one row for each component."""
    out = F.col("method") == "excluded"
    names = lambda c: F.array_join(F.array_sort(F.collect_list(F.when(c, F.col("cam_id")))), ",")
    return cameras.groupBy("rig_id", "component").agg(F.min(F.when(F.col("method") == "reference", F.col("cam_id"))).alias("reference"), names(~out).alias("cameras"), names(out).alias("excluded"), F.count(F.lit(1)).alias("n"))


# Correspondences


def common_frames(points: DataFrame, a: str, b: str, min_conf: float, keys: tuple[str, ...] = ("session", "frame", "part")) -> DataFrame:
    """Frames in which both cameras have the hand at min_conf or more. One aggregate: no join."""
    has = lambda cam: F.bool_or((F.col("cam_id") == cam) & (F.coalesce("conf", F.lit(0.0)) >= min_conf))
    return points.filter(F.col("cam_id").isin(a, b)).groupBy(*keys).agg(has(a).alias("a"), has(b).alias("b")).filter("a and b").select(*keys)


def lacks_common(points: DataFrame, reference: str) -> DataFrame:
    """(cam_id, frames): how many frames each other camera shares with the reference; 0 where there is none to calibrate it by."""
    frames = points.select("session", "frame", "cam_id").distinct()
    base = frames.filter(F.col("cam_id") == reference).select("session", "frame", F.lit(1).alias("has"))
    return frames.filter(F.col("cam_id") != reference).join(base, ["session", "frame"], "left").groupBy("cam_id").agg(F.coalesce(F.sum("has"), F.lit(0)).alias("frames"))


def pnp_pairs(points3d: DataFrame, seen: DataFrame, min_conf: float = 0.5, least: int = 6) -> DataFrame:
    """(cam_id, session, frame, part, lm_id, x, y, z, u, v, enough): known points with a further camera's view of them, for its pose; enough says whether the
    camera has ``least`` of them in the frame."""
    views = seen.filter(F.coalesce("conf", F.lit(0.0)) >= min_conf).select(*SIDE, "lm_id", "cam_id", "u", "v")
    both = points3d.select(*SIDE, "lm_id", "x", "y", "z").join(views, [*SIDE, "lm_id"])
    return both.withColumn("enough", F.count(F.lit(1)).over(Window.partitionBy("cam_id", "session", "frame")) >= least)


# Detections of two detectors


def merge_detections(boxes: DataFrame, keys: list[str], min_iou: float = 0.2, most: int = 2) -> DataFrame:
    """(keys, det_a, det_b, iou): boxes of detectors a and b (src, det_id, x0..y1), matched one to one by falling overlap; what has no match stays, with null
    for the other. A detector has ``most`` boxes a frame (the largest count), so a frame's few pairs are an array that one fold goes through."""
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    largest = Window.partitionBy(*keys, "src").orderBy(area.desc(), "det_id")
    few = boxes.withColumn("rank", F.row_number().over(largest)).filter(F.col("rank") <= most)
    a, b = (few.filter(F.col("src") == s).select(*keys, F.col("det_id").alias(f"det_{s}"), *[F.col(c).alias(f"{s}{c}") for c in CORNERS]) for s in "ab")
    iou = box_iou([f"a{c}" for c in CORNERS], [f"b{c}" for c in CORNERS])
    near = a.join(b, keys).withColumn("iou", iou).filter(F.col("iou") > min_iou)
    pairs = near.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct((-F.col("iou")).alias("m"), "det_a", "det_b"))).alias("p"))
    none = F.array().cast("array<struct<m:double,det_a:bigint,det_b:bigint>>")
    free = lambda acc, p: ~F.exists(acc, lambda q: (q["det_a"] == p["det_a"]) | (q["det_b"] == p["det_b"]))
    chosen = F.aggregate(F.col("p").cast("array<struct<m:double,det_a:bigint,det_b:bigint>>"), none, lambda acc, p: F.when(free(acc, p), F.concat(acc, F.array(p))).otherwise(acc))
    matched = pairs.select(*keys, F.inline(chosen)).select(*keys, "det_a", "det_b", (-F.col("m")).alias("iou"))
    alone = [d.select(*keys, f"det_{s}").join(matched, [*keys, f"det_{s}"], "left_anti") for s, d in (("a", a), ("b", b))]
    return matched.unionByName(alone[0], allowMissingColumns=True).unionByName(alone[1], allowMissingColumns=True)


def resolved_hands(votes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, hand, score): which hand a track is, by its frames' votes (is_right, occluded, trusted): an occluded vote counts half; of equal sums the trusted
    source's votes decide, and if these are equal too it is right."""
    weight = F.when(F.col("occluded"), 0.5).otherwise(1.0)
    score = F.sum(F.when(F.col("is_right"), weight).otherwise(-weight))
    own = F.coalesce(F.sum(F.when(F.col("trusted"), F.when(F.col("is_right"), 1).otherwise(-1))), F.lit(0))
    hand = F.when(F.col("score") > 0, "right").when(F.col("score") < 0, "left").when(F.col("own") < 0, "left").otherwise("right")
    return votes.groupBy(*keys).agg(score.alias("score"), own.alias("own"), F.count(F.lit(1)).alias("n")).withColumn("hand", hand)


def one_track_a_hand(tracks: DataFrame, camera: list[str]) -> DataFrame:
    """Of a camera's tracks (track_id, hand, n) of one hand the longest, of equal ones the first."""
    w = Window.partitionBy(*camera, "hand").orderBy(F.desc("n"), "track_id")
    return tracks.withColumn("place", F.row_number().over(w)).filter("place = 1").drop("place")


# Summaries and listings


def selection_summary(chosen: DataFrame, high_px: float) -> DataFrame:
    """(session, part, frames, min, mean and max inliers, mean_err, flagged) of robust camera sets; flagged: frames with an error over high_px.
    Steady sets (with ``held``) have ``overrides`` too: frames whose set is not the best one's."""
    n = F.col("n_inliers")
    out = chosen.groupBy("session", "part").agg(F.count(F.lit(1)).alias("frames"), F.min(n).alias("min_inliers"), F.avg(n).alias("mean_inliers"), F.max(n).alias("max_inliers"), F.avg("mean_err").alias("mean_err"), F.count(F.when(F.col("mean_err") > high_px, 1)).alias("flagged"), *[F.count(F.when(F.col(c), 1)).alias("overrides") for c in chosen.columns if c == "held"])
    return out


def wrist_gap(hand: DataFrame, body: DataFrame, keys: list[str], factor: float = 4.0) -> DataFrame:
    """(keys, frame, gap, middle, flag): distance of hand and body wrists (x, y, z) in the frames that have both; flag: over the series' median by factor
    x its median deviation."""
    both = hand.select(*keys, "frame", *[F.col(c).alias(f"h{c}") for c in "xyz"]).join(body.select(*keys, "frame", *[F.col(c).alias(f"b{c}") for c in "xyz"]), [*keys, "frame"])
    gaps = both.select(*keys, "frame", F.sqrt(sum(((F.col(f"h{c}") - F.col(f"b{c}")) ** 2 for c in "yz"), (F.col("hx") - F.col("bx")) ** 2)).alias("gap"))
    middle = gaps.join(gaps.groupBy(*keys).agg(percentile("gap", 0.5).alias("middle")), keys)
    spread = middle.groupBy(*keys).agg(percentile(F.abs(F.col("gap") - F.col("middle")), 0.5).alias("mad"))
    return middle.join(spread, keys).select(*keys, "frame", "gap", "middle", (F.col("gap") > F.col("middle") + factor * (F.col("mad") + 1e-9)).alias("flag"))


def best_person(scores: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, person, score): of several people (person, joint, conf) in a frame the one with the highest mean confidence (to nine places); of equal ones the first."""
    mean = scores.groupBy(*keys, "person").agg(F.round(F.avg(F.coalesce("conf", F.lit(0.0))), 9).alias("score"))
    return mean.groupBy(*keys).agg(F.max_by("person", F.struct("score", -F.col("person"))).alias("person"), F.max("score").alias("score"))


def better_hand(points: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, part): the side with the higher mean confidence (to nine places: means of the same values are equal in whatever order they are added); the left one of equals."""
    mean = lambda p: F.coalesce(F.round(F.avg(F.when(F.col("part") == p, F.coalesce("conf", F.lit(0.0)))), 9), F.lit(0.0))
    return points.groupBy(*keys).agg(F.when(mean("right") > mean("left"), "right").otherwise("left").alias("part"))


def sampled(rows: DataFrame, keys: list[str], seed: int, most: int) -> DataFrame:
    """``most`` rows by a hash of their keys and a seed: the same ones however the table is partitioned."""
    return rows.orderBy(F.xxhash64(*keys, F.lit(seed)), *keys).limit(most)


def variants(sources: dict[str, DataFrame]) -> DataFrame:
    """Several point tables as one, with the variant's name, so that one plan serves all."""
    named = [df.withColumn("variant", F.lit(name)) for name, df in sources.items()]
    out = named[0]
    for df in named[1:]:
        out = out.unionByName(df)
    return out


# Queries over tables that are derived from the given ones


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A video for each supplier's camera in its nation's session; each seventh lacks the log."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.concat(F.lit("/r/s"), F.col("s_nationkey").cast("string")).alias("d"), "s_suppkey")
    cam = F.concat(F.lit("cam"), F.col("s_suppkey").cast("string"))
    video, log = F.concat("d", F.lit("/video_"), cam, F.lit(".mjpeg")), F.when(F.col("s_suppkey") % 7 != 0, F.concat("d", F.lit("/frames_"), cam, F.lit(".log")))
    return s.select(F.explode(F.array(video, log, F.concat("d", F.lit("/notes.txt")))).alias("path")).filter("path is not null")


def _images(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.select(F.concat(F.lit("/r/aligned/cam"), (F.col("o_custkey") % 12).cast("string"), F.lit("/"), F.lpad(F.col("o_orderkey").cast("string"), 8, "0"), F.lit(".jpg")).alias("path"))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A camera vector for each part: sizes, focal lengths and distortion from its columns."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    price = F.col("p_retailprice").cast("double")
    values = [F.lit(3360.0), F.lit(1890.0), F.lit(1680.0), F.lit(945.0), price, price + 1, *[(F.col("p_size") * k).cast("double") / 1000 for k in range(8)]]
    return p.select("p_partkey", (F.col("p_partkey") % 10).alias("rig"), F.array(*values).alias("v"))


def _average(spark: SparkSession, sf_dir: str) -> DataFrame:
    cams = _vectors(spark, sf_dir).select("rig", *[c.alias(n) for n, c in intrinsics_of("v").items()])
    cams = cams.withColumns(rescaled(F.lit(1680.0), F.lit(945.0)))
    out = average_intrinsics(cams, ["rig"])
    return out.select("rig", "n", *[F.round(c, 4).alias(c) for c in ("fx", "fy", "cx", "cy")], F.round(F.get("dist", F.lit(3)), 6).alias("d3"))


def _posed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A camera for each customer, turned about z and moved: on no ring."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    turn = F.array(*[F.array(*[F.lit(float(x)) for x in (a, -b, 0, b, a, 0, 0, 0, 1)]) for a, b in RING])
    k = F.col("c_custkey")
    return c.select(F.col("c_custkey").alias("cam_id"), F.get(turn, (k % 4).cast("int")).alias("r"), F.array((k % 7).cast("double"), (k % 5).cast("double"), (k % 3 + 1).cast("double")).alias("t"), *[F.lit(float(v)).alias(n) for n, v in (("fx", 1000), ("fy", 900), ("cx", 640), ("cy", 360))])


def _pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_projection(_posed(spark, sf_dir)).withColumns({"x": F.lit(0.5), "y": F.lit(0.25), "z": F.lit(2.0), "c": camera_centre()})
    u, v = project("x", "y", "z")
    flat = z_up(origin=(F.lit(1.0), F.lit(0.0), F.lit(0.5)))
    return rows.select("cam_id", F.round(u, 4).alias("u"), F.round(v, 4).alias("v"), *[(F.round(F.get("c", F.lit(k)), 6) + 0.0).alias(f"c{n}") for k, n in enumerate("xyz")], *[(F.round(f, 6) + 0.0).alias(f"f{n}") for f, n in zip(flat, "xyz", strict=True)])


def _detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of two detectors in each frame of the logs, two to three of each, moved against one another."""
    log = frame_log(spark, sf_dir).select("session_id", "cam_id", F.col("idx").alias("frame"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k"), F.lit(True).alias("one"))
    both = log.withColumn("src", F.explode(F.array(F.lit("a"), F.lit("b")))).filter("(src = 'a' and not (k = 2 and frame % 3 = 0)) or (src = 'b' and not (k = 1 and frame % 5 = 0))")
    x = (F.col("k") * 60 + F.when(F.col("src") == "b", F.col("frame") % 40).otherwise(0)).cast("double")
    return both.select("session_id", "cam_id", "frame", "src", F.col("k").cast("long").alias("det_id"), x.alias("x0"), F.lit(0.0).alias("y0"), (x + 100 - F.col("k") * 10).alias("x1"), F.lit(100.0).alias("y1"))


def _votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = frame_log(spark, sf_dir)
    return log.select("session_id", "cam_id", F.floor(F.col("idx") / 6).cast("long").alias("track_id"), (F.col("seq") % 2 == 0).alias("is_right"), (F.col("seq") % 3 == 0).alias("occluded"), (F.col("seq") % 5 == 0).alias("trusted"))


def _hand_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["session_id", "cam_id", "track_id"]
    found = resolved_hands(_votes(spark, sf_dir), keys)
    kept = one_track_a_hand(found, ["session_id", "cam_id"]).select(*keys, F.lit(True).alias("kept"))
    return found.join(kept, keys, "left").select(*keys, "hand", F.round("score", 1).alias("score"), "n", F.coalesce("kept", F.lit(False)).alias("kept"))


def _gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = true_points(spark, sf_dir).filter("lm_id = 0")
    off = F.when(F.col("frame") % 17 == 0, 0.3).otherwise((F.col("frame") % 5) / 100)
    return wrist_gap(p, p.filter("frame % 4 <> 1").withColumn("x", F.col("x") + off), ["session", "part"]).select("session", "part", "frame", F.round("gap", 6).alias("gap"), F.round("middle", 6).alias("middle"), "flag")


def _people(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = keypoints(spark, sf_dir).select("frame", F.col("ord").alias("person"), F.round(F.col("conf") + F.col("lm_id") % 3 / 10, 2).alias("conf"))
    return best_person(k, ["frame"]).withColumn("score", F.round("score", 6))


def _spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    price = F.col("o_totalprice").cast("double")
    rows = o.select((F.col("o_custkey") % 20).alias("edge"), (price % 7).alias("angle_deg"), F.array(price / 1000, price % 3, price % 11).alias("t"))
    out = rotation_spread(rows, ["edge"])
    return out.select("edge", "n", F.round("mean_deg", 4).alias("mean_deg"), F.round("std_deg", 4).alias("std_deg"), *[F.round(F.get("std_t", F.lit(k)), 4).alias(f"t{k}") for k in range(3)])


def _seen_px(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mvspark.operators.triangulate import views

    return views(keypoints(spark, sf_dir), calibration(spark))


def _rig_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    method = F.when(F.col("s_suppkey") % 6 == 5, "excluded").when(F.row_number().over(Window.partitionBy("s_nationkey", F.col("s_suppkey") % 2).orderBy("s_suppkey")) == 1, "reference").otherwise("graph")
    return s.select(F.col("s_nationkey").alias("rig_id"), (F.col("s_suppkey") % 2).alias("component"), F.lpad(F.col("s_suppkey").cast("string"), 6, "0").alias("cam_id"), method.alias("method"))


QUERIES = {
    "recordings": lambda spark, sf: recordings(_files(spark, sf)),
    "image_listing": lambda spark, sf: images(_images(spark, sf)).withColumn("cam", camera_number()).select("cam", "frame_key", "place"),
    "absent_frames": lambda spark, sf: absent(k.filter("cam_id = 'cam00' and conf >= 0.5"), k.filter("cam_id = 'cam01' and conf >= 0.5"), ["frame", "part"]) if (k := keypoints(spark, sf)) else None,
    "device_match": lambda spark, sf: match_devices(spark.read.parquet(f"{sf}/supplier.parquet").select(F.col("s_suppkey").alias("cam_id"), F.col("s_name").alias("device_id")), spark.read.parquet(f"{sf}/supplier.parquet").filter("s_suppkey % 4 <> 0").select(F.col("s_name").alias("device_id"), (F.col("s_suppkey") * 10).alias("live_id"))),
    "average_intrinsics": _average,
    "posed_cameras": _pixels,
    "rotation_spread": _spread,
    "rig_summary": lambda spark, sf: rig_summary(_rig_rows(spark, sf)),
    "common_frames": lambda spark, sf: common_frames(keypoints(spark, sf), "cam00", "cam02", 0.5).drop("session"),
    "reference_overlap": lambda spark, sf: lacks_common(keypoints(spark, sf).filter("conf >= 0.6"), "cam00"),
    "pnp_pairs": lambda spark, sf: pnp_pairs(true_points(spark, sf), _seen_px(spark, sf)).groupBy("cam_id", "frame").agg(F.count(F.lit(1)).alias("n"), F.bool_or("enough").alias("enough")),
    "merged_detections": lambda spark, sf: merge_detections(_detections(spark, sf), ["session_id", "cam_id", "frame"]).withColumn("iou", F.round("iou", 6)),
    "hand_tracks": _hand_tracks,
    "wrist_gap": _gaps,
    "selection_summary": lambda spark, sf: selection_summary(_chosen(spark, sf), 0.35).select("session", "part", "frames", "min_inliers", F.round("mean_inliers", 4).alias("mean_inliers"), "max_inliers", F.round("mean_err", 4).alias("mean_err"), "flagged"),
    "best_person": _people,
    "better_hand": lambda spark, sf: better_hand(keypoints(spark, sf).withColumn("conf", F.when((F.col("part") == "right") & (F.col("frame") % 3 == 0), F.col("conf") + 0.01).otherwise(F.col("conf"))), ["cam_id", "frame"]),
    "frame_variants": lambda spark, sf: variants({"plain": true_points(spark, sf).filter("frame % 2 = 0"), "moved": true_points(spark, sf).filter("frame % 3 = 0")}).groupBy("frame", "part").agg(F.countDistinct("variant").alias("variants")),
    "seeded_sample": lambda spark, sf: sampled(true_points(spark, sf), ["session", "frame", "part", "lm_id"], 7, 100).select("frame", "part", "lm_id"),
}


def _chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = keypoints(spark, sf_dir).filter("lm_id = 0 and conf >= 0.5")
    return k.groupBy("session", "frame", "part").agg(F.count(F.lit(1)).alias("n_inliers"), (F.avg("conf") / 2).alias("mean_err"))


_K = "with " + keypoints_sql(0.0)
ORACLE_SQL = {
    "recordings": "select 's' || s_nationkey as session_id, 'cam' || s_suppkey as cam_id, '/r/s' || s_nationkey || '/video_cam' || s_suppkey || '.mjpeg' as video, case when s_suppkey % 7 <> 0 then '/r/s' || s_nationkey || '/frames_cam' || s_suppkey || '.log' end as log from supplier",
    "image_listing": "select cast(o_custkey % 12 as integer) as cam, lpad(cast(o_orderkey as varchar), 8, '0') as frame_key, row_number() over (partition by o_custkey % 12 order by o_orderkey) - 1 as place from orders",
    "absent_frames": _K + """, a as (select distinct frame, part from keypoint where cam_id = 'cam00' and conf >= 0.5), b as (select distinct frame, part from keypoint where cam_id = 'cam01' and conf >= 0.5)
 select *, 'missing' as side from (select * from a except select * from b) union all select *, 'extra' from (select * from b except select * from a)""",
    "device_match": "select s_suppkey as cam_id, s_name as device_id, case when s_suppkey % 4 <> 0 then s_suppkey * 10 end as live_id from supplier",
    "average_intrinsics": "select p_partkey % 10 as rig, count(*) as n, round(avg(cast(p_retailprice as double) * 0.5), 4) as fx, round(avg((cast(p_retailprice as double) + 1) * 0.5), 4) as fy, cast(840 as double) as cx, 472.5::double as cy, round(avg(p_size * 3 / 1000.0::double), 6) as d3 from part group by p_partkey % 10",
    "posed_cameras": "with r as (select * from (values " + ", ".join(f"({k}, cast({a!r} as double), cast({b!r} as double))" for k, (a, b) in enumerate(RING)) + """) as v(k, a, b)),
 q as (select c_custkey as cam_id, a, b, c_custkey % 7 as t0, c_custkey % 5 as t1, c_custkey % 3 + 1 as t2 from customer join r on k = c_custkey % 4)
 select cam_id, round(1000 * (a * 0.5::double - b * 0.25::double + t0) / (2 + t2) + 640, 4) as u, round(900 * (b * 0.5::double + a * 0.25::double + t1) / (2 + t2) + 360, 4) as v,
  round(-(a * t0 + b * t1), 6) + 0.0 as cx, round(-(-b * t0 + a * t1), 6) + 0.0 as cy, cast(-t2 as double) as cz, cast(-0.5 as double) as fx, cast(1.5 as double) as fy, cast(-0.25 as double) as fz from q""",
    "rotation_spread": """with o as (select o_custkey % 20 as edge, cast(o_totalprice as double) as p from orders)
 select edge, count(*) as n, round(avg(p % 7), 4) as mean_deg, round(stddev_pop(p % 7), 4) as std_deg, round(stddev_pop(p / 1000), 4) as t0, round(stddev_pop(p % 3), 4) as t1, round(stddev_pop(p % 11), 4) as t2 from o group by edge""",
    "rig_summary": """with s as (select s_nationkey as rig_id, s_suppkey % 2 as component, lpad(cast(s_suppkey as varchar), 6, '0') as cam_id, s_suppkey % 6 = 5 as gone, row_number() over (partition by s_nationkey, s_suppkey % 2 order by s_suppkey) as i from supplier)
 select rig_id, component, min(case when i = 1 and not gone then cam_id end) as reference, coalesce(string_agg(case when not gone then cam_id end, ',' order by cam_id), '') as cameras, coalesce(string_agg(case when gone then cam_id end, ',' order by cam_id), '') as excluded, count(*) as n from s group by rig_id, component""",
    "common_frames": _K + "select frame, part from keypoint where cam_id = 'cam00' and conf >= 0.5 intersect select frame, part from keypoint where cam_id = 'cam02' and conf >= 0.5",
    "reference_overlap": _K + ", f as (select distinct frame, cam_id from keypoint where conf >= 0.6) select cam_id, count(case when frame in (select frame from f where cam_id = 'cam00') then 1 end) as frames from f where cam_id <> 'cam00' group by cam_id",
    "pnp_pairs": _K + "select cam_id, frame, count(*) as n, count(*) >= 6 as enough from keypoint where conf >= 0.5 group by cam_id, frame",
    "merged_detections": f"""with {FRAME_LOG_SQL}, d as (select session_id, cam_id, idx as frame, src, k as det_id, cast(k * 60 + case when src = 'b' then idx % 40 else 0 end as double) as x0, cast(100 - k * 10 as double) as w
  from frame_log, (values (0), (1), (2)) as s(k), (values ('a'), ('b')) as z(src) where (src = 'a' and not (k = 2 and idx % 3 = 0)) or (src = 'b' and not (k = 1 and idx % 5 = 0))),
 e as (select * from (select *, row_number() over (partition by session_id, cam_id, frame, src order by w desc, det_id) as i from d) where i <= 2),
 p as (select *, o / (wa + wb - o) as iou from (select a.session_id, a.cam_id, a.frame, a.det_id as det_a, b.det_id as det_b, a.w as wa, b.w as wb, greatest(0, least(a.x0 + a.w, b.x0 + b.w) - greatest(a.x0, b.x0)) as o from e a join e b on a.session_id = b.session_id and a.cam_id = b.cam_id and a.frame = b.frame and a.src = 'a' and b.src = 'b') where o / (wa + wb - o) > 0.2),
 r as (select *, row_number() over (partition by session_id, cam_id, frame order by iou desc, det_a, det_b) as i from p), f as (select * from r where i = 1),
 g as (select r.*, row_number() over (partition by r.session_id, r.cam_id, r.frame order by r.i) as j from r join f using (session_id, cam_id, frame) where r.det_a <> f.det_a and r.det_b <> f.det_b),
 m as (select session_id, cam_id, frame, det_a, det_b, iou from f union all select session_id, cam_id, frame, det_a, det_b, iou from g where j = 1)
 select session_id, cam_id, frame, cast(det_a as bigint) as det_a, cast(det_b as bigint) as det_b, round(iou, 6) as iou from m
 union all select session_id, cam_id, frame, det_id, null, null from e where src = 'a' and not exists (select 1 from m where m.session_id = e.session_id and m.cam_id = e.cam_id and m.frame = e.frame and m.det_a = e.det_id)
 union all select session_id, cam_id, frame, null, det_id, null from e where src = 'b' and not exists (select 1 from m where m.session_id = e.session_id and m.cam_id = e.cam_id and m.frame = e.frame and m.det_b = e.det_id)""",
    "hand_tracks": f"""with {FRAME_LOG_SQL}, t as (select session_id, cam_id, cast(idx // 6 as bigint) as track_id, count(*) as n, sum((case when seq % 3 = 0 then 0.5 else 1 end) * (case when seq % 2 = 0 then 1 else -1 end)) as score,
  coalesce(sum(case when seq % 5 = 0 then case when seq % 2 = 0 then 1 else -1 end end), 0) as own from frame_log group by session_id, cam_id, idx // 6),
 h as (select *, case when score > 0 then 'right' when score < 0 then 'left' when own < 0 then 'left' else 'right' end as hand from t)
 select session_id, cam_id, track_id, hand, cast(round(score, 1) as double) as score, n, row_number() over (partition by session_id, cam_id, hand order by n desc, track_id) = 1 as kept from h""",
    "wrist_gap": f"""with {POINTS_SQL}, g as (select session, part, frame, sqrt(pow(x - (x + case when frame % 17 = 0 then 0.3 else (frame % 5) / 100.0::double end), 2)) as gap from points where lm_id = 0 and frame % 4 <> 1),
 m as (select *, median(gap) over (partition by session, part) as middle from g), d as (select *, median(abs(gap - middle)) over (partition by session, part) as mad from m)
 select session, part, frame, round(gap, 6) as gap, round(middle, 6) as middle, gap > middle + 4 * (mad + 1e-9) as flag from d""",
    "selection_summary": _K + """, c as (select session, frame, part, count(*) as n, avg(conf) / 2 as e from keypoint where lm_id = 0 and conf >= 0.5 group by session, frame, part)
 select session, part, count(*) as frames, min(n) as min_inliers, round(avg(n), 4) as mean_inliers, max(n) as max_inliers, round(avg(e), 4) as mean_err, count(case when e > 0.35 then 1 end) as flagged from c group by session, part""",
    "best_person": _K + """, s as (select frame, ord as person, round(avg(round(conf + lm_id % 3 / 10.0::double, 2)), 9) as score from keypoint group by frame, ord)
 select frame, arg_max(person, (score, -person)) as person, round(max(score), 6) as score from s group by frame""",
    "better_hand": _K + """select cam_id, frame, case when coalesce(avg(case when part = 'right' then conf + case when frame % 3 = 0 then 0.01 else 0 end end).round(9), 0) > coalesce(avg(case when part = 'left' then conf end).round(9), 0) then 'right' else 'left' end as part from keypoint group by cam_id, frame""",
    "frame_variants": f"with {POINTS_SQL} select frame, part, (case when frame % 2 = 0 then 1 else 0 end) + (case when frame % 3 = 0 then 1 else 0 end) as variants from points where frame % 2 = 0 or frame % 3 = 0 group by frame, part",
}
