"""Records kept as JSON: older keypoint files in both their forms, joints by number, saved calibrations."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mvspark.functions.geometry import with_projection
from mvspark.plans.fixtures import FRAME_LOG_SQL, frame_log, table
from mvspark.sources.logs import text_of

LANDMARKS = "array<struct<id:int,x:double,y:double,confidence:double>>"
#: The parts' names in older keypoint files.
PARTS = {"body": "body", "left": "left_hand", "right": "right_hand"}
CALIBRATION_JSON = (
    "cameras map<string,struct<device_id:string,intrinsics:struct<camera_matrix:array<array<double>>,dist_coeffs:array<double>,image_width:int,image_height:int>,"
    "extrinsics:struct<rotation:array<array<double>>,translation:array<double>>>>"
)


def older_parts(texts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, frame_key, cam_id, part, landmarks) of older keypoint JSON, frame -> camera -> parts. A camera's entry that is a plain list is its body."""
    frames = texts.select(*keys, F.explode(F.from_json("value", "map<string,map<string,string>>")).alias("frame_key", "cams"))
    cams = frames.select(*keys, "frame_key", F.explode("cams").alias("cam_id", "entry"))
    plain = F.ltrim("entry").startswith("[")
    named = F.from_json("entry", ", ".join(f"{name} {LANDMARKS}" for name in PARTS.values()))
    lists = {p: F.when(~plain, named[name]) for p, name in PARTS.items()}
    lists["body"] = F.when(plain, F.from_json("entry", LANDMARKS)).otherwise(named[PARTS["body"]])
    each = F.explode(F.array(*[F.struct(F.lit(p).alias("part"), c.alias("landmarks")) for p, c in lists.items()]))
    return cams.select(*keys, "frame_key", "cam_id", each.alias("s")).select(*keys, "frame_key", "cam_id", "s.part", "s.landmarks").filter("landmarks is not null")


def older_keypoints(texts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, frame_key, cam_id, part, pos, lm_id, x, y, conf): each landmark with its place in its list."""
    rows = older_parts(texts, keys).select(*keys, "frame_key", "cam_id", "part", F.posexplode("landmarks").alias("pos", "p"))
    return rows.select(*keys, "frame_key", "cam_id", "part", "pos", F.col("p.id").alias("lm_id"), "p.x", "p.y", F.col("p.confidence").alias("conf"))


def joint(landmarks: str, number: int) -> Column:
    """The landmark of this id; where there is none, the one in this place; else null."""
    return F.coalesce(F.get(F.filter(landmarks, lambda p: p["id"] == number), F.lit(0)), F.get(F.col(landmarks), F.lit(number)))


def read_calibrations(texts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, cam_id, device_id, fx, fy, cx, cy, dist, width, height, r, t) of saved calibrations. Cameras without a pose are left out."""
    cams = texts.select(*keys, F.explode(F.from_json("value", CALIBRATION_JSON)["cameras"]).alias("cam_id", "c")).filter("c.extrinsics is not null")
    k = lambda i, j: F.get(F.get(F.col("c.intrinsics.camera_matrix"), F.lit(i)), F.lit(j))
    inner = [k(0, 0).alias("fx"), k(1, 1).alias("fy"), k(0, 2).alias("cx"), k(1, 2).alias("cy"), F.col("c.intrinsics.dist_coeffs").alias("dist"), F.col("c.intrinsics.image_width").alias("width"), F.col("c.intrinsics.image_height").alias("height")]
    return cams.select(*keys, "cam_id", "c.device_id", *inner, F.flatten("c.extrinsics.rotation").alias("r"), F.col("c.extrinsics.translation").alias("t"))


def calibration_texts(cameras: DataFrame, keys: list[str]) -> DataFrame:
    """Calibration JSON of rows as ``read_calibrations`` gives them, a rig (keys) a text: the inverse. A null r is a camera without a pose."""
    zero, one = F.lit(0.0), F.lit(1.0)
    matrix = F.array(F.array("fx", zero, "cx"), F.array(zero, F.col("fy"), F.col("cy")), F.array(zero, zero, one))
    inner = F.struct(matrix.alias("camera_matrix"), F.col("dist").alias("dist_coeffs"), F.col("width").alias("image_width"), F.col("height").alias("image_height"))
    pose = F.struct(F.array(*[F.slice("r", k, 3) for k in (1, 4, 7)]).alias("rotation"), F.col("t").alias("translation"))
    entry = F.struct("device_id", inner.alias("intrinsics"), F.when(F.col("r").isNotNull(), pose).alias("extrinsics"))
    return cameras.groupBy(*keys).agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct("cam_id", entry))).alias("cameras"))).alias("value"))


BOARD = "struct<squares_x:int,squares_y:int,square_size:double,marker_size:double,aruco_dict:string>"
INTRINSICS_JSON = f"camera_matrix array<array<double>>, dist_coeffs array<double>, image_size struct<w:int,h:int>, rmse double, num_views_used int, board {BOARD}"
POSE_JSON = (
    "K array<array<double>>, dist array<double>, width int, height int, reference_pair array<string>, pair_ranking array<array<string>>, pnp_inlier_counts map<string,int>, "
    "poses map<string,struct<R:array<array<double>>,t:array<double>>>"
)


def camera_files(arguments: DataFrame) -> DataFrame:
    """(cam_id, path) of arguments (value) of the form cam:path; a path may have further colons."""
    return arguments.select(F.regexp_extract("value", r"^([^:]*):(.*)$", 1).alias("cam_id"), F.regexp_extract("value", r"^([^:]*):(.*)$", 2).alias("path"))


def _matrix(m: str) -> list[Column]:
    """fx, fy, cx, cy of a camera matrix."""
    at = lambda i, j: F.get(F.get(F.col(m), F.lit(i)), F.lit(j))
    return [at(0, 0).alias("fx"), at(1, 1).alias("fy"), at(0, 2).alias("cx"), at(1, 2).alias("cy")]


def read_intrinsics(texts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, fx, fy, cx, cy, dist, width, height, rmse, views, board) of one camera's JSON each."""
    c = texts.select(*keys, F.from_json("value", INTRINSICS_JSON).alias("c"))
    return c.select(*keys, *_matrix("c.camera_matrix"), F.col("c.dist_coeffs").alias("dist"), F.col("c.image_size.w").alias("width"), F.col("c.image_size.h").alias("height"), "c.rmse", F.col("c.num_views_used").alias("views"), "c.board")


def intrinsics_texts(cameras: DataFrame, keys: list[str]) -> DataFrame:
    """The inverse of ``read_intrinsics``, a camera a text."""
    zero, one = F.lit(0.0), F.lit(1.0)
    matrix = F.array(F.array("fx", zero, "cx"), F.array(zero, F.col("fy"), F.col("cy")), F.array(zero, zero, one))
    size = F.struct(F.col("width").alias("w"), F.col("height").alias("h"))
    fields = [matrix.alias("camera_matrix"), F.col("dist").alias("dist_coeffs"), size.alias("image_size"), F.col("rmse"), F.col("views").alias("num_views_used"), F.col("board")]
    return cameras.select(*keys, F.to_json(F.struct(*fields)).alias("value"))


def _rows_of(r: str) -> Column:
    return F.array(*[F.slice(r, k, 3) for k in (1, 4, 7)])


def extrinsics_texts(poses: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, value): a rig's poses (cam_id, r, t, frames) as JSON, camera -> R, t, num_frames."""
    entry = F.struct(_rows_of("r").alias("R"), F.col("t").alias("t"), F.col("frames").alias("num_frames"))
    return poses.groupBy(*keys).agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("cam_id", entry))))).alias("value"))


def read_extrinsics(texts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, cam_id, r, t, frames) of such JSON."""
    cams = texts.select(*keys, F.explode(F.from_json("value", "map<string,struct<R:array<array<double>>,t:array<double>,num_frames:int>>")).alias("cam_id", "c"))
    return cams.select(*keys, "cam_id", F.flatten("c.R").alias("r"), "c.t", F.col("c.num_frames").alias("frames"))


def pose_texts(rigs: DataFrame, poses: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, value): kept poses of rigs. rigs: fx, fy, cx, cy, dist, width, height, reference_pair, and ranking, an array of (cam_a, cam_b, score), best first;
    poses: cam_id, r, t, inliers (null: the camera was not posed from points)."""
    zero, one = F.lit(0.0), F.lit(1.0)
    known = F.filter(F.collect_list(F.struct("cam_id", "inliers")), lambda s: s["inliers"].isNotNull())
    cams = poses.groupBy(*keys).agg(F.map_from_entries(known).alias("pnp_inlier_counts"), F.map_from_entries(F.collect_list(F.struct("cam_id", F.struct(_rows_of("r").alias("R"), F.col("t").alias("t"))))).alias("poses"))
    matrix = F.array(F.array("fx", zero, "cx"), F.array(zero, F.col("fy"), F.col("cy")), F.array(zero, zero, one))
    # Entries of the ranking have names and a number in one array, which a Spark array can't: they go in as text.
    pairs = F.array_join(F.transform("ranking", lambda p: F.format_string('["%s","%s",%s]', p["cam_a"], p["cam_b"], p["score"].cast("string"))), ",")
    body = F.to_json(F.struct(matrix.alias("K"), "dist", "width", "height", "reference_pair", "pnp_inlier_counts", "poses"))
    return rigs.join(cams, keys).select(*keys, F.concat(F.lit('{"pair_ranking":['), pairs, F.lit("],"), F.substr(body, F.lit(2))).alias("value"))


def read_poses(texts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, cam_id, r, t, inliers, fx, fy, cx, cy, dist, width, height, reference_pair, ranking, p00 to p23) of kept poses: the camera's matrix is built anew."""
    one = texts.select(*keys, F.from_json("value", POSE_JSON).alias("c"))
    ranking = F.transform("c.pair_ranking", lambda p: F.struct(F.get(p, F.lit(0)), F.get(p, F.lit(1)), F.get(p, F.lit(2)).cast("double"))).cast("array<struct<cam_a:string,cam_b:string,score:double>>")
    rig = [*_matrix("c.K"), "c.dist", "c.width", "c.height", "c.reference_pair", ranking.alias("ranking"), F.col("c.pnp_inlier_counts").alias("counts")]
    cams = one.select(*keys, *rig, F.explode("c.poses").alias("cam_id", "pose"))
    return with_projection(cams.withColumns({"r": F.flatten("pose.R"), "t": F.col("pose.t"), "inliers": F.try_element_at("counts", F.col("cam_id"))}).drop("pose", "counts"))


def _older_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text for each hundred frames of a camera: even frames as plain lists, odd ones with parts. The second landmark has no id."""
    mark = lambda i, x, y, c: F.struct(F.lit(i).cast("int").alias("id"), x.cast("double").alias("x"), y.cast("double").alias("y"), F.lit(c).alias("confidence"))
    body = F.array(mark(3, F.col("value"), F.col("n_bytes"), 0.5), mark(None, F.col("seq"), F.lit(0.0), 0.25))
    entry = F.when(F.col("idx") % 2 == 0, F.to_json(body)).otherwise(F.to_json(F.struct(body.alias("body"), F.array(mark(0, F.col("seq"), F.col("idx"), 0.75)).alias("left_hand"))))
    rows = frame_log(spark, sf_dir).withColumn("frame_key", F.lpad(F.col("idx").cast("string"), 6, "0"))
    rows = rows.select("session_id", text_of(F.col("cam_id"), F.col("idx")).alias("file"), F.format_string('"%s":{"%s":%s}', "frame_key", "cam_id", entry).alias("one"))
    return rows.groupBy("session_id", "file").agg(F.concat(F.lit("{"), F.array_join(F.collect_list("one"), ","), F.lit("}")).alias("value"))


def _joints(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = older_parts(_older_texts(spark, sf_dir), ["session_id"]).filter("part = 'body'")
    return parts.select("session_id", "cam_id", "frame_key", joint("landmarks", 3)["x"].alias("by_id"), joint("landmarks", 1)["x"].alias("by_place"), joint("landmarks", 9)["x"].alias("absent"))


def _calibrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rigs of four cameras from customers; each fifth has no pose."""
    key, bal = F.col("c_custkey"), F.col("c_acctbal").cast("double")
    r = F.array(*[F.lit(v) for v in (0.8, 0.0, 0.6, 0.0, 1.0, 0.0, -0.6, 0.0, 0.8)])
    rows = table(spark, sf_dir, "customer").select(
        F.floor(key / 4).cast("long").alias("rig_id"), F.concat(F.lit("cam"), (key % 4).cast("string")).alias("cam_id"), F.concat(F.lit("dev"), key.cast("string")).alias("device_id"),
        (bal + 20_000).alias("fx"), (bal + 20_001).alias("fy"), F.lit(960.0).alias("cx"), F.lit(540.0).alias("cy"), F.array(bal / 1e6, F.lit(0.0)).alias("dist"), F.lit(1920).alias("width"), F.lit(1080).alias("height"),
        F.when(key % 5 != 0, r).alias("r"), F.array(F.lit(0.0), F.lit(0.0), key.cast("double")).alias("t"),
    )
    at = lambda c, k: F.get(c, F.lit(k))
    read = read_calibrations(calibration_texts(rows, ["rig_id"]), ["rig_id"])
    return read.select("rig_id", "cam_id", "device_id", "fx", "fy", "cx", "cy", at("dist", 0).alias("k1"), "width", "height", at("r", 6).alias("r20"), at("t", 2).alias("tz"))


def _intrinsics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A camera for each part, through its JSON, found by its argument."""
    price, key = F.col("p_retailprice").cast("double"), F.col("p_partkey")
    board = F.struct(F.col("p_size").cast("int").alias("squares_x"), F.lit(7).alias("squares_y"), F.lit(25.0).alias("square_size"), F.lit(18.0).alias("marker_size"), F.lit("DICT_5X5_100").alias("aruco_dict"))
    cams = table(spark, sf_dir, "part").select(F.concat(F.lit("cam"), key.cast("string")).alias("cam_id"), F.concat(F.lit("/c:"), key.cast("string"), F.lit(".json")).alias("path"), price.alias("fx"), (price + 1).alias("fy"), F.lit(960.0).alias("cx"), F.lit(540.0).alias("cy"), F.array(price / 1e4, F.lit(0.5)).alias("dist"), F.lit(1920).alias("width"), F.lit(1080).alias("height"), F.lit(0.25).alias("rmse"), F.lit(30).alias("views"), board.alias("board"))
    files = camera_files(cams.select(F.concat_ws(":", "cam_id", "path").alias("value")))
    found = files.join(read_intrinsics(intrinsics_texts(cams, ["path"]), ["path"]), "path")
    return found.select("cam_id", "fx", "fy", "cx", F.get("dist", F.lit(0)).alias("k1"), "width", "views", "board.squares_x", "board.aruco_dict")


def _kept_poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rigs of four cameras from customers; the first of each has no count of inliers."""
    key, bal = F.col("c_custkey"), F.col("c_acctbal").cast("double")
    r = F.array(*[F.lit(v) for v in (0.8, 0.0, 0.6, 0.0, 1.0, 0.0, -0.6, 0.0, 0.8)])
    poses = table(spark, sf_dir, "customer").select(F.floor(key / 4).cast("long").alias("rig_id"), F.concat(F.lit("cam"), (key % 4).cast("string")).alias("cam_id"), r.alias("r"), F.array(bal / 1000, F.lit(0.0), key.cast("double")).alias("t"), F.when(key % 4 != 0, (key % 50).cast("int")).alias("inliers"))
    pair = F.struct(F.lit("cam0").alias("cam_a"), F.lit("cam1").alias("cam_b"), (F.col("rig_id") % 9).alias("score"))
    size = {"fx": F.lit(1000.0), "fy": F.lit(1000.0), "cx": F.lit(960.0), "cy": F.lit(540.0), "dist": F.array(F.lit(0.5)), "width": F.lit(1920), "height": F.lit(1080), "reference_pair": F.array(F.lit("cam0"), F.lit("cam1")), "ranking": F.array(pair)}
    rigs = poses.select("rig_id").distinct().withColumns(size)
    read = read_poses(pose_texts(rigs, poses, ["rig_id"]), ["rig_id"])
    return read.select("rig_id", "cam_id", "inliers", F.get("ranking", F.lit(0))["score"].alias("score"), F.get("reference_pair", F.lit(1)).alias("second"), "width", *[F.round(c, 4).alias(c) for c in ("p00", "p03", "p22", "p23")])


def _kept_extrinsics(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    bal = F.col("s_acctbal").cast("double")
    poses = s.select("s_nationkey", F.concat(F.lit("cam"), F.col("s_suppkey").cast("string")).alias("cam_id"), F.array(*[F.lit(float(v)) for v in (0, -1, 0, 1, 0, 0, 0, 0, 1)]).alias("r"), F.array(bal, bal / 4, F.lit(1.0)).alias("t"), F.col("s_suppkey").cast("int").alias("frames"))
    read = read_extrinsics(extrinsics_texts(poses, ["s_nationkey"]), ["s_nationkey"])
    return read.select("s_nationkey", "cam_id", F.get("r", F.lit(1)).alias("r01"), F.get("t", F.lit(1)).alias("ty"), "frames")


_WITH = f"with {FRAME_LOG_SQL} "
_KEYS = "session_id, cam_id, lpad(cast(idx as varchar), 6, '0') as frame_key"
QUERIES = {
    "older_keypoints": lambda spark, sf: older_keypoints(_older_texts(spark, sf), ["session_id"]),
    "joint_lookup": _joints,
    "calibration_json": _calibrations,
    "intrinsics_json": _intrinsics,
    "pose_json": _kept_poses,
    "extrinsics_json": _kept_extrinsics,
}
ORACLE_SQL = {
    "older_keypoints": _WITH + f"""select {_KEYS}, 'body' as part, 0 as pos, 3 as lm_id, cast(value as double) as x, cast(n_bytes as double) as y, 0.5::double as conf from frame_log
 union all select {_KEYS}, 'body', 1, null, cast(seq as double), 0.0::double, 0.25::double from frame_log
 union all select {_KEYS}, 'left', 0, 0, cast(seq as double), cast(idx as double), 0.75::double from frame_log where idx % 2 = 1""",
    "joint_lookup": _WITH + f"select {_KEYS}, cast(value as double) as by_id, cast(seq as double) as by_place, null::double as absent from frame_log",
    "calibration_json": """select cast(c_custkey // 4 as bigint) as rig_id, 'cam' || cast(c_custkey % 4 as varchar) as cam_id, 'dev' || cast(c_custkey as varchar) as device_id, cast(c_acctbal as double) + 20000 as fx, cast(c_acctbal as double) + 20001 as fy,
 960.0::double as cx, 540.0::double as cy, cast(c_acctbal as double) / 1e6 as k1, 1920 as width, 1080 as height, -0.6::double as r20, cast(c_custkey as double) as tz from customer where c_custkey % 5 <> 0""",
    "intrinsics_json": """select 'cam' || p_partkey as cam_id, cast(p_retailprice as double) as fx, cast(p_retailprice as double) + 1 as fy, 960.0::double as cx, cast(p_retailprice as double) / 1e4 as k1, 1920 as width, 30 as views,
 cast(p_size as integer) as squares_x, 'DICT_5X5_100' as aruco_dict from part""",
    "pose_json": """select cast(c_custkey // 4 as bigint) as rig_id, 'cam' || cast(c_custkey % 4 as varchar) as cam_id, cast(case when c_custkey % 4 <> 0 then c_custkey % 50 end as integer) as inliers, cast((c_custkey // 4) % 9 as double) as score, 'cam1' as second, 1920 as width,
 round(1000 * 0.8::double + 960 * -0.6::double, 4) as p00, round(1000 * (cast(c_acctbal as double) / 1000) + 960.0::double * c_custkey, 4) as p03, 0.8::double as p22, cast(c_custkey as double) as p23 from customer""",
    "extrinsics_json": "select s_nationkey, 'cam' || s_suppkey as cam_id, -1.0::double as r01, cast(s_acctbal as double) / 4 as ty, cast(s_suppkey as integer) as frames from supplier",
}
