"""Frame logs and keypoint JSON as text: parsing, byte offsets, warm-up, frame rates."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mvspark.functions.series import row_index
from mvspark.plans.fixtures import FRAME_LOG_SQL, frame_log

#: keypoint JSON: camera -> frame -> landmark -> [x, y, z]
KEYPOINT_JSON = "map<string,map<string,map<string,array<double>>>>"


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """(path, value): one row for each log file, whole, so that its lines keep their order."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")


def seconds_of(text: str):
    """Seconds as a number, else an ISO time (naive: in the session's time zone)."""
    return F.coalesce(F.expr(f"try_cast({text} as double)"), F.unix_micros(F.try_to_timestamp(F.col(text))) / 1e6)


def parse_log(texts: DataFrame, keys: list[str]) -> DataFrame:
    """Entries ``host_ts seq device_ts bytes`` of log texts (value), numbered among the valid lines. Blank, ``#`` and shorter lines are skipped."""
    lines = texts.select(*keys, F.posexplode(F.split("value", "\n")).alias("pos", "line")).withColumn("line", F.trim("line"))
    parts = F.split("line", r"\s+")
    rows = lines.filter((F.col("line") != "") & ~F.col("line").startswith("#")).withColumn("p", parts).filter(F.size("p") >= 4)
    rows = rows.select(*keys, "pos", F.get("p", F.lit(0)).alias("t"), F.get("p", F.lit(1)).try_cast("long").alias("seq"), F.get("p", F.lit(2)).try_cast("double").alias("device_ts_s"), F.get("p", F.lit(3)).try_cast("long").alias("n_bytes"))
    return row_index(rows.withColumn("host_ts_s", seconds_of("t")), keys, ["pos"], "idx").drop("t", "pos")


def parse_header(texts: DataFrame, keys: list[str]) -> DataFrame:
    """rec_w, rec_h, fps and host_offset_s from a log's leading ``#`` lines; the last that matches wins."""
    lines = texts.select(*keys, F.posexplode(F.split("value", "\n")).alias("pos", "line"))
    first = F.min(F.when(~F.col("line").startswith("#"), F.col("pos"))).over(Window.partitionBy(*keys))
    head = lines.withColumn("first", first).filter(F.coalesce(F.col("pos") < F.col("first"), F.lit(True)))
    size, offset = r"(\d+)x(\d+)@(\d+(?:\.\d+)?)fps", r"host_offset_s=([-\d.]+)"
    got = lambda pattern, k: F.nullif(F.regexp_extract("line", pattern, k), F.lit(""))
    last = lambda c: F.max_by(c, F.when(c.isNotNull(), F.col("pos")))
    sync = F.when(F.col("line").startswith("# sync_calibration"), got(offset, 1))
    return head.groupBy(*keys).agg(last(got(size, 1)).cast("int").alias("rec_w"), last(got(size, 2)).cast("int").alias("rec_h"), last(got(size, 3)).cast("double").alias("fps"), last(sync).cast("double").alias("host_offset_s"))


def byte_offsets(log: DataFrame) -> DataFrame:
    """Where each frame lies in its camera's stream: the sum of the lengths before it."""
    w = Window.partitionBy("session_id", "cam_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    return log.select("session_id", "cam_id", "idx", F.coalesce(F.sum("n_bytes").over(w), F.lit(0)).cast("long").alias("offset"), F.col("n_bytes").alias("length"))


def warm_up_sync(log: DataFrame, frames: int = 10) -> DataFrame:
    """Each camera's host minus device time at the first frame after the warm-up."""
    later = log.filter(F.col("idx") >= frames)
    return later.groupBy("session_id", "cam_id").agg(F.min_by(F.col("host_ts_s") - F.col("device_ts_s"), "idx").alias("sync_offset_s"), F.min("idx").alias("idx"))


def fps_by_second(log: DataFrame, seconds: int) -> DataFrame:
    """Frames of each camera in each window of so many seconds."""
    return log.groupBy("session_id", "cam_id", (F.floor(F.col("host_ts_s") / seconds) * seconds).cast("long").alias("from_s")).agg(F.count(F.lit(1)).alias("frames"))


def ema_fps(log: DataFrame) -> DataFrame:
    """Exponential moving frame rate at each camera's end: 0.8 of the last, 0.2 of 1 / dt. A sum weighted by powers of 0.8, so it needs one window
    and a plain aggregate, not an ordered fold."""
    w = Window.partitionBy("session_id", "cam_id")
    steps = log.withColumn("dt", F.col("host_ts_s") - F.lag("host_ts_s").over(w.orderBy("idx"))).filter("dt is not null")
    steps = steps.withColumn("back", F.row_number().over(w.orderBy(F.desc("idx"))) - 1)
    return steps.groupBy("session_id", "cam_id").agg((F.sum(0.2 * F.pow(F.lit(0.8), "back") / F.greatest(F.col("dt"), F.lit(1e-6)))).alias("fps"))


def log_texts(log: DataFrame) -> DataFrame:
    """Logs in text form, with their headers: what the recorder writes."""
    line = F.concat_ws(" ", F.format_string("%.6f", "host_ts_s"), "seq", F.format_string("%.6f", "device_ts_s"), "n_bytes")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", line.alias("l")))), lambda s: s["l"]), "\n")
    # Sizes and rates differ by camera, so that what is read must come from the text.
    n = F.substring("cam_id", 4, 4).cast("int")
    size = F.format_string("# iso=800 shutter_us=4000 %dx%d@%dfps mjpeg_q=70\n", 3840 - 640 * n, 2160 - 360 * n, 30 - 5 * n)
    sync = F.format_string("# sync_calibration host_ts_s=%.9f device_ts_s=%.9f host_offset_s=%.9f\n", F.min("host_ts_s"), F.min("device_ts_s"), F.max("host_offset_s"))
    head = F.concat(F.lit("# video=v.mjpeg\n# camera=c\n"), size, sync, F.lit("# sync_source=rec_mjpeg_post_warmup\n# frame_log: host_ts_s sequence_num device_timestamp_s bytes\n\nshort line x\n"))
    return log.groupBy("session_id", "cam_id").agg(F.concat(head, body).alias("value"))


def parse_keypoints(texts: DataFrame, keys: list[str]) -> DataFrame:
    """(cam_id, frame_key, lm_id, x, y, z) of keypoint JSON texts."""
    cams = texts.select(*keys, F.explode(F.from_json("value", KEYPOINT_JSON)).alias("cam_id", "frames"))
    frames = cams.select(*keys, "cam_id", F.explode("frames").alias("frame_key", "lms"))
    lms = frames.select(*keys, "cam_id", "frame_key", F.explode("lms").alias("lm", "p"))
    return lms.select(*keys, "cam_id", "frame_key", F.col("lm").cast("int").alias("lm_id"), *[F.get("p", F.lit(k)).alias(n) for k, n in enumerate("xyz")])


def keypoint_texts(points: DataFrame, keys: list[str]) -> DataFrame:
    """Keypoint JSON of rows (cam_id, frame_key, lm_id, x, y, z): the inverse of ``parse_keypoints``."""
    lms = points.groupBy(*keys, "cam_id", "frame_key").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("lm_id").cast("string"), F.array("x", "y", "z"))))).alias("lms"))
    frames = lms.groupBy(*keys, "cam_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("frame_key", F.map_entries("lms"))))).alias("f"))
    frames = frames.select(*keys, "cam_id", F.transform_values("f", lambda k, v: F.map_from_entries(v)).alias("f"))
    whole = frames.groupBy(*keys).agg(F.collect_list(F.struct("cam_id", F.map_entries("f").alias("f"))).alias("c"))
    nested = F.transform("c", lambda s: F.struct(s["cam_id"].alias("k"), F.map_from_entries(s["f"]).alias("v")))
    return whole.select(*keys, F.to_json(F.map_from_entries(nested)).alias("value"))


def text_of(cam_id: Column, idx: Column) -> Column:
    """Name of the text that holds a camera's frame: one for each hundred frames keeps texts small. Keys of frames have six digits; of a longer number they are the first six, so the
    others are in the text's name and no text has a key twice."""
    digits = F.lpad(idx.cast("string"), F.greatest(F.length(idx.cast("string")), F.lit(6)), F.lit("0"))
    return F.concat_ws("-", cam_id, F.substring(digits, 1, 4), F.nullif(F.substring(digits, 7, 20), F.lit("")))


def _json_keypoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = frame_log(spark, sf_dir)
    pts = log.select("session_id", "cam_id", text_of(F.col("cam_id"), F.col("idx")).alias("part"), F.lpad(F.col("idx").cast("string"), 6, "0").alias("frame_key"), F.lit(0).alias("lm_id"), F.col("value").cast("double").alias("x"), F.col("n_bytes").cast("double").alias("y"), F.lit(0.5).alias("z"))
    return parse_keypoints(keypoint_texts(pts, ["session_id", "part"]), ["session_id", "part"]).drop("part")


_WITH = f"with {FRAME_LOG_SQL} "
QUERIES = {
    "log_parse": lambda spark, sf: parse_log(log_texts(frame_log(spark, sf)), ["session_id", "cam_id"]).select("session_id", "cam_id", "idx", "seq", "n_bytes", F.round(F.col("host_ts_s") * 1e6).cast("long").alias("host_us"), F.round(F.col("device_ts_s") * 1e6).cast("long").alias("device_us")),
    "log_header": lambda spark, sf: parse_header(log_texts(frame_log(spark, sf)), ["session_id", "cam_id"]),
    "mjpeg_offsets": lambda spark, sf: byte_offsets(frame_log(spark, sf)),
    "warmup_sync": lambda spark, sf: warm_up_sync(frame_log(spark, sf)).withColumn("sync_offset_s", F.round("sync_offset_s", 4)),
    "window_fps": lambda spark, sf: fps_by_second(frame_log(spark, sf), 86_400),
    "ema_fps": lambda spark, sf: ema_fps(frame_log(spark, sf)).withColumn("fps", F.round("fps", 4)),
    "json_keypoints": _json_keypoints,
}
ORACLE_SQL = {
    "log_parse": _WITH + "select session_id, cam_id, idx, seq, n_bytes, cast(round(host_ts_s * 1e6) as bigint) as host_us, cast(round(device_ts_s * 1e6) as bigint) as device_us from frame_log",
    "log_header": _WITH + "select session_id, cam_id, 3840 - 640 * n as rec_w, 2160 - 360 * n as rec_h, cast(30 - 5 * n as double) as fps, max(host_offset_s) as host_offset_s from (select *, cast(substr(cam_id, 4) as integer) as n from frame_log) group by session_id, cam_id, n",
    "mjpeg_offsets": _WITH + "select session_id, cam_id, idx, cast(coalesce(sum(n_bytes) over (partition by session_id, cam_id order by idx rows between unbounded preceding and 1 preceding), 0) as bigint) as offset, n_bytes as length from frame_log",
    "warmup_sync": _WITH + "select session_id, cam_id, round(min_by(host_ts_s - device_ts_s, idx), 4) as sync_offset_s, min(idx) as idx from frame_log where idx >= 10 group by session_id, cam_id",
    "window_fps": _WITH + "select session_id, cam_id, cast(floor(host_ts_s / 86400) * 86400 as bigint) as from_s, count(*) as frames from frame_log group by session_id, cam_id, from_s",
    "ema_fps": _WITH + "select session_id, cam_id, round(sum(0.2 * pow(0.8, back) / greatest(dt, 1e-6)), 4) as fps from (select *, row_number() over (partition by session_id, cam_id order by idx desc) - 1 as back from (select *, host_ts_s - lag(host_ts_s) over (partition by session_id, cam_id order by idx) as dt from frame_log) where dt is not null) group by session_id, cam_id",
    "json_keypoints": _WITH + "select session_id, cam_id, lpad(cast(idx as varchar), 6, '0') as frame_key, 0 as lm_id, cast(value as double) as x, cast(n_bytes as double) as y, cast(0.5 as double) as z from frame_log",
}
