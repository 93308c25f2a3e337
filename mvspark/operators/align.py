"""Alignment of free-running cameras: overlap, nearest-time match of every slot in every camera, quorum and report."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mvspark.functions.series import percentile, ranked_in_blocks
from mvspark.plans.fixtures import FRAME_LOG_SQL, frame_log

#: Seconds; the queries' logs have frames minutes apart.
THRESHOLD_S = 300.0
FPS = 1 / 1000.0
#: Seconds of a block: 18,000 frames of a camera at 30 a second. The queries' logs have a frame in so many minutes.
BLOCK_S, QUERY_BLOCK_S = 600.0, 200_000.0


def default_threshold_ms(fps: float) -> float:
    """Half a frame."""
    return 0.5 / fps * 1000


def time_base(log: DataFrame, forced: str | None = None) -> DataFrame:
    """(session_id, time_base): ``unified`` only if every camera has an offset, else ``host_legacy``; ``host`` if forced."""
    every = F.bool_and(F.col("host_offset_s").isNotNull())
    base = F.lit(forced) if forced else F.when(every, "unified").otherwise("host_legacy")
    return log.groupBy("session_id").agg(base.alias("time_base"))


def overlap(log: DataFrame, time: str = "unified_ts_s") -> DataFrame:
    """(session_id, start_s, end_s): from the latest first entry to the earliest last entry, in log order."""
    ends = log.groupBy("session_id", "cam_id").agg(F.min_by(time, "idx").alias("first"), F.max_by(time, "idx").alias("last"))
    return ends.groupBy("session_id").agg(F.max("first").alias("start_s"), F.min("last").alias("end_s")).filter("end_s > start_s")


def slots(log: DataFrame, reference: str, time: str = "unified_ts_s", block_s: float = BLOCK_S) -> DataFrame:
    """The reference camera's times inside the overlap, numbered block by block."""
    times = log.filter(F.col("cam_id") == reference).select("session_id", F.col(time).alias("slot_ts_s"), F.col("idx").alias("ref_idx"))
    inside = times.join(overlap(log, time), "session_id").filter("slot_ts_s >= start_s and slot_ts_s <= end_s + 1e-9")
    numbered = ranked_in_blocks(inside, ["session_id"], "slot_ts_s", block_s, "slot", ["ref_idx"])
    return numbered.select("session_id", F.col("slot").cast("int").alias("slot"), "slot_ts_s")


def nearest(asked: DataFrame, log: DataFrame, time: str = "unified_ts_s", block_s: float = BLOCK_S) -> DataFrame:
    """Each (session_id, slot, slot_ts_s) with each camera's nearest entry; of two as near the earlier (null if
    it has no valid entry at all). Time is cut into blocks: each block of a camera hands on its first and last entry, which one short scan over blocks carries to blocks on either side, and is then
    sorted and matched alone, slots and entries together, once for each direction. No task holds more of a camera than a block."""
    cams = log.select("session_id", "cam_id").distinct()
    grid = asked.join(cams, "session_id").select("session_id", "cam_id", F.col("slot_ts_s").alias("t"), "slot", F.lit(None).cast("int").alias("idx"), F.lit(0).alias("kind"))
    entries = log.filter(F.col(time).isNotNull() & ~F.isnan(time)).select("session_id", "cam_id", F.col(time).alias("t"), F.lit(None).cast("int").alias("slot"), "idx", F.lit(1).alias("kind"))
    both = grid.unionByName(entries).withColumn("block", F.floor(F.col("t") / block_s))
    own = F.when(F.col("kind") == 1, F.struct("t", "idx"))
    keys = ["session_id", "cam_id", "block"]
    ends = both.groupBy(*keys).agg(F.min(own).alias("lo"), F.max(own).alias("hi"))
    blocks = Window.partitionBy("session_id", "cam_id")
    until = lambda c, w: F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    carried = ends.select(*keys, until("hi", blocks.orderBy("block")).alias("earlier"), until("lo", blocks.orderBy(F.desc("block"))).alias("later"))
    inside, order = Window.partitionBy(*keys), ("t", "kind", "idx", "slot")
    # Both frames reach back from the row, one in descending order: a frame that grows at its end is worked out in one pass.
    both = both.withColumn("before", until(own, inside.orderBy(*order))).withColumn("after", until(own, inside.orderBy(*map(F.desc, order)))).filter("kind = 0")
    both = both.join(carried, keys).withColumns({"before": F.coalesce("before", "earlier"), "after": F.coalesce("after", "later")})
    back, ahead = F.col("t") - F.col("before.t"), F.col("after.t") - F.col("t")
    pick = F.when(ahead.isNull() | (back <= ahead), F.col("before")).otherwise(F.col("after"))
    found = both.withColumn("hit", pick)
    return found.select("session_id", "slot", F.col("t").alias("slot_ts_s"), "cam_id", F.col("hit.idx").alias("nearest_idx"), F.col("hit.t").alias("nearest_ts_s"), (F.abs(F.col("hit.t") - F.col("t")) * 1000).alias("delta_ms"))


def quorum(matches: DataFrame, threshold_ms: float, decoded: DataFrame | None = None) -> DataFrame:
    """Status of each camera in each slot: a slot counts only if all cameras are within the threshold; one without entries is missing in all. A frame that can't be decoded (``decoded``: session_id,
    cam_id, idx of those that can) spoils its own camera alone."""
    near = F.coalesce(F.col("delta_ms") <= threshold_ms, F.lit(False))
    whole = F.bool_and(near).over(Window.partitionBy("session_id", "slot"))
    status = F.when(whole, "matched").when(near, "discarded_slot").when(F.col("nearest_idx").isNull(), "missing").otherwise("discarded")
    out = matches.withColumn("status", status)
    if decoded is not None:
        seen = decoded.select("session_id", "cam_id", F.col("idx").alias("nearest_idx"), F.lit(True).alias("ok"))
        out = out.join(seen, ["session_id", "cam_id", "nearest_idx"], "left")
        out = out.withColumn("status", F.when((F.col("status") == "matched") & F.col("ok").isNull(), "missing_decode").otherwise(F.col("status"))).drop("ok")
    good = F.col("status") == "matched"
    return out.withColumns({"idx": F.when(good, F.col("nearest_idx")), "offset_ms": F.when(good, (F.col("nearest_ts_s") - F.col("slot_ts_s")) * 1000), "matched_ts_s": F.when(good, F.col("nearest_ts_s"))})


def aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = frame_log(spark, sf_dir)
    return quorum(nearest(slots(log, "cam0", block_s=QUERY_BLOCK_S), log, block_s=QUERY_BLOCK_S), THRESHOLD_S * 1000)


def camera_stats(rows: DataFrame) -> DataFrame:
    """Counts by status and mean, largest and p95 offset of each camera."""
    is_ = lambda s: F.count(F.when(F.col("status") == s, 1))
    rows = rows.withColumn("off", F.abs("offset_ms"))
    return rows.groupBy("session_id", "cam_id").agg(
        is_("matched").alias("matched"),
        is_("discarded").alias("discarded"),
        is_("discarded_slot").alias("discarded_slot"),
        is_("missing").alias("missing"),
        F.count(F.when(F.col("status") != "matched", 1)).alias("placeholders"),
        F.round(F.coalesce(F.avg("off"), F.lit(0.0)), 3).alias("mean_ms"),
        F.round(F.coalesce(F.max("off"), F.lit(0.0)), 3).alias("max_ms"),
        F.round(percentile("off", 0.95), 3).alias("p95_ms"),
    )


def spread(rows: DataFrame) -> DataFrame:
    """Largest minus least matched time over whole slots: mean, maximum, p95, count."""
    good = F.count(F.when(F.col("status") == "matched", 1)) == F.count(F.lit(1))
    each = rows.groupBy("session_id", "slot").agg(((F.max("matched_ts_s") - F.min("matched_ts_s")) * 1000).alias("ms"), good.alias("whole")).filter("whole")
    return each.groupBy("session_id").agg(F.count(F.lit(1)).alias("slots"), F.round(F.avg("ms"), 3).alias("mean_ms"), F.round(F.max("ms"), 3).alias("max_ms"), F.round(percentile("ms", 0.95), 3).alias("p95_ms"))


def drift(rows: DataFrame, fps: float, least: int = 20) -> DataFrame:
    """Mean absolute offset of each camera's first and last tenth of matched slots; a warning if they differ by over a frame."""
    w = Window.partitionBy("session_id", "cam_id")
    m = rows.filter("status = 'matched'").withColumns({"i": F.row_number().over(w.orderBy("slot")), "n": F.count(F.lit(1)).over(w), "off": F.abs("offset_ms")}).filter(F.col("n") >= least)
    k = F.greatest(F.lit(1), F.floor(F.col("n") / 10))
    out = m.groupBy("session_id", "cam_id").agg(F.avg(F.when(F.col("i") <= k, F.col("off"))).alias("a"), F.avg(F.when(F.col("i") > F.col("n") - k, F.col("off"))).alias("b"))
    return out.select("session_id", "cam_id", F.round("a", 3).alias("first_ms"), F.round("b", 3).alias("last_ms"), (F.abs(F.col("b") - F.col("a")) > 1000 / fps).alias("drifts"))


def warnings(rows: DataFrame, log: DataFrame, fps: float, threshold_ms: float, videos: DataFrame | None = None) -> DataFrame:
    """(session_id, kind, cam_id, value): p95 spread over a frame, matched offsets over the threshold, a threshold under 0.45 frame, no calibration, and frames that
    a video (session_id, cam_id, frames) has more than its log."""
    frame = 1000 / fps
    wide = spread(rows).filter(F.col("p95_ms") > frame).select("session_id", F.lit("spread").alias("kind"), F.lit("").alias("cam_id"), F.col("p95_ms").alias("value"))
    far = rows.filter("status = 'matched'").groupBy("session_id", "cam_id").agg(F.round(F.max("delta_ms"), 3).alias("value")).filter(F.col("value") > threshold_ms).select("session_id", F.lit("offset").alias("kind"), "cam_id", "value")
    tight = log.select("session_id").distinct().filter(F.lit(threshold_ms < 0.45 * frame)).select("session_id", F.lit("threshold").alias("kind"), F.lit("").alias("cam_id"), F.lit(float(threshold_ms)).alias("value"))
    bare = log.filter("host_offset_s is null").groupBy("session_id", "cam_id").agg(F.count(F.lit(1)).cast("double").alias("value")).select("session_id", F.lit("calibration").alias("kind"), "cam_id", "value")
    out = wide.unionByName(far).unionByName(tight).unionByName(bare)
    if videos is not None:
        logged = log.groupBy("session_id", "cam_id").agg(F.count(F.lit(1)).alias("logged"))
        more = (F.col("frames") - F.coalesce("logged", F.lit(0))).cast("double").alias("value")
        out = out.unionByName(videos.join(logged, ["session_id", "cam_id"], "left").select("session_id", F.lit("count").alias("kind"), "cam_id", more).filter("value <> 0"))
    return out


def _videos(log: DataFrame) -> DataFrame:
    """Videos with as many frames as their logs, but for one of cam2."""
    return log.groupBy("session_id", "cam_id").agg((F.count(F.lit(1)) + F.when(F.col("cam_id") == "cam2", 1).otherwise(0)).alias("frames"))


_SQL = f"""with {FRAME_LOG_SQL},
ends as (select session_id, cam_id, min_by(unified_ts_s, idx) as f, max_by(unified_ts_s, idx) as l from frame_log group by session_id, cam_id),
ov as (select session_id, max(f) as start_s, min(l) as end_s from ends group by session_id),
sl as (select session_id, unified_ts_s as slot_ts_s, cast(row_number() over (partition by session_id order by unified_ts_s, idx) - 1 as integer) as slot
  from frame_log join ov using (session_id) where cam_id = 'cam0' and unified_ts_s >= start_s and unified_ts_s <= end_s + 1e-9 and end_s > start_s),
u as (select session_id, cam_id, slot_ts_s as t, slot, null::integer as idx, 0 as kind from sl, (select distinct cam_id from frame_log)
  union all select session_id, cam_id, unified_ts_s, null::integer, idx, 1 from frame_log),
w as (select *, max(case when kind = 1 then t end) over (partition by session_id, cam_id order by t, kind, idx, slot rows between unbounded preceding and 1 preceding) as bt,
   max(case when kind = 1 then row_id end) over (partition by session_id, cam_id order by t, kind, idx, slot rows between unbounded preceding and 1 preceding) as bi,
   min(case when kind = 1 then t end) over (partition by session_id, cam_id order by t, kind, idx, slot rows between 1 following and unbounded following) as ft,
   min(case when kind = 1 then row_id end) over (partition by session_id, cam_id order by t, kind, idx, slot rows between 1 following and unbounded following) as fi
  from (select *, row_number() over (partition by session_id, cam_id order by t, kind, idx, slot) as row_id from u)),
pk as (select session_id, slot, t, cam_id, case when ft is null or t - bt <= ft - t then bi else fi end as rid, case when ft is null or t - bt <= ft - t then bt else ft end as ht from w where kind = 0),
nr as (select pk.session_id, pk.slot, pk.t as slot_ts_s, pk.cam_id, w.idx as nearest_idx, ht as nearest_ts_s, abs(ht - pk.t) * 1000 as delta_ms
  from pk join w on w.session_id = pk.session_id and w.cam_id = pk.cam_id and w.row_id = pk.rid),
st as (select *, case when bool_and(delta_ms <= {THRESHOLD_S * 1000}) over (partition by session_id, slot) then 'matched' when delta_ms <= {THRESHOLD_S * 1000} then 'discarded_slot' else 'discarded' end as status from nr),
al as (select *, case when status = 'matched' then nearest_idx end as idx, case when status = 'matched' then (nearest_ts_s - slot_ts_s) * 1000 end as offset_ms,
  case when status = 'matched' then nearest_ts_s end as matched_ts_s from st)
"""
_STATS = """select session_id, cam_id, count(case when status = 'matched' then 1 end) as matched, count(case when status = 'discarded' then 1 end) as discarded,
 count(case when status = 'discarded_slot' then 1 end) as discarded_slot, count(case when nearest_idx is null then 1 end) as missing, count(case when status <> 'matched' then 1 end) as placeholders,
 round(coalesce(avg(abs(offset_ms)), 0), 3) as mean_ms, round(coalesce(max(abs(offset_ms)), 0), 3) as max_ms, round(coalesce(quantile_cont(abs(offset_ms), 0.95), 0), 3) as p95_ms from al group by session_id, cam_id"""
_SPREAD = """select session_id, count(*) as slots, round(avg(ms), 3) as mean_ms, round(max(ms), 3) as max_ms, round(coalesce(quantile_cont(ms, 0.95), 0), 3) as p95_ms
 from (select session_id, slot, (max(matched_ts_s) - min(matched_ts_s)) * 1000 as ms from al where status = 'matched' group by session_id, slot) group by session_id"""
_DRIFT = f"""select session_id, cam_id, round(a, 3) as first_ms, round(b, 3) as last_ms, abs(b - a) > {1000 / FPS} as drifts from (
 select session_id, cam_id, avg(case when i <= k then abs(offset_ms) end) as a, avg(case when i > n - k then abs(offset_ms) end) as b from (
  select *, greatest(1, n // 10) as k from (select *, row_number() over (partition by session_id, cam_id order by slot) as i, count(*) over (partition by session_id, cam_id) as n from al where status = 'matched') where n >= 20)
 group by session_id, cam_id)"""

QUERIES = {
    "align_slots": lambda spark, sf: aligned(spark, sf).select("session_id", "slot", "cam_id", "status", "idx", "nearest_idx", F.round("delta_ms", 3).alias("delta_ms")),
    "align_overlap": lambda spark, sf: overlap(frame_log(spark, sf)).select("session_id", F.round("start_s", 3).alias("start_s"), F.round("end_s", 3).alias("end_s")),
    "align_timebase": lambda spark, sf: time_base(frame_log(spark, sf)),
    "align_camera_stats": lambda spark, sf: camera_stats(aligned(spark, sf)),
    "align_spread": lambda spark, sf: spread(aligned(spark, sf)),
    "align_drift": lambda spark, sf: drift(aligned(spark, sf), FPS),
    "align_warnings": lambda spark, sf: warnings(aligned(spark, sf), frame_log(spark, sf), 1 / 500.0, 200_000.0, _videos(frame_log(spark, sf))),
}
ORACLE_SQL = {
    "align_slots": _SQL + "select session_id, slot, cam_id, status, idx, nearest_idx, round(delta_ms, 3) as delta_ms from al",
    "align_overlap": _SQL + "select session_id, round(start_s, 3) as start_s, round(end_s, 3) as end_s from ov where end_s > start_s",
    "align_timebase": _SQL + "select session_id, case when bool_and(host_offset_s is not null) then 'unified' else 'host_legacy' end as time_base from frame_log group by session_id",
    "align_camera_stats": _SQL + _STATS,
    "align_spread": _SQL + _SPREAD,
    "align_drift": _SQL + _DRIFT,
    "align_warnings": _SQL + f"""select session_id, 'spread' as kind, '' as cam_id, p95_ms as value from ({_SPREAD}) where p95_ms > 500000
 union all select * from (select session_id, 'offset' as kind, cam_id, round(max(delta_ms), 3) as value from al where status = 'matched' group by session_id, cam_id) where value > 200000
 union all select distinct session_id, 'threshold', '', cast(200000 as double) from frame_log where 200000 < 0.45 * 500000
 union all select distinct session_id, 'count', cam_id, cast(1 as double) from frame_log where cam_id = 'cam2'""",
}
