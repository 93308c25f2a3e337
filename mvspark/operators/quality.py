"""Keypoint quality: rates, agreement of sources, left/right swap tests, velocity, jitter, outliers; and the corrections."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mvspark.functions.geometry import gram_terms, null_point, project, projection_rows, smallest_eigvec4, to_pixels
from mvspark.functions.quantiles import quantiles
from mvspark.functions.series import checkpointed
from mvspark.operators.smooth import savgol
from mvspark.operators.triangulate import undistort_points, views
from mvspark.plans.fixtures import HEIGHT, WIDTH, POINTS_SQL, calibration, keypoints, keypoints_sql, true_points

HAND = ["cam_id", "frame"]
#: Pixels by which exchanging must be nearer, in the test against body wrists and in that against the other cameras.
BODY_MARGIN, OTHERS_MARGIN = 20.0, 5.0


def detection_rates(points: DataFrame, frames: DataFrame, min_conf: float) -> DataFrame:
    """Share of all frames in which each camera has each side at min_conf or more."""
    total = frames.select("frame").distinct().agg(F.count(F.lit(1)).alias("frames"))
    seen = points.groupBy("cam_id", "part").agg(F.countDistinct(F.when(F.coalesce("conf", F.lit(0.0)) >= min_conf, F.col("frame"))).alias("detected"))
    return seen.join(F.broadcast(total), F.lit(True)).select("cam_id", "part", "detected", F.round(F.col("detected") / F.col("frames"), 6).alias("rate"))


def co_occurrence(bad: DataFrame) -> DataFrame:
    """Correlation of the sides' bad marks (frame, cam_id, left_bad, right_bad as 0 or 1) of each camera; null if one is constant."""
    l, r = F.col("left_bad").cast("double"), F.col("right_bad").cast("double")
    flat = (F.max(l) == F.min(l)) | (F.max(r) == F.min(r))
    cov = F.avg(l * r) - F.avg(l) * F.avg(r)
    var = (F.avg(l * l) - F.avg(l) ** 2) * (F.avg(r * r) - F.avg(r) ** 2)
    return bad.groupBy("cam_id").agg(F.when(~flat, F.round(F.try_divide(cov, F.sqrt(F.greatest(var, F.lit(0.0)))), 6)).alias("corr"))


def combine_max(points: DataFrame) -> DataFrame:
    """Of several sources the keypoints of the one with the highest confidence in the frame; of equal ones the first (source_ord)."""
    keys = ["cam_id", "frame", "part"]
    best = F.max(F.struct(F.coalesce("conf", F.lit(0.0)).alias("conf"), (-F.col("source_ord")).alias("place"))).over(Window.partitionBy(*keys))
    return points.withColumn("__best", best).filter(F.col("source_ord") == -F.col("__best.place")).drop("__best")


def combine_weighted(points: DataFrame) -> DataFrame:
    """Each landmark's mean over sources weighted by the frame's confidence (1e-6 at least); the confidence is the highest."""
    w = F.greatest(F.coalesce(F.col("conf"), F.lit(0.0)), F.lit(1e-6))
    # The few sources of a landmark are added in the order of source_ord: a sum in the order of arrival would not be the same twice.
    few = points.groupBy("session", "cam_id", "frame", "part", "lm_id").agg(F.array_sort(F.collect_list(F.struct("source_ord", w.alias("w"), "x", "y"))).alias("s"), F.max("conf").alias("conf"))
    total = lambda value: F.aggregate("s", F.lit(0.0), lambda acc, s: acc + value(s))
    return few.select("session", "cam_id", "frame", "part", "lm_id", *[(total(lambda s, c=c: s["w"] * s[c]) / total(lambda s: s["w"])).alias(c) for c in "xy"], "conf")


def source_disagreement(points: DataFrame, ratio: float = 0.5) -> DataFrame:
    """Mean pixel distance of two sources' hands, same side and other side, over landmarks that all four have; a swap is likely if the other
    side is nearer by the ratio."""
    pick = lambda s, p, c: F.max(F.when((F.col("source_ord") == s) & (F.col("part") == p), F.col(c)))
    four = {f"{p[0]}{s}{c}": pick(s, p, c) for s in (0, 1) for p in ("left", "right") for c in "xy"}
    rows = points.groupBy("cam_id", "frame", "lm_id").agg(*[v.alias(k) for k, v in four.items()]).dropna(subset=[*four])
    dist = lambda a, b: F.hypot((F.col(f"{a}x") - F.col(f"{b}x")) * WIDTH, (F.col(f"{a}y") - F.col(f"{b}y")) * HEIGHT)
    out = rows.groupBy("cam_id", "frame").agg(((F.avg(dist("l0", "l1")) + F.avg(dist("r0", "r1"))) / 2).alias("same_px"), ((F.avg(dist("l0", "r1")) + F.avg(dist("r0", "l1"))) / 2).alias("cross_px"))
    return out.withColumn("likely_swap", F.col("cross_px") < ratio * F.col("same_px"))


def body_wrist_swap(hands: DataFrame, body: DataFrame, margin_px: float = BODY_MARGIN) -> DataFrame:
    """Hand wrists against body wrists as labelled and exchanged; swapped if exchanging is nearer by the margin. Frames without all four give no row."""
    wrist = lambda df, tag: df.filter("lm_id = 0").groupBy(*HAND).agg(*[F.max(F.when(F.col("part") == p, F.col(c))).alias(f"{tag}{p[0]}{c}") for p in ("left", "right") for c in "xy"]).dropna()
    both = wrist(hands, "h").join(wrist(body, "b"), HAND)
    dist = lambda a, b: F.hypot((F.col(f"h{a}x") - F.col(f"b{b}x")) * WIDTH, (F.col(f"h{a}y") - F.col(f"b{b}y")) * HEIGHT)
    out = both.select(*HAND, (dist("l", "l") + dist("r", "r")).alias("labelled_px"), (dist("l", "r") + dist("r", "l")).alias("swapped_px"))
    return out.withColumns({"swap": F.col("swapped_px") < F.col("labelled_px") - margin_px, "margin": F.col("labelled_px") - F.col("swapped_px")})


def leave_one_out_swap(seen: DataFrame, margin_px: float = OTHERS_MARGIN) -> DataFrame:
    """Each camera's wrists against the points of all other cameras (two at least), as labelled and exchanged. The others' Gram sums are the
    window's sums less the camera's own, so there is one shuffle and one solve for each row."""
    wrist = seen.filter("lm_id = 0")
    terms = gram_terms("u", "v")
    rows = wrist.select("*", *[t.alias(f"g{k}") for k, t in enumerate(terms)])
    w = Window.partitionBy("session", "frame", "part")
    others = [(F.sum(f"g{k}").over(w) - F.col(f"g{k}")).alias(f"o{k}") for k in range(10)]
    rows = rows.select("*", *others, (F.count(F.lit(1)).over(w) - 1).alias("n_others")).filter("n_others >= 2")
    rows = rows.withColumn("p", smallest_eigvec4(F.array(*[f"o{k}" for k in range(10)]))).filter("p is not null")
    u, v = project(F.get("p", F.lit(0)), F.get("p", F.lit(1)), F.get("p", F.lit(2)))
    rows = rows.select(*HAND, "part", "u", "v", u.alias("pu"), v.alias("pv"))
    side = lambda p, c: F.max(F.when(F.col("part") == p, F.col(c))).alias(f"{p[0]}{c}")
    both = rows.groupBy(*HAND).agg(*[side(p, c) for p in ("left", "right") for c in ("u", "v", "pu", "pv")]).dropna()
    dist = lambda a, b: F.hypot(F.col(f"{a}u") - F.col(f"{b}pu"), F.col(f"{a}v") - F.col(f"{b}pv"))
    out = both.select(*HAND, (dist("l", "l") + dist("r", "r")).alias("labelled_px"), (dist("l", "r") + dist("r", "l")).alias("swapped_px"))
    return out.withColumn("swap", F.col("swapped_px") < F.col("labelled_px") - margin_px)


def velocity(wrists: DataFrame, frames: DataFrame, max_px: float = 200.0) -> DataFrame:
    """Pixel step of each wrist from its session's frame before (x, y fractions); undefined after a frame without one."""
    order = frames.select("session", "frame").distinct().withColumn("ord_f", F.dense_rank().over(Window.partitionBy("session").orderBy("frame")))
    w = Window.partitionBy("session", "cam_id", "part").orderBy("ord_f")
    rows = wrists.join(order, ["session", "frame"])
    px = F.hypot((F.col("x") - F.lag("x").over(w)) * WIDTH, (F.col("y") - F.lag("y").over(w)) * HEIGHT)
    rows = rows.withColumn("step_px", F.when(F.col("ord_f") - F.lag("ord_f").over(w) == 1, px))
    return rows.select("cam_id", "part", "frame", "step_px", F.coalesce(F.col("step_px") > max_px, F.lit(False)).alias("fast"))


def wrist_jitter(points3d: DataFrame) -> DataFrame:
    """Mean 3D step between successive present wrists of each session and side; gaps are skipped."""
    w = Window.partitionBy("session", "part").orderBy("frame")
    step = F.sqrt(sum(((F.col(c) - F.lag(c).over(w)) ** 2 for c in "yz"), (F.col("x") - F.lag("x").over(w)) ** 2))
    return points3d.filter("lm_id = 0").withColumn("step", step).groupBy("session", "part").agg(F.round(F.avg("step"), 6).alias("mean_step"), F.count("step").alias("n"))


def mad_outliers(series: DataFrame, keys: list[str], value: str, factor: float = 4.0) -> DataFrame:
    """Rows over median + factor x (MAD + 1e-9) of their series. Medians are exact, by repeated counts: no task holds a series, however long."""
    rows = checkpointed(series)
    middle = lambda df, of, name: F.broadcast(quantiles(df, keys, of, [0.5]).select(*keys, F.col("value").alias(name)))  # noqa: E731  a row a series
    off = rows.join(middle(rows, value, "mid"), keys, "left").withColumn("off", F.abs(F.col(value) - F.col("mid")))
    return off.join(middle(off, "off", "mad"), keys, "left").withColumn("flag", F.col(value) > F.col("mid") + factor * (F.col("mad") + 1e-9)).drop("off")


def smoothing_outliers(raw: DataFrame, smoothed: DataFrame, keys: list[str], factor: float = 4.0) -> DataFrame:
    """(keys, frame, residual, flag): how far a reference landmark's raw point (x, y, z) lies from its smoothed one in the frames that have both; flagged where it is an outlier of
    its whole series."""
    both = raw.select(*keys, "frame", "x", "y", "z").join(smoothed.select(*keys, "frame", *[F.col(c).alias(f"s{c}") for c in "xyz"]), [*keys, "frame"])
    off = both.select(*keys, "frame", F.sqrt(sum(((F.col(c) - F.col(f"s{c}")) ** 2 for c in "yz"), (F.col("x") - F.col("sx")) ** 2)).alias("residual"))
    return mad_outliers(off, keys, "residual", factor).select(*keys, "frame", "residual", "flag")


def swap_correct(points: DataFrame, flags: DataFrame) -> DataFrame:
    """Keypoints with the sides of flagged (cam_id, frame) exchanged."""
    marked = points.join(flags.filter("swap").select(*HAND, F.lit(True).alias("__swap")).distinct(), HAND, "left")
    other = F.when(F.col("part") == "left", "right").when(F.col("part") == "right", "left").otherwise(F.col("part"))
    return marked.withColumn("part", F.when(F.col("__swap"), other).otherwise(F.col("part"))).drop("__swap")


def penalise(detections: DataFrame, flags: DataFrame, factor: float = 0.01) -> DataFrame:
    """Confidences x factor where flagged (cam_id, frame, part); a flagged row that is missing appears with 0."""
    keys = [*HAND, "part"]
    both = detections.join(flags.select(*keys, F.lit(True).alias("__flag")).distinct(), keys, "full")
    return both.select(*keys, F.when(F.col("__flag"), F.coalesce("conf", F.lit(0.0)) * factor).otherwise(F.col("conf")).alias("conf"), F.coalesce("__flag", F.lit(False)).alias("penalised"))


def threshold_sweep(tests: DataFrame, margins: list[float]) -> DataFrame:
    """Swaps found at each margin: the errors don't depend on it, so the rows are read once."""
    each = tests.withColumn("margin_px", F.explode(F.array(*map(F.lit, margins))))
    return each.groupBy("margin_px").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("swapped_px") < F.col("labelled_px") - F.col("margin_px"), 1)).alias("swaps"))


def correct(points: DataFrame, body: DataFrame, cameras: DataFrame, min_conf: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """Keypoints after both swap corrections, and the wrists' detections with fast ones penalised. The cheap test against body wrists comes first, the test against the other
    cameras (views of min_conf) sees its output, and velocities are those of the twice corrected keypoints. Where cameras have a distortion (dist), each test sees
    keypoints without it, taken out anew after each correction; what is corrected are the keypoints as they were seen."""
    flat = (lambda p: undistort_points(p, cameras).drop("raw_x", "raw_y")) if "dist" in cameras.columns else (lambda p: p)
    once = swap_correct(points, body_wrist_swap(flat(points), flat(body)))
    twice = swap_correct(once, leave_one_out_swap(views(flat(once), cameras, min_conf)))
    wrists = _corrected_wrists(flat(points.filter("lm_id = 0")), flat(body.filter("lm_id = 0")), cameras, min_conf)
    return twice, _penalised(wrists, points.select("session", "frame").distinct())


def _corrected_wrists(hands: DataFrame, body: DataFrame, cameras: DataFrame, min_conf: float) -> DataFrame:
    """(session, cam_id, frame, part, x, y, conf) of the wrists after both swap corrections: the tests of body_wrist_swap() and leave_one_out_swap(), whose flags stay with
    their rows, so that a frame's wrists are dealt out once."""
    kept = ["session", *HAND, "part", "x", "y", "conf"]
    both = hands.select(*kept, F.lit(False).alias("body")).unionByName(body.select(*kept, F.lit(True).alias("body")))
    w = Window.partitionBy(*HAND)
    given = F.col("cam_id").isNotNull() & F.col("frame").isNotNull()
    pair = lambda of, p, c: F.max(F.when(of & (F.col("part") == p), F.col(c))).over(w)
    other = F.when(F.col("part") == "left", "right").when(F.col("part") == "right", "left").otherwise(F.col("part"))

    def flipped(rows: DataFrame, first: str, second: str, size: tuple, margin_px: float) -> DataFrame:
        dist = lambda a, b: F.hypot((F.col(f"{first}{a}x") - F.col(f"{second}{b}x")) * size[0], (F.col(f"{first}{a}y") - F.col(f"{second}{b}y")) * size[1])
        swap = given & (dist("l", "r") + dist("r", "l") < dist("l", "l") + dist("r", "r") - margin_px)  # null if one is missing
        return rows.withColumn("part", F.when(swap, other).otherwise(F.col("part")))

    four = {f"{tag}{p[0]}{c}": pair(of, p, c) for tag, of in (("h", ~F.col("body")), ("b", F.col("body"))) for p in ("left", "right") for c in "xy"}
    once = flipped(both.select("*", *[v.alias(k) for k, v in four.items()]).filter("not body"), "h", "b", (WIDTH, HEIGHT), BODY_MARGIN).select(*kept)
    # A wrist that is no view keeps its row, without sums.
    rows = once.join(F.broadcast(cameras.drop("ord").withColumn("listed", F.lit(True))), "cam_id", "left")
    seen = F.col("listed") & (F.coalesce("conf", F.lit(0.0)) >= min_conf)
    rows = rows.withColumns({"seen": F.coalesce(seen, F.lit(False)), "u": to_pixels("x", "width"), "v": to_pixels("y", "height")})
    rows = rows.select(*kept, "seen", "u", "v", *[F.when(F.col("seen"), t).alias(f"g{k}") for k, t in enumerate(gram_terms("u", "v"))], *[c for r in projection_rows() for c in r])
    frame = Window.partitionBy("session", "frame", "part")
    rows = rows.withColumns({f"o{k}": F.sum(f"g{k}").over(frame) - F.col(f"g{k}") for k in range(10)} | {"solved": F.col("seen") & (F.sum(F.col("seen").cast("int")).over(frame) >= 3)})
    rows = rows.withColumn("p", null_point(*[F.when(F.col("solved"), F.col(f"o{k}")) for k in range(10)]))
    pu, pv = project("p.x", "p.y", "p.z")
    rows = rows.select(*kept, F.col("p.x").isNotNull().alias("solved"), "u", "v", pu.alias("pu"), pv.alias("pv"))
    four = {f"{tag}{p[0]}{c}": pair(F.col("solved"), p, name) for tag, of in (("h", ("u", "v")), ("p", ("pu", "pv"))) for p in ("left", "right") for c, name in zip("xy", of, strict=True)}
    return flipped(rows.select("*", *[v.alias(k) for k, v in four.items()]), "h", "p", (1.0, 1.0), OTHERS_MARGIN).select(*kept)


def _penalised(wrists: DataFrame, frames: DataFrame, max_px: float = 200.0, factor: float = 0.01) -> DataFrame:
    """What penalise() gives of the fast steps of velocity() among the wrists themselves: listed frames stand among the rows, so that a session is dealt out once."""
    rows = wrists.withColumn("wrist", F.lit(True)).unionByName(frames, allowMissingColumns=True)
    rows = rows.withColumn("ord_f", F.dense_rank().over(Window.partitionBy("session").orderBy("frame"))).filter("wrist")
    w = Window.partitionBy("session", "cam_id", "part").orderBy("frame")
    px = F.hypot((F.col("x") - F.lag("x").over(w)) * WIDTH, (F.col("y") - F.lag("y").over(w)) * HEIGHT)
    listed = F.col("session").isNotNull() & F.col("frame").isNotNull()
    rows = rows.withColumn("fast", F.coalesce(listed & (F.col("ord_f") - F.lag("ord_f").over(w) == 1) & (px > max_px), F.lit(False)))
    rows = rows.withColumn("penalised", F.max("fast").over(Window.partitionBy("session", "cam_id", "part", "frame")))
    return rows.select(*HAND, "part", F.when(F.col("penalised"), F.coalesce("conf", F.lit(0.0)) * factor).otherwise(F.col("conf")).alias("conf"), "penalised")


def _swapped(points: DataFrame) -> DataFrame:
    """Sides exchanged in every fifth frame in one camera."""
    hit = (F.col("frame") % 5 == 0) & (F.col("ord") == F.col("frame") % 7)
    other = F.when(F.col("part") == "left", "right").otherwise("left")
    return points.withColumn("part", F.when(hit, other).otherwise(F.col("part")))


def _loo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leave_one_out_swap(views(_swapped(keypoints(spark, sf_dir)), calibration(spark)))


def _two_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first source has neither noise nor exchanged sides."""
    both, second = keypoints(spark, sf_dir, sources=(0.0, 2.0)), F.col("source_ord") == 1
    swapped = _swapped(both.withColumn("own", F.col("part")))
    return swapped.withColumns({"part": F.when(second, F.col("part")).otherwise(F.col("own")), "conf": F.when(second, F.round(1.2 - F.col("conf"), 2)).otherwise(F.col("conf"))}).drop("own")


def _bad(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = keypoints(spark, sf_dir).filter("lm_id = 0")
    side = lambda p, limit: F.max(F.when((F.col("part") == p) & ((F.col("conf") < limit)), 1).otherwise(0))
    return k.groupBy("cam_id", "frame").agg(side("left", 0.5).alias("left_bad"), side("right", 0.7).alias("right_bad"))


_K = "with " + keypoints_sql(0.0)
_SW = _K + """, sw as (select frame, lm_id, cam_id, ord, x, y, conf, case when frame % 5 = 0 and ord = frame % 7 then case when part = 'left' then 'right' else 'left' end else part end as part from keypoint)"""
_TWO = (
    "with " + keypoints_sql(0.0).replace("keypoint as", "k0 as") + ", " + keypoints_sql(2.0)[keypoints_sql(2.0).index("keypoint as") :].replace("keypoint as", "k2 as")
    + """, two as (select frame, part, lm_id, cam_id, ord, x, y, conf, 0 as source_ord from k0 union all
 select frame, case when frame % 5 = 0 and ord = frame % 7 then case when part = 'left' then 'right' else 'left' end else part end, lm_id, cam_id, ord, x, y, round(1.2 - conf, 2), 1 from k2)"""
)
_BW = _SW + f""", p as (select h.cam_id, h.frame, max(case when h.part = 'left' then h.x end) as hlx, max(case when h.part = 'left' then h.y end) as hly, max(case when h.part = 'right' then h.x end) as hrx, max(case when h.part = 'right' then h.y end) as hry from sw h where lm_id = 0 group by h.cam_id, h.frame),
 b as (select cam_id, frame, max(case when part = 'left' then x end) as blx, max(case when part = 'left' then y end) as bly, max(case when part = 'right' then x end) as brx, max(case when part = 'right' then y end) as bry from keypoint where lm_id = 0 group by cam_id, frame),
 t as (select cam_id, frame, sqrt(pow((hlx - blx) * {WIDTH}, 2) + pow((hly - bly) * {HEIGHT}, 2)) + sqrt(pow((hrx - brx) * {WIDTH}, 2) + pow((hry - bry) * {HEIGHT}, 2)) as labelled_px,
  sqrt(pow((hlx - brx) * {WIDTH}, 2) + pow((hly - bry) * {HEIGHT}, 2)) + sqrt(pow((hrx - blx) * {WIDTH}, 2) + pow((hry - bly) * {HEIGHT}, 2)) as swapped_px from p join b using (cam_id, frame))"""
_STEP = _K + f""", f as (select frame, dense_rank() over (partition by session order by frame) as o from (select distinct session, frame from keypoint)),
 s as (select cam_id, part, frame, case when o - lag(o) over w = 1 then sqrt(pow((x - lag(x) over w) * {WIDTH}, 2) + pow((y - lag(y) over w) * {HEIGHT}, 2)) end as step_px
  from keypoint join f using (frame) where lm_id = 0 window w as (partition by session, cam_id, part order by o))"""


def _wrists(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = keypoints(spark, sf_dir)
    return velocity(k.filter("lm_id = 0"), k)


def _outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    flagged = mad_outliers(_wrists(spark, sf_dir).filter("step_px is not null"), ["cam_id", "part"], "step_px", 2.0)
    return flagged.select("cam_id", "part", "frame", "flag")


def _smoothed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wrists with a jump in every 41st frame, against the same ones smoothed in x."""
    raw = true_points(spark, sf_dir).filter("lm_id = 0").withColumn("x", F.when(F.col("frame") % 41 == 0, F.col("x") + 3.0).otherwise(F.col("x")))
    fine = savgol(raw, ["session", "part"], "x", whole=False).select("session", "part", "frame", F.col("smooth").alias("x"), "y", "z")
    return smoothing_outliers(raw, fine, ["session", "part"]).select("session", "part", "frame", F.round("residual", 6).alias("residual"), "flag")


QUERIES = {
    "smoothing_outliers": _smoothed,
    "detection_rate": lambda spark, sf: detection_rates(k := keypoints(spark, sf), k, 0.6),
    "cooccurrence": lambda spark, sf: co_occurrence(_bad(spark, sf)),
    "combine_max": lambda spark, sf: combine_max(_two_sources(spark, sf)).select("cam_id", "frame", "part", "lm_id", "source_ord", F.round("conf", 4).alias("conf")),
    # A little is added before rounding, off the ties that the two engines round apart.
    "combine_weighted": lambda spark, sf: combine_weighted(_two_sources(spark, sf)).select("cam_id", "frame", "part", "lm_id", *[F.round(F.col(c) + 3.3e-8, 6).alias(c) for c in ("x", "y", "conf")]),
    "source_disagreement": lambda spark, sf: source_disagreement(_two_sources(spark, sf)).select("cam_id", "frame", F.round("same_px", 3).alias("same_px"), F.round("cross_px", 3).alias("cross_px"), "likely_swap"),
    "bodywrist_swap": lambda spark, sf: body_wrist_swap(_swapped(k := keypoints(spark, sf)), k).select("cam_id", "frame", F.round("margin", 3).alias("margin"), "swap"),
    "loo_swap": lambda spark, sf: _loo(spark, sf).select("cam_id", "frame", "swap"),
    "velocity": lambda spark, sf: _wrists(spark, sf).withColumn("step_px", F.round("step_px", 3)),
    "jitter_flags": _outliers,
    "wrist_jitter": lambda spark, sf: wrist_jitter(true_points(spark, sf)),
    "swap_correct": lambda spark, sf: swap_correct(_swapped(k := keypoints(spark, sf)), body_wrist_swap(_swapped(k), k)).select("cam_id", "frame", "part", "lm_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y")),
    "conf_penalty": lambda spark, sf: penalise(keypoints(spark, sf).filter("lm_id = 0").select("cam_id", "frame", "part", "conf"), _wrists(spark, sf).filter("fast")).withColumn("conf", F.round("conf", 6)),
    "corrections": lambda spark, sf: correct(_swapped(k := keypoints(spark, sf)), k, calibration(spark))[1].withColumn("conf", F.round("conf", 6)),
    "threshold_sweep": lambda spark, sf: threshold_sweep(body_wrist_swap(_swapped(k := keypoints(spark, sf)), k), [5.0, 20.0, 400.0, 1000.0]),
}
_MEAN7 = " + ".join(f"{k} * {x}" for k, x in zip((-2, 3, 6, 7, 6, 3, -2), [f"lag(x, {n}) over w" if n > 0 else f"lead(x, {-n}) over w" if n < 0 else "x" for n in range(3, -4, -1)], strict=True))
ORACLE_SQL = {
    "smoothing_outliers": f"""with {POINTS_SQL}, q as (select session, part, frame, case when frame % 41 = 0 then x + 3 else x end as x from points where lm_id = 0),
 s as (select *, abs(x - coalesce(({_MEAN7}) / 21.0::double, x)) as residual from q window w as (partition by session, part order by frame)),
 m as (select *, median(residual) over (partition by session, part) as mid from s), d as (select *, median(abs(residual - mid)) over (partition by session, part) as mad from m)
 select session, part, frame, round(residual, 6) as residual, residual > mid + 4 * (mad + 1e-9) as flag from d""",
    "detection_rate": _K + "select cam_id, part, count(distinct case when conf >= 0.6 then frame end) as detected, round(count(distinct case when conf >= 0.6 then frame end) / cast((select count(distinct frame) from keypoint) as double), 6) as rate from keypoint group by cam_id, part",
    "cooccurrence": _K + """, b as (select cam_id, frame, max(case when part = 'left' and conf < 0.5 then 1 else 0 end) as l, max(case when part = 'right' and conf < 0.7 then 1 else 0 end) as r from keypoint where lm_id = 0 group by cam_id, frame)
 select cam_id, case when max(l) > min(l) and max(r) > min(r) then round(corr(l, r), 6) end as corr from b group by cam_id""",
    "combine_max": _TWO + "select cam_id, frame, part, lm_id, source_ord, round(conf, 4) as conf from (select *, max(conf) over (partition by cam_id, frame, part) as best, rank() over (partition by cam_id, frame, part order by conf desc, source_ord) as r from two) where r = 1",
    "combine_weighted": _TWO + """select cam_id, frame, part, lm_id, round(list_reduce(list(greatest(conf, 1e-6) * x order by source_ord), lambda a, b: a + b) / list_reduce(list(greatest(conf, 1e-6) order by source_ord), lambda a, b: a + b) + 3.3e-8, 6) as x,
 round(list_reduce(list(greatest(conf, 1e-6) * y order by source_ord), lambda a, b: a + b) / list_reduce(list(greatest(conf, 1e-6) order by source_ord), lambda a, b: a + b) + 3.3e-8, 6) as y, round(max(conf) + 3.3e-8, 6) as conf from two group by cam_id, frame, part, lm_id""",
    "source_disagreement": _TWO + f""", q as (select cam_id, frame, lm_id, {", ".join(f"max(case when source_ord = {n} and part = '{p}' then {c} * {size} end) as {p[0]}{n}{c}" for n in (0, 1) for p in ("left", "right") for c, size in (("x", WIDTH), ("y", HEIGHT)))} from two group by cam_id, frame, lm_id),
 d as (select cam_id, frame, {", ".join(f"avg(sqrt(pow({a}x - {b}x, 2) + pow({a}y - {b}y, 2))) as {a}{b}" for a, b in (("l0", "l1"), ("r0", "r1"), ("l0", "r1"), ("r0", "l1")))} from q where l0x is not null and l1x is not null and r0x is not null and r1x is not null group by cam_id, frame)
 select cam_id, frame, round((l0l1 + r0r1) / 2, 3) as same_px, round((l0r1 + r0l1) / 2, 3) as cross_px, (l0r1 + r0l1) / 2 < 0.5::double * (l0l1 + r0r1) / 2 as likely_swap from d""",
    "bodywrist_swap": _BW + " select cam_id, frame, round(labelled_px - swapped_px, 3) as margin, swapped_px < labelled_px - 20 as swap from t",
    "velocity": _STEP + " select cam_id, part, frame, round(step_px, 3) as step_px, coalesce(step_px > 200, false) as fast from s",
    "jitter_flags": _STEP + """, m as (select *, median(step_px) over (partition by cam_id, part) as mid from s where step_px is not null), d as (select *, median(abs(step_px - mid)) over (partition by cam_id, part) as mad from m)
 select cam_id, part, frame, step_px > mid + 2 * (mad + 1e-9) as flag from d""",
    "wrist_jitter": f"with {POINTS_SQL}, s as (select session, part, sqrt(pow(x - lag(x) over w, 2) + pow(y - lag(y) over w, 2) + pow(z - lag(z) over w, 2)) as step from points where lm_id = 0 window w as (partition by session, part order by frame)) select session, part, round(avg(step), 6) as mean_step, count(step) as n from s group by session, part",

    "conf_penalty": _STEP + " select k.cam_id, k.frame, k.part, round(case when coalesce(step_px > 200, false) then conf * 0.01 else conf end, 6) as conf, coalesce(step_px > 200, false) as penalised from keypoint k join s on s.cam_id = k.cam_id and s.part = k.part and s.frame = k.frame where lm_id = 0",
    "threshold_sweep": _BW + " select margin_px, count(*) as n, count(case when swapped_px < labelled_px - margin_px then 1 end) as swaps from t, (values (cast(5.0 as double)), (20.0), (400.0), (1000.0)) as m(margin_px) group by margin_px",
}
#: The wrists tell every exchange, so the points must come back as they were.
ORACLE_SQL["swap_correct"] = _K + "select cam_id, frame, part, lm_id, round(x, 6) as x, round(y, 6) as y from keypoint"
ORACLE_SQL["corrections"] = ORACLE_SQL["conf_penalty"]
