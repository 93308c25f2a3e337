"""Plans that must not shuffle more than the input, and results at sizes that the small tables don't reach."""

import re

import pytest

import __spark_entry__


def exchanges(df) -> list[str]:
    """What the plan shuffles by hash, in its own words."""
    return exchanges_of(df._jdf.queryExecution().executedPlan().toString())


def exchanges_of(plan: str) -> list[str]:
    return re.findall(r"Exchange hashpartitioning\(([^)]*), \d+\)", plan)


@pytest.mark.parametrize("name", ["triangulate", "triangulate_weighted", "triangulate_older", "hand_boxes", "part_confidence"])
def test_views_stay_with_their_frame(spark, sf_dir, name):
    assert len(exchanges(__spark_entry__.queries()[name](spark, sf_dir))) == 1  # of lineitem, by order


@pytest.mark.parametrize("name", ["pair_rank", "triangulate_robust", "triangulate_planted", "robust_set", "robust_planted"])
def test_views_are_not_joined_with_themselves(spark, sf_dir, name):
    """Of lineitem and of what is chosen or counted; never by a view's camera."""
    plan = exchanges(__spark_entry__.queries()[name](spark, sf_dir))
    assert len(plan) <= 6 and not any("cam_id" in x for x in plan)


def test_steady_cameras_deal_views_out_once(spark, sf_dir):
    plan = exchanges(__spark_entry__.queries()["steady_cameras"](spark, sf_dir))
    assert not any("cam_id" in x for x in plan)
    assert __spark_entry__.queries()["steady_cameras"](spark, sf_dir).count() == 2946


def test_steady_sets_go_on_over_batches(spark, sf_dir):
    """The best sets worked out where the views lie are robust_cameras(); what a batch ends with is handed on; frames that are not listed, and gaps, forget it."""
    from pyspark.sql import functions as F

    from mvspark.operators.sequences import steady_cameras
    from mvspark.operators.triangulate import robust_cameras, views
    from mvspark.plans.fixtures import calibration, keypoints

    off_px = lambda a, b: ((F.col("frame") * a + F.col("ord") * b + F.col("frame") * F.col("ord") * 13) % 17 - 8) * 0.8
    k = keypoints(spark, sf_dir).filter("lm_id = 0").withColumns({"x": F.col("x") + off_px(31, 57) / 3360, "y": F.col("y") + off_px(7, 11) / 1890, "session": F.floor(F.col("frame") / 700).cast("long")})
    k = k.filter("frame % 700 > 4")
    seen = views(k, calibration(spark), 0.4)
    frames = k.filter("frame % 11 > 0")
    rows = lambda df: sorted((r.session, r.part, r.frame, r.cameras, r.n_inliers, round(r.mean_err, 9), r.held) for r in df.collect())
    one, few = (rows(steady_cameras(seen, None, frames, 4.0, rows=n)) for n in (1 << 20, 7))
    assert one == few == rows(steady_cameras(seen, robust_cameras(seen, 4.0), frames, 4.0))
    assert any(r[-1] for r in one) and not any(r[2] % 11 == 0 for r in one)
    assert steady_cameras(seen.limit(0), None, frames).count() == 0 == steady_cameras(seen, None, frames.limit(0)).count()


def test_steady_wrists_are_rows(spark, sf_dir):
    """No group of a session is held: its views were handed to one call whole, and each frame was a table of its own."""
    plan = __spark_entry__.queries()["steady_cameras"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "CoGroup" not in plan and "MapInArrow" in plan


@pytest.mark.parametrize("name", ["combine_max", "combine_weighted", "source_disagreement"])
def test_sources_stand_beside_each_other(spark, sf_dir, name):
    assert len(exchanges(__spark_entry__.queries()[name](spark, sf_dir))) <= 2


def test_medians_hold_no_series(spark):
    from mvspark.operators.quality import mad_outliers

    rows = spark.createDataFrame([("a", float(x)) for x in (1, 2, 3, 4, 100)] + [("b", None)], "k string, x double")
    found = mad_outliers(rows, ["k"], "x")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "median" not in plan and "percentile" not in plan
    assert sorted((r.k, r.x, r.flag) for r in found.collect() if r.x) == [("a", 1.0, False), ("a", 2.0, False), ("a", 3.0, False), ("a", 4.0, False), ("a", 100.0, True)]
    assert [r.flag for r in found.collect() if r.k == "b"] == [None]


def test_frames_past_six_digits(spark):
    """Their keys are cut to six digits, as in the SQL; no text may hold one twice, and no frame may get lost."""
    from pyspark.sql import functions as F

    from mvspark.sources.logs import keypoint_texts, parse_keypoints, text_of

    idx = F.col("id")
    log = spark.range(100_000, 100_003).union(spark.range(1_000_000, 1_000_025)).union(spark.range(10_000_000, 10_000_013))
    log = log.select(text_of(F.lit("cam1"), idx).alias("part"), F.lit("cam1").alias("cam_id"), F.lpad(idx.cast("string"), 6, "0").alias("frame_key"), F.lit(0).alias("lm_id"), idx.cast("double").alias("x"), F.lit(0.5).alias("y"), F.lit(0.5).alias("z"))
    found = sorted(r.x for r in parse_keypoints(keypoint_texts(log, ["part"]), ["part"]).collect())
    assert found == [*map(float, [*range(100_000, 100_003), *range(1_000_000, 1_000_025), *range(10_000_000, 10_000_013)])]


def test_a_row_over_the_limit_ends_at_the_query_depth(spark, tmp_path):
    import duckdb

    from mvspark.llm.extendible_sharding import FINE_BYTES, oracle, shards_of_64k

    rows = [(k, "x" * (70_000 if k == 7 else 900)) for k in range(300)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(oracle(FINE_BYTES)).fetchall()
    assert sorted(map(tuple, shards_of_64k(spark, str(tmp_path)).collect())) == sorted(want)


def test_all_trusted_texts_count(spark):
    from pyspark.sql import functions as F

    from mvspark.llm.kneser_ney import classify, trusted_ids

    labels = spark.range(60_000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    assert trusted_ids(labels).count() == 60_000
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.concat(F.lit("some plain words, number "), F.col("id").cast("string")).alias("text"), F.lit("en").alias("lang"))
    ways = [sorted((r.doc_id, round(r.perplexity, 9), round(r.threshold, 9), r.kept) for r in classify(docs, labels, max_ids=n).collect()) for n in (0, 60_000)]
    assert ways[0] == ways[1]  # joined and broadcast


def test_samples_just_as_far_apart_as_the_limit(spark, tmp_path):
    """Prices 5,000.00 apart are poses 0.05 m apart: they count as near or not as in the SQL, in each camera."""
    import duckdb

    from mvspark.operators.samples import ORACLE_SQL, QUERIES
    from tests.oracle import same

    rows = [(359 + 1200 * i + 300 * k, (500_000 * (4 * i + k) + 37_137 * i) / 100) for i in range(70) for k in (0, 1)]
    spark.createDataFrame(rows, "o_orderkey long, o_totalprice double").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    con.execute(f"create view orders as select * from '{tmp_path}/orders.parquet/*.parquet'")
    same(QUERIES["calibration_samples"](spark, str(tmp_path)), con, ORACLE_SQL["calibration_samples"])


@pytest.mark.parametrize("landmarks", [None, (0,)])
def test_only_chosen_frames_are_pooled(spark, sf_dir, landmarks):
    """Views are neither dealt out by landmark nor by camera, and ranges of frames don't change what is chosen."""
    from mvspark.operators.triangulate import _seen, correspondences

    seen = _seen(spark, sf_dir)
    found = [correspondences(seen, 20, landmarks, ("frame",), width) for width in (1 << 12, 100)]
    assert not any("lm_id" in x or x.endswith("frame") for x in exchanges(found[0]))
    assert sorted(found[0].collect()) == sorted(found[1].collect())


def test_cameras_vertices_stay_with_their_frame(spark, sf_dir):
    assert len(exchanges(__spark_entry__.queries()["mesh_fuse"](spark, sf_dir))) == 1  # of lineitem, by order


def test_only_the_newest_views_are_gathered(spark):
    from pyspark.sql import functions as F

    from mvspark.streaming.states import POSES, newest_points_of

    rows = spark.range(40).select(F.lit("rig").alias("rig_id"), (F.col("id") % 2).cast("string").alias("cam_id"), (F.col("id") / 100).alias("ts_s"), F.array(F.lit(0)).alias("lm"), *[F.array(F.lit(1.0)).alias(c) for c in "uv"], F.array(*[(F.col("id") % 2 + k * k).cast("double") for k in range(12)]).alias("p"))
    found = newest_points_of(rows)
    assert len(POSES) == 12 and "max_by" not in found._jdf.queryExecution().executedPlan().toString()
    assert [(r.ts_s, r.lm_id, r.n_views) for r in found.collect()] == [(0.39, 0, 2)]


def test_meshes_are_not_dealt_out_by_frame(spark, sf_dir):
    """Wrists by session, before they have vertices, and lineitem by order: twice, as the listed frames are read too."""
    plan = [re.sub(r"#\d+L?", "", x) for x in exchanges(__spark_entry__.queries()["mesh_over_time"](spark, sf_dir))]
    assert sorted(plan) == ["l_orderkey", "l_orderkey", "session", "session"]


def test_series_of_shapes_are_tried_at_once():
    """Every row's shape and cameras are those of one row after another, whatever a row before turned out to be."""
    import numpy as np

    from mvspark.operators.meshes import fuse_series, fuse_shapes

    rng = np.random.default_rng(4)
    shapes, weights = rng.normal(size=(200, 1, 5, 3)) * 0.02 + rng.normal(size=(200, 4, 5, 3)) * rng.choice([0.01, 0.1], (200, 4, 1, 1)), rng.random((200, 4)) + 0.5
    there = rng.random((200, 4)) < 0.8
    there[:, 0], shapes[~there] = True, 0.0
    follows = np.where(rng.random(200) < 0.9, np.arange(200) - 1, -1)
    follows[0], first = -1, {0: shapes[5, 0]}
    fused, keep = fuse_series(shapes, weights, there, np.full(200, 5), follows, first)
    last, differs = None, 0
    for k in range(200):
        before = first.get(k) if follows[k] < 0 else last
        own = np.flatnonzero(there[k])
        last, kept = fuse_shapes(shapes[k][own], weights[k][own], before)
        assert np.allclose(last, fused[k]) and [*own[kept]] == [*np.flatnonzero(keep[k])]
        differs += not np.array_equal(kept, fuse_shapes(shapes[k][own], weights[k][own], None)[1])
    assert differs > 20


def test_meshes_are_turned_where_they_are_fused(spark):
    """As vertices one by one: cameras that are not listed, hands of unlike sizes, sessions with equal frames, batches that end anywhere."""
    import numpy as np

    from mvspark.operators import meshes

    rng = np.random.default_rng(6)
    rows = []
    for session, side, size in ((1, "left", 4), (1, "right", 3), (2, "left", 4)):
        for frame in range(10, 22):
            for cam in "abcd":
                if rng.random() < 0.85:
                    wrist = [*map(float, rng.normal(size=3))]
                    rows += [(session, frame, side, cam, v, *map(float, wrist + rng.normal(size=3) * 0.05), *wrist, float(1 + ord(cam) % 3)) for v in range(size)]
    rng.shuffle(rows)
    names = "session long, frame long, side string, cam_id string, vert_id int, x double, y double, z double, wx double, wy double, wz double, weight double"
    mesh = spark.createDataFrame([(int(s), int(f), side, cam, int(v), *map(float, x)) for s, f, side, cam, v, *x in rows], names)
    turns = [(c, [float(x) for x in np.linalg.qr(rng.normal(size=(3, 3)))[0].ravel()], [float(x) for x in rng.normal(size=3)]) for c in "abc"]
    cameras = spark.createDataFrame(turns, "cam_id string, r array<double>, t array<double>")
    frames = spark.createDataFrame([(s, f) for s in (1, 2) for f in range(10, 22) if (s, f) != (1, 15)], "session long, frame long")
    rounded = lambda df: sorted((*r[:4], *[round(x, 9) for x in r[4:]]) for r in map(tuple, df.collect()))
    want = rounded(meshes.fuse_over_time(meshes.to_world(mesh, cameras).select(mesh.columns), frames))
    for n in (1, 5, 2048):
        assert rounded(meshes.fuse_whole(meshes.whole(mesh), frames, cameras=cameras, rows=n)) == want
    assert {r[:2] for r in want} == {(s, f) for s in (1, 2) for f in range(10, 22)} - {(1, 15)}


def test_no_vertex_is_handed_to_the_tasks(spark, sf_dir):
    """Wrists are put in order; neither array functions nor a sort see whole meshes, and no double becomes a decimal number."""
    plan = __spark_entry__.queries()["mesh_over_time"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "transform(" not in plan and "round(" not in plan and plan.count("MapInArrow") == 1
    assert "Sort [" not in plan[: plan.index("Window [count(mark")]


def test_blocks_are_dealt_out_once(spark, sf_dir):
    """All readers of the blocks share what is dealt out (in the plan that was run), and no pandas group holds a series' states."""
    df = __spark_entry__.queries()["kalman_rts"](spark, sf_dir)
    assert df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    own = exchanges_of("\n".join(line for line in plan.splitlines() if "ReusedExchange" not in line))
    own = [re.sub(r"#\d+L?", "", x) for x in own]
    assert "Final Plan" in plan and "FlatMapGroupsInPandas" not in plan
    assert own.count("session, part, lm_id, block") <= 3  # blocks, and their states forwards and backwards


@pytest.mark.parametrize("together", [None, ("frame",)])
def test_smoothing_by_frame_alone(spark, together):
    """Frames that several sessions list, null keys, and a last block without points."""
    from mvspark.operators.smooth import smooth

    frames = spark.range(60).selectExpr("id % 2 as session", "id div 2 as frame").unionByName(spark.range(5).selectExpr("7 as session", "id + 2 as frame"))
    points = frames.filter("frame % 3 > 0").selectExpr("session", "case when frame = 4 then null else 'a' end as part", "frame", "session + frame * 0.5D as x", "1.0D as y", "cast(frame as double) as z", "4 as n_views").filter("part is null or frame < 20")
    found = smooth(points, frames, ["session", "part"], block=4, together=together).collect()
    got = {(r.session, r.frame): (round(r.x, 2), r.observed) for r in found}
    assert {r.part for r in found} == {"a"} and len(got) == len(found) == 2 * 19 + 4
    assert all(got[s, f][1] == (f % 3 > 0 and f != 4) for s, f in got)
    plain = {(r.session, r.frame): (r.x, r.y, r.z) for r in smooth(points, frames, ["session", "part"], block=512).collect()}
    assert all(max(abs(a - b) for a, b in zip((r.x, r.y, r.z), plain[r.session, r.frame], strict=True)) < 1e-9 for r in found)


def test_only_ends_look_up_their_weights(spark):
    """A series of seven or more is one sum of seven; ends, short series and nulls come out as the polynomials have them."""
    import numpy as np

    from mvspark.operators.smooth import SAVGOL, savgol, savgol_weights

    rng = np.random.default_rng(5)
    series = {n: rng.random(n).tolist() for n in (4, 5, 6, 7, 12)}
    rows = spark.createDataFrame([(n, k, x) for n, xs in series.items() for k, x in enumerate(xs)] + [(99, k, None if k == 5 else float(k)) for k in range(12)], "s int, frame int, x double")
    part, whole = savgol(rows, ["s"], "x", whole=False), savgol(rows, ["s"], "x")
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "count(1)" not in plan and "row_number" not in plan and max(plan.count(f"lag(x#{x}, {k}, null)") for x in re.findall(r"lag\(x#(\d+L?)", plan) for k in (-6, 6)) == 0
    assert "zip_with" in whole._jdf.queryExecution().executedPlan().toString()
    got = {(r.s, r.frame): r.smooth for r in whole.collect()}
    for n, xs in series.items():
        size = 7 if n >= 7 else 5
        for k, x in enumerate(xs):
            first = max(0, min(k - size // 2, n - size))
            want = savgol_weights(size)[k - first] @ np.array(xs[first : first + size]) if n >= 5 else x
            assert abs(got[n, k] - want) < 1e-9
    assert [got[99, k] for k in range(12) if k < 9] == [0.0, 1.0, 2.0, 3.0, 4.0, None, 6.0, 7.0, 8.0] and abs(got[99, 11] - 11) < 1e-9
    flat = {(r.s, r.frame): r.smooth for r in part.collect()}
    assert [flat[12, k] for k in (0, 1, 2, 9, 10, 11)] == [series[12][k] for k in (0, 1, 2, 9, 10, 11)]
    assert abs(flat[12, 4] - np.array(SAVGOL) @ np.array(series[12][1:8]) / 21) < 1e-9


@pytest.mark.parametrize("name", ["hand_boxes", "part_confidence"])
def test_frames_are_dealt_out_before_they_have_cameras(spark, sf_dir, name):
    plan = exchanges(__spark_entry__.queries()[name](spark, sf_dir))
    assert [re.sub(r"#\d+L?", "", x) for x in plan] == ["frame"]


def test_lists_of_landmarks_are_groups(spark):
    from pyspark.sql import functions as F

    from mvspark.operators.hands import part_confidence
    from mvspark.operators.occlusion import landmark_boxes

    rows = spark.createDataFrame([("a", 1.0, 2.0, 0.5), ("a", 3.0, None, None), ("a", None, 7.0, 0.75), ("b", None, None, None)], "k string, x double, y double, conf double")
    # collect_list leaves nulls out, an array of structs does not
    lists = rows.groupBy("k").agg(F.collect_list(F.struct("x", "y", "conf")).alias("p")).select("k", *[F.col(f"p.{c}").alias(c) for c in ("x", "y", "conf")])
    for f in (landmark_boxes, part_confidence):
        assert sorted(map(str, f(rows, ["k"]).collect())) == sorted(map(str, f(lists, ["k"], lists=True).collect()))


def test_boxes_reach_over_ranges_of_frames(spark, sf_dir):
    """Ranges without a hand, or without any box, hand on what came before and after; no task holds a camera's whole log."""
    from mvspark.operators.occlusion import _hands, occlusions

    keys = ["session_id", "cam_id"]
    boxes = _hands(spark, sf_dir).filter("not (place = 2 and frame % 100 between 20 and 60) and frame % 200 not between 100 and 130")
    one, many = (sorted(occlusions(boxes, keys, width=width).collect()) for width in (1 << 20, 7))
    assert one == many and any(r.iou > 0 for r in many)
    assert "frame" not in " ".join(exchanges(occlusions(boxes, keys)))  # by range


def test_null_keys_stay_in_ranges(spark):
    from mvspark.functions.series import ranked_in_blocks
    from mvspark.operators.occlusion import occlusions

    rows = spark.createDataFrame([(None, 1.0), (None, 9.0), ("a", None), ("a", 5.0)], "k string, t double")
    assert sorted(((r.k, r.t, r.n) for r in ranked_in_blocks(rows, ["k"], "t", 2.0, "n").collect()), key=str) == [("a", 5.0, 1), ("a", None, 0), (None, 1.0, 0), (None, 9.0, 1)]
    box = [0.0, 0.0, 10.0, 10.0, False]
    boxes = spark.createDataFrame([(None, 0, 1, *box), (None, 0, 2, *box), (None, 9, 1, *box)], "cam string, frame long, place int, x0 double, y0 double, x1 double, y1 double, disagree boolean")
    assert [(r.cam, r.frame, r.iou, r.occluded) for r in occlusions(boxes, ["cam"], width=2).collect()] == [(None, 9, 1.0, True)]


def test_a_folder_is_written_by_few_tasks(spark, tmp_path):
    from pathlib import Path

    from pyspark.sql import functions as F

    from mvspark.sources.stored import extract_missing

    rows = spark.range(2000).select((F.col("id") % 20).alias("session"), F.lit("a").alias("cam_id"), F.col("id").alias("frame")).repartition(8, "frame")
    path = str(tmp_path / "store")
    found = extract_missing(rows, lambda missing: missing.withColumn("n", F.lit(1)), path, ["n"])
    assert found.count() == 2000 and len([*Path(path).rglob("*.parquet")]) == 20  # a file a folder, not one of each task


def test_checkpoints_leave_no_shuffle_files(spark):
    import pathlib

    from mvspark.llm.common import RELEASE
    from mvspark.llm.components import components

    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()

    def files() -> set[str]:
        return {p.name for folder in folders for p in pathlib.Path(str(folder)).rglob("shuffle_*")}

    before, given = files(), spark.conf.get(RELEASE)
    chain = spark.range(200).selectExpr("id + 1 as a", "id as b")
    found = components(chain)
    assert not files() - before and spark.conf.get(RELEASE) == given
    for _ in range(2):  # what was found can be asked again
        assert {(r.node, r.root) for r in found.collect()} == {(k, 0) for k in range(201)}


@pytest.mark.parametrize("name", ["corrections", "corrections_distorted"])
def test_corrections_stay_with_their_frame(spark, sf_dir, name):
    """Of lineitem by order (hands and body), of wrists by view after the solve, of frames, and by session."""
    assert len(exchanges(__spark_entry__.queries()[name](spark, sf_dir))) <= 5


def test_corrections_are_their_steps(spark, sf_dir):
    """Wrists that are missing, of cameras that are not listed or without confidence keep their rows as in the steps one by one."""
    from pyspark.sql import functions as F

    from mvspark.operators.quality import _swapped, correct, penalise, velocity
    from mvspark.plans.fixtures import calibration, keypoints

    body = keypoints(spark, sf_dir).filter("lm_id < 2")
    odd = F.pmod(F.hash("frame", "part", "cam_id"), F.lit(23))
    hands = _swapped(body).filter(~((odd == 3) & (F.col("lm_id") == 0))).filter(odd != 4)
    hands = hands.withColumns({"conf": F.when(odd != 5, F.col("conf")), "cam_id": F.when(odd == 6, "cam9").otherwise(F.col("cam_id"))})
    twice, found = correct(hands, body.filter(odd != 8), calibration(spark))
    wrists = twice.filter("lm_id = 0")
    wanted = penalise(wrists.select("cam_id", "frame", "part", "conf"), velocity(wrists, hands).filter("fast"))
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert rows(found) == rows(wanted) and {r.penalised for r in found.collect()} == {True, False}
