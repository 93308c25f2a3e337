import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from mvspark.functions.geometry import angle_degrees, box_iou, quaternion, undistort
from mvspark.functions.rotations import rotation_matrix, rotation_vector, turn_slope
from mvspark.functions.series import spaced
from mvspark.operators import align, calibration, lens, meshes, occlusion, quality, rig_graph, sequences, smooth, tracks
from mvspark.operators.rig_graph import solve_rigs
from mvspark.operators.triangulate import older_weight, plausible, rank_pairs, triangulate, undistort_points, views
from mvspark.plans.fixtures import calibration as cameras
from mvspark.plans.fixtures import keypoints
from mvspark.sources import records
from mvspark.sources.logs import parse_header, parse_log
from mvspark.streaming import live


def test_swaps_are_found(spark, sf_dir):
    found = {(r.cam_id, r.frame) for r in quality.leave_one_out_swap(views(quality._swapped(keypoints(spark, sf_dir)), cameras(spark))).filter("swap").collect()}
    wrists = keypoints(spark, sf_dir).filter("lm_id = 0").select("frame").distinct().collect()
    planted = {(f"cam{r.frame % 7:02d}", r.frame) for r in wrists if r.frame % 5 == 0 and r.frame % 7 < 4}
    assert planted and planted <= found
    assert not {(c, f) for c, f in found if f % 5}  # no clean frame is flagged


def test_rotations():
    rng = np.random.default_rng(2)
    v = rng.normal(size=(400, 3))
    v *= (np.concatenate([[0.0, 1e-12, 1e-6, 1e-3, np.pi - 1e-9, np.pi - 1e-5, np.pi - 1e-2, np.pi], rng.uniform(0, np.pi, 392)]) / np.linalg.norm(v, axis=1))[:, None]
    r = rotation_matrix(v)
    assert np.allclose(r @ np.swapaxes(r, -1, -2), np.eye(3)) and np.allclose(np.linalg.det(r), 1)
    back = rotation_vector(r)
    assert np.allclose(back[:-397], v[:-397], atol=1e-12) and np.allclose(rotation_matrix(back), r, atol=1e-7)
    assert np.allclose(np.linalg.norm(back - v, axis=1)[np.linalg.norm(v, axis=1) < 3.1], 0, atol=1e-9)
    small = rng.normal(size=(400, 3)) * 1e-6
    some = np.linalg.norm(v, axis=1) < 3
    moved = rotation_vector(rotation_matrix(small) @ r) - v
    assert np.allclose(moved[some], (turn_slope(v) @ small[..., None])[some, :, 0], atol=1e-9)


def test_rigs_are_refined_to_the_least_misfit():
    """Noisy edges of several rigs at once: no small change of any pose lowers the weighted misfit, told without the library's slopes."""
    rng = np.random.default_rng(8)
    rigs, cams = 6, 5
    turn, place = rotation_matrix(rng.normal(size=(rigs, cams, 3))), rng.normal(size=(rigs, cams, 3))
    err, count = np.full((rigs, cams, cams), np.inf), np.zeros((rigs, cams, cams), int)
    r, t = np.zeros((rigs, cams, cams, 3, 3)), np.zeros((rigs, cams, cams, 3))
    for g in range(rigs):
        for a in range(cams):
            for b in range(a + 1, cams):
                if g == 5 and b == 4 or g == 4 and (a, b) == (1, 3):  # the last rig has a camera alone, the one before lacks a pair
                    continue
                m = rotation_matrix(rng.normal(size=3) * 0.08) @ turn[g, b] @ turn[g, a].T
                s = place[g, b] - m @ place[g, a] + rng.normal(size=3) * 0.05
                r[g, a, b], t[g, a, b], r[g, b, a], t[g, b, a] = m, s, m.T, -m.T @ s
                err[g, a, b] = err[g, b, a] = rng.uniform(0.1, 0.5)
                count[g, a, b] = count[g, b, a] = rng.integers(5, 50)
    found, at, ref, alone, error, again = solve_rigs(err, count, r, t)
    assert (error[~alone] > 1).all() and (again == ~alone).all() and alone.sum() == 1 and alone[5, 4]

    def cost(turn, place, g):
        out = 0.0
        for a in range(cams):
            for b in range(a + 1, cams):
                if count[g, a, b]:
                    step = turn[b] @ turn[a].T
                    back = r[g, a, b].T
                    out += count[g, a, b] * (np.sum(rotation_vector(back @ step) ** 2) + np.sum((back @ (place[b] - step @ place[a] - t[g, a, b])) ** 2))
        return out

    for g in range(rigs):
        for c in range(cams):
            if alone[g, c] or c == ref[g, c]:
                assert np.array_equal(found[g, c], np.eye(3)) and not at[g, c].any()
                continue
            for k in range(6):
                ends = []
                for h in (1e-5, -1e-5):
                    some, there = found[g].copy(), at[g].copy()
                    e = np.eye(3)[k % 3] * h
                    some[c], there[c] = (rotation_matrix(e) @ some[c], there[c]) if k < 3 else (some[c], there[c] + e)
                    ends.append(cost(some, there, g))
                assert abs(ends[0] - ends[1]) / 2e-5 < 1e-5 and min(ends) > cost(found[g], at[g], g)


def test_pose_graph_of_any_names_and_order(spark):
    """Edges told from either end; rigs without edges, without a name and of several sizes; no rows at all."""
    eye, turned = np.eye(3).ravel().tolist(), rotation_matrix(np.array([0, 0, np.radians(6)])).ravel().tolist()
    back = np.reshape(turned, (3, 3)).T.ravel().tolist()
    edges = [(rig, "a", "b", eye, [0.0] * 3, 0.1, 9) for rig in ("r", None)] + [(rig, "c", "b", eye, [0.0] * 3, 0.1, 9) for rig in ("r", None)] + [("r", "a", "c", turned, [0.0] * 3, 0.3, 9), (None, "c", "a", back, [0.0] * 3, 0.3, 9)]
    edges = spark.createDataFrame(edges, "rig_id string, cam_a string, cam_b string, r array<double>, t array<double>, err double, n long")
    cams = spark.createDataFrame([("r", "d"), ("r", "a"), ("q", "a")], "rig_id string, cam_id string")
    out = {(r.rig_id, r.cam_id): r for r in rig_graph.pose_graph(edges, cams).collect()}
    assert {k for k, r in out.items() if r.method == "excluded"} == {("r", "d"), ("q", "a")} and len(out) == 8
    for rig in ("r", None):
        assert out[rig, "a"].method == "graph" and abs(out[rig, "a"].consistency_deg - 2) < 1e-9
        turn = rotation_vector(np.reshape(out[rig, "c"].r, (3, 3)) @ np.reshape(out[rig, "a"].r, (3, 3)).T)
        assert abs(np.degrees(np.linalg.norm(turn)) - 4) < 1e-9  # a third of the six degrees goes to each edge
    assert rig_graph.pose_graph(edges.limit(0), cams.limit(0)).count() == 0


def test_kalman_fills_gaps_of_a_straight_line():
    t = np.arange(40.0)
    xyz = np.stack([t * 0.1, 2 - t * 0.05, np.ones(40)], axis=1)
    valid = t % 7 != 3
    out = smooth.kalman_rts(np.where(valid[:, None], xyz, 0), valid, np.full(40, 0.01))
    assert np.abs(out[5:] - xyz[5:]).max() < 0.02


@pytest.mark.parametrize("block", [4, 16, 512])
def test_smooth_in_blocks(spark, block):
    """Series that span blocks, begin late, have gaps over whole blocks, and frames that are not evenly numbered, against the plain recursion over all listed frames."""
    rng = np.random.default_rng(block)
    rows, frames, want = [], [], {}
    for session in range(3):
        listed = np.cumsum(rng.integers(1, 4, 120 + session))
        frames += [(session, int(f)) for f in listed]
        for lm in range(3):
            xyz, valid, views = np.cumsum(rng.normal(size=(len(listed), 3)) * 0.02, axis=0), rng.random(len(listed)) < 0.6, rng.integers(2, 4, len(listed))
            valid[: 17 * lm], valid[50 : 50 + 30 * lm] = False, False
            out = smooth.kalman_rts(np.where(valid[:, None], xyz, 0), valid, np.where(views == 2, 0.015, 0.01))
            rows += [(session, lm, int(listed[t]), *map(float, xyz[t]), int(views[t])) for t in np.flatnonzero(valid)]
            lo, hi = np.flatnonzero(valid)[[0, -1]]
            want |= {(session, lm, int(listed[t])): (*out[t], bool(valid[t])) for t in range(lo, hi + 1)}
    points = spark.createDataFrame(rows, "session long, lm long, frame long, x double, y double, z double, n_views long")
    got = {(r.session, r.lm, r.frame): (r.x, r.y, r.z, r.observed) for r in smooth.smooth(points, spark.createDataFrame(frames, "session long, frame long"), ["session", "lm"], block=block).collect()}
    assert got.keys() == want.keys()
    assert max(abs(got[k][i] - want[k][i]) for k in want for i in range(3)) < 1e-9
    assert all(got[k][3] == want[k][3] for k in want)
    assert smooth.smooth(points.limit(0), points.select("session", "frame"), ["session", "lm"], block=block).count() == 0


def test_tracks_by_parts(spark):
    """Parts between gaps give the tracks of one scan of each session's camera, whatever the gaps and ranges."""
    rng = np.random.default_rng(8)
    rows = []
    for session in ("s0", "s1"):
        for cam in ("cam0", "cam1"):
            frame = 0
            for _ in range(150):
                frame += int(rng.choice([1, 1, 1, 2, 20, 21, 22, 70]))
                rows += [(session, cam, frame, d, *map(float, (x, 0, x + 100, 100))) for d, x in enumerate(rng.integers(0, 1500, rng.integers(1, 4)))]
    boxes = spark.createDataFrame(rows, "session string, cam_id string, frame int, det_id int, x0 double, y0 double, x1 double, y1 double")
    want = {}
    for (session, cam), own in pd.DataFrame(rows, columns=boxes.columns).assign(cx=lambda d: (d.x0 + d.x1) / 2, cy=50.0).groupby(["session", "cam_id"]):
        own = own.sort_values(["frame", "det_id"])
        want |= dict(zip(zip(own.session, own.cam_id, own.frame, own.det_id, strict=True), tracks.track_scan(own), strict=True))
    old = tracks.RANGE
    try:
        for tracks.RANGE in (50, old):
            got = tracks.tracks(boxes.withColumn("Track", F.lit("x")), ("session", "cam_id"))
            assert {(r.session, r.cam_id, r.frame, r.det_id): r.track for r in got.collect()} == want
    finally:
        tracks.RANGE = old
    assert tracks.tracks(boxes.limit(0), ("session", "cam_id")).count() == 0


@pytest.mark.parametrize("block_s", [1.0, 2.5, 1000.0])
def test_alignment_in_time_blocks(spark, block_s):
    """Blocks that cut between ties, blocks without entries, entries at a block's edge, a camera without valid entries: all as by looking at every entry."""
    rng = np.random.default_rng(4)
    rows = []
    for session in ("a", "b"):
        for cam, n in (("cam0", 60), ("cam1", 40), ("cam2", 9), ("cam3", 3)):
            times = np.sort(rng.choice(np.arange(0, 80), n) / 4) if cam != "cam3" else [float("nan")] * 3
            rows += [(session, cam, i, float(t)) for i, t in enumerate(times)]
    log = spark.createDataFrame(rows, "session_id string, cam_id string, idx int, unified_ts_s double")
    asked = align.slots(log.filter("cam_id <> 'cam3'"), "cam0", block_s=block_s)
    for r in align.nearest(asked, log, block_s=block_s).collect():
        own = [(t, i) for s, c, i, t in rows if (s, c) == (r.session_id, r.cam_id) and t == t]
        before, after = max(((t, i) for t, i in own if t < r.slot_ts_s), default=None), min(((t, i) for t, i in own if t >= r.slot_ts_s), default=None)
        want = before if after is None or before and r.slot_ts_s - before[0] <= after[0] - r.slot_ts_s else after
        assert (r.nearest_ts_s, r.nearest_idx) == (want or (None, None))
    for session in ("a", "b"):
        found = sorted((r.slot, r.slot_ts_s) for r in asked.filter(F.col("session_id") == session).collect())
        starts = [max(f(t for s, c, i, t in rows if (s, c) == (session, cam)) for cam in ("cam0", "cam1", "cam2")) if f is min else min(f(t for s, c, i, t in rows if (s, c) == (session, cam)) for cam in ("cam0", "cam1", "cam2")) for f in (min, max)]
        inside = [t for s, c, i, t in rows if (s, c) == (session, "cam0") and starts[0] <= t <= starts[1]]
        assert found == [*enumerate(inside)]


def test_logs(spark):
    text = "# camera=cam0\n# iso=800 shutter_us=4000 3840x2160@30fps mjpeg_q=70\n# sync_calibration host_ts_s=1.0 device_ts_s=0.75 host_offset_s=0.25\n# unified_time = device_timestamp_s + host_offset_s\n\n1.5 7 1.25 900\nshort line\n1970-01-01T00:00:02 8 NaN 901\n# 1x1@1fps\n"
    df = spark.createDataFrame([("a", text)], "path string, value string")
    rows = parse_log(df, ["path"]).orderBy("idx").collect()
    assert [(r.idx, r.seq, r.host_ts_s) for r in rows] == [(0, 7, 1.5), (1, 8, 2.0)]
    assert parse_header(df, ["path"]).first()[1:] == (3840, 2160, 30.0, 0.25)


def test_older_keypoints(spark):
    text = '{"000001": {"cam0": [{"id": 4, "x": 1, "y": 2, "confidence": 0.5}, {"x": 3.5}], "cam1": {"left_hand": [{"id": 0, "x": 7}], "body": []}}, "000002": {}}'
    df = spark.createDataFrame([("a", text), ("b", "not JSON"), ("c", None)], "path string, value string")
    rows = {(r.path, r.cam_id, r.part, r.pos, r.lm_id, r.x) for r in records.older_keypoints(df, ["path"]).collect()}
    assert rows == {("a", "cam0", "body", 0, 4, 1.0), ("a", "cam0", "body", 1, None, 3.5), ("a", "cam1", "left", 0, 0, 7.0)}


def test_nearest_box_in_time_is_the_earlier_of_two(spark):
    rows = [("c", 0, 2, 0.0), ("c", 1, 1, 0.0), ("c", 2, 2, 500.0), ("c", 2, 1, 0.0), ("d", 5, 1, 0.0)]
    df = spark.createDataFrame(rows, "cam_id string, frame int, place int, x0 double").selectExpr("*", "0d as y0", "x0 + 100 as x1", "100d as y1", "false as disagree")
    assert {(r.cam_id, r.frame, r.place, r.iou, r.occluded) for r in occlusion.occlusions(df, ["cam_id"]).collect()} == {("c", 0, 2, 1.0, True), ("c", 1, 1, 1.0, True), ("d", 5, 1, 0.0, False)}


def test_geometry(spark):
    one = spark.createDataFrame([([1.0, 0.0, 0.0, 0.0, 0.0, -1.0, 0.0, 1.0, 0.0], [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0], 0.0, 0.0, 2.0, 2.0, 1.0, 0.0, 3.0, 2.0)], "r array<double>, s array<double>, x0 double, y0 double, x1 double, y1 double, u0 double, v0 double, u1 double, v1 double")
    q, a, i = one.select(quaternion("r"), angle_degrees("r", "s"), box_iou(["x0", "y0", "x1", "y1"], ["u0", "v0", "u1", "v1"])).first()
    assert np.allclose(q, [0.5**0.5, 0.5**0.5, 0, 0]) and abs(a - 90) < 1e-9 and abs(i - 1 / 3) < 1e-9
    cam = one.select(F.lit(1000.0).alias("fx"), F.lit(1000.0).alias("fy"), F.lit(500.0).alias("cx"), F.lit(400.0).alias("cy"), F.lit(700.0).alias("u"), F.lit(450.0).alias("v"))
    assert np.allclose(cam.select(*undistort("u", "v", (0.0,) * 8)).first(), (700, 450))
    k1, x, y = 0.1, 0.2, 0.05
    bent = cam.select("fx", "fy", "cx", "cy", F.lit(500 + 1000 * x * (1 + k1 * (x * x + y * y))).alias("u"), F.lit(400 + 1000 * y * (1 + k1 * (x * x + y * y))).alias("v"))
    assert np.allclose(bent.select(*undistort("u", "v", (k1, *(0.0,) * 7), 8)).first(), (700, 450), atol=1e-3)


def test_spaced(spark):
    df = spark.range(11).selectExpr("'a' as g", "id")
    assert sorted(r.id for r in spaced(df, ["g"], ["id"], 3).collect()) == [0, 5, 10]
    assert spaced(df, ["g"], ["id"], 50).count() == 11


def test_streams_equal_batches(spark, tmp_path):
    rows = [("rig", f"cam{i % 3}", 1000 + i * 0.05, i) for i in range(60)] + [("rig", "cam0", 1060.0, 99)]
    df = spark.createDataFrame(rows, "rig_id string, cam_id string, ts_s double, seq long").withColumn("ts", F.timestamp_micros((F.col("ts_s") * 1e6).cast("long")))
    df.repartition(1).write.parquet(str(tmp_path / "in"))

    def drain(make, name, mode="append"):
        stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
        q = make(stream).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name).collect()

    assert sum(r.frames for r in drain(live.fps, "fps", "complete")) == 61
    want = calibration.simultaneous_pairs(df.withColumns({"r": F.array(F.lit(0.0)), "t": F.array(F.lit(0.0)), "err": F.lit(0.0)}), 0.08).count()
    assert len(drain(live.simultaneous, "pairs")) == want
    lost = drain(lambda s: live.drops(s, s.filter("seq % 10 <> 0")), "drops", "complete")
    assert sum(r.dropped for r in lost) == 6 and all(r.dropped >= 0 for r in lost)
    edges = drain(lambda s: live.running_edges(s.select("rig_id", F.lit("cam0").alias("cam_a"), F.col("cam_id").alias("cam_b"), F.col("seq").alias("err"))), "edges", "complete")
    assert {(r.cam_b, r.n) for r in edges} == {("cam0", 21), ("cam1", 20), ("cam2", 20)}
    assert {r.cam_id for r in drain(live.latest, "latest")} == {"cam0"}
    assert {(r.cam_id, round(r.silent_from_s, 2)) for r in drain(live.alarms, "alarms")} >= {("cam0", 1002.85)}


def test_anchors_refuse_jumps_until_the_circle_is_wide():
    at = np.array([[0, 0], [50, 0], [500, 0], [500, 0], [60, 0], [np.nan, 0], [np.nan, 0], [350, 0]], float)
    assert sequences.anchor_scan(at, 100) == [True, True, False, False, True, False, False, True]
    assert sequences.anchor_scan(np.full((2, 2), np.nan), 100) == [False, False]


def test_half_steps_give_cubics_back():
    for n in range(1, 12):
        t = np.arange(n, dtype=float)[:, None]
        power = min(n - 1, 3)
        want = (np.arange(2 * n - 1) / 2)[:, None] ** power
        assert np.allclose(sequences.half_steps(t**power), want)


def test_steady_set_is_the_best_or_held(spark, sf_dir):
    k = keypoints(spark, sf_dir, 2.0)
    seen = views(k, cameras(spark), 0.5)
    best = {(r.part, r.frame): sorted(r.cameras) for r in sequences.robust_cameras(seen, 2.0).collect()}
    rows = sequences.steady_cameras(seen, sequences.robust_cameras(seen, 2.0), k, 2.0).collect()
    assert {(r.part, r.frame) for r in rows} == set(best)
    assert all(r.cameras == best[r.part, r.frame] or r.held for r in rows)
    assert all(r.n_inliers >= len(best[r.part, r.frame]) for r in rows)


def test_steady_sets_equal_a_plain_scan(spark, sf_dir):
    """Every frame's set, inliers, error and flag, and the overrides of each wrist, against a loop over dictionaries with a singular value decomposition for each point."""
    from mvspark.operators.rigs import selection_summary

    off_px = lambda a, b: ((F.col("frame") * a + F.col("ord") * b + F.col("frame") * F.col("ord") * 13) % 17 - 8) * 0.8
    k = keypoints(spark, sf_dir).withColumns({"x": F.col("x") + off_px(31, 57) / 3360, "y": F.col("y") + off_px(7, 11) / 1890})
    k = k.filter("(frame * 5 + ord) % 9 > 0")
    seen = views(k, cameras(spark), 0.4)
    best = sequences.robust_cameras(seen, 4.0)
    steady = sequences.steady_cameras(seen, best, k, 4.0)
    rows = {(r.session, r.part, r.frame): r for r in steady.collect()}
    at = {}
    for r in seen.filter("lm_id = 0").collect():
        p = np.array([[r[f"p{i}{j}"] for j in range(4)] for i in range(3)])
        at.setdefault((r.session, r.part, r.frame), {})[r.cam_id] = (p, np.array([r.u, r.v]))
    top = {(r.session, r.part, r.frame): (sorted(r.cameras), r.mean_err) for r in best.collect()}
    listed = {}
    for r in k.select("session", "frame").distinct().collect():
        listed.setdefault(r.session, []).append(r.frame)

    def errors(views_, used):
        a = np.concatenate([np.stack([u * p[2] - p[0], v * p[2] - p[1]]) for p, (u, v) in (views_[c] for c in used)])
        h = np.linalg.svd(a)[2][-1]
        return {c: float(np.linalg.norm((p @ h)[:2] / (p @ h)[2] - uv)) for c, (p, uv) in views_.items()}

    want = {}
    for session, frames in listed.items():
        for part in ("left", "right"):
            before = None
            for frame in sorted(frames):
                key = (session, part, frame)
                if key not in top:
                    before = None
                    continue
                chosen, error = top[key]
                held = False
                own = [c for c in before or [] if c in at[key]]
                if len(own) >= 2:
                    off = errors(at[key], own)
                    near = sorted(c for c in off if off[c] < 4.0)
                    mean = sum(off[c] for c in near) / len(near) if near else np.inf
                    if len(near) >= max(2, len(chosen)) and mean <= 1.5 * error:
                        held, chosen, error = near != chosen, near, mean
                before = chosen
                want[key] = (chosen, error, held)
    assert set(rows) == set(want)
    for key, (chosen, error, held) in want.items():
        r = rows[key]
        assert (list(r.cameras), r.n_inliers, r.held) == (chosen, len(chosen), held) and abs(r.mean_err - error) < 1e-6
    held = sum(h for *_, h in want.values())
    assert held > 0
    summary = selection_summary(steady, 3.0).collect()
    assert sum(r.overrides for r in summary) == held and sum(r.frames for r in summary) == len(want)


def test_pairs_are_ranked_by_what_reprojects(spark, sf_dir):
    clean = keypoints(spark, sf_dir)
    wrong = clean.withColumn("y", F.when((F.col("cam_id") == "cam01") & (F.col("frame") % 4 > 0), F.col("y") + 0.2).otherwise(F.col("y")))
    before, after = ([r.asDict() for r in rank_pairs(views(k, cameras(spark), 0.5)).collect()] for k in (clean, wrong))
    assert all(r["score"] == r["points"] for r in before)
    assert [r["score"] for r in after] == sorted((r["score"] for r in after), reverse=True)
    for r in after:
        bad = "cam01" in (r["cam_a"], r["cam_b"])
        assert r["score"] < 0.5 * r["points"] if bad else r["score"] == r["points"]
    few = [r.frame for r in clean.select("frame").distinct().orderBy("frame").limit(7).collect()]
    assert {r.score for r in rank_pairs(views(clean.filter(F.col("frame").isin(few)), cameras(spark), 0.5)).collect()} == {0}


def test_savgol_at_the_ends(spark):
    rng = np.random.default_rng(1)
    series = {n: rng.normal(size=n) for n in (3, 4, 5, 6, 7, 8, 20)}
    df = spark.createDataFrame([(n, t, float(x)) for n, xs in series.items() for t, x in enumerate(xs)], "k int, frame int, x double")
    got = {(r.k, r.frame): r.smooth for r in smooth.savgol(df, ["k"], "x").collect()}
    for n, xs in series.items():
        window = min(7, n if n % 2 else n - 1)
        for t in range(n):
            lo = min(max(t - window // 2, 0), n - window)
            want = np.polyval(np.polyfit(np.arange(lo, lo + window), xs[lo : lo + window], 3), t) if window > 3 else xs[t]
            assert abs(got[n, t] - want) < 1e-9


def test_alignment_of_gaps_and_empty_cameras(spark):
    from mvspark.operators import align

    log = spark.createDataFrame(
        [("s", "cam0", k, float(k)) for k in range(6)] + [("s", "cam1", k, k + 0.01) for k in range(6) if k != 3] + [("s", "cam2", k, None) for k in range(3)], "session_id string, cam_id string, idx int, unified_ts_s double"
    )
    two = log.filter("cam_id <> 'cam2'")
    asked = align.slots(two, "cam0")
    rows = align.quorum(align.nearest(asked, two), 50.0).collect()
    assert {r.status for r in rows if r.slot_ts_s == 3.0} == {"discarded", "discarded_slot"} and sum(r.status == "matched" for r in rows) == 8
    rows = align.quorum(align.nearest(asked, log), 50.0)
    # A camera without valid entries spoils every slot.
    assert {(r.cam_id, r.status) for r in rows.filter("slot = 1").collect()} == {("cam0", "discarded_slot"), ("cam1", "discarded_slot"), ("cam2", "missing")}
    assert {r["kind"] for r in align.warnings(align.quorum(align.nearest(asked, two), 50.0), log.withColumn("host_offset_s", F.lit(0.0)), 30.0, 50.0).collect()} == set()


def test_alignment_grows_with_its_rows(spark):
    import time

    from mvspark.operators import align

    def took(n):
        log = spark.range(2 * n).select(F.lit("s").alias("session_id"), F.when(F.col("id") % 2 == 0, "cam0").otherwise("cam1").alias("cam_id"), (F.col("id") / 2).cast("int").alias("idx"), (F.col("id") / 100).alias("unified_ts_s"))
        began = time.time()
        align.nearest(align.slots(log, "cam0"), log).write.format("noop").mode("overwrite").save()
        return time.time() - began

    took(1_000)
    assert took(80_000) < 8 * took(10_000) + 20


def test_recordings_need_logs(spark, tmp_path):
    from mvspark.operators import rigs

    for name in ("video_cam2.mjpeg", "frames_cam2.log", "video_cam10.mjpeg"):
        (tmp_path / name).write_bytes(b"x")
    with pytest.raises(FileNotFoundError, match="cam10"):
        rigs.read_recordings(spark, str(tmp_path))
    (tmp_path / "frames_cam10.log").write_bytes(b"x")
    found = rigs.read_recordings(spark, str(tmp_path)).orderBy(rigs.camera_number()).collect()
    assert [r.cam_id for r in found] == ["cam2", "cam10"] and all(r.log and r.session_id == tmp_path.name for r in found)


def test_sessions_with_equal_frames_stay_apart(spark, sf_dir):
    from mvspark.operators import triangulate
    from mvspark.plans.fixtures import calibration as ring, keypoints

    one = keypoints(spark, sf_dir).filter("frame < 200")
    two = one.withColumns({"session": F.lit(99).cast("long"), "x": F.col("x") + 0.001})
    both = triangulate.triangulate(triangulate.views(one.unionByName(two), ring(spark)))
    alone = triangulate.triangulate(triangulate.views(one, ring(spark)))
    assert {(r.frame, r.part, r.lm_id, round(r.x, 6), r.n_views) for r in both.filter("session <> 99").collect()} == {(r.frame, r.part, r.lm_id, round(r.x, 6), r.n_views) for r in alone.collect()}


def test_points_from_saved_calibrations(spark):
    """Cameras that are on no ring, written to calibration JSON, read back, and used."""
    from mvspark.functions.geometry import project, with_projection
    from mvspark.operators import triangulate
    from mvspark.sources.records import calibration_texts, read_calibrations

    def turned(axis, angle):
        return rotation_matrix(np.array(axis, float) / np.linalg.norm(axis) * angle).ravel().tolist()

    cams = [(f"cam{k}", f"d{k}", 900.0 + 50 * k, 950.0, 640.0, 350.0 + k, [0.0] * 8, 1280, 720 + 10 * k, turned(a, w), t) for k, (a, w, t) in enumerate([((1, 2, 0.5), 0.3, [0.1, 0.2, 3.0]), ((0, 1, 1), -0.5, [-0.4, 0.1, 2.5]), ((1, 0, 0), 0.9, [0.3, -0.6, 4.0])])]
    kinds = "cam_id string, device_id string, fx double, fy double, cx double, cy double, dist array<double>, width int, height int, r array<double>, t array<double>"
    saved = calibration_texts(spark.createDataFrame(cams, kinds).withColumn("rig", F.lit(1)), ["rig"])
    rig = with_projection(read_calibrations(saved, ["rig"])).withColumn("ord", F.substring("cam_id", 4, 1).cast("int"))
    points = spark.createDataFrame([(0, f, "left", lm, 0.1 * f, 0.05 * lm, 0.02 * f * lm) for f in range(4) for lm in range(3)], "session long, frame long, part string, lm_id int, x double, y double, z double")
    u, v = project("x", "y", "z")
    seen = points.crossJoin(rig.select("cam_id", *[c for c in rig.columns if c.startswith("p")], "width", "height")).select("session", "frame", "part", "lm_id", "cam_id", (u / F.col("width")).alias("x"), (v / F.col("height")).alias("y"), F.lit(1.0).alias("conf"))
    found = triangulate.triangulate(triangulate.views(seen, rig)).join(points.select("frame", "lm_id", *[F.col(c).alias(f"t{c}") for c in "xyz"]), ["frame", "lm_id"]).collect()
    assert len(found) == 12 and all(abs(r[c] - r[f"t{c}"]) < 1e-6 for r in found for c in "xyz")
    sets = triangulate.robust_cameras(triangulate.views(seen, rig)).collect()
    assert len(sets) == 4 and all(r.n_inliers == 3 for r in sets)


def test_older_weights_are_roots(spark, sf_dir):
    seen = views(keypoints(spark, sf_dir, 40.0), cameras(spark), 0.5).filter("frame % 100 = 1").withColumn("occluded", (F.col("ord") + F.col("lm_id")) % 2 == 0)
    got = {(r.frame, r.part, r.lm_id): (r.x, r.y, r.z) for r in triangulate(seen.withColumn("w", older_weight("occluded")), weight="w").collect()}
    rows = seen.toPandas()
    assert got
    for key, g in rows.groupby(["frame", "part", "lm_id"]):
        if len(g) < 2:
            assert key not in got
            continue
        a = []
        for r in g.itertuples():
            p = np.array([[getattr(r, f"p{i}{k}") for k in range(4)] for i in range(3)])
            w = np.sqrt(max(r.conf, 1e-3) * (0.5 if r.occluded else 1.0))
            a += [w * (r.u * p[2] - p[0]), w * (r.v * p[2] - p[1])]
        x = np.linalg.svd(np.array(a))[2][-1]
        assert np.allclose(got[key], x[:3] / x[3], atol=1e-5)


def test_points_stay_where_the_lens_model_breaks(spark):
    cams = spark.createDataFrame([("a", [-3.0]), ("b", [0.0] * 8)], "cam_id string, dist array<double>").select("*", *[F.lit(v).alias(n) for n, v in (("fx", 100.0), ("fy", 100.0), ("cx", 50.0), ("cy", 50.0), ("width", 100.0), ("height", 100.0))])
    points = spark.createDataFrame([("a", 1.0, 1.0, 9), ("b", 0.9, 0.1, 8), ("c", 0.5, 0.5, 7)], "cam_id string, x double, y double, z long")
    out = {r.cam_id: (round(r.x, 6), round(r.y, 6), r.raw_x, r.z) for r in undistort_points(points, cams).collect()}
    assert out == {"a": (1.0, 1.0, 1.0, 9), "b": (0.9, 0.1, 0.9, 8)}  # a: the model's factor is below zero; c has no lens


def test_shapes_follow_the_one_before():
    j = np.arange(5.0)[:, None]
    good, bad = np.hstack([j, 0 * j, 0 * j]) * 0.1, np.hstack([j, 0 * j, j]) * 0.3
    w = np.array([1.0, 3.0])
    both, keep = meshes.fuse_shapes(np.stack([good, bad]), w, None)
    assert keep.all() and np.allclose(both, (good + 3 * bad) / 4)
    one, keep = meshes.fuse_shapes(np.stack([good, bad]), w, good)
    assert keep.tolist() == [True, False] and np.allclose(one, good)
    assert meshes.fuse_shapes(np.stack([good, bad]), w, good + 9)[1].all()  # none is near: all count


def test_meshes_over_time(spark):
    """Places 1 to 5 of a session, two cameras; the second sees another shape from 2 on, and there is no camera at 4."""
    rows = [(1, f, "left", c, v, v * 0.1 + (v * 1.0 if c == "b" and f > 10 else 0.0), 0.0, 0.0, 0.0, 0.0, 0.0, 1.0) for f in (10, 20, 30, 50) for c in "ab" for v in range(4)]
    mesh = spark.createDataFrame(rows, "session long, frame long, side string, cam_id string, vert_id int, x double, y double, z double, wx double, wy double, wz double, weight double")
    frames = spark.createDataFrame([(1, f) for f in (10, 20, 30, 40, 50)], "session long, frame long")
    for batch in ("3", "10000"):  # frames that go on in the next batch, and not
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        got = {(r.frame, r.vert_id): round(r.x, 6) for r in meshes.fuse_over_time(mesh, frames).collect()}
        assert got == {(f, v): round(v * 0.1 + (v * 0.5 if f == 50 else 0.0), 6) for f in (10, 20, 30, 50) for v in range(4)}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert meshes.fuse_over_time(mesh.limit(0), frames).count() == 0


def test_too_few_views_are_an_error(spark):
    seen = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "cam_id string, view int")
    assert lens.require_views(seen, ["cam_id"], 1).count() == 2
    with pytest.raises(Exception, match="too few valid views: b"):
        lens.require_views(seen, ["cam_id"], 2).collect()


def test_streams_keep_anchors_poses_and_calibrations(spark, sf_dir, tmp_path):
    def drain(df, make, name, mode="append"):
        df.repartition(1).write.parquet(str(tmp_path / f"{name}-in"))
        stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / f"{name}-in"))
        q = make(stream).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name)

    at = [(0.0, 0.0), (50.0, 0.0), (500.0, 0.0), (500.0, 0.0), (60.0, 0.0), (None, 0.0), (None, 0.0), (350.0, 0.0)]
    wrists = spark.createDataFrame([("c", p, i, u, v) for p in ("left", "right") for i, (u, v) in enumerate(at)], "cam_id string, part string, place long, u double, v double")
    got = drain(wrists, lambda s: live.anchors(s, 100.0), "anchored").collect()
    assert {(r.part, r.place): r.accepted for r in got} == {(p, i): a for p in ("left", "right") for i, a in enumerate([True, True, False, False, True, False, False, True])}

    pairs = calibration.edge_observations(calibration.simultaneous_pairs(calibration.board_poses(spark, sf_dir), 0.5))
    want = {(r.cam_a, r.cam_b): r for r in calibration.edges(pairs).collect()}
    got = drain(pairs, live.running_poses, "poses", "update").collect()
    assert len(got) == len(want) and all(r.n == want[r.cam_a, r.cam_b].n and np.allclose(r.r, want[r.cam_a, r.cam_b].r, atol=1e-9) for r in got)

    made = spark.createDataFrame([("rig", "cam0", 5.0, 1), ("rig", "cam0", 8.0, 2), ("rig", "cam0", 20.0, 3)], "rig_id string, cam_id string, made_s double, version int")
    frames = spark.createDataFrame([("rig", "cam0", 1), ("rig", "cam0", 2), ("rig", "cam9", 3)], "rig_id string, cam_id string, seq long")
    assert {(r.seq, r.version) for r in drain(frames, lambda s: live.posed(s, made, 10.0), "posed").collect()} == {(1, 2), (2, 2)}
    open_poses = calibration.board_poses(spark, sf_dir).select("cam_id", "ts_s", "seq", "r", "t")
    took = drain(open_poses, live.gates, "gated").groupBy("cam_id").agg(F.count(F.lit(1)).alias("n")).collect()
    rows = open_poses.toPandas().sort_values(["ts_s", "seq"])
    assert {r.cam_id: r.n for r in took} == {c: sum(calibration.gate_scan(g)) for c, g in rows.groupby("cam_id")}


def test_quantiles(spark):
    from mvspark.functions.quantiles import quantiles

    rng = np.random.default_rng(5)
    values = [*rng.normal(size=3000), *[7.0] * 2000, *rng.normal(size=50) * 1e12, 1.7e308, -1.7e308, 5e-324]
    rows = [("a", float(x)) for x in values] + [(None, float(k)) for k in range(10)] + [("b", 3.0), ("c", None), ("d", float("nan")), ("d", float("inf"))]
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    at = [0.0, 0.25, 0.5, 0.9, 0.999, 1.0]
    want = {"a": values, None: list(range(10)), "b": [3.0]}
    for bins in (4, 64, 4096):
        found = {(r.g, r.q): r.value for r in quantiles(df, ["g"], "x", at, bins).collect()}
        assert set(found) == {(g, q) for g in want for q in at}
        for (g, q), x in found.items():
            place = q * (len(want[g]) - 1)
            own, k = sorted(want[g]), int(place)
            exact = own[k] if place == k else own[k] * (1 - (place - k)) + own[k + 1] * (place - k)
            assert x == exact or abs(x - exact) <= 1e-12 * abs(exact)
    assert quantiles(df.limit(0), ["g"], "x", at).count() == 0


def test_points_far_from_their_session_are_left_out(spark):
    """Session 1: wrists 0 to 1 along x, so the limit is 1.5 from their middle. Session 2 has no trusted wrist, so its far point stays, without a distance."""
    rows = [(1, k, "left", 0, 1.0, k / 10, 0.0, 0.0) for k in range(11)] + [(1, 20, "left", 5, 1.0, 1.9, 0.0, 0.0), (1, 21, "left", 5, 1.0, 0.5, 0.0, 1.6), (1, 22, "left", 5, 40.0, 0.5, 0.0, 0.0), (1, 22, "left", 5, 1.0, 0.5, 0.0, 0.0)]
    rows += [(2, 30, "left", 0, 40.0, 0.0, 0.0, 0.0), (2, 31, "left", 5, 2.0, 99.0, 0.0, 0.0)]
    found = plausible(spark.createDataFrame(rows, "session long, frame long, part string, lm_id int, err_px double, px double, py double, pz double")).collect()
    got = {r.frame: (r.dist if r.dist is None else round(r.dist, 9), r.worst) for r in found}
    assert got == {k: (abs(round(k / 10 - 0.5, 9)), 1.0) for k in range(11)} | {20: (1.4, 1.0), 31: (None, 2.0)}


def test_plausible_points_equal_a_plain_count(spark, sf_dir):
    """The query's points against NumPy's median and percentile of each session's wrists."""
    from mvspark.operators.triangulate import POINT, QUERIES, _errors

    rows = _errors(spark, sf_dir).toPandas()
    points = rows.groupby(POINT).agg(worst=("err_px", "max"), px=("px", "first"), py=("py", "first"), pz=("pz", "first")).reset_index()
    want = set()
    for _, own in points[points["worst"] < 30].groupby("session"):
        at, wrist = own[["px", "py", "pz"]].to_numpy(), (own["lm_id"] == 0).to_numpy()
        dist = np.linalg.norm(at - np.median(at[wrist], axis=0), axis=1)
        want |= set(own[dist < 3 * np.percentile(dist[wrist], 90)][POINT[1:]].itertuples(index=False, name=None))
    found = [tuple(r) for r in QUERIES["plausible_points"](spark, sf_dir).collect()]
    assert len(found) == len(want) and set(found) == want


def test_is_spaced(spark):
    from mvspark.functions.series import is_spaced

    for n, most in [(1, 200), (200, 200), (201, 200), (399, 200), (1000, 200), (12345, 200), (9, 2), (6, 3), (50, 1)]:
        found = [r.id for r in spark.range(n).filter(is_spaced(F.col("id"), F.lit(n), most)).collect()]
        assert sorted(found) == (list(range(n)) if n <= most else sorted({round(float(i)) for i in np.linspace(0, n - 1, most)}))


def test_extraction_is_kept(spark, tmp_path):
    from mvspark.sources.stored import extract_missing, stored

    path, asked = str(tmp_path / "store"), []

    def extraction(parts):
        def run(missing):
            asked.append(sorted((r.session, r.cam_id, r.frame) for r in missing.collect()))
            return missing.filter("frame <> 3").select("*", *[(F.col("frame") * 10 + k + len(asked) * 1000).alias(p) for k, p in enumerate(parts)])

        return run

    keys = spark.createDataFrame([(s, c, f) for s in ("007", "x/y") for c in ("a", "b") for f in range(4)], "session string, cam_id string, frame long")
    own = lambda df: {(r.session, r.cam_id, r.frame): tuple(r)[3:] for r in df.collect()}
    files = lambda: sorted(str(p) for p in (tmp_path / "store").rglob("*.parquet"))
    half = keys.filter("session = '007' and frame < 2")
    assert len(own(extract_missing(half, extraction(["left"]), path, ["left"]))) == 4
    # The half is completed: what is stored stays as it is, and a frame with nothing in it isn't tried again.
    rows = own(extract_missing(keys.unionByName(keys), extraction(["left"]), path, ["left"]))
    assert len(rows) == 16 and rows["007", "a", 1] == (1010,) and rows["x/y", "a", 1] == (2010,) and rows["007", "b", 3] == (None,)
    assert list(map(len, asked)) == [4, 12]
    before = files()
    assert own(extract_missing(keys, extraction(["left"]), path, ["left"])) == rows and len(asked) == 2 and files() == before
    # An older schema is upgraded for the keys wanted; others in the same folder keep their rows, other folders their files.
    up = own(extract_missing(keys.filter("session = '007' and cam_id = 'a'"), extraction(["left", "body"]), path, ["left", "body"]))
    assert up == {("007", "a", f): (3000 + f * 10, 3001 + f * 10) for f in range(3)} | {("007", "a", 3): (None, None)}
    assert {p for p in files() if "007" not in p} == {p for p in before if "007" not in p}
    left = own(stored(spark, path).select("session", "cam_id", "frame", "left"))
    assert len(left) == stored(spark, path).count() == 16 and left["007", "b", 1] == (1010,) and left["x/y", "b", 2] == (2020,)
    forced = own(extract_missing(keys.filter("frame = 0"), extraction(["left", "body"]), path, ["left", "body"], force=True))
    assert len(forced) == 4 and set(forced.values()) == {(4000, 4001)} and stored(spark, path).count() == 16
    assert extract_missing(keys.limit(0), extraction(["left"]), str(tmp_path / "none"), ["left"]).count() == 0


def test_frames_by_byte_range(spark, tmp_path):
    from mvspark.sources.frames import read_frames
    from mvspark.sources.logs import byte_offsets

    rng = np.random.default_rng(3)
    log, frames, paths = [], {}, {}
    for cam in ("cam0", "cam1"):
        paths[cam] = str(tmp_path / f"video_{cam}.mjpeg")
        with open(paths[cam], "wb") as out:
            for idx in range(50):
                frames[cam, idx] = b"\xff\xd8" + rng.bytes(int(rng.integers(0, 300))) + b"\xff\xd9"
                out.write(frames[cam, idx])
                log.append(("s", cam, idx, len(frames[cam, idx])))
    offsets = byte_offsets(spark.createDataFrame(log, "session_id string, cam_id string, idx int, n_bytes long"))
    files = spark.createDataFrame([*paths.items(), ("cam2", "/none.mjpeg"), ("cam3", None)], "cam_id string, path string")
    at = offsets.join(files, "cam_id")
    for wanted in ("true", "idx % 7 = 3", "idx = 49", "false"):
        for batch_bytes in (1, 1 << 24):
            found = read_frames(at.filter(wanted), batch_bytes).collect()
            assert len(found) == at.filter(wanted).count() and all(r.jpeg == frames[r.cam_id, r.idx] and r.state == "whole" for r in found)
    # A logged frame that was never written shifts those after it; the last ones run beyond the end.
    shifted = at.filter("cam_id = 'cam0'").withColumn("offset", F.col("offset") + F.when(F.col("idx") >= 20, 5).otherwise(0)).withColumn("state", F.lit(1))
    state = {r.idx: r.state for r in read_frames(shifted).collect()}
    assert {i for i, s in state.items() if s == "whole"} == set(range(20)) and state[49] == "short"
    none = files.filter("cam_id >= 'cam2'").select("*", F.lit(0).cast("long").alias("offset"), F.lit(9).cast("long").alias("length"))
    assert {(r.cam_id, r.jpeg, r.state) for r in read_frames(none).collect()} == {("cam2", None, "missing"), ("cam3", None, "missing")}
