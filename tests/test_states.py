"""Streams with several states against their batch forms: random cuts of the input into batches, and a restart from the checkpoint."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from mvspark.operators import calibration, samples, triangulate
from mvspark.plans.fixtures import calibration as cameras
from mvspark.plans.fixtures import keypoints
from mvspark.streaming import states

PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@pytest.fixture
def rocks(spark):
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(PROVIDER)


def run(spark, folder, make, parts, schema, name, mode="append"):
    """Rows of each batch; a part of the input is one file and one batch. Each list of parts is a run of its own from the same checkpoint."""
    out = []
    for files in parts:
        for k, rows in files:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder / name / "in" / f"p={k:04d}"))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder / name / "in" / "*"))
        q = make(stream).writeStream.foreachBatch(lambda df, i: out.append((i, df.collect()))).outputMode(mode).option("checkpointLocation", str(folder / name / "checkpoint")).trigger(availableNow=True).start()
        assert q.awaitTermination(240) and q.exception() is None
    return out


def cut(rows, at, runs=2):
    """Parts of rows as (number, part), dealt to runs."""
    parts = [(k, p) for k, p in enumerate(rows[i:j] for i, j in zip([0, *at], [*at, len(rows)], strict=True)) if p]
    half = len(parts) // runs
    return [parts[:half], parts[half:]] if runs == 2 else [parts]


def test_samples_equal_the_batch_form(rocks, sf_dir, tmp_path):
    seen = samples._detections(rocks, sf_dir).filter("seq < 1600")
    controls = rocks.createDataFrame([("rig", "cam1", 400.0, 400), ("rig", None, 900.0, 900), ("other", None, 5.0, 5)], "rig_id string, cam_id string, ts_s double, seq long")
    cams = rocks.createDataFrame([("rig", f"cam{k}") for k in range(4)], "rig_id string, cam_id string")
    requests = samples.requests(seen, controls, cams)
    want = sorted(map(tuple, samples.samples(requests).collect()), key=str)
    rows = sorted(requests.collect(), key=lambda r: (r.ts_s, not r.reset))
    rng = np.random.default_rng(3)
    firsts = [i for i in range(1, len(rows)) if rows[i].ts_s != rows[i - 1].ts_s]  # an instant's rows stay together
    at = sorted(rng.choice(firsts, 5, replace=False).tolist())
    out = run(rocks, tmp_path, states.samples, cut(rows, at), requests.schema, "samples")
    assert len({i for i, _ in out}) == 6
    assert sorted((tuple(r) for _, part in out for r in part), key=str) == want
    again = [r for _, part in out for r in part if r.cam_id == "cam1" and r["sample"] == 1]
    assert len(again) == 3  # at the start and after each of its two resets
    plain = samples.samples(samples.requests(seen))
    kept = {(r.cam_id, r.seq) for r in plain.collect()}
    old = {c: g for c, g in samples.requests(seen).toPandas().sort_values(["ts_s", "seq"]).groupby("cam_id")}
    assert kept == {(c, s) for c, g in old.items() for s, a in zip(g["seq"], calibration.gate_scan(g), strict=True) if a}


def test_samples_stop_at_the_cap_and_fall_due(monkeypatch):
    held = samples.Held()
    eye = np.eye(3).ravel()
    found = [held.offer(eye, [0.06 * k, 0, 0], [k % 30]) for k in range(200)]
    assert sum(f is not None for f in found) == samples.MOST_SAMPLES and found[samples.MOST_SAMPLES] is None
    due = [f[0] for f in found if f and f[2]]
    assert due == [n for n in range(1, 151) if n >= 8 and (n - 8) % 3 == 0]
    assert [len(f[1]) for f in found[:31]] == [1] * 30 + [0]
    assert samples.Held().offer(eye, [0.0] * 3, []) == (1, [], False)


def test_newest_points_equal_the_batch_form(rocks, sf_dir, tmp_path):
    seen = triangulate.views(keypoints(rocks, sf_dir, 1.0), cameras(rocks), 0.4).filter("part = 'left' and frame < 700")
    frames = states.framed(seen.select(F.concat(F.lit("rig"), (F.col("frame") % 2).cast("string")).alias("rig_id"), "cam_id", (F.col("frame") * 0.02).alias("ts_s"), "lm_id", "u", "v", *states.POSES), ["rig_id", "cam_id", "ts_s"])
    rows = frames.collect()
    rng = np.random.default_rng(4)
    rows = [rows[i] for i in np.argsort([r.ts_s + rng.uniform(0, 0.3) for r in rows])]  # shuffled arrival
    at = sorted(rng.choice(np.arange(1, len(rows)), 5, replace=False).tolist())
    parts = cut(rows, at)
    out = run(rocks, tmp_path, lambda s: states.newest_points(s, 0.15, 1.0), parts, frames.schema, "points")
    so_far, checked = [], 0
    for (_, got), (_, part) in zip(sorted(out), [p for files in parts for p in files], strict=True):
        so_far += part
        want = {(r.rig_id, r.lm_id): r for r in states.newest_points_of(rocks.createDataFrame(so_far, frames.schema), 0.15).collect()}
        rigs = {r.rig_id for r in part}
        found = {(r.rig_id, r.lm_id): r for r in got}
        assert set(found) == {k for k in want if k[0] in rigs}
        for k, r in found.items():
            assert r.n_views == want[k].n_views >= 2 and r.ts_s == want[k].ts_s and np.allclose([r.x, r.y, r.z], [want[k].x, want[k].y, want[k].z], atol=1e-8)
            checked += 1
    assert checked > 10


def test_late_rows_and_statuses(rocks, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(f"rig{i % 2}", f"cam{i % 3}", 1000 + i * 0.25) for i in range(400)]
    rows = [r for r in rows if not (r[1] == "cam1" and 1030 < r[2] < 1060)]  # one silence
    order = np.argsort([r[2] + rng.uniform(0, 3.0) for r in rows])
    rows = [rows[i] for i in order]
    parts = cut(rows, sorted(rng.choice(np.arange(1, len(rows)), 6, replace=False).tolist()))
    schema = "rig_id string, cam_id string, ts_s double"
    out = run(rocks, tmp_path, lambda s: states.late_rows(s, 1.0), parts, schema, "late", "update")
    last = {r.rig_id: (r.late, r.n) for _, part in sorted(out, key=lambda x: x[0]) for r in part}
    newest, want = {}, {}
    for _, part in [p for files in parts for p in files]:
        for rig in {r[0] for r in part}:
            ts = np.array([r[2] for r in part if r[0] == rig])
            late, n = want.get(rig, (0, 0))
            want[rig] = (late + int((ts < newest.get(rig, -np.inf) - 1.0).sum()), n + len(ts))
            newest[rig] = max(newest.get(rig, -np.inf), ts.max())
    assert last == want and sum(late for late, _ in want.values()) > 0

    seeds = rocks.createDataFrame([(f"rig{i}", f"cam{k}", 1000.0) for i in range(2) for k in range(4)], "rig_id string, cam_id string, start_s double")
    with_ts = lambda s: states.statuses(s.withColumn("ts", F.timestamp_micros((F.col("ts_s") * 1e6).cast("long"))), seeds, 20.0, 5.0, "10 seconds")
    out = run(rocks, tmp_path, with_ts, parts, schema, "status")
    found = sorted(tuple(r) for _, part in out for r in part)
    times = {}
    for rig, cam, ts in sorted(rows, key=lambda r: r[2]):
        times.setdefault((rig, cam), []).append(ts)
    gaps = [(*k, "silent", a) for k, t in times.items() for a, b in zip(t, t[1:], strict=False) if b - a > 20]
    assert len(gaps) == 2
    assert found == sorted([("rig0", "cam3", "never", 1000.0), ("rig1", "cam3", "never", 1000.0), *gaps])
