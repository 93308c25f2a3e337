"""Live forms: windowed counts, simultaneous pairs, latest views, sample gates and alarms as structured streams."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from mvspark.operators.calibration import MIN_OBSERVATIONS, MOST_SAMPLES, edges, frozen, novel


def fps(frames: DataFrame, late: str = "10 seconds", width: str = "1 second") -> DataFrame:
    """Frames of each camera in each window of event time ``ts``; rows later than the watermark are dropped."""
    return frames.withWatermark("ts", late).groupBy(F.window("ts", width), "cam_id").agg(F.count(F.lit(1)).alias("frames")).select("cam_id", F.col("window.start").alias("from_ts"), "frames")


def drops(logged: DataFrame, written: DataFrame, late: str = "10 seconds", width: str = "1 second") -> DataFrame:
    """Logged frames less written ones of each camera in each window of event time (cam_id, ts): one count over both streams, no join."""
    marked = [df.select("cam_id", "ts").withColumn("sign", F.lit(sign)).withWatermark("ts", late) for df, sign in ((logged, 1), (written, -1))]
    counted = marked[0].unionByName(marked[1]).groupBy(F.window("ts", width), "cam_id").agg(F.sum("sign").alias("dropped"))
    return counted.select("cam_id", F.col("window.start").alias("from_ts"), "dropped")


def running_edges(observations: DataFrame) -> DataFrame:
    """Count and mean error of each pair of cameras so far (rig_id, cam_a, cam_b, err), for update mode: the state is one row for each pair."""
    return observations.groupBy("rig_id", "cam_a", "cam_b").agg(F.count(F.lit(1)).alias("n"), F.avg("err").alias("err"))


def running_poses(observations: DataFrame, least: int = MIN_OBSERVATIONS) -> DataFrame:
    """The mean transform of each pair of cameras so far, for update mode: the sums that are the state are one row for each pair, and the turn is of changed rows only."""
    return edges(observations, least)


def posed(frames: DataFrame, calibrations: DataFrame, started_s: float) -> DataFrame:
    """A stream's rows (rig_id, cam_id) with the calibration that their rig had when it started; later ones don't touch it."""
    return frames.join(frozen(calibrations, started_s), ["rig_id", "cam_id"])


def simultaneous(frames: DataFrame, tolerance: str = "80 milliseconds", late: str = "10 seconds") -> DataFrame:
    """Pairs of different cameras' rows (rig_id, cam_id, ts, seq) within the tolerance in event time: a stream-stream join whose state the watermarks bound."""
    a = frames.withWatermark("ts", late).select(*[F.col(c).alias(f"{c}_a") for c in ("rig_id", "cam_id", "ts", "seq")])
    b = frames.withWatermark("ts", late).select(*[F.col(c).alias(f"{c}_b") for c in ("rig_id", "cam_id", "ts", "seq")])
    near = F.expr(f"ts_b >= ts_a - interval {tolerance} and ts_b <= ts_a + interval {tolerance}")
    return a.join(b, (F.col("rig_id_a") == F.col("rig_id_b")) & (F.col("cam_id_a") < F.col("cam_id_b")) & near)


def latest(frames: DataFrame, within_s: float = 0.15) -> DataFrame:
    """After each batch, each rig's newest row of every camera that lies within so many seconds of the rig's newest."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = dict(zip(*state.get, strict=True)) if state.exists else {}
        for rows in parts:
            for cam, t in zip(rows["cam_id"], rows["ts_s"], strict=True):
                held[cam] = max(t, held.get(cam, t))
        state.update((list(held), list(held.values())))
        newest = max(held.values())
        live = sorted((c, t) for c, t in held.items() if newest - t <= within_s)
        yield pd.DataFrame({"rig_id": key[0], "cam_id": [c for c, _ in live], "ts_s": [t for _, t in live]})

    return frames.groupBy("rig_id").applyInPandasWithState(step, "rig_id string, cam_id string, ts_s double", "cams array<string>, times array<double>", "append", GroupStateTimeout.NoTimeout)


def gates(poses: DataFrame) -> DataFrame:
    """Candidates (cam_id, ts_s, seq, r, t) that are accepted, by the batch form's rule; the accepted poses are the state."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        flat = list(state.get[0]) if state.exists else []
        accepted = [(np.reshape(flat[i : i + 9], (3, 3)), np.array(flat[i + 9 : i + 12])) for i in range(0, len(flat), 12)]
        rows = pd.concat(list(parts)).sort_values(["ts_s", "seq"])
        took = []
        for seq, r, t in zip(rows["seq"], rows["r"], rows["t"], strict=True):
            r, t = np.reshape(np.asarray(r, float), (3, 3)), np.asarray(t, float)
            if len(accepted) < MOST_SAMPLES and novel(accepted, r, t):
                accepted.append((r, t))
                flat += [*r.ravel().tolist(), *t.tolist()]
                took.append(seq)
        state.update((flat,))
        yield pd.DataFrame({"cam_id": key[0], "seq": took})

    return poses.groupBy("cam_id").applyInPandasWithState(step, "cam_id string, seq bigint", "poses array<double>", "append", GroupStateTimeout.NoTimeout)


def alarms(frames: DataFrame, after_s: float = 20.0, late: str = "1 second") -> DataFrame:
    """(cam_id, silent_from_s) once for each silence of over so many seconds of event time, re-armed by the next detection."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            last = state.get[0]
            state.remove()
            yield pd.DataFrame({"cam_id": [key[0]], "silent_from_s": [last]})
            return
        times = np.sort(np.concatenate([p["ts_s"].to_numpy() for p in parts]))
        if state.exists:
            times = np.concatenate([[state.get[0]], times]) if state.get[0] < times[0] else np.sort(np.append(times, state.get[0]))
        quiet = times[:-1][np.diff(times) > after_s]
        state.update((float(times[-1]),))
        state.setTimeoutTimestamp(max(int((times[-1] + after_s) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"cam_id": key[0], "silent_from_s": quiet})

    marked = frames.withWatermark("ts", late)
    return marked.groupBy("cam_id").applyInPandasWithState(step, "cam_id string, silent_from_s double", "last double", "append", GroupStateTimeout.EventTimeTimeout)


def anchors(wrists: DataFrame, step_px: float = 200.0) -> DataFrame:
    """(cam_id, part, place, accepted) of a stream of wrists (cam_id, part, place, u, v in pixels), by the batch form's rule: one outside the circle around the last accepted counts as missing, and the
    circle grows with every frame. A wrist's state is its anchor and the anchor's frame; rows from before that frame are too late."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts)).sort_values("place")
        anchor, took = state.get if state.exists else None, []
        for place, u, v in zip(rows["place"], rows["u"].astype(float), rows["v"].astype(float), strict=True):
            here = not (np.isnan(u) or np.isnan(v))
            take = here and (anchor is None or (place >= anchor[2] and np.hypot(u - anchor[0], v - anchor[1]) <= step_px * max(place - anchor[2], 1)))
            if take:
                anchor = (float(u), float(v), int(place))
            took.append(bool(take))
        if anchor is not None:
            state.update(anchor)
        yield pd.DataFrame({"cam_id": key[0], "part": key[1], "place": rows["place"].to_numpy(), "accepted": took})

    return wrists.groupBy("cam_id", "part").applyInPandasWithState(step, "cam_id string, part string, place bigint, accepted boolean", "u double, v double, place bigint", "append", GroupStateTimeout.NoTimeout)
