"""Streams that hold more than one kind of state: calibration samples with resets, points of the newest views, late rows, cameras that are silent or were never seen.
They need spark.sql.streaming.stateStore.providerClass to be the RocksDB provider of Spark."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

from mvspark.functions.geometry import PROJECTION
from mvspark.functions.series import checkpointed
from mvspark.operators.samples import CAMERA, Held, in_order, sample_schema, scan
from mvspark.operators.triangulate import triangulate, views
from mvspark.plans.fixtures import calibration, keypoints, keypoints_sql

POSES = [c for row in PROJECTION for c in row]


class _Sampler(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.poses = handle.getListState("poses", "r array<double>, t array<double>")
        self.cells = handle.getMapState("cells", "cell int", "sample int")
        self.since = handle.getValueState("since", "n int")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        poses = list(self.poses.get())
        held = Held([np.asarray(p[0]) for p in poses], [np.asarray(p[1]) for p in poses], {c[0] for c in self.cells.keys()}, self.since.get()[0] if self.since.exists() else 0)
        out, kept = [], len(poses)
        for found in scan(held, in_order(pd.concat(list(rows)))):
            if found is None:
                kept = 0
                for state in (self.poses, self.cells):
                    state.clear()
            else:
                out.append((*key, *found))
                for cell in found[2]:
                    self.cells.updateValue((cell,), (found[1],))
        fresh = [(r.tolist(), t.tolist()) for r, t in zip(held.turns[kept:], held.places[kept:], strict=True)]
        if fresh:
            self.poses.appendList(fresh)
        self.since.update((held.since,))
        yield pd.DataFrame(out, columns=[*CAMERA, "seq", "sample", "new_cells", "cells", "due"])

    def close(self) -> None:
        pass


def samples(rows: DataFrame) -> DataFrame:
    """The batch form's accepted samples of a stream of requests(): poses, cells and the count since the last calibration are each camera's state; a control row forgets them. Equal to the batch form
    if later batches hold later rows."""
    return rows.groupBy(*CAMERA).transformWithStateInPandas(_Sampler(), sample_schema(rows), "append", "none")


def framed(seen: DataFrame, keys: list[str]) -> DataFrame:
    """Views of single landmarks (keys, lm_id, u, v, p00 .. p23) as one row for each of the keys, which name a camera's frame: keys, lm, u, v and the camera's projection p (row-major)."""
    rows = seen.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("lm_id", "u", "v"))).alias("s"), F.any_value(F.array(*POSES)).alias("p"))
    return rows.select(*keys, F.col("s.lm_id").alias("lm"), F.col("s.u").alias("u"), F.col("s.v").alias("v"), "p")


class _Points(StatefulProcessor):
    def __init__(self, within_s: float, forget_s: float):
        self.within_s, self.forget_s = within_s, forget_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.views = handle.getMapState("views", "cam_id string", "ts_s double, lm array<int>, u array<double>, v array<double>, p array<double>")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        held = {c[0]: v for c, v in self.views.iterator()}
        before = {c: v[0] for c, v in held.items()}
        for part in rows:
            for row in zip(part["cam_id"], part["ts_s"], part["lm"], part["u"], part["v"], part["p"], strict=True):
                if row[0] not in held or row[1] > held[row[0]][0]:
                    held[row[0]] = (float(row[1]), *[np.asarray(x).tolist() for x in row[2:]])
        newest = max(v[0] for v in held.values())
        for cam, view in held.items():
            if newest - view[0] > self.forget_s:
                if cam in before:
                    self.views.removeKey((cam,))
            elif before.get(cam) != view[0]:
                self.views.updateValue((cam,), view)
        yield self.solved(key[0], newest, [v for v in held.values() if newest - v[0] <= self.within_s])

    @staticmethod
    def solved(rig: object, newest: float, live: list[tuple]) -> pd.DataFrame:
        """Least-squares points of all landmarks with two views or more, at once."""
        lm = np.concatenate([np.asarray(v[1], int) for v in live])
        u, v = (np.concatenate([np.asarray(x[k], float) for x in live]) for k in (2, 3))
        p = np.repeat([np.reshape(x[4], (3, 4)) for x in live], [len(x[1]) for x in live], axis=0)
        rows = np.stack([u[:, None] * p[:, 2] - p[:, 0], v[:, None] * p[:, 2] - p[:, 1]], 1)
        seen = np.isfinite(rows).all((1, 2))
        which, at = np.unique(lm[seen], return_inverse=True)
        gram = np.zeros((len(which), 4, 4))
        np.add.at(gram, at, np.swapaxes(rows[seen], 1, 2) @ rows[seen])
        views = np.bincount(at, minlength=len(which))
        h = np.linalg.eigh(gram)[1][:, :, 0]
        good = (views >= 2) & (np.abs(h[:, 3]) >= 1e-12)
        xyz = h[good, :3] / h[good, 3:]
        return pd.DataFrame({"rig_id": rig, "ts_s": newest, "lm_id": which[good].astype(np.int32), "n_views": views[good].astype(np.int64), "x": xyz[:, 0], "y": xyz[:, 1], "z": xyz[:, 2]})

    def close(self) -> None:
        pass


def newest_points(frames: DataFrame, within_s: float = 0.15, forget_s: float = 5.0) -> DataFrame:
    """(rig_id, ts_s, lm_id, n_views, x, y, z) after each batch of a stream of framed() rows (rig_id, cam_id, ts_s, lm, u, v, p): the points of each rig's newest views that lie within so many seconds of
    its newest one. A camera's older rows are passed over; one that is behind by over forget_s leaves the state."""
    kind = frames.schema["rig_id"].dataType.simpleString()
    return frames.groupBy("rig_id").transformWithStateInPandas(_Points(within_s, max(forget_s, within_s)), f"rig_id {kind}, ts_s double, lm_id int, n_views long, x double, y double, z double", "append", "none")


def newest_rows(rows: DataFrame, camera: list[str] = CAMERA) -> DataFrame:
    """Of each camera the rows of its newest ts_s. Times are found first, so that no other rows are gathered or sorted."""
    last = rows.groupBy(*camera).agg(F.max("ts_s").alias("ts_s"))
    return rows.join(F.broadcast(last), [*camera, "ts_s"], "left_semi")  # a row a camera


def newest_points_of(frames: DataFrame, within_s: float = 0.15) -> DataFrame:
    """What newest_points() gives after the last of these rows, in batch."""
    last = newest_rows(frames).groupBy(*CAMERA).agg(F.any_value(F.struct("ts_s", "lm", "u", "v", "p")).alias("s")).select(*CAMERA, "s.*")
    live = last.withColumn("newest", F.max("ts_s").over(Window.partitionBy("rig_id"))).filter(F.col("newest") - F.col("ts_s") <= within_s)
    flat = live.select("rig_id", "newest", F.inline(F.arrays_zip("lm", "u", "v")), *[F.get("p", F.lit(k)).alias(c) for k, c in enumerate(POSES)])
    return triangulate(flat.withColumnsRenamed({"newest": "ts_s", "lm": "lm_id"}), ["rig_id", "ts_s", "lm_id"])


class _Late(StatefulProcessor):
    def __init__(self, tolerance_s: float):
        self.tolerance_s = tolerance_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counts = handle.getValueState("counts", "newest double, late long, n long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        newest, late, n = self.counts.get() if self.counts.exists() else (-np.inf, 0, 0)
        least = newest - self.tolerance_s
        for part in rows:
            ts = part["ts_s"].to_numpy(float)
            newest, late, n = max(newest, float(ts.max(initial=-np.inf))), late + int((ts < least).sum()), n + len(ts)
        self.counts.update((newest, late, n))
        yield pd.DataFrame({"rig_id": [key[0]], "late": [late], "n": [n]})

    def close(self) -> None:
        pass


def late_rows(frames: DataFrame, tolerance_s: float) -> DataFrame:
    """(rig_id, late, n) so far after each batch, for update mode: how many of a rig's rows came when an earlier batch had one newer by over the tolerance."""
    kind = frames.schema["rig_id"].dataType.simpleString()
    return frames.select("rig_id", "ts_s").groupBy("rig_id").transformWithStateInPandas(_Late(tolerance_s), f"rig_id {kind}, late long, n long", "update", "none")


class _Status(StatefulProcessor):
    def __init__(self, after_s: float, never_s: float):
        self.after_s, self.never_s = after_s, never_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ts_s double, seen boolean")

    def arm(self, at_s: float, watermark: int) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(max(int(np.ceil(at_s * 1000)), watermark + 1))

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues: object) -> None:
        start = float(initialState["start_s"].iloc[0])
        self.last.update((start, False))
        self.arm(start + self.never_s, timerValues.getCurrentWatermarkInMs())

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        times = np.sort(np.concatenate([p["ts_s"].to_numpy(float) for p in rows]))
        last = self.last.get() if self.last.exists() else None
        warned = last is not None and last[1] and not list(self.handle.listTimers())  # the silence after the last one has been told
        before = [last[0]] if last is not None and last[1] and not warned and last[0] < times[0] else []
        told = np.concatenate([before, times])
        newest = max(float(times[-1]), last[0]) if last is not None and last[1] else float(times[-1])
        self.last.update((newest, True))
        self.arm(newest + self.after_s, timerValues.getCurrentWatermarkInMs())
        yield self.rows(key, "silent", told[:-1][np.diff(told) > self.after_s])

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        from_s, seen = self.last.get()
        yield self.rows(key, "silent" if seen else "never", [from_s])

    @staticmethod
    def rows(key: tuple, status: str, from_s: list) -> pd.DataFrame:
        return pd.DataFrame({"rig_id": key[0], "cam_id": key[1], "status": status, "from_s": np.asarray(from_s, float)})

    def close(self) -> None:
        pass


def statuses(frames: DataFrame, cameras: DataFrame, after_s: float = 20.0, never_s: float = 0.0, late: str = "1 second") -> DataFrame:
    """(rig_id, cam_id, status, from_s): ``silent`` once for each silence of over after_s seconds of event time (column ts, and ts_s in seconds), from the last detection; ``never`` once for each of the
    ``cameras`` (rig_id, cam_id, start_s) that has no detection when never_s have passed since its start. All timers run on the stream's watermark."""
    kind = {f.name: f.dataType.simpleString() for f in frames.schema}
    seeds = cameras.select(*CAMERA, F.col("start_s").cast("double").alias("start_s")).groupBy(*CAMERA)
    marked = frames.withWatermark("ts", late).groupBy(*CAMERA)
    return marked.transformWithStateInPandas(_Status(after_s, never_s), f"rig_id {kind['rig_id']}, cam_id {kind['cam_id']}, status string, from_s double", "append", "eventTime", initialState=seeds)


def _newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each session's last points; the right hand's landmarks are numbered from 100."""
    seen = views(keypoints(spark, sf_dir), calibration(spark), 0.5)
    flat = seen.select(F.col("session").alias("rig_id"), "cam_id", F.col("frame").cast("double").alias("ts_s"), (F.col("lm_id") + F.when(F.col("part") == "right", 100).otherwise(0)).alias("lm_id"), "u", "v", *POSES)
    newest = checkpointed(framed(newest_rows(flat), [*CAMERA, "ts_s"]))  # a row a camera
    found = newest_points_of(newest, 0.5)
    return found.select("rig_id", "ts_s", "lm_id", "n_views", *[(F.round(c, 4) + 0.0).alias(c) for c in "xyz"])


QUERIES = {"newest_points": _newest}
ORACLE_SQL = {
    "newest_points": "with " + keypoints_sql() + """, s as (select * from keypoint where conf >= 0.5), last_ as (select session, max(frame) as frame from s group by session),
 n as (select s.session, s.frame, part, lm_id, count(*) as n_views from s join last_ using (session, frame) group by all having count(*) >= 2)
 select n.session as rig_id, cast(n.frame as double) as ts_s, n.lm_id + case when n.part = 'right' then 100 else 0 end as lm_id, n_views, round(x, 4) + 0.0 as x, round(y, 4) + 0.0 as y, round(z, 4) + 0.0 as z from n join points using (session, frame, part, lm_id)""",
}
