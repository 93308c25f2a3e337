"""Hand meshes of several cameras over time: into the world, fused with the shape before in view, and set on the wrist."""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType
from pyspark.sql.window import Window

from mvspark.functions.series import dealt
from mvspark.plans.fixtures import POINTS_SQL, RING, calibration, true_points

NEAR_M, FACTOR = 0.08, 1.5
KEYS, XYZ = ["session", "frame", "side"], ["x", "y", "z", "wx", "wy", "wz"]
#: What a vertex of a whole mesh holds besides its camera.
MESH = ["vert_id", *XYZ, "weight"]


def _placed(v: dict[str, Column], r: Column, t: Column) -> dict[str, Column]:
    """Of a vertex (x, y, z) and its wrist (wx, wy, wz): the vertex relative to the wrist along the world's axes, and the wrist as a point of the world."""
    turn = lambda of, i: sum((F.get(r, F.lit(3 * i + k)) * of[k] for k in (1, 2)), F.get(r, F.lit(3 * i)) * of[0])
    wrist, off = [v[f"w{c}"] for c in "xyz"], [v[c] - v[f"w{c}"] for c in "xyz"]
    return {c: turn(off, i) for i, c in enumerate("xyz")} | {f"w{c}": turn(wrist, i) + F.get(t, F.lit(i)) for i, c in enumerate("xyz")}


def to_world(vertices: DataFrame, cameras: DataFrame) -> DataFrame:
    """Vertices (x, y, z) and their hand's wrist (wx, wy, wz) from their camera's coordinates: the vertices relative to the wrist along the world's axes, the wrist
    as a point of the world. Cameras (cam_id, r, t) lead from the camera to the world."""
    rows = vertices.join(cameras.select("cam_id", "r", "t"), "cam_id")
    return rows.withColumns(_placed({c: F.col(c) for c in XYZ}, F.col("r"), F.col("t"))).drop("r", "t")


def _middle(x: np.ndarray, counts: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Medians over the second axis (cameras) of those in the mask, one at least in each row."""
    shape = (...,) + (None,) * (x.ndim - 2)
    x = np.sort(np.where(mask[shape], x, np.inf), axis=1)
    at = lambda i: np.take_along_axis(x, i[shape][:, None], axis=1)[:, 0]
    return (at((counts - 1) // 2) + at(counts // 2)) / 2


def _chosen(shapes: np.ndarray, there: np.ndarray, size: np.ndarray, before: np.ndarray | None, near: float, factor: float) -> np.ndarray:
    """Which cameras count of each row's shapes (rows, cameras, vertices, 3), of which ``there`` and ``size`` (vertices of each row) hold: fuse_shapes() of many rows."""
    apart = lambda a, b: np.sqrt(((a - b[:, None]) ** 2).sum(axis=-1)).sum(axis=-1) / size[:, None]
    keep = there.copy()
    if before is not None:
        close = there & (apart(shapes, before) <= near)
        keep = np.where(close.any(axis=1)[:, None], close, keep)
    many = np.flatnonzero(keep.sum(axis=1) > 2)
    shapes, size, counts, some = shapes[many], size[many], keep[many].sum(axis=1), keep[many]
    off = apart(shapes, _middle(shapes, counts, some))
    keep[many] &= off <= factor * _middle(off, counts, some)[:, None]
    return keep


def _mean(shapes: np.ndarray, weights: np.ndarray, keep: np.ndarray) -> np.ndarray:
    w = np.where(keep, weights, 0.0)
    return np.einsum("nc,ncvi->nvi", w, shapes) / w.sum(axis=1)[:, None, None]


def fuse_shapes(shapes: np.ndarray, weights: np.ndarray, before: np.ndarray | None, near: float = NEAR_M, factor: float = FACTOR) -> tuple[np.ndarray, np.ndarray]:
    """Weighted mean of shapes (cameras, vertices, 3) and which cameras count: those near the shape before, or all where none is; of over two of them those not far
    from their median shape."""
    keep = _chosen(shapes[None], np.ones((1, len(shapes)), bool), np.array([shapes.shape[1]]), None if before is None else before[None], near, factor)
    return _mean(shapes[None], weights[None], keep)[0], keep[0]


def fuse_series(shapes: np.ndarray, weights: np.ndarray, there: np.ndarray, size: np.ndarray, follows: np.ndarray, first: dict[int, np.ndarray], near: float = NEAR_M, factor: float = FACTOR) -> tuple[np.ndarray, np.ndarray]:
    """fuse_shapes() of the rows of series. follows: the row before each row, or -1, where a row follows on a shape of ``first`` or on none.

    A fused shape is of its own row's cameras, so all rows are tried at once on what the row before makes without a shape before it; those after a row whose cameras came out
    otherwise are tried again, until none did."""
    keep = _chosen(shapes, there, size, None, near, factor)
    fused = _mean(shapes, weights, keep)
    after = np.full(len(shapes), -1)
    after[follows[follows >= 0]] = np.flatnonzero(follows >= 0)
    rows = np.sort(np.r_[np.flatnonzero(follows >= 0), np.array([*first], int)])
    while len(rows):
        before = fused[follows[rows]]
        for i in np.flatnonzero(follows[rows] < 0):
            before[i] = first[rows[i]]
        now = _chosen(shapes[rows], there[rows], size[rows], before, near, factor)
        moved = (now != keep[rows]).any(axis=1)
        rows, now = rows[moved], now[moved]
        keep[rows], fused[rows] = now, _mean(shapes[rows], weights[rows], now)
        rows = after[rows]
        rows = rows[rows >= 0]
    return fused, keep


def starts(*columns: np.ndarray) -> np.ndarray:
    """Where each run of equal values of sorted columns begins."""
    new = np.zeros(max(len(columns[0]) - 1, 0), bool)
    for c in columns:
        new |= c[1:] != c[:-1]
    return np.flatnonzero(np.r_[True, new]) if len(columns[0]) else np.zeros(0, int)


def whole(vertices: DataFrame) -> DataFrame:
    """(session, frame, side, v): a side's vertices in a frame, of all cameras, as one array of structs (cam_id, vert_id, x, y, z, wx, wy, wz, weight)."""
    return vertices.dropna(subset=KEYS).groupBy(*KEYS).agg(F.collect_list(F.struct("cam_id", *MESH)).alias("v"))


def fuse_over_time(vertices: DataFrame, frames: DataFrame, near: float = NEAR_M, factor: float = FACTOR) -> DataFrame:
    """(session, frame, side, vert_id, x, y, z, wx, wy, wz): one shape a frame of cameras' (session, frame, side, cam_id, vert_id, x, y, z, wx, wy, wz, weight), with the mean wrist
    of the cameras that count. A frame without cameras (frames: session, frame) ends the series. A camera's mesh has the vertices of every other's."""
    return fuse_whole(whole(vertices), frames, near, factor)


def placed(rows: DataFrame, frames: DataFrame) -> DataFrame:
    """Rows (session, frame, side, and others) of the listed frames (session, frame) with the frame's place among its session's. Rows that already lie together by session are not dealt
    out, and come out in the order of session, frame and side."""
    marks = frames.select("session", "frame").dropna().distinct().withColumn("mark", F.col("frame").cast("long"))
    # A frame's mark has no side, so it comes first: the place is the number of marks so far.
    so_far = Window.partitionBy("session").orderBy("frame", F.asc_nulls_first("side")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = rows.unionByName(marks, allowMissingColumns=True).withColumns({"place": F.count("mark").over(so_far), "listed": F.max("mark").over(so_far) == F.col("frame")})
    return both.filter("listed and mark is null").select(*rows.columns, "place")


def _codes(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Each value's place among the different ones (null: -1), and these in order."""
    names = pc.unique(values).drop_null()
    names = names.take(pc.sort_indices(names))
    return pc.index_in(values, names).fill_null(-1).to_numpy(zero_copy_only=False).astype(int), names


class _Turns:
    """Cameras' turns and places (cam_id, r, t) by name."""

    def __init__(self, cams: list[dict]):
        self.at = {c["cam_id"]: (np.array(c["r"], float).reshape(3, 3), np.array(c["t"], float)) for c in cams}

    def of(self, names: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each name whether it is listed, r and t; a null is not."""
        known = [self.at.get(n, (np.eye(3), np.zeros(3))) for n in names.to_pylist()] + [(np.eye(3), np.zeros(3))]
        return np.array([*(n in self.at for n in names.to_pylist()), False]), np.stack([r for r, _ in known]), np.stack([t for _, t in known])


def fuse_whole(meshes: DataFrame, frames: DataFrame, near: float = NEAR_M, factor: float = FACTOR, also: tuple[str, ...] = (), cameras: DataFrame | None = None, made: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]] | None = None, rows: int = 2048) -> DataFrame:
    """fuse_over_time() of whole meshes (see whole()), a row each; also of such that got their place by placed() and still lie in its order: these are not sorted. also: columns of doubles that stay beside the
    vertices. cameras (cam_id, r, t): the meshes are in their camera's coordinates, and are first brought to the world as by to_world(); these few are one row. made: what gives batches of
    rows their v (vert_id int), so that no vertex is handed to the tasks; the rows then hold what it needs.

    A session is a sorted run of rows, of which a task holds so many at once and each side's shape before them. Meshes that already lie together by session are not dealt out."""
    found = meshes if "place" in meshes.columns else placed(meshes, frames)
    if cameras is not None:
        found = found.join(F.broadcast(cameras.agg(F.collect_list(F.struct("cam_id", "r", "t")).alias("cams"))), F.lit(True))
    turned = cameras is not None
    kind = StructField("vert_id", IntegerType()) if made else meshes.schema["v"].dataType.elementType["vert_id"]
    if not made:
        found = found.select(*KEYS, "place", "v", *also, *[c for c in ("cams",) if turned])
    out = StructType([*[meshes.schema[c] for c in KEYS], kind, *[StructField(c, DoubleType()) for c in [*XYZ, *also]]])
    names = [f.name for f in out]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        session, before = None, {}  # of each side the last place and its shape
        batches = (b.slice(i, rows) for b in batches for i in range(0, b.num_rows, rows))
        for batch in made(batches) if made else batches:
            flat, sizes = batch.column("v").flatten(), pc.list_value_length(batch.column("v")).fill_null(0).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(sizes)), sizes)
            (cam, cams), (vert, verts) = (_codes(flat.field(c)) for c in ("cam_id", "vert_id"))
            key = (row * (len(cams) + 1) + cam) * (len(verts) + 1) + vert
            if turned:
                listed, r, t = _Turns(batch.column("cams")[0].as_py()).of(cams)
                at = np.flatnonzero(listed[cam])
            else:
                at = np.arange(len(row))
            if (key[at][1:] < key[at][:-1]).any():
                at = at[np.argsort(key[at], kind="stable")]
            row, cam = row[at], cam[at]
            if not len(at):
                continue
            # Places of a row's cameras and of a camera's vertices.
            runs = starts(row, cam)
            run = np.repeat(np.arange(len(runs)), np.diff(np.r_[runs, len(row)]))
            slot = np.arange(len(runs)) - np.repeat(starts(row[runs]), np.diff(np.r_[starts(row[runs]), len(runs)]))
            heads, place_in = row[runs], np.arange(len(row)) - runs[run]
            have = np.flatnonzero(np.bincount(row, minlength=len(sizes)))
            index = np.full(len(sizes), -1)
            index[have] = np.arange(len(have))
            most, deep = int(slot.max()) + 1, int(place_in.max()) + 1
            values = np.stack([flat.field(c).to_numpy(zero_copy_only=False).astype(float) for c in MESH[1:]], axis=1)[at]
            full = np.zeros((len(have), most, deep, 3))
            full[index[row], slot[run], place_in] = values[:, :3]
            there, weights, wrists = np.zeros((len(have), most), bool), np.zeros((len(have), most)), np.zeros((len(have), most, 3))
            head = index[heads], slot
            there[head], weights[head], wrists[head] = True, values[runs, 6], values[runs, 3:6]
            size = np.zeros(len(have), int)
            np.maximum.at(size, index[row], place_in + 1)
            if turned:
                turn, move = np.broadcast_to(np.eye(3), (*there.shape, 3, 3)).copy(), np.zeros((*there.shape, 3))
                turn[head], move[head] = r[cam[runs]], t[cam[runs]]
                full = np.where(there[..., None, None] & (np.arange(deep) < size[:, None])[:, None, :, None], (full - wrists[:, :, None]) @ turn.swapaxes(-1, -2), 0.0)
                wrists = np.einsum("ncij,ncj->nci", turn, wrists) + move
            # Series of the batch, in the order of their places.
            own = batch.take(pa.array(have))
            code, sessions = _codes(own.column("session"))
            side, sides = _codes(own.column("side"))
            place = own.column("place").to_numpy(zero_copy_only=False)
            order = np.lexsort((place, side, code))
            same = np.r_[False, (side[order][1:] == side[order][:-1]) & (code[order][1:] == code[order][:-1])]
            follows, first = np.full(len(have), -1), {}
            on = np.flatnonzero(same & (np.r_[-1, place[order][:-1]] == place[order] - 1))
            follows[order[on]] = order[on - 1]
            label = lambda k: (sessions[code[k]].as_py(), sides[side[k]].as_py() if side[k] >= 0 else None)
            for k in order[~same]:
                of, which = label(k)
                last, shape = before.get(which, (None, None))
                if of == session and last == place[k] - 1:
                    first[int(k)] = np.zeros((deep, 3))
                    first[int(k)][: len(shape)] = shape
            fused, keep = fuse_series(full, weights, there, size, follows, first, near, factor)
            ends = order[np.r_[~same[1:], True]]
            now = label(order[-1])[0]
            before = before if now == session else {}
            before |= {label(k)[1]: (place[k], fused[k, : size[k]]) for k in ends if label(k)[0] == now}
            session = now
            wrist = np.einsum("nc,nci->ni", keep, wrists) / keep.sum(axis=1)[:, None]
            each, whole_ = pa.array(np.repeat(np.arange(len(have)), size)), np.arange(deep) < size[:, None]
            # A row's vertices are those of its first camera.
            vertex = flat.field("vert_id").take(pa.array(at[slot[run] == 0]))
            columns = [*[own.column(c).take(each) for c in KEYS], vertex, *[pa.array(fused[..., c][whole_]) for c in range(3)], *[pa.array(np.repeat(wrist[:, c], size)) for c in range(3)], *[own.column(c).take(each) for c in also]]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    if "place" not in meshes.columns:
        found = found.sortWithinPartitions("session", "frame", F.asc_nulls_first("side"))
    return found.mapInArrow(scan, out)


def on_wrists(fused: DataFrame, body: DataFrame | None = None) -> DataFrame:
    """Fused shapes as points of the world: set on the body's wrist (session, frame, side, x, y, z) where there is one, else on the cameras' mean wrist. Without ``body`` the rows hold
    its wrists themselves (bx, by, bz)."""
    rows = fused
    if body is not None:
        rows = fused.join(body.select("session", "frame", "side", *[F.col(c).alias(f"b{c}") for c in "xyz"]), ["session", "frame", "side"], "left")
    at = {c: F.col(c) + F.coalesce(f"b{c}", f"w{c}") for c in "xyz"}
    return rows.withColumns(at).select("session", "frame", "side", "vert_id", *"xyz")


def _meshes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ten vertices about each wrist (frame, wx, wy, wz, and others) as four cameras see them, whole; the fourth sees three times the shape in every seventh frame."""
    k, j = (x.ravel().astype(float) for x in np.meshgrid(np.arange(len(RING)), np.arange(10), indexing="ij"))
    rc, rs = (np.repeat([of[i] for of in RING], 10) for i in (0, 1))
    into = lambda x, z: (rc * x - rs * (z - 2), rs * x + rc * (z - 2))
    for batch in batches:
        frame, wx, wy, wz = (batch.column(c).to_numpy(zero_copy_only=False)[:, None] for c in ("frame", "wx", "wy", "wz"))
        size = np.where((k == 3) & (frame % 7 == 0), 3.0, 1.0)
        n, (x, z), (vx, vz) = len(frame), into(wx + (0.01 * j + 0.0005 * k * k * j) * size, wz), into(wx, wz)
        values = [x, wy + 0.02 * j * size, z, vx, wy + 0.0 * j, vz, np.broadcast_to(1.0 + k, x.shape)]
        names = pa.DictionaryArray.from_arrays(np.tile(k, n).astype(np.int32), [f"cam{i:02d}" for i in range(len(RING))]).cast(pa.string())
        flat = pa.StructArray.from_arrays([names, pa.array(np.tile(j, n).astype(np.int32)), *[pa.array(v.ravel()) for v in values]], names=["cam_id", *MESH])
        v = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * len(k)), flat)
        yield pa.RecordBatch.from_arrays([*batch.columns, v], names=[*batch.schema.names, "v"])


def _fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wrists are dealt out by session, the body's (in two of three frames) beside the hand's, and put in order before they get their vertices: no vertex is."""
    body = {"bx": F.col("x"), "by": F.col("y"), "bz": F.col("z") + 0.5}
    hands = true_points(spark, sf_dir).filter("lm_id = 0").withColumnRenamed("part", "side")
    wrists = dealt(hands.select("session", "frame", "side", *[F.col(c).alias(f"w{c}") for c in "xyz"], *[F.when(F.col("frame") % 3 != 0, v).alias(k) for k, v in body.items()]), "session")
    mesh = on_wrists(fuse_whole(placed(wrists, wrists), wrists, also=tuple(body), cameras=calibration(spark), made=_meshes))
    # Five decimals, without the decimal numbers that round() makes of each double.
    return mesh.select("session", "frame", "side", "vert_id", *[(F.rint(F.col(c) * 1e5) / 1e5 + 0.0).alias(c) for c in "xyz"])


QUERIES = {"mesh_over_time": _fused}
ORACLE_SQL = {
    # With the shape before in view the bad camera falls first, and then the third; at the start it falls with the others' median.
    "mesh_over_time": f"""with {POINTS_SQL}, w as (select session, frame, part as side, x, y, z, frame % 7 = 0 and row_number() over (partition by session, part order by frame) > 1 as two from points where lm_id = 0),
 s as (select *, unnest(range(0, 10)) as j, case when two then (0 + 2 * 1) / 3.0::double else (0 + 2 * 1 + 3 * 4) / 6.0::double end as k2 from w)
 select session, frame, side, cast(j as integer) as vert_id, round(x + 0.01 * j + 0.0005 * k2 * j, 5) + 0.0 as x, round(y + 0.02::double * j, 5) + 0.0 as y, round(z + case when frame % 3 <> 0 then 0.5::double else 0 end, 5) + 0.0 as z from s""",
}
