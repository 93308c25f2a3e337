"""Poses of a rig's cameras from the mean transforms of camera pairs, as arrays over many rigs at once."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mvspark.functions.geometry import angle_degrees
from mvspark.functions.rotations import cross_matrix, rotation_matrix, rotation_vector, turn_slope
from mvspark.operators.calibration import BOARDS_SQL, TURNS, board_edges, board_poses
from mvspark.plans.fixtures import table

REFINE_DEG = 1.0
#: Pairs of cameras of all rigs that are worked out together (some 100 bytes each, several times).
AT_ONCE = 1 << 17
SCHEMA = "cam_id string, reference string, method string, consistency_deg double, r array<double>, t array<double>"


def _settle(ref: np.ndarray, err: np.ndarray, r: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Poses (rigs, cameras) along the paths of least summed error from each camera's reference, which stands at the origin. All components settle one camera a round."""
    rigs, cams = ref.shape
    row = np.arange(rigs)
    far = np.where(ref == np.arange(cams), 0.0, np.inf)
    turn, place = np.broadcast_to(np.eye(3), (rigs, cams, 3, 3)).copy(), np.zeros((rigs, cams, 3))
    open_ = np.ones((rigs, cams), bool)
    for _ in range(cams):
        at = np.argmin(np.where(open_, far, np.inf), 1)
        open_[row, at] = False
        through = far[row, at][:, None] + err[row, at]
        better = open_ & (through < far)
        far = np.where(better, through, far)
        turn = np.where(better[..., None, None], r[row, at] @ turn[row, at][:, None], turn)
        place = np.where(better[..., None], np.einsum("bcij,bj->bci", r[row, at], place[row, at]) + t[row, at], place)
    return turn, place


def _misfit(turn: np.ndarray, place: np.ndarray, a: np.ndarray, b: np.ndarray, r: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each edge from a to b: the turn and the step between its posed and its measured transform (both as norms don't depend on the frame they are told in), the posed turn, and a's place turned by it."""
    step = turn[:, b] @ np.swapaxes(turn[:, a], -1, -2)
    moved = np.einsum("beij,bej->bei", step, place[:, a])
    return rotation_vector(step @ np.swapaxes(r, -1, -2)), place[:, b] - moved - t, step, moved


def refine(turn: np.ndarray, place: np.ndarray, a: np.ndarray, b: np.ndarray, r: np.ndarray, t: np.ndarray, weight: np.ndarray, free: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Poses (rigs, cameras) with the least weighted sum of squared misfits over the edges (a, b: cameras; r, t, weight: rigs, edges); cameras that aren't free stay. Normal equations
    of six rows a camera are summed from blocks of edges; each rig has its damping and stops when its step vanishes."""
    rigs, cams = free.shape
    damp, live = np.full(rigs, 1e-4), free.any(1)

    def cost(turn: np.ndarray, place: np.ndarray) -> np.ndarray:
        v, s, *_ = _misfit(turn, place, a, b, r, t)
        return np.sum(weight * (np.sum(v * v, -1) + np.sum(s * s, -1)), -1)

    now = cost(turn, place)
    held = ~np.repeat(free, 6, 1)
    for _ in range(rounds):
        if not live.any():
            break
        v, s, step, moved = _misfit(turn, place, a, b, r, t)
        slope = turn_slope(v)
        # Small turns in front of the poses, and steps of their places: what they do to both misfits.
        by_a, by_b = (np.zeros((*v.shape[:2], 6, 6)) for _ in range(2))
        by_b[..., :3, :3], by_b[..., 3:, :3], by_b[..., 3:, 3:] = slope, cross_matrix(moved), np.eye(3)
        by_a[..., :3, :3], by_a[..., 3:, :3], by_a[..., 3:, 3:] = -slope @ step, -step @ cross_matrix(place[:, a]), -step
        miss = np.concatenate([v, s], -1)
        normal, slant = np.zeros((rigs, cams, cams, 6, 6)), np.zeros((rigs, cams, 6))
        for i, one in ((a, by_a), (b, by_b)):
            np.add.at(slant, (slice(None), i), np.einsum("be,beki,bek->bei", weight, one, miss))
            for j, two in ((a, by_a), (b, by_b)):
                np.add.at(normal, (slice(None), i, j), np.einsum("be,beki,bekj->beij", weight, one, two))
        full = normal.transpose(0, 1, 3, 2, 4).reshape(rigs, 6 * cams, 6 * cams)
        full = np.where(held[:, :, None] | held[:, None, :], 0.0, full)
        full[:, np.arange(6 * cams), np.arange(6 * cams)] += np.where(held, 1.0, damp[:, None])
        move = np.linalg.solve(full, np.where(held, 0.0, -slant.reshape(rigs, -1))[..., None])[..., 0].reshape(rigs, cams, 6)
        new_turn, new_place = rotation_matrix(move[..., :3]) @ turn, place + move[..., 3:]
        then = cost(new_turn, new_place)
        took = live & (then <= now)
        turn, place = np.where(took[:, None, None, None], new_turn, turn), np.where(took[:, None, None], new_place, place)
        now, damp = np.where(took, then, now), np.where(took, damp / 5, damp * 10)
        live &= ~(np.abs(move).max((1, 2)) < 1e-11) & (damp < 1e12)
    return turn, place


def solve_rigs(err: np.ndarray, count: np.ndarray, r: np.ndarray, t: np.ndarray, refine_deg: float = REFINE_DEG) -> tuple[np.ndarray, ...]:
    """For rigs of equally many cameras, whose mean transforms from camera i to j are r, t (rigs, i, j, ...) with error err (inf: no edge) and count: the poses (turn, place), each camera's reference, whether it
    is alone, its component's mean misfit in degrees, and whether that was refined."""
    rigs, cams = err.shape[:2]
    edge = np.isfinite(err)
    reach = edge | np.eye(cams, dtype=bool)
    for _ in range(max(cams - 1, 1).bit_length()):
        reach = reach @ reach
    rank = edge.sum(2) * (1 << 40) + np.where(edge, count, 0).sum(2)
    ref = np.argmax(np.where(reach, rank[:, None], -1), 2)
    turn, place = _settle(ref, np.where(edge, err, np.inf), r, t)
    a, b = np.triu_indices(cams, 1)
    used = edge[:, a, b].any(0)  # pairs that no rig has are left out
    a, b = a[used], b[used]
    here = edge[:, a, b]
    rm, tm = np.where(here[..., None, None], r[:, a, b], np.eye(3)), np.where(here[..., None], t[:, a, b], 0.0)
    off = np.degrees(np.linalg.norm(_misfit(turn, place, a, b, rm, tm)[0], axis=-1))
    inside = reach[:, :, a] & here[:, None]  # edges of each camera's component
    n = inside.sum(2)
    error = np.where(n > reach.sum(2) - 1, np.sum(np.where(inside, off[:, None], 0.0), 2) / np.maximum(n, 1), 0.0)
    again = error > refine_deg
    if again.any():
        some = again.any(1)
        weight = np.where(here & again[:, a], count[:, a, b], 0.0)
        turn[some], place[some] = refine(turn[some], place[some], a, b, rm[some], tm[some], weight[some], (again & (ref != np.arange(cams)))[some])
    return turn, place, ref, reach.sum(2) == 1, error, again


def _solved(rigs: pd.DataFrame) -> Iterator[dict]:
    """Rows of many rigs (rig_id, cam_a, cam_b, r, t, err, n as lists of edges), those of equally many cameras together."""
    names = [sorted({*a, *(c for c in b if c is not None)}) for a, b in zip(rigs["cam_a"], rigs["cam_b"], strict=True)]
    by_size: dict[int, list[int]] = {}
    for i, cams in enumerate(names):
        by_size.setdefault(len(cams), []).append(i)
    for cams, members in by_size.items():
        most = max(1, AT_ONCE // (cams * cams))
        for part in (members[k : k + most] for k in range(0, len(members), most)):
            shape = (len(part), cams, cams)
            err, count, r, t = np.full(shape, np.inf), np.zeros(shape, np.int64), np.zeros((*shape, 3, 3)), np.zeros((*shape, 3))
            for g, i in enumerate(part):
                place, row = {c: k for k, c in enumerate(names[i])}, rigs.iloc[i]
                for a, b, re, te, e, n in zip(row["cam_a"], row["cam_b"], row["r"], row["t"], row["err"], row["n"], strict=True):
                    if b is not None and a != b:
                        i_, j_, m = place[a], place[b], np.asarray(re, float).reshape(3, 3)
                        r[g, i_, j_], t[g, i_, j_], r[g, j_, i_], t[g, j_, i_] = m, te, m.T, -m.T @ np.asarray(te, float)
                        err[g, i_, j_] = err[g, j_, i_] = e
                        count[g, i_, j_] = count[g, j_, i_] = n
            turn, place, ref, alone, error, again = solve_rigs(err, count, r, t)
            for g, i in enumerate(part):
                for k, cam in enumerate(names[i]):
                    one = {"rig_id": rigs["rig_id"].iloc[i], "cam_id": cam, "reference": None, "method": "excluded", "consistency_deg": None, "r": None, "t": None}
                    if not alone[g, k]:
                        one |= {"reference": names[i][ref[g, k]], "method": "graph" if again[g, k] else "chain", "consistency_deg": error[g, k], "r": turn[g, k].ravel().tolist(), "t": place[g, k].tolist()}
                    yield one


def pose_graph(edge_rows: DataFrame, cameras: DataFrame) -> DataFrame:
    """(rig_id, cam_id, reference, method, consistency_deg, r, t) of every camera of every rig. edge_rows: rig_id, cam_a, cam_b, r, t, err, n, one row a pair. In each component the reference is the camera
    with the most edges, then observations, then the first by name; cameras without edges are ``excluded``. Where the component's edges disagree by over a degree in the mean, its poses are refined.
    A rig's edges (cameras squared at most) are one row; rigs are dealt to tasks and worked out many at a time."""
    alone = cameras.select("rig_id", F.col("cam_id").alias("cam_a"))
    rows = edge_rows.select("rig_id", "cam_a", "cam_b", "r", "t", "err", "n").unionByName(alone, allowMissingColumns=True)
    rigs = rows.groupBy("rig_id").agg(F.collect_list(F.struct("cam_a", "cam_b", "r", "t", "err", "n")).alias("e")).select("rig_id", *[F.col(f"e.{c}").alias(c) for c in ("cam_a", "cam_b", "r", "t", "err", "n")])
    kind = rigs.schema["rig_id"].dataType.simpleString()
    columns = ["rig_id", "cam_id", "reference", "method", "consistency_deg", "r", "t"]

    def solve(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rigs in parts:
            yield pd.DataFrame(list(_solved(rigs)), columns=columns)

    return rigs.mapInPandas(solve, f"rig_id {kind}, {SCHEMA}")


def planted_rigs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Edges and cameras of a rig for each customer, whose cameras are turned about z. By the key's remainder by four: all six pairs of four cameras agree; two more cameras know
    only each other; the fourth camera knows nobody; three cameras at one place, whose loop doesn't close by 6 to 10 degrees."""
    key = F.col("c_custkey")
    kind = key % 4
    rigs = table(spark, sf_dir, "customer").select(key.cast("long").alias("rig_id"), kind.cast("int").alias("kind"))
    last = F.when(F.col("kind") == 1, 5).when(F.col("kind") == 3, 2).otherwise(3)
    cams = rigs.select("rig_id", "kind", F.explode(F.sequence(F.lit(0), last)).alias("k"))
    pairs = rigs.select("*", F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in range(6) for b in range(a + 1, 6)])).alias("p")).select("rig_id", "kind", "p.*")
    top = F.when(F.col("kind") >= 2, 2).otherwise(3)
    pairs = pairs.filter((F.col("b") <= top) | ((F.col("kind") == 1) & (F.col("a") == 4)))
    bend = F.when((F.col("kind") == 3) & (F.col("a") == 0) & (F.col("b") == 2), F.radians(6.0 + F.col("rig_id") % 5)).otherwise(0.0)
    angle = (F.col("b") - F.col("a")) * (0.3 + 0.05 * (F.col("rig_id") % 9)) + bend
    pairs = pairs.withColumns({"c": F.cos(angle), "s": F.sin(angle), "y": (F.col("rig_id") % 10) / 10})
    x = lambda k: F.when(F.col("kind") == 3, 0.0).otherwise(0.5 * F.col(k) + 0.1)
    y = lambda k: F.when(F.col("kind") == 3, 0.0).otherwise(0.25 * F.col(k) + F.col("y"))
    z, o = F.lit(0.0), F.lit(1.0)
    r = F.array(F.col("c"), -F.col("s"), z, F.col("s"), F.col("c"), z, z, z, o)
    t = F.array(x("b") - F.col("c") * x("a") + F.col("s") * y("a"), y("b") - F.col("s") * x("a") - F.col("c") * y("a"), z)
    err = F.when(F.col("kind") == 3, F.when(F.col("b") - F.col("a") == 2, 1.0).otherwise(0.2)).otherwise(0.1 + (F.col("rig_id") + 3 * F.col("a") + 5 * F.col("b")) % 11 / 100)
    name = lambda k: F.concat(F.lit("cam"), F.col(k).cast("string"))
    edges = pairs.select("rig_id", name("a").alias("cam_a"), name("b").alias("cam_b"), r.alias("r"), t.alias("t"), err.alias("err"), (5 + (F.col("rig_id") + F.col("a") + 2 * F.col("b")) % 7).alias("n"))
    return edges, cams.select("rig_id", name("k").alias("cam_id"))


def _shown(g: DataFrame) -> DataFrame:
    at = lambda c, k: (F.round(F.get(c, F.lit(k)), 5) + 0.0).alias(f"{c}{k}")
    return g.select("rig_id", "cam_id", "reference", "method", F.round("consistency_deg", 4).alias("consistency_deg"), *[at("r", k) for k in (0, 3, 8)], *[at("t", k) for k in range(3)])


def _graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    cams = board_poses(spark, sf_dir).select("rig_id", "cam_id").distinct()
    g = pose_graph(board_edges(spark, sf_dir), cams)
    ref = g.filter("cam_id = reference").select("rig_id", F.col("r").alias("r0"))
    return g.join(ref, "rig_id").select("cam_id", "method", F.round("consistency_deg", 4).alias("consistency_deg"), F.round(angle_degrees("r", "r0"), 4).alias("turn_deg"))


QUERIES = {"pose_graph": _graph, "pose_graph_rigs": lambda spark, sf: _shown(pose_graph(*planted_rigs(spark, sf)))}
ORACLE_SQL = {
    # All pairs are seen often enough; the reference has the most observations.
    "pose_graph": BOARDS_SQL + ", t as (select * from (values " + ", ".join(f"({k}, atan2({b!r}, {a!r}))" for k, (a, b) in enumerate(TURNS)) + """) as v(k, turn)), n as (select a.k, count(*) as n from o a join o b on a.seq = b.seq and a.k <> b.k group by a.k),
 ref as (select turn from n join t using (k) order by n desc, k limit 1)
 select 'cam' || t.k as cam_id, 'chain' as method, 0.0::double as consistency_deg, round(degrees(abs(t.turn - ref.turn)), 4) as turn_deg from t, ref""",
    # A loop that doesn't close spreads over its edges by the inverse of their counts.
    "pose_graph_rigs": """with rig as (select c_custkey as rig_id, c_custkey % 4 as kind from customer), k as (select range as k from range(6)),
 cam as (select rig_id, kind, k, k >= 4 as comp, 0.3 + 0.05 * (rig_id % 9) as f, case when kind = 3 then 0 else 0.5 * k + 0.1 end as x, case when kind = 3 then 0 else 0.25 * k + rig_id % 10 / 10.0 end as y from rig, k where k <= case kind when 1 then 5 when 3 then 2 else 3 end),
 edge as (select rig_id, kind, a.k as a, b.k as b, 5 + (rig_id + a.k + 2 * b.k) % 7 as n from rig, k a, k b where a.k < b.k and (b.k <= case when kind >= 2 then 2 else 3 end or (kind = 1 and a.k = 4))),
 deg as (select rig_id, k, count(*) as d, sum(n) as n from (select rig_id, a as k, n from edge union all select rig_id, b, n from edge) group by all),
 ref as (select rig_id, comp, k as ref, f * k as fr, x as xr, y as yr from cam join deg using (rig_id, k) qualify row_number() over (partition by rig_id, comp order by d desc, deg.n desc, k) = 1),
 loop as (select rig_id, radians(6.0 + rig_id % 5) as bend, radians(6.0 + rig_id % 5) / sum(1.0::double / n) as share, max(case when a = 0 and b = 1 then 1.0::double / n end) as w01, max(case when a = 1 then 1.0::double / n end) as w12 from edge where kind = 3 group by rig_id),
 turned as (select cam.*, f * k + coalesce(case k when 1 then share * w01 when 2 then share * (w01 + w12) end, 0) as turn from cam left join loop using (rig_id)),
 rel as (select t.*, ref, fr, xr, yr, t.turn - rt.turn as d from turned t left join deg using (rig_id, k) left join ref on ref.rig_id = t.rig_id and ref.comp = t.comp and deg.k is not null left join turned rt on rt.rig_id = t.rig_id and rt.k = ref)
 select rig_id, 'cam' || k as cam_id, 'cam' || ref as reference, case when ref is null then 'excluded' when kind = 3 then 'graph' else 'chain' end as method,
  case when ref is null then null when kind = 3 then round((6.0::double + rig_id % 5) / 3, 4) else 0 end as consistency_deg, round(cos(d), 5) + 0.0 as r0, round(sin(d), 5) + 0.0 as r3, case when ref is null then null else 1.0::double end as r8,
  round(x - cos(d) * xr + sin(d) * yr, 5) + 0.0 as t0, round(y - sin(d) * xr - cos(d) * yr, 5) + 0.0 as t1, case when ref is null then null else 0.0::double end as t2 from rel""",
}
