"""Initial estimates of a factor graph, spread from fixed variables in rounds that double the ways they compose.

Poses. Variables are first joined within blocks of 2^BLOCK ids, breadth first from the fixed ones and then from the smallest ids, each block
in one task, so a chain whose ids follow each other leaves one component a block, and only these take part in rounds. Fixed
variables belong to the world. In a round each component is hung, through one of
its factors, on the neighbouring component of the smallest id below its own (the world is below all). The trees that this makes
are flattened by doubling: a component's pose in its parent is multiplied by the parent's in the grandparent, so ways of length
2^k take k joins. Factors then join fewer components, and the rounds end when none joins two. A chain of n poses takes one round and log2 n
joins. Where measurements agree, the poses are those that any walk gives; where they don't, the ways are those of the rule
above, not the shortest, and do not depend on how tables are partitioned.

Other variables start when enough of their factors have gathered on known poses. Each rule is a grouped sum and a small
closed solution, so a point that a million poses see is no hot key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanweave.functions import poses
from scanweave.operators.tracks import compose
from scanweave.sources.tables import keep

#: The component of what is known; ids of variables are above it.
WORLD = -(1 << 63)
#: Bits of an id inside its block.
BLOCK = 12
_P = poses.STRUCT


def _let(f: Callable[..., Column], *columns: Column) -> Column:
    """f of the columns, each computed once: products of products would else repeat their factors a thousand times."""
    bound = F.array(F.struct(*[c.alias(f"v{i}") for i, c in enumerate(columns)]))
    return F.element_at(F.transform(bound, lambda s: f(*[s[f"v{i}"] for i in range(len(columns))])), 1)


def _times(a: Column, b: Column) -> Column:
    return _let(lambda p, q: poses.struct(poses.compose(poses.of(p), poses.of(q))), a, b)


def _back(a: Column) -> Column:
    return _let(lambda p: poses.struct(poses.inverse(poses.of(p))), a)


def _unit(a: Column) -> Column:
    def scaled(p: Column) -> Column:
        q = poses.of(p)[3:]
        norm = F.sqrt(sum(x * x for x in q))
        return poses.struct((*poses.of(p)[:3], *[x / norm for x in q]))

    return _let(scaled, a)


def _still() -> Column:
    return poses.struct(tuple(F.lit(v) for v in (0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0)))


def _flattened(parents: DataFrame, rounds: list[str]) -> DataFrame:
    """(node, root, pose) of (node, parent, pose): each node's last parent, and its pose there. Two joins are one round, after
    which every node has looked at four times as many ancestors."""
    now = parents.select("node", F.col("parent").alias("root"), "pose")
    while True:
        for _ in range(2):
            up = now.select(F.col("node").alias("root"), F.col("root").alias("_up"), F.col("pose").alias("_up_pose"))
            met = now.join(up, "root", "left")
            now = met.select("node", F.coalesce("_up", "root").alias("root"), F.when(F.col("_up").isNull(), F.col("pose")).otherwise(_unit(_times(F.col("_up_pose"), F.col("pose")))).alias("pose"), F.col("_up").isNotNull().alias("_moved"))
        now = keep(now, "spread-tree")
        rounds.append("double")
        if not now.where("_moved").limit(1).count():
            return now.drop("_moved")
        now = now.drop("_moved")


def _hung(members: DataFrame, tops: DataFrame) -> DataFrame:
    """members (id, root, pose) on the roots of their roots: tops are (id, root, pose)."""
    up = tops.select(F.col("id").alias("root"), F.col("root").alias("_up"), F.col("pose").alias("_up_pose"))
    moved = F.when(F.col("_up").isNull(), F.col("pose")).otherwise(_unit(_times(F.col("_up_pose"), F.col("pose"))))
    return members.join(up, "root", "left").select("id", F.coalesce("_up", "root").alias("root"), moved.alias("pose"))


def _in_block(steps: pd.DataFrame, fixed: pd.DataFrame) -> pd.DataFrame:
    """(id, root, pose) of the variables of a block of ids: the fixed ones and what its steps join to them in the world, the others in
    the frame of the smallest id that its steps join them to. Rows without b name a variable only."""
    ids = np.unique(np.concatenate([steps["a"].to_numpy(), steps["b"].dropna().to_numpy().astype(np.int64), fixed["id"].to_numpy()]).astype(np.int64))
    own = steps[steps["b"].notna()].sort_values(["id", "a", "b"])
    a, b = (np.searchsorted(ids, own[c].to_numpy().astype(np.int64)) for c in "ab")
    step = own[list(poses.FIELDS)].to_numpy(float).reshape(-1, 7)
    turn = step * np.array([1, 1, 1, -1, -1, -1, 1.0])
    back = turn.copy()
    back[:, :3] = -compose(np.hstack([np.zeros((len(turn), 3)), turn[:, 3:]]), step)[:, :3]
    both, links = np.concatenate([np.hstack([np.zeros((1, 6)), np.ones((1, 1))]), step, back]), [[] for _ in ids]
    for k, (i, j) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        links[i].append((j, k + 1))
        links[j].append((i, k + 1 + len(a)))
    parent, by, root = np.arange(len(ids)), np.zeros(len(ids), int), [-1] * len(ids)
    world = np.searchsorted(ids, np.sort(fixed["id"].to_numpy())).tolist()
    for starts in (world, *([i] for i in range(len(ids)))):
        queue = [i for i in starts if root[i] < 0]
        for i in queue:
            root[i] = i
        for i in queue:  # grows as it is read
            for j, k in links[i]:
                if root[j] < 0:
                    root[j], parent[j], by[j] = root[i], i, k
                    queue.append(j)
    pose = both[by]
    while (rows := np.flatnonzero(parent[parent] != parent)).size:
        pose[rows], parent[rows] = compose(pose[parent[rows]], pose[rows]), parent[parent[rows]]
    top, at = ids[parent], {i: p for i, *p in fixed[["id", *poses.FIELDS]].itertuples(index=False)}
    rows = np.flatnonzero(np.isin(parent, world))
    if len(rows):
        pose[rows] = compose(np.array([at[i] for i in top[rows]], float), pose[rows])
        top[rows] = WORLD
    pose[:, 3:] /= np.linalg.norm(pose[:, 3:], axis=1, keepdims=True)
    return pd.DataFrame({"id": ids, "root": top} | {c: pose[:, k] for k, c in enumerate(poses.FIELDS)})


def spread_poses(known: DataFrame, steps: DataFrame, rounds: list[str] | None = None) -> DataFrame:
    """(id, pose) of all variables that steps (a, b, step, id: the pose of b in the frame of a) join to known (id, pose), the
    known ones included. rounds gets a word for each job that was run. Steps with a null are left out."""
    rounds = [] if rounds is None else rounds
    usable = steps.where("a is not null and b is not null and step is not null and a != b").select("id", "a", "b", "step")
    fixed = known.where("pose is not null").groupBy("id").agg(F.first("pose").alias("pose"))
    block = lambda c: F.shiftright(c, BLOCK).alias("block")
    near = F.shiftright("a", BLOCK) == F.shiftright("b", BLOCK)
    far = keep(usable.where(~near), "spread-far")
    alone = far.select(F.explode(F.array("a", "b")).alias("a")).distinct()
    rows = usable.where(near).select(block("a"), "id", "a", "b", "step.*").unionByName(alone.select(block("a"), "a"), allowMissingColumns=True)
    held = fixed.select(block("id"), "id", "pose.*")
    members = rows.groupBy("block").cogroup(held.groupBy("block")).applyInPandas(_in_block, f"id long, root long, {', '.join(f'{c} double' for c in poses.FIELDS)}")
    members = keep(members.select("id", "root", F.struct(*poses.FIELDS).alias("pose")), "spread-members")
    rounds.append("block")
    end = lambda side, name: members.select(F.col("id").alias(side), F.col("root").alias(f"{name}_root"), F.col("pose").alias(f"{name}_pose"))
    arcs, tops = far.join(end("a", "a"), "a").join(end("b", "b"), "b"), None  # tops: roots of blocks, their roots and their poses there
    while True:
        # the pose of b's root in the frame of a's: out of a's root to a, over the step, back from b to its root
        whole = _unit(_times(_times(F.col("a_pose"), F.col("step")), _back(F.col("b_pose"))))
        arcs = arcs.where("a_root != b_root").select("id", F.col("a_root").alias("a"), F.col("b_root").alias("b"), whole.alias("step"))
        low = F.col("a") < F.col("b")
        arcs = arcs.select("id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(low, F.col("step")).otherwise(_back(F.col("step"))).alias("step"))
        # of the arcs of two components the first is enough
        arcs = keep(arcs.groupBy("a", "b").agg(F.min("id").alias("id"), F.min_by("step", "id").alias("step")), "spread-arcs")
        rounds.append("hang")
        if not arcs.limit(1).count():
            break
        parents = arcs.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("parent"), F.min_by("step", "a").alias("pose"))
        flat = _flattened(parents, rounds)
        if tops is None:
            ids = arcs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
            tops = ids.select("id", F.col("id").alias("root"), _still().alias("pose"))
        tops = keep(_hung(tops, flat.withColumnRenamed("node", "id")), "spread-tops")
        side = lambda s: flat.select(F.col("node").alias(s), F.col("root").alias(f"{s}_up"), F.col("pose").alias(f"{s}_up_pose"))
        moved = arcs.join(side("a"), "a", "left").join(side("b"), "b", "left")
        arcs = moved.select("id", "step", F.coalesce("a_up", "a").alias("a_root"), F.coalesce("b_up", "b").alias("b_root"), F.coalesce("a_up_pose", _still()).alias("a_pose"), F.coalesce("b_up_pose", _still()).alias("b_pose"))
    members = members if tops is None else _hung(members, tops)
    return members.where(F.col("root") == WORLD).select("id", "pose")


# rules for points and for poses that points fix. A rule gets factors whose variables all but one are known, as
# (target, measurement, pose, offset, point), and gives (id, estimate) for the targets that it can start.


def _numbers(n: int) -> list[Column]:
    return [F.col("measurement")[i] for i in range(n)]


def _in(pose: Column, v: list[Column]) -> list[Column]:
    p = poses.of(pose)
    return [p[i] + x for i, x in enumerate(poses.rotate(p[3:], v))]


def _mean_point(rows: DataFrame, v: list[Column]) -> DataFrame:
    """Of a target's factors the first is taken, by its id."""
    point = poses.struct((*v, F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)))
    return rows.select("target", "factor", point.alias("p")).groupBy(F.col("target").alias("id")).agg(F.min_by("p", "factor").alias("estimate"))


def _point(rows: DataFrame) -> DataFrame:
    return _mean_point(rows, _in(F.col("pose"), _numbers(3)))


def _point_2d(rows: DataFrame) -> DataFrame:
    return _mean_point(rows, _in(F.col("pose"), [*_numbers(2), F.lit(0.0)]))


def _point_offset(rows: DataFrame) -> DataFrame:
    return _mean_point(_framed(rows), _in(F.col("frame"), _numbers(3)))


def _stereo(rows: DataFrame) -> DataFrame:
    """u, v and disparity of a rectified pair; then fx, fy, cx, cy and baseline times fx. Points behind the camera don't start."""
    u, v, d, fx, fy, cx, cy, bf = _numbers(8)
    z = bf / d
    rows = _framed(rows.where(d > 0)).withColumn("seen", F.array((u - cx) / fx * z, (v - cy) / fy * z, z))
    return _mean_point(rows, _in(F.col("frame"), [F.col("seen")[i] for i in range(3)]))


def _solved(rows: DataFrame, normal: list[list[Column]], right: list[Column], least: int, ratio: float, dims: int) -> DataFrame:
    """The solutions of grouped normal equations sum(normal) x = sum(right), where at least `least` factors have met and the
    smallest eigenvalue is at least `ratio` of the largest."""
    pairs = [(i, j) for i in range(dims) for j in range(i, dims)]
    sums = [F.sum(normal[i][j]).alias(f"h{i}{j}") for i, j in pairs] + [F.sum(right[i]).alias(f"b{i}") for i in range(dims)]
    met = rows.groupBy("target").agg(F.count("*").alias("n"), *sums).where(F.col("n") >= least).drop("n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = [x.to_numpy(zero_copy_only=False) for x in batch.columns]
            h = np.zeros((batch.num_rows, dims, dims))
            for k, (i, j) in enumerate(pairs):
                h[:, i, j] = h[:, j, i] = c[1 + k]
            b = np.stack(c[1 + len(pairs) :], axis=1)
            e = np.linalg.eigvalsh(h)
            ok = np.isfinite(h).all(axis=(1, 2)) & (e[:, -1] > 0) & (e[:, 0] >= max(ratio, 1e-12) * e[:, -1])
            x = np.zeros((int(ok.sum()), 7))
            x[:, :dims], x[:, 6] = np.linalg.solve(h[ok], b[ok][:, :, None])[:, :, 0], 1.0
            yield pa.RecordBatch.from_arrays([pa.array(c[0][ok]), pa.StructArray.from_arrays([pa.array(x[:, i]) for i in range(7)], names=list(poses.FIELDS))], names=["id", "estimate"])

    return met.mapInArrow(run, f"id long, estimate {_P}")


def _framed(rows: DataFrame) -> DataFrame:
    """rows with the sensor's pose as a column of its own, which is computed once."""
    return rows.withColumn("frame", _times(F.col("pose"), F.col("offset")))


def _bearing_2d(rows: DataFrame) -> DataFrame:
    """Two bearings or more: the point nearest to all their lines."""
    p, a = poses.of(F.col("pose")), F.col("measurement")[0]
    rows = rows.withColumn("ray", _let(lambda d: F.array(d[1], -d[0]), F.array(*poses.rotate(p[3:], (F.cos(a), F.sin(a), F.lit(0.0))))))
    n = [F.col("ray")[i] for i in range(2)]
    along = n[0] * p[0] + n[1] * p[1]
    return _solved(rows, [[n[i] * n[j] for j in range(2)] for i in range(2)], [n[i] * along for i in range(2)], 2, 1e-9, 2)


def _rays(rows: DataFrame, direction: list[Column], least: int, ratio: float) -> DataFrame:
    """The point nearest to the lines along these directions of the sensor, weighted by their squared lengths."""
    p = poses.of(F.col("frame"))
    rows = _framed(rows).withColumn("seen", F.array(*direction))
    rows = rows.withColumn("ray", F.array(*poses.rotate(p[3:], tuple(F.col("seen")[i] for i in range(3)))))
    d = [F.col("ray")[i] for i in range(3)]
    dd = sum(x * x for x in d)
    h = [[(dd if i == j else F.lit(0.0)) - d[i] * d[j] for j in range(3)] for i in range(3)]
    return _solved(rows, h, [sum(h[i][j] * p[j] for j in range(3)) for i in range(3)], least, ratio, 3)


def _omni(rows: DataFrame) -> DataFrame:
    """Three directions or more, through a sensor offset, that meet at wide enough angles."""
    return _rays(rows, _numbers(3), 3, 1e-1)


def _pinhole(rows: DataFrame) -> DataFrame:
    """Three pixels or more; the measurement is u, v, fx, fy, cx, cy."""
    u, v, fx, fy, cx, cy = _numbers(6)
    return _rays(rows, [(u - cx) / fx, (v - cy) / fy, F.lit(1.0)], 3, 1e-6)


def _pose_of_points(rows: DataFrame) -> DataFrame:
    """A pose from four known points or more that it has measured: the rotation that turns the measured cloud into the known
    one, from sums alone, and the shift of the means."""
    q, p = _numbers(3), poses.of(F.col("point"))[:3]
    sums = [F.sum(x).alias(f"q{i}") for i, x in enumerate(q)] + [F.sum(x).alias(f"p{i}") for i, x in enumerate(p)]
    sums += [F.sum(p[i] * q[j]).alias(f"c{i}{j}") for i in range(3) for j in range(3)]
    met = rows.groupBy("target").agg(F.count("*").alias("n"), *sums).where("n >= 4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = np.stack([x.to_numpy(zero_copy_only=False).astype(np.float64) for x in batch.columns[1:]], axis=1)
            n, q, p = c[:, :1], c[:, 1:4] / c[:, :1], c[:, 4:7] / c[:, :1]
            spread = c[:, 7:].reshape(-1, 3, 3) / n[:, :, None] - p[:, :, None] * q[:, None, :]
            u, s, v = np.linalg.svd(spread)
            sign = np.sign(np.linalg.det(u @ v))
            flip = np.stack([np.ones_like(sign), np.ones_like(sign), sign], axis=1)
            r = (u * flip[:, None, :]) @ v
            ok = s[:, 1] > 1e-9 * np.maximum(s[:, 0], 1e-300)  # points on a line don't fix a rotation
            t = p - np.einsum("nij,nj->ni", r, q)
            x = np.hstack([t, quaternions(r)])[ok]
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(ok)), pa.StructArray.from_arrays([pa.array(x[:, i]) for i in range(7)], names=list(poses.FIELDS))], names=["id", "estimate"])

    return met.mapInArrow(run, f"id long, estimate {_P}")


def quaternions(r: np.ndarray) -> np.ndarray:
    """Unit quaternions (x, y, z, w) of rotation matrices: the eigenvector of the largest eigenvalue of Bar-Itzhack's matrix."""
    k = np.zeros((len(r), 4, 4))
    k[:, 0, 0], k[:, 1, 1], k[:, 2, 2] = r[:, 0, 0] - r[:, 1, 1] - r[:, 2, 2], r[:, 1, 1] - r[:, 0, 0] - r[:, 2, 2], r[:, 2, 2] - r[:, 0, 0] - r[:, 1, 1]
    k[:, 3, 3] = r[:, 0, 0] + r[:, 1, 1] + r[:, 2, 2]
    for i, j, a, b in ((0, 1, r[:, 0, 1], r[:, 1, 0]), (0, 2, r[:, 0, 2], r[:, 2, 0]), (1, 2, r[:, 1, 2], r[:, 2, 1])):
        k[:, i, j] = k[:, j, i] = a + b
    for i, v in enumerate((r[:, 2, 1] - r[:, 1, 2], r[:, 0, 2] - r[:, 2, 0], r[:, 1, 0] - r[:, 0, 1])):
        k[:, i, 3] = k[:, 3, i] = v
    q = np.linalg.eigh(k)[1][:, :, -1]
    return np.where(q[:, 3:] < 0, -q, q)


#: Kind of factor -> (which variable it starts, the rule). Variables are [pose, point] or [pose, point, offset].
RULES: dict[str, tuple[str, Callable[[DataFrame], DataFrame]]] = {
    "pose_point": ("point", _point),
    "pose_point_2d": ("point", _point_2d),
    "pose_point_offset": ("point", _point_offset),
    "pose_bearing_2d": ("point", _bearing_2d),
    "pose_omni": ("point", _omni),
    "pose_pinhole": ("point", _pinhole),
    "pose_stereo": ("point", _stereo),
}


def initialise(variables: DataFrame, factors: DataFrame, rounds: list[str] | None = None, level: int | None = None) -> DataFrame:
    """variables (id, estimate, fixed, other columns) with estimates of all that factors join to the fixed ones, and `initialised`.

    factors (id, kind, variables, measurement) of the kinds pose_pose (7 numbers, or 3 in the plane) and those of RULES;
    optionally level (only that one counts, where it is asked for) and enabled. Points are poses that do not turn. A pose that
    no pose-pose factor reaches starts from four known points that it measured (kind pose_point). Poses and points take turns until
    nothing new starts; variables that nothing reaches keep their estimate. A fixed variable needs an estimate to count.
    """
    rounds = [] if rounds is None else rounds
    factors = factors.where("enabled") if "enabled" in factors.columns else factors
    factors = factors.where(F.col("level") == level) if level is not None else factors
    m = F.col("measurement")
    planar = poses.struct((m[0], m[1], F.lit(0.0), *poses.yaw(m[2])))
    whole = poses.struct(tuple(m[i] for i in range(7)))
    v = F.col("variables")
    steps = factors.where("kind = 'pose_pose'").select("id", v[0].alias("a"), v[1].alias("b"), F.when(F.size(m) == 3, planar).otherwise(whole).alias("step"))
    others = {r.kind for r in factors.select("kind").distinct().collect()} & set(RULES)
    known = keep(variables.where("fixed and estimate is not null").select("id", F.col("estimate").alias("pose")), "spread-known")
    while True:
        known = keep(spread_poses(known, steps, rounds), "spread-known")
        for kind in sorted(others):
            target, rule = RULES[kind]
            own = factors.where(F.col("kind") == kind).select(F.col("id").alias("factor"), v[0].alias("_pose"), v[1].alias("_point"), F.try_element_at(v, F.lit(3)).alias("_offset"), "measurement")
            started = rule(_ready(own, known, "_point", ("_pose", "_offset")))
            known = keep(known.unionByName(started.withColumnRenamed("estimate", "pose").join(known.select("id"), "id", "left_anti")), "spread-known")
            rounds.append(kind)
        if "pose_point" not in others:
            break
        own = factors.where("kind = 'pose_point'").select(F.col("id").alias("factor"), v[0].alias("_pose"), v[1].alias("_point"), F.lit(None).cast("long").alias("_offset"), "measurement")
        started = keep(_pose_of_points(_ready(own, known, "_pose", ("_point",))).withColumnRenamed("estimate", "pose"), "spread-started")
        rounds.append("points_pose")
        if not started.limit(1).count():  # only a new pose lets anything else start
            break
        known = keep(known.unionByName(started.join(known.select("id"), "id", "left_anti")), "spread-known")
    found = variables.join(known.select("id", F.col("pose").alias("_found")), "id", "left")
    return found.withColumn("estimate", F.coalesce("_found", "estimate")).withColumn("initialised", F.col("_found").isNotNull()).drop("_found")


def _ready(own: DataFrame, known: DataFrame, target: str, needed: tuple[str, ...]) -> DataFrame:
    """Factors whose target is open and whose needed variables are known; an offset that a factor doesn't name stands still."""
    rows = own.join(known.select(F.col("id").alias(target)), target, "left_anti").withColumn("target", F.col(target))
    for name in needed:
        side = known.select(F.col("id").alias(name), F.col("pose").alias(name[1:]))
        if name == "_offset":
            rows = rows.join(side, name, "left").where("_offset is null or offset is not null").withColumn("offset", F.coalesce("offset", _still()))
        else:
            rows = rows.join(side, name)
    return rows
