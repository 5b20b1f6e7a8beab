"""Surfel trees: each scan is split at its mean along its widest direction until the pieces are flat or small.

A task builds the tree of a scan, or of a node of few enough points. Above such nodes a scan is split level by level: tasks sum
what a split needs over all points, and only these sums, a few numbers a node, come to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanweave.sources.tables import keep

LEAVES = "scan_id int, leaf_id int, n_points int, mx double, my double, mz double, nx double, ny double, nz double, b0 double, b1 double, b2 double"
NODES = "scan_id int, node_id int, left_id int, right_id int, leaf_id int, mx double, my double, mz double, sx double, sy double, sz double"
#: NODES, and behind them what LEAVES has of a leaf (null for inner nodes).
TREES = NODES + ", n_points int, px double, py double, pz double, nx double, ny double, nz double, b0 double, b1 double, b2 double"
#: Most points that one task takes up whole; points that a pass over larger nodes looks at together.
TASK_POINTS, PASS_POINTS = 200_000, 50_000


def _turned(axes: np.ndarray, mean: np.ndarray) -> np.ndarray:
    return -axes if axes[:, 0] @ mean > 0 else axes


def _frame(points: np.ndarray, mean: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Axes (columns, narrowest first, the first turned towards the sensor) and extents of the box around the mean."""
    if len(points) < 2:
        return np.eye(3), np.zeros(3)
    centred = points - mean
    axes = _turned(np.linalg.eigh(centred.T @ centred / (len(points) - 1))[1], mean)
    local = centred @ axes
    return axes, np.maximum(local.max(axis=0), 0) - np.minimum(local.min(axis=0), 0)


def build(points: np.ndarray, leaf_size: float = 0.2, flatness: float = 0.1, plane: np.ndarray | None = None, sound: np.ndarray | None = None) -> tuple[list[dict], list[dict]]:
    """(nodes, leaves) of one scan's points, leaves numbered from left to right.

    A piece is a leaf when its widest extent is under leaf_size. On each path the first node that is flat (narrowest extent
    under `flatness`) gives its normal to all leaves below; otherwise a leaf of under 3 points has the normal of the
    nearest node above that has 3. A leaf's position is its point nearest to the mean. No recursion: depth is unbounded.
    plane and sound are what nodes above these points have found.
    """
    nodes: list[dict] = []
    leaves: list[dict] = []
    stack = [(points, -1, False, plane, sound)]  # points, parent, is right child, plane's normal, last normal of 3 points
    while stack:
        own, parent, right, plane, sound = stack.pop()
        mean = own.mean(axis=0)
        axes, box = _frame(own, mean)
        if plane is None and len(own) > 2 and box[0] < flatness:
            plane = axes[:, 0]
        sound = axes[:, 0] if len(own) > 2 else sound
        me = len(nodes)
        nodes.append({"left": -1, "right": -1, "leaf": -1, "mean": mean, "split": axes[:, 2]})
        if parent >= 0:
            nodes[parent]["right" if right else "left"] = me
        side = (own - mean) @ axes[:, 2] < 0
        if box[2] < leaf_size or not side.any() or side.all():
            normal = plane if plane is not None else sound if sound is not None else axes[:, 0]
            nearest = own[((own - mean) ** 2).sum(axis=1).argmin()]
            nodes[me]["leaf"] = len(leaves)
            leaves.append({"n": len(own), "mean": nearest, "normal": normal, "box": box})
        else:
            stack.append((own[~side], me, True, plane, sound))
            stack.append((own[side], me, False, plane, sound))
    return nodes, leaves


@dataclass
class Top:
    """A node above those that tasks take up whole, or one of these (`small`)."""

    scan: int
    n: int
    mean: np.ndarray
    axes: np.ndarray
    plane: np.ndarray | None = None
    sound: np.ndarray | None = None
    small: bool = False
    left: int = -1
    right: int = -1
    leaf: dict | None = None


def _local(offset: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Each row's offset along its own axes (rows, 3, k). Written out, so that a row has the same value in every pass."""
    return offset[:, :1] * axes[:, 0] + offset[:, 1:2] * axes[:, 1] + offset[:, 2:] * axes[:, 2]


class _Forest:
    """The nodes so far as arrays, for tasks."""

    def __init__(self, tops: list[Top], roots: dict[int, int]):
        self.scans = np.array(sorted(roots))
        self.roots = np.array([roots[s] for s in self.scans])
        self.left, self.right = (np.array([getattr(t, side) for t in tops]) for side in ("left", "right"))
        self.mean, self.axes = np.array([t.mean for t in tops]), np.array([t.axes for t in tops])

    def find(self, scan: np.ndarray, xyz: np.ndarray) -> np.ndarray:
        """The lowest node of each point; -1 for points of scans that one task takes up."""
        k = np.minimum(np.searchsorted(self.scans, scan), len(self.scans) - 1)
        at = np.where(self.scans[k] == scan, self.roots[k], -1)
        i = np.flatnonzero(at >= 0)
        while len(i := i[self.left[at[i]] >= 0]):
            n = at[i]
            low = _local(xyz[i] - self.mean[n], self.axes[n][:, :, 2:])[:, 0] < 0
            at[i] = np.where(low, self.left[n], self.right[n])
        return at


def _arrays(batches: Iterator[pa.RecordBatch], at_once: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(scan_id, point_id, xyz) of some batches at once."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= at_once:
            yield _numbers(held)
            held = []
    if held:
        yield _numbers(held)


def _numbers(held: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    t = pa.Table.from_batches(held)
    return t["scan_id"].to_numpy(), t["point_id"].to_numpy(), np.column_stack([t[c].to_numpy() for c in "xyz"])


_SUMS = ["n", "x", "y", "z", "xx", "xy", "xz", "yy", "yz", "zz"]
_ENDS = [f"{e}{i}" for e in ("low", "high") for i in range(3)]
_PARTS = ", ".join(f"{c} double" for c in [*(f"{side}_{c}" for side in ("right", "left") for c in _SUMS), *_ENDS])


def _pass(forest: _Forest, active: list[int], points: DataFrame) -> list:
    """Of each active node: the sums of both sides about its mean, the ends of its box, and the point nearest to its mean."""
    place = np.full(len(forest.left), -1)
    place[active] = np.arange(len(active))
    kind = points.schema["point_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, ends = np.zeros((len(active) * 2, len(_SUMS))), np.zeros((len(active), 6))
        near: dict[int, tuple] = {}
        for scan, point, xyz in _arrays(batches, PASS_POINTS):
            at = forest.find(scan, xyz)
            own = np.where(at >= 0, place[at], -1)
            if not (used := own >= 0).any():
                continue
            order = np.flatnonzero(used)
            d = xyz[order] - forest.mean[at[order]]
            local = _local(d, forest.axes[at[order]])
            key = own[order] * 2 + (local[:, 2] < 0)
            by = np.argsort(key, kind="stable")
            order, d, local, key = order[by], d[by], local[by], key[by]
            first = np.flatnonzero(np.diff(key, prepend=-1))
            terms = np.column_stack([np.ones(len(d)), d, d[:, :1] * d, d[:, 1:2] * d[:, 1:], d[:, 2] * d[:, 2]])
            sums[key[first]] += np.add.reduceat(terms, first)
            node = key // 2
            first = np.flatnonzero(np.diff(node, prepend=-1))
            ends[node[first], :3] = np.minimum(ends[node[first], :3], np.minimum.reduceat(local, first))
            ends[node[first], 3:] = np.maximum(ends[node[first], 3:], np.maximum.reduceat(local, first))
            squared = (d * d).sum(axis=1)
            least = np.repeat(np.minimum.reduceat(squared, first), np.diff(first, append=len(node)))
            for k in np.flatnonzero(squared == least):
                i, found = order[k], (squared[k], point[order[k]])
                if node[k] not in near or found < near[node[k]][:2]:
                    near[node[k]] = (*found, *xyz[i])
        rows = sorted(near)
        if rows:
            numbers = np.column_stack([sums[0::2][rows], sums[1::2][rows], ends[rows]])
            nearest = [pa.array([near[k][i] for k in rows]) for i in range(5)]
            yield pa.RecordBatch.from_arrays([pa.array(np.array(active)[rows]), *[pa.array(c) for c in numbers.T], *nearest], names=["node", *[c.split()[0] for c in _PARTS.split(", ")], "d", "point_id", *"xyz"])

    parts = points.mapInArrow(run, f"node long, {_PARTS}, d double, point_id {kind}, x double, y double, z double")
    total = [F.sum(c).alias(c) for side in ("right", "left") for n in _SUMS if (c := f"{side}_{n}")]
    ends = [(F.min if c[0] == "l" else F.max)(c).alias(c) for c in _ENDS]
    return parts.groupBy("node").agg(*total, *ends, F.min(F.struct("d", "point_id", *"xyz")).alias("near")).collect()


def _child(top: Top, row, side: str, plane: np.ndarray | None, task_points: int) -> Top:
    n, *s = (row[f"{side}_{c}"] for c in _SUMS)
    s, n = np.array(s), int(n)
    mean = top.mean + s[:3] / n
    if n <= task_points:
        return Top(top.scan, n, mean, np.eye(3), plane, top.axes[:, 0], small=True)
    squares = s[3:][[[0, 1, 2], [1, 3, 4], [2, 4, 5]]]
    own = squares - np.outer(s[:3], s[:3]) / n
    own[np.abs(own) < 1e-14 * np.trace(squares)] = 0  # what the difference leaves of points that are all one
    return Top(top.scan, n, mean, _turned(np.linalg.eigh(own / (n - 1))[1], mean), plane, top.axes[:, 0])


def _tops(points: DataFrame, leaf_size: float, flatness: float, task_points: int) -> tuple[list[Top], dict[int, int]]:
    """The upper nodes of scans of more than task_points points, and where each such scan's root is; a pass for each level."""
    x, y, z = (F.col(c) for c in "xyz")
    spread = [F.covar_samp(a, b) for a, b in ((x, x), (x, y), (x, z), (y, y), (y, z), (z, z))]
    found = points.groupBy("scan_id").agg(F.count("*").alias("n"), F.array(F.avg(x), F.avg(y), F.avg(z)).alias("mean"), F.array(*spread).alias("spread"))
    tops, roots = [], {}
    for r in found.where(F.col("n") > task_points).collect():
        mean, spread = np.array(r["mean"]), np.array(r["spread"])
        roots[r["scan_id"]] = len(tops)
        tops.append(Top(r["scan_id"], r["n"], mean, _turned(np.linalg.eigh(spread[[[0, 1, 2], [1, 3, 4], [2, 4, 5]]])[1], mean)))
    active = list(range(len(tops)))
    while active:
        rows, active = _pass(_Forest(tops, roots), active, points), []
        for row in sorted(rows, key=lambda r: r["node"]):
            top, low, high = tops[row["node"]], np.array([row[c] for c in _ENDS[:3]]), np.array([row[c] for c in _ENDS[3:]])
            box = high - low
            plane = top.axes[:, 0] if top.plane is None and box[0] < flatness else top.plane
            if box[2] < leaf_size or not row["left_n"] or not row["right_n"]:
                near = row["near"]
                top.leaf = {"n": top.n, "mean": np.array([near[c] for c in "xyz"]), "normal": top.axes[:, 0] if plane is None else plane, "box": box}
                continue
            for side in ("left", "right"):
                setattr(top, side, len(tops))
                tops.append(_child(top, row, side, plane, task_points))
                if not tops[-1].small:
                    active.append(len(tops) - 1)
    return tops, roots


def _row(scan: int, node: tuple, mean: np.ndarray, split: np.ndarray, leaf: dict | None) -> tuple:
    """A row of TREES; node: its id, those of its sides and of its leaf."""
    own = (leaf["n"], *leaf["mean"], *leaf["normal"], *leaf["box"]) if leaf else (None,) * 10
    return (scan, *node, *map(float, mean), *map(float, split), *(v if v is None or isinstance(v, int) else float(v) for v in own))


def trees(points: DataFrame, leaf_size: float = 0.2, flatness: float = 0.1, task_points: int = TASK_POINTS) -> DataFrame:
    """TREES of points (scan_id, point_id, x, y, z), nodes numbered in preorder and leaves from left to right.

    Scans of more than task_points points, and their nodes, are split by passes over the points until each node has no more;
    for this the points are written once, and read once for each level of such nodes.
    """
    task_points = max(task_points, 3)
    points = points.select("scan_id", "point_id", *[F.col(c).cast("double").alias(c) for c in "xyz"])
    tops: list[Top] = []
    if points.groupBy("scan_id").count().where(F.col("count") > task_points).limit(1).count():
        points = keep(points, "scan-points").where(" and ".join(f"{c} - {c} = 0" for c in "xyz"))
        tops, roots = _tops(points, leaf_size, flatness, task_points)
    above = {i: (t.plane, t.sound) for i, t in enumerate(tops) if t.small}

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        scan, top = int(frame["scan_id"].iloc[0]), int(frame["top"].iloc[0])
        xyz = frame.sort_values("point_id", kind="stable")[["x", "y", "z"]].to_numpy(float)
        xyz = xyz[np.isfinite(xyz).all(axis=1)]
        found, flat = build(xyz, leaf_size, flatness, *above.get(top, (None, None))) if len(xyz) else ([], [])
        rows = [(top, *_row(scan, (i, x["left"], x["right"], x["leaf"]), x["mean"], x["split"], flat[x["leaf"]] if x["leaf"] >= 0 else None)) for i, x in enumerate(found)]
        out = pd.DataFrame(rows, columns=["top", *[c.split()[0] for c in TREES.split(", ")]])
        return out.astype({"n_points": "Int32"})

    if not tops:
        return points.withColumn("top", F.lit(-1)).groupBy("scan_id", "top").applyInPandas(run, f"top int, {TREES}").drop("top")
    forest = _Forest(tops, roots)
    leaf = np.array([t.leaf is not None for t in tops])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scan, _, xyz = _numbers([batch])
            top = forest.find(scan, xyz)
            yield batch.append_column("top", pa.array(top.astype("int32"))).filter(pa.array((top < 0) | ~leaf[top]))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in points.schema.fields)
    parts = keep(points.mapInArrow(deal, f"{schema}, top int").groupBy("scan_id", "top").applyInPandas(run, f"top int, {TREES}"), "subtrees")
    sizes = {r["top"]: (r["nodes"], r["leaves"]) for r in parts.where("top >= 0").groupBy("top").agg(F.count("*").alias("nodes"), F.count_if(F.col("leaf_id") >= 0).alias("leaves")).collect()}
    return _numbered(parts, tops, roots, sizes)


def _numbered(parts: DataFrame, tops: list[Top], roots: dict[int, int], sizes: dict[int, tuple[int, int]]) -> DataFrame:
    """Tops and the trees below them under the numbers of whole scans."""
    ids, starts = {}, {}
    for root in roots.values():
        stack, node, leaf = [root], 0, 0
        while stack:
            i = stack.pop()
            ids[i], starts[i] = node, leaf
            if tops[i].small:
                node, leaf = node + sizes[i][0], leaf + sizes[i][1]
                continue
            node += 1
            leaf += tops[i].leaf is not None
            if tops[i].left >= 0:
                stack += [tops[i].right, tops[i].left]
    spark = parts.sparkSession
    rows = [_row(t.scan, (ids[i], ids.get(t.left, -1), ids.get(t.right, -1), starts[i] if t.leaf else -1), t.mean, t.axes[:, 2], t.leaf) for i, t in enumerate(tops) if not t.small]
    shifts = spark.createDataFrame([(i, ids[i], starts[i]) for i, t in enumerate(tops) if t.small] or [(-2, 0, 0)], "top int, _node int, _leaf int")
    moved = lambda c, by: F.when(F.col(c) < 0, F.col(c)).otherwise(F.col(c) + F.coalesce(by, F.lit(0))).alias(c)
    below = parts.join(F.broadcast(shifts), "top", "left")
    by = {"node_id": "_node", "left_id": "_node", "right_id": "_node", "leaf_id": "_leaf"}
    names = [c.split()[0] for c in TREES.split(", ")]
    return below.select(*[moved(c, F.col(by[c])) if c in by else F.col(c) for c in names]).unionByName(spark.createDataFrame(rows, TREES))


def leaves_of(found: DataFrame) -> DataFrame:
    """LEAVES of TREES."""
    return found.where("leaf_id >= 0").select("scan_id", "leaf_id", "n_points", *[F.col(f"p{c}").alias(f"m{c}") for c in "xyz"], "nx", "ny", "nz", "b0", "b1", "b2")


def nodes_of(found: DataFrame) -> DataFrame:
    """NODES of TREES."""
    return found.select(*[c.split()[0] for c in NODES.split(", ")])


def leaves(points: DataFrame, leaf_size: float = 0.2, flatness: float = 0.1, task_points: int = TASK_POINTS) -> DataFrame:
    """LEAVES of points (scan_id, point_id, x, y, z)."""
    return leaves_of(trees(points, leaf_size, flatness, task_points))


def nodes(points: DataFrame, leaf_size: float = 0.2, flatness: float = 0.1, task_points: int = TASK_POINTS) -> DataFrame:
    """NODES of points: what a descent needs. leaf_id is -1 for inner nodes; (sx, sy, sz) is the split's direction."""
    return nodes_of(trees(points, leaf_size, flatness, task_points))


def descend(tree: dict[str, np.ndarray], queries: np.ndarray) -> np.ndarray:
    """The leaf that each query falls into, all queries one level at a time. tree: arrays left, right, leaf, mean, split."""
    at = np.zeros(len(queries), int)
    while (inner := tree["leaf"][at] < 0).any():
        i = np.flatnonzero(inner)
        n = at[i]
        left = ((queries[i] - tree["mean"][n]) * tree["split"][n]).sum(axis=1) < 0
        at[i] = np.where(left, tree["left"][n], tree["right"][n])
    return tree["leaf"][at]


def transform(leaves_or_nodes: pd.DataFrame, pose: np.ndarray, normals: tuple[str, ...]) -> pd.DataFrame:
    """Positions and directions of one scan in the world."""
    out = leaves_or_nodes.copy()
    out[["mx", "my", "mz"]] = out[["mx", "my", "mz"]].to_numpy() @ pose[:3, :3].T + pose[:3, 3]
    out[list(normals)] = out[list(normals)].to_numpy() @ pose[:3, :3].T
    return out

