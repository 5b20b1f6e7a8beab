"""Data association: mutual nearest leaves of scan pairs, and their merging into surfels."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanweave.operators import graph, tree

MATCHES = "scan_a int, leaf_a int, scan_b int, leaf_b int"
SURFELS = "surfel_id long, scan_id int, leaf_id int"


@dataclass(frozen=True)
class Gates:
    """A pair passes when it is near (by distance or along the normal, either is enough) and its normals agree."""

    max_distance: float = 0.5
    max_normal_distance: float = 1.0
    max_angle_deg: float = 5.0


def _angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arctan2(np.linalg.norm(np.cross(a, b), axis=-1), (a * b).sum(axis=-1))


def _trees(nodes: pd.DataFrame, leaves: pd.DataFrame) -> dict[int, tuple[dict, np.ndarray, np.ndarray]]:
    out = {}
    leaf_rows = {s: g.sort_values("leaf_id") for s, g in leaves.groupby("scan_id")}
    for scan, g in nodes.groupby("scan_id"):
        g = g.sort_values("node_id")
        arrays = {"left": g["left_id"].to_numpy(), "right": g["right_id"].to_numpy(), "leaf": g["leaf_id"].to_numpy(), "mean": g[["mx", "my", "mz"]].to_numpy(), "split": g[["sx", "sy", "sz"]].to_numpy()}
        own = leaf_rows[scan]
        out[int(scan)] = arrays, own[["mx", "my", "mz"]].to_numpy(), own[["nx", "ny", "nz"]].to_numpy()
    return out


def match(nodes: DataFrame, leaves: DataFrame, gates: Gates = Gates(), block: int = 16) -> DataFrame:
    """MATCHES of all scan pairs a < b, from nodes and leaves in the world frame.

    A leaf of a descends in b's tree and the leaf it reaches descends in a's; the pair stands if that comes back. Scans are
    dealt into blocks, and a task holds the trees of two blocks, so a tree is repeated once per other block and not per scan.
    """
    n_blocks = leaves.agg(F.max("scan_id")).first()[0]
    n_blocks = 0 if n_blocks is None else n_blocks // block + 1
    own = F.floor(F.col("scan_id") / block).cast("int")
    others = F.transform(F.sequence(F.lit(0), F.lit(max(0, n_blocks - 1))), lambda o: F.struct(F.least(own, o).alias("i"), F.greatest(own, o).alias("j")))

    def dealt(df: DataFrame, kind: str) -> DataFrame:
        return df.withColumn("_pair", F.explode(others)).select("*", "_pair.i", "_pair.j").drop("_pair").withColumn("_kind", F.lit(kind))

    def run(key, node_rows: pd.DataFrame, leaf_rows: pd.DataFrame) -> pd.DataFrame:
        i, j = key
        trees, found = _trees(node_rows, leaf_rows), []
        for a in sorted(trees):
            for b in sorted(trees):
                if a >= b or sorted((a // block, b // block)) != [i, j]:
                    continue
                (tree_a, mean_a, normal_a), (tree_b, mean_b, normal_b) = trees[a], trees[b]
                there = tree.descend(tree_b, mean_a)
                back = tree.descend(tree_a, mean_b[there])
                delta = mean_a - mean_b[there]
                near = (np.linalg.norm(delta, axis=1) < gates.max_distance) | (np.abs((delta * normal_a).sum(axis=1)) < gates.max_normal_distance)
                ok = (back == np.arange(len(mean_a))) & near & (_angles(normal_a, normal_b[there]) < np.deg2rad(gates.max_angle_deg))
                at = np.flatnonzero(ok)
                found.append(pd.DataFrame({"scan_a": a, "leaf_a": at, "scan_b": b, "leaf_b": there[at]}))
        return pd.concat(found) if found else pd.DataFrame({c.split()[0]: [] for c in MATCHES.split(", ")}, dtype="int32")

    return dealt(nodes, "n").groupBy("i", "j").cogroup(dealt(leaves, "l").groupBy("i", "j")).applyInPandas(run, MATCHES)


def replay(matches: list[tuple[int, int, int, int]], mean: dict, normal: dict, gates: Gates) -> dict[tuple[int, int], int]:
    """Leaf -> surfel (numbered from 0) after merging matches in the order given.

    Two leaves without a surfel make one. A leaf without joins the other's surfel unless that one holds a leaf of its scan,
    or it is far by distance and along the normal from the surfel's average as it is now, or turned from it. Two surfels
    never merge.
    """
    surfel_of: dict[tuple[int, int], int] = {}
    sums: list[list] = []  # [sum of means, sum of normals, scans]
    for scan_a, leaf_a, scan_b, leaf_b in matches:
        a, b = (scan_a, leaf_a), (scan_b, leaf_b)
        if a in surfel_of and b in surfel_of:
            continue
        if a not in surfel_of and b not in surfel_of:
            surfel_of[a] = surfel_of[b] = len(sums)
            sums.append([mean[a] + mean[b], normal[a] + normal[b], {scan_a, scan_b}])
            continue
        new, held = (b, a) if a in surfel_of else (a, b)
        own = sums[surfel_of[held]]
        if new[0] in own[2]:
            continue
        n = len(own[2])
        m, d = own[0] / n, own[1] / max(np.linalg.norm(own[1]), 1e-12)
        delta = mean[new] - m
        if np.linalg.norm(delta) > gates.max_distance and abs(delta @ d) > gates.max_normal_distance:
            continue
        if _angles(normal[new], d) > np.deg2rad(gates.max_angle_deg):
            continue
        own[0], own[1] = own[0] + mean[new], own[1] + normal[new]
        own[2].add(new[0])
        surfel_of[new] = surfel_of[held]
    return surfel_of


def merge(matches: DataFrame, leaves: DataFrame, gates: Gates = Gates()) -> DataFrame:
    """SURFELS: which leaves make one surfel; ids are those of a surfel's first leaf.

    Merging depends on the order of matches (scan_a, scan_b, leaf_a), but only inside a connected component of the matches,
    so components are replayed on their own, one task each.
    """
    code = lambda s, l: F.shiftleft(F.col(s).cast("long"), 32) + F.col(l)
    m = matches.withColumns({"a": code("scan_a", "leaf_a"), "b": code("scan_b", "leaf_b")})
    edges = m.select(F.col("a").alias("factor_id"), F.explode(F.array("a", "b")).alias("variable_id"))
    parts = graph.connected(edges)
    rows = m.join(parts.select(F.col("variable_id").alias("a"), "component"), "a")
    world = leaves.select(code("scan_id", "leaf_id").alias("code"), F.array("mx", "my", "mz", "nx", "ny", "nz").alias("v"))
    for side in ("a", "b"):
        rows = rows.join(world.select(F.col("code").alias(side), F.col("v").alias(f"v{side}")), side)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["scan_a", "scan_b", "leaf_a"])
        mean, normal, order = {}, {}, []
        for r in frame.itertuples():
            a, b = (r.scan_a, r.leaf_a), (r.scan_b, r.leaf_b)
            mean[a], normal[a], mean[b], normal[b] = r.va[:3], r.va[3:], r.vb[:3], r.vb[3:]
            order.append((*a, *b))
        found = replay(order, mean, normal, gates)
        first: dict[int, int] = {}
        for (scan, leaf), s in sorted(found.items()):
            first.setdefault(s, (int(scan) << 32) + int(leaf))
        return pd.DataFrame([(first[s], scan, leaf) for (scan, leaf), s in found.items()], columns=["surfel_id", "scan_id", "leaf_id"])

    return rows.select("component", "scan_a", "leaf_a", "scan_b", "leaf_b", "va", "vb").groupBy("component").applyInPandas(run, SURFELS)


def correspond(pairs: DataFrame, fixed: DataFrame, moving: DataFrame, key: str) -> DataFrame:
    """(fixed_idx, moving_idx, fixed, moving): both sides of each correspondence as structs. Pairs with a negative index, which
    stands for none, and those that name an absent row are left out."""
    side = lambda df, name: df.select(F.col(key).alias(f"{name}_idx"), F.struct(*df.columns).alias(name))
    named = pairs.where("fixed_idx >= 0 and moving_idx >= 0").select("fixed_idx", "moving_idx")
    return named.join(side(fixed, "fixed"), "fixed_idx").join(side(moving, "moving"), "moving_idx")


def binary_descriptor(values: Column, word: int = 32) -> Column:
    """One bit for each number of an array, whether it is positive, in words of `word` bits; a null is no bit."""
    bits = lambda k: F.aggregate(F.slice(values, k * word + 1, F.lit(word)), F.struct(F.lit(0).cast("long").alias("bits"), F.lit(0).alias("at")), lambda s, v: F.struct(F.when(v > 0, s["bits"].bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), s["at"]))).otherwise(s["bits"]).alias("bits"), (s["at"] + 1).alias("at")), lambda s: s["bits"])
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / word).cast("int")), bits)


def hamming(a: Column, b: Column) -> Column:
    """How many bits of two binary descriptors differ."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, n: s + n)
