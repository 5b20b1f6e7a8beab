"""Grid maps as tables (image, row, col, ...): cheapest paths, components, lines, bilinear lookups."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from math import hypot, sqrt

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanweave.operators.rows import gathered, members
from scanweave.sources.tables import keep

_STEPS = [(i, j, sqrt(i * i + j * j)) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j]


def obstacle_cost(distance: Column, radius: float, factor: float = 10.0) -> Column:
    """Cost of a cell by its distance to the nearest obstacle: 1 beyond the radius, growing with the square of closeness."""
    close = F.greatest(F.lit(0.0), 1 - distance / radius)
    return 1 + factor * close * close


def _neighbours(df: DataFrame) -> DataFrame:
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(d).alias("d")) for i, j, d in _STEPS])
    return df.withColumn("_s", F.explode(steps)).withColumns({"row": F.col("row") + F.col("_s.i"), "col": F.col("col") + F.col("_s.j"), "_d": F.col("_s.d")}).drop("_s")


def _in_tile(cells: dict, offers: list, cheaper) -> set:
    """Dijkstra inside one tile. cells maps (row, col) to [cost, distance, parent row, parent col]; offers are (distance at the
    cell before, step length, row, col, parent row, parent col). Gives the cells that improved."""
    heap, improved = [], set()

    def offer(base, step, row, col, parent):
        cell = cells.get((row, col))
        if cell is None:
            return
        found = (base + step * cell[0], *parent)
        if cell[1] is None or cheaper(found, tuple(cell[1:])):
            nearer = cell[1] is None or found[0] < cell[1]
            cell[1:] = found
            improved.add((row, col))
            if nearer:
                heapq.heappush(heap, (found[0], row, col))

    for base, step, row, col, *parent in offers:
        offer(base, step, row, col, tuple(parent))
    while heap:
        distance, row, col = heapq.heappop(heap)
        if distance == cells[row, col][1]:
            for i, j, d in _STEPS:
                offer(distance, d, row + i, col + j, (row, col))
    return improved


def _cheaper(new: tuple, old: tuple) -> bool:
    """A smaller distance; at equal ones the parent that comes first, where both have one."""
    if new[0] != old[0]:
        return new[0] < old[0]
    return old[1] is not None and new[1] is not None and new[1:] < old[1:]


def cheapest(cells: DataFrame, goals: DataFrame, tile: int = 256) -> DataFrame:
    """(image, row, col, distance, parent_row, parent_col): cheapest 8-neighbour ways to the nearest goal.

    cells has a positive `cost`; entering a cell costs it times the step's length. Each round settles whole tiles, one task
    a tile, and hands what improved at their borders to the tiles next to them; images no larger than a tile take one round.
    Only tiles that got an offer are read again. Cells that no way reaches are left out.
    """
    at = lambda c: F.floor(F.col(c) / tile)
    keys = ["image", "_tr", "_tc"]
    kind = dict(cells.dtypes)["image"]
    state = "row long, col long, cost double, distance double, parent_row long, parent_col long"
    far = F.lit(None).cast("double")
    none = F.lit(None).cast("long")
    place = lambda df: df.withColumns({"_tr": at("row"), "_tc": at("col")})
    best = keep(place(cells.select("image", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.col("cost").cast("double").alias("cost"), far.alias("distance"), none.alias("parent_row"), none.alias("parent_col"))), "grid")
    offers = place(goals.select("image", F.lit(0.0).alias("base"), F.lit(0.0).alias("step"), F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), none.alias("parent_row"), none.alias("parent_col")))
    offers = keep(offers, "grid")

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = lambda x: None if x != x else int(x)  # noqa: E731  nan stands for null
        for batch in batches:
            groups = [batch.column(i).to_pylist() for i in range(3)]
            for *key, own, given in zip(*groups, members(batch, "own"), members(batch, "given"), strict=True):
                plain = [own[n].tolist() for n in ("row", "col", "cost", "distance", "parent_row", "parent_col")]
                table = {(r, c): [cost, None if d != d else d, whole(a), whole(b)] for r, c, cost, d, a, b in zip(*plain, strict=True)}
                rows = [(base, step, r, c, whole(a), whole(b)) for base, step, r, c, a, b in zip(*(given[n].tolist() for n in ("base", "step", "row", "col", "parent_row", "parent_col")), strict=True)]
                improved = _in_tile(table, rows, _cheaper)
                columns = zip(*[(*key, r, c, *v, (r, c) in improved) for (r, c), v in table.items()], strict=True)
                kinds = [batch.schema.field(0).type, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.int64(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[*keys, "row", "col", "cost", "distance", "parent_row", "parent_col", "improved"])

    while True:
        asked = keep(offers.select(*keys).distinct(), "grid")
        active = gathered(best.join(asked, keys, "left_semi"), keys, ["row", "col", "cost", "distance", "parent_row", "parent_col"], "own")
        given = gathered(offers, keys, ["base", "step", "row", "col", "parent_row", "parent_col"], "given")
        new = keep(active.join(given, keys).mapInArrow(settle, f"image {kind}, _tr long, _tc long, {state}, improved boolean"), "grid")
        best = keep(best.join(asked, keys, "left_anti").unionByName(new.drop("improved")), "grid")
        edge = new.where(f"improved and (pmod(`row`, {tile}) in (0, {tile - 1}) or pmod(col, {tile}) in (0, {tile - 1}))")
        way = _neighbours(edge.select("image", "_tr", "_tc", "row", "col", F.col("distance").alias("base"), F.col("row").alias("parent_row"), F.col("col").alias("parent_col"))).withColumnRenamed("_d", "step")
        crossing = way.where((at("row") != F.col("_tr")) | (at("col") != F.col("_tc"))).drop("_tr", "_tc")
        better = place(crossing).join(best.select("image", "row", "col", "cost", "distance"), ["image", "row", "col"]).where("distance is null or base + step * cost < distance")
        offers = keep(better.select("image", "base", "step", "row", "col", "parent_row", "parent_col", "_tr", "_tc"), "grid")
        if not offers.limit(1).count():
            return best.where("distance is not null").select("image", "row", "col", "distance", "parent_row", "parent_col")


def astar(cells: DataFrame, starts: DataFrame, goals: DataFrame, expansions: int = 10_000) -> DataFrame:
    """(image, place, row, col, distance): the cheapest way from each image's start to its nearest goal, by A* with the
    straight distance as heuristic (costs are at least 1). Gives up, without rows, after so many expansions. One image is one
    task, and memory that of its cells."""
    kind = dict(cells.dtypes)["image"]
    marked = cells.select("image", "row", "col", "cost").join(starts.select("image", "row", "col").withColumn("_s", F.lit(True)), ["image", "row", "col"], "left").join(goals.select("image", "row", "col").withColumn("_g", F.lit(True)), ["image", "row", "col"], "left")

    def way(f: dict) -> list[tuple]:
        at = list(zip(f["row"].tolist(), f["col"].tolist(), strict=True))
        cost = dict(zip(at, f["cost"].tolist(), strict=True))
        begin, end = ({x for x, k in zip(at, f[n].tolist(), strict=True) if k} for n in ("_s", "_g"))
        near = lambda r, c: min((hypot(r - a, c - b) for a, b in end), default=0.0)
        best = {x: (0.0, None) for x in begin}
        heap = [(near(*x), 0.0, *x) for x in sorted(begin)]
        heapq.heapify(heap)
        for _ in range(expansions):
            if not heap:
                break
            _, d, r, c = heapq.heappop(heap)
            if (r, c) in end:
                steps = [(r, c)]
                while (up := best[steps[-1]][1]) is not None:
                    steps.append(up)
                return [(i, *x, best[x][0]) for i, x in enumerate(reversed(steps))]
            if d > best[r, c][0]:
                continue
            for i, j, step in _STEPS:
                to = (r + i, c + j)
                if to in cost and (found := d + step * cost[to]) < best.get(to, (float("inf"),))[0]:
                    best[to] = found, (r, c)
                    heapq.heappush(heap, (found + near(*to), found, *to))
        return []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(image, *x) for image, own in zip(batch.column(0).to_pylist(), members(batch, "members"), strict=True) for x in way(own)]
            kinds = [batch.schema.field(0).type, pa.int64(), pa.int64(), pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], k) for i, k in enumerate(kinds)], names=["image", "place", "row", "col", "distance"])

    marked = marked.select("image", "row", "col", "cost", F.col("_s").isNotNull().alias("_s"), F.col("_g").isNotNull().alias("_g"))
    return gathered(marked, ["image"], ["row", "col", "cost", "_s", "_g"]).mapInArrow(run, f"image {kind}, place long, row long, col long, distance double")


def _joined_cells(rows: list[int], cols: list[int]) -> list[int]:
    """The smallest code row * 2^32 + col reachable from each cell within the list, by union-find."""
    at = {x: i for i, x in enumerate(zip(rows, cols, strict=True))}
    order = sorted(range(len(rows)), key=lambda i: (rows[i], cols[i]))
    parent = list(range(len(rows)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    place = {i: k for k, i in enumerate(order)}
    for i in order:
        for x in ((rows[i] - 1, cols[i] - 1), (rows[i] - 1, cols[i]), (rows[i] - 1, cols[i] + 1), (rows[i], cols[i] - 1)):
            if x in at:
                a, b = sorted((find(i), find(at[x])), key=place.get)
                parent[b] = a
    return [(rows[r] << 32) + cols[r] for r in map(find, range(len(rows)))]


def components(cells: DataFrame, tile: int = 256) -> DataFrame:
    """(image, row, col, component) of occupied cells joined by 8-neighbourhood; the smallest code row * 2^32 + col names it.

    Tiles are labelled by union-find, one task a tile. Labels that touch across a border make a small graph, whose labels
    spread with pointer jumping until none changes; images no larger than a tile need none of that.
    """
    kind = dict(cells.dtypes)["image"]
    at = lambda c: F.floor(F.col(c) / tile)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for image, own in zip(batch.column(0).to_pylist(), members(batch, "members"), strict=True):
                rows, cols = own["row"].tolist(), own["col"].tolist()
                arrays = [pa.array([image] * len(rows), batch.schema.field(0).type), pa.array(rows, pa.int64()), pa.array(cols, pa.int64()), pa.array(_joined_cells(rows, cols), pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, names=["image", "row", "col", "component"])

    whole = cells.select("image", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col")).distinct()
    local = gathered(whole.withColumns({"_tr": at("row"), "_tc": at("col")}), ["image", "_tr", "_tc"], ["row", "col"]).mapInArrow(label, f"image {kind}, row long, col long, component long")
    local = keep(local, "grid")
    edge = local.where(f"pmod(`row`, {tile}) in (0, {tile - 1}) or pmod(col, {tile}) in (0, {tile - 1})")
    own = edge.select("image", "row", "col", at("row").alias("_tr"), at("col").alias("_tc"), F.col("component").alias("a"))
    near = _neighbours(own).where((at("row") != F.col("_tr")) | (at("col") != F.col("_tc")))
    links = keep(near.join(edge.select("image", "row", "col", F.col("component").alias("b")), ["image", "row", "col"]).where("a != b").select("image", "a", "b").distinct(), "grid")
    if not links.limit(1).count():
        return local
    labels = keep(links.select("image", F.col("a").alias("node")).distinct().withColumn("label", F.col("node")), "grid")
    while True:
        offer = links.join(labels.select("image", F.col("node").alias("b"), "label"), ["image", "b"]).groupBy("image", F.col("a").alias("node")).agg(F.min("label").alias("_low"))
        spread = labels.join(offer, ["image", "node"]).select("image", "node", F.col("label").alias("_was"), F.least("label", "_low").alias("label"))
        jump = labels.select("image", F.col("node").alias("label"), F.col("label").alias("_next"))
        new = keep(spread.join(jump, ["image", "label"], "left").select("image", "node", "_was", F.least("label", F.coalesce("_next", "label")).alias("label")), "grid")
        labels = new.select("image", "node", "label")
        if not new.where("_was != label").limit(1).count():
            break
    return local.join(labels.withColumnRenamed("node", "component"), ["image", "component"], "left").select("image", "row", "col", F.coalesce("label", "component").alias("component"))


def cluster_statistics(labelled: DataFrame) -> DataFrame:
    """Count, bounding box and centroid of each component."""
    return labelled.groupBy("image", "component").agg(F.count("*").alias("n_cells"), *[f(c).alias(f"{n}_{c}") for c in ("row", "col") for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg))])


def line_cells(lines: DataFrame) -> DataFrame:
    """The cells of segments (line_id, r0, c0, r1, c1): one per step along the longer side, rounded half up."""
    n = F.greatest(F.abs(F.col("r1") - F.col("r0")), F.abs(F.col("c1") - F.col("c0")))
    steps = lines.withColumn("_n", n).withColumn("k", F.explode(F.sequence(F.lit(0), n.cast("int"))))
    at = lambda a, b: F.when(F.col("_n") == 0, F.col(a)).otherwise(F.floor(F.col(a) + F.col("k") * (F.col(b) - F.col(a)) / F.col("_n") + 0.5)).cast("int")
    return steps.select("line_id", "k", at("r0", "r1").alias("row"), at("c0", "c1").alias("col"))


def bilinear(cells: DataFrame, queries: DataFrame, value: str) -> DataFrame:
    """queries (query_id, image, r, c) with the value between the four cells around; null outside or on the last row or column."""
    corners = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)])
    q = queries.withColumn("_k", F.explode(corners))
    q = q.select("query_id", "image", (F.floor("r") + F.col("_k.i")).alias("row"), (F.floor("c") + F.col("_k.j")).alias("col"), (F.abs(1 - F.col("_k.i") - (F.col("r") - F.floor("r"))) * F.abs(1 - F.col("_k.j") - (F.col("c") - F.floor("c")))).alias("_w"))
    found = q.join(cells.select("image", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), value), ["image", "row", "col"], "left")
    return found.groupBy("query_id").agg(F.when(F.count(value) == 4, F.sum(F.col("_w") * F.col(value))).alias(value))


def extremes(cells: DataFrame, value: str, keys: list[str] = ("image",)) -> DataFrame:
    """Where each image is largest and smallest; among equals the first cell in row-major order."""
    place = F.struct("row", "col")
    return cells.groupBy(*keys).agg(F.max(value).alias("largest"), F.min_by(place, F.struct(-F.col(value), place)).alias("largest_at"), F.min(value).alias("smallest"), F.min_by(place, F.struct(F.col(value), place)).alias("smallest_at"))


def validate_closures(checks: DataFrame, min_checks: int = 5, accept: float = 0.5, reject: float = 0.3, inlier_chi: float = 0.05) -> DataFrame:
    """(closure_id, n_checks, n_good, status) from (closure_id, chi), one row per check of a closure in its cluster.

    accepted when more than `accept` of the checks are inliers, rejected when fewer than `reject` are, after min_checks.
    """
    votes = checks.groupBy("closure_id").agg(F.count("*").alias("n_checks"), F.count(F.when(F.col("chi") < inlier_chi, 1)).alias("n_good"))
    share = F.col("n_good") / F.col("n_checks")
    enough = F.col("n_checks") >= min_checks
    return votes.withColumn("status", F.when(enough & (share > accept), "accepted").when(enough & (share < reject), "rejected").otherwise("open"))


def cluster_closures(closures: DataFrame, parts: DataFrame) -> DataFrame:
    """The clusters of closures that touch the same parts: (parts, n_closures, first_closure). closures (closure_id, a, b), parts
    (variable_id, part)."""
    ends = closures.select("closure_id", F.explode(F.array("a", "b")).alias("variable_id")).join(parts, "variable_id")
    sets = ends.groupBy("closure_id").agg(F.array_sort(F.collect_set("part")).alias("parts"))
    return sets.groupBy("parts").agg(F.count("*").alias("n_closures"), F.min("closure_id").alias("first_closure"))
