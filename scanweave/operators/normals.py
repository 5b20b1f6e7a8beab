"""Normals of organised clouds (keys, row, col, x, y, z) and of points along a scan line; all turned towards the sensor."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanweave.operators.rows import gathered, members

XYZ = ("x", "y", "z")
MOMENTS = ("n", *XYZ, "xx", "xy", "xz", "yy", "yz", "zz")


def spherical(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Normals from the gradient of a spherical range image: differences of range to the cell on the right and the one below.

    A cell without one of the two has no row, nor has one whose neighbour lies in the same direction.
    """
    point = F.struct(*XYZ)
    right = F.first(point).over(Window.partitionBy(*keys, "row").orderBy("col").rangeBetween(1, 1))
    down = F.first(point).over(Window.partitionBy(*keys, "col").orderBy("row").rangeBetween(1, 1))
    d = cells.withColumns({"_a": right, "_b": down}).where("_a is not null and _b is not null")
    flat = lambda p: F.sqrt(p["x"] * p["x"] + p["y"] * p["y"])
    far = lambda p: F.sqrt(p["x"] * p["x"] + p["y"] * p["y"] + p["z"] * p["z"])
    own = {c: F.col(c) for c in XYZ}
    a, b = ({c: F.col(f"{s}.{c}") for c in XYZ} for s in ("_a", "_b"))
    d = d.withColumns({"_t": F.atan2("y", "x"), "_p": F.atan2(F.col("z"), flat(own)), "_r": far(own), "_ta": F.atan2(a["y"], a["x"]), "_ra": far(a), "_pb": F.atan2(b["z"], flat(b)), "_rb": far(b)})
    d = d.where("_t != _ta and _p != _pb and _r > 0")
    d = d.withColumns({"_g": F.expr("cos(_p) / _r * (_ra - _r) / (2 * (_t - _ta))"), "_h": F.expr("(_rb - _r) / (2 * (_p - _pb)) / _r")})
    # -Rz(theta) Ry(phi) (1, g, h), normalised
    u = {"nx": "-(cos(_t) * (cos(_p) + sin(_p) * _h) - sin(_t) * _g)", "ny": "-(sin(_t) * (cos(_p) + sin(_p) * _h) + cos(_t) * _g)", "nz": "-(cos(_p) * _h - sin(_p))"}
    norm = F.expr("sqrt(1 + _g * _g + _h * _h)")
    return d.select(*keys, "row", "col", *[(F.expr(e) / norm).alias(n) for n, e in u.items()])


def moments(cells: DataFrame, keys: list[str], radius: int) -> DataFrame:
    """Sums over the (2 radius + 1)^2 window around each cell: count, coordinates, and their products; columns s_<name>.
    Images are dense: every cell has a row, and one without a point is left to the caller."""
    products = {"n": F.lit(1.0), **{c: F.col(c) for c in XYZ}, **{a + b: F.col(a) * F.col(b) for i, a in enumerate(XYZ) for b in XYZ[i:]}}
    across = Window.partitionBy(*keys, "row").orderBy("col").rangeBetween(-radius, radius)
    sums = cells.select(*keys, "row", "col", *XYZ, *[e.alias(f"_{n}") for n, e in products.items()])
    lines = sums.select(*keys, "row", "col", *[F.sum(f"_{n}").over(across).alias(f"_{n}") for n in MOMENTS])
    grid = Window.partitionBy(*keys, "col").orderBy("row").rangeBetween(-radius, radius)
    down = lines.select(*keys, "row", "col", *[F.sum(f"_{n}").over(grid).alias(f"s_{n}") for n in MOMENTS])
    return sums.select(*keys, "row", "col", *XYZ).join(down, [*keys, "row", "col"])


def _smallest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        s = {n: batch.column(batch.schema.get_field_index(f"s_{n}")).to_numpy() for n in MOMENTS}
        mean = np.stack([s[c] / s["n"] for c in XYZ], axis=-1)
        square = np.stack([np.stack([s["".join(sorted(a + b))] / s["n"] for b in XYZ], -1) for a in XYZ], -2)
        values, vectors = np.linalg.eigh(square - mean[:, :, None] * mean[:, None, :])
        normal = vectors[:, :, 0]
        point = np.stack([batch.column(batch.schema.get_field_index(c)).to_numpy() for c in XYZ], -1)
        normal = np.where((normal * point).sum(axis=1, keepdims=True) > 0, -normal, normal)
        rest = [i for i, n in enumerate(batch.schema.names) if not n.startswith("s_") and n not in XYZ]
        arrays = [batch.column(i) for i in rest] + [pa.array(normal[:, i]) for i in range(3)] + [pa.array(np.maximum(values[:, 0], 0) / np.maximum(values.sum(axis=1), 1e-300))]
        yield pa.RecordBatch.from_arrays(arrays, names=[*[batch.schema.names[i] for i in rest], "nx", "ny", "nz", "curvature"])


def sliding(cells: DataFrame, keys: list[str], radius: int = 3, least: int = 3) -> DataFrame:
    """Normals by the smallest principal direction of the window around each cell, for cells whose window lies inside the
    image and holds at least `least` points. Dense images only: every cell has a row."""
    size = cells.groupBy(*keys).agg(*[f(c).alias(f"_{n}{c}") for c in ("row", "col") for n, f in (("lo", F.min), ("hi", F.max))])
    inner = moments(cells, keys, radius).join(size, keys).where(f"row - {radius} >= _lorow and row + {radius} <= _hirow and col - {radius} >= _locol and col + {radius} <= _hicol and s_n >= {least}")
    rows = inner.select(*keys, "row", "col", *XYZ, *[f"s_{n}" for n in MOMENTS])
    kinds = dict(rows.dtypes)
    return rows.mapInArrow(_smallest, ", ".join(f"`{c}` {kinds[c]}" for c in (*keys, "row", "col")) + ", nx double, ny double, nz double, curvature double")


def line(points: DataFrame, keys: list[str], order: str, columns: tuple[str, ...] = ("x", "y"), squared_distance: float = 0.3, least: int = 5, max_curvature: float = 0.2) -> DataFrame:
    """Normals along a scan line: from the run of points around each whose squared distance to it stays below the gate.

    Runs of fewer than `least` points, and those whose smallest share of the two smaller principal spreads exceeds
    max_curvature, give no row. One scan line is one group; it is as long as one turn of a sensor.
    """

    def normals_of(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        # all runs grow by a point at a time to one side, then to the other, while their ends are near enough; sums are taken
        # about each run's own point
        n, dims = x.shape
        count, first, second = np.ones(n), np.zeros((n, dims)), np.zeros((n, dims, dims))
        for side in (-1, 1):
            at, far = np.arange(n), 1
            while len(at := at[(at + side * far >= 0) & (at + side * far < n)]):
                d = x[at + side * far] - x[at]
                near = (d * d).sum(axis=1) < squared_distance
                at, d, far = at[near], d[near], far + 1
                count[at] += 1
                first[at] += d
                second[at] += d[:, :, None] * d[:, None, :]
        mean = first / count[:, None]
        values, vectors = np.linalg.eigh(second / count[:, None, None] - mean[:, :, None] * mean[:, None, :])
        found = vectors[:, :, 0]
        keep = (count >= least) & ~(values[:, 0] > max_curvature * (values[:, 0] + values[:, 1]))
        return keep, np.where((found * x).sum(axis=1, keepdims=True) > 0, -found, found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, places, found = [], [], []
            for i, own in enumerate(members(batch, "members")):
                keep, n = normals_of(np.stack([own[c].astype(float) for c in columns], -1))
                rows.append(np.full(keep.sum(), i))
                places.append(own[order][keep])
                found.append(n[keep])
            at, n = pa.array(np.concatenate(rows)), np.concatenate(found)
            arrays = [batch.column(j).take(at) for j in range(len(keys))] + [pa.array(np.concatenate(places))] + [pa.array(n[:, j]) for j in range(len(columns))]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keys, order, *[f"n{c}" for c in columns]])

    kinds = dict(points.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in (*keys, order)) + "".join(f", n{c} double" for c in columns)
    return gathered(points, keys, [order, *columns], order=[order]).mapInArrow(run, schema)


def ring(angle: Column, start: float, stop: float, pixels: int) -> Column:
    """The pixel of an angle on a ring of `pixels` even steps from start to stop (radians); null outside."""
    sweep = stop - start
    turn = 2 * float(np.pi)
    along = F.pmod((angle - start) * (1.0 if sweep >= 0 else -1.0), F.lit(turn))
    step = abs(sweep) / pixels
    return F.when(along <= abs(sweep), F.greatest(F.lit(0.0), along / step - 0.5).cast("long"))


def uneven_ring(angle: Column, angles: list[float]) -> Column:
    """The place of the nearest of given ring angles, which rise or fall; null beyond an average step outside them. The
    earlier of two equally near ones is taken."""
    step = abs(angles[-1] - angles[0]) / max(1, len(angles) - 1)
    low, high = min(angles) - step, max(angles) + step
    best = F.array_min(F.array(*[F.struct(F.abs(angle - a).alias("d"), F.lit(i).cast("long").alias("i")) for i, a in enumerate(angles)]))
    return F.when((angle >= low) & (angle <= high), best["i"])
