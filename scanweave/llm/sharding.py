"""Sharding by a k-d tree over metadata (operator 13).

The space of a few metadata dimensions is cut again and again: each node of the tree that shall become k shards is cut along
its widest dimension where k // 2 of its k shares of bytes lie below, so that leaves reach the target bytes. Where many rows
have the same value there, the cut goes on through a hash of the text, which keeps copies side by side, then through a hash of
doc_id, and last through a number drawn for each row; so no value, group of copies or repeated row is too large to be cut.

The weighted medians of all nodes of one level are found together by distributed histograms: each pass over a small table (no
texts) sums bytes in BINS bins of each node's range, and the bin that holds the median becomes the next range, until it holds
one value or less than a thousandth of a shard. The driver gets at most BINS rows for each node that is open at that level.

Balance: a cut is off by at most one row, or by a thousandth of a shard; a row larger than a shard's share makes its shard
larger.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from scanweave.llm._scratch import keep

#: Bins of a histogram, and bytes of one file of a shard (uncompressed, about).
BINS, FILE_BYTES = 512, 256 << 20
#: Shards at most for which every node of a level is open on the driver.
MOST_SHARDS = 4096
#: Rows of a table of offsets that may be broadcast.
BROADCAST_FILES = 1_000_000


@dataclass
class Node:
    """Rows between low (included) and high (left out); bounds are the values of `keys`: one dimension, then the ties."""

    shards: int
    first: int
    bytes: int
    dim: int = -1
    cut: tuple = ()
    left: int = -1
    right: int = -1


@dataclass
class Tree:
    """dims: names of the dimensions. nodes[0] is the root; a node without children is the shard `first`."""

    dims: list[str]
    nodes: list[Node] = field(default_factory=list)


def _text_key(name: str, low: str, high: str) -> tuple[Column, float, float]:
    """Six bytes of a text behind what all texts share, as a number that keeps their order, and its least and largest value."""
    a, b = low.encode(), high.encode()
    same = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    number = lambda x: float(int.from_bytes(x[same : same + 6].ljust(6, b"\0"), "big"))
    return F.expr(f"cast(conv(rpad(hex(substring(cast(`{name}` as binary), {same + 1}, 6)), 12, '0'), 16, 10) as double)"), number(a), number(b)


def dimensions(docs: DataFrame, names: list[str]) -> list[tuple[str, Column]]:
    """The named columns as numbers between 0 and 1 in their order; null, NaN and infinite values are lowest. Columns without
    two values are left out."""
    kinds = {f.name: f.dataType.typeName() for f in docs.schema}
    numeric = {n for n in names if kinds[n] not in ("string", "binary", "char", "varchar")}
    value = {n: F.expr(f"nullif(nullif(nullif(cast(`{n}` as double), double('NaN')), double('Infinity')), double('-Infinity'))") if n in numeric else F.col(f"`{n}`").cast("string") for n in names}
    if not names:
        return []
    spread = docs.agg(*[f(value[n]).alias(f"{k}{i}") for i, n in enumerate(names) for k, f in (("low", F.min), ("high", F.max))]).first()
    out = []
    for i, n in enumerate(names):
        low, high = spread[f"low{i}"], spread[f"high{i}"]
        if low is None or low == high:
            continue
        key = value[n]
        if n not in numeric:
            key, low, high = _text_key(n, low, high)
            if low == high:
                continue
        scaled = (key / 2 - low / 2) / (high / 2 - low / 2)
        out.append((n, F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), scaled)), F.lit(0.0))))
    return out


def _keyed(docs: DataFrame, dims: list[tuple[str, Column]]) -> list[Column]:
    """What a row is placed by: its dimensions, hashes of text and doc_id, and a number of its own, all in doubles. 53 bits
    of each hash: two texts of one number only lie side by side, and are cut by the next."""
    unit = lambda h: (F.shiftrightunsigned(h, 11)).cast("double") / float(1 << 53)
    return [c for _, c in dims] + [unit(F.xxhash64("text")), unit(F.xxhash64("doc_id", F.lit(13))), F.rand(13)]


def _descend(keys: np.ndarray, nodes: list[Node], n_dims: int) -> np.ndarray:
    """Number of the node that each row has come to so far."""
    at = np.zeros(len(keys), np.int64)
    for i, node in enumerate(nodes):  # parents come before children
        if node.left < 0:
            continue
        here = np.flatnonzero(at == i)
        at[here] = np.where(_below(keys[here][:, [node.dim, *range(n_dims, n_dims + 3)]], node.cut), node.left, node.right)
    return at


def _below(keys: np.ndarray, cut: tuple) -> np.ndarray:
    out, same = np.zeros(len(keys), bool), np.ones(len(keys), bool)
    for i, v in enumerate(cut):
        out |= same & (keys[:, i] < v)
        same &= keys[:, i] == v
    return out


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)


def _ranges(nodes: list[Node], n_dims: int, open_nodes: list[int]):
    """Least and largest value of each dimension, and the bytes, for each open node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, keys = batch.column(0).to_numpy(), _matrix(batch)
            at = _descend(keys, nodes, n_dims)
            out = []
            for i in open_nodes:
                own = at == i
                if own.any():
                    out += [(i, d, float(keys[own, d].min()), float(keys[own, d].max()), int(size[own].sum())) for d in range(max(1, n_dims))]
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64()))], names=["node", "dim", "low", "high", "bytes"])

    return run


@dataclass
class Search:
    """A node's median so far: values of the leading keys that are settled, and the range of the next one."""

    node: int
    dim: int
    wanted: int
    below: int = 0
    fixed: tuple = ()
    low: float = 0.0
    high: float = 1.0


def _histograms(nodes: list[Node], n_dims: int, searches: list[Search]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, keys = batch.column(0).to_numpy(), _matrix(batch)
            at = _descend(keys, nodes, n_dims)
            out = []
            for s in searches:
                order = [s.dim, *range(n_dims, n_dims + 3)]
                own = np.flatnonzero(at == s.node)
                for d, v in zip(order, s.fixed, strict=False):
                    own = own[keys[own, d] == v]
                value = keys[own, order[len(s.fixed)]]
                inside = (value >= s.low) & (value <= s.high)
                own, value = own[inside], value[inside]
                if not len(own):
                    continue
                bins = np.minimum(((value - s.low) / (s.high - s.low) * BINS).astype(np.int64), BINS - 1) if s.high > s.low else np.zeros(len(own), np.int64)
                by = np.argsort(bins, kind="stable")
                edges = np.flatnonzero(np.diff(bins[by], prepend=-1))
                out.append((np.full(len(edges), s.node), bins[by][edges], np.minimum.reduceat(value[by], edges), np.maximum.reduceat(value[by], edges), np.add.reduceat(size[own][by], edges)))
            columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0), np.zeros(0, np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["node", "bin", "low", "high", "bytes"])

    return run


def fit(rows: DataFrame, dims: list[str], shards: int) -> Tree:
    """The tree of rows (size long, keys array<double>: dimensions in the order of dims, then three ties)."""
    if not 1 <= shards <= MOST_SHARDS:
        raise ValueError(f"shards must be 1 to {MOST_SHARDS}; cut a shard again for more")
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    tree, n_dims = Tree(dims, [Node(shards, 0, total)]), len(dims)
    small = max(1, total // shards // 1000)
    level = [0] if shards > 1 and total else []
    while level:
        found = rows.mapInArrow(_ranges(tree.nodes, n_dims, level), "node long, dim long, low double, high double, bytes long")
        found = found.groupBy("node", "dim").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("bytes").alias("bytes")).collect()
        searches = []
        for i in level:
            own = [r for r in found if r["node"] == i]
            if not own:
                continue  # no rows: all its shards but the first stay empty
            node = tree.nodes[i]
            node.bytes = own[0]["bytes"]
            widest = max(own, key=lambda r: (r["high"] - r["low"], -r["dim"]))
            node.dim = widest["dim"] if n_dims else 0
            searches.append(Search(i, node.dim, node.bytes * (node.shards // 2) // node.shards, low=widest["low"], high=widest["high"]))
        level = []
        while searches:
            bins = rows.mapInArrow(_histograms(tree.nodes, n_dims, searches), "node long, bin long, low double, high double, bytes long")
            bins = bins.groupBy("node", "bin").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("bytes").alias("bytes")).collect()
            rest = []
            for s in searches:
                own = sorted((r for r in bins if r["node"] == s.node), key=lambda r: r["bin"])
                below = s.below
                for r in own:
                    if below + r["bytes"] >= s.wanted:
                        break
                    below += r["bytes"]
                keys_left = 3 - len(s.fixed)
                if r["bytes"] <= small or r["low"] == r["high"] and not keys_left:  # all of it to the nearer side
                    after = below + r["bytes"] - s.wanted < s.wanted - below
                    _split(tree, s, (*s.fixed, np.nextafter(r["high"], np.inf) if after else r["low"]), level)
                elif r["low"] == r["high"]:
                    rest.append(Search(s.node, s.dim, s.wanted, below, (*s.fixed, r["low"])))
                else:
                    rest.append(Search(s.node, s.dim, s.wanted, below, s.fixed, r["low"], r["high"]))
            searches = rest
    return tree


def _split(tree: Tree, s: Search, cut: tuple, level: list[int]) -> None:
    node = tree.nodes[s.node]
    node.cut, half = cut, node.shards // 2
    node.left, node.right = len(tree.nodes), len(tree.nodes) + 1
    tree.nodes += [Node(half, node.first, 0), Node(node.shards - half, node.first + half, 0)]
    level += [i for i in (node.left, node.right) if tree.nodes[i].shards > 1]


def placed(tree: Tree, keys: Column) -> Column:
    """The shard of a row with these keys, by walking the tree inside the JVM."""
    n, nodes = len(tree.dims), tree.nodes
    array = lambda kind, values: F.expr(f"array({', '.join(f'{kind}({v!r})' if kind == 'double' else f'{v}' for v in values)})")
    dim, left, right = (array("int", [getattr(x, a) for x in nodes]) for a in ("dim", "left", "right"))
    cuts = [array("double", [float(x.cut[k]) if len(x.cut) > k else -1.0 for x in nodes]) for k in range(4)]
    depth, at, todo = 0, {0: 0}, [0]
    for i in todo:
        depth = max(depth, at[i])
        if nodes[i].left >= 0:
            at[nodes[i].left] = at[nodes[i].right] = at[i] + 1
            todo += [nodes[i].left, nodes[i].right]

    def step(here: Column, _: Column) -> Column:
        get = lambda a, k: F.element_at(a, k + 1)
        below: Column = F.lit(False)
        for k in range(3, -1, -1):
            v = get(keys, F.greatest(F.lit(0), get(dim, here))) if k == 0 else F.element_at(keys, n + k)
            below = (v < get(cuts[k], here)) | ((v == get(cuts[k], here)) & below)
        return F.when(get(left, here) < 0, here).otherwise(F.when(below, get(left, here)).otherwise(get(right, here)))

    node = F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(0), step) if depth else F.lit(0)
    return F.element_at(array("int", [x.first for x in nodes]), node + 1)


def write_shards(docs: DataFrame, folder: str, shards: int = 40, dims: tuple[str, ...] = ("doc_id", "lang", "source", "n_chars")) -> Tree:
    """Writes docs (doc_id, text, other columns) as folder/shard=N/*.parquet, N from 0, with columns size, piece and place
    added or, where docs has columns of these names or of the name shard, in their stead; returns the tree.

    A row's size is the UTF-8 bytes of its text plus 16. dims are the metadata dimensions, as far as docs has them. A shard
    is written in pieces of about FILE_BYTES; place counts a piece's rows from 0 by hash of text and doc_id. Null text: size 16, the bytes 16 in its
    shard. Null metadata: lowest. Ties and repeated rows: see above; equal texts lie side by side and mostly share a shard.
    A long text: one row. Empty table: no files.
    """
    docs = docs.drop(*_ADDED, "__keys")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 16
    found = dimensions(docs, [d for d in dims if d in docs.columns])
    keys = F.array(*_keyed(docs, found))
    tree = fit(keep(docs.select(size.alias("size"), keys.alias("keys")), "shard-keys"), [n for n, _ in found], shards)
    pieces = max(1, -(-tree.nodes[0].bytes // shards // FILE_BYTES))
    rows = docs.withColumn("size", size).withColumn("__keys", keys).withColumn("shard", placed(tree, F.col("__keys"))).drop("__keys")
    rows = rows.withColumn("piece", F.pmod(F.xxhash64("doc_id", F.xxhash64("text")), F.lit(pieces)).cast("int"))
    order = Window.partitionBy("shard", "piece").orderBy(F.xxhash64("text"), "doc_id")
    rows = rows.repartition(shards * pieces, "shard", "piece").withColumn("place", F.row_number().over(order) - 1)
    rows.write.partitionBy("shard").parquet(folder)
    return tree


_ADDED = {"size": "long", "piece": "integer", "place": "integer", "shard": "integer"}


def read_shards(docs: DataFrame, folder: str) -> DataFrame:
    """What write_shards wrote of docs (only its schema is read) with each row's slot, gapless from 0 in each shard, in the
    place of piece and place."""
    schema = docs.drop(*_ADDED, "__keys").schema
    for name, kind in _ADDED.items():
        schema = StructType([*schema.fields]).add(name, kind)
    spark = docs.sparkSession
    try:
        rows = spark.read.schema(schema).parquet(folder)
    except AnalysisException:  # an empty table has no files
        return spark.createDataFrame([], schema).drop("piece", "place").withColumn("slot", F.lit(0).cast("long"))
    files = keep(rows.groupBy("shard", "piece").agg(F.count("*").alias("rows")), "shard-files")
    before = F.sum("rows").over(Window.partitionBy("shard").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1))
    files = files.select("shard", "piece", F.coalesce(before, F.lit(0)).alias("before"))
    files = F.broadcast(files) if files.count() <= BROADCAST_FILES else files
    return rows.join(files, ["shard", "piece"]).withColumn("slot", F.col("before") + F.col("place")).drop("piece", "place", "before")
