"""Connected components by union-find: local forests in each task, merged by distributed contraction."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanweave.llm._scratch import keep


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over one task's edges; gives (node, component) with the smallest id as root."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := parent.setdefault(root, root)) != root:
            root = up
        while (up := parent[x]) != root:
            parent[x], x = root, up
        return root

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = list(parent)
    for i in range(0, len(nodes), 100_000):
        part = nodes[i : i + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(np.array([find(x) for x in part], np.int64))], names=["node", "component"])


def components(edges: DataFrame, per_task: int = 500_000) -> DataFrame:
    """(node, component) for every node of edges (a, b); a component is named by its smallest node.

    Each task reduces at most about per_task edges to a forest. With several tasks, the forests' roots are hooked to
    smaller neighbours and the edges contracted, until none crosses components. Nothing is collected.
    """
    schema = "node long, component long"
    tasks = max(1, ceil(edges.count() / per_task))
    if tasks == 1:
        return keep(edges.select("a", "b").repartition(1).mapInArrow(_forest, schema), "components")
    forest = edges.select("a", "b").repartition(tasks).mapInArrow(_forest, schema)
    rest = keep(forest.where("node != component").select(F.col("node").alias("a"), F.col("component").alias("b")).distinct(), "forest")
    nodes = rest.select(F.col("a").alias("node")).union(rest.select("b")).distinct()
    labels = keep(nodes.withColumn("component", F.col("node")), "labels")
    while rest.limit(1).count():
        hook = rest.groupBy(F.greatest("a", "b").alias("root")).agg(F.min(F.least("a", "b")).alias("to"))
        hook = keep(hook, "hooks")
        while True:  # pointer jumping, until each hook leads to a root that stays
            further = hook.select(F.col("root").alias("to"), F.col("to").alias("next"))
            jumped = keep(hook.join(further, "to", "left").select("root", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")), "hooks")
            hook = jumped.select("root", "to")
            if not jumped.where("moved").limit(1).count():
                break
        labels = keep(labels.join(hook.withColumnRenamed("root", "component"), "component", "left").select("node", F.coalesce("to", "component").alias("component")), "labels")
        for side in ("a", "b"):
            rest = rest.join(hook.withColumnRenamed("root", side), side, "left").withColumn(side, F.coalesce("to", side)).drop("to")
        rest = keep(rest.where("a != b").select("a", "b").distinct(), "edges")
    return labels
