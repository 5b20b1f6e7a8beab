"""Small groups as rows: a group's members in one array column, read by Arrow without a Python call for each group.

For groups whose size the sensor bounds (a scan line, a tile of a map). Grouped Python functions cost milliseconds a group; a
batch of array rows costs that once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def gathered(df: DataFrame, keys: list[str], columns: list[str], name: str = "members", order: list[str] = ()) -> DataFrame:
    """One row a group: keys and an array of structs of columns, sorted by `order` first."""
    first = [c for c in order if c in columns]
    listed = F.collect_list(F.struct(*first, *[c for c in columns if c not in first]))
    return df.groupBy(*keys).agg((F.sort_array(listed) if order else listed).alias(name))


def members(batch: pa.RecordBatch, name: str) -> Iterator[dict[str, np.ndarray]]:
    """The fields of each row's array as numpy arrays; integers with nulls become floats with nan. Null rows are empty."""
    lists = batch.column(batch.schema.get_field_index(name))
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    flat = lists.flatten()
    fields = {f.name: flat.field(f.name).to_numpy(zero_copy_only=False) for f in flat.type}
    ends = np.cumsum(sizes)
    for low, high in zip(ends - sizes, ends, strict=True):
        yield {n: v[low:high] for n, v in fields.items()}
