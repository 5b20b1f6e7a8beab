"""Reversible line deduplication (operator 10): sharded cuckoo filters backed by exact reference-count tables.

An index holds three tables in the shared folder:
- postings: one row per (line key, document);
- references: per key the number of documents and the smallest doc_id, counted from the postings;
- filters: per shard a cuckoo filter over the keys that at least `min_docs` documents hold.
A line is probed in its shard's filter, and a hit is settled by that shard's reference rows. Documents can be inserted and
deleted: only the counts of the keys they hold change, and their fingerprints enter or leave the filters.

Shards are cut from key hashes so that each holds a bounded number of keys. A shard with more postings than one task
should take, as that of a line found everywhere, is dealt out by document, with its small filter and references repeated.
"""

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from scanweave.llm import _text
from scanweave.llm._scratch import keep, small_batches

U64 = np.uint64
KEYS_PER_SHARD, POSTINGS_PER_TASK, BROADCAST_SHARDS, BROADCAST_KEYS = 50_000, 200_000, 100_000, 500_000
SLOTS = 4


class CuckooFilter:
    """Four 16-bit fingerprints a bucket; two buckets a key, each found from the other and the fingerprint."""

    def __init__(self, n_keys: int, cells: np.ndarray | None = None):
        if cells is None:
            size = 1 << max(1, int(np.ceil(np.log2(max(1, n_keys) / (SLOTS * 0.8)))))
            cells = np.zeros((size, SLOTS), np.uint16)
        self.cells = cells

    def places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprints (never 0) and both buckets of 64-bit keys."""
        marks = (keys >> U64(48)).astype(np.uint16)
        marks = np.where(marks == 0, np.uint16(1), marks)
        one = (_text.mix(keys) & U64(len(self.cells) - 1)).astype(np.int64)
        return marks, one, self.other(marks, one)

    def other(self, marks, bucket):
        return (bucket ^ _text.mix(np.asarray(marks).astype(U64)).astype(np.int64)) & (len(self.cells) - 1)

    def insert(self, keys: np.ndarray) -> None:
        """Raises OverflowError if a run of kicks does not end; the owner then builds a larger filter from the exact table."""
        marks, one, two = self.places(keys)
        for i in range(len(keys)):
            mark, bucket = marks[i], one[i] if (self.cells[one[i]] == 0).any() else two[i]
            for kick in range(500):
                free = np.flatnonzero(self.cells[bucket] == 0)
                if len(free):
                    self.cells[bucket, free[0]] = mark
                    break
                slot = (kick + i) % SLOTS
                mark, self.cells[bucket, slot] = self.cells[bucket, slot], mark
                bucket = int(self.other(mark, bucket))
            else:
                raise OverflowError

    def build(self, keys: np.ndarray) -> "CuckooFilter":
        """Inserts all keys, in a table twice as large if a run of kicks does not end."""
        size = len(self.cells)
        while True:
            self.cells = np.zeros((size, SLOTS), np.uint16)
            marks, one, two = self.places(keys)
            rest = np.arange(len(keys))
            for bucket in (one, two):  # in bulk: the first four of each bucket
                order = rest[np.argsort(bucket[rest], kind="stable")]
                b = bucket[order]
                rank = np.arange(len(b)) - np.searchsorted(b, b) + (self.cells[b] != 0).sum(axis=1)
                fits = rank < SLOTS
                self.cells[b[fits], rank[fits]] = marks[order[fits]]
                rest = order[~fits]
            try:
                self.insert(keys[rest])
                return self
            except OverflowError:
                size *= 2

    def delete(self, keys: np.ndarray) -> None:
        """Removes one fingerprint of each key; every key must have been inserted."""
        marks, one, two = self.places(keys)
        for mark, *buckets in zip(marks, one, two, strict=True):
            for bucket in buckets:
                if len(at := np.flatnonzero(self.cells[bucket] == mark)):
                    self.cells[bucket, at[0]] = 0
                    break

    def contains(self, keys: np.ndarray) -> np.ndarray:
        marks, one, two = self.places(keys)
        return (self.cells[one] == marks[:, None]).any(axis=1) | (self.cells[two] == marks[:, None]).any(axis=1)


def _keys(part: _text.Texts, min_chars: int):
    """Start, end and row of all lines; which are long enough, and their two 64-bit keys."""
    starts, ends, rows = part.lines()
    solid = np.flatnonzero(~_text.SPACE[part.data])
    low, high = np.searchsorted(solid, starts), np.searchsorted(solid, ends)
    full = np.flatnonzero(high > low)
    first, last = solid[low[full]], solid[high[full] - 1] + 1
    points = np.concatenate([[0], np.cumsum((part.data & 0xC0) != 0x80)])
    long = points[last] - points[first] >= min_chars
    full, first, last = full[long], first[long], last[long]
    return starts, ends, rows, full, part.hash_spans(first, last, lower=True), part.hash_spans(first, last, lower=True, seed=1)


def _postings(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _text.chunks(_text.column(batch, "text")):
                _, _, rows, at, a, b = _keys(part, min_chars)
                with np.errstate(over="ignore"):
                    _, first = np.unique(_text.mix(a + rows[at].astype(U64) * U64(0x632BE59BD9B4E019)), return_index=True)
                doc = batch.column(0).slice(part.first, part.n).take(pa.array(rows[at][first]))
                out = pa.RecordBatch.from_arrays([pa.array(a[first].view(np.int64)), pa.array(b[first].view(np.int64)), doc], names=["key_a", "key_b", "doc_id"])
                yield out.filter(pc.is_valid(doc))

    return run


def _references(postings: DataFrame) -> DataFrame:
    return postings.groupBy("key_a", "key_b").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))


def _shard(shards: int):
    return F.pmod(F.xxhash64("key_a"), F.lit(shards)).cast("int")


def _build_filter(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    cells = CuckooFilter(table.num_rows).build(table["key_a"].to_numpy().view(U64)).cells
    return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "n_buckets": pa.array([len(cells)], pa.int32()), "cells": pa.array([cells.tobytes()], pa.binary())})


FILTER_SCHEMA = "shard int, n_buckets int, cells binary"


def _load(row_buckets: int, cells: bytes) -> "CuckooFilter":
    return CuckooFilter(0, np.frombuffer(cells, np.uint16).reshape(row_buckets, SLOTS).copy())


def _settle(key: tuple[pa.Scalar, ...], lines: pa.Table, known: pa.Table) -> pa.Table:
    """Of one block of postings, those that another document with a smaller id holds: the filter first, then exact references."""
    schema = pa.schema([("key_a", pa.int64()), ("key_b", pa.int64()), ("doc_id", pa.int64())])
    held = known.filter(pc.is_valid(known["cells"]))
    if not held.num_rows or not lines.num_rows:
        return schema.empty_table()
    a = lines["key_a"].to_numpy().view(U64)
    hits = lines.filter(pa.array(_load(held["n_buckets"][0].as_py(), held["cells"][0].as_py()).contains(a)))
    exact = known.filter(pc.is_null(known["cells"])).select(["key_a", "key_b", "first_doc"])
    found = hits.select(["key_a", "key_b", "doc_id"]).join(exact, ["key_a", "key_b"], join_type="inner")
    return found.filter(pc.greater(found["doc_id"], found["first_doc"])).select(["key_a", "key_b", "doc_id"]).cast(schema)


@dataclass(frozen=True)
class LineIndex:
    """postings (key_a, key_b, doc_id), references (and n_docs, first_doc, shard), filters (shard, n_buckets, cells)."""

    postings: DataFrame
    references: DataFrame
    filters: DataFrame
    shards: int
    min_chars: int = 10
    min_docs: int = 2

    @classmethod
    def build(cls, docs: DataFrame, min_chars: int = 10, min_docs: int = 2) -> "LineIndex":
        """The index of docs (doc_id, text); rows without a doc_id stay out."""
        postings = keep(small_batches(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(_postings(min_chars), "key_a long, key_b long, doc_id long"), "line-postings")
        return cls._of(postings, min_chars, min_docs)

    @classmethod
    def _of(cls, postings: DataFrame, min_chars: int, min_docs: int) -> "LineIndex":
        references = keep(_references(postings), "line-references")
        shared = references.where(F.col("n_docs") >= min_docs)
        shards = max(1, -(-shared.count() // KEYS_PER_SHARD))
        return cls(postings, references, cls._filters(shared, shards), shards, min_chars, min_docs)

    @staticmethod
    def _filters(shared: DataFrame, shards: int) -> DataFrame:
        return keep(shared.select("key_a", _shard(shards).alias("shard")).groupBy("shard").applyInArrow(_build_filter, FILTER_SCHEMA), "line-filters")

    def shared(self) -> DataFrame:
        return self.references.where(F.col("n_docs") >= self.min_docs)

    def drops(self) -> DataFrame:
        """(key_a, key_b, doc_id) of the lines that leave a document: held by min_docs documents, one of smaller doc_id among them."""
        lines = self.postings.withColumn("shard", _shard(self.shards))
        heavy = lines.groupBy("shard").count().where(F.col("count") > POSTINGS_PER_TASK)
        heavy = keep(heavy.select("shard", F.ceil(F.col("count") / POSTINGS_PER_TASK).cast("int").alias("blocks")), "line-heavy")
        heavy = F.broadcast(heavy) if heavy.count() <= BROADCAST_SHARDS else heavy
        blocks = F.coalesce("blocks", F.lit(1))
        lines = lines.join(heavy, "shard", "left").withColumn("block", F.pmod(F.xxhash64("doc_id"), blocks).cast("int")).drop("blocks")
        null = lambda kind: F.lit(None).cast(kind)
        exact = self.shared().select(_shard(self.shards).alias("shard"), "key_a", "key_b", "first_doc", null("int").alias("n_buckets"), null("binary").alias("cells"))
        known = exact.unionByName(self.filters.select("shard", null("long").alias("key_a"), null("long").alias("key_b"), null("long").alias("first_doc"), "n_buckets", "cells"))
        known = known.join(heavy, "shard", "left").withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1))).drop("blocks")
        return lines.groupBy("shard", "block").cogroup(known.groupBy("shard", "block")).applyInArrow(_settle, "key_a long, key_b long, doc_id long")

    @staticmethod
    def _small(df: DataFrame) -> DataFrame:
        """A kept table, broadcast if it is no larger than a batch that every executor may hold (16 bytes a row)."""
        return F.broadcast(df) if df.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS else df

    def insert(self, docs: DataFrame) -> "LineIndex":
        """The index with new documents; one whose doc_id is known replaces the old one.

        Counts of the keys they hold are added up, and filters gain the keys that became shared. Postings and references of
        other keys are read and copied, but neither sorted nor shuffled for a batch of at most BROADCAST_KEYS keys.
        """
        new = keep(small_batches(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(_postings(self.min_chars), "key_a long, key_b long, doc_id long").distinct(), "line-new")
        ids = keep(docs.select(F.col("doc_id").cast("long")).where("doc_id is not null").distinct(), "line-ids")
        known = keep(self.postings.join(self._small(ids), "doc_id", "left_semi").select("doc_id").distinct(), "line-known")
        if known.limit(1).count():
            return self.delete(known).insert(docs)
        keys = ["key_a", "key_b"]
        added = keep(_references(new), "line-added")
        touched = self._small(added.select(*keys))
        old = keep(self.references.join(touched, keys, "left_semi"), "line-old")
        now = old.unionByName(added).groupBy(*keys).agg(F.sum("n_docs").alias("n_docs"), F.min("first_doc").alias("first_doc"), F.max("last_doc").alias("last_doc"))
        now = keep(now, "line-now")
        references = keep(self.references.join(touched, keys, "left_anti").unionByName(now), "line-references")
        return self._changed(keep(self.postings.unionByName(new), "line-postings"), references, old, now)

    def delete(self, ids: DataFrame) -> "LineIndex":
        """The index without the documents of ids (doc_id), as if they had never come. Only counts of their keys are made anew."""
        ids = self._small(keep(ids.select(F.col("doc_id").cast("long")).distinct(), "line-ids"))
        keys = ["key_a", "key_b"]
        gone = self._small(keep(self.postings.join(ids, "doc_id", "left_semi").select(*keys).distinct(), "line-gone"))
        postings = keep(self.postings.join(ids, "doc_id", "left_anti").select(*keys, "doc_id"), "line-postings")
        old = keep(self.references.join(gone, keys, "left_semi"), "line-old")
        now = keep(_references(postings.join(gone, keys, "left_semi")), "line-now")
        references = keep(self.references.join(gone, keys, "left_anti").unionByName(now), "line-references")
        return self._changed(postings, references, old, now)

    def _changed(self, postings: DataFrame, references: DataFrame, old: DataFrame, new: DataFrame) -> "LineIndex":
        """Brings the filters from the shared ones among the old references to those among the new, shard by shard."""
        was, now = (r.where(F.col("n_docs") >= self.min_docs).select("key_a", "key_b") for r in (old, new))
        moved = now.join(was, ["key_a", "key_b"], "left_anti").withColumn("gain", F.lit(True)).unionByName(was.join(now, ["key_a", "key_b"], "left_anti").withColumn("gain", F.lit(False)))
        moved = moved.select(_shard(self.shards).alias("shard"), "key_a", "gain")

        def update(key: tuple[pa.Scalar, ...], cells: pa.Table, keys: pa.Table) -> pa.Table:
            gain = keys["gain"].to_numpy(zero_copy_only=False).astype(bool)
            marks = keys["key_a"].to_numpy().view(U64)
            held = _load(cells["n_buckets"][0].as_py(), cells["cells"][0].as_py()) if cells.num_rows else CuckooFilter(len(marks))
            held.delete(marks[~gain])
            shard = pa.array([key[0].as_py()], pa.int32())
            try:
                held.insert(marks[gain])
            except OverflowError:
                return pa.table({"shard": shard, "n_buckets": pa.array([0], pa.int32()), "cells": pa.array([None], pa.binary())})
            return pa.table({"shard": shard, "n_buckets": pa.array([len(held.cells)], pa.int32()), "cells": pa.array([held.cells.tobytes()], pa.binary())})

        filters = keep(self.filters.groupBy("shard").cogroup(moved.groupBy("shard")).applyInArrow(update, FILTER_SCHEMA), "line-filters")
        if filters.where("cells is null").limit(1).count():  # a filter is full: cut shards anew
            return self._of(postings, self.min_chars, self.min_docs)
        return LineIndex(postings, references, filters, self.shards, self.min_chars, self.min_docs)


def _rewrite(min_chars: int, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, drops = _text.column(batch, "text"), batch.column(batch.schema.get_field_index("line_drops"))
            for part in _text.chunks(text):
                starts, ends, rows, at, a, b = _keys(part, min_chars)
                own = drops.slice(part.first, part.n)
                drop = np.zeros(len(starts), bool)
                if own.null_count < part.n:
                    lists = own.fill_null(pa.scalar([], own.type))
                    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
                    flat = lists.flatten()
                    with np.errstate(over="ignore"):
                        salt = lambda r: r.astype(U64) * U64(0x632BE59BD9B4E019)
                        pair = lambda x, y, r: _text.mix(x + salt(r)) + y * U64(3)
                        gone = pair(flat.field("key_a").to_numpy().view(U64), flat.field("key_b").to_numpy().view(U64), np.repeat(np.arange(part.n), sizes))
                        drop[at] = np.isin(pair(a, b, rows[at]), gone)
                n_lines, n_dropped = (np.bincount(r, minlength=part.n).astype(np.int64) for r in (rows, rows[drop]))
                edges, data = np.searchsorted(rows, np.arange(part.n + 1)), part.data.tobytes()
                out = []
                for i in range(part.n):
                    if n_dropped[i]:
                        out.append(b"\n".join(data[starts[j] : ends[j]] for j in range(edges[i], edges[i + 1]) if not drop[j]))
                    else:
                        out.append(data[part.offsets[i] : part.offsets[i + 1]])
                rest = batch.slice(part.first, part.n)
                if digest:
                    made = pa.array([hashlib.sha256(x).hexdigest() for x in out])
                    yield pa.RecordBatch.from_arrays([rest.column(0), pa.array(n_lines), pa.array(n_dropped), made], names=["doc_id", "n_lines", "n_dropped", "kept_sha256"])
                else:
                    at_text = rest.schema.get_field_index("text")
                    null = rest.column(at_text).is_null()
                    made = pc.if_else(null, pa.scalar(None, pa.string()), pa.array(out, pa.binary()).cast(pa.string()))
                    cols = [made if i == at_text else c for i, c in enumerate(rest.columns)]
                    names = [n for n in rest.schema.names if n != "line_drops"]
                    yield pa.RecordBatch.from_arrays([c for c, n in zip(cols, rest.schema.names, strict=True) if n != "line_drops"], names=names)

    return run


def _with_drops(docs: DataFrame, index: LineIndex) -> DataFrame:
    lists = index.drops().groupBy("doc_id").agg(F.collect_list(F.struct("key_a", "key_b")).alias("line_drops"))
    return docs.drop("line_drops").join(lists.withColumnRenamed("doc_id", "line_doc"), F.col("doc_id") == F.col("line_doc"), "left").drop("line_doc")


def line_dedup(docs: DataFrame, min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 per row of docs.

    A line's key is the line stripped of [\\x20\\x09-\\x0D] with A-Z lower-cased. Keys of at least min_chars code points in
    at least min_docs documents lose all their lines but those of the smallest doc_id. Null or empty text: one empty line.
    Repeated rows of one doc_id count as one document for the others, and each is returned. Null doc_id: the row takes no
    part and stays whole. A long text is read whole, in one task, at a few bytes of memory for each of its own. Empty table:
    no rows. Other columns are not read, whatever their names.
    """
    rows = _with_drops(docs.select(F.col("doc_id").cast("long"), "text"), LineIndex.build(docs, min_chars, min_docs))
    return rows.mapInArrow(_rewrite(min_chars, True), "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


def deduplicated(docs: DataFrame, min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """docs with the dropped lines taken out of text; null texts stay null."""
    schema = StructType([f for f in docs.schema.fields if f.name != "line_drops"])
    return _with_drops(docs, LineIndex.build(docs, min_chars, min_docs)).mapInArrow(_rewrite(min_chars, False), schema)
