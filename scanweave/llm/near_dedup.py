"""MinHash near-duplicate grouping (operator 1).

SuperMinHash signatures: every shingle walks a random permutation of the slots, rank by rank, and offers rank + fraction
to the slot it meets. Slots compete over ranks that are correlated within an element, which lowers the variance of the
Jaccard estimate, and a document is finished at the first rank after which all its slots are filled.

The flow:
1. One pass over the texts gives each document's distinct shingle count, a 128-bit hash of the set and band keys.
2. Documents with equal sets form a class; only its smallest doc_id goes on, so exact copies never multiply.
3. In each band bucket all members are compared with one hub, the member that shares most buckets. That is linear in the
   bucket and joins nearly all of a large group of near copies.
4. Where a bucket still spans several components, its members are candidates that no hub could settle. Of each, the rarest
   shingles are taken (rare among those members): two sets of the asked similarity share one of them, at places that
   their sizes bound. A member that shares none with another component meets nobody, as texts of a common template, whose
   rare shingles are their own; nor does one that has so many shingles of its own that no size in the bucket can make up for
   them. Of the others in a bucket, members outside its main component are compared with all in
   other components, so no candidate pair is given up. That happens in blocks of a bounded number of shingles, by an
   inverted index over the exact sets; only links leave a block.
5. Every link is confirmed on the full shingle sets of both texts, and union-find grouping makes components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scanweave.llm import _text
from scanweave.llm._scratch import keep, small_batches
from scanweave.llm.components import components

U64 = np.uint64
#: Pairs in one block of the first round, shingles in one block of the second, candidate ids that may be broadcast (8 bytes each).
BLOCK, BLOCK_SHINGLES, BROADCAST_IDS = 512, 50_000, 1_000_000


def signatures(values: np.ndarray, rows: np.ndarray, n_rows: int, m: int) -> np.ndarray:
    """SuperMinHash: (n_rows, m) of rank << 24 | fraction; rows of no values keep the largest number."""
    empty = np.uint32(0xFFFFFFFF)
    out = np.full(n_rows * m, empty, np.uint32)
    own, at = values, rows
    picks: list[np.ndarray] = []
    perm = None
    for rank in range(m):
        if not len(own):
            break
        with np.errstate(over="ignore"):
            x = _text.mix(own + U64((rank + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        pick = (rank + (((x >> U64(32)) * U64(m - rank)) >> U64(32)).astype(np.int64)).astype(np.int64)
        if perm is None and rank > 4:
            perm = np.tile(np.arange(m, dtype=np.int16), (len(own), 1))
            each = np.arange(len(own))
            for t, p in enumerate(picks):
                a, b = perm[each, t].copy(), perm[each, p].copy()
                perm[each, t], perm[each, p] = b, a
        if perm is None:
            slot = pick
            for t in range(rank - 1, -1, -1):
                slot = np.where(picks[t] == slot, t, slot)
            picks.append(pick)
        else:
            each = np.arange(len(own))
            slot, moved = perm[each, pick].astype(np.int64), perm[each, rank].copy()
            perm[each, rank], perm[each, pick] = slot, moved
        np.minimum.at(out, at * m + slot, (np.uint32(rank << 24) | (x & U64(0xFFFFFF)).astype(np.uint32)))
        open_row = out.reshape(n_rows, m).max(axis=1) == empty
        stay = open_row[at]
        if not stay.all():
            own, at = own[stay], at[stay]
            picks = [p[stay] for p in picks]
            perm = None if perm is None else perm[stay]
    return out.reshape(n_rows, m)


def _sets(texts: _text.Texts, k: int) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, rows = texts.words()
    return _text.distinct_by_row(*_text.shingles(texts.hash_spans(starts, ends, lower=True), rows, texts.n, k), texts.n)


def _features(k: int, bands: int, width: int):
    m = bands * width
    weights = _text.mix(np.arange(1, width + 1, dtype=U64)) | U64(1)
    salts = _text.mix(np.arange(1001, 1001 + bands, dtype=U64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, text = batch.column(0), _text.column(batch, "text")
            for part in _text.chunks(text):
                values, rows = _sets(part, k)
                counts = np.bincount(rows, minlength=part.n)
                sig = signatures(values, rows, part.n, m)
                with np.errstate(over="ignore"):
                    sums = [np.zeros(part.n, U64), np.zeros(part.n, U64)]
                    for s, salt in zip(sums, (U64(0x51ED270B), U64(0xA24BAED4963EE407)), strict=True):
                        np.add.at(s, rows, _text.mix(values ^ salt))
                    keys = _text.mix((_text.mix(sig.astype(U64)).reshape(part.n, bands, width) * weights).sum(axis=2, dtype=U64) ^ salts)
                filled = counts > 0
                flat = pa.array(keys[filled].astype(np.int64, casting="unsafe").ravel())
                offsets = np.concatenate([[0], np.cumsum(filled * bands)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(part.first, part.n), pa.array(counts.astype(np.int64)), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), flat)],
                    names=["doc_id", "n_shingles", "set_a", "set_b", "bands"],
                )

    return run


def _verify(k: int, percent: int):
    def sets_of(batch: pa.RecordBatch, id_name: str, text_name: str) -> dict:
        """Each distinct document of a column once, whatever the number of its pairs."""
        ids = batch.column(batch.schema.get_field_index(id_name)).to_numpy(zero_copy_only=False)
        unique, first = np.unique(ids, return_index=True)
        text = _text.column(batch, text_name).take(pa.array(first))
        out = {}
        for part in _text.chunks(text):
            values, rows = _sets(part, k)
            edges = np.searchsorted(rows, np.arange(part.n + 1))
            for i in range(part.n):
                out[unique[part.first + i]] = values[edges[i] : edges[i + 1]]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                a, b = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
                left, right = sets_of(batch, "a", "text_a"), sets_of(batch, "b", "text_b")
                ok = np.zeros(len(a), bool)
                for i, (x, y) in enumerate(zip(a, b, strict=True)):
                    p, q = left[x], right[y]
                    both = len(np.intersect1d(p, q, assume_unique=True))
                    ok[i] = 100 * both >= percent * (len(p) + len(q) - both) and both > 0
                yield pa.RecordBatch.from_arrays([pa.array(a[ok]), pa.array(b[ok])], names=["a", "b"])

    return run


def _blocks(k: int, percent: int):
    """Over rows sorted by block, with the members outside the bucket's main component first: exact links to all others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, parts, sets, index = None, [], [], [], None
        for batch in batches:
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
            sides, own_ids, own_parts, mains = (batch.column(i).to_pylist() for i in range(3, 7))
            out: list[tuple[int, int]] = []
            for part in _text.chunks(_text.column(batch, "text")):
                values, rows = _sets(part, k)
                edges = np.searchsorted(rows, np.arange(part.n + 1))
                for i in range(part.n):
                    row, own = part.first + i, values[edges[i] : edges[i + 1]]
                    if keys[row] != key:
                        key, ids, parts, sets, index = keys[row], [], [], [], None
                    if sides[row] == 0:
                        ids.append(own_ids[row])
                        parts.append(own_parts[row])
                        sets.append(own.copy())
                        continue
                    if not ids:
                        continue
                    if index is None:
                        flat, at, sizes = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets]), np.array([len(x) for x in sets])
                        order = np.argsort(flat)
                        index = flat[order], at[order], sizes, np.array(ids), np.array(parts)
                    flat, at, sizes, all_ids, all_parts = index
                    low, high = np.searchsorted(flat, own, "left"), np.searchsorted(flat, own, "right")
                    runs = high - low
                    hits = at[np.repeat(low - np.cumsum(runs) + runs, runs) + np.arange(runs.sum())]
                    both = np.bincount(hits, minlength=len(sizes))
                    ok = (100 * both >= percent * (sizes + len(own) - both)) & (all_parts != own_parts[row])
                    if own_parts[row] != mains[row]:
                        ok &= all_ids > own_ids[row]
                    out += [(int(x), own_ids[row]) for x in all_ids[ok]]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], names=["a", "b"])

    return run


def _in_blocks(rows: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Links between components inside the buckets of rows (bucket, id, component, main, is, js).

    Members outside the main component (cut into `is` blocks) meet all members (`js` blocks); a block holds about
    BLOCK_SHINGLES shingles. Only confirmed links leave a task, never the pairs that were looked at.
    """
    rows = keep(rows.select("bucket", "id", "component", "main", "is", "js"), "near-open")
    ids = keep(rows.select(F.col("id").alias("doc_id")).distinct(), "near2-ids")
    texts = _texts(docs, ids).withColumnRenamed("doc_id", "id")
    block = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    one = rows.where("component != main").select("*", block("is").alias("i"), F.lit(0).alias("side")).select("*", every("js").alias("j"))
    other = rows.select("*", every("is").alias("i"), F.lit(1).alias("side")).select("*", block("js").alias("j"))
    both = one.unionByName(other).join(texts, "id").select("bucket", "i", "j", "side", "id", "component", "main", "text")
    both = both.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "side")
    return keep(both.mapInArrow(_blocks(k, percent), "a long, b long").distinct(), "near2-links")


def _texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    few = ids.count() <= BROADCAST_IDS
    found = docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")
    return found.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"))


def _spread(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int, how: str = "inner") -> DataFrame:
    """rows joined with their groups (one row a key, of `size` rows), where no key is a hot one: groups of a thousandth of
    `total` rows or more, of which there are a thousand at most, are broadcast. Both sides are read twice."""
    large = F.col(size) >= max(2, total // 1000)
    hot = groups.where(large)
    names = F.broadcast(hot.select(*keys))
    return rows.join(F.broadcast(hot), keys).unionByName(rows.join(names, keys, "left_anti").join(groups.where(~large), keys, how))


def _shingle_rows(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for part in _text.chunks(_text.column(batch, "text")):
                values, rows = _sets(part, k)
                for i in range(0, len(values), 100_000):
                    own = pa.array(rows[i : i + 100_000] + part.first)
                    yield pa.RecordBatch.from_arrays([ids.take(own), pa.array(values[i : i + 100_000].view(np.int64))], names=["id", "shingle"])

    return run


def _rare(docs: DataFrame, nodes: DataFrame, k: int, percent: int) -> DataFrame:
    """(bucket, id, n, component, first, able) of nodes (id, n, component): the shingles of each among which a partner must share
    one, and how many of all its shingles other nodes hold.

    With all shingles of both in order from the rarest, let x be the smaller set of two with similarity t. Their first common
    shingle is among the |x| - ceil(2t / (1 + t) |x|) + 1 first ones of x (`first`), and among the |y| - ceil(t |y|) + 1 first
    ones of y. Shingles that one node alone has come first and need no row.
    """
    ids = keep(nodes.select(F.col("id").alias("doc_id")), "near2-ids")
    shingles = keep(_texts(docs, ids).mapInArrow(_shingle_rows(k), "id long, shingle long"), "near2-shingles")
    common = keep(shingles.groupBy("shingle").agg(F.count("*").alias("held")).where("held > 1"), "near2-common")
    shared = _spread(shingles, common, ["shingle"], "held", 0 if not (total := common.agg(F.sum("held")).first()[0]) else total // 10)
    place = F.row_number().over(Window.partitionBy("id").orderBy("held", "shingle"))
    ordered = shared.withColumn("place", place).withColumn("n_shared", F.count("*").over(Window.partitionBy("id")))
    ordered = ordered.join(nodes, "id").withColumn("place", F.col("n") - F.col("n_shared") + F.col("place"))
    last = F.expr(f"n - ({percent} * n + 99) div 100 + 1")
    first = F.expr(f"place <= n - ({2 * percent} * n + {99 + percent}) div {100 + percent} + 1")
    return keep(ordered.where(F.col("place") <= last).select(F.col("shingle").alias("bucket"), "id", "n", "component", first.alias("first"), F.col("n_shared").alias("able")), "near2-rare")


def _able(placed: DataFrame, percent: int) -> DataFrame:
    """placed (bucket, id, n, component, able) without the rows that can't be linked in their bucket. `able` shingles of a node
    are held by others at all, so its intersection with any is that at most. For a similarity of t the intersection is
    t / (1 + t) of both sizes together at least, which bounds a partner's size from above."""
    placed = placed.withColumn("most", F.expr(f"able * {100 + percent} div {percent} - n"))
    sizes = placed.groupBy("bucket").agg(F.min("n").alias("low"), F.max("most").alias("high"), F.count("*").alias("n_rows"))
    kept = _spread(placed, keep(sizes, "near2-sizes"), ["bucket"], "n_rows", placed.count())
    return kept.where("low <= most and n <= high").select("bucket", "id", "n", "component")


def _confirmed(pairs: DataFrame, docs: DataFrame, k: int, percent: int, name: str) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough. a is the side that may be hot and is dealt out in blocks."""
    pairs = keep(pairs, f"{name}-pairs")
    ids = keep(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), f"{name}-ids")
    texts = keep(_texts(docs, ids), f"{name}-texts")
    blocks = pairs.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("n_blocks"))
    lefts = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")).join(blocks, "a")
    lefts = lefts.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1))).drop("n_blocks")
    rights = pairs.join(blocks, "a").withColumn("block", F.pmod(F.xxhash64("b"), F.col("n_blocks")).cast("int")).drop("n_blocks")
    rights = rights.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    found = rights.join(lefts, ["a", "block"]).select("a", "b", "text_a", "text_b").mapInArrow(_verify(k, percent), "a long, b long")
    return keep(found, f"{name}-links")


def near_dedup(docs: DataFrame, k: int = 5, percent: int = 85, bands: int = 25, width: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id, kept per row of docs (doc_id, text, any other columns).

    Documents are linked with 100 * |intersection| >= percent * |union| of their distinct k-word shingles; a component is
    all that links reach, named by its smallest doc_id. With the default 25 bands of 5 SuperMinHash slots a pair at
    similarity 0.85 is missed as a candidate with probability 5e-7, above that less.

    Null or word-less text: n_shingles 0, linked with nothing. Repeated rows: one class, each row returned. A doc_id names
    one document: rows of one id with different texts are one node, whose links are confirmed on its text of the smallest
    hash. Null doc_id: the row takes no part, component_id null and kept true. Ties: the smallest doc_id is kept. A long
    text is one row; its set of 8-byte hashes is held in one task. Empty table: no rows. Other columns are not read, whatever
    their names.
    """
    columns = small_batches(docs).select(F.col("doc_id").cast("long"), "text")
    features = keep(columns.mapInArrow(_features(k, bands, width), "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>"), "near-features")
    able = features.where("n_shingles > 0 and doc_id is not null")
    total = able.count()
    classes = able.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    reps = able.join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    rows = keep(reps.select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), F.explode("bands").alias("bucket")), "near-rows")
    buckets = rows.groupBy("bucket").agg(F.count("*").alias("size"), F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("bucket", "size")
    members = keep(_spread(rows, keep(buckets, "near-buckets"), ["bucket"], "size", total * bands), "near-members")

    scores = members.groupBy("id").agg(F.sum("size").alias("score"))
    hubs = members.join(scores, "id").groupBy("bucket").agg(F.max(F.struct("score", (-F.col("id")).alias("minus"), "n")).alias("hub"), F.first("size").alias("n_members"))
    hubs = keep(hubs.select("bucket", (-F.col("hub.minus")).alias("a"), F.col("hub.n").alias("n_a"), "n_members"), "near-hubs")
    fits = F.expr(f"100 * least(n_a, n) >= {percent} * greatest(n_a, n)")
    first = _spread(members, hubs, ["bucket"], "n_members", total * bands).where(F.col("id") != F.col("a")).where(fits).select("a", F.col("id").alias("b")).distinct()
    links = _confirmed(keep(first, "near-first"), columns, k, percent, "near1")
    labels = components(links)

    placed = members.join(labels.select(F.col("node").alias("id"), "component"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    placed = keep(placed, "near-placed")
    mixed = placed.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.first("size").alias("n_members")).where("low < high").select("bucket", "n_members")
    if mixed.limit(1).count():
        open_ids = _spread(placed, keep(mixed, "near-mixed"), ["bucket"], "n_members", total * bands).select("id", "n", "component").distinct()
        rare = _rare(columns, keep(open_ids, "near-nodes"), k, percent)
        holders = rare.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.max("first").alias("first"), F.count("*").alias("held")).where("low < high and first")
        holders = keep(holders.select("bucket", "held"), "near2-holders")
        live = keep(_spread(rare, holders, ["bucket"], "held", rare.count()).select("id", "able").distinct(), "near2-live")
        placed = keep(placed.select("bucket", "id", "n", "component").join(F.broadcast(live) if live.count() <= BROADCAST_IDS else live, "id"), "near2-live-rows")
        placed = keep(_able(placed, percent), "near2-placed")
        parts = placed.groupBy("bucket", "component").agg(F.sum("n").alias("part"), F.count("*").alias("rows"))
        groups = parts.groupBy("bucket").agg(F.count("*").alias("n_parts"), F.sum("part").alias("total"), F.max(F.struct("part", "component")).alias("main"), F.sum("rows").alias("n_rows")).where("n_parts > 1")
        groups = groups.select("bucket", "n_rows", F.col("main.component").alias("main"), F.ceil(F.col("total") / BLOCK_SHINGLES).cast("int").alias("js"), F.ceil((F.col("total") - F.col("main.part")) / BLOCK_SHINGLES).cast("int").alias("is"))
        groups = keep(groups, "near2-groups")
        if groups.limit(1).count():
            labels = components(links.union(_in_blocks(_spread(placed, groups, ["bucket"], "n_rows", placed.count()), columns, k, percent)))

    known = labels.withColumnRenamed("node", "rep")
    groups = keep(classes.join(known, "rep", "left").where("copies > 1 or component is not null").select("set_a", "set_b", "copies", F.coalesce("component", "rep").alias("component")), "near-groups")
    whole = features.select("doc_id", "n_shingles", "set_a", "set_b")
    out = _spread(whole.where("n_shingles > 0 and doc_id is not null"), groups, ["set_a", "set_b"], "copies", total, "left").drop("copies")
    out = out.unionByName(whole.where("n_shingles = 0 or doc_id is null").withColumn("component", F.lit(None).cast("long")))
    own = F.when(F.col("doc_id").isNull(), F.lit(None).cast("long")).when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
