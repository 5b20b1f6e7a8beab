"""Object files: a stream of named, nested objects with ids, pointers between them, and blobs in files beside it.

    "Kind" { "#id" : 1, "estimate" : [ 1, 0 ], "parent" : { "#pointer" : 2 }, "image" : { "path_name" : "f.d/x.dat", "index" : -1 } }

Objects run over any number of lines and the file may be split anywhere between lines, so borders are found by counting:
each line's brackets outside of texts and comments, added up over the lines before it in two steps (sums of splits, then
lines within a split). A line that begins at depth zero begins an object; its number is a count of such lines, taken in the same way.
Nothing is read by one task but one object. Pointers are resolved by a join on ids.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scanweave.sources.tables import keep

SCHEMA = "stream string, object long, part int, kind string, id long, body string, pointers array<struct<at: string, id: long>>, blobs array<struct<at: string, name: string, index: long>>, error string"
#: The words that mark ids, pointers and blobs.
ID, POINTER, BLOB, BLOB_INDEX = "#id", "#pointer", "path_name", "index"
_TEXT_OR_COMMENT = re.compile(r'"[^"]*"|//[^\n]*')
_HEAD = re.compile(r'\s*"([^"]*)"\s*:?\s*(?=\{)')


def _depth(sign: str, line: str = "_plain"):
    return F.length(line) - F.length(F.replace(F.col(line), F.lit(sign), F.lit("")))


def grouped(spark: SparkSession, path: str, together: bool = False) -> DataFrame:
    """(stream, object, text): the lines of each object, in order. Lines before the first object have the number 0."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_split"), F.monotonically_increasing_id().alias("_line"))
    # texts and comments hold brackets that don't count; texts have no escapes
    lines = lines.withColumn("_plain", F.regexp_replace("value", r'"[^"]*"|//.*', ""))
    lines = lines.where("trim(value) != ''").withColumn("_step", _depth("{") - _depth("}"))
    within = Window.partitionBy("_file", "_split").orderBy("_line").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("_file").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    placed = keep(lines.select("_file", "_split", "_line", "value", F.col("_step").cast("long").alias("_step"), F.coalesce(F.sum("_step").over(within), F.lit(0)).alias("_own")), "object-lines")
    # a split of a file is one row here
    splits = placed.groupBy("_file", "_split").agg(F.sum("_step").alias("_sum"))
    splits = splits.select("_file", "_split", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    begun = placed.join(F.broadcast(splits), ["_file", "_split"]).withColumn("_begins", (F.col("_own") + F.col("_base") <= 0).cast("long"))
    counts = begun.groupBy("_file", "_split").agg(F.sum("_begins").alias("_sum"))
    counts = counts.select("_file", "_split", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_first"))
    up_to = Window.partitionBy("_file", "_split").orderBy("_line").rowsBetween(Window.unboundedPreceding, 0)
    numbered = begun.withColumn("_n", F.sum("_begins").over(up_to)).join(F.broadcast(counts), ["_file", "_split"]).withColumn("object", F.col("_first") + F.col("_n"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_split", "_line", "value"))), lambda x: x["value"]), "\n")
    found = numbered.groupBy("_file", "object").agg(text.alias("text"))
    return found.select(F.lit("").alias("stream") if together else F.col("_file").alias("stream"), "_file", "object", "text")


def _marked(value, at: str, pointers: list, blobs: list) -> None:
    if isinstance(value, dict):
        if POINTER in value:
            pointers.append({"at": at, "id": int(value[POINTER])})
        elif isinstance(value.get(BLOB), str):
            blobs.append({"at": at, "name": value[BLOB], "index": int(value.get(BLOB_INDEX, -1))})
        else:
            for k, v in value.items():
                _marked(v, f"{at}.{k}" if at else k, pointers, blobs)
    elif isinstance(value, list):
        for i, v in enumerate(value):
            _marked(v, f"{at}[{i}]", pointers, blobs)


def parsed(text: str) -> Iterator[tuple[str | None, dict | None, str | None]]:
    """(kind, fields, error) of each object of a text; what can't be read ends it."""
    text = _TEXT_OR_COMMENT.sub(lambda m: m[0] if m[0][0] == '"' else "", text)
    text = re.sub(r",(\s*,)*(?=\s*[\]}])", "", text) if re.search(r",\s*[,\]}]", _TEXT_OR_COMMENT.sub("", text)) else text
    at = 0
    while text[at:].strip():
        m = _HEAD.match(text, at)
        if not m:
            yield None, None, "no object begins here"
            return
        try:
            body, at = json.JSONDecoder(strict=False).raw_decode(text, m.end())
        except ValueError as e:
            yield m[1], None, f"the object can't be read: {e}"
            return
        yield m[1], body, None


def _objects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["stream", "object", "part", "kind", "id", "body", "pointers", "blobs", "error"]
    pointer = pa.list_(pa.struct([("at", pa.string()), ("id", pa.int64())]))
    blob = pa.list_(pa.struct([("at", pa.string()), ("name", pa.string()), ("index", pa.int64())]))
    types = [pa.string(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.string(), pointer, blob, pa.string()]
    for batch in batches:
        rows = []
        for stream, number, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for part, (kind, body, error) in enumerate(parsed(text)):
                pointers, blobs = [], []
                _marked(body, "", pointers, blobs)
                own = (body or {}).get(ID)
                rows.append((stream, number, part, kind, own if isinstance(own, int) else None, None if body is None else json.dumps(body, ensure_ascii=False), pointers, blobs, error))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)


def read_objects(spark: SparkSession, path: str, together: bool = False) -> DataFrame:
    """The objects of files, SCHEMA: body is the object as JSON text, pointers and blobs say where in it they stand. A
    stream is a file, or all files where `together` is set (as for a folder that write_objects wrote); ids are unique in it.
    (object, part) is the place in the file: part counts objects that begin on one line. An object that is cut off or that can't be
    read has an `error` and no body."""
    texts = grouped(spark, path, together)
    number = F.when(F.lit(together), F.xxhash64("_file", "object")).otherwise(F.col("object"))
    return texts.select("stream", number.alias("object"), "text").mapInArrow(_objects, SCHEMA)


def latest(objects: DataFrame) -> DataFrame:
    """One object for each id of a stream: the last in the file, which overwrites those before it."""
    place = Window.partitionBy("stream", "id").orderBy(F.desc("object"), F.desc("part"))
    return objects.where("id is not null and error is null").withColumn("_place", F.row_number().over(place)).where("_place = 1").drop("_place")


def references(objects: DataFrame) -> DataFrame:
    """One row for each pointer: stream, object, part, kind, id, at, target (id), target_kind, target_body, status. Status is
    found, null (a negative target) or dangling. The order of objects and the splits of the file don't matter."""
    asked = objects.where("error is null").select("stream", "object", "part", "kind", "id", F.explode("pointers").alias("_p")).select("stream", "object", "part", "kind", "id", F.col("_p.at").alias("at"), F.col("_p.id").alias("target"))
    held = latest(objects).select("stream", F.col("id").alias("target"), F.col("kind").alias("target_kind"), F.col("body").alias("target_body"))
    status = F.when(F.col("target") < 0, "null").when(F.col("target_body").isNull(), "dangling").otherwise("found")
    return asked.join(held, ["stream", "target"], "left").withColumn("status", status)


def blobs(objects: DataFrame, folder: str, size: int | None = None) -> DataFrame:
    """One row for each blob: stream, object, part, id, at, name, index, content. folder holds the files that names are
    relative to. Blobs with an index of 0 or more are the index-th piece of `size` bytes of a shared file; content is null
    where the file, or the piece, is not there."""
    spark = objects.sparkSession
    asked = objects.where("error is null").select("stream", "object", "part", "id", F.explode("blobs").alias("_b")).select("stream", "object", "part", "id", "_b.*")
    root = folder.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    files = files.select(F.expr(f"substr(regexp_replace(path, '^[a-z]+:/*', '/'), {len(re.sub('^[a-z]+:/*', '/', root)) + 2})").alias("name"), F.col("content").alias("_content"))
    piece = F.col("_content")
    if size:
        own = F.expr(f"substring(_content, int(index * {size}) + 1, {size})")
        piece = F.when(F.col("index") < 0, piece).when(F.octet_length(own) == size, own)
    return asked.join(files, "name", "left").withColumn("content", piece).drop("_content")


def write_objects(objects: DataFrame, folder: str) -> None:
    """Adds objects (kind, body: JSON text) to a folder as lines. The format has no escapes: quotes inside texts become
    apostrophes and control characters blanks."""
    body = F.regexp_replace(F.regexp_replace("body", r'\\"', "'"), r"\\[nrtbf]", " ")
    objects.select(F.concat(F.lit('"'), "kind", F.lit('" '), body).alias("value")).write.mode("append").text(folder)


def pointer(target):
    """A field that points to the object of this id; null points to nothing."""
    return F.struct(F.coalesce(target, F.lit(-1)).alias(POINTER))


#: What the numbers of a variable's status mean.
STATUS = {0: "active", 1: "non-active", 2: "fixed"}


def graph(objects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(variables, factors) of the objects of a factor graph. variable: stream, id, type, status, estimate. factor: stream, id,
    type, enabled, level, variables, measurement, information. A variable has an estimate, a factor has variables; others are left out."""
    schema = "graph_id long, status int, estimate array<double>, enabled int, level int, variables array<long>, measurement array<double>, information array<double>"
    rows = objects.where("error is null").select("stream", F.col("kind").alias("type"), F.from_json("body", schema).alias("b"))
    status = F.create_map(*[F.lit(x) for pair in STATUS.items() for x in pair])
    variables = rows.where("b.estimate is not null").select("stream", F.col("b.graph_id").alias("id"), "type", F.coalesce(status[F.col("b.status")], F.lit("active")).alias("status"), "b.estimate")
    factors = rows.where("b.variables is not null").select("stream", F.col("b.graph_id").alias("id"), "type", (F.coalesce("b.enabled", F.lit(1)) != 0).alias("enabled"), F.coalesce("b.level", F.lit(0)).alias("level"), "b.variables", "b.measurement", "b.information")
    return variables, factors


def graph_objects(variables: DataFrame, factors: DataFrame) -> DataFrame:
    """(kind, body) of a graph: variables (id, type, status, estimate), factors (id, type, enabled, level, variables, measurement,
    information), ready for write_objects. Objects are numbered by their hash, so #id is unique but not dense."""
    number = F.create_map(*[F.lit(x) for k, v in STATUS.items() for x in (v, k)])
    own = lambda name: F.abs(F.xxhash64(F.lit(name), "id")).alias(ID)
    v = variables.select(F.col("type").alias("kind"), F.to_json(F.struct(own("variable"), F.col("id").alias("graph_id"), number[F.col("status")].alias("status"), "estimate")).alias("body"))
    f = factors.select(F.col("type").alias("kind"), F.to_json(F.struct(own("factor"), F.col("id").alias("graph_id"), F.col("enabled").cast("int").alias("enabled"), "level", "variables", "measurement", "information")).alias("body"))
    return v.unionByName(f)
