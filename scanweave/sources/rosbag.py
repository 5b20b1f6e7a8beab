"""Recorder files (bags, format 2.0) as a data source that Spark plans, prunes and splits.

A bag holds chunks of messages, compressed or not, and at its end the connections (topic, type, definition) and for each
chunk its times and how many messages of each connection it has. The source reads that end on the driver, leaves out the
chunks that filters on topic, type and time rule out, and makes one partition of each run of neighbouring chunks. A bag
without that end, because recording broke off, is walked from its beginning by one task, as only its chunks say what their
connections are; what is cut off is reported in a row with `damage`, and nothing before it is lost.
"""

from __future__ import annotations

import bz2
import os
import struct
import uuid
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from fnmatch import fnmatch
from urllib.parse import urlparse

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, WriterCommitMessage

from scanweave.sources import rosmsg

#: The first line, and the kinds of records.
MAGIC = b"#ROSBAG V2.0\n"
MESSAGE, BAG, INDEX, CHUNK, CHUNK_INFO, CONNECTION = 2, 3, 4, 5, 6, 7
SCHEMA = "path string, chunk long, topic string, type string, t long, definition string, payload binary, damage string"
#: Bytes of chunks in one partition; bytes of a chunk and of a bag that are written.
SPLIT_BYTES, CHUNK_BYTES, BAG_BYTES = 64 << 20, 768 << 10, 64 << 20
_SECOND = 1_000_000_000


class CutOff(Exception):
    """A file ends inside a record."""


#: What reading damaged records raises.
DAMAGE = (CutOff, OSError, KeyError, ValueError, IndexError, struct.error, pa.ArrowException)


def open_path(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI or of a plain path, and the path there."""
    if urlparse(path).scheme:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), os.path.abspath(path)


def _files(path: str) -> list[str]:
    """Full names of a file, of the bags of a folder, or of those that a pattern in the last part names."""
    system, inner = open_path(path)
    prefix = path[: len(path) - len(inner)] if path.endswith(inner) else ""
    folder, _, name = inner.rpartition("/")
    if any(c in name for c in "*?["):
        return sorted(prefix + f.path for f in system.get_file_info(fs.FileSelector(folder)) if fnmatch(f.base_name, name))
    if system.get_file_info(inner).type == fs.FileType.Directory:
        return sorted(prefix + f.path for f in system.get_file_info(fs.FileSelector(inner)) if f.base_name.endswith(".bag"))
    return [path]


def _fields(header: bytes) -> dict[str, bytes]:
    out, at = {}, 0
    while at < len(header):
        (n,) = struct.unpack_from("<I", header, at)
        name, _, value = header[at + 4 : at + 4 + n].partition(b"=")
        out[name.decode("latin-1")] = value
        at += 4 + n
    return out


def _number(value: bytes) -> int:
    return int.from_bytes(value, "little")


def _time(value: bytes) -> int:
    return _number(value[:4]) * _SECOND + _number(value[4:8])


def _exactly(file, n: int) -> bytes:
    data = file.read(n)
    if len(data) < n:
        raise CutOff
    return data


def _header(file) -> tuple[dict[str, bytes], int]:
    """The next record's header and the size of its data, at which the file then stands; a clean end raises EOFError."""
    size = file.read(4)
    if not size:
        raise EOFError
    if len(size) < 4:
        raise CutOff
    try:
        found = _fields(_exactly(file, _number(size)))
    except struct.error:
        raise CutOff from None
    return found, _number(_exactly(file, 4))


def _records(data: bytes) -> Iterator[tuple[dict[str, bytes], bytes]]:
    """The records inside a chunk."""
    at = 0
    while at + 4 <= len(data):
        (n,) = struct.unpack_from("<I", data, at)
        if at + 8 + n > len(data):
            raise CutOff
        header = _fields(data[at + 4 : at + 4 + n])
        (size,) = struct.unpack_from("<I", data, at + 4 + n)
        at += 8 + n
        if at + size > len(data):
            raise CutOff
        yield header, data[at : at + size]
        at += size


def _plain(header: dict[str, bytes], data: bytes) -> bytes:
    how = header["compression"].decode("latin-1")
    if how == "none":
        return data
    if how == "bz2":
        return bz2.decompress(data)
    if how == "lz4":
        return pa.decompress(data, decompressed_size=_number(header["size"]), codec="lz4", asbytes=True)
    raise ValueError(f"chunk compression {how} is not known")


@dataclass
class Connection:
    topic: str
    type: str
    definition: str

    @classmethod
    def of(cls, header: dict[str, bytes], data: bytes) -> Connection:
        own = _fields(data)
        return cls(header["topic"].decode(), own.get("type", b"").decode(), own.get("message_definition", b"").decode("utf-8", "replace"))


@dataclass
class Chunk:
    at: int
    first: int
    last: int
    counts: dict[int, int]


@dataclass
class Contents:
    """What the end of a bag says; None where a bag has no such end."""

    connections: dict[int, Connection] = field(default_factory=dict)
    chunks: list[Chunk] = field(default_factory=list)


def contents(path: str) -> Contents | None:
    system, inner = open_path(path)
    with system.open_input_file(inner) as file:
        size = file.size()
        if file.read(len(MAGIC)) != MAGIC:
            raise ValueError(f"{path} is no bag of format 2.0")
        try:
            header, _ = _header(file)
            at = _number(header["index_pos"])
            wanted = _number(header["chunk_count"]), _number(header["conn_count"])
            if not len(MAGIC) < at < size:
                return None
            file.seek(at)
            out = Contents()
            while True:
                header, n = _header(file)
                data = _exactly(file, n)
                if _number(header["op"]) == CONNECTION:
                    out.connections[_number(header["conn"])] = Connection.of(header, data)
                elif _number(header["op"]) == CHUNK_INFO:
                    pairs = struct.iter_unpack("<II", data)
                    out.chunks.append(Chunk(_number(header["chunk_pos"]), _time(header["start_time"]), _time(header["end_time"]), dict(pairs)))
        except EOFError:
            return out if (len(out.chunks), len(out.connections)) == wanted else None
        except (CutOff, KeyError, struct.error):
            return None


@dataclass
class Wanted:
    """What filters leave: topics, types (None: all) and times, both ends included."""

    topics: frozenset | None = None
    types: frozenset | None = None
    first: int = -(1 << 63)
    last: int = (1 << 63) - 1

    def has(self, c: Connection) -> bool:
        return (self.topics is None or c.topic in self.topics) and (self.types is None or c.type in self.types)

    def at(self, t: int) -> bool:
        return self.first <= t <= self.last


@dataclass
class Run(InputPartition):
    """Chunks of a bag, by their places; none: the whole bag, from its beginning."""

    path: str
    chunks: list[int]
    connections: dict[int, Connection]


class BagReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.split = options["path"], int(options.get("split_bytes", SPLIT_BYTES))
        self.wanted, self.whole = Wanted(), True

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        w = self.wanted
        for f in filters:
            name = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if name in ("topic", "type") and isinstance(f, EqualTo | In):
                own = frozenset([f.value] if isinstance(f, EqualTo) else f.value)
                held = w.topics if name == "topic" else w.types
                own = own if held is None else own & held
                w.topics, w.types = (own, w.types) if name == "topic" else (w.topics, own)
            elif name == "t" and isinstance(f, EqualTo):
                w.first, w.last = max(w.first, f.value), min(w.last, f.value)
            elif name == "t" and isinstance(f, GreaterThan | GreaterThanOrEqual):
                w.first = max(w.first, f.value + isinstance(f, GreaterThan))
            elif name == "t" and isinstance(f, LessThan | LessThanOrEqual):
                w.last = min(w.last, f.value - isinstance(f, LessThan))
            elif not (name in ("topic", "type", "t", "definition", "payload") and isinstance(f, IsNotNull)):
                yield f
                continue
            self.whole = False

    def partitions(self) -> list[Run]:
        out = []
        for path in _files(self.path):
            found = contents(path)
            if found is None:
                out.append(Run(path, [], {}))
                continue
            own = {k: c for k, c in found.connections.items() if self.wanted.has(c)}
            chunks = sorted(found.chunks, key=lambda c: c.at)
            ends = [c.at for c in chunks[1:]] + [chunks[-1].at if chunks else 0]
            run, size = [], 0
            for c, end in zip(chunks, ends, strict=True):
                if not any(c.counts.get(k) for k in own) or c.first > self.wanted.last or c.last < self.wanted.first:
                    continue
                run.append(c.at)
                size += end - c.at
                if size >= self.split:
                    out.append(Run(path, run, own))
                    run, size = [], 0
            if run:
                out.append(Run(path, run, own))
        return out or [Run("", [], {})]

    def read(self, partition: Run) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        for row in self._rows(partition):
            rows.append(row)
            held += len(row[6] or b"")
            if held >= 4 << 20 or len(rows) >= 2000:
                yield _batch(rows)
                rows, held = [], 0
        if rows:
            yield _batch(rows)

    def _rows(self, run: Run) -> Iterator[tuple]:
        if not run.path:
            return
        system, inner = open_path(run.path)
        with system.open_input_file(inner) as file:
            if run.chunks:
                for at in run.chunks:
                    file.seek(at)
                    try:
                        header, n = _header(file)
                        yield from self._chunk(run.path, at, _plain(header, _exactly(file, n)), run.connections)
                    except DAMAGE as e:
                        yield from self._damage(run.path, at, str(e) or "the file ends inside the chunk")
                return
            connections: dict[int, Connection] = {}
            at = len(MAGIC)
            try:
                while True:
                    file.seek(at)
                    header, n = _header(file)
                    op = _number(header["op"])
                    if op == CHUNK:
                        data = _plain(header, _exactly(file, n))
                        yield from self._chunk(run.path, at, data, connections, learn=True)
                    elif op == CONNECTION:
                        connections[_number(header["conn"])] = Connection.of(header, _exactly(file, n))
                    at += 8 + sum(4 + len(k) + 1 + len(v) for k, v in header.items()) + n
            except EOFError:
                yield from self._damage(run.path, at, "the bag has no index")
            except DAMAGE as e:
                yield from self._damage(run.path, at, str(e) or "the file ends inside a record")

    def _chunk(self, path: str, at: int, data: bytes, connections: dict[int, Connection], learn: bool = False) -> Iterator[tuple]:
        for header, own in _records(data):
            op = _number(header["op"])
            if op == CONNECTION and learn:
                connections[_number(header["conn"])] = Connection.of(header, own)
            elif op == MESSAGE:
                c, t = connections.get(_number(header["conn"])), _time(header["time"])
                if c and self.wanted.has(c) and self.wanted.at(t):
                    yield path, at, c.topic, c.type, t, c.definition, own, None

    def _damage(self, path: str, at: int, what: str) -> Iterator[tuple]:
        if self.whole:  # a row without topic, type and time passes no filter on them
            yield path, at, None, None, None, None, None, f"{what}, at byte {at}"


_ARROW = pa.schema([("path", pa.string()), ("chunk", pa.int64()), ("topic", pa.string()), ("type", pa.string()), ("t", pa.int64()), ("definition", pa.string()), ("payload", pa.binary()), ("damage", pa.string())])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


def _packed(header: dict[str, bytes], data: bytes) -> bytes:
    own = b"".join(struct.pack("<I", len(k) + 1 + len(v)) + k.encode() + b"=" + v for k, v in header.items())
    return struct.pack("<I", len(own)) + own + struct.pack("<I", len(data)) + data


def _u4(*v: int) -> bytes:
    return struct.pack(f"<{len(v)}I", *v)


def _op(op: int) -> bytes:
    return bytes([op])


class BagBuilder:
    """One bag in memory, until its bytes are asked for."""

    def __init__(self, compression: str = "none", chunk_bytes: int = CHUNK_BYTES):
        self.compression, self.chunk_bytes = compression, chunk_bytes
        self.connections: dict[tuple, int] = {}
        self.records: list[bytes] = []
        self.body: list[bytes] = []  # of chunks and their indices
        self.infos: list[bytes] = []
        self.size = 0
        self._new()

    def _new(self) -> None:
        self.own, self.own_size, self.index = [], 0, defaultdict(list)

    def add(self, topic: str, kind: str, t: int, definition: str | None, payload: bytes) -> None:
        key = topic, kind, definition
        if key not in self.connections:
            text = definition if definition is not None else rosmsg.full_text(kind)
            held = {"topic": topic.encode(), "type": kind.encode(), "md5sum": rosmsg.digest(kind, rosmsg.known(text, kind)).encode(), "message_definition": text.encode()}
            data = b"".join(struct.pack("<I", len(k) + 1 + len(v)) + k.encode() + b"=" + v for k, v in held.items())
            number = self.connections[key] = len(self.connections)
            self.records.append(_packed({"op": _op(CONNECTION), "conn": _u4(number), "topic": topic.encode()}, data))
            self._put(self.records[-1])
        number = self.connections[key]
        time = _u4(*divmod(t, _SECOND))
        self.index[number].append((t, self.own_size))
        self._put(_packed({"op": _op(MESSAGE), "conn": _u4(number), "time": time}, payload))
        if self.own_size >= self.chunk_bytes:
            self.flush()

    def _put(self, data: bytes) -> None:
        self.own.append(data)
        self.own_size += len(data)

    def flush(self) -> None:
        if not self.index:
            return
        data = b"".join(self.own)
        packed = {"none": lambda: data, "bz2": lambda: bz2.compress(data), "lz4": lambda: pa.compress(data, codec="lz4", asbytes=True)}[self.compression]()
        chunk = _packed({"op": _op(CHUNK), "compression": self.compression.encode(), "size": _u4(len(data))}, packed)
        times = [t for v in self.index.values() for t, _ in v]
        stamp = lambda t: _u4(*divmod(t, _SECOND))
        counts = b"".join(_u4(k, len(v)) for k, v in self.index.items())
        at = len(MAGIC) + 4096 + self.size
        self.infos.append(_packed({"op": _op(CHUNK_INFO), "ver": _u4(1), "chunk_pos": struct.pack("<Q", at), "start_time": stamp(min(times)), "end_time": stamp(max(times)), "count": _u4(len(self.index))}, counts))
        indices = [_packed({"op": _op(INDEX), "ver": _u4(1), "conn": _u4(k), "count": _u4(len(v))}, b"".join(stamp(t) + _u4(o) for t, o in v)) for k, v in self.index.items()]
        self.body += [chunk, *indices]
        self.size += len(chunk) + sum(map(len, indices))
        self._new()

    def bytes(self) -> bytes:
        self.flush()
        head = lambda pad: _packed({"op": _op(BAG), "index_pos": struct.pack("<Q", len(MAGIC) + 4096 + self.size), "conn_count": _u4(len(self.connections)), "chunk_count": _u4(len(self.infos))}, b" " * pad)
        return b"".join([MAGIC, head(4096 - len(head(0))), *self.body, *self.records, *self.infos])


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class BagWriter(DataSourceArrowWriter):
    """Each task writes bags of about BAG_BYTES, in the order of its rows, under temporary names; a commit gives them theirs."""

    def __init__(self, options: dict[str, str]):
        self.folder = options["path"].rstrip("/")
        self.compression = options.get("compression", "lz4")
        self.bag_bytes, self.chunk_bytes = int(options.get("bag_bytes", BAG_BYTES)), int(options.get("chunk_bytes", CHUNK_BYTES))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, folder = open_path(self.folder)
        system.create_dir(folder, recursive=True)
        names: list[str] = []

        def close(bag: BagBuilder) -> None:
            data = bag.bytes()
            if bag.connections:
                names.append(f"{uuid.uuid4().hex}.bag")
                with system.open_output_stream(f"{folder}/.{names[-1]}.writing") as f:
                    f.write(data)

        bag = BagBuilder(self.compression, self.chunk_bytes)
        for batch in iterator:
            held = batch.schema.names
            columns = [batch.column(held.index(c)).to_pylist() for c in ("topic", "type", "t")] + [batch.column(held.index("definition")).to_pylist() if "definition" in held else [None] * batch.num_rows]
            payloads = batch.column(held.index("payload"))
            for topic, kind, t, definition, payload in zip(*columns, payloads, strict=True):
                data = payload.as_py()
                if topic is None or kind is None or t is None or data is None:
                    raise ValueError("a message needs topic, type, t and payload")
                bag.add(topic, kind, t, definition, data)
                if bag.size + bag.own_size >= self.bag_bytes:
                    close(bag)
                    bag = BagBuilder(self.compression, self.chunk_bytes)
        close(bag)
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        system, folder = open_path(self.folder)
        for m in messages:
            for name in m.names if m else ():
                system.move(f"{folder}/.{name}.writing", f"{folder}/{name}")

    def abort(self, messages: list[Written | None]) -> None:
        system, folder = open_path(self.folder)
        for m in messages:
            for name in m.names if m else ():
                system.delete_file(f"{folder}/.{name}.writing")


class BagSource(DataSource):
    """spark.read.format("bag").load(path): a file, a folder, or a pattern; options split_bytes. Writing: topic, type, t,
    payload, definition (optional where the kind is known); options compression (none, bz2, lz4), bag_bytes, chunk_bytes."""

    @classmethod
    def name(cls) -> str:
        return "bag"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BagReader:
        return BagReader(self.options)

    def writer(self, schema, overwrite: bool) -> BagWriter:
        return BagWriter(self.options)


def _ready(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(BagSource)
    return spark


def read_bags(spark: SparkSession, path: str, **options) -> DataFrame:
    """Messages of bags, SCHEMA; filters on topic, type and t reach the chunk index. Rows with `damage` say where a bag was cut
    off; they have no topic."""
    return _ready(spark).read.format("bag").options(**options).load(path)


def write_bags(messages: DataFrame, folder: str, **options) -> None:
    """Adds bags of messages (topic, type, t in nanoseconds, payload, optionally definition) to a folder, a few for each task;
    range-partition and sort messages by t for bags that follow each other."""
    _ready(messages.sparkSession)
    messages.write.format("bag").mode("append").options(**options).save(folder)


def topics(spark: SparkSession, path: str) -> DataFrame:
    """(path, topic, type, messages, first, last) from the chunk indices alone, no chunk is read; bags without index are left out.
    The times are those of the chunks that hold the topic."""
    rows = []
    for name in _files(path):
        found = contents(name) or Contents()
        for k, c in found.connections.items():
            own = [x for x in found.chunks if x.counts.get(k)]
            rows.append((name, c.topic, c.type, sum(x.counts[k] for x in own), min((x.first for x in own), default=None), max((x.last for x in own), default=None)))
    return spark.createDataFrame(rows, "path string, topic string, type string, messages long, first long, last long")
