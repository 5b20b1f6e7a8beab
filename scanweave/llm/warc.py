"""Deterministic sharded WARC writer and reader (operator 5).

Records are range-sorted by page_id. The ranges, called shards, are cut at exact sums of payload bytes, so they depend on
the pages alone, neither on a sample nor on Spark's partitions. A shard is written into gzip files, one member a record,
and rolls to the next file when the compressed size is reached. Headers and digests are made anew from the payload. Files
get temporary names that hold the attempt; when all tasks are done, the driver gives the files of the winning attempts
their final names and then writes the manifest, without which a reader sees nothing. The same pages give the same bytes,
in files of the same names.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanweave.llm._scratch import keep, small_batches

MANIFEST = "manifest.json"
_SPACE = uuid.UUID("5f2f7f0e-3a57-5c42-9a3c-0c6f3f0f6a11")
RECORDS = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(page_id: int | None, payload_digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id} {payload_digest}')}>"


def record(page_id: int | None, url: str, payload: bytes, refers_to: int | None, is_revisit: bool, date: str) -> bytes:
    """One WARC/1.1 record. A revisit keeps the HTTP header of its page and leaves the payload to the record it refers to."""
    own = digest(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if is_revisit else http + payload
    clean = "".join(c for c in url if c > " " and c != "\x7f")
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if is_revisit else 'response'}", f"WARC-Record-ID: {_record_id(page_id, own)}", f"WARC-Date: {date}", f"WARC-Target-URI: {clean}"]
    lines += [] if page_id is None else [f"X-Page-ID: {page_id}"]
    if is_revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_record_id(refers_to, own)}"]
        lines += [] if refers_to is None else [f"X-Refers-To-Page-ID: {refers_to}"]
    lines += ["Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{own}", f"WARC-Block-Digest: sha1:{digest(block)}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _member(data: bytes, level: int) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)  # 31: a gzip header, without a time
    return z.compress(data) + z.flush()


def _filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    fs, path = pafs.FileSystem.from_uri(uri)
    return fs, path.rstrip("/")


def _qualified(spark: SparkSession, folder: str) -> str:
    """The folder with the scheme of its file system, so that every worker reaches the same one."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    uri = str(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString())
    return f"file://{uri[5:]}" if uri.startswith("file:/") and not uri.startswith("file://") else uri


def _roles(pages: DataFrame, min_bytes: int) -> DataFrame:
    """(page_id, sha1, refers_to) of the pages that revisit a page of the same payload with a larger page_id."""
    own = pages.select("page_id", F.sha1(F.encode("html", "UTF-8")).alias("sha1"), F.octet_length("html").alias("size")).where(F.col("size") >= min_bytes).drop("size")
    last = keep(own.groupBy("sha1").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 and refers_to is not null"), "warc-groups")
    # a payload that a thousandth of the pages share is no join key: there are fewer than a thousand of those
    hot = last.where(F.col("n") > F.lit(own.count() // 1000)).drop("n")
    cold = last.join(F.broadcast(hot.select("sha1")), "sha1", "left_anti").drop("n")
    found = own.join(F.broadcast(hot), "sha1").unionByName(own.join(F.broadcast(hot.select("sha1")), "sha1", "left_anti").join(cold, "sha1"))
    return found.where("page_id is null or page_id < refers_to").select("page_id", "sha1", "refers_to").distinct()


def shard_bounds(sizes: DataFrame, shard_bytes: int, most: int = 65_536, fan: int = 64) -> tuple[list[int], dict[int, int]]:
    """Lower ends of page_id ranges that hold about shard_bytes each, and the parts into which single heavy ids are cut.

    sizes has page_id (not null) and bytes. Ranges are split evenly, again and again where one holds too much, then summed
    from the left; the sums are exact, so equal tables give equal bounds. At most about `most` shards, hence about 4 * most
    numbers, reach the driver, and the bytes of a shard grow beyond that.
    """
    low, high, total = sizes.agg(F.min("page_id"), F.max("page_id"), F.sum("bytes")).first()
    if total is None:
        return [], {}
    target = max(shard_bytes, -(-total // most))
    settled: list[tuple[int, int, int]] = []  # low, high, bytes
    todo = [(low, high, total)]
    first = True
    while todo:
        parts = max(fan, min(4 * most, 4 * -(-total // target))) if first else fan
        ranges = [(lo, hi, -(-(hi - lo + 1) // parts)) for lo, hi, _ in sorted(todo)]
        first = False
        lows = np.array([r[0] for r in ranges], np.int64)
        highs, steps = np.array([r[1] for r in ranges], np.int64), np.array([r[2] for r in ranges], np.uint64)

        def cells(batches: Iterator[pa.RecordBatch], lows=lows, highs=highs, steps=steps) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, size = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
                at = np.searchsorted(lows, ids, "right") - 1
                ok = (at >= 0) & (ids <= highs[at])
                at, ids, size = at[ok], ids[ok], size[ok]
                cell = (ids.view(np.uint64) - lows[at].view(np.uint64)) // steps[at]
                keys, inverse = np.unique(np.stack([at.astype(np.int64), cell.astype(np.int64)]), axis=1, return_inverse=True)
                sums = np.zeros(keys.shape[1], np.int64)
                np.add.at(sums, inverse.ravel(), size)
                yield pa.RecordBatch.from_arrays([pa.array(keys[0]), pa.array(keys[1]), pa.array(sums)], names=["at", "cell", "bytes"])

        found = sizes.select("page_id", "bytes").mapInArrow(cells, "at long, cell long, bytes long").groupBy("at", "cell").agg(F.sum("bytes").alias("bytes")).collect()  # at most 4 * most cells
        todo = []
        for at, cell, size in found:
            lo, hi, step = ranges[at]
            own = lo + cell * step, min(hi, lo + (cell + 1) * step - 1), size
            (todo if size > target and own[0] < own[1] else settled).append(own)
    bounds, parts, held = [], {}, 0
    for lo, _, size in sorted(settled):
        if not bounds or held + size > target:
            bounds, held = [*bounds, lo], 0
        held += size
        if size > target:
            parts[lo] = -(-size // target)
    return bounds, parts


def write(pages: DataFrame, folder: str, min_bytes: int = 0, roll_bytes: int = 64 << 20, level: int = 5, date: str = "2024-01-01T00:00:00Z", shard_bytes: int = 8 << 20) -> list[str]:
    """Writes pages (page_id, url, html) to a new folder that all executors share, and gives the names of its files.

    Of payloads that are equal and at least min_bytes long, the one of the largest page_id is a response and the others
    revisit it. Null html: empty payload. Null page_id: sorts first, refers but is not referred to, unless no page of the
    group has an id. Repeated rows of the largest page_id are all responses. A shard holds about shard_bytes of payload; an
    id (or the null id) with more rows than that is cut into several by a hash of url and payload. A long payload is held
    once with its record and its compressed form. An empty table gives a manifest without files. A folder that has a manifest
    is refused. Other columns are not read, whatever their names.
    """
    folder = _qualified(pages.sparkSession, folder)
    fs, root = _filesystem(folder)
    if fs.get_file_info(f"{root}/{MANIFEST}").type != pafs.FileType.NotFound:
        raise FileExistsError(f"{folder} holds an archive")
    pages = small_batches(pages).select(F.col("page_id").cast("long"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    sizes = keep(pages.select("page_id", (F.octet_length("html") + F.octet_length("url") + F.lit(512)).cast("long").alias("bytes")), "warc-sizes")
    bounds, parts = shard_bounds(sizes.where("page_id is not null"), shard_bytes)
    alone = sizes.where("page_id is null").agg(F.sum("bytes")).first()[0] or 0  # the null id comes before all ranges
    lows, widths = np.array(bounds, np.int64), np.array([max(1, -(-alone // shard_bytes)), *(parts.get(x, 1) for x in bounds)], np.int64)
    starts = np.cumsum(widths) - widths

    def looked_up(values: np.ndarray):
        def run(ids: pa.Array) -> pa.Array:
            at = np.searchsorted(lows, ids.fill_null(0).to_numpy(zero_copy_only=False), "right")
            at[ids.is_null().to_numpy(zero_copy_only=False)] = 0
            return pa.array(values[at])

        return F.arrow_udf(run, "long")("page_id")

    def sharded(df: DataFrame) -> DataFrame:
        return df.withColumn("start", looked_up(starts)).withColumn("width", looked_up(widths) if widths.max() > 1 else F.lit(1).cast("long"))

    own = F.col("start") + F.pmod(F.xxhash64("url", "html"), F.col("width"))
    rows = sharded(pages).select(own.alias("shard"), "page_id", F.lit(1).alias("kind"), "url", "html", F.lit(None).cast("long").alias("refers_to"))
    each = F.explode(F.sequence(F.col("start"), F.col("start") + F.col("width") - 1))
    roles = sharded(_roles(pages, min_bytes)).select(each.alias("shard"), "page_id", F.lit(0).alias("kind"), F.col("sha1").alias("url"), F.lit(None).cast("string").alias("html"), "refers_to")
    # the roles travel with their pages, so that the payloads are shuffled once
    both = roles.unionByName(rows).repartition("shard").sortWithinPartitions("shard", "page_id", "kind", "url", "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _filesystem(folder)
        fs.create_dir(root, recursive=True)
        shard, attempt = -1, uuid.uuid4().hex[:12]
        out, sink, size, n, sha, temporary, roll = [], None, 0, 0, None, "", 0
        page, refers = object(), {}

        def close() -> None:
            nonlocal sink, roll
            sink.close()
            out.append((f"pages-{shard:06d}-{roll:05d}.warc.gz", temporary, n, size, sha.hexdigest()))
            sink, roll = None, roll + 1

        for batch in batches:
            for of, page_id, kind, url, html, to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if of != shard:
                    if sink is not None:
                        close()
                    shard, roll, page, refers = of, 0, object(), {}
                if page_id != page:
                    page, refers = page_id, {}
                if kind == 0:
                    refers[url] = to
                    continue
                payload = html.encode("utf-8")
                sha1 = hashlib.sha1(payload).hexdigest()
                data = _member(record(page_id, url, payload, refers.get(sha1), sha1 in refers, date), level)
                if sink is None:
                    temporary, size, n, sha = f".tmp-{shard:06d}-{roll:05d}-{attempt}", 0, 0, hashlib.sha256()
                    sink = fs.open_output_stream(f"{root}/{temporary}")
                sink.write(data)
                sha.update(data)
                size, n = size + len(data), n + 1
                if size >= roll_bytes:
                    close()
        if sink is not None:
            close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], names=["file", "temporary", "records", "bytes", "sha256"])

    files = sorted(both.mapInArrow(run, "file string, temporary string, records long, bytes long, sha256 string").collect())  # one row a file
    fs.create_dir(root, recursive=True)
    for f in files:
        fs.move(f"{root}/{f['temporary']}", f"{root}/{f['file']}")
    for left in fs.get_file_info(pafs.FileSelector(root)):  # of attempts that were lost
        if left.base_name.startswith(".tmp-"):
            fs.delete_file(left.path)
    manifest = {"files": [{k: f[k] for k in ("file", "records", "bytes", "sha256")} for f in files]}
    with fs.open_output_stream(f"{root}/.{MANIFEST}") as sink:
        sink.write(json.dumps(manifest, indent=1).encode())
    fs.move(f"{root}/.{MANIFEST}", f"{root}/{MANIFEST}")
    return [f["file"] for f in files]


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (by lower-case name) and block of each record in a stream of gzip members."""
    held, z, plain = b"", None, bytearray()
    while True:
        if not held:
            held = stream.read(1 << 20)
            if not held:
                break
        z = z or zlib.decompressobj(31)
        plain += z.decompress(held)
        held = z.unused_data
        if z.eof:
            z = None
            head, _, rest = bytes(plain).partition(b"\r\n\r\n")
            lines = head.decode("utf-8").split("\r\n")
            if not lines[0].startswith("WARC/"):
                raise ValueError("not a WARC record")
            headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
            size = int(headers["content-length"])
            if rest[size:] != b"\r\n\r\n":
                raise ValueError("a record's length differs from its header")
            yield headers, rest[:size]
            plain = bytearray()
    if z is not None or plain:
        raise ValueError("the last record is cut off")


def read(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """RECORDS of the files that the manifest names, checked against their digests. A revisit has no payload."""
    folder = _qualified(spark, folder)
    fs, root = _filesystem(folder)
    with fs.open_input_stream(f"{root}/{MANIFEST}") as source:
        files = json.loads(source.read())["files"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _filesystem(folder)
        number = lambda x: None if x is None else int(x)
        names = [x.split()[0] for x in RECORDS.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
        for batch in batches:
            for name in batch.column(0).to_pylist():
                out, held = [], 0
                with fs.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for headers, block in records(stream):
                        own = headers["warc-payload-digest"].removeprefix("sha1:")
                        if digest(block) != headers["warc-block-digest"].removeprefix("sha1:"):
                            raise ValueError(f"{name}: a block's digest differs")
                        http, _, payload = block.partition(b"\r\n\r\n")
                        fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in http.decode("utf-8").split("\r\n")[1:])}
                        kind = headers["warc-type"]
                        if kind == "response" and digest(payload) != own:
                            raise ValueError(f"{name}: a payload's digest differs")
                        out.append((number(headers.get("x-page-id")), headers["warc-target-uri"], kind, int(fields["content-length"]), own, number(headers.get("x-refers-to-page-id")), payload if payloads and kind == "response" else None))
                        held += len(payload) if payloads else 200
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], names=names)
                            out, held = [], 0
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], names=names)

    paths = spark.createDataFrame([(f["file"],) for f in files], "file string")
    return paths.repartition(max(1, min(len(files), 10_000)), "file").mapInArrow(run, RECORDS)
