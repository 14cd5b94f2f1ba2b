"""WARC archives: a deterministic sharded writer and a reader.

Writing: records are range-sorted by key, then by the payload's hash. A shard's border is the record before which the
payloads of that order sum up to a multiple of the shard size, so that shards are even in bytes (but for records of one
key and payload, which stay together) and depend on the rows alone and not on the cluster. Only keys, hashes and sizes
are ordered for that; the driver gets one border a shard (3 MB for 100 TB in shards of 256 MB). Each shard is a task of
its own and written in order; a file is rolled
when its compressed size reaches a limit, every record is a gzip member of its own, and headers and digests (SHA-1 of
block and payload, base32) are made anew from the payload. Records with equal payloads of at least ``min_revisit``
bytes become one response and revisits of it: only keys and digests are exchanged to find them, and the finding travels
to the payload as a row of its own that sorts right before it.

Commit: a task writes files of its own name under ``_temporary``; its output is the manifest of what it finished, so
files of lost or repeated attempts are in no manifest. The manifest is written as a table, and a second job renames
what it lists into place; a rename that was done before is left alone, so that job may be repeated, too. What stays
under ``_temporary`` is removed at the end, and ``_SUCCESS`` is written last.

Reading: one task a few files of the manifest; a record's digest is checked against its bytes, and payloads are handed
on only where they are asked for.

Files are opened through pyarrow.fs by URI, so the folder may be in any store that it knows (file, hdfs, s3, gs).

Nulls: a null payload is empty; a null url gives an empty target; null keys sort first and count as larger than others
when a response is chosen. Of rows that repeat key and payload the first is the response and the rest revisit it. An
empty table writes a manifest without files. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from lodegauge.sources import scratch

MANIFEST = "shard int, seq int, name string, temporary string, bytes long, records long, first_key long, last_key long, digest string"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary, intact boolean"
#: Borders up to which a row is placed by comparing it with each of them, beyond it by bisection.
FEW = 64
DATE = "2000-01-01T00:00:00Z"
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def store(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder's URI, and the path in it."""
    return fs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:/", "file:///", 1) if uri.startswith("file:") else f"file://{uri}")


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(key: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{key}/{digest}')}>"


def build_record(key: int | None, url: str, payload: bytes, digest: str, revisits: tuple[int | None] | None) -> bytes:
    """One record as bytes. revisits: (key of the response,) for a revisit, whose block ends after the HTTP header."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisits else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisits else 'response'}",
        f"WARC-Record-ID: {record_id(key, digest + ('/r' if revisits else ''))}", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {url.replace(chr(13), '').replace(chr(10), '')}", "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{sha1_base32(block)}",
        f"X-Key: {'' if key is None else key}", f"X-Payload-Length: {len(payload)}",
    ]
    if revisits:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {record_id(revisits[0], digest)}", f"X-Refers-To-Key: {'' if revisits[0] is None else revisits[0]}",
        ]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode("utf-8", "surrogateescape") + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes) -> bytes:
    """A gzip member without a time stamp, so that equal records are equal bytes."""
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


class _Roll:
    """The files of one shard, under temporary names."""

    def __init__(self, files: fs.FileSystem, folder: str, shard: int, limit: int):
        self.files, self.folder, self.shard, self.limit = files, folder, shard, limit
        self.seq, self.out, self.attempt = 0, None, uuid.uuid4().hex

    def put(self, key: int | None, member: bytes) -> dict | None:
        """Write a record; the manifest row of the file before, if this record began a new one."""
        done = None
        if self.out is not None and self.size + len(member) > self.limit:
            done = self.close()
        if self.out is None:
            self.name = f"shard-{self.shard:06d}-{self.seq:05d}.warc.gz"
            self.temporary = f"_temporary/{self.attempt}-{self.name}"
            self.out = self.files.open_output_stream(f"{self.folder}/{self.temporary}", compression=None)
            self.size, self.n, self.first, self.sum = 0, 0, key, hashlib.sha1()
        self.out.write(member)
        self.sum.update(member)
        self.size, self.n, self.last = self.size + len(member), self.n + 1, key
        return done

    def close(self) -> dict | None:
        if self.out is None:
            return None
        self.out.close()
        self.out, self.seq = None, self.seq + 1
        return {"shard": self.shard, "seq": self.seq - 1, "name": self.name, "temporary": self.temporary, "bytes": self.size, "records": self.n, "first_key": self.first, "last_key": self.last, "digest": self.sum.hexdigest()}


def _order(key: Column, digest: Column) -> Column:
    """A text that sorts as (key, digest) does, null keys first."""
    return F.concat(F.coalesce(F.lpad(F.hex(key.bitwiseXOR(F.lit(-(1 << 63)))), 16, "0"), F.lit("")), digest)


def _borders(keys: DataFrame, shard_bytes: int) -> list[str]:
    """The order of the first record of each shard after the first."""
    sums = keys.withColumn("order", _order(F.col("key"), F.col("hash"))).groupBy("order").agg(F.sum("size").alias("size"))
    part = scratch.written(sums.repartitionByRange("order").withColumn("part", F.spark_partition_id()), "warc-order")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    offsets = part.groupBy("part").agg(F.sum("size").alias("b")).select("part", F.coalesce(F.sum("b").over(earlier), F.lit(0)).alias("before"))
    within = Window.partitionBy("part").orderBy("order").rowsBetween(Window.unboundedPreceding, -1)
    placed = part.withColumn("own", F.coalesce(F.sum("size").over(within), F.lit(0))).join(scratch.lookup(scratch.written(offsets, "warc-offsets")), "part")
    shard = F.floor((F.col("own") + F.col("before")) / F.lit(shard_bytes))
    found = placed.groupBy(shard.alias("shard")).agg(F.min("order").alias("first")).where("shard > 0").select("first").collect()
    return sorted(r["first"] for r in found)


def write_archive(pages: DataFrame, folder: str, shard_bytes: int = 256 << 20, file_bytes: int = 1 << 30, min_revisit: int = 0) -> DataFrame:
    """Write pages (page_id, url, html) under the folder's URI; returns the manifest as it was written there."""
    spark = pages.sparkSession
    html = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long").alias("key"), F.coalesce("url", F.lit("")).alias("url"), html.alias("payload"), F.sha1(html).alias("hash"))
    keys = scratch.written(rows.select("key", "hash", F.octet_length("payload").cast("long").alias("size")), "warc-keys")
    same = keys.where(F.col("size") >= min_revisit).groupBy("hash", "size").agg(F.min("key").alias("response"), F.count("*").alias("n")).where("n > 1").drop("n")
    found = keys.join(same, ["hash", "size"]).select("key", "hash", F.col("response"), F.lit(0).alias("kind")).distinct()
    full = rows.withColumn("response", F.lit(None).cast("long")).withColumn("kind", F.lit(1))
    both = full.unionByName(found, allowMissingColumns=True)
    borders = _borders(keys, shard_bytes)
    both = both.withColumn("order", _order(F.col("key"), F.col("hash")))
    if len(borders) <= FEW:
        shard = F.size(F.filter(F.array(*map(F.lit, borders)).cast("array<string>"), lambda b: b <= F.col("order")))
        both = both.withColumn("shard", shard.cast("int"))
    else:
        both = _with_shards(both, borders)
    both = both.drop("order")
    dealt = both.repartitionById(len(borders) + 1, F.col("shard")).sortWithinPartitions("shard", F.col("key").asc_nulls_first(), "hash", "kind", "url")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = store(folder)
        files.create_dir(f"{root}/_temporary", recursive=True)
        schema = pa.schema([("shard", pa.int32()), ("seq", pa.int32()), ("name", pa.string()), ("temporary", pa.string()), ("bytes", pa.int64()), ("records", pa.int64()), ("first_key", pa.int64()), ("last_key", pa.int64()), ("digest", pa.string())])
        table = lambda row: pa.RecordBatch.from_pylist([row], schema)
        roll, known, answered = None, None, False
        for b in batches:
            c = {n: b.column(n) for n in ("shard", "key", "url", "payload", "hash", "response", "kind")}
            for i in range(b.num_rows):
                shard, key, hash_ = c["shard"][i].as_py(), c["key"][i].as_py(), c["hash"][i].as_py()
                if roll is None or roll.shard != shard:
                    if roll and (done := roll.close()):
                        yield table(done)
                    roll, known = _Roll(files, root, shard, file_bytes), None
                if c["kind"][i].as_py() == 0:
                    known, answered = (key, hash_, c["response"][i].as_py()), False
                    continue
                payload = c["payload"][i].as_py()
                revisits = None
                if known and known[:2] == (key, hash_):
                    if known[2] != key or answered:
                        revisits = (known[2],)
                    answered = True
                member = gzip_member(build_record(key, c["url"][i].as_py(), payload, sha1_base32(payload), revisits))
                if done := roll.put(key, member):
                    yield table(done)
        if roll and (done := roll.close()):
            yield table(done)

    manifest_path = f"{folder.rstrip('/')}/_manifest"
    dealt.select("shard", "key", "url", "payload", "hash", "response", "kind").mapInArrow(write, MANIFEST).write.parquet(manifest_path)
    manifest = spark.read.schema(MANIFEST).parquet(manifest_path)
    _commit(manifest, folder)
    return manifest


def _with_shards(rows: DataFrame, borders: list[str]) -> DataFrame:
    """Many borders are searched by bisection over Arrow batches."""
    known = rows.sparkSession.sparkContext.broadcast(borders)

    def f(batches):
        for b in batches:
            yield b.append_column("shard", pa.array([bisect.bisect_right(known.value, x) for x in b.column("order").to_pylist()], pa.int32()))

    return rows.mapInArrow(f, StructType([*rows.schema.fields, StructField("shard", IntegerType())]))


def _commit(manifest: DataFrame, folder: str) -> None:
    """Rename what the manifest lists into place, tidy up and mark the archive as whole."""

    def rename(batches):
        files, root = store(folder)
        for b in batches:
            for r in b.to_pylist():
                final = files.get_file_info(f"{root}/{r['name']}")
                if final.type == fs.FileType.NotFound:
                    try:
                        files.move(f"{root}/{r['temporary']}", f"{root}/{r['name']}")
                    except OSError:  # another attempt of this task may have just done it
                        if files.get_file_info(f"{root}/{r['name']}").type == fs.FileType.NotFound:
                            raise
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"])

    manifest.select("name", "temporary").mapInArrow(rename, "n long").agg(F.sum("n")).collect()
    files, root = store(folder)
    if files.get_file_info(f"{root}/_temporary").type != fs.FileType.NotFound:
        files.delete_dir(f"{root}/_temporary")
    files.create_dir(root, recursive=True)
    with files.open_output_stream(f"{root}/_SUCCESS") as f:
        f.write(b"")


def parse_records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of every record of a stream of gzip members, a member at a time."""
    inflate, raw, rest = zlib.decompressobj(31), bytearray(), b""
    while True:
        data = rest or stream.read(1 << 20)
        rest = b""
        if not data:
            break
        raw += inflate.decompress(data)
        if inflate.eof:
            rest, inflate = inflate.unused_data, zlib.decompressobj(31)
            head, _, block = bytes(raw).partition(b"\r\n\r\n")
            lines = head.decode("utf-8", "surrogateescape").split("\r\n")
            fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
            yield fields, block[: int(fields["Content-Length"])]
            raw = bytearray()


def read_archive(spark: SparkSession, folder: str, payload: bool = True) -> DataFrame:
    """The records of an archive, by its manifest: RECORDS. intact: the block's digest, and a response's payload digest
    and length, are those of the headers. payload: whether payloads are wanted, or null."""
    wanted = payload
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder.rstrip('/')}/_manifest").select("name")
    count = max(1, manifest.count())
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("intact", pa.bool_())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = store(folder)
        number = lambda v: int(v) if v else None
        for b in batches:
            for name in b.column(0).to_pylist():
                out, held = [], 0
                with files.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for h, block in parse_records(stream):
                        kind = h["WARC-Type"]
                        payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
                        digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
                        intact = h["WARC-Block-Digest"] == f"sha1:{sha1_base32(block)}"
                        if payload is not None:
                            intact = intact and digest == sha1_base32(payload) and len(payload) == int(h["X-Payload-Length"])
                        out.append({"page_id": number(h["X-Key"]), "url": h["WARC-Target-URI"], "payload_bytes": int(h["X-Payload-Length"]), "payload_digest": digest, "record_type": kind, "refers_to": number(h.get("X-Refers-To-Key")), "payload": payload if wanted else None, "intact": intact})
                        held += len(block) if wanted else 512
                        if held > 1 << 22:
                            yield pa.RecordBatch.from_pylist(out, schema)
                            out, held = [], 0
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema)

    return manifest.repartition(min(count, 1 << 16), "name").mapInArrow(read, RECORDS)
