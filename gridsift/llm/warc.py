"""Sharded WARC archives: the same input gives the same files, whatever tasks or executors were lost on the way.

Records are sorted by id in shards whose bounds follow from the data alone, each shard is rolled into files by its
compressed size, headers and digests are made anew, and files are written under temporary names. A manifest of the
attempts that Spark accepted is written first; only then the files get their final names, so a reader that goes by the
manifest never sees half a file or a file twice.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from gridsift.session import Scratch, remove

#: Fixed by the WARC 1.1 standard.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Buckets of the id range whose bytes are counted to bound the shards; at most so many rows reach the driver.
ID_BUCKETS = 8192
READ_BYTES = 1 << 20

MANIFEST = "file string, temporary string, shard long, records long, bytes long, sha1 string"
RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, date string, file string"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _place(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(folder)


def _clean(url: str | None) -> str:
    """A header value: without line ends, which would end it."""
    return "".join(" " if c in "\r\n" else c for c in url or "")


def _record(page_id, occurrence, url, payload: bytes, digest: str, leader, date: str) -> bytes:
    """One compressed record. A revisit keeps the HTTP header, which tells the length of the payload, and not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if leader is not None else http + payload
    name = f"urn:page:{'' if page_id is None else page_id}" + (f":{occurrence}" if occurrence else "")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if leader is None else 'revisit'}", f"WARC-Record-ID: <{name}>", f"WARC-Date: {date}",
             *([f"WARC-Target-URI: {_clean(url)}"] if url is not None else []), f"WARC-Payload-Digest: sha1:{digest}",
             f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
             *([f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{leader}>"] if leader is not None else []),
             "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


class _Files:
    """Files of one task: opened under temporary names and rolled by compressed size."""

    def __init__(self, folder: str, roll_bytes: int):
        self.fs, self.folder = _place(folder)
        self.roll_bytes, self.temporary = roll_bytes, f"_temporary/{uuid.uuid4().hex}"
        self.fs.create_dir(f"{self.folder}/{self.temporary}", recursive=True)
        self.shard, self.number, self.stream = None, 0, None
        self.rows: list[tuple] = []

    def add(self, shard: int, record: bytes) -> None:
        if shard != self.shard:
            self.close()
            self.shard, self.number = shard, 0
        elif self.stream is not None and self.size and self.size + len(record) > self.roll_bytes:
            self.close()
            self.number += 1
        if self.stream is None:
            self.file = f"part-{shard:06d}-{self.number:05d}.warc.gz"
            self.stream = self.fs.open_output_stream(f"{self.folder}/{self.temporary}/{self.file}", compression=None)
            self.size, self.count, self.sha = 0, 0, hashlib.sha1()
        self.stream.write(record)
        self.sha.update(record)
        self.size, self.count = self.size + len(record), self.count + 1

    def close(self) -> None:
        if self.stream is not None:
            self.stream.close()
            self.stream = None
            self.rows.append((self.file, f"{self.temporary}/{self.file}", self.shard, self.count, self.size, self.sha.hexdigest()))

    def manifest(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)],
                                          names=["file", "temporary", "shard", "records", "bytes", "sha1"])


def _shards(pages: DataFrame, shard_bytes: int) -> tuple[int, list[tuple[int, int]], int, int]:
    """(least id, [(bucket, shard)], ids per bucket, shards): contiguous id ranges of about equal payload bytes.

    Exact byte counts of at most ``ID_BUCKETS`` equal id ranges decide, so the result depends on the data only.
    """
    ends = pages.agg(F.min("page_id").alias("low"), F.max("page_id").alias("high")).head()
    if ends.low is None:
        return 0, [(0, 0)], 1, 1
    width = max(1, -(-(ends.high - ends.low + 1) // ID_BUCKETS))
    bucket = F.floor((F.coalesce("page_id", F.lit(ends.low)) - F.lit(ends.low)) / F.lit(width)).cast("long")
    counts = pages.groupBy(bucket.alias("bucket")).agg(F.sum("size").alias("size")).orderBy("bucket").collect()
    out, shard, filled = [], 0, 0
    for row in counts:
        if filled and filled + row["size"] > shard_bytes:
            shard, filled = shard + 1, 0
        out.append((row["bucket"], shard))
        filled += row["size"]
    return ends.low, out, width, shard + 1


def write_archives(pages: DataFrame, folder: str, *, min_revisit_bytes: int = 0, shard_bytes: int = 32 << 20, roll_bytes: int = 16 << 20,
                   date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write ``pages`` (page_id, url, html) as WARC files under ``folder``, a new folder that all executors reach; returns the manifest.

    A null html is an empty payload, a null url gives no target header. Of equal payloads of at least
    ``min_revisit_bytes`` bytes the smallest page_id is the response and all others are revisits of it; of repeated rows
    of one page_id the first is kept so. A null page_id comes first and is always a response. Other columns are not
    read. An empty table gives an empty manifest. ``html`` is shuffled once; the revisit marks, two numbers a row, travel
    beside the pages in the same sort, and no group is held in memory.
    """
    spark = pages.sparkSession
    texts = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    slim = texts.select("page_id", F.octet_length("html").cast("long").alias("size"), F.unhex(F.sha1("html")).alias("sha"))
    low, buckets, width, shards = _shards(slim, shard_bytes)
    of_bucket = spark.createDataFrame(buckets, "_bucket long, shard long")

    alike = slim.where(F.col("page_id").isNotNull() & (F.col("size") >= min_revisit_bytes))
    firsts = alike.groupBy("sha").agg(F.min("page_id").alias("leader"), F.max("page_id").alias("last")).where("leader < last").select("sha", "leader")
    marks = alike.join(firsts, "sha").where("page_id > leader").select("page_id", "sha", "leader").distinct()

    def dealt(df: DataFrame) -> DataFrame:
        own = F.floor((F.coalesce("page_id", F.lit(low)) - F.lit(low)) / F.lit(width)).cast("long")
        return df.withColumn("_bucket", own).join(F.broadcast(of_bucket), "_bucket").drop("_bucket")  # ID_BUCKETS rows at most

    rows = texts.select("page_id", F.unhex(F.sha1("html")).alias("sha"), F.lit(1).alias("kind"), "url", "html", F.lit(None).cast("long").alias("leader"))
    both = rows.unionByName(marks.select("page_id", "sha", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("url"),
                                         F.lit(None).cast("string").alias("html"), "leader"))
    ordered = dealt(both).repartitionById(shards, F.col("shard").cast("int")).sortWithinPartitions(
        "shard", F.col("page_id").asc_nulls_first(), "sha", "kind", "url")

    def write(batches):
        files, mark, before, occurrence, seen = None, None, None, 0, None
        for batch in batches:
            for page_id, sha, kind, url, html, leader, shard in zip(*[c.to_pylist() for c in batch.columns]):
                if not kind:
                    mark = (page_id, sha, leader)
                    continue
                payload = html.encode()
                own = leader = mark[2] if mark is not None and mark[:2] == (page_id, sha) else None
                if own is None and page_id is not None and before == (page_id, sha) and len(payload) >= min_revisit_bytes:
                    leader = page_id
                occurrence = occurrence + 1 if seen == (page_id,) else 0
                seen, before = (page_id,), (page_id, sha)
                files = files or _Files(folder, roll_bytes)
                files.add(shard, _record(page_id, occurrence, url, payload, base64.b32encode(sha).decode(), leader, date))
        if files is not None:
            files.close()
            yield files.manifest()

    with Scratch(spark) as scratch:
        # Written through Spark's committer: of a task that ran twice, only the rows of one attempt are in it.
        accepted = scratch.kept(ordered.mapInArrow(write, MANIFEST), "warc-accepted")

        def commit(batches):
            for batch in batches:
                fs, root = _place(folder)
                for file, temporary in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    if fs.get_file_info(f"{root}/{temporary}").type != pyarrow.fs.FileType.NotFound:  # else a repeated task did it
                        fs.move(f"{root}/{temporary}", f"{root}/{file}")
                yield batch

        accepted.mapInArrow(commit, MANIFEST).write.mode("overwrite").parquet(f"{folder}/manifest")
    remove(spark, f"{folder}/_temporary")
    return manifest(spark, folder)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").drop("temporary")


def _members(stream):
    """Uncompressed gzip members, one after the other."""
    data = stream.read(READ_BYTES)
    while data:
        unpacker, parts = zlib.decompressobj(31), []
        while True:
            parts.append(unpacker.decompress(data))
            if unpacker.eof:
                data = unpacker.unused_data or stream.read(READ_BYTES)
                break
            data = stream.read(READ_BYTES)
            if not data:
                raise ValueError("the file ends inside a record")
        yield b"".join(parts)


def _parsed(member: bytes) -> tuple[dict[str, str], int, bytes]:
    """(headers, payload length, payload) of one record; its digests are checked."""
    head, _, rest = member.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[:int(headers["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    said = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    if lines[0] != "WARC/1.1" or rest[len(block):] != b"\r\n\r\n" or headers["WARC-Block-Digest"] != f"sha1:{base32_sha1(block)}":
        raise ValueError("damaged record")
    if headers["WARC-Type"] == "response" and (len(payload) != said or headers["WARC-Payload-Digest"] != f"sha1:{base32_sha1(payload)}"):
        raise ValueError("payload and digest differ")
    return headers, said, payload


def read_archives(spark: SparkSession, folder: str, *, payload: bool = False) -> DataFrame:
    """Records of the files in the manifest: page_id, url, record_type, refers_to, payload_bytes, payload_digest, date, file
    and, if asked for, the payload of responses (null for revisits). Length and digest are those of the full payload, for
    revisits too. Damaged records are an error. One task reads one file at a time as a stream."""
    def number(urn: str):
        text = urn.strip("<>").split(":")[2]
        return int(text) if text else None

    def read(batches):
        fs, root = _place(folder)
        for batch in batches:
            for file in batch.column(0).to_pylist():
                rows, held = [], 0
                with fs.open_input_stream(f"{root}/{file}", compression=None) as stream:
                    for member in _members(stream):
                        headers, size, body = _parsed(member)
                        kind, refers = headers["WARC-Type"], headers.get("WARC-Refers-To")
                        rows.append((number(headers["WARC-Record-ID"]), headers.get("WARC-Target-URI"), kind, number(refers) if refers else None, size,
                                     headers["WARC-Payload-Digest"].removeprefix("sha1:"), headers["WARC-Date"], file,
                                     body if kind == "response" and payload else None))
                        held += len(body) if payload else 0
                        if len(rows) >= 10_000 or held > 16 << 20:
                            yield packed(rows)
                            rows, held = [], 0
                yield packed(rows)

    names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "date", "file"] + ["payload"] * payload
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()] + [pa.binary()] * payload

    def packed(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=names)

    files = manifest(spark, folder).select("file").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "file")
    return files.mapInArrow(read, RECORD + (", payload binary" if payload else ""))
