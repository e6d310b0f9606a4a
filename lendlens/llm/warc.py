"""A deterministic, sharded WARC writer and its reader.

Records are sorted by id ranges; each range is written by one task into files
that roll when their compressed size passes a limit. Headers and digests are
made anew from the payload, so the same pages always give the same bytes. A file is
written under a temporary name and renamed when it is whole; a manifest, written
by Spark when all tasks are done, lists the files that count. A task that
runs again writes the same files again, and files of no manifest are ignored.

Of records with equal payloads the largest id is the response, others are
revisits without a payload. Which ones is found on (id, digest) alone; payloads
are shuffled once, by range, and meet their mark there.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lendlens.llm.common import prepare
from lendlens.operators.cache import checkpoint_folder

LEAST_BYTES = 1000  # smaller payloads are never revisits
ROLL_BYTES = 16 << 20  # compressed size at which a file ends
DATE = "2024-01-01T00:00:00Z"  # of all records: a parameter, so that files repeat
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the namespace of URLs


def _digest(payload: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(key: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, 'page:' + key)}>"


def _record(key: str, url: str | None, payload: bytes, refers_to: str | None, date: str) -> bytes:
    """One record as a gzip member. Null urls give an empty target."""
    digest = _digest(payload)
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Target-URI: {target}",
        f"WARC-Date: {date}", f"WARC-Record-ID: {_record_id(key)}", f"X-Page-ID: {key}",
        f"WARC-Payload-Digest: {digest}", f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: {_record_id(refers_to)}", f"X-Refers-To-Page: {refers_to}", f"WARC-Profile: {PROFILE}"]
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if refers_to is None:
        block += payload
    head += [f"WARC-Block-Digest: {_digest(block)}", f"Content-Length: {len(block)}"]
    raw = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    out = io.BytesIO()
    with gzip.GzipFile(fileobj=out, mode="wb", compresslevel=6, mtime=0, filename="") as member:
        member.write(raw)
    return out.getvalue()


class _Files:
    """Files of one range: temporary until whole, then renamed."""

    def __init__(self, folder: str, part: int, roll_bytes: int):
        self.fs, self.folder = pafs.FileSystem.from_uri(folder)
        self.part, self.roll_bytes, self.number = part, roll_bytes, 0
        self.stream = None

    def add(self, record: bytes) -> Iterator[tuple[str, int, int, str]]:
        if self.stream is None:
            self.name = f"part-{self.part:06d}-{self.number:06d}.warc.gz"
            self.temporary = f"{self.folder}/.{self.name}.{uuid.uuid4().hex}"
            self.stream = self.fs.open_output_stream(self.temporary, compression=None)
            self.size, self.records, self.sum = 0, 0, hashlib.sha1()
        self.stream.write(record)
        self.size += len(record)
        self.records += 1
        self.sum.update(record)
        if self.size >= self.roll_bytes:
            yield self.close()

    def close(self) -> tuple[str, int, int, str]:
        self.stream.close()
        self.fs.move(self.temporary, f"{self.folder}/{self.name}")
        self.stream = None
        self.number += 1
        return self.name, self.records, self.size, self.sum.hexdigest()


def _writer(folder: str, roll_bytes: int, date: str):
    """Writes sorted rows; yields manifest rows. A page's mark comes just before the page."""

    def manifest(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.int64(), pa.string()))],
            ["file", "records", "bytes", "sha1"],
        )

    def run(batches):
        files = None
        marks: dict[tuple[str, str], str] = {}
        current = None
        for b in batches:
            for part, key, url, html, digest, refers_to in zip(*(b.column(c).to_pylist() for c in (
                "part", "key", "url", "html", "digest", "refers_to"
            ))):
                files = files or _Files(folder, part, roll_bytes)
                if key != current:
                    current, marks = key, {}
                if refers_to is not None:
                    marks[key, digest] = refers_to
                    continue
                payload = html or b""
                done = list(files.add(_record(key, url, payload, marks.get((key, digest)), date)))
                if done:
                    yield manifest(done)
        if files is not None and files.stream is not None:
            yield manifest([files.close()])

    return run


def _uri(path: str) -> str:
    return path if "://" in path or path.startswith("file:") else f"file://{path}"


def write(
    pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
    roll_bytes: int = ROLL_BYTES, least_bytes: int = LEAST_BYTES, date: str = DATE,
) -> str:
    """Write a record for each page into a new folder; the folder's URI.

    A null payload is empty, a null id is written as an empty page id and is
    smaller than all others. Rows that repeat the largest id of a payload are
    all responses. Other columns are not read. An empty table writes an empty
    manifest.
    """
    prepare(pages.sparkSession)
    folder = _uri(folder)
    fs, path = pafs.FileSystem.from_uri(folder)
    if fs.get_file_info(path).type != pafs.FileType.NotFound:
        raise ValueError(f"{folder} is there already")
    fs.create_dir(path)
    html = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(
        F.col(id_col).alias("id"), F.col(url_col).alias("url"), html.alias("html"), F.sha1(html).alias("digest")
    )
    large = rows.filter(F.octet_length("html") >= least_bytes).select("id", "digest")
    owners = large.groupBy("digest").agg(F.max("id").alias("owner"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    marks = large.join(owners, "digest").filter(~F.col("id").eqNullSafe(F.col("owner"))).select(
        "id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("html"), "digest",
        F.col("owner").cast("string").alias("refers_to"),
    )
    both = marks.unionByName(rows.withColumn("refers_to", F.lit(None).cast("string")))
    ranged = (
        both.repartitionByRange("id").sortWithinPartitions("id", F.desc_nulls_last("refers_to"), "digest", "url")
        .select(
            F.spark_partition_id().alias("part"), F.coalesce(F.col("id").cast("string"), F.lit("")).alias("key"),
            "url", "html", "digest", "refers_to",
        )
    )
    manifest = ranged.mapInArrow(_writer(folder, roll_bytes, date), "file string, records bigint, bytes bigint, sha1 string")
    # the manifest is the commit: Spark writes it when every range is done
    manifest.write.parquet(f"{folder}/_manifest")
    return folder


def _members(read) -> Iterator[bytes]:
    """The records of a file, one gzip member at a time."""
    data, parts, unpack = read(), [], zlib.decompressobj(31)
    while data:
        parts.append(unpack.decompress(data))
        if unpack.eof:
            yield b"".join(parts)
            data, parts, unpack = unpack.unused_data, [], zlib.decompressobj(31)
        else:
            data = b""
        data = data or read()
    if parts:
        raise ValueError("a record is cut off")


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of a record, with its digests checked."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    block = rest[: int(headers["Content-Length"])]
    if _digest(block) != headers["WARC-Block-Digest"]:
        raise ValueError(f"wrong block digest in {headers['WARC-Record-ID']}")
    payload = block.partition(b"\r\n\r\n")[2]
    if headers["WARC-Type"] == "response" and _digest(payload) != headers["WARC-Payload-Digest"]:
        raise ValueError(f"wrong payload digest in {headers['WARC-Record-ID']}")
    return headers, payload


def _reader(folder: str, payloads: bool):
    """Records of the files named in each batch, streamed file by file."""
    names = ["key", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = [pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.string()]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    def run(batches):
        fs, path = pafs.FileSystem.from_uri(folder)
        for b in batches:
            for name, sha1 in zip(b.column("file").to_pylist(), b.column("sha1").to_pylist()):
                seen = hashlib.sha1()
                rows: list[tuple] = []
                with fs.open_input_stream(f"{path}/{name}", compression=None) as stream:

                    def more(stream=stream, seen=seen) -> bytes:
                        data = stream.read(1 << 20)
                        seen.update(data)
                        return data

                    for raw in _members(more):
                        h, payload = parse(raw)
                        response = h["WARC-Type"] == "response"
                        rows.append((
                            h["X-Page-ID"], h["WARC-Target-URI"], payload if response and payloads else None,
                            len(payload) if response else int(h["X-Payload-Length"]),
                            base64.b32decode(h["WARC-Payload-Digest"].removeprefix("sha1:")).hex(),
                            h["WARC-Type"], h.get("X-Refers-To-Page"),
                        ))
                        if len(rows) == 64:
                            yield batch(rows)
                            rows = []
                if seen.hexdigest() != sha1:
                    raise ValueError(f"damaged file {name}")
                if rows:
                    yield batch(rows)

    return run


def read(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """The records of the files that the manifest lists: key, url, payload, its size and digest, type, refers_to.

    Without payloads that column is null; sizes and digests of responses come from the payloads anyway.
    """
    prepare(spark)
    listed = spark.read.schema("file string, records bigint, bytes bigint, sha1 string").parquet(f"{folder}/_manifest")
    return listed.select("file", "sha1").repartition("file").mapInArrow(
        _reader(folder, payloads), "key string, url string, payload binary, payload_bytes bigint, "
        "payload_digest string, record_type string, refers_to string"
    )


def report(pages: DataFrame) -> DataFrame:
    """Writes the pages as archives in the shared folder, and what reading them back gives."""
    folder = f"{checkpoint_folder(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    records = read(pages.sparkSession, write(pages, folder), payloads=False)
    return records.select(
        F.nullif("key", F.lit("")).cast("bigint").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast("bigint").alias("refers_to"),
    )


SQL = """
with sized as (
  select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha1(coalesce(html, '')) as payload_digest
  from pages
), marked as (select *, max(page_id) over (partition by payload_digest) as owner from sized)
select page_id, payload_bytes, payload_digest,
  case when payload_bytes >= 1000 and owner <> page_id then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= 1000 and owner <> page_id then owner end as refers_to
from marked
"""
