"""WARC archives: a writer that stores equal payloads once, and a splittable reader.

Files are sequences of gzip members, one record each, written by tasks through
pyarrow's file systems into a folder that all executors share. The reader gives
each task a byte range: it searches the range for the gzip magic, takes a candidate
for a member only if its header and first bytes decode to a WARC version line, and
owns the records that start inside the range, to their ends beyond it.

Defined cases: null payloads count as empty; payloads under `min_bytes` are always
responses; of equal payloads the rows with the smallest non-null id are responses
(several rows with that id all are) and every other row, null ids included, revisits
them; when all ids of a payload are null, all are responses. Input columns other
than id, url and payload are not written, whatever their names. The reader takes
archives of other writers too: records of any type, with or without an HTTP head, and
digests by SHA-1, SHA-256 or MD5 in hexadecimal or base 32. `intact` says whether a
payload has the digest that its header states (null: none stated that can be checked);
a record that ends early, or whose length cannot be read, is given as far as it goes
with `intact` false. Payloads of any length are read whole.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import posixpath
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MAGIC = b"\x1f\x8b\x08"
SPLIT_BYTES = 16 << 20
READ_BYTES = 1 << 20
WRITTEN = "path string, bytes long, records long"
RECORD = "record_id string, record_type string, target_uri string, payload_digest string, refers_to string, payload_bytes long, payload binary, intact boolean"


def open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    if urlsplit(path).scheme:
        return pafs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
    return pafs.LocalFileSystem(), path


def plan_records(pages: DataFrame, id_col: str, url_col: str, payload_col: str, min_bytes: int) -> DataFrame:
    """One row per record with its payload, digest and, for revisits, the id it refers to."""
    base = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col), F.lit("")).cast("binary").alias("payload"))
    base = base.select("*", F.sha2("payload", 256).alias("digest"))
    first = base.filter(F.length("payload") >= min_bytes).groupBy("digest").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n")).filter("n > 1 AND first_id IS NOT NULL").drop("n")
    return base.join(first, "digest", "left").withColumn("refers", F.expr("CASE WHEN id <=> first_id THEN NULL ELSE first_id END")).drop("first_id")


def record_bytes(rid: int | None, url: str | None, payload: bytes, digest: str, refers: int | None) -> bytes:
    kind = "response" if refers is None else "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers is None else http
    uri = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if rid is None else rid}>", f"WARC-Target-URI: {uri}", "WARC-Date: 2024-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if refers is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers}>"]
    return ("WARC/1.1\r\n" + "\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def gzip_member(data: bytes) -> bytes:
    packer = zlib.compressobj(5, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """One archive per task, under a name of its own; returns (path, bytes, records) of the finished ones.

    A task's file is written under its attempt's name. Only the attempt whose rows
    Spark keeps is listed, so files of lost or repeated attempts are never read.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = open_fs(folder)
        system.create_dir(root, recursive=True)
        name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex[:12]}.warc.gz"
        out, size, count = None, 0, 0
        for batch in batches:
            cols = [batch.column(c) for c in ("id", "url", "payload", "digest", "refers")]
            for row in zip(*cols, strict=True):
                member = gzip_member(record_bytes(*(x.as_py() for x in row)))
                out = out or system.open_output_stream(posixpath.join(root, name), compression=None)
                out.write(member)
                size, count = size + len(member), count + 1
        if out:
            out.close()
            yield pa.RecordBatch.from_pylist([{"path": f"{folder}/{name}", "bytes": size, "records": count}])

    return records.select("id", "url", "payload", "digest", "refers").mapInArrow(write, WRITTEN)


class _Window:
    """Sequential bytes of a file, kept from a moving start on."""

    def __init__(self, file: pa.NativeFile, size: int, at: int):
        self.file, self.size, self.base, self.data = file, size, at, b""

    def need(self, at: int, n: int) -> bytes:
        """n bytes from `at`, or as many as there are."""
        while self.base + len(self.data) < min(at + n, self.size):
            self.file.seek(self.base + len(self.data))
            self.data += self.file.read(READ_BYTES)
        return self.data[at - self.base : at - self.base + n]

    def drop(self, at: int) -> None:
        if at - self.base > READ_BYTES:
            self.data, self.base = self.data[at - self.base :], at


def inflate(window: _Window, at: int, limit: int | None = None) -> tuple[bytes, int] | None:
    """The member at `at` and where it ends; None if it isn't one. With a limit, only so many bytes of it."""
    packer, out, pos = zlib.decompressobj(31), [], at
    try:
        while not packer.eof:
            part = window.need(pos, READ_BYTES if limit is None else 4096)
            if not part:
                return (b"".join(out), pos) if limit is not None else None
            out.append(packer.decompress(part, 0 if limit is None else limit))
            pos += len(part)
            if limit is not None and sum(map(len, out)) >= limit:
                break
    except zlib.error:
        return None
    return b"".join(out), pos - len(packer.unused_data)


def members(file: pa.NativeFile, size: int, start: int, end: int) -> Iterator[bytes]:
    """The decoded members that start in [start, end): found by magic, proved by their first bytes."""
    window, at = _Window(file, size, start), start
    while at < end:
        window.drop(at)
        chunk = window.need(at, min(READ_BYTES, end - at + len(MAGIC) - 1))
        hit = chunk.find(MAGIC)
        if hit < 0:
            at += max(1, len(chunk) - len(MAGIC) + 1)
            continue
        at += hit
        if at >= end:
            return
        head = inflate(window, at, 16)
        whole = inflate(window, at) if head and head[0].startswith(b"WARC/") else None
        if whole:
            yield whole[0]
            at = whole[1]
        else:
            at += 1


def fields_of(head: bytes) -> dict[str, str]:
    """Header fields after the first line, by lower-case name; folded lines belong to the field before."""
    lines = head.decode("utf-8", "replace").replace("\r\n ", " ").replace("\r\n\t", " ").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def has_digest(payload: bytes, stated: str) -> bool | None:
    """Whether a payload has the digest `algorithm:value`; None if that cannot be told."""
    kind, _, value = stated.partition(":")
    kind = kind.strip().lower().replace("-", "")
    if kind not in ("sha1", "sha256", "md5") or not value:
        return None
    made, value = hashlib.new(kind, payload, usedforsecurity=False).digest(), value.strip()
    if len(value) == 2 * len(made):
        return binascii.hexlify(made).decode() == value.lower()
    return base64.b32encode(made).decode().rstrip("=") == value.upper().rstrip("=")


def parse_member(data: bytes) -> Iterator[dict]:
    """The records of a member."""
    at = 0
    while data.startswith(b"WARC/", at):
        cut = data.find(b"\r\n\r\n", at)
        if cut < 0:
            return
        fields = fields_of(data[at:cut])
        stated = fields.get("content-length", "")
        length = int(stated) if stated.isascii() and stated.isdigit() else None
        block = data[cut + 4 :] if length is None else data[cut + 4 : cut + 4 + length]
        whole = length is not None and len(block) == length
        at = cut + 4 + len(block) + 4
        payload, inner = block, {}
        if fields.get("content-type", "").lower().startswith("application/http"):
            http, found, rest = block.partition(b"\r\n\r\n")
            inner, payload = fields_of(http), rest if found else b""
        revisit = fields.get("warc-type") == "revisit"
        ident = lambda x: None if x is None else x.strip("<>").removeprefix("urn:page:") or None
        digest = fields.get("warc-payload-digest", "")
        intact = None if revisit else has_digest(payload, digest)
        said = inner.get("content-length", "")
        size = (int(said) if said.isascii() and said.isdigit() else None) if revisit else len(payload)
        made = digest.partition(":")[2].lower() if revisit else hashlib.sha256(payload).hexdigest()
        yield {"record_id": ident(fields.get("warc-record-id")), "record_type": fields.get("warc-type"), "target_uri": fields.get("warc-target-uri"), "payload_digest": made or None, "refers_to": ident(fields.get("warc-refers-to")), "payload_bytes": size, "payload": None if revisit else payload, "intact": intact if whole else False}


def read_archives(files: DataFrame, split_bytes: int = SPLIT_BYTES, with_payload: bool = True) -> DataFrame:
    """Records of archives listed as (path, bytes), each byte range of each file a row of its own."""
    splits = files.select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(split_bytes).cast("long"))).alias("start"))
    splits = splits.repartition(max(1, splits.count()))
    schema = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("payload_digest", pa.string()), ("refers_to", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary()), ("intact", pa.bool_())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                system, path = open_fs(row["path"])
                rows, held = [], 0
                with system.open_input_file(path) as file:
                    for member in members(file, row["bytes"], row["start"], min(row["bytes"], row["start"] + split_bytes)):
                        for record in parse_member(member):
                            if not with_payload:
                                record["payload"] = None
                            rows.append(record)
                            held += len(record["payload"] or b"") + 200
                        if held > common.SLAB_BYTES:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return splits.mapInArrow(read, RECORD)


def list_archives(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes) of the archives in a folder, without reading them."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(path).select("path", F.col("length").alias("bytes"))


def op2_warc(spark: SparkSession, sf_dir: str, min_bytes: int = 100) -> DataFrame:
    records = plan_records(common.table(spark, sf_dir, "pages"), "page_id", "url", "html", min_bytes)
    folder = common.new_folder(spark, "warc")
    files = common.cut(write_archives(records, folder), "warc-files")
    out = read_archives(files, with_payload=False)
    out = common.cut(out.select(F.col("record_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"), F.col("target_uri").alias("url")), "warc-records")
    common.delete_folder(spark, folder)
    return out


OP2_SQL = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, url, strlen(body)::BIGINT AS payload_bytes, sha256(body) AS payload_digest FROM p),
m AS (SELECT payload_digest, min(page_id) AS first_id FROM d WHERE payload_bytes >= 100 GROUP BY 1)
SELECT d.page_id, d.payload_bytes, d.payload_digest,
       CASE WHEN m.first_id IS NULL OR m.first_id = d.page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN m.first_id = d.page_id THEN NULL ELSE m.first_id END AS refers_to, coalesce(d.url, '') AS url
FROM d LEFT JOIN m USING (payload_digest)
"""
