"""Operator 10, WARC: archives written and read as a stream of chunks, never holding a whole large record."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, scratch_dir

CHUNK_BYTES = 1 << 20
CRLF = b"\r\n"
CHUNKS = "record_id bigint, chunk_no int, n_bytes bigint, seen_bytes bigint, digest string, last boolean, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, chunk binary"


def _open(path: str):
    """File system and local path of a URI; plain paths are local and shared."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def base32_sha1(hexadecimal: str) -> str:
    return base64.b32encode(bytes.fromhex(hexadecimal)).decode()


class _Member:
    """One gzip member per record, as readers of WARC archives expect."""

    def __init__(self, out):
        self.out, self.z = out, zlib.compressobj(1, zlib.DEFLATED, 31)

    def write(self, data: bytes) -> None:
        self.out.write(self.z.compress(data))

    def close(self) -> None:
        self.out.write(self.z.flush())


def _http_head(length: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()


def _head(r: dict) -> bytes:
    body = 0 if r["record_type"] == "revisit" else len(_http_head(r["payload_bytes"])) + r["payload_bytes"]
    lines = [
        "WARC/1.1",
        f"WARC-Type: {r['record_type']}",
        f"WARC-Record-ID: <urn:page:{r['record']}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{base32_sha1(r['sha1'])}",
        f"X-Payload-Length: {r['payload_bytes']}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {body}",
    ]
    if r["url"] is not None:
        lines.insert(4, "WARC-Target-URI: " + r["url"].replace("\r", "%0D").replace("\n", "%0A"))
    if r["page_id"] is not None:
        lines.append(f"X-Page-Id: {r['page_id']}")
    if r["refers_to"] is not None:
        lines.append(f"X-Refers-To-Page-Id: {r['refers_to']}")
    if r["record_type"] == "revisit":
        lines += [f"WARC-Refers-To: <urn:page:{r['refers_record']}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(lines).encode() + CRLF + CRLF


def _writer(folder: str):
    """Writes one archive per task: to an attempt's own name first, then moved to the partition's name."""

    def write(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        system, root = _open(folder)
        system.create_dir(root, recursive=True)
        draft, n, size, out, member = f"{root}/.{part:06d}-{uuid.uuid4().hex}", 0, 0, None, None
        for b in batches:
            for r in (b.slice(i, 1).to_pylist()[0] for i in range(b.num_rows)):  # one chunk at a time
                if out is None:
                    out = system.open_output_stream(draft, compression=None)
                if r["chunk_no"] == 0:
                    if member:
                        member.write(CRLF + CRLF)
                        member.close()
                    member = _Member(out)
                    member.write(_head(r))
                    if r["record_type"] == "response":
                        member.write(_http_head(r["payload_bytes"]))
                    n += 1
                if r["record_type"] == "response":
                    member.write(r["chunk"])
        if out is not None:
            member.write(CRLF + CRLF)
            member.close()
            size = out.tell()
            out.close()
            path = f"{root}/part-{part:06d}.warc.gz"
            system.move(draft, path)
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/part-{part:06d}.warc.gz"], "records": [n], "bytes": [size]}, schema=pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

    return write


class _Inflated:
    """Buffered reader over concatenated gzip members, in fixed-size pieces."""

    def __init__(self, raw):
        self.raw, self.z, self.buffer, self.pending = raw, zlib.decompressobj(31), bytearray(), b""

    def _more(self) -> bool:
        while True:
            data = self.pending or self.raw.read(CHUNK_BYTES)
            if self.z.eof:
                if not data:
                    return False
                self.z = zlib.decompressobj(31)
            elif not data:
                return False
            got = self.z.decompress(data, CHUNK_BYTES)
            self.pending = self.z.unused_data if self.z.eof else self.z.unconsumed_tail
            if got:
                self.buffer += got
                return True

    def line(self) -> bytes | None:
        while (i := self.buffer.find(CRLF)) < 0:
            if not self._more():
                return None
        out = bytes(self.buffer[:i])
        del self.buffer[: i + 2]
        return out

    def take(self, most: int) -> bytes:
        if not self.buffer and not self._more():
            raise EOFError("archive ends inside a record")
        out = bytes(self.buffer[:most])
        del self.buffer[: len(out)]
        return out


def records(raw, with_data: bool = True):
    """Chunk rows of one archive: digests run along, and only the chunk at hand is in memory."""
    src = _Inflated(raw)
    while (line := src.line()) is not None:
        if not line:
            continue
        head = {}
        while line := src.line():
            k, _, v = line.decode().partition(": ")
            head[k] = v
        left, sha, seen, no = int(head["Content-Length"]), hashlib.sha1(), 0, 0
        if left and head.get("Content-Type", "").startswith("application/http"):
            while (line := src.line()) is not None:  # the payload is behind the HTTP head
                left -= len(line) + 2
                if not line:
                    break
        page = lambda k: int(head[k]) if k in head else None
        while True:
            piece = src.take(min(left, CHUNK_BYTES)) if left else b""
            left -= len(piece)
            seen += len(piece)
            sha.update(piece)
            last = not left
            yield (page("X-Page-Id"), no, len(piece), seen, base64.b32encode(sha.digest()).decode(), last, head["WARC-Type"], page("X-Refers-To-Page-Id"), int(head["X-Payload-Length"]), head["WARC-Payload-Digest"].removeprefix("sha1:"), piece if with_data else None)
            no += 1
            if last:
                break


def _reader(with_data: bool):
    names = [x.split()[0] for x in CHUNKS.split(", ")]
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}
    schema = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in CHUNKS.split(", ")])

    def read(batches):
        for b in batches:
            for path in b.column(0).to_pylist():
                system, local = _open(path)
                with system.open_input_stream(local, compression=None) as raw:
                    rows, size = [], 0
                    for r in records(raw, with_data):
                        rows.append(r)
                        size += r[2] if with_data else 200
                        if size > 4 * CHUNK_BYTES:
                            yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*rows, strict=True)), strict=True)), schema=schema)
                            rows, size = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*rows, strict=True)), strict=True)), schema=schema)

    return read


def write_warc(pages: DataFrame, folder: str) -> DataFrame:
    """Writes ``pages(page_id, url, html)`` as gzip archives under ``folder``; returns ``(path, records, bytes)``.

    Every row is a record. Of rows with equal payloads the one with the smallest page_id (null ids last, then
    the smallest url) is the response, the others are revisits of it without a body. Null html is an empty
    payload. A record's identifier is made of page_id, payload, url and, for rows equal in all of these, a
    number. Payloads pass as (record, chunk number) rows of CHUNK_BYTES, cut in the JVM; the writer holds one
    chunk. Further columns are ignored.
    """
    url = F.col("url") if "url" in pages.columns else F.lit(None).cast("string")
    rows = pages.select("page_id", url.alias("url"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("body"))
    rows = rows.select("page_id", "url", F.sha1("body").alias("sha1"), F.octet_length("body").cast("bigint").alias("payload_bytes"), "body")
    kinds = materialise(rows.groupBy("page_id", "url", "sha1", "payload_bytes").agg(F.count("*").alias("times")), "warc-kinds")
    order = F.struct(F.col("page_id").isNull().alias("n"), "page_id", F.col("url").isNull().alias("m"), "url")
    first = kinds.groupBy("sha1", "payload_bytes").agg(F.min(order).alias("w"), F.sum("times").alias("all")).where(F.col("all") > 1)
    first = materialise(first.select("sha1", "payload_bytes", F.col("w.page_id").alias("first_id"), F.col("w.url").alias("first_url")), "warc-first")
    kinds = kinds.join(first, ["sha1", "payload_bytes"]).withColumn("leads", F.col("page_id").eqNullSafe(F.col("first_id")) & F.col("url").eqNullSafe(F.col("first_url")))
    # written tables have known sizes: Spark broadcasts them if they are small, else moves the pages once
    kinds = materialise(kinds.select(F.col("page_id").alias("k_id"), F.col("url").alias("k_url"), F.col("sha1").alias("k_sha1"), "leads", "first_id", "first_url", "times"), "warc-shared")
    rows = rows.join(kinds, F.col("page_id").eqNullSafe(F.col("k_id")) & F.col("url").eqNullSafe(F.col("k_url")) & (F.col("sha1") == F.col("k_sha1")), "left").drop("k_id", "k_url", "k_sha1")
    rows = rows.withColumn("copy", F.lit(0))
    if not kinds.where("times > 1").isEmpty():
        # rows equal in everything: one of each kind goes on, and is written as often as it occurred
        same = rows.where("times > 1").dropDuplicates(["page_id", "url", "sha1", "payload_bytes"])
        same = same.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("times").cast("int") - 1)))
        rows = rows.where("times is null or times = 1").unionByName(same)
    name = lambda i, u, c: F.concat_ws(":", F.coalesce(i.cast("string"), F.lit("null")), "sha1", F.hex(F.crc32(F.coalesce(u, F.lit("-")).cast("binary"))), c.cast("string"))
    own = F.coalesce(F.col("leads") & (F.col("copy") == 0), F.lit(True))
    rows = rows.withColumns({"record": name(F.col("page_id"), F.col("url"), F.col("copy")), "refers_record": F.when(~own, name(F.col("first_id"), F.col("first_url"), F.lit(0))), "refers_to": F.when(~own, F.col("first_id")), "record_type": F.when(own, "response").otherwise("revisit")})
    n = F.when(own, F.greatest(F.lit(1), F.ceil(F.col("payload_bytes") / CHUNK_BYTES).cast("int"))).otherwise(1)
    kept = ["record", "page_id", "url", "sha1", "payload_bytes", "record_type", "refers_to", "refers_record"]
    cut = rows.select(*kept, "body", F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk_no"))
    chunk = F.when(F.col("record_type") == "response", F.substring("body", F.col("chunk_no") * CHUNK_BYTES + 1, F.lit(CHUNK_BYTES)))
    return cut.select(*kept, "chunk_no", chunk.alias("chunk")).mapInArrow(_writer(folder), "path string, records bigint, bytes bigint")


def read_warc(spark: SparkSession, archives: DataFrame, with_data: bool = True) -> DataFrame:
    """Chunk table of the archives whose ``path`` column is given: record id, chunk number, running digest, bytes."""
    n = max(1, min(archives.count(), 10_000))
    return archives.select("path").repartition(n, "path").mapInArrow(_reader(with_data), CHUNKS)


def op10_warc_round_trip(spark, sf_dir: str) -> DataFrame:
    """Writes every page as a WARC record in shared scratch, reads the archives back, one row per record."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    folder = scratch_dir(spark, "warc")
    listing = f"{folder}-index"
    write_warc(pages, folder).write.parquet(listing)
    chunks = read_warc(spark, spark.read.parquet(listing), with_data=False).where("last")
    own = F.col("record_type") == "response"
    return chunks.select(
        F.col("record_id").alias("page_id"),
        F.when(own, F.col("seen_bytes")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(own, F.col("digest")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        "refers_to",
    )


_ORACLE = """
with p as (select page_id, coalesce(html, '') h, url from pages),
m as (select page_id, strlen(h)::bigint n, upper(sha1(h)) s, min(page_id) over (partition by h) f, row_number() over (partition by h order by page_id nulls last, url nulls last) i from p)
select page_id, n payload_bytes,
  list_aggregate(list_transform(range(0, 8), lambda i: list_aggregate(list_transform(range(0, 4), lambda j:
     substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(s, (5 * i + 1)::int, 5))::bigint >> (15 - 5 * j)::bigint) & 31)::int + 1, 1)), 'string_agg', '')), 'string_agg', '') payload_digest,
  case when i = 1 then 'response' else 'revisit' end record_type, case when i > 1 then f end refers_to from m"""

QUERIES = {"op10_warc_round_trip": op10_warc_round_trip}
ORACLES = {"op10_warc_round_trip": _ORACLE}
