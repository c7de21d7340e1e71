"""WARC archives: written from pages, read back, and assembled into captures through concurrent-to identifiers."""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import arrow_map, cut, remove_dir, shared_dir

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
#: A file is closed when it has grown beyond this.
FILE_BYTES = 64 << 20
#: Digests measured to be at most so many (of about 200 bytes with their URL) are broadcast.
MOST_SHARED = 50_000

RECORD = "record_id string, kind string, concurrent_to string, target_uri string, payload_digest string, page_id long, payload_bytes long, payload binary, fields map<string,string>"
RECORD_ARROW = pa.schema([
    *((c, pa.string()) for c in ("record_id", "kind", "concurrent_to", "target_uri", "payload_digest")), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload", pa.binary()), ("fields", pa.map_(pa.string(), pa.string())),
])


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def header_uri(url: str | None) -> str | None:
    """A URL as a header may hold it: control characters, blanks and non-ASCII are percent-encoded."""
    return None if url is None else quote(url, safe="!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")


def record(kind: str, record_id: str, block: bytes, content_type: str, **headers: str | None) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{record_id}>", f"WARC-Date: {DATE}"]
    lines += [f"WARC-{k.replace('_', '-')}: {v}" for k, v in headers.items() if v is not None]
    lines += [f"Content-Type: {content_type}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(raw: bytes) -> bytes:
    """A gzip member of its own, as archives have one for each record."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def capture_records(page_id: int | None, url: str | None, payload: bytes, revisits: bool, capture: str, first_url: str | None = None) -> Iterator[bytes]:
    """The response or revisit of one page, then its request and its metadata, which name it as concurrent. A revisit
    refers to the response by its URL and date."""
    uri, sha = header_uri(url), digest(payload)
    main, http = str(uuid.uuid5(uuid.NAMESPACE_OID, capture)), f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if revisits:
        yield record("revisit", main, http, "application/http;msgtype=response", Target_URI=uri, Payload_Digest=f"sha1:{sha}", Profile=PROFILE, Refers_To_Target_URI=header_uri(first_url), Refers_To_Date=DATE)
    else:
        yield record("response", main, http + payload, "application/http;msgtype=response", Target_URI=uri, Payload_Digest=f"sha1:{sha}")
    try:
        host = urlsplit(uri or "").netloc
    except ValueError:
        host = ""
    asked = f"GET {uri or '/'} HTTP/1.1\r\nHost: {host}\r\n\r\n".encode()
    yield record("request", str(uuid.uuid5(uuid.NAMESPACE_OID, capture + "?")), asked, "application/http;msgtype=request", Target_URI=uri, Concurrent_To=f"<urn:uuid:{main}>")
    told = {"page-id": page_id, "url": url, "payload-bytes": len(payload)}
    fields = "".join(f"{k}: {json.dumps(v)}\r\n" for k, v in told.items()).encode()
    yield record("metadata", str(uuid.uuid5(uuid.NAMESPACE_OID, capture + "!")), fields, "application/warc-fields", Target_URI=uri, Concurrent_To=f"<urn:uuid:{main}>")


def write_archives(pages: DataFrame, out: str, min_bytes: int = 0, page_id: str = "page_id", url: str = "url", html: str = "html", file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes pages as WARC files under `out`, a folder that all executors share, and returns their manifest
    (path, captures, bytes), which is stored: only files of tasks that succeeded are in it.

    Of pages with equal payloads of at least min_bytes, the one with the largest page_id is the response and the
    others are revisits; rows that tie for the largest are responses all. A null html is an empty payload; a null
    page_id is the largest only if no page of that payload has an id.
    """
    p = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.encode(F.coalesce(html, F.lit("")), "UTF-8").alias("payload")).withColumn("sha", F.sha1("payload"))
    # Only payloads that several records have can be revisited. Their digests, if few, are broadcast, and payloads stay
    # where they are read; else both are shuffled, and Spark can split a digest that very many records have.
    found = p.where(F.length("payload") >= min_bytes).groupBy("sha").agg(F.count("*").alias("n"), F.max(F.struct("page_id", F.col("url").alias("first_url"))).alias("k"))
    shared = cut(found.where("n > 1").select("sha", F.col("k.page_id").alias("keeper"), "k.first_url", F.lit(True).alias("shared")))
    near = F.broadcast(shared) if shared.count() <= MOST_SHARED else shared
    told = p.join(near, "sha", "left").select("page_id", "url", "payload", "first_url", (F.coalesce("shared", F.lit(False)) & ~F.col("page_id").eqNullSafe(F.col("keeper"))).alias("revisits"))

    def rows(it: Iterator[tuple]) -> Iterator[tuple]:
        store, folder = fs.FileSystem.from_uri(out)
        store.create_dir(folder, recursive=True)
        at, attempt = 0, uuid.uuid4().hex
        file, name, captures, size = None, "", 0, 0
        part = TaskContext.get().partitionId()
        for n, (i, u, payload, first_url, revisits) in enumerate(it):
            if file is None:
                name, captures, size = f"part-{part:05d}-{at:03d}-{attempt}.warc.gz", 0, 0
                file = store.open_output_stream(f"{folder}/{name}", compression=None)
            for raw in capture_records(i, u, payload, revisits, f"{part}/{n}/{i}", first_url):
                size += file.write(packed := member(raw)) or len(packed)
            captures += 1
            if size >= file_bytes:
                file.close()
                yield name, captures, size
                file, at = None, at + 1
        if file is not None:
            file.close()
            yield name, captures, size

    return cut(arrow_map(told, rows, "path string, captures long, bytes long", pa.schema([("path", pa.string()), ("captures", pa.int64()), ("bytes", pa.int64())]), chunk=64))


def members(stream, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The gzip members of a stream, unpacked one at a time."""
    rest, z, got = b"", zlib.decompressobj(31), []
    while block := rest or stream.read(chunk):
        got.append(z.decompress(block))
        rest = b""
        if z.eof:
            yield b"".join(got)
            rest, z, got = z.unused_data, zlib.decompressobj(31), []
    if any(got):
        raise ValueError("an archive ends within a record")


def parse(raw: bytes, with_payload: bool) -> tuple:
    """One record as a row of RECORD. The payload of a response is its HTTP body, whose digest is checked."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    h = {k.strip().lower(): v.strip() for k, _, v in (s.partition(":") for s in lines[1:])}
    length = int(h["content-length"])
    block = rest[:length]
    if len(block) < length or rest[length : length + 4] != b"\r\n\r\n":
        raise ValueError("a record is shorter than its Content-Length")
    kind, sha = h["warc-type"], h.get("warc-payload-digest", "").removeprefix("sha1:") or None
    payload = page = size = None
    fields: dict[str, str] = {}
    if kind == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        size = len(payload)
        if sha != digest(payload):
            raise ValueError(f"payload digest of {h['warc-record-id']} differs")
    elif kind == "metadata":
        fields = {k.strip(): v.strip() for k, _, v in (s.partition(":") for s in block.decode().split("\r\n") if s)}
        page, size = (json.loads(fields.get(k, "null")) for k in ("page-id", "payload-bytes"))
    elif kind == "request":
        fields = {"request-line": block.partition(b"\r\n")[0].decode()}
    return h["warc-record-id"], kind, h.get("warc-concurrent-to"), h.get("warc-target-uri"), sha, page, size, payload if with_payload else None, list(fields.items())


def read_archives(manifest: DataFrame, out: str, with_payload: bool = True) -> DataFrame:
    """The records of the manifest's files, streamed file by file, one gzip member in memory at a time."""

    def rows(it: Iterator[tuple]) -> Iterator[tuple]:
        store, folder = fs.FileSystem.from_uri(out)
        for (name,) in it:
            with store.open_input_stream(f"{folder}/{name}", compression=None) as stream:
                for raw in members(stream):
                    yield parse(raw, with_payload)

    names = manifest.select("path").repartitionByRange(max(manifest.count(), 1), "path")  # about a file for each task
    return arrow_map(names, rows, RECORD, RECORD_ARROW, chunk=16)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: record_id, target_uri, kind, response (digest, bytes, payload), request, metadata
    (all that name the capture), and for a revisit the page_id and bytes of the response that it refers to.

    Requests and metadata find their capture by their concurrent-to identifier; a capture without any has nulls. Of
    several requests for one capture the one with the least record id is taken.
    """
    main = records.where("kind in ('response', 'revisit')")
    ask = records.where("kind = 'request'").groupBy(F.col("concurrent_to").alias("record_id")).agg(F.min_by(F.struct("record_id", "target_uri", "fields"), "record_id").alias("request"))
    meta = records.where("kind = 'metadata'").groupBy(F.col("concurrent_to").alias("record_id")).agg(F.min(F.struct("page_id", "payload_bytes")).alias("told"), F.collect_list(F.struct("record_id", "fields")).alias("metadata"))
    joined = main.select("record_id", "kind", "target_uri", "payload_digest", "payload_bytes", "payload").join(ask, "record_id", "left").join(meta, "record_id", "left")
    kept = joined.where("kind = 'response'").groupBy("payload_digest").agg(F.max("told.page_id").alias("page_id"), F.max("payload_bytes").alias("bytes"))
    # Stored first, so that the revisits of one very common payload can be split in the join.
    wanted = joined.where("kind = 'revisit'").select("payload_digest").distinct()
    first = cut(kept.join(wanted, "payload_digest", "left_semi").select("payload_digest", F.lit("revisit").alias("kind"), F.struct("page_id", "bytes").alias("refers_to")))
    both = joined.join(F.broadcast(first) if first.count() <= MOST_SHARED else first, ["payload_digest", "kind"], "left")
    response = F.struct("payload_digest", F.coalesce("payload_bytes", "refers_to.bytes").alias("payload_bytes"), "payload").alias("response")
    return both.select(F.col("told.page_id").alias("page_id"), "record_id", "kind", "target_uri", response, "request", "metadata", "refers_to")


def round_trip(pages: DataFrame, min_bytes: int = 0, **columns) -> DataFrame:
    """One row per row of pages, from archives written to the shared folder and read back: page_id, payload_bytes,
    payload_digest, record_type, refers_to.

    Null and empty html have an empty payload, equal to each other; null urls leave the URI headers out; repeated
    rows are captures of their own; an empty table gives no rows. Other columns are not read. The archives are removed
    once their records' headers are stored.
    """
    out = f"{shared_dir(pages.sparkSession).rstrip('/')}/warc-{uuid.uuid4().hex}"
    manifest = write_archives(pages, out, min_bytes, **columns)
    captures = cut(assemble(cut(read_archives(manifest, out, with_payload=False))).select("page_id", F.col("response.payload_bytes").alias("payload_bytes"), F.col("response.payload_digest").alias("payload_digest"), F.col("kind").alias("record_type"), F.col("refers_to.page_id").alias("refers_to")))
    remove_dir(out)
    return captures
