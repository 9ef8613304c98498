"""WARC archives: written from pages, read back, and put together again by transaction.

Each page becomes a request, a response (or a revisit of an equal payload) and a metadata record; the
latter two of a transaction name the response in WARC-Concurrent-To. Files are gzip members, one a
record, in the shared folder; a task names its files anew at each attempt and reports them in a
manifest that Spark commits, so files of a lost attempt are never read. Any file system that
``pyarrow.fs`` opens will do. Reading streams records; joins over record identifiers then give one
nested row for each capture.
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
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_type, scratch, stored

#: Payloads from this size on are stored once. Bytes of records (before compression) in one file. Compression level.
REVISIT_FROM, FILE_BYTES, LEVEL = 1000, 64_000_000, 1
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD = ("id string, type string, concurrent_to array<string>, target string, date string, refers_to string, payload_digest string, "
          "payload_bytes long, status int, fields string, payload binary")


def line(text: str) -> str:
    """A header's value can't hold line ends."""
    return text.replace("\r", "%0D").replace("\n", "%0A")


def record(kind: str, rid: str, target: str, content_type: str, block: bytes, more: dict[str, str] | None = None) -> bytes:
    head = {"WARC-Type": kind, "WARC-Record-ID": rid, "WARC-Date": DATE, "WARC-Target-URI": target, **(more or {}), "Content-Type": content_type, "Content-Length": str(len(block))}
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items() if v) + "\r\n").encode() + block + b"\r\n\r\n"


def transaction(run: str, key: int, page_id: int | None, url: str | None, payload: bytes, digest: str, refers_key: int | None, refers_page: int | None) -> list[bytes]:
    """The records of one capture; ``refers_key`` is given for a revisit."""
    def rid(k: int, kind: str) -> str:
        return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{run}/{k}/{kind}')}>"

    target = line(url or "")
    own, sha = rid(key, "response"), "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    host, _, path = target.partition("://")[2].partition("/")
    ask = f"GET /{path} HTTP/1.1\r\nHost: {host}\r\n\r\n".encode()
    fields = f"page-id: {'' if page_id is None else page_id}\r\n"
    if refers_key is None:
        main = record("response", own, target, "application/http; msgtype=response", http + payload, {"WARC-Payload-Digest": sha})
    else:
        fields += f"refers-to-page: {refers_page}\r\n"
        main = record("revisit", own, target, "application/http; msgtype=response", http,
                      {"WARC-Payload-Digest": sha, "WARC-Profile": PROFILE, "WARC-Refers-To": rid(refers_key, "response")})
    return [record("request", rid(key, "request"), target, "application/http; msgtype=request", ask, {"WARC-Concurrent-To": own}), main,
            record("metadata", rid(key, "metadata"), target, "application/warc-fields", fields.encode(), {"WARC-Concurrent-To": own})]


def member(data: bytes) -> bytes:
    c = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def _writer(folder: str, run: str):
    def write(batches):
        out, path, n, size = None, "", 0, 0
        store, base = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if out is None:
                    path, n, size = f"{base}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(path, compression=None)
                    out.write(member(record("warcinfo", f"<urn:uuid:{uuid.uuid4()}>", "", "application/warc-fields", b"format: WARC File Format 1.1\r\n")))
                for data in transaction(run, *row):
                    out.write(member(data))
                    size += len(data)
                n += 1
                if size >= FILE_BYTES:
                    out.close()
                    out = None
                    yield pa.RecordBatch.from_pydict({"path": [path], "captures": [n]})
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "captures": [n]})

    return write


def write(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write the archives; the manifest (path, captures) of the files that count.

    Of rows with equal payloads of ``REVISIT_FROM`` bytes or more, one with the largest id has the response; a
    tie is settled by the row's place, so repeated rows are a response and its revisit. A null id ranks
    below all others; null html is an empty payload and a null url an empty target.
    """
    spark = pages.sparkSession
    store, base = fs.FileSystem.from_uri(folder)
    store.create_dir(base, recursive=True)
    payload = F.coalesce(F.col(f"`{html}`"), F.lit(""))
    rows = pages.select(F.monotonically_increasing_id().alias("key"), F.col(f"`{page_id}`").cast("long").alias("page"), F.col(f"`{url}`").cast("string").alias("url"),
                        payload.cast("binary").alias("payload"), F.sha1(payload.cast("binary")).alias("digest"))
    large = rows.where(F.octet_length("payload") >= REVISIT_FROM).groupBy("digest").agg(F.count("*").alias("n"), F.max(F.struct("page", "key")).alias("first"))
    large = stored(large.where("n > 1").select("digest", F.col("first.page").alias("refers_page"), F.col("first.key").alias("refers_key")), "payloads")
    same = F.col("refers_key") == F.col("key")
    joined = rows.join(large, "digest", "left").select("key", "page", "url", "payload", "digest", F.when(~same, F.col("refers_key")).alias("refers_key"), F.when(~same, F.col("refers_page")).alias("refers_page"))
    return stored(joined.mapInArrow(_writer(folder, uuid.uuid4().hex), "path string, captures long"), "manifest")


def records(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, list[str]], bytes]]:
    """Header fields (lower-case names) and block of each record of an uncompressed stream."""
    while True:
        first = stream.readline()
        while first in (b"\r\n", b"\n"):
            first = stream.readline()
        if not first:
            return
        if not first.startswith(b"WARC/"):
            raise ValueError(f"no WARC record begins with {first[:40]!r}")
        head: dict[str, list[str]] = {}
        while (text := stream.readline().rstrip(b"\r\n")):
            name, _, value = text.decode("utf-8", "replace").partition(":")
            head.setdefault(name.strip().lower(), []).append(value.strip())
        size = int(head["content-length"][0])
        block = stream.read(size)
        if len(block) != size:
            raise ValueError("a WARC record is cut off")
        yield head, block


def parsed(head: dict[str, list[str]], block: bytes, payloads: bool) -> dict:
    one = lambda name: head.get(name, [None])[0]
    kind, digest = one("warc-type"), one("warc-payload-digest")
    out = {"id": one("warc-record-id"), "type": kind, "concurrent_to": head.get("warc-concurrent-to", []), "target": one("warc-target-uri"), "date": one("warc-date"),
           "refers_to": one("warc-refers-to"), "payload_digest": None, "payload_bytes": None, "status": None, "fields": None, "payload": None}
    if kind in ("response", "revisit"):
        http, _, payload = block.partition(b"\r\n\r\n")
        status, *lines = http.decode("latin-1").split("\r\n")
        out["status"] = int(status.split()[1])
        if kind == "response":
            out |= {"payload_digest": hashlib.sha1(payload).hexdigest(), "payload_bytes": len(payload), "payload": payload if payloads else None}
        else:  # what the first capture had, by its headers
            size = next(v for k, _, v in (x.partition(":") for x in lines) if k.lower() == "content-length")
            out |= {"payload_digest": base64.b32decode(digest.partition(":")[2]).hex(), "payload_bytes": int(size)}
    elif kind == "metadata":
        out["fields"] = block.decode("utf-8", "replace")
    return out


def read(spark: SparkSession, manifest: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records of the files of a manifest, one file to a task's row; columns as in ``RECORD``."""
    schema = T.StructType.fromDDL(RECORD)
    kind = pa.schema([pa.field(f.name, arrow_type(f.dataType)) for f in schema])

    def run(batches):
        store, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, size = [], 0
                with store.open_input_stream(path, compression=None) as raw, gzip.GzipFile(fileobj=io.BufferedReader(raw, 1 << 20)) as plain:
                    for head, block in records(io.BufferedReader(plain, 1 << 20)):
                        rows.append(parsed(head, block, payloads))
                        size += len(block)
                        if len(rows) >= 2000 or size > 8_000_000:
                            yield pa.RecordBatch.from_pylist(rows, kind)
                            rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, kind)

    return manifest.select("path").repartition(max(1, spark.sparkContext.defaultParallelism), "path").mapInArrow(run, schema)


def assembled(found: DataFrame) -> DataFrame:
    """One nested row for each capture: id, ``response`` (or revisit), ``request`` and ``metadata``.

    A record may name the response, or the response may name it. Of several requests (or metadata records) of
    one response the one with the least id counts; null where there is none. Records of no capture go.
    """
    main = found.where("type in ('response', 'revisit')")
    other = found.where("type in ('request', 'metadata')")
    names = other.select(F.col("id").alias("other"), F.explode("concurrent_to").alias("capture"))
    named = main.select(F.explode("concurrent_to").alias("other"), F.col("id").alias("capture"))
    link = names.unionByName(named).distinct()
    sides = other.withColumnRenamed("id", "other").join(link, "other")
    slim = F.struct(F.col("other").alias("id"), "target", "date", "fields")
    sides = sides.groupBy("capture").agg(*[F.min(F.when(F.col("type") == k, slim)).alias(k) for k in ("request", "metadata")])
    return main.select(F.col("id").alias("capture"), F.struct(*[c for c in main.columns if c not in ("concurrent_to", "fields")]).alias("response")).join(sides, "capture", "left")


def op8_warc(pages: DataFrame) -> DataFrame:
    spark, folder = pages.sparkSession, scratch(pages.sparkSession, "warc")
    found = stored(read(spark, write(pages, folder), folder, payloads=False), "records")
    field = lambda name: F.regexp_extract("metadata.fields", f"(?m)^{name}: (-?[0-9]+)\\r?$", 1)
    number = lambda name: F.when(field(name) != "", field(name)).cast("long")
    return assembled(found).select(number("page-id").alias("page_id"), "response.payload_bytes", "response.payload_digest",
                                   F.col("response.type").alias("record_type"), number("refers-to-page").alias("refers_to"))


SQL = """
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, d AS payload_digest,
       CASE WHEN strlen(h) >= 1000 AND page_id <> m THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN strlen(h) >= 1000 AND page_id <> m THEN m END AS refers_to
FROM (SELECT page_id, h, d, max(page_id) OVER (PARTITION BY d) AS m FROM (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS d FROM pages))
"""
