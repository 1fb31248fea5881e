"""WARC archives with revisit records for repeated payloads.

Headers (id, size, digest) are shuffled by payload digest to find, for each payload that
occurs more than once, the response that the others revisit; page bodies never take part
in that. Bodies are then joined to these decisions by page id and written with fresh
headers as gzip members, one archive after another per task. An archive has a name of its
own for each attempt and counts only when its task succeeded (its row is in the manifest),
so lost executors leave stray files at most.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, new_path

MIN_REVISIT_BYTES = 1000
ARCHIVE_BYTES = 256 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ID_SPACE = 0x8B1D4E5F60714C2D << 64


def record_id(page_id: int) -> str:
    return f"<urn:uuid:{uuid.UUID(int=_ID_SPACE | page_id & (1 << 64) - 1)}>"


def page_of(record: str) -> int:
    low = uuid.UUID(record.strip("<>").removeprefix("urn:uuid:")).int & (1 << 64) - 1
    return low - (1 << 64) if low >> 63 else low


def _clean(value: str | None) -> str:
    return "".join(c for c in value or "" if c >= " ") or "about:blank"


def build_record(page_id: int, url: str | None, payload: bytes, refers_to: int | None = None, refers_url: str | None = None) -> bytes:
    """One WARC/1.1 record; with ``refers_to``, a revisit that leaves the payload out."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_id(page_id)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", _clean(url)),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()),
    ]
    if refers_to is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to)), ("WARC-Refers-To-Target-URI", _clean(refers_url)), ("WARC-Refers-To-Date", DATE)]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


@dataclass
class Record:
    headers: dict[str, str]
    http: dict[str, str]
    payload: bytes


def _fields(lines: list[bytes]) -> dict[str, str]:
    return {k.strip().lower().decode(): v.strip().decode("utf-8", "replace") for k, _, v in (x.partition(b":") for x in lines)}


def parse_record(raw: bytes) -> Record:
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.split(b"\r\n")
    if not version.startswith(b"WARC/1."):
        raise ValueError("not a WARC record")
    headers = _fields(lines)
    block = rest[: int(headers["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return Record(headers, _fields(http.split(b"\r\n")[1:]), payload)


def members(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The gzip members of a stream, one at a time."""
    z, parts, fed = zlib.decompressobj(31), [], False
    for chunk in chunks:
        while chunk:
            parts.append(z.decompress(chunk))
            fed = True
            chunk = b""
            if z.eof:
                yield b"".join(parts)
                chunk, z, parts, fed = z.unused_data, zlib.decompressobj(31), [], False
    if fed:
        raise EOFError("archive ends inside a record")


def gzip_member(raw: bytes, level: int = 4) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def _file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write ``pages`` with revisits resolved; returns the manifest ``path, records, bytes``.

    Of records with equal payloads of at least 1000 bytes the one with the largest
    ``page_id`` is the response and the others revisit it; smaller payloads are always
    responses. A null html is an empty payload, a null url becomes ``about:blank``; extra
    columns are ignored; an empty table gives an empty manifest. ``page_id`` must be
    unique and not null.
    """
    body = F.coalesce(F.col("html"), F.lit(""))
    heads = pages.select("page_id", "url", F.octet_length(body).alias("size"), F.sha1(body.cast("binary")).alias("digest"))
    heads = materialize(heads.where(F.col("size") >= MIN_REVISIT_BYTES), "heads")
    origin = F.max(F.struct("page_id", "url")).alias("origin")
    origins = materialize(heads.groupBy("size", "digest").agg(origin, F.count(F.lit(1)).alias("n")).where("n > 1"), "origins")
    revisits = heads.select("page_id", "size", "digest").join(origins, ["size", "digest"]).where("page_id <> origin.page_id")
    revisits = materialize(revisits.select("page_id", F.col("origin.page_id").alias("refers_to"), F.col("origin.url").alias("refers_url")), "revisits")
    rows = pages.select("page_id", "url", "html").join(revisits, "page_id", "left").select("page_id", "url", "html", "refers_to", "refers_url")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _file_system(folder)
        store.create_dir(base, recursive=True)
        out, name, size, n = None, "", 0, 0
        done = []
        for batch in batches:
            for page, url, html, refers, refers_url in zip(*(batch.column(i) for i in range(5)), strict=True):
                if out is None:
                    name, size, n = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{base}/{name}", compression=None)
                payload = (html.as_py() or "").encode("utf-8", "surrogatepass")
                member = gzip_member(build_record(page.as_py(), url.as_py(), payload, refers.as_py(), refers_url.as_py()))
                out.write(member)
                size, n = size + len(member), n + 1
                if size >= ARCHIVE_BYTES:
                    out.close()
                    done.append((f"{folder}/{name}", n, size))
                    out = None
        if out is not None:
            out.close()
            done.append((f"{folder}/{name}", n, size))
        cols = list(zip(*done, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())], ["path", "records", "bytes"])

    return materialize(rows.mapInArrow(write, "path string, records long, bytes long"), "manifest")


def read_archives(manifest: DataFrame) -> DataFrame:
    """Read the archives named in ``path``, record by record: ``page_id, url, payload_bytes,
    payload_digest, record_type, refers_to``. Digests of responses are computed from what
    was read and checked against their headers."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch["path"].to_pylist():
                store, name = _file_system(path)
                rows = []
                with store.open_input_stream(name, compression=None) as stream:
                    for raw in members(iter(lambda s=stream: s.read(1 << 20), b"")):
                        r = parse_record(raw)
                        kind = r.headers["warc-type"]
                        digest = base64.b32decode(r.headers["warc-payload-digest"].removeprefix("sha1:")).hex()
                        size = int(r.http["content-length"])
                        if kind == "response" and (len(r.payload) != size or hashlib.sha1(r.payload).hexdigest() != digest):
                            raise ValueError(f"{path}: payload does not match its digest")
                        refers = r.headers.get("warc-refers-to")
                        rows.append((page_of(r.headers["warc-record-id"]), r.headers["warc-target-uri"], size, digest, kind, page_of(refers) if refers else None))
                        if len(rows) == 5000:
                            yield _rows(rows)
                            rows = []
                yield _rows(rows)

    files = max(1, min(manifest.count(), 100_000))
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return manifest.select("path").repartition(files).mapInArrow(read, schema)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    cols = list(zip(*rows, strict=True)) or [()] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read them back."""
    return read_archives(write_archives(pages, new_path(pages.sparkSession, "warc")))
