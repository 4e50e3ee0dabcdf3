"""WARC archives: writing, and a reader that splits archives by byte ranges.

Each record is a gzip member of its own. A reading task gets a byte range of an
archive, looks for the gzip magic, takes a member as a record only if its
decoded start is a WARC version line with a complete header block, and owns
the records that start inside its range; it reads the last one to its end,
wherever that is. Members are inflated piece by piece.

Archives are written and read through the shared folder's own file system. A
writing task names its files after itself at random and reports their names
when they are complete, so what a lost or repeated task left is never read.

Defined results: a null html is an empty payload; null urls give records
without a target; equal payloads share one response, that of the largest
page id (all rows of that id, if it repeats); a null page id counts as smaller
than any other and comes back as null. An empty table writes and reads no
record. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import shared_path, ship_package

MAGIC = b"\x1f\x8b\x08"
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_CHUNK = 1 << 18
_FIELD = re.compile(rb"[!#$%&'*+.^_`|~0-9A-Za-z-]+[ \t]*:")
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass(frozen=True)
class Settings:
    """file_bytes: an archive is closed beyond this size. split_bytes: the range a reading task gets."""

    file_bytes: int = 1 << 30
    split_bytes: int = 16 << 20
    date: str = "1970-01-01T00:00:00Z"
    level: int = 6


@dataclass
class Record:
    headers: dict[str, str] = field(default_factory=dict)
    http: dict[str, str] = field(default_factory=dict)
    payload: bytes = b""
    offset: int = 0


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def page_of(urn: str | None) -> int | None:
    text = (urn or "").removeprefix("<urn:x-page:").removesuffix(">")
    return int(text) if text else None


def member(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, settings: Settings) -> bytes:
    """One record as a gzip member: a response, or a revisit if it refers to another page."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {settings.date}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if revisit:
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {record_id(refers_to)}"]
    whole = "\r\n".join(head).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(settings.level, zlib.DEFLATED, 31)
    return packer.compress(whole) + packer.flush()


def _headers(block: bytes) -> dict[str, str]:
    lines = block.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines) if k.strip()}


def parse(whole: bytes, offset: int) -> Record:
    """A record from its decoded bytes."""
    head, _, rest = whole.partition(b"\r\n\r\n")
    out = Record(_headers(head), offset=offset)
    block = rest[: int(out.headers.get("content-length", "0"))]
    if out.headers.get("content-type", "").startswith("application/http"):
        http, _, out.payload = block.partition(b"\r\n\r\n")
        out.http = _headers(http)
    else:
        out.payload = block
    return out


def inflate(source, at: int) -> tuple[bytes, int] | None:
    """The record that starts as a gzip member at this offset and where the member ends; None if none does."""
    unpack, out, checked, pos = zlib.decompressobj(31), bytearray(), False, at
    line = 0  # the first header line that isn't complete yet
    source.seek(at)
    try:
        while not unpack.eof:
            data = source.read(_CHUNK)
            if not data:
                return None
            pos += len(data)
            seen = len(out)
            out += unpack.decompress(data)
            if line == 0 and (unpack.eof or len(out) >= 10):
                if not _VERSION.match(out):
                    return None
                line = 10
            while line and not checked:
                end = out.find(b"\r\n", max(line, seen - 1))
                if end < 0:
                    break
                if end == line:
                    checked = True
                elif out[line] not in b" \t" and not _FIELD.match(out, line, end):
                    return None
                line = end + 2
    except zlib.error:
        return None
    return (bytes(out), pos - len(unpack.unused_data)) if checked else None


def records(source, start: int, end: int) -> Iterator[Record]:
    """Records of an open archive that start in [start, end)."""
    at, overlap = start, len(MAGIC) - 1
    while at < end:
        if found := inflate(source, at):
            yield parse(found[0], at)
            at = found[1]
            continue
        at += 1  # no record here: look for the next magic
        while at < end:
            source.seek(at)
            data = source.read(min(_CHUNK, end - at + overlap))
            hit = data.find(MAGIC)
            if hit >= 0:
                at += hit
                break
            if len(data) <= overlap:
                at = end
            else:
                at += len(data) - overlap


def _fs(path: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(path)


def write(pages: DataFrame, folder: str, settings: Settings = Settings()) -> list[tuple[str, int]]:
    """Write a record for each page into archives in a folder; their paths and sizes."""
    ship_package(pages.sparkSession)
    body = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", body.alias("html"), F.sha1(body.cast("binary")).alias("_digest"))
    first = rows.groupBy("_digest").agg(F.max("page_id").alias("_response"))
    rows = rows.join(first, "_digest").withColumn(
        "_refers", F.when(F.col("page_id").eqNullSafe(F.col("_response")), None).otherwise(F.col("_response"))
    )

    def archives(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = _fs(folder)
        name, out, size = "", None, 0
        for batch in batches:
            for page_id, url, html, refers in zip(batch["page_id"], batch["url"], batch["html"], batch["_refers"]):
                if out is None:
                    name, size = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(f"{base}/{name}", compression=None)
                made = member(
                    None if pd.isna(page_id) else int(page_id),
                    url,
                    html.encode("utf-8", "surrogatepass"),
                    None if pd.isna(refers) else int(refers),
                    settings,
                )
                out.write(made)
                size += len(made)
                if size >= settings.file_bytes:
                    out.close()
                    out = None
                    yield pd.DataFrame({"name": [name], "size": [size]})
        if out is not None:
            out.close()
            yield pd.DataFrame({"name": [name], "size": [size]})

    fs, base = _fs(folder)
    fs.create_dir(base, recursive=True)
    ids = rows.select(F.col("page_id").cast("string").alias("page_id"), "url", "html", F.col("_refers").cast("string").alias("_refers"))
    found = ids.mapInPandas(archives, "name string, size long").collect()
    return sorted((f"{folder}/{r['name']}", r["size"]) for r in found)


def read(spark: SparkSession, archives: list[tuple[str, int]], settings: Settings = Settings()) -> DataFrame:
    """All records: page_id, record_type, refers_to, payload_bytes, payload_digest, target, payload, path and offset.

    payload_bytes and payload_digest are of the full payload; a revisit's come
    from its headers. `valid` says whether a response's payload has its digest.
    """
    ship_package(spark)
    ranges = [
        (path, at, min(at + settings.split_bytes, size))
        for path, size in archives
        for at in range(0, size, settings.split_bytes)
    ]
    schema = (
        "page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, "
        "target string, payload binary, valid boolean, path string, offset long"
    )

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, start, end in zip(batch["path"], batch["start"], batch["stop"]):
                fs, name = _fs(path)
                with fs.open_input_file(name) as source:
                    rows, held = [], 0
                    for r in records(source, int(start), int(end)):
                        h = r.headers
                        kind, named = h.get("warc-type"), h.get("warc-payload-digest", "").removeprefix("sha1:")
                        n = len(r.payload) if kind == "response" else int(r.http.get("content-length", "0"))
                        rows.append(
                            (
                                page_of(h.get("warc-record-id")),
                                kind,
                                page_of(h.get("warc-refers-to")),
                                n,
                                named,
                                h.get("warc-target-uri"),
                                r.payload,
                                kind != "response" or digest(r.payload) == named,
                                path,
                                r.offset,
                            )
                        )
                        held += len(r.payload)
                        if held > 8 << 20:
                            yield _frame(rows, schema)
                            rows, held = [], 0
                    if rows:
                        yield _frame(rows, schema)

    if not ranges:
        return spark.createDataFrame([], schema)
    splits = spark.createDataFrame(ranges, "path string, start long, stop long")
    return splits.repartition(len(ranges), "path", "start").mapInPandas(load, schema)


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    made = pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])
    return made.astype({"page_id": "Int64", "refers_to": "Int64"})


def round_trip(pages: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Write every page to archives in the shared folder and read the archives back."""
    spark = pages.sparkSession
    return read(spark, write(pages, shared_path(spark, "warc"), settings), settings)
