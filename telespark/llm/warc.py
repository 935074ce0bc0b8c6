"""Web archives in ZIP packages: writer, directory reader and range reader.

A package is a ZIP file with a stored (uncompressed) member `archive/data.warc.gz`, one
gzip member per record, and a stored `indexes/index.cdx.gz`: per record a line "key
timestamp {json}" in key order, the key being the address with its host reversed, the
JSON naming file (relative to `archive/`), offset and length. The reader also takes
packages written elsewhere: plain or gzipped indexes, with or without keys, numbers with
or without quotes, names with or without their folder, plain records, records without
page id, length or digest, and digests by SHA-1 (base 32). The reader never extracts a package: it reads the tail of the
file, follows the end-of-directory record (or the ZIP64 one), parses the central
directory, finds the data of stored members behind their local headers, reads the index
and then only the byte range of each record. Index lines are spread over all tasks
before the records are read, so one large package is read by many of them.

Packages are written by the tasks themselves (any file system pyarrow can open) under
names no other attempt uses; the manifest, a stored table of the attempts that
succeeded, says which files count. A lost or repeated attempt leaves a file behind that
no manifest names.

Records with equal payloads of at least `MIN_REVISIT` bytes: the one with the smallest
page id is the response, the others are revisits without a payload. A revisit keeps the
payload's digest in its WARC header and its length in its HTTP header.

Defined results: null html is an empty payload; a null url leaves the header out; a null
page id counts as larger than all others (if all are null, all are responses); rows that
repeat the smallest page id are all responses; an empty table gives no package and no
rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import folder, shuffle_partitions, stash

MIN_REVISIT = 100
PACKAGE_BYTES = 128 << 20
PACKAGE_RECORDS = 100_000
_WARC = "archive/data.warc.gz"
_INDEX = "indexes/index.cdx.gz"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "2024-01-01T00:00:00Z"
_STAMP = "20240101000000"
_NEIGHBOURS = 4 << 20       # ranges this close are read by one task

# --- records ------------------------------------------------------------------------


def page_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
                 html_col: str = "html") -> DataFrame:
    """page_id, url, payload, digest, refers_to (null: response)."""
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    p = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"),
                     payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    firsts = (p.where(F.octet_length("payload") >= MIN_REVISIT).groupBy("digest")
              .agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
              .where("copies > 1 and first_id is not null").select("digest", "first_id"))
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id"))
    return (p.join(firsts, "digest", "left")
            .select("page_id", "url", "payload", "digest", refers.alias("refers_to")))


def encode_record(page_id: int | None, url: str | None, payload: bytes, digest: str,
                  refers_to: int | None) -> bytes:
    """One WARC record, gzipped on its own."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    revisit = refers_to is not None
    block = http.encode() + (b"" if revisit else payload)
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
            f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", f"WARC-Date: {_DATE}",
            f"WARC-Payload-Digest: sha256:{digest}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~')}")
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if revisit:
        head += [f"WARC-Profile: {_PROFILE}", f"X-Refers-To-Page-ID: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    raw = ("\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"
    return gzip.compress(raw, 1, mtime=0)


def _headers(raw: bytes) -> tuple[dict[str, str], int]:
    """Header fields (lower-case names) and where the block starts."""
    end = raw.index(b"\r\n\r\n")
    lines = raw[:end].decode().split("\r\n")[1:]
    pairs = (line.split(":", 1) for line in lines)
    return {k.strip().lower(): v.strip() for k, v in pairs}, end + 4


def decode_record(data: bytes) -> dict:
    """The fields of one record, gzipped or plain; raises if a payload does not match its
    digest or a length is wrong. A revisit's length and digest are what its headers say, null
    where they say nothing; the digest of a payload that is there is always its SHA-256."""
    raw = zlib.decompress(data, 31) if data[:2] == b"\x1f\x8b" else data
    head, at = _headers(raw)
    block = raw[at:at + int(head["content-length"])]
    if len(block) != int(head["content-length"]) or raw[at + len(block):] != b"\r\n\r\n":
        raise ValueError("record length does not match its header")
    http, body = ({}, 0)
    if head.get("content-type", "").startswith("application/http"):
        http, body = _headers(block)
    payload, kind = block[body:], head["warc-type"]
    length = int(http["content-length"]) if "content-length" in http else None
    method, _, value = head.get("warc-payload-digest", "").partition(":")
    digest = value.lower() if method == "sha256" else None
    if kind != "revisit":
        found = hashlib.sha256(payload).hexdigest()
        sha1 = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if length not in (None, len(payload)) or digest not in (None, found) or (
                method == "sha1" and value.upper() != sha1):
            raise ValueError("payload does not match its length or digest")
        length, digest = len(payload), found
    page, refers = head.get("x-page-id"), head.get("x-refers-to-page-id")
    return {"page_id": None if page is None else int(page), "url": head.get("warc-target-uri"),
            "payload_bytes": length, "payload_digest": digest, "record_type": kind,
            "refers_to": None if refers is None else int(refers),
            "payload": payload if kind != "revisit" else None}


def url_key(url: str | None) -> str:
    """An address as an index key: host reversed, then the path, lower-case; what has no
    host is kept, without blanks; "-" if there is none."""
    if not url:
        return "-"
    try:
        parts = urlsplit(url)
        host, port = parts.hostname, parts.port
    except ValueError:                      # broken brackets or port
        host = None
    if not host:
        return quote(url.lower(), safe=":/?#[]@!$&()*+,;=%~")
    path = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return (quote(",".join(reversed(host.split("."))), safe=",-_:[]%") + (f":{port}" if port else "") + ")"
            + quote(path.lower(), safe="/?@!$&()*+,;=%~:"))


# --- writing ------------------------------------------------------------------------

class _Package:
    """A ZIP being written: records go straight to the stored archive member."""

    def __init__(self, uri: str):
        self.uri = f"{uri}/{uuid.uuid4().hex}.wacz"
        system, path = fs.FileSystem.from_uri(self.uri)
        system.create_dir(path.rpartition("/")[0], recursive=True)
        self.out = system.open_output_stream(path)
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_STORED)
        self.member = self.zip.open(_WARC, "w", force_zip64=True)
        self.size, self.index = 0, []

    def add(self, data: bytes, url: str | None, digest: str) -> None:
        self.member.write(data)
        entry = {"url": url, "mime": "text/html", "status": "200", "digest": f"sha256:{digest}",
                 "length": str(len(data)), "offset": str(self.size), "filename": _WARC.removeprefix("archive/")}
        self.index.append(f"{url_key(url)} {_STAMP} {json.dumps(entry)}\n")
        self.size += len(data)

    def close(self) -> tuple[str, int, int]:
        self.member.close()
        self.zip.writestr(_INDEX, gzip.compress("".join(sorted(self.index)).encode(), 1, mtime=0))
        self.zip.close()
        self.out.close()
        return self.uri, len(self.index), self.size


def _write(uri: str, package_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        package, done = None, []
        for batch in batches:
            for i in range(batch.num_rows):
                page_id, url, payload, digest, refers = (batch.column(c)[i].as_py() for c in range(5))
                package = package or _Package(uri)
                package.add(encode_record(page_id, url, payload, digest, refers), url, digest)
                if package.size >= package_bytes or len(package.index) >= PACKAGE_RECORDS:
                    done.append(package.close())
                    package = None
        if package:
            done.append(package.close())
        yield pa.RecordBatch.from_arrays(
            [pa.array([d[i] for d in done], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))],
            names=["path", "records", "bytes"])
    return run


def write_packages(records: DataFrame, uri: str, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Write the records of `page_records`; returns the manifest (path, records, bytes)."""
    return stash(records.select("page_id", "url", "payload", "digest", "refers_to")
                 .mapInArrow(_write(uri, package_bytes), "path string, records long, bytes long"),
                 "warc-manifest")


# --- reading ------------------------------------------------------------------------

def _wide(extra: bytes, wanted: list[bool]) -> list[int]:
    """The 8-byte values of the ZIP64 extra field, in the order of the saturated ones."""
    at = 0
    while at + 4 <= len(extra):
        tag, size = struct.unpack_from("<HH", extra, at)
        if tag == 1:
            return list(struct.unpack_from(f"<{sum(wanted)}Q", extra, at + 4))
        at += 4 + size
    raise ValueError("ZIP64 extra field missing")


def directory(source) -> list[dict]:
    """Members of a ZIP in an open random-access file: name, method, size, offset (of the
    local header), from the central directory; ZIP64 records are followed."""
    end = source.size()
    tail_size = min(end, 65_557 + 20)
    source.seek(end - tail_size)
    tail = source.read(tail_size)
    at = tail.rfind(b"PK\x05\x06")
    if at < 0:
        raise ValueError("no end-of-directory record")
    count, size, offset = struct.unpack_from("<HII", tail, at + 10)
    if at >= 20 and tail[at - 20:at - 16] == b"PK\x06\x07":
        source.seek(struct.unpack_from("<Q", tail, at - 12)[0])
        record = source.read(56)
        if record[:4] != b"PK\x06\x06":
            raise ValueError("ZIP64 end-of-directory record missing")
        count, size, offset = struct.unpack_from("<QQQ", record, 32)
    source.seek(offset)
    data, at, out = source.read(size), 0, []
    for _ in range(count):
        if data[at:at + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        method, = struct.unpack_from("<H", data, at + 10)
        packed, plain, names, extras, comments = struct.unpack_from("<IIHHH", data, at + 20)
        local, = struct.unpack_from("<I", data, at + 42)
        name = data[at + 46:at + 46 + names].decode()
        extra = data[at + 46 + names:at + 46 + names + extras]
        full = [x == 0xFFFFFFFF for x in (plain, packed, local)]
        if any(full):
            wide = iter(_wide(extra, full))
            plain, packed, local = (next(wide) if f else x for f, x in zip(full, (plain, packed, local)))
        out.append({"name": name, "method": method, "size": packed, "offset": local})
        at += 46 + names + extras + comments
    return out


def data_offset(source, member: dict) -> int:
    """Where a member's data starts: behind its local header."""
    source.seek(member["offset"])
    head = source.read(30)
    if head[:4] != b"PK\x03\x04":
        raise ValueError("broken local header")
    names, extras = struct.unpack_from("<HH", head, 26)
    return member["offset"] + 30 + names + extras


def index_entries(data: bytes) -> Iterator[tuple[str, int, int]]:
    """(file name, offset, length) of an index, gzipped or plain: lines of JSON, behind a
    key and a timestamp or alone; blank lines and headers ("!...") are passed over."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    for line in data.splitlines():
        line = line.strip()
        if not line or line.startswith(b"!"):
            continue
        entry = json.loads(line if line.startswith(b"{") else line.split(None, 2)[2])
        yield entry["filename"], int(entry["offset"]), int(entry["length"])


def record_ranges(source) -> Iterator[tuple[int, int]]:
    """(offset, length) in the file of every record the package's indexes list."""
    members = {m["name"]: m for m in directory(source)}
    starts = {name: data_offset(source, m) for name, m in members.items()
              if name.startswith("archive/") and m["method"] == 0}
    for name, m in members.items():
        if not name.startswith("indexes/") or not name.endswith((".cdx", ".cdxj", ".cdx.gz", ".cdxj.gz")):
            continue
        at = data_offset(source, m)
        source.seek(at)
        data = source.read(m["size"])
        if m["method"] == 8:
            data = zlib.decompress(data, -15)
        for filename, offset, length in index_entries(data):
            start = starts.get(filename, starts.get(f"archive/{filename}"))
            if start is None:
                raise ValueError(f"no stored member {filename}")
            yield start + offset, length


def _open(uri: str):
    system, path = fs.FileSystem.from_uri(uri)
    return system.open_input_file(path)


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for uri in batch.column(0).to_pylist():
            with _open(uri) as source:
                found = list(record_ranges(source))
            yield pa.RecordBatch.from_arrays(
                [pa.array([uri] * len(found), pa.string()), pa.array([x[0] for x in found], pa.int64()),
                 pa.array([x[1] for x in found], pa.int64())], names=["path", "at", "length"])


_RECORD = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()),
                     ("payload_digest", pa.string()), ("record_type", pa.string()),
                     ("refers_to", pa.int64()), ("payload", pa.binary())])


def _read(with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uri, source = None, None
        for batch in batches:
            rows, size = [], 0
            for path, at, length in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if path != uri:
                    if source:
                        source.close()
                    uri, source = path, _open(path)
                source.seek(at)
                row = decode_record(source.read(length))
                size += len(row["payload"] or b"")
                if not with_payload:
                    row["payload"] = None
                rows.append(row)
                if with_payload and size > 32 << 20:
                    yield pa.RecordBatch.from_pylist(rows, schema=_RECORD)
                    rows, size = [], 0
            yield pa.RecordBatch.from_pylist(rows, schema=_RECORD)
        if source:
            source.close()
    return run


def read_packages(manifest: DataFrame, with_payload: bool = True) -> DataFrame:
    """Every record of the packages the manifest names, by range reads."""
    ranges = manifest.select("path").mapInArrow(_ranges, "path string, at long, length long")
    parts = shuffle_partitions(manifest.sparkSession)
    near = F.floor(F.col("at") / _NEIGHBOURS)
    spread = ranges.repartition(parts, "path", near).sortWithinPartitions("path", "at")
    return spread.mapInArrow(_read(with_payload), (
        "page_id long, url string, payload_bytes long, payload_digest string, record_type string, "
        "refers_to long, payload binary"))


def round_trip(spark: SparkSession, pages: DataFrame, with_payload: bool = False) -> DataFrame:
    """Write all pages to packages in the shared folder and read them back."""
    manifest = write_packages(page_records(pages), folder(spark, "warc"))
    return read_packages(manifest, with_payload)
