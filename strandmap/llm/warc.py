"""Legacy web archives: write ARC files, convert them to WARC files, read WARC files.

ARC records of version 1 have the header line
    URL IP-address Archive-date Content-type Archive-length
and those of version 2
    URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length
each followed by as many bytes as declared and a newline. A version block
(filedesc://) opens a file and names its version. The converter trusts the
declared lengths and synthesises what WARC asks for: record ids, dates in ISO
form, record types and payload digests.

Archives are written by Spark's text writer, whose line separator is the end
of a record, so they land in any file system Spark writes to, survive lost
executors, and each file is one gzip member. Files are as large as a task's
share of the rows, which is cut down where it passes ``FILE_BYTES``.
"""

from __future__ import annotations

import base64
import hashlib
import math
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmap.llm.common import lean, meet, ship, stored

_SPACE_IN_URL = str.maketrans({chr(c): f"%{c:02X}" for c in range(33)} | {"\x7f": "%7F"})
#: Bytes of the table of repeated payloads that are broadcast at most, and of payloads of one archive file.
BROADCAST_BYTES, FILE_BYTES = 64_000_000, 512_000_000
_BYTES = 8_000_000
#: gzip at its fastest level: archives of this kind are written once, and compression is most of the work.
_GZIP = {"compression": "gzip", "zlib.compress.level": "BEST_SPEED"}


def digest(payload: bytes) -> str:
    """SHA-1 in upper-case base32, as archives write it."""
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def record_id(*parts: object) -> str:
    """A record id that depends on the parts alone."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, '|'.join(map(str, parts)))}>"


def arc_version_block(version: int, name: str, date: str) -> bytes:
    fields = "URL IP-address Archive-date Content-type Archive-length" if version == 1 else "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"
    body = f"{version} 0 strandmap\n{fields}\n".encode()
    extra = "" if version == 1 else " 200 - - 0 " + name
    return f"filedesc://{name} 0.0.0.0 {date} text/plain{extra} {len(body)}\n".encode() + body


def arc_record(version: int, url: str, ip: str, date: str, mime: str, body: bytes, name: str) -> bytes:
    url = url.translate(_SPACE_IN_URL) or "urn:none"
    extra = "" if version == 1 else f" 200 {hashlib.md5(body, usedforsecurity=False).hexdigest()} - 0 {name}"
    return f"{url} {ip} {date} {mime}{extra} {len(body)}\n".encode() + body


def _arc_rows(version: int | None, ip: str, date: str):
    def run(batches):
        task = TaskContext.get().partitionId()
        v = version or 1 + task % 2
        name = f"part-{task:05d}.arc"
        yield pa.RecordBatch.from_arrays([pa.array([arc_version_block(v, name, date)], pa.binary())], names=["record"])
        for batch in batches:
            out, total = [], 0
            for page, url, payload in zip(*(batch.column(c) for c in ("page_id", "url", "payload")), strict=True):
                payload = payload.as_py() or b""
                page = page.as_py()
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Page-Id: {'' if page is None else page}\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
                out.append(arc_record(v, url.as_py() or "", ip, date, "text/html", head + payload, name))
                total += len(payload)
                if total >= _BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])
                    out, total = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    return run


def write_arc(pages: DataFrame, path: str, version: int | None = None, payload: str = "html", ip: str = "0.0.0.0", date: str = "20240101000000") -> None:
    """Write page_id, url and ``payload`` (text in UTF-8 or bytes) as ARC files of HTTP responses.

    Null payloads are empty, null urls become urn:none, white space in urls is
    escaped, a null page_id is left empty, repeated rows are records of their
    own. version is 1, 2, or None for both in turn by file. An empty table
    gives files without records, at most.
    """
    ship(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col(f"`{payload}`").cast("binary").alias("payload"))
    shares = rows.groupBy(F.spark_partition_id().alias("p")).agg(F.sum(F.octet_length("payload")).alias("n")).agg(F.max("n").alias("top"), F.sum("n").alias("all")).first()
    if (shares.top or 0) > FILE_BYTES:
        rows = rows.repartition(2 * math.ceil(shares["all"] / FILE_BYTES))
    rows.mapInArrow(lean(_arc_rows(version, ip, date)), "record binary").select(F.col("record").cast("string")).write.options(lineSep="\n", **_GZIP).text(path)


class _Reader:
    """Bytes of a gzip or plain file, inflated as they are read."""

    def __init__(self, content: bytes):
        self.content = memoryview(content)
        self.zip = zlib.decompressobj(31) if content[:2] == b"\x1f\x8b" else None
        self.at = 0
        self.buffer = bytearray()
        self.start = 0
        self.gone = 0

    @property
    def place(self) -> int:
        """Bytes of the inflated file that were read."""
        return self.gone + self.start

    def _more(self) -> bool:
        if self.at >= len(self.content) and not (self.zip and self.zip.unconsumed_tail):
            return False
        chunk = self.content[self.at : self.at + 262_144]
        self.at += len(chunk)
        if self.zip is None:
            self.buffer += chunk
            return True
        self.buffer += self.zip.decompress(chunk)
        while self.zip.eof and self.zip.unused_data:  # further gzip members
            rest = self.zip.unused_data
            self.zip = zlib.decompressobj(31)
            self.buffer += self.zip.decompress(rest)
        if self.zip.eof and self.at < len(self.content):
            self.zip = zlib.decompressobj(31)
        return True

    def _trim(self) -> None:
        if self.start > 1_000_000:
            del self.buffer[: self.start]
            self.gone += self.start
            self.start = 0

    def line(self) -> bytes | None:
        """The next line without its end; None at the end of the file."""
        self._trim()
        seen = self.start
        while (end := self.buffer.find(b"\n", seen)) < 0:
            seen = len(self.buffer)
            if not self._more():
                if self.start == len(self.buffer):
                    return None
                end = len(self.buffer)
                break
        out = bytes(self.buffer[self.start : end])
        self.start = min(end + 1, len(self.buffer))
        return out.rstrip(b"\r")

    def take(self, n: int) -> bytes:
        while len(self.buffer) - self.start < n and self._more():
            pass
        out = bytes(self.buffer[self.start : self.start + n])
        self.start += len(out)
        return out


def parse_arc(content: bytes) -> Iterator[dict]:
    """Records of an ARC file, in order, without its version blocks.

    The version comes from the latest version block; without one, the number of
    fields of the line tells it. A declared length that passes the end of the
    file is cut there and marked; lines that are no header are passed over.
    file is the name in the latest version block, at the place of the record.
    """
    reader, version, name = _Reader(content), 0, ""
    at = 0
    while (line := reader.line()) is not None:
        here, at = at, reader.place
        if not line:
            continue
        v = version or (1 if line.count(b" ") < 9 else 2)
        if line.startswith(b"filedesc://"):
            last = line.rsplit(b" ", 1)[-1]
            body = reader.take(int(last) if last.isdigit() else 0)
            version, at = 2 if body[:1] == b"2" else 1, reader.place
            name = line.split(b" ", 1)[0][len(b"filedesc://") :].decode("utf-8", "replace")
            continue
        fields = line.rsplit(b" ", 4 if v == 1 else 9)
        if len(fields) < (5 if v == 1 else 10) or not fields[-1].isdigit():
            continue
        length = int(fields[-1])
        body = reader.take(length)
        at = reader.place
        yield {"file": name, "at": here, "url": fields[0].decode("utf-8", "replace"), "ip": fields[1].decode("utf-8", "replace"), "date": fields[2].decode("utf-8", "replace"), "mime": fields[3].decode("utf-8", "replace"), "body": body, "whole": len(body) == length, "version": v}


def _http(body: bytes) -> tuple[bytes, bytes]:
    """Head with its blank line, and payload, of an HTTP response; a body without a head is payload."""
    if not body.startswith(b"HTTP/"):
        return b"", body
    end = body.find(b"\r\n\r\n")
    return (body, b"") if end < 0 else (body[: end + 4], body[end + 4 :])


def _header(head: bytes, name: bytes) -> str:
    for line in head.split(b"\r\n")[1:]:
        key, _, value = line.partition(b":")
        if key.strip().lower() == name:
            return value.strip().decode("utf-8", "replace")
    return ""


def _iso(date: str) -> str:
    """The ISO form of a date of up to 14 digits, missing ones filled up."""
    d = (date + "00000101000000"[len(date) :])[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


_CONVERTED = "record_id string, page_id long, uri string, ip string, date string, digest string, payload_bytes long, head binary, payload binary"


def _batches(rows: Iterator[tuple], names: list[str], types: list[pa.DataType], weigh):
    held, total = [], 0
    for row in rows:
        held.append(row)
        total += weigh(row)
        if total >= _BYTES or len(held) >= 5000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)
            held, total = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)


def _number(text: str) -> int | None:
    return int(text) if text.lstrip("-").isdigit() else None


def _converted(with_payload: bool):
    names = ["record_id", "page_id", "uri", "ip", "date", "digest", "payload_bytes", "head", "payload"]
    types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.binary()]

    def rows(batches):
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
                for r in parse_arc(content.as_py()):
                    head, payload = _http(r["body"])
                    d = digest(payload)
                    page = _header(head, b"x-page-id")
                    # By its place, so that repeated records differ; the name in the file is the same in every run.
                    yield record_id(r["file"] or path.as_py().rsplit("/", 1)[-1], r["at"], r["url"], r["date"], d), _number(page), r["url"], r["ip"], _iso(r["date"]), d, len(payload), head if with_payload else None, payload if with_payload else None

    return lambda batches: _batches(rows(batches), names, types, lambda r: 200 + len(r[8] or b""))


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")


def arc_to_warc(spark: SparkSession, arc_path: str, warc_path: str, least: int = 0) -> None:
    """Convert ARC files to WARC files.

    Records whose payloads are equal and have ``least`` bytes or more share one
    response, that with the largest page id (then record id); the others
    become revisits that refer to it and hold the HTTP head alone. Repeated
    records have ids of their own, so all but one of them are revisits; records
    without a page id come last. The table of repeated payloads, not the
    payloads, meets the records: broadcast up to ``BROADCAST_BYTES``, else
    joined by record id, which no two records share.
    """
    ship(spark)
    records = _files(spark, arc_path)
    small = stored(records.mapInArrow(lean(_converted(False)), _CONVERTED).select("record_id", "page_id", "uri", "date", "digest", "payload_bytes"), "arc-index")
    groups = small.where(F.col("payload_bytes") >= least).groupBy("digest", "payload_bytes").agg(F.max(F.struct("page_id", "record_id", "uri", "date")).alias("first"), F.count("*").alias("n")).where("n > 1")
    groups = stored(groups.select("digest", "payload_bytes", "n", F.col("first.record_id").alias("to"), F.col("first.uri").alias("to_uri"), F.col("first.date").alias("to_date")), "arc-groups")
    key = ["digest", "payload_bytes"]
    full = records.mapInArrow(lean(_converted(True)), _CONVERTED)
    if (groups.agg(F.sum(F.octet_length("to_uri") + 200)).first()[0] or 0) <= BROADCAST_BYTES:
        rows = full.join(F.broadcast(groups.drop("n")), key, "left")
    else:
        rows = full.join(meet(small, groups, key, "n").select("record_id", "to", "to_uri", "to_date"), "record_id", "left")
    revisit = F.col("to").isNotNull() & (F.col("to") != F.col("record_id"))
    block = F.when(revisit, F.col("head")).otherwise(F.concat("head", "payload"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    refers = F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", F.col("to")), line("WARC-Refers-To-Target-URI", F.col("to_uri")), line("WARC-Refers-To-Date", F.col("to_date")))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", F.col("record_id")),
        line("WARC-Date", F.col("date")),
        line("WARC-Target-URI", F.col("uri")),
        line("WARC-IP-Address", F.col("ip")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(revisit, refers).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
    )
    text = F.concat(head.cast("binary"), block).cast("string")
    rows.select(text.alias("record")).write.options(lineSep="\r\n\r\n", **_GZIP).text(warc_path)


def parse_warc(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields in lower case, block) of each record of a WARC file."""
    reader = _Reader(content)
    while (line := reader.line()) is not None:
        if not line.startswith(b"WARC/"):
            continue
        fields = {}
        while line := reader.line():
            key, _, value = line.partition(b":")
            fields[key.decode().strip().lower()] = value.decode("utf-8", "replace").strip()
        yield fields, reader.take(int(fields.get("content-length", "0")))


_READ = "record_id string, record_type string, page_id long, uri string, date string, payload_digest string, payload_bytes long, refers_to_id string, digest_ok boolean, payload binary"


def _warc_rows(with_payload: bool):
    names = [f.split(" ")[0] for f in _READ.split(", ")]
    types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.binary()]

    def rows(batches):
        for batch in batches:
            for content in batch.column("content"):
                for fields, block in parse_warc(content.as_py()):
                    kind = fields.get("warc-type", "")
                    if kind not in ("response", "revisit"):
                        continue
                    head, payload = _http(block)
                    told = fields.get("warc-payload-digest", "").removeprefix("sha1:")
                    full = kind == "response"
                    found = digest(payload) if full else told
                    size = len(payload) if full else _number(_header(head, b"content-length"))
                    yield fields.get("warc-record-id"), kind, _number(_header(head, b"x-page-id")), fields.get("warc-target-uri"), fields.get("warc-date"), found, size, fields.get("warc-refers-to"), found == told, payload if with_payload and full else None

    return lambda batches: _batches(rows(batches), names, types, lambda r: 200 + len(r[9] or b""))


def read_warc(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """Responses and revisits of WARC files, with the page id that a revisit refers to.

    digest_ok tells whether a response's payload has the digest its header
    names; payload_bytes of a revisit comes from its HTTP head. A revisit whose
    response is missing refers to null, as does one of a response without a
    page id. Folders without records give no rows.
    """
    ship(spark)
    files = _files(spark, path)
    small = stored(files.mapInArrow(lean(_warc_rows(False)), _READ), "warc-index")
    rows = files.mapInArrow(lean(_warc_rows(True)), _READ) if with_payload else small
    # Only revisits look for a response, each crowd of them in place.
    wanted = small.where("record_type = 'revisit' and refers_to_id is not null").groupBy("refers_to_id").agg(F.count("*").alias("n"))
    responses = small.where("record_type = 'response'").groupBy(F.col("record_id").alias("refers_to_id")).agg(F.max("page_id").alias("refers_to"))
    found = stored(wanted.join(responses, "refers_to_id", "left"), "warc-targets")
    lone = (F.col("record_type") != "revisit") | F.col("refers_to_id").isNull()
    columns = [f.split(" ")[0] for f in _READ.split(", ")] + ["refers_to"]
    revisits = meet(rows.where(~lone), found, ["refers_to_id"], "n").select(*columns)
    return rows.where(lone).withColumn("refers_to", F.lit(None).cast("long")).select(*columns).unionByName(revisits)
