"""Web archives: a converter from the legacy ARC format to WARC, writing of WARC archives, and reading them back.

An ARC file opens with a version block (`filedesc://`) that tells the version of its record header lines:

    1: URL IP-address Archive-date Content-type Archive-length
    2: URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length

A record is such a line, then as many bytes as the declared length, then a line feed. The converter parses the
lines and lengths, and makes equivalent WARC records: an identifier derived from the content (so that reruns agree), the date in ISO form, the
record type from the content, and SHA-1 digests of block and payload.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, shared_table

ARC_FIELDS = {
    1: ("url", "ip", "date", "content-type", "length"),
    2: ("url", "ip", "date", "content-type", "result-code", "checksum", "location", "offset", "filename", "length"),
}
#: Uncompressed bytes after which a part of an archive is closed.
PART_BYTES = 4 << 20
#: Bytes fed to the decompressor at a time.
_PIECE = 1 << 14
#: The date that pages without one are given.
PAGE_DATE = "19970101000000"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL namespace of RFC 4122


class ArchiveError(ValueError):
    """An archive that does not follow its format."""


@dataclass
class ArcRecord:
    url: str
    ip: str
    date: str
    content_type: str
    block: bytes
    extra: dict[str, str] = field(default_factory=dict)


@dataclass
class WarcRecord:
    headers: dict[str, str]
    block: bytes

    @property
    def payload(self) -> bytes:
        return self.block.partition(b"\r\n\r\n")[2] if "application/http" in self.headers.get("Content-Type", "") else self.block


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def arc_version_block(version: int, date: str = "19960923142103", name: str = "part.arc") -> bytes:
    body = f"{version} 0 quern\n{' '.join(('URL', 'IP-address', 'Archive-date', 'Content-type') + (() if version == 1 else ('Result-code', 'Checksum', 'Location', 'Offset', 'Filename')) + ('Archive-length',))}\n".encode()
    line = f"filedesc://{name} 0.0.0.0 {date} text/plain " + ("" if version == 1 else f"200 - - 0 {name} ") + f"{len(body)}\n"
    return line.encode() + body + b"\n"


def arc_record(r: ArcRecord, version: int) -> bytes:
    url = "".join(f"%{b:02X}" if b <= 0x20 or b == 0x7F else chr(b) for b in r.url.encode()).encode("latin-1").decode() if r.url else "-"
    middle = "" if version == 1 else " ".join(r.extra.get(k, "-") or "-" for k in ARC_FIELDS[2][4:-1]) + " "
    return f"{url} {r.ip} {r.date} {r.content_type} {middle}{len(r.block)}\n".encode("utf-8", "surrogateescape") + r.block + b"\n"


def read_arc(data: bytes) -> Iterator[ArcRecord]:
    """The records after the version block. The declared length decides where a record ends, not its content."""
    stream = io.BytesIO(data)
    version = None
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.strip():
            continue
        parts = line.decode("utf-8", "replace").rstrip("\r\n").split(" ")
        if version is None:
            if not parts[0].startswith("filedesc://"):
                raise ArchiveError("no version block")
            body = stream.read(int(parts[-1]))
            if len(body) != int(parts[-1]):
                raise ArchiveError("the version block is cut short")
            version = int(body[:1]) if body[:1].isdigit() else 0
            if version not in ARC_FIELDS:
                raise ArchiveError(f"version {version}")
            continue
        names = ARC_FIELDS[version]
        if len(parts) < len(names):
            raise ArchiveError(f"header line of {len(parts)} fields in version {version}")
        values = dict(zip(names[1:], parts[len(parts) - len(names) + 1 :]))  # from the right: old URLs may hold spaces
        block = stream.read(int(values["length"]))
        if len(block) != int(values["length"]):
            raise ArchiveError("a record is cut short")
        yield ArcRecord(" ".join(parts[: len(parts) - len(names) + 1]), values["ip"], values["date"], values["content-type"], block, {k: v for k, v in values.items() if k in ARC_FIELDS[2][4:-1]})


def record_id(url: str, date: str, block_digest: str) -> str:
    """The identifier of a converted record: the same for the same URL, date and block, in every run."""
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{url} {date} {block_digest}')}>"


def iso_date(date: str) -> str:
    """An archive date of 4 to 14 digits in ISO form. What a short one lacks is the first month and day, and midnight."""
    if not (date.isdigit() and 4 <= len(date) <= 14 and len(date) % 2 == 0):
        raise ArchiveError(f"date {date!r}")
    d = date + "00000101000000"[len(date) :]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def to_warc(r: ArcRecord) -> WarcRecord:
    """The equivalent WARC record: response for HTTP messages, else resource."""
    http = r.block.startswith(b"HTTP/")
    block_digest = base32_sha1(r.block)
    headers = {
        "WARC-Type": "response" if http else "resource",
        "WARC-Record-ID": record_id(r.url, r.date, block_digest),
        "WARC-Date": iso_date(r.date),
        "WARC-Target-URI": r.url,
        "WARC-IP-Address": r.ip,
        "WARC-Block-Digest": f"sha1:{block_digest}",
        "Content-Type": "application/http; msgtype=response" if http else r.content_type,
    }
    w = WarcRecord(headers, r.block)
    headers["WARC-Payload-Digest"] = f"sha1:{base32_sha1(w.payload)}"
    return w


def to_revisit(w: WarcRecord, first: WarcRecord) -> WarcRecord:
    """The same capture without its payload, which the record `first` holds. Its identifier follows from its own, shorter block."""
    head = w.block.partition(b"\r\n\r\n")[0] + b"\r\n\r\n"
    digest = base32_sha1(head)
    own = first.headers
    headers = w.headers | {
        "WARC-Type": "revisit", "WARC-Record-ID": record_id(w.headers["WARC-Target-URI"], w.headers["WARC-Date"], digest), "WARC-Profile": IDENTICAL, "WARC-Refers-To": own["WARC-Record-ID"],
        "WARC-Refers-To-Target-URI": own["WARC-Target-URI"], "WARC-Refers-To-Date": own["WARC-Date"], "WARC-Block-Digest": f"sha1:{digest}",
    }
    return WarcRecord(headers, head)


def write_warc(w: WarcRecord) -> bytes:
    """One compressed member."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in w.headers.items()) + f"Content-Length: {len(w.block)}\r\n\r\n"
    z = zlib.compressobj(4, zlib.DEFLATED, 31)
    return z.compress(head.encode("utf-8", "surrogateescape") + w.block + b"\r\n\r\n") + z.flush()


def read_warc(data: bytes) -> Iterator[WarcRecord]:
    """The records of an archive of compressed members. A member is fed in pieces, so that the rest is not copied for each."""
    at = 0
    while at < len(data):
        z, parts = zlib.decompressobj(31), []
        while not z.eof:
            piece = data[at : at + _PIECE]
            if not piece:
                raise ArchiveError("a member is cut short")
            parts.append(z.decompress(piece))
            at += len(piece) - len(z.unused_data)
        raw = b"".join(parts)
        head, _, rest = raw.partition(b"\r\n\r\n")
        lines = head.decode("utf-8", "surrogateescape").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ArchiveError("no WARC record")
        headers = dict(x.split(": ", 1) for x in lines[1:])
        size = int(headers.pop("Content-Length"))
        if len(rest) < size:
            raise ArchiveError("a record is cut short")
        yield WarcRecord(headers, rest[:size])


def _page_block(page_id, html: str | None) -> bytes:
    payload = (html or "").encode("utf-8", "surrogatepass")
    number = "" if page_id is None else f"X-Page-Id: {page_id}\r\n"
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{number}Content-Length: {len(payload)}\r\n\r\n".encode() + payload


def _page_number(w: WarcRecord, name: bytes) -> int | None:
    for line in w.block.partition(b"\r\n\r\n")[0].split(b"\r\n"):
        key, _, value = line.partition(b": ")
        if key == name:
            return int(value)
    return None


def write_archives(pages: DataFrame, min_bytes: int = 0, part_bytes: int = PART_BYTES) -> DataFrame:
    """(records, content): archive parts, each a valid .warc.gz of about part_bytes before compression.

    Every page is put in a legacy ARC stream (versions 1 and 2 in turn), which the converter turns into WARC.
    The row of the smallest id among equal payloads of at least min_bytes is the response; the others become
    revisits that name its record, URI and date. Which id that is comes from a min per digest, combined before the shuffle; the digests that
    occur more than once are joined back, and a hot one is split by the adaptive join. Null html is an empty payload, a null URL
    is `-`; payloads of any length are whole in one record. An empty table gives no parts.
    """
    spark = pages.sparkSession
    prepare(spark)
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html"), F.sha1(payload).alias("digest"), F.octet_length(payload).alias("bytes"))
    known = F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))
    repeated = base.filter(F.col("bytes") >= min_bytes).groupBy("digest").agg(F.min(known).alias("first"), F.count("*").alias("n")).filter("n > 1 and first is not null")
    repeated = shared_table(spark, repeated.select("digest", "first"), "payloads")
    later = ~F.col("page_id").eqNullSafe(F.col("first.page_id"))
    decided = base.join(repeated, "digest", "left").select("page_id", "url", "html", F.when(later, F.col("first.page_id")).alias("first"), F.when(later, F.col("first.url")).alias("first_url"))

    def convert(page_id, url, html) -> WarcRecord:
        """A page by way of a legacy archive of one record."""
        version = 1 + (page_id or 0) % 2
        record = ArcRecord(url or "-", "0.0.0.0", PAGE_DATE, "text/html", _page_block(page_id, html), {"result-code": "200"})
        (back,) = read_arc(arc_version_block(version) + arc_record(record, version))
        return to_warc(back)

    def run(batches):
        parts: list[bytes] = []
        size = 0
        for b in batches:
            for page_id, url, html, first, first_url in zip(*(c.to_pylist() for c in b.columns)):
                w = convert(page_id, url, html)
                if first is not None:
                    w = to_revisit(w, convert(first, first_url, html))  # the payload is the same, so the response can be made again here
                parts.append(write_warc(w))
                size += len(html or "") + 200
                if size >= part_bytes:
                    yield pa.RecordBatch.from_pydict({"records": pa.array([len(parts)], pa.int64()), "content": pa.array([b"".join(parts)], pa.binary())})
                    parts, size = [], 0
        if parts:
            yield pa.RecordBatch.from_pydict({"records": pa.array([len(parts)], pa.int64()), "content": pa.array([b"".join(parts)], pa.binary())})

    return decided.mapInArrow(run, "records long, content binary")


def read_archives(archives: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, record_id) of every record in archive parts.

    A response's digest is computed from its payload and must equal the stored one. A revisit's page is looked up by the identifier of the
    record that it names; null if the parts do not hold that record. No parts give an empty result.
    """
    spark = archives.sparkSession
    prepare(spark)

    def run(batches):
        for b in batches:
            for data in b.column(0):
                rows = []
                for w in read_warc(data.as_py()):
                    kind, digest = w.headers["WARC-Type"], w.headers["WARC-Payload-Digest"].removeprefix("sha1:")
                    if kind == "response" and digest != base32_sha1(w.payload):
                        raise ArchiveError("a payload differs from its digest")
                    rows.append((_page_number(w, b"X-Page-Id"), _page_number(w, b"Content-Length"), digest, kind, w.headers["WARC-Record-ID"], w.headers.get("WARC-Refers-To")))
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "record_id", "refers"])

    kinds = "page_id long, payload_bytes long, payload_digest string, record_type string, record_id string, refers string"
    rows = shared_table(spark, archives.select("content").mapInArrow(run, kinds), "warc-records")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type"]
    alone = rows.filter("refers is null").select(*columns, F.lit(None).cast("long").alias("refers_to"), "record_id")
    held = rows.filter("record_type = 'response'").groupBy(F.col("record_id").alias("held")).agg(F.min("page_id").alias("refers_to"))
    named = rows.filter("refers is not null").join(held, F.col("refers") == F.col("held"), "left").select(*columns, "refers_to", "record_id")
    return alone.unionByName(named)


def archive_round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write the pages' archives to the shared folder and read them back, one row per page.

    Null html is an empty payload and null URLs are `-`. A null page_id comes back as null; it revisits a numbered page of the same
    payload and is a response if there is none. Repeated rows of the smallest id are responses each. Other columns change nothing. An
    empty table gives an empty result.
    """
    archives = shared_table(pages.sparkSession, write_archives(pages, min_bytes), "warc")
    return read_archives(archives).drop("record_id")
