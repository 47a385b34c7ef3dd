"""Legacy archive converter: ARC files to WARC files, written by Spark and read back.

``parse_arc`` reads an ARC archive of version 1 or 2: the version block at its start names the fields of the header lines that
follow, and the last field of each is the declared length of the record's content. ``convert`` gives each record what a WARC
record has and an ARC record lacks: an identifier, an ISO timestamp, a type, and SHA-1 digests of block and payload. Records with equal
payloads become revisits of the one with the smallest key. WARC files are written with Spark's own text writer and its commit protocol,
each record a row, so a lost task leaves nothing behind and any file system that Spark can write will do. They
begin with a warcinfo record, hold at most ``FILE_RECORDS`` records, and each record is a gzip member of its own, so files can be read from any record on.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintmill.llm.common import binaries, forget, mapped, shared_folder, slices, spread_join, written

ARCHIVE_BYTES = 4 << 20
MIN_BYTES = 0
FILE_RECORDS, MEMBER_BYTES, LEVEL = 5000, 8 << 20, 6
#: So many revisits, of some 150 bytes each, are broadcast instead of moving all payloads.
BROADCAST_ROWS = 100_000
#: What ends a WARC record.
END = b"\r\n\r\n"
FIELDS_1 = b"URL IP-address Archive-date Content-type Archive-length"
FIELDS_2 = b"URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"
DATE = b"20240101000000"
RECORDS = (
    "key bigint, record_id string, warc_type string, target_uri string, warc_date string, ip string, content_type string, "
    "block_digest string, payload_digest string, payload_bytes bigint, http_head binary, payload binary"
)
READ = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, record_id string"
#: An address and a date of up to 14 digits, as they stand in every header line.
_IP, _DAY = rb"(?:\d{1,3}(?:\.\d{1,3}){3}|[0-9A-Fa-f]*:[0-9A-Fa-f:.]+|-)", rb"\d{4,14}"
_KEY = re.compile(rb"^X-Page-Id: (-?\d+)\r$", re.M | re.I)
_LENGTH = re.compile(rb"^Content-Length: (\d+)\r$", re.M | re.I)


def digest(data: bytes) -> str:
    """Bare upper-case base32 of SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def members(data: bytes) -> Iterator[bytes]:
    """The content of each member of a gzip file; other data as they are."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    view, at = memoryview(data), 0
    while data[at : at + 2] == b"\x1f\x8b":
        z, parts = zlib.decompressobj(31), []
        while not z.eof and at < len(data):
            piece = view[at : at + (16 << 10)]
            parts.append(z.decompress(piece))
            at += len(piece) - len(z.unused_data)
        yield b"".join(parts)


def unzipped(data: bytes) -> bytes:
    """The content of a gzip file of one or more members; other data as they are."""
    return b"".join(members(data))


def _http(key: int | None, payload: bytes) -> bytes:
    named = b"" if key is None else b"X-Page-Id: %d\r\n" % key
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: %d\r\n%s\r\n" % (len(payload), named)


def write_arc(name: str, rows: list[tuple[int | None, str | None, bytes]], version: int) -> bytes:
    """An uncompressed ARC archive of (key, url, payload) rows."""
    fields = FIELDS_1 if version == 1 else FIELDS_2
    about = b"%d 0 lintmill\n%s\n" % (version, fields)

    def line(url: bytes, kind: bytes, length: int) -> bytes:
        if version == 1:
            return b"%s 0.0.0.0 %s %s %d\n" % (url, DATE, kind, length)
        return b"%s 0.0.0.0 %s %s 200 - - 0 %s %d\n" % (url, DATE, kind, name.encode(), length)

    out = [line(b"filedesc://" + name.encode(), b"text/plain", len(about)), about, b"\n"]
    for key, url, payload in rows:
        shown = re.sub(rb"[\x00-\x20\x7f]", lambda m: b"%%%02X" % m[0][0], (url or f"urn:page:{key}").encode())
        block = _http(key, payload) + payload
        out += [line(shown, b"text/html", len(block)), block, b"\n"]
    return b"".join(out)


def _header(fields: list[bytes]) -> re.Pattern:
    """Header lines of these fields: address and date by their forms, as far right as they come, so blanks may stand in a URL before and in a media type after them."""
    if fields[:4] == FIELDS_1.split()[:4]:
        return re.compile(rb"(.*) (" + _IP + rb") (" + _DAY + rb") (.*)" + rb" (\S+)" * (len(fields) - 5) + rb" (\d+)")
    return re.compile(rb"(.*)" + rb" (\S+)" * (len(fields) - 2) + rb" (\d+)")


def timestamp(day: bytes, else_day: bytes = DATE) -> str:
    """An ISO time from up to 14 digits, what is missing being the earliest; ``else_day`` counts where there is no such time."""
    for x in (day, else_day, DATE):
        text = x.decode("latin-1") + "00000101000000"[len(x) :]
        try:
            return datetime.strptime(text, "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ").rjust(20, "0")
        except ValueError:
            continue
    raise ValueError("no date")


def parse_arc(data: bytes) -> Iterator[dict]:
    """The records of an archive, without its version block. A line that is no header line is skipped; a length beyond the end
    is cut at the end. ``archive`` is the date of the version block, for records whose own is none."""
    data = unzipped(data)
    at, fields, own = 0, FIELDS_1.split(), DATE
    pattern = _header(fields)
    while at < len(data):
        end = data.find(b"\n", at)
        end = len(data) if end < 0 else end
        header = data[at:end].rstrip(b"\r")
        at = end + 1
        if header.startswith(b"filedesc://"):  # its own line already has the fields of its version
            values = header.split(b" ")
            if not values[-1].isdigit():
                continue
            length = int(values[-1])
            lines = data[at : at + length].split(b"\n")
            fields = lines[1].split() if len(lines) > 1 and lines[1].startswith(b"URL ") else FIELDS_2.split() if lines[0][:1] == b"2" else FIELDS_1.split()
            pattern, own = _header(fields), values[2] if len(values) > 2 else DATE
        elif m := pattern.fullmatch(header):
            length = int(m[m.lastindex])
            yield dict(zip((f.decode("latin-1") for f in fields), m.groups(), strict=True)) | {"block": data[at : at + length], "at": at, "archive": own}
        else:
            continue
        at += length
        if data[at : at + 1] == b"\n":
            at += 1


def convert(record: dict) -> tuple:
    """One row of RECORDS for one record of an ARC archive."""
    block, url = record["block"], record["URL"].decode("utf-8", "replace")
    head, payload, kind = b"", block, "resource"
    if block.startswith(b"HTTP/") and (cut := block.find(b"\r\n\r\n")) >= 0:
        head, payload, kind = block[: cut + 4], block[cut + 4 :], "response"
    date = timestamp(record["Archive-date"], record.get("archive", DATE))
    key = int(m[1]) if (m := _KEY.search(head)) else None
    own = digest(payload)
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{url} {date} {key} {own}")
    mime = "application/http; msgtype=response" if kind == "response" else record["Content-type"].decode("latin-1")
    return key, f"<urn:uuid:{name}>", kind, url, date, record["IP-address"].decode("latin-1"), mime, digest(block), own, len(payload), head, payload


def _table(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(list(c), type=k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _names(ddl: str) -> tuple[list[str], list[pa.DataType]]:
    parts = [x.strip().split(" ") for x in ddl.split(",")]
    return [n for n, _ in parts], [{"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}[k] for _, k in parts]


def to_arc(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """Archives (name, content) of about ``ARCHIVE_BYTES`` each, versions 1 and 2 in turn. A null body is empty."""
    return mapped(_bodies(pages, id_col, url_col, body_col), lambda batches: (_table([x], ["name", "content"], [pa.string(), pa.binary()]) for x in _archives(batches)), "name string, content binary")


def _bodies(pages: DataFrame, id_col: str, url_col: str, body_col: str) -> DataFrame:
    return pages.select(F.col(id_col).cast("bigint"), F.col(url_col).cast("string"), F.col(body_col).cast("string"))


def _archives(batches) -> Iterator[tuple[str, bytes]]:
    for n, batch in enumerate(batches):
        keys, urls, bodies = batch.column(0).to_pylist(), batch.column(1).to_pylist(), binaries(batch.column(2))
        for k, (lo, hi) in enumerate(slices(bodies, ARCHIVE_BYTES)):
            rows = [(key, url, body or b"") for key, url, body in zip(keys[lo:hi], urls[lo:hi], bodies[lo:hi], strict=True)]
            name = f"{n:05}-{k:05}.arc"
            yield name, write_arc(name, rows, 1 + k % 2)


def _records(content: bytes | None) -> Iterator[pa.RecordBatch]:
    """Rows of RECORDS, ``ARCHIVE_BYTES`` of payload or one record at a time."""
    names, kinds = _names(RECORDS)
    rows, held = [], 0
    for record in parse_arc(content or b""):
        rows.append(convert(record))
        held += len(record["block"]) + 256
        if held >= ARCHIVE_BYTES:
            yield _table(rows, names, kinds)
            rows, held = [], 0
    yield _table(rows, names, kinds)


def arc_to_warc(archives: DataFrame, content_col: str = "content") -> DataFrame:
    """One row of RECORDS per record of the archives in ``content_col``, as read with the binaryFile source; null archives have none."""
    return mapped(archives.select(content_col), lambda batches: (x for batch in batches for content in batch.column(0) for x in _records(content.as_py())), RECORDS)


def pages_to_warc(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """One row of RECORDS per page, by way of archives that never leave the worker; payloads are compressed, since they are stored and moved once more."""
    return mapped(_bodies(pages, id_col, url_col, body_col), lambda batches: (_compressed(x) for _, content in _archives(batches) for x in _records(content)), RECORDS)


def _codec() -> pa.Codec:
    return pa.Codec("zstd", compression_level=3)


def _compressed(records: pa.RecordBatch) -> pa.RecordBatch:
    codec = _codec()
    payloads = pa.array([codec.compress(x.as_buffer(), asbytes=True) for x in records.column("payload")], pa.binary())
    return records.set_column(records.schema.get_field_index("payload"), "payload", payloads)


def revisits(records: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """(key, payload_digest, payload_bytes, refers_to, refers_to_id) of the records whose payload of ``min_bytes`` or more a smaller key already has.

    A hot payload is counted before the shuffle, and what it refers to is broadcast. Records without key are never referred to.
    """
    same = ["payload_digest", "payload_bytes"]
    large = records.where((F.col("payload_bytes") >= min_bytes) & F.col("key").isNotNull()).select("key", "record_id", *same)
    first = large.groupBy(*same).agg(F.min("key").alias("refers_to"), F.min_by("record_id", F.struct("key", "record_id")).alias("refers_to_id"), F.count("*").alias("n"))
    later = spread_join(large.drop("record_id"), first.where("n > 1"), same, large.count())
    return later.where("key <> refers_to").select("key", *same, "refers_to", "refers_to_id").distinct()


def _warc(record: dict, codec: pa.Codec | None) -> bytes:
    """A record without the two blank lines that end it."""
    revisit = record["refers_to"] is not None
    payload = b"" if revisit else codec.decompress(record["payload"], record["payload_bytes"], asbytes=True) if codec else record["payload"]
    block = record["http_head"] + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else record['warc_type']}",
        f"WARC-Record-ID: {record['record_id']}",
        f"WARC-Date: {record['warc_date']}",
        f"WARC-Target-URI: {record['target_uri']}",
        f"WARC-IP-Address: {record['ip']}",
        f"WARC-Payload-Digest: sha1:{record['payload_digest']}",
        f"WARC-Block-Digest: sha1:{digest(block) if revisit else record['block_digest']}",
        f"Content-Type: {record['content_type']}",
    ]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record['refers_to_id']}", f"X-Refers-To-Page-Id: {record['refers_to']}"]
    lines += [f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block


def _members(record: bytes) -> bytes:
    """A record as a gzip member, or as several if it has ``MEMBER_BYTES`` or more, without the last byte, which is always zero.

    That byte is the highest one of the member's length, and the text writer puts it after each row as its line separator.
    """
    parts = [record[i : i + MEMBER_BYTES] for i in range(0, len(record), MEMBER_BYTES)]
    return b"".join(gzip.compress(x, LEVEL, mtime=0) for x in parts)[:-1]


def write_warc(records: DataFrame, path: str, compressed: bool = False) -> None:
    """Write RECORDS with columns refers_to and refers_to_id (null: none) as WARC files of at most ``FILE_RECORDS`` records under ``path``."""
    about = b"software: lintmill\r\nformat: WARC File Format 1.1\r\n"
    head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, path)}>\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(about)}\r\n\r\n"
    info = _members(head.encode() + about + END)

    def run(batches):
        written_rows, codec = 0, _codec() if compressed else None
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                rows = []
                for r in batch.slice(lo, 500).to_pylist():
                    if written_rows % FILE_RECORDS == 0:  # Spark begins a new file after as many rows
                        rows.append(info)
                        written_rows += 1
                    rows.append(_members(_warc(r, codec) + END))
                    written_rows += 1
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], names=["value"])

    rows = mapped(records, run, "value binary").select(F.col("value").cast("string"))
    rows.write.mode("overwrite").option("lineSep", "\0").option("maxRecordsPerFile", FILE_RECORDS).text(path)


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers with lower-case names, block) of each record of a WARC file, by the declared lengths."""
    data, at = unzipped(data), 0
    while (end := data.find(b"\r\n\r\n", at)) >= 0:
        lines = data[at:end].decode("utf-8", "replace").lstrip("\r\n").split("\r\n")
        headers = {n.strip().lower(): v.strip() for n, _, v in (x.partition(":") for x in lines[1:])}
        at = end + 4
        length = int(headers.get("content-length", 0))
        yield headers, data[at : at + length]
        at += length + 4


def _whole_records(data: bytes) -> Iterator[bytes]:
    """A file's content a few records at a time: members up to one that ends a record as records end."""
    held, size = [], 0
    for part in members(data):
        held.append(part)
        size += len(part)
        if size >= ARCHIVE_BYTES and len(part) < MEMBER_BYTES:
            yield b"".join(held)
            held, size = [], 0
    if held:
        yield b"".join(held)


def read_warc(files: DataFrame, content_col: str = "content") -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, record_id) of the response, resource and revisit records in WARC files.

    The digest of a stored payload is computed anew; one that differs from its header is an error. A revisit has those of its header.
    """

    def run(batches):
        names, kinds = _names(READ)
        for batch in batches:
            for content in batch.column(0):
                for part in _whole_records(content.as_py() or b""):
                    rows = []
                    for headers, block in parse_warc(part):
                        kind = headers["warc-type"]
                        if kind == "warcinfo":
                            continue
                        cut = block.find(b"\r\n\r\n") + 4 if block.startswith(b"HTTP/") else 0
                        head, payload = block[:cut], block[cut:]
                        told = headers["warc-payload-digest"].removeprefix("sha1:")
                        if kind != "revisit" and digest(payload) != told:
                            raise ValueError(f"payload of {headers['warc-record-id']} does not match its digest")
                        size = int(m[1]) if kind == "revisit" and (m := _LENGTH.search(head)) else len(payload)
                        refers = headers.get("x-refers-to-page-id")
                        rows.append((int(m[1]) if (m := _KEY.search(head)) else None, size, told, kind, int(refers) if refers else None, headers["warc-record-id"]))
                    yield _table(rows, names, kinds)

    return mapped(files.select(content_col), run, READ)


def round_trip(pages: DataFrame, *, min_bytes: int = MIN_BYTES, path: str | None = None) -> DataFrame:
    """Pages through ARC archives into WARC files at ``path`` (default: a new shared folder), and what the files then hold.

    A null html is an empty payload. An empty table gives no rows. Rows with a null page_id are stored as responses. Rows of one page_id
    are judged each by its own payload; rows that agree in both are all of the same type, so those of the smallest page_id are all
    responses. Other columns of ``pages`` are not read, a null url becomes one made from the id.
    """
    spark = pages.sparkSession
    path = path or shared_folder(spark, "warc")
    records = written(pages_to_warc(pages), "records", "zstd")
    same = ["key", "payload_digest", "payload_bytes"]
    earlier = written(revisits(records, min_bytes), "revisits")
    if earlier.count() <= BROADCAST_ROWS:  # else the records move to them
        earlier = F.broadcast(earlier)
    named = records.where("key is not null").join(earlier, same, "left")
    none = F.lit(None)
    write_warc(named.unionByName(records.where("key is null").withColumns({"refers_to": none.cast("bigint"), "refers_to_id": none.cast("string")})), path, compressed=True)
    forget(records)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return read_warc(spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path))
