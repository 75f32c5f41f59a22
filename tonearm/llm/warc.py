"""Legacy web archives: write ARC, convert ARC to WARC, read WARC, all through Spark's own file sources.

An ARC file begins with a version block; each record is one header line, whose fields depend on the version, and as many
bytes as the line declares. The converter reads files as bytes, walks them by those declared lengths, and synthesises for
each record what WARC asks for: a record id, an ISO timestamp, a type (response, revisit of an equal payload, resource without HTTP header, metadata for what is no
record) and digests. Every record is a gzip member of its own and files are cut by bytes, so memory holds one compressed file and one record.
Payloads are never shuffled: which records revisit which is worked out on digests, and the answers meet the files by path.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonearm.llm.worker import tidy
from tonearm.storage import drop_at_exit, fresh_path, materialize, remove

#: Fixed values of the two ARC versions: the fields of a record's header line, in order.
ARC_FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
#: WARC's version line, record end, and the profile of a revisit of an equal payload.
WARC_VERSION = "WARC/1.1"
WARC_END = "\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payload bytes of one Arrow batch out of a reader.
BATCH_BYTES = 8 << 20
#: Uncompressed bytes after which a writer begins the next file.
FILE_BYTES = 64 << 20
#: Revisits, of about 60 bytes each, that are sent to every task.
MAX_BROADCAST_REVISITS = 1_000_000

ARC_ROWS = "page_id long, url string, ip string, archived string, mime string, http string, payload binary, payload_bytes long, digest string, problem string, path string, offset long"
WARC_ROWS = "record_id string, record_type string, url string, date string, page_id long, payload_bytes long, payload_digest string, refers_to long, truncated boolean, payload binary"


def _one_field(x) -> str:
    """A value that may stand in a space-separated or one-line header: white space and controls percent-encoded, null or empty a dash."""
    return "".join(f"%{ord(c):02X}" if c in " \t\n\r\v\f\0" else c for c in str("" if x is None else x)) or "-"


def _write_members(rows: DataFrame, path: str, records: Callable[[pa.RecordBatch], Iterator[bytes]], start: Callable[[bytes], bytes], file_bytes: int) -> None:
    """Write what ``records`` gives for the batches of ``rows``, each record as a gzip member, in files of about ``file_bytes`` that begin with ``start(first record)``.

    A file is one row of the text source, which ends it with a line separator: the zero byte with which the last member's size ends.
    """

    def closed(parts: list[bytes]) -> bytes:
        whole = b"".join(parts)
        return (whole if whole.endswith(b"\0") else whole + gzip.compress(b"", mtime=0))[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in batches:
            for record in records(batch):
                if not parts:
                    parts.append(gzip.compress(start(record), 6, mtime=0))
                parts.append(gzip.compress(record, 6, mtime=0))
                size += len(record)
                if size >= file_bytes:
                    yield pa.record_batch([pa.array([closed(parts)], pa.binary())], names=["value"])
                    parts, size = [], 0
        if parts:
            yield pa.record_batch([pa.array([closed(parts)], pa.binary())], names=["value"])

    out = rows.mapInArrow(tidy(run), "value binary").select(F.col("value").cast("string").alias("value"))
    out.write.option("maxRecordsPerFile", 1).option("lineSep", "\0").text(path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path).select("path", "content")


def write_arc(pages: DataFrame, path: str, version: int = 1, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", file_bytes: int = FILE_BYTES, date: str = "20240101000000") -> None:
    """Write ``pages`` as gzipped ARC files under ``path``; null payloads are empty, null ids and urls a dash."""
    names = ARC_FIELDS[version]

    def line(url: str, kind: str, length: int) -> bytes:
        known = {"URL": url, "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": kind, "Result-code": "200", "Archive-length": str(length)}
        return " ".join(known.get(n, "-") for n in names).encode() + b"\n"

    def records(batch: pa.RecordBatch) -> Iterator[bytes]:
        for page, url, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            body = body.as_py() or b""
            block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Page-Id: {_one_field(page)}\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body
            yield line(_one_field(url), "text/html", len(block)) + block + b"\n"

    about = f"{version} 0 tonearm\n{' '.join(names)}\n".encode()
    first = line("filedesc://tonearm.arc", "text/plain", len(about)) + about + b"\n"
    rows = pages.select(F.col(id_col), F.col(url_col), F.col(payload_col).cast("binary"))
    _write_members(rows, path, records, lambda _: first, file_bytes)


def _opened(content: bytes) -> io.BufferedIOBase:
    raw = io.BytesIO(content)
    return io.BufferedReader(gzip.GzipFile(fileobj=raw), 1 << 20) if content[:2] == b"\x1f\x8b" else raw


def _header(parts: list[bytes], version: int) -> dict[str, bytes] | None:
    """The fields of an ARC header line; none if it is no such line."""
    names = ARC_FIELDS[version]
    if len(parts) < len(names) or not parts[-1].isdigit():
        return None
    # A content type may hold blanks; the fields around it do not.
    tail = len(names) - 4
    return dict(zip(names, [*parts[:3], b" ".join(parts[3 : len(parts) - tail]), *parts[len(parts) - tail :]]))


def arc_records(content: bytes) -> Iterator[dict]:
    """Records of one ARC file of either version, the version block left out: fields, block, offset, problem.

    A record cut off by the file's end has the problem ``truncated``. Lines that stand where a header should and are none are skipped up to the next header
    line; they come out as one record without fields and the problem ``malformed``. A version block without a number is of version 1.
    """
    f, version, offset, lost, lost_at = _opened(content), 1, 0, [], 0
    while line := f.readline():
        at, offset = offset, offset + len(line)
        parts = line.split()
        described = parts[:1] and parts[0].startswith(b"filedesc://") and parts[-1].isdigit()
        fields = None if described else _header(parts, version)
        if not described and fields is None:
            if parts:
                lost_at = lost_at if lost else at
                lost.append(line)
            continue
        if lost:
            yield {"fields": {}, "block": b"".join(lost), "offset": lost_at, "problem": "malformed"}
            lost = []
        length = int(parts[-1])
        block = f.read(length)
        offset += len(block)
        if described:
            said = block.split(None, 1)[:1]
            version = int(said[0]) if said and said[0].isdigit() and int(said[0]) in ARC_FIELDS else 1
            continue
        yield {"fields": fields, "block": block, "offset": at, "problem": "truncated" if len(block) < length else None}
    if lost:
        yield {"fields": {}, "block": b"".join(lost), "offset": lost_at, "problem": "malformed"}


def split_http(block: bytes) -> tuple[bytes, bytes, dict[bytes, bytes]]:
    """Header text, body and headers (lower-case names) of an HTTP message; a block without one is all body."""
    if not block.startswith(b"HTTP/"):
        return b"", block, {}
    head, _, body = block.partition(b"\r\n\r\n")
    return head, body, {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:])}


def _whole(x: bytes | None) -> int | None:
    return int(x) if x and x.lstrip(b"-").isdigit() else None


def _batches(rows: Iterator[tuple[dict, int]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row, weight in rows:
        held.append(row)
        size += weight + 200
        if size > BATCH_BYTES:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _arc_row(where: str, r: dict) -> tuple[dict, bytes, bytes]:
    """A record's row without its payload, its HTTP header as it stands, and the payload."""
    head, body, named = split_http(r["block"])
    field = {k: v.decode("utf-8", "replace") for k, v in r["fields"].items()}
    row = {"page_id": _whole(named.get(b"x-page-id")), "url": field.get("URL"), "ip": field.get("IP-address"), "archived": field.get("Archive-date"), "mime": field.get("Content-type"), "http": head.decode("utf-8", "replace"), "payload": None, "payload_bytes": len(body), "digest": hashlib.sha256(body).hexdigest(), "problem": r["problem"], "path": where, "offset": r["offset"]}
    return row, head, body


def read_arc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """A row per record: page_id, url, ip, archived, mime, http (header text), payload, payload_bytes, digest (SHA-256), problem (null, truncated or malformed), path, offset."""
    schema = pa.schema([("page_id", pa.int64()), *[(n, pa.string()) for n in ("url", "ip", "archived", "mime", "http")], ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("digest", pa.string()), ("problem", pa.string()), ("path", pa.string()), ("offset", pa.int64())])

    def rows(batch: pa.RecordBatch) -> Iterator[tuple[dict, int]]:
        for where, content in zip(batch.column(0).to_pylist(), batch.column(1)):
            for r in arc_records(content.as_py()):
                row, _, body = _arc_row(where, r)
                yield (row | {"payload": body}, len(body)) if payloads else (row, 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _batches(rows(batch), schema)

    return _files(spark, path).mapInArrow(tidy(run), ARC_ROWS)


def _named_by(page_id: int | None, digest: str, path: str, offset: int) -> str:
    return hashlib.sha256(f"{'-' if page_id is None else page_id}|{digest}|{path.rsplit('/', 1)[-1]}|{offset}".encode()).hexdigest()[:32]


def _record_id(x: str) -> str:
    """Out of 32 hex digits."""
    return f"<urn:uuid:{x[:8]}-{x[8:12]}-{x[12:16]}-{x[16:20]}-{x[20:32]}>"


def _stamp(archived: str | None) -> str:
    """An ARC date as WARC writes it; what is missing is the earliest it can be, what is no date is 1970."""
    d = archived or ""
    d = (d + "19700101000000"[len(d) :])[:14] if d.isdigit() and len(d) >= 4 else "19700101000000"
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:]}Z"


def warc_record(row: dict, head: bytes, body: bytes, first: dict | None) -> bytes:
    """The WARC record of an ARC record; ``first`` names the record that it revisits."""
    http = head + b"\r\n\r\n" if head else b""
    lost = row["problem"] == "malformed"
    block = http + (b"" if first else body)
    kind = "metadata" if lost else "revisit" if first else "response" if http else "resource"
    lines = [WARC_VERSION, f"WARC-Type: {kind}", f"WARC-Record-ID: {_record_id(_named_by(row['page_id'], row['digest'], row['path'], row['offset']))}", f"WARC-Date: {_stamp(row['archived'])}"]
    if not lost:
        lines += [f"WARC-Target-URI: {row['url']}", f"WARC-IP-Address: {row['ip']}", f"WARC-Payload-Digest: sha256:{row['digest']}"]
    if first:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {_record_id(first['name'])}", f"X-Refers-To-Page-Id: {'-' if first['page_id'] is None else first['page_id']}"]
    if row["problem"] == "truncated":
        lines.append("WARC-Truncated: length")
    lines += [f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", f"Content-Type: {'application/http; msgtype=response' if http else 'application/octet-stream' if lost else row['mime']}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + WARC_END.encode()


def _info(first: bytes) -> bytes:
    """A file's first record, by the first record after it."""
    named = next(warc_records(first))[0]
    said = f"software: tonearm\r\nformat: {WARC_VERSION}\r\n"
    uid = _record_id(_named_by(None, "warcinfo", named[b"warc-record-id"].decode(), 0))
    return f"{WARC_VERSION}\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: {uid}\r\nWARC-Date: {named[b'warc-date'].decode()}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(said)}\r\n\r\n{said}{WARC_END}".encode()


def convert_arc(spark: SparkSession, arc_path: str, warc_path: str, min_payload: int = 100, file_bytes: int = FILE_BYTES, max_broadcast_revisits: int = MAX_BROADCAST_REVISITS) -> None:
    """Convert the ARC files under ``arc_path`` to gzipped WARC files under ``warc_path``.

    Of records with equal payloads of at least ``min_payload`` bytes the one with the smallest page id (null ids last; ties
    by place in the archive) becomes a response and the others revisit it; all smaller ones are responses. A truncated record is a response marked
    ``WARC-Truncated: length`` and neither revisits nor is revisited; malformed lines become a metadata record that holds them. Files without records give no file. ``max_broadcast_revisits`` changes no result.
    """
    place = lambda: F.struct(F.col("page_id").isNull().alias("none"), "page_id", "path", "offset")
    whole = read_arc(spark, arc_path, payloads=False).where((F.col("payload_bytes") >= min_payload) & F.col("problem").isNull())
    whole = materialize(whole.select("digest", "page_id", "path", "offset"), "arc-places")
    seen = whole.groupBy("digest").agg(F.min(place()).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    first = F.col("first")
    name = F.substring(F.sha2(F.concat_ws("|", F.coalesce(first["page_id"].cast("string"), F.lit("-")), "digest", F.substring_index(first["path"], "/", -1), first["offset"].cast("string")), 256), 1, 32)
    again = whole.join(seen, "digest").where(place() != first).select("path", "offset", F.struct(first["page_id"].alias("page_id"), name.alias("name")).alias("first"))
    again = materialize(again, "arc-revisits")
    answers = again.groupBy("path").agg(F.collect_list(F.struct("offset", "first")).alias("revisits"))
    # Sent to all tasks up to a size; beyond it the compressed files are joined with them by path.
    answers = F.broadcast(answers) if again.count() <= max_broadcast_revisits else answers

    def records(batch: pa.RecordBatch) -> Iterator[bytes]:
        for where, content, revisits in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
            known = {x["offset"]: x["first"] for x in revisits.as_py() or ()}
            for r in arc_records(content.as_py()):
                yield warc_record(*_arc_row(where, r), known.get(r["offset"]))

    _write_members(_files(spark, arc_path).join(answers, "path", "left").select("path", "content", "revisits"), warc_path, records, _info, file_bytes)


def warc_records(content: bytes) -> Iterator[tuple[dict[bytes, bytes], bytes]]:
    """Headers (lower-case names) and block of each record of one WARC file, by declared lengths."""
    f = _opened(content)
    while line := f.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("not at the start of a WARC record")
        named = {}
        while (line := f.readline()).strip():
            k, _, v = line.partition(b":")
            named[k.strip().lower()] = v.strip()
        yield named, f.read(int(named[b"content-length"]))


def read_warc(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """A row per response, revisit and resource; the payload's length and digest are of the full payload for all.

    A payload's digest is computed anew and must equal the declared one; a revisit has no payload, so its length is what the kept HTTP header declares.
    """
    schema = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("url", pa.string()), ("date", pa.string()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("truncated", pa.bool_()), ("payload", pa.binary())])

    def rows(batch: pa.RecordBatch) -> Iterator[tuple[dict, int]]:
        for content in batch.column(1):
            for named, block in warc_records(content.as_py()):
                kind = named[b"warc-type"].decode()
                if kind not in ("response", "revisit", "resource"):
                    continue
                _, body, http = split_http(block)
                said = named[b"warc-payload-digest"].decode().removeprefix("sha256:")
                if kind != "revisit" and hashlib.sha256(body).hexdigest() != said:
                    raise ValueError(f"payload digest differs in {named[b'warc-record-id']!r}")
                yield {"record_id": named[b"warc-record-id"].decode(), "record_type": kind, "url": named[b"warc-target-uri"].decode("utf-8", "replace"), "date": named[b"warc-date"].decode(), "page_id": _whole(http.get(b"x-page-id")), "payload_bytes": len(body) if kind != "revisit" else _whole(http.get(b"content-length")), "payload_digest": said, "refers_to": _whole(named.get(b"x-refers-to-page-id")), "truncated": b"warc-truncated" in named, "payload": body if payloads else None}, len(body) * payloads

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _batches(rows(batch), schema)

    return _files(spark, path).mapInArrow(tidy(run), WARC_ROWS)


def round_trip(pages: DataFrame, version: int = 1, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """``pages`` through ARC files, the converter and WARC files in the shared folder, read back: one row per row of ``pages``.

    Null payloads are empty; null urls become a dash; null ids come back null; repeated rows are records of their own, of which one is the response;
    an empty table writes empty archives and gives no rows; other columns are not read.
    """
    spark = pages.sparkSession
    arc, warc = fresh_path(spark, "arc"), fresh_path(spark, "warc")
    write_arc(pages, arc, version, id_col, url_col, payload_col)
    convert_arc(spark, arc, warc)
    remove(spark, arc)
    drop_at_exit(spark, warc)
    return read_warc(spark, warc)
