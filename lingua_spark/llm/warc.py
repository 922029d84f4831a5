"""WARC archives: writer with revisit records, and a salvage reader (operator 6).

Writer: one gzip member per record (WARC/1.1). Of records with equal payloads of at least MIN_REVISIT bytes the one
with the smallest page_id is the response and the others are revisits of it; smaller ones are all responses.
Spark's text writer and committer write the files, so they may lie in any store and survive lost executors. It ends
each row with a zero byte: that is the last byte of a gzip member (the high byte of a length below 2^24), which the
row therefore leaves out. Longer records are split into several members.

Salvage reader: for gzip and plain archives. Each record's version line, length, end and digests are checked. After a
failure it searches for the next gzip member that opens and holds a record, or the next plain version
line at which a record passes, goes on there, and logs the bytes between as a quarantined gap. Inside a member of
several records the same holds for its content: what a broken or cut member still gives is searched for version lines at
which a record passes, and the gaps between are logged with their place in the content.

Files are read whole by one task each; the writer bounds them by records and bytes (FILE_CLASSES).

Defined cases: a null html is the empty payload; a null url writes no target; control characters and blanks in a url
are percent-encoded; a page without page_id is always a response and reads back without one; several rows with the
smallest page_id of a payload are all responses; empty tables write no records; extra columns are ignored. A revisit whose
response was lost keeps its row, without payload figures. A record inside the payload of a broken record may be taken for one.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from lingua_spark.llm.common import cut_lineage, delete_folder, scratch_folder, stored

MIN_REVISIT = 100
RECORDS_PER_FILE = 2000
#: (payload bytes up to which a page belongs to the class, its records per file): a file holds 64 MB of payloads at most, or one.
FILE_CLASSES = ((1 << 15, RECORDS_PER_FILE), (1 << 19, 125), (1 << 23, 8), (1 << 62, 1))
DATE = "2024-01-01T00:00:00Z"
_MEMBER = (1 << 24) - 1
_GZIP = b"\x1f\x8b\x08"
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"


def _member(data: bytes) -> bytes:
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def pack(data: bytes) -> bytes:
    """gzip members of a record."""
    return b"".join(_member(data[i:i + _MEMBER]) for i in range(0, len(data), _MEMBER))


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One uncompressed WARC record; a revisit holds the HTTP header alone."""
    http = _HTTP + b"Content-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
            f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}:{digest[:32]}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    head.append(f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"WARC-Refers-To: <urn:page:{refers_to}:{digest[:32]}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return ("WARC/1.1\r\n" + "\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for page_id, url, html, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            data = pack(record(page_id, url, (html or "").encode(), digest, refers_to))
            rows.append(data[:-1])  # the writer's row end is the last byte, 0
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], ["record"])


def write_archives(pages: DataFrame, path: str, records_per_file: int = RECORDS_PER_FILE) -> None:
    """pages(page_id, url, html, ...) as archives in a new folder."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.col("html").cast("string").alias("html")).withColumn("digest", F.sha2(F.coalesce("html", F.lit("")), 256))
    groups = stored(rows.where(f"octet_length(html) >= {MIN_REVISIT}").groupBy("digest")
                    .agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").drop("n"))
    linked = (rows.join(groups, "digest", "left")
              .withColumn("refers_to", F.when(F.col("page_id") > F.col("first"), F.col("first"))))
    size = F.coalesce(F.octet_length("html"), F.lit(0))
    largest, least = rows.agg(F.max(size)).first()[0] or 0, -1
    for most, per_file in FILE_CLASSES:
        if least < 0 or least < largest:
            mine = linked.where((size > least) & (size <= most)) if largest > FILE_CLASSES[0][0] else linked
            (mine.select("page_id", "url", "html", "digest", "refers_to").mapInArrow(_records, "record binary")
             .select(F.col("record").cast("string"))
             .write.mode("append").option("lineSep", "\u0000").option("maxRecordsPerFile", min(records_per_file, per_file)).text(path))
        least = most


@dataclass
class Found:
    offset: int
    length: int
    reason: str = ""  # not empty: a quarantined gap
    head: dict = field(default_factory=dict)
    payload: bytes = b""
    inside: int = -1  # a gap inside a member: where it begins in the content, and its length
    inside_length: int = 0


class Damaged(Exception):
    pass


def parse(data: bytes, at: int = 0) -> tuple[dict, bytes, int]:
    """(headers, block, end) of the uncompressed record at a place; Damaged if a check fails."""
    if not _VERSION.match(data, at):
        raise Damaged("no version line")
    end = data.find(b"\r\n\r\n", at)
    if end < 0:
        raise Damaged("header not ended")
    head = {}
    for line in data[at:end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("bad header line")
        head[name.decode("latin-1").strip().lower()] = value.decode("utf-8", "replace").strip()
    if not head.get("content-length", "").isdigit():
        raise Damaged("bad length")
    start = end + 4
    stop = start + int(head["content-length"])
    if stop + 4 > len(data):
        raise Damaged("record cut short")
    if data[stop:stop + 4] != b"\r\n\r\n":
        raise Damaged("record end missing")
    block = data[start:stop]
    if _digest_differs(head.get("warc-block-digest"), block):
        raise Damaged("block digest differs")
    if head.get("warc-type") == "response" and _digest_differs(head.get("warc-payload-digest"), payload_of(head, block)):
        raise Damaged("payload digest differs")
    return head, block, stop + 4


def _digest_differs(said: str | None, data: bytes) -> bool:
    name, _, value = (said or "").partition(":")
    return name.lower() == "sha256" and hashlib.sha256(data).hexdigest() != value.lower()


def payload_of(head: dict, block: bytes) -> bytes:
    if head.get("content-type", "").startswith("application/http"):
        return block.partition(b"\r\n\r\n")[2]
    return block


_STEP = 1 << 14


def _open_member(data: bytes, at: int) -> tuple[bytes, int, str]:
    """(content, end, fault) of the gzip member at a place: of a broken or cut member all that can be inflated, with a fault."""
    d, out, pos = zlib.decompressobj(31), [], at
    step = _STEP
    while pos < len(data) and not d.eof:
        kept = d.copy()
        try:
            out.append(d.decompress(data[pos:pos + step]))
        except zlib.error as e:
            if step == 1:
                return b"".join(out), pos, f"gzip: {e}"
            d, step = kept, step // 2  # what the step gave before the fault is lost: smaller steps
            continue
        pos += step
    if not d.eof:
        return b"".join(out), len(data), "gzip member cut short"
    return b"".join(out), min(pos, len(data)) - len(d.unused_data), ""


def _content_records(content: bytes, cut: str) -> tuple[list[tuple[dict, bytes]], list[tuple[int, int, str]], int]:
    """(records, gaps, place) of a member's content: `place` is where a last record begins that the content does not
    end, if a search after it finds no other (len(content) without one, or if the member itself is broken: `cut`)."""
    records, gaps, pos = [], [], 0
    while pos < len(content):
        try:
            head, block, pos = parse(content, pos)
            records.append((head, block))
            continue
        except Damaged as e:
            reason = str(e)
        for m in _VERSION.finditer(content, pos + 1):
            try:
                parse(content, m.start())
            except Damaged:
                continue
            gaps.append((pos, m.start() - pos, reason))
            pos = m.start()
            break
        else:
            if reason in ("record cut short", "header not ended") and not cut:
                return records, gaps, pos
            gaps.append((pos, len(content) - pos, cut or reason))
            break
    return records, gaps, len(content)


def _records_at(data: bytes, at: int) -> tuple[list[tuple[dict, bytes]], list[tuple[int, int, str]], int, bool]:
    """(records, gaps inside, end, whole) at a place, in a gzip member (or several, if a record goes on) or plain; Damaged
    without any record. Not whole: the member is broken, so its end is not known."""
    if not data.startswith(_GZIP, at):
        head, block, end = parse(data, at)
        return [(head, block)], [], end, True
    content, end, fault = _open_member(data, at)
    if not fault and not content:
        return [], [], end, True
    records, gaps, place = _content_records(content, fault)
    while place < len(content):  # its last record goes on in the next member, unless that begins with one of its own
        more, later, broken = _open_member(data, end) if data.startswith(_GZIP, end) else (b"", end, "record cut short")
        if not more or broken or _VERSION.match(more):
            gaps.append((place, len(content) - place, "record cut short"))
            break
        base, content, end = place, content[place:] + more, later
        new, inner, place = _content_records(content, "")
        records += new
        gaps += [(base + g, n, why) for g, n, why in inner]
    if not records:
        raise Damaged(gaps[0][2] if gaps else fault or "no version line")
    if fault and sum(gaps[-1][:2] if gaps else (0, 0)) < len(content):
        gaps.append((len(content), 0, fault))  # nothing but the member's end is lost
    return records, gaps, end, not fault


def _next_place(data: bytes, at: int) -> int:
    """The next place from `at` on where a member or a version line may begin."""
    version = _VERSION.search(data, at)
    places = [data.find(_GZIP, at), version.start() if version else -1]
    return min((p for p in places if p >= 0), default=len(data))


def salvage(data: bytes) -> Iterator[Found]:
    """All records that pass, in order, and the gaps between them."""
    at, bad, reason, silent = 0, -1, "", False
    while at < len(data):
        try:
            records, gaps, end, whole = _records_at(data, at)
        except Damaged as e:
            if bad < 0:
                bad, reason = at, str(e)
            at = _next_place(data, at + 1)
            continue
        if bad >= 0:
            if not silent:
                yield Found(bad, at - bad, reason)
            bad, silent = -1, False
        for head, block in records:
            yield Found(at, end - at, "", head, payload_of(head, block))
        for inside, n, why in gaps:
            yield Found(at, end - at, why, inside=inside, inside_length=n)
        if whole:
            at = end
        else:  # the gap inside stands for the rest of the broken member
            bad, silent = at, True
            at = _next_place(data, max(end, at + 1))
    if bad >= 0 and not silent:
        yield Found(bad, len(data) - bad, reason)


_ID = re.compile(r"<urn:page:(-?\d*):")
_FIELDS = [("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("gap", pa.string()), ("record_type", pa.string()),
           ("record_id", pa.string()), ("page_id", pa.int64()), ("refers_to", pa.int64()), ("target_uri", pa.string()),
           ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()), ("inside", pa.int64()), ("inside_length", pa.int64())]
_DDL = ("file string, offset long, length long, gap string, record_type string, record_id string, page_id long, refers_to long, "
        "target_uri string, payload_bytes long, payload_digest string, payload binary, inside long, inside_length long")


def _page(record_id: str | None) -> int | None:
    m = _ID.match(record_id or "")
    return int(m[1]) if m and m[1] else None


def _reader(payloads: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                name, rows = batch.column(0)[k].as_py(), []
                for f in salvage(batch.column(1)[k].as_py() or b""):
                    h = f.head
                    rows.append((name, f.offset, f.length, f.reason or None, h.get("warc-type"), h.get("warc-record-id"), _page(h.get("warc-record-id")),
                                 _page(h.get("warc-refers-to")), h.get("warc-target-uri"), None if f.reason else len(f.payload),
                                 None if f.reason else hashlib.sha256(f.payload).hexdigest(), f.payload if payloads and not f.reason else None,
                                 f.inside if f.inside >= 0 else None, f.inside_length if f.inside >= 0 else None))
                    if len(rows) == 500:
                        yield _batch(rows)
                        rows = []
                if rows:
                    yield _batch(rows)
    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), _FIELDS, strict=True)], [n for n, _ in _FIELDS])


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """A row per recovered record, and per gap (gap: the reason; besides only file, offset and length, of its member for a gap
    inside one, with its place in the content)."""
    return (spark.read.format("binaryFile").load(path).select("path", "content")
            .mapInArrow(_reader(payloads), _DDL))


def resolve_revisits(records: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to): revisits with their response's payload figures."""
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    real = records.where("gap is null")
    responses = real.where("record_type = 'response'").select(*columns)
    revisits = real.where("record_type = 'revisit'").select("page_id", "record_type", "refers_to", F.split("record_id", ":")[3].alias("d"))
    firsts = (responses.select(F.col("page_id").alias("refers_to"), "payload_bytes", "payload_digest",
                               F.concat(F.substring("payload_digest", 1, 32), F.lit(">")).alias("d")).dropDuplicates(["refers_to", "d"]))
    return responses.union(revisits.join(firsts, ["refers_to", "d"], "left").select(*columns))


def round_trip(pages: DataFrame) -> DataFrame:
    """Write pages to archives in the shared folder, read them back, resolve revisits."""
    spark = pages.sparkSession
    path = f"{scratch_folder(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path)
    records = cut_lineage(read_archives(spark, path, payloads=False))
    delete_folder(spark, path)
    return resolve_revisits(records)
