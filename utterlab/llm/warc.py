"""WARC archives: a writer with payload dedup and a reader that splits compressed files.

Every record is a gzip member of its own. A read task owns the members that start within
its byte range: it looks for the gzip magic, accepts a candidate only if it inflates to a
WARC header, and then walks from member to member, past the end of its range for the last.
Files are reached through Arrow's file systems by URI, never by a local path of the driver.

Defined cases: a null payload is empty; a null URL leaves the header out; a null id is
written and read back as null; equal payloads of at least ``min_bytes`` bytes keep the
record with the largest id as the response, and rows repeating that id are responses too;
if all ids of a group are null, all are responses; an empty table gives no records; line
breaks and other control characters of a URL are percent-encoded. A payload which itself
holds a stored (uncompressed) gzip member with a WARC header would be taken for a record
if a range began inside it; the writer compresses, so its own archives hold none.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from utterlab.llm.registry import query
from utterlab.llm.shared import scratch, written

MAGIC = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_BLOCK = 1 << 18
RECORDS = (
    "path string, offset long, type string, record_id string, uri string, digest string,"
    " refers_to string, payload_bytes long, payload binary, reject string"
)


# --- dedup -----------------------------------------------------------------------------


def mark_revisits(
    pages: DataFrame, id_col: str, payload: str, min_bytes: int = 1000, salts: int = 8
) -> DataFrame:
    """Adds ``digest`` (SHA-1, hex) and ``refers_to``: the id that holds an equal payload.

    Groups are pre-aggregated to one row before they meet the pages again, and that row is
    repeated per salt, so a payload of a third of all pages is spread over ``salts`` keys.
    """
    rows = pages.withColumn("digest", F.sha1(payload)).withColumn("__n", F.length(payload))
    groups = (
        rows.where(F.col("__n") >= min_bytes)
        .groupBy("digest", "__n")
        .agg(F.max(id_col).alias("__keep"), F.count(F.lit(1)).alias("__c"))
        .where("__c > 1 AND __keep IS NOT NULL")
        .select("digest", "__n", "__keep", F.explode(_range(salts)).alias("__s"))
    )
    salted = rows.withColumn("__s", F.pmod(F.xxhash64(id_col), F.lit(salts)).cast("int"))
    joined = salted.join(groups, ["digest", "__n", "__s"], "left")
    refers = F.when(~F.col(id_col).eqNullSafe(F.col("__keep")), F.col("__keep"))
    return joined.withColumn("refers_to", refers).drop("__n", "__s", "__keep")


def _range(n: int) -> Column:
    return F.sequence(F.lit(0), F.lit(n - 1))


# --- writer ----------------------------------------------------------------------------


def _member(row: dict, date: str) -> bytes:
    payload = row["payload"] or b""
    head = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode()
    sha1 = base64.b32encode(bytes.fromhex(row["digest"])).decode()
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if row['refers_to'] is None else 'revisit'}",
        f"WARC-Record-ID: {row['record_id']}",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{sha1}",
        "Content-Type: application/http; msgtype=response",
    ]
    if row["uri"] is not None:
        lines.append("WARC-Target-URI: " + quote(row["uri"], safe=_SAFE))
    if row["refers_to"] is not None:
        lines += [f"WARC-Refers-To: {row['refers_to']}", f"WARC-Profile: {PROFILE}"]
    block = head + (payload if row["refers_to"] is None else b"")
    lines.append(f"Content-Length: {len(block)}")
    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
    whole = "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    return deflate.compress(whole) + deflate.flush()


_SAFE = "".join(map(chr, range(0x21, 0x7F)))


def write_warc(
    records: DataFrame,
    folder: str,
    date: str = "2024-01-01T00:00:00Z",
    roll_bytes: int = 1 << 30,
) -> DataFrame:
    """Writes (record_id, uri, digest, refers_to, payload) rows; returns the manifest.

    A task names its files by attempt and lists them only when it ends, so a repeated or
    speculative task leaves files that no manifest row points to.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        stem = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}"
        done: list[tuple[str, int, int]] = []
        out, size, count = None, 0, 0
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    name = f"{stem}-{len(done):04d}.warc.gz"
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                    size, count = 0, 0
                data = _member(row, date)
                out.write(data)
                size, count = size + len(data), count + 1
                if size >= roll_bytes:
                    out.close()
                    done.append((f"{folder}/{name}", size, count))
                    out = None
        if out is not None:
            out.close()
            done.append((f"{folder}/{name}", size, count))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([d[0] for d in done], pa.string()),
                pa.array([d[1] for d in done], pa.int64()),
                pa.array([d[2] for d in done], pa.int64()),
            ],
            ["path", "length", "records"],
        )

    wanted = records.select("record_id", "uri", "digest", "refers_to", "payload")
    return written(
        wanted.mapInArrow(write, "path string, length long, records long"), "warc-manifest"
    )


# --- reader ----------------------------------------------------------------------------


def archives(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, length) of existing archives; contents are not read."""
    return spark.read.format("binaryFile").load(list(paths)).select("path", "length")


def splits(files: DataFrame, split_bytes: int = 64 << 20) -> DataFrame:
    """(path, start, stop) byte ranges that cover every file."""
    starts = F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(split_bytes).cast("long"))
    return (
        files.where("length > 0")
        .select("path", "length", F.explode(starts).alias("start"))
        .select("path", "start", F.least("length", F.col("start") + split_bytes).alias("stop"))
    )


def read_warc(
    files: DataFrame, split_bytes: int = 64 << 20, max_tasks: int = 100_000
) -> DataFrame:
    """Records of the (path, length) archives, each owned by the range it starts in.

    A header of another writer that can't be read costs its own column only: ``digest`` is
    null where it is no SHA-1, ``payload_bytes`` is the length found where the length is no
    number, and ``reject`` names the headers concerned (null where all were read).
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for task in batch.to_pylist():
                store, place = pafs.FileSystem.from_uri(task["path"])
                with store.open_input_file(place) as file:
                    rows, held = [], 0
                    for row in members(file, task["start"], task["stop"]):
                        rows.append({"path": task["path"]} | row)
                        held += len(row["payload"] or b"") + 500
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)
                            rows, held = [], 0
                    yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)

    ranges = splits(files, split_bytes)
    tasks = min(max(ranges.count(), 1), max_tasks)  # a given number is not coalesced again
    return ranges.repartition(tasks, "path", "start").mapInArrow(read, RECORDS)


_SCHEMA = pa.schema(
    [
        ("path", pa.string()),
        ("offset", pa.int64()),
        ("type", pa.string()),
        ("record_id", pa.string()),
        ("uri", pa.string()),
        ("digest", pa.string()),
        ("refers_to", pa.string()),
        ("payload_bytes", pa.int64()),
        ("payload", pa.binary()),
        ("reject", pa.string()),
    ]
)


def members(file: pa.NativeFile, start: int, stop: int) -> Iterator[dict]:
    """Records of the members that start in [start, stop)."""
    at, base, buffer = start, start, b""
    while at < stop:
        if at - base >= len(buffer):
            base = at
            file.seek(base)
            buffer = file.read(_BLOCK)
            if not buffer:
                return
        found = buffer.find(MAGIC, at - base)
        if found < 0:
            # a magic may lie across two blocks
            at = max(at, base + len(buffer) - len(MAGIC) + 1)
            if at + len(MAGIC) > file.size():
                return
            base = at
            file.seek(base)
            buffer = file.read(_BLOCK)
            continue
        at = base + found
        if at >= stop:
            return
        record, end = _inflate(file, at, buffer[found:])
        if record is None:
            at += 1
            continue
        yield {"offset": at} | record
        at = end


def _inflate(file: pa.NativeFile, at: int, data: bytes) -> tuple[dict | None, int]:
    """The record at ``at`` and the end of its member, or None if no member starts there."""
    inflate = zlib.decompressobj(31)
    out, taken = bytearray(), 0
    try:
        while True:
            taken += len(data)
            out += inflate.decompress(data)
            if len(out) >= 7 and out[:7] != b"WARC/1.":
                return None, at
            if inflate.eof:
                break
            file.seek(at + taken)
            data = file.read(_BLOCK)
            if not data:
                return None, at  # cut off: not a whole member
    except zlib.error:
        return None, at
    record = _parse(bytes(out))
    return record, at + taken - len(inflate.unused_data)


def _parse(raw: bytes) -> dict | None:
    if raw[:7] != b"WARC/1.":
        return None
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = _fields(head)
    length, bad_length = _count(fields.get("content-length"))
    block = rest if length is None else rest[:length]
    http, _, payload = block.partition(b"\r\n\r\n")
    kind = fields.get("warc-type")
    told, bad_told = _count(
        _fields(http).get("content-length") if block.startswith(b"HTTP/") else None
    )
    written_digest = fields.get("warc-payload-digest")
    digest = _hex(written_digest) if written_digest else None
    bad = {
        "content-length": bad_length,
        "http content-length": bad_told,
        "warc-payload-digest": bool(written_digest) and digest is None,
    }
    return {
        "type": kind,
        "record_id": fields.get("warc-record-id"),
        "uri": fields.get("warc-target-uri"),
        "digest": digest,
        "refers_to": fields.get("warc-refers-to"),
        "payload_bytes": told if told is not None else len(payload),
        "payload": payload if kind != "revisit" else None,
        "reject": ", ".join(name for name, failed in bad.items() if failed) or None,
    }


def _count(text: str | None) -> tuple[int | None, bool]:
    """A length header as a number, and whether it is there but is none (of 18 digits at most)."""
    if text is None:
        return None, False
    whole = re.fullmatch(r"[0-9]{1,18}", text)
    return (int(text), False) if whole else (None, True)


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, s, v in (x.partition(":") for x in lines) if s}


def _hex(digest: str) -> str | None:
    """Lower-case hex of a SHA-1 given in hex or base 32, null for anything else."""
    label, colon, value = digest.partition(":")
    if colon and label.lower() not in ("sha1", "sha-1"):
        return None
    value = value if colon else label
    if re.fullmatch(r"[0-9a-fA-F]{40}", value):
        return value.lower()
    if re.fullmatch(r"[A-Za-z2-7]{32}", value):
        return base64.b32decode(value.upper()).hex()
    return None


def payload_digest(payload: bytes) -> str:
    return hashlib.sha1(payload).hexdigest()


WARC_SQL = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS b, sha1(coalesce(html, '')) AS d FROM pages
), k AS (SELECT *, octet_length(b) AS n,
  CASE WHEN octet_length(b) >= 1000 THEN max(page_id) OVER (PARTITION BY d, octet_length(b)) END AS keep FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest,
  CASE WHEN keep <> page_id OR (page_id IS NULL AND keep IS NOT NULL) THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN keep <> page_id OR (page_id IS NULL AND keep IS NOT NULL) THEN keep END AS refers_to
FROM k
"""


@query("op10_warc", WARC_SQL)
def warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What does every page look like after a trip through the archives?"""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(
        "page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload")
    )
    urn = lambda c: F.when(F.col(c).isNotNull(), F.format_string("<urn:page:%d>", c))
    marked = mark_revisits(pages, "page_id", "payload").select(
        F.coalesce(urn("page_id"), F.lit("<urn:page:>")).alias("record_id"),
        F.col("url").alias("uri"),
        "digest",
        urn("refers_to").alias("refers_to"),
        "payload",
    )
    manifest = write_warc(marked, scratch(spark, "warc"))
    back = read_warc(manifest)
    number = lambda c: F.regexp_extract(c, r"<urn:page:(-?\d+)>", 1).try_cast("long")
    return back.select(
        number("record_id").alias("page_id"),
        "payload_bytes",
        F.coalesce(F.sha1("payload"), "digest").alias("payload_digest"),
        F.col("type").alias("record_type"),
        number("refers_to").alias("refers_to"),
    )
