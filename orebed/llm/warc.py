"""WARC archives: a writer with revisit records and a reader whose tasks take byte ranges.

Every record is a gzip member of its own. A reading task scans its range for gzip magic, takes a place for
the start of a record only if the member's first bytes inflate to a WARC header, owns the records that start
in its range and reads past the end of the range to finish the last one.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orebed.llm.common import table
from orebed.storage import new_path

MAGIC = b"\x1f\x8b\x08"
#: The version written; those read.
VERSION = b"WARC/1.1\r\n"
VERSIONS = (VERSION, b"WARC/1.0\r\n")

#: Payloads of fewer bytes are never written as revisits.
REVISIT_BYTES = 1000

#: Bytes of a reading task's range, and of one read, and of a member's start that must inflate to a WARC
#: version; tasks of a read at most (each then takes several ranges).
RANGE_BYTES, READ_BYTES, PROBE_BYTES, TASKS = 16 << 20, 1 << 20, 1024, 20_000

WRITTEN = "path string, records long, bytes long"
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def open_store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI or an absolute path, and the path in it."""
    if re.match(r"file:/+", path):
        path = "/" + re.sub(r"^file:/+", "", path)
    return fs.FileSystem.from_uri(path)


def _line(value: str | None) -> bytes:
    """A header value; control characters are percent-encoded."""
    return re.sub(r"[\x00-\x1f\x7f%]", lambda m: f"%{ord(m[0]):02X}", value or "").encode("utf-8", "surrogatepass")


def _value(line: str | None) -> str:
    return re.sub(r"%([01][0-9A-F]|7F|25)", lambda m: chr(int(m[1], 16)), line or "")


def encode_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record as one gzip member; a revisit keeps the HTTP header and leaves out the payload."""
    digest = hashlib.sha1(payload).hexdigest()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [b"WARC-Type: " + (b"response" if refers_to is None else b"revisit")]
    head += [b"WARC-Record-ID: <urn:page:%s>" % (b"" if page_id is None else b"%d" % page_id), b"WARC-Date: 1970-01-01T00:00:00Z"]
    head += [b"WARC-Target-URI: " + _line(url)] if url is not None else []
    head += [b"WARC-Payload-Digest: sha1:" + digest.encode()]
    if refers_to is not None:
        head += [b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", b"WARC-Refers-To: <urn:page:%d>" % refers_to]
    head += [b"Content-Type: application/http; msgtype=response", b"Content-Length: %d" % len(block)]
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(VERSION + b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def _hex_digest(value: str | None) -> str | None:
    """The lower-case hex form of a `sha1:` digest in hex or base 32; None for others."""
    value = (value or "").removeprefix("sha1:")
    if re.fullmatch(r"[0-9a-fA-F]{40}", value):
        return value.lower()
    return base64.b32decode(value.upper()).hex() if re.fullmatch(r"[A-Za-z2-7]{32}", value) else None


def decode_record(data: bytes) -> tuple | None:
    """A RECORDS row of an inflated member; None for a record of another type than response and revisit.

    A record shorter than its header says, or with a payload that its digest does not fit, raises ValueError.
    """
    head, _, rest = data.partition(b"\r\n\r\n")
    named = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])}
    kind = named.get("warc-type")
    if kind not in ("response", "revisit"):
        return None
    ref = lambda key: int(m[1]) if (m := re.fullmatch(r"<urn:page:(-?\d+)>", named.get(key, ""))) else None
    size = int(named["content-length"])
    block = rest[:size]
    http, _, payload = block.partition(b"\r\n\r\n")
    stated = re.search(rb"(?im)^Content-Length:\s*(\d+)", http)
    digest = _hex_digest(named.get("warc-payload-digest"))
    if kind == "response":
        own = hashlib.sha1(payload).hexdigest()
        if len(block) != size or digest not in (None, own):
            raise ValueError(f"record {named.get('warc-record-id')}: the payload does not match its length and digest")
        length, digest = len(payload), own
    else:
        length = int(stated[1]) if stated else None
    url = named.get("warc-target-uri")
    return ref("warc-record-id"), None if url is None else _value(url), kind, ref("warc-refers-to"), length, digest, payload if kind == "response" else None


def with_revisits(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, refers_to: of equal payloads of REVISIT_BYTES or more, the largest page_id is kept whole.

    Only digests of long payloads are grouped and, of those, only repeated ones are joined back: the aggregate
    combines before its shuffle, and AQE broadcasts the repeated digests where they are small or splits a hot one
    where not. Shorter payloads stay out of the join.
    Pages without a page_id are never revisits nor referred to.
    """
    p = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    long = (F.length("payload") >= REVISIT_BYTES) & F.col("page_id").isNotNull()
    short = p.where(~long).withColumn("refers_to", F.lit(None).cast("long"))  # these are no one's copies and meet no join
    p = p.where(long).withColumn("digest", F.sha1("payload"))
    heads = p.groupBy("digest").agg(F.max("page_id").alias("head"), F.min("page_id").alias("low")).where("head > low").select("digest", "head")
    p = p.join(heads, "digest", "left")
    p = p.select("page_id", "url", "payload", F.when(F.col("head") != F.col("page_id"), F.col("head")).alias("refers_to"))
    return p.unionByName(short)


def write_archives(pages: DataFrame, path: str) -> DataFrame:
    """Write one archive a partition below `path`; returns WRITTEN rows, to be acted on once.

    Pages as with_revisits takes them: null html is empty, repeated rows are each written, an empty table
    gives an empty folder. A file gets its last name only when complete, so a repeated task does no harm.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        store, base = open_store(path)
        store.create_dir(base, recursive=True)
        name = f"{base}/part-{TaskContext.get().partitionId():06d}.warc.gz"
        draft, n, size = f"{name}.{uuid.uuid4().hex}.tmp", 0, 0
        with store.open_output_stream(draft, compression=None) as out:
            for b in batches:
                for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    data = encode_record(*row)
                    out.write(data)
                    n, size = n + 1, size + len(data)
        if n:
            store.move(draft, name)
            yield pa.RecordBatch.from_pylist([{"path": name, "records": n, "bytes": size}])
        else:
            store.delete_file(draft)

    return with_revisits(pages).mapInArrow(write, WRITTEN)


def _own_records(store: fs.FileSystem, path: str, start: int, end: int) -> Iterator[tuple]:
    """Rows of the records that start in [start, end) of one file.

    Magic bytes whose data do not inflate to a WARC header are no record and are passed over. A member with
    such a header that cannot be inflated to its end is damaged and raises ValueError, with its place.
    """
    with store.open_input_file(path) as f:
        base, buf = start, b""  # buf: what was read from `base` on

        def more() -> bool:
            nonlocal buf
            f.seek(base + len(buf))
            part = f.read(READ_BYTES)
            buf += part
            return bool(part)

        at = 0  # in buf
        while base + at < end:
            hit = buf.find(MAGIC, at)
            if hit < 0:
                at = max(at, len(buf) - len(MAGIC) + 1)
                base, buf, at = base + at, buf[at:], 0
                if base >= end or not more():
                    return
                continue
            at = hit
            if base + at >= end:
                return
            while len(buf) - at < PROBE_BYTES and more():
                pass
            try:
                head = zlib.decompressobj(31).decompress(buf[at : at + PROBE_BYTES], len(VERSION))
            except zlib.error:
                head = b""
            if head not in VERSIONS:
                at += 1
                continue
            z, parts, fed = zlib.decompressobj(31), [], at
            try:
                while not z.eof:
                    if fed == len(buf) and not more():
                        raise zlib.error("the file ends within it")
                    chunk = buf[fed : fed + READ_BYTES]
                    parts.append(z.decompress(chunk))
                    fed += len(chunk)
            except zlib.error as e:
                raise ValueError(f"{path}: the record at byte {base + at} is damaged: {e}") from None
            used = fed - len(z.unused_data)
            base, buf, at = base + used, buf[used:], 0
            if (row := decode_record(b"".join(parts))) is not None:
                yield row


def read_archives(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """RECORDS of all archives below `path`; every record is read by the one task whose range it starts in.

    Records of types other than response and revisit (warcinfo, request, metadata and so on) give no row. A
    record without an id of a page has a null page_id, one without a digest gets that of its payload, a revisit
    without an HTTP length a null length. Damaged and cut-off records raise. No files and empty files give no rows.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(path).select("path", "length")
    ranges = files.select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(range_bytes).cast("long"))).alias("start"))
    # as many tasks as ranges: rows this small would otherwise be put together into one
    ranges = ranges.repartition(min(TASKS, max(1, ranges.count())), F.col("path"), F.col("start"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])
        for b in batches:
            for p, start in zip(*(c.to_pylist() for c in b.columns), strict=True):
                store, file = open_store(p)
                rows, held = [], 0
                for r in _own_records(store, file, start, start + range_bytes):
                    rows.append(r)
                    held += r[4] or 0
                    if held >= 8 * READ_BYTES or len(rows) >= 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return ranges.mapInArrow(read, RECORDS)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path).agg(F.sum("records")).collect()
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP6_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
d AS (SELECT page_id, strlen(t) AS payload_bytes, sha1(t) AS payload_digest FROM p),
h AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS head FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= {REVISIT_BYTES} AND head <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= {REVISIT_BYTES} AND head <> page_id THEN head END AS refers_to
FROM h
"""
