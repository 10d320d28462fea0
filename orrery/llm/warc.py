"""WARC archives: a writer with revisit records and a splittable reader (operator 9).

Writing: one gzip member for each record.  Records with equal payloads of at least ``LEAST`` bytes are
written once, by the smallest page_id; the others become ``revisit`` records that name it.  Each task
writes files under names of its own and returns them; only the files of tasks that succeeded are
listed, so a task that is run again leaves at most an unlisted file.

Reading: every file is dealt out as byte ranges.  A task looks for the gzip magic from the start of
its range, takes a candidate as a member only if it decodes to a WARC version line, and owns the
records that start inside its range; the last of them may end beyond it.  From there on members follow
each other without a gap, so where one ends another must begin, in this range or a later one, or the
file must end: a damaged or missing member, a cut file and bytes between members are errors.

Where the revisits are few enough to be broadcast, no html is shuffled.

Records of other kinds than response and revisit are passed over; those of other writers have no page_id.

Defined results: null html is the empty payload; null page_id is kept; rows that share the smallest
page_id of their payload are all responses; url is only recorded (null: absent; control characters
are percent-encoded); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.plans.scratch import new_dir, small, written

MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1.1\r\n"
LEAST = 100
SPLIT = 32 << 20
ROLL = 512 << 20
PIECE, HEAD = 1 << 20, 1 << 16
#: Rows of revisits that may be broadcast.
SMALL = 500_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2020-01-01T00:00:00Z"

class DamagedArchive(ValueError):
    """An archive, or a record in it, is not what was written."""


FILES = "path string, bytes long, records long"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _uri(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _page(uri: str) -> int | None:
    """The page of a record's id; None for those of other writers."""
    head, _, tail = uri.strip("<>").rpartition(":")
    return int(tail) if head == "urn:page" and tail != "none" else None


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One record, not compressed; a revisit has the payload's digest and length but not its bytes."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_uri(page_id)}", f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(f"%{ord(c):02X}" if c < "!" or c == "\x7f" else c for c in url))
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_uri(refers_to)}"]
    return VERSION + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _writer(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, sink, size, count, path = [], None, 0, 0, ""
        store, base = pafs.FileSystem.from_uri(folder)

        def close() -> None:
            nonlocal sink
            if sink is not None:
                sink.close()
                out.append((path, size, count))
                sink = None

        for batch in batches:
            for r in range(batch.num_rows):
                page_id, url, html, digest, revisit, refers_to = (batch.column(c)[r].as_py() for c in range(6))
                if sink is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    store.create_dir(base, recursive=True)
                    sink, size, count, path = store.open_output_stream(f"{base}/{name}", compression=None), 0, 0, f"{folder}/{name}"
                pack = zlib.compressobj(5, zlib.DEFLATED, 31)
                member = pack.compress(record(page_id, url, (html or "").encode("utf-8", "surrogatepass"), digest, refers_to, revisit)) + pack.flush()
                sink.write(member)
                size, count = size + len(member), count + 1
                if size >= ROLL:
                    close()
        close()
        yield pa.RecordBatch.from_pydict({"path": [x[0] for x in out], "bytes": [x[1] for x in out], "records": [x[2] for x in out]}, schema=pa.schema([("path", pa.string()), ("bytes", pa.int64()), ("records", pa.int64())]))

    return write


def write_warc(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as .warc.gz files; returns path, bytes and records of each."""
    spark = pages.sparkSession
    folder = folder or new_dir(spark, "warc")
    html = F.coalesce("html", F.lit(""))
    pages = pages.select(F.col("page_id").cast("long"), "url", html.alias("html"), F.sha2(html, 256).alias("digest"), F.octet_length(html).alias("n"))
    seen = written(pages.select("page_id", "digest", "n"), "payloads")
    first = seen.where(F.col("n") >= LEAST).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    again = seen.join(first, "digest").where("page_id is null or page_id > first").select(F.col("page_id").alias("_id"), F.col("digest").alias("_digest"), F.col("first").alias("refers_to")).distinct()
    rows = pages.join(small(written(again, "revisits"), SMALL), pages["page_id"].eqNullSafe(F.col("_id")) & (pages["digest"] == F.col("_digest")), "left")
    rows = rows.select("page_id", "url", "html", "digest", F.col("refers_to").isNotNull().alias("revisit"), "refers_to")
    return written(rows.mapInArrow(_writer(folder), FILES), "warc-files")


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names lowered) and block of a decoded record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    block = rest[: int(fields.get("content-length", 0))]
    if rest[len(block) :] != b"\r\n\r\n":
        raise DamagedArchive(f"the record {fields.get('warc-record-id')} is not as long as it says")
    return fields, block


def members(source, size: int, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(offset, decoded record) of each record that starts in [start, end) of an open file."""

    def decode(at: int, whole: bool = True) -> tuple[bytes, int] | None:
        """The member at ``at`` (or only its beginning) and where it ends; None if none begins there."""
        unpack, parts, pos, checked = zlib.decompressobj(31), [], at, False
        while not unpack.eof:
            source.seek(pos)
            piece = source.read(min(PIECE if checked else HEAD, size - pos))
            try:
                parts.append(unpack.decompress(piece) if piece else b"")
            except zlib.error as why:
                if checked:
                    raise DamagedArchive(f"damaged record at byte {at}: {why}") from why
                return None
            pos += len(piece)
            if not checked and len(got := b"".join(parts)) >= len(VERSION):
                if not got.startswith(b"WARC/1."):
                    return None
                if not whole:
                    return got, pos
                checked = True
            if not piece:
                if checked:
                    raise DamagedArchive(f"the record at byte {at} is cut off")
                return None
        return (b"".join(parts), pos - len(unpack.unused_data)) if checked else None

    def first() -> int | None:
        """Where the first member of a range begins that is not the file's first."""
        at = start
        while at < end:
            source.seek(at)
            window = source.read(min(PIECE, end - at) + len(MAGIC) - 1)
            k = window.find(MAGIC)
            while 0 <= k < end - at:
                if decode(at + k, False):
                    return at + k
                k = window.find(MAGIC, k + 1)
            at += max(1, len(window) - len(MAGIC) + 1)
        return None

    at = first() if start else 0
    if at is None or not size:
        return
    while at < end:
        found = decode(at)
        if found is None:
            raise DamagedArchive(f"no record begins at byte {at}")
        yield at, found[0]
        at = found[1]
    if at < size and not decode(at, False):
        raise DamagedArchive(f"no record begins at byte {at}")


def _reader(with_payload: bool):
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                path, size, start, end = (batch.column(c)[r].as_py() for c in range(4))
                store, base = pafs.FileSystem.from_uri(path)
                rows, held = [], 0
                with store.open_input_file(base) as source:
                    if source.size() != size:
                        raise DamagedArchive(f"{path} has {source.size()} bytes, not {size}")
                    for _, raw in members(source, size, start, end):
                        fields, block = parse(raw)
                        if fields.get("warc-type") not in ("response", "revisit"):
                            continue
                        http, _, payload = block.partition(b"\r\n\r\n")
                        revisit = fields["warc-type"] == "revisit"
                        length = next((int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), len(payload))
                        given = fields.get("warc-payload-digest", "")
                        digest = given[7:] if given.startswith("sha256:") else hashlib.sha256(payload).hexdigest()
                        if not revisit and (len(payload) != length or hashlib.sha256(payload).hexdigest() != digest):
                            raise DamagedArchive(f"damaged record {fields.get('warc-record-id')} in {path}")
                        rows.append((_page(fields.get("warc-record-id", "")), fields.get("warc-target-uri"), length, digest, "revisit" if revisit else "response", _page(fields.get("warc-refers-to", "")) if revisit else None, payload if with_payload and not revisit else None))
                        held += len(payload) if with_payload else 0
                        if len(rows) >= 5000 or held > 16 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return read


def read_warc(files: DataFrame, split: int = SPLIT, payload: bool = True) -> DataFrame:
    """Records of the files (path, bytes): page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload."""
    starts = F.when(F.col("bytes") > 0, F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split).cast("long")))
    ranges = files.select("path", "bytes", F.explode(starts).alias("start"))
    ranges = ranges.select("path", "bytes", "start", F.least(F.col("bytes"), F.col("start") + split).alias("end"))
    # a task for each range, however few bytes the list itself has
    return ranges.repartition(max(1, ranges.count()), "path", "start").mapInArrow(_reader(payload), RECORDS)


def archive(spark: SparkSession, folder: str) -> DataFrame:
    """(path, bytes) of every .warc.gz file below ``folder``, for ``read_warc``."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").option("recursiveFileLookup", "true").load(folder)
    return found.select("path", F.col("length").alias("bytes"))
