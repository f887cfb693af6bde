"""WARC archives: a writer with revisit records, and a splittable reader of record-compressed files.

Writing: payloads of at least ``REVISIT_BYTES`` bytes are grouped by SHA-256 and length; the row with the largest id of a
group is a response record, the others revisit it. Tasks write files of up to ``FILE_BYTES`` with one gzip member per
record, under unique names that reach the manifest, a table, only when the task succeeds.

Reading: files are cut into byte ranges. A task scans its range for gzip magic, takes a candidate for a member only when it
decodes to a WARC header, and owns the records that start inside its range, the last of which it reads to its end
beyond the range. Within a range, members follow each other without scanning.

Defined cases: null html is an empty payload; a null page_id stays null; a null url is an empty target; control and
non-ASCII characters of a url are percent-encoded; a record's id names its page and payload, so only repeated rows (same id, same payload),
which are one page and each a response, share it;
a null id loses to any other; an empty table writes no file and gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import new_folder, open_fs, stage

REVISIT_BYTES = 1000
FILE_BYTES = 1 << 28
SPLIT_BYTES = 8 << 20
SPLITS_PER_TASK = 2
CHUNK = 1 << 20
MAGIC = b"\x1f\x8b\x08"
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_PRINTABLE = "".join(map(chr, range(0x21, 0x7F)))


def plan_records(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, refers_to): payload is null where the record revisits page refers_to."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long"), "url", payload.alias("payload"))
    large = F.octet_length("payload") >= REVISIT_BYTES
    keyed = rows.filter(large).withColumn("key", F.struct(F.unhex(F.sha2("payload", 256)).alias("d"), F.octet_length("payload").alias("n")))
    # staged, so that adaptive execution can split a hot payload's rows; small payloads pass by the join
    keep = stage(keyed.groupBy("key").agg(F.max("page_id").alias("keep"), F.count("*").alias("rows")).filter("rows > 1").drop("rows"), "warc-keep")
    joined = keyed.join(keep, "key", "left").select("page_id", "url", "payload", F.when(~F.equal_null("page_id", "keep"), F.col("keep")).alias("refers_to"))
    return joined.unionByName(rows.filter(~large).withColumn("refers_to", F.lit(None).cast("long")))


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None, date: str = DATE) -> bytes:
    """One record, uncompressed. A revisit has the HTTP header but no payload."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {date}",
        f"WARC-Target-URI: {quote(url or '', safe=_PRINTABLE)}", f"WARC-Payload-Digest: sha1:{digest}", f"Page-ID: {'' if page_id is None else page_id}",
        *([] if refers_to is None else [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"Refers-To-Page-ID: {refers_to}"]),
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _writer(folder: str, file_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, out, size, done = "", None, 0, []

        def close() -> None:
            nonlocal out
            if out is not None:
                out.close()
                done.append((name, size))
                out = None

        for b in batches:
            for page_id, url, payload, refers_to in zip(*(c for c in b.columns), strict=True):
                if out is None:
                    name, size = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0
                    fs, where = open_fs(name)
                    fs.create_dir(where.rsplit("/", 1)[0])
                    out = fs.open_output_stream(where, compression=None)
                data = _member(record(page_id.as_py(), url.as_py(), payload.as_py(), refers_to.as_py()))
                out.write(data)
                size += len(data)
                if size >= file_bytes:
                    close()
        close()
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.string()), pa.array([x[1] for x in done], pa.int64())], ["file", "bytes"])

    return run


def write_warc(pages: DataFrame, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the archives; the manifest (file, bytes) comes back as a staged table."""
    folder = new_folder(pages.sparkSession, "warc")
    return stage(plan_records(pages).mapInArrow(_writer(folder, file_bytes), "file string, bytes long"), "warc-manifest")


def _headers(data: bytes) -> dict[str, str]:
    return dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in data.decode().split("\r\n")[1:] if x)


def read_member(f, at: int, size: int) -> tuple[bytes, int] | None:
    """The data of the gzip member at ``at`` and where it ends; None if there is no member that holds a WARC record."""
    z, parts, got = zlib.decompressobj(31), [], 0
    f.seek(at)
    try:
        while not z.eof:
            chunk = f.read(CHUNK if got else 1 << 14)
            if not chunk:
                return None
            parts.append(z.decompress(chunk))
            if not got and not b"".join(parts).startswith(b"WARC/1."):
                return None
            got += len(chunk)
    except zlib.error:
        return None
    return b"".join(parts), at + got - len(z.unused_data)


def records(f, size: int, start: int, end: int) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of the records that start in [start, end) of an open file."""
    at = start
    while at < end:
        f.seek(at)
        chunk = f.read(min(CHUNK, end - at) + len(MAGIC) - 1)
        k = chunk.find(MAGIC)
        if k < 0:
            at += max(len(chunk) - len(MAGIC) + 1, 1)
            continue
        at += k
        while at < end and (found := read_member(f, at, size)):
            data, after = found
            head, _, rest = data.partition(b"\r\n\r\n")
            headers = _headers(head)
            yield headers, rest[: int(headers["Content-Length"])]
            at = after
        else:
            at += at < end  # no record here: look for the next magic


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    types = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    for b in batches:
        for split in b.to_pylist():
            fs, where = open_fs(split["file"])
            with fs.open_input_file(where) as f:
                rows, held = [], 0
                for headers, block in records(f, split["bytes"], split["start"], split["end"]):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    kind, digest = headers["WARC-Type"], base64.b32decode(headers["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                    if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
                        raise ValueError(f"{split['file']}: the payload of {headers['WARC-Record-ID']} does not have its digest")
                    page, refers = headers["Page-ID"], headers.get("Refers-To-Page-ID")
                    rows.append((int(page) if page else None, headers["WARC-Target-URI"], payload if kind == "response" else None, int(_headers(http)["Content-Length"]), digest, kind, int(refers) if refers else None))
                    held += len(block)
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)
                        rows, held = [], 0
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)


def read_warc(manifest: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to) of every record; payload is null for revisits."""
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(split_bytes).cast("long")))
    splits = manifest.filter("bytes > 0").select("file", "bytes", starts.alias("start")).withColumn("end", F.least(F.col("start") + split_bytes, F.col("bytes")))
    kind = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"
    count = manifest.agg(F.sum(F.ceil(F.col("bytes") / split_bytes)).alias("n")).first()["n"] or 0
    return splits.repartition(max(1, -(-count // SPLITS_PER_TASK)), "file", "start").mapInArrow(_reader, kind)
