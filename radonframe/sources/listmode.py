"""Listmode event files: a binary stream of time blocks and its line-delimited JSON form.

Binary: the magic ``yardl``, a 32-bit version 1, a schema text, a header record, then chunks of time blocks, each with its count, ended by
a count of 0. Integers are base-128 varints, signed ones zig-zag; floats are little-endian; an optional value follows a byte 0 or 1; a
vector follows its length. After the header every number is a varint, so a whole range is decoded at once.

A file is read twice: a first pass, a task for each file, goes through it in pieces of ``PIECE`` bytes and only counts numbers, for the places of its
blocks; then tasks decode ranges of whole blocks of about ``RANGE_BYTES``. A stream that ends before its last count is refused in the first
pass. What a task holds is a piece, or a range, whose length no more than one block can exceed.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .ranges import open_input

MAGIC = b"yardl"
VERSION = 1
FIELDS = ("detector_1", "detector_2", "tof", "energy_1", "energy_2")
EVENTS = "file string, block long, delayed boolean, detector_1 long, detector_2 long, tof long, energy_1 long, energy_2 long"
EVENT = "struct<detector1Id:bigint,detector2Id:bigint,tofIdx:bigint,energy1Idx:bigint,energy2Idx:bigint>"
BLOCK_JSON = f"timeBlocks struct<id:bigint,promptEvents:array<{EVENT}>,delayedEvents:array<{EVENT}>>"


FILE_EVENTS = 4_000_000
PIECE = 8 << 20
RANGE_BYTES = 8 << 20
RANGES = "file string, first long, bytes long, blocks array<long>"


def to_varints(values: np.ndarray) -> bytes:
    """Unsigned integers as varints, in numpy."""
    v = np.asarray(values, np.uint64)
    sizes = np.maximum(1, np.ceil(np.array([int(x).bit_length() for x in v]) / 7)).astype(np.int64) if len(v) < 64 else np.maximum(1, 1 + (np.frexp(np.maximum(v, 1).astype(np.float64))[1] - 1) // 7)
    ends = np.cumsum(sizes)
    out, starts = np.empty(int(ends[-1]) if len(v) else 0, np.uint8), ends - sizes
    for k in range(int(sizes.max(initial=0))):
        live = sizes > k
        more = np.where(sizes[live] > k + 1, 0x80, 0).astype(np.uint8)
        out[starts[live] + k] = ((v[live] >> np.uint64(7 * k)) & np.uint64(0x7F)).astype(np.uint8) | more
    return out.tobytes()


def from_varints(data: bytes) -> np.ndarray:
    """All varints of a byte string."""
    raw = np.frombuffer(data, np.uint8)
    last = np.flatnonzero(raw < 0x80)
    sizes = np.diff(last, prepend=-1)
    starts, out = last - sizes + 1, np.zeros(len(last), np.uint64)
    for k in range(int(sizes.max(initial=0))):
        live = sizes > k
        out[live] |= (raw[starts[live] + k] & 0x7F).astype(np.uint64) << np.uint64(7 * k)
    return out


class Reader:
    """Values one after the other, for headers."""

    def __init__(self, data: bytes, at: int = 0) -> None:
        self.data, self.at = data, at

    def unsigned(self) -> int:
        out = shift = 0
        while True:
            b = self.data[self.at]
            self.at += 1
            out |= (b & 0x7F) << shift
            shift += 7
            if b < 0x80:
                return out

    def signed(self) -> int:
        v = self.unsigned()
        return (v >> 1) ^ -(v & 1)

    def text(self) -> str:
        n = self.unsigned()
        self.at += n
        return self.data[self.at - n : self.at].decode()

    def floats(self, n: int) -> list[float]:
        self.at += 4 * n
        return list(struct.unpack_from(f"<{n}f", self.data, self.at - 4 * n))

    def optional(self, read):
        self.at += 1
        return read() if self.data[self.at - 1] else None


def read_header(r: Reader) -> dict[str, Any]:
    """Scanner and exam of a header record."""

    def detector() -> dict[str, float]:
        return dict(zip(("id", "x", "y", "z"), [r.unsigned(), *r.floats(3)], strict=True))

    def exam() -> dict[str, Any]:
        return {"subject_name": r.optional(r.text), "subject_id": r.text(), "institution": r.text(), "address": r.text(), "protocol": r.optional(r.text), "start_ns": r.optional(r.signed)}

    return {
        "model_name": r.optional(r.text),
        "detectors": [detector() for _ in range(r.unsigned())],
        "tof_bin_edges": r.floats(r.unsigned()),
        "tof_resolution": r.floats(1)[0],
        "energy_bin_edges": r.floats(r.unsigned()),
        "energy_resolution_at_511": r.floats(1)[0],
        "block_duration_ms": r.unsigned(),
        "exam": r.optional(exam),
    }


def write_header(h: dict[str, Any]) -> bytes:
    u = lambda v: to_varints(np.array([v]))
    f = lambda *v: struct.pack(f"<{len(v)}f", *v)
    t = lambda s: u(len(s.encode())) + s.encode()
    o = lambda v, w: b"\0" if v is None else b"\1" + w(v)
    zigzag = lambda v: u((v << 1) ^ (v >> 63))
    exam = lambda e: o(e["subject_name"], t) + t(e["subject_id"]) + t(e["institution"]) + t(e["address"]) + o(e["protocol"], t) + o(e["start_ns"], zigzag)
    return b"".join(
        [
            o(h.get("model_name"), t), u(len(h["detectors"])), *(u(d["id"]) + f(d["x"], d["y"], d["z"]) for d in h["detectors"]), u(len(h["tof_bin_edges"])), f(*h["tof_bin_edges"]),
            f(h["tof_resolution"]), u(len(h["energy_bin_edges"])), f(*h["energy_bin_edges"]), f(h["energy_resolution_at_511"]), u(h["block_duration_ms"]), o(h.get("exam"), exam),
        ]
    )


def opened(data: bytes) -> tuple[dict[str, Any], int]:
    """The header of a file, and where its blocks start."""
    if data[:5] != MAGIC or struct.unpack_from("<i", data, 5)[0] != VERSION:
        raise ValueError("not a listmode stream of version 1")
    r = Reader(data, 9)
    r.text()
    return read_header(r), r.at


def blocks(numbers: np.ndarray) -> Iterator[tuple[int, bool, np.ndarray]]:
    """(block, delayed, events (n, 5)) of a stream's numbers."""
    at = 0
    while at < len(numbers) and (count := int(numbers[at])):
        at += 1
        for _ in range(count):
            number, n = int(numbers[at]), int(numbers[at + 1])
            yield number, False, numbers[at + 2 : at + 2 + 5 * n].reshape(n, 5)
            at += 2 + 5 * n
            if numbers[at]:
                n = int(numbers[at + 1])
                yield number, True, numbers[at + 2 : at + 2 + 5 * n].reshape(n, 5)
                at += 1 + 5 * n
            at += 1


def encoded(header: dict[str, Any], time_blocks: list[tuple[int, np.ndarray, np.ndarray | None]], schema: str = "") -> bytes:
    """A whole file of (block, prompt events, delayed events or None)."""
    s = schema.encode()
    parts = [MAGIC, struct.pack("<i", VERSION), to_varints(np.array([len(s)])), s, write_header(header)]
    numbers: list[np.ndarray] = [np.array([len(time_blocks)])] if time_blocks else []
    for number, prompt, delayed in time_blocks:
        numbers += [np.array([number, len(prompt)]), prompt.ravel(), np.array([0 if delayed is None else 1])]
        if delayed is not None:
            numbers += [np.array([len(delayed)]), delayed.ravel()]
    return b"".join([*parts, to_varints(np.concatenate([*numbers, np.array([0])]))])


def header_of(path: str) -> tuple[dict[str, Any], int]:
    """The header of a file at a path, and where its blocks start; reads no more of it than twice the header."""
    size = 1 << 16
    with open_input(path) as f:
        while True:
            f.seek(0)
            data = f.read(size)
            try:
                header, at = opened(data)
                if at <= len(data):
                    return header, at
            except (IndexError, struct.error, UnicodeDecodeError):
                pass
            if len(data) < size:
                raise ValueError(f"{path} ends within its header")
            size *= 2


class _Numbers:
    """The varints of a file from a place on, of which only some are decoded: it reads pieces and keeps one."""

    def __init__(self, f, at: int, piece: int) -> None:
        self.f, self.piece, self.base, self.raw, self.ends, self.k = f, piece, at, b"", np.empty(0, np.int64), 0
        f.seek(at)

    def _more(self) -> None:
        """Drop what is behind and read on."""
        done = int(self.ends[self.k - 1]) + 1 if self.k else 0
        data = self.f.read(self.piece)
        if not data:
            raise ValueError("the stream ends before its last count")
        self.raw, self.base, self.k = self.raw[done:] + data, self.base + done, 0
        self.ends = np.flatnonzero(np.frombuffer(self.raw, np.uint8) < 0x80)

    def place(self) -> int:
        """Where the next number starts."""
        return self.base + (int(self.ends[self.k - 1]) + 1 if self.k else 0)

    def next(self) -> int:
        while self.k >= len(self.ends):
            self._more()
        value, at = 0, int(self.ends[self.k - 1]) + 1 if self.k else 0
        for k, b in enumerate(self.raw[at : int(self.ends[self.k]) + 1]):
            value |= (b & 0x7F) << (7 * k)
        self.k += 1
        return value

    def skip(self, n: int) -> None:
        while n > len(self.ends) - self.k:
            n -= len(self.ends) - self.k
            self.k = len(self.ends)
            self._more()
        self.k += n


def _ranges(piece: int, range_bytes: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path in frame["path"]:
                _, start = header_of(path)
                with open_input(path) as f:
                    numbers, out = _Numbers(f, start, piece), []
                    while count := numbers.next():
                        first, ids = numbers.place(), []
                        for left in range(count - 1, -1, -1):
                            ids.append(numbers.next())
                            numbers.skip(5 * numbers.next())
                            if numbers.next():
                                numbers.skip(5 * numbers.next())
                            if not left or numbers.place() - first >= range_bytes:
                                out.append((path, first, numbers.place() - first, ids))
                                first, ids = numbers.place(), []
                if out:
                    yield pd.DataFrame(out, columns=["file", "first", "bytes", "blocks"])

    return run


def block_ranges(spark: SparkSession, path: str, piece: int = PIECE, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(file, first, bytes, blocks): stretches of whole blocks of the files of a path, with the blocks' numbers."""
    files = spark.read.format("binaryFile").load(path).select("path")
    return files.mapInPandas(_ranges(piece, range_bytes), RANGES)


def _decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for path, first, size, ids in zip(frame["file"], frame["first"], frame["bytes"], frame["blocks"], strict=True):
            with open_input(path) as f:
                f.seek(first)
                numbers = from_varints(f.read(size))
            for number, delayed, rows in blocks(np.concatenate([np.array([len(ids)], np.uint64), numbers, np.zeros(1, np.uint64)])):
                yield pd.DataFrame({"file": path, "block": number, "delayed": delayed} | {n: rows[:, k].astype(np.int64) for k, n in enumerate(FIELDS)})


def read_binary(spark: SparkSession, path: str, time_blocks: list[int] | None = None, piece: int = PIECE, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Events (file, block, delayed, detector_1, ...) of the files of a path, of some blocks if wanted; only ranges with such blocks are decoded."""
    ranges = block_ranges(spark, path, piece, range_bytes)
    if time_blocks is not None:
        ranges = ranges.filter(F.arrays_overlap("blocks", F.array(*[F.lit(int(b)) for b in time_blocks]).cast("array<long>")))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    out = ranges.repartition(parts, "file", "first").mapInPandas(_decode, EVENTS)
    return out if time_blocks is None else out.filter(F.col("block").isin(time_blocks))


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """(file, detector_id, x, y, z, bins, tof_range): the detectors of each file's header, with its time bins and their range."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for p in frame["path"]:
                h, _ = header_of(p)
                e = h["tof_bin_edges"] or [0.0]
                yield pd.DataFrame([{"file": p, "detector_id": d["id"], "x": d["x"], "y": d["y"], "z": d["z"], "bins": len(e) - 1, "tof_range": e[-1] - e[0]} for d in h["detectors"]])

    return spark.read.format("binaryFile").load(path).select("path").mapInPandas(run, "file string, detector_id long, x double, y double, z double, bins int, tof_range double")


def write_binary(events: DataFrame, folder: str, header: dict[str, Any], schema: str = "", file_events: int = FILE_EVENTS) -> DataFrame:
    """Write events (block, delayed, detector_1, ...) as files of whole blocks in order, of about ``file_events`` at most; (file, events) of what was written.

    A task holds a file's events at a time; a block is a unit of the format, and as such within one file. Names are unique, and only files of
    tasks that succeeded are in the result.
    """

    def write(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for number, b in frame.groupby("block", sort=True):
            late = b["delayed"].to_numpy(bool)
            each = b[list(FIELDS)].to_numpy(np.int64)
            out.append((int(number), each[~late], each[late] if late.any() else None))
        system, where = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        system.create_dir(where)
        name = f"{where}/{uuid.uuid4().hex}.bin"
        with system.open_output_stream(name) as f:
            f.write(encoded(header, out, schema))
        return pd.DataFrame({"file": [name], "events": [len(frame)]})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        n = 0
        for frame in frames:
            # what a block that is not the last one ends goes out once there is enough of it
            if n + len(frame) >= file_events:
                every = pd.concat([*held, frame])
                last = every["block"] == every["block"].iloc[-1]
                if not last.all():
                    yield write(every[~last])
                held = [every[last]]
            elif len(frame):
                held.append(frame)
            n = sum(map(len, held))
        if n:
            yield write(pd.concat(held))

    return events.repartition("block").sortWithinPartitions("block").select("block", "delayed", *FIELDS).mapInPandas(run, "file string, events long")


def read_ndjson(spark: SparkSession, path: str) -> DataFrame:
    """(block, delayed, detector_1, ...) of line-delimited JSON files."""
    rows = spark.read.text(path).select(F.from_json("value", BLOCK_JSON).alias("j")).filter("j.timeBlocks is not null").select("j.timeBlocks.*")

    def marked(column: str, delayed: bool) -> Column:
        return F.transform(F.coalesce(column, F.array().cast(f"array<{EVENT}>")), lambda e: F.struct(F.lit(delayed).alias("delayed"), e.alias("e")))

    both = F.concat(marked("promptEvents", False), marked("delayedEvents", True))
    names = ("detector1Id", "detector2Id", "tofIdx", "energy1Idx", "energy2Idx")
    return rows.select(F.col("id").alias("block"), F.explode(both).alias("x")).select("block", "x.delayed", *[F.col(f"x.e.{a}").alias(b) for a, b in zip(names, FIELDS, strict=True)])


def to_ndjson(events: DataFrame) -> DataFrame:
    """(value): a JSON line per time block, for ``write.text``. A block's events are one row, as in the format."""
    names = ("detector1Id", "detector2Id", "tofIdx", "energy1Idx", "energy2Idx")
    one = F.struct(*[F.col(b).cast("long").alias(a) for a, b in zip(names, FIELDS, strict=True)])
    grouped = events.groupBy("block").agg(F.collect_list(F.when(~F.col("delayed"), one)).alias("promptEvents"), F.collect_list(F.when(F.col("delayed"), one)).alias("delayedEvents"))
    return grouped.select(F.to_json(F.struct(F.struct(F.col("block").alias("id"), "promptEvents", F.when(F.size("delayedEvents") > 0, F.col("delayedEvents")).alias("delayedEvents")).alias("timeBlocks"))).alias("value"))


DETECTOR_JSON = "struct<id:bigint,x:double,y:double,z:double>"
SCANNER_JSON = f"struct<modelName:string,detectors:array<{DETECTOR_JSON}>,tofBinEdges:array<double>,tofResolution:double,energyBinEdges:array<double>,energyResolutionAt511:double,listmodeTimeBlockDuration:bigint>"
EXAM_JSON = "struct<subject:struct<name:string,id:string>,institution:struct<name:string,address:string>,protocol:string,startOfAcquisition:string>"
OPENING_JSON = f"yardl struct<version:int>, header struct<scanner:{SCANNER_JSON},exam:{EXAM_JSON}>"


def header_json(h: dict[str, Any]) -> str:
    """The header line of a JSON stream; what is null is left out. The start of an acquisition is in nanoseconds since 1970, written as text."""
    scanner = {
        "modelName": h.get("model_name"), "detectors": h["detectors"], "tofBinEdges": h["tof_bin_edges"], "tofResolution": h["tof_resolution"], "energyBinEdges": h["energy_bin_edges"],
        "energyResolutionAt511": h["energy_resolution_at_511"], "listmodeTimeBlockDuration": h["block_duration_ms"],
    }
    out: dict[str, Any] = {"scanner": {k: v for k, v in scanner.items() if v is not None}}
    if e := h.get("exam"):
        subject = {"name": e["subject_name"], "id": e["subject_id"]}
        start = None if e["start_ns"] is None else f"{np.datetime64(e['start_ns'], 'ns')}"
        exam = {"subject": {k: v for k, v in subject.items() if v is not None}, "institution": {"name": e["institution"], "address": e["address"]}, "protocol": e["protocol"], "startOfAcquisition": start}
        out["exam"] = {k: v for k, v in exam.items() if v is not None}
    return json.dumps({"header": out}, ensure_ascii=False, separators=(",", ":"))


def write_ndjson(events: DataFrame, folder: str, header: dict[str, Any], schema: str = "{}") -> DataFrame:
    """Write events (block, delayed, detector_1, ...) as JSON streams, one a task, each with its opening line, its header and its blocks in order; (file, blocks)."""
    lines = to_ndjson(events).withColumn("block", F.get_json_object("value", "$.timeBlocks.id").cast("long"))
    opening = json.dumps({"yardl": {"version": VERSION, "schema": json.loads(schema)}}, separators=(",", ":")) + "\n" + header_json(header) + "\n"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, where = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        name, n, f = f"{where}/{uuid.uuid4().hex}.ndjson", 0, None
        for frame in frames:
            if f is None and len(frame):
                system.create_dir(where)
                f = system.open_output_stream(name)
                f.write(opening.encode())
            for line in frame["value"]:
                f.write(line.encode() + b"\n")
            n += len(frame)
        if f is not None:
            f.close()
            yield pd.DataFrame({"file": [name], "blocks": [n]})

    return lines.repartition("block").sortWithinPartitions("block").select("value").mapInPandas(run, "file string, blocks long")


def ndjson_headers(spark: SparkSession, path: str) -> DataFrame:
    """(file, header) of JSON streams; a file without the opening line of version 1, or with any number of headers but one, is an error."""
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), F.from_json("value", OPENING_JSON).alias("j"))
    per = lines.groupBy("file").agg(F.max("j.yardl.version").alias("version"), F.count("j.header").alias("n"), F.first("j.header", ignorenulls=True).alias("header"))
    wrong = F.raise_error(F.concat(F.col("file"), F.lit(" is not a listmode stream of version 1 with one header")))
    return per.select("file", F.when((F.col("version") == VERSION) & (F.col("n") == 1), F.col("header")).otherwise(wrong).alias("header"))


def scanner_of_ndjson(spark: SparkSession, path: str) -> DataFrame:
    """(file, detector_id, x, y, z, bins, tof_range), as ``read_headers`` of binary streams."""
    rows = ndjson_headers(spark, path).select("file", F.col("header.scanner").alias("s"))
    edges = F.col("s.tofBinEdges")
    span = F.coalesce(F.element_at(edges, -1) - F.get(edges, F.lit(0)), F.lit(0.0))
    return rows.select("file", F.explode("s.detectors").alias("d"), F.greatest(F.size(edges) - 1, F.lit(0)).alias("bins"), span.alias("tof_range")).select("file", F.col("d.id").alias("detector_id"), "d.x", "d.y", "d.z", "bins", "tof_range")
