"""Raw files in byte ranges: tasks read records of a fixed size from where they are due, so that a file is neither one row nor one task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RANGE_BYTES = 8 << 20


def open_input(uri: str):
    """A file of any system that pyarrow knows, by a URI as Spark gives it or a plain path."""
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = f"file://{uri[5:]}"
    system, where = fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")
    return system.open_input_file(where)


def read_records(spark: SparkSession, path: str, record_bytes: int, decode: Callable[[str, int, bytes], Iterator[pa.RecordBatch]], schema: str, skip: int = 0, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Rows that ``decode(file, first record, bytes)`` makes of the whole records of each file, after ``skip`` bytes, range by range."""
    each = max(1, range_bytes // record_bytes)
    files = spark.read.format("binaryFile").load(path).select("path", F.floor((F.col("length") - skip) / record_bytes).alias("records")).filter("records > 0")
    ranges = files.select("path", "records", F.explode(F.sequence(F.lit(0).cast("long"), F.col("records") - 1, F.lit(each).cast("long"))).alias("first"))
    ranges = ranges.select("path", "first", F.least(F.lit(each), F.col("records") - F.col("first")).alias("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                with open_input(r["path"]) as f:
                    f.seek(skip + r["first"] * record_bytes)
                    yield from decode(r["path"], r["first"], f.read(r["n"] * record_bytes))

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return ranges.repartition(parts, "path", "first").mapInArrow(run, schema)


def read_planes(spark: SparkSession, path: str, rows: int, columns: int, dtype: str, skip: int = 0, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(file, plane, row, column, value) of files that are planes of rows of numbers, one after the other."""
    kind = np.dtype(dtype)
    row, column = (x.ravel().astype(np.int32) for x in np.divmod(np.arange(rows * columns), columns))

    def decode(file: str, first: int, data: bytes) -> Iterator[pa.RecordBatch]:
        values = np.frombuffer(data, kind).reshape(-1, rows * columns)
        for k, plane in enumerate(values):
            n = len(plane)
            yield pa.RecordBatch.from_arrays([pa.array([file] * n), pa.array(np.full(n, first + k, np.int32)), pa.array(row), pa.array(column), pa.array(plane.astype(float))], ["file", "plane", "row", "column", "value"])

    return read_records(spark, path, rows * columns * kind.itemsize, decode, "file string, plane int, row int, column int, value double", skip, range_bytes)
