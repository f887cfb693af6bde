"""Intermediate tables and files in the folder that the driver and all executors share.

The folder is the session's ``spark.checkpoint.dir``. Where that is unset and Spark runs in one process
(tests), a temporary folder of this process stands in for it; on a cluster an unset folder is an error.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from functools import lru_cache
from urllib.parse import urlparse

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """URI of the shared folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="radonframe-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return f"file://{_own[0]}"


def new_folder(spark: SparkSession, label: str) -> str:
    """URI of a fresh folder name; nothing is created yet."""
    return f"{shared_root(spark)}/radonframe/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str, group_rows: int | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends here, and a lost executor costs no more than its running tasks.

    group_rows: rows of a file's row group, for rows of megabytes: else a writer holds a hundred before it looks at their size, and Spark's reader a whole group.
    """
    spark = df.sparkSession
    path = new_folder(spark, label)
    out = df.write.option("compression", "zstd")
    (out if group_rows is None else out.option("parquet.block.row.count.limit", group_rows)).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` as a staged table with a number for each row, and the name of its column. Nothing else tells repeated rows apart."""
    name = next(x for x in (f"row_{k}" for k in range(len(docs.columns) + 1)) if x not in docs.columns)
    return stage(docs.withColumn(name, F.monotonically_increasing_id()), "numbered"), name


@lru_cache(4)
def _ids(uri: str) -> pa.Array:
    files, folder = open_fs(uri)
    none = [pa.array([], pa.int64())]
    if files.get_file_info(folder).type == fs.FileType.NotFound:
        return none[0]
    found = [x.path for x in files.get_file_info(fs.FileSelector(folder)) if x.path.endswith(".parquet")]
    return pa.concat_arrays(none + [c for x in found for c in pq.read_table(x, filesystem=files, columns=["id"], partitioning=None).column("id").chunks])


def chosen(rows: DataFrame, name: str, ids: DataFrame) -> Column:
    """Whether a row of ``numbered`` rows is one of ``ids`` (one column): a task reads the ids of its own part of the rows from a shared file, so the rows are not shuffled."""
    path = new_folder(rows.sparkSession, "chosen")
    at = ids.toDF("id").withColumn("part", F.shiftright("id", 33))  # the part that numbered the row
    at.repartition("part").write.partitionBy("part").option("compression", "zstd").parquet(path)

    @F.arrow_udf("boolean")
    def is_chosen(row: pa.Array) -> pa.Array:
        parts = pc.unique(pc.shift_right(row, pa.scalar(33, pa.int64())))
        return pc.is_in(row, value_set=pa.concat_arrays([_ids(f"{path}/part={k}") for k in parts.to_pylist()] or [pa.array([], pa.int64())]))

    return is_chosen(F.col(name))


def drop(*tables: DataFrame) -> None:
    """Remove staged tables that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a shared URI, and the path in it; works in tasks."""
    if not urlparse(uri).scheme:
        uri = f"file://{uri}"
    elif uri.startswith("file:/") and not uri.startswith("file://"):
        uri = f"file://{uri[5:]}"
    return fs.FileSystem.from_uri(uri)
