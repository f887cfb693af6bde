"""Cutting the lineage of iterative jobs."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and written to the session's checkpoint folder, which survives the loss of executors.

    An iterate refers to the one before it more than once, so an uncut plan would double with every iteration.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not folder:
            folder = tempfile.mkdtemp(prefix="radonframe-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.setCheckpointDir(folder)
    return df.checkpoint()


def kept(df: DataFrame, key: str) -> DataFrame:
    """``df`` computed once, dealt to tasks by ``key``; later joins and groupings by that key need no shuffle of it."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(df.repartition(parts, key))
