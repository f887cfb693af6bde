"""Emission projections from frames: what camera files hold, frame by frame, as tables of angles, radii and counts.

Frames are a table (frame, window, slot, pixels): the number of the frame in its file, its energy window and time slot, and its rows of
pixels. Rotations are a table, one row for each detector: (detector, views, start, step, direction, radial): angles in degrees, direction
``CC`` or ``CCW`` or any other, radial positions in mm, one for each view or one for all; a column offsets (mm), if there is one, is added to them.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import ranges
from .imaging import header_value, read_header, view_angles

NUMBERS = {("unsignedinteger", 1): "u1", ("unsignedinteger", 2): "<i2", ("unsignedinteger", 4): "<i4", ("int", 2): "<i2", ("int", 4): "<i4", ("shortfloat", 4): "<f4", ("shortfloat", 8): "<f8"}


def views(rotations: DataFrame) -> DataFrame:
    """(view, a, angle, radius) of all detectors' views: view in the order of frames, detector by detector; a in the order of angles.

    Angles are those of the detector, half a turn from the file's, in [0, 360); radii are in cm. As many rows as a scan has views.
    """
    k = F.col("k").cast("double")
    forward = F.upper("direction").isin("CC", "CCW")
    own = F.col("radial")[F.when(F.size("radial") > 1, F.col("k")).otherwise(0)] / 10
    if "offsets" in rotations.columns:
        own = own + F.coalesce(F.col("offsets")[F.col("k")], F.lit(0.0)) / 10
    rows = rotations.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("views") - 1)))
    turned = F.when(forward, F.col("start") + F.col("step") * k).otherwise(F.col("start") - F.col("step") * k) + 180
    rows = rows.select("detector", "k", F.pmod(turned, F.lit(360.0)).alias("angle"), own.alias("radius"))
    view = F.row_number().over(Window.orderBy("detector", "k")) - 1
    a = F.row_number().over(Window.orderBy("angle", "view")) - 1
    return rows.withColumn("view", view).select("view", "angle", "radius").withColumn("a", a)


def projections(frames: DataFrame, rotations: DataFrame) -> DataFrame:
    """(window, slot, a, r, z, value): a window's and slot's frames in order are the views; columns of pixels are r, rows from the last one up are z."""
    view = F.row_number().over(Window.partitionBy("window", "slot").orderBy("frame")) - 1
    # numbers first: pixels are joined to them, not sorted
    numbers = frames.select("frame", "window", "slot", view.alias("view")).join(views(rotations).select("view", "a"), "view").select("frame", "a")
    lines = frames.join(numbers, "frame").select("window", "slot", "a", F.size("pixels").alias("rows"), F.posexplode("pixels").alias("row", "line"))
    return lines.select("window", "slot", "a", (F.col("rows") - 1 - F.col("row")).alias("z"), F.posexplode("line").alias("r", "value")).select("window", "slot", "a", "r", "z", F.col("value").cast("double").alias("value"))


def chosen(counts: DataFrame, window: int | None = None, slot: int | None = None) -> DataFrame:
    """The projections of one energy window, one time slot, or all."""
    for column, number in (("window", window), ("slot", slot)):
        if number is not None:
            counts = counts.filter(F.col(column) == number)
    return counts


def metadata(frames: DataFrame, spacing: tuple[float, float]) -> DataFrame:
    """One row: pixels (columns, rows) and spacing in cm of the projections, and the shape and spacing of the object; spacing in mm."""
    columns, rows = F.size(F.col("pixels")[0]), F.size("pixels")
    dx, dz = (F.lit(x / 10) for x in spacing)
    size = frames.agg(F.max(columns).alias("nr"), F.max(rows).alias("nz"))
    return size.select("nr", "nz", dx.alias("dr"), dz.alias("dz"), F.col("nr").alias("nx"), F.col("nr").alias("ny"))


def window_width(lower: Column, upper: Column) -> Column:
    return upper - lower


def windows_of(header: DataFrame) -> DataFrame:
    """(file, lower, upper, width) of the energy window in each text header."""
    lower, upper = (header_value(header, f"^energy window {x} level").select("file", F.col("values")[0].alias(x)) for x in ("lower", "upper"))
    return lower.join(upper, "file").withColumn("width", window_width(F.col("lower"), F.col("upper")))


def _facts(spark: SparkSession, path: str) -> dict[str, str]:
    """A header's first value of each key: a file of some dozens of lines."""
    out: dict[str, str] = {}
    for r in read_header(spark, path).collect():
        out.setdefault(r["key"], r["value"])
    return out


def _planes(spark: SparkSession, path: str, facts: dict[str, str], dtype: str) -> DataFrame:
    data = os.path.join(os.path.dirname(path), facts["name of data file"])
    return ranges.read_planes(spark, data, int(facts["matrix size [2]"]), int(facts["matrix size [1]"]), dtype)


def read_simulated(spark: SparkSession, path: str) -> DataFrame:
    """(a, r, z, value) of a simulator's projections, by their text header: rows of a plane from the last one up are z."""
    facts = _facts(spark, path)
    kind = NUMBERS[facts["number format"].replace(" ", ""), int(facts["number of bytes per pixel"])]
    rows = int(facts["matrix size [2]"])
    planes = _planes(spark, path, facts, kind).filter(F.col("plane") < int(facts["total number of images"]))
    return planes.select(F.col("plane").alias("a"), F.col("column").alias("r"), (F.lit(rows - 1) - F.col("row")).alias("z"), "value")


def simulated_views(spark: SparkSession, path: str, scale: float = 1.0, radii: DataFrame | None = None) -> DataFrame:
    """(a, angle, radius) of a simulator's header; scale: cm per unit of length; radii: (a, radius) of an orbit that is no circle, in the same unit."""
    f = _facts(spark, path)
    n = int(f["number of projections"])
    angles = view_angles(-float(f["start angle"]), float(f["extent of rotation"]), n, f["direction of rotation"].replace(" ", "") == "CW")
    rows = spark.range(1).select(F.posexplode(angles).alias("a", "angle"))
    if radii is None:
        return rows.withColumn("radius", F.lit(float(f["radius"]) * scale))
    return rows.join(radii.select("a", (F.col("radius") * scale).alias("radius")), "a")


def read_simulated_attenuation(spark: SparkSession, path: str, castor: bool = False) -> DataFrame:
    """(x, y, z, value) of a simulator's attenuation map: z reversed, and y too in the other of its two formats."""
    facts = _facts(spark, path)
    ny, nz = int(facts["matrix size [2]"]), int(facts["matrix size [3]"])
    planes = _planes(spark, path, facts, "<f4").filter(F.col("plane") < nz)
    y = F.lit(ny - 1) - F.col("row") if castor else F.col("row")
    return planes.select(F.col("column").alias("x"), y.alias("y"), (F.lit(nz - 1) - F.col("plane")).alias("z"), "value")
